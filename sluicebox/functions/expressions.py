"""Scalar cleaning expressions, Column to Column, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode calls white space.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: Each date shape with its parse pattern (slashes of year-first dates become hyphens); years outside YEARS are no dates.
YEAR_FIRST = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
MONTH_FIRST = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
DAY_FIRST = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"
YEARS = (1678, 2261)


def normalise_string(column: Column) -> Column:
    """Text without Unicode white space around it; null becomes empty. A text between two visible ASCII characters is left as it is."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    trimmed = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(trimmed, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def number_of(text: Column) -> Column:
    """A plain decimal number as double; anything else (1d, inf, 0x10, 1,000) is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def price_of(text: Column) -> Column:
    """Number, or 0.0 where it can't be read."""
    return F.coalesce(number_of(text), F.lit(0.0))


def quantity_of(text: Column) -> Column:
    """Whole number, halves to even; 0 where it can't be read or is negative or beyond bigint."""
    number = F.rint(F.greatest(price_of(text), F.lit(0.0)))
    return F.coalesce(number.try_cast("bigint"), F.lit(0))


def discount_of(text: Column) -> Column:
    """Fraction clipped to 0..1; 0.0 where it can't be read."""
    return F.least(F.greatest(price_of(text), F.lit(0.0)), F.lit(1.0))


def email_of(text: Column) -> Column:
    """Lower-cased address of a plausible shape, else null."""
    return F.when(text.rlike(EMAIL), F.lower(text))


def date_of(text: Column) -> Column:
    """Date in one of four shapes, else null."""
    moment = (
        F.when(text.rlike(YEAR_FIRST), F.try_to_timestamp(F.translate(text, "/", "-"), F.lit("y-M-d")))
        .when(text.rlike(MONTH_FIRST), F.try_to_timestamp(text, F.lit("M/d/y")))
        .when(text.rlike(DAY_FIRST), F.try_to_timestamp(text, F.lit("d-M-y")))
    )
    return moment.cast("date")


def plausible_date(date: Column) -> Column:
    return F.when(F.year(date).between(*YEARS), date)


def clean_price(column: Column) -> Column:
    return price_of(normalise_string(column))


def clean_quantity(column: Column) -> Column:
    return quantity_of(normalise_string(column))


def clean_discount(column: Column) -> Column:
    return discount_of(normalise_string(column))


def clean_email(column: Column) -> Column:
    return email_of(normalise_string(column))


def parse_order_date(column: Column) -> Column:
    return plausible_date(date_of(normalise_string(column)))


def epoch_seconds(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * 86_400


def month_key(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def in_date_range(date: Column, as_of: Column, years_back: int = 20, years_ahead: int = 1) -> Column:
    """Within the years before and after ``as_of``, both ends included."""
    return date.between(F.add_months(as_of, -12 * years_back), F.add_months(as_of, 12 * years_ahead))


def order_revenue(price: Column, quantity: Column, discount: Column) -> Column:
    """Price times quantity less discount, to two places, in decimal arithmetic; null beyond its range."""
    gross = F.try_multiply(price.try_cast("decimal(18,4)"), quantity.try_cast("decimal(12,0)"))
    return F.round(F.try_multiply(gross.try_cast("decimal(24,4)"), (F.lit(1) - discount.cast("decimal(10,6)")).cast("decimal(10,6)")), 2).cast("double")


def heavy_discount_flag(discount: Column, above: float = 0.80) -> Column:
    return F.when(discount > above, F.lit("heavy_discount"))


def title_case(column: Column) -> Column:
    """Upper case after anything that is no letter, lower case after a letter."""
    letters = F.split(F.lower(column), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def fill_label(column: Column, label: str = "UNKNOWN") -> Column:
    return F.coalesce(column.cast("string"), F.lit(label))


def file_label(stem: Column) -> Column:
    """A file stem as a title."""
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))


def count_label(reason: Column, count: Column) -> Column:
    return F.concat(reason, F.lit(" ("), F.format_number(count, 0), F.lit(")"))
