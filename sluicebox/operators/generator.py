"""Seeded generator of order feeds, clean or dirty, without a driver loop.

Every value is an expression of the row number and the seed, so any number of rows is made in
parallel and comes out the same again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.lookups import CATEGORIES, REGION_MAP
from sluicebox.schemas import RAW_COLUMNS

#: Nouns and makers that product names are put together from.
THINGS = ("Charger", "Kettle", "Jacket", "Backpack", "Lamp", "Notebook", "Drill", "Puzzle", "Guitar", "Blender", "Tent", "Scarf", "Mug", "Monitor", "Rug", "Bottle", "Saw", "Collar", "Ring")
MAKERS = ("Orvane", "Keltis", "Brumo", "Sandre", "Tivoli", "Harlo", "Penrix")
COLOURS, SIZES = ("Black", "Blue", "Red", "Sand"), ("S", "M", "XL", "500ml", "2-Pack")
LETTERS, KEY_ROWS = "abcdefghijklmnopqrstuvwxyz", ("qwertyuiop", "asdfghjkl", "zxcvbnm")
DOMAINS = ("mail.example", "post.example", "shop.test", "office.example.org")
DATE_PATTERNS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
#: Odd quantities of dirty feeds, beside whole ones.
ODD_QUANTITIES = ("0", "-1", "50", "two", "many", "N/A", "3.5", "")
NO_VALUE = ("", "NULL", "N/A")


class OrderGenerator:
    """``rows(n)`` gives n raw orders; ``dirty`` mixes in what real feeds have."""

    def __init__(self, spark: SparkSession, seed: int = 0, dirty: bool = True, as_of: str = "2024-12-31") -> None:
        self.spark, self.seed, self.dirty, self.as_of = spark, seed, dirty, as_of

    def _draw(self, what: str) -> Column:
        """A uniform number in [0, 1) of the row, the seed and a name."""
        return F.pmod(F.xxhash64(F.col("id"), F.lit(self.seed), F.lit(what)), F.lit(1 << 40)) / float(1 << 40)

    def _pick(self, what: str, values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(self._draw(what) * len(values)) + 1).cast("int"))

    def _rare(self, what: str, share: float, odd: Column, usual: Column) -> Column:
        return F.when(self._draw(what) < share, odd).otherwise(usual) if self.dirty else usual

    def typo(self, text: Column, what: str, share: float) -> Column:
        """One slip with probability ``share``, of nine kinds alike.

        A letter is dropped, doubled, swapped with the next, put in the other case, replaced by its
        neighbour on the keyboard or by any letter, or a letter is put in; or a space is lost, or doubled.
        """
        at = (F.floor(self._draw(what + "at") * F.greatest(F.length(text) - 1, F.lit(1))) + 1).cast("int")
        head, one, two, tail = text.substr(F.lit(1), at - 1), text.substr(at, F.lit(1)), text.substr(at + 1, F.lit(1)), text.substr(at + 2, F.length(text))
        any_letter = F.substring(F.lit(LETTERS), (F.floor(self._draw(what + "letter") * len(LETTERS)) + 1).cast("int"), F.lit(1))
        beside = F.translate(F.lower(one), "".join(KEY_ROWS), "".join(row[1:] + row[-2] for row in KEY_ROWS))
        slips = (
            F.concat(head, two, tail),
            F.concat(head, one, one, two, tail),
            F.concat(head, two, one, tail),
            F.concat(head, F.when(F.lower(one) == one, F.upper(one)).otherwise(F.lower(one)), two, tail),
            F.concat(head, beside, two, tail),
            F.concat(head, any_letter, two, tail),
            F.concat(head, one, any_letter, two, tail),
            F.replace(text, F.lit(" "), F.lit("")),
            F.concat(head, one, F.lit(" "), two, tail),
        )
        kind = F.floor(self._draw(what + "kind") * len(slips)).cast("int")
        slip = reduce(lambda rest, i: F.when(kind == i, slips[i]).otherwise(rest), range(len(slips) - 1), slips[-1])
        return F.when((F.length(text) >= 2) & (self._draw(what) < share), slip).otherwise(text)

    def product(self) -> Column:
        """A product of the catalogue: a maker and a thing, or one of its variants in case, spacing, colour, size or order."""
        maker, thing = self._pick("maker", MAKERS), self._pick("product", THINGS)
        plain = F.concat_ws(" ", maker, thing)
        variants = (
            F.lower(plain), F.upper(plain), F.replace(plain, F.lit(" "), F.lit("")), F.replace(plain, F.lit(" "), F.lit("-")), F.replace(plain, F.lit(" "), F.lit("_")),
            F.concat_ws(" ", plain, self._pick("colour", COLOURS)), F.concat_ws(" ", plain, self._pick("size", SIZES)), F.concat_ws(" ", thing, maker),
        )
        which = F.floor(self._draw("variant") * len(variants) * 2).cast("int")
        return reduce(lambda rest, i: F.when(which == i, variants[i]).otherwise(rest), range(len(variants)), plain)

    def rows(self, count: int) -> DataFrame:
        thing = F.floor(self._draw("product") * len(THINGS)) + 1
        ids = self.spark.range(count).select("id", self.product().alias("product"), F.element_at(F.array(*map(F.lit, CATEGORIES)), thing.cast("int")).alias("own"))
        if self.dirty:  # names are made first and spoilt after, so that neither expression is repeated in the other
            ids = ids.withColumns({"product": self.typo(F.col("product"), "name typo", 0.05), "own": self.typo(F.col("own"), "category typo", 0.02)})
        order = F.format_string("ORD-%09d", F.col("id"))
        again = F.format_string("ORD-%09d", F.floor(F.col("id") * self._draw("again")))
        discount = F.when(self._draw("on sale") < 0.4, F.round(0.05 + self._draw("discount") * 0.4, 3)).otherwise(F.lit(0.0))
        odd_discount = F.when(self._draw("bad") < 0.17, F.round(self._draw("wild") * 2.6 - 0.1, 2)).otherwise(F.round(0.85 + self._draw("heavy") * 0.14, 2))
        discount = self._rare("odd discount", 0.06, odd_discount, discount)
        quantity = (F.floor(-F.log(1 - self._draw("quantity")) * 2) + 1).cast("string")
        quantity = self._rare("odd quantity", 0.15, self._pick("which quantity", ODD_QUANTITIES), quantity)
        price = F.round(F.exp(self._draw("price") * 6.5), 2)
        date = F.date_sub(F.lit(self.as_of).cast("date"), F.floor(F.pow(self._draw("age"), F.lit(1.5)) * 730).cast("int"))
        forms = F.element_at(F.array(*[F.date_format(date, p) for p in DATE_PATTERNS]), (F.floor(self._draw("form") * 4) + 1).cast("int"))
        sale_date = self._rare("no date", 0.10, self._pick("which date", NO_VALUE), forms) if self.dirty else F.date_format(date, "yyyy-MM-dd")
        name = F.format_string("user%05d", F.floor(self._draw("user") * 90_000))
        email = F.concat(name, F.lit("@"), self._pick("domain", DOMAINS))
        email = self._rare("bad email", 0.05, F.concat(name, F.lit("@")), self._rare("no email", 0.15, self._pick("which email", NO_VALUE), email))
        number = F.coalesce(quantity.try_cast("double").cast("bigint"), F.lit(0))
        revenue = F.round(price * F.greatest(number, F.lit(0)) * (1 - F.least(F.greatest(discount, F.lit(0.0)), F.lit(1.0))), 2)
        made = ids.select(
            self._rare("reused", 0.01, again, order).alias("order_id"),
            F.col("product").alias("product_name"),
            self._rare("wrong category", 0.10, self._pick("other", CATEGORIES), F.col("own")).alias("category"),
            quantity.alias("quantity"),
            price.cast("string").alias("unit_price"),
            discount.cast("string").alias("discount_percent"),
            self._pick("region", tuple(REGION_MAP)).alias("region"),
            sale_date.alias("sale_date"),
            email.alias("customer_email"),
            revenue.cast("string").alias("revenue"),
        )
        return made.select(*RAW_COLUMNS)
