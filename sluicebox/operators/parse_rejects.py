"""Delimited records parsed by a structural index, faulty ones set apart with the reason.

The bytes of a whole Arrow batch are indexed at once: a quote mask, the parity of the quotes before
each byte of its record, and from both the delimiters and record ends. Records never leave their
partition and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.ragged import strings_from_spans, utf8_buffers

QUOTE, COMMA, RETURN = 34, 44, 13
BAD_QUOTING, COLUMN_COUNT = "bad_quoting", "column_count"


@dataclass(frozen=True)
class NumberRule:
    """A field that must be a number written in digits 0-9.

    ``whole`` allows no point. ``low`` and ``high`` bound the value; ``low_open`` and ``high_open``
    leave the bound itself out.
    """

    column: int
    reason: str
    whole: bool = False
    low: float = 0.0
    high: float = float("inf")
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class RecordFormat:
    columns: tuple[str, ...]
    rules: tuple[NumberRule, ...] = field(default_factory=tuple)


SALES_FORMAT = RecordFormat(
    ("order_id", "product_name", "category", "quantity", "unit_price", "discount_percent", "region", "sale_date", "customer_email", "revenue"),
    (
        NumberRule(3, "bad_quantity", whole=True, low=1),
        NumberRule(4, "bad_unit_price", high=50000, low_open=True, high_open=True),
        NumberRule(5, "bad_discount_percent", high=1),
    ),
)


def _spread(flags_at: np.ndarray, count: int) -> np.ndarray:
    hit = np.zeros(count, bool)
    hit[flags_at] = True
    return hit


def structural_index(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Delimiter positions, index of each record's first delimiter, record ends, and which records are ill-quoted."""
    count = len(offsets) - 1
    begin, end = offsets[:-1], offsets[1:].copy()
    full = end > begin
    end[full] -= data[end[full] - 1] == RETURN
    quotes, commas = np.flatnonzero(data == QUOTE), np.flatnonzero(data == COMMA)
    quotes_before = np.searchsorted(quotes, begin)
    of_comma = np.searchsorted(offsets, commas, "right") - 1
    outside = (np.searchsorted(quotes, commas) - quotes_before[of_comma]) % 2 == 0
    delimiters = commas[outside]
    of_quote = np.searchsorted(offsets, quotes, "right") - 1
    opening = (np.arange(len(quotes)) - quotes_before[of_quote]) % 2 == 0
    padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)])
    left, right = padded[quotes], padded[quotes + 2]
    at_start, at_end = quotes == begin[of_quote], quotes + 1 == end[of_quote]
    fits = np.where(opening, at_start | (left == COMMA) | (left == QUOTE), at_end | (right == COMMA) | (right == QUOTE))
    per_record = np.searchsorted(quotes, offsets[1:]) - quotes_before
    ill = _spread(of_quote[~fits], count) | (per_record % 2 == 1)
    return delimiters, np.searchsorted(delimiters, begin), end, ill


def _field(data: np.ndarray, delimiters: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, column: int, width: int) -> pa.Array:
    """Text of one field of well-formed records: outer quotes off, doubled quotes single."""
    start = begin if column == 0 else delimiters[first + column - 1] + 1
    stop = end if column == width - 1 else delimiters[first + column]
    quoted = stop > start
    quoted[quoted] = data[start[quoted]] == QUOTE
    text = strings_from_spans(data, start + quoted, stop - quoted)
    return pc.replace_substring(text, '""', '"') if quoted.any() else text


def _obeys(text: pa.Array, rule: NumberRule) -> np.ndarray:
    text = pc.utf8_trim(text, " \t")
    shape = pc.match_substring_regex(text, "^[0-9]+$" if rule.whole else r"^[0-9]+(\.[0-9]+)?$")
    value = pc.cast(pc.if_else(shape, text, "0"), pa.float64()).to_numpy(zero_copy_only=False)
    low = value > rule.low if rule.low_open else value >= rule.low
    high = value < rule.high if rule.high_open else value <= rule.high
    return shape.to_numpy(zero_copy_only=False) & low & high


def parse_column(column: pa.Array | pa.ChunkedArray, form: RecordFormat) -> tuple[np.ndarray, list[pa.Array]]:
    """Reason for each record (None where valid), and the fields of the valid records in order."""
    data, offsets = utf8_buffers(column)
    delimiters, first, end, ill = structural_index(data, offsets)
    width = len(form.columns)
    fields = np.diff(np.append(first, len(delimiters))) + 1
    if column.null_count:
        fields[np.asarray(column.is_null())] = 0
    reason = np.where(ill, BAD_QUOTING, np.where(fields != width, COLUMN_COUNT, None)).astype(object)
    whole = np.flatnonzero(reason == None)  # noqa: E711 - elementwise
    first, begin, end = first[whole], offsets[:-1][whole], end[whole]
    for rule in form.rules:
        bad = ~_obeys(_field(data, delimiters, first, begin, end, rule.column, width), rule)
        at = whole[bad]
        reason[at] = rule.reason
        whole, first, begin, end = whole[~bad], first[~bad], begin[~bad], end[~bad]
    return reason, [_field(data, delimiters, first, begin, end, i, width) for i in range(width)]


def parse_records(df: DataFrame, line: str = "line", form: RecordFormat = SALES_FORMAT, reason: str = "reason", fields: str | None = "fields") -> DataFrame:
    """Each row of ``df`` with ``reason`` (null where the record is valid) and the parsed ``fields``.

    A reason is the first that holds of bad_quoting, column_count and the format's number rules. A
    null or empty line has too few columns. ``fields`` is an array of strings, null for a faulty
    record; None leaves it out. Line ends inside quoted fields stay; one carriage return at the end
    of a record is no part of it. Input columns named like the outputs are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (reason, fields)]
    if line not in [f.name for f in kept]:
        raise ValueError(f"no column {line!r}, or it is named like an output")
    schema = T.StructType([*kept, T.StructField(reason, T.StringType()), *([T.StructField(fields, T.ArrayType(T.StringType()))] if fields else [])])
    names = [f.name for f in kept]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(line))
            why, parsed = parse_column(column, form)
            arrays = [*batch.columns, pa.array(why, pa.string())]
            if fields:
                valid = np.asarray([w is None for w in why], bool)
                width = len(form.columns)
                flat = pa.concat_arrays([p.cast(pa.string()) for p in parsed]) if parsed else pa.array([], pa.string())
                good = int(valid.sum())
                order = np.arange(good * width).reshape(width, good).T.reshape(-1)
                sizes = np.where(valid, width, 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(order)), mask=pa.array(~valid))
                arrays.append(listed)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(parse, schema)


def valid_rows(parsed: DataFrame, form: RecordFormat = SALES_FORMAT, reason: str = "reason", fields: str = "fields") -> DataFrame:
    """The valid records of ``parse_records`` as typed columns; whole numbers bigint, others double."""
    kinds = {r.column: "bigint" if r.whole else "double" for r in form.rules}
    taken = set(form.columns)
    keep = [F.col(f"`{c}`") for c in parsed.columns if c not in (reason, fields) and c not in taken]
    columns = [
        F.expr(f"try_cast(trim(BOTH ' \\t' FROM `{fields}`[{i}]) AS {kinds[i]})").alias(name) if i in kinds else F.col(fields)[i].alias(name)
        for i, name in enumerate(form.columns)
    ]
    return parsed.where(F.col(reason).isNull()).select(*keep, *columns)


def rejected_rows(parsed: DataFrame, reason: str = "reason", fields: str = "fields") -> DataFrame:
    """The faulty records with their reasons."""
    return parsed.where(F.col(reason).isNotNull()).drop(fields)
