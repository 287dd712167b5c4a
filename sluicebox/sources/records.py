"""Delimited files read as whole records, in the order of file and position, without unsplitting them.

A line belongs to the record before it if the quotes before it in its file are odd in number. The
first pass counts, for each block of a file, its lines, its quotes, and the records that begin in it
for either parity; running sums over the blocks give each block its parity and first record number.
The second pass numbers the records, joins their lines and parses them by the structural index. Lines
are never shuffled; only records that cross the end of a block are put together afterwards.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.functions.ragged import utf8_buffers
from sluicebox.operators.parse_rejects import COLUMN_COUNT, RecordFormat, parse_column
from sluicebox.session import cut_lineage

QUOTE, RETURN = 34, 13
_COUNTS = "path string, start bigint, quotes bigint, even bigint, odd bigint"


def _quotes_and_blanks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes of each line, and whether there is nothing on it."""
    data, offsets = utf8_buffers(lines)
    quotes = np.diff(np.searchsorted(np.flatnonzero(data == QUOTE), offsets))
    length = np.diff(offsets)
    blank = length == 0
    one = length == 1
    blank[one] = data[offsets[:-1][one]] == RETURN
    return quotes, blank


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Spans of rows in which none of the columns changes."""
    change = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each block, and records that begin in it if the quotes before it are even, or odd, in number."""
    now, held = None, [0, 0, 0]
    done: list[tuple] = []
    for batch in batches:
        quotes, blank = _quotes_and_blanks(batch.column(0))
        names = batch.column(1).dictionary_encode()
        start = batch.column(2).to_numpy()
        for a, b in _runs(names.indices.to_numpy(), start):
            block = (names[a].as_py(), int(start[a]))
            if block != now:
                if now:
                    done.append((*now, *held))
                now, held = block, [0, 0, 0]
            before = (held[0] + np.cumsum(quotes[a:b]) - quotes[a:b]) & 1
            held[0] += int(quotes[a:b].sum())
            held[1] += int(((before == 0) & ~blank[a:b]).sum())
            held[2] += int(((before == 1) & ~blank[a:b]).sum())
    if now:
        done.append((*now, *held))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "start", "quotes", "even", "odd"])


def _blocks(lines: DataFrame) -> DataFrame:
    """(path, start, block, open, base): blocks in order, whether a record is open at their begin, and the records before them, headers aside."""
    counts = cut_lineage(lines.select("value", "path", "start").mapInArrow(_count_blocks, _COUNTS))  # one row for each block
    within = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parted = counts.withColumn("open", F.coalesce(F.sum("quotes").over(within), F.lit(0)) % 2 == 1).withColumn("first", F.row_number().over(Window.partitionBy("path").orderBy("start")) == 1)
    parted = parted.withColumn("own", F.when(F.col("open"), F.col("odd")).otherwise(F.col("even")) - F.col("first").cast("bigint"))
    order = Window.orderBy("path", "start")
    base = F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends_open = F.col("open") != (F.col("quotes") % 2 == 1)
    return cut_lineage(parted.select("path", "start", F.row_number().over(order).alias("block"), "open", "first", base.alias("base"), ends_open.alias("ends_open")))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, part, record): whole records have part 0; pieces of one that crosses the end of its block, their block's number."""
    names = ["number", "part", "record"]
    now, odd, count, held, number, head = None, False, 0, [], 0, False

    def pieces(block: int) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block], pa.int32()), pa.array(["\n".join(held)])], names=names)
            held.clear()

    for batch in batches:
        lines, block = batch.column(0), batch.column(1).to_numpy()
        quotes, blank = _quotes_and_blanks(lines)
        for a, b in _runs(block):
            if block[a] != now:
                if now is not None:
                    yield from pieces(now)
                now, odd, head = int(block[a]), batch.column(2)[a].as_py(), batch.column(3)[a].as_py()
                count, number = batch.column(4)[a].as_py() - int(head), batch.column(4)[a].as_py() - 1
            total = np.cumsum(quotes[a:b]) + int(odd)
            before, after = (total - quotes[a:b]) & 1 == 1, total & 1 == 1
            odd = bool(after[-1])
            begins = ~before & ~blank[a:b]
            numbers = count + np.cumsum(begins) - 1
            count += int(begins.sum())
            whole = begins & ~after
            if head and len(numbers):  # the header is no record
                whole &= numbers >= batch.column(4)[a].as_py()
            at = np.flatnonzero(whole)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(np.zeros(len(at), np.int32)), lines.slice(a, b - a).take(pa.array(at))], names=names)
            first = batch.column(4)[a].as_py()
            joined = []
            for i in np.flatnonzero(before | (begins & after)).tolist():
                if begins[i]:
                    number = int(numbers[i])
                held.append(lines[a + i].as_py())
                if after[i]:
                    continue
                if number < first - int(head):  # it was begun in an earlier block
                    yield from pieces(now)
                elif number >= first:
                    joined.append((number, "\n".join(held)))
                held.clear()
            if joined:
                found, texts = zip(*joined)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.zeros(len(found), np.int32)), pa.array(texts)], names=names)
    if now is not None:
        yield from pieces(now)


def numbered_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(number, record, broken): the records of the files but their headers, numbered in the order of path and position.

    Blank lines are no records. A record that spans more than two blocks is taken for an open quote:
    its pieces come out as they are, ``broken``. Numbers are consecutive.
    """
    lines = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    blocks = _blocks(lines)
    # one row for each block of a file: about a megabyte for a terabyte
    placed = lines.join(F.broadcast(blocks), ["path", "start"]).select("value", "block", "open", "first", "base")
    found = placed.mapInArrow(_assemble, "number bigint, part int, record string")
    whole = found.where("part = 0").select("number", "record", F.lit(False).alias("broken"))
    if blocks.where("open OR ends_open").isEmpty():
        return whole
    pieces = cut_lineage(found.where("part > 0"))
    counted = pieces.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    few = pieces.join(counted.where("n <= 2"), "number").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p["record"]), "\n").alias("record"))
    many = pieces.join(counted.where("n > 2"), "number").select("number", "record", F.lit(True).alias("broken"))
    return whole.unionByName(few.select("number", "record", F.lit(False).alias("broken"))).unionByName(many)


def header_of(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Column names of the files; none where they are empty."""
    first = spark.read.text(paths, lineSep="\n").limit(1).collect()
    return next(csv.reader([first[0].value.lstrip("\ufeff").rstrip("\r")]), []) if first else []


def _padded(record: str, width: int) -> str:
    """A record with as many empty fields at its end as it lacks."""
    record = record.removesuffix("\r")
    return record + "," * (width - len(next(csv.reader([record]))))


def read_records(spark: SparkSession, paths: str | list[str], names: list[str], order: str = "row_index") -> DataFrame:
    """(order, record, reason, c0, c1, ...): the records of the files and their fields.

    ``reason`` is null, or bad_quoting, or column_count where there are more fields than ``names``;
    ``record`` is the text of those alone. Missing fields at the end, and empty ones, are null.
    """
    form, width = RecordFormat(tuple(names)), len(names)
    fields = [f"c{i}" for i in range(width)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = batch.column(1)
            # a lone quote stands for what is broken anyway
            why, parsed = parse_column(pc.if_else(batch.column(2), '"', records), form)
            if (short := np.flatnonzero(why == COLUMN_COUNT)).size:
                texts = records.to_pylist()
                for i in short.tolist():
                    texts[i] = _padded(texts[i], width)
                why, parsed = parse_column(pc.if_else(batch.column(2), '"', pa.array(texts, pa.string())), form)
            bad = np.array([w is not None for w in why], bool)
            place = pa.array(np.cumsum(~bad) - 1, mask=bad)
            columns = [pc.if_else(pc.equal(p, ""), pa.scalar(None, p.type), p).cast(pa.string()).take(place) for p in parsed]
            kept = pc.if_else(pa.array(bad), records, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, pa.array(why, pa.string()), *columns], names=[order, "record", "reason", *fields])

    schema = f"`{order}` bigint, record string, reason string" + "".join(f", {f} string" for f in fields)
    return numbered_records(spark, paths).mapInArrow(parse, schema)
