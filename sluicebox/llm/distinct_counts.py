"""Distinct counts from hashed bitmaps (linear counting), mergeable by bitwise union.

An identifier sets one bit of a bitmap of fixed size, a power of two that is stored with it. A bitmap is
cut into slices of 2**SLICE bits; each is one packed value, its set positions while they are few and its
bits from then on, so neither a small group nor one of billions is ever a large object. Bitmaps are made
where the rows are read, and bitmaps of parts (partitions, batches, days) are merged by OR; the count
follows from the share of empty bits. For all combinations of groups, each task unites the bitmaps it has
under every combination before anything is shuffled, and only packed bitmaps travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, PART, MAP = "__size", "__slice", "__map"
#: Log of the bits in a slice, and the least bits of a bitmap.
SLICE, MIN_BITS = 20, 64
#: Positions that a task holds before it packs them.
HELD = 2_000_000


def relative_error(n: float, m: int) -> float:
    """Standard error of linear counting, relative to ``n`` identifiers in ``m`` bits."""
    if n <= 0:
        return 0.0
    load = n / m
    return math.inf if load > 500 else math.sqrt(m * (math.exp(load) - load - 1)) / n


def bitmap_size(most: int, error: float) -> int:
    """The least power of two of bits whose standard error stays below ``error`` up to ``most`` identifiers."""
    m = MIN_BITS
    while relative_error(most, m) > error:
        m *= 2
    return m


def bit_position(identifier: Column, m: int) -> Column:
    """Bit of an identifier: the low bits of its hash, so a bitmap folds to any smaller power of two."""
    return F.xxhash64(identifier.cast("string")).bitwiseAND(F.lit(m - 1))


def _dense_bytes(m: int) -> int:
    return min(m, 1 << SLICE) // 8


def _positions(packed: bytes, m: int) -> np.ndarray:
    """Set positions of one packed slice."""
    if len(packed) < _dense_bytes(m):
        return np.frombuffer(packed, np.uint32).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))


class _Bits:
    """Keys and positions that a task holds: keys as numbers of a dictionary for each column."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.known: list[dict] = [{} for _ in range(self.width)]
        self.ids: list[list[np.ndarray]] = [[] for _ in range(self.width)]
        self.slices: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.dense: dict[tuple, np.ndarray] = {}
        self.held, self.size = 0, 0

    def sized(self, m: int) -> None:
        if self.size and self.size != m:
            raise ValueError(f"bitmaps of {self.size} and {m} bits: fold them to one size first")
        self.size = m

    def _numbers(self, columns: list[pa.Array]) -> list[np.ndarray]:
        out = []
        for known, column in zip(self.known, columns):
            encoded = column.dictionary_encode()
            values = [*encoded.dictionary.to_pylist(), None]
            own = np.array([known.setdefault(v, len(known)) for v in values[: None if encoded.null_count else -1]] or [0], np.int64)
            out.append(own[encoded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)])
        return out

    def add(self, columns: list[pa.Array], slices: np.ndarray, places: np.ndarray) -> None:
        for held, own in zip(self.ids, self._numbers(columns)):
            held.append(own)
        self.slices.append(slices)
        self.places.append(places)
        self.held += len(places)

    def add_packed(self, columns: list[pa.Array], slices: np.ndarray, maps: pa.Array) -> None:
        """Packed slices: positions as they are, of bits only those that the group hasn't yet."""
        own = self._numbers(columns)
        lengths = np.diff(np.frombuffer(maps.buffers()[1], np.int32, len(maps) + 1, 4 * maps.offset))
        wide = lengths >= _dense_bytes(self.size)
        found = [np.empty(0, np.int64)] * len(maps)
        for i in range(len(maps)):
            packed = maps[i].as_buffer()
            if not wide[i]:
                found[i] = np.frombuffer(packed, np.uint32)
                continue
            key = (*(int(n[i]) for n in own), int(slices[i]))
            bits = np.frombuffer(packed, np.uint8)
            before = self.dense.setdefault(key, np.zeros(len(bits), np.uint8))
            found[i] = np.flatnonzero(np.unpackbits(bits & ~before))
            before |= bits
        times = np.fromiter(map(len, found), np.int64, len(found))
        for held, numbers in zip(self.ids, own):
            held.append(np.repeat(numbers, times))
        self.slices.append(np.repeat(slices, times))
        self.places.append(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64))
        self.held += int(times.sum()) + len(self.dense) * 1000

    def groups(self, kept: tuple[int, ...]) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
        """Of the union over all key columns but ``kept``: values of each column, slices, sorted positions, and where each group's begin."""
        slices = np.concatenate(self.slices)
        code = slices
        for i in kept:
            code = pd.factorize(code * len(self.known[i]) + np.concatenate(self.ids[i]))[0].astype(np.int64)
        code = pd.factorize(code)[0].astype(np.int64)
        row = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        row[code[::-1]] = np.arange(len(code))[::-1]
        bits = np.unique((code << SLICE) | np.concatenate(self.places))
        code = bits >> SLICE
        begin = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0])) if len(code) else np.zeros(0, np.int64)
        row = row[code[begin]]
        values = []
        for i, known in enumerate(self.known):
            names = list(known)
            values.append([names[n] for n in np.concatenate(self.ids[i])[row].tolist()] if i in kept else [None] * len(row))
        return values, slices[row], bits & ((1 << SLICE) - 1), begin

    def packed(self, kept: tuple[int, ...], types: list[pa.DataType]) -> tuple[list[pa.Array], pa.Array, pa.Array]:
        """Key columns, slices, and each group's packed slice."""
        values, slices, places, begin = self.groups(kept)
        ends = np.append(begin[1:], len(places))
        width = _dense_bytes(self.size)
        small = places.astype(np.uint32)
        maps = []
        for a, b in zip(begin.tolist(), ends.tolist()):
            if 4 * (b - a) < width:
                maps.append(small[a:b].tobytes())
            else:
                bits = np.zeros(width * 8, np.uint8)
                bits[places[a:b]] = 1
                maps.append(np.packbits(bits).tobytes())
        return [pa.array(v, t) for v, t in zip(values, types)], pa.array(slices, pa.int32()), pa.array(maps, pa.binary())


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _map_fields() -> list[T.StructField]:
    return [T.StructField(SIZE, T.LongType()), T.StructField(PART, T.IntegerType()), T.StructField(MAP, T.BinaryType())]


def _named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def bitmaps(df: DataFrame, keys: list[str], identifier: str, m: int) -> DataFrame:
    """(keys, __size, __slice, __map): one bitmap per group; a null identifier sets no bit, a null key is a group.

    Other columns are left out, whatever their names; an empty table has no bitmaps.
    """
    schema = T.StructType([*_key_fields(df, keys), *_map_fields()])
    width = len(keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, types = _Bits(width), []

        def full() -> Iterator[pa.RecordBatch]:
            if bits.held:
                columns, slices, maps = bits.packed(tuple(range(width)), types)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(maps), m)), slices, maps], names=schema.names)
                bits.clear()

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            place = batch.column(width).to_numpy()
            bits.sized(m)
            bits.add(batch.columns[:width], place >> SLICE, place & ((1 << SLICE) - 1))
            if bits.held >= HELD:
                yield from full()
        yield from full()

    rows = df.where(F.col(f"`{identifier}`").isNotNull()).select(*_named(keys), bit_position(F.col(f"`{identifier}`"), m).alias("__bit"))
    return _merged(rows.mapInArrow(build, schema), keys)


def union_bitmaps(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of the coarser ``keys``: the union over everything else. Bitmaps of different sizes are a ValueError."""
    schema = T.StructType([*_key_fields(parts, keys), *_map_fields()])
    return _merged(parts.select(*_named([*keys, SIZE, PART, MAP])).mapInArrow(_uniting(len(keys), schema.names, False), schema), keys)


def fold_bitmaps(parts: DataFrame, m: int) -> DataFrame:
    """The same bitmaps at the smaller size ``m``; a smaller bitmap than that is a ValueError."""
    if m < MIN_BITS or m & (m - 1):
        raise ValueError(f"{m} is no power of two of at least {MIN_BITS}")
    keys = [c for c in parts.columns if c not in (SIZE, PART, MAP)]
    schema = T.StructType([*_key_fields(parts, keys), *_map_fields()])
    width = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(width + 3)]):
                size, part, packed = row[width:]
                if size < m:
                    raise ValueError(f"a bitmap of {size} bits can't be folded to {m}")
                place = (np.int64(part) << SLICE | _positions(packed, size)) & (m - 1)
                # a slice lands in one slice: slices are as large as the smaller bitmap or divide it
                own = np.unique(place & ((1 << SLICE) - 1))
                if 4 * len(own) < _dense_bytes(m):
                    packed = own.astype(np.uint32).tobytes()
                else:
                    bits = np.zeros(_dense_bytes(m) * 8, np.uint8)
                    bits[own] = 1
                    packed = np.packbits(bits).tobytes()
                out.append((*row[:width], m, int(place[0] >> SLICE), packed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(i).type) for i, c in enumerate(zip(*out))], names=schema.names)

    return _merged(parts.select(*_named([*keys, SIZE, PART, MAP])).mapInArrow(fold, schema), keys)


def _uniting(width: int, names: list[str], ordered: bool):
    """Unite packed slices by key; ``ordered`` input comes sorted, and each group goes out once."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, types = _Bits(width), []

        def full() -> pa.RecordBatch:
            columns, slices, maps = bits.packed(tuple(range(width)), types)
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(maps), bits.size)), slices, maps], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(i).type for i in range(width)]
            for m in np.unique(batch.column(width).to_numpy()).tolist():
                bits.sized(m)
            bits.add_packed(batch.columns[:width], batch.column(width + 1).to_numpy().astype(np.int64), batch.column(width + 2))
            if bits.held >= HELD:
                made, size = full(), bits.size
                bits.clear()
                if ordered:  # the last group may go on
                    last = _last_group(batch, made, width)
                    bits.sized(size)
                    bits.add_packed(last.columns[:width], last.column(width + 1).to_numpy().astype(np.int64), last.column(width + 2))
                    made = made.filter(pa.array(~_same(made, last, width)))
                yield made
        if bits.held:
            yield full()

    return unite


def _same(made: pa.RecordBatch, last: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of ``made`` with the keys and slice of the one row ``last``."""
    same = np.ones(made.num_rows, bool)
    for i in [*range(width), width + 1]:
        value = last.column(i)[0].as_py()
        same &= np.array([v == value for v in made.column(i).to_pylist()])
    return same


def _last_group(batch: pa.RecordBatch, made: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The row of ``made`` with the keys and slice of the batch's last row."""
    return made.filter(pa.array(_same(made, batch.slice(batch.num_rows - 1, 1), width)))


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    by = _named([*keys, PART])
    schema = parts.schema
    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(_uniting(len(keys), schema.names, True), schema)


def _distinct_names(keys: list[str], outputs: list[str]) -> None:
    if clash := sorted(set(keys) & set(outputs)) or sorted({k for k in keys if keys.count(k) > 1}):
        raise ValueError(f"keys named like results, or twice: {clash}")


def _estimates(filled: Column, m: Column) -> list[Column]:
    """Estimate and relative standard error; null where the bitmap is full."""
    count = F.when(filled < m, -m * F.log(1 - filled / m.cast("double")))
    load = count / m
    return [F.round(count, 3).alias("estimate"), F.round(F.sqrt(m * (F.exp(load) - load - 1)) / count, 6).alias("std_error")]


def _filled(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filled, __size): set bits of whole bitmaps."""
    schema = T.StructType([*_key_fields(maps, keys), T.StructField(SIZE, T.LongType()), T.StructField("filled", T.LongType())])
    width = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(width).to_pylist()
            held = [
                len(packed) // 4 if len(packed) < _dense_bytes(m) else int(np.bitwise_count(np.frombuffer(packed, np.uint8)).sum(dtype=np.int64))
                for m, packed in zip(sizes, batch.column(width + 1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(held, pa.int64())], names=schema.names)

    return _totals(maps.select(*_named([*keys, SIZE, MAP])).mapInArrow(count, schema), keys)


def _totals(counted: DataFrame, keys: list[str]) -> DataFrame:
    found = counted.groupBy(*_named(keys)).agg(F.sum("filled").alias("filled"), F.min(SIZE).alias(SIZE), F.max(SIZE).alias("__most"))
    mixed = F.when(F.col(SIZE) != F.col("__most"), F.raise_error(F.lit("bitmaps of different sizes: fold them to one size first")).cast("bigint"))
    return found.select(*_named(keys), "filled", F.coalesce(mixed, F.col(SIZE)).alias(SIZE))


def count_groups(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filled, estimate, std_error) of bitmaps by ``keys``; a key named like a result is a ValueError."""
    _distinct_names(keys, ["filled", "estimate", "std_error"])
    return _filled(maps, keys).select(*_named(keys), "filled", *_estimates(F.col("filled"), F.col(SIZE)))


def count_combinations(maps: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """(level, keys, filled, estimate, std_error) for every combination of the keys, the empty one included.

    ``level`` names the keys that are kept, joined by commas ('' for the total); the others are null.
    """
    _distinct_names(keys, [level, "filled", "estimate", "std_error"])
    width = len(keys)
    options = [tuple(i for i in range(width) if kept >> i & 1) for kept in range(2**width)]
    names = [",".join(keys[i] for i in kept) for kept in options]
    fields = [T.StructField(level, T.StringType()), *_key_fields(maps, keys)]
    schema = T.StructType([*fields, *_map_fields()])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, types = _Bits(width), []

        def full() -> Iterator[pa.RecordBatch]:
            if not bits.held:
                return
            for kept, name in zip(options, names):
                columns, slices, packed = bits.packed(kept, types)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(packed)), *columns, pa.array(np.full(len(packed), bits.size)), slices, packed], names=schema.names)
            bits.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(i).type for i in range(width)]
            for m in np.unique(batch.column(width).to_numpy()).tolist():
                bits.sized(m)
            bits.add_packed(batch.columns[:width], batch.column(width + 1).to_numpy().astype(np.int64), batch.column(width + 2))
            if bits.held >= HELD:
                yield from full()
        yield from full()

    parts = maps.select(*_named([*keys, SIZE, PART, MAP])).mapInArrow(combine, schema)
    by = [level, *keys]
    return _filled(_merged(parts, by), by).select(*_named(by), "filled", *_estimates(F.col("filled"), F.col(SIZE)))
