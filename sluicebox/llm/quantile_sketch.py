"""Percentiles of very large columns from dyadic Count-sketches, mergeable by addition.

A value is encoded in CODE_BITS bits whose order is that of the values. For every resolution (the code
without its last ``level`` bits) one Count-sketch holds the weights of the nodes: each row of cells adds
a node's weight, with a random sign, to one cell, and the median over the rows estimates it. The
coarsest resolutions are few nodes and are kept exactly, and a group of few codes is kept as those codes
until it grows. Sketches of parts, batches or days are added
cell by cell, and a deletion is a weight of -1. A percentile is found by going down the levels, left
or right by the estimated weight of the left child.

Value error: a result is off by at most one code, a relative 2**-16. Rank error: reported per result,
three standard errors of the estimates met on the way down, from the cells themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE_BITS = 28
#: Nodes of the coarsest level, which is kept exactly.
EXACT_BITS = 10
ROWS, TOP = 5, CODE_BITS - EXACT_BITS
#: Rank error that WIDTH_BITS of cells in a row keep to, by three standard errors on the least even data; each further bit divides it by the root of two.
ERROR, WIDTH_BITS = 0.03, 9
#: (group, code) weights that a task holds before it turns them into cells.
HELD = 2_000_000
#: Different codes up to which a group is stored as codes, unless asked otherwise.
EXACT_CODES = 400
#: Level that stands for a group kept as its codes.
CODES = -1
LEVEL, CELLS = "__level", "__cells"
_FLIP = np.uint64(1 << 63)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def encode_values(values: np.ndarray) -> np.ndarray:
    """Codes of finite or infinite doubles, in the order of the values."""
    bits = (values.astype(np.float64) + 0.0).view(np.uint64)
    ordered = np.where(bits & _FLIP, ~bits, bits | _FLIP)
    return (ordered >> np.uint64(64 - CODE_BITS)).astype(np.int64)


def decode_codes(codes: np.ndarray) -> np.ndarray:
    """The value nearest to zero of each code."""
    ordered = codes.astype(np.uint64) << np.uint64(64 - CODE_BITS)
    rest = np.uint64((1 << (64 - CODE_BITS)) - 1)
    return np.where(ordered & _FLIP, ordered ^ _FLIP, ~(ordered | rest)).view(np.float64)


def width_bits(error: float = ERROR) -> int:
    """Log of the cells in a row at which ranks are within ``error``."""
    if not 0 < error < 1:
        raise ValueError("error lies between 0 and 1")
    return max(4, WIDTH_BITS + math.ceil(2 * math.log2(ERROR / error)))


def _places(nodes: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell (of all rows in a line) and sign of each node, by row."""
    mixed = (nodes.astype(np.uint64)[None, :] + np.uint64(level << 40) + np.uint64(1)) * _ODD[:, None]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    cell = (mixed >> np.uint64(64 - bits)).astype(np.int64) + (np.arange(ROWS)[:, None] << bits)
    return cell, 1 - 2 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype(np.int64)


def _pack(cells: np.ndarray) -> bytes:
    """Cells as bytes, after their form and the log of their number: pairs of index and value where few are set, else all values; 4 bytes each where they fit."""
    size = len(cells).bit_length()
    set_ = np.flatnonzero(cells)
    kind = np.int32 if not len(set_) or np.abs(cells).max() < 2**31 else np.int64
    if len(set_) * 2 < len(cells):
        return bytes([1 + (kind is np.int64), size]) + set_.astype(np.int32).tobytes() + cells[set_].astype(kind).tobytes()
    return bytes([3 + (kind is np.int64), size]) + cells.astype(kind).tobytes()


def _add_packed(cells: np.ndarray, packed: bytes) -> None:
    form, kind = packed[0], np.int64 if packed[0] in (2, 4) else np.int32
    if packed[1] != len(cells).bit_length():
        raise ValueError("sketches made for different errors can't be added")
    body = memoryview(packed)[2:]
    if form >= 3:
        cells += np.frombuffer(body, kind)
        return
    held = len(body) // (4 + np.dtype(kind).itemsize)
    np.add.at(cells, np.frombuffer(body[: held * 4], np.int32), np.frombuffer(body[held * 4 :], kind))


def _pack_codes(codes: np.ndarray, weights: np.ndarray) -> bytes:
    return codes.astype(np.int32).tobytes() + weights.astype(np.int64).tobytes()


def _unpack_codes(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their summed weights."""
    counts = [len(p) // 12 for p in packed]
    codes = np.concatenate([np.frombuffer(p, np.int32, n) for p, n in zip(packed, counts)]).astype(np.int64)
    weights = np.concatenate([np.frombuffer(p, np.int64, n, 4 * n) for p, n in zip(packed, counts)])
    distinct, place = np.unique(codes, return_inverse=True)
    summed = np.zeros(len(distinct), np.int64)
    np.add.at(summed, place, weights)
    return distinct[summed != 0], summed[summed != 0]


def _packed_levels(codes: np.ndarray, weights: np.ndarray, bits: int, exact_codes: int) -> list[tuple[int, bytes]]:
    """(level, cells) of sorted distinct codes: as codes where they are few."""
    if len(codes) <= exact_codes:
        return [(CODES, _pack_codes(codes, weights))]
    return [(level, _pack(cells)) for level, cells in sketch_codes(codes, weights, bits)]


def _cells(level: int, bits: int) -> int:
    return 1 << EXACT_BITS if level == TOP else ROWS << bits


def sketch_codes(codes: np.ndarray, weights: np.ndarray, bits: int = WIDTH_BITS) -> Iterator[tuple[int, np.ndarray]]:
    """Cells of every level for sorted distinct codes and their weights."""
    for level in range(TOP + 1):
        if level:
            codes = codes >> 1
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            codes, weights = codes[first], np.add.reduceat(weights, first) if len(first) else weights
        if level == TOP:
            yield level, np.bincount(codes, weights, minlength=_cells(level, bits)).astype(np.int64)
        else:
            cell, sign = _places(codes, level, bits)
            yield level, np.bincount(cell.ravel(), (sign * weights).ravel(), minlength=_cells(level, bits)).astype(np.int64)


def descend(levels: dict[int, np.ndarray], shares: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Total weight, the value at each share of it, and the standard error of the ranks in weight."""
    bits = (len(levels[0]) // ROWS).bit_length() - 1
    top = np.cumsum(levels[TOP])
    total = int(top[-1])
    if total <= 0:
        return total, np.full(len(shares), np.nan), np.zeros(len(shares))
    rank = np.maximum(np.ceil(shares * total), 1.0)
    node = np.searchsorted(top, rank)
    rank = rank - np.where(node > 0, top[node - 1], 0)
    inside = levels[TOP][node].astype(np.float64)
    variance = np.zeros(len(shares))
    for level in range(TOP - 1, -1, -1):
        cells = levels[level].reshape(-1)
        left = node * 2
        cell, sign = _places(left, level, bits)
        guess = np.clip(np.median(cells[cell] * sign, axis=0), 0, inside)
        # what others add to a cell: all but the largest cells, which are single heavy nodes
        noise = np.sort(np.abs(cells))[: len(cells) - len(cells) // 100].astype(np.float64)
        variance += 1.2533**2 * np.mean(noise**2) / ROWS
        right = rank > guess
        node, rank, inside = np.where(right, left + 1, left), np.where(right, rank - guess, rank), np.where(right, inside - guess, guess)
    return total, decode_codes(node), np.sqrt(variance)


def exact(codes: np.ndarray, weights: np.ndarray, shares: np.ndarray) -> tuple[int, np.ndarray]:
    """Total weight and the value at each share of it, from all codes."""
    reached = np.cumsum(weights)
    if not len(codes) or reached[-1] <= 0:
        return int(reached[-1]) if len(codes) else 0, np.full(len(shares), np.nan)
    at = np.searchsorted(np.maximum.accumulate(reached), np.maximum(np.ceil(shares * reached[-1]), 1))
    return int(reached[-1]), decode_codes(codes[at])


def _schema(df: DataFrame, keys: list[str], column: str) -> T.StructType:
    kinds = {f.name: f for f in df.schema.fields}
    return T.StructType([*[kinds[k] for k in keys], T.StructField(column, T.StringType()), T.StructField(LEVEL, T.IntegerType()), T.StructField(CELLS, T.BinaryType())])


def dyadic_sketches(
    df: DataFrame, keys: list[str], values: list[str], weight: str | None = None, column: str = "column", error: float = ERROR, exact_codes: int = EXACT_CODES
) -> DataFrame:
    """(keys, column, __level, __cells): the sketches of each group and value column.

    Null and NaN values count for nothing; a null key is a group. ``weight`` names an integer column
    (null: 0), -1 for a deletion; without it each row weighs 1. Sketches are made where the rows are
    read and added up by key and level; tasks hold a bounded number of weights. ``error`` is the rank
    error aimed at; sketches of different errors can't be added. A group of at most ``exact_codes``
    different codes is stored as those, which is its finest level without a collision; 0 stores cells always.
    """
    bits = width_bits(error)
    schema = _schema(df, keys, column)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        codes, weights, held = [], [], 0

        def compact() -> None:
            nonlocal codes, weights, held
            if not codes:
                return
            distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
            summed = np.bincount(place, np.concatenate(weights), minlength=len(distinct)).astype(np.int64)
            codes, weights, held = [distinct], [summed], len(distinct)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal codes, weights, held
            compact()
            if not held:
                return
            groups, names = codes[0] >> CODE_BITS, list(known)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, value = names[int(groups[a]) // len(values)], values[int(groups[a]) % len(values)]
                rows = [(*key, value, *packed) for packed in _packed_levels(codes[0][a:b] & ((1 << CODE_BITS) - 1), weights[0][a:b], bits, exact_codes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)
            codes, weights, held = [], [], 0

        types = None
        for batch in batches:
            if types is None:
                types = [*[batch.schema.field(i).type for i in range(len(keys))], pa.string(), pa.int32(), pa.binary()]
            if keys:
                marks = pd.MultiIndex.from_arrays([batch.column(i).to_pandas() for i in range(len(keys))])
                tuples = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
                local, first = pd.factorize(marks, use_na_sentinel=False)[0], {}
                for i in np.unique(local, return_index=True)[1].tolist():
                    first[int(local[i])] = known.setdefault(tuples[i], len(known))
                group = np.array([first[i] for i in range(len(first))], np.int64)[local]
            else:
                known.setdefault((), 0)
                group = np.zeros(batch.num_rows, np.int64)
            heavy = batch.column(len(keys) + len(values)).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(len(values)):
                numbers = batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(np.float64)
                real = ~np.isnan(numbers)
                codes.append(((group[real] * len(values) + i) << CODE_BITS) | encode_values(numbers[real]))
                weights.append(heavy[real])
                held += int(real.sum())
            if held > 2 * HELD:
                compact()
                if held > HELD:
                    yield from flush()
        yield from flush()

    weighed = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(f"`{weight}`").cast("bigint"), F.lit(0))
    chosen = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{v}`").cast("double").alias(f"v{i}") for i, v in enumerate(values)], weighed.alias("__weight"))
    return add_sketches(chosen.mapInArrow(build, schema), keys, column, error, exact_codes)


def add_sketches(parts: DataFrame, keys: list[str], column: str = "column", error: float = ERROR, exact_codes: int = EXACT_CODES) -> DataFrame:
    """Sketches of the (coarser) ``keys``: the sums of those of ``parts``, one set of cells in memory at a time.

    A group may have both cells and codes; ``percentiles`` and later sums take them together. Sketches
    made for another ``error`` are a ValueError.
    """
    bits = width_bits(error)
    schema = _schema(parts, keys, column)
    by = [*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`"), F.col(LEVEL)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, held, done, types = None, None, [], [], None

        def settle() -> None:
            if now is None:
                return
            if now[-1] == CODES:
                done.extend((*now[:-1], *packed) for packed in _packed_levels(*_unpack_codes(held), bits, exact_codes))
            else:
                done.append((*now, _pack(cells)))

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(len(keys) + 3)]
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(keys) + 3)]):
                if row[:-1] != now:
                    settle()
                    if len(done) >= 256:
                        yield full()
                    now, held = row[:-1], []
                    cells = np.zeros(_cells(row[-2], bits), np.int64) if row[-2] != CODES else None
                if row[-2] == CODES:
                    held.append(row[-1])
                    if len(held) % 1024 == 0:
                        held = [_pack_codes(*_unpack_codes(held))]
                else:
                    _add_packed(cells, row[-1])
        settle()
        if done:
            yield full()

    return parts.select(*by, CELLS).repartition(*by).sortWithinPartitions(*by).mapInArrow(add, schema)


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float], column: str = "column", error: float = ERROR) -> DataFrame:
    """(keys, column, share, value, weight, rank_error) from the summed sketches of ``keys``.

    ``value`` is the least value at or above which ``share`` of the weight has been met; null where the
    weight is not positive. ``rank_error`` is the bound on the error of the share.
    """
    kinds = {f.name: f for f in sketches.schema.fields}
    schema = T.StructType(
        [*[kinds[k] for k in keys], kinds[column], *[T.StructField(n, t) for n, t in (("share", T.DoubleType()), ("value", T.DoubleType()), ("weight", T.LongType()), ("rank_error", T.DoubleType()))]]
    )
    if clash := {*keys, column} & {"share", "value", "weight", "rank_error"} or len({*keys, column}) <= len(keys):
        raise ValueError(f"keys named like results, or twice: {clash}")
    wanted, bits = np.array(shares, np.float64), width_bits(error)
    by = [*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`")]
    width = len(by)

    def find(codes: list[bytes], levels: dict[int, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        if not levels:
            total, value = exact(*_unpack_codes(codes), wanted)
            return total, value, np.full(len(wanted), 1 / max(total, 1))
        if codes:
            for level, cells in sketch_codes(*_unpack_codes(codes), bits):
                levels[level] = levels.get(level, 0) + cells
        total, value, error = descend(levels, wanted)
        return total, value, (3 * error + 1) / max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, levels, names, found, types = None, [], {}, [], [], None

        def full() -> pa.RecordBatch:
            times = len(wanted)
            heads = [pa.array([n[i] for n in names for _ in range(times)], types[i]) for i in range(width)]
            value = np.concatenate([f[1] for f in found])
            tail = [
                pa.array(np.tile(wanted, len(found))),
                pa.array(value, pa.float64(), mask=np.isnan(value)),
                pa.array(np.repeat([f[0] for f in found], times), pa.int64()),
                pa.array(np.concatenate([f[2] for f in found])),
            ]
            names.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([*heads, *tail], names=schema.names)

        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(width)]
            for row in zip(*[batch.column(i).to_pylist() for i in range(width + 2)]):
                if row[:width] != now:
                    if now is not None:
                        names.append(now)
                        found.append(find(codes, levels))
                        if len(names) >= 512:
                            yield full()
                    now, codes, levels = row[:width], [], {}
                level, packed = row[width:]
                if level == CODES:
                    codes.append(packed)
                else:
                    if level not in levels:
                        levels[level] = np.zeros(_cells(level, bits), np.int64)
                    _add_packed(levels[level], packed)
        if now is not None:
            names.append(now)
            found.append(find(codes, levels))
            yield full()

    return sketches.select(*by, LEVEL, CELLS).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
