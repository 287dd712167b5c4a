"""Has this key been seen before? Golomb-coded sets of key hashes, spread over buckets.

The keys of the past are hashed, spread over buckets by the leading hash bits, reduced in each bucket
to a range of ``count * 2**bits``, sorted, and stored as Golomb-Rice coded gaps in blocks with a small
directory. A probe decodes the one block that can hold its hash. The new rows' keys, each once with its
earliest row, are probed against the coded set of the past; among themselves they are inserted in their
order into a coded set of their own, where a gap of zero to an earlier key, or the key itself, means seen.
Rows of one key collapse before they are shuffled, and the number of buckets bounds the keys of one, so
a key that holds a third of all rows loads no task.

An answer "new" is always right. An answer "seen" is wrong at a rate below ``2**-bits`` for each probed set.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.session import cut_lineage
from sluicebox.sources.tables import broadcast_if_small, is_small

#: Keys in one block of a coded set: what one probe decodes at most.
BLOCK = 64
#: Keys that a bucket is meant to hold.
BUCKET_KEYS = 100_000

SET_SCHEMA = "bucket int, held bigint, span decimal(20,0), rice int, firsts binary, starts binary, body binary"


def normalised_key(column: Column) -> Column:
    """Key without blanks and tabs around it, in lower case; null where nothing is left."""
    key = F.lower(F.regexp_replace(column.cast("string"), r"^[ \t]+|[ \t]+$", ""))
    return F.when(key != "", key)


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def bucket_of(hashed: Column, buckets: int) -> Column:
    """Bucket by the high half of the hash; the low bits are left for the place within it."""
    return F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(buckets)).cast("int")


def _reduced(hashes: np.ndarray, span: int) -> np.ndarray:
    """Hashes mapped evenly to [0, span), span below 2**52, in order-free integer arithmetic."""
    low = (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)
    high, rest = low >> np.uint64(26), low & np.uint64((1 << 26) - 1)
    upper, lower = np.uint64(span >> 26), np.uint64(span & ((1 << 26) - 1))
    # (high * 2^26 + rest) * span / 2^52, exact to one place
    return (high * upper + ((high * lower + rest * upper) >> np.uint64(26)) + ((rest * lower) >> np.uint64(52))).astype(np.int64)


def _span(held: int, bits: int) -> int:
    return min(max(held, 1) << bits, (1 << 52) - 1)


def encode_set(values: np.ndarray, bits: int) -> tuple[int, bytes, bytes, bytes]:
    """Rice parameter, first value and first bit of each block, and the coded gaps of sorted distinct values."""
    gaps = np.diff(values, prepend=values[:1])
    head = np.arange(len(values)) % BLOCK == 0
    gaps[head] = 0
    rice = max(bits - 1, 0)
    quotient = gaps >> rice
    sizes = np.where(head, 0, quotient + 1 + rice)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    stream = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    body = ~head
    # quotient in ones, a zero, then the remainder, most significant bit first
    ones = np.zeros(len(stream) + 1, np.int32)
    ones[begins[body]] += 1
    ones[(begins + quotient)[body]] -= 1
    stream[:] = np.cumsum(ones[:-1])
    at, rest = (begins + quotient + 1)[body], (gaps & ((1 << rice) - 1))[body]
    for i in range(rice):
        stream[at + i] = (rest >> (rice - 1 - i)) & 1
    return rice, values[head].astype(np.int64).tobytes(), begins[head].astype(np.int64).tobytes(), np.packbits(stream).tobytes()


class CodedSet:
    """A coded set that decodes only the blocks it is probed in."""

    def __init__(self, held: int, span: int, rice: int, firsts: bytes, starts: bytes, body: bytes) -> None:
        self.held, self.span, self.rice = held, span, rice
        self.firsts, self.starts = np.frombuffer(firsts, np.int64), np.frombuffer(starts, np.int64)
        self.body = np.frombuffer(body, np.uint8)

    def _blocks(self, wanted: np.ndarray) -> np.ndarray:
        """Values of the wanted blocks, one row each, the last value repeated in a short block."""
        out = np.empty((len(wanted), BLOCK), np.int64)
        out[:, 0] = value = self.firsts[wanted].copy()
        lengths = np.full(len(wanted), BLOCK)
        lengths[wanted == len(self.firsts) - 1] = self.held - (len(self.firsts) - 1) * BLOCK
        begin = self.starts[wanted]
        end = np.append(self.starts, len(self.body) * 8)[wanted + 1]
        first_byte, last_byte = begin >> 3, (end + 7) >> 3
        width = last_byte - first_byte
        local = np.cumsum(width) - width
        picked = np.repeat(first_byte - local, width) + np.arange(int(width.sum()))
        bits = np.append(np.unpackbits(self.body[picked]), np.zeros(self.rice + 1, np.uint8))
        zero = np.where(bits == 0, np.arange(len(bits)), len(bits) - 1)
        zero = np.minimum.accumulate(zero[::-1])[::-1]
        at = local * 8 + (begin - first_byte * 8)
        weights = 1 << np.arange(self.rice - 1, -1, -1, dtype=np.int64)
        for i in range(1, BLOCK):
            live = np.flatnonzero(lengths > i)
            stop = zero[at[live]]
            rest = np.zeros(len(live), np.int64)
            for j in range(self.rice):
                rest += bits[stop + 1 + j] * weights[j]
            value[live] += ((stop - at[live]) << self.rice) + rest
            at[live] = stop + 1 + self.rice
            out[:, i] = value
        return out

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set."""
        if not self.held or not len(hashes):
            return np.zeros(len(hashes), bool)
        place = _reduced(hashes, self.span)
        block = np.searchsorted(self.firsts, place, "right") - 1
        inside = block >= 0
        wanted, row = np.unique(block[inside], return_inverse=True)
        found = np.zeros(len(hashes), bool)
        if len(wanted):
            values = self._blocks(wanted)
            # rows of blocks follow one another in order, so one search serves all of them
            flat = values.reshape(-1)
            at = np.minimum(np.searchsorted(flat, place[inside]), len(flat) - 1)
            found[inside] = flat[at] == place[inside]
        return found


def build_sets(keys: DataFrame, key: str, buckets: int, bits: int = 20) -> DataFrame:
    """One coded set per bucket over the non-null keys of ``keys`` (SET_SCHEMA), in one shuffle of distinct hashes."""
    hashes = keys.select(key_hash(F.col(key)).alias("h"), F.col(key).isNotNull().alias("k")).where("k").select("h").distinct()
    hashes = hashes.select(bucket_of(F.col("h"), buckets).alias("bucket"), "h")

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        span = _span(len(group), bits)
        values = np.unique(_reduced(group["h"].to_numpy(), span))
        rice, firsts, starts, body = encode_set(values, bits)
        return pd.DataFrame([(group["bucket"].iloc[0], len(values), Decimal(span), rice, firsts, starts, body)], columns=["bucket", "held", "span", "rice", "firsts", "starts", "body"])

    return hashes.groupBy("bucket").applyInPandas(encode, SET_SCHEMA)


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // BUCKET_KEYS))


def seen_before(past: DataFrame, new: DataFrame, key: str, order: str, bits: int = 20, sets: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(order, key, past, maybe, again): the rows of ``new`` that may have been seen.

    ``past``: the coded set of the past holds the key, wrongly at a rate below ``2**-bits``. ``maybe``: an
    earlier row of ``new`` (``order``, a unique bigint, is smaller) has the same reduced hash, as wrongly;
    ``again``: it has the same key.

    Keys are compared after ``normalised_key``; a null or blank key is never seen. ``sets`` may hold the
    stored result of ``build_sets``, made with ``buckets``. Names in ``past`` and ``new`` may clash;
    either may be empty.
    """
    if buckets is None:
        buckets = bucket_count(past.count() + new.count())
    if sets is None:
        sets = build_sets(past.select(normalised_key(F.col(f"`{key}`")).alias("k")), "k", buckets, bits)
    rows = new.select(F.col(f"`{order}`").cast("bigint").alias("o"), normalised_key(F.col(f"`{key}`")).alias("k")).where(F.col("k").isNotNull())
    firsts = rows.groupBy("k").agg(F.min("o").alias("first"), (F.count(F.lit(1)) > 1).alias("repeated")).withColumn("h", key_hash(F.col("k"))).withColumn("bucket", bucket_of(F.col("h"), buckets))

    def probe(keys: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        keys = keys.sort_values("first", kind="stable").reset_index(drop=True)
        hashes = keys["h"].to_numpy()
        held = np.zeros(len(keys), bool)
        for row in coded.itertuples():
            held |= CodedSet(row.held, int(row.span), row.rice, row.firsts, row.starts, row.body).holds(hashes)
        # insertion in order: sorted by reduced hash, a gap of zero means that an earlier key had it
        place = _reduced(hashes, _span(len(keys), bits))
        by = np.lexsort((np.arange(len(place)), place))
        alike = np.zeros(len(place), bool)
        alike[by[1:]] = np.diff(place[by]) == 0
        return keys[["k", "first"]].assign(past=held, alike=alike)[held | alike | keys["repeated"].to_numpy()]

    probed = firsts.groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInPandas(probe, "k string, first bigint, past boolean, alike boolean")
    found = rows.join(broadcast_if_small(cut_lineage(probed)), "k")
    again = F.col("o") > F.col("first")
    return found.where(again | F.col("past") | F.col("alike")).select(F.col("o").alias(order), F.col("k").alias(key), "past", (again | F.col("alike")).alias("maybe"), again.alias("again"))


def confirmed(found: DataFrame, past: DataFrame, key: str) -> DataFrame:
    """The rows of ``seen_before`` that were seen: the keys that only the coded set of the past holds are looked up in ``past`` itself."""
    sure, open_ = found.where("again"), found.where("past AND NOT again")
    old = past.select(normalised_key(F.col(f"`{key}`")).alias(key)).where(F.col(key).isNotNull())
    asked = open_.select(key).distinct()
    if is_small(asked):
        old = old.join(F.broadcast(asked), key, "left_semi").distinct()
    return sure.unionByName(open_.join(old, key, "left_semi").select(*found.columns))


def audit(found: DataFrame, past: DataFrame, new: DataFrame, key: str, bits: int) -> DataFrame:
    """One row: rows of ``new``, positives, and false positives, as counted and as expected in theory."""
    good = confirmed(found, past, key).agg(F.count(F.lit(1)).alias("seen"))
    all_ = found.agg(F.count(F.lit(1)).alias("positives"))
    keyed = new.select(normalised_key(F.col(f"`{key}`")).alias("k")).agg(F.count(F.lit(1)).alias("rows_in"), F.count("k").alias("keyed_rows"))
    counts = keyed.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(good))  # one row each
    unseen = F.col("keyed_rows") - F.col("seen")
    return counts.select(
        F.lit(bits).alias("bits"), "rows_in", "keyed_rows", "positives", "seen",
        (F.col("positives") - F.col("seen")).alias("false_positives"),
        F.try_divide(F.col("positives") - F.col("seen"), unseen).alias("audited_rate"),
        F.lit(2.0 * 2.0**-bits).alias("rate_bound"),
    )

