"""The N best rows of every group by simultaneous bisection of each group's cutoff.

A row's place is an order-preserving code: the score as a 64-bit integer, then the bytes of its
identifier. All groups search their cutoffs at once. A round lays midpoints over the undecided codes of
each group and counts the rows above each; rows above the last midpoint with fewer than N above it are
in, rows below the next are out, and only those between stay undecided. The first midpoints of a level
are those that the leading bits of its code give, alike for all groups, so nothing need be known of a
group beforehand; later ones lie between the lowest and highest undecided code of the group.
``fanout=2`` is plain bisection there; more midpoints take fewer passes. No group is ever brought into
one task: counts are pre-aggregated per (group, interval), and only undecided rows are carried on, from a
table in the shared checkpoint folder.
"""

from __future__ import annotations

import os.path
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.session import cut_lineage
from sluicebox.sources.tables import is_small

#: Bytes of the identifier compared in one level, and leading bits of a level's code that the first midpoints are laid by.
CHUNK, LEADING = 6, 16


@F.pandas_udf(T.LongType())
def _ordered(score: pd.Series) -> pd.Series:
    values = score.to_numpy(np.float64) + 0.0  # -0.0 becomes 0.0
    bits = values.view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.IntegerType())
def _common(low: pd.Series, high: pd.Series) -> pd.Series:
    """Bytes that both begin with; 0 where they aren't known yet."""
    return pd.Series([0 if a is None else len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(low, high)], dtype="int32")


def _chunk(name: Column, offset: Column) -> Column:
    """Order code of CHUNK bytes from ``offset``, larger for what comes first; equal codes mean equal bytes and ends."""
    part = name.substr(offset + 1, F.lit(CHUNK))
    number = F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast("bigint")
    return -(number * 8 + F.length(part))


def _interval(code: Column, low: Column, high: Column, fanout: int) -> Column:
    """Which of the equal intervals of [low, high] holds ``code``: monotone, 0 at low and fanout - 1 at high."""
    wide = high.cast("double") - low.cast("double")
    near = wide < float(2**60)
    share = F.when(near, (code - F.when(near, low).otherwise(code)).cast("double") / (F.when(near, high).otherwise(low + 1) - low).cast("double")).otherwise(
        (code.cast("double") - low.cast("double")) / wide
    )
    return F.least(F.lit(fanout - 1), F.floor(share * fanout)).cast("int")


def top_n(df: DataFrame, group: str, score: str, identifier: str, n: int, rank: str = "rank", fanout: int = 64, repeats: bool = False) -> DataFrame:
    """(group, rank, identifier, score): the ``n`` rows of each group with the highest score.

    Equal scores go by identifier ascending in byte order (null first), then by a hash of the row.
    Rows with a null or NaN score count for nothing. A row repeated whole counts once, unless
    ``repeats``. A null group is a group. Groups of fewer rows come out whole; an empty table gives
    an empty result. Other columns only tell rows apart; a column named like ``rank`` is no trouble.
    """
    if n < 1 or fanout < 2:
        raise ValueError("n is 1 or more, fanout 2 or more")
    every = [F.col(f"`{c}`") for c in df.columns]
    rows = df.where(F.col(f"`{score}`").isNotNull() & ~F.isnan(F.col(f"`{score}`").cast("double")))
    rows = rows.select(
        F.col(f"`{group}`").alias("g"),
        F.col(f"`{score}`").alias("score"),
        F.col(f"`{identifier}`").alias("item"),
        F.xxhash64(*every).alias("whole"),
        *([F.monotonically_increasing_id().alias("copy")] if repeats else []),
    )
    tail = F.concat(F.hex("whole"), F.hex("copy")) if repeats else F.hex("whole")
    if not repeats:
        rows = rows.dropDuplicates()
    rows = cut_lineage(rows.withColumn("code", _ordered(F.col("score").cast("double"))))
    name = F.encode(F.concat(F.coalesce(F.col("item").cast("string"), F.lit("")), F.lit("\u0000"), tail), "UTF-8").alias("name")
    placed = rows.select("g", "score", "item", "code", name, F.lit(n).cast("bigint").alias("need"), F.lit(-1).alias("offset"), F.shiftright("code", 64 - LEADING).cast("int").alias("bin"))
    taken, first = [], True
    while True:
        cuts = cut_lineage(_cuts(placed, not first))
        small = is_small(cuts.select("g"))
        bounds = cuts.select(F.col("g").alias("gc"), "cut", "whole")
        judged = placed.join(F.broadcast(bounds) if small else bounds, F.col("g").eqNullSafe(F.col("gc"))).where(F.col("bin") >= F.col("cut"))
        taken.append(judged.where(F.col("whole") | (F.col("bin") > F.col("cut"))).select("g", "score", "item", "name"))
        open_ = cuts.where(~F.col("whole"))
        if open_.isEmpty():
            break
        undecided = cut_lineage(judged.where(~F.col("whole") & (F.col("bin") == F.col("cut"))).select("g", "score", "item", "code", "name"))
        state = _deeper(open_)
        placed, first = _placed(undecided, F.broadcast(state) if small else state, fanout), False
    chosen = reduce(DataFrame.unionByName, taken)
    best = Window.partitionBy("g").orderBy(F.col("score").cast("double").desc(), "name")
    return chosen.select(
        F.col("g").alias(group), F.row_number().over(best).cast("bigint").alias(rank), F.col("item").alias(identifier), F.col("score").alias(score)
    )


def _cuts(placed: DataFrame, names: bool) -> DataFrame:
    """For each group the interval in which its cutoff lies, and whether it is taken whole.

    ``need`` is how many rows are still to come from the interval; ``first`` and ``last`` are the
    names it spans, if ``names``.
    """
    spans = [F.min("name").alias("first"), F.max("name").alias("last")] if names else []
    counts = placed.groupBy("g", "bin").agg(
        F.count(F.lit(1)).alias("held"), F.min("code").alias("low"), F.max("code").alias("high"), F.first("need").alias("need"), F.first("offset").alias("offset"), *spans
    )
    group = Window.partitionBy("g").orderBy(F.col("bin").desc())
    counts = counts.withColumn("reached", F.sum("held").over(group)).withColumn("below", F.lead("bin").over(group).isNotNull())
    over = F.col("reached") - F.col("held")
    cut = counts.where((over < F.col("need")) & ((F.col("reached") >= F.col("need")) | ~F.col("below")))
    spanned = [F.col(c) if names else F.lit(None).cast("binary").alias(c) for c in ("first", "last")]
    return cut.select("g", F.col("bin").alias("cut"), (F.col("reached") <= F.col("need")).alias("whole"), (F.col("need") - over).alias("need"), "low", "high", "offset", *spanned)


def _deeper(state: DataFrame) -> DataFrame:
    """Groups whose undecided codes are all equal go on to the first identifier byte in which they differ."""
    tied = F.col("low") == F.col("high")
    return state.select(
        F.col("g").alias("gs"), "need", tied.alias("fresh"), F.col("low").alias("lo"), F.col("high").alias("hi"),
        F.when(tied, _common("first", "last")).otherwise(F.col("offset")).alias("offset"),
    )


def _placed(undecided: DataFrame, state: DataFrame, fanout: int) -> DataFrame:
    """Undecided rows with their group's interval number; the code is renewed where the group went deeper."""
    rows = undecided.join(state, F.col("g").eqNullSafe(F.col("gs")))
    rows = rows.withColumn("code", F.when(F.col("fresh"), _chunk(F.col("name"), F.col("offset"))).otherwise(F.col("code")))
    leading = F.shiftright("code", 8 * CHUNK + 3 - LEADING).cast("int")
    bin_ = F.when(F.col("fresh"), leading).otherwise(_interval(F.col("code"), F.col("lo"), F.col("hi"), fanout))
    return rows.select("g", "score", "item", "code", "name", "need", "offset", bin_.alias("bin"))
