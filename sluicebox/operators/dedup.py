"""Keep-first deduplication, by chunk and over all rows, and the row order it rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.session import cut_lineage
from sluicebox.sources.tables import broadcast_if_small


def with_row_order(df: DataFrame, output: str = "row_index") -> DataFrame:
    """Consecutive row numbers in the order of the partitions, without sorting into one of them.

    Partitions of files follow their sizes, not their names: for those, see ``read_orders_csv``. Rows are numbered within their partition; the partitions' sizes, one number each, are summed up on the way.
    """
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    part, offset = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return numbered.withColumn("__p", part).join(F.broadcast(bases), "__p").withColumn(output, F.col("__base") + offset).drop("__id", "__p", "__base")


def mark_chunk_repeats(df: DataFrame, key: str, order: str, chunk_size: int, output: str = "repeat") -> DataFrame:
    """Whether an earlier row of the same chunk has the key."""
    rows = df.withColumn("__chunk", F.floor(F.col(order) / chunk_size))
    firsts = rows.groupBy(F.col(key).alias("__k"), F.col("__chunk").alias("__c")).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = rows.join(firsts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c")), "left")
    return joined.withColumn(output, F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__chunk", "__k", "__c", "__first", "__n")


def mark_duplicates(df: DataFrame, key: str, order: str, passes: str, chunk_size: int = 100_000, output: str = "duplicate") -> DataFrame:
    """Duplicates as a chunk-wise reader with a memory of good keys would call them.

    A row is one if its key came earlier in its chunk, or if in an earlier chunk the key's first row
    passed all rules (``passes``, a boolean column). ``order`` is a unique bigint. With ``chunk_size=1``
    only keys of good earlier rows count. One shuffle, of pre-aggregated keys; ``df`` is read twice.
    """
    # first row and its verdict in one number, pre-aggregated per key and chunk: a key of many rows costs few
    verdict = F.col(order) * 2 + F.when(F.col(passes), 0).otherwise(1)
    chunk = F.floor(F.col(order) / chunk_size)
    firsts = df.groupBy(F.col(key).alias("__k"), chunk.alias("__c")).agg(F.min(verdict).alias("__f"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy("__k")
    good = F.min(F.when(F.col("__f") % 2 == 0, F.col("__c"))).over(own)
    known = firsts.select("__k", "__c", F.floor(F.col("__f") / 2).alias("__first"), good.alias("__good"), F.sum("__n").over(own).alias("__n")).where("__n > 1").drop("__n")
    # one row per repeated key and chunk: where they are few, the wide rows need no shuffle
    known = broadcast_if_small(cut_lineage(known))
    rows = df.withColumn("__chunk", chunk)
    joined = rows.join(known, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c")), "left")
    late = F.coalesce(F.col("__chunk") > F.col("__good"), F.lit(False))
    return joined.withColumn(output, F.coalesce(F.col(order) != F.col("__first"), F.lit(False)) | late).drop("__chunk", "__k", "__c", "__first", "__good")


def first_passing(df: DataFrame, key: str, order: str, passes: str) -> DataFrame:
    """The first row of each key that passes, without ranking whole groups: pre-aggregated before the shuffle."""
    columns = [F.col(c) for c in df.columns]
    return df.where(F.col(passes)).groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
