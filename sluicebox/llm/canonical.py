"""Freely typed values mapped to a list of canonical entries by a prefix-filtered set-similarity join.

Each distinct value becomes a set of character tokens. Tokens are ordered by how rare they are over
all values; two sets can only be similar enough if their rarest tokens meet, so only those prefixes
are joined. A length and a positional filter drop most of what meets, the Jaccard similarity of the
rest is computed exactly, and an edit distance confirms the match that is kept. The join runs over
distinct values, not rows, and no pair of two typed values is ever made.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.session import cut_lineage
from sluicebox.sources.tables import broadcast_if_small

UNKNOWN = "UNKNOWN"
#: Tokens that one edit can take from a value's tokens: a letter and the two pairs it is in.
LOST_BY_EDIT = 3
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"})


def fold_key(value: str) -> str:
    """Letters and digits of a value in one form: width, case, accents, spacing, punctuation and 'and' aside."""
    text = unicodedata.normalize("NFKC", html.unescape(value)).casefold().translate(_LETTERS)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    words = re.sub(r"[\W_]+", " ", text).split()
    return "".join(w for w in words if w != "and")


def tokens(key: str) -> list[str]:
    """Letters and padded letter pairs, a repeated one told apart by its count."""
    padded = f"^{key}$"
    seen: Counter[str] = Counter()
    out = []
    for token in [*key, *(padded[i : i + 2] for i in range(len(padded) - 1))] if key else []:
        seen[token] += 1
        out.append(f"{token}{seen[token]}" if seen[token] > 1 else token)
    return out


def edit_limit(length: int) -> int:
    """Edits that a canonical entry of so many letters may have suffered; a single letter none, as any other would do."""
    return 0 if length <= 1 else 1 if length <= 4 else 2 if length <= 11 else 3


def shared_tokens(length: int) -> int:
    """Tokens that an entry of so many letters still shares with a value within its edits: its similarity is no lower than that gives."""
    return 2 * length + 1 - LOST_BY_EDIT * edit_limit(length)


def least_shared(length: int) -> int:
    """The same for a typed value of so many letters, over all entries that it may be meant for."""
    meant = range(max(1, length - 3), length + 4)
    return min((shared_tokens(n) for n in meant if abs(n - length) <= edit_limit(n)), default=1)


def edits(a: str, b: str, limit: int) -> int:
    """Damerau-Levenshtein distance (a swap of neighbours is one edit), or limit + 1 when above it."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


_FOLDED = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("least", T.IntegerType()), T.StructField("need", T.IntegerType())]
)


@F.pandas_udf(_FOLDED)
def _folded(value: pd.Series) -> pd.DataFrame:
    keys = [fold_key(v) for v in value]
    least, need = [least_shared(len(k)) for k in keys], [shared_tokens(len(k)) for k in keys]
    return pd.DataFrame({"key": keys, "tokens": [tokens(k) for k in keys], "least": pd.Series(least, dtype="int32"), "need": pd.Series(need, dtype="int32")})


@F.pandas_udf(T.IntegerType())
def _edits(typed: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([edits(a, b, edit_limit(len(b))) for a, b in zip(typed, entry)], dtype="int32")


def _limit_of(length: Column) -> Column:
    """``edit_limit`` of a column."""
    return F.when(length <= 1, 0).when(length <= 4, 1).when(length <= 11, 2).otherwise(3)


def _ordered(sets: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """``sets`` with tokens from rare to frequent; ties by the token."""
    exploded = sets.select(*keys, F.explode("tokens").alias("t")).join(frequency, "t")
    return exploded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).getField("t").alias("tokens"))


def _prefix(need: str) -> Column:
    """The rarest tokens, of which at least one is shared wherever ``need`` tokens are."""
    return F.posexplode(F.slice("tokens", 1, F.size("tokens") - F.col(need) + 1))


def resolve_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, value, canonical) for distinct ``values`` (field, value) by ``entries`` (field, label, canonical).

    The match is the entry within the allowed edits with fewest edits, then highest Jaccard
    similarity, then first label; without one, UNKNOWN. A value of no letters or digits is UNKNOWN. The
    similarity that two sets need follows from the edits that the entry's length allows, so no pair
    within them is lost.
    """
    typed = values.withColumn("f", _folded("value")).select("field", "value", "f.key", "f.tokens", "f.least")
    listed = entries.withColumn("f", _folded("label")).select("field", "label", "canonical", "f.key", "f.tokens", "f.need")
    listed = listed.where("key <> ''").groupBy("field", "key").agg(F.min_by(F.struct("canonical", "label", "tokens", "need"), "label").alias("e")).select("field", "key", "e.*")
    typed = cut_lineage(typed)
    # the length filter, once for all entries: values too long for any of them go no further, however long they are
    longest = (listed.agg(F.max(F.length("key"))).collect()[0][0] or 0) + edit_limit(1 << 20)
    keys = typed.where("key <> ''").where(F.length("key") <= longest).select("field", "key", "tokens", "least").dropDuplicates(["field", "key"])
    frequency = keys.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    frequency = listed.select(F.explode("tokens").alias("t")).distinct().join(frequency, "t", "full").select("t", F.coalesce("df", F.lit(0)).alias("df"))
    frequency = broadcast_if_small(cut_lineage(frequency))
    left = _ordered(keys, ["field", "key", "least"], frequency).select("field", "key", "tokens", _prefix("least").alias("i", "t"))
    right = _ordered(listed, ["field", "key", "label", "canonical", "need"], frequency)
    right = right.select("field", F.col("key").alias("entry"), "label", "canonical", "need", F.col("tokens").alias("entry_tokens"), _prefix("need").alias("j", "t"))
    met = left.join(broadcast_if_small(right), ["field", "t"])
    a, b = F.size("tokens"), F.size("entry_tokens")
    met = met.where(F.abs(F.length("key") - F.length("entry")) <= _limit_of(F.length("entry")))
    # the pair meets first at its rarest common token, before which nothing is shared
    met = met.groupBy("field", "key", "entry", "label", "canonical", "need").agg(
        F.min_by(F.struct("i", "j"), F.struct("i", "j")).alias("at"), F.first("tokens").alias("tokens"), F.first("entry_tokens").alias("entry_tokens")
    )
    met = met.where(1 + F.least(a - F.col("at.i") - 1, b - F.col("at.j") - 1) >= F.col("need"))
    shared = F.size(F.array_intersect("tokens", "entry_tokens"))
    met = met.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).withColumn("jaccard", F.col("shared") / (a + b - F.col("shared")))
    near = met.withColumn("most", _limit_of(F.length("entry"))).where(F.levenshtein("key", "entry") <= 2 * F.col("most")).withColumn("edits", _edits("key", "entry")).where("edits <= most")
    best = near.groupBy("field", "key").agg(F.min_by("canonical", F.struct("edits", -F.col("jaccard"), "label")).alias("canonical"))
    found = typed.join(best, ["field", "key"], "left")
    return found.select("field", "value", F.coalesce("canonical", F.lit(UNKNOWN)).alias("canonical"))


def map_to_canonical(rows: DataFrame, row_id: str, fields: dict[str, DataFrame]) -> DataFrame:
    """(row_id, field, canonical) for each row and field whose value needs mapping.

    ``fields`` names, for each column of ``rows``, its entries (label, canonical); the canonical
    values are labels too. Null and blank values, and values written exactly as a canonical entry,
    give no row. All others give one, UNKNOWN where no entry is meant. Rows that repeat repeat in the
    result; an empty table gives none.
    """
    names = list(fields)
    entries = None
    for name in names:
        own = fields[name].select(F.lit(name).alias("field"), "label", "canonical")
        own = own.unionByName(own.select("field", F.col("canonical").alias("label"), "canonical")).where("label IS NOT NULL AND canonical IS NOT NULL").distinct()
        entries = own if entries is None else entries.unionByName(own)
    entries = cut_lineage(entries)
    long = rows.select(F.col(f"`{row_id}`").alias("row"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("p"))
    long = long.select("row", "p.field", "p.value").where(F.col("value").rlike(r"(?U)[^\s​﻿]"))
    exact = entries.select("field", F.col("canonical").alias("value")).distinct()
    long = long.join(broadcast_if_small(exact), ["field", "value"], "left_anti")
    resolved = cut_lineage(resolve_values(long.select("field", "value").distinct(), entries))
    mapped = long.join(broadcast_if_small(resolved), ["field", "value"])
    return mapped.select(F.col("row").alias(row_id), "field", "canonical")


