"""Canonical lists: exact and fuzzy resolution, and building the lists from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.functions.expressions import normalise_string, title_case
from sluicebox.session import cut_lineage
from sluicebox.sources.tables import broadcast_if_small, is_small

UNKNOWN = "UNKNOWN"

#: Categories, regions, and other spellings of the regions.
CATEGORIES = (
    "Automotive", "Baby & Kids", "Books", "Clothing", "Craft & Hobby", "Electronics", "Garden & Outdoor", "Grocery & Food", "Health & Beauty", "Home & Garden",
    "Jewelry & Accessories", "Kitchen", "Musical Instruments", "Office", "Pet Supplies", "Sports", "Tools & Hardware", "Toys & Games", "Travel & Luggage",
)
REGIONS = ("Bengaluru", "Chennai", "Delhi", "Indonesia", "Kolkata", "Malaysia", "Mumbai", "New Delhi", "Philipines", "Singapore", "Thailand", "Vietnam")
REGION_MAP = {
    "Bangalor": "Bengaluru", "Bangalore": "Bengaluru", "Bengaluru": "Bengaluru", "Bombay": "Mumbai", "Calcutta": "Kolkata", "Chenai": "Chennai", "Chennai": "Chennai",
    "Dehli": "Delhi", "Delhi": "Delhi", "Indonesia": "Indonesia", "indonsia": "Indonesia", "Kolkata": "Kolkata", "Kolkatta": "Kolkata", "Madras": "Chennai",
    "Malasia": "Malaysia", "Malaysa": "Malaysia", "Malaysia": "Malaysia", "Mumbai": "Mumbai", "Mumbay": "Mumbai", "New Delhi": "New Delhi", "Philipines": "Philipines",
    "Philippines": "Philipines", "phillipines": "Philipines", "Singapore": "Singapore", "Singapre": "Singapore", "Thailand": "Thailand", "Thailnd": "Thailand",
    "Viet Nam": "Vietnam", "Vietnam": "Vietnam",
}


def category_table(spark: SparkSession, names: tuple[str, ...] = CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "canonical string")


def region_table(spark: SparkSession, mapping: dict[str, str] | None = None, regions: list[str] | None = None) -> DataFrame:
    """(raw_label, canonical); targets are checked to be known regions or UNKNOWN."""
    mapping = REGION_MAP if mapping is None else mapping
    known = {UNKNOWN, *(REGIONS if regions is None else regions), *(REGION_MAP.values() if mapping is REGION_MAP else ())}
    if wrong := set(mapping.values()) - known:
        raise ValueError(f"mapped to no known region: {sorted(wrong)}")
    return spark.createDataFrame(list(mapping.items()), "raw_label string, canonical string")


def resolve_exact(df: DataFrame, column: str, canonical: DataFrame, output: str) -> DataFrame:
    """``output`` by equality regardless of case; null where there is none."""
    named = canonical.select(F.col("canonical").alias("__c"), F.lower("canonical").alias("__k")).dropDuplicates(["__k"])
    return df.join(broadcast_if_small(named), F.lower(normalise_string(F.col(column))) == F.col("__k"), "left").drop("__k").withColumnRenamed("__c", output)


#: Entries up to which a list is written into the expression itself, so that nothing is joined.
INLINE = 200


def short_list(df: DataFrame, columns: list[str]) -> list[tuple] | None:
    """Distinct rows of ``columns`` if there are at most INLINE rows, else None. A list that repeats itself beyond that is joined."""
    found = df.select(*columns).limit(INLINE + 1).collect()
    return list(dict.fromkeys(tuple(row) for row in found)) if len(found) <= INLINE else None


def nearest_of(text: Column, names: list[str], most: int = 2) -> Column:
    """The name of least edit distance to a lower-case text, at most ``most``; ties to the first name. Equal texts need no distances."""
    if not names:
        return F.lit(None).cast("string")
    same = F.create_map(*[F.lit(x) for low, n in sorted({n.lower(): n for n in sorted(names, reverse=True)}.items()) for x in (low, n)])
    options = [F.when((d := F.levenshtein(text, F.lit(n.lower()), most)) >= 0, F.struct(d.alias("d"), F.lit(n).alias("n"))) for n in sorted(names)]
    return F.when(text == "", None).otherwise(F.coalesce(F.try_element_at(same, text), F.array_min(F.array(*options)).getField("n")))


def fuzzy_matches(df: DataFrame, column: str, canonical: DataFrame, most: int = 2) -> DataFrame:
    """(spelling, match): for each distinct spelling the canonical name of least edit distance, at most ``most``; ties to the first name.

    For lists too long to be written into an expression. Names and spellings within the edits have
    lengths no further apart than those, so they are joined by length: spellings of one length meet the
    names of at most ``2 * most + 1`` lengths. The work grows with the spellings, not with the rows.
    """
    values = df.select(F.lower(normalise_string(F.col(column))).alias("spelling")).where("spelling <> ''").distinct()
    names = canonical.select(F.col("canonical").alias("name")).distinct()
    near = names.select("name", F.explode(F.sequence(F.length("name") - most, F.length("name") + most)).alias("size"))
    pairs = values.withColumn("size", F.length("spelling")).join(near, "size").where(F.levenshtein(F.col("spelling"), F.lower("name"), most) >= 0)
    nearest = F.min_by("name", F.struct(F.levenshtein(F.col("spelling"), F.lower("name")), "name"))
    return broadcast_if_small(cut_lineage(pairs.groupBy("spelling").agg(nearest.alias("match"))))


def attach_matches(df: DataFrame, column: str, matches: DataFrame, output: str) -> DataFrame:
    """``output`` from the result of ``fuzzy_matches``, null where a spelling has no match."""
    found = matches.select(F.col("spelling").alias("__v"), F.col("match").alias(output))
    return df.join(found, F.lower(normalise_string(F.col(column))) == F.col("__v"), "left").drop("__v")


def resolve_fuzzy(df: DataFrame, column: str, canonical: DataFrame, output: str, most: int = 2) -> DataFrame:
    """``output`` by the canonical name of least edit distance, at most ``most``; ties to the first name."""
    names = short_list(canonical.select("canonical").where("canonical IS NOT NULL"), ["canonical"])
    if names is not None:
        return df.withColumn(output, nearest_of(F.lower(normalise_string(F.col(column))), [n for (n,) in names], most))
    return attach_matches(df, column, fuzzy_matches(df, column, canonical, most), output)


def region_labels(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical region by exact label and by label regardless of case, each marked for broadcast if small."""
    exact = mapping.groupBy(F.col("raw_label").alias("__r")).agg(F.min("canonical").alias("__e"))
    folded = mapping.groupBy(F.lower("raw_label").alias("__l")).agg(F.min("canonical").alias("__f"))
    if is_small(mapping):  # and so are both
        return F.broadcast(exact), F.broadcast(folded)
    return exact, folded


def attach_region(df: DataFrame, column: str, labels: tuple[DataFrame, DataFrame], output: str) -> DataFrame:
    """``output`` by the exact label, else regardless of case; UNKNOWN and missing give null."""
    label = normalise_string(F.col(column))
    joined = df.join(labels[0], label == F.col("__r"), "left").join(labels[1], F.lower(label) == F.col("__l"), "left")
    found = F.coalesce("__e", "__f")
    return joined.withColumn(output, F.when(found != UNKNOWN, found)).drop("__r", "__e", "__l", "__f")


def region_of(label: Column, entries: list[tuple[str, str]]) -> Column:
    """Canonical region of a label, by the exact entry, else regardless of case; UNKNOWN and missing give null."""
    exact: dict[str, str] = {}
    folded: dict[str, str] = {}
    for raw, canonical in sorted(e for e in entries if None not in e):
        exact[raw] = min(canonical, exact.get(raw, canonical))
        folded[raw.lower()] = min(canonical, folded.get(raw.lower(), canonical))
    if not exact:
        return F.lit(None).cast("string")
    by = [F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (exact, folded)]
    return F.nullif(F.coalesce(F.try_element_at(by[0], label), F.try_element_at(by[1], F.lower(label))), F.lit(UNKNOWN))


def resolve_region(df: DataFrame, column: str, mapping: DataFrame, output: str) -> DataFrame:
    entries = short_list(mapping, ["raw_label", "canonical"])
    if entries is not None:
        return df.withColumn(output, region_of(normalise_string(F.col(column)), entries))
    return attach_region(df, column, region_labels(mapping), output)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the normalised values, blanks included."""
    return df.select(normalise_string(F.col(column)).alias("value")).groupBy("value").count()


def frequent_labels(counts: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Title-cased non-blank values whose share of all rows reaches the threshold, in order."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold lies between 0 and 1")
    total = counts.agg(F.sum("count").alias("total"))
    shares = counts.crossJoin(F.broadcast(total))  # one row
    kept = shares.where((F.col("value") != "") & (F.col("count") / F.col("total") >= threshold))
    return kept.select(title_case(F.col("value")).alias("label")).distinct().orderBy("label")


def build_region_map(values: DataFrame, column: str, existing: DataFrame, canonical: DataFrame, unknown: str = UNKNOWN, most: int = 2) -> DataFrame:
    """(raw_label, canonical): kept entries, guesses for new labels (``unknown`` without one), and every region for itself."""
    new = values.select(normalise_string(F.col(column)).alias("raw_label")).where("raw_label <> ''").distinct()
    new = new.join(existing.select("raw_label"), "raw_label", "left_anti")
    guessed = resolve_fuzzy(new, "raw_label", canonical, "canonical", most).select("raw_label", F.coalesce("canonical", F.lit(unknown)).alias("canonical"))
    own = canonical.select(F.col("canonical").alias("raw_label"), "canonical")
    ranked = existing.select("raw_label", "canonical", F.lit(0).alias("p")).unionByName(guessed.withColumn("p", F.lit(1))).unionByName(own.withColumn("p", F.lit(2)))
    first = ranked.groupBy("raw_label").agg(F.min_by("canonical", "p").alias("canonical"))
    return first.orderBy(F.lower("raw_label"), "raw_label")


def product_categories(df: DataFrame, product: str = "product_name", category: str = "category", confidence: float = 0.70) -> DataFrame:
    """(product_name, category, confidence) where one category has more than ``confidence`` of a product's rows."""
    rows = df.where(F.col(product).isNotNull() & F.col(category).isNotNull())
    counted = rows.groupBy(F.col(product).alias("product_name"), F.col(category).alias("category")).count()
    whole = Window.partitionBy("product_name")
    first = whole.orderBy(F.col("count").desc(), "category")
    share = F.col("count") / F.sum("count").over(whole)
    ranked = counted.withColumn("confidence", F.round(share, 4)).withColumn("share", share).withColumn("place", F.row_number().over(first))
    return ranked.where((F.col("place") == 1) & (F.col("share") > confidence)).select("product_name", "category", "confidence")
