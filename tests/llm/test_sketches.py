import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import distinct_counts as D
from sluicebox.llm import quantile_sketch as Q


def test_counts_within_the_stated_error(spark):
    m = D.bitmap_size(40_000, 0.01)
    ids = spark.range(40_000).select(F.concat(F.lit("o"), F.col("id")).alias("o"), (F.col("id") % 4).alias("k"), (F.col("id") % 7).alias("d"))
    twice = ids.unionByName(ids)
    rows = D.count_combinations(D.bitmaps(twice, ["k", "d"], "o", m), ["k", "d"]).collect()
    assert len(rows) == 1 + 4 + 7 + 28
    for r in rows:
        true = 40_000 / (4 if r.k is not None else 1) / (7 if r.d is not None else 1)
        assert abs(r.estimate - true) <= max(5 * r.std_error * true, 3), r
        assert r.std_error <= 0.011 or true < 2000


def test_parts_merge_to_the_whole(spark):
    ids = spark.range(3000).select((F.col("id") % 500).cast("string").alias("o"), (F.col("id") % 3).alias("part"), F.lit("x").alias("k"))
    whole = D.bitmaps(ids, ["k"], "o", 4096)
    merged = D.union_bitmaps(D.bitmaps(ids, ["part", "k"], "o", 4096), ["k"])
    assert whole.exceptAll(merged).isEmpty() and merged.exceptAll(whole).isEmpty()


def rows_by_key(maps):
    return {tuple(r)[:-1]: bytes(r[-1]) for r in maps.collect()}


@pytest.mark.parametrize("held", [2_000_000, 500])
def test_slices_and_small_memory(spark, monkeypatch, held):
    monkeypatch.setattr(D, "HELD", held)
    monkeypatch.setattr(D, "SLICE", 8)
    ids = spark.range(4000).select(F.col("id").alias("o"), F.when(F.col("id") % 5 < 4, F.col("id") % 5).alias("k"), F.lit("é").alias("d")).repartition(3)
    maps = D.bitmaps(ids, ["k", "d"], "o", 2048)
    truth = {}
    for r in ids.select("k", D.bit_position(F.col("o"), 2048).alias("b")).collect():
        truth.setdefault(r.k, set()).add(r.b)
    packed = rows_by_key(maps)
    got = {}
    for (k, _, size, part), bits in packed.items():
        own = got.setdefault(k, set())
        fresh = {part * 256 + int(p) for p in D._positions(bits, size)}
        assert not own & fresh
        own |= fresh
    assert got == truth
    by_level = {(r.level, r.k): r.filled for r in D.count_combinations(maps, ["k", "d"]).collect()}
    assert by_level["", None] == len(set().union(*truth.values())) and all(by_level["k", k] == len(v) == by_level["k,d", k] for k, v in truth.items())


def test_sizes_fold_and_never_mix(spark):
    ids = spark.range(5000).select(F.col("id").alias("o"), (F.col("id") % 3).alias("k"))
    small, large = D.bitmaps(ids, ["k"], "o", 1024), D.bitmaps(ids, ["k"], "o", 1 << 22)
    assert rows_by_key(D.fold_bitmaps(large, 1024)) == rows_by_key(small)
    with pytest.raises(Exception, match="different sizes|fold them"):
        D.count_groups(D.union_bitmaps(small.unionByName(large), []), []).collect()
    with pytest.raises(ValueError):
        D.fold_bitmaps(small, 1000)


def test_nulls_full_bitmaps_and_nothing(spark):
    df = spark.createDataFrame([(None, "a"), ("x", None), ("x", None), (None, None)], "o string, word string")
    assert {r.word: r.filled for r in D.count_groups(D.bitmaps(df, ["word"], "o", 64), ["word"]).collect()} == {None: 1}
    with pytest.raises(ValueError, match="named like results"):
        D.count_groups(D.bitmaps(df.withColumnRenamed("word", "filled"), ["filled"], "o", 64), ["filled"])
    full = D.count_groups(D.bitmaps(spark.range(5000).select(F.col("id").alias("o"), F.lit(1).alias("k")), ["k"], "o", 64), ["k"]).collect()[0]
    assert full.filled == 64 and full.estimate is None
    assert D.bitmaps(df.where("false"), ["word"], "o", 64).count() == 0
    assert D.relative_error(0, 64) == 0.0


def test_codes_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 0.1, 1.0, 1.5, 1e300, np.inf])
    codes = Q.encode_values(values)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5]
    back = Q.decode_codes(Q.encode_values(np.array([1234.56, -77.7, 0.0])))
    assert np.allclose(back, [1234.56, -77.7, 0.0], rtol=2**-15)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    frame = [(int(i % 5), "a" if i % 3 else None, float(v), 1) for i, v in enumerate(np.exp(rng.normal(3, 2, 12_000)).round(2))]
    return spark.createDataFrame(frame, "batch int, k string, v double, w int")


def rank_errors(rows, truth):
    for r in rows:
        own = np.sort(truth[r.k])
        low, high = np.searchsorted(own, r.value * (1 - 2**-15)) / len(own), np.searchsorted(own, r.value * (1 + 2**-15), "right") / len(own)
        assert max(0, low - r.share, r.share - high) <= r.rank_error + 1e-9
        assert r.rank_error < 0.05 and r.weight == len(own)


def test_percentiles_and_merging(spark, values):
    truth = {}
    for r in values.collect():
        truth.setdefault(r.k, []).append(r.v)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    whole = Q.percentiles(Q.dyadic_sketches(values, ["k"], ["v"]), ["k"], shares)
    rank_errors(whole.collect(), truth)
    parts = Q.dyadic_sketches(values, ["batch", "k"], ["v"])
    merged = Q.percentiles(Q.add_sketches(parts, ["k"]), ["k"], shares)
    assert whole.drop("rank_error").exceptAll(merged.drop("rank_error")).isEmpty()
    everything = Q.percentiles(Q.add_sketches(parts, []), [], [0.5]).collect()
    assert len(everything) == 1 and everything[0].weight == 12_000


def test_deletions_undo(spark, values):
    gone = values.where("batch = 1").withColumn("w", F.lit(-1))
    shares = [0.1, 0.5, 0.9]
    left = Q.percentiles(Q.dyadic_sketches(values.unionByName(gone), ["k"], ["v"], weight="w"), ["k"], shares)
    want = Q.percentiles(Q.dyadic_sketches(values.where("batch <> 1"), ["k"], ["v"]), ["k"], shares)
    assert left.select("k", "share", "value", "weight").exceptAll(want.select("k", "share", "value", "weight")).isEmpty()


def test_nulls_nan_and_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", float("nan"), 1), ("a", 3.0, 1), ("b", None, 1), ("c", 2.0, -1)], "level string, v double, w int")
    rows = {r.level: r for r in Q.percentiles(Q.dyadic_sketches(df, ["level"], ["v"], weight="w"), ["level"], [0.5]).collect()}
    assert rows["a"].value == 3.0 and rows["a"].weight == 1 and "b" not in rows and rows["c"].value is None
    assert Q.percentiles(Q.dyadic_sketches(df.where("false"), ["level"], ["v"]), ["level"], [0.5]).count() == 0
    with pytest.raises(ValueError, match="named like results"):
        Q.percentiles(Q.dyadic_sketches(df.withColumnRenamed("level", "share"), ["share"], ["v"]), ["share"], [0.5])


def test_error_is_chosen_and_never_mixed(spark, values):
    truth = {}
    for r in values.collect():
        truth.setdefault(r.k, []).append(r.v)
    shares = [0.1, 0.5, 0.99]
    fine = Q.percentiles(Q.dyadic_sketches(values, ["k"], ["v"], error=0.005, exact_codes=0), ["k"], shares, error=0.005).collect()
    coarse = Q.percentiles(Q.dyadic_sketches(values, ["k"], ["v"], error=0.1, exact_codes=0), ["k"], shares, error=0.1).collect()
    rank_errors(fine, truth)
    assert max(r.rank_error for r in fine) < min(r.rank_error for r in coarse) / 3
    with pytest.raises(Exception, match="different errors"):
        Q.percentiles(Q.dyadic_sketches(values, ["k"], ["v"], error=0.005, exact_codes=0), ["k"], shares).collect()
    assert Q.width_bits() == Q.WIDTH_BITS and Q.width_bits(0.015) == Q.WIDTH_BITS + 2


def test_small_groups_by_cells_as_by_codes(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in range(3) for v in range(1, 30)], "k int, v double")
    shares = [0.1, 0.5, 0.9]
    by = [Q.percentiles(Q.dyadic_sketches(rows, ["k"], ["v"], exact_codes=n), ["k"], shares).orderBy("k", "share").collect() for n in (0, 400)]
    assert all(abs(a.value - b.value) <= 1 and a.weight == b.weight for a, b in zip(*by))
