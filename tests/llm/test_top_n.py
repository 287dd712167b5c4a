import random

import pytest

from sluicebox.llm.top_n import top_n

SCHEMA = "g string, s double, name string, rank int"


def brute(rows, n):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]}, key=lambda r: (-r[1], (r[2] or "").encode()))
        out[g] = [(r[1] + 0.0, r[2]) for r in own[:n]]
    return {g: v for g, v in out.items() if v}


def found(df, n, **options):
    out = {}
    for row in sorted(top_n(df, "g", "s", "name", n, **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(row.g, []).append((row.s + 0.0, row.name))
        assert row["rank"] == len(out[row.g])
    return out


@pytest.mark.parametrize("fanout", [2, 64])
def test_random_groups(spark, fanout):
    rng = random.Random(fanout)
    rows = [(rng.choice(["a", "b", None, *(f"g{i}" for i in range(30))]), rng.choice([None, float("nan"), -0.0, 0.0, -3.5, 1e300, 1.0, rng.uniform(-9, 9)]), f"p{rng.randint(0, 500):03d}", rng.randint(0, 2)) for _ in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    # rows that differ elsewhere count apart, under one name
    assert found(df, 5, fanout=fanout) == brute(rows, 5)


def test_ties_with_long_common_names(spark):
    rows = [("g", 1.0, "x" * 3000 + f"{i:04d}" + "y" * (i % 3), 0) for i in range(300)] + [("g", 1.0, "x" * 2999, 0), ("g", 2.0, "z", 0), ("h", 1.0, None, 0), ("h", 1.0, "", 1), ("h", 1.0, "é", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df, 4)
    assert got["g"] == brute(rows, 4)["g"]
    assert [n for _, n in got["h"]][2] == "é"


def test_repeats_small_and_empty(spark):
    df = spark.createDataFrame([("g", 1.0, "a", 0)] * 7 + [("g", 0.5, "b", 0)], SCHEMA)
    assert found(df, 3) == {"g": [(1.0, "a"), (0.5, "b")]}
    assert found(df, 3, repeats=True) == {"g": [(1.0, "a")] * 3}
    assert top_n(df.where("false"), "g", "s", "name", 3).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        top_n(df, "g", "s", "name", 0)


def test_one_group_holds_a_third(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", float(i * 7919 % 1009), f"n{i}", 0) for i in range(9000)]
    assert found(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)
