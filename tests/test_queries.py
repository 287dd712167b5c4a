"""Every core query with SQL gives what DuckDB gives; the others give rows."""

import pytest
from conftest import rows_of

from sluicebox.plans import core_queries, core_sql, data_queries

QUERIES = {**core_queries.QUERIES, **data_queries.QUERIES}
SQL = {**core_sql.SQL, **data_queries.SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_all_rules_of_late_batches(spark, sf_dir, duck, tmp_path):
    # times a million these batch numbers are beyond int
    duck.execute(f"COPY (SELECT * REPLACE (CAST(batch_id + 3000 AS INTEGER) AS batch_id) FROM clean_sales) TO '{tmp_path}/clean_sales.parquet' (FORMAT parquet)")
    got = core_queries.all_rules(spark, str(tmp_path)).toPandas()
    want = duck.execute(core_sql.SQL["all_rules"]).df()
    want["row_index"] += 3_000_000_000
    assert len(got) and rows_of(got) == rows_of(want)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
