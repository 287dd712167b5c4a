import pytest
from pyspark.sql import functions as F

from sluicebox import session
from sluicebox.sources import tables


def test_small_by_rows_and_by_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array("id").alias("a"))
    assert tables.is_small(rows) and not tables.is_small(rows, rows=99) and not tables.is_small(rows, size=100_000)
    assert tables.is_small(rows.where("false"), rows=0) and tables.is_small(spark.createDataFrame([(None,)], "t string"))
    assert tables.broadcast_if_small(rows, rows=5) is rows


class Elsewhere:
    """A session of a cluster whose checkpoint folder isn't set."""

    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:
        get = staticmethod(lambda name, default: default)


def test_no_local_checkpoints_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Elsewhere)
