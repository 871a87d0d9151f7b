"""Row numbers dealt by range against plain windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from momentlake.operators.ranks import dealt, numbered


def rows(spark, n=20_000):
    # A third of the rows have one key, and some have none.
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 40).cast("string"))
    return spark.range(n).select(key.alias("k"), (F.xxhash64("id") % 500).alias("score"), "id")


def test_within_keys(spark):
    df = rows(spark)
    got = numbered(df, ["k"], [F.desc("score"), "id"])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "id")).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == df.count()
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("Scan parquet")[0]  # rows meet no window


def test_over_all_rows(spark):
    df = rows(spark, 5_000)
    got = {r["id"]: r["rank"] for r in numbered(df, [], [F.desc("score"), "id"]).collect()}
    order = sorted(df.collect(), key=lambda r: (-r["score"], r["id"]))
    assert [got[r["id"]] for r in order] == list(range(1, 5_001))


def test_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        assert dealt(rows(spark), ["k"], ["id"]).where("k = 'hot'").select("_part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert numbered(rows(spark, 0), ["k"], ["id"]).count() == 0 and numbered(rows(spark, 0), [], ["id"]).count() == 0


def test_scopes_delete_what_was_written(spark):
    from momentlake import scratch

    root = scratch.scratch_root(spark)
    list_of = lambda: {str(f.getPath()) for f in spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root))}
    outer = scratch.materialize(spark.range(3), "outer")
    before = list_of()
    with scratch.scope():
        inner = numbered(rows(spark, 100), ["k"], ["id"])
        assert inner.count() == 100 and list_of() > before
    assert list_of() == before and outer.count() == 3


def test_only_costly_plans_are_written(spark):
    from momentlake.scratch import once

    named = spark.range(3).selectExpr("id AS `Sort Window Join`")
    assert once(named) is named
    for costly in (named.distinct(), named.orderBy(named.columns[0]), named.mapInPandas(lambda it: it, named.schema), named.select(F.udf(lambda x: x, "long")(named.columns[0]).alias("u"))):
        assert once(costly) is not costly
