"""Look-ups read the folders, row groups and pages of their keys only."""

import os

import pytest
from pyspark.sql import functions as F

from pagewarden.plans import store_queries as sq
from pagewarden.sources import keyed
from pagewarden.sources.keyed import KeyedTable, together

SCHEMA = "id bigint, nif string, n int, _bucket_like string"


def rows(spark, first, last):
    return spark.range(first, last).select(
        F.when(F.col("id") % 50 != 7, F.expr("id DIV 3")).alias("id"), F.md5(F.col("id").cast("string")).alias("nif"),
        F.col("id").cast("int").alias("n"), F.lit("x").alias("_bucket_like"))


def rows_scanned(df):
    """Rows that left the file scans, after folders, row groups and pages were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture()
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "ROW_GROUP_BYTES", 1 << 12)
    made = KeyedTable(str(tmp_path / "t"), SCHEMA, "id", ("n",), ("nif",), buckets=16)
    made.replace(rows(spark, 0, 60_000))
    return made


def test_look_ups_skip(spark, table):
    everything = rows(spark, 0, 60_000)
    assert table.read(spark).exceptAll(everything).count() == 0 and table.read(spark).count() == 60_000
    assert table.read(spark).columns == everything.columns
    for ids in ([5], [5, 9_000, 19_999, 10 ** 9], list(range(0, 20_000, 400))):
        found = table.find(spark, ids)
        want = everything.where(F.col("id").isin(ids))
        assert found.exceptAll(want).count() == 0 and found.count() == want.count() > 0
    one = table.find(spark, [1234])
    assert one.count() == 3 and rows_scanned(one) < 60_000 / 16
    assert rows_scanned(table.read(spark)) == 60_000


def test_other_columns_by_bloom_filters(spark, table):
    nif = table.read(spark).where("n = 777").first()["nif"]
    found = table.find(spark, [nif], "nif")
    assert [r.n for r in found.collect()] == [777] and rows_scanned(found) < 60_000 / 4
    with pytest.raises(ValueError, match="not laid out"):
        table.find(spark, [1], "n")


def test_many_keys_are_joined(spark, table):
    keys = spark.range(0, 20_000, 7).toDF("id").union(spark.sql("SELECT CAST(NULL AS bigint)"))
    want = rows(spark, 0, 60_000).join(keys, "id", "left_semi")
    for limit in (10, 10_000):
        table.max_keys = limit
        found = table.find_by(keys)
        assert found.exceptAll(want).count() == 0 and found.count() == want.count()


def test_appends_and_empty_tables(spark, tmp_path):
    made = KeyedTable(str(tmp_path / "t"), SCHEMA, "id", ("n",))
    assert made.find(spark, [1]).count() == made.read(spark).count() == 0
    for i in range(9):
        made.add(rows(spark, 100 * i, 100 * i + 100), together, fan=3)
    assert len(made._newest(spark)[1]) == 1  # 9 parts became 3, these became 1
    made.add(rows(spark, 0, 100), together, fan=3)
    assert made.read(spark).count() == 1000 and made.find(spark, [5, None]).count() == 6
    assert made.find(spark, []).count() == made.find(spark, [None]).count() == 0
    made.replace(rows(spark, 0, 0))
    assert made.read(spark).count() == made.find(spark, [5]).count() == 0


def test_a_hot_key_is_split(spark, tmp_path):
    made = KeyedTable(str(tmp_path / "t"), SCHEMA, "id", ("n",), buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be one task
    made.replace(rows(spark, 0, 4000).withColumn("id", F.when(F.col("n") % 3 != 0, 1).otherwise(F.col("id")).cast("bigint")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    part = made._newest(spark)[1][0][1]
    files = [len([f for f in os.listdir(os.path.join(d, b)) if f.endswith(".parquet")])
             for d in [str(tmp_path / "t" / part)] for b in os.listdir(d) if b.startswith("_bucket")]
    assert max(files) > 1 and made.find(spark, [1]).count() >= 2600


def test_site_history_of_a_keyed_table(spark, tmp_path):
    runs = spark.createDataFrame([(1, 7, "2024-01-01"), (2, 7, "2024-01-02"), (3, 8, "2024-01-01")],
                                 "scan_run_id bigint, website_id bigint, at string").selectExpr(
        "scan_run_id", "website_id", "CAST(at AS timestamp) AS started_at")
    made = KeyedTable(str(tmp_path / "t"), runs.schema, "website_id", ("started_at", "scan_run_id"))
    made.replace(runs)
    assert [r.scan_run_id for r in sq.site_history(made.find(spark, [7]), 7).collect()] == [2, 1]
    wanted = spark.createDataFrame([(7,), (7,), (9,)], "website_id bigint")
    got = sq.histories_of(made, wanted).collect()
    assert sorted((r.scan_run_id, r.position) for r in got) == [(1, 2), (2, 1)]
