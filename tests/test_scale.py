"""Helpers for skewed keys and numbering."""

import hashlib
import random

from pyspark.sql import functions as F

from pagewarden.operators import scale


def test_dense_ids_are_consecutive_and_repeatable(spark):
    df = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"))
    one = {r.url: r.n for r in scale.dense_ids(df, ["url"], "n", 100).collect()}
    assert sorted(one.values()) == list(range(101, 3101))
    order = sorted(one, key=lambda u: hashlib.md5(u.encode()).hexdigest())
    assert [one[u] for u in order] == list(range(101, 3101))
    two = {r.url: r.n for r in scale.dense_ids(df.repartition(7), ["url"], "n", 100).collect()}
    assert one == two


def test_rank_with_one_dominating_key(spark):
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5).alias("site"),
        F.timestamp_seconds(F.lit(1700000000) + (F.col("id") * 37) % 501).alias("at"))
    got = {r.id: r.p for r in scale.rank_newest_first(df, "site", "at", "id", "p", 16).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.at, r.id), reverse=True)
    want, seen = {}, {}
    for r in rows:
        seen[r.site] = seen.get(r.site, 0) + 1
        want[r.id] = seen[r.site]
    assert got == want


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    right = spark.range(40).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")
                                   ).union(spark.sql("SELECT 'hot', 99L"))
    assert scale.hot_keys(left, "key", 300) == {"hot": 3}
    for how in ("left", "inner"):
        plain = sorted(map(str, left.join(right, "key", how).select("id", "key", "v").collect()))
        salted = scale.salted_join(left, right, "key", ["hot", "k1"], "id", how, salts=8)
        assert sorted(map(str, salted.select("id", "key", "v").collect())) == plain


def test_hot_keys_are_found_and_split_without_a_floor(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 999)).alias("key"))
    right = left.select("key").distinct().withColumn("v", F.length("key"))
    hot = scale.hot_keys(left, "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert list(hot) == ["hot"] and parts < hot["hot"] <= scale.SPLIT * parts
    for how in ("left", "inner"):
        salted = scale.salted_join(left, right, "key", hot, "id", how)
        plain = left.join(right, "key", how)
        assert sorted(map(tuple, salted.select("id", "key", "v").collect())) == sorted(
            map(tuple, plain.select("id", "key", "v").collect()))


def test_rank_with_one_dominating_time(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("site"), F.timestamp_seconds(
        F.when(F.col("id") % 4 < 3, 1700000000).otherwise(1700000000 + F.col("id") - 1000)).alias("at"))
    got = {r.id: r.p for r in scale.rank_newest_first(df, "site", "at", "id", "p", 16).collect()}
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.at, r.id), reverse=True):
        seen[r.site] = seen.get(r.site, 0) + 1
        want[r.id] = seen[r.site]
    assert got == want


def test_rows_without_key_are_kept_and_spread(spark):
    left = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("key"))
    right = spark.range(50).select(F.col("id").alias("key"), F.lit("x").alias("v"))
    df = scale.salted_join(left, right.hint("merge"), "key", [], "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key#") == 2 and plan.count(", _salt#") >= 2
    joined = df.collect()
    assert len(joined) == 100
    assert {r.id for r in joined if r.v == "x"} == set(range(0, 50, 2))


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).select("id", F.array("id").alias("a"))
    again = scale.materialize(df, "t")
    assert again.schema.simpleString() == df.schema.simpleString()
    assert again.count() == 10


def test_close_removes_the_run_folder(spark):
    import os

    other = spark.newSession()
    kept = scale.materialize(other.range(3).toDF("n"), "kept")
    assert kept.count() == 3 and os.path.isdir(scale.run_dir(other))
    scale.close(other)
    assert not os.path.exists(scale.run_dir(other))
    assert scale.materialize(other.range(2).toDF("n"), "again").count() == 2


def test_newest_rows(spark):

    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), rng.choice([None, -1, 5]),
             rng.choice(["x", "y"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, s bigint, n bigint, t string").selectExpr(
        "k", "timestamp_seconds(s) AS at", "n", "t", "s")
    order = lambda r: tuple((x is not None, x) for x in r[1:])
    want = {k: max((r for r in rows if r[0] == k), key=order) for k in {r[0] for r in rows}}
    newest = scale.newest_rows(df, "k", "at", "n", ["t"])
    got = newest.collect()
    assert len(got) == len(want) and all((r.k, r.s, r.n, r.t) == want[r.k] for r in got)
    assert newest.columns == df.columns
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_run_outcomes_sort_nothing(spark):
    from pagewarden.operators import store

    rng = random.Random(6)
    rows = [(rng.randint(1, 20), rng.choice(["Running", "Completed", "Failed"]), rng.randint(0, 4),
             rng.choice([None, "r1", "r2"]), rng.choice([None, "e1", "e2"])) for _ in range(300)]
    events = spark.createDataFrame(rows, "scan_run_id bigint, status string, s bigint, report_ref string, "
                                   "error_message string").withColumn("at", F.timestamp_seconds("s")).drop("s")
    outcomes = store.run_outcomes(events)
    assert "SortAggregate" not in outcomes._jdf.queryExecution().executedPlan().toString()

    def last(run, status, place):
        at = [r for r in rows if r[0] == run and r[1] == status]
        texts = [r[place] for r in at if r[2] == max(x[2] for x in at) and r[place]]
        return max(texts, default=None)
    for r in outcomes.collect():
        own = [x for x in rows if x[0] == r.scan_run_id]
        assert r.status == max(own, key=lambda x: (x[2], x[1] != "Running", x[1]))[1]
        assert (r.report_ref, r.error_message) == (last(r.scan_run_id, "Completed", 3), last(r.scan_run_id, "Failed", 4))


def test_orphans_of_a_hot_parent(spark):
    from pagewarden.operators import store

    sites = spark.sql("SELECT id AS website_id, concat('https://s', id) AS url, 's' AS domain, "
                      "TIMESTAMP '2024-01-01' AS created_at FROM range(5)")
    runs = spark.sql("""SELECT id AS scan_run_id, CASE WHEN id % 4 <> 0 THEN 7 WHEN id % 100 = 0 THEN NULL
        ELSE id % 5 END AS website_id, TIMESTAMP '2024-01-01' AS started_at, 'Completed' AS status FROM range(4000)""")
    findings = spark.sql("""SELECT 1L AS finding_id, 1L AS scan_run_id, 'R01' AS rule_id, '' AS description,
        '' AS recommendation, '{}' AS evidence_json, 'Open' AS status, TIMESTAMP '2024-01-01' AS created_at""")
    companies = spark.sql("""SELECT 1L AS company_id, 1L AS website_id, 'x' AS name,
        TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at""")
    got = store.violations(sites, runs, findings, companies)
    by_name = {r.constraint_name: r["count"] for r in got.groupBy("constraint_name").count().collect()}
    assert by_name == {"run_website": 3000 + 40, "run_not_null": 40}


def test_every_policy_phrase_is_met(spark):
    from conftest import SMALL
    from pagewarden import lexicon
    from pagewarden.sources import corpus

    texts = [r.text.lower() for r in corpus.policy_documents(spark, SMALL).select("text").collect()]
    for keys in lexicon.POLICY_PHRASES.values():
        for phrases in keys.values():
            for phrase in phrases:
                assert any(phrase in t for t in texts), phrase


def test_sieve(spark):
    keys = spark.createDataFrame([(f"https://h{i}/",) for i in range(5000)] * 2 + [(None,)], "url string")
    others = spark.range(100000).selectExpr("concat('https://other', id, '/') AS url")
    passes = scale.sieve(keys, "url")
    known = keys.where("url IS NOT NULL").distinct()
    assert known.where(passes(F.col("url"))).count() == 5000
    assert others.where(passes(F.col("url"))).count() < 10000
    # through an aggregate, and on both sides of a join: before they are shuffled
    counted = others.groupBy("url").count().join(others.withColumn("n", F.lit(1)), "url")
    plan = counted.where(passes(F.col("url")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") == 2 and plan.index("Aggregate") < plan.index("bit_count")
    assert others.where(scale.sieve(keys.limit(0), "url")(F.col("url"))).count() == 0


def test_sieve_of_more_keys_than_its_words_hold(spark, monkeypatch):
    monkeypatch.setattr(scale, "SIEVE_WORDS", 1024)
    keys = spark.range(20000).selectExpr("CAST(id AS string) AS k")
    assert keys.where(scale.sieve(keys, "k")(F.col("k"))).count() == 20000
