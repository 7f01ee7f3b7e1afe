"""Store changes, snapshots and company data."""

import pytest
from pyspark.sql import functions as F

from pagewarden import schemas
from pagewarden.operators import company, store
from pagewarden.plans import store_queries as sq
from pagewarden.sources import sinks


@pytest.fixture()
def sites(spark):
    seen = spark.createDataFrame([("https://a.com/",), ("https://a.com/",), ("nada",)], "url string"
                                 ).withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    empty = spark.createDataFrame([], schemas.WEBSITES)
    return seen, store.get_or_create(empty, seen)


def test_get_or_create_twice(sites):
    seen, table = sites
    rows = {r.url: (r.website_id, r.domain) for r in table.collect()}
    assert {u: d for u, (_, d) in rows.items()} == {"https://a.com/": "a.com", "nada": "unknown"}
    assert sorted(i for i, _ in rows.values()) == [1, 2]
    again = {r.url: (r.website_id, r.domain) for r in store.get_or_create(table, seen).collect()}
    assert again == rows


def test_run_status_changes(spark, sites):
    starts = sites[1].select("website_id", F.lit("2024-01-02").cast("timestamp").alias("started_at"))
    runs = store.start_runs(spark.createDataFrame([], schemas.SCAN_RUNS), starts)
    assert {r.status for r in runs.collect()} == {"Running"}
    events = spark.sql("""SELECT * FROM VALUES
        (1L, 'Completed', timestamp'2024-01-02 00:01:00', 'abc', CAST(NULL AS string)),
        (2L, 'Completed', timestamp'2024-01-02 00:01:00', 'def', NULL),
        (2L, 'Failed', timestamp'2024-01-02 00:02:00', NULL, 'HTTP 500')
        AS v(scan_run_id, status, at, report_ref, error_message)""")
    rows = {r.scan_run_id: r for r in store.apply_outcomes(runs, events).collect()}
    assert (rows[1].status, rows[1].report_ref, rows[1].error_message) == ("Completed", "abc", None)
    assert (rows[2].status, rows[2].report_ref, rows[2].error_message) == ("Failed", "def", "HTTP 500")
    assert rows[2].finished_at.minute == 2


COMPANY = "website_id bigint, name string, legal_name string, nif string, address string, " \
          "registry_verified boolean, note string, nameservers_json string, written_at timestamp"


def test_company_upsert_overwrites_everything(spark):
    def batch(*rows):
        return spark.createDataFrame(rows, COMPANY.replace("timestamp", "string")).withColumn(
            "written_at", F.col("written_at").cast("timestamp"))

    first = batch((1, "A", "A Lda", "5", "x", True, "n", '["ns"]', "2024-01-01"),
                  (0, "none", None, None, None, None, None, None, "2024-01-01"))
    table = store.upsert_companies(spark.createDataFrame([], schemas.COMPANIES), first)
    one = table.collect()
    assert len(one) == 1 and one[0].company_id == 1
    second = batch((1, "B", None, None, None, False, None, None, "2024-02-01"),
                   (2, "C", None, None, None, None, None, None, "2024-02-01"))
    rows = {r.website_id: r for r in store.upsert_companies(table, second).collect()}
    assert (rows[1].company_id, rows[1].name, rows[1].legal_name, rows[1].nif) == (1, "B", None, None)
    assert rows[1].registry_verified is False
    assert rows[1].created_at == one[0].created_at and rows[1].updated_at.month == 2
    assert rows[2].company_id == 2


def test_snapshot_table(spark, tmp_path):
    table = sinks.SnapshotTable(str(tmp_path / "t"), "id bigint")
    assert table.read(spark).count() == 0
    table.replace(spark.range(3))
    table.replace(table.read(spark).union(spark.range(3, 5)))
    assert sorted(r.id for r in table.read(spark).collect()) == [0, 1, 2, 3, 4]


def test_two_writers_lose_nothing(spark, tmp_path):
    tables = [sinks.SnapshotTable(str(tmp_path / "t"), "id bigint") for _ in range(2)]
    tables[0].replace(spark.range(2))
    seen = []

    def change(old):  # the other writer publishes between this one's reading and writing
        seen.append(sorted(r.id for r in old.collect()))
        if len(seen) == 1:
            tables[1].update(spark, lambda now: now.union(spark.range(2, 4)))
        return old.union(spark.range(4, 6))
    tables[0].update(spark, change)
    assert seen == [[0, 1], [0, 1, 2, 3]]
    assert sorted(r.id for r in tables[1].read(spark).collect()) == [0, 1, 2, 3, 4, 5]
    assert tables[0].version(spark) == 3

    def always(old):
        tables[1].update(spark, lambda now: now)
        return old
    with pytest.raises(sinks.LostRace):
        tables[0].update(spark, always, tries=2)


def test_writer_that_died(spark, tmp_path):
    table = sinks.SnapshotTable(str(tmp_path / "t"), "id bigint")
    table.patience = 0.3
    table.replace(spark.range(1))
    (tmp_path / "t/published/2").write_text("0 part-of-nobody")  # its last line is missing
    assert table.version(spark) == 1 and table.read(spark).count() == 1
    table.replace(spark.range(5))
    assert (table.version(spark), table.read(spark).count()) == (2, 5)


def test_added_parts_are_rewritten_once_a_level(spark, tmp_path):
    table = sinks.SnapshotTable(str(tmp_path / "t"), "id bigint, n bigint")
    written, write = [], table._write

    def spy(df, level):
        part = write(df, level)
        written.append((level, spark.read.parquet(f"{table.path}/{part[1]}").count()))
        return part
    table._write = spy

    def merge(rows):
        return rows.groupBy("id").agg(F.max("n").alias("n"))
    for k in range(9):
        table.add(spark.range(2 * k, 2 * k + 2).select("id", F.lit(k).cast("bigint").alias("n")), merge, fan=3)
    assert [w for w in written if w[0]] == [(1, 6), (1, 6), (1, 6), (2, 18)]
    assert len(table._newest(spark)[1]) == 1
    assert {r.id: r.n for r in merge(table.read(spark)).collect()} == {i: i // 2 for i in range(18)}


def test_store_kinds(spark, tmp_path):
    path = str(tmp_path / "none")
    sinks.write_table(spark.range(3), path, "none")
    assert sinks.read_table(spark, path, "id bigint").count() == 0
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(2), path)
    assert sinks.read_table(spark, path, "id bigint").count() == 5
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), path, "paper")


def test_unified_report_rows(spark):
    sites = spark.sql("SELECT 1L AS website_id, 'https://a.com/' AS url")
    runs = spark.sql("SELECT * FROM VALUES (1L, 1L, timestamp'2024-01-01', 'Completed'), "
                     "(2L, 1L, timestamp'2024-01-02', 'Running') AS v(scan_run_id, website_id, started_at, status)")
    found = spark.sql("SELECT * FROM VALUES (1L, 'R02', 'd', 'r', 'Open'), (1L, 'R01', 'd', 'r', 'Open') "
                      "AS v(scan_run_id, rule_id, description, recommendation, status)")
    firms = spark.createDataFrame([], schemas.COMPANIES)
    rows = sq.unified_report(sites, runs, firms, found).collect()
    assert [(r.rule_id, r.finding_status, r.company) for r in rows] == [
        ("Conforme", "-", None), ("R01", "Open", None), ("R02", "Open", None)]
    salted = sq.unified_report(sites, runs, firms, found, floor=1).collect()
    assert salted == rows


# -- company ---------------------------------------------------------------------
RESULT = ("company_id int, company_name string, legal_name string, url string, confidence string, "
          "nif string, address string, registry_verified boolean, note string, nameservers string")


def results(spark, **changes):
    row = dict(company_id=1, company_name="Feedzai", legal_name=None, url="https://f.com",
               confidence="high", nif="5", address="Coimbra", registry_verified=True, note=None,
               nameservers="not available") | changes
    return spark.createDataFrame([tuple(row.values())], RESULT)


@pytest.mark.parametrize("changes, force, decision, warnings", [
    ({}, False, "go", []),
    ({"confidence": "medium"}, False, "go", ["medium_confidence"]),
    ({"confidence": "LOW"}, False, "blocked", []),
    ({"confidence": "low"}, True, "go", ["low_confidence"]),
    ({"confidence": "not available"}, False, "go", []),
    ({"url": " Not Available "}, True, "blocked", []),
    ({"registry_verified": False}, False, "go", ["registry_not_confirmed"]),
    ({"registry_verified": None}, False, "go", []),
])
def test_confidence_gate(spark, changes, force, decision, warnings):
    r = company.gate(results(spark, **changes), force).first()
    assert (r.decision, r.warnings) == (decision, warnings)


def test_sentinels_and_nameservers(spark):
    df = spark.createDataFrame([("not available",), ("",), (None,), (" 123 ",), ('["a","b"]',)], "v string")
    got = df.selectExpr(f"{company.cleaned('v')} AS c", f"{company.nameserver_list('v')} AS n").collect()
    assert [tuple(r) for r in got] == [
        (None, []), (None, []), (None, []), (" 123 ", [" 123 "]), ('["a","b"]', ["a", "b"])]


def test_company_input_errors(spark):
    raws = ['{"company_name": " A "}', "{oops", "[1]", '"text"', '{"company_name": "  "}', "{}"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [(r.company_name, r.error) for r in company.parse_input(df).collect()]
    assert got == [("A", None), (None, "invalid_json"), (None, "not_an_object"),
                   (None, "not_an_object"), (None, "missing_company_name"),
                   (None, "missing_company_name")]


def test_company_never_changes_rows_of_sites(spark):
    sites = spark.sql("SELECT 'https://f.com' AS url UNION ALL SELECT 'https://g.com'")
    two = results(spark).union(results(spark, company_id=2, company_name="Earlier name"))
    merged = company.merge_into_sites(sites, two).collect()
    assert len(merged) == 2
    rows = {r.url: r for r in merged}
    assert rows["https://f.com"].company_legal_name == "Feedzai"
    assert rows["https://g.com"].company_legal_name is None


def test_persisted_audits(spark):
    """Two audits into one store: sites once, runs each time, findings of completed runs only."""
    from conftest import SMALL
    from pagewarden.operators import rules
    from pagewarden.plans import audit, persist
    from pagewarden.sources import corpus

    done = audit.run_audit(corpus.site_pages(spark, SMALL), corpus.legal_pages(spark, SMALL))
    companies = spark.createDataFrame(
        [(done.evaluated.first().url, "Some Company", "500000001"), ("https://unknown.example/", "Other", None)],
        "url string, company_name string, nif string").selectExpr(
        "url", "company_name", "CAST(NULL AS string) AS legal_name", "nif", "CAST(NULL AS string) AS address",
        "true AS registry_verified", "'' AS note", "'' AS nameservers")
    one = persist.persist(done, persist.empty_store(spark), companies)
    two = persist.persist(done, one.store, companies)
    n_found = rules.finding_rows(done.evaluated, "page_id").count()
    n_runs = done.evaluated.count() + done.failed.count()
    assert one.store.runs.count() == n_runs and two.store.runs.count() == 2 * n_runs
    assert one.feed.count() == n_found and one.reports.count() == done.evaluated.count()
    assert two.store.findings.count() == 2 * n_found
    assert two.store.findings.select("finding_id").distinct().count() == 2 * n_found
    assert sorted(two.store.websites.collect()) == sorted(one.store.websites.collect())
    assert store.violations(*[getattr(two.store, t) for t in (
        "websites", "runs", "findings", "companies")]).count() == 0
    assert {r.status for r in two.store.runs.collect()} == {"Completed", "Failed"}
    assert store.published(two.store.findings, two.store.runs).count() == 2 * n_found
    assert [(r.name, r.nif) for r in two.store.companies.collect()] == [("Some Company", "500000001")]
    evidence = {r.evidence_json for r in one.store.findings.collect()}
    assert evidence == {r.evidence for r in rules.finding_rows(done.evaluated, "page_id").collect()}


def test_persisting_nothing(spark):
    from conftest import SMALL
    from pagewarden.plans import audit, persist
    from pagewarden.sources import corpus

    none = audit.run_audit(corpus.site_pages(spark, SMALL).limit(0))
    kept = persist.persist(none, persist.empty_store(spark)).store
    assert kept.runs.count() == kept.websites.count() == kept.findings.count() == 0
