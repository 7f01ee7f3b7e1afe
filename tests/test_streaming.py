"""Streams give what the batch gives."""

import datetime

from conftest import SMALL
from pagewarden import schemas
from pagewarden.operators import rules
from pagewarden.plans import audit
from pagewarden.registry import audits
from pagewarden.sources import corpus
from pagewarden.streaming import append_stream, audit_stream, lifecycle, spans


COLUMNS = [part.split()[0] for part in schemas.CRAWL.split(", ")]
KEY = ("page_id", "rule_id", "evidence")


class Stream:
    """The two queries of the streaming audit over folders of crawl files."""

    def __init__(self, spark, folder, **limits):
        self.spark, self.limits = spark, limits
        self.path = lambda *names: "/".join((str(folder), *names))

    def add(self, pages, target, files=1):
        kind = "site" if target else "legal"
        pages.select(*COLUMNS).repartition(files).write.mode("append").parquet(self.path("in", kind))
        audit_stream.start_facts(
            audit_stream.crawl_stream(self.spark, self.path("in", kind), 1), self.path("facts", kind),
            self.path("progress", kind), target).awaitTermination()

    def drain(self, until=None, files=100):
        if until:
            audit_stream.write_heartbeat(self.spark, self.path("facts", "beat"), until)
        query = audit_stream.start_audit(
            audit_stream.facts_stream(self.spark, self.path("facts", "*"), files), self.path("out"),
            self.path("progress", "audit"), **self.limits)
        query.awaitTermination()
        return query.lastProgress

    def found(self):
        rows = self.spark.read.schema("page_id bigint, rule_id string, evidence string").parquet(self.path("out"))
        return sorted(map(tuple, rows.select(*KEY).collect()))


def test_audit_stream_equals_batch(spark, tmp_path):
    pages, legal = corpus.site_pages(spark, SMALL), corpus.legal_pages(spark, SMALL)
    stream = Stream(spark, tmp_path, delay="30 days", period="7 days", reach="30 days")
    batch = sorted(map(tuple, rules.finding_rows(
        audit.run_audit(pages, legal).evaluated, "page_id").select(*KEY).collect()))
    stream.add(pages, True, 2)
    stream.drain(files=1)  # all legal pages are late
    early = stream.found()
    assert set(early) < set(batch)  # sites without a policy link wait for nothing
    stream.add(legal, False, 2)
    stream.drain()
    assert stream.found() == early
    stream.drain("2030-01-01")
    assert stream.found() == batch
    stream.drain()  # nothing new, nothing twice
    assert stream.found() == batch


def test_audit_stream_forgets(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    link = '<a href="/privacy">Privacy</a>'

    def row(number, path, html, time, status=200):
        url = f"https://s{number}.example.org{path}"
        return number, url, url, status, html, None, [], time

    def crawl(rows):
        return spark.createDataFrame(rows, schemas.CRAWL)
    stream = Stream(spark, tmp_path, delay="1 hour", period="1 hour", reach="3 hours")
    kept = []
    for day in range(1, 5):
        stream.add(crawl([row(day, "/", link, at(day, 2)), row(day + 10, "/", link, at(day, 2))]), True)
        stream.add(crawl([row(day, "/privacy", "right of access", at(day, 4)),
                          row(day + 10, "/privacy", "right of access", at(day, 9))]), False)  # beyond its reach
        kept.append(sum(o.numRowsTotal for o in stream.drain().stateOperators))
    assert kept[-1] <= kept[1]
    stream.drain("2024-02-01")
    unreachable = {number for number, rule, _ in stream.found() if rule == "R12"}
    assert unreachable == {day + 10 for day in range(1, 5)}
    assert {number for number, rule, _ in stream.found() if rule == "R07"} == set(range(1, 5))


def test_streaming_audit_parses_in_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audits, "_scratch", lambda spark, name: str(tmp_path / name))
    found = audits.t1(spark, SMALL)
    assert found.count()
    cores = spark.sparkContext.defaultParallelism
    for part in ("in", "facts"):  # a batch has files for all cores
        files = spark.read.parquet(str(tmp_path / "audit-stream" / part / "site")).inputFiles()
        assert len(files) >= cores and len(files) > 3


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "Running", 0), (2, 2, "Running", 5), (1, 1, "Completed", 9), (3, 3, "Running", 2),
            (3, 3, "Failed", 2)]
    events = spark.createDataFrame(rows, "scan_run_id bigint, website_id bigint, status string, s bigint"
                                   ).selectExpr("scan_run_id", "website_id", "status",
                                                "timestamp_seconds(1704067200 + s) AS at")
    source = str(tmp_path / "events")
    events.repartition(4).write.parquet(source)
    table = str(tmp_path / "states")
    stream = spark.readStream.schema(lifecycle.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    lifecycle.start_lifecycle(stream, table, str(tmp_path / "cp")).awaitTermination()
    batch = lifecycle.run_states(events)
    assert sorted(lifecycle.stored_states(spark, table).collect()) == sorted(batch.collect())
    assert {r.scan_run_id: r.status for r in batch.collect()} == {
        1: "Completed", 2: "Running", 3: "Failed"}
    stuck = lifecycle.stuck_runs(batch, "2024-01-01 01:00:10", "1 HOUR").collect()
    assert [r.scan_run_id for r in stuck] == [2]


def test_stuck_runs_come_out_of_the_stream(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("events", "stuck", "cp"))

    def drain(*rows):
        spark.createDataFrame(rows, "scan_run_id bigint, website_id bigint, status string, s bigint").selectExpr(
            "scan_run_id", "website_id", "status", "timestamp_seconds(1704067200 + s * 60) AS at"
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(lifecycle.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = lifecycle.start_stuck_report(stream, out, progress, "1 hour", "10 minutes")
        query.awaitTermination()
        found = spark.read.schema(lifecycle.STUCK).parquet(out).collect()
        return sorted((r.scan_run_id, r.started_at.minute) for r in found), query.lastProgress.stateOperators[0].numRowsTotal
    assert drain((1, 1, "Running", 5), (2, 2, "Running", 0), (3, 3, "Running", 1)) == ([], 3)
    assert drain((2, 2, "Completed", 20), (3, 3, "Running", 30), (1, 1, "Running", 2)) == ([], 3)
    # 80 minutes and the delay: all three timers have gone off, run 3 by its first start
    assert drain((9, 9, "Completed", 80)) == ([(1, 2), (3, 1)], 1)
    assert drain((9, 9, "Completed", 300)) == ([(1, 2), (3, 1)], 0)


def test_stuck_runs_in_shared_groups_equal_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("events", "stuck", "cp"))
    rows = spark.range(0, 90).selectExpr(
        "id DIV 3 AS scan_run_id", "1L AS website_id",
        "CASE WHEN id % 7 = 0 THEN 'Failed' WHEN id % 7 = 1 THEN 'Completed' ELSE 'Running' END AS status",
        "timestamp_seconds(1704067200 + (id * 37) % 300 * 60) AS at")
    # repeated rows and rows without a run or a time
    events = rows.unionByName(rows.where("scan_run_id % 4 = 0")).unionByName(rows.selectExpr(
        "CASE WHEN scan_run_id > 9 THEN scan_run_id END AS scan_run_id", "website_id", "status",
        "CASE WHEN scan_run_id <= 9 THEN at END AS at").limit(20))
    events.repartition(3).write.parquet(source)
    spark.sql("SELECT -1L AS scan_run_id, 1L AS website_id, 'Completed' AS status, timestamp'2024-02-01' AS at"
              ).write.mode("append").parquet(source)
    stream = lifecycle.stuck_stream(
        spark.readStream.schema(lifecycle.EVENTS).option("maxFilesPerTrigger", 1).parquet(source),
        "1 hour", "20 days", groups=2)
    query = append_stream(stream, out, progress)
    query.awaitTermination()
    assert all(p.stateOperators[0].numRowsTotal <= 2 for p in query.recentProgress if p.stateOperators)
    want = lifecycle.stuck_runs(lifecycle.run_states(events.where("scan_run_id IS NOT NULL AND at IS NOT NULL")),
                                "2024-01-12", "1 HOUR").select("scan_run_id", "started_at")
    found = spark.read.schema(lifecycle.STUCK).parquet(out)
    assert sorted(found.collect()) == sorted(want.collect()) != []


def test_spans_leave_the_state(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("scans", "spans", "cp"))
    kept = []
    for day in range(1, 6):
        spark.sql(f"""SELECT * FROM VALUES ({day}L, 1L, timestamp'2024-01-0{day} 05:00:00', array('R01', 'R01')),
            ({day + 10}L, 2L, timestamp'2024-01-0{day} 06:00:00', array('R0{day}')),
            ({day + 20}L, 2L, timestamp'2024-01-0{day} 06:00:00', CAST(array() AS array<string>))
            AS v(scan_run_id, website_id, started_at, rule_ids)""").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spans.SCANS).parquet(source)
        query = spans.start_spans(stream, out, progress, "1 day", "1 day")
        query.awaitTermination()
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(kept) == kept[-1] == kept[2]
    closed = spans.spans(spark.read.parquet(out)).collect()
    got = {(r.website_id, r.rule_id): (r.first_seen.day, r.last_seen.day, r.times_seen, r.is_open) for r in closed}
    assert got == {(1, "R01"): (1, 3, 6, True), **{(2, f"R0{d}"): (d, d, 1, False) for d in (1, 2, 3)}}
    batch = spans.spans(spans.period_spans(spark.read.parquet(source)))
    assert {r.times_seen for r in batch.where("website_id = 1").collect()} == {10}
