"""Queries for store changes, store queries, company data and lifecycles."""

from pyspark.sql import functions as F

from pagewarden import lexicon as lx
from pagewarden.functions import urls
from pagewarden.operators import company, cookies as ck, extraction as ex, notify, reporting, store
from pagewarden.plans import store_queries as sq
from pagewarden.registry import oracle as o
from pagewarden.registry.pages import _scratch
from pagewarden.sources import catalogue, corpus
from pagewarden.sources.keyed import KeyedTable
from pagewarden.sources.tables import read_table
from pagewarden.streaming import lifecycle, spans

Q = {}


def query(name, sql=None):
    def register(fn):
        Q[name] = (fn, o.sql(sql) if sql else None)
        return fn
    return register


# -- tables the queries run on -----------------------------------------------------
def _described(spark, sf):
    """Stored findings with their catalogue text (R99 has none)."""
    texts = catalogue.rules_frame(spark).selectExpr(
        "id AS rule_id", "description", "recommendation")
    return corpus.findings(spark, sf).join(F.broadcast(texts), "rule_id", "left")


o.BLOCKS["described"] = """
SELECT s.scan_run_id, s.rule_id, s.status, r.description, r.recommendation
FROM stored s LEFT JOIN rules r ON r.id = s.rule_id"""


def _store_companies(spark, sf):
    rows = company.store_rows(corpus.resolutions(spark, sf))
    sites = corpus.websites(spark, sf).select("website_id", "url")
    return rows.join(sites, "url").drop("url")


def _feed(spark, sf):
    runs = corpus.scan_runs(spark, sf).select("scan_run_id", "website_id", "started_at")
    found = corpus.findings(spark, sf).join(runs, "scan_run_id").join(
        corpus.websites(spark, sf), "website_id")
    described = sq.described_findings(found.drop("status"))
    number = F.substring("rule_id", 2, 2).cast("bigint")
    return described.select(
        (F.col("scan_run_id") * 100 + number).alias("notification_id"),
        (F.col("website_id") % 5 + 1).alias("client_id"),
        F.when(F.col("scan_run_id") % 3 == 0, F.col("domain")).alias("device_name"),
        "category", F.expr(notify.level("severity")).alias("level"),
        F.concat("url", F.lit(" — "), "rule_id").alias("description"),
        F.lit(lx.FEED_AUDIT_TYPE).alias("type"), F.col("started_at").alias("created_at"))


_CATEGORY = "CASE rule_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in lx.RULE_TO_CATEGORY.items()
) + f" ELSE '{lx.CATEGORY_OTHER}' END"
_LEVEL = "CAST(CASE r.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT)"
o.BLOCKS["feed"] = f"""
SELECT s.scan_run_id * 100 + CAST(substr(s.rule_id, 2, 2) AS BIGINT) AS notification_id,
  u.website_id % 5 + 1 AS client_id, CASE WHEN s.scan_run_id % 3 = 0 THEN w.domain END AS device_name,
  {_CATEGORY.replace('CASE rule_id', 'CASE s.rule_id')} AS category, {_LEVEL} AS level,
  concat(w.url, ' — ', s.rule_id) AS description, 'website_audit' AS type, u.started_at AS created_at
FROM stored s JOIN runs u USING (scan_run_id) JOIN websites w USING (website_id)
LEFT JOIN rules r ON r.id = s.rule_id"""


# -- store changes ---------------------------------------------------------------------
@query("d1_website_get_or_create", """
SELECT website_id, url, domain FROM websites WHERE website_id % 3 = 0
UNION ALL
SELECT (SELECT max(website_id) FROM websites WHERE website_id % 3 = 0)
    + row_number() OVER (ORDER BY md5(url)), url, regexp_extract(url, '//([^/]*)', 1) FROM (
  SELECT url FROM websites UNION SELECT url FROM clean_companies WHERE url IS NOT NULL)
WHERE url NOT IN (SELECT url FROM websites WHERE website_id % 3 = 0)""")
def d1(spark, sf):
    known = corpus.websites(spark, sf)
    at = F.timestamp_seconds(F.lit(1704067200)).alias("seen_at")
    existing = known.where("website_id % 3 = 0").withColumn("created_at", at)
    seen = known.select("url", at).unionByName(
        company.store_rows(corpus.resolutions(spark, sf)).select("url", at))
    return store.get_or_create(existing, seen).select("website_id", "url", "domain")


@query("d2_scan_start", """
SELECT (SELECT max(scan_run_id) FROM runs WHERE scan_run_id % 2 = 0)
    + row_number() OVER (ORDER BY md5(website_id || '|' || strftime(started_at, '%Y-%m-%d %H:%M:%S'))) AS scan_run_id,
  website_id, started_at, 'Running' AS status
FROM (SELECT DISTINCT website_id, started_at FROM runs)""")
def d2(spark, sf):
    runs = corpus.scan_runs(spark, sf)
    starts = runs.select("website_id", "started_at").distinct()
    return store.start_runs(runs.where("scan_run_id % 2 = 0"), starts).select(
        "scan_run_id", "website_id", "started_at", "status")


def _run_events(spark, sf):
    """Complete events after 30 s, fail events after 60 s, both for some runs."""
    at = lambda seconds: (F.col("started_at") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("at")
    runs = corpus.scan_runs(spark, sf)
    none = F.lit(None).cast("string")
    done = runs.where("status = 'Completed'").select(
        "scan_run_id", F.lit("Completed").alias("status"), at(30),
        F.concat(F.lit("ref"), F.col("scan_run_id").cast("string")).alias("report_ref"),
        none.alias("error_message"))
    failed = runs.where("status = 'Failed' OR scan_run_id % 10 = 0").select(
        "scan_run_id", F.lit("Failed").alias("status"), at(60), none.alias("report_ref"),
        F.coalesce("error_message", F.lit("timeout")).alias("error_message"))
    return done.unionByName(failed)


def _finished(spark, sf):
    open_runs = corpus.scan_runs(spark, sf).select(
        "scan_run_id", "website_id", F.lit(None).cast("string").alias("report_ref"), "started_at",
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit("Running").alias("status"),
        F.lit(None).cast("string").alias("error_message"))
    return store.apply_outcomes(open_runs, _run_events(spark, sf))


_FINISHED = """
SELECT scan_run_id, CASE WHEN status = 'Failed' OR scan_run_id % 10 = 0 THEN 'Failed' ELSE status END AS status,
  CASE WHEN status = 'Failed' OR scan_run_id % 10 = 0 THEN started_at + INTERVAL 60 SECOND
       WHEN status = 'Completed' THEN started_at + INTERVAL 30 SECOND END AS finished_at,
  CASE WHEN status = 'Completed' THEN 'ref' || scan_run_id END AS report_ref,
  CASE WHEN status = 'Failed' OR scan_run_id % 10 = 0 THEN coalesce(error_message, 'timeout') END AS error_message
FROM runs"""


@query("d3_scan_complete", f"SELECT scan_run_id, status, finished_at, report_ref FROM ({_FINISHED}) WHERE status = 'Completed'")
def d3(spark, sf):
    return _finished(spark, sf).where("status = 'Completed'").select(
        "scan_run_id", "status", "finished_at", "report_ref")


@query("d4_scan_fail", f"SELECT * FROM ({_FINISHED}) WHERE status <> 'Completed'")
def d4(spark, sf):
    return _finished(spark, sf).where("status <> 'Completed'").select(
        "scan_run_id", "status", "finished_at", "report_ref", "error_message")


@query("d5_findings_append", """
SELECT row_number() OVER (ORDER BY md5(scan_run_id || '|' || CAST(substr(rule_id, 2, 2) AS BIGINT) || '|' || rule_id)) AS finding_id,
  scan_run_id, rule_id, '{"rule":"' || rule_id || '","note":null}' AS evidence_json, 'Open' AS status FROM stored""")
def d5(spark, sf):
    rows = _described(spark, sf).withColumns({
        "seq": F.substring("rule_id", 2, 2).cast("bigint"),
        "evidence": F.expr("to_json(named_struct('rule', rule_id, 'note', CAST(NULL AS string)), "
                           "map('ignoreNullFields', 'false'))"),
        "found_at": F.timestamp_seconds(F.lit(1704067200)),
    })
    empty = spark.createDataFrame([], "finding_id bigint")
    return store.new_findings(empty, rows).select(
        "finding_id", "scan_run_id", "rule_id", "evidence_json", "status")


@query("d6_company_upsert", """
WITH old AS (SELECT * FROM site_companies WHERE company_id % 3 = 0),
     new AS (SELECT * FROM site_companies WHERE (company_id % 2 = 0 OR company_id % 3 <> 0) AND website_id <> 0)
SELECT coalesce(old.company_id, (SELECT max(company_id) FROM old) + n.id) AS company_id,
  coalesce(old.website_id, new.website_id) AS website_id,
  CASE WHEN new.website_id IS NULL THEN 'old name' ELSE coalesce(new.company_name, new.legal_name) END AS name,
  CASE WHEN new.website_id IS NULL THEN old.legal_name ELSE new.legal_name END AS legal_name,
  CASE WHEN new.website_id IS NULL THEN old.nif ELSE new.nif END AS nif,
  CASE WHEN new.website_id IS NULL THEN old.registry_verified ELSE new.registry_verified END AS registry_verified,
  CASE WHEN old.website_id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
  CASE WHEN new.website_id IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at
FROM old FULL OUTER JOIN new ON old.website_id = new.website_id
LEFT JOIN (SELECT website_id, row_number() OVER (ORDER BY md5(CAST(website_id AS VARCHAR))) AS id FROM new
  WHERE website_id NOT IN (SELECT website_id FROM old)) n ON n.website_id = new.website_id""".replace(
    "WITH old AS (", "SELECT * FROM (WITH old AS (", 1) + ")")
def d6(spark, sf):
    at = lambda day: F.lit(day).cast("timestamp")
    rows = company.store_rows(corpus.resolutions(spark, sf))
    ids = corpus.resolutions(spark, sf).selectExpr(
        "company_id", f"{company.cleaned('url')} AS url")
    current = rows.join(ids, "url").join(
        corpus.websites(spark, sf).select("website_id", "url"), "url").drop("url")
    old = current.where("company_id % 3 = 0").withColumns({
        "name": F.lit("old name"), "created_at": at("2024-01-01"), "updated_at": at("2024-01-01")})
    new = current.where("company_id % 2 = 0 OR company_id % 3 <> 0").drop("company_id").withColumn(
        "written_at", at("2024-02-01"))
    return store.upsert_companies(old, new).select(
        "company_id", "website_id", "name", "legal_name", "nif", "registry_verified",
        "created_at", "updated_at")


_FINDING_KEY = "CAST(scan_run_id * 100 + CAST(substr(rule_id, 2, 2) AS BIGINT) AS VARCHAR)"
_TWICE = "JOIN (VALUES (0), (1)) AS v(n) ON v.n = 0 OR"


@query("d7_constraint_violations", f"""
SELECT 'scan_status' AS constraint_name, CAST(scan_run_id AS VARCHAR) AS key FROM runs WHERE scan_run_id % 50 = 0
UNION ALL SELECT 'run_website', CAST(scan_run_id AS VARCHAR) FROM runs WHERE website_id % 10 = 0 OR scan_run_id % 80 = 13
UNION ALL SELECT 'finding_run', {_FINDING_KEY} FROM stored WHERE scan_run_id % 4 = 1 OR scan_run_id % 11 = 6
UNION ALL SELECT 'run_not_null', CAST(scan_run_id AS VARCHAR) FROM runs
  WHERE scan_run_id % 60 = 7 OR scan_run_id % 80 = 13 OR scan_run_id % 70 = 9
UNION ALL SELECT 'finding_not_null', {_FINDING_KEY} FROM stored WHERE scan_run_id % 11 IN (0, 1, 2, 3, 4, 5, 6)
UNION ALL SELECT 'website_not_null', CAST(website_id AS VARCHAR) FROM websites {_TWICE} website_id % 7 = 0
  WHERE website_id % 10 <> 0 AND (website_id % 6 = 1 OR website_id % 11 = 3)
UNION ALL SELECT 'company_not_null', CAST(company_id AS VARCHAR) FROM site_companies {_TWICE} company_id % 9 = 0
  WHERE company_id % 13 IN (1, 2, 3, 4)
UNION ALL SELECT 'unique_website_url', url FROM websites WHERE website_id % 10 <> 0 AND website_id % 7 = 0
UNION ALL SELECT 'unique_company_website', CAST(website_id AS VARCHAR) FROM site_companies
  WHERE company_id % 9 = 0 AND company_id % 13 <> 4
UNION ALL SELECT 'company_website', CAST(company_id AS VARCHAR) FROM site_companies {_TWICE} company_id % 9 = 0
  WHERE website_id % 10 = 0 OR company_id % 13 = 4""")
def d7(spark, sf):
    """Every required column lacks its value in some rows."""
    def without(column, test):
        return F.expr(f"CASE WHEN NOT ({test}) THEN {column} END").alias(column)

    day = "TIMESTAMP '2024-01-01 00:00:00'"
    sites = corpus.websites(spark, sf).where("website_id % 10 <> 0").withColumn(
        "created_at", F.expr(day)).select(
        "website_id", "url", without("domain", "website_id % 6 = 1"),
        without("created_at", "website_id % 11 = 3"))
    sites = sites.unionByName(sites.where("website_id % 7 = 0"))
    runs = corpus.scan_runs(spark, sf).withColumn("status", F.expr(
        "CASE WHEN scan_run_id % 50 = 0 THEN 'Paused' ELSE status END")).select(
        "scan_run_id", without("website_id", "scan_run_id % 80 = 13"),
        without("started_at", "scan_run_id % 60 = 7"), without("status", "scan_run_id % 70 = 9"))
    number = F.substring("rule_id", 2, 2).cast("bigint")
    run = F.expr("CASE WHEN scan_run_id % 11 = 6 THEN NULL WHEN scan_run_id % 4 = 1 "
                 "THEN -scan_run_id ELSE scan_run_id END").alias("scan_run_id")
    columns = ("status", "description", "recommendation", "evidence_json", "created_at", "rule_id")
    found = corpus.findings(spark, sf).withColumns({
        "description": F.col("rule_id"), "recommendation": F.col("rule_id"),
        "evidence_json": F.lit("{}"), "created_at": F.expr(day)}).select(
        (F.col("scan_run_id") * 100 + number).alias("finding_id"), run,
        *[without(c, f"scan_run_id % 11 = {n}") for n, c in enumerate(columns)])
    ids = corpus.resolutions(spark, sf).selectExpr(
        "company_id", f"{company.cleaned('url')} AS url", "company_name AS name",
        f"{day} AS created_at", f"{day} AS updated_at")
    columns = ("name", "created_at", "updated_at", "website_id")
    companies = ids.join(corpus.websites(spark, sf).select("website_id", "url"), "url").select(
        "company_id", *[without(c, f"company_id % 13 = {n}") for n, c in enumerate(columns, 1)])
    companies = companies.unionByName(companies.where("company_id % 9 = 0"))
    return store.violations(sites, runs, found, companies)


@query("d8_published_findings", """
SELECT s.scan_run_id, s.rule_id FROM stored s JOIN runs r USING (scan_run_id) WHERE r.status = 'Completed'""")
def d8(spark, sf):
    """Findings are written under a batch folder before the run status."""
    path = _scratch(spark, "findings")
    unfinished = corpus.scan_runs(spark, sf).where("status <> 'Completed'").select(
        "scan_run_id", F.lit("R01").alias("rule_id"), F.lit(lx.FINDING_STATUS_OPEN).alias("status"))
    corpus.findings(spark, sf).unionByName(unfinished).write.parquet(path)
    return store.published(
        spark.read.parquet(path), corpus.scan_runs(spark, sf)).select("scan_run_id", "rule_id")


# -- store queries --------------------------------------------------------------------------
_RUN_JOIN = """FROM websites w JOIN runs s USING (website_id)
LEFT JOIN site_companies c ON c.website_id = w.website_id
LEFT JOIN described f ON f.scan_run_id = s.scan_run_id"""


@query("q1_unified_report", f"""
SELECT w.url, coalesce(c.legal_name, c.company_name) AS company, c.nif, c.address,
  CASE WHEN c.registry_verified THEN 'Confirmado' WHEN NOT c.registry_verified THEN 'Não confirmado' END AS registry,
  s.started_at, s.status AS scan_status, coalesce(f.rule_id, 'Conforme') AS rule_id,
  coalesce(f.description, {o.q(lx.NO_FINDING_DESCRIPTION)}) AS description,
  coalesce(f.recommendation, {o.q(lx.NO_FINDING_RECOMMENDATION)}) AS recommendation,
  coalesce(f.status, '-') AS finding_status {_RUN_JOIN}""")
def q1(spark, sf):
    return sq.unified_report(
        corpus.websites(spark, sf), corpus.scan_runs(spark, sf), _store_companies(spark, sf),
        _described(spark, sf))


@query("q2_unified_listing", f"""
SELECT CASE WHEN length(w.url) > 32 THEN substr(w.url, 1, 32) || '...' ELSE w.url END AS url,
  strftime(s.started_at, '%Y-%m-%d %H:%M:%S') AS started_at, s.status,
  coalesce(f.rule_id, 'Conforme') AS rule_id,
  substr(coalesce(f.description, {o.q(lx.NO_FINDING_DESCRIPTION)}), 1, 32) || '...' AS description
FROM websites w JOIN runs s USING (website_id) LEFT JOIN described f ON f.scan_run_id = s.scan_run_id""")
def q2(spark, sf):
    return sq.unified_listing(
        corpus.websites(spark, sf), corpus.scan_runs(spark, sf), _described(spark, sf))


@query("q3_scan_history", """
SELECT scan_run_id, website_id, started_at, status,
  row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC, scan_run_id DESC) AS position FROM runs""")
def q3(spark, sf):
    return sq.all_histories(corpus.scan_runs(spark, sf)).select(
        "scan_run_id", "website_id", "started_at", "status", "position")


def _keyed(spark, rows, key, order=(), blooms=()):
    table = KeyedTable(_scratch(spark, "keyed"), rows.schema, key, order, blooms)
    table.replace(rows)
    return table


# The largest website of every hundred, as one looks up a few of many.
@query("q3_history_lookup", """
SELECT scan_run_id, website_id, started_at, status,
  row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC, scan_run_id DESC) AS position FROM runs
WHERE website_id IN (SELECT max(website_id) FROM websites GROUP BY website_id // 100)""")
def q3_lookup(spark, sf):
    wanted = corpus.websites(spark, sf).groupBy(F.expr("website_id DIV 100")).agg(
        F.max("website_id").alias("website_id"))
    runs = _keyed(spark, corpus.scan_runs(spark, sf), "website_id", ("started_at", "scan_run_id"))
    return sq.histories_of(runs, wanted).select("scan_run_id", "website_id", "started_at", "status", "position")


@query("q4_findings_of_scan", """
SELECT scan_run_id, rule_id, description FROM described
WHERE scan_run_id IN (SELECT max(scan_run_id) FROM stored GROUP BY scan_run_id // 100)""")
def q4(spark, sf):
    newest = corpus.findings(spark, sf).groupBy(F.expr("scan_run_id DIV 100")).agg(
        F.max("scan_run_id").alias("scan_run_id"))
    stored = _keyed(spark, _described(spark, sf), "scan_run_id", ("rule_id",))
    return sq.findings_of_scans(stored, newest).select("scan_run_id", "rule_id", "description")


@query("q5_sites_with_rule_open", """
SELECT rule_id, count(DISTINCT website_id) AS sites FROM stored s JOIN runs r USING (scan_run_id)
WHERE s.scan_run_id % 3 <> 0 GROUP BY rule_id""")
def q5(spark, sf):
    found = corpus.findings(spark, sf).withColumn("status", F.when(
        F.col("scan_run_id") % 3 == 0, "Closed").otherwise(F.col("status")))
    return sq.open_sites_per_rule(found, corpus.scan_runs(spark, sf))


def _tracker_uses(spark, sf):
    """(tracker, domain): hosts of third-party scripts and tracking cookie names."""
    pages = ex.with_elements(corpus.site_pages(spark, sf)).where("ok")
    c, s = "c", "s"
    trackers = (
        f"concat(transform(filter({ex.third_party_scripts('scripts')}, "
        f"{s} -> {s}.src <> '{lx.INLINE_TRACKER_SRC}'), {s} -> {urls.host('s.src')}), "
        f"transform(filter({ck.with_defaults('cookies')}, {c} -> {ck.is_tracking(c)}), "
        f"{c} -> {c}.name))")
    return pages.selectExpr("host AS domain", f"explode_outer({trackers}) AS tracker").where(
        "tracker IS NOT NULL")


o.BLOCKS["uses"] = f"""
SELECT DISTINCT tracker, host AS domain FROM (
  SELECT page_id, {o.host('src')} AS tracker FROM third WHERE src <> 'inline:tracking'
  UNION ALL SELECT page_id, name FROM cookies WHERE tracking) JOIN c_pages USING (page_id)"""


@query("q6_shared_trackers", """
SELECT tracker, count(*) AS domains FROM uses GROUP BY tracker HAVING count(*) >= 2""")
def q6(spark, sf):
    return sq.shared_trackers(_tracker_uses(spark, sf))


@query("q6_tracker_domains", """
SELECT tracker, domain FROM uses QUALIFY count(*) OVER (PARTITION BY tracker) >= 2""")
def q6_pairs(spark, sf):
    return sq.tracker_domains(_tracker_uses(spark, sf))


@query("q7_site_for_nif", """
SELECT c.nif, w.url FROM site_companies c JOIN websites w USING (website_id) WHERE c.nif IS NOT NULL""")
def q7(spark, sf):
    return sq.sites_by_nif(_store_companies(spark, sf), corpus.websites(spark, sf))


@query("q7_site_lookup", """
SELECT c.nif, w.url FROM site_companies c JOIN websites w USING (website_id)
WHERE c.nif IN (SELECT max(nif) FROM site_companies GROUP BY substr(nif, 1, 2))""")
def q7_lookup(spark, sf):
    rows = _store_companies(spark, sf)
    wanted = rows.groupBy(F.substring("nif", 1, 2)).agg(F.max("nif").alias("nif"))
    companies = _keyed(spark, rows, "website_id", blooms=("nif",))
    return sq.sites_of_nifs(companies, _keyed(spark, corpus.websites(spark, sf), "website_id"), wanted)


@query("q8_notification_listing", "SELECT notification_id, client_id, device_name, category, level, description, type, created_at FROM feed")
def q8(spark, sf):
    return sq.notification_listing(_feed(spark, sf))


@query("q9_notification_totals", """
SELECT count(*) AS notifications, count(DISTINCT client_id) AS clients, count(DISTINCT device_name) AS devices FROM feed""")
def q9(spark, sf):
    return sq.notification_totals(_feed(spark, sf))


@query("q10_category_and_severity", f"""
SELECT s.scan_run_id, s.rule_id, {_CATEGORY.replace('CASE rule_id', 'CASE s.rule_id')} AS category, r.severity
FROM stored s LEFT JOIN rules r ON r.id = s.rule_id""")
def q10(spark, sf):
    return sq.described_findings(corpus.findings(spark, sf)).select(
        "scan_run_id", "rule_id", "category", "severity")


@query("n1_rule_category", f"SELECT rule_id, {_CATEGORY} AS category, count(*) AS findings FROM stored GROUP BY ALL")
def n1(spark, sf):
    return corpus.findings(spark, sf).groupBy("rule_id").agg(
        F.count("*").alias("findings")
    ).withColumn("category", F.expr(notify.category("rule_id")))


@query("n2_severity_level", f"""
SELECT {_LEVEL} AS level, count(*) AS findings FROM stored s LEFT JOIN rules r ON r.id = s.rule_id GROUP BY ALL""")
def n2(spark, sf):
    return sq.described_findings(corpus.findings(spark, sf)).withColumn(
        "level", F.expr(notify.level("severity"))).groupBy("level").agg(
        F.count("*").alias("findings"))


# -- company -----------------------------------------------------------------------------------
@query("k1_clean_values", """
SELECT company_id, url, company_name, legal_name, nif, address, note, confidence FROM clean_companies""")
def k1(spark, sf):
    columns = ("url", "company_name", "legal_name", "nif", "address", "note")
    return corpus.resolutions(spark, sf).selectExpr(
        "company_id", *[f"{company.cleaned(c)} AS {c}" for c in columns],
        f"lower({company.cleaned('confidence')}) AS confidence")


@query("k2_nameservers", """
SELECT company_id, CAST(nameservers <> '' AS BIGINT) AS n, nameservers FROM clean_companies""")
def k2(spark, sf):
    return corpus.resolutions(spark, sf).selectExpr(
        "company_id", f"{company.nameserver_list('nameservers')} AS names"
    ).selectExpr("company_id", "size(names) AS n", "array_join(names, '|') AS nameservers")


def _gate_sql(force):
    low = "false" if force else "confidence = 'low'"
    return f"""
SELECT company_id, url AS site_url, CASE WHEN reason IS NULL THEN 'go' ELSE 'blocked' END AS decision, reason,
  CASE WHEN reason IS NOT NULL THEN '' ELSE concat_ws('|', CASE WHEN confidence IN ('low', 'medium')
    THEN confidence || '_confidence' END, CASE WHEN NOT registry_verified THEN 'registry_not_confirmed' END) END AS warnings
FROM (SELECT *, CASE WHEN url IS NULL THEN 'no_url' WHEN {low} THEN 'low_confidence' END AS reason FROM clean_companies)"""


def _gate(spark, sf, force):
    return company.gate(corpus.resolutions(spark, sf), force).selectExpr(
        "company_id", "site_url", "decision", "reason", "array_join(warnings, '|') AS warnings")


@query("k3_confidence_gate", _gate_sql(False))
def k3(spark, sf):
    return _gate(spark, sf, False)


@query("k3_confidence_gate_forced", _gate_sql(True))
def k3_forced(spark, sf):
    return _gate(spark, sf, True)


@query("k4_legal_name_carry_over", """
SELECT company_id, coalesce(legal_name, 'Legal ' || company_name) AS legal_name FROM clean_companies""")
def k4(spark, sf):
    given = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.concat(F.lit("Legal "), "c_name").alias("legal_name"))
    return company.with_input_legal_name(
        corpus.resolutions(spark, sf), given, "company_id").select("company_id", "legal_name")


@query("k5_merge_into_site", """
SELECT w.url, coalesce(c.legal_name, c.company_name) AS company_legal_name, c.nif AS company_nif,
  c.address AS company_address, c.registry_verified AS company_registry_verified, c.note AS company_note,
  coalesce(c.nameservers, '') AS nameservers
FROM websites w LEFT JOIN clean_companies c ON c.url = w.url""")
def k5(spark, sf):
    merged = company.merge_into_sites(
        corpus.websites(spark, sf).select("url"), corpus.resolutions(spark, sf))
    return merged.withColumn("nameservers", F.expr(
        "coalesce(array_join(company_nameservers, '|'), '')")).drop("company_nameservers")


@query("k6_display_name", """
SELECT company_id, coalesce(company_name, legal_name, url) AS name FROM clean_companies""")
def k6(spark, sf):
    return corpus.resolutions(spark, sf).selectExpr(
        "company_id", f"{company.display_name()} AS name")


@query("g5_company_block", f"""
SELECT url, coalesce(legal_name, company_name) AS legal_name, regexp_extract(url, '//([^/]*)', 1) AS domain, nif,
  CASE WHEN registry_verified THEN {o.q(lx.REPORT_REGISTRY_LABELS[True])}
    WHEN NOT registry_verified THEN {o.q(lx.REPORT_REGISTRY_LABELS[False])}
    ELSE {o.q(lx.REPORT_REGISTRY_LABELS[None])} END AS registry,
  CASE WHEN note IS NULL THEN NULL WHEN NOT registry_verified THEN 'warning' ELSE 'plain' END AS note_kind,
  nullif(nameservers, '') AS nameservers
FROM clean_companies WHERE url IS NOT NULL""")
def g5(spark, sf):
    fields = company.record_fields(corpus.resolutions(spark, sf))
    return fields.selectExpr("url", f"{reporting.company_block('url')} AS b").where(
        "b IS NOT NULL").selectExpr(
        "url", "b.legal_name", "b.domain", "b.nif", "b.registry", "b.note_kind", "b.nameservers")


# -- lifecycles ----------------------------------------------------------------------------------
def _lifecycle_events(spark, sf):
    kind = F.col("event_type")
    return read_table(spark, sf, "events").select(
        F.expr("event_id DIV 3").alias("scan_run_id"),
        F.expr("event_id DIV 3").alias("website_id"),
        F.when(kind == "error", "Failed").when(kind == "purchase", "Completed")
        .otherwise("Running").alias("status"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))


o.BLOCKS["run_events"] = """
SELECT event_id // 3 AS scan_run_id, date_trunc('second', ts) AS event_at,
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Completed' ELSE 'Running' END AS status FROM events"""
_STATES = """
SELECT scan_run_id, scan_run_id AS website_id, min(event_at) AS started_at,
  arg_max(status, (event_at, status <> 'Running', status)) AS status,
  max(event_at) FILTER (status <> 'Running') AS finished_at FROM run_events GROUP BY scan_run_id"""


@query("t2_scan_lifecycle", _STATES)
def t2(spark, sf):
    return lifecycle.run_states(_lifecycle_events(spark, sf))


@query("t2_scan_lifecycle_stream", _STATES)
def t2_stream(spark, sf):
    source, progress, table = (_scratch(spark, n) for n in ("events", "progress", "states"))
    _lifecycle_events(spark, sf).repartition(3).write.parquet(source)
    events = spark.readStream.schema(lifecycle.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    lifecycle.start_lifecycle(events, table, progress).awaitTermination()
    return lifecycle.stored_states(spark, table)


@query("t2_stuck_runs", f"""
SELECT scan_run_id, started_at FROM ({_STATES}) WHERE status = 'Running'
AND started_at + INTERVAL 6 HOUR < (SELECT max(event_at) FROM run_events)""")
def t2_stuck(spark, sf):
    states = lifecycle.run_states(_lifecycle_events(spark, sf))
    now = _lifecycle_events(spark, sf).agg(F.max("at")).first()[0]
    return lifecycle.stuck_runs(states, now, "6 HOURS").select("scan_run_id", "started_at")


@query("t2_stuck_runs_stream", f"""
SELECT scan_run_id, started_at FROM ({_STATES}) WHERE status = 'Running'
AND started_at + INTERVAL 6 HOUR < (SELECT max(event_at) FROM run_events)""")
def t2_stuck_stream(spark, sf):
    source, progress, out = (_scratch(spark, n) for n in ("events", "progress", "stuck"))
    events = _lifecycle_events(spark, sf)
    events.repartition(3).write.parquet(source)
    # An event of no run moves the watermark to the newest event, where the batch query stands.
    events.agg(F.max("at").alias("at")).select(
        F.lit(-1).cast("bigint").alias("scan_run_id"), F.lit(-1).cast("bigint").alias("website_id"),
        F.lit("Completed").alias("status"), F.expr("at + INTERVAL 60 DAY").alias("at")
    ).write.mode("append").parquet(source)
    lifecycle.start_stuck_report(
        spark.readStream.schema(lifecycle.EVENTS).option("maxFilesPerTrigger", 2).parquet(source),
        out, progress, "6 hours", "60 days", spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema(lifecycle.STUCK).parquet(out)


_SPANS = """
SELECT website_id, rule_id, min(started_at) AS first_seen, max(started_at) AS last_seen, count(*) AS times_seen,
  bool_or(is_last) AS is_open FROM stored s JOIN (
  SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC, scan_run_id DESC) = 1 AS is_last
  FROM runs WHERE status = 'Completed') r USING (scan_run_id) GROUP BY ALL"""


@query("t3_finding_spans", _SPANS)
def t3(spark, sf):
    return sq.finding_spans(corpus.findings(spark, sf), corpus.scan_runs(spark, sf))


@query("t3_finding_spans_stream", _SPANS)
def t3_stream(spark, sf):
    source, progress, out = (_scratch(spark, n) for n in ("scans", "progress", "spans"))
    scans = spans.published_scans(corpus.findings(spark, sf), corpus.scan_runs(spark, sf))
    scans.repartition(3).write.parquet(source)
    scans.limit(0).unionByName(spark.sql(  # a scan of no website, to close the last period
        "SELECT -1L AS scan_run_id, CAST(NULL AS bigint) AS website_id, timestamp'2100-01-01' AS started_at, "
        "CAST(array() AS array<string>) AS rule_ids")).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spans.SCANS).option("maxFilesPerTrigger", 2).parquet(source)
    spans.start_spans(stream, out, progress, "7 days", "60 days",
                      spark.sparkContext.defaultParallelism).awaitTermination()
    return spans.spans(spark.read.parquet(out))
