"""Queries for policy analysis, rules, reports and the check profile."""

from pyspark.sql import functions as F

from pagewarden import lexicon as lx
from pagewarden.functions import language
from pagewarden.operators import (
    checkprofile as cp, extraction as ex, notify, policy, reporting, rules, walk,
)
from pagewarden.operators.scale import materialize
from pagewarden.plans import audit
from pagewarden.registry import oracle as o
from pagewarden.registry.pages import _page_audit, _scratch
from pagewarden.sources import corpus, sinks

Q = {}
FLAGS = lx.POLICY_ELEMENTS


def query(name, sql=None):
    def register(fn):
        Q[name] = (fn, o.sql(sql) if sql else None)
        return fn
    return register


def _audit(spark, sf):
    return audit.run_audit(corpus.site_pages(spark, sf), corpus.legal_pages(spark, sf))


def _policy_texts(spark, sf):
    """Readable legal pages and all documents, with language and flags; k is the reading order."""
    order = {path: k for k, path, _, _ in corpus.LEGAL_PAGES}
    position = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    legal = ex.with_elements(corpus.legal_pages(spark, sf)).where("ok").select(
        "url", F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("site"),
        position[F.regexp_extract("url", "(/[a-z]+)$", 1)].cast("bigint").alias("k"),
        F.col("plain_text").alias("text"))
    return legal.unionByName(corpus.policy_documents(spark, sf)).selectExpr(
        "url", "site", "k", f"{language.detect('text')} AS language", "lower(text) AS lower_text"
    ).withColumn("flags", F.expr(policy.element_flags("lower_text", "language")))


_PIVOT = ", ".join(f"bool_or(hit) FILTER (flag = '{k}') AS {k}" for k in FLAGS)


# -- policy ------------------------------------------------------------------------
@query("p1_policy_lookup", """
SELECT g.page_id, g.policy_url, coalesce(l.status <> 200, true) AS unreachable
FROM good g LEFT JOIN c_legal l ON l.url = g.policy_url WHERE g.policy_url IS NOT NULL""")
def p1(spark, sf):
    sites = ex.site_records(ex.page_facts(corpus.site_pages(spark, sf)))
    loaded = corpus.legal_pages(spark, sf).selectExpr(
        "url", f"{ex.READABLE} AS ok", "fetched_at", "page_id")
    return walk.policy_lookup(sites, loaded)


@query("p2_required_elements", f"SELECT url, {_PIVOT} FROM policy_flags GROUP BY url")
def p2(spark, sf):
    return _policy_texts(spark, sf).select("url", "flags.*")


_VARIANTS = "(VALUES ('pt-PT'), ('en'), ('fr'), ('unknown'))"


@query("p3_dictionary_choice", f"""
SELECT url, v.language, count(DISTINCT flag) AS flags_found FROM policy_text t CROSS JOIN {_VARIANTS} AS v(language)
LEFT JOIN dict d ON contains(lower(t.text), d.phrase) AND (v.language LIKE d.lang || '%'
  OR NOT (v.language LIKE 'pt%' OR v.language LIKE 'en%')) GROUP BY ALL""")
def p3(spark, sf):
    flags = ", ".join(f"CASE WHEN f.{k} THEN 1 ELSE 0 END" for k in FLAGS)
    return _policy_texts(spark, sf).selectExpr(
        "url", f"{policy.dictionary_hits('lower_text')} AS hits"
    ).selectExpr(
        "url", "hits", "explode(array('pt-PT', 'en', 'fr', 'unknown')) AS language"
    ).selectExpr(
        "url", "language", f"{policy.chosen_flags('hits', 'language')} AS f"
    ).selectExpr(
        "url", "language", f"CAST({flags.replace(', ', ' + ')} AS BIGINT) AS flags_found")


@query("p4_merged_flags", f"""
SELECT site, {_PIVOT} FROM policy_flags GROUP BY ALL""")
def p4(spark, sf):
    return policy.flags_by(_policy_texts(spark, sf), "site")


@query("p5_first_evidence", """
SELECT site, flag, arg_min(url, k) AS evidence_url FROM policy_flags WHERE hit GROUP BY ALL""")
def p5(spark, sf):
    return policy.first_evidence(_policy_texts(spark, sf), "site", "k")


@query("p6_legal_page_walk", "SELECT page_id, policy_url, pages, pages_read FROM reads")
def p6(spark, sf):
    return _audit(spark, sf).evaluated.selectExpr(
        "page_id", "privacy_policy_url AS policy_url", "array_join(pages_analyzed, '|') AS pages",
        "pages_read")


# Page k of a site offers its first five links; queued pages are those in breadth-first order below readable ones.
@query("p6_walk_limits", f"""
SELECT * FROM (WITH RECURSIVE queued AS (
  SELECT c_custkey AS site, 0 AS k, 0 AS level, [0] AS way FROM customer
  UNION ALL
  SELECT site, {corpus.WALK_FAN} * k + i, level + 1, way || [i] FROM queued CROSS JOIN range(1, {lx.MAX_POLICY_PAGES + 1}) r(i)
  WHERE (site * 7 + k * 5) % 6 > 1 AND k < {corpus.WALK_PAGES} AND level < {lx.MAX_POLICY_PAGES}),
reads AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY level, way) AS n FROM queued
  WHERE (site * 7 + k * 5) % 6 > 1 AND k < {corpus.WALK_PAGES})
SELECT site, count(k) AS pages_read, coalesce(string_agg(k::VARCHAR, '|' ORDER BY n), '') AS pages
FROM customer LEFT JOIN reads ON site = c_custkey AND n <= {lx.MAX_POLICY_PAGES}
GROUP BY c_custkey, site HAVING site IS NOT NULL)""")
def p6_limits(spark, sf):
    facts = corpus.linked_sites(spark, sf)
    starts = facts.where("page_id % 100 = 0 AND ok").select(F.col("url").alias("start"))
    pool = walk.legal_pool(facts, starts)
    return walk.policy_walks(starts, pool, stored=False).selectExpr(
        "CAST(regexp_extract(start, '//s([0-9]+)', 1) AS bigint) AS site", "CAST(pages_read AS bigint) AS pages_read",
        "array_join(transform(pages_analyzed, u -> substring_index(u, '/', -1)), '|') AS pages")


@query("p7_policy_unreachable", """
SELECT page_id, policy_url IS NOT NULL AND pages_read = 0 AS policy_unreachable FROM reads""")
def p7(spark, sf):
    return _audit(spark, sf).evaluated.select("page_id", "policy_unreachable")


@query("p8_pages_analyzed", """
SELECT r.page_id, w.ord AS n, w.url, r.pages_read > 1 AS several
FROM reads r JOIN walks w ON w.start = r.policy_url""")
def p8(spark, sf):
    return _audit(spark, sf).evaluated.selectExpr(
        "page_id", "pages_read > 1 AS several", "posexplode(pages_analyzed) AS (pos, url)"
    ).selectExpr("page_id", "pos + 1 AS n", "url", "several")


@query("p9_walk_flags_and_evidence", "SELECT page_id, flag, evidence AS evidence_url FROM site_flags WHERE hit")
def p9(spark, sf):
    return _audit(spark, sf).evaluated.where("evidence_urls IS NOT NULL").selectExpr(
        "page_id", "explode(evidence_urls) AS (flag, evidence_url)")


# -- rules --------------------------------------------------------------------------
def _rule_query(rule_id, name, sql_columns, spark_columns):
    page_level = rule_id not in rules.POLICY_RULES

    def run(spark, sf):
        evaluated = (_page_audit(spark, sf, (rule_id,)) if page_level
                     else _audit(spark, sf).evaluated)
        found = rules.finding_rows(evaluated, "page_id").where(F.col("rule_id") == rule_id)
        return found.selectExpr("page_id", "severity", *spark_columns)

    query(f"{rule_id.lower()}_{name}", f"""
SELECT page_id, severity{''.join(', ' + c for c in sql_columns)} FROM findings_d
WHERE rule_id = '{rule_id}'""")(run)


_json = "get_json_object(evidence, '$.{}')".format
_rule_query("R01", "missing_banner", (), ())
_rule_query("R02", "tracking_before_consent", (), ())
_rule_query("R03", "analytics_scripts", ("evidence AS script",), (f"{_json('script')} AS script",))
_rule_query("R04", "insecure_cookies", ("evidence AS cookies",), (
    f"array_join(from_json({_json('cookies')}, 'array<string>'), '|') AS cookies",))
_rule_query("R05", "missing_policy", (), ())
for _id, _name in (("R06", "right_of_access"), ("R07", "right_to_erasure"),
                   ("R08", "international_transfers"), ("R09", "dpo_contact"),
                   ("R10", "retention_period")):
    _rule_query(_id, _name, ("evidence AS flag", "'false' AS value"),
                (f"{_json('flag')} AS flag", f"{_json('value')} AS value"))
_rule_query("R11", "forms_without_notice", ("evidence AS forms",), (
    f"array_join(transform(from_json({_json('forms')}, "
    "'array<struct<action:string,fields:array<string>>>'), "
    "f -> concat(f.action, ':', array_join(f.fields, '|'))), ';') AS forms",))
_rule_query("R12", "policy_unreachable", ("evidence AS privacy_policy_url",),
            (f"{_json('privacy_policy_url')} AS privacy_policy_url",))


@query("re1_all_rules", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, sub) - 1 AS seq, rule_id,
  severity, description, recommendation FROM findings_d""")
def re1(spark, sf):
    return rules.finding_rows(_audit(spark, sf).evaluated, "page_id").select(
        "page_id", "seq", "rule_id", "severity", "description", "recommendation")


@query("re2_catalogue_coverage", """
SELECT DISTINCT s.rule_id, 'no_rule' AS side FROM stored s
WHERE s.rule_id NOT IN (SELECT id FROM rules)""")
def re2(spark, sf):
    return rules.catalogue_coverage(spark, corpus.findings(spark, sf))


# -- reports -------------------------------------------------------------------------
_COUNTS = ", ".join(
    f"count(f.rule_id) FILTER (f.severity = '{s}') AS {s}" for s in lx.SEVERITY_RANK)


@query("g1_severity_counts", f"""
SELECT g.page_id, {_COUNTS} FROM good g LEFT JOIN findings_d f USING (page_id) GROUP BY g.page_id""")
def g1(spark, sf):
    return reporting.severity_counts(_audit(spark, sf).evaluated)


@query("g2_ordered_findings", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rank, ord, sub) AS n, rule_id,
  CASE severity WHEN 'high' THEN 'Alto' WHEN 'medium' THEN 'Médio' ELSE 'Baixo' END AS label
FROM findings_d""")
def g2(spark, sf):
    return reporting.reports(_audit(spark, sf).evaluated).selectExpr(
        "page_id", "posexplode(findings) AS (pos, f)"
    ).selectExpr("page_id", "pos + 1 AS n", "f.rule_id", "f.label")


_TIME = "to_timestamp(1704067200 + page_id * 60) AT TIME ZONE 'UTC'"


@query("g3_report_id", f"""
SELECT page_id, substr(sha1(concat(url, '-', strftime({_TIME}, '%Y-%m-%dT%H:%M:%S'))), 1, 8) AS report_id
FROM good""")
def g3(spark, sf):
    pages = ex.page_facts(corpus.site_pages(spark, sf))
    return ex.site_records(pages).selectExpr(
        "page_id", f"{reporting.report_id('url', 'fetched_at')} AS report_id")


@query("g4_report_dataset", f"""
SELECT g.page_id, g.url, strftime({_TIME.replace('page_id', 'g.page_id')}, '%d/%m/%Y %H:%M') AS generated_at,
  substr(sha1(concat(g.url, '-', strftime({_TIME.replace('page_id', 'g.page_id')}, '%Y-%m-%dT%H:%M:%S'))), 1, 8) AS report_id,
  {_COUNTS}, coalesce(string_agg(f.rule_id, '|' ORDER BY f.rank, f.ord, f.sub), '') AS ordered_rules,
  (SELECT count(*) FROM cookies c WHERE c.page_id = g.page_id) AS total_cookies,
  (SELECT coalesce(string_agg(c.name, '|' ORDER BY c.pos), '') FROM cookies c
   WHERE c.page_id = g.page_id AND c.tracking) AS tracking_cookies
FROM good g LEFT JOIN findings_d f USING (page_id) GROUP BY g.page_id, g.url""")
def g4(spark, sf):
    return reporting.reports(_audit(spark, sf).evaluated).selectExpr(
        "page_id", "url", "generated_at", "report_id", "high", "medium", "low",
        "array_join(transform(findings, f -> f.rule_id), '|') AS ordered_rules", "total_cookies",
        "array_join(transform(tracking_cookies, c -> c.name), '|') AS tracking_cookies")


@query("g6_no_findings", """
SELECT g.page_id, count(f.rule_id) = 0 AS no_findings
FROM good g LEFT JOIN findings_d f USING (page_id) GROUP BY g.page_id""")
def g6(spark, sf):
    return reporting.reports(_audit(spark, sf).evaluated).select("page_id", "no_findings")


@query("g7_batch_overview", """
SELECT 'sites_completed' AS measure, count(*) AS value FROM good
UNION ALL SELECT 'sites_failed', (SELECT count(*) FROM c_pages) - count(*) FROM good
UNION ALL SELECT 'sites_with_high', count(DISTINCT page_id) FROM findings_d WHERE severity = 'high'
UNION ALL SELECT 'rule_' || rule_id, count(*) FROM findings_d GROUP BY rule_id""")
def g7(spark, sf):
    done = _audit(spark, sf)
    return reporting.batch_overview(done.evaluated, done.failed)


# -- notifications of audit findings ---------------------------------------------------
@query("n3_notification_rows", """
SELECT CAST(1 AS BIGINT) AS client_id, CAST(0 AS BIGINT) AS device_id, substr(scheme || '://' || host, 1, 50) AS remote_address,
  CAST(NULL AS VARCHAR) AS device_name, CAST(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS level,
  url || ' — ' || description AS description, 'website_audit' AS type
FROM findings_d JOIN good USING (page_id)""")
def n3(spark, sf):
    found = rules.finding_rows(_audit(spark, sf).evaluated, "page_id", "url")
    return notify.notifications(found).select(
        "client_id", "device_id", "remote_address", "device_name", "level", "description", "type")


# -- check profile -----------------------------------------------------------------------
def _checked(spark, sf):
    return cp.check_pages(corpus.site_pages(spark, sf))


o.BLOCKS["check_link"] = f"""
SELECT page_id, arg_min({o.resolved('href')}, i) AS privacy_link FROM links
WHERE {o.contains_any('text', lx.CHECK_LINK_PHRASES)} GROUP BY page_id"""
o.BLOCKS["check_banner"] = f"""
SELECT p.page_id, {o.contains_any("lower(coalesce(string_agg(k.t, '' ORDER BY k.pos) FILTER (k.kind = 'text'), ''))", lx.CHECK_BANNER_PHRASES)} AS has_banner_text,
  coalesce(bool_or(k.kind = 'open' AND k.tag IN ('div', 'section', 'aside')
    AND regexp_matches(lower(k.t), '(id|class)="[^"]*({'|'.join(lx.CHECK_BANNER_MARKERS)})')
    OR k.tag = 'script' AND regexp_matches(lower(k.t), '{'|'.join(lx.CHECK_BANNER_SCRIPT_MARKERS)}')), false) AS has_banner_element
FROM c_pages p LEFT JOIN kinds k USING (page_id) WHERE p.status = 200 GROUP BY p.page_id"""
o.BLOCKS["check_scripts"] = f"""
SELECT p.page_id, coalesce(bool_or({o.contains_any('s.src', lx.CHECK_ANALYTICS_SRC)}
    OR {o.contains_any('s.body', lx.CHECK_ANALYTICS_BODY)}), false) AS has_analytics,
  count(s.src) FILTER (s.h <> '' AND s.h <> s.host AND NOT suffix(s.h, '.' || s.host)) AS n,
  coalesce(string_agg(s.src, '|' ORDER BY s.pos) FILTER (s.h <> '' AND s.h <> s.host
    AND NOT suffix(s.h, '.' || s.host)), '') AS list
FROM c_pages p LEFT JOIN (SELECT *, lower(regexp_extract(src, '^(?:[a-z]+:)?//([^/:?#]*)', 1)) AS h
  FROM scripts) s USING (page_id) WHERE p.status = 200 GROUP BY p.page_id"""


@query("v1_check_links_and_banner", """
SELECT b.page_id, l.privacy_link, b.has_banner_text, b.has_banner_element
FROM check_banner b LEFT JOIN check_link l USING (page_id)""")
def v1(spark, sf):
    return _checked(spark, sf).where("reachable").select(
        "page_id", "privacy_link", "has_banner_text", "has_banner_element")


@query("v2_check_analytics", "SELECT page_id, has_analytics FROM check_scripts")
def v2(spark, sf):
    return _checked(spark, sf).where("reachable").select("page_id", "has_analytics")


@query("v3_check_third_party", "SELECT page_id, n AS scripts, list FROM check_scripts")
def v3(spark, sf):
    return _checked(spark, sf).where("reachable").selectExpr(
        "page_id", "third_party_scripts_count AS scripts",
        "array_join(third_party_scripts, '|') AS list")


@query("v4_check_forms", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS form_no, fields, notice FROM (
  SELECT page_id, 1 AS k, 'email' AS fields, false AS notice FROM c_pages WHERE status = 200 AND page_id % 3 = 1
  UNION ALL SELECT page_id, 2, 'username', false FROM c_pages WHERE status = 200 AND page_id % 4 = 3)""")
def v4(spark, sf):
    return _checked(spark, sf).selectExpr(
        "page_id", "posexplode(forms_with_personal_data) AS (form_no, f)"
    ).selectExpr("page_id", "form_no", "array_join(f.fields, '|') AS fields",
                 "f.has_privacy_notice AS notice")


_CHECK_DICT = o.rows((k, p) for k, ps in lx.CHECK_POLICY_PHRASES.items() for p in ps)
o.BLOCKS["check_dict"] = f"SELECT * FROM (VALUES {_CHECK_DICT}) AS v(flag, phrase)"
o.BLOCKS["check_flags"] = """
SELECT t.url, d.flag, bool_or(contains(lower(t.text), d.phrase)) AS hit
FROM legal_text t CROSS JOIN check_dict d GROUP BY ALL"""
_CHECK_PIVOT = ", ".join(
    f"bool_or(f.hit) FILTER (f.flag = '{k}') AS {k}" for k in lx.CHECK_POLICY_PHRASES)


@query("v5_check_policy_flags", f"""
SELECT l.page_id, l.privacy_link, coalesce(bool_or(f.url IS NOT NULL), false) AS policy_read, {_CHECK_PIVOT}
FROM check_link l LEFT JOIN check_flags f ON f.url = l.privacy_link GROUP BY ALL""")
def v5(spark, sf):
    linked = cp.check_pages(corpus.legal_pages(spark, sf))
    return cp.check_policies(_checked(spark, sf), linked).select(
        "page_id", "privacy_link", "policy_read", "policy_flags.*")


@query("v6_profile_agreement", """
SELECT check_name, count(*) FILTER (a AND b) AS both_hit, count(*) FILTER (a AND NOT b) AS only_ours,
  count(*) FILTER (NOT a AND b) AS only_theirs, count(*) FILTER (NOT a AND NOT b) AS neither FROM (
  SELECT 'banner' AS check_name, x.by_text OR x.by_element AS a, y.has_banner_text OR y.has_banner_element AS b
    FROM banner x JOIN check_banner y USING (page_id)
  UNION ALL SELECT 'policy_link', u.policy_url IS NOT NULL, l.privacy_link IS NOT NULL
    FROM banner x LEFT JOIN policy_url u USING (page_id) LEFT JOIN check_link l USING (page_id)
  UNION ALL SELECT 'analytics', coalesce(t.a, false), s.has_analytics FROM check_scripts s
    LEFT JOIN (SELECT page_id, bool_or(cat = 'analytics') AS a FROM third GROUP BY page_id) t USING (page_id)
  UNION ALL SELECT 'third_party', coalesce(t.a, false), s.n > 0 FROM check_scripts s
    LEFT JOIN (SELECT page_id, bool_or(src <> 'inline:tracking') AS a FROM third GROUP BY page_id) t USING (page_id))
GROUP BY check_name""")
def v6(spark, sf):
    facts = ex.page_facts(corpus.site_pages(spark, sf))
    return cp.agreement(cp.own_verdicts(facts), cp.check_verdicts(_checked(spark, sf)))


@query("s9_check_results_json", """
SELECT p.page_id, p.status = 200 AS reachable, s.n AS scripts, l.privacy_link
FROM c_pages p LEFT JOIN check_scripts s USING (page_id) LEFT JOIN check_link l USING (page_id)
WHERE p.status = 200 UNION ALL SELECT page_id, false, 0, NULL FROM c_pages WHERE status <> 200""")
def s9(spark, sf):
    path = _scratch(spark, "checks")
    checked = materialize(_checked(spark, sf), "checked")
    linked = cp.check_pages(corpus.legal_pages(spark, sf))
    results = cp.check_results(checked, cp.check_policies(checked, linked))
    sinks.write_check_results(results, path)
    stored = spark.read.schema(results.schema).json(path)
    return stored.select("page_id", "reachable",
                         F.col("third_party_scripts_count").alias("scripts"), "privacy_link")


# -- streaming -------------------------------------------------------------------------------
@query("t1_streaming_audit", """
SELECT page_id, rule_id, count(*) AS findings FROM findings_d GROUP BY ALL""")
def t1(spark, sf):
    from pagewarden import schemas
    from pagewarden.streaming import audit_stream as stream
    folder, cores = _scratch(spark, "audit-stream"), spark.sparkContext.defaultParallelism
    columns = [part.split()[0] for part in schemas.CRAWL.split(", ")]
    for kind, pages in (("site", corpus.site_pages(spark, sf)), ("legal", corpus.legal_pages(spark, sf))):
        # in no order of time, over several files: two batches, each with work for all cores
        pages.select(*columns).repartition(3 * cores, F.hash("url", "page_id")).write.parquet(f"{folder}/in/{kind}")
        stream.start_facts(stream.crawl_stream(spark, f"{folder}/in/{kind}", max_files=2 * cores),
                           f"{folder}/facts/{kind}", f"{folder}/progress/{kind}", kind == "site").awaitTermination()
    stream.write_heartbeat(spark, f"{folder}/facts/beat", "2100-01-01")
    stream.start_audit(stream.facts_stream(spark, f"{folder}/facts/*", max_files=8 * cores), f"{folder}/out",
                       f"{folder}/progress/audit", partitions=cores,
                       delay="1000 days", period="30 days", reach="1000 days").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("page_id", "rule_id").agg(F.count("*").alias("findings"))
