"""Queries for sources, URL expressions, page extraction and cookies."""

from pyspark.sql import functions as F

from pagewarden import lexicon as lx
from pagewarden.functions import html as ht, language, text as tx, urls
from pagewarden.operators import cookies as ck, extraction as ex, ngram_language, reporting, rules
from pagewarden.plans import audit
from pagewarden.registry import oracle as o
from pagewarden.sources import catalogue, corpus, sinks
from pagewarden.operators.scale import materialize, run_dir
from pagewarden.sources.tables import read_table, read_texts

Q = {}


def query(name, sql=None):
    def register(fn):
        Q[name] = (fn, o.sql(sql) if sql else None)
        return fn
    return register


def _scratch(spark, name):
    import uuid
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks ----------------------------------------------------------
@query("s1_crawl_scan", """
SELECT page_id, url, status = 200 AS ok, CASE WHEN status <> 200 THEN concat('HTTP ', CAST(status AS VARCHAR)) END AS load_error
FROM c_pages""")
def s1(spark, sf):
    return corpus.site_pages(spark, sf).selectExpr(
        "page_id", "url", f"{ex.REACHABLE} AS ok", f"{ex.LOAD_ERROR} AS load_error")


@query("s2_cookie_scan", """
SELECT page_id, pos AS idx, name, domain, path, secure, http_only, same_site FROM cookies""")
def s2(spark, sf):
    # Raw observations leave out what equals the default.
    raw = corpus.site_pages(spark, sf).selectExpr("page_id", "url", (
        "to_json(transform(cookies, c -> named_struct('name', c.name, 'domain', c.domain, "
        "'path', nullif(c.path, '/'), 'secure', nullif(c.secure, false), "
        "'httpOnly', nullif(c.httpOnly, false), 'sameSite', c.sameSite))) AS raw"))
    typed = raw.selectExpr("page_id", "url", f"{ck.from_json_text('raw')} AS cookies")
    return ck.observations(typed).selectExpr(
        "page_id", "idx", "name", "domain", "path", "secure", "httpOnly AS http_only",
        "sameSite AS same_site")


@query("s3_rule_catalogue", """
SELECT r.id, r.name, r.description, r."check", r.severity, r.article, r.recommendation,
  count(f.scan_run_id) AS stored_findings
FROM rules r LEFT JOIN stored f ON f.rule_id = r.id GROUP BY ALL""")
def s3(spark, sf):
    counts = corpus.findings(spark, sf).groupBy("rule_id").agg(
        F.count("*").alias("stored_findings"))
    return catalogue.rules_frame(spark).join(
        counts, F.col("id") == F.col("rule_id"), "left"
    ).drop("rule_id").withColumn(
        "stored_findings", F.coalesce("stored_findings", F.lit(0).cast("bigint")))


@query("s4_site_list", """
SELECT s.url, CAST(l.status AS BIGINT) AS status, coalesce(l.status = 200, false) AS reachable FROM (
  SELECT DISTINCT concat(scheme, '://', host, '/privacy') AS url FROM c_pages) s
LEFT JOIN c_legal l ON l.url = s.url""")
def s4(spark, sf):
    pages = corpus.site_pages(spark, sf)
    sites = pages.selectExpr(
        f"concat({urls.scheme('url')}, '://', {urls.host('url')}, '/privacy') AS url").distinct()
    crawl = corpus.legal_pages(spark, sf).select("url", "status")
    return sites.join(crawl, "url", "left").select(
        "url", F.col("status").cast("bigint").alias("status"),
        F.expr(f"{ex.REACHABLE} AS reachable"))


RAW_COMPANY = """
SELECT c_custkey AS company_id, CASE c_custkey % 6 WHEN 0 THEN '{"company_name": "  "}'
  WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"company_name": '
  WHEN 3 THEN concat('{"company_name": " ', c_name, ' ", "country": "Portugal"}')
  WHEN 4 THEN concat('{"company_name": "', c_name, '", "legal_name": "', c_name, ', S.A.", "address": "', c_mktsegment, '"}')
  ELSE concat('{"legal_name": "', c_name, '"}') END AS raw FROM customer"""


@query("s5_company_input", f"""
SELECT company_id, CASE WHEN NOT json_valid(raw) THEN 'invalid_json'
  WHEN json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) <> 'OBJECT' THEN 'not_an_object'
  WHEN coalesce(trim(n), '') = '' THEN 'missing_company_name' END AS error,
  nullif(trim(n), '') AS company_name,
  CASE WHEN nullif(trim(n), '') IS NOT NULL THEN json_extract_string(j, '$.legal_name') END AS legal_name,
  CASE WHEN nullif(trim(n), '') IS NOT NULL THEN json_extract_string(j, '$.country') END AS country,
  CASE WHEN nullif(trim(n), '') IS NOT NULL THEN json_extract_string(j, '$.address') END AS address
FROM (SELECT *, json_extract_string(j, '$.company_name') AS n FROM (
  SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS j FROM ({RAW_COMPANY})))""")
def s5(spark, sf):
    from pagewarden.operators import company
    raw = spark.sql(RAW_COMPANY.replace("FROM customer", "FROM {customer}").replace(
        "'{\"", "'{{\"").replace("\"}'", "\"}}'"), customer=read_table(spark, sf, "customer"))
    return company.parse_input(raw).select(
        "company_id", "error", "company_name", "legal_name", "country", "address")


@query("s6_store_tables", """
SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS scan_date, count(*) AS runs,
  count(*) FILTER (status = 'Failed') AS failed, count(DISTINCT website_id) AS sites
FROM runs GROUP BY ALL""")
def s6(spark, sf):
    path = _scratch(spark, "scan_runs")
    runs = corpus.scan_runs(spark, sf).withColumn("scan_date", F.to_date("started_at"))
    sinks.write_table(runs, path, partition_by=("scan_date",))
    stored = sinks.read_table(
        spark, path, "scan_run_id bigint, website_id bigint, started_at timestamp, "
        "status string, error_message string, scan_date date")
    return stored.groupBy(F.col("scan_date").cast("string").alias("scan_date")).agg(
        F.count("*").alias("runs"), F.count_if(F.expr("status = 'Failed'")).alias("failed"),
        F.countDistinct("website_id").alias("sites"))


def _full_audit(spark, sf):
    return audit.run_audit(corpus.site_pages(spark, sf), corpus.legal_pages(spark, sf))


def _page_audit(spark, sf, only=None):
    return audit.page_level_findings(corpus.site_pages(spark, sf), only)


_REPORT_TIME = "to_timestamp(1704067200 + page_id * 60) AT TIME ZONE 'UTC'"


@query("s7_report_history_and_latest", f"""
SELECT replace(host, '.', '_') AS site_slug, count(*) AS stored_reports,
  replace(host, '.', '_') || '_' || strftime({_REPORT_TIME.replace('page_id', 'max(page_id)')}, '%Y%m%d-%H%M%S') AS latest_key
FROM good GROUP BY host""")
def s7(spark, sf):
    path = _scratch(spark, "reports")
    made = materialize(reporting.reports(_full_audit(spark, sf).evaluated), "made")
    sinks.append_reports(made, path)
    sinks.replace_latest(made, path)
    latest = sinks.SnapshotTable(f"{path}/latest", made.schema).read(spark)
    history = spark.read.parquet(f"{path}/history").groupBy("site_slug").agg(
        F.count("*").alias("stored_reports"))
    return history.join(latest.select("site_slug", "report_key"), "site_slug").withColumnRenamed(
        "report_key", "latest_key")


@query("s8_notification_feed", f"""
SELECT page_id, 'website_audit' AS type, rule_id,
  count(*) AS notifications, count(*) AS with_time, count(*) AS same_site FROM found GROUP BY ALL""")
def s8(spark, sf):
    from pagewarden.operators import notify
    path = _scratch(spark, "feed")
    found = materialize(rules.finding_rows(
        _full_audit(spark, sf).evaluated, "page_id", "url", "fetched_at"), "found")
    feed = notify.feed(found, ("page_id", "seq"), "fetched_at")
    sinks.append_notifications(feed, path)
    stored = spark.read.parquet(path)
    mine = found.select("page_id", "seq", "rule_id", F.expr(
        urls.remote_address("url", lx.REMOTE_ADDRESS_LENGTH)).alias("address"))
    return stored.join(mine, ["page_id", "seq"]).groupBy("page_id", "type", "rule_id").agg(
        F.countDistinct("notification_id").alias("notifications"),
        F.count("created_at").alias("with_time"),
        F.count_if(F.expr("remote_address = address")).alias("same_site"))


@query("d9_audit_to_store", f"""
SELECT url, strftime({_REPORT_TIME}, '%Y-%m-%d %H:%M:%S') AS started_at, 'Completed' AS status, NULL AS error_message,
  count(f.rule_id) AS findings, coalesce(string_agg(f.rule_id, '|' ORDER BY f.rule_id), '') AS rules
FROM good LEFT JOIN found f USING (page_id) GROUP BY page_id, url
UNION ALL
SELECT url, strftime({_REPORT_TIME}, '%Y-%m-%d %H:%M:%S'), 'Failed', CASE WHEN status <> 200
  THEN concat('HTTP ', CAST(status AS VARCHAR)) ELSE concat('invalid policy link: ', policy_url) END, 0, ''
FROM c_pages LEFT JOIN policy_url USING (page_id)
WHERE status <> 200 OR (policy_url IS NOT NULL AND policy_url NOT LIKE 'http%')""")
def d9(spark, sf):
    from pagewarden.plans import persist
    kept = persist.persist(_full_audit(spark, sf), persist.empty_store(spark)).store
    found = kept.findings.groupBy("scan_run_id").agg(
        F.count("*").alias("findings"),
        F.array_join(F.array_sort(F.collect_list("rule_id")), "|").alias("rules"))
    return kept.runs.join(kept.websites, "website_id").join(found, "scan_run_id", "left").select(
        "url", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "status",
        "error_message", F.coalesce("findings", F.lit(0).cast("bigint")).alias("findings"),
        F.coalesce("rules", F.lit("")).alias("rules"))


# -- URL expressions --------------------------------------------------------------
def _hrefs(spark, sf):
    """Every link target and script source of the crawl, plus relative forms."""
    e = tx.fresh("e")
    value = f"coalesce({ht.attribute(e, 'href')}, {ht.attribute(e, 'src')})"
    found = (f"filter(transform(filter(elements, {e} -> {e}.name IN ('a', 'script')), "
             f"{e} -> {value}), v -> v <> '')")
    relative = "array('?p=1', '#top', 'rel/x', '../up', './a/../b')"
    return ex.parsed(corpus.site_pages(spark, sf)).where("ok").selectExpr(
        "page_id", "url", "base", f"explode(concat({found}, {relative})) AS href")


_HREFS = """
SELECT page_id, url, scheme, host, href FROM links WHERE href <> ''
UNION ALL SELECT page_id, url, scheme, host, src FROM scripts WHERE src <> ''
UNION ALL SELECT page_id, url, scheme, host, unnest(['?p=1', '#top', 'rel/x', '../up', './a/../b'])
FROM c_pages WHERE status = 200"""
_DIR = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"
_UP = (f"CASE WHEN length({_DIR}) - length(replace({_DIR}, '/', '')) <= 3 THEN {_DIR} "
       f"ELSE regexp_replace({_DIR}, '[^/]+/$', '') END")
_RESOLVED = f"""
SELECT *, CASE href WHEN '?p=1' THEN regexp_replace(url, '[?#].*$', '') || '?p=1'
  WHEN '#top' THEN regexp_replace(url, '#.*$', '') || '#top'
  WHEN 'rel/x' THEN {_DIR} || 'rel/x' WHEN './a/../b' THEN {_DIR} || 'b'
  WHEN '../up' THEN {_UP} || 'up'
  ELSE {o.resolved('href')} END AS resolved FROM ({_HREFS})"""


def _resolved(spark, sf):
    return _hrefs(spark, sf).selectExpr(
        "page_id", "url", "href", f"{urls.resolve_against('base', 'href')} AS resolved")


@query("u1_url_host", f"SELECT page_id, resolved, {o.host('resolved')} AS host FROM ({_RESOLVED})")
def u1(spark, sf):
    return _resolved(spark, sf).selectExpr(
        "page_id", "resolved", f"{urls.host('resolved')} AS host")


@query("u2_resolve_link", f"SELECT page_id, href, resolved FROM ({_RESOLVED})")
def u2(spark, sf):
    return _resolved(spark, sf).select("page_id", "href", "resolved")


@query("u3_display_domain", "SELECT page_id, regexp_replace(host, '^www\\.', '') AS domain FROM c_pages")
def u3(spark, sf):
    return read_table(spark, sf, "pages").selectExpr(
        "page_id", f"{urls.display_domain('url')} AS domain")


@query("u4_site_slug", f"""
SELECT page_id, resolved, replace(coalesce(nullif({o.host('resolved')}, ''), 'site'), '.', '_') AS slug
FROM ({_RESOLVED})""")
def u4(spark, sf):
    return _resolved(spark, sf).selectExpr(
        "page_id", "resolved", f"{urls.site_slug('resolved')} AS slug")


@query("u5_remote_address", f"""
SELECT page_id, resolved, substr(regexp_extract(resolved, '^([a-z]+):', 1) || '://'
  || coalesce(nullif({o.host('resolved')}, ''), 'unknown'), 1, 50) AS remote_address
FROM ({_RESOLVED})""")
def u5(spark, sf):
    return _resolved(spark, sf).selectExpr(
        "page_id", "resolved",
        f"{urls.remote_address('resolved', lx.REMOTE_ADDRESS_LENGTH)} AS remote_address")


@query("u6_website_domain", f"""
SELECT page_id, resolved, coalesce(nullif({o.host('resolved')}, ''), 'unknown') AS domain
FROM ({_RESOLVED})""")
def u6(spark, sf):
    return _resolved(spark, sf).selectExpr(
        "page_id", "resolved", f"{urls.website_domain('resolved')} AS domain")


@query("u7_url_validity", f"""
SELECT page_id, href, CASE WHEN NOT (href LIKE 'http%') THEN concat('invalid URL: ', href) END AS rejection
FROM ({_HREFS})""")
def u7(spark, sf):
    links = _hrefs(spark, sf).select("page_id", F.col("href").alias("url"))
    return ex.target_check(links).withColumnRenamed("url", "href")


# -- page elements ------------------------------------------------------------------
@query("x1_page_tokens", "SELECT page_id, pos, kind, tag, t AS text FROM kinds")
def x1(spark, sf):
    return ex.token_rows(corpus.site_pages(spark, sf))


def _elements(spark, sf):
    return ex.with_elements(corpus.site_pages(spark, sf)).where("ok")


@query("x2_third_party_scripts", "SELECT page_id, idx, src, cat AS category FROM third")
def x2(spark, sf):
    return _elements(spark, sf).selectExpr(
        "page_id", f"posexplode({ex.third_party_scripts('scripts')}) AS (idx, s)"
    ).selectExpr("page_id", "idx", "s.src", "s.category")


@query("x3_inline_trackers", """
SELECT page_id, count(*) AS inline_trackers FROM third WHERE src = 'inline:tracking' GROUP BY page_id""")
def x3(spark, sf):
    found = ex.third_party_scripts("scripts")
    return _elements(spark, sf).selectExpr(
        "page_id", f"size(filter({found}, s -> s.src = '{lx.INLINE_TRACKER_SRC}')) "
        "AS inline_trackers").where("inline_trackers > 0")


@query("x4_script_category", f"""
SELECT page_id, resolved AS src, {o.category('resolved')} AS category FROM ({_RESOLVED})""")
def x4(spark, sf):
    return _resolved(spark, sf).selectExpr(
        "page_id", "resolved AS src", f"{ex.script_category('resolved')} AS category")


def _forms(spark, sf):
    return _elements(spark, sf).selectExpr(
        "page_id", f"posexplode({ex.form_records()}) AS (form_no, f)"
    ).selectExpr("page_id", "form_no", "f.*")


@query("x5_forms", "SELECT page_id, form_no, action, method, fields FROM form")
def x5(spark, sf):
    return _forms(spark, sf).selectExpr(
        "page_id", "form_no", "action", "method", "array_join(fields, '|') AS fields")


@query("x6_nearby_notice", "SELECT page_id, form_no, notice FROM form")
def x6(spark, sf):
    return _forms(spark, sf).selectExpr(
        "page_id", "form_no", "has_nearby_privacy_notice AS notice")


@query("x7_policy_link", """
SELECT p.page_id, u.policy_url FROM c_pages p LEFT JOIN policy_url u USING (page_id) WHERE p.status = 200""")
def x7(spark, sf):
    return _elements(spark, sf).selectExpr(
        "page_id", f"{ex.first_link(lx.POLICY_LINK_PHRASES)} AS policy_url")


@query("x8_related_legal_links", f"""
SELECT page_id, u AS link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM (
  SELECT page_id, u, min(i) AS i FROM (
    SELECT page_id, url, host, i, {o.resolved('href')} AS u FROM links
    WHERE {o.contains_any('text', lx.LEGAL_LINK_PHRASES)})
  WHERE {o.host('u')} = host AND u <> url GROUP BY page_id, u)
QUALIFY n <= 5""")
def x8(spark, sf):
    kept = (f"slice(filter({ex.legal_links()}, u -> u <> url), 1, {lx.MAX_LEGAL_LINKS})")
    return _elements(spark, sf).selectExpr(
        "page_id", f"posexplode({kept}) AS (pos, link)"
    ).selectExpr("page_id", "link", "pos + 1 AS n")


@query("x9_banner_text", "SELECT page_id, by_text FROM banner")
def x9(spark, sf):
    return _elements(spark, sf).selectExpr("page_id", f"{ex.banner_text()} AS by_text")


@query("x10_banner_element", "SELECT page_id, by_element FROM banner")
def x10(spark, sf):
    return _elements(spark, sf).selectExpr("page_id", f"{ex.marked_element()} AS by_element")


@query("x11_consent_banner", "SELECT page_id, by_text OR by_element AS banner FROM banner")
def x11(spark, sf):
    return _elements(spark, sf).selectExpr(
        "page_id", f"{ex.banner_text()} OR {ex.marked_element()} AS banner")


@query("x12_plain_text", "SELECT page_id, text FROM page_text")
def x12(spark, sf):
    return _elements(spark, sf).selectExpr("page_id", "plain_text AS text")


@query("x13_language", o.voted("documents", "doc_id", "text"))
def x13(spark, sf):
    return read_texts(spark, sf, "documents").select("doc_id", "text").selectExpr(
        "doc_id", f"{language.detect('text')} AS language")


# Learnt from three quarters of the documents, judged are all.
@query("x13_language_by_trigrams", r"""
WITH tri_words AS (SELECT doc_id, lang, word, count(*) AS n FROM (
  SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents)
  WHERE word <> '' GROUP BY ALL),
tri_found AS (SELECT doc_id, lang, gram, sum(n) AS n FROM (
  SELECT doc_id, lang, n, substr(' ' || word || ' ', unnest(range(1, length(word) + 1)), 3) AS gram FROM tri_words)
  GROUP BY ALL),
tri_counts AS (SELECT lang, gram, sum(n) AS n FROM tri_found WHERE doc_id % 4 <> 0 AND lang IS NOT NULL GROUP BY ALL),
tri_sizes AS (SELECT lang, CAST(sum(n) + (SELECT count(DISTINCT gram) FROM tri_counts) AS DOUBLE) AS size FROM tri_counts GROUP BY lang),
tri_gains AS (SELECT lang, gram, CAST(floor(1000 * ln(CAST(n + 1 AS DOUBLE) / size)) AS BIGINT)
  - CAST(floor(1000 * ln(1 / size)) AS BIGINT) AS gain FROM tri_counts JOIN tri_sizes USING (lang)),
tri_lengths AS (SELECT doc_id, sum(n) AS n FROM tri_found GROUP BY doc_id),
tri_seen AS (SELECT f.doc_id, g.lang, sum(f.n * g.gain) AS gain FROM tri_found f JOIN tri_gains g USING (gram) GROUP BY ALL),
tri_best AS (SELECT doc_id, s.lang FROM tri_lengths l CROSS JOIN tri_sizes s LEFT JOIN tri_seen USING (doc_id, lang)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY
    coalesce(gain, 0) + l.n * CAST(floor(1000 * ln(1 / size)) AS BIGINT) DESC, s.lang) = 1)
SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 THEN coalesce(lang, 'unknown') ELSE 'unknown' END AS language
FROM (SELECT doc_id, text FROM documents) LEFT JOIN tri_best USING (doc_id)
""")
def x13_trigrams(spark, sf):
    documents = read_texts(spark, sf, "documents").select("doc_id", "text", "lang")
    return ngram_language.judge(documents, ngram_language.train(documents.where("doc_id % 4 <> 0")), "doc_id")


@query("x14_site_record", """
SELECT g.page_id, g.url, g.url AS final_url, l.language,
  (SELECT count(*) FROM cookies c WHERE c.page_id = g.page_id) AS cookies,
  (SELECT count(*) FROM third t WHERE t.page_id = g.page_id) AS scripts,
  (SELECT count(*) FROM form f WHERE f.page_id = g.page_id) AS forms,
  g.policy_url, b.by_text OR b.by_element AS banner
FROM good g JOIN banner b USING (page_id) JOIN page_lang l USING (page_id)""")
def x14(spark, sf):
    return ex.site_records(ex.page_facts(corpus.site_pages(spark, sf))).selectExpr(
        "page_id", "url", "final_url", "language", "size(cookies) AS cookies",
        "size(third_party_scripts) AS scripts", "size(forms) AS forms",
        "privacy_policy_url AS policy_url", "consent_banner_detected AS banner")


@query("x15_record_validity", """
SELECT page_id, url, CASE WHEN status <> 200 THEN concat('HTTP ', CAST(status AS VARCHAR))
  ELSE concat('invalid policy link: ', policy_url) END AS error_message
FROM c_pages LEFT JOIN policy_url USING (page_id)
WHERE status <> 200 OR (policy_url IS NOT NULL AND policy_url NOT LIKE 'http%')""")
def x15(spark, sf):
    facts = ex.page_facts(corpus.site_pages(spark, sf))
    return ex.failed_scans(facts).select("page_id", "url", "error_message")


# -- cookies --------------------------------------------------------------------------
_CLASS = f"CASE WHEN tracking THEN '{lx.COOKIE_TRACKING}' ELSE '{lx.COOKIE_OTHER}' END"


@query("c1_cookie_class", f"SELECT page_id, pos AS idx, name, domain, {_CLASS} AS class FROM cookies")
def c1(spark, sf):
    return ck.classified(corpus.site_pages(spark, sf))


@query("c2_cookie_buckets", f"""
SELECT p.page_id, k.class, coalesce(string_agg(c.name, '|' ORDER BY c.pos), '') AS names
FROM c_pages p CROSS JOIN (VALUES (true, '{lx.COOKIE_TRACKING}'), (false, '{lx.COOKIE_OTHER}')) AS k(tracking, class)
LEFT JOIN cookies c ON c.page_id = p.page_id AND c.tracking = k.tracking GROUP BY ALL""")
def c2(spark, sf):
    return ck.buckets(corpus.site_pages(spark, sf)).selectExpr(
        "page_id", "class", "array_join(transform(cookies, c -> c.name), '|') AS names")


@query("c3_cookie_summary", """
SELECT p.page_id, count(c.name) AS total_cookies, count(c.name) FILTER (c.tracking) AS tracking_count,
  coalesce(string_agg(n || ' ' || c.name || ' ' || c.domain, '|' ORDER BY c.pos) FILTER (c.tracking), '') AS tracking_list
FROM c_pages p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page_id, tracking ORDER BY pos) AS n
  FROM cookies) c USING (page_id) GROUP BY p.page_id""")
def c3(spark, sf):
    return ck.summary(corpus.site_pages(spark, sf)).selectExpr(
        "page_id", "total_cookies", "tracking_count",
        "array_join(transform(tracking_list, t -> concat_ws(' ', t.position, t.name, t.domain)), '|') "
        "AS tracking_list")


@query("c4_has_tracking", """
SELECT p.page_id, coalesce(bool_or(c.tracking), false) AS has_tracking
FROM c_pages p LEFT JOIN cookies c USING (page_id) GROUP BY p.page_id""")
def c4(spark, sf):
    return ck.tracking_flags(corpus.site_pages(spark, sf))


@query("c5_insecure_cookies", """
SELECT p.page_id, coalesce(string_agg(c.name, '|' ORDER BY c.pos), '') AS insecure_cookies
FROM c_pages p LEFT JOIN cookies c ON c.page_id = p.page_id AND (NOT c.secure OR NOT c.http_only)
GROUP BY p.page_id""")
def c5(spark, sf):
    return ck.insecure(corpus.site_pages(spark, sf)).selectExpr(
        "page_id", "array_join(insecure_cookies, '|') AS insecure_cookies")
