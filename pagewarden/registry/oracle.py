"""Checking SQL, written relationally and independently of the array code.

``BLOCKS`` are common table expressions over the given tables; ``sql`` puts the
needed ones, in order, in front of a statement.
"""

import re

from pagewarden import lexicon as lx
from pagewarden.sources import corpus as cp


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def rows(items) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in item) + ")" for item in items)


def contains_any(col, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in phrases) + ")"


TOKEN = ("(?is)<!--.*?-->|<script\\b(?:\"[^\"]*\"|[^\">])*>.*?</script>"
         "|<style\\b[^>]*>.*?</style>|</?[a-z](?:\"[^\"]*\"|[^\">])*>|<![^>]*>|[^<]+|<")

_CATEGORY = ("CASE WHEN lower({0}) LIKE '%analytics%' OR lower({0}) LIKE '%gtag/js%' THEN 'analytics' "
             "WHEN lower({0}) LIKE '%doubleclick%' OR lower({0}) LIKE '%ads%' THEN 'advertising' "
             "WHEN lower({0}) LIKE '%facebook%' OR lower({0}) LIKE '%twitter%' "
             "OR lower({0}) LIKE '%linkedin%' THEN 'social' ELSE 'other' END")


def category(col):
    return _CATEGORY.format(col)


def resolved(href):
    """Links of the corpus have no dot segments."""
    return (f"CASE WHEN {href} LIKE '//%' THEN scheme || ':' || {href} "
            f"WHEN {href} LIKE '/%' THEN scheme || '://' || host || {href} ELSE {href} END")


HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"


def host(col):
    return HOST.format(col)


def decoded(col):
    """The four references of the pages; cut-off titles lack the semicolon."""
    col = f"regexp_replace({col}, '&amp([^A-Za-z0-9;]|$)', '&\\1', 'g')"
    return (f"replace(replace(replace(replace({col}, '&middot;', '·'), '&copy;', '©'), "
            "'&quot;', '\"'), '&amp;', '&')")


FLAGS = lx.POLICY_ELEMENTS
_STOPS = rows((lang, w) for lang, ws in lx.STOP_WORDS.items() for w in ws)
_DICT = rows((lang, key, p) for lang, d in lx.POLICY_PHRASES.items()
             for key, ps in d.items() for p in ps)


def voted(source, key, text):
    """CTE body: language of every text by stop-word vote."""
    return f"""
SELECT s.{key}, CASE WHEN length(regexp_replace(any_value(s.{text}), '^\\s+|\\s+$', '', 'g')) < 50
                     THEN 'unknown' ELSE coalesce(any_value(b.lang), 'unknown') END AS language
FROM {source} s LEFT JOIN (
  SELECT k, arg_min(lang, (-n, lang)) AS lang FROM (
    SELECT k, lang, count(*) AS n FROM (
      SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '\\p{{L}}+')) AS w FROM {source}) x
    JOIN stops ON stops.word = x.w GROUP BY k, lang) GROUP BY k) b ON b.k = s.{key}
GROUP BY s.{key}"""


BLOCKS = {
    "c_pages": cp.PAGES_SQL.format(pages="pages"),
    "stops": f"SELECT * FROM (VALUES {_STOPS}) AS v(lang, word)",
    "dict": f"SELECT * FROM (VALUES {_DICT}) AS v(lang, flag, phrase)",
    "rules": "SELECT * FROM (VALUES " + rows(lx.RULES) + ") AS v(" + ", ".join(
        '"' + f + '"' for f in lx.RULE_FIELDS) + ")",
    "c_cookies": f"""
SELECT p.page_id, v.idx, v.name, CASE WHEN v.domain = '' THEN p.host ELSE v.domain END AS domain,
       v.path, v.secure, v.http_only, v.same_site
FROM c_pages p JOIN (VALUES {rows(cp.COOKIES)})
     AS v(idx, name, domain, path, secure, http_only, same_site)
  ON (p.page_id + v.idx * v.idx) % 5 < 2 WHERE p.status = 200""",
    "cookies": """
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS pos,
       (name IN ('_ga_AB12', '_fbp', 'from_page') OR domain LIKE '%.google.com') AS tracking
FROM c_cookies""",
    "c_legal": f"""
SELECT h.scheme, h.host, v.k, concat(h.scheme, '://', h.host, v.path) AS url, v.path,
       CASE WHEN (length(h.host) + v.k) % 6 = 0 THEN 403 ELSE 200 END AS status,
       concat('<html><body><p>', v.body, '</p>',
         CASE WHEN (length(h.host) + v.k) % 3 = 0 THEN {q(cp.ACCESS_TEXT)} ELSE '' END,
         CASE WHEN (length(h.host) + v.k) % 4 = 1 THEN {q(cp.RETENTION_TEXT)} ELSE '' END,
         v.links, '</body></html>') AS html
FROM (SELECT DISTINCT scheme, host FROM c_pages) h
CROSS JOIN (VALUES {rows(cp.LEGAL_PAGES)}) AS v(k, path, body, links)""",
    "tok": f"""
SELECT page_id, url, scheme, host, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS pos
FROM (SELECT page_id, url, scheme, host, regexp_extract_all(html, $re${TOKEN}$re$) AS toks
      FROM c_pages WHERE status = 200)""",
    "kinds": """
SELECT *, CASE WHEN t NOT LIKE '<%' OR t = '<' THEN 'text' WHEN t LIKE '<!--%' THEN 'comment'
  WHEN regexp_matches(t, '(?is)^<(script|style)\\b.*</(script|style)>$') THEN 'script_body'
  WHEN t LIKE '</%' THEN 'close' WHEN regexp_matches(t, '(?i)^<[a-z]') THEN 'open'
  ELSE 'declaration' END AS kind,
  lower(regexp_extract(t, '(?i)^</?([a-z][^\\s/>]*)', 1)) AS tag FROM tok""",
    "scripts": """
SELECT page_id, url, scheme, host, pos, regexp_extract(t, '(?i)^<script[^>]*src="([^"]*)"', 1) AS src,
       regexp_replace(regexp_replace(t, '(?is)^<script[^>]*>', ''), '(?is)</script>$', '') AS body
FROM tok WHERE t ILIKE '<script%'""",
    "third": f"""
SELECT page_id, src, cat, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx FROM (
  SELECT page_id, pos, r AS src, {category('r')} AS cat FROM (
    SELECT *, {resolved('src')} AS r FROM scripts WHERE src <> '')
  WHERE {host('r')} <> '' AND {host('r')} <> host
  UNION ALL
  SELECT page_id, pos, 'inline:tracking', 'analytics' FROM scripts
  WHERE src = '' AND {contains_any('lower(body)', lx.INLINE_TRACKER_MARKERS)})""",
    "links": f"""
SELECT page_id, url, scheme, host, i, m[1] AS href, lower(trim(m[2])) AS text FROM (
  SELECT page_id, url, scheme, host, generate_subscripts(a, 1) AS i,
         regexp_extract(unnest(a), '(?is)<a href="([^"]*)">(.*?)</a>', ['1', '2']) AS s,
         [s['1'], s['2']] AS m
  FROM (SELECT *, regexp_extract_all(html, '(?is)<a href="[^"]*">.*?</a>') AS a
        FROM c_pages WHERE status = 200))""",
    "policy_url": f"""
SELECT page_id, arg_min({resolved('href')}, i) AS policy_url FROM links
WHERE {contains_any('text', lx.POLICY_LINK_PHRASES)} GROUP BY page_id""",
    "forms": """
SELECT page_id, 1 AS k, scheme || '://' || host || '/submit' AS action, 'POST' AS method,
       'email|q|msg' AS fields, false AS notice FROM c_pages WHERE status = 200 AND page_id % 3 = 1
UNION ALL
SELECT page_id, 2, 'https://forms.example.org/p', 'GET', 'username', true
FROM c_pages WHERE status = 200 AND page_id % 4 = 3""",
    "form": "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS form_no FROM forms",
    "banner": f"""
SELECT p.page_id, coalesce(bool_or({contains_any('lower(t)', lx.BANNER_PHRASES)}
   AND (kind IN ('text', 'comment', 'script_body', 'declaration'))), false) AS by_text,
   coalesce(bool_or(kind = 'open' AND tag IN ('div', 'section', 'aside')
   AND regexp_matches(lower(t), '(id|class)="[^"]*({'|'.join(lx.BANNER_MARKERS)})')), false) AS by_element
FROM c_pages p LEFT JOIN kinds USING (page_id) WHERE p.status = 200 GROUP BY p.page_id""",
    "page_text": f"""
SELECT page_id, trim(regexp_replace({decoded("string_agg(t, ' ' ORDER BY pos)")}, '\\s+', ' ', 'g')) AS text
FROM kinds WHERE kind = 'text' GROUP BY page_id""",
    "page_lang": voted("page_text", "page_id", "text"),
    "good": """
SELECT p.page_id, p.url, p.scheme, p.host, u.policy_url FROM c_pages p
LEFT JOIN policy_url u USING (page_id)
WHERE p.status = 200 AND (u.policy_url IS NULL OR u.policy_url LIKE 'http%')""",
    "legal_text": """
SELECT url, scheme, host, k, trim(regexp_replace(string_agg(t, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text
FROM (SELECT url, scheme, host, k, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS t,
        generate_subscripts(regexp_extract_all(html, '<[^>]*>|[^<]+'), 1) AS pos
      FROM c_legal WHERE status = 200) WHERE t NOT LIKE '<%' GROUP BY url, scheme, host, k""",
    "legal_lang": voted("legal_text", "url", "text"),
    "legal_flags": """
SELECT t.url, t.scheme, t.host, t.k, d.flag, bool_or(contains(lower(t.text), d.phrase) AND (
    d.lang = l.language OR l.language NOT IN ('pt', 'en'))) AS hit
FROM legal_text t JOIN legal_lang l USING (url) CROSS JOIN dict d GROUP BY ALL""",
    "policy_text": f"""
SELECT url, concat(scheme, '://', host) AS site, k, text FROM legal_text
UNION ALL SELECT concat('doc:', CAST(doc_id AS VARCHAR)), source, doc_id, concat(coalesce(text, ''), '. ', phrase)
FROM documents JOIN (VALUES {rows(enumerate(cp.DOCUMENT_PHRASES))}) AS v(n, phrase)
  ON doc_id % {len(cp.DOCUMENT_PHRASES)} = v.n""",
    "policy_lang": voted("policy_text", "url", "text"),
    "policy_flags": """
SELECT t.url, t.site, t.k, d.flag, bool_or(contains(lower(t.text), d.phrase) AND (
    d.lang = l.language OR l.language NOT IN ('pt', 'en'))) AS hit
FROM policy_text t JOIN policy_lang l USING (url) CROSS JOIN dict d GROUP BY ALL""",
    "walk_ok": "SELECT scheme, host, " + ", ".join(
        f"(length(host) + {k}) % 6 <> 0 AS ok{k}" for k in range(5)
    ) + " FROM (SELECT DISTINCT scheme, host FROM c_pages)",
    # Reading order of the five legal pages, derived by hand from their links.
    "walks": """
SELECT start, scheme || '://' || host || p AS url, ord FROM (
  SELECT start, scheme, host, unnest(ps) AS p, generate_subscripts(ps, 1) AS ord FROM (
    SELECT scheme || '://' || host || '/privacy' AS start, scheme, host,
      CASE WHEN NOT ok0 THEN [] ELSE list_filter(['/privacy', CASE WHEN ok1 THEN '/contact' END,
        CASE WHEN ok2 THEN '/cookies' END,
        CASE WHEN ok1 THEN (CASE WHEN ok3 THEN '/gdpr' END) WHEN ok2 AND ok4 THEN '/terms' END,
        CASE WHEN NOT (ok2 AND ok4) THEN NULL WHEN ok1 THEN '/terms' WHEN ok3 THEN '/gdpr' END],
        lambda x: x IS NOT NULL) END AS ps FROM walk_ok
    UNION ALL
    SELECT scheme || '://' || host || '/terms', scheme, host,
      CASE WHEN NOT ok4 THEN [] WHEN ok3 THEN ['/terms', '/gdpr'] ELSE ['/terms'] END FROM walk_ok))""",
    "reads": """
SELECT g.page_id, g.policy_url, count(w.url) AS pages_read,
       coalesce(string_agg(w.url, '|' ORDER BY w.ord), '') AS pages
FROM good g LEFT JOIN walks w ON w.start = g.policy_url GROUP BY ALL""",
    "site_flags": """
SELECT g.page_id, f.flag, bool_or(f.hit) AS hit, arg_min(f.url, w.ord) FILTER (f.hit) AS evidence
FROM good g JOIN walks w ON w.start = g.policy_url JOIN legal_flags f ON f.url = w.url GROUP BY ALL""",
    "tracked": """
SELECT g.page_id, coalesce(bool_or(c.tracking), false) AS tracking FROM good g
LEFT JOIN cookies c USING (page_id) GROUP BY g.page_id""",
    "found": """
SELECT page_id, rule_id, ord, sub, evidence FROM (
  SELECT t.page_id, 'R01' AS rule_id, 1 AS ord, 0 AS sub, NULL AS evidence FROM tracked t
    JOIN banner b USING (page_id) WHERE t.tracking AND NOT (b.by_text OR b.by_element)
  UNION ALL SELECT t.page_id, 'R02', 2, 0, NULL FROM tracked t
    JOIN banner b USING (page_id) WHERE t.tracking AND NOT (b.by_text OR b.by_element)
  UNION ALL SELECT page_id, 'R03', 3, idx, src FROM third JOIN good USING (page_id)
    WHERE src LIKE '%google-analytics%' OR src LIKE '%gtag/js%'
  UNION ALL SELECT page_id, 'R04', 4, 0, string_agg(name, '|' ORDER BY idx) FROM cookies
    JOIN good USING (page_id) WHERE NOT secure OR NOT http_only GROUP BY page_id
  UNION ALL SELECT page_id, 'R05', 5, 0, NULL FROM good WHERE policy_url IS NULL
  UNION ALL SELECT r.page_id, m.rule_id, m.ord, 0, m.shown FROM reads r
    CROSS JOIN (VALUES ('right_access', 'R06', 6, 'right_access'),
      ('right_erasure', 'R07', 7, 'right_erasure'),
      ('international_transfers', 'R08', 8, 'international_transfers'),
      ('dpo_contact', 'R09', 9, 'mentions_dpo'),
      ('retention_period', 'R10', 10, 'retention_period')) AS m(flag, rule_id, ord, shown)
    LEFT JOIN site_flags f ON f.page_id = r.page_id AND f.flag = m.flag
    WHERE r.pages_read > 0 AND NOT coalesce(f.hit, false)
  UNION ALL SELECT page_id, 'R12', 12, 0, policy_url FROM reads
    WHERE policy_url IS NOT NULL AND pages_read = 0
  UNION ALL SELECT page_id, 'R11', 13, 0, string_agg(action || ':' || fields, ';' ORDER BY form_no)
    FROM form JOIN good USING (page_id) WHERE NOT notice GROUP BY page_id)""",
    "findings_d": """
SELECT f.*, r.severity, r.description, r.recommendation,
  CASE r.severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank
FROM found f JOIN rules r ON r.id = f.rule_id""",
    # store
    "websites": """
SELECT DISTINCT user_id AS website_id, concat('https://site', CAST(user_id AS VARCHAR), '.example.org/') AS url,
  concat('site', CAST(user_id AS VARCHAR), '.example.org') AS domain FROM events""",
    "runs": """
SELECT event_id AS scan_run_id, user_id AS website_id, date_trunc('second', ts) AS started_at,
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'Running' ELSE 'Completed' END AS status,
  CASE WHEN event_type = 'error' THEN concat('HTTP ', CAST(500 + event_id % 4 AS VARCHAR)) END AS error_message
FROM events""",
    "stored": f"""
SELECT r.scan_run_id, v.rule_id, 'Open' AS status FROM runs r
JOIN (VALUES {rows((k, r) for k, r in enumerate(cp.STORED_RULES, 1))}) AS v(k, rule_id)
  ON (r.scan_run_id + v.k) % 7 = 0 WHERE r.status = 'Completed' AND r.scan_run_id % 5 <> 0""",
    "companies": """
SELECT c.c_custkey AS company_id, c.c_name AS company_name,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'not available' ELSE concat(c.c_name, ', S.A.') END AS legal_name,
  CASE WHEN c.c_custkey % 10 = 9 THEN ' Not Available '
       ELSE concat('https://site', CAST(c.c_custkey AS VARCHAR), '.example.org/') END AS url,
  CASE c.c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'not available' END AS confidence,
  CASE WHEN c.c_custkey % 6 = 5 THEN 'not available' ELSE CAST(500000000 + c.c_custkey AS VARCHAR) END AS nif,
  n.n_name AS address, CASE c.c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS registry_verified,
  CASE c.c_custkey % 7 WHEN 0 THEN 'check by hand' WHEN 1 THEN ' ' END AS note,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'not available' ELSE 'a.ns.example,b.ns.example' END AS nameservers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
}


def clean(col):
    return f"CASE WHEN lower(trim({col})) IN ('', 'not available') THEN NULL ELSE {col} END"


BLOCKS["clean_companies"] = f"""
SELECT company_id, {clean('url')} AS url, {clean('company_name')} AS company_name,
  {clean('legal_name')} AS legal_name, {clean('nif')} AS nif, {clean('address')} AS address,
  registry_verified, {clean('note')} AS note,
  CASE WHEN nameservers = 'not available' THEN '' ELSE nameservers END AS nameservers,
  lower({clean('confidence')}) AS confidence
FROM companies"""
BLOCKS["site_companies"] = """
SELECT w.website_id, c.* FROM clean_companies c JOIN websites w ON w.url = c.url"""


def _ordered(names):
    result = []

    def visit(name):
        if name in result:
            return
        for dep in BLOCKS:
            if dep != name and re.search(rf"\b(?:FROM|JOIN)\s+{dep}\b", BLOCKS[name]):
                visit(dep)
        result.append(name)

    for name in names:
        visit(name)
    return result


def sql(statement: str) -> str:
    """The statement with every block it needs in front."""
    direct = [n for n in BLOCKS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", statement)]
    blocks = _ordered(direct)
    if not blocks:
        return statement
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n].strip()})" for n in blocks)
    return f"WITH {ctes}\n{statement}"
