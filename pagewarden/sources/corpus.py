"""Audit inputs derived from the given tables.

The given pages carry no forms, external scripts, cookies or policy links, so
these are woven into every page from its id.  ``SQL`` texts run unchanged in
Spark and in the checking engine.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden import lexicon, schemas
from pagewarden.sources.tables import read_table, read_texts

PAGES_SQL = """
SELECT page_id, url,
       CASE WHEN page_id % 13 = 12 THEN 503 ELSE 200 END AS status,
       regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
       lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
       replace(html, '<body>', concat('<body>',
         CASE WHEN page_id % 2 = 0 THEN '<div>Este site utiliza cookies.</div>' ELSE '' END,
         CASE WHEN page_id % 7 = 0 THEN '<div id="onetrust-banner-sdk" class="x"></div>' ELSE '' END,
         '<script src="/static/app.js"></script>',
         CASE WHEN page_id % 3 = 0 THEN '<script src="https://www.google-analytics.com/analytics.js"></script>' ELSE '' END,
         CASE WHEN page_id % 5 = 1 THEN '<script async src="//connect.facebook.net/en_US/fbevents.js"></script>' ELSE '' END,
         CASE WHEN page_id % 5 = 2 THEN '<script src="https://ad.doubleclick.net/x.js"></script><script src="https://cdn.example.net/lib.js"></script>' ELSE '' END,
         CASE WHEN page_id % 11 = 3 THEN '<script>gtag("config","G-1");</script>' ELSE '' END,
         CASE WHEN page_id % 3 = 1 THEN '<div><div><div><div><form action="/submit" method="post"><input type="text" name="email"><input type="text" name="q"><textarea name="msg"></textarea></form></div></div></div></div>' ELSE '' END,
         CASE WHEN page_id % 4 = 3 THEN '<section><div><div><form action="https://forms.example.org/p"><input name="username"></form></div><p>Your personal data is safe.</p></div></section>' ELSE '' END,
         CASE WHEN page_id % 17 = 16 THEN '<a href="mailto:privacy@example.org">Privacy</a>' ELSE '' END,
         CASE WHEN page_id % 4 <> 0 THEN '<a href="/privacy">Privacy Policy</a>' ELSE '' END,
         CASE WHEN page_id % 9 = 4 THEN '<a href="/terms">Terms and Conditions</a>' ELSE '' END)) AS html
FROM {pages}
"""

# Cookies of page p: entry i is present when (p + i * i) % 5 < 2.
COOKIES = (
    (0, "_ga_AB12", "", "/", True, False, "Lax"),
    (1, "session_id", "", "/", True, True, "Strict"),
    (2, "_fbp", "", "/", False, False, None),
    (3, "AEC", ".google.com", "/", True, True, "Lax"),
    (4, "from_page", "", "/", True, True, None),
    (5, "pref", "google.com", "/x", False, True, None),
)

# Legal pages of a host: (number, path, text, links).
LEGAL_PAGES = (
    (0, "/privacy",
     "We are the data controller and rely on your consent for the use of this site.",
     '<a href="/contact">Contact us</a><a href="/cookies">Cookies</a><a href="/about">About</a><a href="https://other.example.com/privacy">Privacy</a>'),
    (1, "/contact",
     "Write to our data protection officer at the office on the main street.",
     '<a href="/privacy">Privacy</a><a href="/gdpr">GDPR</a>'),
    (2, "/cookies",
     "The data may go to servers in the United States of America for analysis.",
     '<a href="/terms">Terms</a>'),
    (3, "/gdpr",
     "You may lodge a complaint with the supervisory authority of your country.", ""),
    (4, "/terms",
     "These are the terms of the site and the law of the land applies to them.",
     '<a href="/gdpr">GDPR</a>'),
)
ACCESS_TEXT = "<p>You can ask for access to your data and you have the right to erasure.</p>"
RETENTION_TEXT = "<p>O prazo de conservação dos dados é de 2 anos.</p>"


def _page_cookies():
    entries = F.array(*[
        F.when(
            (F.col("page_id") + i * i) % 5 < 2,
            F.struct(
                F.lit(name).alias("name"),
                (F.col("host") if domain == "" else F.lit(domain)).alias("domain"),
                F.lit(path).alias("path"), F.lit(secure).alias("secure"),
                F.lit(http_only).alias("httpOnly"),
                F.lit(same_site).cast("string").alias("sameSite"),
            ),
        )
        for i, name, domain, path, secure, http_only, same_site in COOKIES
    ])
    return F.when(F.col("status") == 200, F.filter(entries, lambda c: c.isNotNull())
                  ).otherwise(F.array().cast(f"array<{schemas.COOKIE}>"))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_SQL, pages=read_texts(spark, sf_dir, "pages"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages with the cookies seen on them."""
    return _seeded(spark, sf_dir).select(
        "page_id", "url", F.col("url").alias("final_url"), "status", "html",
        F.lit(None).cast("string").alias("error"),
        _page_cookies().alias("cookies"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("fetched_at"),
    )


def legal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five legal pages for every host of the crawl, some of them blocked."""
    # Host names are few and short: spread them before the pages are made.
    hosts = read_table(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^([a-z]+)://', 1) AS scheme",
        "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host",
    ).distinct().repartition(spark.sparkContext.defaultParallelism)
    entries = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(path).alias("path"),
                 F.lit(body).alias("body"), F.lit(links).alias("links"))
        for k, path, body, links in LEGAL_PAGES
    ])
    n = F.length("host") + F.col("k")
    return hosts.select("scheme", "host", F.inline(entries)).select(
        F.lit(None).cast("bigint").alias("page_id"),
        F.concat("scheme", F.lit("://"), "host", "path").alias("url"),
        F.concat("scheme", F.lit("://"), "host", "path").alias("final_url"),
        F.when(n % 6 == 0, 403).otherwise(200).alias("status"),
        F.concat(
            F.lit("<html><body><p>"), "body", F.lit("</p>"),
            F.when(n % 3 == 0, ACCESS_TEXT).otherwise(""),
            F.when(n % 4 == 1, RETENTION_TEXT).otherwise(""),
            "links", F.lit("</body></html>"),
        ).alias("html"),
        F.lit(None).cast("string").alias("error"),
        F.array().cast(f"array<{schemas.COOKIE}>").alias("cookies"),
        F.timestamp_seconds(F.lit(1704067200)).alias("fetched_at"),
    )


# Sites of WALK_PAGES pages, one for each customer: page k links to pages WALK_FAN * k + 1 and on, more than a
# walk follows, and some pages cannot be read.
WALK_PAGES, WALK_FAN = 60, 8


def linked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the pages of those sites, as the walk reads them."""
    links = ", ".join(f"concat(host, CAST({WALK_FAN} * k + {i} AS string))" for i in range(1, WALK_FAN + 1))
    flags = ", ".join(f"'{name}', k % {n + 2} = 0" for n, name in enumerate(lexicon.POLICY_ELEMENTS))
    # Customers are few and short next to their pages: spread them before the pages are made.
    return read_table(spark, sf_dir, "customer").select("c_custkey").repartition(
        spark.sparkContext.defaultParallelism).selectExpr(
        "c_custkey", "concat('https://s', CAST(c_custkey AS string), '.example.org/') AS host").selectExpr(
        "c_custkey", "host", f"explode(sequence(0, {WALK_PAGES - 1})) AS k").selectExpr(
        "concat(host, CAST(k AS string)) AS url", "(c_custkey * 7 + k * 5) % 6 > 1 AS ok",
        f"named_struct({flags}) AS flags", f"array({links}) AS legal_links",
        "timestamp'2024-01-01' AS fetched_at", "c_custkey * 100L + k AS page_id")


# Every phrase of the policy dictionaries, three to a document, in turn.
_PHRASES = [p for keys in lexicon.POLICY_PHRASES.values() for of in keys.values() for p in of]
DOCUMENT_PHRASES = [". ".join(_PHRASES[k:k + 3]) for k in range(0, len(_PHRASES), 3)]


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as policy texts, a few phrases behind each: url, site, k (reading order), text."""
    phrases = F.array(*[F.lit(p) for p in DOCUMENT_PHRASES])
    return read_texts(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("site"), F.col("doc_id").cast("bigint").alias("k"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(". "), F.get(
            phrases, (F.col("doc_id") % len(DOCUMENT_PHRASES)).cast("int"))).alias("text"))


# -- store rows derived from the event table ---------------------------------
def websites(spark, sf_dir) -> DataFrame:
    user = F.col("user_id").cast("string")
    return read_table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.col("user_id").alias("website_id"),
        F.concat(F.lit("https://site"), user, F.lit(".example.org/")).alias("url"),
        F.concat(F.lit("site"), user, F.lit(".example.org")).alias("domain"),
    )


def scan_runs(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scan_run_id"), F.col("user_id").alias("website_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("started_at"),
        F.when(kind == "error", "Failed").when(kind == "view", "Running")
        .otherwise("Completed").alias("status"),
        F.when(kind == "error", F.concat(
            F.lit("HTTP "), (500 + F.col("event_id") % 4).cast("string")
        )).alias("error_message"),
    )


STORED_RULES = tuple(f"R{n:02d}" for n in range(1, 13)) + ("R99",)


def findings(spark, sf_dir) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(rule).alias("rule_id"))
        for k, rule in enumerate(STORED_RULES, 1)
    ])
    return scan_runs(spark, sf_dir).where(
        (F.col("status") == "Completed") & (F.col("scan_run_id") % 5 != 0)
    ).select("scan_run_id", F.inline(entries)).where(
        (F.col("scan_run_id") + F.col("k")) % 7 == 0
    ).select("scan_run_id", "rule_id", F.lit("Open").alias("status"))


def resolutions(spark, sf_dir) -> DataFrame:
    """Company resolution results, one per customer."""
    key = F.col("c_custkey")
    text = key.cast("string")
    missing = F.lit("not available")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return read_table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        key.alias("company_id"), F.col("c_name").alias("company_name"),
        F.when(key % 4 == 0, missing)
        .otherwise(F.concat("c_name", F.lit(", S.A."))).alias("legal_name"),
        F.when(key % 10 == 9, " Not Available ").otherwise(
            F.concat(F.lit("https://site"), text, F.lit(".example.org/"))).alias("url"),
        F.when(key % 4 == 0, "low").when(key % 4 == 1, "medium")
        .when(key % 4 == 2, "high").otherwise(missing).alias("confidence"),
        F.when(key % 6 == 5, missing)
        .otherwise((500000000 + key).cast("string")).alias("nif"),
        F.col("n_name").alias("address"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("registry_verified"),
        F.when(key % 7 == 0, "check by hand").when(key % 7 == 1, " ").alias("note"),
        F.when(key % 5 == 0, missing)
        .otherwise("a.ns.example,b.ns.example").alias("nameservers"),
    )
