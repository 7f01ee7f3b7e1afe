"""Cookie operators.  Cookies stay in the array of their page row."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon, schemas
from pagewarden.functions import text as tx


def from_json_text(raw: str) -> str:
    """Raw observed cookies (a JSON list) to typed cookies with defaults."""
    return with_defaults(f"from_json({raw}, 'array<{schemas.COOKIE}>')")


def with_defaults(cookies: str) -> str:
    c = tx.fresh("c")
    typed = (
        f"transform({cookies}, {c} -> named_struct("
        f"'name', coalesce({c}.name, ''), 'domain', coalesce({c}.domain, ''), "
        f"'path', coalesce({c}.path, '/'), 'secure', coalesce({c}.secure, false), "
        f"'httpOnly', coalesce({c}.httpOnly, false), 'sameSite', {c}.sameSite))"
    )
    return f"coalesce({typed}, CAST(array() AS array<{schemas.COOKIE}>))"


def is_tracking(cookie: str) -> str:
    name = tx.let(
        f"lower({cookie}.name)",
        lambda n: " OR ".join(
            f"startswith({n}, '{p}')" for p in lexicon.TRACKING_COOKIE_PREFIXES),
    )
    domain = tx.let(
        f"lower({cookie}.domain)",
        lambda d: " OR ".join(
            f"endswith({d}, '{x}')" for x in lexicon.TRACKING_COOKIE_DOMAINS),
    )
    return f"({name} OR {domain})"


def cookie_class(cookie: str) -> str:
    return (f"CASE WHEN {is_tracking(cookie)} THEN '{lexicon.COOKIE_TRACKING}' "
            f"ELSE '{lexicon.COOKIE_OTHER}' END")


def with_classes(cookies: str) -> str:
    """Typed cookies with their class in front."""
    c = tx.fresh("c")
    return (f"transform({with_defaults(cookies)}, {c} -> named_struct("
            f"'class', {cookie_class(c)}, 'cookie', {c}))")


def of_class(classed: str, label: str) -> str:
    c, d = tx.fresh("c"), tx.fresh("d")
    return (f"transform(filter({classed}, {c} -> {c}.class = '{label}'), "
            f"{d} -> {d}.cookie)")


def insecure_names(cookies: str) -> str:
    c, d = tx.fresh("c"), tx.fresh("d")
    return (f"transform(filter({cookies}, {c} -> NOT {c}.secure OR NOT {c}.httpOnly), "
            f"{d} -> {d}.name)")


def numbered(cookies: str) -> str:
    c, i = tx.fresh("c"), tx.fresh("i")
    return (f"transform({cookies}, ({c}, {i}) -> named_struct('position', {i} + 1, "
            f"'name', {c}.name, 'domain', {c}.domain))")


def observations(pages: DataFrame) -> DataFrame:
    """One row per observed cookie, defaults applied."""
    return pages.select(
        "page_id", "url", F.posexplode(F.expr(with_defaults("cookies"))).alias("idx", "c")
    ).select("page_id", "url", "idx", "c.*")


def classified(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", F.posexplode(F.expr(with_classes("cookies"))).alias("idx", "c")
    ).select("page_id", "idx", "c.cookie.name", "c.cookie.domain", "c.class")


def _classed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr(with_classes("cookies")).alias("classed"))


def buckets(pages: DataFrame) -> DataFrame:
    """Exactly two buckets per page, both always present, input order kept."""
    bucket = lambda label: (
        f"named_struct('class', '{label}', 'cookies', {of_class('classed', label)})")
    return _classed(pages).select("page_id", F.expr(
        f"inline(array({bucket(lexicon.COOKIE_TRACKING)}, {bucket(lexicon.COOKIE_OTHER)}))"
    ))


def summary(pages: DataFrame) -> DataFrame:
    """Totals and the numbered list of tracking cookies per page."""
    return _classed(pages).selectExpr(
        "page_id", "size(classed) AS total_cookies",
        f"{of_class('classed', lexicon.COOKIE_TRACKING)} AS tracked",
    ).selectExpr(
        "page_id", "total_cookies", "size(tracked) AS tracking_count",
        f"{numbered('tracked')} AS tracking_list",
    )


def tracking_flags(pages: DataFrame) -> DataFrame:
    """Whether a page sets any tracking cookie; false without cookies."""
    return _classed(pages).selectExpr(
        "page_id", f"exists(classed, c -> c.class = '{lexicon.COOKIE_TRACKING}') "
        "AS has_tracking",
    )


def insecure(pages: DataFrame) -> DataFrame:
    """Names of cookies lacking Secure or HttpOnly, in input order."""
    return pages.selectExpr("page_id", f"{with_defaults('cookies')} AS cookies").selectExpr(
        "page_id", f"{insecure_names('cookies')} AS insecure_cookies"
    )
