"""Page extraction: one tokenisation per page, everything else row-local.

``page_facts`` is the only job that reads html.  It is a narrow projection over
the crawl (no shuffle), and its output is small enough to be joined freely.
"""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import html as ht, language, text as tx, urls
from pagewarden.operators import cookies as ck, policy

REACHABLE = "coalesce(status BETWEEN 200 AND 299, false)"
# Legal and check pages are read up to, not including, client errors.
READABLE = "coalesce(status < 400, false)"
LOAD_ERROR = (
    f"CASE WHEN NOT {REACHABLE} THEN coalesce("
    "concat('HTTP ', CAST(status AS string)), error, 'no response') END"
)


def tokenized(pages: DataFrame) -> DataFrame:
    """Pages with their token array; html itself is dropped here.

    A page that could not be loaded has no content.
    """
    return pages.withColumns({
        "ok": F.expr(REACHABLE),
        "readable": F.expr(READABLE),
        "load_error": F.expr(LOAD_ERROR),
        "host": F.expr(urls.host("url")),
        "base": F.expr(urls.url_parts("url")),
        "tokens": F.expr(
            ht.tokens(f"CASE WHEN {READABLE} THEN coalesce(html, '') ELSE '' END")),
    }).drop("html")


def token_rows(pages: DataFrame) -> DataFrame:
    """One row per token: (page_id, pos, kind, tag, text)."""
    return tokenized(pages).select(
        "page_id", F.posexplode("tokens").alias("pos", "t")
    ).selectExpr(
        "page_id", "pos", f"{ht.token_kind('t')} AS kind",
        f"{ht.tag_name('t')} AS tag", "t AS text",
    )


def parsed(pages: DataFrame, banner_markers=lexicon.BANNER_MARKERS) -> DataFrame:
    """Tokens, texts, tags with attributes, and spans of links and forms."""
    return tokenized(pages).withColumns({
        "texts": F.expr(ht.texts("tokens")),
        "tags": F.expr(ht.tags("tokens")),
    }).withColumns({
        "elements": F.expr(ht.elements("tags", "tokens", banner_markers)),
        "spanned": F.expr(ht.element_spans("tags", "size(tokens)")),
    }).drop("tags")


def _named(*names: str) -> str:
    e = tx.fresh("e")
    return f"filter(elements, {e} -> {tx.in_list(f'{e}.name', names)})"


# -- scripts ------------------------------------------------------------------
def scripts() -> str:
    """Every script as (src, body) in page order; src is ``''`` for inline ones."""
    e = tx.fresh("e")
    return (f"transform({_named('script')}, {e} -> named_struct("
            f"'src', coalesce({ht.attribute(e, 'src')}, ''), "
            f"'body', coalesce({e}.body, '')))")


def script_category(src: str) -> str:
    branches = lambda low: " ".join(
        f"WHEN {tx.contains_any(low, markers)} THEN '{label}'"
        for label, markers in lexicon.SCRIPT_CATEGORIES
    )
    return tx.let(
        f"lower({src})",
        lambda low: f"CASE {branches(low)} ELSE '{lexicon.SCRIPT_CATEGORY_OTHER}' END",
    )


def third_party_scripts(script_array: str) -> str:
    """External scripts on another host and inline trackers, duplicates kept."""
    s, x, y = tx.fresh("s"), tx.fresh("x"), tx.fresh("y")
    inline = tx.let(f"lower({s}.body)",
                    lambda b: tx.contains_any(b, lexicon.INLINE_TRACKER_MARKERS))
    located = (
        f"transform({script_array}, {s} -> CASE "
        f"WHEN {s}.src <> '' THEN {urls.resolve_against('base', f'{s}.src')} "
        f"WHEN {inline} THEN '{lexicon.INLINE_TRACKER_SRC}' END)"
    )
    kept = (f"filter({located}, {x} -> {x} = '{lexicon.INLINE_TRACKER_SRC}' "
            f"OR {urls.host(x)} NOT IN ('', host))")
    return (f"transform({kept}, {y} -> named_struct('src', {y}, 'category', "
            f"CASE WHEN {y} = '{lexicon.INLINE_TRACKER_SRC}' "
            f"THEN '{lexicon.INLINE_TRACKER_CATEGORY}' ELSE {script_category(y)} END))")


# -- banner -------------------------------------------------------------------
def banner_text(phrases=lexicon.BANNER_PHRASES) -> str:
    """A consent phrase inside one string node (comments and scripts included)."""
    t = tx.fresh("t")
    body = ht.raw_body(t)
    string_node = (
        f"({ht.is_text(t)} OR startswith({t}, '<!') OR "
        f"({t} RLIKE '(?i)^<(?:script|style)' AND {tx.matches_any(body, phrases)}))"
    )
    return f"exists(tokens, {t} -> {tx.matches_any(t, phrases)} AND {string_node})"


def marked_element(markers=lexicon.BANNER_MARKERS) -> str:
    """A div/section/aside whose id or class holds one of the markers."""
    e, a = tx.fresh("e"), tx.fresh("a")
    return (f"exists({_named(*lexicon.BANNER_TAGS)}, {e} -> exists({e}.attrs, {a} -> "
            f"{a}.k IN ('id', 'class') AND {tx.contains_any(f'lower({a}.v)', markers)}))")


# -- links and forms ----------------------------------------------------------
def _spans_of(name: str) -> str:
    """Spans of the elements of one name, aligned with ``_named(name)``."""
    x = tx.fresh("x")
    return (f"filter(spanned.spans, {x} -> "
            f"{ht.tag_name(f'get(tokens, {x}.first)')} = '{name}')")


def links() -> str:
    """Links with a target as (href, text); text trimmed and lower-cased."""
    z, x = tx.fresh("z"), tx.fresh("x")
    element, span = f"{z}.`0`", f"{z}.`1`"
    text = ht.joined(ht.between("texts", f"{span}.first", f"{span}.last"), "")
    both = (f"transform(arrays_zip({_named('a')}, {_spans_of('a')}), {z} -> "
            f"named_struct('href', coalesce({ht.attribute(element, 'href')}, ''), "
            f"'text', lower({tx.strip(text)})))")
    return f"filter({both}, {x} -> {x}.href <> '')"


def first_link(phrases) -> str:
    """First link in document order whose text holds a phrase, resolved."""
    x = tx.fresh("x")
    hit = f"get(filter(links, {x} -> {tx.contains_any(f'{x}.text', phrases)}), 0).href"
    return tx.let(
        hit,
        lambda h: f"CASE WHEN {h} IS NOT NULL THEN {urls.resolve_against('base', h)} END",
    )


def legal_links() -> str:
    """Legal links to the same host, first occurrences in document order."""
    x, y, u = tx.fresh("x"), tx.fresh("y"), tx.fresh("u")
    wanted = (f"filter(links, {x} -> "
              f"{tx.contains_any(f'{x}.text', lexicon.LEGAL_LINK_PHRASES)})")
    resolved = f"transform({wanted}, {y} -> {urls.resolve_against('base', f'{y}.href')})"
    return f"array_distinct(filter({resolved}, {u} -> {urls.host(u)} = host))"


def span_text(first: str, separator: str) -> str:
    """Lower-cased text of an element; a negative position is the document."""
    inner = ht.between("texts", first, ht.span_end("spanned.spans", first))
    return (f"lower(array_join(CASE WHEN {first} < 0 THEN texts ELSE {inner} END, "
            f"'{separator}'))")


def forms() -> str:
    """Forms as (form tag, span, ancestors, input and textarea elements)."""
    z, i, e = tx.fresh("z"), tx.fresh("i"), tx.fresh("e")
    inside = lambda names: (
        f"filter(elements, {e} -> {tx.in_list(f'{e}.name', names)} "
        f"AND {e}.pos > {z}.`1`.first AND {e}.pos < {z}.`1`.last)")
    return (f"transform(arrays_zip({_named('form')}, {_spans_of('form')}), "
            f"({z}, {i}) -> named_struct('tag', {z}.`0`, "
            f"'parent', get(spanned.forms, {i}).parent, "
            f"'outer', get(spanned.forms, {i}).outer, "
            f"'inner', {inside(('input', 'textarea'))}))")


def form_records() -> str:
    """Resolved action, method, field names and nearby notice per form.

    Fields are inputs first, then textareas.  The text of an ancestor contains
    the text of everything inside it, so the outermost ancestor within reach
    decides the notice.
    """
    f, e, n = tx.fresh("f"), tx.fresh("e"), tx.fresh("n")
    names = lambda tag: (
        f"filter(transform(filter({f}.inner, {e} -> {e}.name = '{tag}'), "
        f"{e} -> {ht.attribute(e, 'name')}), {n} -> {n} <> '')")
    action = tx.let(
        ht.attribute(f"{f}.tag", "action"),
        lambda a: f"CASE WHEN {a} <> '' THEN {urls.resolve_against('base', a)} ELSE {a} END",
    )
    notice = tx.let(
        span_text(f"{f}.outer", " "),
        lambda t: tx.contains_any(t, lexicon.PRIVACY_NOTICE_PHRASES),
    )
    return (f"transform(forms_found, {f} -> named_struct('action', {action}, "
            f"'method', upper(coalesce(nullif({ht.attribute(f'{f}.tag', 'method')}, ''), 'GET')), "
            f"'fields', concat({names('input')}, {names('textarea')}), "
            f"'has_nearby_privacy_notice', {notice}))")


def with_elements(pages: DataFrame) -> DataFrame:
    """Parsed pages with their scripts, links, forms and plain text."""
    found = {
        "plain_text": tx.collapse_spaces(ht.joined("texts", " ")),
        "scripts": scripts(),
        "links": links(),
        "forms_found": forms(),
    }
    return parsed(pages).withColumns(
        {name: F.expr(tx.fenced(value)) for name, value in found.items()})


# Why a page gives no site record; NULL when it does.
RECORD_ERROR = (
    "coalesce(load_error, CASE WHEN privacy_policy_url IS NOT NULL "
    f"AND NOT {urls.is_valid_url('privacy_policy_url')} "
    "THEN concat('invalid policy link: ', privacy_policy_url) END)"
)


# -- the page record ----------------------------------------------------------
FACT_COLUMNS = (
    "page_id", "fetched_at", "url", "final_url", "status", "ok", "readable", "record_error",
    "language", "cookies", "third_party_scripts", "forms", "privacy_policy_url",
    "consent_banner_detected", "legal_links", "flags",
)

# Columns that come out of page parsing: filters on them must stay above it.
PARSED_COLUMNS = (
    "record_error", "language", "third_party_scripts", "forms", "privacy_policy_url",
    "consent_banner_detected", "legal_links", "flags",
)


def page_facts(pages: DataFrame, extra=()) -> DataFrame:
    """Everything later jobs need to know about a page, without its html."""
    return with_elements(pages).withColumns({
        "lower_text": F.expr("lower(plain_text)"),
        "language": F.expr(language.detect("plain_text")),
        "third_party_scripts": F.expr(third_party_scripts("scripts")),
        "forms": F.expr(form_records()),
        "privacy_policy_url": F.expr(first_link(lexicon.POLICY_LINK_PHRASES)),
        "consent_banner_detected": F.expr(f"{banner_text()} OR {marked_element()}"),
        "legal_links": F.expr(legal_links()),
        "cookies": F.expr(ck.with_defaults("cookies")),
    }).withColumns({
        "flags": F.expr(policy.element_flags("lower_text", "language")),
        "record_error": F.expr(RECORD_ERROR),
    }).select(*[
        F.expr(tx.fenced(c)).alias(c) if c in PARSED_COLUMNS else c
        for c in (*FACT_COLUMNS, *extra)
    ])


def site_records(facts: DataFrame) -> DataFrame:
    """Valid site records."""
    return facts.where("record_error IS NULL").drop("record_error", "ok", "readable")


def failed_scans(facts: DataFrame) -> DataFrame:
    """Pages whose scan fails, with the error text."""
    return facts.selectExpr(
        "page_id", "url", "fetched_at", "record_error AS error_message"
    ).where("error_message IS NOT NULL")


def target_check(targets: DataFrame) -> DataFrame:
    """Target URLs with the message that rejects them (NULL when accepted)."""
    return targets.withColumn("rejection", F.expr(
        f"CASE WHEN NOT {urls.is_valid_url('url')} "
        "THEN concat('invalid URL: ', coalesce(url, '')) END"
    ))
