"""The independent check profile: looser words, own rules, same pages."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import html as ht, text as tx, urls
from pagewarden.operators import extraction as ex, policy
from pagewarden.operators.scale import hot_keys, materialize, salted_join


def _script_marker(script: str) -> str:
    return tx.let(
        f"lower(concat({script}.src, ' ', {script}.body))",
        lambda low: tx.contains_any(low, lexicon.CHECK_BANNER_SCRIPT_MARKERS))


def outside_scripts() -> str:
    """Script targets (not resolved) whose host is neither the page's nor below it."""
    s, x = tx.fresh("s"), tx.fresh("x")
    outside = tx.let(
        urls.host(x),
        lambda h: f"{h} <> '' AND {h} <> host AND NOT endswith({h}, concat('.', host))")
    return f"filter(transform(scripts, {s} -> {s}.src), {x} -> {outside})"


def personal_forms() -> str:
    """Forms with personal fields: name, type or placeholder of each such field."""
    f, i, e = tx.fresh("f"), tx.fresh("i"), tx.fresh("e")
    value = lambda name: f"lower(coalesce({ht.attribute(e, name)}, ''))"
    triple = f"array({value('name')}, {value('type')}, {value('placeholder')})"
    t, v, n = tx.fresh("t"), tx.fresh("v"), tx.fresh("n")
    hit = f"exists({t}, {v} -> {tx.contains_any(v, lexicon.CHECK_FIELD_PATTERNS)})"
    shown = f"get(filter({n}, {v} -> {v} <> ''), 0)"
    fields = (f"transform(filter(transform({f}.inner, {e} -> {triple}), {t} -> {hit}), "
              f"{n} -> {shown})")
    notice = tx.let(ex.span_text(f"{f}.parent", ""),
                    lambda x: tx.contains_any(x, lexicon.CHECK_NOTICE_PHRASES))
    return (f"filter(transform(forms_found, {f} -> named_struct('fields', {fields}, "
            f"'has_privacy_notice', {notice})), {i} -> size({i}.fields) > 0)")


def check_pages(pages: DataFrame) -> DataFrame:
    """Per page: reachability, policy link, banner, analytics, scripts, forms."""
    s = tx.fresh("s")
    any_of = lambda field, words: tx.contains_any(f"{s}.{field}", words)
    parsed = ex.parsed(pages, lexicon.CHECK_BANNER_MARKERS).withColumns({
        "scripts": F.expr(ex.scripts()),
        "links": F.expr(ex.links()),
        "forms_found": F.expr(ex.forms()),
        "page_text": F.expr("lower(array_join(texts, ''))"),
        "spaced_text": F.expr("lower(array_join(texts, ' '))"),
    })
    checked = parsed.withColumns({
        "privacy_link": F.expr(ex.first_link(lexicon.CHECK_LINK_PHRASES)),
        "has_banner_text": F.expr(tx.contains_any("page_text", lexicon.CHECK_BANNER_PHRASES)),
        "has_banner_element": F.expr(
            f"{ex.marked_element(lexicon.CHECK_BANNER_MARKERS)} "
            f"OR exists(scripts, {s} -> {_script_marker(s)})"),
        "has_analytics": F.expr(
            f"exists(scripts, {s} -> {any_of('src', lexicon.CHECK_ANALYTICS_SRC)} "
            f"OR {any_of('body', lexicon.CHECK_ANALYTICS_BODY)})"),
        "outside": F.expr(outside_scripts()),
        "forms_with_personal_data": F.expr(personal_forms()),
        "policy_flags": F.expr(policy.check_flags("spaced_text")),
    })
    found = {
        **{c: c for c in ("privacy_link", "has_banner_text", "has_banner_element",
                          "has_analytics", "forms_with_personal_data", "policy_flags")},
        "third_party_scripts": f"slice(outside, 1, {lexicon.CHECK_SCRIPT_LIST})",
        "third_party_scripts_count": "size(outside)",
    }
    return checked.selectExpr(
        "page_id", "url", "final_url", "status", "fetched_at", "readable AS reachable",
        "CASE WHEN NOT readable THEN load_error END AS error",
        *[f"{tx.fenced(value)} AS {name}" for name, value in found.items()],
    )


def check_policies(checked: DataFrame, crawl_checked: DataFrame,
                   floor: int = None) -> DataFrame:
    """Policy flags of the page each site links to; NULL flags if not readable.

    The links are written first (three short columns): they are needed for
    finding policy pages that very many sites share and for the join itself.
    """
    links = materialize(checked.select("page_id", "url", "privacy_link").where(
        "privacy_link IS NOT NULL"), "check-links")
    pages = crawl_checked.groupBy("url").agg(
        F.max_by(F.struct("reachable", "policy_flags"), F.struct("fetched_at", "page_id")).alias("p"))
    target = pages.select(F.col("url").alias("privacy_link"), "p.reachable", "p.policy_flags")
    return salted_join(
        links, target, "privacy_link", hot_keys(links, "privacy_link", floor), "page_id"
    ).select(
        "page_id", "url", "privacy_link",
        F.coalesce("reachable", F.lit(False)).alias("policy_read"),
        F.when(F.col("reachable"), F.col("policy_flags")).alias("policy_flags"),
    )


def check_results(checked: DataFrame, policies: DataFrame) -> DataFrame:
    """Nested result per site, ready for a JSON sink."""
    policy_check = policies.select(
        "page_id", F.struct("privacy_link", "policy_read", "policy_flags").alias(
            "privacy_policy_check"))
    return checked.drop("policy_flags").join(policy_check, "page_id", "left")


def own_verdicts(facts: DataFrame) -> DataFrame:
    s = tx.fresh("s")
    return facts.where("ok").select("page_id", F.expr(
        "array(named_struct('check_name', 'banner', 'hit', consent_banner_detected), "
        "named_struct('check_name', 'policy_link', 'hit', privacy_policy_url IS NOT NULL), "
        "named_struct('check_name', 'analytics', 'hit', exists(third_party_scripts, "
        f"{s} -> {s}.category = 'analytics')), "
        "named_struct('check_name', 'third_party', 'hit', exists(third_party_scripts, "
        f"{s} -> {s}.src <> '{lexicon.INLINE_TRACKER_SRC}')))"
    ).alias("v")).select("page_id", F.inline_outer("v"))


def check_verdicts(checked: DataFrame) -> DataFrame:
    return checked.where("reachable").select("page_id", F.expr(
        "array(named_struct('check_name', 'banner', 'hit', "
        "has_banner_text OR has_banner_element), "
        "named_struct('check_name', 'policy_link', 'hit', privacy_link IS NOT NULL), "
        "named_struct('check_name', 'analytics', 'hit', has_analytics), "
        "named_struct('check_name', 'third_party', 'hit', third_party_scripts_count > 0))"
    ).alias("v")).select("page_id", F.inline_outer("v"))


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per check: sites where both, one or neither profile says yes."""
    both = ours.withColumnRenamed("hit", "a").join(
        theirs.withColumnRenamed("hit", "b"), ["page_id", "check_name"], "full_outer"
    ).select("check_name", F.coalesce("a", F.lit(False)).alias("a"),
             F.coalesce("b", F.lit(False)).alias("b"))
    return both.groupBy("check_name").agg(
        F.count_if(F.expr("a AND b")).alias("both_hit"),
        F.count_if(F.expr("a AND NOT b")).alias("only_ours"),
        F.count_if(F.expr("NOT a AND b")).alias("only_theirs"),
        F.count_if(F.expr("NOT a AND NOT b")).alias("neither"),
    )
