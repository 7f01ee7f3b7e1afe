"""Bounded breadth-first walk over legal pages, all sites at once.

The walk depends only on its first URL, so it runs once per distinct policy
URL.  One row per walk carries the pages read so far and the queue; its size is
bounded by the page budget (at most ``max_pages`` pages with ``max_pages``
links each).  A level explodes the queue, looks every URL up in the page
facts and folds the answers in queue order, which is exactly the order of a
first-in first-out queue.  Walks that have ended are put aside, so each level
shuffles only those still under way, and the levels end with the last of them.
A pool need not be stored: then each level makes the part of it that it looks up.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon, schemas
from pagewarden.functions import text as tx
from pagewarden.operators.scale import hot_keys, materialize, salted_join, sieve

PAGES = f"array<struct<url:string,flags:{schemas.FLAGS}>>"
LOOK_AHEAD = 3
NONE_WAIT = "CAST(array() AS array<string>)"


def latest_by_url(facts: DataFrame, *keys: str) -> DataFrame:
    """One row per URL: the newest load of the page; ``keys`` are columns that follow from the URL."""
    return facts.groupBy(*keys, "url").agg(
        F.max_by(F.struct("ok", "flags", "legal_links"),
                 F.struct("fetched_at", "page_id", F.hash("flags", "legal_links"))
                 ).alias("p")
    ).select("url", "p.*")


def policy_lookup(sites: DataFrame, facts: DataFrame, floor: int = None) -> DataFrame:
    """Policy URL of every site to the page loaded for it; unreachable if none."""
    links = materialize(sites.where("privacy_policy_url IS NOT NULL").select(
        "page_id", F.col("privacy_policy_url").alias("policy_url")), "policy-links")
    pages = _as_read(facts).groupBy(F.col("url").alias("policy_url")).agg(
        F.max_by("ok", F.struct("fetched_at", "page_id")).alias("ok"))
    return salted_join(
        links, pages, "policy_url", hot_keys(links, "policy_url", floor), "page_id"
    ).select("page_id", "policy_url", (~F.coalesce("ok", F.lit(False))).alias("unreachable"))


def _as_read(facts: DataFrame) -> DataFrame:
    """Facts in which ``ok`` means that a legal page can be read."""
    return facts.withColumn("ok", F.col("readable")) if "readable" in facts.columns else facts


def legal_pool(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """Facts of the pages a walk can reach: policy URLs and linked legal pages.

    URLs are compared by their hash, one number for each link; a page let in by an equal hash is never
    looked up. Facts are dealt by that hash once, for the comparison and for the newest load. How many
    links a page has is not in the planner's estimates, so it is told not to broadcast them.
    """
    facts = _as_read(facts)
    linked = facts.where("ok").select(F.explode("legal_links").alias("start"))
    candidates = starts.select("start").union(linked).where("start IS NOT NULL").select(
        F.xxhash64("start").alias("url_hash")).distinct()
    return latest_by_url(
        facts.where("url IS NOT NULL").select(
            "url", "ok", "flags", "legal_links", "fetched_at", "page_id", F.xxhash64("url").alias("url_hash"))
        .join(candidates.hint("merge"), "url_hash", "left_semi"), "url_hash")


def _fold(max_pages: int, rest: str) -> str:
    """Process the looked-up queue entries of one level in order; ``rest`` still waits before their links."""
    s, e, link = tx.fresh("s"), tx.fresh("e"), tx.fresh("l")

    def state(visited, pages, queue):
        return f"named_struct('visited', {visited}, 'pages', {pages}, 'queue', {queue})"

    seen = f"concat({s}.visited, array({e}.url))"
    offered = (f"slice(filter({e}.legal_links, {link} -> {link} <> {e}.url "
               f"AND NOT array_contains({s}.visited, {link})), 1, {max_pages})")
    more = (f"CASE WHEN size({s}.pages) + 1 < {max_pages} "
            f"THEN concat({s}.queue, {offered}) ELSE {s}.queue END")
    read = f"concat({s}.pages, array(named_struct('url', {e}.url, 'flags', {e}.flags)))"
    return (
        f"aggregate(array_sort(entries), "
        f"{state('carry.visited', 'carry.pages', rest)}, "
        f"({s}, {e}) -> CASE "
        f"WHEN size({s}.pages) >= {max_pages} "
        f"OR array_contains({s}.visited, {e}.url) THEN {s} "
        f"WHEN NOT coalesce({e}.ok, false) "
        f"THEN {state(seen, f'{s}.pages', f'{s}.queue')} "
        f"ELSE {state(seen, read, more)} END)"
    )


def begun(starts: DataFrame, *keys: str) -> DataFrame:
    """Walks that have read nothing yet, one for each start (and keys)."""
    return starts.select(
        "start", *keys,
        F.array().cast("array<string>").alias("visited"),
        F.array().cast(PAGES).alias("pages"),
        F.array("start").alias("queue"),
    )


def queued(state: DataFrame, *keys: str, ahead: str = None) -> DataFrame:
    """The queued URLs of all walks, one row each; the first carries the walk's state.

    With ``ahead`` only so many of a walk, the others wait in its state.
    """
    waiting = [F.expr(f"slice(queue, {ahead} + 1, size(queue))").alias("rest")] if ahead else []
    carried = ["visited", "pages"] + (["rest"] if ahead else [])
    return state.select(
        "start", *keys, "visited", "pages", *waiting,
        F.posexplode_outer(F.expr(f"slice(queue, 1, {ahead})") if ahead else "queue").alias("pos", "url")
    ).select(
        # A finished walk looks its first page up again: spread over all tasks,
        # and without effect because that page is visited.
        "start", *keys, "pos", F.coalesce("url", "start").alias("url"),
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(*carried)).alias("carry"),
    )


def folded(looked_up: DataFrame, max_pages: int, *keys: str, newest=(), rest: str = NONE_WAIT) -> DataFrame:
    """Walks after a level. Of several loads of a page the one with the largest ``newest`` counts:
    it comes first, and a URL that has been visited is passed over. ``rest`` are queued URLs not looked up."""
    def latest_first(column):
        number = F.unix_micros(column) if column == "fetched_at" else F.col(column)
        return [F.col(column).isNull().alias(f"no_{column}"), (-number).alias(f"less_{column}")]
    order = [c for column in newest for c in latest_first(column)]
    if newest:
        order.append((-F.hash("flags", "legal_links").cast("bigint")).alias("less_hash"))
    return looked_up.groupBy("start", *keys).agg(
        F.first("carry", ignorenulls=True).alias("carry"),
        F.collect_list(
            F.struct("pos", "url", *order, "ok", "flags", "legal_links")
        ).alias("entries"),
    ).select("start", *keys, F.expr(_fold(max_pages, rest)).alias("s")).select("start", *keys, "s.*")


def policy_walks(starts: DataFrame, pool: DataFrame,
                 max_pages: int = lexicon.MAX_POLICY_PAGES,
                 hot: list = (), stored: bool = True) -> DataFrame:
    """Walk from every start URL: merged flags, evidence URLs, pages read.

    A pool that is not ``stored`` is made anew for each level and only as far as the level looks
    it up: the sieve of the queued URLs reaches the facts under it before they are shuffled.
    """
    if not stored:
        return _walks_over_facts(starts, pool, max_pages, hot)
    state, ended = begun(starts), []
    more = f"size(queue) > 0 AND size(pages) < {max_pages}"
    for _ in range(max_pages):
        # A level reads only what the walks still under way have queued.
        state = materialize(folded(salted_join(
            queued(state), pool, "url", hot, spread_by="start"), max_pages), "walk-level")
        ended.append(state.where(f"NOT ({more})"))
        state = state.where(more)
        if state.isEmpty():
            break
    return walk_results(reduce(DataFrame.unionByName, ended, state))


def _walks_over_facts(starts: DataFrame, pool: DataFrame, max_pages: int, hot: list) -> DataFrame:
    """The same walks, few look-ups before few reads of the facts.

    A level looks up LOOK_AHEAD times the pages that a walk may still read, in the order of its queue; the
    others wait in front of the links found. From level ``max_pages`` on it looks up all, so that
    each level ends a walk or reads a page of it, and twice as many levels are enough.
    """
    state, ended = materialize(begun(starts), "walk-level", free=True), []
    more = f"size(queue) > 0 AND size(pages) < {max_pages}"
    for level in range(2 * max_pages):
        ahead = f"({LOOK_AHEAD} * ({max_pages} - size(pages)))" if level < max_pages else "size(queue)"
        entries = queued(state, ahead=ahead)
        near = pool.where(sieve(entries, "url")(F.col("url"))).hint("merge")  # larger than estimated
        state = materialize(folded(salted_join(
            entries, near, "url", hot, spread_by="start"), max_pages, rest="carry.rest"), "walk-level", free=True)
        ended.append(state.where(f"NOT ({more})"))
        state = state.where(more)
        if state.isEmpty():
            break
    return walk_results(reduce(DataFrame.unionByName, ended, state))


def walk_results(state: DataFrame, *keys: str) -> DataFrame:
    p = tx.fresh("p")
    first = lambda key: f"get(filter(pages, {p} -> {p}.flags.{key}), 0).url"
    flags = ", ".join(
        f"'{k}', exists(pages, {p} -> {p}.flags.{k})" for k in lexicon.POLICY_ELEMENTS)
    evidence = ", ".join(
        f"named_struct('key', '{k}', 'value', {first(k)})" for k in lexicon.POLICY_ELEMENTS)
    return state.selectExpr(
        "start", *keys,
        f"CASE WHEN size(pages) > 0 THEN named_struct({flags}) END AS policy_flags",
        f"map_from_entries(filter(array({evidence}), {p} -> {p}.value IS NOT NULL)) "
        "AS evidence_urls",
        f"transform(pages, {p} -> {p}.url) AS pages_analyzed",
        "size(pages) AS pages_read",
    )


def analyze_policies(sites: DataFrame, facts: DataFrame,
                     max_pages: int = lexicon.MAX_POLICY_PAGES,
                     floor: int = None) -> DataFrame:
    """Site records with the outcome of their policy walk.

    ``policy_unreachable`` is true when there is a policy link but no page of
    the walk could be read.
    """
    links = sites.where("privacy_policy_url IS NOT NULL").select(
        F.col("privacy_policy_url").alias("start"))
    starts = links.distinct()
    pool = materialize(legal_pool(facts, starts), "legal-pool")
    hot_pages = hot_keys(pool.select(F.explode("legal_links").alias("url")), "url", floor)
    hot_starts = hot_keys(links, "start", floor)
    results = policy_walks(starts, pool, max_pages, hot_pages)
    return with_outcome(salted_join(
        sites.withColumn("start", F.col("privacy_policy_url")), results, "start",
        hot_starts, spread_by="page_id",
    ).drop("start"))


def with_outcome(met: DataFrame) -> DataFrame:
    """Sites with the results of their walks (null where there was none), completed."""
    return met.withColumns({
        "policy_unreachable": F.expr(
            "privacy_policy_url IS NOT NULL AND coalesce(pages_read, 0) = 0"),
        "pages_analyzed": F.expr("coalesce(pages_analyzed, CAST(array() AS array<string>))"),
        "pages_read": F.expr("coalesce(pages_read, 0)"),
    })
