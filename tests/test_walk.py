"""The legal-page walk against a plain breadth-first search."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pagewarden import lexicon as lx, schemas
from pagewarden.operators import walk
from pagewarden.plans import audit
from pagewarden.sources import corpus

FACTS = (f"url string, ok boolean, flags {schemas.FLAGS}, legal_links array<string>, "
         "fetched_at timestamp, page_id bigint")


def search(start, pages, max_pages):
    """(pages read, first page per flag) of one walk."""
    queue, visited, read, first = [start], set(), [], {}
    while queue and len(read) < max_pages:
        url = queue.pop(0)
        if url in visited:
            continue
        visited.add(url)
        ok, flags, links = pages.get(url, (False, (), ()))
        if not ok:
            continue
        read.append(url)
        for name, value in zip(lx.POLICY_ELEMENTS, flags):
            if value:
                first.setdefault(name, url)
        if len(read) < max_pages:
            queue += [u for u in links if u not in visited][:max_pages]
    return read, first


def run(spark, starts, pages, max_pages=5, hot=()):
    facts = spark.createDataFrame(
        [(u, ok, tuple(fl), list(li), None, None) for u, (ok, fl, li) in pages.items()], FACTS)
    begin = spark.createDataFrame([(s,) for s in starts], "start string")
    pool = walk.legal_pool(facts, begin)
    return {r.start: r for r in walk.policy_walks(begin, pool, max_pages, list(hot)).collect()}


def random_site(rng, host, n):
    urls = [f"https://{host}/{i}" for i in range(n)]
    return {u: (rng.random() < 0.8, [rng.random() < 0.2 for _ in lx.POLICY_ELEMENTS],
                list(dict.fromkeys(rng.choices(urls + [f"https://{host}/gone"], k=rng.randint(0, 9)))))
            for u in urls}


@pytest.mark.parametrize("max_pages", [5, 3, 1])
def test_random_graphs(spark, max_pages):
    rng = random.Random(max_pages)
    pages = {}
    for h in range(12):
        pages |= random_site(rng, f"h{h}.com", rng.randint(2, 14))
    starts = [u for u in pages if rng.random() < 0.5] + ["https://nowhere.com/"]
    hubs = [u for u in pages if u.endswith("/0")]
    plain = run(spark, starts, pages, max_pages)
    assert set(plain) == set(starts)
    for start, row in plain.items():
        read, first = search(start, pages, max_pages)
        assert row.pages_analyzed == read
        assert row.evidence_urls == first
        assert (row.policy_flags is None) == (not read)
        if read:
            assert {k for k, v in row.policy_flags.asDict().items() if v} == set(first)
    if max_pages == 5:  # splitting hot pages changes nothing
        assert run(spark, starts, pages, max_pages, hubs) == plain


LINKED = '<p>Direito de acesso aos dados pessoais garantido.</p><a href="{}">{}</a>'


def outcome(spark, crawl, pages, max_pages=5):
    home = crawl(("https://example.com/", '<a href="/privacidade">Privacidade</a>'))
    legal = crawl(*[(f"https://example.com{p}", h) for p, h in pages.items()]) if pages else home.limit(0)
    return audit.run_audit(home, legal, max_pages=max_pages).evaluated.first()


def test_flag_on_linked_page(spark, crawl):
    r = outcome(spark, crawl, {
        "/privacidade": LINKED.format("/contactos", "Contactos"),
        "/contactos": "<p>Encarregado de Proteção de Dados: dpo@example.com</p>"})
    assert r.policy_flags.right_access and r.policy_flags.dpo_contact
    assert r.evidence_urls["dpo_contact"] == "https://example.com/contactos"
    assert r.pages_read == 2


def test_failing_linked_page_is_skipped(spark, crawl):
    r = outcome(spark, crawl, {"/privacidade": LINKED.format("/cookies", "Política de Cookies")})
    assert r.policy_flags.right_access and r.pages_analyzed == ["https://example.com/privacidade"]


def test_page_budget(spark, crawl):
    chain = {f"/p{i}": LINKED.format(f"/p{i + 1}", "Termos") for i in range(2, 7)}
    r = outcome(spark, crawl, {"/privacidade": LINKED.format("/p2", "Termos")} | chain, max_pages=3)
    assert r.pages_read == 3


def test_nothing_reachable(spark, crawl):
    r = outcome(spark, crawl, {})
    assert r.policy_unreachable
    fired = [f.rule_id for f in r.findings]
    assert "R12" in fired and not {"R05", "R06", "R07", "R08", "R09", "R10"} & set(fired)


def test_shared_hot_policy_page(spark, crawl):
    """Very many sites with one policy page: same rows with and without salting."""
    sites = crawl(*[(f"https://s{i}.com/", '<a href="https://hub.com/privacy">Privacy</a>')
                    for i in range(60)])
    hub = crawl(("https://hub.com/privacy", '<p>right of access</p><a href="/terms">Terms</a>'),
                ("https://hub.com/terms", "<p>retention period</p>"))
    one = audit.run_audit(sites, hub).evaluated
    two = audit.run_audit(sites, hub, floor=5).evaluated
    columns = ("url", "pages_analyzed", "policy_flags")
    rows = sorted(map(tuple, one.select(*columns).collect()))
    assert rows == sorted(map(tuple, two.select(*columns).collect())) and len(rows) == 60
    assert all(len(r[1]) == 2 for r in rows)


def test_newest_load_of_a_page_counts(spark):
    df = spark.sql("""SELECT 'u' AS url, v.ok, v.at AS fetched_at, 1L AS page_id,
        CAST(NULL AS struct<a:boolean>) AS flags, CAST(array() AS array<string>) AS legal_links
        FROM VALUES (false, timestamp'2024-01-01'), (true, timestamp'2024-01-02') AS v(ok, at)""")
    assert [r.ok for r in walk.latest_by_url(df).collect()] == [True]


def test_pool_compares_urls_by_number_and_pages_are_made_in_all_tasks(spark):
    sites = corpus.linked_sites(spark, SMALL)
    tasks = sites.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= min(4, spark.sparkContext.defaultParallelism)  # of one small file
    facts = sites.where("page_id < 400").unionByName(sites.where("page_id = 101").withColumn("url", F.lit(None)))
    facts = facts.unionByName(facts.where("page_id % 3 = 0").withColumn(  # a newer load that cannot be read
        "fetched_at", F.expr("fetched_at + INTERVAL 1 DAY")).withColumn("ok", F.lit(False)))
    starts = sites.where("page_id IN (100, 300)").select(F.col("url").alias("start")).unionByName(
        spark.sql("SELECT CAST(NULL AS string) AS start"))
    pool = walk.legal_pool(facts, starts)
    rows = facts.collect()
    linked = {u for r in rows if r.ok for u in r.legal_links} | {r.start for r in starts.collect()}
    newest = {}
    for r in sorted((r for r in rows if r.url is not None), key=lambda r: r.fetched_at):
        newest[r.url] = r.ok
    want = {(u, ok) for u, ok in newest.items() if u in linked}
    assert want and sorted((r.url, r.ok) for r in pool.collect()) == sorted(want)


@pytest.mark.parametrize("max_pages, ahead", [(5, 3), (5, 1), (3, 2), (1, 1)])
def test_walks_over_a_pool_that_is_not_stored(spark, monkeypatch, max_pages, ahead):
    """Queued URLs that wait, pages that cannot be read, loads that come twice and hosts linked to each other."""
    monkeypatch.setattr(walk, "LOOK_AHEAD", ahead)
    rng = random.Random(max_pages * 10 + ahead)
    pages, hosts = {}, [f"h{h}.com" for h in range(6)]
    for host in hosts:
        pages |= random_site(rng, host, rng.randint(2, 14))
    pages = {u: (rng.random() < 0.5, fl, (li + [f"https://{rng.choice(hosts)}/{rng.randint(0, 20)}"]) * rng.randint(1, 2))
             for u, (_, fl, li) in pages.items()}
    pages |= {f"https://chain/{i}": (True, [i == 4] * len(lx.POLICY_ELEMENTS),
                                     [f"https://dead/{i}{j}" for j in range(4)] + [f"https://chain/{i + 1}"]) for i in range(8)}
    starts = [u for u in pages if rng.random() < 0.4] + ["https://nowhere.com/", "https://chain/0", "https://chain/0"]
    rows = [(u, ok, tuple(fl), list(li), None, 2) for u, (ok, fl, li) in pages.items()]
    older = [(u, not ok, tuple(fl), [], None, 1) for u, (ok, fl, _) in pages.items() if rng.random() < 0.3]
    facts = spark.createDataFrame(rows + rows[::3] + older + [(None, True, rows[0][2], [None, "x"], None, 3)], FACTS)
    begin = spark.createDataFrame([(s,) for s in starts], "start string")
    done = walk.policy_walks(begin, walk.legal_pool(facts, begin), max_pages, stored=False).collect()
    assert len(done) == len(set(starts))
    for row in done:
        read, first = search(row.start, pages, max_pages)
        assert row.pages_analyzed == read and row.evidence_urls == first


def test_a_level_reads_what_it_looks_up(spark, tmp_path):
    """Neither the pool nor the shuffles of ended levels stay on disk: some hundred bytes for a site of 60 pages."""
    from pagewarden.operators import scale
    from pagewarden.registry import audits
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk():
        shuffles = files.getAllFiles()
        kept = [os.path.join(d, f) for d, _, fs in os.walk(scale.run_dir(spark)) for f in fs]
        return (sum(shuffles.apply(i).length() for i in range(shuffles.size())) + sum(map(os.path.getsize, kept)))

    spark.range(1, 4001).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    before = on_disk()
    rows = audits.p6_limits(spark, str(tmp_path))
    assert (on_disk() - before) / 4000 < 1000
    assert rows.count() == spark.range(1, 4001).where("(id * 7) % 6 > 1").count()


def test_pages_and_links_are_not_broadcast(spark):
    """A small table of few columns can stand for many pages and links: its estimate says nothing of them."""
    facts = corpus.linked_sites(spark, SMALL)
    starts = facts.where("page_id % 100 = 0 AND ok").select(F.col("url").alias("start"))
    pool = walk.legal_pool(facts, starts)
    assert "Broadcast" not in pool._jdf.queryExecution().executedPlan().toString()
