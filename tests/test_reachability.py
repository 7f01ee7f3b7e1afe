"""A policy page counts as read below status 400, and its newest load counts."""

from pyspark.sql import functions as F

from pagewarden.operators import checkprofile as cp, extraction as ex, walk

LINK = "<a href='/privacy'>Privacy policy</a>"
TEXT = "<p>You have the right of access and the right to erasure of your personal data.</p>"


def test_redirect_status_is_read(crawl):
    facts = ex.page_facts(crawl(("https://a.example/", LINK), ("https://a.example/privacy", TEXT, 304)))
    sites = ex.site_records(facts)
    assert [r.unreachable for r in walk.policy_lookup(sites, facts).collect()] == [False]
    done = walk.analyze_policies(sites, facts).collect()
    assert [r.policy_unreachable for r in done] == [False]
    # The audited page itself still has to be loaded in full.
    assert {r.url for r in ex.failed_scans(facts).collect()} == {"https://a.example/privacy"}


def test_newest_load_counts_everywhere(crawl):
    pages = crawl(("https://a.example/", LINK), ("https://a.example/privacy", TEXT, 200),
                  ("https://a.example/privacy", TEXT, 503))
    pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.col("page_id")))
    facts = ex.page_facts(pages)
    sites = ex.site_records(facts).where("url = 'https://a.example/'")
    assert [r.unreachable for r in walk.policy_lookup(sites, facts).collect()] == [True]
    assert [r.policy_unreachable for r in walk.analyze_policies(sites, facts).collect()] == [True]
    checked = cp.check_pages(pages)
    read = cp.check_policies(checked.where("url = 'https://a.example/'"), checked).collect()
    assert [r.policy_read for r in read] == [False]
