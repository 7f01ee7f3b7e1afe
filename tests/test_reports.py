"""Report datasets, notifications and the check profile on small pages."""

import hashlib

from pyspark.sql import functions as F

from pagewarden.operators import checkprofile as cp, company, extraction as ex, notify, reporting, rules
from pagewarden.plans import audit
from pagewarden.sources import sinks


def _evaluated(crawl):
    cookies = [("_ga", "a.com", "/", True, False, None), ("sid", "a.com", "/", True, True, None)]
    pages = crawl(("https://www.a.com/x", "<p>hello</p>", 200, cookies),
                  ("https://b.com/", "<div>we use cookies</div><a href='/p'>Privacy</a>"))
    return audit.page_level_findings(
        pages.withColumn("fetched_at", F.expr("timestamp'2024-03-05 06:07:08'")), None)


def test_report_rows(crawl):
    rows = {r.url: r for r in reporting.reports(_evaluated(crawl)).collect()}
    r = rows["https://www.a.com/x"]
    assert (r.high, r.medium, r.low) == (3, 1, 0)
    assert [f.rule_id for f in r.findings] == ["R01", "R02", "R05", "R04"]
    assert [f.label for f in r.findings] == ["Alto", "Alto", "Alto", "Médio"]
    assert r.generated_at == "05/03/2024 06:07"
    assert r.report_key == "www_a_com_20240305-060708"
    assert r.report_id == hashlib.sha1(b"https://www.a.com/x-2024-03-05T06:07:08").hexdigest()[:8]
    assert (r.total_cookies, [(c.position, c.name) for c in r.tracking_cookies]) == (2, [(1, "_ga")])
    assert r.company is None and not r.no_findings


def test_report_company_block(spark, crawl):
    firm = spark.createDataFrame(
        [("https://b.com/", "B", None, "5", None, False, "check", "not available")],
        "url string, company_name string, legal_name string, nif string, address string, "
        "registry_verified boolean, note string, nameservers string")
    merged = company.merge_into_sites(_evaluated(crawl), firm)
    rows = {r.url: r.company for r in reporting.reports(merged).collect()}
    assert rows["https://www.a.com/x"] is None
    b = rows["https://b.com/"]
    assert (b.legal_name, b.domain, b.nif, b.note_kind, b.nameservers) == (
        "B", "b.com", "5", "warning", None)


def test_history_and_latest(spark, crawl, tmp_path):
    path = str(tmp_path / "reports")
    made = reporting.reports(_evaluated(crawl))
    later = reporting.reports(_evaluated(crawl).withColumn(
        "fetched_at", F.expr("timestamp'2024-03-06'")).where("url LIKE '%a.com%'"))
    for batch in (made, later):
        sinks.append_reports(batch, path)
        sinks.replace_latest(batch, path)
    assert spark.read.parquet(f"{path}/history").count() == 3
    latest = sinks.SnapshotTable(f"{path}/latest", made.schema).read(spark)
    assert {(r.site_slug, r.scanned_at.day) for r in latest.collect()} == {
        ("www_a_com", 6), ("b_com", 5)}


def test_notifications(crawl):
    found = rules.finding_rows(_evaluated(crawl), "url")
    rows = notify.notifications(found).collect()
    first = [r for r in rows if r.category == "missing_privacy_policy"][0]
    assert (first.remote_address, first.level, first.device_name) == ("https://www.a.com", 1, None)
    assert first.description.startswith("https://www.a.com/x — ")
    assert notify.notifications(found, enabled=False).count() == 0


def test_check_profile(spark, crawl):
    html = """<div class="my-Consent">x</div><script src="//cdn.a.com/1.js"></script>
    <script src="/own.js"></script><script src="https://x.net/2.js"></script><script>gtag()</script>
    <div><form><input type="password" placeholder="Senha"><input name="Email"><textarea></textarea>
    </form> RGPD</div><a href="/p">Cookies</a>"""
    pages = crawl(("https://a.com/", html), ("https://a.com/p", "<p>right of access</p>"))
    checked = cp.check_pages(pages)
    r = checked.where("url = 'https://a.com/'").first()
    assert (r.privacy_link, r.has_banner_text, r.has_banner_element, r.has_analytics) == (
        "https://a.com/p", False, True, True)
    assert (r.third_party_scripts, r.third_party_scripts_count) == (["https://x.net/2.js"], 1)
    assert [(f.fields, f.has_privacy_notice) for f in r.forms_with_personal_data] == [
        (["password", "email"], True)]
    p = cp.check_policies(checked, checked).first()
    assert p.policy_read and p.policy_flags.right_access and not p.policy_flags.dpo_contact


def test_overview(crawl):
    done = _evaluated(crawl)
    failed = ex.failed_scans(ex.page_facts(crawl(("https://c.com/", "", 500))))
    got = {r.measure: r.value for r in reporting.batch_overview(done, failed).collect()}
    assert got["sites_completed"] == 2 and got["sites_failed"] == 1
    assert got["sites_with_high"] == 1 and got["rule_R05"] == 1
