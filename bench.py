"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewarden.operators.scale import close  # noqa: E402
from pagewarden.registry import audits, pages, stores  # noqa: E402
from pagewarden.session import local_session  # noqa: E402
from pagewarden.sources.tables import read_table  # noqa: E402

HEADLINE = {
    "page_tokens": pages.x1,
    "third_party_scripts": pages.x2,
    "policy_links": pages.x7,
    "plain_text": pages.x12,
    "language": pages.x13,
    "site_records": pages.x14,
    "cookie_classes": pages.c1,
    "policy_flags": audits.p2,
    "legal_page_walk": audits.p6,
    "all_rules": audits.re1,
    "report_dataset": audits.g4,
    "batch_overview": audits.g7,
    "check_profile": audits.v1,
    "website_get_or_create": stores.d1,
    "unified_report": stores.q1,
    "scan_history": stores.q3,
    "sites_with_rule_open": stores.q5,
    "shared_trackers": stores.q6,
    "finding_spans": stores.t3,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus != "*" else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def timed(fn):
        start = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    warm_up = timed(HEADLINE["report_dataset"])  # class loading and compilation
    seconds = {name: timed(fn) for name, fn in HEADLINE.items()}
    n_pages = read_table(spark, sf_dir, "pages").count()
    n_findings = audits.re1(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "warm_up": warm_up,
        "pages_per_sec": round(n_pages / seconds["site_records"], 1),
        "audited_pages_per_sec": round(n_pages / seconds["report_dataset"], 1),
        "findings_per_sec": round(n_findings / seconds["all_rules"], 1),
    }))
    close(spark)
    spark.stop()


if __name__ == "__main__":
    main()
