"""The whole audit as one plan over a crawl table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon, schemas
from pagewarden.operators import extraction, rules, scale, walk


@dataclass
class Audit:
    """Outcome of an audit; ``facts`` are written, the other members are lazy."""

    facts: DataFrame      # one row per loaded page
    evaluated: DataFrame  # one row per valid site record, with its findings
    failed: DataFrame     # pages whose scan failed, with the error


def run_audit(targets: DataFrame, crawl: DataFrame = None, rule_list: list = None,
              max_pages: int = lexicon.MAX_POLICY_PAGES, floor: int = None) -> Audit:
    """Audit the target pages; ``crawl`` holds further pages the walk may read.

    The pages are tokenised once; their facts (without html) are written to the
    shared scratch folder and everything else works on those.
    """
    marked = targets.withColumn("is_target", F.lit(True))
    pages = marked if crawl is None else marked.unionByName(
        crawl.withColumn("is_target", F.lit(False)))
    facts = scale.materialize(extraction.page_facts(pages, extra=("is_target",)), "facts")
    return from_facts(facts, rule_list, max_pages, floor)


def from_facts(facts: DataFrame, rule_list: list = None,
               max_pages: int = lexicon.MAX_POLICY_PAGES, floor: int = None) -> Audit:
    scanned = facts.where("is_target").drop("is_target")
    sites = extraction.site_records(scanned)
    analysed = walk.analyze_policies(sites, facts, max_pages, floor)
    return Audit(
        facts=facts,
        evaluated=rules.evaluate(analysed, rule_list),
        failed=extraction.failed_scans(scanned),
    )


def page_level_findings(targets: DataFrame, only, rule_list: list = None) -> DataFrame:
    """Findings of rules that need no policy text: one narrow pass, no shuffle."""
    sites = extraction.site_records(extraction.page_facts(targets)).withColumns({
        "policy_flags": F.lit(None).cast(schemas.FLAGS),
        "policy_unreachable": F.lit(False),
    })
    return rules.evaluate(sites, rule_list, only)

