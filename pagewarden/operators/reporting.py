"""Report datasets: one nested row per scan, built inside the site row."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import text as tx, urls
from pagewarden.operators import cookies as ck
from pagewarden.operators.company import FIELDS as COMPANY_FIELDS
from pagewarden.operators.scale import newest_rows


def _case(value: str, mapping: dict, default) -> str:
    branches = " ".join(
        f"WHEN {tx.quoted(k)} THEN {tx.quoted(v)}" for k, v in mapping.items())
    return f"CASE {value} {branches} ELSE {tx.quoted(default)} END"


def severity_rank(severity: str) -> str:
    return _case(severity, lexicon.SEVERITY_RANK, lexicon.SEVERITY_RANK_OTHER)


def severity_label(severity: str) -> str:
    return _case(severity, lexicon.SEVERITY_LABELS, lexicon.SEVERITY_LABEL_OTHER)


def severity_count(severity: str) -> str:
    f = tx.fresh("f")
    return f"size(filter(findings, {f} -> {f}.severity = '{severity}'))"


def ordered_findings() -> str:
    """Findings from high to low; equal severities stay in emission order."""
    f = tx.fresh("f")
    return (
        f"array_sort(transform(findings, {f} -> named_struct("
        f"'rank', {severity_rank(f'{f}.severity')}, 'seq', {f}.seq, "
        f"'rule_id', {f}.rule_id, 'severity', {f}.severity, "
        f"'label', {severity_label(f'{f}.severity')}, "
        f"'description', {f}.description, 'recommendation', {f}.recommendation, "
        f"'message', get_json_object({f}.evidence, '$.message'))))"
    )


def iso_time(time: str) -> str:
    """ISO text of a timestamp; fractions only when there are any."""
    return (f"concat(date_format({time}, \"yyyy-MM-dd'T'HH:mm:ss\"), "
            f"CASE WHEN unix_micros({time}) % 1000000 <> 0 "
            f"THEN date_format({time}, '.SSSSSS') ELSE '' END)")


def report_id(url: str, time: str) -> str:
    return f"substr(sha1(concat({url}, '-', {iso_time(time)})), 1, 8)"


def severity_counts(evaluated: DataFrame) -> DataFrame:
    """High/medium/low findings per scan; zero rows stay."""
    return evaluated.selectExpr(
        "page_id", *[f"{severity_count(s)} AS {s}" for s in lexicon.SEVERITY_RANK])


COMPANY_SHOWN = (
    "coalesce(company_legal_name, '') <> '' OR coalesce(company_nif, '') <> '' "
    "OR coalesce(company_address, '') <> '' "
    "OR coalesce(size(company_nameservers), 0) > 0"
)


def company_block(url: str) -> str:
    """The company section of a report; NULL when it is not shown."""
    labels = lexicon.REPORT_REGISTRY_LABELS
    return (
        f"CASE WHEN {COMPANY_SHOWN} THEN named_struct("
        f"'legal_name', company_legal_name, 'site', {url}, "
        f"'domain', {urls.display_domain(url)}, 'nif', company_nif, "
        "'address', company_address, "
        "'nameservers', nullif(array_join(company_nameservers, ', '), ''), "
        f"'registry', CASE WHEN company_registry_verified THEN {tx.quoted(labels[True])} "
        f"WHEN NOT company_registry_verified THEN {tx.quoted(labels[False])} "
        f"ELSE {tx.quoted(labels[None])} END, "
        "'note_kind', CASE WHEN coalesce(company_note, '') = '' THEN NULL "
        "WHEN coalesce(NOT company_registry_verified, false) THEN 'warning' "
        "ELSE 'plain' END, 'note', company_note) END"
    )


def without_company(evaluated: DataFrame) -> DataFrame:
    """Empty company columns for scans started from a URL."""
    return evaluated.withColumns({
        name: F.lit(None).cast(
            "boolean" if name.endswith("verified")
            else "array<string>" if name.endswith("nameservers") else "string")
        for name in COMPANY_FIELDS if name not in evaluated.columns
    })


def reports(evaluated: DataFrame, time: str = "fetched_at") -> DataFrame:
    """One report per scan, also for scans without findings.

    The report time is a column of the input, so results repeat exactly.
    """
    tracked = "tracking_cookies"
    classed = without_company(evaluated).withColumn(
        "classed", F.expr(ck.with_classes("cookies")))
    return classed.selectExpr(
        "page_id", "url", f"{time} AS scanned_at",
        f"{report_id('url', time)} AS report_id",
        f"concat({urls.site_slug('url')}, '_', "
        f"date_format({time}, '{lexicon.REPORT_KEY_FORMAT}')) AS report_key",
        f"{urls.site_slug('url')} AS site_slug",
        f"CAST({time} AS date) AS scan_date",
        f"date_format({time}, '{lexicon.REPORT_DATE_FORMAT}') AS generated_at",
        *[f"{severity_count(s)} AS {s}" for s in lexicon.SEVERITY_RANK],
        "size(findings) = 0 AS no_findings",
        f"{ordered_findings()} AS findings",
        "size(classed) AS total_cookies",
        f"{ck.numbered(ck.of_class('classed', lexicon.COOKIE_TRACKING))} AS {tracked}",
        f"{company_block('url')} AS company",
        f"{tx.quoted(lexicon.REPORT_DISCLAIMER)} AS disclaimer",
    )


def latest_reports(all_reports: DataFrame) -> DataFrame:
    """The newest report of every site: keys are aggregated, whole reports only looked up."""
    return newest_rows(all_reports, "site_slug", "scanned_at", "page_id", ["report_key"]).select(
        "site_slug", *[c for c in all_reports.columns if c != "site_slug"])


def batch_overview(evaluated: DataFrame, failed: DataFrame) -> DataFrame:
    """Long table (measure, value): sites scanned, failed, with high findings,
    findings per rule."""
    f = tx.fresh("f")
    hits = evaluated.selectExpr(
        f"explode(concat(array('sites_completed'), CASE WHEN {severity_count('high')} > 0 "
        "THEN array('sites_with_high') ELSE CAST(array() AS array<string>) END, "
        f"transform(findings, {f} -> concat('rule_', {f}.rule_id)))) AS measure", "1L AS n")
    lost = failed.selectExpr("'sites_failed' AS measure", "1L AS n")
    none = evaluated.sparkSession.createDataFrame(
        [(m, 0) for m in ("sites_completed", "sites_with_high", "sites_failed")],
        "measure string, n bigint")
    return hits.unionByName(lost).unionByName(none).groupBy("measure").agg(
        F.sum("n").alias("value"))
