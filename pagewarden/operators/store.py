"""State changes of the audit store, as table-to-table functions.

Each function takes the current tables and a batch and gives the new rows or
the new table.  Times come from the batch, never from the clock.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import urls
from pagewarden.operators.scale import dense_ids, materialize, moment


def _last_id(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def new_websites(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows to add for URLs not stored yet; ``seen`` has (url, seen_at).

    URLs compare as given.  A URL seen twice is added once, at its first time.
    """
    fresh = seen.groupBy("url").agg(F.min("seen_at").alias("created_at")).join(
        existing.select("url"), "url", "left_anti")
    numbered = dense_ids(fresh, ["url"], "website_id", _last_id(existing, "website_id"))
    return numbered.select(
        "website_id", "url", F.expr(urls.website_domain("url")).alias("domain"),
        F.date_trunc("second", "created_at").alias("created_at"),
    )


def get_or_create(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """The website table after a batch."""
    added = new_websites(existing, seen)
    return existing.select(*added.columns).unionByName(added)


def start_runs(existing: DataFrame, starts: DataFrame) -> DataFrame:
    """New runs in status Running; ``starts`` has (website_id, started_at),
    unique, at most one start per site and instant."""
    numbered = dense_ids(
        starts.select("website_id", "started_at"), ["website_id", "started_at"],
        "scan_run_id", _last_id(existing, "scan_run_id"))
    return numbered.select(
        "scan_run_id", "website_id", F.lit(None).cast("string").alias("report_ref"),
        F.date_trunc("second", "started_at").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("Running").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def run_outcomes(events: DataFrame) -> DataFrame:
    """Last state per run from its events (scan_run_id, status, at, report_ref,
    error_message).  A later event wins; at equal times an end beats Running, Failed beats Completed, and
    any other text (a broken constraint) beats these; completing never clears an error text and failing never clears a report reference.

    Times and the rank of the status are one number, so all sums are hash aggregates; the texts are
    looked up in the events of the newest moments.
    """
    known = sorted(lexicon.SCAN_STATUSES, key=lambda s: (s != "Running", s))
    rank = "CASE status " + " ".join(f"WHEN '{s}' THEN {n}L" for n, s in enumerate(known)) + " ELSE 99L END"
    ended = F.col("status") != "Running"
    when = lambda status: F.max(F.when(F.col("status") == status, F.col("at")))
    sums = events.groupBy("scan_run_id").agg(
        F.max(moment("at", rank)).alias("last"), F.max(F.when(ended, F.col("at"))).alias("finished_at"),
        when("Completed").alias("completed_at"), when("Failed").alias("failed_at"))
    last = lambda status, column, at: F.array_max(F.collect_set(F.when(
        (F.col("status") == status) & (F.col("at") == F.col(at)), F.col(column)))).alias(column)
    newest = events.withColumn("moment", moment("at", rank)).join(
        sums.withColumnRenamed("scan_run_id", "run"), F.col("scan_run_id").eqNullSafe(F.col("run")))
    texts = newest.where("at = completed_at OR at = failed_at OR moment = last")
    return texts.groupBy("scan_run_id").agg(
        F.array_max(F.collect_set(F.when(F.col("moment") == F.col("last"), F.col("status")))).alias("status"),
        F.max("finished_at").alias("finished_at"), last("Completed", "report_ref", "completed_at"),
        last("Failed", "error_message", "failed_at"))


def apply_outcomes(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The run table after complete/fail events."""
    done = run_outcomes(events.where(F.col("status") != "Running")).select(
        "scan_run_id", F.struct("status", "finished_at", "report_ref", "error_message").alias("o"))
    return runs.join(done, "scan_run_id", "left").select(
        "scan_run_id", "website_id",
        F.coalesce("o.report_ref", "report_ref").alias("report_ref"), "started_at",
        F.coalesce(F.date_trunc("second", "o.finished_at"), "finished_at").alias("finished_at"),
        F.coalesce("o.status", "status").alias("status"),
        F.coalesce("o.error_message", "error_message").alias("error_message"),
    )


def new_findings(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Finding rows to append; repeats are kept.  ``rows`` has (scan_run_id, seq,
    rule_id, description, recommendation, evidence, found_at)."""
    numbered = dense_ids(rows, ["scan_run_id", "seq", "rule_id"], "finding_id",
                         _last_id(existing, "finding_id"))
    return numbered.select(
        "finding_id", "scan_run_id", "rule_id",
        F.lit(None).cast("string").alias("category"), "description", "recommendation",
        F.col("evidence").alias("evidence_json"),
        F.lit(lexicon.FINDING_STATUS_OPEN).alias("status"),
        F.date_trunc("second", "found_at").alias("created_at"),
    )


COMPANY_VALUES = ("name", "legal_name", "nif", "address", "registry_verified", "note",
                  "nameservers_json")


def upsert_companies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The company table after a batch of (website_id, values..., written_at).

    One row per website: all fields are overwritten, NULLs too; id and creation
    time stay.  The last write of a batch wins; website 0 is ignored.
    """
    latest = incoming.where("website_id <> 0").groupBy("website_id").agg(
        F.max_by(F.struct(*COMPANY_VALUES, "written_at"),
                 F.struct("written_at", *COMPANY_VALUES)).alias("n"))
    ids = dense_ids(
        latest.select("website_id").join(existing, "website_id", "left_anti"),
        ["website_id"], "new_id", _last_id(existing, "company_id"))
    merged = existing.select("website_id", F.struct(*existing.columns).alias("o")).join(
        latest, "website_id", "full_outer").join(ids, "website_id", "left")
    time = F.date_trunc("second", "n.written_at")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(
        F.col(f"o.{c}")).alias(c)
    return merged.select(
        F.coalesce("o.company_id", "new_id").alias("company_id"), "website_id",
        *[pick(c) for c in COMPANY_VALUES],
        F.coalesce("o.created_at", time).alias("created_at"),
        F.coalesce(time, F.col("o.updated_at")).alias("updated_at"),
    )


# Columns that must hold a value, by table.
REQUIRED = {
    "website": ("url", "domain", "created_at"),
    "run": ("website_id", "started_at", "status"),
    "finding": ("scan_run_id", "rule_id", "description", "recommendation", "evidence_json", "status",
                "created_at"),
    "company": ("website_id", "name", "created_at", "updated_at"),
}


# What a table's rows are to others. (role, name, key column): a ``parent`` offers its key,
# a ``child`` needs it (constraint name, parent table), a ``unique`` key stands once.
_KEYS = {
    "website": [("parent", "website", "website_id"), ("unique", "unique_website_url", "url")],
    "run": [("parent", "run", "scan_run_id"), ("child", ("run_website", "website"), "website_id")],
    "finding": [("child", ("finding_run", "run"), "scan_run_id")],
    "company": [("child", ("company_website", "website"), "website_id"),
                ("unique", "unique_company_website", "website_id")],
}
_ENTRY = "array<struct<name:string,space:string,role:string,key:string,own:string>>"
KNOWN_KEYS = 1 << 20  # up to so many keys without a parent are broadcast


def _entries(df: DataFrame, table: str) -> DataFrame:
    """All that the constraints ask of a table, from one reading of it: broken row constraints as they
    are, and an entry for every key it offers, needs or must not repeat."""
    own = f"CAST({dict(run='scan_run_id').get(table, f'{table}_id')} AS string)"

    def entry(condition, name, role, space="NULL", key="NULL"):
        return (f"CASE WHEN {condition} THEN named_struct('name', '{name}', 'space', {space}, 'role', '{role}', "
                f"'key', CAST({key} AS string), 'own', {own}) END")
    parts = [entry(" OR ".join(f"{c} IS NULL" for c in REQUIRED[table]), f"{table}_not_null", "broken")]
    if table == "run":
        known = ", ".join(f"'{status}'" for status in lexicon.SCAN_STATUSES)
        parts.append(entry(f"status NOT IN ({known})", "scan_status", "broken"))
    for role, name, column in _KEYS[table]:
        if role == "child":  # a missing key refers to nothing
            name, space = name
            parts.append(entry(f"{column} IS NULL", name, "broken"))
        else:
            space = name
        parts.append(entry(f"{column} IS NOT NULL", name, role, f"'{space}'", column))
    return df.select(F.inline(F.expr(f"filter(CAST(array({', '.join(parts)}) AS {_ENTRY}), x -> x IS NOT NULL)")))


def violations(websites: DataFrame, runs: DataFrame, findings: DataFrame,
               companies: DataFrame) -> DataFrame:
    """Rows breaking a constraint, as (constraint_name, key).

    A missing key is a missing value and refers to nothing; it repeats nothing. Every table is read
    once; references and repetitions are one aggregate over the keys of all tables, and only the rows
    whose key has no parent are looked up again, in the written entries.
    """
    tables = {"website": websites, "run": runs, "finding": findings, "company": companies}
    entries = materialize(reduce(DataFrame.unionByName, (
        _entries(df, table) for table, df in tables.items())), "constraint-entries")
    keys = materialize(entries.where("role <> 'broken'").groupBy("space", "key").agg(
        *[F.count_if(F.col("role") == role).alias(role) for role in ("parent", "child", "unique")]
    ).where("unique > 1 OR (child > 0 AND parent = 0)"), "constraint-keys")
    lost = keys.where("child > 0 AND parent = 0").select("space", "key")
    children = entries.where("role = 'child'")
    orphans = children.join(F.broadcast(lost) if lost.count() <= KNOWN_KEYS else lost, ["space", "key"], "left_semi")
    named = lambda df, name, key: df.select(
        F.col(name).alias("constraint_name"), F.col(key).alias("key"))
    return named(entries.where("role = 'broken'"), "name", "own").unionByName(
        named(orphans, "name", "own")).unionByName(named(keys.where("unique > 1"), "space", "key"))


def published(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of runs whose result was published: findings are written first,
    the Completed status last, and readers only see completed runs."""
    done = runs.where("status = 'Completed'").select("scan_run_id")
    return findings.join(done, "scan_run_id", "left_semi")
