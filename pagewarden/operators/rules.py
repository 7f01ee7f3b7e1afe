"""The rules as one pass over the site table.

Every rule is an expression giving the list of its evidences for a site (an
empty list: it does not fire).  All lists of a site are concatenated in
emission order inside the row, looked up in the catalogue, and exploded only
when findings are wanted as rows.
"""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden import lexicon
from pagewarden.functions import text as tx
from pagewarden.operators import cookies as ck
from pagewarden.sources.catalogue import default_rules, rules_frame, validated

NO_EVIDENCE = "CAST(array() AS array<string>)"


def _evidence(rule_id: str, *fields) -> str:
    """Evidence as JSON text: the message plus typed fields, NULLs kept."""
    pairs = [("message", tx.quoted(lexicon.RULE_MESSAGES[rule_id])), *fields]
    body = ", ".join(f"'{name}', {value}" for name, value in pairs)
    return f"to_json(named_struct({body}), map('ignoreNullFields', 'false'))"


def _once(condition: str, evidence: str) -> str:
    return f"CASE WHEN {condition} THEN array({evidence}) ELSE {NO_EVIDENCE} END"


def _tracking_without_banner(rule_id: str) -> str:
    c = tx.fresh("c")
    return _once(
        f"NOT consent_banner_detected AND exists(cookies, {c} -> {ck.is_tracking(c)})",
        _evidence(rule_id),
    )


def _analytics_scripts() -> str:
    s, x = tx.fresh("s"), tx.fresh("x")
    hits = (f"filter(third_party_scripts, {s} -> "
            f"{tx.contains_any(f'{s}.src', lexicon.ANALYTICS_SRC_MARKERS)})")
    return f"transform({hits}, {x} -> {_evidence('R03', ('script', f'{x}.src'))})"


def _insecure_cookies() -> str:
    return tx.let(
        ck.insecure_names("cookies"),
        lambda n: _once(f"size({n}) > 0", _evidence("R04", ("cookies", n))),
    )


def _missing_policy() -> str:
    return _once("privacy_policy_url IS NULL",
                 _evidence("R05", ("privacy_policy_url", "CAST(NULL AS string)")))


def _missing_element(rule_id: str, flag: str, shown_as: str = None) -> str:
    return _once(
        "privacy_policy_url IS NOT NULL AND NOT policy_unreachable "
        f"AND NOT coalesce(policy_flags.{flag}, false)",
        _evidence(rule_id, ("flag", f"'{shown_as or flag}'"), ("value", "false")),
    )


def _unreachable_policy() -> str:
    return _once("privacy_policy_url IS NOT NULL AND policy_unreachable",
                 _evidence("R12", ("privacy_policy_url", "privacy_policy_url")))


def has_personal_field(fields: str, patterns=lexicon.PERSONAL_FIELD_PATTERNS) -> str:
    n = tx.fresh("n")
    hit = tx.let(f"lower({n})", lambda low: tx.contains_any(low, patterns))
    return f"exists({fields}, {n} -> {hit})"


def _forms_without_notice() -> str:
    f, g = tx.fresh("f"), tx.fresh("g")
    found = (f"transform(filter(forms, {f} -> NOT {f}.has_nearby_privacy_notice "
             f"AND {has_personal_field(f'{f}.fields')}), "
             f"{g} -> named_struct('action', {g}.action, 'fields', {g}.fields))")
    return tx.let(
        found, lambda x: _once(f"size({x}) > 0", _evidence("R11", ("forms", x))))


# Rule id -> expression, in emission order.  To add a rule, register its
# expression here and its text in the catalogue.
RULE_LOGIC = {
    "R01": lambda: _tracking_without_banner("R01"),
    "R02": lambda: _tracking_without_banner("R02"),
    "R03": _analytics_scripts,
    "R04": _insecure_cookies,
    "R05": _missing_policy,
    "R06": lambda: _missing_element("R06", "right_access"),
    "R07": lambda: _missing_element("R07", "right_erasure"),
    "R08": lambda: _missing_element("R08", "international_transfers"),
    "R09": lambda: _missing_element("R09", "dpo_contact", "mentions_dpo"),
    "R10": lambda: _missing_element("R10", "retention_period"),
    "R12": _unreachable_policy,
    "R11": _forms_without_notice,
}
POLICY_RULES = ("R06", "R07", "R08", "R09", "R10", "R12")


def _catalogue_map(rules: list) -> str:
    """The catalogue as a constant: rule id -> severity, description, advice."""
    entries = {}
    for rule in rules:
        entries.setdefault(rule["id"], {
            k: rule[k] for k in ("severity", "description", "recommendation")
        })
    text = json.dumps(entries).replace("'", chr(92) + "u0027")
    return (f"from_json(r'{text}', 'map<string,struct<severity:string,"
            "description:string,recommendation:string>>')")


def evaluate(sites: DataFrame, rules: list = None, only=None) -> DataFrame:
    """Adds ``findings``: the findings of a site in emission order.

    A rule yields findings only if the catalogue has its id.
    """
    catalogue = validated(default_rules() if rules is None else rules)
    known = {r["id"] for r in catalogue}
    wanted = [r for r in RULE_LOGIC if r in known and (only is None or r in only)]
    v, x, i = tx.fresh("v"), tx.fresh("x"), tx.fresh("i")
    lists = [
        f"transform({RULE_LOGIC[rule]()}, {v} -> named_struct("
        f"'rule_id', '{rule}', 'evidence', {v}))"
        for rule in wanted
    ]
    if not lists:
        fired = "CAST(array() AS array<struct<rule_id:string,evidence:string>>)"
    else:
        fired = f"flatten(array({', '.join(lists)}))"
    rule = tx.fresh("rule")
    described = (
        f"transform(fired, ({x}, {i}) -> get(transform(array("
        f"try_element_at({_catalogue_map(catalogue)}, {x}.rule_id)), {rule} -> "
        f"named_struct('seq', {i}, 'rule_id', {x}.rule_id, 'severity', {rule}.severity, "
        f"'description', {rule}.description, 'recommendation', {rule}.recommendation, "
        f"'evidence', {x}.evidence)), 0))"
    )
    return sites.withColumn("fired", F.expr(fired)).withColumn(
        "findings", F.expr(tx.fenced(described))
    ).drop("fired")


def finding_rows(evaluated: DataFrame, *keys: str) -> DataFrame:
    return evaluated.select(*keys, F.inline("findings"))


def catalogue_coverage(spark: SparkSession, used: DataFrame, rules: list = None) -> DataFrame:
    """Rule ids on one side only: ``no_rule`` (used, not in the catalogue) and
    ``no_logic`` (in the catalogue, without an expression)."""
    catalogue = rules_frame(spark, rules).select(F.col("id").alias("rule_id"))
    logic = spark.createDataFrame([(r,) for r in RULE_LOGIC], "rule_id string")
    dead = catalogue.join(logic, "rule_id", "left_anti").withColumn("side", F.lit("no_logic"))
    unknown = used.select("rule_id").distinct().join(
        F.broadcast(catalogue), "rule_id", "left_anti"
    ).withColumn("side", F.lit("no_rule"))
    return unknown.unionByName(dead)
