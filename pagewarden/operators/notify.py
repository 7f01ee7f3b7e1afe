"""Notification rows: one per finding."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon, schemas
from pagewarden.functions import urls
from pagewarden.operators.reporting import _case
from pagewarden.operators.scale import dense_ids


def category(rule_id: str) -> str:
    return _case(rule_id, lexicon.RULE_TO_CATEGORY, lexicon.CATEGORY_OTHER)


def level(severity: str) -> str:
    return _case(f"lower({severity})", lexicon.SEVERITY_LEVELS, lexicon.SEVERITY_LEVEL_OTHER)


def notifications(findings: DataFrame, client_id: int = lexicon.FEED_CLIENT_ID,
                  device_id: int = lexicon.FEED_DEVICE_ID,
                  audit_type: str = lexicon.FEED_AUDIT_TYPE,
                  enabled: bool = True, keep=()) -> DataFrame:
    """Feed records of finding rows (url, rule_id, severity, description)."""
    rows = findings if enabled else findings.where(F.lit(False))
    return rows.select(
        F.lit(client_id).cast("int").alias("client_id"),
        F.lit(device_id).cast("int").alias("device_id"),
        F.expr(urls.remote_address("url", lexicon.REMOTE_ADDRESS_LENGTH)).alias("remote_address"),
        F.lit(None).cast("string").alias("device_name"),
        F.expr(category("rule_id")).alias("category"),
        F.expr(category("rule_id")).alias("notification_key"),
        F.expr(level("severity")).alias("level"),
        F.lit(None).cast("timestamp").alias("log_timestamp"),
        F.concat("url", F.lit(" — "), "description").alias("description"),
        F.lit(audit_type).alias("type"), *keep,
    )


FEED_COLUMNS = tuple(part.split()[0] for part in schemas.NOTIFICATIONS.split(", "))


def feed(findings: DataFrame, key_columns, created_at: str, base: int = 0, **options) -> DataFrame:
    """The whole feed table: notifications with their id and time, and the finding's key.

    Findings are numbered by their unique key, so the same findings get the same ids.
    """
    keyed = notifications(findings, keep=(*key_columns, created_at), **options)
    numbered = dense_ids(keyed, key_columns, "notification_id", base)
    return numbered.withColumn("created_at", F.col(created_at).cast("timestamp")).select(
        *FEED_COLUMNS, *key_columns)
