"""Boilerplate lines by the number of distinct sites they stand on.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation,
so a line that stands on a third of all pages costs one small sketch in each task.
Where the estimate is so near the threshold that its error could decide, the distinct
sites are counted exactly. Lines on at least ``min_sites`` sites are removed.

A document that consists mostly of such lines is taken for a copy of a document, not a page
with boilerplate around its own text: it is left whole for the near-duplicate step. With ``alike``
that is checked: one that has lines of its own and is like no other such document loses
the repeated lines.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagewarden.llm.common import materialize

MIN_SITES = 3
MAX_SHARE = 0.5  # above this share of repeated characters a document counts as a copy
LOG_BUCKETS = 8
STANDARD_ERROR = 1.04 / (2 ** LOG_BUCKETS) ** 0.5
SURE = 4  # standard errors beyond which an estimate decides


def _lines(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    line = docs.select(*more, F.explode(F.split(F.col(text), "\n")).alias("raw"))
    line = line.select(*[c for c in line.columns if c != "raw"], F.trim("raw").alias("raw"))
    return line.where("raw <> ''").withColumn("line", F.xxhash64("raw")).drop("raw")


def repeated_lines(docs: DataFrame, min_sites=MIN_SITES, site="source", text="text") -> DataFrame:
    """Hashes of trimmed, non-empty lines on ``min_sites`` or more distinct sites.

    Rows without a site or text add nothing.
    """
    lines = _lines(docs, text, F.col(site).cast("string").alias("site")).where(
        F.col("site").isNotNull())
    sketched = materialize(
        lines.groupBy("line").agg(F.hll_sketch_estimate(
            F.hll_sketch_agg("site", LOG_BUCKETS)).alias("sites"))
        .where(F.col("sites") >= _low(min_sites)), "line-sketches")
    near = sketched.where(F.col("sites") <= _high(min_sites)).select("line")
    exact = lines.join(near, "line").groupBy("line").agg(
        F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = sketched.where(F.col("sites") > _high(min_sites))
    return materialize(sure.select("line").union(exact.select("line")), "repeated-lines")


def _margin(min_sites: int) -> float:
    return max(1.0, SURE * STANDARD_ERROR * min_sites)


def _low(min_sites: int) -> float:
    return min_sites - _margin(min_sites)


def _high(min_sites: int) -> float:
    return min_sites + _margin(min_sites)


def without_repeated_lines(docs: DataFrame, min_sites=MIN_SITES, max_share=MAX_SHARE,
                           id_column="doc_id", site="source", text="text",
                           alike: Callable[[DataFrame], DataFrame] = None) -> DataFrame:
    """All rows and columns, and n_lines, n_removed (both bigint), clean (the text that is left).

    ``alike`` gets documents (id, text) and returns for each row its id, text_hash and root,
    equal for near duplicates.

    Empty lines stay where they are. A null text has no lines and stays null. Ids
    may be null or repeat: a row's result depends on its own text only.
    """
    bad = repeated_lines(docs, min_sites, site, text)
    own_hash = F.xxhash64(F.col(text), F.length(text))
    hits = _lines(docs, text, F.col(id_column).alias("_hit_id"), own_hash.alias("_hit_hash")) \
        .join(bad, "line").groupBy("_hit_id", "_hit_hash").agg(F.collect_set("line").alias("_bad"))
    hits = materialize(hits, "line-hits")
    # The row travels as one struct: its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), own_hash.alias("own_hash"))
    body = f"row.`{text}`"
    joined = rows.join(hits, F.col("row")[id_column].eqNullSafe(F.col("_hit_id"))
                       & (F.col("own_hash") == F.col("_hit_hash")), "left")
    parts = joined.withColumn("_all", F.split(F.expr(body), "\n")).withColumn(
        "_kept", F.expr("CASE WHEN _bad IS NULL THEN _all ELSE "
                        "filter(_all, l -> NOT array_contains(_bad, xxhash64(trim(l)))) END"))
    chars = "aggregate({}, 0L, (n, l) -> n + length(l))"
    parts = parts.withColumn(
        "_copy", F.expr(f"{chars.format('_kept')} < {1 - max_share} * {chars.format('_all')}"))
    if alike:
        parts = _checked_copies(parts, alike, id_column, text)
    return parts.select(
        *[F.col("row")[c].alias(c) for c in docs.columns],
        F.expr("coalesce(size(_all), 0)").cast("bigint").alias("n_lines"),
        F.expr("CASE WHEN _all IS NULL OR _copy THEN 0 ELSE size(_all) - size(_kept) END")
        .cast("bigint").alias("n_removed"),
        F.expr(f"CASE WHEN _bad IS NULL OR _copy THEN {body} "
               "ELSE array_join(_kept, '\n') END").alias("clean"))


def _checked_copies(parts: DataFrame, alike: Callable, id_column: str, text: str) -> DataFrame:
    """``parts`` with _copy only where no line is the document's own or another is like it."""
    mostly = materialize(parts.where("_copy").select(
        F.col("row")[id_column].alias(id_column), F.col("row")[text].alias(text),
        F.expr("exists(_kept, l -> trim(l) <> '')").alias("_own")), "mostly-repeated")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_hash")
    whole = mostly.where(~F.col("_own")).select(F.col(id_column).alias("_copy_id"), hashed)
    rooted = materialize(alike(mostly.select(id_column, text)), "repeated-alike")
    groups = rooted.groupBy("root").count().where("count > 1").select("root")
    copies = materialize(whole.union(rooted.join(groups, "root", "left_semi").select(
        id_column, "text_hash")).distinct().withColumn("_found", F.lit(True)), "repeated-copies")
    own = F.xxhash64(F.coalesce(F.col("row")[text], F.lit("")))
    return parts.join(copies, F.col("_copy") & F.col("row")[id_column].eqNullSafe(F.col("_copy_id"))
                      & (own == F.col("_text_hash")), "left").withColumn(
        "_copy", F.coalesce(F.col("_found"), F.lit(False)))
