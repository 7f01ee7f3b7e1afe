"""Benchmark passages in documents, re-parameterised ones included.

Both sides are brought to two canonical forms: numbers, names and units behind numbers
become typed placeholders, the rest is lower-cased words. In the first form capitalised words inside
a sentence are names, so a passage may begin in the midst of one; in the second all capitalised words
are, so names at the start of a sentence may change too. Windows of WINDOW canonical words are
hash-joined, each form with its own. A document that holds enough of an item's distinct windows of a
form is a candidate: MIN_COVER of them or, of items of SOME_WINDOWS or more, all that one changed word
leaves (at least HALF). The slots of the item are then
laid against those of the document at the commonest offset, and a leak must replace
each slot value by one value only, and no two by the same (MIN_CONSISTENT of the
aligned slots).

Everything is an expression of the engine: no Python runs on the executors.
"""

from pyspark.sql import DataFrame, Window, functions as F

from pagewarden.llm.common import materialize

WINDOW = 5
MIN_COVER = 0.8
SOME_WINDOWS, HALF = 10, 0.5
MIN_CONSISTENT = 0.8
BROADCAST_WINDOWS = 1_000_000  # 24 bytes each; above this the windows are shuffled

# Units that follow a number.
UNITS = ("kg|g|mg|lb|oz|km|m|cm|mm|mi|ft|in|l|ml|h|min|s|ms|kb|mb|gb|tb|hz|kw|kwh|w|v|a|"
         "percent|dollars|euros|cents|years|months|weeks|days|hours|minutes|seconds|"
         "meters|metres|miles|feet|inches|pounds|grams|liters|litres")
# Each starts with the character it needs and looks back from there, so most places fail at once.
NAME = r"\p{Lu}(?<=[\p{L},;] \p{Lu})\p{Ll}++(?: \p{Lu}\p{Ll}++)*+(?![\p{L}\p{N}])"
ANY_NAME = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}++(?: \p{Lu}\p{Ll}++)*+(?![\p{L}\p{N}])"
FORMS = (NAME, ANY_NAME)
NUMBER = r"([0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?:[.,][0-9]++)*+)(?![\p{L}\p{N}])"
UNIT = rf"(#n(?:⟦[^⟧]*⟧)? ?)((?i:{UNITS})|[%$€£])(?![\p{{L}}\p{{N}}])"
GAP = r"[^\p{L}\p{N}#]+"


def _canonical(text, name: str):
    marked = F.replace(text, F.lit("#"), F.lit(" "))
    marked = F.regexp_replace(marked, NUMBER, "#n")
    marked = F.regexp_replace(marked, UNIT, "$1 #u")
    words = F.split(F.lower(F.regexp_replace(marked, name, "#p")), GAP)
    return F.array_remove(words, "")  # one at either end at most


def _windows(rows: DataFrame, keys: list, text: str, window: int) -> DataFrame:
    """keys, form, at, h for every window; a shorter text is one window, an empty one none.

    Words are hashed once. The explode is an outer one (an inner one would have its input
    worked out twice, for an inferred filter on its size), and a window's hash is taken behind it.
    """
    forms = [F.transform(_canonical(F.coalesce(F.col(text), F.lit("")), name), lambda w: F.xxhash64(w))
             for name in FORMS]
    rows = rows.select(*keys, F.posexplode_outer(F.array(*forms)).alias("form", "w"))
    rows = rows.select(*keys, "form", "w", F.posexplode_outer("w").alias("at", "first"))
    rows = rows.where(F.col("at").isNotNull() & (
        (F.col("at") == 0) | (F.col("at") + window <= F.size("w"))))
    rest = [F.get("w", F.col("at") + k) for k in range(1, window)]  # nulls beyond a short text
    return rows.select(*keys, "form", "at", F.xxhash64("form", "first", *rest).alias("h"))


def _slots(rows: DataFrame, keys: list, text: str) -> DataFrame:
    """keys, form, at, kind, value of every placeholder, at counted in canonical words."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[#⟦⟧]", " ")
    marked = F.regexp_replace(marked, NUMBER, "#n⟦$1⟧")
    marked = F.regexp_replace(marked, UNIT, "$1 #u⟦$2⟧")
    words = F.array(*[F.regexp_extract_all(
        F.regexp_replace(marked, name, "#p⟦$0⟧"), F.lit(r"#[npu]⟦[^⟧]*⟧|[\p{L}\p{N}]+"), F.lit(0)) for name in FORMS])
    return rows.select(*keys, F.posexplode_outer(words).alias("form", "words")).select(
        *keys, "form", F.posexplode("words").alias("at", "word")).where(
        F.col("word").startswith("#")).select(
            *keys, "form", "at", F.substring("word", 1, 2).alias("kind"),
            F.lower(F.regexp_extract("word", "⟦(.*)⟧", 1)).alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, window=WINDOW, min_cover=MIN_COVER,
          id_column="doc_id", text="text", item="item_id", item_text="text") -> DataFrame:
    """One row for each leaked item of each document: id, text_hash, item_id, n_windows (of the item),
    n_found, cover, n_slots (aligned), changed (slots with another value), all of the first form that shows it.

    Null and empty texts leak nothing and are leaked by nothing; items without an id are
    passed over; repeated rows of a document give one row; of repeated items each window
    counts once.
    """
    items = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), F.col(item_text).alias("body"))
    grams = materialize(_windows(items, ["item"], "body", window).groupBy("item", "form", "h").agg(
        F.min("at").alias("q")), "leak-windows")
    total = grams.groupBy("item", "form").agg(F.count("*").alias("n_windows"))
    lookup = F.broadcast(grams) if grams.count() <= BROADCAST_WINDOWS else grams
    mine = docs.select(F.col(id_column).alias("doc"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                       F.col(text).alias("body"))
    keys = ["doc", "text_hash"]
    found = _windows(mine, keys, "body", window).drop("form").join(lookup, "h")
    # Sums per offset first: few rows for each pair whatever the document's length.
    pairs = found.groupBy(*keys, "item", "form", "h").agg(
        F.min(F.col("at") - F.col("q")).alias("shift"))
    pairs = pairs.groupBy(*keys, "item", "form", "shift").agg(F.count("*").alias("n")).groupBy(
        *keys, "item", "form").agg(F.sum("n").alias("n_found"), F.max(F.struct(
            "n", F.negative("shift").alias("back"))).alias("best"))
    n = F.col("n_windows")
    enough = F.when(n >= SOME_WINDOWS, F.least(min_cover * n, F.greatest(n - window, HALF * n))).otherwise(min_cover * n)
    pairs = pairs.join(total, ["item", "form"]).withColumn("cover", F.col("n_found") / n) \
        .where(F.col("n_found") >= enough) \
        .select(*keys, "item", "form", "n_windows", "n_found", "cover", (-F.col("best.back")).alias("shift"))
    pairs = materialize(pairs, "leak-pairs")

    slots = materialize(_slots(items, ["item"], "body"), "leak-slots").distinct()
    asked = pairs.join(slots.select("item", "form").distinct(), ["item", "form"], "left_semi")
    asked_docs = asked.select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    texts = mine.join(asked_docs, F.col("doc").eqNullSafe(F.col("_d"))
                      & (F.col("text_hash") == F.col("_h")), "left_semi").dropDuplicates(keys)
    theirs = _slots(texts, keys, "body").select(
        F.col("doc").alias("_d"), F.col("text_hash").alias("_h"), F.col("form").alias("_form"),
        F.col("at").alias("_at"), F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    aligned = asked.join(slots, ["item", "form"]).join(
        theirs, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))
        & (F.col("form") == F.col("_form"))
        & (F.col("at") + F.col("shift") == F.col("_at")) & (F.col("kind") == F.col("_kind")))
    group = [*keys, "item", "form", "kind"]
    forth = aligned.groupBy(*group, "value", "_value").agg(F.count("*").alias("n"))
    one_way = forth.groupBy(*group, "value").agg(
        F.sum("n").alias("all"), F.max("n").alias("kept"),
        F.max_by("_value", "n").alias("to"))
    judged = one_way.groupBy(*group, "to").agg(  # no two values to the same one
        F.sum("all").alias("all"), F.max("kept").alias("kept"),
        F.sum(F.when(F.col("to") != F.col("value"), F.col("kept")).otherwise(0)).alias("changed"))
    judged = judged.groupBy(*keys, "item", "form").agg(
        F.sum("all").alias("n_slots"), F.sum("kept").alias("n_kept"),
        F.sum("changed").alias("changed"))
    judged = judged.select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"),
                           F.col("item").alias("_i"), F.col("form").alias("_f"), "n_slots", "n_kept", "changed")
    first = Window.partitionBy("doc", "text_hash", "item").orderBy("form")
    return pairs.join(judged, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))
                      & (F.col("item") == F.col("_i")) & (F.col("form") == F.col("_f")), "left").where(
        F.coalesce(F.col("n_kept") >= MIN_CONSISTENT * F.col("n_slots"), F.lit(True))).withColumn(
        "place", F.row_number().over(first)).where("place = 1").select(
        F.col("doc").alias(id_column), "text_hash", F.col("item").alias("item_id"), "n_windows",
        "n_found", "cover", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
        F.coalesce("changed", F.lit(0)).cast("bigint").alias("changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """The rows that hold no benchmark item; all columns stay."""
    bad = materialize(leaks(docs, benchmark, id_column=id_column, text=text).select(
        F.col(id_column).alias("_d"), F.col("text_hash").alias("_h")).distinct(), "leaked")
    return docs.join(bad, docs[id_column].eqNullSafe(bad["_d"]) & (
        F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_h"]), "left_anti")
