"""Language of texts by letter trigrams that are counted from labelled texts.

The vote of ``functions.language`` needs no data and works inside a row; this model is trained on a table
whose languages are known and judges texts in few stop words as well. Scores are whole numbers,
so a result does not depend on the order of any sum.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import text as tx
from pagewarden.operators.scale import materialize

SCALE = 1000  # thousandths of a natural logarithm
# Words of at least this share of all words are scored beforehand: there are at most 1 / share of them. Others are
# scored by their trigrams, with the same result.
FREQUENT = 200_000
MAX_BROADCAST_GRAMS = 500_000  # more trigrams than this are joined by a shuffle


@dataclass
class Trigrams:
    """``gains``: (gram, g0, g1, ..): how much more than an unseen trigram each language gives, ``kinds`` rows;
    ``frequent``: (word, w0, w1, ..): the sums over the trigrams of frequent words; ``unseen``
    is (language, score of an unseen trigram) in the order of the columns, one for each language."""

    gains: DataFrame
    kinds: int
    frequent: DataFrame
    unseen: list


def _words(texts: DataFrame, text: str, *keep) -> DataFrame:
    """One row for each word; a text without any has one row with a null word."""
    words = f"filter(split(lower({text}), {tx.pattern(r'[^\p{L}]+')}), w -> w <> '')"
    return texts.select(*keep, F.explode_outer(F.expr(words)).alias("word"))


_PADDED = "transform(sequence(1, length(word)), i -> substr(concat(' ', word, ' '), i, 3))"


def _grams(words: DataFrame, *keep) -> DataFrame:
    """Trigrams of words with a blank at both ends, as many as the word has letters."""
    return words.where("word IS NOT NULL").select(*keep, F.explode(F.expr(_PADDED)).alias("gram"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Trigrams:
    """Counts all labelled texts; rows without language or text teach nothing.

    Words are counted first, so trigrams are taken once of each different word. One number for each
    language comes to the driver.
    """
    given = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    words = materialize(_words(given, "text", "lang").where("word IS NOT NULL").groupBy("lang", "word").agg(
        F.count("*").alias("n")), "words")
    counts = materialize(_grams(words, "lang", "n").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kinds = counts.select("gram").distinct().count()

    def score(n: str, total: int) -> str:
        return f"CAST(floor({SCALE} * ln(CAST({n} + 1 AS double) / CAST({total + kinds} AS double))) AS bigint)"

    gains = [F.sum(F.when(F.col("lang") == lang, F.expr(f"{score('n', total)} - {score('0', total)}"))).alias(f"g{i}")
             for i, (lang, total) in enumerate(sorted(totals.items()))]
    # The same logarithm as above, taken by the same engine.
    unseen = counts.sparkSession.range(1).selectExpr(
        *[f"{score('0', total)} AS u{i}" for i, (_, total) in enumerate(sorted(totals.items()))]).first()
    wide = materialize(counts.groupBy("gram").agg(*gains) if gains else counts.select("gram"), "trigram-gains")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * FREQUENT >= total)
    frequent = _grams(common, "word").join(wide, "gram").groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(f"g{i}", F.lit(0))).alias(f"w{i}") for i in range(len(gains))])
    return Trigrams(wide, kinds, materialize(frequent.drop("n"), "frequent-words"), list(zip(sorted(totals), unseen or ())))


def judge(texts: DataFrame, model: Trigrams, id_column: str, text: str = "text") -> DataFrame:
    """(id, language); rows of one id are judged together.

    ``unknown`` are texts that are null, under 50 characters or without a letter, and all texts if nothing was learnt.
    Of equal scores the smaller code wins. A text is read once and never shuffled: frequent words meet their scores
    in a bounded broadcast, trigrams of the others theirs; what is shuffled is one row of sums a text and task.
    """
    unknown = F.lit(lexicon.LANGUAGE_UNKNOWN)
    long = F.expr(f"coalesce(length({tx.strip('_text')}) >= {lexicon.LANGUAGE_MIN_CHARS}, false)")
    given = texts.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).withColumn("long", long)
    if not model.unseen:
        return given.select(F.col("_id").alias(id_column), unknown.alias("language")).distinct()
    places = range(len(model.unseen))
    words = _words(given, "_text", "_id", "long").join(F.broadcast(model.frequent), "word", "left")
    rare = F.when(F.col("w0").isNull(), F.expr(_PADDED))  # null for a null word too
    grams = words.select("_id", "long", "word", *[f"w{i}" for i in places], F.explode_outer(rare).alias("gram"))
    gains = model.gains
    if model.kinds <= MAX_BROADCAST_GRAMS:
        gains = F.broadcast(gains)
    else:  # rows without a trigram meet none, wherever they go
        grams = grams.withColumn("gram", F.coalesce("gram", F.concat(F.lit("none "), F.xxhash64("_id").cast("string"))))
    size = F.when(F.col("w0").isNull(), F.when(F.col("word").isNotNull(), 1)).otherwise(F.length("word"))
    sums = grams.join(gains, "gram", "left").groupBy("_id").agg(
        F.bool_or("long").alias("long"), F.sum(size).alias("grams"),
        *[F.sum(F.coalesce(f"w{i}", f"g{i}", F.lit(0))).alias(f"s{i}") for i in places])
    best = "array_min(array(" + ", ".join(
        f"named_struct('cost', -(s{i} + {unseen} * grams), 'lang', {tx.quoted(lang)})"
        for i, (lang, unseen) in enumerate(model.unseen)) + ")).lang"
    return sums.select(F.col("_id").alias(id_column), F.when(
        F.col("long") & F.col("grams").isNotNull(), F.expr(best)).otherwise(unknown).alias("language"))
