"""Trigram language model against a plain count, and its edge cases."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import ngram_language as ng

TEXTS = {
    "pt": "Os seus dados pessoais são tratados pelo responsável e o titular tem direito de acesso aos dados.",
    "en": "Your personal data are handled by the controller and you have the right to see these data.",
    "es": "Sus datos personales son tratados por el responsable y usted tiene derecho a verlos siempre.",
}


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return Counter(f" {w} "[i:i + 3] for w in words for i in range(len(w)))


def plain_judge(labelled, text):
    counts = {}
    for lang, given in labelled:
        counts.setdefault(lang, Counter()).update(plain_grams(given))
    kinds = len(set().union(*counts.values()))
    grams = plain_grams(text)
    if len(text.strip()) < 50 or not grams:
        return "unknown"
    cost = {}
    for lang, seen in counts.items():
        size = sum(seen.values()) + kinds
        cost[lang] = -sum(n * math.floor(1000 * math.log((seen[g] + 1) / size)) for g, n in grams.items())
    return min(cost, key=lambda lang: (cost[lang], lang))


@pytest.mark.parametrize("frequent,broadcast", [(ng.FREQUENT, ng.MAX_BROADCAST_GRAMS), (20, 0), (1, 10 ** 6)])
def test_equals_a_plain_count(spark, monkeypatch, frequent, broadcast):
    monkeypatch.setattr(ng, "FREQUENT", frequent)
    monkeypatch.setattr(ng, "MAX_BROADCAST_GRAMS", broadcast)
    labelled = [*TEXTS.items(), ("en", "The controller keeps the data for one year."), ("pt", "Prazo de conservação")]
    model = ng.train(spark.createDataFrame([*labelled, (None, "nobody knows"), ("en", None)], "lang string, text string"))
    texts = {1: "O responsável trata os dados e informa o titular sobre o prazo de conservação dos dados.",
             2: "We handle data of our visitors and keep them as long as the controller needs these data.",
             3: "El responsable de los datos es la empresa y sus clientes pueden verlos en todo momento.",
             4: "zzz qqq www zzz qqq www zzz qqq www zzz qqq www zzz qqq www", 5: "short", 6: "1234 " * 20, 7: "", 8: None}
    df = spark.createDataFrame([(k, v, "clash", 0) for k, v in texts.items()], "k int, text string, word string, n int")
    got = {r.k: r.language for r in ng.judge(df, model, "k").collect()}
    assert got == {k: plain_judge(labelled, v or "") for k, v in texts.items()}
    assert [got[i] for i in (1, 2, 3, 5, 6, 7, 8)] == ["pt", "en", "es"] + ["unknown"] * 4


def test_nothing_learnt_and_nothing_to_judge(spark):
    none = spark.createDataFrame([], "lang string, text string")
    text = spark.createDataFrame([(1, TEXTS["en"])], "k int, text string")
    assert ng.judge(text, ng.train(none), "k").collect()[0].language == "unknown"
    model = ng.train(spark.createDataFrame(list(TEXTS.items()), "lang string, text string"))
    assert ng.judge(text.where("false"), model, "k").count() == 0
    assert ng.judge(text.union(text), model, "k").collect()[0].language == "en"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ng.train(documents.where("doc_id % 4 <> 0"))
    judged = ng.judge(documents, model, "doc_id").join(documents.select("doc_id", "lang", "text"), "doc_id").where(
        "doc_id % 4 = 0 AND length(trim(text)) >= 50")
    share = judged.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert share >= 0.99
