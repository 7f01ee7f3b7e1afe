"""URL filter: rules first, then the ratio of two character language models.

One smoothed variable-order Markov model is trained on accepted URLs, one on rejected ones.
A URL's score is its mean log-likelihood difference per character; the cut is set
where the balanced error over all training URLs is smallest.

A model mixes orders 0 to 3 (Witten-Bell weights: each context trusts its own counts as
far as it has seen them). Characters are folded to an alphabet of K symbols, so all
there is to a model are the counts of K ** 4 four-letter groups: they are summed over
all URLs by one aggregation, and the table sent to the tasks has K ** 4 cells, however
large the crawl.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pagewarden.llm.common import map_batches

# Folded alphabet; all other characters share the last symbol but one,
# the last stands before the beginning.
LETTERS = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:+"
K = len(LETTERS) + 2
ORDER = 4
SCALE = 100  # histogram cells per unit of score
LIMIT = 20.0

# Words of hosts and paths whose URLs teach the rejecting model.
REJECT_WORDS = ("ad ads adult adserver affiliate bet bets betting casino cheap clickbait dating "
                "escort gambling jackpot keygen loan loans lottery pills poker porn sex slots spam "
                "tracker tracking track viagra warez win xxx").split()

_FOLD = {c: i for i, c in enumerate(LETTERS)} | {str(d): LETTERS.index("0") for d in range(10)}


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                      F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict) -> Column:
    """The longest rule whose host is the host or a parent domain and whose path begins the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(url: str) -> np.ndarray:
    """Codes of the four-letter groups that end at each character."""
    text = url.split("://", 1)[-1].lower()
    other = K - 2
    codes = np.array([K - 1] * (ORDER - 1) + [_FOLD.get(c, other) for c in text] + [K - 1], np.int64)
    out = codes[ORDER - 1:].copy()
    for back in range(1, ORDER):
        out += codes[ORDER - 1 - back: len(codes) - back] * K ** back
    return out


def gram_counts(urls: DataFrame, url="url", label="label") -> DataFrame:
    """(label, code, n) over all rows; null URLs count nothing."""
    def each(labels, texts):
        sums = {}
        for y in set(labels):
            codes = [grams(t) for t, z in zip(texts, labels) if z == y and t is not None]
            if codes:
                sums[y] = np.unique(np.concatenate(codes), return_counts=True)
        ys = [y for y, (c, _) in sums.items() for _ in range(len(c))]
        return (ys, [int(c) for cs, _ in sums.values() for c in cs],
                [int(n) for _, ns in sums.values() for n in ns])
    return map_batches(urls.select(label, url), lambda: each, "label int, code int, n bigint") \
        .groupBy("label", "code").agg(F.sum("n").alias("n"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the last letter of each group given the others, all orders mixed."""
    p = np.full(K, 1.0 / K)
    for order in range(1, ORDER + 1):
        n = counts.reshape(-1, K ** order).sum(axis=0).reshape(-1, K)
        seen, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        below = np.tile(p.reshape(-1, K), (len(n) // p.reshape(-1, K).shape[0], 1))
        weight = np.maximum(seen + kinds, 1)
        p = np.where(seen > 0, (n + kinds * below) / weight, below).ravel()
    return np.log(p)


def train(urls: DataFrame, url="url", label="label"):
    """(table of differences, cut) from rows labelled 1 (accepted) or 0 (rejected).

    With only one kind of row there is no ratio: (None, None).
    """
    cells = {0: np.zeros(K ** ORDER), 1: np.zeros(K ** ORDER)}
    for r in gram_counts(urls, url, label).toLocalIterator():  # at most 2 * K ** 4 rows
        cells[r["label"]][r["code"]] = r["n"]
    if not cells[0].any() or not cells[1].any():
        return None, None
    table = (log_model(cells[1]) - log_model(cells[0])).astype(np.float32)
    labelled = scored(urls.where(F.col(url).isNotNull()), table, url, [label])
    histogram = labelled.groupBy(label, F.round(F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.col("score"))) * SCALE).cast("int").alias("cell")).count().collect()
    span = int(LIMIT * SCALE)
    tally = np.zeros((2, 2 * span + 1))
    for r in histogram:
        tally[r[label], r["cell"] + span] += r["count"]
    share = tally / tally.sum(axis=1, keepdims=True)
    # Cutting below cell k rejects everything under it.
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(share, axis=1)], axis=1)
    error = below[1] + 1 - below[0]
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return table, (int(best[len(best) // 2]) - span - 0.5) / SCALE


def scored(urls: DataFrame, table: np.ndarray, url: str, keep: list) -> DataFrame:
    """The kept columns and the length-normalised difference of every URL (null: 0)."""
    sent = urls.sparkSession.sparkContext.broadcast(table)

    def make():
        def each(texts, *kept):
            return (*kept, [0.0 if t is None else float(sent.value[grams(t)].mean()) for t in texts])
        return each
    kinds = dict(urls.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_batches(urls.select(url, *keep), make, f"{schema}, score double")


def judge(pages: DataFrame, rules: dict, id_column="page_id", url="url") -> DataFrame:
    """Per row: id, host, path, rule, score, verdict.

    Null URLs and ones without :// have an empty host and path; they can fit no rule, and the model
    judges what text they have (a null URL is allowed). Rows repeat as they are.
    """
    words = F.split(F.lower(F.col(url)), "[^a-z]+")
    labelled = pages.where(F.col(url).isNotNull()).select(F.col(url), F.when(F.arrays_overlap(
        words, F.array(*[F.lit(w) for w in REJECT_WORDS])), 0).otherwise(1).alias("label"))
    table, cut = train(labelled, url)
    if table is None:
        out = pages.select(id_column, url, F.lit(0.0).alias("score"))
        cut = -LIMIT
    else:
        out = scored(pages, table, url, [id_column, url])
    host, path = host_of(F.col(url)), path_of(F.col(url))
    out = out.select(id_column, host.alias("host"), path.alias("path"), "score",
                     F.col(url).isNull().alias("_none"))
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("_none") | (F.col("score") >= cut), "allow").otherwise("block")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return out.select(id_column, "host", "path", "rule", "score", verdict.alias("verdict"))
