"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. One level of parsing collapses runs of one
symbol, tosses deterministic coins (a symbol's label becomes the lowest bit in which
it differs from its left neighbour, and that bit's value, until at most six labels are
left), starts a phrase at every local maximum of the labels, and names a phrase by a
hash of its symbols. The names are the symbols of the next level. Where a phrase
begins depends on a few symbols around it and never on its offset, so equal substrings
get equal phrases but for a bounded margin at either end.

The fingerprint is a min-hash sketch over the sets of names of the lower levels: the names of a level
are dealt to the slots of that level by their hash, and each slot keeps 16 bits of its smallest. The
likeness of two fingerprints is the share of equal slots among those that either uses, an
estimate of the Jaccard likeness of the name sets, each level weighing by its slots. All texts
are sketched alike, whatever their length: short ones merely leave slots of the higher levels unused.
"""

import hashlib
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewarden.llm.common import map_batches, spread

LEVEL_SLOTS = (12, 26, 26)  # slots of the names of levels 1, 2, 3
SLOTS = sum(LEVEL_SLOTS)
TOSSES = 4  # 64 bit -> 128 -> 14 -> 8 -> 6 labels
ROWS_PER_TASK = 2000
CHUNK_CHARS = 1 << 17

_U = np.uint64
# Multipliers of a common 64-bit mixing function.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = _U(0x9E3779B97F4A7C15)
_NONE = 0xFFFF  # a slot without a name
EMPTY = "ffff" * SLOTS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; ``first`` marks the first symbol of each text."""
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = labels[first] ^ labels.dtype.type(1)  # no neighbour: differs in bit 0
    low = labels ^ left
    low &= ~low + labels.dtype.type(1)
    place = np.bitwise_count(low - labels.dtype.type(1)).astype(np.uint8)
    bit = (labels & low) != 0
    return place * np.uint8(2) + bit


def level(names: np.ndarray, owner: np.ndarray) -> tuple:
    """Names of the phrases of every text, and the text each belongs to."""
    n = len(names)
    new = np.ones(n, bool)  # runs of one symbol become one symbol with its length
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n)).astype(_U)
    owner = owner[at]
    names = names[at]
    long = np.flatnonzero(run > 1)
    names[long] = mix(names[long] + run[long] * _STEP)
    first = np.ones(len(at), bool)
    first[1:] = owner[1:] != owner[:-1]
    heads = np.flatnonzero(first)
    labels = names.astype(np.uint32)  # neighbours that agree in these bits just tie
    for _ in range(TOSSES):
        labels = toss(labels, heads)
    start = first.copy()
    if len(at) > 2:
        top = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        start[1:-1] |= top & ~first[2:]
    begin = np.flatnonzero(start)
    # A phrase's name is a polynomial hash: symbols weighted by their place in it.
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    weighted = mix(names * _M2 + (place.astype(_U) + _U(1)) * _STEP)
    return mix(np.add.reduceat(weighted, begin)), owner[begin]


def sketches(texts: list) -> list:
    """Fingerprints of whole texts: 4 hex digits for each slot."""
    out = [EMPTY] * len(texts)
    group, size = [], 0
    for i, text in enumerate(texts):
        if text:
            group.append(i)
            size += len(text)
        if group and (size >= CHUNK_CHARS or i + 1 == len(texts)):
            _sketch_group([texts[k] for k in group], group, out)
            group, size = [], 0
    if group:
        _sketch_group([texts[k] for k in group], group, out)
    return out


def _sketch_group(texts: list, places: list, out: list) -> None:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    names = points.astype(_U)
    minima = np.full(len(texts) * SLOTS, ~_U(0))
    before = 0
    for depth, width in enumerate(LEVEL_SLOTS, 1):
        names, owner = level(names, owner)
        salted = mix(names + _U(depth))
        slot = (salted % _U(width)).astype(np.int64) + before + owner.astype(np.int64) * SLOTS
        np.minimum.at(minima, slot, salted)
        before += width
    kept = np.where(minima == ~_U(0), _U(_NONE), (minima >> _U(40)) % _U(_NONE))
    kept = kept.astype(">u2").tobytes().hex()
    for k, place in enumerate(places):
        out[place] = kept[k * 4 * SLOTS: (k + 1) * 4 * SLOTS]


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness, 0 to 1. An empty text is like an empty text only."""
    if a == b:
        return 1.0
    x = np.frombuffer(bytes.fromhex(a), ">u2")
    y = np.frombuffer(bytes.fromhex(b), ">u2")
    used = (x != _NONE) | (y != _NONE)
    return float(np.mean((x == y)[used]))


def fingerprints(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """Per row the fingerprint of the whole text; null counts as empty."""
    kind = dict(docs.dtypes)[id_column]
    return map_batches(
        docs.select(id_column, text),
        lambda: lambda keys, texts: (keys, sketches([t or "" for t in texts])),
        f"`{id_column}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_following(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """Rows (range, own, key, h, body) in partitions sorted so that every row stands right
    before the one that follows it in the whole table by (id, text hash).

    The id axis is cut at quantiles into ranges, each of which is
    sorted with spilling and streamed, never held. The first row of a range is also
    sent, marked as not its own, to the end of the range before it (the very first row
    to the last range). So the texts are shuffled once and there is no window over the
    whole table. Null ids come first. From ROWS_PER_TASK squared rows on, ranges and rows of a
    range grow alike, with the square root of the table; the driver holds one id for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("body"))
    n = docs.count()
    ranges = spread(n, max(ROWS_PER_TASK, isqrt(n)), spark)
    cuts = np.array(sorted({int(c) for c in rows.stat.approxQuantile(
        "key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}), np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        """Number of cuts at or below a key."""
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), "right").astype(np.int32))
    lowest = F.coalesce("key", F.expr("-9223372036854775808L"))  # nulls would make the keys floats
    rows = rows.withColumn("range", range_of(lowest)).withColumn("h", F.xxhash64("body"))
    order = F.struct(F.col("key").isNotNull().alias("filled"), "key", "h")
    firsts = sorted((r["range"], r["m"]["key"], r["m"]["h"]) for r in
                    rows.groupBy("range").agg(F.min(order).alias("m")).collect())
    marks = spark.createDataFrame(  # a row for each range; the first follows the last
        [(*first, firsts[i - 1][0]) for i, first in enumerate(firsts)],
        "at int, first_key bigint, first_h bigint, to int")
    own = F.struct("range", F.lit(True).alias("own"))
    copy = F.struct(F.col("to").alias("range"), F.lit(False).alias("own"))
    sent = rows.join(
        F.broadcast(marks),
        (F.col("range") == F.col("at")) & F.col("key").eqNullSafe(F.col("first_key"))
        & (F.col("h") == F.col("first_h")), "left",
    ).select("key", "h", "body", F.explode(
        F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("place"))
    return sent.select("place.range", "place.own", "key", "h", "body").repartition(
        ranges, "range").sortWithinPartitions(
            "range", F.desc("own"), F.col("key").asc_nulls_first(), "h")


def edit_likeness(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text (see ``edited``; the following
    row is the next by id, after the last the first), and how alike its fingerprint is
    to that one and to the following row's.

    Ids are integers. Null texts count as empty, null ids come first, rows of one id are
    ordered by a hash of their text, equal rows follow each other; a single row follows
    itself. An empty table gives no rows.
    """
    def run(batches):
        held = None  # (range, key, text, fingerprint) still without its following row
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            prints = sketches([r[4] for r in rows])
            pairs = []
            for (place, own, key, _, body), mark in zip(rows, prints):
                if held and held[0] == place:
                    pairs.append((*held[1:], body, mark))
                held = (place, key, body, mark) if own else None
            changed = [edited(p[1], p[3]) for p in pairs]
            marks = sketches(changed)
            yield pa.RecordBatch.from_pylist([{
                id_column: key, "n_chars": len(body),
                "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": mark, "edited_fingerprint": new_mark,
                "near_edited": likeness(mark, new_mark), "near_next": likeness(mark, next_mark),
            } for (key, body, mark, _, next_mark), new, new_mark in zip(pairs, changed, marks)],
                schema=arrow)

    arrow = pa.schema([(id_column, pa.int64()), ("n_chars", pa.int64())]
                      + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
                      + [(c, pa.float64()) for c in ("near_edited", "near_next")])
    return with_following(docs, id_column, text).mapInArrow(
        run, f"`{id_column}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
