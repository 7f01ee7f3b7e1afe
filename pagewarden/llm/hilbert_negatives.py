"""Hard negatives by Hilbert-ordered blocks with zone maps.

Candidates are ordered along a Hilbert curve over all dimensions (each cut into 2 ** ``BITS`` cells
between its least and greatest value) inside their label, and cut into blocks of one label. A block is
one row of a Parquet table: its zone map (least and greatest value in each dimension), its ids and its
vectors. Anchors are ordered and cut into tiles the same way.

First only the zone maps meet the anchors. Interval arithmetic gives bounds of every anchor's scores in
every block: the sum over dimensions of the smaller, and of the larger, of the products with the two ends.
For positives a block is read if its upper bound reaches the best lower bound of a block with enough rows;
for negatives if its bounds meet one of the anchor's windows, above what blocks inside the window are sure
to give. Then only wanted blocks and tiles meet, in units of a slab (consecutive blocks) and a section
(a set of tiles): a task holds one slab and streams tiles past it, blocks in descending order of their
bound, with thresholds that rise as rows are found. No bound is a guess, so the result is exact. Where vectors
have no structure, bounds exclude little, and all anchors are compared with all rows, in blocks.

Scores are integer inner products, exact in floating point where the norms allow it, else worked out in
64-bit integers. Components are quantised to floor(256 x), at most ``LARGEST`` in size. Shorter vectors
count as filled up with zeros.

Rows with a null id, label or vector, or a null or non-finite component take no part. Repeated rows are
rows of their own; an anchor's other rows are those of other ids. Ties go to the smaller id.
"""

from collections import Counter, namedtuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagewarden.llm.common import map_batches, materialize

BITS = 4
LARGEST = 1 << 26  # squares of 2,000 components stay within 64 bits
BLOCK, TILE = 512, 256
SLAB_ROWS = 1 << 18
SECTION_TILES = 1 << 10
ANCHORS_EVERY, LABELS, RELABELLED_EVERY = 50, 10, 7
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a window, in hundredths of the positive's score
NONE = np.iinfo(np.int64).min
_ZONE = "place bigint, slab int, label bigint, n int, copies int, low array<bigint>, high array<bigint>"
_GROUP = f"{_ZONE}, ids binary, vectors binary"
Group = namedtuple("Group", [f.split()[0] for f in _GROUP.split(", ")])


def quantised(vectors: DataFrame) -> DataFrame:
    """id, label (as relabelled), q (array of bigint) of the rows that take part."""
    x = "CAST(x AS double)"
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.expr(f"CASE WHEN vec_id % {RELABELLED_EVERY} = 0 THEN (label + 1L) % {LABELS} ELSE label END")
        .cast("bigint").alias("label"), "embedding").where(
        "id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, "
        f"x -> x IS NULL OR isnan({x}) OR abs({x}) = double('infinity'))").select(
        "id", "label", F.expr(f"transform(embedding, x -> CAST(greatest(least(floor(256 * {x}), "
                              f"double({LARGEST})), double(-{LARGEST})) AS bigint))").alias("q"))


def extent(rows: DataFrame) -> tuple:
    """(number of rows, least and greatest values of the dimensions)."""
    n = rows.count()
    ends = rows.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("i").collect()
    # a vector that is shorter has a zero there
    return n, np.array([min(r["low"], 0) if r["n"] < n else r["low"] for r in ends], np.int64), \
        np.array([max(r["high"], 0) if r["n"] < n else r["high"] for r in ends], np.int64)


def matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def hilbert_keys(q: np.ndarray, low: np.ndarray, high: np.ndarray, bits=BITS) -> list:
    """Places along the Hilbert curve, as binary strings in curve order.

    The transpose form of the curve index: from the highest bit on, every axis inverts or swaps
    the lower bits of the first axis; then a Gray code over the axes.
    """
    span = np.maximum(high - low, 0).astype(float) + 1
    axes = np.clip((q - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.uint8).T.copy()
    if not len(axes):
        return [b""] * len(q)
    for b in range(bits - 1, 0, -1):
        lower = np.uint8((1 << b) - 1)
        for axis in axes:
            set_ = (axis >> b & 1).astype(bool)
            swap = np.where(set_, 0, (axes[0] ^ axis) & lower).astype(np.uint8)
            axis ^= swap
            axes[0] ^= np.where(set_, lower, swap)
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(axes.shape[1], np.uint8)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0).astype(np.uint8)
    axes ^= flip
    planes = np.concatenate([axes >> b & 1 for b in range(bits - 1, -1, -1)])
    return [r.tobytes() for r in np.packbits(planes, axis=0).T]


def grouped(rows: DataFrame, size: int, slabs: int, low: np.ndarray, high: np.ndarray, name: str) -> DataFrame:
    """Rows (id, label, q) in Hilbert order inside their label, as groups of up to ``size`` rows of one label.

    Consecutive groups are in the same of ``slabs`` slabs. Rows of one key are ordered by id, so
    many equal vectors are spread over as many groups and slabs as they need.
    """
    dims = len(low)
    keyed = map_batches(rows.select("id", "label", "q"), lambda: lambda ids, labels, q: (
        ids, labels, q, hilbert_keys(matrix(q, dims), low, high)), "id bigint, label bigint, q array<bigint>, key binary")
    order = ["label", "key", "id"]
    keyed = materialize(keyed, f"{name}-keyed")
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], _GROUP).schema)

    def cut(batches):
        part, number, label, ids, vectors = TaskContext.get().partitionId(), 0, None, [], []

        def group():
            q = matrix(vectors, dims)
            return pa.RecordBatch.from_pylist([{
                "place": part << 32 | number, "slab": part % slabs, "label": label, "n": len(ids),
                "copies": max(Counter(ids).values()),
                "low": q.min(axis=0).tolist(), "high": q.max(axis=0).tolist(),
                "ids": np.array(ids, "<i8").tobytes(), "vectors": q.astype("<i4").tobytes()}], schema=arrow)
        for batch in batches:
            for key, own, vector in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "q"))):
                if ids and (own != label or len(ids) == size):
                    yield group()
                    number, ids, vectors = number + 1, [], []
                label = own
                ids.append(key)
                vectors.append(vector)
        if ids:
            yield group()
    return materialize(keyed.repartitionByRange(slabs, *order).sortWithinPartitions(*order).mapInArrow(cut, _GROUP),
                       name)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Least and greatest possible scores (anchors x blocks), as exact integers."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(plus, low) + product(minus, high), product(plus, high) + product(minus, low)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers, by floating point where no partial sum can lose a digit."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = (np.abs(a).astype(float) ** 2).sum(axis=1).max() ** 0.5 * (np.abs(b).astype(float) ** 2).sum(axis=1).max() ** 0.5
    for kind, digits in ((np.float32, 24), (np.float64, 53)):
        if most * 1.001 < 1 << digits:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def top(rows, scores, ids, k: int) -> np.ndarray:
    """Places of the first ``k`` by (score descending, id) for every value of ``rows``."""
    order = np.lexsort((ids, -scores, rows))
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


class Best:
    """The first ``k`` found so far for each of ``n`` rows, and the score a newcomer has to reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows, scores, ids):
        if len(rows):
            rows, scores, ids = (np.concatenate(p) for p in (
                (self.rows, rows), (self.scores, scores), (self.ids, ids)))
            keep = top(rows, scores, ids, self.k)
            self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
            last = np.flatnonzero(np.bincount(self.rows, minlength=len(self.least)) == self.k)
            ends = np.searchsorted(self.rows, last, "right") - 1
            self.least[last] = np.maximum(self.least[last], self.scores[ends])


class Blocks:
    """The blocks of a slab and their zone maps as matrices (vectors are null where only zones are read)."""

    def __init__(self, groups: list):
        self.groups = groups
        self.low, self.high = (np.array([getattr(g, k) for g in groups], np.int64) for k in ("low", "high"))
        self.label, self.n, self.copies = (np.array([getattr(g, k) for g in groups]) for k in ("label", "n", "copies"))

    def rows(self, at: int) -> tuple:
        """(ids, vectors) of one block."""
        ids = np.frombuffer(self.groups[at].ids, "<i8").astype(np.int64)
        vectors = np.frombuffer(self.groups[at].vectors, "<i4")
        return ids, vectors.reshape(len(ids), self.low.shape[1]).astype(np.int64)


class Tile:
    """Anchors of one label and what they look for: without ``scores`` their positives, else, for each
    positive's score (anchors x POSITIVES, NONE where there is none), the negatives in its window."""

    def __init__(self, group: Group, scores: np.ndarray = None):
        self.label, self.same = group.label, scores is None
        self.ids, self.vectors = Blocks([group]).rows(0)
        if self.same:
            self.k = POSITIVES
            self.least, self.most = np.full((len(self.ids), 1), NONE), np.full((len(self.ids), 1), -NONE - 1)
        else:
            self.k = NEGATIVES
            whole, rest = np.divmod(scores, 100)  # in parts, as a large score times 100 would overflow
            none = scores == NONE
            self.least = np.where(none, 1, LOW * whole - (-LOW * rest) // 100)
            self.most = np.where(none, 0, HIGH * whole + HIGH * rest // 100)

    def wanted(self, blocks: Blocks) -> tuple:
        """Which (anchor, block) pairs can give a result, by zone maps alone, and their upper bounds."""
        mine = (blocks.label == self.label) == self.same
        low, high = bounds(self.vectors, blocks.low, blocks.high)
        # In a search for positives all rows with the anchor's id may be in the block.
        enough = mine & (blocks.n - blocks.copies * self.same >= self.k)
        need = np.zeros(low.shape, bool)
        for least, most in zip(self.least.T[:, :, None], self.most.T[:, :, None]):
            sure = np.where(enough & (low >= least) & (high <= most), low, NONE).max(axis=1, keepdims=True)
            need |= mine & (high >= np.maximum(least, sure)) & (low <= most) & (least <= most)
        return need, high

    def search(self, blocks: Blocks) -> tuple:
        """(anchor, search, score, id) of the best rows of the blocks for each search of each anchor."""
        searches = self.least.shape[1]
        best = Best(self.least.size, self.k, self.least.ravel())
        need, high = self.wanted(blocks)
        for at in np.argsort(-np.where(need, high, NONE + 1).max(axis=0), kind="stable"):
            floor = best.least.reshape(self.least.shape)
            rows = np.flatnonzero(need[:, at] & ((high[:, at, None] >= floor) & (floor <= self.most)).any(axis=1))
            if not len(rows):
                continue
            ids, vectors = blocks.rows(at)
            scores = product(self.vectors[rows], vectors)
            anchor, place = np.nonzero((scores >= floor[rows].min(axis=1)[:, None])
                                       & (scores <= self.most[rows].max(axis=1)[:, None]))
            if self.same:
                other = ids[place] != self.ids[rows[anchor]]
                anchor, place = anchor[other], place[other]
            found, names, anchor = scores[anchor, place], ids[place], rows[anchor]
            hit, search = np.nonzero((found[:, None] >= floor[anchor]) & (found[:, None] <= self.most[anchor]))
            best.add(anchor[hit] * searches + search, found[hit], names[hit])
        return best.rows // searches, best.rows % searches, best.scores, best.ids


def _meet(blocks: DataFrame, tiles: DataFrame, units: int, make, schema: str) -> DataFrame:
    """``make(Blocks, Tile, row)`` for every tile with all blocks of the same (slab, section)."""
    arrow = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)
    columns = ["slab", "section", "kind", "scores", *Group._fields]
    columns = list(dict.fromkeys(columns))

    def of(df, kind):
        more = {"kind": F.lit(kind)} | {k: F.lit(None).cast("binary") for k in ("ids", "vectors", "scores")
                                         if k not in df.columns}
        return df.withColumns(more).select(columns)

    def run(batches):
        unit, groups, slab = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["slab"], row["section"]) != unit:
                    unit, groups, slab = (row["slab"], row["section"]), [], None
                group = Group(*(row[k] for k in Group._fields))
                if row["kind"] == 0:
                    groups.append(group)
                elif groups:
                    slab = slab or Blocks(groups)
                    scores = row["scores"] and np.frombuffer(row["scores"], "<i8").reshape(-1, POSITIVES)
                    out = make(slab, Tile(group, scores), row)
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
    order = ["slab", "section", "kind", "place"]
    return of(blocks, 0).unionByName(of(tiles, 1)).repartition(units, "slab", "section") \
        .sortWithinPartitions(*order).mapInArrow(run, schema)


def _found(blocks: DataFrame, tiles: DataFrame, slabs: int, sections: int, k: int) -> DataFrame:
    """(tile, anchor, search, anchor_id, score, id): the first ``k`` of every search of every anchor."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    zones = blocks.select([f.split()[0] for f in _ZONE.split(", ")])

    def choose(slab, tile, row):
        need = tile.wanted(slab)[0].any(axis=0)
        chosen = [slab.groups[at].place for at in np.flatnonzero(need)]
        n = int(bool(chosen))
        return [row["place"]] * n, [row["slab"]] * n, [row["section"]] * n, [chosen] * n
    demand = materialize(_meet(
        zones.withColumn("section", every(sections)), tiles.drop("slab").withColumn("slab", every(slabs)),
        slabs * sections, choose, "tile bigint, slab int, section int, blocks array<bigint>"), "negatives-demand")

    def read(slab, tile, row):
        anchor, search, scores, ids = tile.search(slab)
        return [row["place"]] * len(anchor), anchor, search, tile.ids[anchor], scores, ids
    chosen = demand.select("section", F.explode("blocks").alias("place")).distinct()
    asked = demand.select(F.col("tile").alias("place"), "slab")
    partial = _meet(
        blocks.join(chosen, "place"), tiles.drop("slab").join(asked, "place"), slabs * sections, read,
        "tile bigint, anchor int, search int, anchor_id bigint, score bigint, id bigint")
    order = Window.partitionBy("tile", "anchor", "search").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label; other columns are passed over. A positive without a negative in its
    window gives no row; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors.select("vec_id", "embedding", "label")), "negatives-rows")
    n, low, high = extent(rows)
    anchors = rows.where(F.col("id") % ANCHORS_EVERY == 0)
    cores = spark.sparkContext.defaultParallelism
    slabs = max(1, -(-n // SLAB_ROWS), min(2 * cores, n // (4 * BLOCK)))
    blocks = grouped(rows, BLOCK, slabs, low, high, "negatives-blocks")
    tiles = grouped(anchors, TILE, max(1, n // ANCHORS_EVERY // (16 * TILE)), low, high, "negatives-tiles")
    sections = max(1, -(-tiles.count() // SECTION_TILES))
    tiles = tiles.withColumn("section", F.pmod(F.xxhash64("place"), F.lit(sections)).cast("int"))
    positives = materialize(_found(blocks, tiles, slabs, sections, POSITIVES), "negatives-positives")

    def packed(names, anchor, order, scores):
        out = [np.full((TILE, POSITIVES), NONE, "<i8") for _ in names]
        for table, *cells in zip(out, anchor, order, scores):
            a, j, score = map(np.array, cells)
            table[a, j - 1] = score
        return names, [table[:max(a) + 1].tobytes() for table, a in zip(out, anchor)]
    wins = map_batches(
        positives.groupBy("tile").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("cells")).select(
            "tile", "cells.anchor", "cells.rank", "cells.score"),
        lambda: packed, "place bigint, scores binary")
    searched = tiles.join(wins, "place")
    negatives = _found(blocks, searched, slabs, sections, NEGATIVES).select(
        "tile", "anchor", F.col("search").alias("place"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return negatives.join(positives.select(
        "tile", "anchor", (F.col("rank") - 1).alias("place"), "anchor_id", F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score")), ["tile", "anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
