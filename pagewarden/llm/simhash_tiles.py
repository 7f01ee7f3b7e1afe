"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is set if it is set in over half of the shingle hashes of a text,
repeats included. Distinct fingerprints are compared in tiles: exclusive-or and bit
counts over numpy arrays; two tiles whose population counts differ by more than the
radius are never paired, as each differing bit changes the count by one.

Rows reach a tile by a block key, one of r + 1 bit bands for a radius r: fingerprints within r
bits agree in at least one band, so no link is lost and a tile holds 2 ** -band of the rows.
A block above the tile size is cut in order of population count into tiles, and each
allowed pair of its tiles is one unit of work.

A unit returns a spanning forest of its links (fewer rows than it read), never all
pairs; components then come from repeated smallest-neighbour steps.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pagewarden.llm.common import map_batches, materialize, spread

SEED = 42
MIN_TILE, MAX_TILE = 1024, 16384
UNIT_ROWS_PER_TASK = 65536
_U = np.uint64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A text of fewer
    words is one shingle.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, _U)
    line, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    first = [0, *(ends[: n - 1].tolist())]
    last = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], _U)


def fingerprint(text: str, words: int) -> bytes:
    """Fingerprint as big-endian bytes."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> bytes:
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at: at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words=4, id_column="doc_id", text="text") -> DataFrame:
    """Per row: id, text_hash, fp (binary). Null and empty texts have the zero fingerprint."""
    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(id_column, text, text_hash(text)),
                       lambda: lambda keys, texts, hashes: (
                           keys, hashes, [fingerprint(t or "", words) for t in texts]),
                       f"`{id_column}` {kind}, text_hash bigint, fp binary")


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def unit_links(fps: np.ndarray, radius: int) -> list:
    """Spanning forest, as index pairs, of the links inside one unit.

    ``fps`` is sorted by population count.
    """
    n, links = len(fps), []
    counts = np.bitwise_count(fps).astype(np.int64)
    if n <= MIN_TILE:  # all at once; most units have no link
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
        if len(a) <= 2 * n:
            return list(zip(a.tolist(), b.tolist()))
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            row = queue.pop()
            low = np.searchsorted(counts, counts[row] - radius)
            high = np.searchsorted(counts, counts[row] + radius, "right")
            others = low + np.flatnonzero(left[low:high])
            for other in others[np.bitwise_count(fps[others] ^ fps[row]) <= radius].tolist():
                left[other] = False
                links.append((row, other))
                queue.append(other)
    return links


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, materialized), as spanning
    forests of the units."""
    spark = distinct.sparkSession
    n = distinct.count()
    tile = int(min(MAX_TILE, max(MIN_TILE, n // 64)))
    word = F.conv(F.hex(F.col("fp")), 16, -10).cast("bigint")
    width, spare = divmod(64, radius + 1)
    keys, at = [], 0
    for band in range(radius + 1):
        bits = width + (band < spare)
        value = F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << bits) - 1))
        keys.append(value * F.lit(64) + F.lit(band))
        at += bits
    blocked = distinct.select(
        "fp", F.bit_count(word).alias("ones"), F.explode(F.array(*keys)).alias("block"))
    blocked = materialize(blocked.select("block", "fp", "ones"), "simhash-blocks")

    # Blocks above one tile: cut along the population count.
    hist = blocked.groupBy("block", "ones").count()
    over = Window.partitionBy("block")
    upto = over.orderBy("ones").rowsBetween(Window.unboundedPreceding, 0)
    cut = hist.withColumn("total", F.sum("count").over(over)).where(F.col("total") > tile) \
        .withColumn("high", F.floor((F.sum("count").over(upto) - 1) / tile)) \
        .withColumn("low", F.floor((F.sum("count").over(upto) - F.col("count")) / tile)) \
        .select("block", "ones", "low", "high")
    cut = materialize(cut, "simhash-cuts")
    tiles = cut.withColumn("tile", F.explode(F.sequence("low", "high"))).groupBy("block", "tile") \
        .agg(F.min("ones").alias("least"), F.max("ones").alias("most")) \
        .groupBy("block").agg(F.collect_list(F.struct("tile", "least", "most")).alias("tiles"))
    tiles = materialize(tiles, "simhash-tiles")
    placed = blocked.join(cut, ["block", "ones"], "left").withColumn(
        "tile", F.col("low") + F.pmod(F.xxhash64("fp"), F.col("high") - F.col("low") + 1))
    placed = placed.select("block", "fp", "tile").join(tiles, "block", "left")
    mine = F.expr("filter(tiles, x -> x.tile = tile)[0]")
    placed = placed.withColumn("mine", mine).withColumn("partner", F.explode(F.expr(
        f"CASE WHEN tile IS NULL THEN array(0L) ELSE transform(filter(tiles, x -> "
        f"(size(tiles) = 1 OR x.tile <> tile) AND x.least <= mine.most + {radius} AND mine.least <= x.most + {radius}), "
        f"x -> x.tile) END")))
    own = F.coalesce("tile", F.lit(0))
    units = placed.select("fp", F.concat_ws(
        "/", "block", F.least(own, "partner"), F.greatest(own, "partner")).alias("unit"))
    groups = spread(n * (radius + 1), UNIT_ROWS_PER_TASK, spark)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(pdf["fp"]), ">u8").astype(_U)
        codes = pd.factorize(pdf["unit"])[0]
        order = np.lexsort((np.bitwise_count(words), codes))
        words, codes = words[order], codes[order]
        names = pdf["fp"].to_numpy()[order]
        edges = np.flatnonzero(np.diff(codes, prepend=-1, append=-2))
        a, b = [], []
        for start, end in zip(edges[:-1], edges[1:]):
            if end - start > 1:
                for i, j in unit_links(words[start:end], radius):
                    if names[start + i] != names[start + j]:
                        a.append(names[start + i])
                        b.append(names[start + j])
        return pd.DataFrame({"a": a, "b": b})

    return units.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(groups))) \
        .repartition(groups, "bin").groupBy("bin").applyInPandas(compare, "a binary, b binary")


def components(edges: DataFrame, node: str = "binary") -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link.

    Alternating steps: a node's larger neighbours, then its smaller ones, are hooked to
    the smallest of its neighbourhood. The links shrink to stars; each step is written
    out, so lost executors cost a re-read, and a hot centre is only ever summed to its
    minimum and joined as the single row of its side.
    """
    both = "inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))"
    edges = materialize(edges.distinct(), "links")
    while True:
        around = edges.selectExpr(both)
        least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")), "links-least")
        large = materialize(around.join(least, "u").where("v > u").select(
            F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        # now a > b in each row
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "links-low")
        hooked = large.join(low, "a").select("a", "b", "m")
        small = materialize(hooked.selectExpr(
            "inline(array(struct(a AS a, m AS b), struct(b AS a, m AS b)))"
        ).where("a <> b").distinct(), "links-small")
        heads = small.select(F.col("b").alias("a")).distinct()
        deep = small.join(heads, "a", "left_semi").limit(1).count()
        twice = small.groupBy("a").count().where("count > 1").limit(1).count()
        edges = small
        if not deep and not twice:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words=4, radius=4, id_column="doc_id", text="text") -> DataFrame:
    """Per row: id, text_hash, fp (binary), root (one fingerprint of the component),
    component_id (smallest id reachable over links of ``radius`` or fewer differing bits,
    itself included).

    Rows of one fingerprint are one component before any comparison. A component whose
    ids are all null has a null component_id; null ids are else passed over. Repeated
    rows stay as rows. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, words, id_column, text), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_column).alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")),
                           "simhash-smallest")
    of = materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-of")
    return rows.join(of, "fp").select(id_column, "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words=4, radius=4, id_column="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` that stay: the one of the smallest id in each component.

    Of rows repeated under that id one stays (that of the smallest text hash); a component
    without any id keeps the row of its smallest text hash.
    """
    ids = F.col(id_column)
    order = F.struct(ids.isNull().alias("missing"), ids.alias("_id"), F.col("text_hash").alias("_hash"))
    kept = materialize(near_duplicates(docs, words, radius, id_column, text).groupBy("root").agg(
        F.min(order).alias("row")).select("row._id", "row._hash"), "simhash-kept")
    again = materialize(docs.groupBy(ids.alias("_again")).count().where("count > 1").select("_again"),
                        "simhash-repeated")
    stay = docs.join(kept, ids.eqNullSafe(kept["_id"]) & (text_hash(text) == kept["_hash"]), "left_semi")
    repeated = stay.join(again, ids.eqNullSafe(again["_again"]), "left_semi").withColumn(
        "_text_hash", text_hash(text)).dropDuplicates([id_column, "_text_hash"]).drop("_text_hash")
    return stay.join(again, ids.eqNullSafe(again["_again"]), "left_anti").unionByName(repeated)
