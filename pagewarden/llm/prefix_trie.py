"""Prefix trie of conversations, as a minimal-perfect-hash node table.

A node is a distinct sequence of first turns; its name is a chained 128-bit digest of them, so the
digest of every prefix comes out of one pass over the turns of a conversation. Node
counts are one aggregation by digest. Sums over subtrees come from flat arrays: the
nodes of a shard get slots of a minimal perfect hash (every look-up is checked against the
digest stored in its slot, and a digest with two depths, parents or texts' lengths is an error), counts
are scattered to their slots, parents become an array of slots, and levels are
added to their parents from the deepest up.

Shards are whole subtrees. A node is heavy if more than ``limit`` turns of all conversations lie at or
below it; the topmost light nodes root the subtrees, which are dealt to shards by hash and hold at most
``limit`` nodes each. Heavy nodes are closed upwards and form the last table, after the subtrees' totals
are summed by parent; there are at most depth * turns / limit of them. With limit = sqrt(turns * depth) both
sides grow with the square root of the input only.

Turns are shuffled once, by family (the conversation that lends its beginning, and its borrowers), and
streamed in order: a task holds the lent turns (``LENT`` at most), never a conversation. The members
that end at a node are hashed in ascending order from pieces that were joined in parallel.
"""

from hashlib import blake2b, sha256
from math import isqrt
from struct import unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewarden.llm.common import materialize

FAMILY = 5
LENT = 8  # turns that a conversation can borrow
LEAST_LIMIT = 1 << 14
ROWS_PER_SHARD = 1 << 18
JOINED = 4096  # ids in a piece of a node's list
LEVELS = 100  # each leaves less than half of the keys, so distinct ones never need as many
BROADCAST_NODES = 1 << 16
ROOT = bytes(16)
# A digest is two numbers, so that aggregates and joins stay on fixed-width columns.
NAME, PARENT = ["hi", "lo"], ["up_hi", "up_lo"]
TURN = ("conv_id bigint, depth bigint, bytes bigint, is_end boolean, hi bigint, lo bigint, "
        "up_hi bigint, up_lo bigint")
_U = np.uint64


def step(digest: bytes, role: str, text: str) -> bytes:
    """Name of a prefix that is one turn longer."""
    role, text = role.encode(), text.encode()
    return blake2b(digest + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()


def _stream(df: DataFrame, make, schema: str, size=4096) -> DataFrame:
    """mapInArrow with a generator of rows from rows, written out ``size`` at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        waiting = []
        for row in make(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            waiting.append(row)
            if len(waiting) == size:
                yield table(waiting)
                waiting = []
        if waiting:
            yield table(waiting)
    return df.mapInArrow(run, schema)


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one included (TURN).

    Turns of a conversation are in order of turn (null first), role, text; the last two break
    ties. Null roles and texts are empty. Rows without conv_id are of no conversation.
    """
    conv = F.col("conv_id")
    rows = turns.select(
        conv.cast("bigint").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL").select(
        "*", (conv - conv % FAMILY).alias("family"))
    rows = rows.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("family", "conv_id", F.crc32(conv.cast("string")).alias("crc"), "role", "text")

    def row(conv_id, depth, last, is_end, digest, parent):
        up = unpack("<qq", parent) if depth else (None, None)
        return conv_id, depth, last, is_end, *unpack("<qq", digest), *up

    def chain(stream):
        family = now = None
        lent = []  # first original turns of the family's first conversation
        for key, conv_id, crc, *turn in stream:
            if key != family:
                family, lent = key, []
            if conv_id != now:
                if now is not None:
                    yield row(now, depth, last, True, digest, parent)
                now, depth, digest, parent, last = conv_id, 0, ROOT, None, 0
                yield row(now, depth, last, False, digest, parent)
                skip = crc % (LENT + 1) if conv_id != family else 0
                for role, text in lent[:skip]:
                    parent, depth, last = digest, depth + 1, len(text.encode())
                    digest = step(digest, role, text)
                    yield row(now, depth, last, False, digest, parent)
            role, text = turn
            if conv_id == family and len(lent) < LENT:
                lent.append((role, text))
            if skip:
                skip -= 1
                continue
            parent, depth, last = digest, depth + 1, len(text.encode())
            digest = step(digest, role, text)
            yield row(now, depth, last, False, digest, parent)
        if now is not None:
            yield row(now, depth, last, True, digest, parent)
    return _stream(rows, chain, TURN)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of digests (rows of two words) for every seed."""
    x = keys[:, 0] + _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for more in (keys[:, 1], _U(0)):  # a common public mixing function, once for each word
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        x = x ^ (x >> _U(31)) ^ more
    return x


class Slots:
    """Minimal perfect hash of distinct digests: n keys, slots 0 to n - 1.

    On each level the keys that are alone in their cell of a bit array are settled, the others go
    on to the next; the slot is the number of set bits before the cell. A slot keeps its digest.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, left, before = [], keys, 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("a digest stands twice in a shard")
            cells = 2 * len(left)
            at = (mixed(left, len(self.levels)) % _U(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            rank = np.where(alone, before + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            before += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._of(keys)] = keys

    def _of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, rank in enumerate(self.levels):
            found = rank[(mixed(keys[left], seed) % _U(len(rank))).astype(np.int64)]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that are not in the table."""
        out = self._of(keys)
        inside = np.flatnonzero(out >= 0)
        wrong = (self.keys[out[inside]] != keys[inside]).any(axis=1)
        out[inside[wrong]] = -1
        return out


def sum_subtrees(table: pa.Table) -> pa.Table:
    """parent_conv_id, n_children, n_leaves, saved_tokens of all nodes of a shard.

    Columns: hi, lo, up_hi, up_lo, conv_id, depth, n_convs, bytes, and below_children, below_leaves,
    below_saved: what hangs under a node in other shards. A node whose parent is in another shard
    has no parent_conv_id here.
    """
    def column(name):
        return table.column(name).fill_null(0).to_numpy()
    keys, ups = (np.stack([column(k) for k in pair], axis=1).astype(np.int64).view(_U) for pair in (NAME, PARENT))
    slots = Slots(keys)
    own = slots.of(keys)
    at = {k: np.zeros(len(keys), np.int64) for k in (
        "conv_id", "depth", "n_convs", "bytes", "below_children", "below_leaves", "below_saved")}
    for k, values in at.items():
        values[own] = column(k)
    parent = np.full(len(keys), -1, np.int64)
    parent[own] = np.where(column("depth") == 0, -1, slots.of(ups))
    inner = parent >= 0
    if (at["depth"][inner] != at["depth"][parent[inner]] + 1).any():
        raise ValueError("a digest stands for two prefixes")
    children = at["below_children"]
    np.add.at(children, parent[inner], 1)
    leaves = at["below_leaves"] + (children == 0)
    saved = at["below_saved"] + (at["n_convs"] - 1) * at["bytes"]
    order = np.argsort(-at["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(at["depth"][order], prepend=-1, append=-1))
    for low, high in zip(cuts[:-1], cuts[1:]):
        level = order[low:high]
        level = level[inner[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    conv = np.where(inner, at["conv_id"][parent], 0)
    return table.select([*NAME, *PARENT, "conv_id", "depth", "n_convs"]).append_column(
        "parent_conv_id", pa.array(conv[own], mask=~inner[own])).append_column(
        "n_children", pa.array(children[own])).append_column(
        "n_leaves", pa.array(leaves[own])).append_column("saved_tokens", pa.array(saved[own]))


SHARD = ("hi bigint, lo bigint, up_hi bigint, up_lo bigint, conv_id bigint, depth bigint, n_convs bigint, "
         "parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")


def ends(finished: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): hash of the ascending, comma-joined ids of the conversations that end there.

    Ids are ordered and joined in ranges, in parallel; a node's ranges are then hashed one after the other.
    """
    ordered = finished.select(*NAME, "conv_id").repartitionByRange(*NAME, "conv_id") \
        .sortWithinPartitions(*NAME, "conv_id")

    def join(stream):
        now, least, ids = None, None, []
        for *name, conv_id in stream:
            if name != now or len(ids) == JOINED:
                if ids:
                    yield *now, least, ",".join(ids)
                now, least, ids = name, conv_id, []
            ids.append(str(conv_id))
        if ids:
            yield *now, least, ",".join(ids)

    def digests(stream):
        now = None
        for *name, _, ids in stream:
            if name == now:
                total.update(b"," + ids.encode())
                continue
            if now is not None:
                yield *now, total.hexdigest()
            now, total = name, sha256(ids.encode())
        if now is not None:
            yield *now, total.hexdigest()
    pieces = _stream(ordered, join, "hi bigint, lo bigint, least bigint, ids string", 256)
    return _stream(pieces.repartition(*NAME).sortWithinPartitions(*NAME, "least"), digests,
                   "hi bigint, lo bigint, ends_sha256 string")


def trie(turns: DataFrame, limit: int = None) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text; other columns are passed over. A repeated row is one more turn. An
    empty table has no conversation and no node. ``limit`` is the number of turns from which a node is
    heavy.
    """
    rows = materialize(prefixes(turns.select("conv_id", "turn", "role", "text")), "trie-prefixes")
    finished = rows.where("is_end").select("conv_id", *NAME, F.col("depth").alias("length"))
    path = rows.where("NOT is_end").drop("is_end")
    facts = ["depth", "bytes", *PARENT]
    nodes = materialize(path.join(finished.select("conv_id", "length"), "conv_id").groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        *[F.min(k).alias(k) for k in facts],
        *[F.max(k).alias(f"max_{k}") for k in facts]), "trie-nodes")
    size = nodes.agg(
        F.max("depth").alias("deepest"), F.max("weight").alias("turns"), F.count("*").alias("n"),
        F.count_if(~F.expr(" AND ".join(f"{k} <=> max_{k}" for k in facts))).alias("unsound")).first()
    if size["unsound"]:
        raise ValueError("a digest stands for two prefixes")
    limit = limit or max(LEAST_LIMIT, isqrt((size["turns"] or 0) * ((size["deepest"] or 0) + 1)))
    nodes = nodes.select(*NAME, *PARENT, "conv_id", "depth", "n_convs", "bytes", "weight")
    heavy = materialize(nodes.where(F.col("weight") > limit), "trie-heavy")
    n_heavy = heavy.count()

    def small(df):  # beyond that the join shuffles, and adaptive execution splits its hot keys
        return F.broadcast(df) if n_heavy <= BROADCAST_NODES else df

    # The topmost light node on the path of each conversation names the subtree of its light nodes.
    names = small(heavy.select(*NAME))
    tops = path.join(names, NAME, "left_anti").groupBy("conv_id").agg(
        F.min(F.struct("depth", *NAME)).alias("top")).select("conv_id", F.xxhash64("top.hi", "top.lo").alias("top"))
    cores = turns.sparkSession.sparkContext.defaultParallelism
    shards = max(cores, -(-size["n"] // ROWS_PER_SHARD))
    below = {k: F.lit(0).cast("bigint") for k in ("below_children", "below_leaves", "below_saved")}
    light = nodes.join(names, NAME, "left_anti").join(tops, "conv_id").withColumns(below).groupBy(
        F.pmod("top", F.lit(shards))).applyInArrow(sum_subtrees, SHARD)
    light = materialize(light, "trie-light")

    # Heavy nodes: what hangs under them is summed by parent first, so the table has one row for each.
    hanging = light.where("parent_conv_id IS NULL").groupBy(*[F.col(k).alias(n) for k, n in zip(PARENT, NAME)]) \
        .agg(F.count("*").alias("below_children"), F.sum("n_leaves").alias("below_leaves"),
             F.sum("saved_tokens").alias("below_saved"))
    top = heavy.join(hanging, NAME, "left").fillna(0, list(below)).withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(
        sum_subtrees, SHARD)
    top = materialize(top, "trie-top")
    upper = top.select(*[F.col(n).alias(k) for k, n in zip(PARENT, NAME)], F.col("conv_id").alias("upper"))
    light = light.join(small(upper), PARENT, "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "upper")).drop("upper")
    nothing = sha256(b"").hexdigest()
    return light.unionByName(top).join(ends(finished), NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
