"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, hi bigint, depth string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(
            (r for r in rows if r[0] is not None),
            key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own[conv].append((role or "", text or ""))
    members = defaultdict(list)
    rebuilt = {}
    for conv in own:
        base = conv - int(np.fmod(conv, 5))
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(own.get(base, [])[:h] + own[conv][h:])
        for depth in range(len(rebuilt[conv]) + 1):
            members[rebuilt[conv][:depth]].append(conv)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        leaves = [m for m in below if not any(len(o) == len(m) + 1 and o[:-1] == m for o in members)]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(m) == len(node) + 1 for m in below), len(leaves),
                    sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def found(spark, rows, limit=None):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(table(spark, rows), limit).select(*COLUMNS).collect())


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-20, n), n // 2):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice(["é", "", None, "hello", "x\0y"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [None, 1, 10])
def test_trie_is_that_of_all_prefixes(spark, limit):
    rows = conversations(limit or 0)
    assert found(spark, rows, limit) == brute(rows)


def test_edges(spark):
    rows = [(5, None, None, None), (5, 0, "", "b"), (5, 0, "", "a"), (5, 0, "", "a"),  # null first, ties, repeats
            (6, 1, "user", "only"), (8, 1, "user", "only"),  # borrowers; 8 borrows past its own end
            (11, 3, "user", "no conversation 10"), (None, 0, "user", "nobody"),
            (20, 7, "user", "long " * 50_000), (25, 1, "user", "long " * 50_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    turnless = [(c, 0, "user", "x") for c in range(1000, 1200) if c % 5]  # no conversation lends anything
    got = prefix_trie.trie(table(spark, turnless)).where("depth = 0").first()
    assert got.n_convs == 160 and got.ends_sha256 != hashlib.sha256(b"").hexdigest()


def test_snapshots_of_one_conversation(spark):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(40) for t in range(c + 1)]
    assert found(spark, rows, 30) == brute(rows)


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    rows = [(5 * c, 0, "user", "same") for c in range(50)]
    assert found(spark, rows) == brute(rows)


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 20_000):
        keys = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        if n > 2:
            keys[1::2, 0], keys[::2, 1] = 7, 9  # words alone do not tell them apart
        slots = prefix_trie.Slots(keys)
        assert sorted(slots.of(keys).tolist()) == list(range(n))
        assert (slots.of(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError, match="twice"):
        prefix_trie.Slots(np.zeros((2, 2), np.uint64))


def test_wrong_depth_is_found():
    rows = {"hi": [1, 2], "lo": [0, 0], "up_hi": [0, 1], "up_lo": [0, 0], "depth": [0, 5]}
    rows |= dict.fromkeys(("conv_id", "n_convs", "bytes", "below_children", "below_leaves", "below_saved"), [1, 1])
    with pytest.raises(ValueError, match="two prefixes"):
        prefix_trie.sum_subtrees(pa.table({k: pa.array(v, "int64") for k, v in rows.items()}))


def test_a_digest_of_two_prefixes_is_an_error(spark, monkeypatch):
    one = spark.createDataFrame([(1, 0, 0, False, 1, 1, None, None), (1, 1, 3, False, 2, 2, 1, 1),
                                 (2, 1, 4, False, 2, 2, 1, 1), (1, 1, 3, True, 2, 2, 1, 1),
                                 (2, 1, 4, True, 2, 2, 1, 1)], prefix_trie.TURN)
    monkeypatch.setattr(prefix_trie, "prefixes", lambda turns: one)
    with pytest.raises(ValueError, match="two prefixes"):
        prefix_trie.trie(table(spark, []))


def test_the_last_turns_are_never_held(spark):
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(6, t, "user", "x") for t in range(20)]
    got = prefix_trie.trie(table(spark, rows)).agg(F.max("depth"), F.count("*")).first()
    assert got[0] == 3000 and got[1] >= 3001
