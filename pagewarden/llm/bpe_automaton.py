"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens: from the state reached by token x it has an arc
labelled y if, and only if, x y stays x y when the merges run over its text. It
starts as the automaton of all base symbol strings (every arc is there). Each merge
(a, b -> c), in order of rank, is one gadget on it:

* arc c is added wherever arc a led into a state with arc b: c may follow what a
  could follow, and what could follow b may follow c (c takes over the arcs into a
  and out of b as they are at that moment);
* arc b leaves the state of a; with a = b, arc c leaves it too, as the leftmost
  pair merges first.

The finished table of a 49k vocabulary has 49k x 49k cells, so a row is not written
out: a cell is the outcome of the gadgets that touched it, found by following the two
merge chains back in rank order, and then kept in the table. The automaton is
deterministic, and each text has exactly one path through it: its encoding. The
encoder runs over the positions of a pre-split word and keeps the state of every
prefix; decoding emits the labels of the arcs.
"""

import hashlib
import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from pagewarden.llm.common import map_batches

WORD_END = "</w>"
# The pre-split pattern and white space of the word-end vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0  -     　]+"
UNSPACED = SPACE.replace("[", "[^", 1)

CACHED_WORDS = 200_000
CACHED_CHUNKS = 400_000
TABLE_CELLS = 2_000_000
# Words longer than this are encoded without being kept.
KEEP_BYTES = 64


def byte_symbols() -> list:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    chars = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def _lengths(tokens: dict) -> dict:
    """Lengths of the tokens of three bytes and more, longest first, by their last three bytes."""
    found = {}
    for raw in tokens:
        if len(raw) > 2:
            found.setdefault(raw[-3:], set()).add(len(raw))
    return {tail: sorted(of, reverse=True) for tail, of in found.items()}


class MergeAutomaton:
    """Deterministic automaton over tokens, compiled from a merge list."""

    def __init__(self, vocab: dict, merges: list):
        self.labels = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.parts, self.rank = {}, {}
        for k, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.parts[vocab[a + b]] = (k, *pair)
            self.rank[pair] = k
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            last = token.endswith(WORD_END) and token != WORD_END
            body = token[: -len(WORD_END)] if last else token
            if all(c in back for c in body):
                raw = bytes(back[c] for c in body)
                (self.final if last else self.inner)[raw] = i
        self.inner_lengths, self.final_lengths = _lengths(self.inner), _lengths(self.final)
        self.table = {}

    def arc(self, x: int, y: int) -> bool:
        """Does the state of x have an arc labelled y?"""
        key = x << 32 | y
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_CELLS:
                self.table.clear()
            known = self.table[key] = self._gadgets(x, y)
        return known

    def _gadgets(self, x: int, y: int) -> bool:
        until = len(self.rank)  # gadgets of lower rank have run
        while True:
            k = self.rank.get((x, y))
            if k is not None and k < until:
                return False  # the arc was taken out by its own merge
            of_x, of_y = self.parts.get(x), self.parts.get(y)
            if of_x is None and of_y is None:
                return True
            if of_y is None or of_x is not None and of_x[0] > of_y[0]:
                until, x = of_x[0], of_x[2]  # x took over the arcs out of its right part
            elif of_x is not None and of_x[0] == of_y[0]:
                until, x, y = of_x[0], of_x[2], of_y[1]
            else:
                until, y = of_y[0], of_y[1]  # y took over the arcs into its left part
                if self.rank.get((x, y)) == until:
                    return False  # a = b: the pair to the left merges first

    def encode(self, word: bytes) -> list:
        """Ids of one pre-split word: the labels of its path."""
        n = len(word)
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        state, before = {0: None}, {}
        # Of a short word only those prefixes that its path may come through.
        for end in (n,) if n <= KEEP_BYTES else range(1, n + 1):
            self._reach(word, end, state, before)
        path, at = [], n
        while at:
            path.append(state[at])
            at = before.get(at, 0)
        return path[::-1]

    def _reach(self, word: bytes, end: int, state: dict, before: dict):
        """The state of the prefix up to ``end``: its last token, the longest that has an arc."""
        tokens, lengths = ((self.final, self.final_lengths) if end == len(word)
                           else (self.inner, self.inner_lengths))
        for length in (*lengths.get(word[end - 3:end], ()), 2, 1) if end > 2 else (2, 1):
            start = end - length
            if start < 0:
                continue
            token = tokens.get(word[start:end])
            if token is None:
                continue
            if start:
                last = state[start] if start in state else self._reach(word, start, state, before)
                if last is None or not self.arc(last, token):
                    continue
            state[end], before[end] = token, start
            return token
        state[end] = None


class Kept:
    """Results by text. When ``size`` are kept the older half goes, so frequent ones stay."""

    def __init__(self, size: int):
        self.half, self.recent, self.older = size // 2, {}, {}

    def find(self, key):
        found = self.recent.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, found) -> None:
        if len(self.recent) >= self.half:
            self.older = self.recent.copy()
            self.recent.clear()
        self.recent[key] = found


class Encoder:
    """Encodes and decodes whole texts as a word-end vocabulary file asks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
                  for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.unspaced, self.pieces = re.compile(UNSPACED), regex.compile(PIECES)
        self.known, self.chunks = Kept(CACHED_WORDS), Kept(CACHED_CHUNKS)

    def normal(self, chunk: str) -> str:
        chunk = unicodedata.normalize("NFC", chunk)
        return chunk.replace("Σ", "σ").lower()  # letter by letter, no final sigma

    def word(self, piece: str) -> tuple:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.automaton.encode(raw)
        found = (array("I", ids).tobytes(), " ".join(map(self.labels.__getitem__, ids)))
        if len(raw) <= KEEP_BYTES:
            self.known.keep(piece, found)
        return found

    def chunk(self, chunk: str) -> tuple:
        """``word`` of all pieces of a text without white space; no piece, normal form or
        letter case reaches over white space."""
        found = [self.known.find(piece) or self.word(piece)
                 for piece in self.pieces.findall(self.normal(chunk))]
        found = found[0] if len(found) == 1 else (
            b"".join([f[0] for f in found]), " ".join([f[1] for f in found]))
        if len(chunk) <= KEEP_BYTES:
            self.chunks.keep(chunk, found)
        return found

    def run(self, text: str) -> tuple:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        ids, labels = [], []
        recent, chunk = self.chunks.recent, self.chunk
        for part in self.cut.split(text) if any(t in text for t in self.added) else (text,):
            if part in self.added:
                ids.append(array("I", [self.added[part]]).tobytes())
                labels.append(part)
                continue
            found = [recent.get(c) or self.chunks.find(c) or chunk(c) for c in self.unspaced.findall(part)]
            ids += [f[0] for f in found]
            labels += [f[1] for f in found if f[0]]
        return b"".join(ids), " ".join(labels)


@lru_cache(maxsize=2)
def _encoder(path: str, changed: int, size: int) -> Encoder:
    return Encoder(path)


def encoder_of(path: str) -> Encoder:
    """The encoder of a file, once in each Python worker: later tasks go on with its tables."""
    of = os.stat(path)
    return _encoder(path, of.st_mtime_ns, of.st_size)


def encode_texts(docs: DataFrame, path: str, id_column="doc_id", text="text") -> DataFrame:
    """Per row: ids (array), the decoded text. Null and empty texts have no ids and an
    empty decoded text; ids may be null or repeat; rows are independent."""
    def make():
        encoder = encoder_of(path)

        def each(keys, texts):
            done = [encoder.run(t or "") for t in texts]
            return keys, [list(memoryview(i).cast("I")) for i, _ in done], [d for _, d in done]
        return each
    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(id_column, text), make,
                       f"`{id_column}` {kind}, ids array<bigint>, decoded string")


def token_digests(docs: DataFrame, path: str, id_column="doc_id", text="text") -> DataFrame:
    """Per row the digests of ``encode_texts``, made in the same pass."""
    def make():
        encoder = encoder_of(path)

        def each(keys, texts):
            done = [encoder.run(t or "") for t in texts]
            return (keys, [len(i) // 4 for i, _ in done],
                    [hashlib.sha256(i).hexdigest() for i, _ in done],
                    [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest()
                     for _, d in done])
        return each
    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(id_column, text), make,
                       f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, "
                       "decoded_sha256 string")
