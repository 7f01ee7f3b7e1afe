"""Language by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each
piece; a word's probability is the sum over all ways to cut it into pieces (forward
algorithm), a text's the product over its words, and the language is the most probable one.

Words are runs of letters of the lower-cased text, cut with a mark for their start in front. A
character that is no piece is one with a fixed small probability, so each word has a segmentation.

Probabilities are learned by expectation maximisation: words are counted for each language over all
learning rows (a table that grows with the corpus), each round adds up the expected number of every piece
over all segmentations of all counted words, and only those sums, at most pieces times
languages, reach the driver. They are smoothed towards the pooled pieces of all languages.

Null or letterless texts are ``und`` with score 0, as is every text if nothing was learned. Rows with a
null text or language teach nothing; repeated rows teach as often as they stand there. Equal
likelihoods go to the first language in order of its name. Texts of any length count whole.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagewarden.llm.common import map_batches, materialize

UNKNOWN = "und"
ROUNDS = 2
SMOOTHING = 200.0  # pooled pieces added to those of a language
FLOOR = 1e-9  # probability of a character that is no piece, and least one of a piece
SHORT = 24  # longer words leave the range of plain floating point numbers: FLOOR ** (SHORT + 1)
TOGETHER = 1 << 15  # words in arrays at a time
CACHED_WORDS = 200_000  # in each task
COUNTED_WORDS = 200_000  # in each task, before counts are passed on
START = "▁"
_LETTERS = regex.compile(r"\p{L}+")
_CODES = 0x110000


def pieces(path: str) -> list:
    """The pieces of a public vocabulary file, lower-cased, in order of first place."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(own.vocab_size())
           if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)))
    return list(dict.fromkeys(own.id_to_piece(i).lower() for i in ids))


def words(text: str) -> list:
    return _LETTERS.findall((text or "").lower())


class Lattice:
    """Finds all pieces in words, walking a tree of the pieces' characters for many words at once."""

    def __init__(self, vocabulary: list):
        nodes, steps = {"": 0}, {}
        for piece in vocabulary:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    nodes[piece[:end]] = len(nodes)
                    steps[nodes[piece[:end - 1]] * _CODES + ord(piece[end - 1])] = nodes[piece[:end]]
        keys = np.array(sorted(steps), np.int64)
        self.keys = np.append(keys, -1)  # so that a search never ends behind the last one
        self.next = np.array([*(steps[k] for k in keys.tolist()), 0], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[[nodes[p] for p in vocabulary]] = np.arange(len(vocabulary))
        self.unknown = len(vocabulary)

    def edges(self, found: list):
        """Groups of (word numbers, start, end, piece numbers) in ascending order of (end, length); in
        a group every word is there once. A character that is no piece has the number ``unknown``."""
        lengths = np.array([len(w) for w in found], np.int64)
        codes = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(found)), lengths)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, state, step, parts = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            step += 1
            key = state * _CODES + codes[at]
            place = np.searchsorted(self.keys[:-1], key)
            known = self.keys[place] == key
            if step == 1:
                whole = np.where(known, self.piece[self.next[place] * known], -1)
                parts.append((word, start, start + 1, np.where(whole < 0, self.unknown, whole)))
            word, start, at, state = word[known], start[known], at[known], self.next[place[known]]
            piece = self.piece[state]
            if step > 1:
                hit = piece >= 0
                parts.append((word[hit], start[hit], start[hit] + step, piece[hit]))
            more = start + step < lengths[word]
            word, start, at, state = word[more], start[more], at[more] + 1, state[more]
        word, start, end, piece = (np.concatenate(c) for c in zip(*parts))
        group = end * (step + 1) + end - start
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:]):
            some = order[low:high]
            yield word[some], int(start[some[0]]), int(end[some[0]]), piece[some]


@dataclass
class Model:
    """Languages in order of name, their log priors, and probabilities (languages in columns; rows are
    the pieces and, last, the character that is no piece)."""
    vocabulary: list
    languages: list
    priors: np.ndarray
    table: np.ndarray

    def scorer(self):
        """A function from a list of texts to their (languages, scores); made once in each task."""
        lattice, seen, logs = Lattice(self.vocabulary), {}, [np.zeros((0, len(self.languages)))]

        def each(texts):
            counts = [Counter(words(t)) for t in texts]
            if len(seen) > CACHED_WORDS:
                seen.clear()
                logs[:] = [logs[0][:0]]
            new = list(set().union(*counts).difference(seen))
            if new and self.languages:
                logs[:] = [np.concatenate([logs[0], self.words([START + w for w in new], lattice)])]
                seen.update(zip(new, range(len(seen), len(seen) + len(new))))
            return tuple(zip(*(self._best(c, seen, logs[0]) for c in counts)))
        return each

    def _best(self, counts: Counter, seen: dict, logs: np.ndarray) -> tuple:
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        rows = np.fromiter(map(seen.__getitem__, counts), np.int64, len(counts))
        total = self.priors + np.fromiter(counts.values(), float, len(counts)) @ logs[rows]
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def words(self, found: list, lattice: Lattice) -> np.ndarray:
        """Log probabilities (words x languages), each over all segmentations of the word."""
        out = np.zeros((len(found), len(self.languages)))
        short = [i for i, w in enumerate(found) if len(w) <= SHORT]
        for low in range(0, len(short), TOGETHER):
            rows = short[low: low + TOGETHER]
            some = [found[i] for i in rows]
            forward = np.zeros((SHORT + 1, len(some), len(self.languages)))
            forward[0] = 1
            for word, start, end, piece in lattice.edges(some):
                forward[end, word] += forward[start, word] * self.table[piece]
            out[rows] = np.log(forward[[len(w) for w in some], np.arange(len(some))])
        for i, w in enumerate(found):
            if len(w) > SHORT:
                out[i] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        place = {p: i for i, p in enumerate(self.vocabulary)}
        longest, logs = max(map(len, place), default=1), np.log(self.table)
        forward = [np.zeros(len(self.languages))]  # as many as the longest piece needs
        for end in range(1, len(word) + 1):
            first = end - len(forward)
            starts = [s for s in range(first, end) if word[s:end] in place]
            terms = [forward[s - first] + logs[place[word[s:end]]] for s in starts]
            if word[end - 1] not in place:
                terms.append(forward[-1] + logs[-1])
            forward = [*forward, np.logaddexp.reduce(terms)][-longest:]
        return forward[-1]

    def expected(self, found: list, language: np.ndarray, n: np.ndarray, lattice: Lattice) -> np.ndarray:
        """Expected counts (as the table) over all segmentations of words, each ``n`` times in its
        language (its column)."""
        sums, shape = np.zeros(self.table.size), self.table.shape
        for low in range(0, len(found), TOGETHER):
            some = found[low: low + TOGETHER]
            k, times = language[low: low + TOGETHER], n[low: low + TOGETHER]
            edges, every = list(lattice.edges(some)), np.arange(len(some))
            ends = np.array([len(w) for w in some])
            forward, backward = np.zeros((2, SHORT + 1, len(some)))
            forward[0] = backward[ends, every] = 1
            for word, start, end, piece in edges:
                forward[end, word] += forward[start, word] * self.table[piece, k[word]]
            total = forward[ends, every]
            for word, start, end, piece in reversed(edges):
                beyond = self.table[piece, k[word]] * backward[end, word]
                backward[start, word] += beyond
                sums += np.bincount(piece * shape[1] + k[word], minlength=len(sums),
                                    weights=times[word] * forward[start, word] * beyond / total[word])
        return sums.reshape(shape)


def _in_batches(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow with a generator of column lists; ``make`` gets the batches as column lists."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for out in make(tuple(c.to_pylist() for c in b.columns) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def word_counts(docs: DataFrame, lang="lang", text="text") -> DataFrame:
    """(lang, word, n) over all rows with a text and a language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        counts = {}
        for langs, texts in batches:
            for own, body in zip(langs, texts):
                counts.setdefault(own, Counter()).update(words(body))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield from ([[own] * len(c), c.keys(), c.values()] for own, c in counts.items())
                counts = {}
        yield from ([[own] * len(c), c.keys(), c.values()] for own, c in counts.items())
    return _in_batches(rows, "lang string, word string, n bigint", count).groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def _expectations(counted: DataFrame, model: Model) -> DataFrame:
    """(piece number, lang number, expected count) of all counted words."""
    def add(batches):
        lattice = Lattice(model.vocabulary)
        of = {name: k for k, name in enumerate(model.languages)}
        sums = np.zeros(model.table.shape)
        for langs, found, n in batches:
            # Overlapping stretches of a long word are taken one after the other.
            parts = [((START + w)[at: at + SHORT], of[own], times) for own, w, times in zip(langs, found, n)
                     for at in range(0, len(w) + 1, SHORT)]
            stretches, language, times = zip(*parts)
            sums += model.expected(list(stretches), np.array(language), np.array(times, float), lattice)
        piece, k = np.nonzero(sums)
        yield piece, k, sums[piece, k]
    return _in_batches(counted, "piece int, k int, n double", add).groupBy("piece", "k").agg(
        F.sum("n").alias("n"))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities (see Model) of each language from the counts of its pieces and the pooled ones."""
    pooled = counts.sum(axis=1, keepdims=True) + 1.0
    table = (counts + SMOOTHING * pooled / pooled.sum()) / (counts.sum(axis=0) + SMOOTHING)
    return _with_unknown(np.maximum(table, FLOOR))


def _with_unknown(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.full((1, table.shape[1]), FLOOR)])


def fit(docs: DataFrame, vocabulary: list, lang="lang", text="text", rounds=ROUNDS) -> Model:
    """Model of all rows of ``docs`` that have a text and a language."""
    counted = materialize(word_counts(docs, lang, text), "language-words")
    learned = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(
        F.col(lang).cast("string").alias("lang")).count().orderBy("lang").collect()
    names = [r["lang"] for r in learned]
    shares = np.array([r["count"] for r in learned], float)
    priors = np.log(shares / shares.sum()) if names else shares
    model = Model(vocabulary, names, priors,
                  _with_unknown(np.full((len(vocabulary), len(names)), 1 / max(1, len(vocabulary)))))
    for _ in range(rounds if names else 0):
        counts = np.zeros(model.table.shape)
        for r in _expectations(counted, model).toLocalIterator():
            counts[r["piece"], r["k"]] = r["n"]
        model = Model(vocabulary, names, priors, smoothed(counts[:-1]))
    return model


def languages(docs: DataFrame, model: Model, id_column="doc_id", text="text") -> DataFrame:
    """Per row: id, lang_pred, score (probability of that language among the learned ones)."""
    kind = dict(docs.dtypes)[id_column]

    def make():
        each = model.scorer()
        return lambda keys, texts: (keys, *each(texts))
    return map_batches(docs.select(id_column, text), make,
                       f"`{id_column}` {kind}, lang_pred string, score double")
