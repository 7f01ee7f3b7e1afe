"""Corpus operators against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import public_tokenizers

from pagewarden.operators.scale import run_dir
from pagewarden.llm import (
    bpe_automaton, disclosure_pii, line_spread, phrase_fingerprint, quality_qda, queries,
    simhash_tiles, site_template, template_leaks, url_language, warc,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, fp string, _id int"
PAGES = "page_id bigint, url string, html string, host string, key int"
VOCAB = public_tokenizers.path(queries.VOCABULARY)


def documents(spark, rows):
    """(doc_id, text[, source]); the other columns have names that operators use inside."""
    return spark.createDataFrame(
        [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", 1) for r in rows], DOCS)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES)


WORDS = [f"{a}{b}" for a in "ba ke lo mi nu so ta vi".split() for b in "ran den lis mot".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGE = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, " \n "),
        (5, "word " * 60_000), (None, None), (6, "ß😀 \u0000 Σ")]


# --- encoding

def test_encoding_is_the_librarys(spark):
    rng = random.Random(7)
    texts = [t for _, t in EDGE] + ["".join(rng.choice("aab hé's1!<|endoftext|>") for _ in range(80))
                                    for _ in range(200)]
    library = Tokenizer.from_file(VOCAB)
    library.no_truncation()
    library.no_padding()
    df = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in bpe_automaton.encode_texts(df, VOCAB).collect()}
    digests = {r.doc_id: r for r in bpe_automaton.token_digests(df, VOCAB).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, decoded)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert digests[i].n_tokens == len(ids)


def test_encoder_reads_chunks_between_any_spaces_and_is_kept(monkeypatch):
    rng = random.Random(8)
    odd = [chr(c) for c in (*range(1, 48), 0x85, 0xa0, 0x1680, *range(0x2000, 0x2011), 0x2028, 0x202f, 0x205f, 0x3000,
                            0x200b, 0xfeff, 0x301, 0x308, 0x307, 0x130, 0x3a3, 0x1e9e, 0x37e, 0x212b, 0xfb01)]
    texts = ["".join(rng.choice(odd + list("aeinst'sAO12")) for _ in range(60)) for _ in range(400)]
    library = Tokenizer.from_file(VOCAB)
    library.no_truncation()
    library.no_padding()
    encoder = bpe_automaton.encoder_of(VOCAB)
    for limit in (400_000, 8):  # the least keeps next to nothing
        monkeypatch.setattr(encoder, "known", bpe_automaton.Kept(limit))
        monkeypatch.setattr(encoder, "chunks", bpe_automaton.Kept(limit))
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            got = encoder.run(text)
            assert got == (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))
        assert len(encoder.chunks.recent) <= limit // 2
    # Read once in a worker; a word of the vocabulary needs no walk over its prefixes.
    assert bpe_automaton.encoder_of(VOCAB) is encoder
    monkeypatch.setattr(encoder.automaton, "_reach", None)
    assert len(encoder.automaton.encode(b"the")) == 1


# --- near duplicates

def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, f"{prints[i]:016x}", least.get(find(i))) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("tile", [8, 1024])
def test_components(spark, monkeypatch, tile):
    rng = random.Random(3)
    rows = [(k, t) for k, t in EDGE if t is None or len(t) < 1000]
    base = sentence(rng, 300).split()
    for i in range(100, 140):  # near copies that chain, in shuffled order of id
        base[rng.randrange(300)] = rng.choice(WORDS)
        rows.append((rng.randrange(1000, 10 ** 6), " ".join(base)))
    rows += [(i, sentence(rng, rng.randint(1, 40))) for i in range(200, 240)]
    monkeypatch.setattr(simhash_tiles, "MIN_TILE", tile)
    monkeypatch.setattr(simhash_tiles, "MAX_TILE", tile)
    got = simhash_tiles.near_duplicates(documents(spark, rows)).select(
        "doc_id", F.lower(F.hex("fp")), "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


def test_one_of_each(spark):
    rng = random.Random(5)
    long = sentence(rng, 200)
    rows = [(9, long), (4, long), (4, long), (7, long + " extra"), (8, sentence(rng, 200)),
            (None, sentence(rng, 100)), (11, None), (10, "")]
    kept = simhash_tiles.one_of_each(documents(spark, rows))
    assert kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert sorted((r.doc_id if r.doc_id is not None else -1 for r in kept.collect())) == [-1, 4, 8, 10]


def test_unit_links_of_a_dense_group():
    rng = np.random.default_rng(1)
    fps = np.uint64(0xF0F0) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fps = np.unique(fps)
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    links = simhash_tiles.unit_links(fps[order], 4)
    assert len({x for pair in links for x in pair}) == len(fps)


# --- lines

def test_lines(spark):
    own = "my own words here that only I have written down"
    rows = [(i, f"{own} {i}\nshared by all of us\n\n  two sites only", f"s{i % 2}") for i in range(4)]
    rows += [(i, f"{own} {i}\n shared by all of us ", f"s{i}") for i in range(4, 6)]
    rows += [(10 + i, "copied text", f"s{i}") for i in range(5)]
    rows += [(20, None), (21, ""), (None, "nobody\nelse", None), (22, "nobody\nelse", None), (22, "nobody\nelse", None)]
    got = {r.doc_id: r for r in line_spread.without_repeated_lines(documents(spark, rows)).collect()}
    assert got[0].clean == f"{own} 0\n\n  two sites only" and got[0].n_removed == 1
    assert got[4].clean == f"{own} 4"
    assert got[10].clean == "copied text"  # a copy, not boilerplate
    assert (got[20].clean, got[20].n_lines, got[21].clean) == (None, 0, "")
    assert got[22].clean == "nobody\nelse"


def test_own_lines_beside_a_long_passage(spark):
    import corpus_pipeline
    rng = random.Random(17)
    passage = sentence(rng, 80)
    own = [sentence(rng, 20) for _ in range(4)]
    lines = [sentence(rng, 20) for _ in range(30)]
    rows = [(i, f"{own[i]}\n{passage}", f"s{i}") for i in range(4)]
    near = {10 + i: "\n".join([*lines[:i], lines[i] + " twice", *lines[i + 1:]]) for i in range(4)}
    rows += [(k, t, f"s{k}") for k, t in near.items()]
    rows += [(20 + i, passage, f"s{i}") for i in range(2)] + [(None, passage, "s"), (30, None), (31, "")]
    # every row but the empty ones is mostly lines of three or more sites
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), None).collect()}
    assert len(got) == len(rows)
    assert [(got[i].text, got[i].n_chars) for i in range(4)] == [(t, len(t)) for t in own]
    assert {k: got[k].text for k in near} == near  # near copies are left to the next stage
    assert got[20].text == got[21].text == got[None].text == passage  # nothing of their own
    assert (got[30].text, got[31].text) == (None, "")


@pytest.mark.parametrize("threshold", [3, 40])
def test_line_spread_is_exact(spark, threshold):
    rng = random.Random(threshold)
    rows, sites = [], {}
    for line in range(60):
        for site in rng.sample(range(100), rng.randint(1, 80)):
            rows.append((len(rows), f"line {line}", f"s{site}"))
            sites.setdefault(line, set()).add(site)
    got = {r.line for r in line_spread.repeated_lines(documents(spark, rows), threshold).collect()}
    want = {f"line {k}" for k, v in sites.items() if len(v) >= threshold}
    hashes = {r.h for r in spark.createDataFrame([(w,) for w in want] or [("",)], "w string").select(
        F.xxhash64("w").alias("h")).collect()}
    assert got == (hashes if want else set())


# --- quality

def test_quality_learns_and_keeps(spark):
    rng = random.Random(2)
    good = [(i, sentence(rng, rng.randint(5, 300)).capitalize() + ".") for i in range(300)]
    bad = [(i, " ".join([rng.choice(WORDS)] * 80) if i // 2 % 2 else sentence(rng, 60).upper().replace(" ", "!! "))
           for i in range(300, 600)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 600, 2)] + [(1, None), (None, 1)],
                                   "doc_id bigint, quality int")
    stats = quality_qda.with_statistics(docs)
    model = quality_qda.fit(stats, labels)
    odd = [r for r in quality_qda.score_statistics(stats, model).collect() if r.doc_id % 2]
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 300) for r in odd]) > 0.97
    scored = quality_qda.with_score(documents(spark, EDGE), model, "_q").collect()
    assert len(scored) == len(EDGE) and all(0 <= r["_q"] <= 1 for r in scored)
    one_class = quality_qda.fit(stats, labels.where("quality = 1"))
    assert {r.score for r in quality_qda.score_statistics(stats, one_class).collect()} == {1.0}
    none = quality_qda.fit(stats.limit(0), labels)
    assert quality_qda.score_statistics(stats.limit(1), none).first().score == 0.5


# --- leaks

def test_leaks(spark):
    rng = random.Random(9)
    plain = sentence(rng, 40)
    slotted = ("a train leaves the town with 12 wagons and Anna counts 12 kg of coal in each while "
               "her friend, Bert sees 30 birds and asks Anna how many wagons pass in 30 minutes")
    items = spark.createDataFrame([(1, plain), (2, slotted), (3, None), (4, ""), (None, plain)],
                                  "item_id bigint, text string")
    changed = slotted.replace("12", "77").replace("Anna", "Clara").replace("30", "41")
    mixed = slotted.replace("12 w", "5 w").replace("12 k", "6 k").replace("30 b", "7 b").replace("30 m", "8 m") \
        .replace("Anna c", "Ida c").replace("Anna h", "Eva h").replace("Bert", "Ida")
    rows = [(1, f"{sentence(rng, 50)} {plain} {sentence(rng, 50)}"), (2, f"{sentence(rng, 9)}. {changed}"),
            (3, f"x. {mixed}"), (4, sentence(rng, 300)), (5, plain.upper()), (6, " ".join(plain.split()[:20])),
            *[(k, t) for k, t in EDGE if k not in (1, 2, 3, 4, 5, 6)], (7, plain), (7, plain)]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in template_leaks.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 1), (7, 1)}
    assert got[2, 2].changed > 0 and got[2, 2].n_slots >= 5
    left = template_leaks.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [3, 4, 6]
    assert template_leaks.leaks(docs, items.limit(0)).count() == 0
    shuffled = template_leaks.BROADCAST_WINDOWS
    try:
        template_leaks.BROADCAST_WINDOWS = 0
        assert {(r.doc_id, r.item_id) for r in template_leaks.leaks(docs, items).collect()} == set(got)
    finally:
        template_leaks.BROADCAST_WINDOWS = shuffled


def test_names_at_the_start_of_sentences(spark):
    items = spark.createDataFrame([
        (1, "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have?"),
        (2, "the quick river runs below nine old bridges and then it meets the cold grey sea again")],
        "item_id bigint, text string")
    rows = [(1, "Ann has 7 apples. Ann buys 4 more apples. How many apples does Ann have?"),
            (2, "It said:\n\"Joe has 12 apples. Joe buys 30 more apples. How many apples does Joe have?\" And so on."),
            (3, "Ann has 7 apples. Bob buys 4 more apples. Why many apples does Eve have?"),  # not one question
            (4, "He has 5 apples."),
            (5, "So the quick river runs below ten old bridges and then it meets the cold grey sea again."),  # a word
            (6, "a quick river ran below nine bridges and it met the cold sea again, the grey sea")]
    got = {(r.doc_id, r.item_id) for r in template_leaks.leaks(documents(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (5, 2)}


# --- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    test = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(s),
            "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return {k: [m.span() for m in p.finditer(text) if test[k](m.group())] for k, p in PLAIN.items()}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-1 4+25(é", max_size=60) | st.text(max_size=30))
def test_base_spans(text):
    assert disclosure_pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    text = "1" * 300_000 + " a" * 10 + "@" * 50_000 + " 4465758382889437 x 10.0.0.256 10.0.0.25"
    assert {k: len(v) for k, v in disclosure_pii.base_spans(text).items()} == {
        "email": 0, "ip": 1, "card": 1, "phone": 0}


def test_disclosing_terms(spark):
    rng = random.Random(4)
    rows = [(i, f"{sentence(rng, 30)} write to Zebulon at zeb@mail.example.com {sentence(rng, 30)}") for i in range(6)]
    rows += [(100 + i, f"write to Norma at box{i}@mail.example.com now " + sentence(rng, 40)) for i in range(40)]
    rows += [(200 + i, "Secretword " + "x@y.zz copied text") for i in range(5)]
    rows += [(i, sentence(rng, 50)) for i in range(300, 500)] + EDGE
    docs = documents(spark, rows)
    found = disclosure_pii.find_spans(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, r)
    assert "term:" in got[0].spans and got[0].n_email == 1
    text = rows[0][1]
    marked = [text[t.start:t.end] for t in got[0].terms]
    assert "Zebulon" in marked and "write" not in marked
    assert all("term" not in got[100 + i].spans for i in range(40))
    assert "term" not in got[200].spans  # copies are one context
    assert got[1].base_sha256 == hashlib.sha256(got[1].base.encode()).hexdigest()
    clean = {r.doc_id: r.sanitised for r in disclosure_pii.sanitised(docs, found).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and "[NAME]" in clean[0]
    assert len(found.collect()) == len(rows)


def test_disclosure_by_hand(spark):
    rng = random.Random(12)
    people = ["Ulla", "Odo", "Ines", "Wim"]
    rows = []
    for i in range(120):
        who, other = rng.randrange(4), rng.randrange(4)
        text = f"{sentence(rng, 8)} ask {people[who if rng.random() < 0.8 else other]} or a{who}@mail.example.com, {sentence(rng, 8)}"
        rows += [(i, text)] * rng.choice([1, 1, 3])
    rows += [(500 + i, sentence(rng, 12)) for i in range(80)]
    rows.append((900, "Far " + "é" * 900 + " nobody@mail.example.com"))
    near, having, entities = {}, {}, {}
    for key, text in rows:
        spans = disclosure_pii.base_spans(text)
        for term in set(re.findall(r"\w+", text.lower())):
            having[term] = having.get(term, 0) + 1
        for s, e in spans["email"]:
            entities.setdefault(text[s:e], set()).add(text)
            words = [(m.start(), m.group().lower()) for m in re.finditer(r"\w+", text) if m.end() <= s or m.start() >= e]
            before = [w for at, w in words if at < s][-5:]
            after = [w for at, w in words if at >= e][:5]
            for term in {*before, *after}:
                near.setdefault((text[s:e], term), []).append(text)
    total, want = len({t for _, t in rows}), set()
    for (entity, term), texts in near.items():
        p = len(texts) / having[term]
        n = len(set(texts)) / p
        z = 1.96
        low = (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
        if low >= 1 / 3 and 1 + np.log(low) / -np.log(min(0.5, len(entities[entity]) / total)) >= 0.4:
            want.add((disclosure_pii._hash(f"email:{entity}"), term))
    docs = documents(spark, rows)
    got = disclosure_pii.disclosing_terms(disclosure_pii.scan(docs), docs, least=0.4).collect()
    assert {(r.entity, r.term) for r in got} == want
    assert {t for _, t in want} >= {"ulla", "wim"}
    assert "far" not in {w for _, w, *_ in disclosure_pii.contexts(rows[0][1], disclosure_pii.base_spans(rows[0][1]))}
    words = [w for _, w, *_ in disclosure_pii.contexts(rows[-1][1], disclosure_pii.base_spans(rows[-1][1]))]
    assert words == ["far", "é" * 900]  # however long the words are


# --- fingerprints

def brute_edit(rows):
    hashed = sorted(((k is not None, k or 0, t or "") for k, t in rows), key=lambda r: r[:2])
    out = {}
    for (_, k, t), (_, _, nxt) in zip(hashed, hashed[1:] + hashed[:1]):
        n = len(t) // 4
        out[k] = (len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows_per_task", [3, 2000])
def test_edited_texts(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(phrase_fingerprint, "ROWS_PER_TASK", rows_per_task)
    rng = random.Random(6)
    rows = [(k, sentence(rng, rng.randint(1, 200))) for k in rng.sample(range(-500, 5000), 60)]
    rows += [(9001, ""), (9002, None)]
    got = {r.doc_id: r for r in phrase_fingerprint.edit_likeness(documents(spark, rows)).collect()}
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == brute_edit(rows)
    long = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))


def test_fingerprints_edge(spark):
    got = phrase_fingerprint.edit_likeness(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    single = phrase_fingerprint.edit_likeness(documents(spark, [(1, "abcdefgh")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert phrase_fingerprint.edit_likeness(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc é", max_size=12), st.integers(0, 5))
def test_parsing_ignores_offsets(prefix, seed):
    text = sentence(random.Random(seed), 120)
    one, other, alone = phrase_fingerprint.sketches([text, prefix + text, "x"])
    assert phrase_fingerprint.likeness(one, other) > 0.8
    assert phrase_fingerprint.sketches([text])[0] == one


# --- URLs

def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in rules:
        rule_host, rest = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def test_urls(spark):
    rng = random.Random(8)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'M.', ''])}{rng.choice(WORDS)}.Example."
            f"{rng.choice(['net', 'com', 'org', 'ÄB'])}{rng.choice(['/en/', '/de/', '/fr/x', '', '/', '/de'])}"
            f"{rng.choice(['', '?a=/en/', '#://b', 'é'])}" for _ in range(300)]
    urls += [f"http://{w}-{rng.choice(WORDS)}.example.org/{i}" for i in range(30) for w in ("casino", "cheap-pills")]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://net/", "http://net"]
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], None)])
    got = url_language.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r.page_id is None:
            continue
        assert (r.host, r.path, r.rule) == brute_url(urls[r.page_id], queries.URL_RULES)
        if r.rule:
            assert r.verdict == queries.URL_RULES[r.rule]
        elif urls[r.page_id] and ("casino" in urls[r.page_id] or "pills" in urls[r.page_id]):
            assert r.verdict == "block"
        elif ".Example." in (urls[r.page_id] or ""):
            assert r.verdict == "allow"
    assert url_language.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_log_model_is_a_distribution():
    rng = np.random.default_rng(0)
    counts = np.zeros(url_language.K ** url_language.ORDER)
    counts[rng.integers(0, len(counts), 5000)] = rng.integers(1, 9, 5000)
    p = np.exp(url_language.log_model(counts)).reshape(-1, url_language.K)
    assert np.allclose(p.sum(axis=1), 1)


# --- archives

def test_warc_round_trip(spark, tmp_path, capsys):
    big, small = "<p>" + "é" * 200, "<p>tiny"
    rows = [(5, "http://a/ä b", big), (2, None, big), (9, "u\r\nX: y", big), (3, "u", small), (4, "u", small),
            (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "x" * 300_000), (2, "again", big)]
    folder = warc.archive(pages(spark, rows), str(tmp_path / "w"))
    df = spark.read.format("warc").load(folder)
    got = df.collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.page_id, []).append(r)
    assert [r.warc_type for r in of[2]] == ["response"] * 2 and of[None][0].warc_type == "response"
    assert (of[5][0].warc_type, of[5][0].refers_to, of[5][0].payload) == ("revisit", 2, None)
    assert of[3][0].warc_type == of[4][0].warc_type == "response"
    html = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        assert r.payload_length == len(html[r.page_id])
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        if r.warc_type == "response":
            assert bytes(r.payload) == html[r.page_id]
    assert df.where("warc_type = 'revisit'").count() == 2
    assert df.where("target_uri LIKE 'aga%'").count() == 1
    assert df.count() == len(rows)  # predicates of earlier queries leave no trace
    assert df.where("warc_type = 'revisit'").union(df.where("warc_type = 'response'")).count() == len(rows)
    assert warc.pushed(spark, folder, "warc_type = 'revisit'").count() == 2
    assert warc.pushed(spark, folder, "warc_type IN ('revisit', 'response') AND page_id = 8").count() == 1
    some = warc.pushed(spark, folder, "target_uri LIKE 'aga%'", payload=False)
    assert [(r.page_id, r.payload) for r in some.collect()] == [(2, None)]
    some.explain("formatted")
    assert "StringStartsWith(target_uri,aga)" in capsys.readouterr().out
    bare = spark.read.format("warc").option("payload", "false").load(folder)
    assert bare.where("payload IS NOT NULL").count() == 0 and bare.count() == len(rows)
    warc.archive(pages(spark, [(50, "more", big), (51, "more", None)]), folder)  # appended: nothing is hidden

    def now():
        return spark.read.format("warc").load(folder)
    assert df.count() == len(rows) and now().count() == len(rows) + 2
    assert now().where("page_id >= 50 AND warc_type = 'response'").count() == 2
    warc.records_of(pages(spark, [(60, "new", small)])).write.format("warc").mode("overwrite").save(folder)
    assert [r.page_id for r in now().collect()] == [60]
    warc.archive(pages(spark, [(61, "new", small)]), folder)
    assert sorted(r.page_id for r in now().collect()) == [60, 61]
    assert warc.archive(pages(spark, [])).startswith(run_dir(spark))
    empty = warc.archive(pages(spark, []), str(tmp_path / "e"))
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_of_other_writers():
    import gzip
    raw = [warc.record(i, "u", "response", "d", 3, None, b"abc") for i in range(3)]
    forms = (b"".join(raw), b"".join(map(gzip.compress, raw)), b"".join(map(warc.member, raw)),
             gzip.compress(b"".join(raw)), warc.member(raw[0]) + gzip.compress(raw[1] + raw[2]),
             gzip.compress(raw[0] + raw[1][:9]) + gzip.compress(b"") + gzip.compress(raw[1][9:] + raw[2]))
    for data in forms:
        found = list(warc.records(data, lambda h: h["x-page-id"] != "1", True))
        assert [(h["x-page-id"], p) for h, p in found] == [("0", b"abc"), ("2", b"abc")]
    assert list(warc.records(b"", lambda h: True, True)) == []


def test_warc_records_of_any_size_in_small_chunks(monkeypatch):
    import gzip
    monkeypatch.setattr(warc, "CHUNK_BYTES", 97)
    monkeypatch.setattr(warc, "PIECE_BYTES", 13)
    monkeypatch.setattr(warc, "HEAD_BYTES", 64)
    rng = random.Random(3)
    payloads = [rng.randbytes(rng.choice([0, 1, 50, 96, 97, 98, 5000])) for _ in range(60)]
    raw = [warc.record(i, "u" * rng.randrange(300), "response", "d", len(p), None, p) for i, p in enumerate(payloads)]
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw)), b"".join(map(warc.member, raw)),
                 gzip.compress(b"".join(raw))):
        for with_payload in (True, False):
            found = list(warc.records(data, lambda h: int(h["x-page-id"]) % 3 != 0, with_payload))
            assert [(int(h["x-page-id"]), p) for h, p in found] == [
                (i, p if with_payload else None) for i, p in enumerate(payloads) if i % 3 != 0]


def test_broken_archives_are_errors(spark, tmp_path):
    import gzip
    raw = [warc.record(i, "u", "response", "d", 3, None, b"abc") for i in range(3)]
    bad_length = raw[0].replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(warc.HTTP % 3) + 3),
                                b"Content-Length: x\r\n\r\nHTTP")
    assert bad_length != raw[0]
    broken = [raw[0] + b"nonsense" + raw[1], raw[0] + raw[1][:-20], raw[0] + b"WARC/1.1\r\nno: end", bad_length]
    packed = [gzip.compress(b) for b in broken]
    cut = [gzip.compress(raw[0])[:-30], warc.member(raw[0])[:-30], warc.member(raw[0]) + b"\x1f\x8b\x08\x04"]
    for data in broken + packed + cut:
        for with_payload in (True, False):
            with pytest.raises((ValueError, warc.zlib.error)):
                list(warc.records(data, lambda h: True, with_payload))
    warc.register(spark)
    (tmp_path / "broken.warc").write_bytes(broken[0])
    with pytest.raises(Exception, match="broken.warc"):
        spark.read.format("warc").load(str(tmp_path)).count()


def test_foreign_archive_time_is_linear():
    import gzip
    import time
    rng = random.Random(5)

    def seconds(n):
        data = b"".join(gzip.compress(warc.record(i, "u", "response", "d", 4000, None, rng.randbytes(4000)), 1)
                        for i in range(n))
        start = time.process_time()
        assert sum(1 for _ in warc.records(data, lambda h: True, True)) == n
        return time.process_time() - start
    seconds(500)
    small, large = seconds(2000), seconds(8000)
    assert large < 8 * small + 0.5 and large < 10


def test_warc_skips_unwanted_payloads(monkeypatch):
    data = warc.member(warc.record(1, "u", "response", "d", 10 ** 6, None, random.Random(1).randbytes(10 ** 6)))
    inflated = []
    real = warc.zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.inner = real(*a)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert list(warc.records(data, lambda h: False, True)) == []
    assert sum(inflated) <= 2 * warc.HEAD_BYTES


# --- pages

def page(body, title="t"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body>"
            f"<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy</div>{body}"
            "<div id=comments><p>Reader says</p></div><footer>&copy; us</footer></body></html>")


@pytest.mark.parametrize("body,want", [
    ("<article><h1>A &amp;  B</h1><p>one<br>two<p><b>three</p>four</article>", "A & B\n\none two\n\nthree\n\nfour"),
    ("<main><p>x <i>y</i>z</p><form><p>no</p></form><!-- <p>c</p> --></main>", "x yz"),
    ("<article><aside>no</aside><header><h1>Head</h1></header><p>t &#x41;&amp</p></article>", "Head\n\nt A&"),
    ("<article><div class='share-buttons'>no</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>",
     "a\n\nb\n\nc\n\nd"),
    ("<article></article>", ""),
    ("<div><p>long enough text of the page</p></div>", "long enough text of the page"),
])
def test_main_text(body, want):
    assert site_template.main_text(page(body)) == want


def test_templates(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>{sentence(rng, 4)}</h1><p>{sentence(rng, 20)}</p>"
                                             "<p>Read more on our site</p><p>All rights kept</p><div><p>Call us</p></div>"
                                             "</article>", sentence(rng, 3))) for i in range(20)]
    copies = [(100 + i, f"http://copy.example/{i}", page("<article><h1>Same</h1><p>one</p><p>two</p><p>three</p></article>",
                                                        "Same")) for i in range(20)]
    odd = [(200, "http://one.example/", page("<article><p>Read more on our site</p></article>")), (201, None, None),
           (202, "http://h.example/x", ""), (203, "http://h.example/y", "<" * 2000 + "<p>" * 3000), (None, "u", "<p>a")]
    got = {r.page_id: r for r in site_template.extract(pages(spark, rows + copies + odd)).collect()}
    assert all("Read more" not in got[i].text and got[i].text.count("\n\n") == 1 for i in range(20))
    assert all(got[100 + i].text == "Same\n\none\n\ntwo\n\nthree" for i in range(20))
    assert got[200].text == "Read more on our site" and got[201].text == "" and got[202].text == ""
    assert got[None].text == "a" and got[200].n_chars == 21
    assert site_template.extract(pages(spark, [])).count() == 0


# --- registered queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_queries_cover_their_tables(spark, name):
    rows = queries.Q[name][0](spark, SMALL).collect()
    table = "pages" if name.split("_")[0] in ("op1", "op2", "op3") else "documents"
    if name.startswith("op5"):
        texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
        items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
        flat = lambda t: t.replace("\n", " ")
        whole = {(d.doc_id, b.item_id) for d in texts for b in items if flat(b.text) in flat(d.text)}
        assert whole <= {(r.doc_id, r.item_id) for r in rows}
    elif name.startswith("op11"):
        assert {r.anchor_id for r in rows} == set(range(0, spark.read.parquet(f"{SMALL}/embeddings.parquet").count(), 50))
    elif name.startswith("op13"):
        turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
        assert [r.n_convs for r in rows if r.depth == 0] == [turns.select("conv_id").distinct().count()]
    else:
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SMALL).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) > 0
    leaked = {r.doc_id for r in queries.op5(spark, SMALL).collect()}
    assert not leaked & set(ids)


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing(spark, stage):
    import corpus_pipeline
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert run(spark, docs.limit(0), SMALL).count() == 0
