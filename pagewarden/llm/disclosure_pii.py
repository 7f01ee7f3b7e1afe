"""Personal data: fixed patterns, and terms that give a protected entity away.

An entity is a value that a pattern found (an address, a phone number, ...). The REACH words on either
side of its mentions are its co-occurring terms. Over the whole corpus
the information that a term t reveals about an entity e is their pointwise mutual
information against the information content of e:

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + ln p(e | t) / IC(e)

with p(e | t) the share of the texts with t in which it stands near e, and IC(e) = -ln of the share of texts that
mention e. The share is not taken at face value but by its lower confidence bound, and the evidence counts
different texts only: a term that is seen once, or in any number of copies of one text, proves
nothing, at any size of the corpus. Terms with a disclosure of DISCLOSURE or more, and a bound of
CERTAINTY or more, are marked near the mentions of e, and generalised or removed.
"""

import hashlib
from bisect import bisect_left

import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagewarden.llm.common import map_batches, materialize

REACH = 5
DISCLOSURE = 0.8
CERTAINTY = 1 / 3  # two texts out of two reach it, one of one does not
Z = 1.96  # standard errors of the confidence bound
KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds. A run of digits is only entered at its
# start: entering it later fails or matches alike, and long runs stay linear.
DOMAIN = regex.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = regex.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = regex.compile(r"[\p{L}\p{N}]+")


def emails(text: str) -> list:
    """Leftmost matches, found from their at sign: the local part is the run before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at)
        start = at
        if match:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, match.end()))
                free = match.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict:
    ips = [m.span() for m in IP.finditer(text) if all(
        len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    cards = []
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


def _hash(s: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")), "big", signed=True)


def contexts(text: str, spans: dict) -> list:
    """(entity, term, start, end) for the words near every mention."""
    mentions = sorted((s, e, k) for k in KINDS for s, e in spans[k])
    if not mentions:
        return []
    words, rows, reach = [m.span() for m in WORD.finditer(text)], [], 0
    free = []  # words outside all mentions
    for low, high in words:
        while reach < len(mentions) and mentions[reach][1] <= low:
            reach += 1
        if not any(s < high and low < e for s, e, _ in mentions[reach: bisect_left(mentions, (high,))]):
            free.append((low, high))
    for s, e, kind in mentions:
        value = text[s:e].lower()
        entity = _hash(f"{kind}:{value if kind == 'email' else _digits(value)}")
        at = bisect_left(free, (s,))
        rows += [(entity, text[low:high].lower(), low, high)
                 for low, high in (*free[max(0, at - REACH): at], *free[at: at + REACH])]
    return rows


def _joined(spans: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def scan(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """One pass over the texts: base spans, their counts and digest, the contexts."""
    def each(keys, texts, hashes):
        out = [keys, hashes, *[[] for _ in range(7)]]
        for t in texts:
            t = t or ""
            spans = base_spans(t)
            base = _joined(spans)
            row = [*[len(spans[k]) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), base,
                   [dict(zip(("entity", "term", "start", "end"), r)) for r in contexts(t, spans)]]
            for column, value in zip(out[2:], row):
                column.append(value)
        return out
    kind = dict(docs.dtypes)[id_column]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_batches(
        docs.select(id_column, text, F.xxhash64(F.coalesce(F.col(text), F.lit("")))), lambda: each,
        f"`{id_column}` {kind}, text_hash bigint, {counts}, base_sha256 string, base string, "
        "near array<struct<entity: bigint, term: string, start: int, end: int>>")


def lower_bound(share, n):
    """Lower end of the score interval of a share seen in ``n`` trials (columns or numbers)."""
    root = ((share * (1 - share) + Z * Z / (4 * n)) / n) ** 0.5
    return (share + Z * Z / (2 * n) - Z * root) / (1 + Z * Z / n)


def disclosing_terms(scanned: DataFrame, docs: DataFrame, text="text", least=DISCLOSURE,
                     certainty=CERTAINTY) -> DataFrame:
    """(entity, term, disclosure) of all terms that give an entity away.

    Shares are of rows, the number of trials is of different texts.
    """
    near = scanned.select("text_hash", F.explode("near").alias("n")).select("n.entity", "n.term", "text_hash")
    seen = materialize(scanned.select("text_hash", F.explode(F.array_distinct(F.transform(
        "near", lambda n: F.struct(n["entity"].alias("entity"), n["term"].alias("term"))))).alias("n"))
        .groupBy("n.entity", "n.term", "text_hash").agg(F.count("*").alias("rows")), "pii-near")
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_texts"), F.sum("rows").alias("n_near"))
    # Pairs that could not be certain even if every text with the term were near the entity.
    pairs = materialize(pairs.where(lower_bound(F.lit(1.0), F.col("n_texts")) >= certainty), "pii-pairs")
    terms = materialize(pairs.select("term").distinct(), "pii-terms")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    # Counted before the join: a common word then meets its term once, not in each text.
    counts = words.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term")
    mentions = near.groupBy("entity").agg(F.count_distinct("text_hash").alias("n_entity"))
    total = max(2, scanned.select("text_hash").distinct().count())
    share = F.least(F.lit(1.0), F.col("n_near") / F.coalesce("n_term", "n_near"))
    bound = lower_bound(F.col("share"), F.col("n_texts") / F.col("share"))
    content = -F.ln(F.least(F.col("n_entity") / F.lit(float(total)), F.lit(0.5)))
    return materialize(
        pairs.join(mentions, "entity").join(counts, "term", "left").withColumn("share", share)
        .withColumn("bound", bound).where(F.col("bound") >= certainty)
        .select("entity", "term", (1 + F.ln("bound") / content).alias("disclosure"))
        .where(F.col("disclosure") >= least), "pii-disclosing")


def find_spans(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """Per row: id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, base, terms (sorted
    spans of disclosing terms), spans (all, as text).

    Null and empty texts have none. Ids may be null or repeat; copies of a row under one
    id share their term spans.
    """
    scanned = materialize(scan(docs, id_column, text), "pii-scan")
    flagged = disclosing_terms(scanned, docs, text)
    near = scanned.select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash"),
                          F.explode("near").alias("n")).select(
        "_id", "_hash", "n.entity", "n.term", F.struct("n.start", "n.end").alias("span"))
    terms = near.join(flagged, ["entity", "term"]).groupBy("_id", "_hash").agg(
        F.array_sort(F.collect_set("span")).alias("terms"))
    terms = materialize(terms, "pii-spans")
    out = scanned.join(terms, F.col(id_column).eqNullSafe(F.col("_id"))
                       & (F.col("text_hash") == F.col("_hash")), "left")
    said = F.expr("array_join(transform(coalesce(terms, array()), "
                  "t -> concat('term:', t.start, ':', t.end)), ',')")
    return out.select(
        id_column, "text_hash", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "terms",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")),
                    F.when(said != "", said)).alias("spans"))


def sanitise(text: str, spans: str) -> str:
    """Base spans and names become their kind, numbers their length class, other terms go."""
    out, at = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in
                             (x.split(":") for x in spans.split(",") if x)):
        if s < at:
            continue
        word = text[s:e]
        new = f"[{kind.upper()}]"
        if kind == "term":
            new = "[NAME]" if word[:1].isupper() else "[NUMBER]" if word.isdigit() else ""
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, found: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """id and the sanitised text of every row; ``found`` comes from ``find_spans``."""
    keys = found.select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash"),
                        "spans").dropDuplicates(["_id", "_hash"])
    joined = docs.select(id_column, text).join(keys, F.col(id_column).eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_hash")), "left")
    kind = dict(docs.dtypes)[id_column]
    return map_batches(
        joined.select(id_column, text, "spans"), lambda: lambda keys, texts, spans: (
            keys, [None if t is None else sanitise(t, s or "") for t, s in zip(texts, spans)]),
        f"`{id_column}` {kind}, sanitised string")
