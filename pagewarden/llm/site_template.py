"""Main text of pages by template deduction over the pages of a host.

Each page is a sequence of tokens: elements by their path, and texts by path and
content. The occurrence vector of a token says how often it stands on each page of
the host. Tokens with equal vectors form an equivalence class; a class that is
large and frequent enough is valid and belongs to the template. Vectors are never
gathered: two are equal if their sums of hashed (page, count) pairs and their
support are, so classes come from two aggregations with map-side sums, whatever the
number of pages of a host. A repeated row counts as often as it stands there.

Valid classes nest along the element paths and are ordered: a second pass over the pages keeps of a class the tokens
that follow the same token of their class wherever they stand. What lies between template elements are slots.
The main slot is the article: an article or main element, else the innermost section of the template around
most unlinked text that is not of the template, over the host's pages (without a template, the section that
holds most unlinked text). A slot is a whole subtree: nested sections, quotes and tables
belong to it, and it widens to the section around it while that has own text which is neither linked nor of the template
(a heading above the body). From it go regions that are no article by
element or class name, and texts of the template (constant over the host).
"""

import html as html_lib
import re

import xxhash
from pyspark.sql import DataFrame, functions as F

from pagewarden.llm.common import map_batches, materialize

MIN_PAGES = 5
MIN_SUPPORT = 0.5
MIN_CLASS = 3
CONSTANT_SUPPORT = 0.6

# Element names and class words.
RAW = frozenset("script style noscript template textarea iframe title svg object select math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("article aside body div footer form header html main nav section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies disqus footer header hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promoted recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe teaser toolbar widget widgets".split())
CLOSES_P = BLOCKS - {"html", "body"}
SELF_NESTING = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"),
                "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_SEED_STRUCT, _SEED_TEXT = 1, 2
LOW, HIGH = 1 << 32, 1 << 31


def _hash(text: str, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return value - (1 << 64) if value >> 63 else value


def _tag_end(source: str, at: int) -> int:
    """Position after the > that ends a tag; quoted values may hold one."""
    i, n = at, len(source)
    close = source.find(">", i)
    if close < 0:
        return n
    if '"' not in source[i:close] and "'" not in source[i:close]:
        return close + 1
    while i < n:
        c = source[i]
        if c == ">":
            return i + 1
        if c in "\"'" and source[i - 1: i] in ("=", " "):
            end = source.find(c, i + 1)
            if end < 0:
                return close + 1
            i = end
        i += 1
    return n


def tokens(source: str):
    """("open", name, attributes), ("close", name, ""), ("text", text, "") and
    ("title", text, ""); contents of scripts, styles and comments are passed over."""
    at, n = 0, len(source)
    low = None
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", source[at:], ""
            return
        if lt > at:
            yield "text", source[at:lt], ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(source, lt)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = _tag_end(source, m.end())
        name = m.group(2).lower()
        if m.group(1):
            yield "close", name, ""
        elif name in RAW:
            low = source.lower() if low is None else low
            if len(low) != n:  # a letter whose lower case is longer
                low = source.translate({c: c + 32 for c in range(65, 91)})
            stop = low.find(f"</{name}", end)
            if name == "title":
                yield "title", source[end: n if stop < 0 else stop], ""
            if stop < 0:
                return
            end = _tag_end(source, stop + 2 + len(name))
        else:
            yield "open", name, source[m.end(): end - 1]
        at = end


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE and not (name == "header" and in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTR.findall(attributes):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key in ("class", "id", "role") and OUTSIDE_WORDS.intersection(_WORDS.findall(value)):
            return name not in ("html", "body", "article", "main")
        if key == "hidden" or key == "aria-hidden" and value == "true" \
                or key == "style" and re.search(r"display\s*:\s*none", value):
            return name not in ("html", "body")
    return False


def texts(source: str, slot=None):
    """Walks a page: (kind, here, block, text) of every text; kind is "open" for elements.

    ``here`` is (name, path, section, outside, linked, main, inside) of the element around: ``path`` is the hash of the
    element path, ``section`` that of the sectioning elements only, ``inside`` is whether the section
    ``slot`` is around it. For elements the text is the section around theirs.
    """
    stack = []
    count, block = {}, 0
    top = here = ("", 0, 0, False, False, False, False)

    def pop():
        nonlocal here
        name = stack.pop()[0]
        count[name] -= 1
        here = stack[-1] if stack else top
        return name

    for kind, value, attributes in tokens(source):
        if kind in ("text", "title"):
            if not value.isspace():
                yield kind, here, block, value
            continue
        if kind == "open":
            if value in CLOSES_P and count.get("p"):
                while pop() != "p":
                    pass
                block += 1
            limits = SELF_NESTING.get(value)
            if limits and count.get(value):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limits:
                        break
                    if stack[i][0] == value:
                        while len(stack) > i:
                            pop()
                        break
            if value in BLOCKS:
                block += 1
            if value in VOID:
                if value == "br":
                    yield "text", here, block, " "
                continue
            _, path, section, outside, linked, main, inside = here
            label = value
            if value in SECTIONS and "class" in attributes:
                m = re.search(r"""class\s*=\s*["']?([^"'>]*)""", attributes)
                label += "." + m.group(1).strip() if m else ""
            main = main or value in ("article", "main") or 'role="main"' in attributes
            around = section
            if value in SECTIONS:
                section = _hash(f"{section}/{label}", _SEED_STRUCT)
            entry = (value, _hash(f"{path}/{label}", _SEED_STRUCT), section,
                     outside or _outside(value, attributes, main), linked or value == "a", main,
                     inside or section == slot)
            if not attributes.rstrip().endswith("/") or value in BLOCKS:
                stack.append(entry)
                count[value] = count.get(value, 0) + 1
                here = entry
            yield "open", entry, block, around
        elif value in VOID or not count.get(value):
            if value in ("p", "br"):
                block += 1
        else:
            while pop() != value:
                block += 1
            if value in BLOCKS:
                block += 1


def _shown(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def page_tokens(source: str) -> tuple:
    """({(kind, token): count}, {section: unlinked characters}) of one page; kinds: 0 element, 1 text, 2 title text."""
    found, mass = {(0, 0): 1}, {}
    for kind, here, _, value in texts(source):
        if kind == "open":
            key = (0, here[1])
        else:
            shown = _shown(value)
            if not shown:
                continue
            if kind == "title" or here[0] in HEADINGS:
                key = (2, _hash(shown, _SEED_TEXT))
            else:
                key = (1, _hash(f"{here[1]}#{shown}", _SEED_TEXT))
            if kind == "text" and not here[3] and not here[4]:
                mass[here[2]] = mass.get(here[2], 0) + len(shown)
        found[key] = found.get(key, 0) + 1
    return found, mass


def page_template(source: str, classes: dict) -> tuple:
    """Order and slots of one page; ``classes``: {(kind, token): class} of its host.

    ({(kind, token): [is first of its class, least, greatest token before it in its class]},
    {section: unlinked characters outside the template, by the innermost template section; 0: none but the body}).
    """
    order, last, within, mass = {}, {}, {}, {}

    def met(key, of):
        cell = order.setdefault(key, [0, None, None])
        if of in last:
            cell[1] = last[of] if cell[1] is None else min(cell[1], last[of])
            cell[2] = last[of] if cell[2] is None else max(cell[2], last[of])
        else:
            cell[0] = 1
        last[of] = key[1]

    if (0, 0) in classes:  # the page itself
        met((0, 0), classes[0, 0])
    for kind, here, _, value in texts(source):
        if kind == "open":
            key = (0, here[1])
            of = classes.get(key)
            if of is not None:
                met(key, of)
            if here[0] in ("html", "body"):
                within[here[2]] = 0
            elif here[0] in SECTIONS:
                within[here[2]] = here[2] if of is not None else within.get(value, 0)
            continue
        if kind == "title" or here[0] in HEADINGS:
            of = None
        else:
            key = (1, _hash(f"{here[1]}#{_shown(value)}", _SEED_TEXT))
            of = classes.get(key)
        if of is not None:
            met(key, of)
        elif kind == "text" and not here[3] and not here[4] and (shown := _shown(value)):
            slot = within.get(here[2], 0)
            mass[slot] = mass.get(slot, 0) + len(shown)
    return order, mass


def _nested(pages: DataFrame, members: DataFrame) -> tuple:
    """Members that are in order on all pages, and (host, slot): where most text outside the template stands.

    ``members``: host, support, class, kind, token, of all classes. Sums and extremes are formed on the map side.
    """
    known = members.groupBy("host").agg(F.collect_list(F.struct("kind", "token", "class")).alias("classes"))

    def make():
        cached = {}

        def each(hosts, sources, classes):
            sums = {}
            for host, source, of in zip(hosts, sources, classes):
                if host not in cached:
                    if len(cached) > 1000:
                        cached.clear()
                    cached[host] = {(m["kind"], m["token"]): m["class"] for m in of}
                order, mass = page_template(source or "", cached[host])
                for (kind, token), (first, least, most) in order.items():
                    cell = sums.setdefault((host, kind, token), [0, None, None, 0])
                    cell[0] += first
                    if least is not None:
                        cell[1] = least if cell[1] is None else min(cell[1], least)
                        cell[2] = most if cell[2] is None else max(cell[2], most)
                for section, n in mass.items():
                    sums.setdefault((host, 3, section), [0, None, None, 0])[3] += n
            return (*([k[i] for k in sums] for i in range(3)), *([v[i] for v in sums.values()] for i in range(4)))
        return each
    rows = map_batches(pages.select("host", "html").join(known, "host").select("host", "html", "classes"), make,
                       "host string, kind int, token bigint, firsts bigint, least bigint, most bigint, mass bigint")
    seen = materialize(rows.groupBy("host", "kind", "token").agg(
        F.sum("firsts").alias("firsts"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("mass").alias("mass")), "site-order")
    ordered = members.join(seen.where("kind < 3 AND (least IS NULL OR least = most)").drop("mass"),
                           ["host", "kind", "token"]).where("firsts IN (0, support)")
    slots = seen.where("kind = 3").groupBy("host").agg(
        F.max_by("token", F.struct("mass", "token")).alias("inner_slot"))
    return ordered.drop("firsts", "least", "most"), slots


def templates(pages: DataFrame) -> DataFrame:
    """(host, constants, elements, slot) of each host; ``pages``: host, key, html.

    ``constants`` and ``elements`` hold the tokens of valid classes; a token's support is at
    least half of the host's pages, so they hold at most twice the mean number of tokens of a page.
    """
    def each(hosts, keys, sources):
        sums = {}
        for host, key, source in zip(hosts, keys, sources):
            found, mass = page_tokens(source or "")
            for (kind, token), n in found.items():
                cell = sums.setdefault((host, kind, token), [0, 0, 0])
                cell[0] += 1
                cell[1] += _hash(f"{key}:{n}")
            for section, n in mass.items():
                sums.setdefault((host, 3, section), [0, 0, 0])[2] += n
        return ([k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums],
                [v[0] for v in sums.values()],
                [v[1] % LOW for v in sums.values()], [(v[1] // LOW) % HIGH for v in sums.values()],
                [v[2] for v in sums.values()])
    rows = map_batches(pages.select("host", "key", "html"), lambda: each,
                       "host string, kind int, token bigint, support bigint, low bigint, high bigint, mass bigint")
    # The sum modulo 2^63, in two parts that cannot overflow: the low one carries into the high one.
    carried = (F.sum("high") + F.expr(f"sum(low) DIV {LOW}L")) % HIGH
    vectors = materialize(rows.groupBy("host", "kind", "token").agg(
        F.sum("support").alias("support"), (carried * LOW + F.sum("low") % LOW).alias("vector"),
        F.sum("mass").alias("mass")).where("support > 1 OR kind IN (0, 3)"), "site-vectors")
    hosts = vectors.groupBy("host").agg(
        F.max(F.when((F.col("kind") == 0) & (F.col("token") == 0), F.col("support"))).alias("n_pages"),
        F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("support"))), F.lit(1)).alias("title_support"),
        F.max_by("token", F.when(F.col("kind") == 3, F.struct("mass", "token"))).alias("slot"))
    hosts = materialize(hosts, "site-hosts")
    frequent = vectors.where("kind IN (0, 1)").join(hosts, "host").where(
        (F.col("n_pages") >= MIN_PAGES) & (F.col("support") >= MIN_SUPPORT * F.col("n_pages")))
    classes = frequent.groupBy("host", "support", "vector").agg(
        F.count("*").alias("size"), F.collect_list(F.struct("kind", "token")).alias("members"),
        F.first("n_pages").alias("n_pages"), F.first("title_support").alias("title_support")
    ).where(F.col("size") >= MIN_CLASS)
    # A text on no more pages than twice the commonest title comes with copies of one page.
    constant = (F.col("support") >= CONSTANT_SUPPORT * F.col("n_pages")) & (
        F.col("support") > 2 * F.col("title_support"))
    members = materialize(classes.select(
        "host", "support", F.xxhash64("support", "vector").alias("class"), constant.alias("constant"),
        F.inline("members")), "site-classes")
    ordered, slots = _nested(pages, members)
    built = ordered.groupBy("host").agg(
        F.collect_list(F.when((F.col("kind") == 1) & F.col("constant"), F.col("token"))).alias("constants"),
        F.collect_list(F.when(F.col("kind") == 0, F.col("token"))).alias("elements"))
    # Where most text stands in no section of the template but the body, pages say themselves which is theirs.
    return materialize(hosts.join(built, "host", "left").join(slots, "host", "left").select(
        "host", "constants", "elements", F.expr("coalesce(nullif(inner_slot, 0), slot)").alias("slot")),
        "site-templates")


def _constant(here, value: str, constants) -> bool:
    return bool(constants) and here[0] not in HEADINGS and _hash(
        f"{here[1]}#{_shown(value)}", _SEED_TEXT) in constants


def main_slot(walked: list, constants=frozenset(), slot=None):
    """The section that is the article of a walked page without article or main element; None if it has one.

    ``slot`` (the host's) if the page has text in it or below, else the section with most unlinked text; then the section around it while
    that has own unlinked text outside the template. The body is no such section.
    """
    mass, own, around, pages = {}, set(), {}, set()
    for kind, here, _, value in walked:
        if kind == "open":
            if here[0] in ("html", "body"):
                pages.add(here[2])
            around.setdefault(here[2], value)
        elif kind == "text" and not here[3] and not value.isspace():
            if here[5]:
                return None
            if not here[4]:
                mass[here[2]] = mass.get(here[2], 0) + len(value)
                if not _constant(here, value, constants):
                    own.add(here[2])
    held = set()
    for section in mass:
        while section and section not in held:
            held.add(section)
            section = around.get(section, 0)
    if slot not in held:
        slot = max(mass, key=mass.get, default=0)
    while (wider := around.get(slot, 0)) in own and wider not in pages and wider != slot and wider:
        slot = wider
    return slot


def main_text(source: str, constants=frozenset(), slot=None) -> str:
    """The blocks of the main slot, joined by an empty line."""
    blocks, parts, current = [], [], None
    walked = list(texts(source))
    slot = main_slot(walked, constants, slot)
    for kind, here, block, value in walked if slot is None else texts(source, slot):
        if kind != "text" or here[3] or not (here[5] if slot is None else here[6] or here[2] == slot):
            continue
        if _constant(here, value, constants):
            continue
        if block != current:
            blocks.append("".join(parts))
            parts, current = [], block
        parts.append(value)
    blocks.append("".join(parts))
    return "\n\n".join(b for b in map(_shown, blocks) if b)


def extract(pages: DataFrame, id_column="page_id", url="url", html="html") -> DataFrame:
    """Per row: id, url, text, n_chars, n_constants (texts of the host's template).

    Null html is an empty page with an empty text. Rows without a host share one that has
    no template. Hosts of fewer than MIN_PAGES pages have only the structure of the page itself.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(
        F.col(id_column).alias("page"), F.col(url).alias("address"), F.col(html).alias("html"), host.alias("host"),
        F.xxhash64(F.col(id_column).cast("string"), F.col(url)).alias("key"))
    known = templates(rows.where("host <> ''"))
    # One row per host; a hot host's pages are split by the adaptive skew join.
    joined = rows.join(known, "host", "left")

    def make():
        cached = {}

        def each(ids, urls, sources, hosts, constants, slots):
            out = []
            for source, name, constant, slot in zip(sources, hosts, constants, slots):
                if name not in cached:
                    if len(cached) > 1000:
                        cached.clear()
                    cached[name] = frozenset(constant or ())
                out.append(main_text(source or "", cached[name], slot))
            return ids, urls, out, [len(t) for t in out], [len(c or ()) for c in constants]
        return each
    kind = dict(pages.dtypes)[id_column]
    return map_batches(
        joined.select("page", "address", "html", "host", "constants", "slot"), make,
        f"page {kind}, address string, text string, n_chars bigint, n_constants bigint"
    ).select(F.col("page").alias(id_column), F.col("address").alias("url"), "text", "n_chars", "n_constants")
