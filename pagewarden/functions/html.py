"""HTML as arrays of tokens, entirely in native expressions (SQL text).

A page is cut once into tokens (comments, whole script/style elements, tags,
text runs).  Every extractor then works on arrays inside the row, so page
extraction is a narrow projection: no explode, no shuffle, no Python.

All repetition in the token pattern is possessive, which keeps matching linear
and free of recursion on very long tags or text runs.
"""

from pagewarden import lexicon
from pagewarden.functions import text as tx
from pagewarden.functions.text import fresh, let, pattern

_REST_OF_TAG = (r"[^>=]*+(?:=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|)"
                r"[^>=]*+)*+>").replace(r"\"", '"')
_RAW = (r"<{0}(?=[\s/>])" + _REST_OF_TAG +
        r"(?<!/>).*?(?:</{0}(?=[\s/>])[^>]*+>|\z)")
TOKEN_PATTERN = "(?is)" + "|".join((
    r"<!--.*?-->",
    _RAW.format("script"),
    _RAW.format("style"),
    r"</?[a-z][^\s/>]*+" + _REST_OF_TAG,
    r"<[!?][^>]*+>|</[^>]*+>",
    r"(?:[^<]++|<(?![a-z/!?]))++",
    r"<",
))
_OPEN_TAG = r"(?is)^<[a-z][^\s/>]*+" + _REST_OF_TAG
_TAG_NAME = r"(?i)^</?([a-z][^\s/>]*)"
_TEXT = r"(?i)^(?:[^<]|<(?![a-z/!?])|<$)"
_ATTRIBUTE = (r"(?s)[^\s/>=\"'][^\s/>=]*(?:\s*=+\s*"
              r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)?").replace(r"\"", '"')
_USED_ATTRIBUTES = (
    "href", "src", "action", "method", "name", "type", "placeholder", "id", "class",
)
_USED_TAGS = ("a", "form", "input", "textarea", "script")
SPAN_CHUNK = 128


def tokens(html: str) -> str:
    return f"regexp_extract_all({html}, {pattern(TOKEN_PATTERN)}, 0)"


def is_text(token: str) -> str:
    return f"(NOT startswith({token}, '<') OR {token} RLIKE {pattern(_TEXT)})"


def texts(token_array: str) -> str:
    """Decoded text per token position; NULL where the token is not text."""
    t = fresh("t")
    return (f"transform({token_array}, {t} -> CASE WHEN {is_text(t)} "
            f"THEN {tx.decode_entities(t)} END)")


def joined(text_array: str, separator: str) -> str:
    return f"array_join({text_array}, '{separator}')"


def between(array: str, first: str, last: str) -> str:
    """Array entries strictly between two token positions."""
    return f"slice({array}, {first} + 2, greatest({last} - {first} - 1, 0))"


def raw_body(token: str) -> str:
    """Content of a whole script/style element."""
    inner = f"substr({token}, length(regexp_extract({token}, {pattern(_OPEN_TAG)}, 0)) + 1)"
    return f"regexp_replace({inner}, '(?i)</(?:script|style)[^>]*>$', '')"


def token_kind(token: str) -> str:
    return (
        f"CASE WHEN {is_text(token)} THEN 'text' "
        f"WHEN startswith({token}, '<!--') THEN 'comment' "
        f"WHEN {token} RLIKE {pattern(r'(?is)^<(?:script|style)[\s/>].*</(?:script|style)[^>]*>$')} "
        f"THEN 'script_body' WHEN {token} RLIKE '(?i)^</[a-z]' THEN 'close' "
        f"WHEN {token} RLIKE '(?i)^<[a-z]' THEN 'open' ELSE 'declaration' END"
    )


def tag_name(token: str) -> str:
    return f"lower(regexp_extract({token}, {pattern(_TAG_NAME)}, 1))"


# -- tags and their attributes ------------------------------------------------
def tags(token_array: str) -> str:
    """All tags as (pos, name, step): 1 opens, -1 closes, 0 has no content."""
    t, i, e = fresh("t"), fresh("i"), fresh("e")
    childless = tx.in_list(f"{e}.name", lexicon.VOID_TAGS + ("script", "style"))
    named = (f"filter(transform({token_array}, ({t}, {i}) -> named_struct('pos', {i}, "
             f"'name', CASE WHEN startswith({t}, '<') THEN {tag_name(t)} ELSE '' END)), "
             f"{e} -> {e}.name <> '')")
    token = f"get({token_array}, {e}.pos)"
    return (f"transform({named}, {e} -> named_struct('pos', {e}.pos, 'name', {e}.name, "
            f"'step', CASE WHEN startswith({token}, '</') THEN -1 "
            f"WHEN {childless} OR endswith({token}, '/>') THEN 0 ELSE 1 END))")


def attributes(tag: str) -> str:
    """Attributes of an opening tag that the audit uses, decoded, in order."""
    a, b = fresh("a"), fresh("b")
    opened = (f"CASE WHEN endswith(lower(right({tag}, 10)), 'script>') "
              f"THEN regexp_extract({tag}, {pattern(_OPEN_TAG)}, 0) ELSE {tag} END")
    inner = f"regexp_replace({opened}, {pattern(r'(?i)^<[a-z][^\s/>]*|>$')}, '')"
    used = (f"filter(transform(regexp_extract_all({inner}, {pattern(_ATTRIBUTE)}, 0), "
            f"{a} -> named_struct('k', lower(regexp_extract({a}, {pattern(r'^[^\s=]+')}, 0)), "
            f"'raw', regexp_extract({a}, {pattern(r'(?s)^[^=]*=+\s*(.*)$')}, 1))), "
            f"{b} -> {tx.in_list(f'{b}.k', _USED_ATTRIBUTES)})")
    quotes = pattern("""(?s)^"(.*)"$|^'(.*)'$""")
    bare = f"regexp_replace({b}.raw, {quotes}, '$1$2')"
    return (f"transform({used}, {b} -> named_struct('k', {b}.k, "
            f"'v', {tx.decode_entities(bare, need_semicolon=True)}))")


def elements(tag_array: str, token_array: str, banner_markers) -> str:
    """Opening tags the extractors look at, with attributes and script body.

    div/section/aside count only when a consent-manager marker occurs in them.
    """
    e = fresh("e")
    token = f"get({token_array}, {e}.pos)"
    marked = (f"({tx.in_list(f'{e}.name', lexicon.BANNER_TAGS)} "
              f"AND {tx.matches_any(token, banner_markers)})")
    kept = (f"filter({tag_array}, {e} -> {e}.step >= 0 AND "
            f"({tx.in_list(f'{e}.name', _USED_TAGS)} OR {marked}))")
    return (f"transform({kept}, {e} -> named_struct('pos', {e}.pos, 'name', {e}.name, "
            f"'attrs', {attributes(token)}, "
            f"'body', CASE WHEN {e}.name = 'script' THEN {raw_body(token)} END))")


def attribute(element: str, name: str) -> str:
    """Attribute value: NULL if absent, ``''`` without value, the last one wins."""
    a = fresh("a")
    return (f"try_element_at(filter({element}.attrs, {a} -> {a}.k = '{name}'), -1).v")


# -- element spans -------------------------------------------------------------
def element_spans(tag_array: str, n_tokens: str) -> str:
    """Spans of links, forms and the ancestors of forms that matter.

    One pass over the tags with a stack (innermost element first).  A closing
    tag closes up to the nearest open element of its name and is ignored when
    there is none; elements still open at the end close there.  A stack entry
    is stored negative (-pos - 1) once its span is wanted, so the state holds
    positions and names only.  Result: ``spans`` sorted by position and, per
    form, the positions of its parent and of its outermost ancestor within
    reach (-1 is the document).

    Arrays are copied when they change, so the pass runs in chunks of SPAN_CHUNK tags. Within a chunk
    the stack below it (``names``, ``open`` of the chunk's state) stays as it is: a tag changes a short
    stack of its own, the number of elements below that have been closed (``gone``) and the list of
    those whose span is wanted since (``marks``); ``kinds``, the names below, tells at once that a closing
    tag has nothing to close there. The two are put together at the end of the chunk, and
    what a chunk finds is put aside as one entry: the work is linear in the tags, and the depth of
    nesting counts once a chunk.
    """
    s, e, p, i, c, k = (fresh(n) for n in "sepick")
    levels = lexicon.NOTICE_LEVELS
    span_list = "array<struct<first:int,last:int>>"
    form_list = "array<struct<pos:int,parent:int,outer:int>>"
    none = lambda kind: f"CAST(array() AS {kind})"
    plain = lambda entry: f"greatest({entry}, -{entry} - 1)"

    def closed(positions, end, marks=none("array<int>")):
        return (f"transform(filter({positions}, {p} -> {p} < 0 OR array_contains({marks}, {p})), "
                f"{p} -> named_struct('first', {plain(p)}, 'last', {end}))")

    def state(names, opened, spans, forms, gone=f"{s}.gone", marks=f"{s}.marks", kinds=f"{s}.kinds"):
        return (f"named_struct('names', {names}, 'open', {opened}, 'gone', {gone}, 'marks', {marks}, "
                f"'spans', {spans}, 'forms', {forms}, 'kinds', {kinds})")

    def rest(array, start):
        """Entries from an offset on."""
        return f"slice({array}, {start} + 1, size({array}) + 1)"

    below = lambda n: f"get({c}.open, {s}.gone + {n} - size({s}.open))"
    ancestor = lambda n: f"CASE WHEN {n} < size({s}.open) THEN get({s}.open, {n}) ELSE {below(n)} END"
    wanted = (0, levels - 1)
    marked_stack = (
        f"transform({s}.open, ({p}, {i}) -> CASE WHEN {i} IN {wanted} "
        f"THEN least({p}, -{p} - 1) ELSE {p} END)"
    )
    lower = ", ".join(f"CASE WHEN {n} >= size({s}.open) AND {below(n)} >= 0 THEN {below(n)} END" for n in wanted)
    is_form = f"{e}.name = 'form'"
    stack = f"CASE WHEN {is_form} THEN {marked_stack} ELSE {s}.open END"
    marks = (f"CASE WHEN {is_form} THEN array_union({s}.marks, array_compact(array({lower}))) "
             f"ELSE {s}.marks END")
    entry = f"CASE WHEN {e}.name IN ('a', 'form') THEN -{e}.pos - 1 ELSE {e}.pos END"
    position = lambda n: f"coalesce({let(ancestor(n), plain)}, -1)"
    forms = (f"CASE WHEN {is_form} THEN concat({s}.forms, array(named_struct("
             f"'pos', {e}.pos, 'parent', {position(0)}, 'outer', {position(levels - 1)}))) "
             f"ELSE {s}.forms END")
    opened = state(f"concat(array({e}.name), {s}.names)",
                   f"concat(array({entry}), {stack})", f"{s}.spans", forms, marks=marks)
    self_closed = state(
        f"{s}.names", stack,
        f"concat({s}.spans, array(named_struct('first', {e}.pos, 'last', {e}.pos)))",
        forms, marks=marks)
    popped = lambda depth: state(
        rest(f"{s}.names", depth), rest(f"{s}.open", depth),
        f"concat({s}.spans, {closed(f'slice({s}.open, 1, {depth})', f'{e}.pos')})",
        f"{s}.forms")
    popped_below = lambda depth: state(
        none("array<string>"), none("array<int>"),
        f"concat({s}.spans, {closed(f'{s}.open', f'{e}.pos')}, "
        f"{closed(f'slice({c}.open, {s}.gone + 1, {depth})', f'{e}.pos', f'{s}.marks')})",
        f"{s}.forms", gone=f"{s}.gone + {depth}")
    place_below = (f"CASE WHEN get({c}.names, {s}.gone) = {e}.name THEN 1 "
                   f"ELSE CAST(array_position({rest(f'{c}.names', f'{s}.gone')}, {e}.name) AS INT) END")
    closing_below = let(
        f"CASE WHEN array_contains({s}.kinds, {e}.name) THEN {place_below} ELSE 0 END",
        lambda depth: f"CASE WHEN {depth} > 0 THEN {popped_below(depth)} ELSE {s} END")
    closing = let(
        f"CAST(array_position({s}.names, {e}.name) AS INT)",
        lambda depth: f"CASE WHEN {depth} > 0 THEN {popped(depth)} ELSE {closing_below} END",
    )

    def chunk(events):
        empty = state(none("array<string>"), none("array<int>"), none(span_list), none(form_list),
                      gone="0", marks=none("array<int>"), kinds=f"array_distinct({c}.names)")
        return (
            f"aggregate(slice({events}, {k} + 1, {SPAN_CHUNK}), {empty}, ({s}, {e}) -> "
            f"CASE {e}.step WHEN 1 THEN {opened} WHEN 0 THEN {self_closed} ELSE {closing} END)")

    def together(r):
        """The whole stack after a chunk, and what all chunks have found."""
        left = rest(f"{c}.open", f"{r}.gone")
        marked = (f"CASE WHEN size({r}.marks) = 0 THEN {left} ELSE transform({left}, {p} -> "
                  f"CASE WHEN array_contains({r}.marks, {p}) THEN -{p} - 1 ELSE {p} END) END")
        below_names = rest(f"{c}.names", f"{r}.gone")
        return (f"named_struct('names', concat({r}.names, {below_names}), "
                f"'open', concat({r}.open, {marked}), "
                f"'spans', concat({c}.spans, array({r}.spans)), 'forms', concat({c}.forms, array({r}.forms)))")

    def folded(events):
        empty = (f"named_struct('names', {none('array<string>')}, 'open', {none('array<int>')}, "
                 f"'spans', {none(f'array<{span_list}>')}, 'forms', {none(f'array<{form_list}>')})")
        return (
            f"aggregate(sequence(0, greatest(size({events}) - 1, 0), {SPAN_CHUNK}), {empty}, "
            f"({c}, {k}) -> {let(chunk(events), together)}, {c} -> named_struct('spans', array_sort(concat("
            f"flatten({c}.spans), {closed(f'{c}.open', n_tokens)})), 'forms', flatten({c}.forms)))")

    events = f"filter({tag_array}, {e} -> {e}.step <> 0 OR {e}.name IN ('a', 'form'))"
    return let(
        _plain_links(tag_array),
        lambda links: f"CASE WHEN exists({links}, {p} -> {p}.last IS NULL) "
                      f"THEN {let(events, folded)} "
                      f"ELSE named_struct('spans', {links}, 'forms', {none(form_list)}) END",
    )


def _plain_links(tag_array: str) -> str:
    """Spans of links directly followed by their closing tag.

    ``last`` is NULL for every other link and for forms: those pages need the
    pass with a stack, all others are done.
    """
    e, i, x = fresh("e"), fresh("i"), fresh("x")
    following = f"get({tag_array}, {i} + 1)"
    span = lambda last: f"named_struct('first', {e}.pos, 'last', {last})"
    closed_next = (f"CASE WHEN {following}.name = 'a' AND {following}.step < 0 "
                   f"THEN {following}.pos END")
    return (
        f"filter(transform({tag_array}, ({e}, {i}) -> CASE "
        f"WHEN {e}.name = 'form' AND {e}.step >= 0 THEN {span('CAST(NULL AS INT)')} "
        f"WHEN {e}.name <> 'a' OR {e}.step < 0 THEN NULL "
        f"WHEN {e}.step = 0 THEN {span(f'{e}.pos')} "
        f"ELSE {span(closed_next)} "
        f"END), {x} -> {x} IS NOT NULL)"
    )


def span_end(spans: str, first: str) -> str:
    x = fresh("x")
    return f"get(filter({spans}, {x} -> {x}.first = {first}), 0).last"
