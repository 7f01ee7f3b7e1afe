"""Text expressions.

The functions of this package take and return SQL expression text.  The page
expressions are deeply nested, and ``let`` binds an intermediate value once, so
plans stay small and nothing is computed twice.
"""

from html.entities import html5
from itertools import count
import json

_names = count()

# Unicode white space as Python's str.split() understands it: for regular
# expressions (predefined classes are much faster than a long list) and as text.
_WS = r"[\h\v\x1c-\x1f]"
_WS_CHARS = "".join(
    f"\\u{ord(c):04x}" for c in map(chr, range(0x3001)) if c.isspace())


def fresh(prefix: str = "v") -> str:
    """A lambda variable name that no enclosing lambda uses."""
    return f"{prefix}_{next(_names)}"


def let(value: str, body) -> str:
    """``body(name)`` with ``value`` computed once."""
    v = fresh()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def fenced(value: str) -> str:
    """An expression that no filter on it is pushed through.

    Pushing a filter below the projection that computes its input would repeat
    the whole page parsing inside the filter; an expression the optimizer takes
    for non-deterministic stays where it is.  The value does not change.
    """
    return f"CASE WHEN spark_partition_id() >= 0 THEN {value} END"


def quoted(value) -> str:
    """SQL literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """Regular expression literal; quote characters are written as escapes."""
    return "r'" + regex.replace("'", r"\x27").replace('"', r"\x22") + "'"


def in_list(value: str, items) -> str:
    return f"{value} IN ({', '.join(quoted(i) for i in items)})"


def shortest(phrases) -> list:
    """Phrases without those that contain another one and so decide nothing."""
    unique = list(dict.fromkeys(phrases))
    return [p for p in unique if not any(q != p and q in p for q in unique)]


def contains_any(value: str, phrases) -> str:
    """True when any phrase is a substring of ``value``."""
    tests = (f"contains({value}, {quoted(p)})" for p in shortest(phrases))
    return "(" + " OR ".join(tests) + ")"


def matches_any(value: str, phrases) -> str:
    """Case-insensitive ``contains_any`` for values not yet lower-cased."""
    return f"{value} RLIKE {pattern('(?iu)' + alternatives(phrases))}"


def alternatives(phrases) -> str:
    special = ".^$*+?{}[]|()\\"
    return "|".join(
        "".join("\\" + c if c in special else c for c in p) for p in phrases
    )


def strip(value: str) -> str:
    return f"trim(BOTH '{_WS_CHARS}' FROM {value})"


def collapse_spaces(value: str) -> str:
    """White space runs to one space; single spaces are not even matched."""
    odd_run = rf"{_WS}(?:(?<! )|(?={_WS})){_WS}*"
    return f"trim(regexp_replace({value}, {pattern(odd_run)}, ' '))"


def _entity_names() -> dict:
    names = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    # Numbers 128-159 mean the windows-1252 characters, as browsers read them.
    for n in range(128, 160):
        try:
            names[f"#{n}"] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return names


_ENTITIES = "from_json(r'{}', 'map<string,string>')".format(
    json.dumps(_entity_names()).replace("'", chr(92) + "u0027")
)


def _decode_piece(piece: str, need_semicolon: bool) -> str:
    """Decode one text run that followed an ampersand."""
    end = ";" if need_semicolon else r"(?:;|(?![A-Za-z0-9]))"
    regex = rf"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{{1,31}}){end}"

    def code_of(ref):
        # Leading zeros are legal; a longer number is beyond the last code point.
        digits = f"ltrim('0', regexp_extract({ref}, '[0-9a-fA-F]+$', 0))"
        return (f"CAST(CASE WHEN NOT startswith({ref}, '#') THEN NULL "
                f"WHEN length({digits}) > 7 THEN '1114112' "
                f"WHEN {ref} RLIKE '^#[xX]' THEN conv(concat('0', {digits}), 16, 10) "
                f"ELSE concat('0', {digits}) END AS INT)")

    def numeric(code):
        return (f"CASE WHEN {code} > 0 AND {code} <= 1114111 "
                f"AND NOT {code} BETWEEN 55296 AND 57343 "
                f"THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') "
                f"WHEN {code} IS NOT NULL THEN '\\uFFFD' END")

    def replaced(whole):
        char = let(
            f"trim(TRAILING ';' FROM {whole})",
            lambda ref: f"coalesce(try_element_at({_ENTITIES}, {ref}), "
                        f"{let(code_of(ref), numeric)})",
        )
        rest = f"substr({piece}, length({whole}) + 1)"
        return (f"CASE WHEN {whole} = '' THEN concat('&', {piece}) "
                f"ELSE coalesce(concat({char}, {rest}), concat('&', {piece})) END")

    return let(f"regexp_extract({piece}, {pattern(regex)}, 0)", replaced)


def decode_entities(value: str, need_semicolon: bool = False) -> str:
    """Character references to characters; text without ``&`` passes untouched."""
    p, i = fresh("piece"), fresh("i")

    def decoded(v):
        return (f"CASE WHEN contains({v}, '&') THEN array_join(transform(split({v}, '&'), "
                f"({p}, {i}) -> CASE WHEN {i} = 0 THEN {p} "
                f"ELSE {_decode_piece(p, need_semicolon)} END), '') ELSE {v} END")

    return decoded(value) if value.isidentifier() else let(value, decoded)
