"""URL expressions (SQL text in, SQL text out).  All are plain projections."""

from pagewarden.functions.text import fresh, let, pattern

_HOST = (r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
         r"(\[[^\]/?#]*\]|[^/:?#]*)")
# scheme, netloc, path, ?query, #fragment; an empty query or fragment is dropped.
_PARTS = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
          r"(?:\?(?=#|$)|(\?[^#]+))?(?:#$|(#.+))?$")
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
_JOINABLE = "('http', 'https', 'ftp', 'file', 'ws', 'wss')"


def host(url: str) -> str:
    """Lower-case host without user info and port; ``''`` when there is none."""
    return f"lower(translate(regexp_extract({url}, {pattern(_HOST)}, 1), '[]', ''))"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def display_domain(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www[.]', '')"


def _host_or(url: str, default: str) -> str:
    return f"coalesce(nullif({host(url)}, ''), '{default}')"


def site_slug(url: str) -> str:
    return f"translate({_host_or(url, 'site')}, '.', '_')"


def website_domain(url: str) -> str:
    return _host_or(url, "unknown")


def remote_address(url: str, length: int) -> str:
    return f"substring(concat({scheme(url)}, '://', {_host_or(url, 'unknown')}), 1, {length})"


def is_valid_url(url: str) -> str:
    """http/https with a host; NULL counts as invalid."""
    return (f"coalesce({url} RLIKE '^(?i:https?)://' AND {host(url)} <> '' "
            f"AND NOT {url} RLIKE {pattern(chr(92) + 's')}, false)")


def url_parts(url: str) -> str:
    """Split a URL into (raw, scheme, netloc, path, query, fragment)."""
    def split(clean):
        part = lambda i: f"regexp_extract({clean}, {pattern(_PARTS)}, {i})"
        return (f"named_struct('raw', {url}, 'scheme', lower({part(1)}), "
                f"'netloc', {part(2)}, 'path', {part(3)}, 'query', {part(4)}, "
                f"'fragment', {part(5)})")

    return let(
        f"regexp_replace({url}, {pattern(r'^[\x00-\x20]+|[\t\r\n]')}, '')", split
    )


def _drop_dot_segments(path: str) -> str:
    acc, seg = fresh("acc"), fresh("seg")
    walked = (
        f"aggregate(split({path}, '/'), CAST(array() AS array<string>), "
        f"({acc}, {seg}) -> CASE WHEN {seg} = '..' "
        f"THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) "
        f"WHEN {seg} = '.' THEN {acc} ELSE concat({acc}, array({seg})) END, "
        f"{acc} -> CASE WHEN {path} RLIKE {pattern(r'(?:^|/)\.\.?$')} "
        f"THEN concat({acc}, array('')) ELSE {acc} END)"
    )
    return (f"CASE WHEN {path} RLIKE {pattern(_DOT_SEGMENT)} "
            f"THEN array_join({walked}, '/') ELSE {path} END")


def _merged_path(base: str, ref: str) -> str:
    """Path of a reference against the base path, dot segments removed.

    Relative references drop empty segments, absolute paths keep them.
    """
    folder = f"regexp_replace({base}.path, '[^/]+$', '')"
    joined = (f"CASE WHEN startswith({ref}.path, '/') THEN {ref}.path ELSE "
              f"regexp_replace(concat('/', {folder}, {ref}.path), '/{{2,}}', '/') END")
    return f"coalesce(nullif({let(joined, _drop_dot_segments)}, ''), '/')"


def join_parts(base: str, ref: str) -> str:
    """Resolve a split reference against a split base URL."""
    path = (f"CASE WHEN {ref}.netloc <> '' THEN {ref}.path "
            f"WHEN {ref}.path = '' THEN {base}.path "
            f"ELSE {_merged_path(base, ref)} END")
    rooted = lambda p: (f"CASE WHEN {p} <> '' AND NOT startswith({p}, '/') "
                        f"THEN concat('/', {p}) ELSE {p} END")
    query = (f"CASE WHEN {ref}.query = '' AND {ref}.path = '' AND {ref}.netloc = '' "
             f"THEN {base}.query ELSE {ref}.query END")
    return (f"CASE WHEN {ref}.raw = '' THEN {base}.raw "
            f"WHEN ({ref}.scheme <> '' AND {ref}.scheme <> {base}.scheme) "
            f"OR {base}.scheme NOT IN {_JOINABLE} THEN {ref}.raw "
            f"ELSE concat({base}.scheme, '://', "
            f"coalesce(nullif({ref}.netloc, ''), {base}.netloc), "
            f"{let(path, rooted)}, {query}, {ref}.fragment) END")


def resolve_against(base_parts: str, href: str) -> str:
    """Resolve a link against an already split base."""
    return let(url_parts(href), lambda ref: join_parts(base_parts, ref))


def resolve(base: str, href: str) -> str:
    """Resolve a link against the URL of its page."""
    return let(url_parts(base), lambda b: resolve_against(b, href))
