"""URL expressions: split, normalise, resolve, authority, allow-filters.

All are plain column expressions that work on any string (blanks, non-ASCII, no scheme), also
inside array lambdas. The semantics are those of RFC 3986 reference resolution in the form the
Python standard library documents for ``urljoin`` and ``urlsplit``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import bind, sql_function

# Schemes whose references are resolved / that carry an authority / ``;params``.
RELATIVE_SCHEMES = ("", "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp", "prospero", "rtsp",
                    "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss")
AUTHORITY_SCHEMES = ("", "file", "ftp", "git", "git+ssh", "gopher", "http", "https", "imap", "itms-services", "mms",
                     "nfs", "nntp", "prospero", "rsync", "rtsp", "rtsps", "rtspu", "sftp", "shttp", "snews", "svn",
                     "svn+ssh", "telnet", "wais", "ws", "wss")
PARAM_SCHEMES = ("", "ftp", "hdl", "http", "https", "imap", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp",
                 "shttp", "sip", "sips", "tel")

# RFC 3986 appendix B, total over all strings.
_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PARAMS = r"(?s)^((?:.*/)?[^/;]*)((?:;[^/]*)?)$"
_ROOTED = r"^/(?:[^/;?#\x00-\x20][^;?#\x00-\x20]*)?\z"
_BELOW = (r"^(?:[.][.]/)*[^./:;?#\x00-\x20][^/:;?#\x00-\x20]*(?:/[^./:;?#\x00-\x20][^/:;?#\x00-\x20]*)*/?\z")
_ABSOLUTE = r"^[hH][tT][tT][pP][sS]?://[^/?#;\x00-\x20]+(?:/[^?#;\x00-\x20]*)?\z"
_NO_SCHEME = r"^//[^/?#;\x00-\x20]+(?:/[^?#;\x00-\x20]*)?\z"
_SAME_PAGE = r"^(?:#|[?][^#\x00-\x20]+#?)[^#\x00-\x20]+\z"
# http URLs whose split is plain: nothing to strip, lower or leave out. With a path alone, and with more behind it.
_PLAIN_PATH = r"^https?://[a-z0-9._:@-]+(?:/[^?#\x00-\x20]*)?\z"
_PLAIN_URL = r"^https?://[a-z0-9._:@-]+(?:/[^?#\x00-\x20]*)?(?:[?][^#\x00-\x20]+)?(?:#[^\x00-\x20]+)?\z"
# http URLs whose path robots rules meet as it stands: no escapes, nothing to encode, no parameters, no empty first segment.
_PLAIN_ROBOTS = r"^https?://[a-z0-9._:@-]+(?:/(?:[A-Za-z0-9_.~-][A-Za-z0-9_.~/-]*)?)?\z"
_DOTS = r"(?:^|/)\.\.?(?:/|$)"
_DIRT = r"^[\x00-\x20]+|[\t\r\n]"


def _names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# The functions below write SQL text; every step that is used more than once is bound to a name.


def _parts(url: str) -> str:
    """``array(scheme, authority, path, query, fragment)``; absent parts are empty.

    Line breaks cannot occur in a cleaned URL, so they separate the parts of one regex pass.
    """
    clean = f"regexp_replace({url}, r'{_DIRT}', '')"
    return f"split(regexp_replace({clean}, r'{_SPLIT}', '$1\\n$2\\n$3\\n$4\\n$5'), '\\n')"


def _base_parts(url: str) -> str:
    """Parts of a base, then what plain links need: the prefix of rooted links and the path that
    relative ones start from (both empty where links have to go the long way)."""
    both = tuple(s for s in RELATIVE_SCHEMES if s and s in AUTHORITY_SCHEMES)
    origin = f"if(p[1] <> '' and sch in ({_names(both)}), concat(sch, '://', lower(p[1])), '')"
    start = "case when p[2] = '' then '/' when startswith(p[2], '/') and not p[2] rlike r'/[./]|;' then p[2] else '' end"
    general = bind(_parts(url), "p", bind("lower(p[0])", "sch", f"array(sch, p[1], p[2], p[3], p[4], {origin}, {start})"))
    plain = bind(f"substring_index({url}, '/', 3)", "org", bind(
        f"array(substring_index(org, ':', 1), substring_index(org, '/', -1), substring({url}, length(org) + 1))", "p",
        f"array(p[0], p[1], p[2], '', '', org, {start})"))
    return f"if({url} rlike r'{_PLAIN_PATH}', {plain}, {general})"


def _unsplit(parts: str) -> str:
    """A URL from its five parts; delimiters of empty parts go."""
    return bind(parts, "u", f"""concat(
        if(u[0] <> '', concat(u[0], ':'), ''),
        case when u[1] <> '' then concat('//', u[1], if(u[2] <> '' and not startswith(u[2], '/'), '/', ''))
             when startswith(u[2], '//') then '//'
             when u[0] <> '' and (u[2] = '' or startswith(u[2], '/')) and u[0] in ({_names(AUTHORITY_SCHEMES)}) then '//'
             else '' end,
        u[2],
        if(u[3] <> '', concat('?', u[3]), ''),
        if(u[4] <> '', concat('#', u[4]), ''))""")


def _tidy_path(segments: str) -> str:
    """Remove ``.`` and ``..``; a path ending in one keeps its trailing slash."""
    kept = """aggregate(s, cast(array() as array<string>), (acc, x) ->
        case when x = '..' then slice(acc, 1, greatest(size(acc) - 1, 0)) when x = '.' then acc else concat(acc, array(x)) end)"""
    return bind(segments, "s", bind(
        f"array_join(if(element_at(s, -1) in ('.', '..'), concat({kept}, array('')), {kept}), '/')",
        "t", "if(t = '', '/', t)"))


def _join_paths(base: str, path: str) -> str:
    """A rooted path stands alone; another follows the directory of the base, without empty segments inside."""
    folder = f"if({base} = '', '/', regexp_extract({base}, r'(?s)^.*/', 0))"
    whole = f"if(startswith({path}, '/'), {path}, regexp_replace(concat({folder}, {path}), '/+', '/'))"
    return bind(whole, "m", f"case when m rlike r'{_DOTS}' then {_tidy_path("split(m, '/')")} when m = '' then '/' else m end")


def _path_and_params(scheme: str, path: str) -> str:
    """``array(path, ;params of its last segment)``."""
    return f"""if(contains({path}, ';') and {scheme} in ({_names(PARAM_SCHEMES)}),
        array(regexp_extract({path}, r'{_PARAMS}', 1), regexp_extract({path}, r'{_PARAMS}', 2)), array({path}, ''))"""


def _resolve(base: str, href: str) -> str:
    """Reference resolution against split base parts, in stages."""
    chosen = f"""named_struct('p', p, 'own', lower(p[0]), 'scheme', if(p[0] = '', {base}[0], lower(p[0])))"""
    judged = f"""named_struct('p', k.p, 'own', k.own, 'scheme', k.scheme,
        'foreign', ({base}[0] = '' and {base}[1] = '' and {base}[2] = '' and {base}[3] = '' and {base}[4] = '') or k.scheme <> {base}[0] or k.scheme not in ({_names(RELATIVE_SCHEMES)}),
        'auth', k.scheme in ({_names(AUTHORITY_SCHEMES)}),
        'same', k.p[2] = '' or (k.p[2] = ';' and k.scheme in ({_names(PARAM_SCHEMES)})))"""
    # An authority of its own leaves nothing to inherit.
    whole = "(j.foreign or (j.p[1] <> '' and j.auth))"
    path = bind(_path_and_params("j.scheme", "j.p[2]"), "q", bind(
        f"({_path_and_params(f'{base}[0]', f'{base}[2]')})[0]", "bp",
        f"concat({_join_paths('bp', 'q[0]')}, if(length(q[1]) > 1, q[1], ''))"))
    target = _unsplit(f"""array(
        if(j.foreign, j.own, j.scheme),
        lower(case when j.foreign or j.p[1] <> '' then j.p[1] when j.auth then {base}[1] else '' end),
        case when {whole} then j.p[2] when j.same then {base}[2] else {path} end,
        if(not {whole} and j.same and j.p[3] = '', {base}[3], j.p[3]),
        j.p[4])""")
    # The most frequent links need no splitting: a path from the root, a path from the folder of the
    # page (``../`` drops segments of it), an absolute http URL with or without its scheme, and another query or
    # fragment of the page.
    rooted = f"startswith({href}, '/') and {base}[5] <> '' and {href} rlike r'{_ROOTED}' and not contains({href}, '/.')"
    below = f"{base}[5] <> '' and {base}[6] <> '' and {href} rlike r'{_BELOW}'"
    keep = f"""greatest(length({base}[6]) - length(replace({base}[6], '/', ''))
        - cast((length({href}) - length(rest)) div 3 as int), 1)"""
    from_folder = bind(f"if(startswith({href}, '../'), regexp_replace({href}, r'^(?:[.][.]/)+', ''), {href})", "rest",
                       f"concat({base}[5], substring_index({base}[6], '/', {keep}), '/', rest)")
    absolute = bind(f"regexp_extract({href}, r'^[a-zA-Z]+://[^/]*', 0)", "pre",
                    f"concat(lower(pre), substring({href}, length(pre) + 1))")
    no_scheme = bind(f"regexp_extract({href}, r'^//[^/]*', 0)", "pre",
                     f"concat({base}[0], ':', lower(pre), substring({href}, length(pre) + 1))")
    here = f"{base}[5] <> '' and startswith({base}[2], '/') and {href} rlike r'{_SAME_PAGE}'"
    query = f"if(startswith({href}, '#') and {base}[3] <> '', concat('?', {base}[3]), '')"
    return f"""case when coalesce({href}, '') = '' then ''
        when {rooted} then concat({base}[5], {href})
        when {below} then {from_folder}
        when (startswith({href}, 'h') or startswith({href}, 'H')) and {href} rlike r'{_ABSOLUTE}' then {absolute}
        when {base}[5] <> '' and {href} rlike r'{_NO_SCHEME}' then {no_scheme}
        when {here} then concat({base}[5], {base}[2], {query}, {href})
        else {bind(_parts(href), "p", bind(chosen, "k", bind(judged, "j", target)))} end"""


def _unquote(value: str) -> str:
    """Decode percent escapes; malformed ones stay as they are."""
    return f"""if(contains({value}, '%'), url_decode(regexp_replace(replace({value}, '+', '%2B'),
        r'%(?![0-9A-Fa-f]{{2}})', '%25')), {value})"""


def _quote(value: str) -> str:
    """Percent-encode everything but letters, digits and ``/_.-~``."""
    out = f"url_encode({value})"
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = f"replace({out}, '{have}', '{want}')"
    return out


def base_parts(url: Column) -> Column:
    """A page URL split once, as :func:`resolve_parts` wants its base."""
    return sql_function(_base_parts("in.url"), url=url)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, keep the rest."""
    general = bind(_parts("in.url"), "p", _unsplit("array(lower(p[0]), lower(p[1]), p[2], p[3], p[4])"))
    return sql_function(f"if(in.url rlike r'{_PLAIN_URL}', in.url, {general})", url=url)


def resolve_parts(base: Column, href: Column) -> Column:
    """Resolve ``href`` against a base from :func:`base_parts`; ``""`` for no href."""
    return sql_function(_resolve("in.base", "in.href"), base=base, href=href)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute, normalised target of a link; ``""`` for a missing or empty href."""
    return sql_function(bind(_base_parts("in.base"), "base", _resolve("base", "in.href")), base=base, href=href)


def unquote(value: Column) -> Column:
    """Decode percent escapes; malformed ones stay as they are."""
    return sql_function(_unquote("in.value"), value=value)


def canonical_rule_path(value: Column) -> Column:
    """A robots rule path, recomposed and with canonical escapes."""
    return sql_function(_quote(_unsplit(_base_parts("in.value"))), value=value)


def robots_path(url: Column) -> Column:
    """The form of a URL that robots rules are compared with: path and beyond, canonical escapes."""
    target = bind(_parts(_unquote("in.url")), "p", _unsplit(
        "array('', '', regexp_replace(p[2], r'(?s)^((?:.*/)?[^/;]*);$', '$1'), p[3], p[4])"))
    general = bind(_quote(target), "q", "if(q = '', '/', q)")
    plain = "if(length(in.url) = length(substring_index(in.url, '/', 3)), '/', substring(in.url, length(substring_index(in.url, '/', 3)) + 1))"
    return sql_function(f"if(in.url rlike r'{_PLAIN_ROBOTS}', {plain}, {general})", url=url)


def url_domain(url: Column) -> Column:
    """Authority including a port, case kept; empty when there is none."""
    return F.regexp_extract(F.regexp_replace(url, _DIRT, ""), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def page_url(url: Column) -> Column:
    """The URL without its fragment: what is asked for when it is fetched."""
    return F.substring_index(url, "#", 1)


def robots_url(url: Column) -> Column:
    """``scheme://authority/robots.txt`` of an http(s) URL, else empty."""
    root = F.regexp_extract(url, r"^https?://[^/]+", 0)
    return F.when(root == "", root).otherwise(F.concat(root, F.lit("/robots.txt")))


def url_in_domains(url: Column, domains: Column | list[str]) -> Column:
    """Exact match of the authority; sub-domains do not count."""
    listed = F.array(*[F.lit(d) for d in domains]).cast("array<string>") if isinstance(domains, list) else domains
    # Most allowed URLs begin with an allowed authority and a slash, mostly the first; only the others are taken apart.
    def begins(d: Column) -> Column:
        return (F.startswith(url, F.concat(F.lit("https://"), d, F.lit("/")))
                | F.startswith(url, F.concat(F.lit("http://"), d, F.lit("/")))) & ~d.rlike(r"[/?#\t\r\n]")

    first = F.coalesce(begins(F.get(listed, F.lit(0))), F.lit(False))
    return F.when(first, True).when(F.exists(listed, begins), True).otherwise(F.array_contains(listed, url_domain(url)))


def joined_patterns(patterns: Column) -> Column:
    """What :func:`url_matches_any` tries for a list of patterns, put together once per list and not per URL:
    ``(listed, joined)``, without ``joined`` for lists that are empty or refer to their own groups."""
    listed = F.coalesce(patterns, F.array().cast("array<string>"))
    groups = F.exists(listed, lambda p: p.rlike(r"\\[1-9k]|\(\?<[a-zA-Z]"))
    joined = F.array_join(F.transform(listed, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    one = F.when(F.size(listed) > 0, F.when(groups, F.lit(None)).otherwise(joined))
    return F.struct(listed.alias("listed"), one.alias("joined"))


def url_matches_joined(url: Column, patterns: Column) -> Column:
    """:func:`url_matches_any` for patterns from :func:`joined_patterns`."""
    each = (F.size(patterns["listed"]) <= 0) | F.exists(patterns["listed"], lambda p: F.rlike(url, p))
    return F.when(patterns["joined"].isNotNull(), F.regexp_instr(url, patterns["joined"], 0) > 0).otherwise(each)


def url_matches_any(url: Column, patterns: Column | list[str] | None) -> Column:
    """True if any pattern is found in the URL, or if there are no patterns.

    The patterns of a column are tried as one alternative, which is compiled again only where a row
    has other patterns than the row before; lists whose patterns refer to their own groups are
    tried one by one. For large sets of patterns see ``operators.patterns``.
    """
    if patterns is None or isinstance(patterns, list):
        out = F.lit(not patterns)
        for p in patterns or []:
            out = out | url.rlike(p)
        return out
    return url_matches_joined(url, joined_patterns(patterns))
