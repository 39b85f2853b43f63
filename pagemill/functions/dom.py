"""HTML shredding: one Arrow stage that turns each page into an array of element rows.

A page row becomes

* ``chunks``: the page's text nodes in document order, and
* ``nodes``: one struct per element in document order, with the pre-order interval
  encoding of trees (Grust, "Accelerating XPath location steps", SIGMOD 2002).

``nodes[i].pre = i``, so a parent or a sibling is one array access away, and the
descendants of a node are exactly the positions ``pre + 1 .. last``. Text is a range of
``chunks`` and inner markup a range of the page source, so nothing is copied per ancestor.
Everything after this stage is Catalyst expressions; no page needs a shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's code with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),      # largest pre inside the subtree
    T.StructField("parent", T.IntegerType()),    # pre of the parent, -1 at the root
    T.StructField("prev", T.IntegerType()),      # pre of the element sibling before, or -1
    T.StructField("level", T.IntegerType()),
    T.StructField("sib", T.IntegerType()),       # 1-based rank among element siblings
    T.StructField("tag", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("c0", T.IntegerType()),        # text = chunks[c0 .. c1 - 1]
    T.StructField("c1", T.IntegerType()),
    T.StructField("h0", T.IntegerType()),        # markup = source[h0 .. h1 - 1], code points
    T.StructField("h1", T.IntegerType()),
])
CHUNKS = T.ArrayType(T.StringType())
NODES = T.ArrayType(NODE)

# Output batches of the Arrow stage: bounded by source size, so a run of large pages
# never piles up in one Python worker.
BATCH_CHARS = 4 << 20
BATCH_PAGES = 1024

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("iframe noembed noframes script style xmp".split())
ESCAPABLE_TEXT = frozenset("textarea title".split())
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary "
    "table ul xmp".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
SCOPE = frozenset("applet caption html marquee object table td template th".split())
TABLE_SCOPE = frozenset("html table template".split())
SPECIAL = CLOSES_P | TABLE_PARTS | SCOPE | VOID | HEAD_CONTENT | frozenset(
    "body button frame frameset head iframe noembed select textarea".split())

_LI_STOP = SPECIAL - {"address", "div", "p", "li"}
_DD_STOP = SPECIAL - {"address", "div", "p", "dd", "dt"}
_P_STOP = SCOPE | {"button"}
_LIST_STOP = SCOPE | {"ol", "ul"}
_TABLE_STOP = frozenset(("html", "template"))
# Start tags that may close or imply something; all others open an element and nothing else.
_IMPLYING = CLOSES_P | TABLE_PARTS | frozenset("a body button head html optgroup option".split())
_NO_ATTRS: dict[str, str] = {}

_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*)")
_ATTR = re.compile(r"""[ \t\n\f\r/]*([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)"""
                   r"""(?:[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*"|'[^']*'|[^ \t\n\f\r>]*))?""")
# The common well-formed tag in one match; anything else takes the attribute loop.
# An unquoted value directly before a slash is not plain: the slash belongs to it.
_PLAIN_ATTR = re.compile(r"""([^ \t\n\f\r"'>/=]+)(?:="([^"]*)"|='([^']*)'|=([^ \t\n\f\r"'>/=]++)(?!/))?""")
_ATTRS = r"""(?:[ \t\n\f\r]+[^ \t\n\f\r"'>/=]+(?:="[^"]*"|='[^']*'|=[^ \t\n\f\r"'>/=]++(?!/))?)*"""
_PLAIN_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*)({_ATTRS})[ \t\n\f\r]*/?>")
# All markup of a well-formed page; group 1 is an anchor's attributes, group 3 marks what is not well formed.
_MARKUP = re.compile(
    rf"<a(?=[ \t\n\f\r/>])({_ATTRS})[ \t\n\f\r]*/?>|<!--(?:>|->|.*?(?:-->|\Z))"
    rf"|<({'|'.join(sorted(RAW_TEXT | ESCAPABLE_TEXT))})(?=[ \t\n\f\r/>]){_ATTRS}[ \t\n\f\r]*/?>.*?(?=</\2[ \t\n\f\r/>]|\Z)"
    rf"|</?[a-zA-Z][^ \t\n\f\r/>]*{_ATTRS}[ \t\n\f\r]*/?>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>|(<(?=[a-zA-Z/!?]))", re.I | re.S)
_TAG_END = re.compile(r"[ \t\n\f\r/]*>")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])", re.I) for t in RAW_TEXT | ESCAPABLE_TEXT}


class _Batch:
    """Element columns of a run of pages, gathered flat for Arrow."""

    INTS = ("last", "parent", "prev", "level", "sib", "c0", "c1", "h0", "h1")

    def __init__(self) -> None:
        self.ints: dict[str, list[int]] = {k: [] for k in self.INTS}
        self.tag: list[str] = []
        self.classes: list[str] = []
        self.class_at = [0]
        self.keys: list[str] = []
        self.values: list[str] = []
        self.attr_at = [0]
        self.chunks: list[str] = []
        self.page_nodes = [0]
        self.page_chunks = [0]
        self.hrefs: list[str | None] = []       # of every anchor, in document order
        self.page_hrefs = [0]

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        def offsets(at: list[int]) -> pa.Array:
            return pa.array(at, pa.int32())

        columns = {k: pa.array(v, pa.int32()) for k, v in self.ints.items()}
        starts = np.asarray(self.page_nodes, dtype=np.int32)
        columns["pre"] = pa.array(np.arange(starts[-1], dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts)))
        columns["tag"] = pa.array(self.tag, pa.string())
        columns["classes"] = pa.ListArray.from_arrays(offsets(self.class_at), pa.array(self.classes, pa.string()))
        columns["attrs"] = pa.MapArray.from_arrays(
            offsets(self.attr_at), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        nodes = pa.StructArray.from_arrays([columns[f] for f in NODE.names], names=NODE.names)
        return (
            pa.ListArray.from_arrays(offsets(self.page_chunks), pa.array(self.chunks, pa.string())),
            pa.ListArray.from_arrays(offsets(self.page_nodes), nodes),
        )


def _add_page(out: _Batch, source: str, keep: frozenset[str] | None) -> None:
    """Append one page's elements and text to the batch, closing what the markup leaves open."""
    ints, tags, chunks = out.ints, out.tag, out.chunks
    base, text_base = out.page_nodes[-1], out.page_chunks[-1]
    last, c1, h1 = ints["last"], ints["c1"], ints["h1"]
    children: list[int] = []        # per element: element children so far
    newest: list[int] = []          # per element: its newest child
    open_: list[int] = []           # open elements, outermost first
    names: list[str] = []           # their tag names
    counts: dict[str, int] = {}     # how many of a name are open, so that a miss need not walk the stack
    head = body = -1

    parents, prevs, levels, sibs = ints["parent"], ints["prev"], ints["level"], ints["sib"]
    c0, h0, class_at, attr_at = ints["c0"], ints["h0"], out.class_at, out.attr_at
    hrefs = out.hrefs

    def push(tag: str, attrs: dict[str, str], at: int) -> int:
        pre = len(children)
        if open_:
            parent = open_[-1]
            prevs.append(newest[parent])
            newest[parent] = pre
            children[parent] = sib = children[parent] + 1
            sibs.append(sib)
            parents.append(parent)
        else:
            prevs.append(-1)
            sibs.append(1)
            parents.append(-1)
        children.append(0)
        newest.append(-1)
        levels.append(len(open_))
        text_at = len(chunks) - text_base
        c0.append(text_at)
        c1.append(text_at)
        h0.append(at)
        h1.append(at)
        last.append(pre)
        tags.append(tag)
        if attrs:
            if "class" in attrs:
                out.classes.extend(attrs["class"].split())
            for k, v in attrs.items():
                if keep is None or k in keep:
                    out.keys.append(k)
                    out.values.append(v)
        if tag == "a":
            hrefs.append(attrs.get("href"))
        class_at.append(len(out.classes))
        attr_at.append(len(out.keys))
        if tag not in VOID:
            open_.append(pre)
            names.append(tag)
            counts[tag] = counts.get(tag, 0) + 1
        return pre

    def close(depth: int, at: int) -> None:
        """Close the open elements from the innermost out to position ``depth``."""
        end, text_end = len(children) - 1, len(chunks) - text_base
        for i in open_[depth:]:
            last[base + i], c1[base + i], h1[base + i] = end, text_end, at
        for name in names[depth:]:
            counts[name] -= 1
        del open_[depth:], names[depth:]

    def find(wanted: Iterable[str], stop: frozenset[str]) -> int:
        """Stack position of the innermost wanted element, -1 if a stop comes first."""
        if not any(counts.get(w) for w in wanted):
            return -1
        for d in range(len(names) - 1, -1, -1):
            if names[d] in wanted:
                return d
            if names[d] in stop:
                return -1
        return -1

    def close_if_open(wanted: Iterable[str], stop: frozenset[str], at: int) -> bool:
        d = find(wanted, stop)
        if d >= 0:
            close(d, at)
        return d >= 0

    def enter_body(at: int) -> None:
        nonlocal head, body
        if body < 0:
            if head < 0:
                head = push("head", {}, at)
            close(1, at)
            body = push("body", {}, at)

    def start(tag: str, attrs: dict[str, str], lt: int, at: int) -> bool:
        """Open an element, first closing what its kind implies. False if the tag is dropped."""
        nonlocal head, body
        if tag == "html":
            if not children:
                push("html", attrs, at)
            return False
        if not children:
            push("html", {}, lt)
        if tag == "head":
            if head < 0 and body < 0:
                head = push("head", attrs, at)
            return False
        if tag == "body":
            if body < 0:
                if head < 0:
                    head = push("head", {}, lt)
                close(1, lt)
                body = push("body", attrs, at)
            return False
        if body < 0:
            if tag in HEAD_CONTENT:
                if head < 0:
                    head = push("head", {}, lt)
                elif len(open_) == 1:
                    open_.append(head)
                    names.append("head")
                    counts["head"] += 1
            else:
                enter_body(lt)
        if tag in TABLE_PARTS:
            table = find(("table",), _TABLE_STOP)
            if table < 0:
                return False
            stay = ["table"]
            if tag in ("tr", "td", "th"):
                stay += ["tbody", "thead", "tfoot"]
            if tag in ("td", "th"):
                stay.append("tr")
            if tag == "col":
                stay.append("colgroup")
            while names[-1] not in stay:
                close(len(names) - 1, lt)
            if tag in ("tr", "td", "th") and names[-1] == "table":
                push("tbody", {}, lt)
            if tag in ("td", "th") and names[-1] != "tr":
                push("tr", {}, lt)
        elif tag == "li":
            close_if_open(("li",), _LI_STOP, lt)
        elif tag in ("dd", "dt"):
            close_if_open(("dd", "dt"), _DD_STOP, lt)
        elif tag in ("option", "optgroup"):
            if names[-1] == "option":
                close(len(names) - 1, lt)
            if tag == "optgroup" and names[-1] == "optgroup":
                close(len(names) - 1, lt)
        elif tag == "a":
            if counts.get("a"):
                close_if_open(("a",), SPECIAL, lt)
        elif tag == "button":
            close_if_open(("button",), SCOPE, lt)
        if tag in CLOSES_P:
            if counts.get("p"):
                close_if_open(("p",), _P_STOP, lt)
            if tag in HEADINGS and names[-1] in HEADINGS:
                close(len(names) - 1, lt)
        push(tag, attrs, at)
        return True

    def finish(tag: str, lt: int, at: int) -> None:
        """Handle an end tag."""
        if tag in ("html", "body") or not children:
            return
        if tag == "head":
            if len(names) > 1 and names[1] == "head":
                close(1, lt)
        elif tag == "p":
            if not close_if_open(("p",), _P_STOP, lt):
                enter_body(lt)
                push("p", {}, at)
                close(len(names) - 1, at)
        elif tag == "br":
            enter_body(lt)
            push("br", {}, at)
        elif tag in HEADINGS:
            close_if_open(HEADINGS, SCOPE, lt)
        elif tag in TABLE_PARTS or tag == "table":
            close_if_open((tag,), TABLE_SCOPE, lt)
        elif tag == "li":
            close_if_open((tag,), _LIST_STOP, lt)
        elif tag in SPECIAL:
            close_if_open((tag,), SCOPE, lt)
        else:
            close_if_open((tag,), SPECIAL, lt)

    def text(value: str, at: int) -> None:
        if body < 0 and len(open_) <= 2:
            if not value.strip():
                return
            if not children:
                push("html", {}, at)
            enter_body(at)
        chunks.append(value)

    pos, n = 0, len(source)
    while pos < n:
        lt = source.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            piece = source[pos:lt]
            text(unescape(piece) if "&" in piece else piece, pos)
            if lt == n:
                break
        if len(names) > 2 and source.startswith("</", lt):       # mostly the plain end of the innermost element
            tag = names[-1]
            if source.startswith(tag + ">", lt + 2):
                pos = lt + 3 + len(tag)
                i = open_.pop()
                names.pop()
                counts[tag] -= 1
                last[base + i], c1[base + i], h1[base + i] = len(children) - 1, len(chunks) - text_base, lt
                continue
        attrs = _NO_ATTRS
        m = _PLAIN_TAG.match(source, lt)
        if m is not None:
            slash, tag, listed = m.groups()
            tag, pos = tag.lower(), m.end()
            if listed and not slash:
                attrs = {}
                for key, double, single, bare in _PLAIN_ATTR.findall(listed):
                    key, value = key.lower(), double or single or bare
                    if key not in attrs:
                        attrs[key] = unescape(value) if "&" in value else value
        else:
            m = _TAG.match(source, lt)
            if m is None:
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 2)
                    pos = n if end < 0 else end + 3
                elif source[lt + 1:lt + 2] in ("!", "?", "/") and lt + 1 < n:
                    end = source.find(">", lt + 2)
                    pos = n if end < 0 else end + 1
                else:
                    text("<", lt)
                    pos = lt + 1
                continue
            slash, tag, pos = m.group(1), m.group(2).lower(), m.end()
            attrs = {}
            end_m = _TAG_END.match(source, pos)
            while end_m is None:
                a = _ATTR.match(source, pos)
                if a is None:
                    break
                pos = a.end()
                key, value = a.group(1).lower(), a.group(2) or ""
                if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
                    value = value[1:-1]
                if key not in attrs:
                    attrs[key] = unescape(value) if "&" in value else value
                end_m = _TAG_END.match(source, pos)
            if end_m is None:            # the source ends inside a tag: the tag is dropped
                break
            pos = end_m.end()
        if slash:
            if names and names[-1] == tag and len(names) > 2:    # the innermost element
                i = open_.pop()
                names.pop()
                counts[tag] -= 1
                last[base + i], c1[base + i], h1[base + i] = len(children) - 1, len(chunks) - text_base, lt
            else:
                finish(tag, lt, pos)
        elif body >= 0 and (tag not in _IMPLYING or tag == "a" and not counts.get("a")):
            push(tag, attrs, pos)
            opened = True
        else:
            opened = start(tag, attrs, lt, pos)
        if not slash and tag in _RAW_END and opened:
            stop = _RAW_END[tag].search(source, pos)
            end = stop.start() if stop else n
            if end > pos:
                piece = source[pos:end]
                chunks.append(unescape(piece) if tag in ESCAPABLE_TEXT and "&" in piece else piece)
            pos = end
    if not children:
        push("html", {}, 0)
    enter_body(n)
    close(0, n)
    out.page_nodes.append(base + len(children))
    out.page_chunks.append(len(chunks))
    out.page_hrefs.append(len(hrefs))


# The beginning of a tag that Spark's expressions leave to Python: anything but a tag in lower case with quoted or
# simple values, without entities, comments or raw text; an anchor starts with its href.
_ATTRS = r'(?: [a-z][a-z-]*+=(?:"[^"&<>]*+"|[a-zA-Z0-9_-]++)){0,20}+'
_ODD_TAG = (r'<(?!/?+(?!(?:a|iframe|noembed|noframes|script|style|textarea|title|xmp)[ />])[a-z][a-z0-9]*+' + _ATTRS
            + r'>|/(?:a|title)>|a href="[^"&<>]*+"' + _ATTRS + r'>|title>[^<]*+</title>|!DOCTYPE html>)')
_PLAIN_HREF = r'<a href="([^"]*+)"'


def _hrefs(source: str) -> list[str | None]:
    """href (or None) of every anchor, in document order, without building the tree.

    A page with any malformed tag goes through the tree builder, so both ways agree.
    """
    out: list[str | None] = []
    for m in _MARKUP.finditer(source):
        if m.lastindex == 1:
            href, listed = None, m.group(1)
            for key, double, single, bare in _PLAIN_ATTR.findall(listed) if listed else ():
                if key.lower() == "href":
                    href = unescape(double or single or bare)
                    break
            out.append(href)
        elif m.lastindex == 3:
            batch = _Batch()
            _add_page(batch, source, frozenset())
            return batch.hrefs
    return out


def plain_source(html: Column) -> Column:
    """Whether a page consists of plain tags only, so that its source shows all its tags and values as they are."""
    return ~html.rlike(_ODD_TAG)


def plain_hrefs(html: Column) -> Column:
    """The hrefs of :func:`page_hrefs` for a page of plain tags."""
    return F.regexp_extract_all(html, F.lit(_PLAIN_HREF), F.lit(1))


# URLs and hrefs whose target is put together from pieces, without dots, escapes or empty segments. Others are Spark's.
_STEPS = r"[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*/?"
_PLAIN_BASE = r"^(?P<origin>https?://[a-z0-9.-]+)(?P<path>(?P<folder>(?:/[A-Za-z0-9_-]+)*)/[A-Za-z0-9_-]*)?$"
_PLAIN_ABSOLUTE = rf"^(?P<head>(?:[hH][tT][tT][pP][sS]?:)?//[A-Za-z0-9.-]+)(?P<tail>(?:/|/{_STEPS})?)$"


def plain_targets(urls: pa.Array, hrefs: pa.ListArray, skipped: tuple[str, ...]) -> pa.ListArray:
    """Targets of the hrefs of each page, without those ``skipped`` and empty ones; null for a page on which one
    is not of the plain forms. Says what ``urls.resolve_link`` says."""
    values, page = hrefs.flatten(), pc.list_parent_indices(hrefs)
    base = pc.extract_regex(urls, pattern=_PLAIN_BASE)
    origin, folder, path = (pc.struct_field(base, n) for n in ("origin", "folder", "path"))
    here = pc.binary_join_element_wise(origin, path, "").take(page)
    rooted = pc.not_equal(path, "").take(page)
    inside = pc.binary_join_element_wise(origin, folder, "").take(page)
    above = pc.binary_join_element_wise(origin, pc.replace_substring_regex(folder, "/[^/]*$", ""), "").take(page)
    origin = origin.take(page)
    full = pc.extract_regex(values, pattern=_PLAIN_ABSOLUTE)
    head, tail = pc.ascii_lower(pc.struct_field(full, "head")), pc.struct_field(full, "tail")
    scheme = pc.replace_substring_regex(origin, "//.*$", "")
    drop = pc.or_(pc.is_null(values), pc.fill_null(pc.is_in(values, pa.array(["", *skipped], pa.string())), False))
    found = pc.case_when(
        pc.make_struct(
            drop, pc.match_substring_regex(values, rf"^/(?:{_STEPS})?$"), pc.match_substring_regex(values, rf"^{_STEPS}$"),
            pc.match_substring_regex(values, rf"^[.][.]/{_STEPS}$"), pc.starts_with(head, "//"), pc.is_valid(head),
            pc.and_(rooted, pc.match_substring_regex(values, "^[#?][A-Za-z0-9_=&-]+$"))),
        pa.scalar("", pa.string()), pc.binary_join_element_wise(origin, values, ""), pc.binary_join_element_wise(inside, values, "/"),
        pc.binary_join_element_wise(above, pc.utf8_slice_codeunits(values, 3), "/"),
        pc.binary_join_element_wise(scheme, head, tail, ""), pc.binary_join_element_wise(head, tail, ""),
        pc.binary_join_element_wise(here, values, ""))
    kept = pc.and_(pc.is_valid(found), pc.invert(drop))
    places = page.to_numpy(zero_copy_only=False)
    odd = np.bincount(places[pc.is_null(found).to_numpy(zero_copy_only=False)], minlength=len(urls)) > 0
    sizes = np.bincount(places[kept.to_numpy(zero_copy_only=False)], minlength=len(urls))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), found.filter(kept), mask=pa.array(odd))


def resolved(urls: pa.Array, hrefs: pa.ListArray, skipped: tuple[str, ...]) -> dict[str, pa.Array]:
    """``hrefs`` where there are no ``targets`` by :func:`plain_targets`, and these. Columns go by their place."""
    places = np.arange(len(urls))       # copies: a slice's offset is not heeded by all of pyarrow's functions
    hrefs = hrefs.take(places)
    targets = plain_targets(urls.take(places), hrefs, skipped)
    return {"hrefs": hrefs.take(pa.array(places, mask=targets.is_valid().to_numpy(zero_copy_only=False))), "targets": targets}


def href_batches(html_col: str, skipped: tuple[str, ...] | None = None) -> Callable:
    """Arrow function that drops the source column and fills ``hrefs`` where there is a source. With ``skipped`` it adds
    ``targets`` by :func:`plain_targets` and keeps ``hrefs`` where those are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_PAGES):
                rows = batch.slice(first, BATCH_PAGES)
                found = rows.column("hrefs")
                if rows.column(html_col).null_count < rows.num_rows:
                    found = pa.array([h if s is None else _hrefs(s) for s, h in zip(
                        rows.column(html_col).to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.string()))
                fields = [f for f in batch.schema.names if f not in (html_col, "hrefs")]
                out = dict(zip(fields, map(rows.column, fields), strict=True)) | {"hrefs": found}
                if skipped is not None:
                    out |= resolved(rows.column("url"), found, skipped)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def page_hrefs(pages: DataFrame, html_col: str = "html", skipped: tuple[str, ...] | None = None) -> DataFrame:
    """Replace ``html`` by ``hrefs``: the cheap form of :func:`shred_pages` when only links matter.

    Pages of plain tags only (:data:`_ODD_TAG` finds nothing) are read by Spark's own expressions, once; of the
    others the source goes on to Python. Both see every page the same way. With ``skipped`` hrefs and a column
    ``url``, pages of plain hrefs get ``targets`` instead of ``hrefs``, the others null.
    """
    fields = [f for f in pages.schema.fields if f.name != html_col]
    html = F.coalesce(F.col(html_col), F.lit(""))
    listed = F.when(plain_source(html), plain_hrefs(html))
    read = pages.select(*[F.col(f"`{f.name}`") for f in fields], html.alias(html_col), listed.alias("hrefs"))
    left = read.withColumn(html_col, F.when(F.col("hrefs").isNull(), F.col(html_col)))
    more = [T.StructField("hrefs", CHUNKS)] + ([] if skipped is None else [T.StructField("targets", CHUNKS)])
    return left.mapInArrow(href_batches(html_col, skipped), T.StructType([*fields, *more]))


def shred_batches(html_col: str, attrs: list[str] | None, keep_html: bool, skipped: tuple[str, ...] | None = None) -> Callable:
    """The function handed to ``mapInArrow``; other columns pass through untouched. With ``skipped`` it adds ``hrefs`` and
    ``targets`` as :func:`href_batches` does, and a page that comes with ``hrefs`` has no tree."""
    keep = None if attrs is None else frozenset(attrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch: pa.RecordBatch, first: int, stop: int, out: _Batch) -> pa.RecordBatch:
            rows = batch.slice(first, stop - first)
            chunks, nodes = out.arrays()
            fields = [f for f in batch.schema.names if (keep_html or f != html_col) and (skipped is None or f != "hrefs")]
            done = dict(zip(fields, map(rows.column, fields), strict=True)) | {"chunks": chunks, "nodes": nodes}
            if skipped is not None:
                hrefs = pa.ListArray.from_arrays(pa.array(out.page_hrefs, pa.int32()), pa.array(out.hrefs, pa.string()))
                done |= resolved(rows.column("url"), hrefs, skipped)
            return pa.RecordBatch.from_arrays(list(done.values()), names=list(done))

        for batch in batches:
            sources = batch.column(html_col)
            known = batch.column("hrefs").to_pylist() if skipped is not None else [None] * batch.num_rows
            first, size, out = 0, 0, _Batch()
            for i, hrefs in enumerate(known):
                if hrefs is None:
                    page = sources[i].as_py() or ""
                    _add_page(out, page, keep)
                    size += len(page)
                else:
                    out.hrefs += hrefs
                    out.page_nodes.append(out.page_nodes[-1])
                    out.page_chunks.append(out.page_chunks[-1])
                    out.page_hrefs.append(len(out.hrefs))
                if size >= BATCH_CHARS or i + 1 - first >= BATCH_PAGES:
                    yield emit(batch, first, i + 1, out)
                    first, size, out = i + 1, 0, _Batch()
            if first < batch.num_rows:
                yield emit(batch, first, batch.num_rows, out)

    return run


def shred_pages(pages: DataFrame, attrs: list[str] | None = None, keep_html: bool = False,
                html_col: str = "html", skipped: tuple[str, ...] | None = None) -> DataFrame:
    """Replace ``html`` by ``chunks`` and ``nodes``; one row per page, no shuffle.

    ``attrs`` names the attributes worth keeping (column pruning for the map; all when
    ``None``). The page source travels back to the JVM only with ``keep_html``, which inner
    markup needs. Filters do not move through this stage, so put them before it. With ``skipped``
    hrefs and columns ``url`` and ``hrefs``, pages with ``hrefs`` get no nodes, and all get ``targets``
    or ``hrefs`` as from :func:`page_hrefs`.
    """
    fields = [f for f in pages.schema.fields if (keep_html or f.name != html_col) and (skipped is None or f.name != "hrefs")]
    more = [T.StructField("chunks", CHUNKS), T.StructField("nodes", NODES)]
    if skipped is not None:
        more += [T.StructField("hrefs", CHUNKS), T.StructField("targets", CHUNKS)]
    return pages.mapInArrow(shred_batches(html_col, attrs, keep_html, skipped), T.StructType(fields + more))


def node_table(shredded: DataFrame, *keys: str) -> DataFrame:
    """The relational form: one row per element, ``keys`` first, with ``id`` pulled out of the map."""
    return (
        shredded.select(*keys, F.explode("nodes").alias("node"))
        .select(*keys, "node.*", F.element_at("node.attrs", F.lit("id")).alias("id"))
    )


def shred_view(pages: DataFrame, name: str, *keys: str) -> None:
    """Make the elements of ``pages`` a SQL view: ``keys``, the columns of :func:`node_table`, and ``text``.

    The view is the Arrow stage of :func:`shred_pages` and an explode; filters on ``keys`` go below it.
    """
    rows = shred_pages(pages.select(*keys, "html")).select(*keys, "chunks", F.explode("nodes").alias("node"))
    text = F.array_join(F.slice("chunks", F.col("node.c0") + 1, F.col("node.c1") - F.col("node.c0")), "")
    rows.select(*keys, "node.*", F.element_at("node.attrs", F.lit("id")).alias("id"), text.alias("text")).createOrReplaceTempView(name)
