"""CSS selectors as column expressions over the ``nodes`` array of a shredded page.

A selector becomes a predicate on one node. Parents and siblings are reached by array
position. What a node alone cannot tell is listed once per page, sorted, and looked up by halving:
the matches of whatever stands before a descendant step (as many of them begin before a node as
do not end before it, unless it lies inside one), the first fitting child of every parent for
``~``, the siblings of a kind for ``:nth-of-type`` and its like, the inner matches of ``:has``.
Search hierarchies take, inside the interval ``pre + 1 .. last`` of each earlier match, a slice of
the next step's matches, and keep multiplicity and walk order. So cost follows the page's length and
the number of matches; depth and long sibling lists do not multiply it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let


class Page:
    """The nodes of a page and the lists made from them so far, by what they are needed for."""

    def __init__(self, nodes: Column, lists: dict[object, Column] | None = None) -> None:
        self.nodes, self.lists = nodes, lists or {}

    def having(self, key: object, column: Column) -> Page:
        return Page(self.nodes, {**self.lists, key: column})

    def rank(self, key: object, before: Callable[[Column], Column], part: str | None = None) -> Column:
        """:func:`rank` in a list, or in one ``part`` of it."""
        listed = self.lists[key]
        return rank(listed if part is None else listed[part], before, list(self.lists).index(key))


Test = Callable[[Column, Page], Column]
#: How a list comes from the nodes and the lists before it.
Make = Callable[[Page], Column]
#: A place after all others, of a page or among siblings.
BEYOND = 2**31 - 1

_SPACE = re.compile(r"\s+")
_SIMPLE = re.compile(
    r"(?P<star>\*)|#(?P<id>[^\s.#\[\]:>+~,*()]+)|\.(?P<cls>[^\s.#\[\]:>+~,*()]+)"
    r"|\[\s*(?P<attr>[^\s\]=~^$*|]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]]*?)\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<open>\()?|(?P<tag>[a-zA-Z][^\s.#\[\]:>+~,*()]*)")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass
class Compound:
    """Tests that one node must pass together, and the lists they look things up in."""

    tests: list[Test] = field(default_factory=list)
    attrs: set[str] = field(default_factory=set)
    needs: dict[object, Make] = field(default_factory=dict)
    alone: bool = True                 # whether the node by itself is enough

    def holds(self, node: Column, page: Page) -> Column:
        out = F.lit(True)
        for i, test in enumerate(self.tests):
            out = test(node, page) if i == 0 else out & test(node, page)
        return out

    def take(self, inner: Compound) -> None:
        """What an inner compound looks at is looked at here too."""
        self.attrs |= inner.attrs
        self.needs |= inner.needs
        self.alone &= inner.alone

    def listed(self, key: object, make: Make) -> None:
        self.needs[key] = make
        self.alone = False


@dataclass
class Chain:
    """Compounds joined by combinators, leftmost first; ``links[i]`` stands before ``parts[i + 1]``."""

    parts: list[Compound]
    links: list[str]


def _attr(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], F.lit(name))


def _attr_test(name: str, op: str | None, value: str) -> Test:
    def known(check: Callable[[Column], Column]) -> Test:
        return lambda n, _: F.coalesce(check(_attr(n, name)), F.lit(False))

    if op is None:
        return known(lambda v: v.isNotNull())
    if op == "=":
        return known(lambda v: v == F.lit(value))
    if op == "~=":
        if not value or _SPACE.search(value):
            return lambda n, _: F.lit(False)
        return known(lambda v: F.array_contains(F.split(v, r"\s+"), value))
    if op == "|=":
        return known(lambda v: (v == F.lit(value)) | F.startswith(v, F.lit(value + "-")))
    if not value:                      # an empty operand of ^= $= *= matches nothing
        return lambda n, _: F.lit(False)
    fn = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op]
    return known(lambda v: fn(v, F.lit(value)))


def rank(values: Column, before: Callable[[Column], Column], number: int = 0) -> Column:
    """How many elements of a sorted array come ``before``, found by halving.

    The optimizer takes two lookups for the same one if they differ only in the lambda variable that
    holds the array, so lookups in different lists of a page count their steps from different numbers.
    """
    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        right = (acc["low"] < acc["high"]) & before(F.get(values, mid))
        return F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"),
                        F.when(right, acc["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(number), F.length(F.bin(F.size(values))) + (number - 1)),
                       F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda acc: acc["low"])


def _nth(arg: str, name: str, place: Callable[[Column, Page], Column]) -> Test:
    """``an+b`` of the node's place among some of its siblings, from 1."""
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not arg or m is None:
        raise ValueError(f"unsupported argument of :{name}: {arg!r}")
    step = 0 if m.group(1) is None else int(m.group(1) + "1" if m.group(1) in ("", "+", "-") else m.group(1))
    first = int(m.group(2) or 0)
    if step == 0:
        return lambda n, page: place(n, page) == F.lit(first)
    return lambda n, page: let(place(n, page), lambda k: (F.pmod(k - F.lit(first), F.lit(abs(step))) == 0) & (
        (k >= F.lit(first)) if step > 0 else (k <= F.lit(first))))


# Siblings are listed as (parent, pre), or (parent, tag, pre), sorted.

def _siblings(page: Page) -> Column:
    return F.sort_array(F.transform(page.nodes, lambda n: F.struct(n["parent"].alias("parent"), n["pre"].alias("pre"))))


def _kinds(page: Page) -> Column:
    return F.sort_array(F.transform(page.nodes, lambda n: F.struct(
        n["parent"].alias("parent"), n["tag"].alias("tag"), n["pre"].alias("pre"))))


def _upto(node: Column, page: Page, kind: bool, pre: Column) -> Column:
    """How many listed siblings come before the place ``pre`` among the node's siblings."""
    if kind:
        goal = F.struct(node["parent"].alias("parent"), node["tag"].alias("tag"), pre.alias("pre"))
        return page.rank("kinds", lambda s: s < goal)
    goal = F.struct(node["parent"].alias("parent"), pre.alias("pre"))
    return page.rank("siblings", lambda s: s < goal)


def _from_start(node: Column, page: Page) -> Column:
    return _upto(node, page, True, node["pre"]) - _upto(node, page, True, F.lit(-1)) + 1


def _from_end(kind: bool) -> Callable[[Column, Page], Column]:
    return lambda n, page: _upto(n, page, kind, F.lit(BEYOND)) - _upto(n, page, kind, n["pre"])


def _is_last(node: Column, page: Page) -> Column:
    """The last child ends where its parent ends."""
    return (node["parent"] < 0) | (F.get(page.nodes, node["parent"])["last"] == node["last"])


def _has(links: str, inner: Compound, key: object) -> tuple[Make, Test]:
    """List and test of one ``:has`` entry: a descendant, ``>`` child, ``+`` next or ``~`` later sibling."""
    def matches(page: Page) -> Column:
        return F.filter(page.nodes, lambda n: F.coalesce(inner.holds(n, page), F.lit(False)))

    if links == "~":
        def later(n: Column, page: Page) -> Column:
            here = F.struct(n["parent"].alias("parent"), (n["pre"] + 1).alias("pre"))
            there = F.struct(n["parent"].alias("parent"), F.lit(BEYOND).alias("pre"))
            return page.rank(key, lambda s: s < there) > page.rank(key, lambda s: s < here)

        return (lambda page: F.sort_array(F.transform(matches(page), lambda n: F.struct(
            n["parent"].alias("parent"), n["pre"].alias("pre"))))), later
    name = {" ": "pre", ">": "parent", "+": "prev"}[links]

    def inside(n: Column, page: Page) -> Column:
        low, high = (n["pre"] + 1, n["last"] + 1) if links == " " else (n["pre"], n["pre"] + 1)
        return page.rank(key, lambda x: x < high) > page.rank(key, lambda x: x < low)

    return (lambda page: F.sort_array(F.transform(matches(page), lambda n: n[name]))), inside


def _closing(text: str, pos: int) -> int:
    """Where the bracket before ``pos`` closes; quoted text is passed over."""
    depth = 1
    for m in re.compile(r"""["'][^"']*["']|[()]""").finditer(text, pos):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return m.start()
    raise ValueError(f"unsupported selector at {text[pos:]!r}: no closing bracket")


def _split(text: str) -> list[str]:
    """The entries of a comma list, commas inside brackets and quotes aside."""
    out, depth = [""], 0
    for piece in re.findall(r"""\"[^\"]*\"|'[^']*'|.""", text, re.DOTALL):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(piece, 0)
        if piece == "," and depth == 0:
            out.append("")
        else:
            out[-1] += piece
    return [x.strip() for x in out]


def _whole(text: str, name: str) -> Compound:
    """A compound that is all of ``text``."""
    inner, end = _compound(text, 0)
    if not inner.tests or end != len(text):
        raise ValueError(f"unsupported argument of :{name}: {text!r}")
    return inner


def _add_has(out: Compound, entry: str) -> Test:
    """One entry of ``:has``; ``x y`` inside it means an x that in turn has a y."""
    m = re.match(r"\s*([>+~])?\s*", entry)
    link, rest = m.group(1) or " ", entry[m.end():]
    inner, end = _compound(rest, 0)
    if not inner.tests:
        raise ValueError(f"unsupported argument of :has: {entry!r}")
    if end < len(rest):
        inner.tests.append(_add_has(inner, rest[end:]))
    key = object()
    make, test = _has(link, inner, key)
    out.take(inner)
    out.listed(key, make)
    return test


def _pseudo(out: Compound, name: str, arg: str | None) -> None:
    plain = {"first-child": lambda n, _: n["sib"] == 1, "empty": lambda n, _: (n["last"] == n["pre"]) & (n["c0"] == n["c1"]),
             "root": lambda n, _: n["parent"] < 0}
    ends = {"last-child": _is_last, "only-child": lambda n, page: (n["sib"] == 1) & _is_last(n, page)}
    kinds = {"first-of-type": lambda n, page: _from_start(n, page) == 1, "last-of-type": lambda n, page: _from_end(True)(n, page) == 1,
             "only-of-type": lambda n, page: (_from_start(n, page) == 1) & (_from_end(True)(n, page) == 1)}
    counted = {"nth-child": lambda n, _: n["sib"], "nth-last-child": _from_end(False), "nth-of-type": _from_start,
               "nth-last-of-type": _from_end(True)}
    if (name in counted or name in ("not", "is", "where", "has")) != (arg is not None):
        raise ValueError(f"unsupported selector :{name}")
    if name in plain:
        out.tests.append(plain[name])
    elif name in ends:
        out.tests.append(ends[name])
        out.alone = False
    elif name in kinds or name in counted:
        if name != "nth-child":
            out.listed(*(("siblings", _siblings) if name == "nth-last-child" else ("kinds", _kinds)))
        out.tests.append(kinds[name] if name in kinds else _nth(arg, name, counted[name]))
    elif name in ("not", "is", "where"):
        inner = [_whole(entry, name) for entry in _split(arg)]
        for c in inner:
            out.take(c)

        def any_of(n: Column, page: Page) -> Column:
            found = inner[0].holds(n, page)
            for c in inner[1:]:
                found = found | c.holds(n, page)
            return ~found if name == "not" else found

        out.tests.append(any_of)
    elif name == "has":
        tests = [_add_has(out, entry) for entry in _split(arg)]

        def has_any(n: Column, page: Page) -> Column:
            found = tests[0](n, page)
            for test in tests[1:]:
                found = found | test(n, page)
            return found

        out.tests.append(has_any)
    else:
        raise ValueError(f"unsupported selector :{name}")


def _compound(text: str, pos: int) -> tuple[Compound, int]:
    out, start = Compound(), pos
    while pos < len(text) and (m := _SIMPLE.match(text, pos)):
        if m["tag"] and pos != start:
            break
        pos = m.end()
        if m["star"]:
            out.tests.append(lambda n, _: F.lit(True))
        elif m["tag"]:
            out.tests.append(lambda n, _, v=m["tag"].lower(): n["tag"] == F.lit(v))
        elif m["id"]:
            out.attrs.add("id")
            out.tests.append(_attr_test("id", "=", m["id"]))
        elif m["cls"]:
            out.tests.append(lambda n, _, v=m["cls"]: F.array_contains(n["classes"], v))
        elif m["attr"]:
            value = m["val"] or ""
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            out.attrs.add(m["attr"].lower())
            out.tests.append(_attr_test(m["attr"].lower(), m["op"], value))
        else:
            arg = None
            if m["open"]:
                end = _closing(text, pos)
                arg, pos = text[pos:end].strip(), end + 1
            _pseudo(out, m["pseudo"], arg)
    return out, pos


@dataclass
class Selector:
    """A comma group of chains, parsed once on the driver."""

    text: str
    chains: list[Chain]

    @property
    def attrs(self) -> set[str]:
        """Attributes the shredder has to keep for this selector."""
        return {a for c in self.chains for p in c.parts for a in p.attrs}

    @property
    def alone(self) -> bool:
        """Whether a node's own fields decide."""
        return all(len(c.parts) == 1 and c.parts[0].alone for c in self.chains)

    def holds(self, node: Column, page: Page) -> Column:
        """``page`` has the lists of :func:`with_lists`."""
        out = None
        for chain in self.chains:
            one = _chain_holds(chain, len(chain.parts) - 1, node, page)
            out = one if out is None else out | one
        return out

    def lists(self) -> Iterable[tuple[object, Make]]:
        """What :meth:`holds` looks things up in; a list may use those before it."""
        for chain in self.chains:
            for i, part in enumerate(chain.parts):
                yield from part.needs.items()
                link = chain.links[i] if i < len(chain.links) else None
                if link == "~":
                    yield (id(chain), i), lambda page, c=chain, i=i: _first_hits(
                        page.nodes, lambda n: _chain_holds(c, i, n, page))
                elif link == " ":
                    yield (id(chain), i), lambda page, c=chain, i=i: _intervals(
                        page.nodes, lambda n: _chain_holds(c, i, n, page))


def parse_selector(text: str) -> Selector:
    """Parse the supported grammar; anything else is refused with its position."""
    chains, pos, body = [], 0, text.strip()
    if not body:
        raise ValueError("empty selector")
    while True:
        parts, links = [], []
        while True:
            part, end = _compound(body, pos)
            if end == pos:
                raise ValueError(f"unsupported selector at {body[pos:]!r} in {text!r}")
            parts.append(part)
            pos = end
            if pos == len(body) or re.match(r"\s*,", body[pos:]):
                break
            m = _COMBINATOR.match(body, pos)
            if m is None:
                raise ValueError(f"unsupported selector at {body[pos:]!r} in {text!r}")
            links.append(m.group(1) or " ")
            pos = m.end()
        chains.append(Chain(parts, links))
        if pos == len(body):
            return Selector(text, chains)
        pos += re.match(r"\s*,\s*", body[pos:]).end()


#: Elements that a page may have without their start tag.
_UNWRITTEN = frozenset("html head body tbody tr colgroup p br".split())


def required_texts(text: str) -> set[str]:
    """What the source of a page of plain lower-case tags without entities must hold for the selector to match
    at all: tags, classes, ids and attribute names. Selectors with groups, functions and the like require nothing."""
    if re.search(r"[,:()]", text):
        return set()
    out: set[str] = set()
    pos = 0
    while pos < len(text):
        m = _SIMPLE.match(text, pos) or _COMBINATOR.match(text, pos)
        if m is None or m.end() == pos:
            return set()
        if m.re is _SIMPLE:
            tag, name = m["tag"], m["id"] or m["cls"] or m["attr"]
            if tag and tag.lower() not in _UNWRITTEN:
                out.add(f"<{tag.lower()}")
            elif name:
                out.add(name.lower() if m["attr"] else name)
        pos = m.end()
    return out


def _chain_holds(chain: Chain, i: int, node: Column, page: Page) -> Column:
    """Does ``node`` end the first ``i + 1`` compounds of the chain?"""
    here = chain.parts[i].holds(node, page)
    if i == 0:
        return here
    link = chain.links[i - 1]

    def at(pointer: str) -> Column:
        return F.coalesce(_chain_holds(chain, i - 1, F.get(page.nodes, node[pointer]), page), F.lit(False))

    if link == ">":
        return here & (node["parent"] >= 0) & at("parent")
    if link == "+":
        return here & (node["prev"] >= 0) & at("prev")
    key = (id(chain), i - 1)
    if link == "~":
        return here & (node["prev"] >= 0) & _after_first(page, key, node)
    return here & (page.rank(key, lambda x: x < node["pre"], "begin") > page.rank(key, lambda x: x < node["pre"], "last"))


def _passing(nodes: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(nodes, lambda n: F.coalesce(test(n), F.lit(False)))


def _intervals(nodes: Column, test: Callable[[Column], Column]) -> Column:
    """``(begin, last)``: where the passing nodes begin, and where they end, each sorted."""
    return let(_passing(nodes, test), lambda hits: F.struct(
        F.transform(hits, lambda n: n["pre"]).alias("begin"),
        F.sort_array(F.transform(hits, lambda n: n["last"])).alias("last")))


def _first_hits(nodes: Column, test: Callable[[Column], Column]) -> Column:
    """``(parent, pre)`` of the first passing child of every parent that has one, sorted by parent."""
    keyed = F.sort_array(F.transform(_passing(nodes, test), lambda n: F.struct(
        n["parent"].alias("parent"), n["pre"].alias("pre"))))
    return let(keyed, lambda all_: F.filter(
        all_, lambda h, k: (k == 0) | (F.get(all_, k - 1)["parent"] != h["parent"])))


def _after_first(page: Page, key: object, node: Column) -> Column:
    """Does ``node`` stand after the first hit among its siblings?"""
    found = F.get(page.lists[key], page.rank(key, lambda h: h["parent"] < node["parent"]))
    return let(found, lambda hit: F.coalesce(
        (hit["parent"] == node["parent"]) & (hit["pre"] < node["pre"]), F.lit(False)))


def with_lists(nodes: Column, needs: Iterable[tuple[object, Make]], body: Callable[[Page], Column]) -> Column:
    """``body`` with a page that has all lists, each made once."""
    todo = list(dict(needs).items())

    def bound(k: int, page: Page) -> Column:
        if k == len(todo):
            return body(page)
        key, make = todo[k]
        return let(make(page), lambda column: bound(k + 1, page.having(key, column)))

    return bound(0, Page(nodes))


def _parsed(selector: Selector | str) -> Selector:
    return parse_selector(selector) if isinstance(selector, str) else selector


def css_positions(nodes: Column, selector: Selector | str) -> Column:
    """Positions of the matching nodes in document order, each once (``array<int>``)."""
    chosen = _parsed(selector)
    return with_lists(nodes, chosen.lists(), lambda page: F.transform(
        F.filter(nodes, lambda n: chosen.holds(n, page)), lambda n: n["pre"]))


def positions_inside(nodes: Column, outer: Column, selector: Selector | str) -> Column:
    """Positions of the matches strictly inside each of the nodes at ``outer``, one after another.

    All matches of the page are found once; those inside a node are a slice of them.
    """
    def inside(hits: Column, at: Column) -> Column:
        low = rank(hits, lambda x: x <= at)
        return let(low, lambda low: F.slice(hits, low + 1, rank(hits, lambda x: x <= F.get(nodes, at)["last"]) - low))

    return let(outer, lambda found: F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(
        let(css_positions(nodes, selector), lambda hits: F.flatten(F.transform(found, lambda at: inside(hits, at))))))


def path_positions(nodes: Column, steps: list[Selector | str], distinct: bool = False) -> Column:
    """Positions reached by narrowing step by step inside every earlier match.

    Bag semantics in walk order: a node reached along k chains appears k times unless
    ``distinct``. No steps means no matches.
    """
    if not steps:
        return F.array().cast("array<int>")
    found = css_positions(nodes, steps[0])
    for step in steps[1:]:
        found = positions_inside(nodes, found, step)
    return F.array_distinct(found) if distinct else found
