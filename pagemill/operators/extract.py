"""Rule-driven extraction: all elements of all pages in one map-only pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import plain_hrefs, plain_source, shred_pages
from ..functions.expr import let, span
from ..functions.selectors import css_positions, parse_selector, path_positions, positions_inside, required_texts
from ..functions.values import collect_attr, collect_text, csv_field, inner_markup, registered_value
from ..sources.specs import Rule
from .links import CLICK_HREFS, scanned_targets
from .reshape import strided_rows, zip_arrays, zip_columns
from .select import page_keys


def drop_seed_pages(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Leave out pages of seeds flagged ``only_scrape_sub_pages``, looked up across all targets.

    Goes before :func:`shred_rules`: filters do not pass the shredder.
    """
    flagged = seeds.filter("only_scrape_sub_pages").select("url").distinct()
    return pages.join(flagged, "url", "left_anti")


def _shredder(rules: list[Rule]) -> dict:
    """What :func:`shred_pages` has to keep: just the attributes the rules look at, and the source only for inner markup."""
    attrs = {r.attr_name for r in rules if r.attr_name}
    for rule in rules:
        for step in rule.steps:
            attrs |= parse_selector(step).attrs
    return {"attrs": sorted(attrs), "keep_html": any(r.remove_tags and not r.collect_text for r in rules)}


def shred_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Shred for the rules."""
    return shred_pages(pages, **_shredder(rules))


def rule_positions(rule: Rule) -> Column:
    """Positions of a rule's matches on the page, in walk order, with multiplicity."""
    return path_positions(F.col("nodes"), list(rule.steps))


def _content(rule: Rule, node: Column) -> Column | None:
    if rule.collect_text:
        return collect_text(node, F.col("chunks"))
    return inner_markup(node, F.col("html")) if rule.remove_tags else None


def _slots(rule: Rule) -> list[tuple[int, str]]:
    """``(slot, output column)``: text or markup first, an attribute value and registered functions in addition."""
    slots = [(0, rule.name)] if rule.wants_content else []
    if rule.attr_name:
        slots.append((1, f"{rule.name} {rule.attr_name}" if rule.wants_content else rule.name))
    return slots + [(2 + k, f"{rule.name} {function}") for k, function in enumerate(rule.functions)]


def _value(rule: Rule, slot: int, node: Column) -> Column:
    if slot > 1:
        return registered_value(rule.functions[slot - 2], node, F.col("chunks"))
    return _content(rule, node) if slot == 0 else collect_attr(node, rule.attr_name)


def _placed(shredded: DataFrame, rules: list[Rule]) -> DataFrame:
    """Positions of every rule's matches in columns of their own, so that all slots of a rule share one walk."""
    none = F.array().cast("array<int>")
    return shredded.select("*", *[F.when(F.size("nodes") > 0, rule_positions(r)).otherwise(none).alias(f"_at{r.element_id}")
                                  for r in rules if _slots(r)])


def _slot_values(rule: Rule, slot: int, at: str) -> Column:
    """Values at the positions in the column ``at``."""
    nodes = F.col("nodes")
    return F.transform(at, lambda i: _value(rule, slot, F.get(nodes, i)))


def select_rules(shredded: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(keys, element_id, match_ord, pre)``: matches of every rule."""
    def matches(rule: Rule) -> Column:
        return F.transform(rule_positions(rule), lambda pre, k: F.struct(
            F.lit(rule.element_id).alias("element_id"), (k + 1).alias("match_ord"), pre.alias("pre")))

    per_rule = [matches(r) for r in rules]
    return shredded.select(*page_keys(shredded), F.inline(F.flatten(F.array(*per_rule))))


def apply_rules(shredded: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(keys, element_id, name, match_ord, slot, value)``: one row per extracted value.

    A rule without parsing options yields no values.
    """
    def cells(rule: Rule) -> Column:
        def of(pre: Column, k: Column) -> Column:
            return F.array(*[F.struct(
                F.lit(rule.element_id).alias("element_id"), F.lit(name).alias("name"), (k + 1).alias("match_ord"),
                F.lit(slot).alias("slot"), _value(rule, slot, F.get(F.col("nodes"), pre)).alias("value"))
                for slot, name in _slots(rule)])

        return F.flatten(F.transform(rule_positions(rule), of))

    per_rule = [cells(r) for r in rules if _slots(r)]
    keys = page_keys(shredded)
    if not per_rule:
        raise ValueError("no rule collects anything")
    return shredded.select(*keys, F.inline(F.flatten(F.array(*per_rule))))


def output_columns(rules: list[Rule]) -> list[str]:
    """Column names of the wide table, in data order; equal names share a column."""
    return list(dict.fromkeys(name for r in sorted(rules, key=lambda r: r.ordinal) for _, name in _slots(r)))


def _columns(rules: list[Rule], place: Callable[[Rule], str] = lambda r: f"_at{r.element_id}") -> dict[str, Column]:
    """Value arrays by output column, in data order; ``place`` names the column of a rule's positions."""
    columns: dict[str, list[Column]] = {}
    for r in sorted(rules, key=lambda r: (r.ordinal, r.element_id)):
        for slot, name in _slots(r):
            columns.setdefault(name, []).append(_slot_values(r, slot, place(r)))
    if not columns:
        raise ValueError("no rule collects anything")
    return {k: v[0] if len(v) == 1 else F.concat(*v) for k, v in columns.items()}


def extract_table(shredded: DataFrame, rules: list[Rule]) -> DataFrame:
    """The wide table ``(keys, row_ord, <one column per element>)``.

    Row k of a page holds the k-th match of every element, null where an element has fewer. The
    columns are zipped inside the page's row: no pivot, no shuffle.
    """
    return zip_columns(_placed(shredded, rules), page_keys(shredded), _columns(rules))


def without_matches(rules: list[Rule]) -> Column | None:
    """Whether a page's source alone rules out every match: it shows all its tags as they are and lacks some text
    of each rule. None if some rule requires no text."""
    may = []
    for rule in rules:
        texts = set().union(*[required_texts(s) for s in rule.steps]) if rule.steps else set()
        if _slots(rule) and not texts:
            return None
        if _slots(rule):
            may.append(reduce(Column.__and__, [F.contains("html", F.lit(t)) for t in sorted(texts)]))
    return ~reduce(Column.__or__, may) & plain_source(F.col("html")) if may else None


def linked_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Shred ``(url, keys, html)`` for the rules and add ``targets``, in one pass. Pages on which no rule can match have
    no nodes: their links come from the source."""
    quiet = without_matches(rules)
    listed = F.lit(None).cast("array<string>") if quiet is None else F.when(quiet, plain_hrefs(F.col("html")))
    read = pages.withColumn("hrefs", listed)
    shredded = shred_pages(read.withColumn("html", F.when(F.col("hrefs").isNull(), F.col("html"))), **_shredder(rules), skipped=CLICK_HREFS)
    return shredded.withColumn("targets", scanned_targets()).drop("hrefs")


def pages_and_links(pages: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """``(url, keys, targets, rows)``: links and wide rows (see ``reshape.zipped_rows``) of a page from one parse."""
    linked = linked_pages(pages.select("url", *keys, "html"), rules)
    return zip_arrays(_placed(linked, rules), ["url", *keys, "targets"], list(_columns(rules).values()), "rows")


def step_positions(shredded: DataFrame, guards: dict[tuple[str, ...], Column]) -> tuple[DataFrame, dict[tuple[str, ...], str]]:
    """Positions of many search hierarchies at once, each shared beginning walked once per page.

    ``guards`` maps every hierarchy, beginnings included, to a condition on the page's row under which it is wanted;
    elsewhere there are no positions. Returns the frame with a column per hierarchy, and their names.
    """
    names = {path: f"_steps{i}" for i, path in enumerate(guards)}
    out, nodes = shredded, F.col("nodes")
    for depth in range(1, max(map(len, guards), default=0) + 1):
        found = {p: css_positions(nodes, p[0]) if depth == 1 else positions_inside(nodes, F.col(names[p[:-1]]), p[-1])
                 for p in guards if len(p) == depth}
        none = F.array().cast("array<int>")
        out = out.select("*", *[F.when(guards[p], c).otherwise(none).alias(names[p]) for p, c in found.items()])
    return out, names


def pages_for_sets(pages: DataFrame, sets: dict[int, list[Rule]], *keys: str) -> DataFrame:
    """``(url, keys, targets, found)``: links and rows of a page for many sets of rules from one parse.

    ``pages`` has ``sets``, the numbers of the sets that may want the page. ``found`` lists
    ``(set_no, rows)``; a row is its values as text in the order of :func:`output_columns`.
    """
    rules = [r for own in sets.values() for r in own]
    wanted: dict[tuple[str, ...], list[int]] = {}
    for number, own in sets.items():
        for r in own:
            for k in range(1, len(r.steps) + 1) if _slots(r) else ():
                wanted.setdefault(r.steps[:k], []).append(number)
    guards = {p: (F.size("nodes") > 0) & F.arrays_overlap("sets", F.array(*[F.lit(n) for n in dict.fromkeys(numbers)]))
              for p, numbers in wanted.items()}

    def listed(rows: dict[int, Column]) -> Column:
        found = [F.when(F.array_contains("sets", number), F.struct(F.lit(number).alias("set_no"), r.alias("rows")))
                 for number, r in rows.items()]
        return F.filter(F.array(*found), lambda f: f.isNotNull())

    placed, names = step_positions(linked_pages(pages.select("url", *keys, "sets", "html"), rules), guards)
    rows = {}
    for number, own in sets.items():
        columns = list(_columns(own, lambda r: names[r.steps]).values())
        rows[number] = let(F.array(*columns), lambda lists: F.transform(
            span(F.lit(0), F.array_max(F.transform(lists, F.size)) - 1), lambda i: F.transform(lists, lambda c: F.get(c, i))))
    return placed.select("url", *keys, "targets", listed(rows).alias("found"))


def extract_lines(shredded: DataFrame, rules: list[Rule], delimiter: str = ",") -> DataFrame:
    """The horizontal layout per page: ``(keys, ordinal, name, line)``, values of an element across."""
    lines = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("name"), F.array_join(
        F.transform(values, lambda v: csv_field(v, delimiter)), delimiter).alias("line"))
        for i, (name, values) in enumerate(_columns(rules).items())]
    return _placed(shredded, rules).select(*page_keys(shredded), F.inline(F.array(*lines)))


def element_lists(shredded: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(keys, name, values)``: one row per page and element, its values as a list in walk order."""
    lists = [F.struct(F.lit(name).alias("name"), values.alias("values")) for name, values in _columns(rules).items()]
    return _placed(shredded, rules).select(*page_keys(shredded), F.inline(F.array(*lists)))


def extract_strided(shredded: DataFrame, rules: list[Rule], width: int | None = None) -> DataFrame:
    """The literal positional assembly per page: value i goes to column i mod n; the last
    incomplete row is dropped."""
    def values(rule: Rule) -> Column:
        return F.flatten(F.transform(rule_positions(rule), lambda pre: F.array(*[
            _value(rule, slot, F.get(F.col("nodes"), pre)) for slot, _ in _slots(rule)])))

    ordered = [values(r) for r in sorted(rules, key=lambda r: (r.ordinal, r.element_id)) if _slots(r)]
    names = output_columns(rules)
    return strided_rows(shredded, page_keys(shredded), F.concat(*ordered), width or len(names),
                        names if width is None else None)


def extract_pages(pages: DataFrame, rules: list[Rule], seeds: DataFrame | None = None) -> DataFrame:
    """Pages to wide table in one go."""
    if seeds is not None:
        pages = drop_seed_pages(pages, seeds)
    return extract_table(shred_rules(pages, rules), rules)
