"""Job specifications as tables: seeds, crawl settings, extraction rules, column order.

A spec is one JSON document. All steps are column expressions inside the spec's row, so a table
of many specs is compiled in parallel without a shuffle. ``spec_id`` identifies the document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.urls import normalize_url, url_domain
from ..functions.values import VALUE_FUNCTIONS

SPEC_SCHEMA = """
target_urls ARRAY<STRUCT<url: STRING,
    options: STRUCT<only_scrape_sub_pages: BOOLEAN, render_pages: BOOLEAN>,
    crawler: STRUCT<allowed_domains: ARRAY<STRING>, url_patterns: ARRAY<STRING>, max_depth: INT,
                    crawl_delay: DOUBLE, ignore_robots_txt: BOOLEAN, user_agent: STRING>>>,
elements ARRAY<STRUCT<name: STRING, css_selector: STRING, tag: STRING,
    attributes: ARRAY<STRUCT<name: STRING, value: STRING, css_selector: STRING>>,
    search_hierarchy: ARRAY<STRUCT<name: STRING, value: STRING, css_selector: STRING>>,
    data_parsing: STRUCT<collect_text: BOOLEAN, remove_tags: BOOLEAN,
                         collect_attr_value: STRUCT<attr_name: STRING>, value_functions: ARRAY<STRING>>>>,
data_saving MAP<STRING, MAP<STRING, STRING>>,
data_order ARRAY<STRING>
"""

# The documented defaults.
DEFAULT_OPTIONS = {"only_scrape_sub_pages": True, "render_pages": False}
DEFAULT_CRAWLER = {"max_depth": 6, "crawl_delay": 1.0, "ignore_robots_txt": False, "user_agent": "*"}



def read_spec(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Spec files, one JSON document each or (``lines``) per line; missing files and broken JSON are errors."""
    return (spark.read.schema(SPEC_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
            .select(F.col("_metadata.file_path").alias("spec_id"), "*"))


def parse_specs(docs: DataFrame, json_col: str = "spec") -> DataFrame:
    """Specs from a text column; the other columns (``spec_id`` among them) stay."""
    keep = [c for c in docs.columns if c != json_col]
    doc = F.from_json(F.col(json_col), SPEC_SCHEMA, {"mode": "FAILFAST"})
    return docs.select(*keep, doc.alias("doc")).select(*keep, "doc.*")


def spec_seeds(specs: DataFrame, strict: bool = True) -> DataFrame:
    """One row per target URL with options and crawl settings, defaults filled in.

    Without a ``crawler`` block the seed's own domain is allowed; a block that names no domains
    allows none. With ``strict`` a spec without any URL is an error.
    """
    targets = F.filter(F.coalesce(F.col("target_urls"), F.array()), lambda t: F.coalesce(t["url"], F.lit("")) != "")
    if strict:
        targets = let(targets, lambda t: F.when(F.size(t) == 0, F.raise_error(
            F.concat(F.lit("no valid URLs in spec "), F.col("spec_id").cast("string")))).otherwise(t))
    c = F.col("t.crawler")
    return specs.select("spec_id", F.posexplode(targets).alias("seed_id", "t")).select(
        "spec_id",
        "seed_id",
        normalize_url(F.col("t.url")).alias("url"),
        *[F.coalesce(F.col(f"t.options.{k}"), F.lit(v)).alias(k) for k, v in DEFAULT_OPTIONS.items()],
        F.when(c.isNull(), F.array(url_domain(normalize_url(F.col("t.url")))))
        .otherwise(F.coalesce(c["allowed_domains"], F.array().cast("array<string>"))).alias("allowed_domains"),
        c["url_patterns"].alias("url_patterns"),
        *[F.coalesce(c[k], F.lit(v)).alias(k) for k, v in DEFAULT_CRAWLER.items()],
    )


def one_spec(spark: SparkSession, path: str) -> DataFrame:
    """The spec a job runs on; no spec or several ones are an error."""
    spec = read_spec(spark, path)
    if len(spec.select("spec_id").take(2)) != 1:
        raise ValueError(f"a job has exactly one spec: {path}")
    return spec


def saving_options(spec: DataFrame) -> dict[str, dict[str, str]]:
    """Options by sink name of one spec, whatever the sinks are called; values are texts."""
    entries = spec.select(F.map_entries("data_saving")).first()[0] or []      # in the order of the spec
    return {sink: dict(options) for sink, options in entries if options is not None}


def saving_by_spec(specs: DataFrame) -> dict[str, dict[str, dict[str, str]]]:
    """:func:`saving_options` of every spec, by the text of its id; ids must differ."""
    rows = specs.select(F.col("spec_id").cast("string"), F.map_entries("data_saving").alias("saving")).collect()
    if len({r["spec_id"] for r in rows}) != len(rows):
        raise ValueError("spec ids must differ")
    return {r["spec_id"]: {sink: dict(o) for sink, o in r["saving"] or [] if o is not None} for r in rows}


def option_warnings(specs: DataFrame) -> DataFrame:
    """One row per option that a target leaves out, with the default used instead."""
    missing = F.filter(
        F.array(*[F.struct(F.lit(k).alias("option"), F.lit(v).alias("default_value"),
                           F.col(f"t.options.{k}").isNull().alias("missing")) for k, v in DEFAULT_OPTIONS.items()]),
        lambda o: o["missing"])
    return (specs.select("spec_id", F.posexplode("target_urls").alias("target", "t"))
            .select("spec_id", "target", F.col("t.url").alias("url"), F.inline(missing))
            .drop("missing"))


# Rules -------------------------------------------------------------------------------------


def _value_text(value: Column) -> Column:
    """A list of values arrives as its JSON text; all of its tokens are wanted."""
    listed = F.from_json(value, "array<string>")
    return F.when(F.startswith(value, F.lit("[")), F.coalesce(F.array_join(listed, " "), value)).otherwise(value)


def collect_attributes(attributes: Column) -> Column:
    """Attribute list -> ``array(struct(name, value))``, values of one name joined by blanks.

    An entry without name or value must bring a ``css_selector``, which passes through.
    """
    def entry(a: Column) -> Column:
        usable = (F.coalesce(a["name"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != "")
        css = F.coalesce(a["css_selector"], F.lit("")) != ""
        bad = F.raise_error(F.concat(F.lit("attribute without name or value: "), F.to_json(a)))
        return F.struct(
            F.when(usable, a["name"]).when(css, F.lit("css_selector")).otherwise(bad).alias("name"),
            F.when(usable, _value_text(a["value"])).when(css, a["css_selector"]).otherwise(bad).alias("value"))

    def merge(entries: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(entries, lambda e: e["name"])),
            lambda n: F.struct(n.alias("name"), F.array_join(F.transform(
                F.filter(entries, lambda e: e["name"] == n), lambda e: e["value"]), " ").alias("value")))

    return let(F.transform(F.coalesce(attributes, F.array()), entry), merge)


def selector_of(attr: Column, quoted: bool = False) -> Column:
    """``.a.b`` for class tokens, ``[name=value]`` for other attributes, css as it is."""
    tokens = F.filter(F.split(attr["value"], r"(?U)\s+"), lambda x: x != "")
    mark = F.when(F.contains(attr["value"], F.lit('"')), F.lit("'")).otherwise(F.lit('"'))
    needs = F.lit(True) if quoted else attr["value"].rlike(r"""["'\]]""")
    q = F.when(needs, mark).otherwise(F.lit(""))
    return (F.when(attr["name"] == "css_selector", attr["value"])
            .when(attr["name"] == "class", F.concat(F.lit("."), F.array_join(tokens, ".")))
            .otherwise(F.concat(F.lit("["), attr["name"], F.lit("="), q, attr["value"], q, F.lit("]"))))


def attribute_selectors(attributes: Column) -> Column:
    """Merged attributes as a list of selectors."""
    return F.transform(collect_attributes(attributes), lambda a: selector_of(a))


def hierarchy_steps(hierarchy: Column) -> Column:
    """Search hierarchy -> list of steps, each entry compiled on its own."""
    return F.flatten(F.transform(F.coalesce(hierarchy, F.array()), lambda h: attribute_selectors(F.array(h))))


def _conjunction(tag: Column, attributes: Column) -> Column:
    """Tag and all attributes on one node, as a single selector."""
    def one(merged: Column) -> Column:
        css = F.filter(merged, lambda a: a["name"] == "css_selector")
        rest = F.filter(merged, lambda a: a["name"] != "css_selector")
        start = F.when(F.size(css) > 0, F.array_join(F.transform(css, lambda a: a["value"]), "")).otherwise(
            F.coalesce(tag, F.lit("")))
        return F.concat(start, F.array_join(F.transform(rest, lambda a: selector_of(a, quoted=True)), ""))

    return let(collect_attributes(attributes), one)


def data_order(order: Column, names: Column) -> Column:
    """Column order: listed names once each, then the others in spec order; unknown names are errors."""
    listed = F.coalesce(order, F.array().cast("array<string>"))
    unknown = F.array_except(listed, names)
    full = F.array_distinct(F.concat(listed, F.array_except(names, listed)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(
        F.lit("unknown name in data_order: "), F.array_join(unknown, ", ")))).otherwise(full)


def element_names(elements: Column) -> Column:
    return F.transform(F.coalesce(elements, F.array()), lambda e, i: F.when(
        F.coalesce(e["name"], F.lit("")) == "", F.concat(F.lit("element "), i.cast("string"))).otherwise(e["name"]))


def spec_order(specs: DataFrame) -> DataFrame:
    """``(spec_id, ordinal, name)``: the output columns of each spec."""
    order = data_order(F.col("data_order"), element_names(F.col("elements")))
    return specs.select("spec_id", F.posexplode(order).alias("ordinal", "name"))


def spec_rules(specs: DataFrame) -> DataFrame:
    """Compiled extraction rules, one row per element.

    Choice of selector: search hierarchy, else attributes (with the tag), else ``css_selector``;
    a hierarchy next to attributes, or none of the three, is an error.
    """
    e = F.col("e")
    names = element_names(F.col("elements"))
    has_path = F.size(F.coalesce(e["search_hierarchy"], F.array())) > 0
    has_attrs = F.size(F.coalesce(e["attributes"], F.array())) > 0
    has_css = F.coalesce(e["css_selector"], F.lit("")) != ""

    def bad(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text + ": "), F.to_json(e)))

    steps = (F.when(has_path & has_attrs, bad("an element takes a search hierarchy or attributes, not both"))
             .when(has_path, hierarchy_steps(e["search_hierarchy"]))
             .when(has_attrs, F.array(_conjunction(e["tag"], e["attributes"])))
             .when(has_css, F.array(e["css_selector"]))
             .otherwise(bad("element without selector")))
    parsing = e["data_parsing"]
    return (
        specs.select("spec_id", names.alias("names"), data_order(F.col("data_order"), names).alias("order"),
                     F.posexplode("elements").alias("element_id", "e"))
        .select(
            "spec_id",
            "element_id",
            F.get("names", F.col("element_id")).alias("name"),
            F.when(has_path, "hierarchy").when(has_attrs, "attributes").otherwise("css").alias("kind"),
            steps.alias("steps"),
            F.coalesce(parsing["collect_text"], F.lit(False)).alias("collect_text"),
            F.coalesce(parsing["remove_tags"], F.lit(False)).alias("remove_tags"),
            parsing["collect_attr_value"].isNotNull().alias("wants_attr"),
            F.when(parsing["collect_attr_value"]["attr_name"] != "",
                   F.lower(parsing["collect_attr_value"]["attr_name"])).alias("attr_name"),
            F.array_distinct(F.coalesce(parsing["value_functions"], F.array().cast("array<string>"))).alias("functions"),
            (F.array_position("order", F.get("names", F.col("element_id"))) - 1).cast("int").alias("ordinal"),
        )
    )


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rules that ask for an attribute value without naming the attribute."""
    return rules.filter(F.col("wants_attr") & F.col("attr_name").isNull()).select("spec_id", "element_id", "name")


@dataclass(frozen=True)
class Rule:
    """One extraction rule on the driver, ready to become column expressions."""

    element_id: int
    name: str
    steps: tuple[str, ...]
    collect_text: bool = False
    remove_tags: bool = False
    attr_name: str | None = None
    ordinal: int = field(default=0, compare=False)
    functions: tuple[str, ...] = ()        # registered value functions, see ``values.register_value``

    @property
    def wants_content(self) -> bool:
        return self.collect_text or self.remove_tags


def _as_rule(r: Row) -> Rule:
    return Rule(r.element_id, r.name, tuple(r.steps), r.collect_text, r.remove_tags, r.attr_name, r.ordinal, tuple(r.functions))


def _check_functions(rows: list[Row]) -> None:
    unknown = {f for r in rows for f in r.functions} - set(VALUE_FUNCTIONS)
    if unknown:
        raise ValueError(f"value functions that are not registered: {', '.join(sorted(unknown))}")


def load_rules(rules: DataFrame) -> list[Rule]:
    """The rules of one spec in output order: a document that someone wrote, which the driver
    compiles into a plan. A value function that is not registered is an error."""
    rows = rules.orderBy("ordinal", "element_id").collect()
    _check_functions(rows)
    return [_as_rule(r) for r in rows]


def load_rule_sets(rules: DataFrame) -> tuple[dict[int, list[Rule]], dict[str, int]]:
    """The rules of many specs: the different sets of rules by number, and the number for the text of each spec id."""
    rows = rules.orderBy("spec_id", "ordinal", "element_id").collect()
    _check_functions(rows)
    by_spec: dict[str, list[Rule]] = {}
    for r in rows:
        by_spec.setdefault(str(r.spec_id), []).append(_as_rule(r))
    numbers: dict[tuple, int] = {}
    set_of = {s: numbers.setdefault(tuple((r, r.ordinal) for r in own), len(numbers)) for s, own in by_spec.items()}
    return {n: [r for r, _ in key] for key, n in numbers.items()}, set_of
