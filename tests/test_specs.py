"""Rule compilation, seeds, settings and column order."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.sources import specs as J


def specs(spark, *docs):
    return J.parse_specs(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "spec_id int, spec string"))


def rules(spark, *elements, **rest):
    return J.load_rules(J.spec_rules(specs(spark, {"elements": list(elements), **rest})))


def attributes(spark, *attrs):
    row = specs(spark, {"elements": [{"attributes": list(attrs)}]}).select(
        J.collect_attributes(F.col("elements")[0]["attributes"]).alias("a"),
        J.attribute_selectors(F.col("elements")[0]["attributes"]).alias("s")).first()
    return {x.name: x.value for x in row.a}, row.s


def cls(value):
    return {"name": "class", "value": value}


def test_attributes_of_one_name_are_merged(spark):
    want = {"class": "cost net", "lang": "de"}, [".cost.net", "[lang=de]"]
    lang = {"name": "lang", "value": "de"}
    assert attributes(spark, cls("cost"), cls("net"), lang) == want
    assert attributes(spark, cls("cost net"), lang) == want
    assert attributes(spark, {"name": "class", "value": ["cost", "net"]}, lang) == want
    assert attributes(spark, {"css_selector": "p.foot"}) == ({"css_selector": "p.foot"}, ["p.foot"])


def test_hierarchies(spark):
    given = [cls("key wide"), {"name": "id", "value": "go"}, {"name": "data-kind", "value": "act"}]
    mixed = [given[0], {"css_selector": "#go"}, given[2]]
    got = rules(spark, {"search_hierarchy": [cls("wing"), cls("shelf low"), cls("slot")]},
                {"search_hierarchy": given}, {"search_hierarchy": mixed})
    assert [list(r.steps) for r in got] == [
        [".wing", ".shelf.low", ".slot"], [".key.wide", "[id=go]", "[data-kind=act]"],
        [".key.wide", "#go", "[data-kind=act]"]]


def test_choice_names_and_options(spark):
    got = rules(
        spark,
        {"css_selector": ".h3, h3", "data_parsing": {"collect_text": True, "remove_tags": True}},
        {"name": "N", "tag": "p", "attributes": [cls("a b"), {"name": "x", "value": 'q"]'}], "css_selector": "i",
         "data_parsing": {"collect_attr_value": {"attr_name": "HREF"}}},
        {"name": "M", "css_selector": "b", "search_hierarchy": [cls("c")]},
        data_order=["M"])
    assert [(r.element_id, r.name, r.steps, r.collect_text, r.remove_tags, r.attr_name, r.ordinal) for r in got] == [
        (2, "M", (".c",), False, False, None, 0),
        (0, "element 0", (".h3, h3",), True, True, None, 1),
        (1, "N", ("p.a.b[x='q\"]']",), False, False, "href", 2)]


@pytest.mark.parametrize("spec, text", [
    ({"elements": [{"name": "x"}]}, "without selector"),
    ({"elements": [{"search_hierarchy": [cls("a")], "attributes": [cls("b")]}]}, "not both"),
    ({"elements": [{"attributes": [{"name": "class"}]}]}, "without name or value"),
    ({"elements": [{"name": "x", "css_selector": "a"}], "data_order": ["y"]}, "unknown name"),
])
def test_bad_specs_are_errors(spark, spec, text):
    with pytest.raises(Exception, match=text):
        J.load_rules(J.spec_rules(specs(spark, spec)))


def test_seeds(spark):
    doc = {"target_urls": [
        {"url": "HTTPS://A.com/X"}, {"url": ""}, {"options": {}},
        {"url": "https://b.com/", "options": {"only_scrape_sub_pages": False}, "crawler": {"crawl_delay": 0.5, "odd": 1}},
        {"url": "https://c.com/", "crawler": {"allowed_domains": ["c.com", "d.com"], "max_depth": 1, "user_agent": "me",
                                              "url_patterns": ["x"], "ignore_robots_txt": True}}]}
    got = [tuple(r)[1:] for r in J.spec_seeds(specs(spark, doc)).orderBy("seed_id").collect()]
    assert got == [
        (0, "https://a.com/X", True, False, ["a.com"], None, 6, 1.0, False, "*"),
        (1, "https://b.com/", False, False, [], None, 6, 0.5, False, "*"),
        (2, "https://c.com/", True, False, ["c.com", "d.com"], ["x"], 1, 1.0, True, "me")]
    with pytest.raises(Exception, match="no valid URLs"):
        J.spec_seeds(specs(spark, {"target_urls": [{"url": ""}]})).collect()
    assert J.spec_seeds(specs(spark, {"target_urls": [{"url": ""}]}), strict=False).count() == 0
    assert J.option_warnings(specs(spark, doc)).count() == 9


def test_order_keeps_first_mention_and_appends_the_rest(spark):
    doc = {"elements": [{"name": n, "css_selector": "a"} for n in "xyz"], "data_order": ["z", "x", "z"]}
    assert [r.name for r in J.spec_order(specs(spark, doc)).orderBy("ordinal").collect()] == ["z", "x", "y"]


def test_spec_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"target_urls": [{"url": "https://a.com"}], "page_navigator": {"x": 1}}, indent=2))
    assert J.spec_seeds(J.read_spec(spark, str(tmp_path / "a.json"))).count() == 1
    (tmp_path / "b.json").write_text("{not json")
    with pytest.raises(Exception):
        J.read_spec(spark, str(tmp_path / "b.json")).collect()
    with pytest.raises(Exception):
        J.read_spec(spark, str(tmp_path / "none.json")).collect()
