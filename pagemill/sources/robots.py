"""robots.txt bodies as a table of rule groups, and the decisions taken from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let, span
from ..functions.urls import canonical_rule_path, robots_path, unquote, url_domain
from ..functions.values import strip
from ..operators.lookup import spread_lookup

# Field names and the letters used for them while grouping lines.
FIELDS = {"user-agent": "U", "allow": "A", "disallow": "D", "crawl-delay": "C", "request-rate": "R"}
DENIED_STATUS = (401, 403)

_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def read_robots(files: DataFrame) -> DataFrame:
    """``(host, body, status?)`` -> ``(host, groups, denied)``, one row per host.

    A group is a run of user-agent lines with the rules after it, up to a blank line or the next
    run. Everything happens inside the row, bounded by one robots file. Of several files for a host
    the greatest counts, so that a join by host never multiplies rows.
    """
    extra = ["status"] if "status" in files.columns else []
    files = files.groupBy("host").agg(F.max(F.struct("body", *extra)).alias("f")).select("host", "f.*")

    def token(line: Column) -> Column:
        text = strip(F.substring_index(line, "#", 1))
        key = F.lower(strip(F.substring_index(text, ":", 1)))
        kind = F.when(line == "", F.lit("B"))
        for name, letter in FIELDS.items():
            kind = kind.when(F.contains(text, F.lit(":")) & (key == name), F.lit(letter))
        value = unquote(strip(F.regexp_replace(text, r"^[^:]*:", "")))
        return F.struct(kind.alias("kind"), value.alias("value"))

    def segments(tokens: Column) -> Column:
        def kind(i: Column) -> Column:
            return F.get(tokens, i)["kind"]

        starts = F.filter(span(F.lit(0), F.size(tokens) - 1), lambda i: (kind(i) == "B") | (
            (kind(i) == "U") & ((i == 0) | (F.coalesce(kind(i - 1), F.lit("B")) != "U"))))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(
            tokens, at + 1, F.coalesce(F.get(s, k + 1), F.size(tokens)) - at)))

    def rule(t: Column) -> Column:
        return F.struct(((t["kind"] == "A") | (t["value"] == "")).alias("allow"),
                        canonical_rule_path(t["value"]).alias("path"))

    def group(seg: Column) -> Column:
        delays = F.filter(seg, lambda t: (t["kind"] == "C") & t["value"].rlike(r"^[0-9]+$"))
        return F.struct(
            F.transform(F.filter(seg, lambda t: t["kind"] == "U"), lambda t: t["value"]).alias("agents"),
            F.transform(F.filter(seg, lambda t: t["kind"].isin("A", "D")), rule).alias("rules"),
            F.when(F.size(delays) > 0, F.get(delays, F.size(delays) - 1)["value"].cast("double")).alias("delay"))

    tokens = F.filter(F.transform(F.split("body", _LINE_BREAK, -1), token), lambda t: t["kind"].isNotNull())
    live = F.filter(let(tokens, segments), lambda s: (F.get(s, F.lit(0))["kind"] == "U") & F.exists(
        s, lambda t: t["kind"].isin("A", "D", "C", "R")))
    denied = F.col("status").isin(*DENIED_STATUS) if "status" in files.columns else F.lit(False)
    return files.select("host", F.coalesce(F.transform(live, group), F.array()).alias("groups"),
                        F.coalesce(denied, F.lit(False)).alias("denied"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """Flat view: ``(host, grp, agents, delay, seq, allow, path)``."""
    return (robots.select("host", F.posexplode("groups").alias("grp", "g"))
            .select("host", "grp", F.array_join("g.agents", ",").alias("agents"), F.col("g.delay").alias("delay"),
                    F.posexplode_outer("g.rules").alias("seq", "r"))
            .select("host", "grp", "agents", "delay", "seq", "r.allow", "r.path"))


def agent_group(groups: Column, agent: Column | str) -> Column:
    """The group that applies to a user agent: first named match, else the first ``*`` group."""
    name = F.lower(F.substring_index(F.lit(agent) if isinstance(agent, str) else agent, "/", 1))
    named = F.filter(groups, lambda g: ~F.array_contains(g["agents"], "*") & F.exists(
        g["agents"], lambda a: F.contains(name, F.lower(a))))
    default = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    return F.get(F.concat(named, default), F.lit(0))


def rules_allow(url: Column, rules: Column) -> Column:
    """First rule in file order whose path is a prefix decides; no rule allows."""
    return F.when(F.coalesce(F.size(rules), F.lit(0)) <= 0, F.lit(True)).otherwise(let(
        robots_path(url), lambda p: F.coalesce(F.get(F.filter(
            rules, lambda r: F.startswith(p, r["path"])), F.lit(0))["allow"], F.lit(True))))


def with_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Add ``robots_ok`` and ``robots_delay`` by host.

    One robots row at most meets each URL, and a host with a large share of all URLs is spread.
    """
    chosen = robots.select("host", agent_group(F.col("groups"), agent).alias("_g"), "denied")
    return (spread_lookup(urls.withColumn("host", url_domain(F.col("url"))), chosen, "host", "url")
            .withColumn("robots_ok", ~F.coalesce(F.col("denied"), F.lit(False))
                        & rules_allow(F.col("url"), F.col("_g.rules")))
            .withColumn("robots_delay", F.col("_g.delay"))
            .drop("host", "_g", "denied"))


def filter_robots(urls: DataFrame, robots: DataFrame, agent: str = "*", ignore: bool = False) -> DataFrame:
    """URLs that the rules of their own host allow."""
    if ignore:
        return urls
    return with_robots(urls, robots, agent).filter("robots_ok").drop("robots_ok", "robots_delay")


def rule_table(robots: DataFrame, agent: str = "*") -> tuple[DataFrame, DataFrame]:
    """The rules for one agent as relations, for files with very many of them.

    Returns ``(rules, hosts)``: ``(host, path, allow, seq)`` with the first rule of every path, and
    ``(host, lengths, denied, delay)`` with the distinct lengths of a host's rule paths.
    """
    chosen = robots.select("host", agent_group(F.col("groups"), agent).alias("g"), "denied")
    flat = chosen.select("host", F.posexplode("g.rules").alias("seq", "r")).select("host", "seq", "r.allow", "r.path")
    rules = flat.groupBy("host", "path").agg(F.min_by("allow", "seq").alias("allow"), F.min("seq").alias("seq"))
    lengths = F.array_distinct(F.transform(F.coalesce("g.rules", F.array()), lambda r: F.length(r["path"])))
    return rules, chosen.select("host", lengths.alias("lengths"), "denied", F.col("g.delay").alias("delay"))


def with_rule_table(urls: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """What :func:`with_robots` adds, from the stored relations of :func:`rule_table`.

    The beginnings of a URL's path, of the lengths that its host's rules have, meet the rules in an
    equi-join; of the rules met the first one decides. A URL costs one row per length, however many
    rules its host has. Hosts with many URLs and rules that fit many of them are spread; the relations
    are shuffled and never broadcast, as a small file may hold very many rules.
    """
    hosted = urls.select("url").distinct().withColumn("host", url_domain(F.col("url")))
    known = spread_lookup(hosted, hosts.select("host", "lengths"), "host", "url", 8, large=True).filter(F.size("lengths") > 0)
    path = known.withColumn("path", robots_path(F.col("url")))
    begun = path.select("url", F.col("host"), F.explode(F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    keyed = rules.select(F.struct("host", "path").alias("begin"), "allow", "seq")
    met = spread_lookup(begun.select("url", F.struct("host", "path").alias("begin")), keyed, "begin", "url", 8, large=True)
    first = met.filter(F.col("seq").isNotNull()).groupBy("url").agg(F.min_by("allow", "seq").alias("_allow"))
    of_host = hosts.select("host", "denied", F.col("delay").alias("_delay"))
    return (spread_lookup(urls.join(first, "url", "left").withColumn("host", url_domain(F.col("url"))), of_host, "host", "url", 8, large=True)
            .withColumn("robots_ok", ~F.coalesce(F.col("denied"), F.lit(False)) & F.coalesce(F.col("_allow"), F.lit(True)))
            .select(*urls.columns, "robots_ok", F.col("_delay").alias("robots_delay")))
