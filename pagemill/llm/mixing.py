"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..storage import Workspace
from .common import boxed, row_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Points of the schedule: i * STEP mod MODULUS, with STEP / MODULUS next to the golden ratio's fraction.
MODULUS, STEP = 1 << 31, 1327217885
BINS, RUN = 1024, 1 << 16


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = 3) -> DataFrame:
    """One row per source: ``(source, sid, source_size, weight, target)``.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes. A
    target stops at ``repeat`` times its source's size and the excess is shared by weight again:
    in order of ``cap / weight`` the stopped sources come first, so running sums settle it at once.
    One row per source is left here; the windows run over those only.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    each = total.select("source", "source_size", (F.row_number().over(order) - 1).cast("long").alias("sid"),
                        turn.cast("double").alias("weight"),
                        (F.col("source_size") * repeat).cast("double").alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    ranked = each.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("all"),
        F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("used"),
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("left"))
    share = (F.col("all") - F.col("used")) / F.col("left")
    level = F.max(F.when(share * F.col("weight") <= F.col("cap"), share)).over(everything)
    return ranked.select("source", "sid", "source_size", "weight",
                         F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def with_blocks(targets: DataFrame, block: int, repeat: int) -> DataFrame:
    """Adds the quota in words, whole passes, blocks per pass, and slots that the source needs."""
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * repeat)
    size = F.greatest("source_size", F.lit(1))
    per = F.ceil(size / block).cast("long")
    return (targets.withColumn("quota", quota).withColumn("blocks", per)
            .withColumn("passes", F.floor(F.col("quota") / size).cast("long"))
            .withColumn("rest", F.col("quota") - F.col("passes") * size)
            .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """``(slot, sid, rank, pass, block, limit)``: which block every slot of the mix reads.

    Point ``i`` of the golden-ratio sequence falls into the interval of one source, intervals being
    as wide as the slots the sources need. Points and intervals meet over equal-width bins (an
    equi-join; the sequence fills all bins alike). A slot's rank among those of its source is the
    number in earlier runs of ``RUN`` points plus its place in its own run, so no window spans a
    source. Rank r reads block r of the repeated source; what the sequence leaves short, at most a
    few slots per source, follows at the end.
    """
    spark = plan.sparkSession
    n = plan.agg(F.sum("slots")).first()[0] or 0
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    # Integer bounds on the lattice: interval of sid is [low, high) of MODULUS.
    high = F.floor(F.sum("slots").over(upto) / F.lit(max(n, 1)) * MODULUS).cast("long")
    bounds = plan.select("sid", "slots", "passes", "blocks", "rest", high.alias("high"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0).cast("long")))
    wide = MODULUS // BINS
    binned = bounds.filter("high > low").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))))
    point = F.pmod(F.pmod("i", F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS))
    points = (spark.range(n).select(F.col("id").alias("i")).withColumn("at", point)
              .withColumn("bin", F.floor(F.col("at") / wide)))
    hits = points.join(binned, "bin").filter("at >= low AND at < high").select(
        "i", "sid", F.floor(F.col("i") / RUN).alias("run"))
    runs = hits.groupBy("sid", "run").count().select(
        "sid", "run", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("run").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "count")
    place = F.row_number().over(Window.partitionBy("sid", "run").orderBy("i")) - 1
    ranked = hits.withColumn("place", place).join(runs, ["sid", "run"]).select(
        F.col("i").alias("slot"), "sid", (F.col("before") + F.col("place")).alias("rank"))
    drawn = runs.groupBy("sid").agg(F.sum("count").alias("drawn"))
    short = (bounds.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
             .filter("drawn < slots")
             .withColumn("rank", F.explode(F.sequence("drawn", F.col("slots") - 1)))
             .select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank"))
    own = F.col("rank") % F.col("blocks")
    turn = F.floor(F.col("rank") / F.col("blocks"))
    return (ranked.union(short).join(bounds.select("sid", "slots", "passes", "blocks", "rest"), "sid")
            .filter("rank < slots")
            .select("slot", "sid", "rank", turn.alias("pass"), own.alias("block"),
                    F.when(turn < F.col("passes"), F.lit(block))
                    .otherwise(F.least(F.lit(block), F.col("rest") - own * block)).cast("long").alias("limit")))


class Mix:
    """A mix of ``docs``; its tables are written once and may be read in any order.

    ``documents``: (sid, off, doc_id, k1, k2, source, size, source_size, target), one row per
    document at its place in its source's shuffled stream of words. ``slots``: the schedule.
    ``takes``: (slot, sid, off, pass, first, words), the part of a document that a slot reads.

    Sizes count words; null and empty texts have none and are never taken. Documents are shuffled
    inside their source by a hash of id and text, so reruns agree and repeated rows, which get
    their own places, are interchangeable. A null source is a source. A null id is allowed. An
    empty table gives empty tables. Hot sources are range-partitioned, never gathered.
    """

    def __init__(self, docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text",
                 source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeat: int = 3,
                 block: int = 1024) -> None:
        own = boxed(docs, doc_id=doc_id, text=text, source=source)
        sized = ws.put(own.select("doc_id", "source", n_words("text").alias("size"), *row_key("doc_id", "text")), "sizes")
        plan = ws.put(with_blocks(source_targets(sized, weights, repeat), block, repeat), "plan")
        known = plan.select(F.col("source").alias("of"), "sid", "source_size", "target")
        placed = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        self.documents = ws.put(running_total(
            placed, ["sid"], ["k1", "k2"], F.col("size"), "off", ws), "documents")
        self.slots = ws.put(schedule(plan, block), "slots")
        ends = F.col("off") + F.col("size")
        pieces = self.documents.filter("size > 0").select(
            "sid", "off", "size", F.explode(F.sequence(
                F.floor(F.col("off") / block), F.floor((ends - 1) / block))).alias("block"))
        start = F.col("block") * block
        read = pieces.join(self.slots, ["sid", "block"])
        first = F.greatest(F.col("off"), start)
        stop = F.least(ends, start + F.col("limit"))
        self.takes = read.filter(stop > first).select(
            "slot", "sid", "off", "pass", (first - F.col("off")).alias("first"), (stop - first).alias("words"))


def mixed_sizes(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken, k1, k2) of every document."""
    taken = mix.takes.groupBy("sid", "off").agg(F.sum("words").alias("taken"))
    # A document without words shares its place with the next one; only documents with words are taken.
    with_size = F.when(F.col("size") > 0, F.col("off"))
    joined = mix.documents.withColumn("at", with_size).join(
        taken.withColumnRenamed("off", "at"), ["sid", "at"], "left")
    return joined.select("doc_id", "size", "source_size", "target",
                         F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "k1", "k2")


def op2(spark, folder: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mixed_sizes(Mix(docs, Workspace(spark))).drop("k1", "k2")


def mixed_documents(docs: DataFrame, ws: Workspace, text: str = "text", **options) -> DataFrame:
    """The mix as rows of ``docs``: a document once per pass that takes it, cut where its pass ends.

    Passes read a source from its start, so a pass takes a document whole, a run of its first
    words, or not at all. A cut text ends with the last word taken; ``n_chars`` and other columns
    keep their values. Documents that the mix does not take are absent.
    """
    mix = Mix(docs, ws, text=text, **options)
    passes = mix.takes.groupBy("sid", "off", "pass").agg(F.sum("words").alias("words"))
    used = passes.join(mix.documents.filter("size > 0").select("sid", "off", "k1", "k2", "size"), ["sid", "off"])
    own = boxed(docs, doc_id=options.get("doc_id", "doc_id"), text=text)
    own = own.select("row", "text", *row_key("doc_id", "text")).dropDuplicates(["k1", "k2"])
    met = own.join(used.select("k1", "k2", "words", "size"), ["k1", "k2"])
    whole = F.col("words") >= F.col("size")
    return met.select(*[(F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col("words")))
                         if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space between words kept."""
    spaces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(spaces, F.lit(1), n.cast("int")), "")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pipeline's stage: documents as often as the mix takes them."""
    return mixed_documents(docs, Workspace(spark))
