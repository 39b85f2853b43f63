"""Pages arriving as a stream.

Extraction is a map over pages, so the batch operators run unchanged on a streaming DataFrame and
the file sink gives exactly-once output; ``foreachBatch`` is needed only to feed several sinks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import joined_patterns, normalize_url, url_domain, url_in_domains, url_matches_joined
from ..operators.extract import drop_seed_pages, extract_table, shred_rules
from ..operators.links import page_targets
from ..plans.job import check_saving, save_table
from ..sources.robots import rules_allow
from ..sources.specs import Rule, load_rules, one_spec, saving_options, spec_rules, spec_seeds
from ..storage import Workspace

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"

# State on the disks of the executors, of which a batch writes what it changed. Spark's default keeps all keys of the
# state, in two versions, in the executors' memory.
STATE = "spark.sql.streaming.stateStore"
DISK_STATE = {f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, unless the session names a provider of its own.

    A stream takes its settings when it starts, and one that goes on from a checkpoint those it began with.
    """
    chosen = spark.conf.get(f"{STATE}.providerClass", None) is not None
    put = {} if chosen else {k: v for k, v in DISK_STATE.items() if spark.conf.get(k, None) is None}
    for key, value in put.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in put:
            spark.conf.unset(key)


def stream_pages(spark: SparkSession, folder: str, glob: str | None = None, schema: str = PAGE_SCHEMA,
                 files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream of pages."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def stream_extract(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The wide table of :func:`extract_table`, as a stream."""
    return extract_table(shred_rules(pages, rules), rules)


def stream_new_urls(pages: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First arrival of each URL.

    With an event time the state is bounded: a URL is forgotten once the watermark passes
    ``delay`` after it. Without one, state grows with the number of URLs.
    """
    if event_time is None:
        return pages.dropDuplicates(["url"])
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


def stream_frontier(pages: DataFrame, settings: DataFrame, event_time: str, delay: str = "30 days",
                    visited: DataFrame | None = None) -> DataFrame:
    """``(seed_id, url, event_time)``: allowed link targets of arriving pages, each the first time it is met.

    ``pages`` is a stream of ``(url, html, event_time)``; ``settings`` comes from ``crawl.attach_robots``. A
    page counts for every seed that allows its domain. The state holds a seed's URL until the
    watermark is ``delay`` past it, so it follows the URLs met in that time and not the age of the crawl; a
    target met again later is given out again. ``visited`` (``seed_id``, ``url``) is left out. All of it
    runs in the JVM but for the link scan, which leaves plain links resolved, and a restart goes on from the checkpoint.
    """
    domains = settings.select("seed_id", F.explode("allowed_domains").alias("_domain")).distinct()
    found = page_targets(pages.filter("html IS NOT NULL").select(normalize_url(F.col("url")).alias("url"), event_time, "html"))
    hits = found.select(event_time, url_domain(F.col("url")).alias("_domain"), "targets").join(domains, "_domain")
    limits = settings.select("seed_id", "allowed_domains", joined_patterns(F.col("url_patterns")).alias("_patterns"), "rules", "denied")
    links = (hits.join(limits, "seed_id").withColumn("url", F.explode("targets"))
             .filter(url_matches_joined(F.col("url"), F.col("_patterns")) & url_in_domains(F.col("url"), F.col("allowed_domains")))
             .filter(~F.col("denied") & rules_allow(F.col("url"), F.col("rules"))).select("seed_id", "url", event_time))
    if visited is not None:
        links = links.join(visited.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
    return links.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["seed_id", "url"])


def stream_to_files(table: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options) -> StreamingQuery:
    """Append each micro-batch once; processes what is there and stops. State is kept as :func:`disk_state` says."""
    with disk_state(table.sparkSession):
        return (table.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start(path))


def stream_to_batches(table: DataFrame, path: str, checkpoint: str,
                      write: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Hand each micro-batch and a folder of its own to ``write``, which must overwrite it.

    A batch that is retried after a failure gets the same folder, so its output is replaced.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{path}/batch={batch_id}")

    return (table.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_job(spark: SparkSession, spec_path: str, pages: DataFrame, checkpoint: str) -> StreamingQuery:
    """Arriving pages ``(url, html)`` to all sinks of a spec, without pages of flagged seeds.

    Sinks that write files get a folder ``batch=<n>`` per micro-batch, replaced when a batch is
    retried; others (a database, registered ones) are appended to, at least once, and learn the
    ``batch_id``, by which a data source with commits can take each batch once.
    """
    spec = one_spec(spark, spec_path)
    rules, saving = load_rules(spec_rules(spec)), saving_options(spec)
    check_saving(saving)
    arriving = pages.select(normalize_url(F.col("url")).alias("url"), "html").filter("html IS NOT NULL")
    table = extract_table(shred_rules(drop_seed_pages(arriving, spec_seeds(spec)), rules), rules)

    def each(batch: DataFrame, batch_id: int) -> None:
        own = {sink: {**o, "file_path": f"{o['file_path']}/batch={batch_id}"} if o.get("file_path") else {**o, "batch_id": str(batch_id)}
               for sink, o in saving.items()}
        save_table(batch, own, True, Workspace(batch.sparkSession))

    return (table.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
