"""Sinks: CSV, text, database, and the registry that writes one result to all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

# Allowed layouts and the JDBC form of the documented database keys.
ORIENTATIONS = ("vertical", "horizontal")
JDBC_URL = "jdbc:{type}://{host}:{port}/{database_name}"

# Quoting that brings every value back unchanged, delimiters, quotes and line breaks included.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _need_path(options: dict, kind: str) -> str:
    path = options.get("file_path")
    if not path:
        raise ValueError(f"the {kind} sink needs a file_path")
    return path


def csv_options(options: dict) -> dict:
    return {**CSV_OPTIONS, "sep": options.get("delimiter") or ","}


def write_csv(df: DataFrame, options: dict, mode: str = "append") -> None:
    """Write a table as CSV with a header; ``mode='overwrite'`` clears earlier output.

    ``orientation`` says which layout ``df`` already has: a table of records, or ready lines in
    a ``line`` column (``extract.extract_lines``, ``reshape.layout_horizontal``).
    """
    orientation = check_csv(options)
    path = _need_path(options, "csv")
    if orientation == "horizontal":
        df.select("line").write.mode(mode).text(path)
    else:
        df.write.mode(mode).options(**csv_options(options)).csv(path)


def check_csv(options: dict) -> str:
    """The orientation, after a look at what CSV output needs."""
    orientation = options.get("orientation") or ORIENTATIONS[0]
    if orientation not in ORIENTATIONS:
        raise ValueError(f"orientation is one of {' / '.join(ORIENTATIONS)}: {orientation!r}")
    _need_path(options, "csv")
    return orientation


def enabled(options: dict) -> bool:
    """Sinks are on unless their options say otherwise; specs give texts."""
    return str(options.get("enabled")).lower() != "false"


def read_csv(spark, options: dict, schema) -> DataFrame:
    """Read back what :func:`write_csv` wrote."""
    # An unquoted empty field is null by itself; naming "" as the null would take quoted ones too.
    reading = {**csv_options(options), "nullValue": "\x00", "emptyValue": "", "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**reading).csv(_need_path(options, "csv"))


def text_lines(df: DataFrame, delimiter: str = "\t") -> DataFrame:
    """One line per row; tabs, line breaks and backslashes inside values are escaped."""
    def escaped(name: str):
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        for have, want in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            value = F.replace(value, F.lit(have), F.lit(want))
        return value

    return df.select(F.concat_ws(delimiter, *[escaped(c) for c in df.columns]).alias("value"))


def write_txt(df: DataFrame, options: dict, mode: str = "append") -> None:
    text_lines(df).write.mode(mode).text(_need_path(options, "txt"))


def jdbc_options(options: dict) -> dict:
    """The documented keys (type, host, port, ...) or a ready ``url``, as writer options."""
    if not options.get("url"):
        missing = [k for k in ("type", "host", "port", "database_name") if not options.get(k)]
        if missing:
            raise ValueError(f"database options missing: {', '.join(missing)}")
    out = {"url": options.get("url") or JDBC_URL.format(**options), "dbtable": options.get("table") or "scraped_data",
           "batchsize": str(options.get("batch_size") or 10_000)}
    for ours, theirs in (("username", "user"), ("password", "password"), ("driver", "driver"),
                         ("connections", "numPartitions")):
        if options.get(ours) is not None:
            out[theirs] = str(options[ours])
    return out


def write_database(df: DataFrame, options: dict, mode: str = "append") -> None:
    """Append to a table over JDBC, one connection per partition (``connections`` caps them)."""
    df.write.format("jdbc").options(**jdbc_options(options)).mode(mode).save()


SINKS: dict[str, Callable[[DataFrame, dict, str], None]] = {
    "csv": write_csv, "txt": write_txt, "database": write_database}
CLEARABLE = {"csv", "txt"}


def register_sink(name: str, write: Callable[[DataFrame, dict, str], None], clearable: bool = False) -> None:
    """Add a sink type under the name that specs use."""
    SINKS[name] = write
    if clearable:
        CLEARABLE.add(name)


def write_source(df: DataFrame, options: dict, mode: str = "append") -> None:
    """Write through any data source that Spark knows by the ``format`` of the options, Python ones
    (``spark.dataSource.register``) included; all options go to its writer.

    A source with commit and abort sees either all rows of a write or none. In a stream it also gets
    ``batch_id``: one that keeps what it commits under that number takes each batch exactly once.
    """
    df.write.format(options["format"]).options(**options).mode(mode).save()


def write_all(df: DataFrame, saving: dict[str, dict | None], clear: bool = True,
              workspace: Workspace | None = None) -> list[tuple[str, str]]:
    """Write to every enabled sink; returns ``(sink, outcome)`` with unknown and disabled ones.

    With more than one sink the table is computed once into the shared folder and read from there.
    A sink of any other name that brings a ``format`` goes through :func:`write_source`.
    """
    plan, report = [], []
    for name, options in saving.items():
        if options is None:
            continue
        if name not in SINKS and not options.get("format"):
            report.append((name, "unknown"))
        elif not enabled(options):
            report.append((name, "disabled"))
        else:
            plan.append((name, options))
    if len(plan) > 1:
        columns = df.columns
        stored = (workspace or Workspace(df.sparkSession)).put(df.toDF(*[f"c{i}" for i in range(len(columns))]), "result")
        df = stored.toDF(*columns)
    for name, options in plan:
        SINKS.get(name, write_source)(df, options, "overwrite" if clear and name in CLEARABLE else "append")
        report.append((name, "written"))
    return report
