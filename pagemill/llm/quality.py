"""Quality rules: a learned decision list over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed, hash_share, row_key, ship, slices, unboxed

ship(__name__)
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_top_word"]


def statistics(text: bytes) -> list[int]:
    """``COUNTS`` of one text; words are runs without ASCII white space."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS)
    data = np.frombuffer(text, np.uint8)
    kind = np.bincount(data, minlength=256)
    points = len(data) - int(kind[0x80:0xC0].sum())
    blanks = int(kind[0x20] + kind[0x09:0x0E].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n > 2:
        pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
        triple = pair[:-1] * len(ids) + seq[2:]
        _, at, times = np.unique(triple, return_inverse=True, return_counts=True)
        hit = times[at] > 1
        cover = np.zeros(n, bool)
        for shift in range(3):
            cover[shift:n - 2 + shift] |= hit
        repeated = int(cover.sum())
    marks = int(kind[0x21:0x30].sum() + kind[0x3A:0x41].sum() + kind[0x5B:0x61].sum() + kind[0x7B:0x7F].sum())
    return [n, points - blanks, int(kind[[ord(c) for c in SYMBOLS]].sum()), len(lines) - len(set(lines)), repeated,
            len(lines), int(kind[0x41:0x5B].sum()), int(kind[0x30:0x3A].sum()), marks,
            int(np.bincount(seq).max())]


def statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 8 << 20):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *[pa.array(rows[:, i].copy()) for i in range(len(COUNTS))]],
                names=[*keep, *COUNTS])


def text_statistics(keyed: DataFrame) -> DataFrame:
    """Other columns of ``keyed`` and ``COUNTS`` of its ``text``."""
    rest = keyed.drop("text")
    schema = rest.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return keyed.select(*rest.columns, "text").mapInArrow(statistic_batches, schema)


def features() -> dict[str, Column]:
    """What the rules may test: sizes and shares, 0 where there is nothing to divide by."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")

    return {
        "n_words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"), "mark_share": share("n_marks", "word_chars"),
        "top_word_share": share("n_top_word", "n_words"), "line_words": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Rule:
    """``all(feature >= bound if above else feature < bound)`` marks a text as poor."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, bound in self.tests:
            out = out & (of[name] >= bound if above else of[name] < bound)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {b:g}" for n, a, b in self.tests)


def learn_rules(x: dict[str, np.ndarray], poor: np.ndarray, precision: float = 0.9, most_tests: int = 4,
                cuts: int = 64, least: int = 3) -> list[Rule]:
    """Sequential covering: one conjunction after another for the poor texts not covered yet.

    Two thirds of the rows grow a rule, one third prunes it. Growing adds the threshold test with
    the highest information gain (over up to ``cuts`` quantiles of each feature) until no good text
    is covered. Pruning drops last tests while that does not lower (poor - good) / (poor + good) on
    the other rows. A rule stays if it covers ``least`` poor texts and at least ``precision`` of
    what it covers is poor, on all rows and on the pruning rows. Of a refused rule the first test's
    feature and direction begin no further rule until one has been accepted; learning ends when none is
    left to begin with. So rules speak only where the labels are clear, and everything else is kept.
    """
    names = list(x)
    data = np.column_stack([x[n] for n in names]) if names else np.empty((len(poor), 0))
    prune = np.arange(len(poor)) % 3 == 2
    open_, rules = np.ones(len(poor), bool), []
    refused: set[tuple[str, bool]] = set()
    while (open_ & poor & ~prune).sum() >= least:
        grow, tests = open_ & ~prune, []
        while (grow & ~poor).any() and len(tests) < most_tests:
            p, q = (grow & poor).sum(), (grow & ~poor).sum()
            base, best = np.log2(p / (p + q)), (1e-9, None, None)
            for f in range(len(names)):
                values = np.unique(data[grow, f])
                mids = (values[1:] + values[:-1]) / 2
                if len(mids) > cuts:
                    mids = np.unique(np.concatenate([mids[:2], np.quantile(mids, np.linspace(0, 1, cuts), method="nearest")]))
                order = np.sort(data[grow & poor, f]), np.sort(data[grow & ~poor, f])
                below = [np.searchsorted(o, mids, "left") for o in order]
                for above in (True, False):
                    if not tests and (names[f], above) in refused:
                        continue
                    tp = p - below[0] if above else below[0]
                    fp = q - below[1] if above else below[1]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(tp > 0, tp * (np.log2(tp / (tp + fp)) - base), -1)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        hit = data[:, f] >= mids[k] if above else data[:, f] < mids[k]
                        best = (gain[k], (names[f], above, float(mids[k])), hit)
            if best[1] is None:
                break
            tests.append((best[1], best[2]))
            grow &= best[2]

        def covered(k: int, tests=tests) -> np.ndarray:
            out = open_.copy()
            for _, hit in tests[:k]:
                out &= hit
            return out

        def worth(k: int) -> float:
            c = covered(k) & prune
            p, q = (c & poor).sum(), (c & ~poor).sum()
            return (p - q) / (p + q) if p + q else -1.0

        size = max(range(len(tests), 0, -1), key=worth, default=0)
        hit = covered(size)
        good, bad = (hit & poor).sum(), (hit & ~poor).sum()
        held = hit & prune
        if not size or good < least or good < precision * (good + bad) or \
                (held & poor).sum() < precision * held.sum():
            if not tests:
                break
            refused.add(tests[0][0][:2])
            continue
        rules.append(Rule(tuple(t for t, _ in tests[:size])))
        refused.clear()
        open_ &= ~hit
    return rules


def decision(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The decision list as one conditional expression: True keeps."""
    out = None
    for rule in rules:
        out = F.when(rule.column(of), False) if out is None else out.when(rule.column(of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled(labels: DataFrame, most: int = 20_000, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``(doc_id, quality)`` of at most about a quarter more than ``most`` labels, chosen by a hash of the id.

    Rows with a null id or quality are no labels; repeated labels count as often as they come.
    """
    given = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("quality")).dropna()
    return given.filter(hash_share("doc_id", given.count(), most))


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, given: DataFrame, most: int = 20_000) -> list[Rule]:
    """Rules from the labelled rows of ``stats (doc_id, COUNTS)`` that pass the base.

    Texts that the base refuses need no rule and would only teach the base again. At most ``most``
    rows of ``given``, from :func:`labelled`, come to the driver: a bounded sample that no order or
    partitioning changes. No labels: no rules.
    """
    of = features()
    rows = (stats.filter(~base_failed()).join(given, "doc_id").select(
        F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *[c.alias(f"f_{n}") for n, c in of.items()])
        .orderBy("h", *[f"f_{n}" for n in of], "quality").limit(most).toPandas())
    return learn_rules({n: rows[f"f_{n}"].to_numpy(float) for n in of}, rows["quality"].to_numpy() == 0)


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds :func:`base_failed` and ``kept`` (passed the base and no rule speaks against it)."""
    failed = base_failed()
    return stats.select("*", failed.alias("base_failed"), (~failed & decision(rules, features())).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, ws: Workspace, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``(doc_id, k1, k2, COUNTS, base_failed, kept)`` of every row of ``docs``.

    Statistics cover whole texts: ``n_words`` runs without ASCII white space, ``word_chars`` their
    code points, ``n_symbols`` characters of ``SYMBOLS``, ``n_dup_lines`` lines with a word equal to
    an earlier line, ``n_repeat_words`` words inside windows of three words found twice or more. A
    null or empty text has zeros everywhere and fails the base. Null ids and repeated rows are
    judged like others. An empty table gives an empty one. The statistics are written once and
    read for learning and for judging; texts are not moved.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", *row_key("doc_id", "text"), "text")
    stats = ws.put(text_statistics(own), "statistics")
    return judged(stats, fit(stats, labelled(labels)))


def tables(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1(spark, folder: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    done = quality_verdicts(docs, tables(spark, folder), Workspace(spark))
    return done.select("doc_id", *COUNTS[:5], "base_failed", "kept")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pipeline's stage: documents that the rules keep. Texts stay in place: the rules come from the
    statistics of the labelled sample, then one pass counts and filters."""
    ws = Workspace(spark)
    own = boxed(docs, doc_id="doc_id", text="text").select("row", "doc_id", "text")
    given = ws.put(labelled(tables(spark, folder)), "labelled")
    sample = own.select("doc_id", "text").join(given.select("doc_id").distinct(), "doc_id", "left_semi")
    rules = fit(text_statistics(sample), given)
    return unboxed(judged(text_statistics(own), rules).filter("kept"), docs.columns)
