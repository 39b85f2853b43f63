"""A log-bilinear neural language model, trained by noise-contrastive estimation in numpy.

The model predicts the class of a token from the classes of the tokens before it; inside a class a
word has its smoothed share of the training tokens. All probabilities are normalised over the
training vocabulary and one unseen word.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import boxed, raw, ship, slices
from .vocabulary import frequent, word_counts

ship(__name__)
#: The token at the end of a text; no word is empty.
END = b""
#: Classes of one byte: the end, words outside the dictionary, then single words and bins of words.
END_CLASS, RARE_CLASS, CLASSES, START = 0, 1, 192, 255
SINGLE = 160
LN10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased words without ASCII white space, then the end."""
    return [*text.lower().split(), END]


# -- The model ------------------------------------------------------------------------------------

@dataclass
class Model:
    """``words`` and ``bias`` per predicted class; ``before[j]`` per class j + 1 places earlier, with
    the class START beyond the text's begin; ``mix[j]`` weighs the dimensions of that place."""

    words: np.ndarray       # (classes, size)
    bias: np.ndarray        # (classes,)
    before: np.ndarray      # (256, size)
    mix: np.ndarray         # (order, size)

    PARTS = ("words", "bias", "before", "mix")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.PARTS:
            shape = getattr(self, p).shape
            n = int(np.prod(shape))
            out.append(flat[at:at + n].reshape(shape).astype(np.float32))
            at += n
        return Model(*out)


def initial(share: np.ndarray, size: int, order: int, seed: int) -> Model:
    """Biases at the classes' log shares, so that training starts from a model without context."""
    rng = np.random.default_rng(seed)
    return Model((rng.normal(size=(len(share), size)) * 0.05).astype(np.float32), np.log(share).astype(np.float32),
                 (rng.normal(size=(256, size)) * 0.05).astype(np.float32),
                 (1 / (1 + np.arange(order))[:, None] * np.ones((order, size))).astype(np.float32))


def contexts(ids: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` classes before each token, nearest first; START before the text's begin.

    ``begin`` holds, per token, where its text begins.
    """
    places = np.arange(len(ids))
    out = np.full((order, len(ids)), START, np.uint8)
    for j in range(order):
        have = places - j - 1 >= begin
        out[j, have] = ids[places[have] - j - 1]
    return out


def summed(rows: np.ndarray, of: np.ndarray, out: np.ndarray) -> None:
    """Add each row to the row of ``out`` that ``of`` names; equal names are summed first."""
    order = np.argsort(of, kind="stable")
    ranked = of[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out[ranked[first]] += np.add.reduceat(rows[order], first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """AdaGrad on the noise-contrastive loss: tell each token from ``noise`` draws of the classes' shares."""

    def __init__(self, model: Model, share: np.ndarray, noise: int, rate: float, seed: int) -> None:
        self.model, self.noise, self.rate = model, noise, rate
        self.rng = np.random.default_rng(seed)
        self.upto = np.cumsum(share / share.sum())
        self.odds = np.log(noise * share / share.sum()).astype(np.float32)
        self.squares = {p: np.full(getattr(model, p).shape, 0.1, np.float32) for p in Model.PARTS}
        self.seen = 0

    def step(self, ids: np.ndarray, ctx: np.ndarray) -> None:
        m, n = self.model, len(ids)
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(self.noise)), len(self.upto) - 1)
        rows = [m.before[c] for c in ctx]
        query = sum(r * w for r, w in zip(rows, m.mix, strict=True))
        true = sigmoid((query * m.words[ids]).sum(axis=1) + m.bias[ids] - self.odds[ids]) - 1
        false = sigmoid(query @ m.words[drawn].T + m.bias[drawn] - self.odds[drawn])
        g = {p: np.zeros_like(getattr(m, p)) for p in Model.PARTS}
        summed(true[:, None] * query, ids, g["words"])
        g["bias"] += np.bincount(ids, true, len(m.bias)).astype(np.float32)
        np.add.at(g["words"], drawn, false.T @ query)
        np.add.at(g["bias"], drawn, false.sum(axis=0))
        back = true[:, None] * m.words[ids] + false @ m.words[drawn]
        for j, c in enumerate(ctx):
            g["mix"][j] = (back * rows[j]).sum(axis=0)
            summed(back * m.mix[j], c, g["before"])
        for p in Model.PARTS:
            grad = g[p] / n
            self.squares[p] += grad * grad * n
            getattr(m, p)[...] -= self.rate * np.sqrt(n) * grad / np.sqrt(self.squares[p])
        self.seen += n


def token_scores(model: Model, ids: np.ndarray, ctx: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Natural log probability of each token's class.

    Each distinct context is met once: matrix products give the scores of all classes after it and
    their sum, and a token takes its own score less the log of its context's sum.
    """
    packed = np.zeros(len(ids), np.int64)
    for c in ctx:
        packed = packed << 8 | c
    distinct, which = np.unique(packed, return_inverse=True)
    parts = [(distinct >> 8 * (len(ctx) - 1 - j) & 255) for j in range(len(ctx))]
    query = sum((model.before * w)[c] for c, w in zip(parts, model.mix, strict=True))
    total = np.empty(len(distinct), np.float32)
    for at in range(0, len(distinct), chunk):
        scores = query[at:at + chunk] @ model.words.T + model.bias
        top = scores.max(axis=1, keepdims=True)
        total[at:at + chunk] = np.log(np.exp(scores - top) @ np.ones(scores.shape[1], np.float32)) + top[:, 0]
    own = np.einsum("ij,ij->i", query[which], model.words[ids]) + model.bias[ids]
    return own - total[which]


# -- Classes --------------------------------------------------------------------------------------

@dataclass
class Classes:
    """What a stage needs to know of the vocabulary: the dictionary, and two logs per word in it."""

    words: list[bytes]
    klass: np.ndarray       # class of each word
    count: np.ndarray       # training tokens of each word
    inside: np.ndarray      # log10 of its share of its class
    share: np.ndarray       # smoothed share of each class in the training tokens
    total: int              # all training tokens
    distinct: int
    rare: float             # log10 of what an unseen word gets inside the class of rare words
    ends: int               # training texts


def classes_of(listed: list[tuple[bytes, int]], total: int, distinct: int) -> Classes:
    """The most frequent words are classes of their own; the rest of the dictionary fills bins of about
    equal mass; all other words, and unseen ones, are the rare class."""
    n = dict(listed)
    ends = n.pop(END, 0)
    words, count = list(n), np.fromiter(n.values(), np.int64, len(n))
    klass = 2 + np.minimum(np.arange(len(words)), SINGLE)
    tail = count[SINGLE:]
    bins = CLASSES - SINGLE - 2
    if len(tail):
        mass = np.cumsum(tail) - tail
        klass[SINGLE:] = 2 + SINGLE + mass * bins // max(1, int(tail.sum()))
    size = np.bincount(klass, count + 1, CLASSES)
    inside = np.log10((count + 1) / size[klass])
    rest, types = total - int(count.sum()) - ends, distinct - len(words) - (ends > 0)
    per_class = np.bincount(klass, count, CLASSES)
    per_class[END_CLASS], per_class[RARE_CLASS] = ends, rest
    used = 2 + SINGLE + bins
    return Classes(words, klass, count, inside, ((per_class + 1) / (total + used)).astype(np.float64), total, distinct,
                   -float(np.log10(rest + types + 1)), ends)


_INDEX: dict[int, dict[bytes, int]] = {}


def index_of(shared) -> dict[bytes, int]:
    """Number of each word of the dictionary, made once per Python worker."""
    if shared.id not in _INDEX:
        _INDEX.clear()
        _INDEX[shared.id] = {w: i for i, w in enumerate(shared.value.words)}
    return _INDEX[shared.id]


class Shared:
    """The broadcast classes under a name of their own, so a worker's next task finds its index."""

    def __init__(self, broadcast, name: int) -> None:
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Classes:
        return self.broadcast.value


ENCODED = ("n_tokens long, n_known long, log_count double, inside double, n_rare long, ids binary, "
           "rare array<struct<word: binary, n: long>>")


def encode_batches(shared):
    """The Arrow stage that replaces ``text`` by class numbers, sums over the words of the dictionary,
    and the words outside it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = shared.value, index_of(shared)
        log_count = np.log10(known.count + 1.0)
        log_end = float(np.log10(known.ends + 1.0))
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [t.lower().split() for t in raw(batch.column("text"))]
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                flat = list(itertools.chain.from_iterable(texts))
                at = np.fromiter(map(number.get, flat, itertools.repeat(-1)), np.int64, len(flat))
                hit = at >= 0
                doc = np.repeat(np.arange(len(texts)), n)
                ids = np.full(len(flat) + len(texts), END_CLASS, np.uint8)
                klass = np.full(len(flat), RARE_CLASS, np.uint8)
                klass[hit] = known.klass[at[hit]]
                ids[np.arange(len(flat)) + doc] = klass
                ends = np.cumsum(n + 1)

                def per_doc(values: np.ndarray, doc=doc, hit=hit, size=len(texts)) -> np.ndarray:
                    return np.bincount(doc[hit], values, size).astype(np.float64)

                rare, offsets = [], [0]
                missing = np.flatnonzero(~hit)
                for group in np.split(missing, np.searchsorted(doc[missing], np.arange(1, len(texts)))):
                    rare.append(Counter(flat[i] for i in group.tolist()))
                    offsets.append(offsets[-1] + len(rare[-1]))
                entries = pa.StructArray.from_arrays(
                    [pa.array([w for c in rare for w in c], pa.binary()),
                     pa.array([k for c in rare for k in c.values()], pa.int64())], names=["word", "n"])
                keep = [c for c in batch.schema.names if c != "text"]
                n_hit = np.bincount(doc[hit], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(n + 1), pa.array(n_hit + (known.ends > 0)),
                     pa.array(per_doc(log_count[at[hit]]) + log_end), pa.array(per_doc(known.inside[at[hit]])),
                     pa.array(n - n_hit), binary(ids, ends),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)],
                    names=[*keep, "n_tokens", "n_known", "log_count", "inside", "n_rare", "ids", "rare"])

    return run


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def joined(batches: Iterator[pa.RecordBatch], order: int, limit: int) -> Iterator[tuple]:
    """``(batch, ids, contexts, ends)`` of slices of about ``limit`` tokens of the column ``ids``."""
    for whole in batches:
        for batch in slices(whole, "ids", limit):
            values = [np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("ids")]
            ends = np.cumsum([len(v) for v in values])
            ids = np.concatenate(values)
            begin = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
            yield batch, ids, contexts(ids, begin, order), ends


# -- Training and scoring -------------------------------------------------------------------------

def train_batches(model: Model, share: np.ndarray, order: int, noise: int, rate: float, batch_size: int, seed: int):
    """The Arrow stage over ``ids``: one row of parameters per task, weighted by the tokens it learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model.like(model.flat()), share, noise, rate, seed)
        for _, ids, ctx, _ in joined(batches, order, 1 << 18):
            places = trainer.rng.permutation(len(ids))
            for at in range(0, len(ids), batch_size):
                now = places[at:at + batch_size]
                trainer.step(ids[now], ctx[:, now])
        flat = trainer.model.flat().astype(np.float64) * trainer.seen
        if trainer.seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat),
                 pa.array(np.full(len(flat), trainer.seen, np.int64))], names=["at", "sum", "weight"])

    return run


def fit(encoded: DataFrame, share: np.ndarray, size: int, order: int, noise: int, rate: float, batch_size: int,
        rounds: tuple[int, ...], seed: int) -> Model:
    """The model after one pass over all rows of ``encoded (turn, ids)``.

    ``rounds`` deals the documents out: a document whose ``turn`` modulo the last number lies below
    the k-th and not below an earlier number is learned from in round k. In a round every task starts
    from the same parameters and learns from its own documents; the mean of all tasks', weighted by
    tokens, starts the next round. The driver holds one set of parameters, whose size is fixed.
    """
    model, last = initial(share, size, order, seed), 0
    for k, upto in enumerate(rounds):
        turn = F.pmod("turn", F.lit(rounds[-1]))
        part = encoded.filter((turn >= last) & (turn < upto)).select("ids")
        rows = (part.mapInArrow(train_batches(model, share, order, noise, rate / (1 + k), batch_size, seed + k),
                                "at int, sum double, weight long")
                .groupBy("at").agg((F.sum("sum") / F.sum("weight")).alias("mean")).collect())
        last = upto
        if rows:
            flat = np.zeros(len(rows))
            for r in rows:
                flat[r["at"]] = r["mean"]
            model = model.like(flat)
    return model


def score_batches(model: Model, order: int):
    """The Arrow stage that replaces ``ids`` by the sum of its tokens' log10 class probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ctx, ends in joined(batches, order, 1 << 18):
            logs = token_scores(model, ids, ctx).astype(np.float64)
            sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[ends], prepend=0.0) / LN10
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sums)], names=[*keep, "classes"])

    return run


def held_out_of(doc_id: Column) -> Column:
    """Documents that are not learned from: CRC-32 of the id as text, modulo 7, is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def score_texts(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", one_in: int = 1 << 20,
                size: int = 24, order: int = 2, noise: int = 24, rate: float = 0.05, batch_size: int = 2048,
                rounds: tuple[int, ...] = (1, 5, 20), seed: int = 12) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Tokens are A-Z lower-cased words without ASCII white space and one end per text. ``base_score``
    is the text's log10 probability under add-one smoothed counts of the training documents,
    ``score`` that of the log-bilinear model: it predicts the class of each token from the ``order``
    classes before, and a word inside its class has its smoothed share. Both are normalised over
    the training vocabulary and one unseen word.

    The counts cover all distinct words of all training documents, and the model learns from every
    training document once. Words that make up one in ``one_in`` tokens (at most ``one_in`` words)
    travel with the stages; the others are joined with the counts, one row per document and
    distinct word, so no key of that join is frequent in training; a word that is frequent in
    held-out documents only is found in no count and adaptive execution splits it.

    Null and empty texts and texts of white space consist of their end. Repeated rows are scored
    and learned from one by one. A null ``doc_id`` belongs to the training documents. Without
    training documents every token is unseen: the base gives probability 1 to the only, unseen
    word. No rows give no rows; further columns are not looked at.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", "text").withColumn("held_out", held_out_of(F.col("doc_id")))
    kind = own.schema["doc_id"].dataType.simpleString()
    counts = ws.put(word_counts(own.filter(~F.col("held_out")), tokens), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    listed = frequent(counts, total, one_in)
    if total and END not in dict(listed):            # texts so long that their ends are no frequent token
        listed += [(END, r["n"]) for r in counts.filter(F.octet_length("word") == 0).collect()]
    known = classes_of(listed, total, distinct)
    shared = Shared(docs.sparkSession.sparkContext.broadcast(known), hash(ws.path))
    encoded = ws.put(own.select("doc_id", "held_out", "text").mapInArrow(
        encode_batches(shared), f"doc_id {kind}, held_out boolean, {ENCODED}")
        .withColumn("uid", F.monotonically_increasing_id()), "encoded")
    turns = encoded.filter(~F.col("held_out")).select(F.xxhash64("doc_id", "n_tokens", F.lit(seed)).alias("turn"), "ids")
    model = fit(turns, known.share, size, order, noise, rate, batch_size, rounds, seed)
    narrow = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "log_count", "inside", "n_rare", "ids")
    scored = ws.put(narrow.mapInArrow(score_batches(model, order),
                                      narrow.drop("ids").withColumn("classes", F.lit(0.0)).schema), "scored")
    rare = (encoded.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
            .join(counts, "word").groupBy("uid")
            .agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_log")))
    rare = ws.put(rare, "rare")
    more = F.coalesce(F.col("more_log"), F.lit(0.0))
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("classes") + F.col("inside") + more + F.col("n_rare") * F.lit(known.rare)).alias("score"))


def op12(spark, folder: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score_texts(spark.read.parquet(f"{folder}/documents.parquet"), Workspace(spark))
