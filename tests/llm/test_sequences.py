"""Word runs, the language model and importance resampling: edge cases, ties, repeated rows and the parts inside."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bilinear_lm, importance, vocabulary, word_runs
from pagemill.storage import Workspace

import brute as B
from test_operators import ROWS, UNIQUE, frame, got

PLAIN = [r[:2] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# -- Word runs ------------------------------------------------------------------------------------

def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        letters, n = rng.choice([1, 2, 2, 3, 4]), rng.randrange(60)
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            words += [rng.randrange(letters) for _ in range(rng.randrange(20))]
        for least, times in ((6, 4), (1, 3)):
            found = word_runs.runs(np.array(words, np.int64), least, times)
            assert [tuple(r) for r in found.tolist()] == B.word_runs(words, least, times)


def test_long_periods_and_long_runs():
    rng = np.random.default_rng(5)
    root = rng.integers(0, 50, 3001)
    words = np.concatenate([rng.integers(0, 50, 777), np.tile(root, 5)[:4 * 3001 + 17], rng.integers(100, 200, 99)])
    found = word_runs.runs(words)
    assert [777 - found[0, 0] >= 0, len(found), found[0, 2]] == [True, 1, 3001]
    assert word_runs.runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def test_word_runs(spark, docs, none):
    rows = [(k, " ".join(t)) for k, t in enumerate([
        "x y " * 5, "a b c a b c a b c a b c", "a a a a a", "a a a a a a", "b a a a a a a c d c d c d c d c d e",
        "q " * 70 + "r s " * 9 + "\n\tq  q q q q q"])] + PLAIN
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = word_runs.word_runs(table).select("doc_id", "n_words", "runs", F.sha2("collapsed", 256))
    have = Counter((i, n, tuple(tuple(r) for r in found), c) for i, n, found, c in out.collect())
    want = Counter()
    for i, text in rows:
        words = B.WORD.findall(text or "")
        found = B.word_runs(words)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        want[i, len(words), tuple(found), B.sha(" ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    assert have == want
    assert word_runs.word_runs(docs).count() == len(ROWS)
    assert word_runs.word_runs(none).count() == 0


def test_equal_powers(spark):
    runs = [[(0, 8, 2), (9, 12, 3), (30, 6, 1)], [(0, 9, 2), (10, 13, 3)], [(0, 12, 3), (5, 8, 2)], []]
    table = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start: long, length: long, period: long>>")
    best = [r[0] and tuple(r[0]) for r in table.select(word_runs.longest_power(F.col("runs"))).collect()]
    assert best == [(30, 6, 1), (0, 9, 2), (0, 12, 3), None]


# -- Language model -------------------------------------------------------------------------------

def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = bilinear_lm.initial(np.full(7, 1 / 7), 5, 2, 3)
    model.words[...] = rng.normal(size=model.words.shape) * 20
    ctx = rng.integers(0, 7, (2, 40)).astype(np.uint8)
    each = [bilinear_lm.token_scores(model, np.full(40, c, np.uint8), ctx) for c in range(7)]
    assert np.exp(np.array(each, np.float64)).sum(axis=0) == pytest.approx(1, abs=1e-4)


def test_words_of_a_class_sum_to_one():
    counts = {b"w%d" % k: 4000 // (k + 1) for k in range(1500)} | {bilinear_lm.END: 50}
    total = sum(counts.values())
    listed = [(w, n) for w, n in counts.items() if n > 3]
    known = bilinear_lm.classes_of(listed, total, len(counts))
    for c in np.unique(known.klass):
        assert (10 ** known.inside[known.klass == c]).sum() == pytest.approx(1)
    rest = [n for w, n in counts.items() if n <= 3]
    assert sum((n + 1) * 10 ** known.rare for n in [*rest, 0]) == pytest.approx(1)
    assert known.share.sum() == pytest.approx(1)


def test_training_learns_an_order():
    rng = np.random.default_rng(2)
    ids = np.empty(40_000, np.uint8)
    ids[0] = 0
    for k in range(1, len(ids)):                    # a class is nearly always followed by the next one
        ids[k] = (ids[k - 1] + 1) % 20 if rng.random() < 0.9 else rng.integers(20)
    share = np.full(20, 1 / 20)
    trainer = bilinear_lm.Trainer(bilinear_lm.initial(share, 16, 2, 1), share, 10, 0.05, 4)
    ctx = bilinear_lm.contexts(ids, np.zeros(len(ids), np.int64), 2)
    for _ in range(4):
        for at in range(0, 32_000, 500):
            trainer.step(ids[at:at + 500], ctx[:, at:at + 500])
    unseen = bilinear_lm.token_scores(trainer.model, ids[32_000:], ctx[:, 32_000:]).mean()
    assert unseen > -1.5 > np.log(1 / 20)


def test_contexts_stop_at_the_text():
    ids = np.array([5, 6, 0, 7, 0], np.uint8)
    ctx = bilinear_lm.contexts(ids, np.array([0, 0, 0, 3, 3]), 2)
    assert ctx.tolist() == [[255, 5, 6, 255, 7], [255, 255, 5, 255, 255]]


@pytest.mark.parametrize("one_in", [1 << 20, 40, 1])
def test_score_texts(spark, docs, none, one_in):
    out = bilinear_lm.score_texts(docs, Workspace(spark), one_in=one_in)
    have = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["base_score"]))
    want = sorted(B.unigrams(PLAIN), key=lambda r: (r[0] is None, r[0], r[2], r[5]))
    assert [tuple(r)[:5] for r in have] == [r[:5] for r in want]
    assert [r["base_score"] for r in have] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r["score"] < 0 for r in have)
    assert bilinear_lm.score_texts(none, Workspace(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = bilinear_lm.score_texts(frame(spark, [(i, "a b", "s") for i in held]), Workspace(spark)).collect()
    assert {tuple(r)[1:6] for r in rows} == {(True, 3, 0, 0, 0.0)}


# -- Importance resampling ------------------------------------------------------------------------

def test_composed_hashes():
    rng = random.Random(7)
    words = [bytes(rng.randrange(1, 256) for _ in range(rng.choice([1, 2, 5, 30, 700]))) for _ in range(300)]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    length = np.array([len(w) for w in words])
    both = importance.moved(crc[:-1], length[1:]) ^ crc[1:]
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("held", [[], [b"the", b"x", "é".encode()], None])
def test_scan(held):
    text = b" the x  xx the \xc3\xa9 x thethe "
    d = importance.Dictionary(sorted(set(text.split())) if held is None else held)
    crc, length, end = d.scan(text)
    assert crc.tolist() == [zlib.crc32(w) for w in text.split()]
    assert length.tolist() == [len(w) for w in text.split()]
    assert all(text[e] == 32 != text[e - 1] for e in end)


@pytest.mark.parametrize("one_in", [1 << 18, 30, 1])
def test_importance(spark, none, one_in):
    target = ["of the license", None, "", ROWS[11][1], "under the MIT License"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    out = importance.importance_resample(frame(spark, UNIQUE), wanted, Workspace(spark), one_in=one_in)
    have = got(out, "doc_id", "n_features", "weight", "score", "rank")
    assert have == Counter(B.resampled([r[:2] for r in UNIQUE], target))
    assert importance.importance_resample(none, wanted, Workspace(spark)).count() == 0


def test_importance_of_repeated_rows(spark, docs, none):
    out = importance.importance_resample(docs, none, Workspace(spark), least=1)
    rows = out.collect()
    want = Counter(r[:4] for r in B.resampled(PLAIN, [], least=1))
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in rows) == want
    able = [r for r in rows if r["n_words"] >= 1]
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(able) * 25 // 100 + 1))
    assert [r["score"] for r in ranked] == sorted((r["score"] for r in able), reverse=True)[:len(ranked)]


def test_three_word_features():
    d = importance.Dictionary([])
    n, numbers, offsets = importance.features(d, [b"a b c d", b"", b"e f"], 1 << 16, 3)
    assert n.tolist() == [4, 0, 2]
    assert offsets.tolist() == [0, 9, 9, 12]
    want = [b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d", b"e", b"f", b"e f"]
    assert numbers.tolist() == [zlib.crc32(w) % (1 << 16) for w in want]


# -- Word counts ----------------------------------------------------------------------------------

def test_counts_are_handed_on_early(spark):
    batches = frame(spark, ROWS).select("text").toArrow().to_batches()
    seen: Counter = Counter()
    for b in vocabulary.count_batches(bytes.split, held=5)(iter(batches)):
        seen.update(dict(zip(*b.to_pydict().values(), strict=True)))
    assert seen == Counter(w for _, t, _ in ROWS for w in (t or "").encode().split())
