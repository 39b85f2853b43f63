"""The registered queries on the small tables, and the pipeline against its stages done plainly."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from conftest import SMALL
from oracle import compare, connect
from pagemill.llm import catalog

import brute as B


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SMALL), name, catalog.QUERIES[name], catalog.SQL[name], SMALL) == ""


def texts() -> list[tuple]:
    return connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall()


BRUTE = {
    "op6_sentencepiece": lambda docs: B.pieces(docs, model()),
    "op9_simhash": B.simhash, "op10_suffix_dedup": B.repeats, "op3_line_dedup": B.lines,
    "op11_word_runs": B.periodic, "op13_importance_resampling": lambda docs: B.resampled(docs, benchmark())}


def benchmark() -> list:
    return [r[0] for r in connect(SMALL).sql("SELECT text FROM benchmark").fetchall()]


def model():
    import sentencepiece
    from pagemill.llm.pieces import model_path
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.mark.parametrize("name", list(BRUTE))
def test_brute(spark, name):
    rows = Counter(tuple(r) for r in catalog.QUERIES[name](spark, SMALL).collect())
    assert rows == Counter(BRUTE[name](texts()))


def test_quality_query(spark):
    rows = catalog.QUERIES["op1_quality_rules"](spark, SMALL).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((i, *B.quality(t)) for i, t in texts())
    assert not any(r["base_failed"] and r["kept"] for r in rows)


def test_quality_query_learns(spark):
    """Labelled poor texts that pass the base go, good ones stay, on few labels too."""
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op1_quality_rules"](spark, folder).collect()}
    labels = connect(folder).sql("SELECT doc_id, quality FROM labels").fetchall()
    judged = [(q, rows[i]["kept"]) for i, q in labels if q is not None and i in rows and not rows[i]["base_failed"]]
    poor, good = [k for q, k in judged if q == 0], [k for q, k in judged if q == 1]
    assert len(poor) > 10 and sum(poor) < 0.3 * len(poor)
    assert sum(good) >= 0.99 * len(good)


def test_mixing_query(spark):
    rows = catalog.QUERIES["op2_source_mixing"](spark, SMALL).collect()
    docs = connect(SMALL).sql("SELECT doc_id, text, source FROM documents").fetchall()
    size, source = {i: len(B.WORD.findall(t or "")) for i, t, _ in docs}, {i: s for i, _, s in docs}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = B.targets(total)
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_license_query(spark):
    rows = catalog.QUERIES["op7_license_scan"](spark, SMALL).collect()
    have = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows)
    assert have == Counter((i, *B.licenses(t)) for i, t in texts())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_vector_query(spark):
    rows = [tuple(r) for r in catalog.QUERIES["op8_vector_groups"](spark, SMALL).select("vec_id", "n_links", "component_id", "kept").collect()]
    vectors = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(rows) == Counter(B.vectors(vectors))


def test_language_model(spark):
    rows = catalog.QUERIES["op12_bilinear_lm"](spark, SMALL).collect()
    want = {r[0]: r for r in B.unigrams(texts())}
    assert {r["doc_id"]: tuple(r)[:5] for r in rows} == {i: r[:5] for i, r in want.items()}
    assert all(r["base_score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-9) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SMALL).cache()
        seen[name] = before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sorted(seen["line dedup"].items())
    after = seen["simhash near-dedup"]
    assert Counter((i, B.sha(t)) for i, t in after.items()) == Counter((i, h) for i, _, _, h in B.lines(rows))
    groups = B.simhash(sorted(after.items()))
    assert set(seen["source mixing"]) == {c for _, _, c in groups}
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
