"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing
column names and no rows at all, against the plain versions in ``brute``."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import (
    chats, license_scan, license_texts, line_dedup, mixing, pieces, quality, simhash, suffix_dedup, suffix_runs, url_filter, vector_dedup)
from pagemill.llm.common import row_key
from pagemill.llm.components import connected_components
from pagemill.storage import Workspace

import brute as B

#: Names that the operators use inside, as columns of the user's table.
CLASH = ["row", "k1", "fp", "lines", "n_words", "h1", "size", "ord", "places", "pos"]


def documents() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "Éa", "of", "tion", "MIT", "license", "x", "#&&", "longerword", "GNU", "apache", "cc-by", "under"]

    def prose(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))

    shared = "A line that many documents share, long enough to count as one"
    passage = prose(60)
    texts = [None, "", " ", "\n\n", "word", "a b", "a b c d", "A B C D", "Released under the MIT License.",
             "This work is licensed under the GNU General Public License, version 3.", shared, prose(4000),
             "aaaa" * 200, "aa bb " * 120, "ba" * 150, passage, "x" + passage, passage + "y", passage[:90],
             "#### $$$ " * 40, "é" * 120, "é" * 120 + "z"]
    for k in range(12):
        texts.append(prose(80) + "\n" + ("  " if k % 2 else "") + (shared.upper() if k % 3 else shared) + "\t\n" + prose(5))
    base = prose(300)
    texts += [base, base, base + " end", "start " + base, base.replace("tion", "tion", 1)]
    texts += [texts[11]] * 3
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(None, base, "s1"), (None, shared + "\n" + prose(3), None), rows[5], rows[11], (7, "other text of the same id", "s2")]
    return rows


ROWS = documents()
UNIQUE = [r for i, r in enumerate(ROWS) if r[0] is not None and r[0] not in [x[0] for x in ROWS[:i]]]


def frame(spark, rows):
    clash = [F.lit(i).alias(c) for i, c in enumerate(CLASH)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).select("*", *clash)


def got(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_quality_statistics(spark, docs, none):
    labels = spark.createDataFrame([(0, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    out = quality.quality_verdicts(docs, labels, Workspace(spark))
    assert got(out, "doc_id", *quality.COUNTS[:5], "base_failed") == Counter((i, *B.quality(t)) for i, t, _ in ROWS)
    assert out.filter("base_failed AND kept").isEmpty()
    assert quality.quality_verdicts(none, labels.limit(0), Workspace(spark)).count() == 0


def test_quality_stage(spark, docs, none, monkeypatch):
    """Null ids, repeated rows and clashing columns pass through; what the base refuses goes."""
    labels = spark.createDataFrame([(0, 0), (None, 1), (4, None), (11, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "tables", lambda *_: labels)
    clash = docs.select("*", *[F.lit(2).alias(c) for c in ("quality", "h", "kept", "base_failed", "n_symbols", "f_n_words")])
    out = quality.stage(spark, clash, "")
    assert out.columns == clash.columns
    assert got(out, "doc_id", "text") == Counter((i, t) for i, t, _ in ROWS if not B.quality(t)[-1])
    assert quality.stage(spark, none, "").count() == 0
    monkeypatch.setattr(quality, "tables", lambda *_: labels.limit(0))
    assert quality.stage(spark, clash, "").count() == out.count()


def test_quality_rules_hold_out():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    poor = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    train, test = np.arange(3000) < 2000, np.arange(3000) >= 2000
    rules = quality.learn_rules({k: v[train] for k, v in x.items()}, poor[train])
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= np.logical_and.reduce([x[n] >= b if up else x[n] < b for n, up, b in rule.tests])
    assert (hit & poor & test).sum() >= 0.95 * (poor & test).sum()
    assert (hit & ~poor & test).sum() <= 0.02 * (~poor & test).sum()
    assert quality.learn_rules(x, rng.random(3000) < 0.1) == []     # noise teaches nothing


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    train = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    out = quality.quality_verdicts(rows, train, Workspace(spark)).filter("NOT base_failed")
    held = out.join(labels.filter(F.xxhash64("doc_id") % 2 != 0), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r[0], r[1]): r[2] for r in held}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, False), 0) >= 0.7 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_mixing(spark, docs, none):
    mix = mixing.Mix(docs, Workspace(spark), block=16)
    out = [tuple(r) for r in mixing.mixed_sizes(mix).select("doc_id", "size", "source_size", "target", "taken").collect()]
    again = mixing.mixed_sizes(mixing.Mix(docs.repartition(5), Workspace(spark), block=16))
    assert Counter(out) == got(again, "doc_id", "size", "source_size", "target", "taken")
    size = Counter()
    for _, t, s in ROWS:
        size[s] += len(B.WORD.findall(t or ""))
    want = B.targets(size)
    assert len(out) == len(ROWS)
    assert all(0 <= taken <= 3 * n for _, n, _, _, taken in out)
    assert {round(t, 6) for *_, t, _ in out} == {round(t, 6) for t in want.values()}
    assert abs(sum(r[4] for r in out) - sum(want.values())) <= len(want)
    assert mix.slots.groupBy("slot").count().filter("count > 1").isEmpty()
    assert mixing.mixed_sizes(mixing.Mix(none, Workspace(spark))).count() == 0


def test_mixing_follows_the_weights(spark):
    rows = [(i, "w " * 400, "abc"[i % 3]) for i in range(300)]
    mix = mixing.Mix(frame(spark, rows), Workspace(spark), block=64)
    order = [r[0] for r in mix.slots.orderBy("slot").select("sid").collect()]
    for at in range(0, len(order) - 80, 40):        # every stretch of the schedule has the shares
        share = Counter(order[at:at + 80])
        assert [abs(share[k] - 10 * w) <= 5 for k, w in enumerate((5, 2, 1))] == [True] * 3


def test_mixed_documents(spark, docs, none):
    out = mixing.mixed_documents(docs, Workspace(spark), block=16)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(B.WORD.findall(r["text"]))
    taken = mixing.mixed_sizes(mixing.Mix(docs, Workspace(spark), block=16))
    assert sum(words.values()) == taken.agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(none, Workspace(spark)).count() == 0


def test_line_dedup(spark, docs, none):
    out = line_dedup.drop_common_lines(docs, Workspace(spark))
    have = got(out, "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    assert have == Counter(B.lines([r[:2] for r in ROWS]))
    assert line_dedup.stage(spark, docs, "").columns == docs.columns
    assert line_dedup.drop_common_lines(none, Workspace(spark)).count() == 0


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["a.example.org", "EXAMPLE.org", "xexample.org", "org", "fr.com", "a.b.c.com", "example.net", "", "." * 300 + "org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a#b", "/de/", "/de", "?q=/es/", "/ES/", "/" + "p" * 5000]
    rows = [(i, s + h + p) for i, (s, h, p) in enumerate(
        (rng.choice(["http://", "https://", "HTTP://", ""]), rng.choice(hosts), rng.choice(paths)) for _ in range(600))]
    rows += [(None, None), (None, "http://example.org/es/x"), (5, ""), (5, ""), (6, "no scheme"), (7, "://org/"), (8, "http://ex\nample.org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("row", "host", "path", "rule", "start")])
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    out = url_filter.judge_urls(pages, rules, Workspace(spark))
    assert got(out, "row.page_id", "host", "path", "rule", "verdict") == Counter((i, *B.url(u, url_filter.RULES)) for i, u in rows)
    none = url_filter.judge_urls(pages, rules.limit(0), Workspace(spark), default="block")
    assert got(none, "rule", "verdict") == Counter({(None, "block"): len(rows)})
    assert url_filter.judge_urls(pages.limit(0), rules, Workspace(spark)).count() == 0


def chat_rows() -> list[tuple]:
    def chat(i, turns, start=0):
        return [(i, start + k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]

    return [*chat(1, ["a", "b"]), *chat(2, ["a", "b", "c"]), *chat(3, ["a", "b", "c"], start=7), *chat(4, ["a"]),
            *chat(5, ["a", "x"]), *chat(6, ["", None]), *chat(7, ["", None, "t" * 50_000]), *chat(8, ["b", "a"]),
            *chat(None, ["a", "b", "c"]), (9, None, None, "q"), (9, None, None, "q"), (10, None, None, "q"),
            *chat(11, [str(k) for k in range(60)]), *chat(12, [str(k) for k in range(59)])]


def test_chats(spark, monkeypatch):
    rows = chat_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("row", "pos", "n_turns", "run", "m1")])
    out = chats.rendered(chats.collapse_snapshots(turns, Workspace(spark)))
    kept = {r[0]: r[1] for r in out.groupBy("conv_id").count().collect()}
    assert kept == {2: 3, 5: 2, 7: 3, 8: 2, 9: 2, 11: 60}
    seven = [r["rendered"] for r in out.filter("conv_id = 7").orderBy("pos").collect()]
    assert seven[:2] == ["<|user|>\n\n<|end|>\n", "<|assistant|>\n\n<|end|>\n"] and len(seven[2]) > 50_000
    assert chats.collapse_snapshots(turns.limit(0), Workspace(spark)).count() == 0
    placed = spark.createDataFrame([(c, p, p + 1) for c in (1, None) for p in range(10)], "conv_id long, pos long, x long").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("row", "role", "text")])
    sums = got(chats.prefix_sums(placed, ["x"], run=3), "conv_id", "pos", "x")
    assert sums == Counter((c, p, (p + 1) * (p + 2) // 2) for c in (1, None) for p in range(10))


def test_pieces(spark, docs, none):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter(B.pieces([r[:2] for r in ROWS], model))
    assert got(pieces.encode_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    coded = pieces.encode_ids(docs)
    assert got(pieces.decode_ids(coded), "doc_id", "ids") == Counter((i, t or "") for i, t, _ in ROWS)
    table = pieces.ChunkTable(pieces.model_path(), most=2)      # a table that starts anew all the time
    for _, text, _ in ROWS:
        chunks = table.chunks(text or "")
        table.learn([chunks])
        assert pieces.id_list([table.table[c] for c in chunks])[0] == model.encode(text or "")
    assert pieces.encode_digests(none).count() == 0


def test_licenses(spark, docs, none):
    out = license_scan.scan_licenses(docs)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert got(out, *names) == Counter((i, *B.licenses(t)) for i, t, _ in ROWS)
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert license_scan.scan_licenses(none).count() == 0


def test_license_templates():
    def labels(text: str) -> set:
        a = license_scan.Automaton([("x", "[[this {{2}} is]] licensed under {{3}} license [[version 2]] only")])
        words = text.encode().split()
        return {k for k in range(len(words)) if a.longest(words, k)}

    assert labels("licensed under my own license only") == {0}
    assert labels("this fine work is licensed under license version 2 only") == {0, 4}
    assert labels("licensed under a b c d license only") == set()
    assert labels("licensed under a license version only") == set()
    with pytest.raises(ValueError):
        license_scan.Automaton([("x", "{{2}} words")])


def filled(template: str, rng: random.Random) -> tuple[list[str], list[int]]:
    """A text that the template accepts, and which of its words are mandatory."""
    words, fixed, inside = [], [], None
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            inside = rng.random() < 0.5
        elif part == "]]":
            inside = None
        elif inside is False:
            continue
        elif part.startswith("{{"):
            words += [f"w{rng.randrange(99)}" for _ in range(rng.randrange(int(part[2:-2]) + 1))]
        else:
            if inside is None:
                fixed.append(len(words))
            words.append(part)
    return words, fixed


@pytest.mark.parametrize("label", sorted(license_texts.TEXTS))
def test_whole_license_texts(label):
    rng = random.Random(label)
    a = license_scan.Automaton([(label, license_texts.TEXTS[label])])

    def accepted(words: list[str]) -> bool:
        tokens = [w.encode() for w in words]
        return any(t in a.first and a.longest(tokens, k) for k, t in enumerate(tokens))

    for _ in range(30):
        words, fixed = filled(license_texts.TEXTS[label], rng)
        assert len(fixed) > 60 and accepted(["x", *words, "y"])
        at = rng.choice(fixed)
        assert not accepted([*words[:at], "changed", *words[at + 1:]])
        assert not accepted([*words[:at], *words[at + 1:]]) or words[at] in words[at - 1:at] + words[at + 1:at + 2]


def test_license_score(spark):
    rng = random.Random(2)
    words, _ = filled(license_texts.TEXTS["zlib"], rng)
    rows = [(1, " ".join(words)), (2, "Copyright X. " + " ".join(words).upper() + " end"), (3, " ".join(words[:-1])), (4, "MIT license here now")]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(words)
    assert out[1] == ("zlib", 1.0) and out[2] == ("zlib", pytest.approx(n / (n + 3)))
    assert out[3] == ("", 0.0) and out[4] == ("mit", 0.5)


def vector_rows() -> list[tuple]:
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(3, 16))
    rows = []
    for k in range(240):
        v = centers[k % 3] + rng.normal(size=16) * (0.25 if k % 2 else 2)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2 if k % 7 else None))
    rows += [(1000, rows[3][1], 1), (1001, rows[3][1], 1), (1002, [x * 2 for x in rows[3][1]], 1), (None, rows[5][1], 1),
             (1003, None, 1), (1004, [], 1), (1005, [0.0] * 16, 1), (1006, [math.nan] + [1.0] * 15, 1),
             (1007, [None] + [1.0] * 15, 1), (1008, [math.inf] + [1.0] * 15, 1), (1009, [1.0, 2.0], 1), (1010, [1.0, 2.0], 1),
             (1011, [-x for x in rows[3][1]], 1), (1012, [1e30] * 16, 1), (1013, [1e-30] * 16, 1), (3, rows[3][1], 1)]
    return rows


@pytest.mark.parametrize(("per_cell", "block"), [(2000, 1024), (8, 1024), (8, 20), (2, 7)])
def test_vectors(spark, monkeypatch, per_cell, block):
    rows = vector_rows()
    fit = vector_dedup.fit_cells
    monkeypatch.setattr(vector_dedup, "fit_cells", lambda v: fit(v, per_cell=per_cell))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(
        "*", *[F.lit(1).alias(c) for c in ("row", "node", "copies", "vector", "e")])
    out = vector_dedup.representatives(vector_dedup.vector_groups(table, Workspace(spark), block=block))
    assert got(out, "vec_id", "n_links", "component_id", "kept") == Counter(B.vectors(rows))


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vector_dedup.vector_groups(table, Workspace(spark)).count() == 0


def test_simhash(spark, docs, none):
    out = simhash.simhash_groups(docs, Workspace(spark))
    have = got(out, "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert have == Counter(B.simhash([r[:2] for r in ROWS]))
    assert simhash.simhash_groups(none, Workspace(spark)).count() == 0
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == out.select("root").distinct().count()


def test_close_fingerprints(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for d in (1, 2, 3, 4, 5, 4):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints.append(q)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints} | {0})
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r[0]: r[1] for r in connected_components(links, Workspace(spark)).collect()}
    u = np.array(prints, np.int64).view(np.uint64)
    want = B.parts(len(u), [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4)])
    assert [roots.get(p, p) for p in prints] == [prints[w] for w in want]


@pytest.mark.parametrize("low", [True, False])
def test_many_fingerprints_that_share_a_half(low):
    rng = np.random.default_rng(9)
    other = rng.integers(0, 1 << 32, 3000, np.uint64)
    for d in (1, 2, 3, 4, 4, 5):
        masks = np.array([sum(1 << int(b) for b in rng.choice(32, d, replace=False)) for _ in range(300)], np.uint64)
        other = np.concatenate([other, rng.choice(other, 300) ^ masks])
    half = np.uint64(0x1234567)
    fp = np.unique(other << np.uint64(32) | half if low else half << np.uint64(32) | other)
    links = np.concatenate(list(simhash.group_links(fp, low, 4)))
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all()
    at = {int(f): i for i, f in enumerate(fp)}
    got = B.parts(len(fp), [(at[int(a)], at[int(b)]) for a, b in links])
    want = B.parts(len(fp), [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4)])
    assert got == want


def test_a_group_of_many_distinct_fingerprints_is_quick():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 32, 100_000, np.uint64))
    start = time.perf_counter()
    list(simhash.group_links(fp, False, 4))
    assert time.perf_counter() - start < 40


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(9, 9)]
    out = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    want = B.parts(500, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {n: want[n] for n in nodes}


@pytest.mark.parametrize(("gather", "part"), [(1_000_000, 2 << 20), (50, 700)])
def test_suffixes(spark, none, monkeypatch, gather, part):
    monkeypatch.setattr(suffix_dedup, "GATHER", gather)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup.blocks_of, "__defaults__", (part,))
    out = suffix_dedup.drop_repeats(frame(spark, UNIQUE), Workspace(spark))
    have = got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert have == Counter(B.repeats([r[:2] for r in UNIQUE]))
    assert suffix_dedup.drop_repeats(none, Workspace(spark)).count() == 0


def test_suffixes_of_odd_rows(spark):
    text = "".join(random.Random(6).choices("abcdef ", k=250))
    rows = [(1, text, None), (1, text, None), (None, text, None), (2, "q" + text, None)]
    out = suffix_dedup.drop_repeats(frame(spark, rows), Workspace(spark))
    assert got(out, "doc_id", "n_removed") == Counter({(1, 0): 2, (None, 250): 1, (2, 250): 1})


def test_suffixes_of_many_texts_under_one_id(spark):
    """Thousands of texts of one id with a passage in common, some of equal length."""
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=130))
    rows = [(7, "".join(rng.choices("ijklmnop", k=rng.choice([5, 5, 60]))) + passage + str(k), None) for k in range(4000)]
    rows += [(8, passage, None), (7, rows[0][1], None), (6, "z" + passage[:100], None)]
    out = suffix_dedup.drop_repeats(frame(spark, rows), Workspace(spark)).select("doc_id", "n_bytes", "n_removed").collect()
    # Texts of one id follow each other in the order of their hashes; equal rows are one document.
    keyed = spark.createDataFrame(list(set(rows)), "doc_id long, text string, s string").select("doc_id", *row_key("text"), "text").collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"], r["k1"], r["k2"]))
    plain = {r["text"]: tuple(x)[1:] for r, x in zip(order, B.repeats([(n, r["text"]) for n, r in enumerate(order)]), strict=True)}
    assert Counter(tuple(r) for r in out) == Counter((i, *plain[t][:2]) for i, t, _ in rows)
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup.drop_repeats(spark.createDataFrame([("x", "y")], "doc_id string, text string"), Workspace(spark))


def test_hashes_match_bytes():
    data = np.frombuffer(("xyz" * 50 + "abc" * 50 + "xyz" * 50).encode(), np.uint8)
    h = suffix_runs.Hashes(data).of(slice(0, len(data) - 31), slice(32, None))
    grams = [data[i:i + 32].tobytes() for i in range(len(h))]
    assert len(set(h.tolist())) == len(set(grams)) == len(set(zip(h.tolist(), grams, strict=True)))
