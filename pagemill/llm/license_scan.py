"""License texts found by templates with optional and replaceable regions, run as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, raw, ship, slices
from .license_texts import TEMPLATES

ship(__name__)
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """All templates as one non-deterministic automaton over tokens.

    A state is a place in a template; ``step[state]`` says which token leads on, places behind
    optional regions are reached without a token, and a replaceable region of n words is n
    places that any token passes. Mandatory tokens have to match exactly.
    """

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.word: list[bytes | None] = []          # the token that leaves a place; None: any
        self.skip: list[list[int]] = []             # places reached from here without a token
        self.label: dict[int, str] = {}             # accepting places
        self.first: dict[bytes, list[int]] = {}     # places entered by a first token
        for label, text in templates:
            begin = len(self.word)
            opened: list[int] = []
            for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", text):
                if part == "[[":
                    opened.append(len(self.word))
                    self._place(None, any_word=False)
                elif part == "]]":
                    self._place(None, any_word=False)
                    self.skip[opened.pop()].append(len(self.word) - 1)
                elif part.startswith("{{"):
                    n, at = int(part[2:-2]), len(self.word)
                    for _ in range(n):
                        self._place(None, any_word=True)
                        self.skip[-1].append(at + n)
                else:
                    self._place(part.encode())
            self._place(None, any_word=False, last=True)
            self.label[len(self.word) - 1] = label
            for s in self.closure([begin]):
                if self.word[s] is None and s in self.label or self.any[s]:
                    raise ValueError(f"template {label} may begin with any word")
                if self.word[s] is not None:
                    self.first.setdefault(self.word[s], []).append(s)

    any: list[bool]

    def _place(self, word: bytes | None, any_word: bool = False, last: bool = False) -> None:
        if not self.word:
            self.any = []
        self.word.append(word)
        self.any.append(any_word)
        # A mark place leads to the next one without a token.
        self.skip.append([len(self.word)] if word is None and not any_word and not last else [])

    def closure(self, places: list[int]) -> list[int]:
        out, todo = set(), list(places)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skip[s]
        return sorted(out)

    def longest(self, words: list[bytes], at: int) -> dict[str, int]:
        """Labels accepted by runs of words from ``at``, with the end of the longest run."""
        now, found = self.first.get(words[at], ()), {}
        now = self.closure([s + 1 for s in now])
        end = at + 1
        while now:
            for s in now:
                if s in self.label:
                    found[self.label[s]] = end
            if end == len(words):
                break
            w = words[end]
            now = self.closure([s + 1 for s in now if self.any[s] or self.word[s] == w])
            end += 1
        return found


def scan(text: bytes, phrases: Automaton, templates: Automaton, hint: re.Pattern) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    low = text.lower()
    words = TOKEN.findall(low)
    if not hint.search(low):
        return len(words), 0, None, None, "", "", 0.0
    starts, base, labels, covered, upto = [], set(), set(), 0, 0
    for at, w in enumerate(words):
        if w in phrases.first:
            hits = phrases.longest(words, at)
            if hits:
                starts += [at] * len(hits)
                base |= set(hits)
                covered += max(0, max(hits.values()) - max(upto, at))
                upto = max(upto, *hits.values())
        if w in templates.first:
            hits = templates.longest(words, at)
            if hits:
                labels |= set(hits)
                covered += max(0, max(hits.values()) - max(upto, at))
                upto = max(upto, *hits.values())
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), covered / len(words))


OUT = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
       "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan_batches(phrases: dict[str, str], templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Automaton([(label, phrase) for phrase, label in phrases.items()])
        more = Automaton([(label, t) for label, ts in templates.items() for t in ts])
        # A text without the first two words of any phrase or a first word of any template holds none.
        hint = re.compile(b"|".join(sorted({re.escape(w) for w in [*base.first, *more.first]})) or b"(?!)")
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                rows = [scan(t, base, more, hint) for t in raw(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(OUT.values())]],
                    names=["doc_id", *OUT])

    return run


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
                  templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    Texts are A-Z lower-cased whole; words are runs of ASCII letters and digits and of characters
    beyond ASCII. ``n_base`` counts all places where a base phrase stands, ``first_word`` and
    ``last_word`` are their smallest and largest start. ``labels`` adds those of templates that the
    text accepts anywhere; ``score`` is the share of words inside phrases and accepted templates.

    Null and empty texts have no words, empty labels, null places and score 0. Null ids and
    repeated rows pass like others; an empty table gives an empty one. Templates end by themselves,
    so a very long text costs its length times the few places active at once. One map stage.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    schema = own.select("doc_id", *[F.lit(None).cast(kinds[k]).alias(n) for n, k in OUT.items()]).schema
    return own.mapInArrow(scan_batches(phrases, templates), schema)


def op7(spark, folder: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{folder}/documents.parquet"))
