"""The contracts of the queries, computed plainly in Python; what the Spark results are held against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def targets(size: dict, weights=(5, 2, 1), repeat: int = 3) -> dict:
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(size.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > repeat * size[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(repeat * size[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def lines(docs: list[tuple], least: int = 40, documents: int = 5) -> list[tuple]:
    def key(line: str) -> str:
        return line.strip(BLANK).translate(ASCII)

    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        keep = [x for x in own if not (len(holders.get(key(x), ())) >= documents and max(holders[key(x)]) != i)]
        out.append((i, len(own), len(own) - len(keep), sha("\n".join(keep))))
    return out


def fingerprint(text: str | None, width: int = 4) -> int:
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def parts(n: int, links) -> list[int]:
    """The part of every member, by the smallest member."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(docs: list[tuple], bits: int = 4) -> list[tuple]:
    fp = np.array([fingerprint(t) for _, t in docs], np.uint64)
    links = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= bits) if j > i]
    part = parts(len(fp), links)
    least: dict = {}
    for (i, _), p in zip(docs, part, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    return [(i, f"{int(f):016x}", least.get(p)) for (i, _), f, p in zip(docs, fp, part, strict=True)]


def pieces(docs: list[tuple], model) -> list[tuple]:
    out = []
    for i, text in docs:
        ids = model.encode(text or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    return out


def url(text: str | None, rules: list[tuple[str, str]]) -> tuple:
    if text is None or "://" not in text:
        return "", "", None, "allow"
    rest = text.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(ASCII)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    hits = [(k, label) for phrase, label in PHRASES.items() for p in [phrase.split()]
            for k in range(len(words)) if words[k:k + len(p)] == p]
    at = [k for k, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in hits})))


def repeats(docs: list[tuple], width: int = 100) -> list[tuple]:
    """Documents are taken by id; null ids last."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, (d[1] or "").encode())):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - width + 1):
            window = data[at:at + width]
            if window in seen:
                gone[at:at + width] = True
            else:
                seen.add(window)
        spans = int(np.diff(np.concatenate([[0], gone[:-1].astype(int)])).clip(0).sum())
        keep = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out.append((i, len(data), int(gone.sum()), spans, sha(keep)))
    return out


def vectors(rows: list[tuple], least: float = 0.93) -> list[tuple]:
    """rows: (vec_id, embedding, label)"""
    n, links, degree = len(rows), [], [0] * len(rows)

    def sound(v) -> bool:
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v) else None for _, v, _ in rows]
    groups = defaultdict(list)
    for k, (_, _, label) in enumerate(rows):
        if unit[k] is not None and label is not None:
            groups[(label, len(unit[k]))].append(k)
    for ks in groups.values():
        u = np.array([unit[k] for k in ks])
        for a, b in zip(*np.nonzero(u @ u.T >= least), strict=True):
            if a != b:
                degree[ks[a]] += 1
                if a < b:
                    links.append((ks[a], ks[b]))
    least_id: dict = {}
    part = parts(n, links)
    for k, p in enumerate(part):
        if rows[k][0] is not None:
            least_id[p] = min(rows[k][0], least_id.get(p, rows[k][0]))
    return [(rows[k][0], degree[k], least_id.get(part[k]), rows[k][0] is not None and rows[k][0] == least_id.get(part[k]))
            for k in range(n)]


def word_runs(words: list, least: int = 6, times: int = 4) -> list[tuple]:
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        at = 0
        while at < n - q:
            start = at
            while at < n - q and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            part = words[start:start + length]
            if length >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((start, length, q))
            at += at == start
    return sorted(found)


def periodic(docs: list[tuple]) -> list[tuple]:
    out = []
    for i, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = word_runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        out.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
                    sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def unigrams(docs: list[tuple]) -> list[tuple]:
    texts = [(i, [*WORD.findall((t or "").translate(ASCII)), ""], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2)
             for i, t in docs]
    count = Counter(w for _, words, held in texts if not held for w in words)
    total = sum(count.values())
    return [(i, held, len(words), sum(count[w] > 0 for w in words), total,
             sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words)) for i, words, held in texts]


def resampled(docs: list[tuple], target: list, share: int = 25, least: int = 20) -> list[tuple]:
    def hashed(text: str | None) -> tuple[int, list[int]]:
        words = ALNUM.findall((text or "").translate(ASCII))
        runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    own, wanted = [hashed(t) for _, t in docs], [hashed(t) for t in target]
    s, t = (Counter(b for _, x in part for b in x) for part in (own, wanted))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    rows = []
    for (i, _), (n, x) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * share // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]
