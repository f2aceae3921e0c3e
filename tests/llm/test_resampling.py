"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

from factloom.llm import resampling

WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, percent, least, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for _, text in rows for f in features(text, n)) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in docs:
        g = [gain(of(f)) for f in features(text, n)]
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(g) // len(g) if g else 0
        out.append((i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))[: percent * sum(r[1] >= least for r in out) // 100]
    places = {}
    for k, r in enumerate(fit, 1):
        places.setdefault(r, []).append(k)
    return sorted(((*r, places[r].pop(0) if places.get(r) else None) for r in out), key=repr)


DOCS = [(i, " ".join(f"W{(i * k) % 17} élan-{k % 5}" for k in range(i % 40))) for i in range(120)] + [(7, "W1 W2"), (7, "W1 W2"), (None, "a b c " * 20), (None, None), (500, ""), (501, "x" * 300_000), (502, "one, two;" * 40_000)]
TARGET = [(0, "W1 W2 W3 élan"), (1, None), (2, "W1 W1")]


def frames(spark):
    return spark.createDataFrame([(*r, "s", 1) for r in DOCS], "doc_id long, text string, score string, bucket int"), spark.createDataFrame(TARGET, "item_id long, text string")


def test_against_python(spark):
    docs, target = frames(spark)
    for n, buckets, percent, least, seed in ((1, 10_000, 10, 20, 2024), (3, 50, 33, 1, 7)):
        got = resampling.ranked(resampling.score(docs, resampling.gains(docs, target, n=n, buckets=buckets), n=n, buckets=buckets, seed=seed), percent=percent, min_features=least)
        assert got.columns == ["doc_id", *resampling.SCORED, "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(DOCS, TARGET, n, buckets, percent, least, seed)


def test_drawn_rows_are_as_they_were(spark):
    docs, target = frames(spark)
    got = resampling.draw(docs, target)
    assert got.columns == docs.columns
    want = [r for r in brute(DOCS, TARGET, 1, 10_000, 10, 20, 2024) if r[4]]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in want)
    assert all(r.score == "s" for r in got.collect())


def test_empty_tables(spark):
    docs, target = frames(spark)
    none = docs.limit(0)
    assert resampling.ranked(resampling.score(none, resampling.gains(none, target))).collect() == []
    got = resampling.ranked(resampling.score(docs, resampling.gains(docs, target.limit(0))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(DOCS, [], 1, 10_000, 10, 20, 2024)
