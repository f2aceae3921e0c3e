"""Operators against plain rewritings of what they compute, and figures that the README states."""

import base64
import gzip
import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import byte_bpe, fingerprint, pii, suffix_dedup, toxicity, warc


def naive_hits(model, words):
    out = {}
    for i, w in enumerate(words):
        weights = [v for k, v in model.beginnings.items() if w.startswith(k)] + [model.words[x] for x in (w,) if x in model.words]
        around = ({f"{words[i - 1]} {w}"} if i else set()) | ({f"{w} {words[i + 1]}"} if i + 1 < len(words) else set())
        if weights and not around & model.exceptions:
            out[i] = max(weights)
    return list(out.values())


def test_lexicon_matches_like_plain_loops():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    for _ in range(60):
        model = toxicity.Model({word(): rng.random() + 0.1 for _ in range(6)}, {word(): rng.random() + 0.1 for _ in range(4)}, {f"{word()} {word()}" for _ in range(30)}, (-2.0, 1.5, 0.5))
        a = model.automaton()
        for _ in range(20):
            words = [word() for _ in range(rng.randint(0, 40))]
            hits = naive_hits(model, words)
            assert sorted(w for _, w in model.hits(words, a)) == sorted(hits)
            s = sum(hits)
            x, y = math.log1p(s), math.log1p(100 * s / max(1, len(words)))
            assert model.score(words, a) == pytest.approx(1 / (1 + math.exp(2.0 - 1.5 * x - 0.5 * y)))


def scramble(x):
    m = (1 << 64) - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & m
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & m
    return x ^ (x >> 33)


def naive_fingerprint(text):
    """The walk, one step at a time."""
    held, j = [], 0
    for c in fingerprint.classes(text).tolist():
        while True:
            held.append(c)
            place = j % 4096
            j += 1
            if place % 64 == 0 or scramble(c * 4096 + place + 0x5EED) & 1:
                break
    steps = [s for s in fingerprint._tables()["steps"].tolist() if s < len(held)]
    return "".join("0123456789abcdef"[scramble((s * 257 + held[s]) & ((1 << 64) - 1)) & 15] for s in steps)


def test_fingerprints_like_plain_walks():
    rng = random.Random(7)
    texts = ["", "a", "é" * 5, "漢字" * 300] + ["".join(rng.choice("abcdef é漢\n") for _ in range(rng.randint(1, 900))) for _ in range(70)]
    assert fingerprint.fingerprints(texts) == [naive_fingerprint(t) for t in texts]


def joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return find


def test_recall_of_near_fingerprints(spark):
    """Of all pairs of documents with a likeness of 0.8 or more, by brute force, nine in ten at least are connected by the links found; no link is wrong."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 700").collect()]
    prints = dict(zip([i for i, _ in rows], fingerprint.fingerprints([t for _, t in rows])))
    alike = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if 0.5 < (len(prints[a]) + 1) / (len(prints[b]) + 1) < 2 and fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    links = [(r.doc_id, r.near_id) for r in fingerprint.near(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(fingerprint.likeness(prints[a], prints[b]) >= 0.8 and b < a for a, b in links)
    find = joined(links)
    together = sum(find(a) == find(b) for a, b in alike)
    assert len(alike) > 30 and together >= 0.9 * len(alike), (together, len(alike))


def test_passages_of_real_documents(spark):
    """Every repeated window of 50 words, by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r.doc_id: (r.text or "").translate(lower).encode().split() for r in df.collect()}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders[hash(tuple(w[k : k + 50]))].add(i)
    expected = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(holders[hash(tuple(w[k : k + 50]))]) > 1:
                expected[i].update(range(k, k + 50))
    found = defaultdict(set)
    for r in suffix_dedup.passages(df).collect():
        found[r.doc_id].update(range(r.start_word, r.end_word))
    assert sum(map(len, expected.values())) > 50_000
    assert found == expected


def test_viterbi_like_all_paths():
    rng = np.random.default_rng(5)
    t = pii.Tagger(hidden=3, seed=2)
    t.p = {k: v * 4 for k, v in t.p.items()}
    x = rng.integers(0, pii.N_CLASSES, (6, 4))
    e = t.emissions(np.ascontiguousarray(x.T))[0]
    for row, tags in enumerate(t.decode(x).tolist()):
        worth = lambda path: t.p["s"][path[0]] + sum(e[k, row, c] for k, c in enumerate(path)) + sum(t.p["t"][a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert worth(tags) == pytest.approx(max(worth(p) for p in itertools.product(range(pii.N_TAGS), repeat=4)), abs=1e-4)


def test_windows_tile_a_text():
    """Labels of a long text are each window's own middle; a text in one window is decoded as a whole."""
    t = pii.Tagger(hidden=4, seed=3)
    text = "mail a1@b2.org now " * 30
    c = pii.char_classes(text)
    middles = [t.decode(pii._pad(c, s)[None, :])[0][pii.MARGIN : pii.MARGIN + pii.STRIDE] for s in pii._windows(len(text))]
    tags = np.concatenate(middles)[: len(text)]
    spans = {(a, b, k) for a, b, k in pii.tag_spans(t, [text])[0]}
    marked = np.zeros(len(text), bool)
    for a, b, _ in spans:
        marked[a:b] = True
    assert np.array_equal(marked, tags > 0)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.train(pii.sample_windows(docs.where("doc_id % 2 = 0"))), pii.sample_windows(docs.where("doc_id % 2 = 1"))


@pytest.mark.parametrize("rule", pii.SPELLINGS)
def test_recall_of_added_spans(trained, rule):
    """Spans of held-out documents in spellings that the patterns do not cover."""
    tagger, windows = trained
    texts, wanted = [], []
    for w in windows:
        base = pii.base_spans(w)
        text, labelled = pii.respell(w, base, rule)
        own = [s for s in labelled if s[2] == rule[0] and pii.valid(s[2], text[s[0] : s[1]])]
        if text != w and own:
            texts.append(text)
            wanted.append(own)
    n = found = 0
    for own, text, (base, every) in zip(wanted, texts, pii.spans(tagger, texts)):
        for a, b, k in own:
            if not any(k == kind and s < b and a < e for s, e, kind in base):
                n += 1
                found += any(k == kind and s < b and a < e for s, e, kind in every)
    assert n > 30 and found >= 0.9 * n, (found, n)


def test_nothing_added_to_clean_texts(trained, spark):
    tagger, _ = trained
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sum(len(every) - len(base) for base, every in pii.spans(tagger, texts)) <= 5


def capture(block, kind=b"response", more=b"", content=b"application/http; msgtype=response"):
    return b"WARC/1.0\r\nWARC-Type:" + kind + b"\r\nwarc-record-id: <urn:x>\r\nContent-Type: " + content + more + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_refuses_broken_archives():
    body = b"x" * 1000
    good = capture(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body)
    digest = base64.b32encode(hashlib.sha1(body).digest())
    assert [r["payload_bytes"] for r in warc.parse(good * 2)] == [1000, 1000]
    assert [r["payload"] for r in warc.parse(capture(b"no head at all"))] == [b"no head at all"]
    assert [r["payload"] for r in warc.parse(capture(b"\r\n\r\n192.0.2.1\r\n", content=b"text/dns"))] == [b"\r\n\r\n192.0.2.1\r\n"]
    assert list(warc.parse(capture(b"HTTP/1.1 200 OK\r\n\r\n" + body, more=b"\r\nWARC-Payload-Digest: sha1:" + digest)))[0]["payload_digest"] == digest.decode()
    assert list(warc.parse(b"")) == []
    packed = gzip.compress(good) + gzip.compress(good)
    assert len(list(warc.parse(packed))) == 2
    broken = [good[:-500], good + good[:-2], packed[:-9], packed[: len(packed) // 2 + 5], good.replace(b"Content-Length: 1", b"Content-Length: 2"), good.replace(b"Content-Length: 1", b"Content-Length: 0"), b"nonsense\r\n\r\n", good.replace(b"Content-Length", b"Other")]
    broken.append(capture(b"HTTP/1.1 200 OK\r\n\r\ny" + body, more=b"\r\nWARC-Payload-Digest: sha1:" + digest))
    for data in broken:
        with pytest.raises(ValueError):
            list(warc.parse(data))


def test_warc_blocks_of_separators():
    """Payloads of nothing but line ends, in every length."""
    rng = random.Random(2)
    blocks = [bytes(rng.choice(b"\r\n") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [b"\r\n" * k for k in range(8)]
    data = b"".join(capture(b, content=b"text/plain") for b in blocks)
    assert [r["payload"] for r in warc.parse(data)] == blocks


def test_warc_files(spark, tmp_path):
    good = capture(b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 5000)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good * 3) + gzip.compress(good))
    (tmp_path / "b.warc").write_bytes(good * 2)
    assert warc.read(spark, str(tmp_path)).groupBy("payload_bytes").count().collect() == [(5000, 6)]
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(good * 3)[:-20])
    with pytest.raises(Exception, match="(?i)unexpected end|EOF|cut off|does not end"):
        warc.read(spark, str(tmp_path)).count()


def test_one_record_is_held_at_a_time():
    """An archive of a gigabyte passes through in pieces."""
    piece = b"p" * 1_000_000
    head, *_ = capture(b"HTTP/1.1 200 OK\r\n\r\n" + piece).split(b"\r\n\r\n")
    flow = (x for _ in range(1000) for x in (head, b"HTTP/1.1 200 OK", piece))
    assert sum(len(block) for _, block in warc.cut_records(flow)) == 1000 * (1_000_000 + 19)


def test_slices_of_bytes():
    rng = random.Random(6)
    raw = np.frombuffer(bytes(rng.choice(b"ab\0") for _ in range(5000)), np.uint8)
    begin = np.sort(np.array([rng.randint(0, 4900) for _ in range(800)]))
    end = begin + np.array([rng.randint(1, 24) for _ in range(800)])
    places, of = byte_bpe.distinct_slices(raw, begin, end)
    text = lambda i: raw[begin[i] : end[i]].tobytes()
    assert all(text(i) == text(places[of[i]]) for i in range(800))
    short = [i for i in range(800) if end[i] - begin[i] <= 15]
    assert len({of[i] for i in short}) == len({text(i) for i in short})
