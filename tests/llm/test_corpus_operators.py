"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import bloom, byte_bpe, common, components, exact_dedup, fingerprint, mixing, ngram_join, pii, sharding, suffix_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Odd documents: null, empty and long texts, copies, near copies, shared passages, repeated ids."""
    rng = random.Random(4)
    base, passage, long = prose(rng, 300), prose(rng, 60), prose(rng, 9000)
    words = base.split()
    texts = [None, "", " ", "one", "two words", base, base, base.upper().replace("É", "é"), long, long + " x"]
    for k in (1, 2, 5, 40):
        w = list(words)
        for i in rng.sample(range(len(w)), k):
            w[i] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 100)} {passage} {prose(rng, 80)}" for _ in range(4)]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(20)] + ["ab " * 500, "ab " * 500]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, "one", "en", "s3", 3), (None, "no id", "en", "s1", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sharded(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    return [tuple(r) for r in sharding.shard(df.withColumnRenamed("shard", "name"), 5, 3).select("row_number", "shard", "slot").collect()]


def test_sharding(spark):
    rows = [(i, "a") for i in range(97)] + [(None, None)] * 2 + [(1, "hot")] * 9000
    got = sharded(spark, rows)
    n = len(rows)
    assert sorted(r for r, _, _ in got) == list(range(n))
    counts = Counter(s for _, s, _ in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(t for _, s, t in got if s == k) == list(range(counts[k])) for k in range(5))
    assert all(sharding.locate(r, n, 5, 3) == (s, t) and sharding.row_at(s, t, n, 5, 3) == r for r, s, t in got[::97])
    assert sharded(spark, rows[::-1]) and sharded(spark, []) == []
    assert [sorted(sharding.locate(r, n, 1, 0)[1] for r in range(n)) == list(range(n)) for n in (1, 2, 3, 5, 10, 50)] == [True] * 6


def test_exact_dedup(docs, empty):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[lower_az(r[1] or "")].append(r[0])
    for max_bits in (bloom.MAX_BITS, 1 << 16):
        got = exact_dedup.mark(docs.withColumnRenamed("lang", "kept"), max_bits=max_bits).collect()
        assert len(got) == len(rows)
        for r in got:
            own = groups[lower_az(r.text or "")]
            assert (r.keep_id, r.group_size) == (max((i for i in own if i is not None), default=None), len(own))
            assert r.text_sha256 == hashlib.sha256(lower_az(r.text or "").encode()).hexdigest()
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.distinct(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark(empty).count() == 0


def test_bloom_pick(spark, docs):
    ids = spark.createDataFrame([(5,), (7,), (999,)], "doc_id long")
    assert sorted(r.doc_id for r in bloom.pick(docs, ids, "doc_id").collect()) == [5, 7]
    assert bloom.without(docs, ids, "doc_id").count() == docs.count() - 2


def test_mixing(docs, empty):
    sized = docs.withColumn("size", mixing.words(docs.text)).select("doc_id", "source", "size")
    got = mixing.take(sized).collect()
    rows = corpus()
    assert len(got) == len(rows)
    total, size = sum(r.size for r in got), defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert sum(r.taken for r in got) == int(1.5 * total)
    assert all(0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] for r in got)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate([*sorted(s for s in size if s), None])}
    left, free, target = 1.5 * total, set(size), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    longest = max(r.size for r in got)
    for s in size:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= longest + 1
    assert mixing.take(empty.withColumn("size", mixing.words(empty.text)).select("doc_id", "source", "size")).count() == 0
    none = docs.where("text IS NULL").withColumn("size", mixing.words(docs.text)).select("doc_id", "source", "size")
    assert [(r.taken, r.target) for r in mixing.take(none).collect()] == [(0, 0.0)]


def brute_components(rows, rule):
    sets = {}
    for i, t in rows:
        w = lower_az(t or "").encode().split()
        n = rule.words
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for k, (i, a) in enumerate(flat):
        for j, b in flat[k + 1 :]:
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (max(len(s) for s in ss), find(i)) for i, ss in sets.items()}


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.CONTRACT])
def test_ngram_join(spark, docs, empty, rule):
    df = docs.where("doc_id IS NOT NULL")
    got = ngram_join.join(df, rule).collect()
    assert len(got) == df.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components([(r[0], r[1]) for r in corpus() if r[0] is not None], rule)
    if rule == ngram_join.CONTRACT:
        assert ngram_join.join(empty, rule).count() == 0
    else:
        kept = ngram_join.representatives(df, rule)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got}


def test_ngram_join_large_plots(spark, monkeypatch):
    """Leaves so small that a plot needs many of them."""
    monkeypatch.setattr(ngram_join, "LEAF", 1 << 11)
    monkeypatch.setattr(ngram_join, "LEAF_SETS", 16)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    rng = random.Random(9)
    base = [prose(rng, 1) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = f"w{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.CONTRACT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, ngram_join.CONTRACT)


def test_ngram_join_shuffles_a_text_once(spark, monkeypatch):
    """Members of small and of large plots are looked up apart, each with its own texts only."""
    monkeypatch.setattr(ngram_join, "LEAF", 1 << 11)
    monkeypatch.setattr(ngram_join, "LEAF_SETS", 16)
    asked, pick = [], bloom.pick
    monkeypatch.setattr(bloom, "pick", lambda df, ids, id: asked.append(ids) or pick(df, ids, id))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"x{i}", *words[i % 50 :]])) for i in range(120)] + [(1000 + i, "a few other words in a short text that is here " + "twice " * (1 + i)) for i in range(2)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.CONTRACT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, ngram_join.CONTRACT)
    kinds = [{r.leaf >= 0 for r in ids.collect()} for ids in asked]
    assert True in set().union(*kinds) and all(len(k) < 2 for k in kinds)
    keys = [r.key for ids in asked for r in ids.collect()]
    assert len(keys) == len(set(keys))


@pytest.mark.parametrize("per_task", [1 << 20, 70])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "PER_TASK", per_task)  # 70: several tasks, then rounds
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200), (None, 5), (7, None)] + [(500, 500 + rng.randint(1, 90)) for _ in range(100)] + [(-3, -9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and 200 not in got and got[-3] == -9 and set(got.values()) == {0, 100, 500, -9}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, empty):
    df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    got = {r.doc_id: r for r in fingerprint.compare_edited(df).collect()}
    order = sorted(texts, reverse=True)
    follow = dict(zip(order, order[1:] + order[:1]))
    assert set(got) == set(texts)
    for i, r in got.items():
        own, other = texts[i], texts[follow[i]]
        h = len(own) // 2
        edited = own[: len(own) - h] + other[:h]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == fingerprint.fingerprints([own, edited])
        assert 0 <= r.near_edited <= 1 and r.near_next == pytest.approx(fingerprint.likeness(r.fingerprint, got[follow[i]].fingerprint), abs=1e-8)
    for r in got.values():
        for n, other in ((r.bands_edited, r.edited_fingerprint), (r.bands_next, got[follow[r.doc_id]].fingerprint)):
            assert n == len(set(fingerprint.band_keys(r.fingerprint, 32, 8)) & set(fingerprint.band_keys(other, 32, 8)) - ({f"0:{r.fingerprint}"} if len(r.fingerprint) >= 64 else set()))
    assert got[5].fingerprint == got[6].fingerprint and got[0].fingerprint == ""
    assert fingerprint.likeness(got[5].fingerprint, got[10].fingerprint) > 0.8 > fingerprint.likeness(got[5].fingerprint, got[20].fingerprint)
    assert fingerprint.compare_edited(empty).count() == 0
    assert fingerprint.compare_edited(docs).count() == docs.count()
    assert (6, 5) in {(r.doc_id, r.near_id) for r in fingerprint.near(df).collect()}


def test_near_fingerprints(spark):
    """Near copies below an unlike text with the same header, and the recall of the bands near the bound."""
    rng = random.Random(9)
    header, rows = prose(rng, 200), []
    for i in range(40):
        body = prose(rng, 60)
        rows += [(1000 + 2 * i, f"{header} {body}"), (1001 + 2 * i, f"{header} {body[:-4]}")]
    for i in range(60):
        words = prose(rng, 150).split()
        rows.append((2 * i + 2000, " ".join(words)))
        for at in rng.sample(range(150), rng.randint(1, 3)):
            words[at] = "changed"
        rows.append((2 * i + 2001, " ".join(words)))
    prints = fingerprint.fingerprints([t for _, t in rows])
    least = {f: i for (i, _), f in reversed(list(zip(rows, prints)))}
    ones = [(i, f) for f, i in least.items()]
    alike = {(i, least[f]) for (i, _), f in zip(rows, prints) if i != least[f]} | {(j, i) for i, f in ones for j, g in ones if j > i and fingerprint.likeness(f, g) >= 0.8}
    found = {(r.doc_id, r.near_id) for r in fingerprint.near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= alike
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in found:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert sum(find(a) == find(b) for a, b in alike) >= 0.98 * len(alike)


def test_suffix_dedup(docs, empty):
    rows = [(r[0], lower_az(r[1] or "").encode().split()) for r in corpus() if r[0] is not None]
    windows = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add(i)
    expected = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - 49):
            if len(windows[tuple(w[k : k + 50])]) > 1:
                expected[i].update(range(k, k + 50))
    found = defaultdict(set)
    for r in suffix_dedup.passages(docs.withColumnRenamed("lang", "other_id")).collect():
        assert r.n_words >= 50 and r.other_id != r.doc_id
        found[r.doc_id].update(range(r.start_word, r.end_word))
    assert found == expected
    assert suffix_dedup.passages(empty).count() == 0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_suffix_dedup_of_a_frequent_line(spark, empty, batch):
    """Passages end in a line of all documents that every window selects; what follows differs, so other documents sort between the partners."""
    rng = random.Random(8)
    line = min((prose(rng, 10) for _ in range(3000)), key=lambda t: int(suffix_dedup.kgrams(next(suffix_dedup._per_text([t.encode()])))[0]))
    before = [prose(rng, 40) for _ in range(30)]
    texts = [f"{prose(rng, 20)} {before[i % 30]} {line} {prose(rng, 60)}" for i in range(60)]
    texts += [f"{prose(rng, 60)} {line} {prose(rng, 60)}" for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in suffix_dedup.passages(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert found == {(i, 20, 70, (i + 30) % 60) for i in range(60)}


def test_warc(spark, tmp_path):
    html = ["<p>\r\n\r\nWARC/1.0\r\n</p>", None, "", "é" * 1000, "same", "same", "same"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(5, "http://y", "same"), (None, None, "alone")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"), min_bytes=1)
    got = warc.assemble(warc.read(spark, str(tmp_path / "a"))).collect()
    assert len(got) == 9
    kinds = Counter((r.metadata[0].fields["page-id"], r.response.type) for r in got)
    assert kinds == {("0", "response"): 1, ("1", "response"): 1, ("2", "response"): 1, ("3", "response"): 1, ("4", "revisit"): 1, ("5", "revisit"): 2, ("6", "response"): 1, ("null", "response"): 1}
    assert {r.response.refers_to for r in got if r.response.type == "revisit"} == {"<urn:capture:6.0:response>"}
    assert {bytes(r.response.payload).decode() for r in got if r.response.type == "response"} == {h or "" for h in html} | {"alone"}
    assert all(r.response.digest == f"sha1:{r.response.payload_digest}" for r in got if r.response.type == "response")
    assert all([x.concurrent_to for x in (*r.request, *r.metadata)] == [r.capture] * 2 and r.others == [] for r in got)
    warc.write(pages.where("false"), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_byte_bpe(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_path(), "rb") as f:
        codec = byte_bpe.Codec(f.read(), kept_pieces=100)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "1", "²", "!", " ", "é", "漢", "\0", "😀", "　", "r", "l", "v", "e", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "x" * 3000, " " * 999, "'" * 300, "é" * 900]
    ids = codec.encode(texts)
    assert ids == reference.encode_ordinary_batch(texts)
    assert [codec.decode(i) for i in ids] == [t.encode() for t in texts]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(r[0], len(x), sha(",".join(map(str, x)).encode()), sha((r[1] or "").encode())) for r in corpus() for x in [reference.encode_ordinary(r[1] or "")]}
    encoded = byte_bpe.encode(docs)
    assert sorted(bytes(r.bytes) for r in byte_bpe.decode(encoded).collect()) == sorted((r[1] or "").encode() for r in corpus())
    assert all(len(r.ids) == len(r.offsets) and r.offsets[:1] in ([], [0]) for r in encoded.collect())
    assert byte_bpe.digests(empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    return sorted(((m.start(), m.end(), k) for k in pii.KINDS for m in re.finditer(PATTERNS[k], t) if k == "email" or pii.valid(k, m.group())), key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base():
    rng = random.Random(3)
    parts = ["@", ".", "a", "b-", "1", "12", "+1", "(", "555", " ", "-", "%", "_", "4111 1111 1111 1111", "10.0.0.1", "é"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]:
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_tagger(spark, empty):
    rng = random.Random(6)
    make = {"email": lambda: f"{prose(rng, 1).replace('é', 'e')}{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.org", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "phone": lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", "card": lambda: "4111 1111 1111 1111"}
    rows = [(i, f"{prose(rng, 12)} {make[pii.KINDS[i % 4]]()} {prose(rng, 12)}") for i in range(240)] + [(900, None), (901, ""), (902, prose(rng, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tagger = pii.train(pii.sample_windows(df))
    kept = [(t, pii.base_spans(t)) for _, t in rows[:240]]
    found = pii.tag_spans(tagger, [t for t, _ in kept])
    assert sum(s in f for (_, b), f in zip(kept, found) for s in b) >= 0.9 * sum(len(b) for _, b in kept)
    hidden = [pii.respell(t, b, ("email", "@", " @ ")) for t, b in kept if b and b[0][2] == "email"]
    added = pii.spans(tagger, [t for t, _ in hidden])
    assert sum(any(a < e and s < b for a, b, k in every if k == "email") for (_, every), (_, own) in zip(added, hidden) for s, e, _ in own) > 0.8 * len(hidden)
    for r in pii.digests(df, tagger=tagger).collect():
        base = plain_spans(dict(rows)[r.doc_id] or "")
        written = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and (r.n_email, r.n_card) == (sum(k == "email" for _, _, k in base), sum(k == "card" for _, _, k in base))
        assert set(written.split(",")) <= set(r.spans.split(","))
    assert pii.find(df, tagger=None).where("doc_id < 240 AND size(base) = 0").count() == 0
    assert pii.digests(empty).count() == 0 and pii.train([]) is None


def test_pii_gradients():
    rng = np.random.default_rng(0)
    t = pii.Tagger(hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, pii.N_CLASSES, (6, 2)), rng.integers(0, pii.N_TAGS, (6, 2))
    _, grads = t.gradients(x, y)
    for name in t.p:
        at = tuple(int(rng.integers(0, n)) for n in t.p[name].shape)
        kept, sides = t.p[name][at], []
        for d in (1e-3, -1e-3):
            t.p[name][at] = kept + d
            sides.append(t.gradients(x, y)[0])
        t.p[name][at] = kept
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(grads[name][at], abs=2e-3)


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    bad, rows, labels = ["scumbag", "trashface", "idiotic"], [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 5 == 0:
            for k in rng.sample(range(60), 4):
                words[k] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "Sсumbag tra5hface 1diotic"), (1003, "fine words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (0, 0, 0), (5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400))
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0]
    again = toxicity.fit(df, known)
    assert (again.words, again.beginnings, again.coefficients) == (model.words, model.beginnings, model.coefficients)
    assert toxicity.score(docs, model, docs.columns).count() == docs.count()
    assert toxicity.score(empty, toxicity.fit(empty, known.where("false"))).count() == 0
    phrase = toxicity.Model(words={"kill": 5.0}, exceptions={"kill process"}, coefficients=(-3.0, 2.0, 0.0))
    a = phrase.automaton()
    assert phrase.score(["kill", "them"], a) > 0.3 > phrase.score(["kill", "process"], a)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
