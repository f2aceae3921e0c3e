"""The trie of conversation prefixes against a plain one in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from factloom.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """conversations: id to its list of (role, text)."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(conversations):
        t = tuple(conversations[c])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                kids[t[: d - 1]].add(t[:d])
        ends[t].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()), key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def table(spark, conversations, rng):
    flat = [(c, k, *turn) for c, ts in conversations.items() for k, turn in enumerate(ts)]
    rng.shuffle(flat)
    return spark.createDataFrame(flat, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    words = ["a", "bé", "ccc"][: 1 + seed % 3]
    known = {rng.randrange(-50, 10**6): [(rng.choice("us"[: 1 + seed // 2]), rng.choice(words)) for _ in range(1 + min(int(rng.expovariate(0.3)), 25))] for _ in range(300)}
    assert rows(prefix_trie.trie(table(spark, known, rng))) == brute(known)


def test_copies_long_ones_and_prefixes(spark):
    rng = random.Random(9)
    long = [("user", f"turn {k}") for k in range(3000)]
    known = {i: [("user", "same")] * (i % 7 + 1) for i in range(0, 40_000, 3)} | {10**9 + i: long[: 3000 - 700 * i] for i in range(4)}
    assert rows(prefix_trie.trie(table(spark, known, rng))) == brute(known)


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    known = {rng.randrange(400): [("u", rng.choice("ab")) for _ in range(rng.randrange(1, 10))] for _ in range(250)}
    want = {}
    for c, own in known.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = known.get(c - c % 5, [])[:h] + own[h:]
    assert any(not t for t in want.values())
    assert rows(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.turns(table(spark, known, rng))))) == brute(want)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, seq string, block int, key binary, ends string"
    extra = ("x", 1, b"y", "z")
    df = spark.createDataFrame([(1, None, None, "first", *extra), (1, 0, "user", None, *extra), (2, 0, "", "first", *extra), (2, 1, "user", "", *extra), (2, 1, "user", "", *extra), (None, 0, "user", "lost", *extra)], schema)
    assert rows(prefix_trie.trie(df)) == brute({1: [("", "first"), ("user", "")], 2: [("", "first"), ("user", ""), ("user", "")]})
    assert prefix_trie.trie(df.limit(0)).collect() == []
    lone = df.where("conv_id = 2").limit(1).withColumn("text", __import__("pyspark").sql.functions.lit("x" * 1_000_000))
    assert rows(prefix_trie.trie(lone)) == brute({2: [("", "x" * 1_000_000)]})
    # nothing but a conversation that is left without turns
    alone = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(alone, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.turns(df)))) == brute({alone: []})


def test_parts_of_a_tree_meet(spark):
    """The merge of blocks gives what one block gives, wherever the order is cut."""
    rng = random.Random(3)
    for _ in range(200):
        values = [-1, *(rng.randrange(4) for _ in range(rng.randrange(1, 20)))]
        ids = [rng.randrange(1000) for _ in values]
        whole = {(e.value, e.left): e for e in prefix_trie.nearest_smaller([*values, -1], [None, *ids])[0] if e.value >= 0}
        for (v, left), e in whole.items():
            right = next((i for i in range(e.first + 1, len(values)) if values[i] < v), len(values))
            assert (e.right, e.least, e.count) == (right, min(ids[left:right]), values[left + 1 : right].count(v))
            assert values[left] < v and min(values[left + 1 : right]) == v
