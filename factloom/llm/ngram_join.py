"""N-gram Jaccard join by count-vector R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into groups, the number in each group is a coordinate,
and two sets overlap by no more than the sum of the coordinate-wise minima. Trees are descended in pairs: boxes of nodes (least and
greatest size, upper corner) are tested by that bound, level by level, then points; surviving pairs are verified on the sets themselves.

One tree over everything would visit most leaves, since unrelated documents of a size have similar counts. So the forest is cut first,
without loss: sets that link differ in at most T shingles (T follows from their sizes), so of G groups G - T at least
have the same content in both. Documents of a size range that share the content of a group, or a chain of such, form a plot,
and each plot has its own trees. A content that more than FREQUENT sets have joins only sets that have as many frequent ones as a link that
rests on those alone would need; so a passage in many documents does not chain them. Equal sets are one point.

Plots that fit a leaf are packed into tasks, a tree of nodes of FAN points each. A larger plot is cut into leaves of bounded size in order of
size and first coordinates; every leaf is compared with itself and the next one at least, which connects most of a large group of near copies. A component
of LEAF_SETS or more then gets a tree of its own, what is left of the plot another, with inner nodes of FAN children; trees are descended level by level, and
no two sets of one component are compared again, so the work of a large group grows with its size, not with its square. Leaves that meet compare
points first; only sets whose point meets one of the other leaf travel to the pair's verification, so no group has to fit one task.
Only links between parts that are not yet connected are looked for, and connected components join the rest: no pair within a
group is emitted needlessly, no component is lost.

Null and empty texts have no shingles and link with nothing; a text shorter than a shingle is one shingle. Rows with one id are one node of the
component through each of their texts; rows with a null id link as others do, and are left out only where the least id is looked for. Sets are
compared by 64-bit hashes of words and shingles, and sets whose 63-bit hashes are equal count as equal: among 10^10 different sets some five pairs
would be taken for equal wrongly. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom, common
from .components import components

DIMENSIONS = 256  # coordinates of the points in the trees
FREQUENT = 8
LEAF_SETS = 256
LEAF = 1 << 20  # weight of a leaf: 256 sets, or fewer if they exceed 4,096 shingles
FAN = 16  # children of a node
BESIDE = 2  # leaves of a large plot that are compared with each other and the next one in one group


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; link when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def ranges(self, top: int = 1 << 31) -> list[tuple[int, int, int, int]]:
        """(least size, greatest size, T, groups): sizes of the smaller set grow by a quarter from range to range, the larger one may be 1/similarity beyond."""
        out, low = [], 1
        while low < top:
            high = max(low + 1, low * 5 // 4)
            t = (high - 1) * (self.den - self.num) // self.num
            groups = t + 2
            for _ in range(3):  # room for groups that stay empty
                groups = t + 2 + math.ceil(2 * groups * math.exp(-low / groups))
            out.append((low, (high - 1) * self.den // self.num, t, groups))
            low = high
        return out

    def need(self, a, b):
        """Least intersection of sets of these sizes that link."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingle_sets(texts: list[bytes], words: int):
    """Sorted distinct shingle hashes of each text."""
    h, _, _, owner = common.words_of(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k] if len(rolled) else rolled
        rolled = common.mix(rolled)
        for i in range(len(texts)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                s = np.uint64(b - a)
                for x in h[a:b]:
                    s = common.mix(np.array([s * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(1)], np.uint64))[0]
                yield np.array([s], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """63 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(common.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(s))
        return int(common.mix(np.array([total], np.uint64))[0] >> np.uint64(1))


def _corner(s: np.ndarray) -> int:
    """The first two of four coarse coordinates, quantised: a place in the order from which leaves are cut."""
    c = np.bincount((s >> np.uint64(62)).astype(np.int64), minlength=4)[:2] if len(s) else np.zeros(2)
    q = np.clip((c / max(1, len(s)) - 0.25) * math.sqrt(max(1, len(s))) * 4 + 8, 0, 15).astype(int)
    return int(q[0]) * 16 + int(q[1])


def _chunked(batches, text: int):
    for b in common.small(batches):
        texts = common.utf8(b.column(text))
        for i, j in common.chunks(texts):
            yield b.slice(i, j - i), texts[i:j]


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, row, text): row is a hash that rows with the same id and text share; unlike an id it is never null."""
    return docs.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(text).alias("text"))


def features(rows: DataFrame, rule: Rule) -> DataFrame:
    """(id, row, n, key, corner) of every document."""

    def run(batches):
        import pyarrow as pa

        for b, texts in _chunked(batches, 2):
            own = [(len(s), set_key(s), _corner(s)) for s in shingle_sets(texts, rule.words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in own], pa.int64()) for k in range(3)]], ["id", "row", "n", "key", "corner"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row long, n long, key long, corner long")


def signatures(s: np.ndarray, ranges: list, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for the content of each group, for every size range that the set belongs to; and for each the range and, in the low half,
    how many contents a linked pair shares at least.
    """
    out, needs, n = [], [], len(s)
    i = int(np.searchsorted(lows, n, side="right")) - 1
    with np.errstate(over="ignore"):
        while i >= 0 and ranges[i][1] >= n:
            _, _, t, groups = ranges[i]
            if t:
                g = (common.mix(s + np.uint64(i)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(g, kind="stable")
                g, member = g[order], common.mix(s[order] ^ np.uint64(0x5851F42D4C957F2D))
                heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                total = np.add.reduceat(member, heads)
                own = common.mix(total + common.mix(g[heads].astype(np.uint64) + np.uint64((i + 1) << 40)))
                need = groups - t - (groups - len(heads))
                if need < 1:  # so many are empty that all equal groups could be
                    empty = np.setdiff1d(np.arange(groups), g[heads])
                    own = np.r_[own, common.mix(common.mix(empty.astype(np.uint64) + np.uint64((i + 1) << 40)) ^ np.uint64(1))]
                out.append(own)
                needs.append(np.full(len(own), (i << 32) + max(1, need), np.int64))
            i -= 1
    return (np.concatenate(out), np.concatenate(needs)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _blocks(sig: np.ndarray, key: np.ndarray, need: np.ndarray):
    """Rows in order of signature and key, each once; where each signature begins, and how many rows it has."""
    order = np.lexsort((key, sig))
    sig, key, need = sig[order], key[order], need[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])][: len(sig)]
    sig, key, need = sig[once], key[once], need[once]
    heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    return sig, key, need, heads, np.diff(np.r_[heads, len(sig)])


def plots(docs: DataFrame, rule: Rule, n_docs: int) -> DataFrame:
    """(node, root) of sets that share the content of a group, by chains."""
    ranges = rule.ranges()
    lows = np.array([r[0] for r in ranges])
    buckets = max(common.parallelism(docs), n_docs // 4000)
    schema = "bucket int, sigs binary, keys binary, needs binary, counts binary, frequent binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(parts):
        """Signatures by bucket in six bytes each, after the key and the need that a run of them shares. Signatures that are frequent
        in this task alone go out at once, in buckets by key; a mark (key -1) tells their own bucket."""
        import pyarrow as pa

        sig, key, need, heads, n = _blocks(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        hot = np.repeat(n > FREQUENT, n)
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        with np.errstate(over="ignore"):
            six = (sig // np.uint64(buckets)) & np.uint64((1 << 48) - 1)
            ids = (six * np.uint64(buckets) + bucket.astype(np.uint64)).view(np.int64)
        rows = []
        out = np.stack([key[hot], ids[hot], need[hot]], 1)
        place = out[:, 0] % buckets
        order = np.argsort(place, kind="stable")
        ends = np.flatnonzero(np.r_[place[order][1:] != place[order][:-1], True][: len(out)]) + 1
        for own in np.split(order, ends[:-1]) if len(out) else []:
            rows.append((int(place[own[0]]), b"", b"", b"", b"", out[own].tobytes()))
        mark = heads[n > FREQUENT]
        six, key, need, bucket = np.r_[six[~hot], six[mark]], np.r_[key[~hot], np.full(len(mark), -1)], np.r_[need[~hot], np.zeros(len(mark), np.int64)], np.r_[bucket[~hot], bucket[mark]]
        order = np.lexsort((need, key, bucket))
        six, key, need, bucket = six[order], key[order], need[order], bucket[order]
        at = 0
        for e in (np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True][: len(six)]) + 1).tolist():
            k, d = key[at:e], need[at:e]
            runs = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            raw = six[at:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((int(bucket[at]), raw, k[runs].tobytes(), d[runs].tobytes(), np.diff(np.r_[runs, e - at]).astype("<u4").tobytes(), b""))
            at = e
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)

    def map_side(batches):
        parts, held = [], 0
        for _, texts in _chunked(batches, 0):
            for s in shingle_sets(texts, rule.words):
                sig, need = signatures(s, ranges, lows)
                if len(sig):
                    parts.append((sig, np.full(len(sig), set_key(s), np.int64), need))
                    held += len(sig)
            if held > 500_000:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    def reduce_side(bucket, parts):
        """Edges from the least key of each signature to the others, without a need; rows (key, signature, need) of frequent ones."""
        import pyarrow as pa

        sigs, keys, needs, frequent = [], [], [], []
        for six, key, need, counts, ready in zip(*[parts[c].to_pylist() for c in names[1:]]):
            raw = np.zeros((len(six) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            n = np.frombuffer(counts, "<u4")
            sigs.append(raw.view("<u8").ravel())
            keys.append(np.repeat(np.frombuffer(key, np.int64), n))
            needs.append(np.repeat(np.frombuffer(need, np.int64), n))
            frequent.append(np.frombuffer(ready, np.int64).reshape(-1, 3))
        sig, key, need, heads, n = _blocks(np.concatenate(sigs), np.concatenate(keys), np.concatenate(needs))
        first = np.repeat(key[heads], n)
        hot = np.repeat((n > FREQUENT) | (key[heads] < 0), n)
        edge = ~hot & (key != first)
        edges = np.unique(np.stack([first[edge], key[edge]], 1), axis=0)
        own = hot & (key >= 0)
        with np.errstate(over="ignore"):
            ids = (sig[own] * np.uint64(buckets) + np.uint64(bucket[0].as_py())).view(np.int64)
        f = np.concatenate([*frequent, np.stack([key[own], ids, need[own]], 1)])
        return pa.table({"a": pa.array(np.r_[edges[:, 0], f[:, 0]], pa.int64()), "b": pa.array(np.r_[edges[:, 1], f[:, 1]], pa.int64()), "need": pa.concat_arrays([pa.nulls(len(edges), pa.int64()), pa.array(f[:, 2], pa.int64())])})

    packed = docs.select("text").mapInArrow(map_side, schema)
    found = common.cut(packed.groupBy("bucket").applyInArrow(reduce_side, "a long, b long, need long"))
    frequent = found.where("need IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("sig"), "need").distinct()
    enough = frequent.groupBy("key", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("need").bitwiseAND((1 << 32) - 1)).select("key", "need")
    frequent = common.cut(frequent.join(enough, ["key", "need"], "left_semi").select("key", "sig"))
    first = common.cut(frequent.groupBy("sig").agg(F.min("key").alias("a")))
    more = frequent.join(first, "sig").where("key <> a").select("a", F.col("key").alias("b"))
    return components(found.where("need IS NULL").select("a", "b").unionByName(more))


def points(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), DIMENSIONS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)
    return out


def coordinates(n: int) -> int:
    """Coordinates of the point of a set of n: one for about four shingles, 256 at least; a power of two, so that finer points can be folded."""
    return max(DIMENSIONS, 1 << (-(-n // 4) - 1).bit_length())


def fine_point(s: np.ndarray) -> np.ndarray:
    d = coordinates(len(s))
    return np.bincount((s & np.uint64(d - 1)).astype(np.int64), minlength=d).astype("<u2")


def fold(p: np.ndarray, d: int) -> np.ndarray:
    """Points with d coordinates, each a sum of finer ones."""
    return p if p.shape[1] == d else p.reshape(len(p), -1, d).sum(1).astype(p.dtype if p.dtype != np.uint8 else np.uint16)


def nodes(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, greatest size and upper corner of every FAN points in a row."""
    heads = np.arange(0, len(n), FAN)
    return np.minimum.reduceat(n, heads), np.maximum.reduceat(n, heads), np.maximum.reduceat(p, heads, axis=0)


def candidates(rule: Rule, n1: np.ndarray, p1: np.ndarray, other: tuple | None = None):
    """(i, js): for each point those of the other tree, or later ones of its own, whose node's box may meet the box of its node."""
    if not len(n1) or other is not None and not len(other[0]):
        return
    n2, p2 = (n1, p1) if other is None else other
    low1, high1, top1 = nodes(n1, p1)
    low2, high2, top2 = (low1, high1, top1) if other is None else nodes(n2, p2)
    for a in range(len(low1)):
        near = (rule.den * high1[a] >= rule.num * low2) & (rule.den * high2 >= rule.num * low1[a])
        if other is None:
            near[:a] = False
        b = np.flatnonzero(near)
        b = b[np.minimum(top1[a], top2[b]).sum(1, dtype=np.int64) >= rule.need(low1[a], low2[b])]
        if len(b):
            js = (b[:, None] * FAN + np.arange(FAN)).ravel()
            js = js[js < len(n2)]
            for i in range(a * FAN, min(len(n1), (a + 1) * FAN)):
                yield i, (js[js > i] if other is None else js)


def _meeting(rule: Rule, i: int, js: np.ndarray, n1, p1, n2, p2) -> np.ndarray:
    """Those of js whose size and point may belong to a link with i."""
    js = js[rule.den * np.minimum(n1[i], n2[js]) >= rule.num * np.maximum(n1[i], n2[js])]
    return js[np.minimum(p1[i], p2[js]).sum(1, dtype=np.int64) >= rule.need(n1[i], n2[js])] if len(js) else js


def survivors(rule: Rule, n1: np.ndarray, p1: np.ndarray, c1: np.ndarray, other: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which points of a leaf meet a point of the other leaf (or of their own) of another component, and which of the other leaf do."""
    n2, p2, c2 = (n1, p1, c1) if other is None else other
    d = min(p1.shape[1], p2.shape[1])
    p1, p2 = fold(p1, d), fold(p2, d)
    one, two = np.zeros(len(n1), bool), np.zeros(len(n2), bool)
    for i, js in candidates(rule, n1, p1, None if other is None else (n2, p2)):
        js = _meeting(rule, i, js[c2[js] != c1[i]], n1, p1, n2, p2)
        one[i] |= len(js) > 0
        two[js] = True
    return (one | two, two) if other is None else (one, two)


def verify(rule: Rule, keys: np.ndarray, sets: list[np.ndarray], parts: np.ndarray | None = None, other: tuple | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever is connected, within one leaf or between two. Once two sets are connected they are not compared; parts tells what is from the start."""

    def ordered(keys, sets, parts):
        order = np.argsort([len(s) for s in sets], kind="stable")
        return keys[order], [sets[i] for i in order], parts[order], np.array([len(sets[i]) for i in order], np.int64)

    first = np.arange(len(sets)) if parts is None else parts
    label = np.unique(first if other is None else np.r_[first, other[2]], return_inverse=True)[1]
    keys, sets, part1, n1 = ordered(keys, sets, label[: len(sets)])
    k2, s2, part2, n2 = (keys, sets, part1, n1) if other is None else ordered(other[0], other[1], label[len(sets) :])
    p1 = points(sets)
    p2 = p1 if other is None else points(s2)
    links = []
    for i, js in candidates(rule, n1, p1, None if other is None else (n2, p2)):
        for j in _meeting(rule, i, js[part2[js] != part1[i]], n1, p1, n2, p2).tolist():
            if part2[j] == part1[i]:
                continue
            both = len(np.intersect1d(sets[i], s2[j], assume_unique=True))
            if rule.den * both >= rule.num * (n1[i] + n2[j] - both):
                links.append((int(keys[i]), int(k2[j])))
                old, new = part2[j], part1[i]
                part1[part1 == old] = new
                part2[part2 == old] = new
    return links


def _links(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def cut_leaves(members: DataFrame, by: list[str]) -> DataFrame:
    """members with ``leaf`` and ``total``, the weight of their tree (by): every tree's points in order of size and first coordinates, cut by cumulative weight."""
    place = members.groupBy(*by, "n", "corner").agg(F.sum("w").alias("sum"))
    before = Window.partitionBy(*by).orderBy("n", "corner").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    place = common.cut(place.select(*by, "n", "corner", "sum", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.sum("sum").over(whole).alias("total")))  # a hot place can then be split
    inside = F.floor(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) * F.col("sum") / (1 << 20))
    return members.join(place, [*by, "n", "corner"]).withColumn("leaf", F.floor((F.col("base") + inside) / LEAF)).drop("sum", "base")


def links(rows: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links between keys, enough of them to connect every component."""
    n_docs = slim.count()
    plot = plots(rows, rule, n_docs).select(F.col("node").alias("key"), F.col("root").alias("plot"))
    common.forget(slim)
    members = slim.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.max("corner").alias("corner")).join(plot, "key")
    members = common.cut(members.withColumn("w", F.greatest(F.lit(LEAF // LEAF_SETS), F.col("n"))))
    bins = max(common.parallelism(rows), (members.agg(F.sum("w")).first()[0] or 0) // (8 * LEAF))
    members = cut_leaves(members, ["plot"]).withColumn("leaf", F.when(F.col("total") <= LEAF, F.pmod(F.xxhash64("plot"), F.lit(bins)) - bins).otherwise(F.col("leaf"))).drop("total")
    members = common.cut(members)
    common.forget(members)

    def tokenise(batches):
        import pyarrow as pa

        for b, texts in _chunked(batches, 1):
            sets = list(shingle_sets(texts, rule.words))
            large = [x >= 0 for x in b["leaf"].to_pylist()]
            keep = [i for i, (s, k) in enumerate(zip(sets, b["key"].to_pylist())) if set_key(s) == k]
            yield pa.RecordBatch.from_arrays([*[b[c].take(pa.array(keep, pa.int64())) for c in ("key", "plot", "leaf")], pa.array([sets[i].tobytes() for i in keep], pa.binary()), pa.array([fine_point(sets[i]).tobytes() if large[i] else b"" for i in keep], pa.binary())], ["key", "plot", "leaf", "set", "point"])

    def sets(of):
        """Sets of these members; no other texts are shuffled."""
        texts = bloom.pick(rows.select("row", "text"), of.select("row", "key", "plot", "leaf"), "row").select("row", "text", "key", "plot", "leaf")
        return texts.mapInArrow(tokenise, "key long, plot long, leaf long, set binary, point binary")

    def unique(parts):
        found = {k: np.frombuffer(raw, np.uint64) for k, raw in zip(parts["key"].to_pylist(), parts["set"].to_pylist())}
        keys = sorted(found)
        return np.array(keys, np.int64), [found[k] for k in keys]

    def small(parts):
        """Plots of one bin, each a tree of a single leaf."""
        import pyarrow as pa

        out = []
        plot, key, raw = parts["plot"].to_numpy(), parts["key"].to_numpy(), parts["set"].to_pylist()
        order = np.lexsort((key, plot))
        ends = np.flatnonzero(np.r_[plot[order][1:] != plot[order][:-1], True]) + 1
        for own in np.split(order, ends[:-1]):
            own = own[np.r_[True, key[own][1:] != key[own][:-1]]]
            if len(own) > 1:
                out += verify(rule, key[own], [np.frombuffer(raw[i], np.uint64) for i in own])
        return pa.Table.from_batches([_links(out)])

    def beside(parts):
        """Some leaves and the next one."""
        import pyarrow as pa

        return pa.Table.from_batches([_links(verify(rule, *unique(parts)))])

    small_ones, large_ones = members.where("leaf < 0"), members.where("leaf >= 0")
    if large_ones.isEmpty():
        far = None
    else:
        own = common.cut(sets(large_ones))
        common.forget(own)
        group = F.expr(f"leaf div {BESIDE}")
        both = F.when((F.col("leaf") % BESIDE == 0) & (F.col("leaf") > 0), F.array(group - 1, group)).otherwise(F.array(group))
        near = common.cut(own.select("plot", F.explode(both).alias("at"), "key", "set").groupBy("plot", "at").applyInArrow(beside, "a long, b long"))
        common.forget(own)
        far = common.cut(near.unionByName(far_links(own, large_ones.drop("leaf"), components(near), rule)))
        del own, near
        common.forget(far)
    found = sets(small_ones).select("key", "plot", "leaf", "set").groupBy("leaf").applyInArrow(small, "a long, b long")
    return found if far is None else found.unionByName(far)


LEAVES = "plot long, tree long, leaf long, low long, high long, box array<int>, keys binary, parts binary, sizes binary, points binary"


def leaf_rows(rows: DataFrame) -> DataFrame:
    """(plot, tree, leaf, key, part, n, point) to one row a leaf: its box and its points, in order of size, in as many coordinates as its smallest set has."""

    def leaf(key, parts):
        import pyarrow as pa

        unique = {k: (n, c, np.frombuffer(p, "<u2")) for k, n, c, p in zip(*[parts[x].to_pylist() for x in ("key", "n", "part", "point")])}
        keys = sorted(unique, key=lambda k: (unique[k][0], k))
        d = min(len(p) for _, _, p in unique.values())
        p = np.concatenate([fold(unique[k][2][None, :], d) for k in keys])
        sizes, own = (np.array([unique[k][c] for k in keys], np.int64) for c in (0, 1))
        row = {"low": int(sizes[0]), "high": int(sizes[-1]), "box": p.reshape(len(p), -1, DIMENSIONS).sum(1).max(0).tolist(), "keys": np.array(keys, np.int64).tobytes(), "parts": own.tobytes(), "sizes": sizes.tobytes(), "points": p.astype(np.uint8 if p.max() < 256 else "<u2").tobytes()}
        kinds = {"box": pa.list_(pa.int32())} | dict.fromkeys(("keys", "parts", "sizes", "points"), pa.binary())
        return pa.Table.from_pylist([dict(zip(("plot", "tree", "leaf"), (k.as_py() for k in key))) | row], pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.int64())) for x in LEAVES.split(", ")]))

    return rows.groupBy("plot", "tree", "leaf").applyInArrow(leaf, LEAVES)


def meeting_leaves(leaves: DataFrame, rule: Rule) -> DataFrame:
    """(plot, tree, leaf, tree2, leaf2): pairs of leaves that may hold a link, by descending trees in pairs from their roots. A tree other than -1 is one component and is not compared with itself."""
    level = leaves.select("plot", "tree", F.col("leaf").alias("node"), "low", "high", "box")
    levels, top = [level], leaves.agg(F.max("leaf")).first()[0] or 0
    corner = F.aggregate("boxes", F.element_at("boxes", 1), lambda s, v: F.zip_with(s, v, lambda p, q: F.greatest(p, q)))
    while top > 0:  # collect_list holds FAN boxes at most
        level = level.groupBy("plot", "tree", F.expr(f"node div {FAN}").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("box").alias("boxes"))
        level = common.cut(level.withColumn("box", corner).drop("boxes"))
        levels.append(level)
        top //= FAN
    bound = F.aggregate(F.zip_with("box", "box2", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    least = F.ceil(rule.num * (F.col("low") + F.col("low2")) / (rule.num + rule.den))
    may = (F.col("high") * rule.den >= F.col("low2") * rule.num) & (F.col("high2") * rule.den >= F.col("low") * rule.num) & (bound >= least)
    pair = ["plot", "tree", "node", "tree2", "node2"]
    second = lambda x: x.select(*[F.col(c) if c in ("plot", "above2") else F.col(c).alias(f"{c}2") for c in x.columns])
    x, y = levels[-1], second(levels[-1])
    pairs = x.join(y, "plot").where((F.col("tree") < F.col("tree2")) | ((F.col("tree") == -1) & (F.col("tree2") == -1))).where(may).select(*pair)
    for level in levels[-2::-1]:
        pairs = common.cut(pairs.select("plot", "tree", F.col("node").alias("above"), "tree2", F.col("node2").alias("above2")))
        x, y = level.withColumn("above", F.expr(f"node div {FAN}")), second(level).withColumn("above2", F.expr(f"node2 div {FAN}"))
        pairs = pairs.join(x, ["plot", "tree", "above"]).join(y, ["plot", "tree2", "above2"]).where(((F.col("tree") != F.col("tree2")) | (F.col("node") <= F.col("node2"))) & may).select(*pair)
    return pairs.select("plot", "tree", F.col("node").alias("leaf"), "tree2", F.col("node2").alias("leaf2"))


def far_links(own: DataFrame, members: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links of large plots between the components (node, root) known so far. own has (plot, key, set, point)."""
    size = known.groupBy("root").agg(F.count("*").alias("size"))
    big = common.cut(size.where(F.col("size") >= LEAF_SETS).select(F.col("root").alias("part"), F.col("root").alias("tree")))
    parted = members.join(known.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")
    parted = common.cut(parted).join(big, "part", "left").withColumn("tree", F.coalesce("tree", F.lit(-1)))
    placed = common.cut(cut_leaves(parted, ["plot", "tree"]).select("plot", "tree", "leaf", "key", "part", "n"))
    leaves = common.cut(leaf_rows(own.select("plot", "key", "point").join(placed, ["plot", "key"])))
    joined = common.cut(meeting_leaves(leaves, rule))
    side = ["plot", "tree", "leaf", "tree2", "leaf2"]

    def unpack(keys, parts, sizes, raw):
        keys, parts, sizes = (np.frombuffer(x, np.int64) for x in (keys, parts, sizes))
        d = coordinates(int(sizes[0]))
        return keys, sizes, np.frombuffer(raw, np.uint8 if len(raw) == d * len(keys) else "<u2").reshape(len(keys), d), parts

    def meet(batches):
        """Keys of the sets of two leaves that have to be verified, by the side they stand on."""
        import pyarrow as pa

        for b in batches:
            for *at, k1, c1, n1, p1, k2, c2, n2, p2 in zip(*[b[c].to_pylist() for c in (*side, "keys", "parts", "sizes", "points", "keys2", "parts2", "sizes2", "points2")]):
                one_leaf = at[1:3] == at[3:5]
                (k1, n1, p1, c1), (k2, n2, p2, c2) = unpack(k1, c1, n1, p1), unpack(k2, c2, n2, p2)
                one, two = survivors(rule, n1, p1, c1, None if one_leaf else (n2, p2, c2))
                keys, parts = (k1[one], c1[one]) if one_leaf else (np.r_[k1[one], k2[two]], np.r_[c1[one], c2[two]])
                second = np.zeros(len(keys), np.int32)
                second[int(one.sum()) :] = 1
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(keys), x, np.int64)) for x in at], pa.array(keys), pa.array(parts), pa.array(second)], [*side, "key", "part", "second"])

    def pair(parts):
        """Links between the sets of two leaves, or within one."""
        import pyarrow as pa

        sides = ({}, {})
        for k, c, second, raw in zip(*[parts[x].to_pylist() for x in ("key", "part", "second", "set")]):
            sides[second][k] = (np.frombuffer(raw, np.uint64), c)
        (k1, s1, c1), (k2, s2, c2) = ((np.array(sorted(x), np.int64), [x[k][0] for k in sorted(x)], np.array([x[k][1] for k in sorted(x)], np.int64)) for x in sides)
        return pa.Table.from_batches([_links(verify(rule, k1, s1, c1, (k2, s2, c2) if len(k2) else None))])

    body = ["keys", "parts", "sizes", "points"]
    first = leaves.select("plot", "tree", "leaf", *body)
    second = leaves.select("plot", F.col("tree").alias("tree2"), F.col("leaf").alias("leaf2"), *[F.col(c).alias(f"{c}2") for c in body])
    both = joined.repartition(common.parallelism(own), *side).join(first, ["plot", "tree", "leaf"]).join(second, ["plot", "tree2", "leaf2"])
    met = common.cut(both.mapInArrow(meet, "plot long, tree long, leaf long, tree2 long, leaf2 long, key long, part long, second int"))
    some, _ = bloom.split(own.select("plot", "key", "set"), met.select("key").distinct(), "key")  # only these are shuffled
    texts = some.join(met, ["plot", "key"]).select(*side, "key", "part", "second", "set")
    return texts.groupBy(*side).applyInArrow(pair, "a long, b long")


def join(docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs; component_id is null where no id of the component is known."""
    return classes(_rows(docs, id, text), rule).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component_id"))


def classes(rows: DataFrame, rule: Rule) -> DataFrame:
    """(id, row, n, component_id, first) of every row; first is the row hash of the component's first member by id, nulls last."""
    slim = common.cut(features(rows, rule))
    linked = components(links(rows, slim, rule))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    least = slim.where("n > 0").groupBy("key").agg(F.min(order).alias("least"))
    rooted = common.cut(least).join(linked.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    per_root = common.cut(rooted.groupBy("root").agg(F.min("least").alias("least")))
    per_key = common.cut(rooted.select("key", "root").join(per_root, "root").select("key", F.col("least.id").alias("component_id"), F.col("least.row").alias("first")))
    full = slim.where("n > 0").join(per_key, "key").select("id", "row", "n", "component_id", "first")
    return full.unionByName(slim.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("first")))


def representatives(docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least id (null last); columns as they were. Rows alike in id and text stay or go together."""
    gone = common.cut(classes(_rows(docs, id, text), rule).where("row <> first").select("row").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.xxhash64(F.col(id), F.col(text)).alias("row"))  # names of the input stay inside
    return bloom.without(whole, gone, "row").select("kept.*")


CONTRACT = Rule(words=3, num=90, den=100)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), CONTRACT)


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLE = {
    "op4_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    WHERE 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n) GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id"""
}
