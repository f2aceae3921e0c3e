"""Suffix-array dedup with sparse suffixes: passages of ``least`` words or more that occur in more than one document.

Every window of ``least`` words selects the position of its smallest k-gram hash (its minimiser), so equal windows select
equal places and every repeated passage holds a retained suffix. Suffixes whose first k words can't repeat are dropped by a Bloom
filter of k-grams seen twice. The rest are sorted by all of Spark's range partitions into a sparse suffix array; each is compared with
its nearest neighbours from other documents, and a match is extended right, then left. Matches of a document that touch are merged.

The sort key ends with the document and the position, so a passage that most documents share is spread over partitions. A context of ``least`` - k
words on each side travels with a suffix, longer passages are covered by several suffixes. Neighbours are those with the longest common right side,
so rows that differ on the left may sort between equal passages, and neighbours may stand in another partition. What neighbours leave uncovered is
therefore grouped by hashes of the windows of ``least`` words around each suffix: inside a batch where all rows of the key are in it, else by Spark,
which aggregates in the tasks first, so a frequent passage does not meet in one of them. A window shared with the row before is left to that row, which holds it too.

Words are lower-cased (A-Z). Null, empty and short texts have no passages. Every row is a document of its own, so rows that share an id, or have none, match each other like
any others, and their passages are merged row by row; rows alike in id and text count once. Ids may be of any simple type. Where they are not whole numbers, or one
is null or stands in several rows, rows are known by a 64-bit hash of id and text, whose ids are looked up at the end.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bloom, common
from .ngram_join import _chunked

LEAST, K = 50, 10
SUFFIX = "key long, right binary, left binary, doc long, pos int"


def kgrams(h: np.ndarray, k: int = K) -> np.ndarray:
    """63-bit hashes of every k words in a row."""
    if len(h) < k:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        r = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            r = r * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return (common.mix(r) >> np.uint64(1)).astype(np.int64)


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions that some window of k-grams selects: its smallest, leftmost of equals."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.empty(len(view), np.int64)
    for i in range(0, len(view), 50_000):
        at[i : i + 50_000] = view[i : i + 50_000].argmin(1) + np.arange(i, min(i + 50_000, len(view)))
    return np.unique(at)


def _per_text(texts: list[bytes]):
    h, _, _, owner = common.words_of(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        yield h[first[i] : first[i + 1]]


def retained(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(doc, key, pos) of every retained suffix."""

    def run(batches):
        import pyarrow as pa

        for b, texts in _chunked(batches, 1):
            ids, keys, at = [], [], []
            for d, h in zip(b.column(0).to_pylist(), _per_text(texts)):
                g = kgrams(h, k)
                m = minimisers(g, least - k + 1)
                ids.append(np.full(len(m), -1 if d is None else d, np.int64))
                keys.append(g[m])
                at.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32))], ["doc", "key", "pos"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, key long, pos int")


def suffixes(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Suffixes that may repeat, with the hashes of the words that follow and, backwards, of those before."""
    found = retained(docs, least, k)
    total = found.count()
    bits = bloom.bits_for(total)
    key = F.col("key")
    maybe = bloom.test(found, key, bloom.build(found, key, bits, least=2, is_hash=True), bits, "__maybe", is_hash=True).where("__maybe")
    wanted = common.cut(maybe.groupBy("doc").agg(F.collect_set("key").alias("keys")))  # as many as a document has at most
    side = least - k

    def run(batches):
        import pyarrow as pa

        for b, texts in _chunked(batches, 1):
            rows = []
            for d, keys, h in zip(b["doc"].to_pylist(), b["keys"], _per_text(texts)):
                g = kgrams(h, k)
                m = minimisers(g, least - k + 1)
                m = m[np.isin(g[m], keys.values.to_numpy())]
                short = (h >> np.uint64(32)).astype(">u4")
                back = short[::-1]
                for p in m.tolist():
                    rows.append((int(g[p]), short[p + k : p + k + side].tobytes(), back[len(h) - p : len(h) - p + side].tobytes(), d, p))
                if len(rows) > 20_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    def pack(rows):
        import pyarrow as pa

        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32())], ["key", "right", "left", "doc", "pos"])

    return bloom.pick(docs.select("doc", "text"), wanted, "doc").select("doc", "text", "keys").mapInArrow(run, SUFFIX)


def _matrix(column: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes padded with zeros, and how many there are."""
    n = np.fromiter((len(x) // 4 for x in column), np.int64, len(column))
    raw = b"".join(x.ljust(4 * side, b"\0") for x in column)
    return np.frombuffer(raw, ">u4").reshape(-1, side), n


def _common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    same = np.c_[m[i] == m[j], np.zeros(len(i), bool)]
    return np.minimum(same.argmin(1), np.minimum(n[i], n[j]))


def _compare(rows: dict, done_from: int, done_to: int, least: int, k: int):
    """Matches of rows done_from..done_to with the nearest rows of other documents before and behind, within their key.

    Also, for each of these rows, the common words right and left before, right and left behind (-1 without such a row), and the document behind.
    """
    side = least - k
    key, doc, pos = rows["key"], rows["doc"], rows["pos"]
    n = len(key)
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    run = np.searchsorted(heads, np.arange(n), side="right") - 1
    before = heads[run] - 1
    behind = np.r_[heads[1:], n][run]
    i = np.arange(done_from, done_to)
    out = []
    cover, partner = np.full((done_to - done_from, 4), -1, np.int64), doc[done_from:done_to].copy()
    right, nr = _matrix(rows["right"], side)
    left, nl = _matrix(rows["left"], side)
    for c, other in ((0, before), (2, behind)):
        a = i[(other[i] >= 0) & (other[i] < n)]
        a = a[key[a] == key[other[a]]]
        if not len(a):
            continue
        b = other[a]
        r, lf = _common(right, nr, a, b), _common(left, nl, a, b)
        ok = r + lf + k >= least
        out.append(np.stack([doc[a], pos[a] - lf, pos[a] + k + r, doc[b]], 1)[ok])
        cover[a - done_from, c], cover[a - done_from, c + 1] = r, lf
        partner[a - done_from] = doc[b]
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64), cover, partner


def _windows(rows: dict, cover: np.ndarray, partner: np.ndarray, least: int, k: int) -> dict:
    """Windows of ``least`` words around suffixes that the row before does not share: key, hash, row, start, lowest and highest document known to hold it, and whether none but its own is known."""
    side = least - k
    (right, nr), (left, nl) = _matrix(rows["right"], side), _matrix(rows["left"], side)

    def prefixes(m):
        h = np.zeros((len(m), side + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(side):
                h[:, i + 1] = common.mix(h[:, i] * np.uint64(0x9E3779B97F4A7C15) + m[:, i] + np.uint64(1))
        return h

    o = np.arange(side + 1)
    rb, lb, rn, ln = (cover[:, c, None] for c in range(4))
    valid = (o <= nl[:, None]) & (side - o <= nr[:, None]) & ~((o <= lb) & (side - o <= rb))
    at, off = np.nonzero(valid)
    known = ((o <= ln) & (side - o <= rn))[at, off]
    with np.errstate(over="ignore"):
        w = common.mix(prefixes(left)[at, off] * np.uint64(0xC2B2AE3D27D4EB4F) + prefixes(right)[at, side - off] + off.astype(np.uint64)).view(np.int64)
    doc = rows["doc"][at]
    other = np.where(known, partner[at], doc)
    return {"key": rows["key"][at], "w": w, "row": at, "doc": doc, "pos": rows["pos"][at], "start": rows["pos"][at] - off, "lo": np.minimum(doc, other), "hi": np.maximum(doc, other), "need": ~known}


def _meet(rows: dict, cover: np.ndarray, partner: np.ndarray, least: int, k: int) -> np.ndarray:
    """Matches of windows that neighbours leave uncovered, one a suffix and other document; rows hold all suffixes of their keys."""
    x = _windows(rows, cover, partner, least, k)
    if not x["need"].any():
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((x["w"], x["key"]))
    key, w = x["key"][order], x["w"][order]
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (w[1:] != w[:-1])])
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
    lo, hi = np.minimum.reduceat(x["lo"][order], heads)[group], np.maximum.reduceat(x["hi"][order], heads)[group]
    hit = np.flatnonzero(x["need"] & (lo != hi))
    doc, start, row = x["doc"][hit], x["start"][hit], x["row"][hit]
    other = np.where(lo[hit] != doc, lo[hit], hi[hit])
    order = np.lexsort((start, other, row))
    doc, start, row, other = doc[order], start[order], row[order], other[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])]) if len(hit) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(hit)] - 1 if len(hit) else first
    return np.stack([doc[first], start[first], start[last] + least, other[first]], 1)


def _whole(rows: dict, done_from: int, done_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows done_from..done_to, those of keys that surely begin and end there and have three rows or more, and those of keys that may not."""
    key = rows["key"]
    n = len(key)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[heads[1:], n]
    inside = (heads >= max(1, done_from)) & (ends <= done_to) & (ends < n)
    g = np.searchsorted(heads, np.arange(done_from, done_to), side="right") - 1
    return inside[g] & (ends - heads >= 3)[g], ~inside[g]


def _stack(parts: list) -> dict:
    return {"key": np.concatenate([p["key"] for p in parts]), "doc": np.concatenate([p["doc"] for p in parts]), "pos": np.concatenate([p["pos"] for p in parts]), "right": [x for p in parts for x in p["right"]], "left": [x for p in parts for x in p["left"]]}


def _cut(rows: dict, a: int, b: int) -> dict:
    return {c: v[a:b] for c, v in rows.items()}


def _take(rows: dict, at: np.ndarray) -> dict:
    return {c: [v[i] for i in at.tolist()] if isinstance(v, list) else v[at] for c, v in rows.items()}


def _load(b) -> dict:
    return {"key": b["key"].to_numpy(), "doc": b["doc"].to_numpy(), "pos": b["pos"].to_numpy().astype(np.int64), "right": b["right"].to_pylist(), "left": b["left"].to_pylist()}


MATCH = "doc long, start int, end int, other long"


def matches(sorted_suffixes: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(doc, start, end, other) from neighbours in a sorted table of suffixes."""

    def pack(found, later):
        """Matches, and suffixes for a later step, whose ``end`` tells what neighbours cover, for windows(), and ``other`` the document behind."""
        import pyarrow as pa

        n, e = len(found), len(later["key"])
        both = lambda m, x, t: pa.concat_arrays([pa.array(found[:, m] if n else [], pa.int64()).cast(t), pa.array(x, pa.int64()).cast(t)])
        only = lambda x, t: pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)])
        arrays = [both(0, later["doc"], pa.int64()), both(1, later["pos"], pa.int32()), both(2, later["cover"], pa.int32()), both(3, later["partner"], pa.int64()), only(later["key"], pa.int64()), only(later["right"], pa.binary()), only(later["left"], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "start", "end", "other", "key", "right", "left"])

    def last_run(rows):
        """Where the last run of one document begins."""
        change = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1])) + 1
        return int(change[-1]) if len(change) else 0

    def work(rows, a, b):
        """Matches of rows a..b, those of windows where a key is whole, and rows of other keys."""
        found, cover, partner = _compare(rows, a, b, least, k)
        whole, open_ = _whole(rows, a, b)
        at, rest = np.flatnonzero(whole), np.flatnonzero(open_)
        parts = [found]
        keys = rows["key"][a:b][at]
        i = 0
        while i < len(at):  # about 5,000 rows at a time, whole keys
            j = int(np.searchsorted(keys, keys[min(i + 5000, len(at)) - 1], side="right"))
            parts.append(_meet(_take(rows, at[i:j] + a), cover[at[i:j]], partner[at[i:j]], least, k))
            i = j
        size = lambda c: np.fromiter((len(rows[c][i]) // 4 for i in (rest + a).tolist()), np.int64, len(rest))
        nr, nl = size("right"), size("left")
        rest = rest[(nr + nl + k >= least) & ((cover[rest, 0] < nr) | (cover[rest, 1] < nl))]  # those with a window that the row before does not share
        later = _take(rows, rest + a) | {"cover": ((cover[rest] + 1) << np.array([0, 8, 16, 24])).sum(1), "partner": partner[rest]}
        return np.concatenate(parts), later

    def run(batches):
        held, from_ = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = _load(b) if held is None else _stack([held, _load(b)])
            tail = last_run(rows)
            if tail <= from_:  # still one run
                held = rows
                continue
            yield pack(*work(rows, from_, tail))
            # the last run waits for what follows; the row before it is its neighbour
            held, from_ = _cut(rows, tail - 1, len(rows["key"])), 1
        if held is not None:
            yield pack(*work(held, from_, len(held["key"])))

    both = common.cut(sorted_suffixes.mapInArrow(run, f"{MATCH}, key long, right binary, left binary"))

    def windows(batches):
        import pyarrow as pa

        for b in common.small(batches, 5000):
            rows = _load(b.rename_columns(["pos" if c == "start" else c for c in b.schema.names]))
            cover = (b["end"].to_numpy().astype(np.int64)[:, None] >> np.array([0, 8, 16, 24]) & 255) - 1
            x = _windows(rows, cover, b["other"].to_numpy(), least, k)
            yield pa.RecordBatch.from_arrays([pa.array(x[c], pa.int64()) for c in ("key", "w", "doc", "pos", "start", "lo", "hi")] + [pa.array(x["need"])], ["key", "w", "doc", "pos", "start", "lo", "hi", "need"])

    inner = both.where("key IS NULL").select("doc", "start", "end", "other")
    around = both.where("key IS NOT NULL").mapInArrow(windows, "key long, w long, doc long, pos long, start long, lo long, hi long, need boolean")
    shared = around.groupBy("key", "w").agg(F.min("lo").alias("low"), F.max("hi").alias("high")).where("low <> high")
    met = around.where("need").select("key", "w", "doc", "pos", "start").join(shared, ["key", "w"]).withColumn("other", F.when(F.col("low") != F.col("doc"), F.col("low")).otherwise(F.col("high")))
    met = met.groupBy("doc", "pos", "other").agg(F.min("start").cast("int").alias("start"), (F.max("start") + least).cast("int").alias("end")).select("doc", "start", "end", "other")
    return inner.unionByName(met)


def _coded(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """((doc, text), (doc, id) if rows are known by hashes)."""
    key, body = F.col(f"`{id}`"), F.col(f"`{text}`")
    if isinstance(docs.schema[id].dataType, T.IntegralType) and docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return docs.select(key.cast("long").alias("doc"), body.alias("text")), None
    doc = F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), key.isNull(), F.coalesce(body, F.lit("")))
    rows = docs.select(doc.alias("doc"), body.alias("text"), key.alias("id"))
    return rows.select("doc", "text"), rows.select("doc", "id")


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, k: int = K) -> DataFrame:
    """(id, start_word, end_word, n_words, other_id, matches): each repeated passage of each row, and the least other one met (by id, or by hash where rows are known by hashes)."""
    own, names = _coded(docs, id, text)
    ordered = suffixes(own, least, k).orderBy("key", "right", "left", "doc", "pos")
    found = matches(ordered, least, k)
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end", "other").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("__new").over(Window.partitionBy("doc").orderBy("start", "end", "other").rowsBetween(Window.unboundedPreceding, 0))
    spans = found.distinct().withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("__i", island)
    out = spans.groupBy("doc", "__i").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other"), F.count("*").alias("matches"))
    if names is None:
        kind = docs.schema[id].dataType
        out = out.withColumn("id", F.col("doc").cast(kind)).withColumn("other_id", F.col("other").cast(kind))
    else:
        out = common.cut(out)
        known = common.cut(names.join(out.select("doc").union(out.select("other")).distinct(), "doc", "left_semi").groupBy("doc").agg(F.min("id").alias("id")))
        out = out.join(known, "doc").join(known.select(F.col("doc").alias("other"), F.col("id").alias("other_id")), "other")
    return out.select(F.col("id").alias(id), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id", "matches")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE: dict[str, str] = {}
