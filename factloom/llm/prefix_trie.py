"""The trie of conversation prefixes, as a Cartesian tree over the sorted conversations' longest common prefixes.

Distinct conversations are sorted by their turns' digests over ranges of the order; L[i] is the number of turns that a conversation shares with the one before.
The conversations between two nearest smaller values around L[i] are those below one trie node of depth L[i]; positions of equal L between the same
two make one node. Every partition finds nearest smaller values of its own positions with a stack. What reaches over its ends are its prefix and
suffix minima, strictly falling and rising values, so at most two for each depth: these are merged across partitions in the order, on the driver, and
give the nodes that span partitions. Ends of conversations below which nothing hangs are nodes of their own. A node stands for all depths since its parent's,
which have the same conversations below; they are expanded at the end. All figures of a node are differences of running sums over the
order (conversations, leaves, bytes), minima over its interval are carried by the stack.

Of a conversation 16 bytes a turn and the turns' sizes travel, never its texts; they have to fit a row and the sort's sample (a conversation of a million turns is
16 MB). The driver gets each partition's first and last key and its minima, nothing that grows with the number of conversations. The ids
of equal conversations are hashed as a stream, in blocks of ids, since a digest of one list can't be split.

Null roles and texts count as empty, turns are in the order of (turn, digest), null turns first; repeated rows are turns of their own. Rows without a conversation's id
belong to none and are left out. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
PER_TASK = 100_000
NODE = "conv_id long, upper long, depth long, ahead array<long>, n_convs long, saved long, n_children long, n_leaves long, parent_conv_id long, ends_sha256 string"


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the digests and UTF-8 sizes of each conversation's turns in order."""
    who, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat_ws(":", F.octet_length(who).cast("string"), F.concat(who, said)).cast("binary"), 256), 1, 2 * WIDTH)
    each = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("size")).alias("t"))
    return each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuild(conversations: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Conversation c with its first h turns replaced by those of c - c % group (fewer if that has fewer), h being crc32 of its decimal id modulo spread."""
    heads = conversations.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, spread - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    none = F.array().cast(conversations.schema["turns"].dataType)
    joined = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    head, tail = F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, members, ends): least id of each distinct conversation, how many have it, digest of their ids."""
    blocks = members.groupBy("seq", F.shiftright("conv_id", 12).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("seq", "block", F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(common.parallelism(members), "seq").sortWithinPartitions("seq", "block")

    def run(batches):
        import pyarrow as pa

        now = state = None
        out: list[tuple] = []
        for b in batches:
            for seq, least, n, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                if seq == now:
                    state.update(b"," + ids.encode())
                    total += n
                    continue
                if now is not None:
                    out.append((first, total, state.hexdigest()))
                now, first, total, state = seq, least, n, hashlib.sha256(ids.encode())
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "members", "ends"])
                out = []
        if now is not None:
            out.append((first, total, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "members", "ends"])

    return dealt.select("seq", "least", "n", "ids").mapInArrow(run, "conv_id long, members long, ends string")


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    n, at = min(len(a), len(b)), 0
    while at < n and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


class _Entry:
    """Positions of one value between two smaller ones. left and right: the nearest smaller positions, None if they are not in the block. least: least id between them as far as the block shows it."""

    __slots__ = ("value", "left", "right", "first", "last", "count", "least", "conv")

    def __init__(self, value, left, first, last, count, least):
        self.value, self.left, self.right, self.first, self.last, self.count, self.least, self.conv = value, left, None, first, last, count, least, None


def nearest_smaller(values: list[int], between: list, spans: list | None = None) -> tuple[list[_Entry], list[_Entry], list[_Entry]]:
    """(entry of each position, entries open on the left, entries open on the right) of the Cartesian tree over values, equal ones merged.

    between[i]: least id of what lies between position i - 1 and i. spans: for values that stand for several positions, (first, last, count, least id between those).
    """
    stack: list[_Entry] = []
    of: list[_Entry] = []
    opened: list[_Entry] = []
    for i, v in enumerate(values):
        first, last, count, inside = spans[i] if spans else (i, i, 1, None)
        least = between[i]
        while stack and stack[-1].value > v:
            e = stack.pop()
            e.right, e.least = first, _least(e.least, least)
            least = e.least
        if stack and stack[-1].value == v:
            top = stack[-1]
            top.least, top.last, top.count = _least(top.least, least), last, top.count + count
        else:
            top = _Entry(v, stack[-1].last if stack else None, first, last, count, least)
            if not stack:
                opened.append(top)
            stack.append(top)
        top.least = _least(top.least, inside)
        of.append(top)
    return of, opened, stack


def _least(a, b):
    return b if a is None else a if b is None or a < b else b


class _Block:
    """The conversations of one partition in order, and their tree as far as the partition shows it."""

    def __init__(self, batches, ends: dict):
        rows = [(b.column(0)[0].as_py(), *(b.column(k).to_pylist() for k in range(1, b.num_columns))) for b in batches if b.num_rows]
        self.number = rows[0][0] if rows else None
        keys, sizes, self.members, self.conv, self.ends = ([x for r in rows for x in r[k]] for k in range(1, 6))
        if self.number is None:
            return
        before, after = ends[self.number]
        n = len(keys)
        self.turns = [len(k) // WIDTH for k in keys]
        self.shared = [-1 if before is None else lcp(before, keys[0]), *(lcp(a, b) for a, b in zip(keys, keys[1:]))]
        self.next = [*self.shared[1:], -1 if after is None else lcp(keys[-1], after)]
        self.ahead = [np.cumsum([0, *s], dtype=np.int64) for s in sizes]  # bytes of the first 0, 1, 2... turns
        self.leaf = [t > x for t, x in zip(self.turns, self.next)]
        total = [int(a[-1]) for a in self.ahead]
        self.new = [t - int(a[max(x, 0)]) for t, a, x in zip(total, self.ahead, self.shared)]
        sums = zip(self.members, self.leaf, (m * t for m, t in zip(self.members, total)), self.new)
        self.sums = np.zeros((n + 1, 4), np.int64)  # conversations, leaves, bytes in all, bytes in distinct nodes, of all before a position
        self.sums[1:] = np.cumsum(np.array(list(sums), np.int64), axis=0)
        self.of, self.opened, self.left_open = nearest_smaller(self.shared, [None, *self.conv[:-1]])

    def reduced(self) -> list[_Entry]:
        """Entries that reach over an end of the block, in order."""
        return [*self.opened, *self.left_open[1:]]  # the least value is the last of the former and the first of the latter


def _summary(block: _Block):
    """A row for each entry that reaches over the block's ends."""
    last = 0
    entries = block.reduced()
    for k, e in enumerate(entries):
        i, j = e.first, e.last
        least = lambda a, b: min(block.conv[a:b], default=None)
        yield {
            "block": block.number, "entry": k, "value": e.value, "count": e.count, "before": least(last, i), "inside": least(i, j), "after": least(j, None) if k == len(entries) - 1 else None,
            "first": i, "last": j, "size": len(block.conv), "at_first": block.sums[i].tolist(), "at_last": block.sums[j].tolist(), "all": block.sums[-1].tolist(), "turns": block.turns[j], "new": block.new[j], "ahead": block.ahead[j].tolist(), "ends": block.ends[j],
        }
        last = j


SUMMARY = "block long, entry long, value long, count long, before long, inside long, after long, first long, last long, size long, at_first array<long>, at_last array<long>, all array<long>, turns long, new long, ahead array<long>, ends string"


def _node(e: _Entry, upper: int, left: dict, sums, conv: int, parent) -> tuple:
    """A row of NODE. left: turns, new, ahead, ends of the conversation at the node's left end and sums before it; sums: those before its right end."""
    n, leaves, whole, distinct = (int(b - a) for a, b in zip(left["sums"], sums))
    ended = left["turns"] == e.value
    ahead = left["ahead"]
    own = [0, *ahead][upper + 1 : e.value + 1]  # bytes of the first x - 1 turns for the depths x from upper + 1 on
    return conv, upper, e.value, own, n, whole - (distinct - left["new"]) - ahead[-1], e.count + 1 - ended, leaves, parent, left["ends"] if ended else None


def _across(rows: list) -> tuple[list[tuple], dict, dict]:
    """Nodes that span partitions; the least ids of each block's reduced entries; of the entry at the next block's first position."""
    rows = sorted(rows, key=lambda r: (r["block"], r["entry"]))
    start, total, places, between = 0, np.zeros(4, np.int64), [], []
    tail = None
    for k, r in enumerate(rows):
        places.append((start, total))
        between.append(_least(tail, r["before"]) if r["entry"] == 0 else r["before"])
        if k + 1 == len(rows) or rows[k + 1]["block"] != r["block"]:
            tail, start, total = r["after"], start + r["size"], total + np.array(r["all"], np.int64)
    # positions are global from here on; the last one, behind everything, closes all that is open
    spans = [(s + r["first"], s + r["last"], r["count"], r["inside"]) for (s, _), r in zip(places, rows)]
    of, _, _ = nearest_smaller([*(r["value"] for r in rows), -1], [*between, tail], [*spans, (start, start, 1, None)])
    left_of = {s + r["last"]: {"turns": r["turns"], "new": r["new"], "ahead": r["ahead"], "ends": r["ends"], "sums": t + np.array(r["at_last"], np.int64), "value": r["value"], "entry": of[k]} for k, ((s, t), r) in enumerate(zip(places, rows))}
    right_of = {s + r["first"]: (t + np.array(r["at_first"], np.int64), r["value"], of[k]) for k, ((s, t), r) in enumerate(zip(places, rows))} | {start: (total, -1, None)}
    nodes, seen = [], set()
    for e in of:
        if e.value < 0 or id(e) in seen:
            continue
        seen.add(id(e))
        left, (sums, value, right) = left_of[e.left], right_of[e.right]
        up = left["entry"] if left["value"] >= value else right
        upper = max(left["value"], value)
        nodes.append(_node(e, upper, left, sums, e.least, up.least if upper >= 0 else None))
    convs: dict = {}
    for k, r in enumerate(rows):
        convs.setdefault(r["block"], []).append(of[k].least)
    blocks = sorted(convs)
    return nodes, convs, {a: convs[b][0] for a, b in zip(blocks, blocks[1:])}


def _inside(block: _Block, convs: list, following):
    """Nodes within the block: of entries closed on both sides, and of leaves."""
    for e, conv in zip(block.reduced(), convs):
        e.conv = conv
    for e in set(block.of):
        e.conv = e.least if e.conv is None else e.conv
    done = {id(e) for e in block.reduced()}
    n = len(block.of)
    for j, e in enumerate(block.of):
        if e.value >= 0 and id(e) not in done:
            done.add(id(e))
            i, r = e.left, e.right
            up = block.of[i] if block.shared[i] >= block.shared[r] else block.of[r]
            left = {"turns": block.turns[i], "new": block.new[i], "ahead": block.ahead[i].tolist(), "ends": block.ends[i], "sums": block.sums[i]}
            yield _node(e, up.value, left, block.sums[r], e.conv, up.conv)
        if block.leaf[j]:
            upper = max(block.shared[j], block.next[j])
            parent = None if upper < 0 else e.conv if block.shared[j] >= block.next[j] else block.of[j + 1].conv if j + 1 < n else following
            ahead, m = block.ahead[j].tolist(), block.members[j]
            yield block.conv[j], upper, block.turns[j], [0, *ahead][upper + 1 : block.turns[j] + 1], m, (m - 1) * ahead[-1], 0, 1, parent, block.ends[j]


def _rows(found, schema, size: int = 2000):
    import pyarrow as pa

    kept: list = []
    for row in found:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept), schema.types)], schema.names)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept), schema.types)], schema.names)


def _arrow(ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, turns), as op13 returns it."""
    spark = conversations.sparkSession
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    members = conversations.select("conv_id", F.unhex(digests).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    members = common.cut(members.withColumn("seq", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * WIDTH))))
    ends = common.cut(_ends(members.select("seq", "conv_id")))
    distinct = members.select("conv_id", "key", "sizes").join(ends, "conv_id")
    dealt = distinct.repartitionByRange(max(common.parallelism(conversations), ends.count() // PER_TASK), "key").sortWithinPartitions("key")
    placed = common.cut(dealt.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("block"), "key", "sizes", "members", "conv_id", "ends"))

    bounds = sorted((r.block, r.low, r.high) for r in placed.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())  # a row a partition
    lows, highs = [b[1] for b in bounds], [b[2] for b in bounds]
    around = spark.sparkContext.broadcast({b[0]: (x, y) for b, x, y in zip(bounds, [None, *highs], [*lows[1:], None])})

    def summarise(batches):
        block = _Block(batches, around.value)
        if block.number is not None:
            schema = _arrow(SUMMARY)
            yield from _rows((tuple(r[c] for c in schema.names) for r in _summary(block)), schema)

    spanning, convs, following = _across([r.asDict() for r in placed.mapInArrow(summarise, SUMMARY).collect()])
    known = spark.sparkContext.broadcast((convs, following))

    def inner(batches):
        block = _Block(batches, around.value)
        if block.number is not None:
            convs, following = known.value
            yield from _rows(_inside(block, convs[block.number], following.get(block.number)), _arrow(NODE))

    found = placed.mapInArrow(inner, NODE)
    if spanning:
        found = found.unionByName(spark.createDataFrame(spanning, NODE))
    return _expanded(found)


def _expanded(found: DataFrame) -> DataFrame:
    """A row for each depth that a node stands for."""
    each = found.select("*", F.posexplode("ahead").alias("step", "bytes_ahead")).withColumn("bottom", F.col("upper") + 1 + F.col("step") == F.col("depth"))
    none: Column = F.lit(EMPTY)
    return each.select(
        "conv_id",
        (F.col("upper") + 1 + F.col("step")).alias("depth"),
        F.when(F.col("step") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("bottom"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.col("bytes_ahead")).alias("saved_tokens"),
        F.when(F.col("bottom"), F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table's conversations as they are."""
    return nodes(turns(df, conv, turn, role, text))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuild(turns(common.table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE = {
    "op13_prefix_trie": """
WITH RECURSIVE o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM o),
bytes_of AS (SELECT conv_id, k, CAST(('0x' || substr(hex(encode(CAST(conv_id AS VARCHAR))), CAST(2 * k - 1 AS INT), 2)) AS BIGINT) AS b FROM ids, range(1, 21) r(k) WHERE k <= length(CAST(conv_id AS VARCHAR))),
crc(conv_id, k, bit, c) AS (SELECT conv_id, CAST(0 AS BIGINT), 8, CAST(4294967295 AS BIGINT) FROM ids UNION ALL
       SELECT crc.conv_id, CASE WHEN bit = 8 THEN crc.k + 1 ELSE crc.k END, CASE WHEN bit = 8 THEN 1 ELSE bit + 1 END,
              CASE WHEN (CASE WHEN bit = 8 THEN xor(c, b.b) ELSE c END) & 1 = 1 THEN xor(3988292384, (CASE WHEN bit = 8 THEN xor(c, b.b) ELSE c END) >> 1) ELSE (CASE WHEN bit = 8 THEN xor(c, b.b) ELSE c END) >> 1 END
       FROM crc JOIN bytes_of b ON b.conv_id = crc.conv_id AND b.k = CASE WHEN bit = 8 THEN crc.k + 1 ELSE crc.k END),
head AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE bit = 8 AND k = length(CAST(conv_id AS VARCHAR))),
parts AS (SELECT head.conv_id, 0 AS part, o.place, o.role, o.text FROM head JOIN o ON o.conv_id = head.conv_id - head.conv_id % 5 AND o.place <= h
       UNION ALL SELECT head.conv_id, 1, o.place, o.role, o.text FROM head JOIN o USING (conv_id) WHERE o.place > h),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts),
pre(conv_id, depth, node, size) AS (SELECT conv_id, CAST(0 AS BIGINT), 'root', CAST(0 AS BIGINT) FROM ids UNION ALL
       SELECT r.conv_id, r.depth, sha256(pre.node || ':' || r.role || chr(1) || r.text), CAST(octet_length(encode(r.text)) AS BIGINT) FROM pre JOIN rebuilt r ON r.conv_id = pre.conv_id AND r.depth = pre.depth + 1),
n AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM pre GROUP BY node),
links AS (SELECT DISTINCT a.node AS parent, b.node AS child FROM pre a JOIN pre b ON b.conv_id = a.conv_id AND b.depth = a.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY parent),
up AS (SELECT child AS node, n.conv_id AS parent_conv_id FROM links JOIN n ON n.node = links.parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM pre a JOIN pre b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
tree AS (SELECT top AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM below JOIN n USING (node) LEFT JOIN kids k USING (node) GROUP BY top),
final AS (SELECT conv_id, max(depth) AS depth FROM pre GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM pre JOIN final USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, n.depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN tree t USING (node) LEFT JOIN kids k USING (node) LEFT JOIN up u USING (node) LEFT JOIN ends e USING (node)"""
}
