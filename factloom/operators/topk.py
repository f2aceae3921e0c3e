"""The best documents for many weighted queries at once, without scoring every document for every query.

Documents with the same entities have the same score for every query: they are one set, with its newest documents. Sets are packed into blocks of bounded size, each with
a list of sets for every entity. A task takes a batch of queries past all blocks, one block after the other, and keeps the best documents of each query; the worst score
kept is its threshold. It tells which entities a better set must hold (all whose weight is more than may be missed, and one at least of each group whose weights together
are), so a block's lists are intersected as bits, and only the few sets that are left are scored. What leaves a task are the best documents of its queries: nothing is
shuffled for a query and a block, and neither rows nor disk grow with queries times documents. Time still does, by some bit operations for 64 sets at once.

Entities are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

DOC = ["document_collection", "document_id"]
#: Sets of a block, queries of a batch; a query's first threshold is taken from one in GROWTH sets of its first block.
BLOCK, BATCH, GROWTH = 1 << 18, 1024, 8
#: Lists of entities that a task keeps as bits.
LISTS = 1024
#: A document without a collection; names of collections are kept behind a dot.
NO_NAME = ""
_PACKED = "n int, ents array<long>, lists array<binary>, starts binary, ids binary, names array<string>, codes binary"


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, its lineage cut."""
    shared.folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of the session's own and read again: compressed, unlike what is cut. Shuffle files that led to it go."""
    path = shared.new(df.sparkSession, name)
    df.write.parquet(path)
    shared.forget(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(tags: DataFrame) -> DataFrame:
    """(document, entities): each document's distinct entities, as sorted hashes."""
    ents = tags.select(*DOC, F.xxhash64("ent_id", "ent_type").alias("ent")).distinct()
    return ents.groupBy(*DOC).agg(F.sort_array(F.collect_list("ent")).alias("entities"))  # one document's entities


def _pack(block: int):
    """Sets of a task as blocks, one row each: newest first, with a list of sets for each entity (bits, or positions where they are shorter)."""

    def made(entities, members):
        import pyarrow as pa

        counts = np.diff(members.offsets.to_numpy())
        flat = members.flatten()
        ids, names = flat.field("document_id").to_numpy(zero_copy_only=False), flat.field("document_collection").dictionary_encode("encode")
        labels, codes = np.array([NO_NAME if x is None else f".{x}" for x in names.dictionary.to_pylist()], dtype=str), names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        rank = np.argsort(np.argsort(labels))[codes]  # by name
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((-rank, -ids, owner))
        ids, codes, rank = ids[order], codes[order], rank[order]
        first = np.r_[0, np.cumsum(counts)[:-1]]
        newest = np.lexsort((-rank[first], -ids[first]))  # sets by their newest documents
        place = np.empty(len(newest), np.int64)
        place[newest] = np.arange(len(newest))
        again = np.argsort(place[owner], kind="stable")
        starts = np.r_[0, np.cumsum(counts[newest])].astype(np.int32)

        ents = entities.flatten().to_numpy(zero_copy_only=False)
        at = place[np.repeat(np.arange(len(counts)), np.diff(entities.offsets.to_numpy()))]
        order = np.lexsort((at, ents))
        ents, at = ents[order], at[order]
        known, begins = np.unique(ents, return_index=True)
        width = -(-len(counts) // 64) * 8
        lists = []
        for places in np.split(at, begins[1:]) if len(known) else []:
            if len(places) * 4 < width:
                lists.append(places.astype(np.uint32).tobytes())
                continue
            bits = np.zeros(width * 8, np.uint8)
            bits[places] = 1
            lists.append(np.packbits(bits, bitorder="little").tobytes())
        row = {"n": len(counts), "ents": known.tolist(), "lists": lists, "starts": starts.tobytes(), "ids": ids[again].astype(np.int64).tobytes(), "names": labels.tolist(), "codes": codes[again].tobytes()}
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    def pack(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == block:
                    yield _whole(pa, held, made)
                    held, n = [], 0
        if n:
            yield _whole(pa, held, made)

    return pack


def _whole(pa, held, made):
    table = pa.Table.from_batches(held)
    return made(*[pa.concat_arrays(table.column(c).chunks) for c in ("entities", "members")])


def blocks_of(docs: DataFrame, keep: int, block: int = BLOCK) -> DataFrame:
    """Blocks of the sets of entities of documents (document, entities), each set with its ``keep`` newest documents."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-docs.count() // block), cores)
    newest = Window.partitionBy("entities").orderBy(F.desc("document_id"), F.desc("document_collection"))
    dealt = docs.select("entities", F.col("document_id").cast("long").alias("document_id"), "document_collection").repartition(parts, "entities")
    sets = dealt.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= keep).groupBy("entities").agg(F.collect_list(F.struct("document_id", "document_collection")).alias("members"))
    if parts > cores:  # equal documents may be many: fewer and fuller blocks
        distinct = docs.agg(F.approx_count_distinct(F.xxhash64("entities"))).first()[0]
        sets = sets.coalesce(min(parts, max(-(-distinct // block), cores)))
    return cut(sets.mapInArrow(_pack(block), _PACKED))


def _batch(per: list[str]):
    """Queries of a task as one row of arrays."""

    def pack(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            columns = [pa.concat_arrays(table.column(c).chunks) for c in table.column_names]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), c) for c in columns], names=table.column_names)

    return pack


class _Block:
    """A packed block with its entities' lists as bits."""

    def __init__(self, row: dict):
        one = lambda c: row[c].values if hasattr(row[c], "values") else row[c]
        self.n = row["n"].as_py()
        self.words = -(-self.n // 64)
        self.at = dict(zip(one("ents").to_pylist(), range(len(one("ents")))))
        self.lists, self.made = one("lists"), {}
        buffer = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
        self.starts, self.ids = buffer("starts", np.int32), buffer("ids", np.int64)
        self.names, self.codes = np.array(one("names").to_pylist(), dtype=str), buffer("codes", np.int32)
        self.heads = -self.ids[self.starts[:-1]]  # rising

    def bits(self, e: int):
        """The sets with an entity, a bit each; None if there are none."""
        k = self.at.get(e)
        if k is None:
            return None
        if k not in self.made:
            if len(self.made) >= LISTS:
                self.made.clear()
            raw = np.frombuffer(self.lists[k].as_buffer(), np.uint8)
            if len(raw) < self.words * 8:
                bits = np.zeros(self.words * 64, np.uint8)
                bits[raw.view(np.uint32)] = 1
                raw = np.packbits(bits, bitorder="little")
            self.made[k] = raw.view(np.uint64) if raw.ctypes.data % 8 == 0 else raw.copy().view(np.uint64)
        return self.made[k]

    def members(self, sets: np.ndarray, scores: np.ndarray):
        """(scores, ids, names) of the documents of sets."""
        begin = self.starts[sets]
        n = self.starts[sets + 1] - begin
        ends = np.cumsum(n)
        at = np.repeat(begin - (ends - n), n) + np.arange(ends[-1])
        return np.repeat(scores, n), self.ids[at], self.names[self.codes[at]]


class _Query:
    """A query's weights and its best documents so far. low: the least score seen below them, or theirs."""

    def __init__(self, ents, weights, total):
        self.ents, self.weights, self.total = ents, weights, total
        self.scores, self.ids, self.names = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, dtype=str)
        self.least, self.low = 0.0, np.inf

    def dense(self, lists, words: int, digits: int):
        """Scores of the first sets of a block."""
        s = np.zeros(words * 64)
        for b, w in zip(lists, self.weights):
            if b is not None:
                s += np.multiply(np.unpackbits(b[:words].view(np.uint8), bitorder="little"), w)
        return np.round(s / self.total, digits)

    def meet(self, block: _Block, keep: int, digits: int) -> int:
        """Take a block's better documents in; the number of sets that were good enough."""
        lists = [block.bits(e) for e in self.ents]
        here = [i for i, b in enumerate(lists) if b is not None]
        if not here:
            return 0
        least, full = self.least, len(self.scores) == keep
        if not full:
            words = min(block.words, max(block.words // GROWTH, keep))
            s = self.dense(lists, words, digits)
            met = s[s > 0]
            if len(met):
                self.low = min(self.low, met.min())
            if len(met) >= keep:
                least = max(least, np.partition(met, len(met) - keep)[len(met) - keep])
        elif self.low >= least and np.round(min(self.weights) / self.total, digits) < least:  # is there a lower score at all?
            s = self.dense(lists, block.words, digits)
            self.low = min(self.low, s[s > 0].min(initial=np.inf))
        lost = sum(w for b, w in zip(lists, self.weights) if b is None)
        slack = self.total * 10.0**-digits
        spare = self.total * (1 - least) + slack - lost  # the weight that a good set may miss
        if spare < 0:
            return 0
        last = block.words
        if full and spare < 2 * slack:  # equal scores at best: only newer sets are better
            last = -(-int(np.searchsorted(block.heads, -self.ids[-1], side="right")) // 64)
            if not last:
                return 0
        here.sort(key=lambda i: -self.weights[i])
        sure = [i for i in here if self.weights[i] > spare]
        rest, kept = here[len(sure) :], None
        if sure:
            found = lists[sure[0]][:last]
            for i in sure[1:]:
                found = found & lists[i][:last]
            kept = np.flatnonzero(found != 0)
            found = found[kept]
        else:  # one of the heaviest at least, which together are too much to miss
            found, sum_ = np.zeros(last, np.uint64), 0.0
            for i in rest:
                found = found | lists[i][:last]
                sum_ += self.weights[i]
                if sum_ > spare:
                    break
            kept = np.flatnonzero(found != 0)
            found = found[kept]
        # sets that miss up to 0, 1 and 2 thirds of what may be missed, weights rounded down to thirds
        none = one = two = found
        for i in rest:
            thirds = int(self.weights[i] * (3 - 1e-9) / spare)
            if not thirds or not len(kept):
                break
            b = lists[i][kept]
            two = two & (b | (one if thirds == 1 else none))
            one = one & (b | none) if thirds == 1 else one & b
            none = none & b
        some = np.flatnonzero(two != 0)
        if not len(some):
            return 0
        kept = kept[some]
        f = np.flatnonzero(np.unpackbits(two[some].view(np.uint8), bitorder="little").view(bool))
        word, shift = kept[f >> 6], (f & 63).astype(np.uint64)
        s, sure = np.zeros(len(f)), set(sure)
        for i in sorted(here):
            w = self.weights[i]
            s += w if i in sure else w * ((lists[i][word] >> shift) & np.uint64(1))
        s = np.round(s / self.total, digits)
        good = np.flatnonzero(s >= least if least > 0 else s > 0)
        if not full and least <= 0 and len(good):
            self.low = min(self.low, s[good].min())
        if len(good) > keep:
            good = good[np.argsort(-s[good], kind="stable")[:keep]]  # of equal scores the newest, which come first
        if not len(good):
            return 0
        scores, ids, names = block.members((word[good] << 6) + shift[good].astype(np.int64), s[good])
        if full:
            better = (scores > least) | (ids >= self.ids[-1])
            scores, ids, names = scores[better], ids[better], names[better]
            if not len(scores):
                return len(good)
        scores, ids, names = [np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.names, names))]
        order = np.lexsort((ids, scores))[::-1]
        if (np.diff(ids[order]) == 0).any():  # one id in several collections
            order = np.lexsort((names, ids, scores))[::-1]
        if len(order) > keep:
            self.low = min(self.low, scores[order[-1]])
        order = order[:keep]
        self.scores, self.ids, self.names = scores[order], ids[order], names[order]
        if len(order) == keep:
            self.least = self.scores[-1]
        return len(good)


def _scorer(per: list[str], keep: int, digits: int):
    """Takes batches of queries past the blocks; gives the best documents of each query, a row with its low, and the sets that came out of each block."""

    def score(rows):
        import pyarrow as pa

        batches: dict[object, tuple] = {}
        for b in rows:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                block, key = _Block(row), row["batch"].as_py()
                if key not in batches:
                    each = zip(row["own_ents"].as_py(), row["own_weights"].as_py(), row["total"].as_py())
                    batches[key] = [row[c].values for c in per], [_Query(*x) for x in each], []
                batches[key][2].append(sum(q.meet(block, keep, digits) for q in batches[key][1]))
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        for keys, queries, came in batches.values():
            which = np.repeat(np.arange(len(queries)), [len(q.scores) for q in queries])
            joined = lambda c: np.concatenate([getattr(q, c) for q in queries])
            empty = lambda kind, n: pa.nulls(n, kind)
            names = [*per, *DOC, "score", "came"]
            values = [pa.array([x[1:] if x else None for x in joined("names").tolist()], kinds[0]), pa.array(joined("ids")), pa.array(joined("scores")), empty(kinds[3], len(which))]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(which)) for c in keys], *values], names=names)
            lows = [min(q.low, q.scores.min()) if len(q.scores) else None for q in queries]
            yield pa.RecordBatch.from_arrays([*keys, empty(kinds[0], len(lows)), empty(kinds[1], len(lows)), pa.array(lows, kinds[2]), empty(kinds[3], len(lows))], names=names)
            yield pa.RecordBatch.from_arrays([*[empty(c.type, 1) for c in keys], *[empty(k, 1) for k in kinds[:3]], pa.array([came], kinds[3])], names=names)

    return score


def search(core: DataFrame, tags: DataFrame, keep: int, per: list[str], digits: int = 6, block: int = BLOCK, batch: int = BATCH) -> tuple[DataFrame, DataFrame, list[int]]:
    """``best`` over mentions."""
    return best(core, written(documents_of(tags), "entities"), keep, per, digits, block, batch)


def best(core: DataFrame, docs: DataFrame, keep: int, per: list[str], digits: int = 6, block: int = BLOCK, batch: int = BATCH) -> tuple[DataFrame, DataFrame, list[int]]:
    """((query, document, score) of the best ``keep`` documents of each query, (query, low), sets that were good enough in the first block, the second ...).

    core: (query, ent_id, ent_type, score), docs: (document, entities). A document's score is the sum of the query's weights (above 0) of entities that it mentions, over
    the sum of all of them, rounded; of equal scores the highest document id is better, then the collection. low: the score of a document with a score that is lower than
    all kept, or the lowest kept if there is none.
    """
    spark = docs.sparkSession
    terms = core.where(F.col("score") > 0).select(*per, F.xxhash64("ent_id", "ent_type").alias("ent"), F.col("score").alias("w"))
    asked = terms.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("ent", "w"))).alias("t"), F.sum("w").alias("total")).select(*per, F.col("t.ent").alias("own_ents"), F.col("t.w").alias("own_weights"), "total")
    asked = cut(asked)
    n = asked.count()
    batches = max(1, -(-n // batch), min(4 * spark.sparkContext.defaultParallelism, -(-n // 64)))
    arrays = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in asked.schema)
    dealt = cut(asked.repartition(batches, *per).mapInArrow(_batch(per), arrays).withColumn("batch", F.monotonically_increasing_id()))

    met = blocks_of(docs, keep, block).coalesce(1).hint("shuffle_replicate_nl").crossJoin(dealt)  # a task for each batch, which reads the blocks one by one
    kinds = {c: core.schema[c].dataType.simpleString() for c in per} | {"document_collection": "string", "document_id": "long", "score": "double", "came": "array<long>"}
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    spark.conf.set(records, "1")  # a block at a time
    try:
        rows = written(met.mapInArrow(_scorer(per, keep, digits), ", ".join(f"`{c}` {k}" for c, k in kinds.items())), "best")
    finally:
        spark.conf.set(records, before)
    came = rows.where("came IS NOT NULL").select(F.posexplode("came")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    rows = rows.where("came IS NULL AND score IS NOT NULL")
    kept = rows.where("document_id IS NOT NULL").select(*per, "document_collection", F.col("document_id").cast(docs.schema["document_id"].dataType).alias("document_id"), "score")
    return kept, rows.where("document_id IS NULL").select(*per, F.col("score").alias("low")), [r.n for r in came]
