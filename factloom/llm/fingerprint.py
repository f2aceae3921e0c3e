"""Document fingerprints by a randomised edit embedding, bit-sampled banding and verification.

All texts walk through the same random bits: at step j the embedding holds the current character, and the walk moves on to the
next one when the bit of (character, j) is set. Few edits change few steps, so edit distance turns into Hamming distance. The
fingerprint keeps one hex digit (four hashed bits) at fixed random steps, 64 of the first 64 and 128 of every further octave, as
far as the walk goes; it covers the whole text and grows with the logarithm of its length. Likeness is the share of
agreeing digits, each weighted by the steps it stands for, corrected for chance agreement. Bands sample digits; two texts are candidates if they share
a band, and likeness verifies them. The query bands and verifies the pairs it is asked for; near() bands whole tables, for callers that look for near copies.
A text of some 32 characters or fewer does not fill the first 64 steps; its whole fingerprint is its band.

Null counts as empty. An empty text has an empty fingerprint, like only to another empty one. Equal texts have equal
fingerprints. Of documents with one id the order is that of their texts; a null id comes last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PERIOD = 4096
SAMPLE = 4096  # ids that ranges of ids are drawn from where they are not numbers
BASE, PER_OCTAVE, OCTAVES = 64, 128, 32
_T: dict[str, np.ndarray] = {}


def _tables() -> dict:
    """Steps that a character class stays at a step, the sampled steps, and their weights; all from one fixed seed."""
    if not _T:
        bits = common.mix(np.arange(256 * PERIOD, dtype=np.uint64) + np.uint64(0x5EED)).reshape(256, PERIOD) & np.uint64(1) == 1
        bits[:, ::64] = True  # no stay is longer than 64
        stay = np.zeros((256, PERIOD), np.uint8)
        until = np.full(256, 0, np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):
            until = np.where(bits[:, j % PERIOD], 1, until + 1)
            if j < PERIOD:
                stay[:, j] = until
        steps, weights = [np.arange(BASE, dtype=np.int64)], [np.ones(BASE)]
        for k in range(6, 6 + OCTAVES):
            low = 1 << k
            if low <= PER_OCTAVE:
                own = np.arange(low, 2 * low)
            else:  # one random step in each of 128 equal parts
                part = low // PER_OCTAVE
                own = low + np.arange(PER_OCTAVE) * part + (common.mix(np.arange(PER_OCTAVE, dtype=np.uint64) + np.uint64(k << 20)) % np.uint64(part)).astype(np.int64)
            steps.append(own)
            weights.append(np.full(len(own), low / len(own)))
        _T.update(stay=stay, flat=stay.ravel(), rows=[r.tobytes() for r in stay], steps=np.concatenate(steps), weights=np.concatenate(weights))
    return _T


def classes(text: str) -> np.ndarray:
    """A byte for each code point; only code points above 127 can share one."""
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(p < 128, p, 128 + (p * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


def walk(parts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """For each text the step at which each character begins, and last the step after it; texts advance side by side."""
    t = _tables()
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    lengths = np.array([len(parts[i]) for i in order], np.int64)
    firsts = np.cumsum(np.r_[0, lengths])[:-1] if len(order) else lengths
    flat = np.concatenate([parts[i] for i in order]).astype(np.int32) * PERIOD if len(order) else np.zeros(0, np.int32)
    at = np.empty(len(flat), np.int64)
    j = np.array([begin[i] for i in order], np.int64)
    stay = t["flat"]
    alive, i = len(order), 0
    counts = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(order) else 0) + 1), side="right")  # texts that have an i-th character
    while i < len(counts) and (alive := int(counts[i])) > 48:
        where = firsts[:alive] + i
        now = j[:alive]
        at[where] = now
        j[:alive] = now + stay[flat[where] + (now & (PERIOD - 1))]
        i += 1
    for k in range(int(counts[i]) if i < len(counts) else 0):  # the few longest, one by one
        a, b, step, rows, own = int(firsts[k]) + i, int(firsts[k] + lengths[k]), int(j[k]), t["rows"], []
        for c in parts[order[k]][i:].tolist():
            own.append(step)
            step += rows[c][step & 4095]
        at[a:b] = own
        j[k] = step
    out: list = [None] * len(parts)
    for k, i in enumerate(order):
        out[i] = np.r_[at[firsts[k] : firsts[k] + lengths[k]], j[k]]
    return out


def sample(part: np.ndarray, at: np.ndarray) -> str:
    """Digits at the sampled steps that the walk reaches."""
    steps = _tables()["steps"]
    steps = steps[: np.searchsorted(steps, at[-1])]
    if not len(part):
        return ""
    held = part[np.searchsorted(at, steps, side="right") - 1]
    nibble = common.mix(steps.astype(np.uint64) * np.uint64(257) + held) & np.uint64(15)
    return np.frombuffer(b"0123456789abcdef", np.uint8)[nibble.astype(np.intp)].tobytes().decode()


def fingerprints(texts: list[str]) -> list[str]:
    parts = [classes(t) for t in texts]
    return [sample(p, a) for p, a in zip(parts, walk(parts, [0] * len(parts)))]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    w = _tables()["weights"][:n]
    m = min(len(a), len(b))
    same = np.frombuffer(a[:m].encode(), np.uint8) == np.frombuffer(b[:m].encode(), np.uint8)
    raw = float(w[:m][same].sum() / w.sum())
    return max(0.0, (raw - 1 / 16) / (15 / 16))


BANDS, DIGITS = 32, 8
ROOTS = 16  # least ids of a band's group that all others of it are verified against in a round


def _places(top: int, bands: int, digits: int) -> np.ndarray:
    """Which digits of the first ``top`` make each band, drawn by the steps they stand for, so that a digit agrees as often as the likeness counts it."""
    t = _tables()
    if (key := f"{top}:{bands}:{digits}") not in t:
        reach = np.cumsum(t["weights"][:top])
        u = common.mix((np.arange(digits, dtype=np.uint64)[None, :] + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(1000) + np.uint64(7)).ravel()) % np.uint64(int(reach[-1]))
        t[key] = np.searchsorted(reach, u.astype(np.float64), side="right").reshape(bands, digits)
    return t[key]


def _tops(f: str) -> list[int]:
    """Lengths that fill whole octaves: the last two that a fingerprint has. 0: it is too short for bands."""
    full = [0, *np.cumsum([BASE, *[min(1 << k, PER_OCTAVE) for k in range(6, 6 + OCTAVES)]]).tolist()]
    return [e for e in full if e <= len(f)][-2:]


def shared_bands(a: str, b: str, bands: int = BANDS, digits: int = DIGITS) -> int:
    """How many bands two fingerprints share; candidates share one at least."""
    if not (_tops(a)[-1] and _tops(b)[-1]):
        return int(a == b)
    x, y = (np.frombuffer(f.encode(), np.uint8) for f in (a, b))
    tops = [t for t in _tops(a) if t and t in _tops(b)]
    return sum(int((x[p] == y[p]).all(1).sum()) for p in (_places(t, bands, digits) for t in tops))


def with_next(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """Rows ranged by descending id over partitions, sorted in each. (bucket, extra, columns): after a bucket's own rows comes, as
    an extra, the row that follows them; after the very last one, the first. One shuffle, and no window over all rows.
    """
    parts = common.parallelism(df)
    n_bounds = 8 * parts
    ids = df.select(F.col(id).alias("i"))
    if isinstance(df.schema[id].dataType, T.NumericType):
        bounds = ids.agg(F.percentile_approx("i", [k / n_bounds for k in range(1, n_bounds)], 100 * n_bounds)).first()[0] or []
    else:  # quantiles of SAMPLE ids, picked by hash
        some = sorted(r.i for r in ids.where("i IS NOT NULL").orderBy(F.xxhash64("i")).limit(SAMPLE).collect())
        bounds = [some[len(some) * k // n_bounds] for k in range(1, n_bounds)] if some else []
    bounds = sorted(set(bounds))
    bucket = lambda c: F.when(c.isNull(), -1).otherwise(F.size(F.filter(F.lit(bounds) if bounds else F.array(), lambda b: b < c)))
    ids = ids.withColumn("b", bucket(F.col("i")))
    tops = sorted((r["b"], r["top"]) for r in ids.groupBy("b").agg(F.max("i").alias("top")).collect())  # one row a bucket
    above = [(top, b) for (_, top), b in zip(tops, [b for b, _ in tops[1:]])]  # the highest id of each goes also to the bucket above
    above += [(tops[-1][1], tops[0][0])] if tops else []
    kind = df.schema[id].dataType.simpleString()
    extra = df.sparkSession.createDataFrame(above, f"__i {kind}, __to int") if above else df.sparkSession.createDataFrame([], f"__i {kind}, __to int")
    own = df.select(bucket(F.col(id)).alias("bucket"), F.lit(False).alias("extra"), *columns)
    more = df.join(F.broadcast(extra), F.col(id).eqNullSafe(F.col("__i"))).select(F.col("__to").alias("bucket"), F.lit(True).alias("extra"), *columns)
    return own.unionByName(more).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col(id).desc_nulls_last(), *[c for c in columns if c != id])


def compare_edited(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the beginning of the next document, their likeness, and the bands that make them
    candidates of it (and of the next document)."""
    kind = df.schema[id].dataType.simpleString()
    rows = with_next(df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "id", ["id", "text"])

    def work(held: list) -> list:
        texts = [x[3] for x in held]
        parts = [classes(t) for t in texts]
        walks = walk(parts, [0] * len(parts))
        own = [sample(p, a) for p, a in zip(parts, walks)]
        pairs = [k for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]]
        halves = [len(texts[k]) // 2 for k in pairs]
        tails = [parts[k + 1][:h] for k, h in zip(pairs, halves)]
        moved = walk(tails, [int(walks[k][len(texts[k]) - h]) for k, h in zip(pairs, halves)])
        out = []
        for k, h, tail, m in zip(pairs, halves, tails, moved):
            keep = len(texts[k]) - h
            edited = texts[k][:keep] + texts[k + 1][:h]
            f = sample(np.r_[parts[k][:keep], tail], np.r_[walks[k][:keep], m])
            out.append((held[k][2], len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), own[k], f, round(likeness(own[k], f), 9), round(likeness(own[k], own[k + 1]), 9), shared_bands(own[k], f), shared_bands(own[k], own[k + 1])))
        return out

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def pack(rows):
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            first = pa.array(cols[0], id_type)
            return pa.RecordBatch.from_arrays([first, *[pa.array(c, t) for c, t in zip(cols[1:], kinds[1:])]], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"])

        id_type = None
        for b in common.small(batches):
            id_type = b.schema.field("id").type
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append(row)
                size += len(row[3])
                if size > 4_000_000:
                    yield pack(work(held))
                    held, size = held[-1:], 0
        if held:
            yield pack(work(held))

    out = rows.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int")
    return out.withColumnRenamed("id", id)


def near(df: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = BANDS, digits: int = DIGITS, more: int = 4) -> DataFrame:
    """(id, near_id, likeness): links between documents whose fingerprints are alike, to an earlier id each, enough to connect near copies.

    A band samples digits of the octaves that a text fills, and of one octave fewer, so lengths may differ by a factor of two. Equal fingerprints stand for
    each other: each is linked with the least id that has it, and only that one goes on. In each band's group all are verified against its ROOTS least ids;
    those that are like none of them go on with ``more`` further digits in the band's key, until no group is left, so a large group of unlike texts falls apart within
    some rounds and no group's pairs are all tried. Banding is a matter of chance: two documents that share no band, or meet in none as far as their bands hold
    together, have no link. Documents without an id are left out.
    """
    kind = df.schema[id].dataType.simpleString()

    def prints(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), ["" if t is None else t for t in b.column(1).to_pylist()]
            for i, j in common.chunks(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fingerprints(texts[i:j]), pa.string())], ["one", "f"])

    def keys(round_: int):
        def run(batches):
            import pyarrow as pa

            for b in common.small(batches):
                rows = []
                for d, f, wanted in zip(*[c.to_pylist() for c in b.columns]):
                    found = band_keys(f, bands, digits + more * round_)
                    rows += [(d, k, found[k]) for k in (range(len(found)) if wanted is None else wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["one", "band", "key"])

        return run

    def verified(batches):
        import pyarrow as pa

        for b in common.small(batches):
            alike = [round(likeness(x, y), 9) for x, y in zip(b["f"].to_pylist(), b["g"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["one"], b["root"], pa.array(alike, pa.float64()), b["bands"]], ["one", "root", "likeness", "bands"])

    all_ = common.cut(df.where(F.col(id).isNotNull()).select(id, text).mapInArrow(prints, f"one {kind}, f string"))
    rows = common.cut(all_.groupBy("f").agg(F.min("one").alias("one")))
    found = all_.join(rows.withColumnRenamed("one", "root"), "f").where(F.col("one") > F.col("root")).select("one", "root", F.lit(1.0).alias("likeness")).distinct()
    left, k = rows.select("one", "f", F.lit(None).cast("array<int>").alias("bands")), 0
    while True:
        keyed = common.cut(left.mapInArrow(keys(k), f"one {kind}, band int, key string"))
        first = Window.partitionBy("band", "key").orderBy("one")
        roots = common.cut(keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= ROOTS).select("band", "key", F.col("one").alias("root")))
        pairs = keyed.join(roots, ["band", "key"]).where("root < one").groupBy("one", "root").agg(F.collect_list("band").alias("bands"))  # its bands at most
        named = pairs.join(rows, "one").join(rows.select(F.col("one").alias("root"), F.col("f").alias("g")), "root").select("one", "root", "f", "g", "bands")
        checked = common.cut(named.mapInArrow(verified, f"one {kind}, root {kind}, likeness double, bands array<int>"))
        found = found.unionByName(checked.where(F.col("likeness") >= least).select("one", "root", "likeness"))
        band = F.explode("bands").alias("band")
        done = checked.where(F.col("likeness") >= least).select("one", band).distinct()
        tried = checked.select("one", band).distinct().join(keyed.join(roots, ["band", "key"]).where("one = root").select("one", "band").distinct(), ["one", "band"], "left_anti")  # roots are through
        again = tried.join(done, ["one", "band"], "left_anti").groupBy("one").agg(F.collect_list("band").alias("bands"))
        if again.isEmpty():
            break
        left, k = again.join(rows, "one").select("one", "f", "bands"), k + 1
    return found.groupBy(F.col("one").alias(id), F.col("root").alias("near_id")).agg(F.max("likeness").alias("likeness"))  # an id may have several texts


def band_keys(f: str, bands: int, digits: int) -> list[str]:
    """The bands of a fingerprint, named by octave and number. More digits begin with the fewer ones."""
    held = np.frombuffer(f.encode(), np.uint8)
    return [key for top in _tops(f) for key in ([f"{top}:{k}:" + row.tobytes().decode() for k, row in enumerate(held[_places(top, bands, digits)])] if top else [f"0:{f}"])]


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLE: dict[str, str] = {}
