"""Sharding: a Feistel permutation with cycle walking over global row numbers [native].

Rows are numbered 0..n-1 in order of an MD5 key over all their columns. The permutation acts on 0..m*m-1 with
m = ceil(sqrt(n)); a number that leaves 0..n-1 is permuted again until it is back. Position p of the shuffled order goes to
shard p mod n_shards, slot p div n_shards, so counts are at most one apart and slots have no gaps. Both can be computed for
any row number, and inverted, without the table (``locate``, ``row_at``).

Equal rows are counted before anything is shuffled and expanded at the end, so copies do not pile up. Nulls are values like
any other; an empty table gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ranking

PRIME = 2147483647
ROUNDS = 6
ADDED = ["row_number", "shard", "slot"]


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second addend of every round, from a linear congruential generator."""
    state, keys = seed % PRIME + 1, []
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            state = (state * 48271 + 11) % PRIME
            row.append(1 + state % (PRIME - 1))
        keys.append(tuple(row))
    return keys


def side(n: int) -> int:
    return max(1, math.isqrt(max(0, n - 1)) + 1) if n else 1


def _permute(x: Column, m: int, seed: int) -> Column:
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("abc", ks)]) for ks in round_keys(seed)])
    start = F.struct(F.call_function("div", x, F.lit(m).cast("long")).alias("l"), (x % m).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        t = (s["r"] * k["a"] + k["b"]) % PRIME
        return F.struct(s["r"].alias("l"), ((s["l"] + (t * t + k["c"]) % PRIME) % m).alias("r"))

    return F.aggregate(keys, start, turn, lambda s: s["l"] * m + s["r"])


def position(row_number: Column, n: int, seed: int) -> Column:
    """The row's place in the shuffled order. Numbers outside 0..n-1 lie on chains of at most m*m - n steps."""
    m = side(n)
    once = _permute(row_number, m, seed)
    walks = min(m * m - n, 256)
    if walks < 1:
        return once
    again = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once, lambda p, _: F.when(p < n, p).otherwise(_permute(p, m, seed)))
    return F.when(once < n, once).otherwise(F.when(again < n, again).otherwise(F.raise_error(F.lit("cycle walk too long"))))


def _python_permute(x: int, m: int, keys: list, back: bool = False) -> int:
    left, right = divmod(x, m)
    for a, b, c in reversed(keys) if back else keys:
        if back:
            left, right = (right - ((((left * a + b) % PRIME) ** 2 + c) % PRIME)) % m, left
        else:
            left, right = right, (left + ((((right * a + b) % PRIME) ** 2 + c) % PRIME)) % m
    return left * m + right


def locate(row_number: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p, keys, m = row_number, round_keys(seed), side(n)
    while (p := _python_permute(p, m, keys)) >= n:
        pass
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """The row number at a slot of a shard."""
    p, keys, m = slot * n_shards + shard, round_keys(seed), side(n)
    while (p := _python_permute(p, m, keys, back=True)) >= n:
        pass
    return p


def number_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a ``row_number`` from 0 without gaps, and how many there are."""
    columns = [c for c in df.columns if c not in ADDED]
    keyed = df.select(*columns, ranking.key_of(*[F.col(c) for c in columns]).alias("__key"))
    groups = common.cut(keyed.groupBy("__key", *columns).agg(F.count("*").alias("__n")))
    n = groups.agg(F.sum("__n")).first()[0] or 0
    first = common.cut(ranking.running_sum(groups, "__n", "__key", [], ranking.digits(n), "__first"))
    few = first.where("__n <= 4096").select(*columns, F.explode(F.sequence("__first", F.expr("__first + __n - 1"))).alias("row_number"))
    blocks = first.where("__n > 4096").select(*columns, "__first", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("__n - 1"), F.lit(4096).cast("long"))).alias("__at"))
    blocks = blocks.repartition(common.parallelism(df), "__first", "__at")
    many = blocks.select(*columns, F.explode(F.sequence(F.expr("__first + __at"), F.expr("__first + least(__n, __at + 4096) - 1"))).alias("row_number"))
    return few.unionByName(many), n


def shard(df: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Every row of df with row_number, shard and slot."""
    numbered, n = number_rows(df)
    at = numbered.withColumn("__p", position(F.col("row_number"), n, seed) if n else F.lit(0).cast("long"))
    return at.withColumn("shard", (F.col("__p") % n_shards).cast("int")).withColumn("slot", F.call_function("div", F.col("__p"), F.lit(n_shards).cast("long"))).drop("__p")


SHARDS, SEED = 24, 20240229


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard(docs, SHARDS, SEED).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    def permute(src: str, dst: str, column: str) -> str:
        ctes, prev = [f"{dst}0 AS (SELECT *, {column} // m AS l, {column} % m AS r FROM {src})"], f"{dst}0"
        for i, (a, b, c) in enumerate(round_keys(SEED), 1):
            ctes.append(f"{dst}{i} AS (SELECT * EXCLUDE (l, r), r AS l, (l + ((((r * {a} + {b}) % {PRIME}) * ((r * {a} + {b}) % {PRIME}) + {c}) % {PRIME})) % m AS r FROM {prev})")
            prev = f"{dst}{i}"
        ctes.append(f"{dst} AS (SELECT * EXCLUDE (l, r), l * m + r AS {dst}p FROM {prev})")
        return ",\n".join(ctes)

    # every number of the square's permutation once; chains are then followed by joins
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i::BIGINT] || range(4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
nibbles AS (SELECT doc_id, size, list_transform(range(size - 8), lambda i: ('0x' || h[2 * i + 1] || h[2 * i + 2])::BIGINT) AS bytes FROM hexed),
crc AS (SELECT doc_id, size, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1])), 4294967295) AS text_crc32 FROM nibbles, crc_table),
dims AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS m FROM documents),
numbered AS (SELECT crc.*, n, m, row_number() OVER (ORDER BY md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' || text_crc32), doc_id) - 1 AS rn FROM crc, dims),
square AS (SELECT x, m FROM (SELECT unnest(range(m * m)) AS x, m FROM dims)),
{permute("square", "sq", "x")},
walk AS (SELECT doc_id, size, text_crc32, n, sqp AS p FROM numbered JOIN sq ON rn = x
  UNION ALL SELECT doc_id, size, text_crc32, n, sqp FROM walk JOIN sq ON p = x WHERE p >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, p // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walk WHERE p < n"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLE = {"op1_sharding": _oracle()}
