"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import pathlib
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contract words are runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that Python tasks find it wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_factloom_shipped", False):
        package = pathlib.Path(__file__).resolve().parents[1]
        target = pathlib.Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
        sc._factloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; one of our own only in local mode where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the session's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more: Spark removes them when the driver collects its garbage, which a long job may not do for long."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that on texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parallelism(df: DataFrame, least: int = 12) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------- numpy, inside tasks

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by the worker."""
    if len(_POWERS.get("up", ())) < n:
        n = 1 << max(19, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.r_[_U(1), np.full(n - 1, _U(_BASE))], dtype=np.uint64)
            _POWERS["down"] = np.cumprod(np.r_[_U(1), np.full(n - 1, _U(pow(_BASE, -1, 1 << 64)))], dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contract words of many texts at once, A-Z lower-cased: a 64-bit hash of each, byte start and end in its own text, and the text's number."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if not texts:
        raw = raw[:0]
    firsts = np.cumsum(np.r_[0, lengths[:-1] + 1]) if len(texts) else np.zeros(0, np.int64)
    space = _SPACE[raw]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    owner = np.searchsorted(firsts, starts, side="right") - 1
    with np.errstate(over="ignore"):
        up, down = _powers(len(raw) + 1)
        total = np.r_[_U(0), np.cumsum(_BYTE[_FOLD[raw]] * up[: len(raw)], dtype=np.uint64)]
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts - firsts[owner], ends - firsts[owner], owner


def release() -> None:
    """Give Arrow's unused memory back at the end of a task; the worker lives on for other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def chunks(values: list, limit: int = 300_000):
    """Slices of a list of byte strings that hold about limit bytes each; a longer text stands alone."""
    at, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield at, i
            at, size = i, 0
        size += len(v)
    if at < len(values):
        yield at, len(values)


def small(batches, rows: int = 1000):
    """Slices of record batches, so that a task never holds more than that many texts as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def utf8(column) -> list[bytes]:
    """Arrow strings as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]
