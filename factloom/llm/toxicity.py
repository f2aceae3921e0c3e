"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters and punctuation to spaces. The lexicon holds whole
words and word beginnings that toxic training documents use far more than chance allows, weighted by their log odds. Of near copies
only one is trained on, so that a copied text does not make its rare words toxic. Words of
an exception phrase (two words that clean training documents use and toxic ones do not) count nothing. The summed weight, as
it is and per hundred words, goes through a logistic function fitted on the same documents.

The fit reads at most about ``bound`` labelled documents of each class, picked by hash (the one bounded sample here); scoring reads every
whole text. Null and empty texts have no words and get the lowest score. Documents without a label, or whose label is null,
are not trained on; of several labels of a document the highest counts. Without any label of one class nothing is toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngram_join import _chunked, shingle_sets

BOUND = 20_000
MAX_TERMS = 5_000
EVIDENCE = 14.0  # nats by which a term's share of toxic documents must beat chance
PER_DOCUMENT = 3  # different words with one beginning that count in a document
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

#: Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ı": "i", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _table() -> dict[int, str]:
    t = {ord(c): " " for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\n\r\t\f\v¡¿«»“”‘’…–—"}
    t |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    t |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
    t |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}  # invisible
    return t


_FOLD = _table()


def fold(text: str) -> list[str]:
    """Folded words."""
    return text.lower().translate(_FOLD).split()


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: set = field(default_factory=set)
    coefficients: tuple = (-6.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.beginnings.items():
            a.add_word(f" {k}", (len(k) + 1, w))
        for k, w in self.words.items():
            a.add_word(f" {k} ", (len(k) + 2, w))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, words: list[str], automaton) -> list[tuple[int, float]]:
        """Start of each matched word in the spaced text and its highest weight, exceptions left out."""
        if not len(automaton) or not words:
            return []
        text = f" {' '.join(words)} "
        found: dict[int, float] = {}
        for end, (n, w) in automaton.iter(text):
            at = end - n + 1
            if w > found.get(at, 0):
                found[at] = w
        if self.exceptions:
            for at in [*found]:
                if any(p in self.exceptions for p in self.phrases(text, at)):
                    del found[at]
        return sorted(found.items())

    @staticmethod
    def phrases(text: str, at: int) -> list[str]:
        """The two-word phrases around the word that begins after the space at ``at``."""
        end = text.index(" ", at + 1)
        out = []
        if at:
            out.append(text[text.rindex(" ", 0, at) + 1 : end])
        if end + 1 < len(text):
            out.append(text[at + 1 : text.index(" ", end + 1)])
        return out

    def features(self, words: list[str], automaton) -> tuple[float, float]:
        s = sum(w for _, w in self.hits(words, automaton))
        return math.log1p(s), math.log1p(100 * s / max(1, len(words)))

    def score(self, words: list[str], automaton) -> float:
        a, b, c = self.coefficients
        x, y = self.features(words, automaton)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out quarter, about bound of each class at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~held_out())
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    part = lambda k: min(1.0, bound / max(1, n.get(k, 0)))
    u = F.pmod(F.crc32(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), F.lit(1 << 20)) / (1 << 20)
    picked = known.where(u < F.when(F.col("toxic"), part(True)).otherwise(part(False)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded: about 2 x bound ids


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _sketched(batches):
    """Two minimum hashes over three-word shingles; near copies share one of them nearly always."""
    import pyarrow as pa

    for b, texts in _chunked(batches, 1):
        sets = list(shingle_sets(texts, 3))
        low = [[(int(common.mix(s ^ np.uint64(k)).min() >> np.uint64(1)) if len(s) else -1) for s in sets] for k in (0, 99)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low[0], pa.int64()), pa.array(low[1], pa.int64())], ["doc_id", "text", "toxic", "m0", "m1"])


def without_near_copies(rows: DataFrame) -> DataFrame:
    """Of training rows that share a sketch the first by id; the sample is bounded, so are the groups."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", "toxic").mapInArrow(_sketched, f"doc_id {kind}, text string, toxic boolean, m0 long, m1 long")
    for m in ("m0", "m1"):
        order = Window.partitionBy(m, F.when(F.col(m) < 0, F.col("doc_id"))).orderBy("doc_id", "text")
        rows = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return rows.select("text", "toxic")


def _count_terms(batches):
    import pyarrow as pa

    counts = {False: Counter(), True: Counter()}
    for b in common.small(batches):
        for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            words = set(fold(text or ""))
            c = counts[toxic]
            c.update(w for w in words if len(w) > 2)
            own = Counter(f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n)
            c.update({k: min(v, PER_DOCUMENT) for k, v in own.items()})
    terms = [*(counts[False].keys() | counts[True].keys())]
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([counts[k][t] for t in part], pa.int64()) for k in (True, False)]], ["term", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    rows = common.cut(without_near_copies(training_rows(docs, labels, bound)))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    nt, nc = n.get(True, 0), n.get(False, 0)
    model = Model()
    if not nt or not nc:
        return model
    terms = common.cut(rows.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
    # chance: the toxic share of all counts of that kind of term
    base = {r["p"]: r["b"] for r in terms.groupBy(F.endswith("term", F.lit("*")).alias("p")).agg((F.sum("t") / F.sum(F.col("t") + F.col("c"))).alias("b")).collect()}
    share, chance = F.col("t") / (F.col("t") + F.col("c")), F.when(F.endswith("term", F.lit("*")), F.lit(base.get(True, 0.5))).otherwise(F.lit(base.get(False, 0.5)))
    evidence = F.col("t") * F.log(share / chance) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - chance))).otherwise(0)
    weight = F.least(F.lit(6.0), F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1)))
    best = terms.where((F.col("t") >= 3) & (share > chance)).withColumn("e", evidence).withColumn("w", weight).where((F.col("e") >= EVIDENCE) & (F.col("w") > 2)).orderBy(F.desc("e"), "term").limit(MAX_TERMS).collect()
    beginnings = {r["term"][:-1]: r for r in best if r["term"][-1] == "*"}
    for k, r in beginnings.items():  # a beginning that a shorter one covers adds nothing
        if not any(k[:i] in beginnings for i in PREFIXES if i < len(k)):
            model.beginnings[k] = r["w"]
    model.words = {r["term"]: r["w"] for r in best if r["term"][-1] != "*" and not any(r["term"][:i] in model.beginnings and model.beginnings[r["term"][:i]] >= r["w"] for i in PREFIXES)}
    plain = model

    def phrases(batches):
        import pyarrow as pa

        a, found = plain.automaton(), Counter()
        for b in common.small(batches):
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                words = fold(text or "")
                spaced = f" {' '.join(words)} "
                for p in {p for at, _ in plain.hits(words, a) for p in plain.phrases(spaced, at)}:
                    found[p, toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n if t else 0 for (_, t), n in found.items()], pa.int64()), pa.array([0 if t else n for (_, t), n in found.items()], pa.int64())], ["term", "toxic", "clean"])

    near = rows.mapInArrow(phrases, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.exceptions = {r["term"] for r in near.where("clean >= 3 AND toxic = 0").orderBy(F.desc("clean"), "term").limit(MAX_TERMS).collect()}

    def measured(batches):
        import pyarrow as pa

        a = model.automaton()
        for b in common.small(batches):
            xy = [model.features(fold(t or ""), a) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in xy], pa.float64()), pa.array([y for _, y in xy], pa.float64()), b["toxic"]], ["x", "y", "toxic"])

    points = rows.mapInArrow(measured, "x double, y double, toxic boolean").toPandas()  # three numbers for each row of the bounded sample
    model.coefficients = _logistic(points[["x", "y"]].to_numpy(), points["toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple:
    """Newton's method with a small ridge; the sum is ordered so that reruns agree."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    a, y, w = np.c_[np.ones(len(x)), x][order], y[order], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 9) for v in w)


def score(docs: DataFrame, model: Model, columns: list[str] = ("doc_id",)) -> DataFrame:
    """The columns asked for, but for any of these names, with ``score`` and ``predicted``."""
    columns = [c for c in columns if c not in ("score", "predicted")]

    def run(batches):
        import pyarrow as pa

        a = model.automaton()
        for b in common.small(batches):
            s = [round(model.score(fold(t or ""), a), 9) for t in b.column(b.num_columns - 1).to_pylist()]
            kept = b.columns[: len(columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], [*columns, "score", "predicted"])

    source = docs.select(*[f"`{c}`" for c in columns], F.col("text").alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that score the threshold or more, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        a = model.automaton()
        for b in common.small(batches):
            yield b.filter(pa.array([round(model.score(fold(t or ""), a), 9) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
