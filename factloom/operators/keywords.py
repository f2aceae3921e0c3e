"""Keywords of texts by an unsupervised score: case, position, frequency, spread over sentences and diversity of neighbours, as aggregates over tokens.

A term matters if it is often capitalised inside sentences, stands early, is frequent, occurs in many sentences, and does not stand beside ever different
words. Lower scores are better. Terms alike by Jaro similarity are suppressed in favour of better ones.

A key's texts may be many: tokens are aggregated by key and term. The terms of one key, already aggregated, meet in one row where alike ones are suppressed.
Where a key is a document (``document_keywords``), its texts are dealt to one task, which counts the tokens of many documents at once; letters are those of Python's
Unicode tables there, a few hundred younger ones than Java's.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import porter
from . import statistics

SENTENCE_END = r"[.!?\n]+"
WORD = r"[\p{L}\p{N}]+"
LEAST_LENGTH = 3
#: Words and ends of sentences, as above; characters of texts that are counted at once.
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
CHARACTERS = 2_000_000


def tokens(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, sentence, place, word, left, right): words with their neighbours in the sentence. Sentences are numbered within a text."""
    sentences = texts.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END)).alias("sentence", "s"))
    words = sentences.select(*key, "sentence", F.regexp_extract_all("s", F.lit(f"({WORD})"), 1).alias("words"))
    each = words.select(*key, "sentence", "words", F.posexplode("words").alias("place", "word"))
    beside = lambda k: F.lower(F.get("words", F.col("place") + k))
    return each.select(*key, "sentence", "place", "word", beside(-1).alias("left"), beside(1).alias("right"))


def scored(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, term, score) of all terms but stop words, numbers and those of fewer than three letters."""
    own = tokens(texts, key, text).withColumn("term", F.lower("word"))
    upper = (F.upper("word") == F.col("word")) & (F.length("word") > 1) & (F.lower("word") != F.col("word"))
    capital = (F.upper(F.substring("word", 1, 1)) == F.substring("word", 1, 1)) & (F.lower(F.substring("word", 1, 1)) != F.substring("word", 1, 1)) & (F.col("place") > 0)
    words = own.groupBy(*key, "term").agg(
        F.count("*").alias("tf"), F.count_if(upper).alias("acronyms"), F.count_if(capital).alias("capitals"), F.median("sentence").alias("middle"), F.size(F.collect_set("sentence")).alias("sentences"),
        F.count("left").alias("lefts"), F.size(F.collect_set("left")).alias("left_words"), F.count("right").alias("rights"), F.size(F.collect_set("right")).alias("right_words"),
    )
    stop = F.col("term").isin(T.STOP_WORDS)
    of_key = Window.partitionBy(*key)
    terms = words.select("*", F.max("tf").over(of_key).alias("most"), F.avg(F.when(~stop, F.col("tf"))).over(of_key).alias("mean"), F.stddev_pop(F.when(~stop, F.col("tf"))).over(of_key).alias("spread"))
    lengths = texts.select(*key, F.size(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END)).alias("n")).groupBy(*key).agg(F.max("n").alias("n_sentences"))
    rows = terms.where(~stop & (F.length("term") >= LEAST_LENGTH) & ~F.rlike("term", F.lit("^[0-9]+$"))).join(lengths, key)

    case = F.greatest("acronyms", "capitals") / (1 + F.ln("tf"))
    place = F.ln(F.ln(3 + F.col("middle")))
    share = F.col("tf") / F.col("most")
    varied = lambda words, n: 0.5 + F.coalesce(F.try_divide(F.col(words), F.col(n)), F.lit(0.0)) * share
    rows = rows.withColumn("related", varied("left_words", "lefts") + varied("right_words", "rights"))
    frequent, wide = F.col("tf") / (F.col("mean") + F.col("spread")), F.col("sentences") / F.col("n_sentences")
    rows = rows.withColumn("s", place * F.col("related") / (case + frequent / F.col("related") + wide / F.col("related")))
    return rows.select(*key, "term", (F.col("s") / (F.col("tf") * (1 + F.col("s")))).alias("score"))


def jaro(a: str, b: str) -> float:
    """Jaro similarity: letters met in a window of half the longer length, less half of those out of order."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, met = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                met.append(c)
                break
    if not met:
        return 0.0
    moved = sum(x != y for x, y in zip(met, (c for c, f in zip(b, free) if not f))) // 2
    m = len(met)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def unlike(terms: list[str], keep: int, limit: float) -> list[str]:
    """The first terms, without those that are alike to one kept before."""
    kept: list[tuple] = []
    for t in terms:
        if len(kept) == keep:
            break
        n, letters = len(t), frozenset(t)
        for k, m, others in kept:
            # similarity can't exceed (2 + shorter / longer) / 3, nor what the letters allow that both have
            if (2 + min(n, m) / max(n, m)) / 3 > limit:
                met = min(n - len(letters - others), m - len(others - letters))
                if (met / n + met / m + 1) / 3 > limit - 1e-9 and jaro(t, k) > limit:
                    break
        else:
            kept.append((t, n, letters))
    return [k for k, _, _ in kept]


def suppressed(scored_: DataFrame, key: list[str], keep: int = 25, limit: float = 0.9, digits: int = 9) -> DataFrame:
    """(key, term, score, rank): the best terms of each key that are not alike to a better one, by rounded score and then name."""

    @F.pandas_udf("array<string>")
    def chosen(lists):
        return lists.map(lambda x: unlike(list(x), keep, limit))

    ordered = F.sort_array(F.collect_list(F.struct(F.round("score", digits).alias("score"), "term")))
    rows = scored_.groupBy(*key).agg(ordered.alias("all")).withColumn("chosen", chosen(F.col("all.term")))
    of = F.map_from_entries(F.transform("all", lambda x: F.struct(x["term"], x["score"])))
    return rows.withColumn("of", of).select(*key, "of", F.posexplode("chosen").alias("rank", "term")).select(*key, "term", F.col("of")[F.col("term")].alias("score"), (F.col("rank") + 1).cast("long").alias("rank"))


class _Codes(dict):
    """Numbers for what is looked up, in the order of its first appearance."""

    def __missing__(self, x):
        self[x] = n = len(self)
        return n


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds: half up, by the shortest decimal that is written for a double."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _distinct(group: np.ndarray, value: np.ndarray, n: int, of: int) -> np.ndarray:
    """Distinct values (below ``of``) in each of n groups."""
    return np.bincount(np.unique(group * of + value) // of, minlength=n)


def keywords_of(texts: list[str], owner: np.ndarray, keep: int, limit: float, digits: int = 9) -> list[tuple[list[str], list[float]]]:
    """(terms, scores) of each owner (0, 1, ...) of texts: those of ``scored`` and ``suppressed``, counted for many owners at once."""
    keys = int(owner[-1]) + 1 if len(owner) else 0
    seen = _Codes()
    parts = [np.fromiter(map(seen.__getitem__, _TOKEN.findall(t)), np.int64) for t in texts]
    tokens_ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    surface = list(seen)
    end = np.fromiter((w[0] in ".!?\n" for w in surface), bool, len(surface))
    lower = _Codes()
    term_of = np.fromiter((lower[w.lower()] for w in surface), np.int64, len(surface))
    acronym = np.fromiter((len(w) > 1 and w.upper() == w != w.lower() for w in surface), bool, len(surface))
    capital = np.fromiter((w[0].upper() == w[0] != w[0].lower() for w in surface), bool, len(surface))
    terms = list(lower)

    ends = end[tokens_]
    n_sentences = np.ones(keys, np.int64)
    per_text = np.bincount(text[ends], minlength=len(texts))
    np.maximum.at(n_sentences, owner, per_text + 1)
    sentence = np.cumsum(ends) - np.r_[0, np.cumsum(per_text)][text]
    word, text, sentence = tokens_[~ends], text[~ends], sentence[~ends]
    out: list[tuple[list[str], list[float]]] = [([], []) for _ in range(keys)]
    if not len(word):
        return out
    beside = (text[1:] == text[:-1]) & (sentence[1:] == sentence[:-1])
    left, right = np.r_[False, beside], np.r_[beside, False]
    term, size = term_of[word], len(terms)

    group = owner[text] * size + term
    order = np.lexsort((sentence, group))
    g, s = group[order], sentence[order]
    new = np.r_[True, g[1:] != g[:-1]]
    first = np.flatnonzero(new)
    tf = np.diff(np.r_[first, len(g)])
    count = lambda flags: np.add.reduceat(flags[order].astype(np.int64), first)
    own = np.empty(len(g), np.int64)
    own[order] = np.repeat(np.arange(len(first)), tf)
    sentences = np.add.reduceat((new | np.r_[True, s[1:] != s[:-1]]).astype(np.int64), first)
    middle = 0.5 * s[first + (tf - 1) // 2] + 0.5 * s[first + tf // 2]
    key, which = g[first] // size, g[first] % size

    stop_words = frozenset(T.STOP_WORDS)
    stop = np.fromiter((t in stop_words for t in terms), bool, size)[which]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    spread_out = lambda x: np.repeat(x, np.diff(np.r_[starts, len(key)]))
    with np.errstate(divide="ignore", invalid="ignore"):  # a key of stop words alone
        others = np.add.reduceat((~stop).astype(np.int64), starts)
        mean = spread_out(np.add.reduceat(np.where(stop, 0, tf), starts) / others)
        deviation = np.sqrt(spread_out(np.add.reduceat(np.where(stop, 0.0, (tf - mean) ** 2), starts) / others))
    fit = np.fromiter((len(t) >= LEAST_LENGTH and not (t.isascii() and t.isdigit()) for t in terms), bool, size)
    good = np.flatnonzero(~stop & fit[which])

    share = tf / spread_out(np.maximum.reduceat(tf, starts))
    varied = lambda words, n: 0.5 + np.where(n > 0, words / np.maximum(n, 1), 0.0) * share
    related = varied(_distinct(own[left], term[np.flatnonzero(left) - 1], len(first), size), count(left)) + varied(_distinct(own[right], term[np.flatnonzero(right) + 1], len(first), size), count(right))
    key, which, tf, related, mean, deviation = (x[good] for x in (key, which, tf, related, mean, deviation))
    case = np.maximum(count(acronym[word]), count(capital[word] & left))[good] / (1 + np.log(tf))
    wide = sentences[good] / n_sentences[key]
    score = np.log(np.log(3 + middle[good])) * related / (case + tf / (mean + deviation) / related + wide / related)
    score = _rounded(score / (tf * (1 + score)), digits)

    by_name = np.empty(size, np.int64)
    by_name[sorted(range(size), key=terms.__getitem__)] = np.arange(size)
    order = np.lexsort((by_name[which], score, key))
    edges = np.searchsorted(key[order], np.arange(keys + 1))
    for k in np.flatnonzero(np.diff(edges)):
        best = order[edges[k] : edges[k + 1]]
        named = dict(zip(map(terms.__getitem__, which[best].tolist()), score[best].tolist()))
        chosen = unlike(named, keep, limit)
        out[k] = chosen, [named[t] for t in chosen]
    return out


def _counted(key: list[str], keep: int, limit: float):
    def of(batches):
        import pyarrow as pa

        def made(keys, texts, owner):
            found = keywords_of(texts, np.array(owner, np.int64), keep, limit)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=[*key, "terms", "scores"])

        kinds, keys, texts, owner, n = None, [], [], [], 0
        for b in batches:
            kinds = [b.column(c).type for c in key]
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                for k, t in zip(zip(*[part.column(c).to_pylist() for c in key]), part.column("text").to_pylist()):
                    if not keys or keys[-1] != k:
                        if n > CHARACTERS:
                            yield made(keys, texts, owner)
                            keys, texts, owner, n = [], [], [], 0
                        keys.append(k)
                    texts.append(t or "")
                    owner.append(len(keys) - 1)
                    n += len(texts[-1])
        if keys:
            yield made(keys, texts, owner)

    return of


def document_keywords(texts: DataFrame, key: list[str], keep: int = 25, limit: float = 0.9) -> DataFrame:
    """The keywords of each key. Texts are dealt by key once, so that neither tokens nor terms are shuffled; the texts of one key are held by a task."""
    dealt = texts.select(*key, F.col("text")).dropna(subset=key).repartition(*key).sortWithinPartitions(*key)
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key)
    found = dealt.mapInArrow(_counted(key, keep, limit), f"{fields}, terms array<string>, scores array<double>")
    rows = found.select(*key, F.posexplode(F.arrays_zip("terms", "scores")).alias("rank", "x"))
    return rows.select(*key, F.col("x.terms").alias("term"), F.col("x.scores").alias("score"), (F.col("rank") + 1).cast("long").alias("rank"))


def entity_keywords(tags: DataFrame, texts: DataFrame, per_entity: int = 100, keep: int = 20, seed: int = 0) -> DataFrame:
    """(ent_id, term, weight): a keyword cloud of each entity, from a seeded sample of the documents that mention it.

    Terms of one stem are one, named by the shortest word of the sample with that stem; the entity's own name is none. Weights go from 1 to 8.
    """
    doc = ["document_collection", "document_id"]
    sample = statistics.sampled_documents(tags, per_entity, seed).join(texts.select(*doc, "text"), doc)
    key = ["ent_id", "ent_type"]
    best = suppressed(scored(sample, key), key).where(~F.contains(F.lower("ent_id"), F.col("term")))
    words = tokens(sample, key).select(*key, F.lower("word").alias("word")).distinct()
    shortest = words.groupBy(*key, porter(F.col("word")).alias("stem")).agg(F.min(F.struct(F.length("word").alias("n"), F.col("word"))).alias("x")).select(*key, "stem", "x.word")
    merged = best.withColumn("stem", porter(F.col("term"))).groupBy(*key, "stem").agg(F.min("score").alias("score")).join(shortest, [*key, "stem"])
    name = F.when(F.col("word") == F.concat("stem", F.lit("s")), F.col("stem")).otherwise(F.col("word"))
    return statistics.keyword_weights(merged.select(F.concat_ws(":", *key[::-1]).alias("entity_id"), name.alias("term"), (-F.col("score")).alias("score")), keep)  # the lowest score is the best
