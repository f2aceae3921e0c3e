"""All ten operators and five stages on odd tables: nulls, empty and very long texts, ties, repeated rows, empty tables, columns of clashing names."""

import random

import pytest

from factloom.llm import byte_bpe, common, exact_dedup, fingerprint, mixing, ngram_join, pii, sharding, suffix_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
CLASHING = ["size", "source_size", "target", "taken", "copies", "keep_id", "group_size", "kept", "text_sha256", "score", "predicted", "n", "row", "key", "id", "component_id", "n_shingles", "other_id", "doc", "fingerprint", "n_tokens", "spans", "one", "k"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def table():
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near = [*words[:200], "other", *words[201:]]
    texts = [None, "", "  \t", "one", "one", " ".join(words), " ".join(near), " ".join(words).upper(), "x" * 300_000, "word " * 60_000, "ip 10.0.0.1 mail a.b@c.org +1 (555) 010-9999 4111111111111111"]
    rows = [(i if i % 4 else -i, t, None if i == 3 else "en", None if i % 5 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, " ".join(words) + " end", "en", None, 0), (None, None, None, None, None), rows[5], rows[5], (-(1 << 63), " ".join(near), "de", "s1", 1)]
    return [r + tuple("mine" for _ in CLASHING) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labelled(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def mixed(df):
    return mixing.take(df.select("doc_id", "source", mixing.words(df.text).alias("size"), "k", "kept"))


def archived(df, folder):
    warc.write(df, folder, id="doc_id", payload="text", url="key")
    return warc.assemble(warc.read(df.sparkSession, folder))


ROW_BY_ROW = {  # operators that return a row for each document
    "sharding": lambda df: sharding.shard(df, 5, 3),
    "toxicity": lambda df: toxicity.score(df, toxicity.fit(df, labelled(df.sparkSession)), df.columns),
    "fingerprints": lambda df: fingerprint.compare_edited(df),
    "ngram_join": lambda df: ngram_join.join(df),
    "byte_bpe": lambda df: byte_bpe.digests(df),
    "pii": lambda df: pii.digests(df, tagger=None),
    "mixing": mixed,
    "exact_dedup": lambda df: exact_dedup.mark(df),
}


@pytest.mark.parametrize("name", [*ROW_BY_ROW, "warc"])
def test_a_row_for_each_document(odd, none, tmp_path, name):
    one = ROW_BY_ROW.get(name)
    out = (one(odd) if one else archived(odd, str(tmp_path / "full"))).collect()
    assert len(out) == len(table())
    assert (one(none) if one else archived(none, str(tmp_path / "empty"))).count() == 0


def test_suffixes_of_odd_ids(odd, none):
    """Null, negative and the least possible ids are told apart."""
    found = suffix_dedup.passages(odd).collect()
    assert {r.doc_id for r in found} == {None, 5, 6, 7, -(1 << 63)}
    assert all(r.doc_id != r.other_id and r.n_words >= 50 for r in found)
    assert suffix_dedup.passages(none).count() == 0


def test_null_ids_link(odd):
    got = {(r.doc_id, r.n_shingles > 100): r.component_id for r in ngram_join.join(odd).collect()}
    assert got[None, True] == got[5, True] == got[6, True] == got[7, True] == got[-(1 << 63), True] == -(1 << 63)
    assert got[None, False] is None
    lone = ngram_join.join(odd.where("doc_id IS NULL")).collect()
    assert [r.component_id for r in lone] == [None, None]


def test_string_ids(odd):
    df = odd.withColumn("doc_id", odd.doc_id.cast("string"))
    for out in (fingerprint.compare_edited(df), ngram_join.join(df), byte_bpe.digests(df), pii.digests(df, tagger=None), exact_dedup.mark(df)):
        assert out.count() == len(table())
    found = suffix_dedup.passages(df).collect()
    assert {r.doc_id for r in found} == {None, "5", "6", "7", str(-(1 << 63))} and all(r.doc_id != r.other_id for r in found)
    assert fingerprint.near(df).where("near_id >= doc_id").count() == 0


def test_stages_keep_columns(spark, odd, none):
    import corpus_pipeline

    given = {tuple(r) for r in table()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name == "byte_bpe":
            assert out.count() == len(table())
        else:
            assert out.columns == odd.columns
            rows = [tuple(r) for r in out.collect()]
            assert set(rows) <= given and rows
        assert stage(spark, none, SF).count() == 0


def test_what_stages_drop(spark, odd):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    fold = lambda t: (t or "").lower()
    kept = stages["exact_dedup"](spark, odd, SF).collect()
    assert sorted(fold(r.text) for r in kept) == sorted({fold(r[1]) for r in table()})
    near = stages["ngram_join"](spark, odd, SF).collect()
    long = [r for r in near if r.text and len(r.text.split()) in (400, 401)]
    assert [r.doc_id for r in long] == [-(1 << 63)]  # one of the group, that of the least id
    assert sum(r.text in (None, "", "  \t") for r in near) == sum(r[1] in (None, "", "  \t") for r in table())  # empty texts link with nothing
    times = {}
    for r in stages["mixing"](spark, odd, SF).collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    mix = {}
    for r in mixed(odd).collect():
        mix.setdefault((r.doc_id, r.size), []).append(r.copies)
    for (i, text), n in times.items():
        assert n <= sum(mix[i, len(text.split())]) + len(mix[i, len(text.split())])
        assert text.strip()
