"""SentencePiece encoding, spans, decoding and normalisation against the library."""

import hashlib
import random
from types import SimpleNamespace

import pytest

from factloom.llm import sentencepiece_bpe as own

sentencepiece = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a", "a ", "▁", "x▁y", "▁▁ ▁", "<unk>", "<s>hi</s>", "<0x41>", "\0", "a\0b", "日本語テキスト", "😀😀 x", "a" * 3000, " " * 333, "\n\n\t x", "ﷺ" * 50, "12345 678", "\U0010ffff", "éá"]
POOL = [*map(chr, range(32, 127)), *"éèêçöüß▁ 　​😀日本한국العहि\n\t\0", "the ", "  ", " in", "ing", "ﬁ", "①", "㌔", "Å", "が"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=own.default_path())


@pytest.fixture(scope="module")
def codec():
    with open(own.default_path(), "rb") as f:
        return own.Codec(f.read(), kept_slices=500)


def test_ids_spans_and_text(library, codec):
    texts = ODD + mixed(1500, 1)
    for text, (ids, starts, ends), want in zip(texts, codec.tokens(texts), library.encode(texts, return_type="proto")):
        assert ids.tolist() == [p.id for p in want.pieces], text
        assert list(zip(starts, ends)) == [(p.begin, p.end) for p in want.pieces], text
        assert codec.decode(ids.tolist()).decode() == library.decode(ids.tolist())


def test_decoding_of_any_ids(library, codec):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.randrange(259, 300)]) for _ in range(rng.randrange(9))]
        assert codec.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_compiled_character_maps(rule, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    spec = dict(own._fields(dict(own._fields(library.serialized_model_proto()))[3]))
    normalize = own.Normalizer(SimpleNamespace(charsmap=spec[2], dummy_prefix=True, trim=trim, escape=True))
    assert normalize.map.units
    for text in [*ODD, *mixed(600, 3)]:
        got, places = normalize(text)
        assert got == library.normalize(text), text
        assert len(places) == len(got) + 1
        assert all(a <= b for a, b in zip(places, places[1:]))


def test_spans_reach_through_a_map(codec):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(own._fields(dict(own._fields(library.serialized_model_proto()))[3]))
    normalize = own.Normalizer(SimpleNamespace(charsmap=spec[2], dummy_prefix=True, trim=True, escape=True))
    got, places = normalize("  ﬁn ㌔  x ")
    assert got == "▁fin▁キロ▁x"
    data = "  ﬁn ㌔  x ".encode()
    assert [data[places[k] : places[k + 1]].decode() for k in (got.index("n"), got.index("ロ"), got.index("x"))] == ["n", "㌔", "x"]


def test_frames(spark, library):
    rows = [(1, "Ein Satz, 12 a.", 7), (1, "Ein Satz, 12 a.", 8), (2, None, 9), (None, "", 0), (3, "x" * 200_000 + " 語", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = own.digests(df).collect()
    want = [library.encode(t or "") for _, t, _ in rows]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i or 0, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t, _), x in zip(rows, want))
    encoded = own.encode(df.where("doc_id = 1 OR doc_id IS NULL"))
    assert sorted((r.doc_id or 0, r.text) for r in own.decode(encoded).collect()) == [(0, ""), (1, "Ein Satz, 12 a."), (1, "Ein Satz, 12 a.")]
    assert own.digests(df.limit(0)).collect() == []


def test_documents(spark, library):
    rows = {r.doc_id: r for r in own.op11_sentencepiece(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        own.Model(b"\x12\x02\x18\x01")
