"""The completion dictionary, substring search and the translation of query strings: what is read, and odd cases."""

import random

from factloom.operators import dictionary, indexing, qgrams, results, suggest, translation
from test_stored import files_read, formatted

WORDS = ["alpha", "Alpha", "alphabet", "beta", "betamax", "ünder", "日本", "x", "gamma ray", "gamma rays"]


def names(rng, n):
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) + str(rng.randrange(300)) for _ in range(n)})


def test_dictionary(spark, tmp_path):
    rng = random.Random(2)
    known = names(rng, 3000)
    terms = spark.createDataFrame([(n,) for n in [*known, *known[:50], "", None]], "term string")
    dictionary.write(terms, str(tmp_path / "d"), per_file=400, per_block=16)
    own = dictionary.Dictionary(spark, str(tmp_path / "d"))
    assert sorted(r.term for r in own.terms().collect()) == known
    assert len(own.bounds) > 4 and files_read(own.blocks) >= len(own.bounds)
    for typed in ("al", "alpha", "ALPHABET", "beta1", "gamma rays 日", "gamma ray1", "ün", "zz", "a", "", "x.betamax"):
        want = [r.term for r in suggest.complete(terms.where("term <> ''"), typed).collect()]
        got = own.complete(typed)
        assert sorted(r.term for r in got.collect()) == sorted(want), typed
        assert len(own.parts(typed.split(".")[-1].lower(), 10)) <= 2 or len(typed) < 2
    # a name in the middle of a file's range is read from that file alone
    assert own.parts("alphabet", 10) and files_read(own.blocks.where(f"part IN ({', '.join(map(str, own.parts('alphabet alphabet', 10)))})")) == len(own.parts("alphabet alphabet", 10)) == 1


def test_long_names_and_nothing(spark, tmp_path):
    long = "n" * 50_000
    dictionary.write(spark.createDataFrame([(long,), (long + "a",), ("m",)], "term string"), str(tmp_path / "d"))
    own = dictionary.Dictionary(spark, str(tmp_path / "d"))
    assert [r.term for r in own.complete("nn").collect()] == [long, long + "a"]
    dictionary.write(spark.createDataFrame([], "term string"), str(tmp_path / "none"))
    assert dictionary.Dictionary(spark, str(tmp_path / "none")).complete("ab").collect() == []


def test_substring_search(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, n) for i, n in enumerate(names(rng, 500))] + [(900, None), (901, ""), (902, "zx"), (903, "aaa" * 5000), (904, "50% off_")]
    texts = spark.createDataFrame(rows, "id long, text string")
    qgrams.write(texts, "id", "text", str(tmp_path / "q"), slots=5)
    own = qgrams.Search(spark, str(tmp_path / "q"))
    needles = ["alpha", "ALPHABET", "bet", "a1", "x", "日", "zx", "aaaa", "alphaalpha", "lphab", "ama", "0% o", "f_", "zzz", "ünder1", ""]
    table = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted((n, i) for n in needles for i, t in rows if n and n.lower() in (t or "").lower())
    assert sorted(map(tuple, own.find(table, texts, "id", "text").collect())) == want
    candidates = own.candidates(table).count()
    assert len(want) <= candidates < len(want) * 1.5 < len(rows) * len(needles) / 2
    assert sorted(r.id for r in own.one("alphabet").collect()) >= sorted(i for n, i in want if n == "ALPHABET")
    assert "PartitionFilters" in formatted(own.one("bet")) and files_read(own.postings.where("slot = 1")) < files_read(own.postings)


def test_translation(spark):
    rows = [("MESH:D1", "DosageForm", None, "injection"), ("CHEMBL1064", "Drug", None, "simvastatin"), ("CHEMBL1431", "Drug", None, "metformin"), ("9606", "Species", None, "human"), ("MESH:D3920", "Disease", None, "diabetes mellitus"), ("MESH:D4", "Disease", None, "Diabetes Mellitus, Type 2")]
    index = indexing.tagger_index([spark.createDataFrame(rows, "entity_id string, entity_type string, entity_class string, synonym string")])
    types = {"drug": "Drug", "drugs": "Drug", "plant family": "PlantFamily", "plantgenera": "PlantFamily", "lab method": "LabMethod"}
    cases = {
        "Metformin treats Diabetes Mellitus": [("Drug:CHEMBL1431", "treats", "Disease:MESH:D3920|Disease:MESH:D4", None)],
        '  "mellitus   diab"  TREATS human ': [("Disease:MESH:D3920|Disease:MESH:D4", "treats", "Species:9606", None)],
        "?X(PlantGenera) associated ?Y": [("?X(PlantFamily)", "associated", "?Y", None)],
        "Drugs treats plant_family": [("?Drug(Drug)", "treats", "?PlantFamily(PlantFamily)", None)],
        "mesh:d007 treats gene:CYP3A4": [("MeSH:MESH:D007", "treats", "Gene:CYP3A4", None)],
        "chembl25 induces fidx7_AND_ Metformin associated with treats nothing": [(None, None, None, "no relation"), (None, None, None, "object: unknown term")],
        "Simvastatin associated with human": [("Drug:CHEMBL1064", "associated with", "Species:9606", None)],
        "? treats human": [(None, None, None, "subject: variable without a name")],
        "human treats ?X(Ghost)": [(None, None, None, "object: unknown type")],
        "me treats human": [(None, None, None, "subject: unknown term")],
        "treats human": [(None, None, None, "no relation")],
        " _AND_ ": [(None, None, None, "empty")],
        None: [(None, None, None, "empty")],
    }
    queries = spark.createDataFrame([(i, q, "x") for i, q in enumerate(cases)], "id long, query string, relation string")
    got = translation.translate(queries, ["id"], index, ["treats", "associated", "associated with"], types)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r.fact)):
        found.setdefault(r.id, []).append((r.subject, r.relation, r.object, r.reason))
    assert found == dict(enumerate(cases.values()))
    summary = {r.id: (r.n_facts, r.reason) for r in translation.answerable(got, ["id"]).collect()}
    assert summary[0] == (1, None) and summary[5] == (0, "no relation") and summary[12] == (0, "empty")
    assert translation.translate(queries.limit(0), ["id"], index, ["treats"], types).collect() == []


def test_explanations(spark):
    names = {"d": ["Diabetes Mellitus", "Diabetes Meitus", "Diabetes Mellitus, Congenital Autoimmune", "diabetes mellitus", "x", None], "a": ["Ace", "Acetabulum", "A.c.e. inhibitor", "Zeta"], "n": ["!!", "a"], "many": [f"name{i:03d}" for i in range(30)]}
    df = spark.createDataFrame([(e, n) for e, ns in names.items() for n in ns], "entity_id string, name string")
    got = {r.entity_id: (r.names, r.n) for r in suggest.explanations(df, 25).collect()}
    assert got["d"] == (["Diabetes Meitus", "Diabetes Mellitus"], 2)
    assert got["a"] == (["A.c.e. inhibitor", "Ace", "Acetabulum", "Zeta"], 4)
    assert got["many"][0][-1] == "and 5 more" and got["many"][1] == 30 and "n" not in got


def test_paths(spark):
    rng = random.Random(6)
    nodes = {".".join(p[: k + 1]) for p in ([str(rng.randrange(3)) for _ in range(rng.randrange(1, 12))] for _ in range(120)) for k in range(len(p))}
    own = {n for n in nodes if rng.random() < 0.2}
    got = dict(map(tuple, results.compressed_paths(spark.createDataFrame([(n, n in own) for n in nodes], "node string, own boolean")).collect()))
    assert got == results.compress(dict.fromkeys(nodes, 1), own) and any(n != s for n, s in got.items())
    assert results.compressed_paths(spark.createDataFrame([], "node string, own boolean")).collect() == []
