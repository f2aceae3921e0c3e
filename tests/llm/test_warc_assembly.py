"""Transactions of archives from elsewhere: every record is in a row, however identifiers connect them."""

import pytest

from factloom.llm import warc

SCHEMA = warc.RECORD


def records(spark, rows):
    """rows: (record_id, type, concurrent_to)"""
    names = [f.split(" ")[0] for f in SCHEMA.replace("map<string,string>", "map").split(", ")]
    full = [tuple({"record_id": i, "type": t, "concurrent_to": c, "fields": {"of": str(i)}, "payload_bytes": 1}.get(n) for n in names) for i, t, c in rows]
    return spark.createDataFrame(full, SCHEMA)


def shape(df):
    ids = lambda rs: [r.record_id for r in rs]
    return sorted(((r.response and r.response.record_id, ids(r.request), ids(r.metadata), ids(r.others)) for r in df.collect()), key=repr)


CASES = {
    "one hop": ([("a", "response", None), ("q", "request", "a"), ("m", "metadata", "a")], [("a", ["q"], ["m"], [])]),
    "two metadata": ([("a", "response", None), ("m1", "metadata", "a"), ("m2", "metadata", "a"), ("q", "request", "a")], [("a", ["q"], ["m1", "m2"], [])]),
    "resource and lone request": ([("a", "resource", None), ("m", "metadata", "a"), ("q", "request", None), ("w", "warcinfo", None)], [("a", [], ["m"], []), (None, ["q"], [], []), (None, [], [], ["w"])]),
    "response names request, metadata the response": ([("q", "request", None), ("a", "response", "q"), ("m", "metadata", "a")], [("a", ["q"], ["m"], [])]),
    "each names the other": ([("q", "request", "a"), ("a", "response", "q"), ("m", "metadata", "q"), ("b", "response", None), ("n", "metadata", "b")], [("a", ["q"], ["m"], []), ("b", [], ["n"], [])]),
    "a long chain": ([("r0", "response", None), *[(f"r{i}", "metadata", f"r{i - 1}") for i in range(1, 30)]], [("r0", [], sorted(f"r{i}" for i in range(1, 30)), [])]),
    "named record is missing": ([("m", "metadata", "gone"), ("n", "metadata", "gone"), ("a", "revisit", None)], [(None, [], ["m", "n"], []), ("a", [], [], [])]),
    "two responses": ([("a", "response", None), ("b", "response", "a"), ("q", "request", "a")], [("a", ["q"], [], []), ("b", ["q"], [], [])]),
    "no ids": ([(None, "response", None), (None, "response", None), (None, "metadata", None), (None, "metadata", "a"), ("a", "response", None)], [("a", [], [None], []), (None, [], [], []), (None, [], [], []), (None, [], [None], [])]),
    "nothing": ([], []),
}


@pytest.mark.parametrize("case", CASES)
def test_assembly(spark, case):
    rows, want = CASES[case]
    got = warc.assemble(records(spark, rows))
    assert shape(got) == sorted(want, key=repr)
    for r in got.collect():
        assert all(x.fields == {"of": str(x.record_id)} for x in [*r.request, *r.metadata, *r.others])
