"""Passages of rows that share an id, or have none."""

import random

from factloom.llm import suffix_dedup

RNG = random.Random(11)
FRESH = lambda n: " ".join(f"w{RNG.randrange(10**9)}" for _ in range(n))


def found(spark, rows, schema="doc_id long, text string"):
    return sorted(((r.doc_id, r.start_word, r.end_word, r.other_id) for r in suffix_dedup.passages(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_rows_of_one_id_are_not_merged(spark):
    p, q = FRESH(60), FRESH(55)
    rows = [(None, f"{p} {FRESH(3)}"), (None, f"{FRESH(40)} {q}"), (1, f"{FRESH(5)} {p}"), (2, q)]
    assert found(spark, rows) == sorted([(None, 0, 60, 1), (None, 40, 95, 2), (1, 5, 65, None), (2, 0, 55, None)], key=repr)


def test_rows_of_one_id_match_each_other(spark):
    p = FRESH(50)
    rows = [(7, f"{p} {FRESH(2)}"), (7, f"{FRESH(9)} {p}"), (8, FRESH(70))]
    assert found(spark, rows) == [(7, 0, 50, 7), (7, 9, 59, 7)]


def test_equal_rows_count_once(spark):
    p = FRESH(80)
    assert found(spark, [(7, p), (7, p), (None, None), (None, None), (3, "")]) == []
    assert found(spark, [(7, p), (7, p), (8, p)]) == [(7, 0, 80, 8), (8, 0, 80, 7)]


def test_hashes_and_numbers_agree(spark):
    shared = [FRESH(50 + 7 * k) for k in range(4)]
    rows = [(i, f"{FRESH(i)} {shared[i % 4]} {FRESH(9)}") for i in range(1, 20)] + [(50, FRESH(100))]
    whole = {r[:3] for r in found(spark, rows)}
    assert {r[:3] for r in found(spark, [*rows, (None, FRESH(60))])} == whole
    assert {(int(r[0]), *r[1:3]) for r in found(spark, [(str(i), t) for i, t in rows], "doc_id string, text string")} == whole and len(whole) == 19
