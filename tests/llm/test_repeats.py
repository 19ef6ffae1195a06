"""One row of each group stays when rows repeat, share an id with other texts, or have no id."""

import pytest

from lumenfold.llm import exact, near

LONG = [" ".join(f"t{k}w{i}" for i in range(80)) for k in range(4)]


@pytest.fixture(scope="module")
def mixed_rows(spark):
    rows = [
        (1, LONG[0], {"a": 1}), (1, LONG[0], {"a": 1}), (2, LONG[0] + " ", None),  # repeated row, copy
        (3, LONG[1], None), (3, LONG[2], None),  # one id, two texts
        (None, LONG[1], None), (None, LONG[3], None), (None, LONG[3], None), (None, None, None), (7, "", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(4)


def test_exact_keeps_one_row_of_each_text(mixed_rows):
    got = exact.drop_exact_copies(mixed_rows)
    assert got.columns == mixed_rows.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # The longest text stays, with its blank; a null id loses ties.
    assert found == sorted([(2, LONG[0] + " "), (3, LONG[1]), (3, LONG[2]), (None, LONG[3]), (7, "")], key=str)


def test_near_keeps_one_row_of_each_class(mixed_rows):
    got = near.drop_near_copies(mixed_rows)
    assert got.columns == mixed_rows.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert found == sorted([(1, LONG[0]), (3, LONG[1]), (3, LONG[2]), (None, LONG[3]), (7, "")], key=str)


def test_near_compares_the_right_text_of_a_shared_id(spark):
    """Rows without ids, each with one near copy: every pair is verified with its own texts."""
    change = lambda t: " ".join(w if i != 40 else "other" for i, w in enumerate(t.split()))
    docs = spark.createDataFrame([(None, x) for t in LONG for x in (t, change(t))], "doc_id long, text string")
    assert near.drop_near_copies(docs).count() == len(LONG)


def test_substring_with_shared_and_missing_ids(spark, monkeypatch):
    """Rows that share an id lose nothing to each other but to smaller ids, each by its own text; rows without one stay whole. One block and many agree."""
    from lumenfold.llm import substring

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a b {passage} c"), (3, f"x {passage}"), (3, f"{passage} y z {LONG[0]}"), (3, f"{LONG[0]} end"), (5, f"{LONG[0]} {passage}"), (None, passage), (None, f"{passage} q"), (None, f"{passage} q"), (2, None), (2, f"{passage} {passage}")]
    want = sorted([(1, 33, 0), (3, 31, 30), (3, 112, 30), (3, 81, 0), (5, 110, 110), (None, 30, 0), (None, 31, 0), (None, 31, 0), (2, 0, 0), (2, 60, 60)], key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (substring.BLOCK_BYTES, 200):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        monkeypatch.setattr(substring, "BUCKET_BYTES", 2 * size)
        got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.repeated_words(docs).collect()]
        assert sorted(got, key=str) == want


def test_ids_that_are_strings(spark):
    """Exact and substring dedup take any ids that sort: strings go by code point."""
    from lumenfold.llm import substring

    rows = [("b10", LONG[0]), ("b9", LONG[0]), ("é", f"{LONG[1]} x"), ("a", f"y {LONG[1]}"), (None, LONG[1]), ("z", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.repeated_words(docs).collect()}
    assert got == {"b10": (80, 0), "b9": (80, 80), "é": (81, 80), "a": (81, 0), None: (80, 0), "z": (0, 0)}
    assert {r.doc_id: r.keep_id for r in exact.exact_dedup(docs).collect()} == {"b10": "b10", "b9": "b10", "é": "é", "a": "a", None: None, "z": "z"}


def test_hot_classes_meet_their_verdict_by_broadcast(spark, monkeypatch):
    """Whether texts and classes count as hot or not, the verdicts are the same."""
    change = lambda t, k: " ".join(w if i != 20 + k else "other" for i, w in enumerate(t.split()))
    rows = [(i, LONG[0]) for i in range(12)] + [(20 + k, change(LONG[0], k)) for k in range(6)] + [(40 + k, LONG[1 + k % 2]) for k in range(4)] + [(60, None), (None, LONG[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {**{i: (0, 18) for i in [*range(12), *range(20, 26)]}, 40: (40, 2), 42: (40, 2), 41: (41, 2), 43: (41, 2), 60: (60, 1), None: (None, 1)}
    for hot in (near.HOT, 1, 3):
        monkeypatch.setattr(near, "HOT", hot)
        assert {r.doc_id: (r.class_id, r.class_size) for r in near.near_duplicates(docs).collect()} == want


def test_labels_that_contradict_are_left_out(spark):
    from pyspark.sql import functions as F

    from lumenfold.llm import sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = sample.labelled(docs, labels, "doc_id", "text", "quality", F.lit(True), 10).collect()
    assert sorted((r.id, r.label) for r in got) == [(0, 1), (2, 0)]
