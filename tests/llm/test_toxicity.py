"""Toxicity: folding, matching, exceptions, held-out accuracy, hard rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from pulseboard.llm import toxicity as T
from pulseboard.llm.common import table
from llm_fixtures import make_docs  # noqa: F401

SF = "/root/testdata/sf0.1"


def matcher(exceptions=()):
    return T.Matcher({T.fold("idiot"): (2.0, True), T.fold("losers")[:6]: (1.0, True)}, exceptions)


@pytest.mark.parametrize("text,hits", [
    ("you IDIOT!", 1), ("an id10t", 1), ("an іdіоt", 1), ("ｉｄｉｏｔ", 1), ("id​iot, 1D1OT; !diot", 2), ("idiotic", 0), ("loserly LOSER", 2), ("closer", 0), ("idiot idiot", 2), ("", 0)])
def test_folding_and_matching(text, hits):
    assert matcher().measure(text)[2] == hits


def test_exceptions_and_heaviest_entry():
    m = matcher(["idiot savant"])
    assert m.measure("an idiot savant and an idiot") == (2.0, 0, 1, 6)
    both = T.Matcher({T.fold("idiot"): (2.0, True), T.fold("idiot")[:5]: (3.5, False)}, ())
    assert both.measure("idiot idiotic") == (2.0, 3.5, 1, 2)
    assert T.Matcher({}, ()).measure("a b") == (0, 0, 0, 2)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = T.score_toxicity(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    tp = sum(r.toxic and r.predicted for r in rows)
    fp = sum(not r.toxic and r.predicted for r in rows)
    # a few labels of this table mark texts without any toxic word
    assert tp >= 0.9 * sum(r.toxic for r in rows) and fp <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def rows_of():
    clean = [(k, f"the day number {k} is fine and so on") for k in range(60)]
    bad = [(1000 + k, f"the day {k} is for a dreckig fellow") for k in range(60)]
    return clean, bad


def test_small_and_hard_rows(spark, make_docs):
    clean, bad = rows_of()
    odd = [(2000, None), (2001, ""), (2002, "dreckig " * 20_000), (None, "dreckig"), (3, clean[3][1])]
    docs = make_docs(clean + bad + odd, extra=["weight", "hits", "toxic", "entry"])
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad] + [(None, 1), (5, None), (6, 7), (9_999_999, 1)], "doc_id bigint, toxic int")
    got = T.score_toxicity(docs, labels).collect()
    assert len(got) == len(clean + bad + odd)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        want = r.doc_id is None or 1000 <= r.doc_id < 2000 or r.doc_id == 2002
        assert (r.predicted == 1) == want, r
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.score_toxicity(docs, swapped).collect()}
    assert again == {r.doc_id: r.score for r in got}  # held-out labels change nothing


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in T.score_toxicity(make_docs([(1, "x")]), none).collect()] == [0]
    assert T.score_toxicity(make_docs([]), none).count() == 0
