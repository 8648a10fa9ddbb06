"""Ordinal quality: gradients by differences, grades recovered, held-out accuracy, hard rows."""

import numpy as np
import pytest

from pulseboard.llm import quality as Q
from pulseboard.llm.common import table
from llm_fixtures import make_docs  # noqa: F401

SF = "/root/testdata/sf0.1"


def test_three_grades_are_recovered():
    rng = np.random.default_rng(0)
    rows, grade = [], []
    for k in range(600):
        g = k % 3
        text = " ".join(rng.choice(["good", "plain"] if g == 2 else ["plain", "!!x"] if g == 1 else ["!!x", "##y"], 30))
        rows.append(Q.text_vector(text.encode()))
        grade.append((0, 3, 9)[g])
    model = Q.fit_ordinal(rows, np.array(grade), [0, 3, 9])
    assert np.all(np.diff(model.thresholds) > 0)
    z = np.array([model.weights[p] @ v for p, v in rows])
    assert ((z[:, None] > model.thresholds).sum(1) == np.searchsorted([0, 3, 9], grade)).mean() > 0.97


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = Q.learn(docs, labels.where("doc_id % 4 != 0"))
    rows = Q.graded(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").select("quality", "tail_prob", "expected_grade").collect()
    good = [r.tail_prob >= 0.5 for r in rows if r.quality == 1]
    bad = [r.tail_prob >= 0.5 for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05
    assert all(r.expected_grade == pytest.approx(r.tail_prob) for r in rows)


def test_hard_rows(spark, make_docs):
    rows = [(k, "plain words in a row here") for k in range(50)] + [(100 + k, "BUY!! NOW!! " * 9) for k in range(50)]
    odd = [(500, None), (501, ""), (502, "x"), (503, "xy"), (504, "plain words " * 40_000), (None, "plain words in a row here"), (3, "plain words in a row here")]
    docs = make_docs(rows + odd, extra=["grade", "place", "value", "keep"])
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(None, 1), (7, None), (3, 0)], "doc_id bigint, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows + odd)
    assert all(r.keep == (r.doc_id is None or not 100 <= r.doc_id < 200) for r in got if r.doc_id is None or r.doc_id < 200 or r.doc_id == 504)
    assert len({r.tail_prob for r in got if r.doc_id in (500, 501)}) == 1
    grades = spark.createDataFrame([(k, k) for k in range(40)], "doc_id bigint, quality int")
    with pytest.raises(ValueError, match="grades"):
        Q.classify(docs, grades)


@pytest.mark.parametrize("labels,expected", [([], None), ([(1, 4)], 4.0)])
def test_no_choice(spark, make_docs, labels, expected):
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = Q.classify(make_docs([(1, "x y"), (2, None)]), frame).collect()
    assert [(r.expected_grade, r.tail_prob, r.keep) for r in got] == [(expected, 1.0, True)] * 2
    assert Q.classify(make_docs([]), frame).count() == 0
