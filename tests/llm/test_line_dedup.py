"""Line dedup against brute force, at several batch counts and fan-outs."""

import hashlib

import pytest

from pulseboard.llm import line_dedup as L
from llm_fixtures import make_docs, rng  # noqa: F401

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least=10):
    held = {}
    for i, t in rows:
        for ln in (t or "").split("\n"):
            held.setdefault(key(ln), set()).add(2**63 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [ln for ln in lines if len(key(ln)) < least or len(held[key(ln)]) < 2 or min(held[key(ln)]) == (2**63 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng):
    pool = [f"Line Number {k} Éß" for k in range(40)] + ["short", "", "  \t", "ten chars!", "nine char"]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(rng.choice([0, 1, 3, 30])):
            ln = rng.choice(pool)
            lines.append(rng.choice([ln, ln.upper(), f" \t{ln}\r", ln.replace("É", "é")]))
        rows.append((rng.randrange(10_000), "\n".join(lines)))
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(None, "Line Number 3 Éß\nonly where no id stands"), (None, "only where no id stands"), (rows[0][0], rows[0][1]),
             (rows[1][0], rows[2][1]), (20_000, None), (20_001, ""), (20_002, "\n"), (20_003, "\n".join(pool * 300)), (20_004, "same line twice\nsame line twice"),
             (20_005, "Same Line Twice \nx")]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_matches_brute_force(spark, make_docs, rng, batches, fanout):
    rows = rows_of(rng)
    docs = make_docs(rows, extra=["owner", "h1", "at", "batch", "did", "drop", "row"])
    out = L.dedup_lines(docs, 10, batches, fanout)
    got = sorted(((r.row.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_digest_and_pipeline_form(spark, make_docs, rng):
    rows = rows_of(rng)
    docs = make_docs(rows, extra=["kept", "row", "lines"])
    assert sorted(map(tuple, L.line_digest(docs).collect()), key=str) == brute(rows)
    out = L.deduplicated(docs)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        assert (r.text is None) == (r.doc_id == 20_000)
        assert r.text is None or r.n_chars == len(r.text)


def test_empty_table(spark, make_docs):
    assert L.line_digest(make_docs([])).count() == 0


def test_no_python_in_the_plan(spark, make_docs):
    plan = L.line_digest(make_docs([(1, "a line of text")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
