"""Dates by a column's first value, and histograms with round edges."""

import datetime as dt
import math
import random
import warnings
from fractions import Fraction

import pandas as pd
import pytest

from conftest import tab
from pulseboard.functions import clean as C
from pulseboard.operators import distributions as DI
from pulseboard.operators import kpis as K
from pulseboard.sources.literal import literal_frame

COLUMNS = {
    "iso": ["2024-03-05", "2024-02-30", "05.03.2024", None, "2024-12-31"],
    "day": ["31.01.2024", "05.02.2024", "02/03/2024", "", "12.13.2024"],
    "month": ["02/03/2024", "13/03/2024", "12/31/2024", "2024-01-01", None],
    "blank first": [None, "", "25/12/2023", "01/02/2024", "12/25/2023"],
    "named": ["05-Mar-2024", "31-Dec-2023", "05-Foo-2024", "2024-03-05", None],
    "words": ["Mar 05, 2024", "Dec 31, 2023", "Mar 5 2024", None, None],
    "timed": ["2024-03-05 10:15:00", "2024-03-06 23:59:59", "2024-03-07", None, "x"],
    "compact": ["20240305", "20241231", "20241332", None, "2024"],
    "none": ["soon", "2024-01-01", None, "01/02/2024", ""],
    "empty": [None, None, "", None, None],
}


def test_dates_follow_the_first_value(spark):
    names = list(COLUMNS)
    df = literal_frame(spark, [tuple(COLUMNS[c][i] for c in names) + (i,) for i in range(5)], [(c, "string") for c in names] + [("_row", "bigint")])
    got = C.dates_by_first(df.repartition(3), {f"d_{c}": c for c in names}).orderBy("_row").collect()
    for c in names:
        cells = [v if v else None for v in COLUMNS[c]]
        if c == "none":  # nothing to go by: no cell is read
            want = [None] * 5
        else:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                want = [None if pd.isna(x) else x.date() for x in pd.to_datetime(pd.Series(cells, dtype="object"), errors="coerce")]
        assert [r[f"d_{c}"] for r in got] == want, c
    assert C.dates_by_first(df.limit(0), {"d": "iso"}).count() == 0


def test_frames_take_either_reading(spark):
    d = dt.date(2025, 6, 30)
    rows = [{"Project Name": "a", "Project End Date": "31/12/2025"}, {"Project Name": "b", "Project End Date": "01/02/2025"}, {"Project Name": "c", "Project End Date": "2025-12-31"}]
    t = tab(spark, "Project Inventory", rows)
    first = K.project_frame(t, dates="first")
    assert [r["__end"] for r in first.orderBy("_row").collect()] == [dt.date(2025, 12, 31), dt.date(2025, 2, 1), None]
    assert K.next_deal_gap(first, d).first().overdue_next_deal_discussion_count == 1
    assert [r["__end"] for r in K.project_frame(t).orderBy("_row").collect()] == [None, None, dt.date(2025, 12, 31)]
    with pytest.raises(ValueError):
        K.project_frame(t, dates="guess")
    assert K.project_frame(t.drop("Project End Date"), dates="first").first()["__end"] is None


def brute(values, bins):
    lo, hi = min(values), max(values)
    if lo == hi:
        widths = [Fraction(1)]
    else:
        widths = sorted(Fraction(m) * Fraction(10) ** d for d in range(-12, 15) for m in (1, 2, 5))
    exact = [Fraction(repr(v)) for v in values]
    for w in widths:
        places = [math.floor(v / w) for v in exact]
        if max(places) - min(places) < bins:
            low = min(places)
            return sorted((p - low, float(p * w), float((p + 1) * w), places.count(p)) for p in set(places))


def test_round_edges(spark):
    rng = random.Random(4)
    sets = [[0.1, 0.2, 0.3, 0.7, 0.29], [5.0, 5.0], [0.0, 100.0], [float(i) for i in range(0, 101, 5)], [-3.5, 2.25, 7.125], [1e6, 3e6, 2.5e6], [0.001, 0.0035],
            [84.99, 85.0, 69.995, 70.0]] + [[round(rng.uniform(-50, 150), 2) for _ in range(40)] for _ in range(6)]
    for values in sets:
        for bins in (10, 4):
            rows = [{"Project Name": "p", "Project Health Score": "x"} for _ in values]
            df = tab(spark, "Project Inventory", rows)
            df = df.join(literal_frame(spark, [(i, v) for i, v in enumerate(values)], [("_row", "bigint"), ("__health", "double")]), "_row")
            got = DI.round_histogram(df, DI.PROJECT_SCORES[:1], bins).collect()
            assert sorted((r.bin, r.bin_low, r.bin_high, r.bin_count) for r in got) == brute(values, bins), values
            assert len(got) <= bins
    with pytest.raises(ValueError):
        DI.round_histogram(df, DI.PROJECT_SCORES[:1], 1)
    assert DI.round_histogram(df.limit(0), DI.PROJECT_SCORES[:1]).count() == 0
