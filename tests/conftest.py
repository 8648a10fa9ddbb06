import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pulseboard.session import get_session

    s = get_session("local[*]", shuffle_partitions=8, app_name="pulseboard-tests", driver_memory="8g")
    yield s


def tab(spark, tab_name, rows, cols=None):
    """A tab from python rows: all text cells plus ``_row`` = position."""
    from pulseboard.sources.literal import literal_frame
    from pulseboard.sources.tabs import TAB_COLUMNS

    cols = list(cols or TAB_COLUMNS[tab_name])
    data = []
    for i, r in enumerate(rows):
        r = dict(r)
        data.append(tuple(r.get(c) for c in cols) + (i,))
    return literal_frame(spark, data, [(c, "string") for c in cols] + [("_row", "bigint")])
