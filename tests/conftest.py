import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiforge.functions.columns import DEFAULT_COLUMNS as C  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from kpiforge.session import get_session
    return get_session(master="local[*]", shuffle_partitions=8, driver_memory="8g")


LEDGER_SCHEMA = (f"`{C['date']}` timestamp, `{C['amount']}` double, `{C['qty']}` long, "
                 f"`{C['category']}` string, `{C['region']}` string, `{C['customer']}` string")


def make_ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


REGIONS = ["东部", "西部", "海岛"]


@pytest.fixture(scope="session")
def spring_ledger(spark):
    """100 days from 2023-02-10, one to four sales a day, by formula."""
    kinds = ["家具", "文具", "玩具", "园艺", "乐器"]
    rows = []
    for d in range(100):
        day = dt.datetime(2023, 2, 10) + dt.timedelta(days=d)
        for j in range(1 + d * d % 4):
            n = 97 * d + 53 * j
            rows.append((day, 40 + n % 811 * 1.25, 1 + n % 6, kinds[n % 5], REGIONS[n % 3], f"K{n % 23:02d}"))
    return make_ledger(spark, rows)


@pytest.fixture(scope="session")
def tilted_ledger(spark):
    """70 days; of six kinds each sells for less than half of what the one before does."""
    rows = []
    for d in range(70):
        day = dt.datetime(2023, 9, 1) + dt.timedelta(days=d)
        for k in range(6):
            if (d + k) % 3:
                rows.append((day, round(900 / 2.5**k + (13 * d + k) % 17, 2), 1, f"kind{k}", REGIONS[d % 3], f"K{(5 * d + k) % 31:02d}"))
    return make_ledger(spark, rows)


def collect(df, *cols):
    rows = df.collect()
    if not cols:
        return [r.asDict() for r in rows]
    return [tuple(r[c] for c in cols) for r in rows]
