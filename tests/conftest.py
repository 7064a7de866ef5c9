from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from caseload.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("the generated tables are not here")
    return path


def month_ends(start: str, periods: int) -> list[dt.date]:
    """The last days of ``periods`` months from the month of ``start`` on."""
    year, month = map(int, start.split("-")[:2])
    out = []
    for _ in range(periods):
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        out.append(dt.date(year, month, 1) - dt.timedelta(days=1))
    return out


@pytest.fixture
def make_series(spark):
    """``service, ds, y`` rows of one series."""

    def make(service: str, start: str, values) -> object:
        rows = [(service, d, float(v)) for d, v in zip(month_ends(start, len(values)), values, strict=True)]
        return spark.createDataFrame(rows, "service string, ds date, y double")

    return make


@pytest.fixture
def complete(make_series):
    return make_series("Nb Consultations", "2022-01-31", [100 + i + 7 * i % 10 for i in range(24)])


@pytest.fixture
def zeros(make_series):
    return make_series("Service Zéro", "2023-01-31", [0] * 12)


@pytest.fixture
def constant(make_series):
    return make_series("Paludisme", "2023-01-31", [50] * 12)


@pytest.fixture
def outlier(make_series):
    values = [5 + (13 * i) % 45 for i in range(24)]
    values[10] = 500
    return make_series("Service Outlier", "2023-01-31", values)


@pytest.fixture
def short(make_series):
    return make_series("Consultations PF", "2024-01-31", range(1, 11))
