"""Text, date and score expressions against fixed expectations."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from caseload.functions import dates, scoring, text
from caseload.functions.rules import HEADER_MONTHS, INDICATOR_RULES, MONTH_SPELLINGS


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    kinds = {str: "string", float: "double", int: "int", dt.date: "date", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (1,)], schema)
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "raw, name",
    [
        ("Nombre de consultants", "Nb Consultants"),
        ("TOTAL PALUDISME", "Paludisme"),
        ("Accouchement en établissement", "Accouchements"),
        ("ACCOUCHEMENT EN ÉTABLISSEMENT", "Accouchements"),
        ("Service Inconnu", "Service Inconnu"),
        ("nombre de consultants < 5 ans", "Nb Consultants <5 ans"),
        ("Nombre de consultants <10", "Nombre de consultants <10"),
        ("Nombre de consultations <5", "Nb Consultations <5 ans"),
        ("Nombre de consultants\n< 5", "Nb Consultants"),
        ("Décès", "Décès"),
        ("total deces", "Décès"),
        (" \t Cas Référés du mois\n", "Référés"),
        ("  padded  ", "padded"),
        (None, "nan"),
    ],
)
def test_standard_names(spark, raw, name):
    assert one(spark, text.standardise(F.col("raw")), raw=raw) == name


def test_rules_are_ordered_and_complete():
    assert len(INDICATOR_RULES) == 17
    assert len({name for _, name in INDICATOR_RULES}) == 17
    assert sum(map(len, MONTH_SPELLINGS.values())) == 50
    assert len(HEADER_MONTHS) == 15


def test_custom_rules(spark):
    rules = [("^a", "first"), ("b$", "second")]
    assert one(spark, text.standardise(F.col("raw"), rules), raw="  ab ") == "first"
    assert one(spark, text.standardise(F.col("raw"), rules), raw=" bb ") == "second"


@pytest.mark.parametrize(
    "raw, value, zeroed",
    [
        ("12", 12.0, 12.0),
        (" 12 ", 12.0, 12.0),
        ("1e3", 1000.0, 1000.0),
        (".5", 0.5, 0.5),
        ("5.", 5.0, 5.0),
        ("1,234", None, 0.0),
        ("12d", None, 0.0),
        ("inf", math.inf, math.inf),
        ("-Infinity", None, -math.inf),
        ("nan", None, 0.0),
        ("1_000", None, 0.0),
        ("", None, 0.0),
        ("-3", None, -3.0),
        ("0", 0.0, 0.0),
        (None, None, 0.0),
    ],
)
def test_numbers(spark, raw, value, zeroed):
    assert one(spark, text.numeric(F.col("v"), 0), v=raw) == value
    assert one(spark, text.numeric_or_zero(F.col("v")), v=raw) == zeroed


def test_numbers_that_are_doubles_already(spark):
    assert one(spark, text.at_least(F.col("v"), 0), v=math.nan) is None
    assert one(spark, text.at_least(F.col("v"), 0), v=-1.0) is None
    assert one(spark, text.zero_if_missing(F.col("v")), v=math.nan) == 0.0
    assert one(spark, text.zero_if_missing(F.col("v")), v=-1.0) == -1.0


@pytest.mark.parametrize("month, words", MONTH_SPELLINGS.items())
def test_month_names(spark, month, words):
    for word in words:
        assert one(spark, text.month_number(F.col("m")), m=f" {word.lower()} ") == month
    assert one(spark, text.month_number(F.col("m")), m="TOTAL") is None


@pytest.mark.parametrize(
    "path, year",
    [
        ("/data/LBS_matrice_2023.xlsx", 2023),
        ("file:/in/2019/matrice.csv", 2024),
        ("a20231231.csv", 2023),
        ("matrice.2022.csv", 2022),
        ("matrice.2022", 2024),
        ("x123.csv", 2024),
    ],
)
def test_year_from_name(spark, path, year):
    assert one(spark, text.year_from_name(F.col("p")), p=path) == year


def test_month_start(spark):
    assert one(spark, text.month_start(F.col("y"), F.col("m")), y=2023, m=2) == dt.date(2023, 2, 1)
    assert one(spark, text.month_start(F.col("y"), F.col("m")), y=2023, m=13) is None
    assert one(spark, text.month_start(F.col("y"), F.col("m")), y=0, m=1) is None


def test_strict_date(spark):
    assert one(spark, text.strict_date(F.col("d")), d="2023-02-01") == dt.date(2023, 2, 1)
    assert one(spark, text.strict_date(F.col("d")), d=None) is None
    with pytest.raises(SparkRuntimeException, match="not a date"):
        one(spark, text.strict_date(F.col("d")), d="soon")


@pytest.mark.parametrize(
    "target, months, through",
    [(None, 12, 12), (0, 12, 12), (2025, 12, 24), (2024, 1, 12), (2026, 24, 36), (2020, 1, 12)],
)
def test_horizon(spark, target, months, through):
    last = dt.date(2023, 12, 31)
    assert one(spark, dates.horizon_months(F.col("d"), target), d=last) == months
    assert one(spark, dates.horizon_months(F.col("d"), target, True), d=last) == through


def test_future_calendar(spark):
    ends = one(spark, dates.month_ends_after(F.col("d"), F.lit(3)), d=dt.date(2023, 11, 1))
    assert ends == [dt.date(2023, 12, 31), dt.date(2024, 1, 31), dt.date(2024, 2, 29)]


GOOD = dict(r2=0.9, mae=5.0, rmse=7.0, smape=3.0)
BAD = dict(r2=-0.5, mae=1000.0, rmse=2000.0, smape=150.0)
CONTEXT = dict(r2=0.8, mae=15.0, rmse=20.0, smape=8.0)


@pytest.fixture
def metrics(spark):
    return [F.col(name) for name in ("r2", "mae", "rmse", "smape")]


def test_composite_score(spark, metrics):
    assert one(spark, scoring.composite_score(*metrics), **GOOD) == pytest.approx(0.6308495145631068, abs=1e-15)
    assert one(spark, scoring.composite_score(*metrics), **BAD) == pytest.approx(0.16034967531219405, abs=1e-15)
    assert one(spark, scoring.composite_score(*metrics), **CONTEXT) == pytest.approx(0.5538822751322752, abs=1e-15)
    equal = one(spark, scoring.composite_score(*metrics, health=False), **CONTEXT)
    assert equal == pytest.approx(0.4590112433862434, abs=1e-15)


def test_score_of_unusable_metrics(spark, metrics):
    for broken in ({"mae": math.nan}, {"r2": math.nan}):
        assert one(spark, scoring.composite_score(*metrics), **{**GOOD, **broken}) == 0.0
        assert one(spark, scoring.display_score(*metrics), **{**GOOD, **broken}) == -math.inf
    null = F.lit(None).cast("double")
    assert one(spark, scoring.composite_score(null, *metrics[1:]), **GOOD) == 0.0
    assert one(spark, scoring.composite_score(metrics[0], F.lit(math.inf), *metrics[2:]), **GOOD) > 0.0
    assert one(spark, scoring.composite_score(None, None, None, None)) == 0.0
    perfect = dict(r2=1.0, mae=0.0, rmse=0.0, smape=0.0)
    assert one(spark, scoring.composite_score(*metrics), **perfect) == 1.0
    assert one(spark, scoring.display_score(*metrics, error=F.lit("x")), **GOOD) == -math.inf


@pytest.mark.parametrize(
    "score, four, three",
    [(0.8, "Excellent", "Excellent"), (0.7, "Bon", "Excellent"), (0.6, "Bon", "Bon"),
     (0.5, "Moyen", "Bon"), (0.4, "Moyen", "Faible"), (0.39, "Faible", "Faible")],
)
def test_bands(spark, score, four, three):
    assert one(spark, scoring.band4(F.col("s")), s=score) == four
    assert one(spark, scoring.band3(F.col("s")), s=score) == three


def test_null_metric_shows_as_zero(spark):
    assert one(spark, scoring.zero_if_null(F.lit(None).cast("double"))) == 0.0
