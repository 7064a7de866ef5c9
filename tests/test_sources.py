"""Matrix files, long tables and stored results on real files."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

import caseload
from caseload.operators.prepare import prepare, split_by_history
from caseload.plans import reports
from caseload.sources.long_table import read_long_csv, write_long_csv
from caseload.sources.matrices import matrix_to_long, read_matrices

MONTHS = "JANVIER,FEV,MARS,AVR,MAI,JUIN,JUILLET,AOÛT,SEPTEMBRE,OCTOBRE,NOVEMBRE,DECEMBRE"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    def write(name: str, content: str) -> str:
        path = tmp_path / name
        path.write_text(content, encoding="utf-8")
        return str(path)

    return write


def test_matrix_with_every_kind_of_cell(spark, folder):
    path = folder(
        "matrix_2023.csv",
        "﻿Rapport annuel,,\n\n"
        f"Indicateur,{MONTHS}\n"
        "TOTAL PALUDISME,1,2,-3,abc,,6,1e1,0,9,10,11,12\n"
        ',1,1,1,1,1,1,1,1,1,1,1,1\n'
        '"A, ""B""",7\n',
    )
    long, errors = read_matrices(spark, path)
    found = rows(long)
    assert (dt.date(2023, 1, 1), 'A, "B"', 7.0) in found
    malaria = [r for r in found if r[1] == "TOTAL PALUDISME"]
    assert [r[0].month for r in malaria] == [1, 2, 6, 7, 8, 9, 10, 11, 12]
    assert malaria[3] == (dt.date(2023, 7, 1), "TOTAL PALUDISME", 10.0)
    assert len(found) == 10
    assert errors.count() == 0


def test_bad_files_are_listed_and_the_rest_is_read(spark, folder, tmp_path):
    paths = [
        folder("matrix_2021.csv", "Service,JANVIER\nX,1\n"),
        folder("matrix_noyear.csv", "Nom,MARS\nX,3\n"),
        folder("matrix_noheader_2024.csv", "a,b\nc,d\n"),
        folder("matrix_late_2024.csv", "t\n" * 10 + "Service,JANVIER\nX,1\n"),
        folder("matrix_in_time_2022.csv", "t\n" * 9 + "Service,JANVIER\nX,5\n"),
        folder("matrix_twice_2024.csv", "Service,JANVIER,JAN\nX,1,2\n"),
        folder("matrix_nodata_2024.csv", "Service,JANVIER\nX,abc\n"),
        folder("matrix_empty_2024.csv", ""),
        str(tmp_path / "missing_2024.csv"),
    ]
    long, errors = read_matrices(spark, paths)
    assert rows(long) == [
        (dt.date(2021, 1, 1), "X", 1.0), (dt.date(2022, 1, 1), "X", 5.0), (dt.date(2024, 3, 1), "X", 3.0),
    ]
    reasons = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in errors.collect()}
    assert reasons == {
        "matrix_noheader_2024.csv": "no header row with a month name",
        "matrix_late_2024.csv": "no header row with a month name",
        "matrix_twice_2024.csv": "two columns of the same month",
        "matrix_nodata_2024.csv": "no usable value",
        "matrix_empty_2024.csv": "empty file",
        "missing_2024.csv": "file does not exist",
    }


def test_header_is_the_first_row_with_a_full_month_name(spark, folder):
    path = folder("m_2020.csv", "Service,JAN,FEV\nService,MARS,AVR\nX,1,2\nMAI,3,4\n")
    assert rows(read_matrices(spark, path)[0]) == [
        (dt.date(2020, 3, 1), "MAI", 3.0), (dt.date(2020, 3, 1), "X", 1.0),
        (dt.date(2020, 4, 1), "MAI", 4.0), (dt.date(2020, 4, 1), "X", 2.0),
    ]


def test_label_column_by_keyword_then_text_then_first(spark, folder):
    keyword = folder("k_2020.csv", "Zone,Nom du service,JANVIER\nz,X,1\n")
    first_text = folder("t_2021.csv", "No,Nom,Autre,JANVIER\n1,,a,3\n2,Y,b,4\n")
    numbers = folder("n_2022.csv", "No,JANVIER\n7,1\n")
    found = rows(read_matrices(spark, [keyword, first_text, numbers])[0])
    assert found == [
        (dt.date(2020, 1, 1), "X", 1.0), (dt.date(2021, 1, 1), "Y", 4.0), (dt.date(2022, 1, 1), "7", 1.0),
    ]


def test_missing_cells_and_repeated_columns(spark, folder):
    missing = folder("a_2020.csv", "No,Nom,JANVIER,MARS\nNA,X,1,n/a\n2,NULL,3,4\n3,nan bis,5,6\n")
    repeated = folder("b_2021.csv", "Service,JANVIER,JANVIER\nY,1,2\n")
    found = rows(read_matrices(spark, [missing, repeated])[0])
    assert found == [
        (dt.date(2020, 1, 1), "X", 1.0), (dt.date(2020, 1, 1), "nan bis", 5.0),
        (dt.date(2020, 3, 1), "nan bis", 6.0), (dt.date(2021, 1, 1), "Y", 1.0),
    ]


def test_large_file_in_many_splits(spark, folder):
    """Row order must hold when one file is read by many tasks."""
    body = "".join(f"label {i},{i},{i + 1}\n" for i in range(20000))
    path = folder("big_2019.csv", "titre\nIndicateur,JANVIER,MARS\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        long, errors = read_matrices(spark, path)
        total = long.agg(F.count("*"), F.sum("valeur")).first()
        late = folder("late_2019.csv", "titre un peu long\n" * 3000 + "Indicateur,JANVIER\nX,1\n")
        rejected = read_matrices(spark, late)[1].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(total) == (40000, 20000.0 * 20000)
    assert errors.count() == 0
    assert [r["reason"] for r in rejected] == ["no header row with a month name"]


def test_semicolon_files(spark, folder):
    path = folder("m_2020.csv", 'Service;JANVIER\n"a;b";3\n')
    assert rows(read_matrices(spark, path, sep=";")[0]) == [(dt.date(2020, 1, 1), "a;b", 3.0)]


def test_no_file_at_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_matrices(spark, [str(tmp_path / "nothing.csv")])


def test_matrix_frame_refuses_bad_months(spark):
    df = spark.createDataFrame([("X", "1", "2")], "Service string, JAN string, JANVIER string")
    with pytest.raises(ValueError):
        matrix_to_long(df, "Service", ["JAN", "JANVIER"], 2020)
    with pytest.raises(ValueError):
        matrix_to_long(df, "Service", ["Service"], 2020)
    assert rows(matrix_to_long(df, "Service", ["JAN"], 2020)) == [(dt.date(2020, 1, 1), "X", 1.0)]


def test_long_csv(spark, folder, tmp_path):
    path = folder(
        "long.csv",
        "date,SERVICE,valeur,zone\n2022-01-01,Nombre de consultants,5,a\n2022-02-01,total ira,x,b\n"
        "2023-01-01,TOTAL IRA,-2,b\n2022-01-01,Autre,1,c\n",
    )
    df = read_long_csv(spark, path)
    assert df.columns == ["date", "SERVICE", "valeur", "zone"]
    ready = prepare(df)
    assert ready.columns == ["ds", "service", "y", "zone"]
    assert rows(ready) == [
        (dt.date(2022, 1, 1), "Nb Consultants", 5.0, "a"),
        (dt.date(2022, 2, 1), "Infections Respiratoires", 0.0, "b"),
        (dt.date(2023, 1, 1), "Infections Respiratoires", -2.0, "b"),
    ]
    assert prepare(df, target_year=2023).count() == 2
    assert prepare(df, target_year=0).count() == 3
    assert prepare(df, keys=["Autre"]).count() == 1
    assert prepare(df, keys=None).count() == 4
    table = spark.createDataFrame([("Autre",)], "name string")
    assert prepare(df, keys=table).count() == 1
    view = caseload.load_and_prepare(spark, path)
    assert view.columns == ["date", "service", "valeur", "zone"]
    written = write_long_csv(prepare(df).select(
        F.col("ds").alias("date"), F.col("service").alias("SERVICE"), F.col("y").alias("valeur")
    ), str(tmp_path / "out"))
    assert rows(prepare(read_long_csv(spark, written))) == rows(ready.drop("zone"))


def test_long_csv_is_checked(spark, folder):
    with pytest.raises(ValueError, match="valeur"):
        read_long_csv(spark, folder("a.csv", "date,SERVICE\n2020-01-01,X\n"))
    with pytest.raises(ValueError, match="no rows"):
        read_long_csv(spark, folder("b.csv", "date,SERVICE,valeur\n"))
    with pytest.raises(ValueError, match="nothing"):
        write_long_csv(
            spark.createDataFrame([], "date date, SERVICE string, valeur double"), "/nowhere"
        )
    bad = read_long_csv(spark, folder("c.csv", "date,SERVICE,valeur\nsoon,TOTAL IRA,1\n"))
    with pytest.raises(Exception, match="not a date"):
        prepare(bad).collect()


def test_duplicates_stay_unless_summed(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [(day, "TOTAL IRA", 1.0), (day, "total ira bis", 2.0)], "date date, SERVICE string, valeur double"
    )
    assert prepare(df).count() == 2
    assert rows(prepare(df, dedupe="sum")) == [("Infections Respiratoires", day, 3.0)]
    with pytest.raises(ValueError):
        prepare(df, dedupe="other")


def test_history_split_counts_rows(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", day, 1.0)] * 12 + [("b", day, 1.0)] * 11, "service string, ds date, y double")
    enough, short = split_by_history(df)
    assert enough.count() == 12
    assert rows(short) == [("b", 11)]


def test_whole_run(spark, folder, tmp_path):
    for year in (2021, 2022, 2023):
        values = ",".join(str(100 + (year - 2020) * 5 + i) for i in range(12))
        folder(
            f"matrice_{year}.csv",
            f"Indicateur,{MONTHS}\nNombre de consultants,{values}\nTOTAL PALUDISME,{values}\nTOTAL IRA,1\n",
        )
    out = str(tmp_path / "out")
    tables = caseload.run_full_analysis(spark, str(tmp_path / "matrice_*.csv"), out, target_year=2025)
    picked = {r["service"]: r for r in tables.selection.collect()}
    assert set(picked) == {"Nb Consultants", "Paludisme", "Infections Respiratoires"}
    assert picked["Infections Respiratoires"]["error"].startswith("Données historiques insuffisantes")
    future = tables.forecasts.where("kind = 'future'")
    assert future.groupBy("service", "model").count().where("count <> 12").count() == 0
    assert future.agg(F.max("ds")).first()[0] == dt.date(2024, 12, 31)
    again = caseload.load_results(spark, f"{out}/results", 2025)
    assert again.metrics.count() == 6
    for name in ("summary", "comparison", "forecasts", "charts", "run_summary", "ranking", "errors"):
        assert spark.read.parquet(f"{out}/reports_2025/{name}").count() > 0
    before = caseload.run_full_analysis(spark, str(tmp_path / "matrice_*.csv"), out)
    assert before.selection.count() == 3
    kept = caseload.load_results(spark, f"{out}/results").selection
    assert {r[0] for r in kept.select("run_year").distinct().collect()} == {2023, 2025}


def test_a_stopped_run_leaves_the_last_one_in_view(spark, tmp_path):
    from caseload.operators.forecast import ForecastTables
    from caseload.sources.results import load_results, published, save_results

    def tables(value: float, broken: bool = False):
        one = spark.createDataFrame([("S", value)], "service string, y double")
        bad = one.withColumn("y", F.when(F.lit(True), F.raise_error(F.lit("stopped"))).cast("double")) if broken else one
        return ForecastTables(one, one, bad, one)

    path = str(tmp_path / "results")
    save_results(tables(1.0), path, 2024)
    with pytest.raises(Exception, match="stopped"):
        save_results(tables(2.0, broken=True), path, 2024)  # history and forecasts written, then it stops
    seen = load_results(spark, path, 2024)
    assert [r.y for r in seen.history.collect()] == [1.0] and [r.y for r in seen.selection.collect()] == [1.0]
    save_results(tables(3.0), path, 2024)
    save_results(tables(9.0), path, 2023)
    assert [r.y for r in load_results(spark, path, 2024).metrics.collect()] == [3.0]
    assert sorted(published(spark, path)) == [2023, 2024]
    assert sorted(r.y for r in load_results(spark, path).forecasts.collect()) == [3.0, 9.0]


def test_unreadable_results_are_none(spark, tmp_path):
    assert caseload.load_results(spark, str(tmp_path / "nothing")) is None


def test_rules_run_per_row_when_labels_are_many(spark, monkeypatch):
    from caseload.operators import prepare as module

    rows = [(f"TOTAL IRA {i}", 1) for i in range(50)] + [(None, 1), (" x ", 1)]
    df = spark.createDataFrame(rows, "label string, v int")
    few = module.name_indicators(df, "label")
    monkeypatch.setattr(module.lookup, "MAX_BROADCAST_BYTES", 99)
    many = module.name_indicators(df, "label")
    row = module.name_indicators(df, "label", per="row")
    assert "Join" not in many._jdf.queryExecution().toString()
    found = [sorted(map(tuple, d.collect())) for d in (few, many, row)]
    assert found[0] == found[1] == found[2]
    assert found[0].count(("Infections Respiratoires", 1)) == 50
    keyed = module.name_indicators(df, "label", keys=["x"], per="row")
    assert keyed.collect() == module.name_indicators(df, "label", keys=["x"]).collect() == [("x", 1)]


def test_one_label_with_a_third_of_the_rows(spark):
    """A hot label and a hot date go through naming, sorting and the series arrays."""
    from caseload.operators.forecast import series_arrays
    from caseload.operators.prepare import in_series_order

    hot = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "TOTAL IRA").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("SERVICE"),
        F.when(F.col("id") % 2 == 0, F.lit("2020-01-01")).otherwise(F.lit("2020-02-01")).cast("date").alias("date"),
        F.lit(1.0).alias("valeur"),
    )
    ready = prepare(hot, keys=None)
    assert ready.where("service = 'Infections Respiratoires'").count() == 6667
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_series_order(ready).select(F.spark_partition_id().alias("at"), "service").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["service"] for r in placed] == sorted(r["service"] for r in placed)
    sizes = Counter(r["at"] for r in placed)
    assert max(sizes.values()) < 6667 and len(placed) == 20000
    arrays = series_arrays(ready.select("service", "ds", "y"))
    assert arrays.agg(F.max(F.size("days"))).first()[0] == 2


def test_reports_need_results(spark, tmp_path):
    with pytest.raises(ValueError):
        caseload.save_reports({}, str(tmp_path))
    empty = spark.createDataFrame([], "a int")
    assert caseload.save_reports({"none": empty}, str(tmp_path)) == []


def test_csv_reports(spark, tmp_path, complete):
    tables = caseload.forecast(complete)
    written = caseload.save_reports({"s": reports.summary(tables)}, str(tmp_path), fmt="csv")
    assert written == ["s"]
    back = spark.read.option("header", True).csv(f"{tmp_path}/s")
    assert back.columns[:3] == ["Service", "Meilleur Modèle", "Score Composite"]


def test_long_csv_is_read_by_name(spark, folder, tmp_path):
    path = folder("long.csv", "SERVICE,valeur,date\nA,1.5,2024-01-01\n")
    schema = "date string, SERVICE string, valeur double"
    found = read_long_csv(spark, path, spark.createDataFrame([], schema).schema)
    assert rows(found) == [("2024-01-01", "A", 1.5)]
    assert rows(read_long_csv(spark, path).select("SERVICE", "valeur")) == [("A", "1.5")]


def test_long_csv_of_unlike_headers_is_refused(spark, tmp_path):
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.csv").write_text("date,SERVICE,valeur\n2024-01-01,A,1\n")
    (mixed / "b.csv").write_text("SERVICE,date,valeur\nB,2024-02-01,2\n")
    with pytest.raises(Exception, match="header"):
        read_long_csv(spark, str(mixed)).collect()


def test_long_csv_of_unlike_headers_is_united_by_name(spark, tmp_path):
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.csv").write_text("date,SERVICE,valeur\n2024-01-01,A,1\n2024-01-02,A,5\n")
    (mixed / "b.csv").write_text('SERVICE,"date",valeur,zone\nB,2024-02-01,2,n\n')
    (mixed / "c.csv").write_text("date,SERVICE,valeur\n2024-03-01,C,3\n")
    (mixed / "d.csv").write_text("")
    wanted = [("2024-01-01", "A", "1", None), ("2024-01-02", "A", "5", None), ("2024-02-01", "B", "2", "n"), ("2024-03-01", "C", "3", None)]
    found = read_long_csv(spark, str(mixed), mixed_headers=True)
    assert sorted(map(tuple, found.select("date", "SERVICE", "valeur", "zone").collect()), key=str) == wanted
    schema = spark.createDataFrame([], "valeur double, date string, SERVICE string").schema
    typed = read_long_csv(spark, str(mixed), schema, mixed_headers=True)
    assert rows(typed) == [(1.0, "2024-01-01", "A"), (2.0, "2024-02-01", "B"), (3.0, "2024-03-01", "C"), (5.0, "2024-01-02", "A")]
    (mixed / "e.csv").write_text("date,SERVICE\n2024-03-01,C\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_long_csv(spark, str(mixed), mixed_headers=True)


def test_reading_matrices_leaves_the_session_as_it_was(spark, folder):
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    read_matrices(spark, folder("matrix_2020.csv", "Service,JANVIER\nX,1\n"))
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before


def test_year_from_a_folder(spark, tmp_path):
    place = tmp_path / "year=2019"
    place.mkdir()
    (place / "part-00001234.csv").write_text("Service,JANVIER\nX,1\n")
    long, _ = read_matrices(spark, str(tmp_path), year_of=lambda path: F.regexp_extract(path, "/year=([0-9]{4})/", 1))
    assert rows(long) == [(dt.date(2019, 1, 1), "X", 1.0)]
