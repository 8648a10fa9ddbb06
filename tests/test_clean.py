"""Cleaning semantics: lenient numbers (C1), blanks (C11), status forms (C3), headers and aliases."""

from pyspark.sql import functions as F

from conftest import tab
from pulseboard.functions import clean as C
from pulseboard.sources.literal import literal_frame
from pulseboard.sources.tabs import clean_tab, with_default


def test_to_number_c1(spark):
    cells = ["$1,200", "(500)", "85%", "1e5", "-3.5", "N/A", "", "  ", "Q3 2025", None, "1 000", "12.5.1", "+7",
             "inf", "€5"]
    expected = [1200, 500, 85, 15, -3.5, 0, 0, 0, 0, 0, 0, 0, 7, 0, 0]
    df = literal_frame(spark, [(i, c) for i, c in enumerate(cells)], [("i", "bigint"), ("c", "string")])
    got = {r.i: r.n for r in df.select("i", C.to_number(F.col("c")).alias("n")).collect()}
    assert [got[i] for i in range(len(cells))] == [float(x) for x in expected]


def test_to_number_numeric_column_is_cast_only(spark):
    df = literal_frame(spark, [(1.5,), (None,)], [("x", "double")])
    got = [r.n for r in df.select(C.to_number(F.col("x"), "double").alias("n")).collect()]
    assert sorted(got) == [0.0, 1.5]


def test_amo_form_number(spark):
    df = literal_frame(spark, [("$1,234",), ("abc",), (None,), ("12.5",)], [("x", "string")])
    got = [r.n for r in df.select(C.amo_form_number(F.col("x")).alias("n")).collect()]
    assert got == [1234.0, 0.0, 0.0, 12.5]


def test_to_date_iso_only(spark):
    df = literal_frame(spark, [("2025-01-04",), ("2025-02-30",), ("01/03/2025",), ("",), (None,)], [("x", "string")])
    got = [r.d for r in df.select(C.to_date(F.col("x")).alias("d")).collect()]
    assert str(got[0]) == "2025-01-04" and got[1:] == [None, None, None, None]


def test_blank_rows_c11(spark):
    rows = [{"Activity": "", "Type (Delivery/Sales/Ops)": ""}, {"Activity": "  "}, {"Activity": "x"}]
    df = clean_tab(tab(spark, "Executive Activity", rows), "Executive Activity")
    got = sorted((r["_row"], r["Activity"]) for r in df.collect())
    assert got == [(1, "  "), (2, "x")]


def test_headers_trimmed_and_aliases(spark):
    df = literal_frame(spark, [("High", "1", 0)], [(" Severity (High/Medium/Low) ", "string"), ("Impact ($)", "string"),
                                                   ("_row", "bigint")])
    out = clean_tab(df, "Project Risks")
    assert out.columns == ["Severity", "Impact ($)", "_row"]


def test_status_forms_c3(spark):
    vals = ["R", " r", "r", "G ", "y", None]
    df = literal_frame(spark, [(v,) for v in vals], [("s", "string")])
    kpi = [r.s for r in df.select(C.status_kpi(F.col("s")).alias("s")).collect()]
    page = [r.s for r in df.select(C.status_page(F.col("s")).alias("s")).collect()]
    assert kpi.count("R") == 3 and kpi.count("Y") == 1 and kpi.count("G") == 1
    assert [p for p in page if p in ("R", "Y")] == ["R", "R", "Y"]
    assert [v for v in vals if v in ("R", "Y")] == ["R"]


def test_with_default(spark):
    df = literal_frame(spark, [("a",)], [("x", "string")])
    assert with_default(df, "y", 0).columns == ["x", "y"]
    assert with_default(df, "x", 0).columns == ["x"]


def test_split_list_trims_and_dedupes(spark):
    df = literal_frame(spark, [("A, B ,A",), (None,)], [("x", "string")])
    got = [sorted(r.l) for r in df.select(C.split_list(F.col("x")).alias("l")).collect()]
    assert got == [["A", "B"], [""]]


def test_formats(spark):
    df = literal_frame(spark, [(1234.5, 0.25, -1234.4)], [("a", "double"), ("b", "double"), ("c", "double")])
    r = df.select(C.format_currency(F.col("a")).alias("a"), C.format_percentage(F.col("b")).alias("b"),
                  C.format_currency(F.col("c")).alias("c"), C.format_percentage(F.lit(12345.67)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("$1,234", "0.2%", "$-1,234", "12345.7%")


def test_csv_scan_then_clean(spark, tmp_path):
    from pulseboard.functions.clean import to_number
    from pulseboard.sources.tabs import scan_tab

    p = tmp_path / "tab.csv"
    p.write_text(' Project Name ,Revenue,Key Issues,_row\nA,"$1,200",,0\n,,,1\nB,(500),"x, y",2\n')
    df = clean_tab(scan_tab(spark, str(p), "csv"), "Project Inventory")
    assert df.columns == ["Project Name", "Revenue", "Key Issues", "_row"]
    assert dict(df.dtypes)["_row"] == "bigint"
    got = sorted((r["_row"], r["Project Name"], r.n, r["Key Issues"])
                 for r in df.select("*", to_number(F.col("Revenue")).alias("n")).collect())
    assert got == [(0, "A", 1200.0, None), (2, "B", 500.0, "x, y")]


def test_export_slug_and_enum_fallback(spark):
    from pulseboard.operators.report import export_slug

    assert export_slug("Project Inventory") == "project_inventory"
    df = literal_frame(spark, [("r",), ("X",), (None,)], [("s", "string")])
    got = [r.v for r in df.select(C.enum_or(F.col("s"), ("R", "Y", "G"), "G").alias("v")).collect()]
    assert got == ["R", "G", "G"]


def test_load_workbook_missing_tab_is_empty(spark, tmp_path):
    from pulseboard.sources.tabs import load_workbook

    tab(spark, "Talent Gaps", [{"Skill/Role Needed": "x"}]).write.parquet(str(tmp_path / "talent_gaps"))
    wb = load_workbook(spark, str(tmp_path), names=["Talent Gaps", "Operational Gaps"])
    assert wb["Talent Gaps"].count() == 1
    assert wb["Operational Gaps"].count() == 0 and "Operational Issue" in wb["Operational Gaps"].columns


def test_numbers_are_strict(spark):
    from pulseboard.functions import clean as C
    from pulseboard.operators import scenario as S

    df = spark.createDataFrame([("5d", 0.0), ("7f", 0.0), ("nan", 0.0), ("inf", 0.0), ("$1,5", 15.0), (" 5 ", 5.0), ("1e2", 100.0), (".5", 0.5), ("1_000", 0.0), ("\u00a05", 5.0)], "c string, want double")
    for r in df.select("want", C.amo_form_number("c").alias("got")).collect():
        assert r.got == r.want
    rows = spark.createDataFrame([("50f",), ("Infinity",), ("50",), (" 5 % ",), ("$1,000",), ("$x",)], "Value string").select(*[x.alias(n) for x, n in zip(S.parse_value(F.col("Value")), ("n", "ok"))]).collect()
    assert [(r.n, r.ok) for r in rows] == [(None, False), (None, False), (50.0, True), (5.0, True), (1000.0, True), (0.0, True)]


def test_unreadable_file_raises_and_missing_is_empty(spark, tmp_path):
    import pytest

    from pulseboard.sources.tabs import load_tab

    (tmp_path / "bad").write_bytes(b"PAR1 not parquet")
    with pytest.raises(Exception):
        load_tab(spark, str(tmp_path / "bad"), "Talent Gaps").count()
    assert load_tab(spark, str(tmp_path / "none"), "Talent Gaps").count() == 0


def test_csv_with_doubled_quotes(spark, tmp_path):
    from pulseboard.sources.tabs import load_tab

    (tmp_path / "t.csv").write_text('Skill/Role Needed,Urgency,_row\n"He said ""hi"", ok","a\nb",0\n,x,1\n')
    rows = load_tab(spark, str(tmp_path / "t.csv"), "Talent Gaps", "csv", multiline=True).orderBy("_row").collect()
    assert [tuple(r) for r in rows] == [('He said "hi", ok', "a\nb", 0), (None, "x", 1)]
