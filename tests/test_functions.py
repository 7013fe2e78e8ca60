from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quarryline import functions as fn


def values(spark, texts, column, kind="string"):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"k int, t {kind}")
    return [r["v"] for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_clean_text_and_casts(spark):
    assert values(spark, ["  a b \t", "", "   ", None, " x "], fn.clean_text("t")) == ["a b", None, None, None, "x"]
    assert values(spark, [" 12 ", "", None, "12.5", "x"], fn.safe_int("t", "null")) == [12, None, None, None, None]
    assert values(spark, [" 1.5 ", " ", "-2"], fn.safe_decimal("t")) == [1.5, None, -2.0]
    assert values(spark, ["T", " yes", "0", "NO ", "maybe", "", None], fn.safe_bool("t")) == [True, True, False, False, None, None, None]
    for strict in (fn.safe_int("t"), fn.safe_decimal("t"), fn.safe_datetime("t"), fn.safe_date("t", format="%Y-%m-%d")):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
            values(spark, ["abc"], strict)


def test_dates(spark):
    texts = ["2024-01-05", "20240105", "05-Jan-24", "05-JAN-2024", "Jan 05, 2024", "2024/01/05", "15-Jan-85", "01/05/2024", "2024-13-01", "", None]
    d = date(2024, 1, 5)
    assert values(spark, texts, fn.safe_date("t")) == [d, d, d, d, d, d, date(1985, 1, 15), None, None, None, None]
    assert values(spark, ["05-January-2024", "x"], fn.safe_date("t", formats=["%d-%B-%Y"])) == [d, None]
    assert values(spark, ["2024-01-05T06:07:08"], fn.safe_datetime("t", ntz=True)) == [datetime(2024, 1, 5, 6, 7, 8)]
    with pytest.raises(ValueError):
        fn.safe_date("t", format="%Y", formats=["%Y"])


def test_ndc(spark):
    texts = ["12345-6789-01", "1234-5678-90", "12345-678-90", "1234-567-8", "1234-567", "1234567890", "123", "123456789012", "abc", "", None, "--", "1-2-3-4"]
    want = ["12345-6789-01", "01234-5678-90", "12345-0678-90", "01234-0567-08", "01234-0567", "01234-5678-90", "00000-0001-23", "12345-6789-01", None, None, None, None, "00001-0002-03"]
    assert values(spark, texts, fn.normalize_ndc("t")) == want
    assert values(spark, ["1234-567"], fn.normalize_ndc("t", force_package=True, package_suffix="1", with_hyphens=False)) == ["01234056701"]
    assert values(spark, [1234567890.0, 123.0, None], fn.normalize_ndc("t"), "double") == ["01234-5678-90", "00000-0001-23", None]
    assert values(spark, [1234567890], fn.normalize_ndc("t"), "long") == ["01234-5678-90"]


def test_row_hash(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, 1), ("a", "", 1), (None, "a", 1)], "x string, y string, z int")
    got = [r["h"] for r in df.select(fn.row_hash(["x", "y", "z"]).alias("h")).collect()]
    assert got == [hashlib.sha256(s.encode()).hexdigest() for s in ("a|\x00|1", "a||1", "\x00|a|1")]
    assert df.select(fn.row_hash(["y", "x"]).alias("h")).first()["h"] != df.select(fn.row_hash(["x", "y"]).alias("h")).first()["h"]
    with pytest.raises(ValueError):
        fn.row_hash([])
    doubles = spark.createDataFrame([(1e7, datetime(2024, 1, 1))], "d double, t timestamp")
    text = doubles.select(*[fn.canonical_text(F.col(f.name), f.dataType) for f in doubles.schema]).first()
    assert tuple(text) == ("10000000.0", "2024-01-01 00:00:00.000000")


def test_text_normalizer(spark):
    n = fn.TextNormalizer(strip_suffixes=True, strip_prefixes=True, symbol_mappings=True)
    texts = ["The Acme & Sons, Inc.", "ACME LLC", "Café Zürich GmbH", "  Many   spaces Pty Ltd ", "...", "", None, "Inc", "Theory Co", "A. B. (C) Corp"]
    assert values(spark, texts, n.column("t")) == ["acme and sons", "acme", "cafe zurich", "many spaces", None, None, None, "inc", "theory", "a b c"]
    keep = fn.TextNormalizer(ignore_case=False, strip_punctuation=False, normalize_whitespace=False, unicode_normalize=False)
    assert values(spark, ["Ünï  x!"], keep.column("t")) == ["Ünï  x!"]


def test_names_and_calendar(spark):
    assert values(spark, ["a%20b/c.txt", 'x:*?"<>|y', "a \t b", "%2F", "", None, "50%+1"], fn.sanitize_filename("t")) == ["a_bc.txt", "xy", "a_b", None, None, None, "50%+1"]
    assert values(spark, ["a.TXT", "b.csv.gz", "c"], fn.strip_extension("t", [".txt", ".gz"])) == ["a", "b.csv", "c"]
    assert values(spark, ["2024-05-15"], fn.calendar_boundary("t", "weekly", "friday")) == [date(2024, 5, 10)]
    assert values(spark, ["2024-05-15"], fn.calendar_boundary("t", "quarterly")) == [date(2024, 4, 1)]
    with pytest.raises(ValueError):
        fn.calendar_boundary("t", "daily")


def test_case_folds_beyond_lower_case_where_texts_stay_as_they_are(spark):
    from quarryline.functions.normalize import TextNormalizer

    df = spark.createDataFrame([("Straße ÉCOLE",), ("PLAIN",), (None,)], "t string")
    got = [r[0] for r in df.select(TextNormalizer(unicode_normalize=False).column("t")).collect()]
    assert got == ["strasse école", "plain", None]
