"""Scalar normalisers, all cases of one function in one small job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from invoicelake.functions import fixed_values as V, normalize as N, scoring as S
from invoicelake.functions.text import clean_text, lines, strip


def run(spark, cases, build):
    rows = [(i, raw) for i, (raw, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, raw string").select("i", build(F.col("raw")).alias("v"))
    got = {r.i: r.v for r in frame.collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, (raw, got[i], want)


def test_clean_text(spark):
    cases = [
        ("Kiln\r\nGlaze", "Kiln\nGlaze"), ("Kiln\rGlaze\r", "Kiln\nGlaze"), ("qty\t \tprice", "qty price"),
        ("two     words", "two words"), ("x\n\n\n\ny\n\n\nz", "x\n\ny\n\nz"), ("p\n\nq", "p\n\nq"), ("\t kept \n", "kept"),
        ("", ""), (" \u3000x\u3000", "x"), ("nothing to do", "nothing to do"),
    ]
    run(spark, cases, clean_text)


def test_lines(spark):
    cases = [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\x0cc d", ["a", "b", "c", "d"])]
    run(spark, cases, lines)


def test_dates(spark):
    day = dt.date(2019, 8, 23)
    good = [
        "2019-08-23", "2019/08/23", "23/08/2019", "23-08-2019", "23.08.2019", "23 August 2019", "August 23, 2019",
        "August 23 2019", "23 Aug 2019", "Aug 23, 2019", "23-Aug-2019", "23-Aug-19", "23/08/19", "23/08/2019.",
        "23/08/2019;", "23  aug 2019", "٢٣/08/2019", "08/23/2019",
    ]
    bad = ["23/08/1850", "23/08/2188", "soon", "", "23/08", "30/02/2019", "23 Augu 2019", "23-08-19", "23/08/75", "2019"]
    more = [("19/12/2031", dt.date(2031, 12, 19)), ("23/08/99", dt.date(1999, 8, 23)), ("04/05/2019", dt.date(2019, 5, 4))]
    run(spark, [(g, day) for g in good] + [(b, None) for b in bad] + more, N.normalize_date)
    run(spark, [("04/05/2019", dt.date(2019, 4, 5))], lambda c: N.normalize_date(c, prefer_dmy=False))


def test_due_dates(spark):
    for n, want in ((10, dt.date(2019, 9, 2)), (45, dt.date(2019, 10, 7)), (0, dt.date(2019, 8, 23))):
        run(spark, [("2019-08-23", want), ("later", None)], lambda c, n=n: N.compute_due_date(N.normalize_date(c), F.lit(n)))


def test_amounts(spark):
    cases = [
        ("8317.09", 8317.09), ("8,317.09", 8317.09), ("8.317,09", 8317.09), ("8 317.09", 8317.09), ("7,65,432.10", 765432.10),
        ("42", 42.0), ("0.07", 0.07), ("$6,001.50", 6001.50), ("£77.20", 77.20), ("€9.876,54", 9876.54), ("₹3,300", 3300.0),
        ("CHF 18.75", 18.75), ("Rs. 640", 640.0), ("3.4K", 3400.0), ("1.75M", 1750000.0), ("6k", 6000.0),
        ("9.876.543", 9876543.0), ("", None), ("tbd", None), ("-3", None), ("3000000000000", None), ("7x", None),
        ("2_500", 2500.0), (".", None), (",", None), ("8.", 8.0), (".25", 0.25),
    ]
    run(spark, cases, N.normalize_amount)


def test_rounding_is_that_of_the_binary_value(spark):
    values = ["2.675", "0.125", "0.375", "1.005", "0.865", "0.895", "0.635", "0.045", "1.115", "12.345", "99.995", "0.025", "7.1249"]
    run(spark, [(v, round(float(v), 2)) for v in values], lambda c: N.round2(c.cast("double")))


def test_currencies(spark):
    tokens = [
        ("€", "EUR"), ("¥", "JPY"), ("£", "GBP"), ("eur", "EUR"), ("CHF", "CHF"), ("RS", "INR"), ("Rs.", "INR"),
        ("rm", "MYR"), ("QQQ", "QQQ"), ("", None), ("four letters", None), ("\tGBP ", "GBP"),
    ]
    run(spark, tokens, N.normalize_currency)
    texts = [
        ("We charge CHF 72.10 per night", "CHF"), ("Balance: £18", "GBP"), ("pay €7 or ₹600", "EUR"), ("sum SGD 450", "SGD"),
        ("Deposit Rs. 90", "INR"), ("A walk by the lake.", None), ("", None), ("JPY 900 then USD 6", "JPY"), ("€ 12", None),
    ]
    run(spark, texts, N.detect_currency)


def test_fusion(spark):
    rows = [
        (0, "2031-07-04", 0.80, "2031-07-04", 0.60), (1, "R-77", 0.97, "R-77", 0.50), (2, "R-77", 0.75, None, 0.0),
        (3, None, 0.0, "Birch & Sons", 0.70), (4, "2031-07-04", 0.66, "2030-01-31", 0.65), (5, None, 0.0, None, 0.0),
        (6, "Birch", 0.60, "Birch and Sons", 0.55),
    ]
    frame = spark.createDataFrame(rows, "i int, a string, ac double, b string, bc double")
    got = frame.select("i", S.fuse(F.col("a"), F.col("ac"), F.col("b"), F.col("bc")).alias("f")).select("i", "f.*")
    found = {r.i: (r.value, round(r.confidence, 4), r.source) for r in got.collect()}
    assert found == {
        0: ("2031-07-04", 0.85, "regex+nlp"), 1: ("R-77", 1.0, "regex+nlp"), 2: ("R-77", 0.75, "regex"),
        3: ("Birch & Sons", 0.70, "nlp"), 4: ("2031-07-04", 0.66, "regex"), 5: (None, 0.0, "none"),
        6: ("Birch", 0.65, "regex+nlp"),
    }


def test_consistency(spark):
    rows = [(0, "2027-05-01", "2027-06-10", 93.0, 100.0), (1, "2027-06-10", "2027-05-01", 40.0, 0.0),
            (2, "2027-05-01", "2027-05-01", 40.0, 300.0), (3, None, None, None, 10.0)]
    frame = spark.createDataFrame(rows, "i int, a string, b string, t double, s double")
    warned = S.extraction_warnings(
        S.date_warning(F.col("a").cast("date"), F.col("b").cast("date")), S.sum_warning(F.col("t"), F.col("s"))
    )
    got = {r.i: r.w for r in frame.select("i", warned.alias("w")).collect()}
    assert got[0] == [] and got[3] == []
    assert len(got[1]) == 1 and "before" in got[1][0]
    assert got[2] == [
        "Consistency check: total_amount (40.00) is less than sum of line items (300.00) — possible extraction error."
    ]


def test_the_usual_amount_is_searched_once(spark):
    # expressions inside of a transform don't share their parts
    written = N.normalize_amount(F.col("a"))._jc.toString()
    assert written.count("regexp_extract(a,") == 1


def test_strip_is_trimming_at_both_ends(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\u3000a", "a\u2003", "\u00e9", "\u00e9a", "a\u00e9 ", "\x1fa\x85", "\x00a", "a\x7f", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(strip(F.col("t")), F.btrim("t", F.lit(V.WHITESPACE))).collect()
    assert len(rows) == len(texts) and all(got == want for got, want in rows)
