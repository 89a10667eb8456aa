"""Golden rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import scalars as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, wanted", [("443", "SKY-443"), ("SKY443", "SKY-443"), ("sky-443", "SKY-443"), ("SKY-443", "SKY-443"), (" sky443\t", "SKY-443"), ("OPP-1", "OPP-1"), ("sky-abc", "SKY-ABC"), ("", ""), (None, None), (" 443\xa0", "SKY-443")])
def test_normalize_opportunity(spark, given, wanted):
    assert one(spark, given, S.normalize_opportunity) == wanted


@pytest.mark.parametrize("size, wanted", [(1023, "1023 B"), (1024, "1.0 KB"), (1048576, "1.0 MB"), (1280, "1.3 KB")])
def test_size_label(spark, size, wanted):
    assert one(spark, size, S.size_label, "long") == wanted


@pytest.mark.parametrize("month, ok", [("2026-13", False), ("2026-1", False), ("2026-01", True), ("2026-00", False), ("x", False), (None, False)])
def test_is_month(spark, month, ok):
    assert one(spark, month, S.is_month) is ok


def test_megabytes_half_even(spark):
    assert one(spark, 131072, S.megabytes, "long") == 0.12
    assert one(spark, None, S.megabytes, "long") == 0.0


def test_rotation(spark):
    assert one(spark, 270, lambda x: S.rotated(x, F.lit(180)), "int") == 90
    assert one(spark, None, lambda x: S.rotated(x, F.lit(90)), "int") == 90


def test_filenames(spark):
    assert one(spark, "a b/c\\d e.pdf", S.normalize_filename) == "d_e.pdf"
    name = one(spark, "a b.pdf", lambda x: S.stored_filename(F.lit("k"), x))
    assert name[8:] == "_a_b.pdf" and int(name[:8], 16) >= 0


def test_case_numbers(spark):
    assert one(spark, 7, lambda n: S.case_number(F.lit("CASE-2026-"), n), "int") == "CASE-2026-0007"
    assert one(spark, 12345, lambda n: S.case_number(F.lit("CASE-2026-"), n), "int") == "CASE-2026-12345"
    assert one(spark, "CASE-2026-x1", S.case_suffix) is None


def test_labels(spark):
    assert one(spark, "POD", S.type_label) == "Proof of Delivery"
    assert one(spark, "OTHER", S.type_label) == "OTHER"
    assert one(spark, None, S.type_code) is None
    assert one(spark, "2026-01", S.month_label) == "Jan 2026"
    assert one(spark, None, S.status_class) == "gray"
