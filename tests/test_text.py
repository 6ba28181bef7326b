import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("name", "ext"), [("a.PDF", "pdf"), ("README", "readme"), ("a.b.", ""), (None, ""), ("a.tar.gz", "gz")])
def test_extension(spark, name, ext):
    assert one(spark, tx.extension(F.col("x")), x=name) == ext


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1024**2 - 1, "1024.0 KB"), (1024**2, "1.0 MB"), (20 * 1024**2 + 1, "20.0 MB")])
def test_file_size(spark, n, text):
    assert one(spark, tx.file_size(F.col("x")), x=n) == text


def test_trim_takes_the_web_s_spaces(spark):
    assert one(spark, tx.trimmed(F.col("x")), x="﻿ \t a b 　\n") == "a b"
    assert one(spark, tx.trimmed(F.col("x")), x="\x85a") == "\x85a"
    assert one(spark, tx.not_blank(F.col("x")), x="  \n") is False
    assert one(spark, tx.not_blank(F.col("x")), x=None) is False


def test_missing_is_null_or_empty(spark):
    assert one(spark, tx.or_else(F.col("x"), F.col("y"), "z"), x="", y=None) == "z"
    assert one(spark, tx.or_else(F.col("x"), F.col("y"), "z"), x="", y="y") == "y"
    assert one(spark, tx.present(F.col("x")), x="") is False


def test_truncation_adds_a_note(spark):
    text = one(spark, tx.truncated(F.col("x")), x="a" * 12_001)
    assert text.startswith("a" * 12_000 + "\n\n…[Content truncated at 12,000 characters.") and len(text) > 12_001
    assert one(spark, tx.truncated(F.col("x")), x="a" * 12_000) == "a" * 12_000


@given(st.text(alphabet="ab é", max_size=40), st.integers(1, 30))
@settings(max_examples=15, deadline=None)
def test_truncation_keeps_the_prefix(spark, text, most):
    out = one(spark, tx.truncated(F.col("x"), most), x=text)
    assert out == text if len(text) <= most else out.startswith(text[:most]) and len(out) > most


def test_labels(spark):
    assert one(spark, tx.short_label(F.col("x")), x="a" * 18) == "a" * 18
    assert one(spark, tx.short_label(F.col("x")), x="a" * 19) == "a" * 16 + "…"
    assert one(spark, tx.counted(F.col("x"), "document"), x=1) == "1 document"
    assert one(spark, tx.counted(F.col("x"), "document"), x=0) == "0 documents"


def test_slide_text_decodes_in_order(spark):
    xml = "<a:p><a:t>x &amp;lt; y</a:t><a:br/><a:t>z</a:t></a:p>&#xD;"
    assert one(spark, tx.slide_text(F.col("x")), x=xml) == "x < y z"
    assert one(spark, tx.slide_text(F.col("x")), x="a<a:br/>b") == "a\nb"


def test_numbers_in_paths(spark):
    assert one(spark, tx.digits_or_zero(F.col("x")), x="slide10.xml") == 10
    assert one(spark, tx.digits_or_zero(F.col("x")), x="none") == 0


def test_friendly_error(spark):
    assert one(spark, tx.friendly_error(F.col("x")), x="Email not confirmed!").startswith("Please confirm")
    assert one(spark, tx.friendly_error(F.col("x")), x=None) == tx.FRIENDLY_DEFAULT
    assert one(spark, tx.friendly_error(F.col("x")), x="odd") == "odd"
