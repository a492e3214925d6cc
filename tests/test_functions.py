import re

import pytest
from pyspark.sql import functions as F

from keelson import errors
from keelson.functions import binary, globs
from keelson.operators.kv import successor


@pytest.mark.parametrize(
    "pattern, name, expected",
    [
        ("*", "abc", True), ("*", "a/b", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False),
        ("[^a-c]x", "dx", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("a.c", "abc", False), ("str*", "strings", True), ("", "", True), ("", "a", False), ("[\\]]", "]", True),
    ],
)
def test_glob(spark, pattern, name, expected):
    assert spark.range(1).select(globs.matches(F.lit(name), pattern)).first()[0] is expected


@pytest.mark.parametrize("pattern", ["[", "[a", "[]", "a\\", "[-]", "[a-]"])
def test_bad_glob(pattern):
    with pytest.raises(errors.BadPattern):
        globs.to_regex(pattern)


def test_successor():
    assert successor(b"ab") == b"ac"
    assert successor(b"a\xff") == b"b"
    assert successor(b"\xff") is None
    assert successor("key_") == "key`"


def test_bytes(spark):
    row = spark.createDataFrame([(bytearray(b"foober"),)], "v binary")
    v = F.col("v")
    for offset, byte in ((0, "F"), (3, "B"), (5, "R"), (6, "A"), (12, "C")):
        row = row.select(binary.set_byte(F.col("v"), offset, ord(byte)).alias("v"))
    assert bytes(row.first()[0]) == b"FooBeRA\0\0\0\0\0C"
    assert bytes(row.select(binary.get_byte(v, 3)).first()[0]) == b"B"
    assert bytes(row.select(binary.get_byte(v, 99)).first()[0]) == b"\0"


@pytest.mark.parametrize("start, end, expected", [(2, 10, "st"), (1, 2, "es"), (1, 4, "est"), (5, 10, None)])
def test_get_range(spark, start, end, expected):
    assert spark.range(1).select(binary.get_range(F.lit("test"), start, end)).first()[0] == expected


@pytest.mark.parametrize(
    "value, n, expected",
    [("12", 12, "24"), ("24", -25, "-1"), ("9223372036854775818", 200, "9223372036854776018"), ("211", -9223372036854775807, "-9223372036854775596"), ("x", 1, None), ("1.5", 1, None)],
)
def test_counter(spark, value, n, expected):
    assert spark.range(1).select(binary.add_text(F.lit(value), F.lit(n))).first()[0] == expected


def test_regex_is_anchored():
    assert re.match(r"\^\(\?:.*\)\$", globs.to_regex("a*"))
