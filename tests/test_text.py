import pytest
from pyspark.sql import functions as F

from plantgraph.errors import PlantError
from plantgraph.functions import text
from plantgraph import schema


def code(f, *a):
    with pytest.raises(PlantError) as e:
        f(*a)
    return e.value.code


def test_identifiers():
    for s, ok in {"a": 1, "a.b_c:d-e": 1, "": 0, "-a": 0, "a-": 0, "a b": 0, "a\n": 0, "x" * 128: 1, "x" * 129: 0, "é": 0}.items():
        assert text.is_identifier(s) == bool(ok), s


def test_escape_round_trip():
    for s in ["", "plain", 'q"\\', "\n\r\t", "\x00\x7f", "é漢😀", "a#b=c"]:
        assert text.unescape(text.escape(s)) == s
        assert text.escape(s).isascii()
    assert text.escape("é") == '"\\xc3\\xa9"'
    for bad in ["x", '"', '"\\"', '"\\q"', '"\\x1"', '"\\xg0"']:
        assert code(text.unescape, bad) == "malformed_record"
    assert code(text.unescape, '"' + "a" * 10 + '"', 9) == "text_too_long"


def test_numbers():
    assert text.parse_uint64("18446744073709551615") == schema.U64_MAX
    assert text.parse_int64("-0") == 0 and text.parse_int64("-9223372036854775808") == -(1 << 63)
    for s, c in {"": "malformed_number", "01": "malformed_number", "+1": "malformed_number", " 1": "malformed_number", "18446744073709551616": "limit_exceeded"}.items():
        assert code(text.parse_uint64, s) == c
    assert code(text.parse_int64, "9223372036854775808") == "limit_exceeded"


def test_celsius():
    for s, v in {"7.000": 7000, "-12.500": -12500, "0.001": 1, "-0.001": -1, "10000.000": 10_000_000}.items():
        assert text.parse_celsius(s) == v
    assert text.show_celsius(-500) == "-0.500C"
    for s, c in {"7": "malformed_number", "7.0": "malformed_number", "1234567.000": "malformed_number", "10000.001": "quantity_out_of_range"}.items():
        assert code(text.parse_celsius, s) == c
    assert code(text.add_celsius, 10_000_000, 1) == "quantity_out_of_range"


def test_columns_agree(spark):
    words = ["", "a", "plain text", 'q"\\', "tab\t", "é漢😀", "a\n", "-a", "x" * 129, "18446744073709551615", "18446744073709551616", "01"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for r in df.select("s", text.escaped(F.col("s")).alias("e"), text.identifier(F.col("s")).alias("i"), text.display_text(F.col("s"), 64).alias("d"), text.uint64(F.col("s")).alias("u")).collect():
        assert r.e == text.escape(r.s)
        assert r.i == text.is_identifier(r.s)
        assert r.d == text.is_display_text(r.s, 64)
        try:
            want = text.parse_uint64(r.s)
        except PlantError:
            want = None
        assert (None if r.u is None else int(r.u)) == want
    mc = [-10_000_000, -1500, -1, 0, 1, 7000, None]
    for r in spark.createDataFrame([(m,) for m in mc], "m bigint").select("m", text.celsius(F.col("m")).alias("t")).collect():
        assert r.t == (None if r.m is None else text.show_celsius(r.m))


def test_model_totality():
    assert len(schema.CODES) == 86 and len(set(schema.CODES)) == 86
    assert set(schema.PORTS_OF) == set(schema.NODE_KINDS) == set(schema.SUBKINDS)
    assert all(set(p) <= set(schema.PORTS) for p in schema.PORTS_OF.values())
    assert {c for v in schema.CONTAINS.values() for c in v} <= set(schema.NODE_KINDS)
    for container, held in schema.CONTAINS.items():
        assert "container" in schema.PORTS_OF[container]
        assert all("contained" in schema.PORTS_OF[k] for k in held)
    assert all("supply_out" in schema.PORTS_OF[k] for k in schema.SUPPLIERS)
    assert all("source_in" in schema.PORTS_OF[k] for k in schema.CONSUMERS)
    assert schema.CATEGORY["supply_cycle"] == "structure" and schema.CATEGORY["io_error"] == "persistence" and schema.CATEGORY["path_invalid"] == "argument"
