"""Scalar rules on text, numbers and temperatures: for Python values, and as columns where Spark
can say them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..errors import PlantError

IDENTIFIER = r"[A-Za-z0-9]([A-Za-z0-9._:-]{0,126}[A-Za-z0-9])?"
_IDENTIFIER = re.compile(IDENTIFIER)
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
_TEMPERATURE = re.compile(r"(-?)([0-9]{1,6})\.([0-9]{3})")
LEAST_MC, MOST_MC = -10_000_000, 10_000_000


def is_identifier(s: str) -> bool:
    return _IDENTIFIER.fullmatch(s) is not None


def identifier(column: Column) -> Column:
    return column.rlike(rf"\A{IDENTIFIER}\z")


def is_display_text(s: str, most: int) -> bool:
    return _bytes(s) <= most and not _CONTROL.search(s) and _utf8(s)


def display_text(column: Column, most: int) -> Column:
    return (F.octet_length(column) <= most) & ~column.rlike("[\\x00-\\x1F\\x7F\\u0080-\\u009F]")


def is_external_identity(s: str, most: int = 512) -> bool:
    return _bytes(s) <= most and "\x00" not in s and _utf8(s)


def _utf8(s: str) -> bool:
    return not any(0xD800 <= ord(c) < 0xE000 for c in s)


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogateescape"))


_NAMED = {0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}


def escape(s: str) -> str:
    """Quoted and ASCII only: bytes outside printable ASCII become \\xHH."""
    return '"' + "".join(_NAMED.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\x{b:02x}") for b in s.encode("utf-8", "surrogateescape")) + '"'


def escaped(column: Column) -> Column:
    """``escape`` as a column: what needs no more than backslashes is said by Spark, the rest goes
    through its bytes as hexadecimal pairs."""
    plain = column.rlike("\\A[\\x20-\\x7E]*\\z")
    quick = F.regexp_replace(column, '(["\\\\])', "\\\\$1")
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(column)), lambda i: F.substring(F.hex(F.encode(column, "UTF-8")), i * 2 - 1, F.lit(2)))
    named = {f"{b:02X}": v for b, v in _NAMED.items()}

    def one(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        out = F.when(code.between(0x20, 0x7E), F.char(code)).otherwise(F.concat(F.lit("\\x"), F.lower(h)))
        for b, v in named.items():
            out = F.when(h == b, F.lit(v)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.when(plain, quick).otherwise(F.array_join(F.transform(pairs, one), "")), F.lit('"'))


_ESCAPE = re.compile(rb'\\(?:(["\\nrt])|x([0-9A-Fa-f]{2}))')
_MEANS = {v[1:].encode(): bytes([b]) for b, v in _NAMED.items()}


def unescape(s: str, most: int = 65_535) -> str:
    """What a quoted text stands for: every backslash must begin one of the escapes."""
    quoted = re.fullmatch('"(.*)"', s, re.DOTALL)
    if not quoted:
        raise PlantError("malformed_record", "the text is not in quotes")
    raw = quoted[1].encode("utf-8", "surrogateescape")
    if b"\\" in _ESCAPE.sub(b"", raw):
        raise PlantError("malformed_record", "a backslash begins no escape")
    out = _ESCAPE.sub(lambda m: _MEANS[m[1]] if m[1] else bytes.fromhex(m[2].decode()), raw)
    if len(out) > most:
        raise PlantError("text_too_long", "the text is longer than allowed")
    return out.decode("utf-8", "surrogateescape")


def ascii_lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def is_ascii_token(s: str) -> bool:
    return bool(s) and all(0x21 <= ord(c) <= 0x7E for c in s)


def parse_uint64(s: str, most: int = schema.U64_MAX) -> int:
    if not re.fullmatch("0|[1-9][0-9]*", s):
        raise PlantError("malformed_number", "not a canonical unsigned number", s[:64])
    if (n := int(s)) > most:
        raise PlantError("limit_exceeded", "number out of range", s[:64])
    return n


def parse_int64(s: str) -> int:
    if not re.fullmatch("-?(0|[1-9][0-9]*)", s):
        raise PlantError("malformed_number", "not a canonical number", s[:64])
    if not -(1 << 63) <= (n := int(s)) < 1 << 63:
        raise PlantError("limit_exceeded", "number out of range", s[:64])
    return n


def uint64(column: Column) -> Column:
    """The number a column's text stands for, null where it is no canonical unsigned 64-bit number."""
    n = F.when(column.rlike(r"\A(0|[1-9][0-9]{0,19})\z"), column.cast(schema.U64))
    return F.when(n <= F.lit(str(schema.U64_MAX)).cast(schema.U64), n)


def int64(column: Column) -> Column:
    """The number a column's text stands for, null where it is no signed 64-bit number; minus zero is zero."""
    return F.when(column.rlike(r"\A-?(0|[1-9][0-9]{0,18})\z"), column.try_cast("bigint"))


def celsius_parsed(column: Column) -> Column:
    """Thousandths of a degree from text with three decimals, null where it is none or out of range."""
    mc = F.when(column.rlike(r"\A-?[0-9]{1,6}\.[0-9]{3}\z"), F.replace(column, F.lit("."), F.lit("")).try_cast("bigint"))
    return F.when(mc.between(LEAST_MC, MOST_MC), mc)


def parse_celsius(s: str) -> int:
    """Degrees with exactly three fraction digits, in thousandths."""
    m = _TEMPERATURE.fullmatch(s)
    if not m:
        raise PlantError("malformed_number", "a temperature has one to six digits, a point and three digits", s[:64])
    mc = (int(m[2]) * 1000 + int(m[3])) * (-1 if m[1] else 1)
    return check_celsius(mc)


def check_celsius(mc: int) -> int:
    if not LEAST_MC <= mc <= MOST_MC:
        raise PlantError("quantity_out_of_range", "temperature out of range", str(mc))
    return mc


def add_celsius(a: int, b: int) -> int:
    return check_celsius(a + b)


def subtract_celsius(a: int, b: int) -> int:
    return check_celsius(a - b)


def show_celsius(mc: int) -> str:
    return f"{'-' if mc < 0 else ''}{abs(mc) // 1000}.{abs(mc) % 1000:03d}C"


def celsius(column: Column) -> Column:
    sign = F.when(column < 0, "-").otherwise("")
    return F.when(column.isNotNull(), F.concat(sign, (F.abs(column) / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(column) % 1000).cast("string"), 3, "0"), F.lit("C")))


def parse_token(token: str, vocabulary: list[str], what: str) -> str:
    if token not in vocabulary:
        raise PlantError("unknown_enum_token", f"unknown {what}", token[:64])
    return token


def posture_report() -> str:
    return "claim boundary (every claim below is not owned)\n" + "".join(f"  not_owned  {c}\n" for c in schema.EXCLUDED_CLAIMS)
