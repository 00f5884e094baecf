"""Four-state bit strings as Spark columns: JVM-side expressions of any width."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scalar

#: Widest operands for which Spark's 38-digit numbers hold every product.
NARROW = 63
_WIDE = T.DecimalType(38, 0)


def lit(bits: str) -> Column:
    return F.lit(bits)


def unknown(c: Column) -> Column:
    return c.rlike("[xz]")


def bit_of(c: Column, width: int, k: int) -> Column:
    """Bit k, counted from the least significant."""
    return F.substring(c, width - k, 1)


def resize(c: Column, source: int, width: int, signed: bool) -> Column:
    if width == source:
        return c
    if width < source:
        return F.substring(c, source - width + 1, width)
    fill = F.repeat(F.substring(c, 1, 1), F.lit(width - source)) if signed else F.lit("0" * (width - source))
    return F.concat(fill, c)


def two_state(c: Column) -> Column:
    return F.translate(c, "xz", "00")


def flip(c: Column) -> Column:
    return F.translate(c, "01z", "10x")


def truth(c: Column) -> Column:
    """1 if any bit is 1, else x if any is unknown, else 0."""
    return F.when(F.instr(c, "1") > 0, "1").when(unknown(c), "x").otherwise("0")


def number(c: Column, signed: bool) -> Column:
    """A known value of at most NARROW bits as a decimal."""
    n = F.conv(c, 2, 10).cast(_WIDE)
    return F.when(F.substring(c, 1, 1) == "1", n - F.pow(F.lit(2).cast("double"), F.length(c)).cast(_WIDE)).otherwise(n) if signed else n


def of_number(n: Column, width: int) -> Column:
    """The low bits of a whole decimal, for widths up to NARROW."""
    size = F.lit(str(1 << width)).cast(_WIDE)
    return F.lpad(F.bin(F.pmod(n, size).cast("long")), width, "0")


def _each(a: Column, b: Column, one) -> Column:
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), one), "")


def bitwise(op: str, a: Column, b: Column, width: int) -> Column:
    def one(p: Column, q: Column) -> Column:
        if op == "&":
            return F.when((p == "0") | (q == "0"), "0").when((p == "1") & (q == "1"), "1").otherwise("x")
        if op == "|":
            return F.when((p == "1") | (q == "1"), "1").when((p == "0") & (q == "0"), "0").otherwise("x")
        same = F.when(unknown(F.concat(p, q)), "x")
        return same.when(p == q, "0" if op == "^" else "1").otherwise("1" if op == "^" else "0")

    return one(a, b) if width == 1 else _each(a, b, one)


def merged(a: Column, b: Column, width: int) -> Column:
    """Equal bits, and x where they differ."""
    one = lambda p, q: F.when(p == q, p).otherwise("x")
    return one(a, b) if width == 1 else _each(a, b, one)


def reduce(op: str, c: Column) -> Column:
    base = op.replace("~", "")
    if base == "&":
        out = F.when(F.instr(c, "0") > 0, "0").when(unknown(c), "x").otherwise("1")
    elif base == "|":
        out = F.when(F.instr(c, "1") > 0, "1").when(unknown(c), "x").otherwise("0")
    else:
        out = F.when(unknown(c), "x").otherwise((F.length(F.translate(c, "0", "")) % 2).cast("string"))
    return F.translate(out, "01", "10") if "~" in op else out


def compare(op: str, a: Column, b: Column, signed: bool) -> Column:
    unsure = unknown(F.concat(a, b))
    if signed:
        a, b = (F.concat(F.translate(F.substring(s, 1, 1), "01", "10"), F.substring(s, 2, 1 << 30)) for s in (a, b))
    holds = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.when(unsure, "x").when(holds, "1").otherwise("0")


def wild(a: Column, b: Column, width: int) -> Column:
    """==?: unknown bits on the right match anything."""

    def one(p: Column, q: Column) -> Column:
        return F.when(unknown(q), "1").when(unknown(p), "x").when(p == q, "1").otherwise("0")

    if width == 1:
        return one(a, b)
    return reduce("&", _each(a, b, one))


def shift(op: str, a: Column, b: Column, width: int, b_width: int, signed: bool) -> Column:
    low = F.substring(b, max(1, b_width - 29), 30)  # what is above says that everything is shifted out
    over = F.instr(F.substring(b, 1, b_width - 30), "1") > 0 if b_width > 30 else F.lit(False)
    n = F.when(unknown(b) | over, F.lit(width)).otherwise(F.least(F.lit(width), F.conv(F.translate(low, "xz", "00"), 2, 10).cast("int")))
    if op in ("<<", "<<<"):
        out = F.concat(F.substring(a, n + 1, F.lit(width)), F.repeat(F.lit("0"), n))
    else:
        fill = F.substring(a, 1, 1) if op == ">>>" and signed else F.lit("0")
        out = F.concat(F.repeat(fill, n), F.substring(a, F.lit(1), F.lit(width) - n))
    return F.when(unknown(b), "x" * width).otherwise(out)


def select(c: Column, source: int, low: Column, width: int, four: bool) -> Column:
    """`width` bits upward from a known index; bits outside are unknown."""
    outside = "x" if four else "0"
    places = F.sequence(F.lit(width - 1), F.lit(0)) if width > 1 else F.array(F.lit(0))

    def one(k: Column) -> Column:
        at = low + k
        return F.when((at < 0) | (at >= source), outside).otherwise(F.substring(c, (F.lit(source) - at).cast("int"), F.lit(1)))

    return F.array_join(F.transform(places, one), "")


def index(c: Column, width: int, signed: bool) -> Column:
    """A known index as a long; what is too wide for that is outside of any vector."""
    if width <= 40:
        n = F.conv(F.translate(c, "xz", "00"), 2, 10).cast("long")
        return F.when(F.substring(c, 1, 1) == "1", n - (1 << width)).otherwise(n) if signed else n
    low = F.conv(F.translate(F.substring(c, width - 39, 40), "xz", "00"), 2, 10).cast("long")
    high, top = F.substring(c, 1, width - 40), F.lit(1 << 50)
    if signed:
        return F.when(F.instr(high, "1") == 0, low).when(F.instr(high, "0") == 0, low - (1 << 40)).when(F.substring(c, 1, 1) == "1", -top).otherwise(top)
    return F.when(F.instr(high, "1") == 0, low).otherwise(top)


def arithmetic(op: str, a: Column, b: Column, width: int, b_width: int, signed: bool, exponent_signed: bool) -> Column:
    """+ - * / % ** of operands with the result's width (the exponent keeps its own)."""
    if op == "**" or max(width, b_width) > NARROW:
        return _outside(op, width, signed, exponent_signed)(a, b)
    unsure, x, y = unknown(F.concat(a, b)), number(a, signed and op in "/%"), number(b, signed and op in "/%")
    if op in "+-*":
        return F.when(unsure, "x" * width).otherwise(of_number({"+": x + y, "-": x - y, "*": x * y}[op], width))
    rest = F.abs(x) % F.abs(y)
    quotient = ((F.abs(x) - rest) / F.abs(y)).cast(_WIDE)
    value = F.when(((x < 0) != (y < 0)), -quotient).otherwise(quotient) if op == "/" else F.when(x < 0, -rest).otherwise(rest)
    return F.when(unsure | (F.instr(b, "1") == 0), "x" * width).otherwise(of_number(value, width))


def _outside(op: str, width: int, signed: bool, exponent_signed: bool):
    """The same in Python, in Arrow batches: for operands that no Spark number holds, and for powers."""
    @F.pandas_udf("string")
    def wide(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else scalar.arithmetic(op, p, q, width, signed, exponent_signed) for p, q in zip(a, b, strict=True)])

    return wide


def literal_text(c: Column, width: int) -> Column:
    """A value as <width>'h<digits>: digits of four bits from the least significant; all-z digits show z, other unknown ones x."""
    digits = (width + 3) // 4
    if not digits:
        return F.lit("0'h0")
    first = width - 4 * (digits - 1)
    parts = [F.substring(c, 1, first)] + [F.substring(c, first + 1 + 4 * k, 4) for k in range(digits - 1)]
    shown = [F.when(p.rlike("^[01]+$"), F.lower(F.conv(p, 2, 16))).when(p.rlike("^z+$"), "z").otherwise("x") for p in parts] if digits <= 4 else None
    if shown is not None:
        return F.concat(F.lit(f"{width}'h"), *shown)
    padded = F.concat(F.repeat(F.when(F.substring(c, 1, first).rlike("^z+$"), "z").otherwise("0"), F.lit(4 - first)), c)
    one = lambda k: F.substring(padded, (k * 4 + 1).cast("int"), F.lit(4))
    each = F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), lambda k: F.when(one(k).rlike("^[01]+$"), F.lower(F.conv(one(k), 2, 16))).when(one(k) == "zzzz", "z").otherwise("x"))
    return F.concat(F.lit(f"{width}'h"), F.array_join(each, ""))
