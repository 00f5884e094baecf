"""Bound expressions as Spark columns over sampled signal states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bits as B
from .binding import Bound
from .types import Type, common

#: path -> column of the signal's sampled value (for events: whether it occurred at the sample time).
Samples = Callable[[str], Column]


def raised(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {message}"))


def truth(c: Column, t: Type) -> Column:
    if t.kind == "real":
        return F.when(c != 0, "1").otherwise("0")
    if t.kind == "string":
        return F.lit("0")
    return B.truth(c)


def coerced(c: Column, source: Type, target: Type) -> Column:
    if source == target or target.kind == "string":
        return c
    if target.kind == "real":
        if source.kind == "real":
            return c
        value = B.number(c, source.signed).cast("double") if source.width <= B.NARROW else _float(c, source.signed)
        return F.when(B.unknown(c), raised("EXPR-RUNTIME-REAL-CAST", "value with x or z has no real equivalent").cast("double")).otherwise(value)
    if source.kind == "real":
        whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("decimal(38,0)")
        if target.width <= B.NARROW:
            return B.of_number(whole, target.width)
        low = B.of_number(whole, B.NARROW)
        return F.concat(F.when(whole < 0, F.lit("1" * (target.width - B.NARROW))).otherwise(F.lit("0" * (target.width - B.NARROW))), low)
    out = B.resize(c, source.width, target.width, source.signed)
    return B.two_state(out) if source.four and not target.four else out


def _float(c: Column, signed: bool) -> Column:
    total = F.aggregate(F.split(c, ""), F.lit(0.0), lambda n, d: n * 2 + d.cast("double"))
    return F.when(F.substring(c, 1, 1) == "1", total - F.pow(F.lit(2.0), F.length(c))).otherwise(total) if signed else total


def compiled(node: Bound, samples: Samples) -> Column:
    """A string of bits, a double or a string, as the node's type says."""
    op, t = node.op, node.type
    if op == "const":
        return F.lit(node.value)
    if op == "signal":
        c = samples(str(node.value))
        if not t.integral:
            return F.when(c.isNull(), raised("EXPR-RUNTIME-MISSING-SAMPLE", f"signal '{node.value}' has no value yet").cast("double" if t.kind == "real" else "string")).otherwise(c)
        return F.coalesce(c, F.lit(("x" if t.four else "0") * t.width))
    if op == "triggered":
        return F.when(samples(str(node.value)), "1").otherwise("0")
    kinds = [a.type for a in node.args]
    if op in ("&&", "||"):
        stop, a = ("0", "1") if op == "&&" else ("1", "0"), truth(compiled(node.args[0], samples), kinds[0])
        b = truth(compiled(node.args[1], samples), kinds[1])
        return F.when(a == stop[0], stop[0]).otherwise(F.when(b == stop[0], stop[0]).when((a == stop[1]) & (b == stop[1]), stop[1]).otherwise("x"))
    if op == "?:":
        which = truth(compiled(node.args[0], samples), kinds[0])
        yes, no = (coerced(compiled(node.args[k], samples), kinds[k], t) for k in (1, 2))
        if t.integral:
            mixed = B.merged(yes, no, t.width)
            mixed = mixed if t.four else B.two_state(mixed)
        else:
            mixed = F.when(yes == no, yes).otherwise(raised("EXPR-RUNTIME-CONDITIONAL-UNKNOWN", "unknown condition over different values").cast("double" if t.kind == "real" else "string"))
        return F.when(which == "1", yes).when(which == "0", no).otherwise(mixed)
    v = [compiled(a, samples) for a in node.args]
    if op == "cast":
        return coerced(v[0], kinds[0], t)
    if op in ("bit", "up", "down"):
        low = B.index(v[1], kinds[1].width, kinds[1].signed)
        low = low - (t.width - 1) if op == "down" else low
        return F.when(B.unknown(v[1]), ("x" if t.four else "0") * t.width).otherwise(B.select(v[0], kinds[0].width, low, t.width, t.four))
    if op == "part":
        m, low = node.value  # type: ignore[misc]
        if 0 <= min(m, low) and max(m, low) < kinds[0].width:
            part = F.substring(v[0], kinds[0].width - max(m, low), t.width)
        else:
            part = B.select(v[0], kinds[0].width, F.lit(min(m, low)).cast("long"), t.width, t.four)
        return part if m >= low else F.reverse(part)
    if op == "u!":
        return F.translate(truth(v[0], kinds[0]), "01", "10")
    if op == "u~":
        return B.flip(v[0])
    if op in ("u+", "u-"):
        if op == "u+":
            return v[0]
        return -v[0] if t.kind == "real" else B.arithmetic("-", F.lit("0" * t.width), v[0], t.width, t.width, t.signed, False)
    if op[0] == "u":
        return B.reduce(op[1:], v[0])
    if op == "{}":
        return F.concat(*v)
    if op == "repeat":
        return F.repeat(v[0], F.lit(node.value))
    if op == "inside":
        found = v[1]
        for c in v[2:]:
            found = B.bitwise("|", found, c, 1)
        return found
    a, b = v
    if op in ("<<", ">>", "<<<", ">>>"):
        return B.shift(op, a, b, t.width, kinds[1].width, t.signed)
    if op == "**" and t.integral:
        return B.arithmetic(op, coerced(a, kinds[0], t), b, t.width, kinds[1].width, t.signed, kinds[1].signed)
    met = common(kinds[0], kinds[1]) if kinds[0].numeric and kinds[1].numeric else kinds[0]
    a, b = coerced(a, kinds[0], met), coerced(b, kinds[1], met)
    if not met.integral:
        return _real(op, a, b)
    if op in ("&", "|", "^", "~^"):
        return B.bitwise(op, a, b, t.width)
    if op in ("===", "!=="):
        return F.when(a == b, "1" if op == "===" else "0").otherwise("0" if op == "===" else "1")
    if op in ("==?", "!=?"):
        same = B.wild(a, b, met.width)
        return same if op == "==?" else F.translate(same, "01", "10")
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return B.compare(op, a, b, met.signed)
    return B.arithmetic(op, a, b, t.width, t.width, t.signed, False)


def _real(op: str, a: Column, b: Column) -> Column:
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return F.when({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "1").otherwise("0")
    bad = raised("EXPR-RUNTIME-REAL-NONFINITE", "real result is not finite").cast("double")
    if op in ("/", "%"):
        value = F.when(b == 0, bad).otherwise(a / b if op == "/" else a % b)
    else:
        value = {"+": a + b, "-": a - b, "*": a * b, "**": F.pow(a, b)}[op]
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), bad).otherwise(value)


def holds(node: Bound, samples: Samples) -> Column:
    """Whether a condition is definitely true, as a boolean."""
    return truth(compiled(node, samples), node.type) == "1"
