"""Types of four-state expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Integer-like kinds as (width, signed, four-state).
INTEGER_LIKE = {"byte": (8, True, False), "shortint": (16, True, False), "int": (32, True, False), "longint": (64, True, False), "integer": (32, True, True), "time": (64, False, True)}


@dataclass(frozen=True)
class Type:
    kind: str  # bits, enum, real, string, event, or an integer-like kind
    width: int = 1
    four: bool = True
    signed: bool = False
    enum_id: str | None = None
    labels: tuple[tuple[str, str], ...] = ()

    @property
    def integral(self) -> bool:
        return self.kind not in ("real", "string", "event")

    @property
    def numeric(self) -> bool:
        return self.integral or self.kind == "real"

    def plain(self) -> Type:
        return replace(self, kind="bits", enum_id=None, labels=()) if self.kind == "enum" else self


TRUTH, REAL, STRING, EVENT = Type("bits"), Type("real", 64, False, True), Type("string", 0, False), Type("event", 0, False)


def integer_like(kind: str) -> Type:
    width, signed, four = INTEGER_LIKE[kind]
    return Type(kind, width, four, signed)


def common(a: Type, b: Type) -> Type:
    """The type two numeric operands meet in."""
    if "real" in (a.kind, b.kind):
        return REAL
    met = Type("bits", max(a.width, b.width, 1), a.four or b.four, a.signed and b.signed)
    return a if a.kind == b.kind and a.kind in INTEGER_LIKE and replace(a, kind="bits") == met else met
