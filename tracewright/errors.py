"""Fatal errors by category, with the exit code of each, and query diagnostics."""

from __future__ import annotations

from dataclasses import dataclass


class WaveError(Exception):
    """A fatal error of one category: args, file, scope, signal, expr, internal or unimplemented."""

    def __init__(self, category: str, message: str) -> None:
        super().__init__(f"{category}: {message}")
        self.category, self.message = category, message

    @property
    def exit_code(self) -> int:
        return 2 if self.category == "file" else 1


class ExprError(WaveError):
    """An expression error: layer (parse, semantic, runtime), code and place in the source."""

    def __init__(self, code: str, message: str, start: int = 0, end: int = 0) -> None:
        super().__init__("expr", f"{code.split('-')[1].lower()}:{code}: {message}")
        self.code, self.span, self.layer = code, (start, end), code.split("-")[1].lower()


@dataclass(frozen=True)
class Diagnostic:
    code: str  # W0001 no limit, W0002 truncated, W0003 empty, W0004 unmatched candidate
    message: str
    kind: str = "warning"
