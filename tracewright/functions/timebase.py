"""Time tokens such as `15ns` and raw dump times."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WaveError

#: Zeptoseconds in a unit.
UNITS = {"zs": 1, "as": 10**3, "fs": 10**6, "ps": 10**9, "ns": 10**12, "us": 10**15, "ms": 10**18, "s": 10**21}


@dataclass(frozen=True)
class Timebase:
    tick: int
    unit: str
    start: int
    end: int

    @property
    def tick_zs(self) -> int:
        return self.tick * UNITS[self.unit]

    def raw(self, token: str) -> int:
        """The raw time of a token inside the dump; checked in a fixed order."""
        text = token.strip()
        if re.fullmatch("[0-9]+", text):
            raise WaveError("args", f"time '{token}' needs a unit")
        m = re.fullmatch("([0-9]+)(zs|as|fs|ps|ns|us|ms|s)", text)
        if m is None:
            raise WaveError("args", f"invalid time '{token}'")
        if int(m[1]) >= 1 << 64:
            raise WaveError("args", f"time '{token}' is too large")
        zs = int(m[1]) * UNITS[m[2]]
        if not self.start * self.tick_zs <= zs <= self.end * self.tick_zs:
            raise WaveError("args", f"time '{token}' is outside of dump bounds [{self.text(self.start)}, {self.text(self.end)}]")
        if zs % self.tick_zs:
            raise WaveError("args", f"time '{token}' is not a multiple of the dump tick {self.tick}{self.unit}")
        return zs // self.tick_zs

    def window(self, start: str | None, end: str | None) -> tuple[int, int]:
        low = self.start if start is None else self.raw(start)
        high = self.end if end is None else self.raw(end)
        if low > high:
            raise WaveError("args", "the window's start is after its end")
        return low, high

    def text(self, raw: int) -> str:
        return f"{raw * self.tick}{self.unit}"

    def column(self, raw: Column) -> Column:
        return F.concat((raw * F.lit(self.tick)).cast("string"), F.lit(self.unit))
