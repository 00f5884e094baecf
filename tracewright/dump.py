"""The staging model: one or many dumps as value changes, signals, scopes and bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import WaveError
from .functions.timebase import Timebase
from .plans.types import INTEGER_LIKE, REAL, STRING, Type, integer_like

CHANGES = "dump_id long, sig_id long, t long, seq long, bits string, real double, str string"
SIGNALS = "sig_id long, path string, scope_path string, name string, kind string, width int, type_kind string, four boolean, signed boolean, labels map<string,string>"
SCOPES = "path string, parts array<string>, depth int, kind string"
META = "dump_id long, tick_value long, tick_unit string, start_raw long, end_raw long"

#: Kinds whose bits have two states, and the integer-like type of a kind.
TWO_STATE = frozenset("bit byte short_int int long_int boolean bit_vector".split())
LIKE = {"byte": "byte", "short_int": "shortint", "int": "int", "long_int": "longint", "integer": "integer", "time": "time"}
SCOPE_KINDS = "module task function begin fork generate struct union class interface package program unknown".split()
SIGNAL_KINDS = (
    "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor string port sparse_array real_time bit logic int short_int long_int byte enum short_real boolean bit_vector unknown"
).split()


def type_of(kind: str, width: int | None, labels: dict[str, str] | None = None) -> Type:
    """The expression type that a dump variable of a kind has."""
    if kind in ("real", "real_time", "real_parameter", "short_real"):
        return REAL
    if kind == "string":
        return STRING
    if kind == "event":
        return Type("event", 0, False)
    if kind == "enum" and labels:
        return Type("enum", width or 1, True, False, f"enum:{sorted(labels.items())}", tuple(labels.items()))
    if kind in LIKE and width == INTEGER_LIKE[LIKE[kind]][0]:
        return integer_like(LIKE[kind])
    return Type("bits", width or 1, kind not in TWO_STATE, kind in ("byte", "short_int", "int", "long_int", "integer"))


@dataclass(frozen=True)
class Signal:
    sig_id: int
    path: str
    kind: str
    width: int | None
    type: Type

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    @property
    def scope(self) -> str:
        return self.path.rpartition(".")[0]


@dataclass
class Dump:
    """changes, signals, scopes and meta; all dumps in it share their catalog and tick."""

    changes: DataFrame
    signals: DataFrame
    scopes: DataFrame
    meta: DataFrame
    _known: dict[str, Signal | None] = field(default_factory=dict)
    bounds: Timebase | None = None  # what meta says, where that is known already
    marks: DataFrame | None = None  # a smaller frame whose t is spread over time like that of changes, where there is one
    reading: Callable[[list[int], int, int], DataFrame] | None = None  # how a source reads only some signals and times, where it can

    @property
    def spark(self) -> SparkSession:
        return self.changes.sparkSession

    @cached_property
    def time(self) -> Timebase:
        if self.bounds is not None:
            return self.bounds
        row = self.meta.agg(F.min("tick_value"), F.min("tick_unit"), F.min("start_raw"), F.max("end_raw")).first()
        if row is None or row[0] is None:
            return Timebase(1, "s", 0, 0)
        return Timebase(row[0], row[1], row[2] or 0, row[3] or 0)

    @cached_property
    def cuts(self) -> list[int]:
        """Where ranges of time with about equal numbers of changes begin."""
        from .operators.sampling import time_cuts

        return time_cuts(self.changes if self.marks is None else self.marks)

    def slice(self, refs: Iterable[Signal], start: int, end: int) -> DataFrame:
        """The changes of some signals at the times from start to end."""
        ids = sorted({s.sig_id for s in refs})
        own = self.changes if self.reading is None else self.reading(ids, start, end)
        own = own.filter(F.col("sig_id").isin(ids) & (F.col("t") <= end))
        return own if start <= self.time.start else own.filter(F.col("t") >= start)

    def find(self, path: str) -> Signal | None:
        """The signal of a path; looked up once."""
        if path not in self._known:
            row = self.signals.filter(F.col("path") == path).limit(1).collect()
            self._known[path] = _signal(row[0]) if row else None
        return self._known[path]

    def preload(self, paths: list[str]) -> None:
        """Looks up several paths in one job."""
        todo = sorted({p for p in paths if p not in self._known})
        if todo:
            found = {r["path"]: _signal(r) for r in self.signals.filter(F.col("path").isin(todo)).collect()}
            self._known |= {p: found.get(p) for p in todo}

    def signal(self, path: str) -> Signal:
        found = self.find(path)
        if found is None:
            raise WaveError("signal", f"signal '{path}' not found in dump")
        return found

    def require_scope(self, scope: str) -> None:
        if not self.scopes.filter(F.col("path") == scope).limit(1).count():
            raise WaveError("scope", f"scope '{scope}' not found in dump")

    def scoped(self, name: str, scope: str | None, dots: bool = False) -> str:
        """The path of a name under a scope; dotted names there are only allowed for point values."""
        if scope is None:
            return name
        if "." in name and not dots:
            raise WaveError("signal", f"'{name}' must be relative to scope '{scope}'")
        return f"{scope}.{name}"


def known_signals(entries: list[tuple]) -> dict[str, Signal | None]:
    """A catalog given as SIGNALS rows, for lookups without a job."""
    return {e[1]: Signal(e[0], e[1], e[4], e[5], type_of(e[4], e[5], e[9])) for e in entries}


def _signal(row: T.Row) -> Signal:
    return Signal(row["sig_id"], row["path"], row["kind"], row["width"], type_of(row["kind"], row["width"], row["labels"]))


def dump_from_lists(spark: SparkSession, changes: list[tuple], signals: list[tuple], scopes: list[tuple] = (), tick: tuple[int, str] = (1, "ns"), times: list[int] | None = None) -> Dump:
    """A small dump from (sig_id, t, seq, value) and (sig_id, path, kind, width[, labels]) rows."""
    kinds = {s[0]: s[2] for s in signals}
    rows = []
    for sig, t, seq, value in changes:
        k = type_of(kinds[sig], 1).kind
        rows.append((0, sig, t, seq, value if k not in ("real", "string", "event") else None, value if k == "real" else None, value if k == "string" else None))
    every = sorted({c[1] for c in changes} | set(times or ()))
    start, end = (every[0], every[-1]) if every else (0, 0)
    entries = [(s[0], s[1], s[1].rpartition(".")[0], s[1].rpartition(".")[2], s[2], s[3], type_of(s[2], s[3]).kind, type_of(s[2], s[3]).four, type_of(s[2], s[3]).signed, s[4] if len(s) > 4 else None) for s in signals]
    paths = {p: k for p, k in scopes} if scopes else {}
    for s in signals:
        parts = s[1].split(".")[:-1]
        for n in range(1, len(parts) + 1):
            paths.setdefault(".".join(parts[:n]), "module")
    nodes = [(p, p.split("."), p.count("."), k) for p, k in paths.items()]
    return Dump(
        spark.createDataFrame(rows, CHANGES),
        spark.createDataFrame(entries, SIGNALS),
        spark.createDataFrame(nodes, SCOPES),
        spark.createDataFrame([(0, tick[0], tick[1], start, end)], META),
        known_signals(entries),
        Timebase(*tick, start, end),
    )
