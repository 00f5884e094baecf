"""The row-producing queries: value, change, property and extract."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dump import Dump, Signal
from ..errors import Diagnostic, WaveError
from ..functions.bits import literal_text
from ..plans import events as ev
from ..plans.binding import Bound, Lookup, bound
from ..plans.columns import holds
from ..results import DEFAULT_MAX, Result, checked_limit
from .sampling import carried, state_at, states, states_at
from .triggers import matched

NATIVE, PRE_EDGE = "native", "pre-edge"
CAPTURES = ("match", "switch", "assert", "deassert")


def lookup(dump: Dump, scope: str | None) -> Lookup:
    def find(name: str):
        if scope is not None and "." in name:
            raise WaveError("signal", f"'{name}' must be relative to scope '{scope}'")
        s = dump.find(f"{scope}.{name}" if scope is not None else name)
        return None if s is None else s.type

    return find


class Bindings:
    """Expressions of one query over one scope: binding, and the signals they need."""

    def __init__(self, dump: Dump, scope: str | None) -> None:
        if scope is not None:
            dump.require_scope(scope)
        self.dump, self.scope = dump, scope

    def path(self, name: str) -> str:
        return f"{self.scope}.{name}" if self.scope is not None else name

    def event(self, text: str) -> list[ev.Term]:
        return ev.bound_event(text, lookup(self.dump, self.scope), self.path)

    def value(self, text: str) -> Bound:
        return bound(text, lookup(self.dump, self.scope), self.path)


def shown(dump: Dump, path: str, scope: str | None, absolute: bool) -> str:
    return path if absolute or scope is None else path.removeprefix(f"{scope}.")


def requested(dump: Dump, names: list[str], scope: str | None, dots: bool = False) -> list[Signal]:
    """The signals of a request in its order, with duplicates; only ones whose bits can be shown."""
    paths = [dump.scoped(n.strip(), scope, dots) for n in names]
    dump.preload(paths)
    out = [dump.signal(p) for p in paths]
    for s in out:
        if s.type.kind in ("real", "string", "event"):
            raise WaveError("signal", f"signal '{s.path}' has no bit-vector value")
    return out


def _sampled(dump: Dump, mode: str) -> tuple[Column, Column]:
    """The sample time of a row, and whether the row has one."""
    if mode == NATIVE:
        return F.col("t"), F.lit(True)
    return F.col("t") - 1, F.col("t") - 1 >= F.col("start_raw")


def _require_edges(terms: list[ev.Term], mode: str) -> None:
    if mode not in (NATIVE, PRE_EDGE):
        raise WaveError("args", f"unknown sample mode '{mode}'")
    if mode == PRE_EDGE and not ev.edges_only(terms):
        raise WaveError("args", "pre-edge sampling needs an event of edges only")


def value(dump: Dump, at: list[str], signals: list[str], scope: str | None = None, absolute: bool = False) -> Result:
    """The values of signals at times, in request order; a value that is missing fails the query."""
    if scope is not None:
        dump.require_scope(scope)
    times = [dump.time.raw(a) for a in at]
    asked = requested(dump, signals, scope, dots=True)
    distinct = list({s.path: s for s in asked}.values())
    column = {s.path: k for k, s in enumerate(distinct)}
    one = [F.struct(F.lit(shown(dump, s.path, scope, absolute)).alias("path"), literal_text(F.col(f"c{column[s.path]}"), s.type.width).alias("value")) for s in asked]
    missing = F.coalesce(*(F.when(F.col(f"c{column[s.path]}").isNull(), F.lit(f"signal '{s.path}' has no value at requested time")) for s in asked))
    frame = states_at(dump, distinct, times).select("dump_id", "pos", "t", F.array(*one).alias("signals"), missing.alias("error"))
    return Result("value", frame, ["dump_id", "pos"], None, shape=lambda r: {"time": dump.time.text(r["t"]), "signals": [x.asDict() for x in r["signals"]]}, limited=False)


def change_rows(dump: Dump, signals: list[Signal], terms: list[ev.Term], start: int, end: int, mode: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows (dump_id, t, sample_t, s0, s1, ...) where an event finds a requested signal changed, with its raw bits."""
    distinct = list({s.path: s for s in signals}.values())
    needed = {s.path for s in distinct} | ev.names(terms)
    st = states(dump, [dump.signal(p) for p in sorted(needed)], start, end)
    sample_t, exists = _sampled(dump, mode)
    fired = matched(terms, st, [s.path for s in distinct])
    column = {s.path: k for k, s in enumerate(distinct)}

    def differs(now: Column, before: Column) -> Column:
        return now.isNotNull() & before.isNotNull() & (now != before)

    rows = st.df.filter(F.col("t") > start)
    if mode == NATIVE:
        moved = reduce(or_, (differs(st.now(s.path), st.before(s.path)) for s in distinct))
        rows = rows.filter(moved & fired)
        return rows.select("dump_id", "t", sample_t.alias("sample_t"), *(st.now(s.path).alias(f"s{column[s.path]}") for s in distinct)), column
    rows = rows.filter(fired & exists).select("dump_id", "bucket", "t", sample_t.alias("sample_t"), *(st.before(s.path).alias(f"s{k}") for k, s in enumerate(distinct)))
    rows = carried(rows, {f"b{k}": F.col(f"s{k}") for k in range(len(distinct))}, ["t"], before=True)
    seed = state_at(dump, distinct, start).select("dump_id", *(F.col(f"c{k}").alias(f"d{k}") for k in range(len(distinct))))
    rows = rows.join(seed, "dump_id")
    moved = reduce(or_, (differs(F.col(f"s{k}"), F.coalesce(f"b{k}", f"d{k}")) for k in range(len(distinct))))
    return rows.filter(moved).select("dump_id", "t", "sample_t", *(f"s{k}" for k in range(len(distinct)))), column


def change(dump: Dump, signals: list[str], on: str, start: str | None = None, end: str | None = None, scope: str | None = None, mode: str = PRE_EDGE, limit: int | str | None = DEFAULT_MAX, absolute: bool = False) -> Result:
    """Snapshots of signals where an event finds one of them changed."""
    most = checked_limit(limit)
    b = Bindings(dump, scope)
    asked = requested(dump, signals, scope)
    terms = b.event(on)
    _require_edges(terms, mode)
    low, high = dump.time.window(start, end)
    rows, column = change_rows(dump, asked, terms, low, high, mode)
    values = [F.struct(F.lit(shown(dump, s.path, scope, absolute)).alias("path"), literal_text(F.col(f"s{column[s.path]}"), s.type.width).alias("value")) for s in asked]
    missing = F.coalesce(*(F.when(F.col(f"s{column[s.path]}").isNull(), F.lit(f"signal '{s.path}' has no value at a change")) for s in asked))
    df = rows.select("dump_id", "t", "sample_t", F.array(*values).alias("signals"), missing.alias("error"))
    shape = lambda r: {"time": dump.time.text(r["t"]), "sample_time": dump.time.text(r["sample_t"]), "signals": [x.asDict() for x in r["signals"]]}
    return Result("change", df, ["t", "dump_id"], most, empty="no signal changes found in selected time range", shape=shape)


def property_rows(dump: Dump, terms: list[ev.Term], test: Bound, start: int, end: int, mode: str, capture: str) -> DataFrame:
    """Rows (dump_id, t, sample_t, kind) where an event meets a condition, or where that turned."""
    tracked = sorted(test.signals())
    if any(t.kind == "any" for t in terms) and not tracked and len(terms) == 1:
        raise WaveError("args", "a wildcard event needs a condition with signals")
    needed = sorted(set(tracked) | ev.names(terms))
    st = states(dump, [dump.signal(p) for p in needed], start, end)
    sample_t, exists = _sampled(dump, mode)
    samples = st.now if mode == NATIVE else st.before
    fired = matched(terms, st, tracked) & exists & (F.col("t") >= start)
    rows = st.df.filter(fired).select("dump_id", "bucket", "t", sample_t.alias("sample_t"), holds(test, samples).alias("decision"))
    if capture == "match":
        return rows.filter("decision").select("dump_id", "t", "sample_t", F.lit("match").alias("kind"))
    refs = [dump.signal(p) for p in tracked]
    seeds = state_at(dump, refs, start) if refs else dump.meta.select("dump_id")
    seed = seeds.select("dump_id", holds(test, lambda p: F.col(f"c{tracked.index(p)}")).alias("seed"))
    rows = carried(rows.filter(F.col("t") > start), {"last": F.col("decision")}, ["t"], before=True).join(seed, "dump_id")
    rows = rows.withColumn("last", F.coalesce("last", "seed")).filter("decision <> last")
    rows = rows.select("dump_id", "t", "sample_t", F.when(F.col("decision"), "assert").otherwise("deassert").alias("kind"))
    return rows if capture == "switch" else rows.filter(F.col("kind") == capture)


def property_check(dump: Dump, on: str, test: str, start: str | None = None, end: str | None = None, scope: str | None = None, mode: str = PRE_EDGE, capture: str = "switch", limit: int | str | None = DEFAULT_MAX) -> Result:
    """Where an event finds a condition true (match), or finds that it turned (switch, assert, deassert)."""
    most = checked_limit(limit)
    if capture not in CAPTURES:
        raise WaveError("args", f"unknown capture '{capture}'")
    b = Bindings(dump, scope)
    terms = b.event(on)
    _require_edges(terms, mode)
    condition = b.value(test)
    if condition.type.kind in ("string", "event"):
        raise WaveError("expr", "EXPR-SEMANTIC-BOOLEAN-CONTEXT: the condition has no truth")
    low, high = dump.time.window(start, end)
    df = property_rows(dump, terms, condition, low, high, mode, capture)
    shape = lambda r: {"time": dump.time.text(r["t"]), "sample_time": dump.time.text(r["sample_t"]), "kind": r["kind"]}
    return Result("property", df, ["t", "dump_id"], most, empty="no property matches found in selected time range", shape=shape)


@dataclass
class Source:
    """One source of an extraction: rows of payload where an event finds a condition true."""

    name: str
    on: str
    when: str
    payload: list[str] = field(default_factory=list)
    label: dict[str, str] = field(default_factory=dict)


def extract_rows(dump: Dump, sources: list[Source], start: int, end: int, scope: str | None, mode: str = PRE_EDGE) -> DataFrame:
    """Rows (dump_id, t, sample_t, ord, source, v<signal>...): payload bits by signal path, null where a source has none.

    All sources share one pass over the state: each distinct event is one
    column, and a row becomes as many rows as there are sources that match."""
    b = Bindings(dump, scope)
    bound_sources = []
    for s in sources:
        terms = b.event(s.on)
        if not ev.edges_only(terms):
            raise WaveError("args", "an extraction needs an event of edges only")
        bound_sources.append((s, terms, b.value(s.when), requested(dump, s.payload, scope)))
    needed = set().union(*(ev.names(t) | w.signals() | {p.path for p in pay} for _, t, w, pay in bound_sources))
    st = states(dump, [dump.signal(p) for p in sorted(needed)], start, end)
    sample_t, exists = _sampled(dump, mode)
    samples = st.before if mode == PRE_EDGE else st.now
    payload = sorted({p.path for _, _, _, pay in bound_sources for p in pay})
    fired = {s.on: matched(t, st, []) for s, t, _, _ in bound_sources}
    rows = st.df.filter((F.col("t") >= start) & exists & reduce(or_, fired.values()))
    whens = [F.when(fired[s.on] & holds(w, samples), F.lit(k)) for k, (s, _, w, _) in enumerate(bound_sources)]
    rows = rows.withColumn("ord", F.explode(F.array_compact(F.array(*whens))))
    has = {p: [k for k, (_, _, _, pay) in enumerate(bound_sources) if p in {x.path for x in pay}] for p in payload}
    names = F.array(*(F.lit(s.name) for s in sources))
    return rows.select("dump_id", "t", sample_t.alias("sample_t"), "ord", names[F.col("ord")].alias("source"), *(F.when(F.col("ord").isin(has[p]), samples(p)).alias(f"v{k}") for k, p in enumerate(payload)))


def payload_paths(dump: Dump, sources: list[Source], scope: str | None) -> list[str]:
    """The paths behind v0, v1, ... of extract_rows."""
    return sorted({dump.scoped(p, scope) for s in sources for p in s.payload})


def extract(dump: Dump, sources: list[Source], start: str | None = None, end: str | None = None, scope: str | None = None, limit: int | str | None = DEFAULT_MAX, absolute: bool = False, mode: str = PRE_EDGE, command: str = "extract generic", diagnostics: list[Diagnostic] | None = None, context: dict | None = None, names: list[dict[str, str]] | None = None) -> Result:
    """Rows of payload of all sources, in order of time and then of declaration."""
    most = checked_limit(limit)
    if not sources:
        raise WaveError("args", "an extraction needs a source")
    low, high = dump.time.window(start, end)
    df = extract_rows(dump, sources, low, high, scope, mode)
    at = {p: k for k, p in enumerate(payload_paths(dump, sources, scope))}
    cases = F.lit(None)
    for k, s in enumerate(sources):
        own = [(n, dump.signal(dump.scoped(n, scope))) for n in s.payload]
        title = (names or [{}] * len(sources))[k]
        pairs = [F.struct(F.lit(title.get(n, shown(dump, x.path, scope, absolute))).alias("path"), literal_text(F.col(f"v{at[x.path]}"), x.type.width).alias("value")) for n, x in own]
        made = F.array(*pairs) if pairs else F.array().cast("array<struct<path:string,value:string>>")
        cases = F.when(F.col("ord") == k, made) if k == 0 else cases.when(F.col("ord") == k, made)
    df = df.select("dump_id", "t", "sample_t", "ord", "source", cases.alias("payload"))
    df = df.withColumn("error", F.when(F.exists("payload", lambda p: p["value"].isNull()), F.lit("a payload signal has no value at a match")))

    def shape(r) -> dict:
        return {"time": dump.time.text(r["t"]), "sample_time": dump.time.text(r["sample_t"]), "source": r["source"], **sources[r["ord"]].label, "payload": [p.asDict() for p in r["payload"]]}

    return Result(command, df, ["t", "ord", "dump_id"], most, list(diagnostics or []), dict(context or {}), "no matching rows found in selected time range", shape)


__all__ = ["Source", "change", "extract", "property_check", "value"]
