"""AHB: address and data phases overlap, so a row needs the state that earlier edges left.

At each clock edge the state is set by the last edge that set one, which a
carried column gives; no row-by-row walk is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dump import Dump
from ..errors import WaveError
from ..functions.bits import literal_text
from ..operators.sampling import carried, states
from ..operators.triggers import edge
from ..results import DEFAULT_MAX, Result, checked_limit
from . import profiles as P
from .buses import ISSUES
from .mapping import mapped

ORDER = ("reset", "data-stall", "data-complete", "address", "idle", "busy", "desynchronized")


def _direction(write: Column) -> Column:
    return F.when(write == "0", "read").when(write == "1", "write").otherwise("unknown")


def _inputs(found: dict[str, str]) -> tuple[Column, Column, Column, Column, Column]:
    """reset, ready, transfer and write bits at an edge, and the kind of transfer that begins."""
    reset = F.coalesce(F.col("s_hresetn"), F.lit("x")) if "hresetn" in found else F.lit("1")
    ready, trans = F.coalesce(F.col("s_hready"), F.lit("x")), F.coalesce(F.col("s_htrans"), F.lit("xx"))
    return reset, ready, trans, F.coalesce(F.col("s_hwrite"), F.lit("x")), F.when(trans == "10", "nonseq").when(trans == "11", "seq")


def ahb_edges(dump: Dump, found: dict[str, str], end: int, scope: str | None = None) -> DataFrame:
    """Clock edges from the dump's start: dump_id, bucket, t, s_<standard> bits, and setter, the state that the edge sets (null: none)."""
    paths = {s: dump.scoped(n, scope) for s, n in found.items()}
    st = states(dump, [dump.signal(p) for p in paths.values()], dump.time.start, end)
    clock = paths["hclk"]
    at = {s: F.right(st.before(p), F.lit(1)) if s in ("hready", "hwrite", "hresetn", "hresp") else st.before(p) for s, p in paths.items()}
    edges = st.df.filter(edge("posedge", st.before(clock), st.now(clock)) & (F.col("t") > F.col("start_raw")))
    rows = edges.select("dump_id", "bucket", "t", *(c.alias(f"s_{s}") for s, c in at.items()))
    reset, ready, trans, write, moves = _inputs(found)

    def phase(name: str, transfer: Column | None = None, direction: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("name"), F.col("t").alias("t"), (none if transfer is None else transfer).alias("transfer"), (none if direction is None else direction).alias("direction"))

    setter = (
        F.when(reset == "0", phase("empty"))
        .when((reset != "1") | ~ready.isin("0", "1"), phase("desynchronized"))
        .when(ready == "0", F.lit(None))
        .when(moves.isNotNull(), phase("pending", moves, _direction(write)))
        .when(trans.isin("00", "01"), phase("empty"))
        .otherwise(phase("desynchronized"))
    )
    return rows.withColumn("setter", setter)


def ahb_rows(dump: Dump, found: dict[str, str], end: int, scope: str | None = None, stall: bool = False, idle: bool = False, busy: bool = False) -> DataFrame:
    """dump_id, t, sample_t, ord, event, transfer, direction, phase (the last state set before t) and s_<standard> bits, from the dump's start."""
    reset, ready, trans, write, moves = _inputs(found)
    rows = carried(ahb_edges(dump, found, end, scope).withColumn("held", reset), {"phase": F.col("setter"), "last_reset": F.col("held")}, ["t"], before=True)
    state = F.coalesce(F.col("phase.name"), F.lit("desynchronized"))
    good = (reset == "1") & ready.isin("0", "1")
    lost = (state != "desynchronized") & (((reset != "0") & ~good) | (good & (ready == "1") & moves.isNull() & ~trans.isin("00", "01")))

    def event(name: str, when: Column, transfer: Column | str | None = None, direction: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        t = none if transfer is None else F.lit(transfer) if isinstance(transfer, str) else transfer
        return F.when(when, F.struct(F.lit(ORDER.index(name)).alias("ord"), F.lit(name).alias("event"), t.alias("transfer"), (none if direction is None else direction).alias("direction")))

    pending = F.col("phase.direction")
    events = [
        event("reset", (reset == "0") & ~F.coalesce(F.col("last_reset") == "0", F.lit(False))),
        event("data-stall", good & (ready == "0") & (state == "pending") & F.lit(stall), None, pending),
        event("data-complete", good & (ready == "1") & (state == "pending"), None, pending),
        event("address", good & (ready == "1") & moves.isNotNull(), moves, _direction(write)),
        event("idle", good & (ready == "1") & (trans == "00") & F.lit(idle), "idle"),
        event("busy", good & (ready == "1") & (trans == "01") & F.lit(busy), "busy", _direction(write)),
        event("desynchronized", lost),
    ]
    rows = rows.withColumn("e", F.explode(F.array_compact(F.array(*events))))
    return rows.select("dump_id", "t", (F.col("t") - 1).alias("sample_t"), "e.*", "phase", *(f"s_{s}" for s in found))


def payload_standards(found: dict[str, str]) -> dict[str, list[str]]:
    """Everything an event kind may show, in order; rows then leave out what their direction and response exclude."""
    data = ["hresp", *P.AHB_WRITE, *P.AHB_READ, *P.AHB_GOOD_READ, *P.AHB_GOOD]
    table = {"address": P.AHB_ADDRESS, "busy": P.AHB_ADDRESS, "idle": P.AHB_IDLE, "data-stall": data, "data-complete": data, "reset": [], "desynchronized": []}
    return {k: [s for s in v if s in found] for k, v in table.items()}


def payload_column(dump: Dump, found: dict[str, str], scope: str | None) -> Column:
    complete = F.col("event") == "data-complete"
    success = complete & (F.coalesce(F.col("s_hresp"), F.lit("x")) == "0") if "hresp" in found else F.lit(False)
    reads, writes = F.col("direction").isin("read", "unknown"), F.col("direction").isin("write", "unknown")
    unknown = F.col("direction") == "unknown"

    def shown(s: str, event: str) -> Column:
        if event not in ("data-stall", "data-complete") or s == "hresp":
            return F.lit(True)
        if s in P.AHB_WRITE:
            return writes
        if s in P.AHB_READ:
            return (complete & reads) | unknown
        return success & (reads if s in P.AHB_GOOD_READ else F.lit(True))

    out = F.array().cast("array<struct<path:string,value:string>>")
    whole = out
    for event, own in payload_standards(found).items():
        if own:
            cells = [F.when(shown(s, event), F.struct(F.lit(s).alias("path"), literal_text(F.col(f"s_{s}"), dump.signal(dump.scoped(found[s], scope)).type.width).alias("value"))) for s in own]
            whole = F.when(F.col("event") == event, F.array_compact(F.array(*cells))).otherwise(whole)
    return whole


def extract_ahb(dump: Dump, maps: dict[str, str] | None = None, includes: list[str] | None = None, profile: str = "ahb-lite", include_stall: bool = False, include_idle: bool = False, include_busy: bool = False, scope: str | None = None, start: str | None = None, end: str | None = None, limit: int | str | None = DEFAULT_MAX) -> Result:
    """Pipeline rows from `start` on; the state there is that of the whole dump before, shown as initial_data_phase."""
    if profile not in P.AHB:
        raise WaveError("args", f"unknown AHB profile '{profile}'")
    most = checked_limit(limit)
    found, notes = mapped(dump, "AHB", P.AHB[profile], maps or {}, includes or [], scope, no_decoys=True)
    for s in P.AHB_REQUIRED:
        if s not in found:
            raise WaveError("args", f"AHB mapping requires {s}")
    low, high = dump.time.window(start, end)
    rows = ahb_rows(dump, found, high, scope, include_stall, include_idle, include_busy)
    missing = F.coalesce(*(F.when(F.col(f"s_{s}").isNull(), F.lit(f"signal '{found[s]}' has no value at an edge")) for s in found))
    df = rows.filter(F.col("t") >= low).withColumn("payload", payload_column(dump, found, scope)).withColumn("error", missing)

    def shape(r) -> dict:
        more = {k: r[k] for k in ("transfer", "direction") if r[k] is not None}
        return {"time": dump.time.text(r["t"]), "sample_time": dump.time.text(r["sample_t"]), "profile": profile, "event": r["event"], **more, "payload": {p["path"]: p["value"] for p in r["payload"]}}

    context = {"name": "ahb", "profile": profile, "issue": ISSUES["ahb"], "include_stall": include_stall, "include_idle": include_idle, "include_busy": include_busy, "mappings": found, "initial_data_phase": _initial(dump, found, scope, low)}
    return Result("extract ahb", df.drop("phase"), ["t", "ord", "dump_id"], most, notes, context, "no AHB events found in selected time range", shape)


def _initial(dump: Dump, found: dict[str, str], scope: str | None, start: int) -> dict:
    """The state that edges before `start` leave."""
    before = ahb_edges(dump, found, start, scope).filter((F.col("t") < start) & F.col("setter").isNotNull())
    last = before.agg(F.max_by("setter", "t")).first()[0]
    if last is None or last["name"] != "pending":
        return {"state": "desynchronized" if last is None else last["name"]}
    t = last["t"]
    return {"state": "pending", "address": {"time": dump.time.text(t), "sample_time": dump.time.text(t - 1), "transfer": last["transfer"], "direction": last["direction"]}}
