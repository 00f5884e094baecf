"""APB, ATB, AXI and AXI-Stream: each a set of sources for one extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dump import Dump
from ..errors import Diagnostic, WaveError
from ..operators.waves import Source, extract
from ..results import DEFAULT_MAX, Result
from . import profiles as P
from .mapping import mapped

Maps = dict[str, str]


def _needs(protocol: str, found: Maps, names: list[str]) -> None:
    for n in names:
        if n not in found:
            raise WaveError("args", f"{protocol} mapping requires {n}")


def _all(*names: str | None) -> str:
    return " && ".join(n for n in names if n)


def _profile(table, profile: str, protocol: str):
    """The entry of a profile in a table of profiles, or nothing for a plain list of them."""
    if profile not in table:
        raise WaveError("args", f"unknown {protocol} profile '{profile}'")
    return table[profile] if isinstance(table, dict) else None


def apb_sources(found: Maps, profile: str = "apb4", pready_mode: str = "mapped", include_wait: bool = False) -> tuple[list[Source], list[list[str]]]:
    """setup, access-wait and access-complete, in this order, with each source's payload standards."""
    _needs("APB", found, P.APB_REQUIRED)
    ready = found.get("pready")
    if pready_mode == "mapped" and ready is None:
        raise WaveError("args", "APB pready-mode mapped requires a pready mapping")
    if pready_mode == "implicit-high" and ready is not None:
        raise WaveError("args", "APB pready-mode implicit-high forbids a pready mapping")
    if include_wait and pready_mode != "mapped":
        raise WaveError("args", "APB wait rows need pready-mode mapped")
    sel, enable, reset = found["psel"], found["penable"], found.get("presetn")
    events = [("setup", f"{sel} && !{enable}")]
    if include_wait:
        events.append(("access-wait", f"{sel} && {enable} && !{ready}"))
    events.append(("access-complete", _all(sel, enable, ready)))
    sources, standards = [], []
    for event, when in events:
        own = [s for s in P.APB[profile] if s in found and s not in P.APB_CONTEXT and (event == "access-complete" or s not in P.APB_COMPLETION)]
        sources.append(Source(event, f"posedge {found['pclk']}", _all(reset, when), [found[s] for s in own], {"profile": profile, "event": event}))
        standards.append(own)
    return sources, standards


def atb_sources(found: Maps, profile: str = "atb-c") -> tuple[list[Source], list[list[str]]]:
    _needs("ATB", found, ["atclk"])
    on, reset = f"posedge {found['atclk']}", found.get("atresetn")

    def complete(channel: str, valid: str, ready: str) -> bool:
        if (valid in found) != (ready in found):
            raise WaveError("args", f"ATB {channel} channel must map both {valid} and {ready}")
        return valid in found

    sources, standards = [], []

    def add(event: str, own: list[str], *names: str) -> None:
        sources.append(Source(event, on, _all(reset, *(found[n] for n in names)), [found[s] for s in own], {"profile": profile, "event": event}))
        standards.append(own)

    own = [s for s in P.ATB_PAYLOAD if s in found]
    transfer = complete("transfer", "atvalid", "atready")
    if own and not transfer:
        raise WaveError("args", "ATB transfer payload needs both atvalid and atready")
    if transfer:
        add("transfer", own, "atvalid", "atready")
    flush = complete("flush", "afvalid", "afready")
    if flush:
        add("flush", [], "afvalid", "afready")
    if not transfer and not flush:
        raise WaveError("args", "ATB extraction requires a complete transfer or flush channel")
    if "syncreq" in found:
        add("sync-request", [], "syncreq")
    return sources, standards


def axi_sources(found: Maps, profile: str = "axi4") -> tuple[list[Source], list[list[str]]]:
    """One source for each channel whose valid and ready are mapped, in the profile's order."""
    _needs("AXI", found, ["aclk"])
    sources, standards = [], []
    for channel, fields in P.AXI[profile][1].items():
        valid, ready = f"{channel}valid", f"{channel}ready"
        own = [f for f in fields if f in found]
        if (valid in found) != (ready in found) or own and valid not in found:
            raise WaveError("args", f"AXI {channel} channel must map both {valid} and {ready}")
        if valid in found:
            sources.append(Source(channel, f"posedge {found['aclk']}", _all(found.get("aresetn"), found[valid], found[ready]), [found[f] for f in own], {"profile": profile, "channel": channel}))
            standards.append(own)
    if not sources:
        raise WaveError("args", "AXI extraction requires a complete channel")
    return sources, standards


def stream_sources(found: Maps, profile: str = "axi4-stream", tready_mode: str = "mapped") -> tuple[list[Source], list[list[str]]]:
    _needs("AXI-Stream", found, ["aclk", "tvalid"])
    if (tready_mode == "mapped") != ("tready" in found):
        raise WaveError("args", f"AXI-Stream tready-mode {tready_mode} {'requires' if tready_mode == 'mapped' else 'forbids'} a tready mapping")
    own = [s for s in P.STREAM_PAYLOAD if s in found]
    when = _all(found.get("aresetn"), found["tvalid"], found.get("tready"))
    return [Source("transfer", f"posedge {found['aclk']}", when, [found[s] for s in own], {"profile": profile})], [own]


def axi_standards(profile: str) -> list[str]:
    out = list(P.AXI_CONTEXT)
    for channel, fields in P.AXI[profile][1].items():
        out += [f"{channel}valid", f"{channel}ready", *fields]
    return out


#: Issues of the specifications that profiles follow.
ISSUES = {"apb": "E", "atb": "C", "axistream": "B", "ahb": "C"}


def _extracted(dump: Dump, command: str, built: tuple[list[Source], list[list[str]]], notes: list[Diagnostic], profile: str, scope: str | None, start, end, limit, found: Maps, **more) -> Result:
    """One extraction of all sources; payloads are keyed by standard name."""
    sources, standards = built
    names = [dict(zip(s.payload, own, strict=True)) for s, own in zip(sources, standards, strict=True)]
    issue = P.AXI[profile][0] if command == "axi" else ISSUES[command]
    context = {"name": command, "profile": profile, "issue": issue, **more, "mappings": found}
    result = extract(dump, sources, start, end, scope, limit, command=f"extract {command}", diagnostics=notes, context=context, names=names)
    inner = result.shape
    result.shape = lambda r: {k: v for k, v in keyed(inner(r)).items() if k != "source"}
    return result


def keyed(row: dict) -> dict:
    return {**row, "payload": {p["path"]: p["value"] for p in row["payload"]}}


def extract_apb(dump: Dump, maps: Maps | None = None, includes: list[str] | None = None, profile: str = "apb4", pready_mode: str = "mapped", include_wait: bool = False, scope: str | None = None, start: str | None = None, end: str | None = None, limit: int | str | None = DEFAULT_MAX) -> Result:
    """Setup and access rows with direction; each row has the payload that its direction gives meaning to."""
    found, notes = mapped(dump, "APB", _profile(P.APB, profile, "APB"), maps or {}, includes or [], scope)
    result = _extracted(dump, "apb", apb_sources(found, profile, pready_mode, include_wait), notes, profile, scope, start, end, limit, found, pready_mode=pready_mode, include_wait=include_wait)
    result.df = with_direction(result.df)
    inner = result.shape
    result.shape = lambda r: inner(r) | {"direction": r["direction"]}
    return result


def with_direction(df: DataFrame) -> DataFrame:
    """direction from pwrite's bits, and the payload without what only the other direction uses."""
    pwrite = F.element_at(F.filter("payload", lambda p: p["path"] == "pwrite"), 1)["value"]
    df = df.withColumn("direction", F.when(pwrite.rlike("'h0+$"), "read").when(pwrite.rlike("'h0*1$"), "write").otherwise("unknown"))
    allowed = lambda p: ~((F.col("direction") == "read") & p["path"].isin(P.APB_WRITE)) & ~((F.col("direction") == "write") & p["path"].isin(P.APB_READ))
    return df.withColumn("payload", F.filter("payload", allowed))


def extract_atb(dump: Dump, maps: Maps | None = None, includes: list[str] | None = None, profile: str = "atb-c", scope: str | None = None, start: str | None = None, end: str | None = None, limit: int | str | None = DEFAULT_MAX) -> Result:
    found, notes = mapped(dump, "ATB", _profile(P.ATB, profile, "ATB"), maps or {}, includes or [], scope, runs=False)
    return _extracted(dump, "atb", atb_sources(found, profile), notes, profile, scope, start, end, limit, found)


def extract_axi(dump: Dump, maps: Maps | None = None, includes: list[str] | None = None, profile: str = "axi4", scope: str | None = None, start: str | None = None, end: str | None = None, limit: int | str | None = DEFAULT_MAX) -> Result:
    _profile(P.AXI, profile, "AXI")
    found, notes = mapped(dump, "AXI", axi_standards(profile), maps or {}, includes or [], scope, P.AXI_CONTEXT)
    return _extracted(dump, "axi", axi_sources(found, profile), notes, profile, scope, start, end, limit, found)


def extract_axistream(dump: Dump, maps: Maps | None = None, includes: list[str] | None = None, profile: str = "axi4-stream", tready_mode: str = "mapped", scope: str | None = None, start: str | None = None, end: str | None = None, limit: int | str | None = DEFAULT_MAX) -> Result:
    _profile(P.STREAM, profile, "AXI-Stream")
    found, notes = mapped(dump, "AXI-Stream", P.STREAM_SIGNALS, maps or {}, includes or [], scope, P.AXI_CONTEXT)
    return _extracted(dump, "axistream", stream_sources(found, profile, tready_mode), notes, profile, scope, start, end, limit, found, tready_mode=tready_mode)
