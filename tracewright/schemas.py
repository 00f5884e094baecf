"""JSON Schemas of outputs, streams and inputs.

Each command has one schema for its data and one for its stream items; the
envelope and the records choose among them by the command's name, so that a
wrong row is an error of that row and not of every alternative."""

from __future__ import annotations

from .dump import SCOPE_KINDS, SIGNAL_KINDS
from .errors import WaveError
from .protocols import profiles as P
from .protocols.buses import ISSUES, axi_standards

DRAFT = "https://json-schema.org/draft/2020-12/schema"
TEXT, COUNT, FLAG = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
TIME = {"type": "string", "pattern": "^[0-9]+(zs|as|fs|ps|ns|us|ms|s)$"}
VALUE = {"type": "string", "pattern": "^[1-9][0-9]*'h[0-9a-fxz]+$"}
DIRECTION = {"enum": ["read", "write", "unknown"]}


def closed(required: dict, optional: dict | None = None) -> dict:
    """An object of just these properties, the first of which it must have."""
    return {"type": "object", "required": list(required), "properties": {**required, **(optional or {})}, "additionalProperties": False}


def listed(items: dict) -> dict:
    return {"type": "array", "items": items}


def named(standards: list[str], values: dict) -> dict:
    """A map whose keys are standard signal names."""
    return {"type": "object", "propertyNames": {"enum": sorted(set(standards))}, "additionalProperties": values}


PAIRS = listed(closed({"path": TEXT, "value": VALUE}))
ROWS = {
    "info": closed({"time_unit": TIME, "time_start": TIME, "time_end": TIME}),
    "scope": closed({"path": TEXT, "depth": COUNT, "kind": {"enum": SCOPE_KINDS}}),
    "signal": closed({"name": TEXT, "path": TEXT, "kind": {"enum": SIGNAL_KINDS}}, {"display": TEXT, "width": {"type": ["integer", "null"], "minimum": 0}}),
    "value": closed({"time": TIME, "signals": PAIRS}),
    "change": closed({"time": TIME, "sample_time": TIME, "signals": PAIRS}),
    "property": closed({"time": TIME, "sample_time": TIME, "kind": {"enum": ["match", "assert", "deassert"]}}),
    "extract generic": closed({"time": TIME, "sample_time": TIME, "source": TEXT, "payload": PAIRS}),
}
DOCS = {
    "docs topics": closed({"topics": listed(closed({"id": TEXT, "title": TEXT, "description": TEXT}))}),
    "docs search": closed({"query": TEXT, "matches": listed({"type": "object", "required": ["id"]})}),
}


def _profiles() -> dict[str, dict[str, list[str]]]:
    """protocol -> profile -> its standard signal names."""
    return {
        "apb": P.APB,
        "atb": P.ATB,
        "axi": {name: axi_standards(name) for name in P.AXI},
        "axistream": dict.fromkeys(P.STREAM, P.STREAM_SIGNALS),
        "ahb": P.AHB,
    }


#: What a protocol's rows and contexts have beside time, profile and payload.
MORE_ROW = {
    "apb": {"event": {"enum": ["setup", "access-wait", "access-complete"]}, "direction": DIRECTION},
    "atb": {"event": TEXT},
    "axi": {"channel": {"enum": ["aw", "w", "b", "ar", "r", "ac", "cr", "cd"]}},
    "axistream": {},
    "ahb": {"event": {"enum": ["reset", "address", "data-stall", "data-complete", "idle", "busy", "desynchronized"]}},
}
MODE = {"enum": ["mapped", "implicit-high"]}
_ADDRESS = closed({"time": TIME, "sample_time": TIME, "transfer": {"enum": ["nonseq", "seq"]}, "direction": DIRECTION})
MORE_CONTEXT = {
    "apb": {"pready_mode": MODE, "include_wait": FLAG},
    "atb": {},
    "axi": {},
    "axistream": {"tready_mode": MODE},
    "ahb": {"include_stall": FLAG, "include_idle": FLAG, "include_busy": FLAG, "initial_data_phase": closed({"state": {"enum": ["empty", "pending", "desynchronized"]}}, {"address": _ADDRESS})},
}


def _protocol(name: str) -> tuple[dict, dict]:
    """(row, context) of a protocol's extraction; one alternative for each profile."""
    rows, contexts = [], []
    for profile, standards in _profiles()[name].items():
        optional = {"transfer": {"enum": ["nonseq", "seq"]}, "direction": DIRECTION} if name == "ahb" else {}
        rows.append(closed({"time": TIME, "sample_time": TIME, "profile": {"const": profile}, **MORE_ROW[name], "payload": named(standards, VALUE)}, optional))
        issue = P.AXI[profile][0] if name == "axi" else ISSUES[name]
        contexts.append(closed({"name": TEXT, "profile": {"const": profile}, "issue": {"const": issue}, **MORE_CONTEXT[name], "mappings": named(standards, TEXT)}))
    return _by_profile(rows), _by_profile(contexts)


def _by_profile(made: list[dict]) -> dict:
    """The alternative whose profile an object names."""
    names = [m["properties"]["profile"]["const"] for m in made]
    chosen = [{"if": {"properties": {"profile": {"const": n}}, "required": ["profile"]}, "then": m} for n, m in zip(names, made, strict=True)]
    return {"type": "object", "required": ["profile"], "properties": {"profile": {"enum": names}}, "allOf": chosen}


def _commands() -> dict[str, tuple[dict, dict, dict | None]]:
    """command -> its data, its stream item, and its stream context."""
    out: dict[str, tuple[dict, dict, dict | None]] = {c: (listed(r), r, None) for c, r in ROWS.items()}
    for name in _profiles():
        row, context = _protocol(name)
        out[f"extract {name}"] = (listed(row), row, context)
    return out | {c: (r, r, None) for c, r in DOCS.items()}


DIAGNOSTIC = {"kind": {"enum": ["warning"]}, "code": {"enum": ["W0001", "W0002", "W0003", "W0004"]}, "message": TEXT}


def _case(command: str, then: dict) -> dict:
    return {"if": {"properties": {"command": {"const": command}}, "required": ["command"]}, "then": {"properties": then}}


def _output(commands: dict) -> dict:
    data = [_case(c, {"data": _data(c, d)}) for c, (d, _, _) in commands.items()]
    required = {"$schema": TEXT, "command": {"enum": list(commands)}, "data": {}, "diagnostics": listed(closed(DIAGNOSTIC))}
    return {**closed(required), "allOf": data}


def _data(command: str, data: dict) -> dict:
    """The data of a protocol: its context with the events beside it."""
    name = command.split()[-1]
    if name not in _profiles():
        return data
    context = {"name": TEXT, "profile": {"enum": list(_profiles()[name])}, "issue": TEXT, **MORE_CONTEXT[name], "mappings": {"type": "object", "additionalProperties": TEXT}}
    return closed({**context, "events": data})


def _stream(commands: dict) -> dict:
    head = {"seq": COUNT, "command": {"enum": list(commands)}}
    begin = {**closed({"type": {"const": "begin"}, **head, "seq": {"const": 0}}, {"context": {"type": "object"}}), "allOf": [_case(c, {"context": x}) for c, (_, _, x) in commands.items() if x]}
    item = {**closed({"type": {"const": "item"}, **head, "item": {}}), "allOf": [_case(c, {"item": i}) for c, (_, i, _) in commands.items()]}
    note = closed({"type": {"const": "diagnostic"}, **head, "diagnostic": closed(DIAGNOSTIC)})
    end = closed({"type": {"const": "end"}, **head, "summary": closed({"items": COUNT, "diagnostics": COUNT, "truncated": FLAG})})
    records = {"begin": begin, "item": item, "diagnostic": note, "end": end}
    chosen = [{"if": {"properties": {"type": {"const": t}}, "required": ["type"]}, "then": r} for t, r in records.items()]
    return {"type": "object", "required": ["type", "seq", "command"], "properties": {"type": {"enum": list(records)}, **head}, "allOf": chosen}


def _input() -> dict:
    generic = closed({"kind": {"const": "extract.generic.sources"}, "sources": {**listed(closed({"name": TEXT, "on": TEXT, "when": TEXT}, {"payload": listed(TEXT)})), "minItems": 1}}, {"$schema": TEXT})
    kinds = {"extract.generic.sources": generic}
    modes = {"apb": {"pready_mode": MODE, "include_wait": FLAG}, "axistream": {"tready_mode": MODE}, "ahb": {"include_stall": FLAG, "include_idle": FLAG, "include_busy": FLAG}}
    for name, profiles in _profiles().items():
        maps = named([s for own in profiles.values() for s in own], TEXT)
        kind = f"extract.{name}.source"
        kinds[kind] = closed({"kind": {"const": kind}}, {"$schema": TEXT, "name": TEXT, "profile": {"enum": list(profiles)}, "maps": maps, "includes": listed(TEXT), **modes.get(name, {})})
    chosen = [{"if": {"properties": {"kind": {"const": k}}, "required": ["kind"]}, "then": s} for k, s in kinds.items()]
    return {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": list(kinds)}}, "allOf": chosen}


def schema(kind: str, command: str | None = None) -> dict:
    """`output`, `stream` or `input`, for one command or all."""
    commands = _commands() if command is None else {c: x for c, x in _commands().items() if c == command}
    made = {"output": lambda: _output(commands), "stream": lambda: _stream(commands), "input": _input}.get(kind)
    if made is None or not commands:
        raise WaveError("args", f"unknown schema '{kind}'" if made is None else f"unknown command '{command}'")
    return {"$schema": DRAFT, "title": kind, **made()}
