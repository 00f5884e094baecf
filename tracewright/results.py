"""Query results: rows up to a limit, diagnostics, and their output forms."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .errors import Diagnostic, WaveError

DEFAULT_MAX = 50


@dataclass
class Result:
    """An ordered frame of a command; `rows()` runs it, up to one row over the limit."""

    command: str
    df: DataFrame
    order: list[str]
    limit: int | None = DEFAULT_MAX
    diagnostics: list[Diagnostic] = field(default_factory=list)
    context: dict = field(default_factory=dict)
    empty: str | None = None
    shape: object = None  # row -> dict for output
    limited: bool = True  # whether the command has a limit at all

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    def rows(self) -> tuple[list[dict], list[Diagnostic]]:
        """The rows as dicts and all diagnostics: no limit, unmatched candidates, empty, truncated."""
        notes = ([Diagnostic("W0001", "limit disabled: --max=unlimited")] if self.limit is None and self.limited else []) + list(self.diagnostics)
        found = (self.ordered() if self.limit is None else self.ordered().limit(self.limit + 1)).collect()
        cut = self.limit is not None and len(found) > self.limit
        out = [self._shaped(r) for r in found[: self.limit]]
        if not out and self.empty:
            notes.append(Diagnostic("W0003", self.empty))
        if cut:
            notes.append(Diagnostic("W0002", f"truncated output to {self.limit} entries (use --max to increase limit)"))
        return out, notes

    def _shaped(self, row) -> dict:
        made = self.shape(row) if callable(self.shape) else row.asDict(recursive=True)
        if "error" in row and row["error"]:
            raise WaveError("signal", row["error"])
        return made


def checked_limit(limit: int | str | None) -> int | None:
    """A limit argument: a positive number, or None or `unlimited`."""
    if limit is None or limit == "unlimited":
        return None
    if not str(limit).isdigit() or int(limit) < 1:
        raise WaveError("args", "--max must be a positive number or 'unlimited'")
    return int(limit)


def to_json(result: Result) -> str:
    data, notes = result.rows()
    body: object = data if not result.context else {**result.context, "events": data}
    return json.dumps({"$schema": f"output/{result.command.replace(' ', '-')}", "command": result.command, "data": body, "diagnostics": [vars(d) for d in notes]}, ensure_ascii=False)


def to_jsonl(result: Result) -> Iterator[str]:
    """begin, item*, diagnostic*, end records; rows come from the cluster as they are read."""
    n = 0

    def record(record_type: str, **more) -> str:
        nonlocal n
        n += 1
        return json.dumps({"type": record_type, "seq": n - 1, "command": result.command, **more}, ensure_ascii=False)

    yield record("begin", **({"context": result.context} if result.context else {}))
    notes = ([Diagnostic("W0001", "limit disabled: --max=unlimited")] if result.limit is None and result.limited else []) + list(result.diagnostics)
    shown, cut = 0, False
    frame = result.ordered() if result.limit is None else result.ordered().limit(result.limit + 1)
    for row in frame.toLocalIterator():
        if result.limit is not None and shown == result.limit:
            notes.append(Diagnostic("W0002", f"truncated output to {result.limit} entries (use --max to increase limit)"))
            cut = True
            break
        yield record("item", item=result._shaped(row))
        shown += 1
    if not shown and result.empty:
        notes.append(Diagnostic("W0003", result.empty))
    for d in notes:
        yield record("diagnostic", diagnostic={"kind": d.kind, "code": d.code, "message": d.message})
    yield record("end", summary={"items": shown, "diagnostics": len(notes), "truncated": cut})


def to_text(result: Result) -> tuple[list[str], list[str]]:
    """Lines for people, and the diagnostics as lines for stderr."""
    data, notes = result.rows()
    shown = PROTOCOL_LABELS.get(result.command)
    lines = _protocol(result.context, data, *shown) if shown else [_line(result.command, r) for r in data]
    return lines, [f"{d.kind}: {d.code}: {d.message}" for d in notes]


#: How protocols show their rows: the title of the list, and the fields of a row's label.
PROTOCOL_LABELS = {
    "extract ahb": ("events", ("event", "transfer", "direction")),
    "extract apb": ("events", ("event", "direction")),
    "extract atb": ("events", ("event",)),
    "extract axi": ("transfers", ("channel",)),
    "extract axistream": ("transfers", ()),
}


def _protocol(context: dict, rows: list[dict], title: str, label: tuple[str, ...]) -> list[str]:
    """The context line by line, its mappings, and a line for each row."""
    lines = []
    for k, v in context.items():
        if k == "mappings":
            lines += ["mappings:", *(f"  {standard} = {name}" for standard, name in v.items())]
        else:
            lines.append(f"{k}: {v['state'] if isinstance(v, dict) else str(v).lower() if isinstance(v, bool) else v}")
    lines.append(f"{title}:")
    for r in rows:
        words = list(dict.fromkeys(r[k] for k in label if r.get(k)))  # an event that is its own transfer is named once
        named = [f"[{' '.join(words)}]"] if words else []
        lines.append(" ".join([f"@{r['time']}", f"sample@{r['sample_time']}", *named, *(f"{k}={v}" for k, v in r["payload"].items())]))
    return lines


def _line(command: str, row: dict) -> str:
    if command == "info":
        return "\n".join(f"{k}: {v}" for k, v in row.items())
    if command == "scope":
        return f"{row['depth']} {row['path']} kind={row['kind']}"
    if command == "signal":
        return f"{row['display']} kind={row['kind']}" + (f" width={row['width']}" if row.get("width") is not None else "")
    head = f"@{row['time']}" if "time" in row else ""
    if row.get("sample_time", row.get("time")) != row.get("time") or command.startswith("extract"):
        head += f" sample@{row['sample_time']}"
    pairs = row.get("signals") or row.get("payload") or []
    if isinstance(pairs, dict):
        pairs = [{"path": k, "value": v} for k, v in pairs.items()]
    named = [str(row[k]) for k in ("source", "event", "direction", "kind") if row.get(k)]
    return " ".join([head, *named, *(f"{p['path']}={p['value']}" for p in pairs)]).strip()


def tree(rows: list[dict]) -> list[str]:
    """Scope rows (path, depth) in pre-order as a box-drawn tree."""
    lines = []
    for k, r in enumerate(rows):
        below = rows[k + 1 :]

        def more(depth: int, below=below) -> bool:
            for b in below:
                if b["depth"] < depth:
                    return False
                if b["depth"] == depth:
                    return True
            return False

        d = r["depth"]
        rails = "".join("│   " if more(x) else "    " for x in range(1, d))
        knot = "" if d == 0 else "├── " if more(d) else "└── "
        lines.append(f"{rails}{knot}{r['path'].rpartition('.')[2]} kind={r['kind']}")
    return lines
