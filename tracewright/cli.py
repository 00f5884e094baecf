"""Command line: python -m tracewright.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .dump import Dump
from .errors import WaveError
from .operators import catalog, manual, waves
from .operators.waves import Source
from .protocols import ahb, buses
from .protocols.mapping import pairs_of
from .results import Result, to_json, to_jsonl, to_text, tree
from .schemas import schema
from .sources import documents
from .sources.fst import read_fst
from .sources.vcd import read_vcd, staged
from .trace import Trace


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _open(path: str) -> Dump:
    spark = _session()
    low = path.lower()
    if low.endswith(".fst"):
        return read_fst(spark, path)
    if low.endswith((".parquet", "/")):
        return staged(spark, path.rstrip("/"))
    return read_vcd(spark, path)


def _depth(text: str) -> int | None:
    if text == "unlimited":
        return None
    if not text.isdigit():
        raise argparse.ArgumentTypeError("a number or 'unlimited'")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description="Queries over waveform dumps")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str, parent=commands) -> argparse.ArgumentParser:
        c = parent.add_parser(name)
        form = c.add_mutually_exclusive_group()
        form.add_argument("--json", action="store_true")
        form.add_argument("--jsonl", action="store_true")
        c.add_argument("--waves", required=True)
        for m in more:
            {
                "max": lambda: c.add_argument("--max", default="50"),
                "window": lambda: (c.add_argument("--from", dest="start"), c.add_argument("--to", dest="end")),
                "scope": lambda: c.add_argument("--scope"),
                "abs": lambda: c.add_argument("--abs", action="store_true", dest="absolute"),
                "filter": lambda: c.add_argument("--filter", default=".*"),
                "depth": lambda: c.add_argument("--max-depth", type=_depth, default=5),
                "mode": lambda: c.add_argument("--sample-mode", default=waves.PRE_EDGE, choices=[waves.PRE_EDGE, waves.NATIVE]),
                "bus": lambda: (c.add_argument("--profile"), c.add_argument("--source"), c.add_argument("--map", action="append", default=[], dest="maps"), c.add_argument("--include", action="append", default=[], dest="includes")),
            }[m]()
        return c

    command("info")
    command("scope", "max", "filter", "depth").add_argument("--tree", action="store_true")
    s = command("signal", "max", "filter", "depth", "abs")
    s.add_argument("--scope", required=True)
    s.add_argument("--recursive", action="store_true")
    v = command("value", "scope", "abs")
    v.add_argument("--at", required=True)
    v.add_argument("--signals", required=True)
    c = command("change", "window", "scope", "max", "abs", "mode")
    c.add_argument("--signals", required=True)
    c.add_argument("--on", required=True)
    q = command("property", "window", "scope", "max", "mode")
    q.add_argument("--on", required=True)
    q.add_argument("--eval", required=True, dest="test")
    q.add_argument("--capture", default="switch", choices=waves.CAPTURES)
    kinds = commands.add_parser("extract").add_subparsers(dest="kind", required=True)
    g = command("generic", "window", "scope", "max", "abs", parent=kinds)
    g.add_argument("--source")
    g.add_argument("--name", default="transfer")
    g.add_argument("--on")
    g.add_argument("--when")
    g.add_argument("--payload", default="")
    for kind in documents.KINDS:
        b = command(kind, "window", "scope", "max", "bus", parent=kinds)
        if kind == "ahb":
            for row in ("stall", "idle", "busy"):
                b.add_argument(f"--include-{row}", action="store_true")
        if kind == "apb":
            b.add_argument("--pready-mode", default=None, choices=["mapped", "implicit-high"])
            b.add_argument("--include-wait", action="store_true")
        if kind == "axistream":
            b.add_argument("--tready-mode", default=None, choices=["mapped", "implicit-high"])
    d = commands.add_parser("docs").add_subparsers(dest="kind", required=True)
    d.add_parser("topics")
    d.add_parser("show").add_argument("topic")
    d.add_parser("search").add_argument("query")
    e = d.add_parser("export")
    e.add_argument("folder")
    e.add_argument("--force", action="store_true")
    commands.add_parser("skill")
    sc = commands.add_parser("schema")
    sc.add_argument("kind", nargs="?", default="output", choices=["output", "stream", "input"])
    sc.add_argument("--stream", action="store_const", const="stream", dest="kind")
    sc.add_argument("--input", action="store_const", const="input", dest="kind")
    return p


def result(a: argparse.Namespace) -> Result:
    """The query of parsed arguments."""
    trace = Trace(a.command if a.command != "extract" else f"extract {a.kind}")
    trace.event("backend.open.start")
    dump = _open(a.waves)
    trace.event("backend.open.done", lambda: {"waves": a.waves, "time_start": dump.time.start, "time_end": dump.time.end})
    made = _query(a, dump)
    trace.event("query.plan.done", lambda: {"order": made.order, "limit": made.limit})
    return made


def _query(a: argparse.Namespace, dump: Dump) -> Result:
    names = lambda text: [n.strip() for n in text.split(",") if n.strip()]
    if a.command == "info":
        return catalog.info(dump)
    if a.command == "scope":
        return catalog.scope(dump, a.filter, a.max_depth, a.max)
    if a.command == "signal":
        return catalog.signal(dump, a.scope, a.filter, a.recursive, a.max_depth, a.absolute, a.max)
    if a.command == "value":
        return waves.value(dump, names(a.at), names(a.signals), a.scope, a.absolute)
    if a.command == "change":
        return waves.change(dump, names(a.signals), a.on, a.start, a.end, a.scope, a.sample_mode, a.max, a.absolute)
    if a.command == "property":
        return waves.property_check(dump, a.on, a.test, a.start, a.end, a.scope, a.sample_mode, a.capture, a.max)
    if a.kind == "generic":
        if (a.source is None) == (a.on is None or a.when is None):
            raise WaveError("args", "give either --source or both --on and --when")
        sources = documents.generic_sources(documents.load(a.source)) if a.source else [Source(a.name, a.on, a.when, names(a.payload))]
        return waves.extract(dump, sources, a.start, a.end, a.scope, a.max, a.absolute)
    run = {"apb": buses.extract_apb, "atb": buses.extract_atb, "axi": buses.extract_axi, "axistream": buses.extract_axistream, "ahb": ahb.extract_ahb}[a.kind]
    if a.source is not None:
        if a.maps or a.includes or a.profile:
            raise WaveError("args", "--source excludes --profile, --map and --include")
        more = documents.protocol_arguments(documents.load(a.source), a.kind)
    else:
        more = {"maps": pairs_of(a.maps), "includes": a.includes}
        for k in ("profile", *documents.EXTRA.get(a.kind, ())):
            if getattr(a, k, None):
                more[k] = getattr(a, k)
    return run(dump, scope=a.scope, start=a.start, end=a.end, limit=a.max, **more)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "schema":
            print(json.dumps(schema(a.kind), indent=1))
        elif a.command == "skill":
            print(manual.show(_session(), "commands"))
        elif a.command == "docs":
            if a.kind == "topics":
                print("\n".join(f"{t[0]}: {t[2]}" for t in manual.packaged()))
            elif a.kind == "show":
                print(manual.show(_session(), a.topic))
            elif a.kind == "search":
                print("\n".join(r["id"] for r in manual.find(_session(), a.query)))
            else:
                print("\n".join(manual.export(a.folder, a.force)))
        else:
            r = result(a)
            if a.json:
                print(to_json(r))
            elif a.jsonl:
                for line in to_jsonl(r):
                    print(line, flush=True)
            elif getattr(a, "tree", False):
                print("\n".join(tree(r.rows()[0])))
            else:
                lines, notes = to_text(r)
                print("\n".join(lines))
                print("\n".join(notes), file=sys.stderr)
    except WaveError as e:
        print(f"fatal: {e}", file=sys.stderr)
        return e.exit_code
    except BrokenPipeError:
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
