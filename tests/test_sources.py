"""VCD input, staging, source documents, the command line, the manual and streams."""

from __future__ import annotations

import json
import re

import pytest

from fixtures import ahb, rtl
from tracewright import cli
from tracewright.errors import WaveError
from tracewright.operators import catalog, manual
from tracewright.operators.waves import Source, change, extract, property_check, value
from tracewright.plans import events
from tracewright.plans.binding import bound
from tracewright.protocols.ahb import extract_ahb
from tracewright.protocols.buses import extract_axistream
from tracewright.results import to_json, to_jsonl, to_text
from tracewright.schemas import schema
from tracewright.sources import documents
from tracewright.sources.vcd import read_vcd, stage, staged
from tracewright.streaming.live import live_matches

VCD = """$date today $end
$timescale 1 ns $end
$scope module top $end
$var wire 1 ! clk $end
$var wire 8 " data [7:0] $end
$var event 1 % tick $end
$scope function helper $end
$var real 64 & temp $end
$upscope $end
$var wire 1 ! alias $end
$upscope $end
$enddefinitions $end
#0
$dumpvars
0!
b0 "
r0.5 &
$end
#5
1!
b1x "
1%
#10
0!
bz "
r2.5 &
#10
b101 "
#20
1!
"""


@pytest.fixture
def vcd(tmp_path):
    path = tmp_path / "a.vcd"
    path.write_text(VCD)
    return str(path)


def rows(result):
    return [(r["time"], [p["value"] for p in r["signals"]]) for r in result.rows()[0]]


def test_vcd(spark, vcd, tmp_path):
    d = read_vcd(spark, vcd)
    want = [("5ns", ["8'h0x", "1'h1"]), ("10ns", ["8'h05", "1'h0"]), ("20ns", ["8'h05", "1'h1"])]
    assert rows(change(d, ["data", "alias"], "*", scope="top", mode="native")) == want
    assert [r["time"] for r in property_check(d, "posedge top.clk", "top.helper.temp > 1.0", mode="native", capture="match").rows()[0]] == ["20ns"]
    stage(d, str(tmp_path / "staged"), 2)
    assert rows(change(staged(spark, str(tmp_path / "staged")), ["data", "alias"], "*", scope="top", mode="native")) == want


def test_file_errors(spark, tmp_path):
    with pytest.raises(WaveError) as e:
        read_vcd(spark, str(tmp_path / "none.vcd"))
    assert e.value.category == "file" and e.value.exit_code == 2
    (tmp_path / "x.fsdb").write_text("binary")
    with pytest.raises(WaveError, match="FSDB"):
        read_vcd(spark, str(tmp_path / "x.fsdb"))


def test_documents(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"kind": "extract.generic.sources", "sources": [{"name": "a", "on": "posedge clk", "when": "1", "payload": ["d"]}]}))
    assert documents.generic_sources(documents.load(str(path)))[0].payload == ["d"]
    assert documents.protocol_arguments({"kind": "extract.apb.source", "profile": "apb3", "maps": {"PCLK": "clk"}, "pready_mode": "mapped"}, "apb") == {"profile": "apb3", "pready_mode": "mapped", "maps": {"pclk": "clk"}, "includes": []}
    for bad in ({"kind": "other"}, {"kind": "extract.generic.sources", "sources": []}, {"kind": "extract.generic.sources", "sources": [{}]}):
        with pytest.raises(WaveError):
            documents.generic_sources(bad)


def test_command_line(spark, vcd, capsys):
    assert cli.main(["change", "--waves", vcd, "--scope", "top", "--signals", "data", "--on", "posedge clk", "--sample-mode", "native", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["data"][0]["time"] == "5ns"
    assert cli.main(["value", "--waves", vcd, "--at", "5ns", "--signals", "top.clk"]) == 0
    assert "@5ns top.clk=1'h1" in capsys.readouterr().out
    assert cli.main(["extract", "generic", "--waves", vcd, "--scope", "top", "--on", "posedge clk", "--when", "1", "--payload", "data", "--jsonl"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["type"] == "end"
    assert cli.main(["scope", "--waves", vcd, "--tree"]) == 0
    assert "└── helper" in capsys.readouterr().out
    assert cli.main(["info", "--waves", "/nowhere.vcd"]) == 2
    assert cli.main(["value", "--waves", vcd, "--at", "5ns", "--signals", "top.gone"]) == 1
    assert "fatal: signal" in capsys.readouterr().err
    assert cli.main(["schema", "stream"]) == 0


def test_manual(spark, tmp_path):
    assert manual.find(spark, "Expressions literals")[0]["id"] == "expressions"
    assert "Catalog" in manual.show(spark, "commands")
    with pytest.raises(WaveError, match="commands"):
        manual.show(spark, "comands")
    files = manual.export(str(tmp_path / "m"))
    assert len(files) == 3
    with pytest.raises(WaveError):
        manual.export(str(tmp_path / "m"))
    assert manual.export(str(tmp_path / "m"), force=True) == files
    assert schema("output")["required"] == ["$schema", "command", "data", "diagnostics"]


def problems(value, rule: dict, at: str = "$") -> list[str]:
    """What a value breaks of the JSON Schema keywords in use."""
    out = []
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "boolean": bool, "null": type(None)}
    if "type" in rule:
        wanted = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        if not any(isinstance(value, kinds[k]) and not (k == "integer" and isinstance(value, bool)) for k in wanted):
            return [f"{at}: no {wanted}"]
    out += [f"{at}: not {rule['const']!r}"] if "const" in rule and value != rule["const"] else []
    out += [f"{at}: {value!r} is none of its values"] if "enum" in rule and value not in rule["enum"] else []
    out += [f"{at}: {value!r}"] if "pattern" in rule and isinstance(value, str) and not re.search(rule["pattern"], value) else []
    out += [f"{at}: too small"] if isinstance(value, int) and value < rule.get("minimum", value) else []
    if isinstance(value, dict):
        out += [f"{at}: lacks {k}" for k in rule.get("required", ()) if k not in value]
        for k, v in value.items():
            own = rule.get("properties", {}).get(k, rule.get("additionalProperties", {}))
            out += [f"{at}.{k}: not allowed"] if own is False else problems(v, own, f"{at}.{k}")
            out += problems(k, rule.get("propertyNames", {}), f"{at}.{k} (name)")
    if isinstance(value, list):
        out += [f"{at}: too few"] if len(value) < rule.get("minItems", 0) else []
        for k, v in enumerate(value):
            out += problems(v, rule.get("items", {}), f"{at}[{k}]")
    for part in rule.get("allOf", ()):
        out += problems(value, part, at)
    if "if" in rule and not problems(value, rule["if"], at):
        out += problems(value, rule.get("then", {}), at)
    return out


def test_outputs_follow_their_schemas(spark, vcd):
    d = rtl(spark)
    found = [
        catalog.info(d),
        catalog.scope(d),
        catalog.signal(d, "top"),
        value(d, ["5ns"], ["data"], "top"),
        change(d, ["data"], "posedge clk", scope="top"),
        property_check(d, "edge top.clk", "top.valid"),
        extract(d, [Source("s", "posedge clk", "1", ["data"])], scope="top"),
        extract_axistream(d, {"aclk": "clk", "tvalid": "valid", "tdata": "data"}, scope="top", tready_mode="implicit-high"),
        extract_ahb(ahb(spark), {"hclk": "clk"}, ["^ahb_lite_h_"], scope="top", include_stall=True),
    ]
    whole, stream = schema("output"), schema("stream")
    for r in found:
        body = json.loads(to_json(r))
        assert problems(body, whole) == [] and body["data"], r.command
        for line in to_jsonl(r):
            assert problems(json.loads(line), stream) == [], (r.command, line)
        assert problems(json.loads(to_json(r)), schema("output", r.command)) == []
    body = json.loads(to_json(found[7]))
    body["data"]["events"][0]["payload"]["tdatum"] = "8'haa"
    assert problems(body, whole) == ["$.data.events[0].payload.tdatum (name): 'tdatum' is none of its values"]
    assert problems({**json.loads(to_json(found[4])), "data": [{"time": "5ns"}]}, whole) == ["$.data[0]: lacks sample_time", "$.data[0]: lacks signals"]
    source = {"kind": "extract.apb.source", "profile": "apb3", "maps": {"pclk": "clk"}, "pready_mode": "mapped"}
    assert problems(source, schema("input")) == []
    assert problems({**source, "profile": "apb9", "maps": {"hclk": "x"}}, schema("input")) and problems({"kind": "extract.generic.sources", "sources": []}, schema("input"))


def test_protocol_text(spark):
    lines, _ = to_text(extract_axistream(rtl(spark), {"aclk": "clk", "tvalid": "valid", "tdata": "data"}, scope="top", tready_mode="implicit-high"))
    assert lines[:4] == ["name: axistream", "profile: axi4-stream", "issue: B", "tready_mode: implicit-high"]
    assert lines[4:] == ["mappings:", "  aclk = clk", "  tvalid = valid", "  tdata = data", "transfers:", "@15ns sample@14ns tdata=8'haa", "@25ns sample@24ns tdata=8'haa"]
    lines, _ = to_text(extract_ahb(ahb(spark), {"hclk": "clk"}, ["^ahb_lite_h_"], scope="top"))
    assert {"include_stall: false", "events:"} <= set(lines) and any(re.match(r"@[0-9]+ns sample@[0-9]+ns \[address nonseq (read|write)\] ", x) for x in lines)


def test_trace(spark, vcd, capsys, monkeypatch):
    monkeypatch.setenv("DEBUG", "1")
    assert cli.main(["info", "--waves", vcd]) == 0
    found = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith('{"kind": "debug"')]
    assert [x["message"] for x in found] == ["backend.open.start", "backend.open.done", "query.plan.done"]
    assert all(x["details"]["command"] == "info" and x["timestamp_ns"] >= 0 for x in found)


def test_depth_and_kinds(spark, vcd, tmp_path, capsys):
    assert cli.main(["scope", "--waves", vcd, "--max-depth", "unlimited"]) == 0
    assert cli.main(["scope", "--waves", vcd, "--max-depth", "0", "--json"]) == 0
    assert [x["depth"] for x in json.loads(capsys.readouterr().out.splitlines()[-1])["data"]] == [0]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["scope", "--waves", vcd, "--max-depth", "-1"])
    spelled = {"triand": "triand", "trior": "trior", "trireg": "trireg", "realtime": "real_time", "shortint": "short_int", "wor": "wor", "std_logic": "logic", "std_ulogic_vector": "bit_vector", "event_parameter": "parameter", "sparray": "sparse_array", "odd": "unknown"}
    body = "".join(f"$var {k} 1 {chr(33 + n)} s{n} $end\n" for n, k in enumerate(spelled))
    text = f"$timescale 1ns $end\n$scope vhdl_architecture a $end\n{body}$upscope $end\n$enddefinitions $end\n#0\n0!\n"
    path = tmp_path / "k.vcd"
    path.write_text(text)
    d = read_vcd(spark, str(path))
    assert [r["kind"] for r in catalog.scope(d).rows()[0]] == ["unknown"]
    assert {r["name"]: r["kind"] for r in catalog.signal(d, "a").rows()[0]} == {f"s{n}": k for n, k in enumerate(spelled.values())}


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    d = rtl(spark)
    folder = str(tmp_path / "log")
    for k, (a, b) in enumerate(((0, 12), (12, 26), (26, 99))):
        d.changes.filter(f"t >= {a} and t < {b}").coalesce(1).write.parquet(f"{folder}/part={k}")
    paths = {s: f"top.{n}" for s, n in enumerate(("clk", "valid", "data"))}
    types = {p: d.signal(p).type for p in paths.values()}
    terms, test = events.bound_event("posedge top.clk", types.get), bound("top.valid", types.get)
    stream = spark.readStream.schema(d.changes.schema.add("part", "integer")).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live_matches(stream, paths, terms, test).writeStream.format("memory").queryName("live").outputMode("append").start()
    try:
        q.processAllAvailable()
        found = sorted(r["t"] for r in spark.table("live").collect())
    finally:
        q.stop()
    assert found == [15, 25]
