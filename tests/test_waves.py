"""Golden results of the row-producing queries, catalogs and bus extractors."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fixtures import ahb, apb, m2, rtl, timeline
from tracewright.errors import ExprError, WaveError
from tracewright.operators import catalog
from tracewright.operators.waves import Source, change, extract, property_check, value
from tracewright.plans import events
from tracewright.protocols.ahb import extract_ahb
from tracewright.protocols.buses import extract_apb, extract_axistream
from tracewright.protocols.mapping import meanings
from tracewright.protocols.profiles import AXI
from tracewright.results import to_json, to_jsonl, to_text, tree

NATIVE = "native"


def shown(result):
    out = []
    for r in result.rows()[0]:
        out.append((int(r["time"][:-2]), r.get("kind") or tuple(p["value"] for p in r.get("signals") or r["payload"])))
    return out


def test_change_modes(spark):
    d = rtl(spark)
    ask = lambda start, end, mode: change(d, ["data"], "posedge clk", start, end, "top", mode)
    assert shown(ask(None, "15ns", NATIVE)) == [(5, ("8'haa",))]
    assert ask(None, "15ns", "pre-edge").rows()[0][0] == {"time": "15ns", "sample_time": "14ns", "signals": [{"path": "data", "value": "8'haa"}]}
    rows, notes = ask("5ns", "15ns", "pre-edge").rows()
    assert rows == [] and [n.code for n in notes] == ["W0003"]
    assert shown(ask("5ns", "35ns", "pre-edge")) == [(35, ("8'h55",))]


def test_change_native_compares_with_the_previous_time(spark):
    d = m2(spark)
    assert shown(change(d, ["clk", "data"], "*", "1ns", "10ns", "top", NATIVE)) == [(5, ("1'h1", "8'h00")), (10, ("1'h1", "8'h0f"))]
    assert shown(change(d, ["clk"], "posedge clk", "5ns", None, "top", NATIVE)) == []
    assert shown(change(d, ["data", "clk"], "posedge clk iff data == 8'h00", None, None, "top", NATIVE)) == [(5, ("8'h00", "1'h1"))]
    wire = ("wire", 1, "0")
    t = timeline(spark, {"top.trig": wire, "top.sig": wire}, [(5, {"top.trig": "1", "top.sig": "1"}), (7, {"top.sig": "0"}), (10, {"top.trig": "0"}), (15, {"top.trig": "1"})])
    assert shown(change(t, ["sig"], "posedge trig", scope="top", mode=NATIVE)) == [(5, ("1'h1",))]
    assert shown(change(t, ["sig"], "posedge trig", "6ns", scope="top", mode=NATIVE)) == []


def test_property_captures(spark):
    d = m2(spark)
    assert shown(property_check(d, "posedge top.clk", "top.data == 8'h00", mode=NATIVE, capture="match")) == [(5, "match")]
    assert shown(property_check(d, "*", "top.data == 8'h0f", mode=NATIVE)) == [(10, "assert")]
    with pytest.raises(WaveError):
        property_check(d, "*", "1", mode=NATIVE)
    with pytest.raises(WaveError):
        property_check(d, "top.data", "1")


def test_triggered_looks_at_the_sample_time(spark):
    d = timeline(spark, {"top.clk": ("wire", 1, "0"), "top.ev": ("event", None, None)}, [(5, {"top.ev": None}), (10, {"top.clk": "1"}), (15, {"top.clk": "0"}), (19, {"top.ev": None}), (20, {"top.clk": "1"})])
    assert shown(property_check(d, "posedge top.clk", "top.ev.triggered()", capture="match")) == [(20, "match")]


def test_iff_at_the_edge_and_when_before_it(spark):
    d = timeline(spark, {"top.clk": ("wire", 1, "0"), "top.rst_n": ("wire", 1, "0"), "top.data": ("reg", 8, "10101010")}, [(5, {"top.clk": "1", "top.rst_n": "1", "top.data": "01010101"})])
    rows, _ = extract(d, [Source("t", "posedge clk iff rst_n", "1", ["data"])], scope="top").rows()
    assert [(r["time"], r["sample_time"], r["payload"][0]["value"]) for r in rows] == [("5ns", "4ns", "8'haa")]
    assert shown(extract(d, [Source("t", "posedge clk", "rst_n", ["data"])], scope="top")) == []


def test_sources_share_one_order(spark):
    d = rtl(spark)
    rows = extract(d, [Source("b", "posedge clk", "valid", ["data"]), Source("a", "posedge clk", "clk == 0", ["valid"])], scope="top", limit=2).rows()
    assert [(r["time"], r["source"]) for r in rows[0]] == [("5ns", "a"), ("15ns", "b")]
    assert rows[1][-1].code == "W0002"


def test_last_write_wins_and_first_values(spark):
    d = timeline(spark, {"top.clk": ("wire", 1, "0"), "top.g": ("wire", 1, "0"), "top.late": ("wire", 4, None)}, [(5, {"top.g": "1"}), (5, {"top.g": "0"}), (5, {"top.clk": "1"}), (7, {"top.late": "0001"})])
    assert shown(property_check(d, "edge top.g", "1", mode=NATIVE, capture="match")) == []
    assert shown(property_check(d, "top.late", "1", mode=NATIVE, capture="match")) == [(7, "match")]
    with pytest.raises(WaveError, match="no value"):
        value(d, ["5ns"], ["top.late"]).rows()


def test_value_keeps_request_order_and_duplicates(spark):
    rows = value(m2(spark), ["10ns", "0ns", "10ns"], ["cpu.valid", "data", "cpu.valid"], "top").rows()[0]
    assert [r["time"] for r in rows] == ["10ns", "0ns", "10ns"]
    assert [p["value"] for p in rows[0]["signals"]] == ["1'h1", "8'h0f", "1'h1"]


@pytest.mark.parametrize(("token", "text"), [("5", "unit"), ("5.5ns", "invalid"), ("99999999999999999999ns", "too large"), ("11ns", "outside"), ("1ps", "not a multiple")])
def test_time_tokens(spark, token, text):
    with pytest.raises(WaveError, match=text):
        value(m2(spark), [token], ["top.clk"])


def test_catalog(spark):
    d = m2(spark)
    assert [r["path"] for r in catalog.scope(d).rows()[0]] == ["top", "top.cpu", "top.mem"]
    assert tree(catalog.scope(d).rows()[0]) == ["top kind=module", "├── cpu kind=module", "└── mem kind=module"]
    assert [r["display"] for r in catalog.signal(d, "top", recursive=True).rows()[0]] == ["cfg", "clk", "data", "cpu.valid", "mem.ready"]
    assert [r["display"] for r in catalog.signal(d, "top", "^c").rows()[0]] == ["cfg", "clk"]
    assert catalog.info(d).rows()[0] == [{"time_unit": "1ns", "time_start": "0ns", "time_end": "10ns"}]
    with pytest.raises(WaveError):
        catalog.signal(d, "nowhere")


def test_ahb_golden(spark):
    d = ahb(spark)
    ask = lambda **k: extract_ahb(d, {"hclk": "clk"}, ["^ahb_lite_h_"], scope="top", **k)
    kinds = "reset address data-complete address data-complete address data-complete desynchronized address data-complete reset desynchronized reset".split()
    rows = ask().rows()[0]
    assert [r["event"] for r in rows] == kinds
    assert (rows[4]["time"], rows[5]["time"], rows[5]["transfer"]) == ("40ns", "40ns", "seq")
    late = ask(start="20ns", include_stall=True)
    assert late.context["initial_data_phase"]["address"] == {"time": "15ns", "sample_time": "14ns", "transfer": "nonseq", "direction": "read"}
    assert (late.rows()[0][0]["event"], late.rows()[0][0]["time"]) == ("data-stall", "20ns")
    rows, notes = ask(start="40ns", limit=1).rows()
    assert [(r["event"], r["time"]) for r in rows] == [("data-complete", "40ns")] and notes[-1].code == "W0002"
    assert [r["event"] for r in ask(end="15ns").rows()[0]] == ["reset", "address"]


def test_apb_golden(spark):
    d = apb(spark)
    result = extract_apb(d, includes=["^uart_apb_"], scope="top")
    rows, notes = result.rows()
    assert [(r["event"], r["direction"], r["time"]) for r in rows] == [("setup", "write", "5ns"), ("access-complete", "write", "20ns"), ("setup", "read", "25ns"), ("access-complete", "read", "30ns"), ("access-complete", "write", "35ns"), ("setup", "unknown", "40ns")]
    assert {n.code for n in notes} == {"W0004"} and len(notes) == 2
    assert "prdata" not in rows[1]["payload"] and rows[3]["payload"]["prdata"] == "8'ha5" and "pwdata" not in rows[3]["payload"]
    waits = extract_apb(d, includes=["^uart_apb_"], scope="top", include_wait=True).rows()[0]
    assert [r["event"] for r in waits][:4] == ["setup", "access-wait", "access-wait", "access-complete"]


def test_mapping():
    standards = ["paddr", "pwrite", "pclk"]
    assert meanings("uart_apb_paddr_o", standards) == ["paddr"]
    assert meanings("uart_apb_p_addr_o", standards) == ["paddr"]
    assert meanings("uart_apb_paddr_pwrite_o", standards) == ["paddr", "pwrite"]
    assert meanings("a_clk", ["aclk"]) == ["aclk"] and meanings("a_clk", ["aclk"], ("aclk",)) == []
    assert AXI["axi5"][1]["aw"][-3:] == ["awtagop", "awact", "awactv"] and AXI["ace5-lite-acp"][1]["ar"][-3:] == ["armpam", "archunken", "aridunq"]


def test_stream_modes(spark):
    with pytest.raises(WaveError):
        extract_axistream(rtl(spark), {"aclk": "clk", "tvalid": "valid"}, scope="top")
    rows = extract_axistream(rtl(spark), {"aclk": "clk", "tvalid": "valid", "tdata": "data"}, scope="top", tready_mode="implicit-high").rows()[0]
    assert [(r["time"], r["payload"]) for r in rows] == [("15ns", {"tdata": "8'haa"}), ("25ns", {"tdata": "8'haa"})]


def test_outputs(spark):
    r = change(rtl(spark), ["data"], "posedge clk", scope="top", mode=NATIVE, limit=1)
    body = json.loads(to_json(r))
    assert body["command"] == "change" and body["diagnostics"][0]["code"] == "W0002"
    records = [json.loads(x) for x in to_jsonl(r)]
    assert [x["type"] for x in records] == ["begin", "item", "diagnostic", "end"] and [x["seq"] for x in records] == [0, 1, 2, 3]
    assert to_text(r)[0] == ["@5ns data=8'haa"]


@pytest.mark.parametrize(("text", "code"), [("", "EMPTY"), ("a or", "BROKEN-UNION"), ("a iff", "EMPTY-IFF"), ("posedge", "MISSING-NAME"), ("a iff (b", "UNMATCHED-OPEN"), ("a iff b)", "UNMATCHED-CLOSE")])
def test_event_errors(text, code):
    with pytest.raises(ExprError) as e:
        events.parse(text)
    assert e.value.code == f"EXPR-PARSE-EVENT-{code}"


def test_event_terms():
    terms = events.parse("posedge a iff (b or c) && d, edge e or *")
    assert [(t.kind, t.name, t.iff) for t in terms] == [("posedge", "a", "(b or c) && d"), ("edge", "e", None), ("any", None, None)]


def test_small_ranges_give_the_same(spark, monkeypatch):
    """Carrying over many ranges of time gives what one range gives."""
    from tracewright.operators import sampling

    def everything():
        d, p, a = rtl(spark), m2(spark), ahb(spark)
        return [
            shown(change(d, ["data", "clk"], "posedge clk", scope="top")),
            shown(change(d, ["data"], "*", scope="top", mode=NATIVE)),
            shown(property_check(d, "edge top.clk", "top.valid")),
            shown(property_check(p, "*", "top.data == 8'h0f", mode=NATIVE)),
            [tuple(sorted(map(str, r.items()))) for r in extract_ahb(a, {"hclk": "clk"}, ["^ahb_lite_h_"], scope="top", include_stall=True).rows()[0]],
        ]

    monkeypatch.setattr(sampling, "time_cuts", lambda changes: [])
    want = everything()
    monkeypatch.undo()
    assert everything() == want
    monkeypatch.setattr(sampling, "time_cuts", lambda changes: list(range(3, 60_000, 7)))
    assert everything() == want


def test_time_cuts_balance_rows(spark):
    """Ranges hold about as many changes each, wherever in time those are."""
    from tracewright.operators import sampling

    times = [int(t) for t in range(0, 1000)] + [10**12 + 3 * t for t in range(9000)]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    cuts = sampling.time_cuts(df)
    counts = [r["count"] for r in df.groupBy(sampling.range_of(cuts).alias("k")).count().collect()]
    assert len(counts) == 16 and max(counts) < 1.3 * min(counts)
    for t in (0, cuts[0] - 1, cuts[0], cuts[5], cuts[-1] + 1):
        assert spark.range(1).select(F.lit(t).alias("t")).select(sampling.range_of(cuts)).first()[0] == sum(c <= t for c in cuts)
    assert sampling.time_cuts(df.limit(0)) == []
