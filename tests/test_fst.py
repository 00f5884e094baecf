"""FST input: what its writer put in comes out, and queries agree with other inputs."""

from __future__ import annotations

import gzip
import random

import pytest

import fst_writer
from tracewright.errors import WaveError
from tracewright.operators import catalog
from tracewright.operators.waves import change, property_check, value
from tracewright.sources.fst import Reader, read_fst
from tracewright.sources.vcd import read_vcd

LABELS = {"IDLE": "00", "BUSY": "01"}
SIGNALS = [("top.clk", "wire", 1), ("top.data", "wire", 8), ("top.tick", "event", 1), ("top.u.temp", "real", 64), ("top.u.note", "string", 0), ("top.u.clk_in", "wire", 1, "top.clk"), ("top.u.mode", "reg", 2, None, LABELS), ("top.wide", "logic", 65)]
CHANGES = [
    ("top.clk", 0, "0"), ("top.data", 0, "00000000"), ("top.u.temp", 0, 0.5), ("top.u.mode", 0, "00"),
    ("top.clk", 5, "1"), ("top.data", 5, "0000001x"), ("top.tick", 5, "1"), ("top.u.note", 5, "go on"),
    ("top.clk", 10, "0"), ("top.data", 10, "zzzzzzzz"), ("top.data", 10, "00000101"), ("top.u.temp", 10, 2.5), ("top.wide", 10, "1" + "0" * 63 + "1"),
    ("top.clk", 20, "1"), ("top.u.mode", 20, "01"), ("top.u.note", 20, ""), ("top.wide", 20, "h" * 65),
]


def rows(dump, *kept):
    return sorted((r.t, r.sig_id, r.bits, r.real, r.str) for r in dump.changes.collect() if r.seq > 0 or "frame" in kept)


@pytest.mark.parametrize(("pack", "index", "names", "cuts"), [("4", 8, 6, []), ("Z", 5, 4, [10]), ("4", 8, 7, [5, 20])])
def test_values_and_names(spark, tmp_path, pack, index, names, cuts):
    fst_writer.write(tmp_path / "a.fst", SIGNALS, CHANGES, cuts, pack=pack, index=index, names=names)
    dump = read_fst(spark, str(tmp_path / "a.fst"))
    ids = {"top.clk": 0, "top.data": 1, "top.tick": 2, "top.u.temp": 3, "top.u.note": 4, "top.u.mode": 5, "top.wide": 6}
    want = sorted((t, ids[p], None if p in ("top.tick", "top.u.temp", "top.u.note") else v.replace("h", "x"), v if p == "top.u.temp" else None, v if p == "top.u.note" else None) for p, t, v in CHANGES)
    assert sorted(rows(dump), key=str) == sorted(want, key=str)
    assert (dump.time.start, dump.time.end) == (0, 20)
    kinds = {r.path: (r.kind, r.width, r.sig_id) for r in dump.signals.collect()}
    assert kinds["top.u.clk_in"] == ("wire", 1, 0) and kinds["top.u.mode"] == ("enum", 2, 5) and kinds["top.tick"] == ("event", None, 2)
    assert {r.path for r in dump.scopes.collect()} == {"top", "top.u"}
    assert catalog.info(dump).rows()[0][0] | {"time_start": "0ns", "time_end": "20ns"} == catalog.info(dump).rows()[0][0]
    found = value(dump, ["7ns", "10ns", "20ns"], ["top.data", "top.u.clk_in"])
    assert [[s["value"] for s in r["signals"]] for r in found.rows()[0]] == [["8'h0x", "1'h1"], ["8'h05", "1'h0"], ["8'h05", "1'h1"]]
    assert [r["time"] for r in property_check(dump, "*", "top.u.mode == type(top.u.mode)::BUSY", mode="native").rows()[0]] == ["20ns"]


def test_same_answers_as_vcd(spark, tmp_path):
    draw = random.Random(3)
    widths = {"clk": 1, "a": 7, "b": 33}
    now = {n: "0" * w for n, w in widths.items()}
    log = [(f"top.{n}", 0, v) for n, v in now.items()]
    for t in range(1, 400):
        for n, w in widths.items():
            if draw.random() < (1 if n == "clk" else 0.3):
                now[n] = ("1" if now[n] == "0" else "0") if n == "clk" else "".join(draw.choice("01" if draw.random() < 0.95 else "xz") for _ in range(w))
                log.append((f"top.{n}", t, now[n]))
    fst_writer.write(tmp_path / "a.fst", [(f"top.{n}", "wire", w) for n, w in widths.items()], log, [100, 101, 300])
    text = "$timescale 1ns $end\n$scope module top $end\n" + "".join(f"$var wire {w} {n} {n} [{w - 1}:0] $end\n" for n, w in widths.items()) + "$upscope $end\n$enddefinitions $end\n"
    for t in range(400):
        text += f"#{t}\n" + "".join(f"b{v} {p[4:]}\n" if len(v) > 1 else f"{v}{p[4:]}\n" for p, u, v in log if u == t)
    (tmp_path / "a.vcd").write_text(text)
    both = [read_fst(spark, str(tmp_path / "a.fst")), read_vcd(spark, str(tmp_path / "a.vcd"))]
    for start, end in ((None, None), ("99ns", "101ns"), ("350ns", None)):
        one, two = (change(d, ["a", "b"], "posedge clk", start, end, "top", limit="unlimited").rows()[0] for d in both)
        assert one == two and one
    one, two = (property_check(d, "posedge clk", "a > 7'd60", None, None, "top", limit="unlimited").rows()[0] for d in both)
    assert one == two and one


def test_only_the_signals_and_blocks_asked_for_are_read(spark, tmp_path):
    fst_writer.write(tmp_path / "a.fst", SIGNALS, CHANGES, [5, 10, 20])
    dump = read_fst(spark, str(tmp_path / "a.fst"))
    assert [len(Reader({"path": str(tmp_path / "a.fst"), "start": a, "end": b}).partitions()) for a, b in (("0", "99"), ("21", "99"), ("20", "20"), ("0", "4"))] == [4, 0, 1 + 1, 1]
    refs = [dump.signal("top.clk"), dump.signal("top.u.temp")]
    assert [(r.sig_id, r.t, r.bits) for r in dump.slice(refs, 12, 20).collect()] == [(0, 20, "1")]
    assert sorted({r.sig_id for r in dump.reading([0, 3], 0, 99).collect()}) == [0, 3]
    assert not dump.slice(refs, 99, 200).collect()
    assert sorted({r.t for r in dump.marks.collect()}) == [0, 5, 10, 20]


def test_files_that_are_no_dumps(spark, tmp_path):
    path = tmp_path / "a.fst"
    fst_writer.write(path, SIGNALS, CHANGES)
    whole = path.read_bytes()
    for content in (b"", b"$date", whole[:300], whole[:-5], b"\xfe" + (len(gzip.compress(whole)) + 16).to_bytes(8, "big") + len(whole).to_bytes(8, "big") + gzip.compress(whole)):
        path.write_bytes(content)
        with pytest.raises(WaveError):
            read_fst(spark, str(path))
    with pytest.raises(WaveError):
        read_fst(spark, str(tmp_path / "none.fst"))
