"""Small dumps, written down as the assignments that drive them."""

from __future__ import annotations

from tracewright.dump import dump_from_lists


def timeline(spark, signals, steps, scopes=()):
    """A dump from {name: (kind, width, first value)} and [(t, {name: value})]; only real changes are logged."""
    ids = {n: k for k, n in enumerate(signals)}
    now = {n: v for n, (_, _, v) in signals.items()}
    changes, seq = [], 0
    for n, v in now.items():
        if v is not None:
            changes.append((ids[n], 0, seq, v))
            seq += 1
    for t, values in steps:
        for n, v in values.items():
            if signals[n][0] == "event" or now[n] != v:
                now[n] = v
                changes.append((ids[n], t, seq, v))
                seq += 1
    return dump_from_lists(spark, changes, [(ids[n], n, k, w) for n, (k, w, _) in signals.items()], scopes)


def rtl(spark):
    wire = ("wire", 1, "0")
    return timeline(
        spark,
        {"top.clk": wire, "top.valid": wire, "top.data": ("wire", 8, "00000000")},
        [(5, {"top.clk": "1", "top.valid": "1", "top.data": "10101010"}), (10, {"top.clk": "0"}), (15, {"top.clk": "1"}), (20, {"top.clk": "0"}), (25, {"top.clk": "1", "top.valid": "0", "top.data": "01010101"}), (30, {"top.clk": "0"}), (35, {"top.clk": "1"})],
    )


def m2(spark):
    wire = ("wire", 1, "0")
    return timeline(
        spark,
        {"top.clk": wire, "top.data": ("reg", 8, "0" * 8), "top.cfg": ("parameter", 8, "10101010"), "top.cpu.valid": wire, "top.mem.ready": wire},
        [(5, {"top.clk": "1", "top.cpu.valid": "1"}), (10, {"top.data": "00001111", "top.mem.ready": "1"})],
    )


def clocked(first, edges):
    """Steps of a clock that rises at 5, 10, ... with assignments one tick before each rise."""
    steps = []
    for k, values in enumerate(edges):
        t = 5 * (k + 1)
        steps += [(t - 1, values), (t, {first: "1"}), (t + 1, {first: "0"})]
    return steps


def ahb(spark):
    p = "top.ahb_lite_h_"
    widths = {"trans_o": (2, "00"), "ready_i": (1, "1"), "write_o": (1, "0"), "addr_o": (32, "0" * 32), "rdata_i": (32, "0" * 32), "wdata_o": (32, "0" * 32), "resp_i": (1, "0"), "resetn_i": (1, "0")}
    signals = {"top.clk": ("reg", 1, "0"), **{p + n: ("reg", w, v) for n, (w, v) in widths.items()}}
    edges = [
        {}, {"resetn_i": "1"}, {"trans_o": "10", "write_o": "0"}, {"ready_i": "0"}, {"resp_i": "1"}, {"ready_i": "1", "trans_o": "00"},
        {"resp_i": "0", "trans_o": "10", "write_o": "1"}, {"trans_o": "11", "write_o": "0"}, {"trans_o": "01", "write_o": "1"}, {"trans_o": "00", "write_o": "0"},
        {"ready_i": "x"}, {}, {"ready_i": "1", "trans_o": "10", "write_o": "x"}, {"trans_o": "00"}, {"resetn_i": "0"}, {}, {"resetn_i": "x"}, {"resetn_i": "0"}, {"resetn_i": "1"},
    ]
    return timeline(spark, signals, clocked("top.clk", [{p + n: v for n, v in e.items()} for e in edges]))


def apb(spark):
    p = "top.uart_apb_"
    widths = {"presetn_i": (1, "1"), "psel_o": (1, "0"), "penable_o": (1, "0"), "pwrite_o": (1, "0"), "pready_i": (1, "0"), "p_addr_o": (8, "0" * 8), "pwdata_o": (8, "0" * 8), "pstrb_o": (1, "0"), "prdata_i": (8, "0" * 8), "pslverr_i": (1, "0"), "misc_o": (1, "0"), "psel0_o": (1, "0")}
    signals = {f"{p}p_clk_i": ("wire", 1, "0"), **{p + n: ("wire", w, v) for n, (w, v) in widths.items()}}
    edges = [
        {"psel_o": "1", "pwrite_o": "1", "p_addr_o": "01000000", "pwdata_o": "11011110", "pstrb_o": "1"}, {"penable_o": "1"}, {}, {"pready_i": "1", "prdata_i": "1" * 8},
        {"penable_o": "0", "pwrite_o": "0", "prdata_i": "10100101", "pstrb_o": "0"}, {"penable_o": "1", "pslverr_i": "1"}, {"pwrite_o": "1"}, {"penable_o": "0", "pwrite_o": "x", "pwdata_o": "11001100"}, {"psel_o": "0"}, {"presetn_i": "0", "psel_o": "1"},
    ]
    return timeline(spark, signals, clocked(f"{p}p_clk_i", [{p + n: v for n, v in e.items()} for e in edges]))
