"""Writes small FST files, block by block, for tests of the reader."""

from __future__ import annotations

import gzip
import struct
import zlib

import pyarrow as pa

VARS = {"event": 0, "parameter": 2, "real": 3, "reg": 5, "wire": 16, "string": 21, "logic": 23}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def signed(n: int) -> bytes:
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n & 127])


def long(n: int) -> bytes:
    return n.to_bytes(8, "big")


def lz4(b: bytes) -> bytes:
    return pa.compress(b, codec="lz4_raw", asbytes=True)


def block(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + long(len(body) + 8) + body


def smaller(b: bytes) -> bytes:
    packed = zlib.compress(b)
    return packed if len(packed) < len(b) else b


def raw(kind: str, width: int, value) -> bytes:
    if kind == "real":
        return struct.pack("<d", value)
    return b"" if kind == "string" else str(value).encode().rjust(width, b"0")


def chain(kind: str, width: int, changes: list[tuple[int, object]]) -> bytes:
    out, last = b"", 0
    for place, value in changes:
        step, last = place - last, place
        if kind == "real":
            out += varint(step << 1 | 1) + struct.pack("<d", value)
        elif kind == "string":
            text = str(value).encode()
            out += varint(step << 1) + varint(len(text)) + text
        elif width == 1:
            out += varint(step << 2 | int(value) << 1) if value in "01" else varint(step << 4 | "xzhuwl-?".index(value) << 1 | 1)
        elif set(value) <= set("01"):
            out += varint(step << 1) + int(value.ljust((width + 7) // 8 * 8, "0"), 2).to_bytes((width + 7) // 8, "big")
        else:
            out += varint(step << 1 | 1) + value.encode()
    return out


def write(path, signals: list[tuple], changes: list[tuple], cuts: list[int] = (), first: dict | None = None, pack: str = "4", index: int = 8, names: int = 6, scale: int = -9, end: int | None = None) -> None:
    """A file of (path, kind, width[, alias of][, labels]) signals and (path, t, value) changes, in blocks that end before cuts."""
    handles: dict[str, int] = {}
    tree, at, count = b"", [], 0
    for n, (full, kind, width, *more) in enumerate(signals):
        *scope, name = full.split(".")
        while at != scope[: len(at)]:
            at.pop()
            tree += bytes([255])
        for s in scope[len(at) :]:
            at.append(s)
            tree += bytes([254, 0]) + s.encode() + b"\0\0"
        alias, labels = (more + [None, None])[:2]
        if labels:
            tree += bytes([252, 0, 7]) + f"e {len(labels)} {' '.join(labels)} {' '.join(labels.values())}".encode() + b"\0" + varint(n + 1) + bytes([253])
            tree += bytes([252, 0, 7]) + b"\0" + varint(n + 1)
        handles[full] = handles[alias] if alias else len(set(handles.values()))
        count += 1
        shown = f"{name} [{width - 1}:0]" if width > 1 and kind not in ("real", "string") else name
        tree += bytes([VARS[kind], 0]) + shown.encode() + b"\0" + varint(width) + varint(handles[full] + 1 if alias else 0)
    own = {handles[s[0]]: s for s in reversed(signals)}
    times = sorted({t for _, t, _ in changes})
    start, last = times[0], times[-1] if end is None else end
    order = "".join(["version", "\0" * 121, "date", "\0" * 115])
    head = long(start) + long(last) + struct.pack("<d", 2.7182818284590452354) + long(0) + long(1) + long(count) + long(len(own)) + long(len(cuts) + 1) + struct.pack("b", scale) + order.encode() + b"\0" + long(0)
    out = block(0, head)
    edges = [start, *cuts, last + 1]
    now = {h: "x" * s[2] if s[1] not in ("real", "string") else 0.0 for h, s in own.items()} | {handles[p]: v for p, v in (first or {}).items()}
    for a, b in zip(edges, edges[1:], strict=False):
        here = [t for t in times if a <= t < b]
        frame = b"".join(raw(s[1], s[2], now[h]) for h, s in sorted(own.items()))
        packed = smaller(frame)
        body = long(a) + long(min(b, last)) + long(0) + varint(len(frame)) + varint(len(packed)) + varint(len(own)) + packed
        chains, table, gap, previous, seen, skipped = pack.encode(), b"", 0, 0, {}, 0
        for h, s in sorted(own.items()):
            mine = [(here.index(t), v) for p, t, v in changes if handles[p] == h and a <= t < b]
            if not mine:
                skipped += 1
                continue
            now[h] = mine[-1][1]
            if skipped:
                table, skipped = table + varint(skipped << 1), 0
            data = chain(s[1], s[2], mine)
            if data in seen:
                if index == 8:
                    same = seen[data] == previous
                    table += signed(1 if same else (-(seen[data] + 1)) << 1 | 1)
                    previous = seen[data]
                else:
                    table += varint(0) + varint(seen[data] + 1)
                continue
            seen[data] = h
            step = len(chains) - gap
            gap = len(chains)
            table += signed(step << 1 | 1) if index == 8 else varint(step << 1 | 1)
            held = lz4(data) if pack == "4" else zlib.compress(data)
            chains += varint(len(data)) + held if len(data) > 24 else varint(0) + data
        if skipped:
            table += varint(skipped << 1)
        steps = b"".join(varint(t - u) for t, u in zip(here, [0, *here], strict=False))
        packed = smaller(steps)
        body += varint(len(own)) + chains + table + long(len(table)) + packed + long(len(steps)) + long(len(packed)) + long(len(here))
        out += block(index, body)
    widths = b"".join(varint({"real": 0, "string": 0xFFFFFFFF}.get(s[1], s[2])) for _, s in sorted(own.items()))
    packed = smaller(widths)
    out += block(3, long(len(widths)) + long(len(own)) + packed)
    once = lz4(tree)
    out += block(names, long(len(tree)) + {4: gzip.compress(tree), 6: once, 7: long(len(once)) + lz4(once)}[names])
    path.write_bytes(out)
