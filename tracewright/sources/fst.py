"""FST files as a dump. The file is a chain of blocks; each block of value
changes is a task of its own, which seeks to it. A query names its signals and times to the
reader: other signals' chains are not unpacked and blocks outside the times are
not opened. Paths are local (readable on every executor) or URIs
that Arrow's file systems know."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..dump import CHANGES, META, SCOPE_KINDS, SCOPES, SIGNAL_KINDS, SIGNALS, Dump, known_signals, type_of
from ..errors import WaveError
from ..functions.timebase import Timebase
from .vcd import KINDS, UNITS

#: Fixed values of the format: types of blocks, of hierarchy entries and of attributes.
HEADER, CHANGES_PLAIN, GEOMETRY, NAMES_GZIP, CHANGES_ALIAS, NAMES_LZ4, NAMES_LZ4_TWICE, CHANGES_ALIAS2, WRAPPED = 0, 1, 3, 4, 5, 6, 7, 8, 254
ATTRIBUTE, END_ATTRIBUTE, SCOPE, UPSCOPE = 252, 253, 254, 255
MISC, TYPE_NAME, ENUM_TABLE = 0, 2, 7
#: Scope kinds, variable kinds and supplementary data types by number.
SCOPE_TYPES = "module task function begin fork generate struct union class interface package program".split()
VAR_TYPES = (
    "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor port sparse_array real_time string bit logic int short_int long_int byte enum short_real"
).split()
DATA_TYPES = {1: "boolean", 2: "bit", 3: "bit_vector", 4: "std_ulogic", 5: "std_ulogic_vector", 6: "std_logic", 7: "std_logic_vector", 10: "integer", 11: "real", 14: "time", 16: "string"}
#: States of a bit that is neither 0 nor 1, in the format's order (h, u, w, l and - read as x).
STATES = pa.array(["0", "1", "x", "z", "x", "x", "x", "x", "x", "x"])

#: Rows of a record batch, roughly.
BATCH = 1 << 16


def opened(path: str) -> pa.NativeFile:
    if re.match("[a-z0-9]+:/", path):
        found, path = fs.FileSystem.from_uri(path)
    else:
        found = fs.LocalFileSystem()
    return found.open_input_file(path)


def _long(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 8], "big")


def varint(b: bytes, at: int) -> tuple[int, int]:
    """The number that begins at a place, and the place after it."""
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def varints(b: bytes) -> np.ndarray:
    """All numbers of a run of varints."""
    data = np.frombuffer(b, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(sizes.max()) if len(ends) else 0):
        has = sizes > k
        out[has] |= (data[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def _lz4(b: bytes, size: int) -> bytes:
    return pa.decompress(b, decompressed_size=size, codec="lz4_raw", asbytes=True) if size else b""


def _zlib(b: bytes, size: int) -> bytes:
    """Data that is packed only where that made it smaller."""
    return b if len(b) == size else zlib.decompress(b)


def blocks(f: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(type, place, length) of each whole block's body; a block that was cut off at the end is left out."""
    size, at = f.size(), 0
    while at + 9 <= size:
        f.seek(at)
        head = f.read(9)
        n = _long(head, 1)
        if n < 8 or at + 1 + n > size:
            return
        yield head[0], at + 9, n - 8
        at += 1 + n


def _body(f: pa.NativeFile, place: int, length: int) -> bytes:
    f.seek(place)
    return f.read(length)


def lengths(body: bytes) -> np.ndarray:
    """Width of each handle: 0 for strings, -1 for reals."""
    out = varints(_zlib(body[16:], _long(body, 0))).astype(np.int64)
    return np.where(out == 0, -1, np.where(out == 0xFFFFFFFF, 0, out))


def names(kind: int, body: bytes) -> bytes:
    size = _long(body, 0)
    if kind == NAMES_GZIP:
        return gzip.decompress(body[8:])
    if kind == NAMES_LZ4:
        return _lz4(body[8:], size)
    return _lz4(_lz4(body[16:], _long(body, 8)), size)


def hierarchy(b: bytes) -> tuple[list[tuple], list[tuple]]:
    """(scopes, signals) of the declarations; aliases share a sig_id, which is the handle less one."""
    at, path, handles = 0, [], 0
    scopes: dict[str, str] = {}
    signals: list[tuple] = []
    tables: dict[int, dict[str, str]] = {}
    data_type, table = 0, None

    def text(at: int) -> tuple[str, int]:
        end = b.index(0, at)
        return b[at:end].decode("utf-8", "replace"), end + 1

    while at < len(b):
        entry = b[at]
        at += 1
        if entry == SCOPE:
            kind = b[at]
            name, at = text(at + 1)
            _, at = text(at)
            path.append(name)
            known = SCOPE_TYPES[kind] if kind < len(SCOPE_TYPES) else "unknown"
            scopes.setdefault(".".join(path), known if known in SCOPE_KINDS else "unknown")
        elif entry == UPSCOPE:
            path.pop()
        elif entry == ATTRIBUTE:
            family, sub = b[at], b[at + 1]
            name, at = text(at + 2)
            arg, at = varint(b, at)
            if family == MISC and sub == TYPE_NAME:
                data_type = arg & 1023
            elif family == MISC and sub == ENUM_TABLE:
                if name:
                    words = name.split(" ")
                    n = int(words[1])
                    tables[arg] = dict(zip(words[2 : 2 + n], words[2 + n :], strict=False))
                else:
                    table = tables.get(arg)
        elif entry == END_ATTRIBUTE:
            pass
        elif entry < len(VAR_TYPES):
            name, at = text(at + 1)
            width, at = varint(b, at)
            alias, at = varint(b, at)
            if not alias:
                handles += 1
            sig = (alias or handles) - 1
            kind = DATA_TYPES.get(data_type, VAR_TYPES[entry])
            kind = "enum" if table else KINDS.get(kind, kind)
            kind = kind if kind in SIGNAL_KINDS else "unknown"
            first, *rest = name.split()
            full = first if not rest or re.fullmatch(r"\[-?[0-9]+:-?[0-9]+\]", rest[0]) else "".join((first, *rest))
            bits = None if kind in ("event", "string") else width
            t = type_of(kind, bits, table)
            signals.append((sig, ".".join([*path, full]), ".".join(path), full, kind, bits, t.kind, t.four, t.signed, table))
            data_type, table = 0, None
        else:
            raise WaveError("file", f"unknown hierarchy entry {entry}")
    return [(p, p.split("."), p.count("."), k) for p, k in scopes.items()], signals


@dataclass
class Block(InputPartition):
    kind: int
    place: int
    length: int
    number: int


def _chains(kind: int, index: bytes, end: int) -> dict[int, tuple[int, int]]:
    """(place, length) of each handle's chain, from the index; aliases point at an earlier handle's."""
    found: dict[int, tuple[int, int]] = {}
    alias: dict[int, int] = {}
    at = handle = place = 0
    begun, previous = -1, 0

    def begin(step: int) -> None:
        nonlocal place, begun
        place += step
        if begun >= 0:
            found[begun] = (found[begun][0], place - found[begun][0])
        found[handle] = (place, 0)
        begun = handle

    while at < len(index):
        if kind == CHANGES_ALIAS2 and index[at] & 1:
            raw, after = varint(index, at)
            bits = 7 * (after - at)
            signed = (raw - (1 << bits) if raw >> (bits - 1) & 1 else raw) >> 1
            at = after
            if signed > 0:
                begin(signed)
            else:
                previous = -signed - 1 if signed < 0 else previous
                alias[handle] = previous
            handle += 1
            continue
        raw, at = varint(index, at)
        if kind == CHANGES_ALIAS2 or raw and not raw & 1:
            handle += raw >> 1
        elif raw:
            begin(raw >> 1)
            handle += 1
        else:
            other, at = varint(index, at)
            alias[handle] = other - 1
            handle += 1
    if begun >= 0:
        found[begun] = (found[begun][0], end - found[begun][0])
    for handle, other in alias.items():
        if other in found:
            found[handle] = found[other]
    return found


def _times(f: pa.NativeFile, block: Block) -> np.ndarray:
    """The times of a block, from its end alone."""
    size, packed, count = struct.unpack(">QQQ", _body(f, block.place + block.length - 24, 24))
    data = _body(f, block.place + block.length - 24 - packed, packed)
    return np.cumsum(varints(_zlib(data, size))[:count]).astype(np.int64)


class Section:
    """One block of value changes."""

    def __init__(self, f: pa.NativeFile, block: Block):
        self.block = block
        b = self.b = _body(f, block.place, block.length)
        self.begin, self.end = _long(b, 0), _long(b, 8)
        self.times = _times(f, block)
        cut = len(b) - 24 - _long(b, len(b) - 16)
        index = cut - 8 - _long(b, cut - 8)
        at = 24
        full, at = varint(b, at)
        held, at = varint(b, at)
        self.handles, at = varint(b, at)
        self._frame = (full, at, held)
        _, at = varint(b, at + held)
        self.base, self.pack = at, b[at : at + 1]
        self.chains = _chains(block.kind, b[index : cut - 8], index - at)

    def frame(self) -> bytes:
        full, at, held = self._frame
        return _zlib(self.b[at : at + held], full)

    def chain(self, handle: int) -> bytes:
        place, length = self.chains[handle]
        size, at = varint(self.b, self.base + place)
        data = self.b[at : self.base + place + length]
        if not size:
            return data
        if self.pack == b"4":
            return _lz4(data, size)
        if self.pack in (b"Z", b"!"):
            return zlib.decompress(data)
        raise WaveError("file", f"chains packed by '{self.pack.decode('latin-1')}' are not supported")

    def values(self, handle: int, width: int) -> tuple[np.ndarray, pa.Array]:
        """(places of times, values as text) of a handle's changes; reals as doubles."""
        data = self.chain(handle)
        if width == 1:
            v = varints(data).astype(np.int64)
            other = (v & 1) == 1
            step = np.where(other, v >> 4, v >> 2)
            codes = np.where(other, 2 + ((v >> 1) & 7), (v >> 1) & 1)
            return np.cumsum(step), pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), STATES).cast(pa.string())
        at, place, places, out = 0, 0, [], []
        size = (width + 7) // 8
        while at < len(data):
            v, at = varint(data, at)
            place += v >> 1
            places.append(place)
            if width == 0:
                n, at = varint(data, at)
                out.append(data[at : at + n].decode("utf-8", "replace"))
                at += n
            elif width < 0:
                if v & 1:
                    out.append(data[at : at + 8])
                    at += 8
                else:  # a double whose bytes are all 0 or 1, as digits
                    out.append(bytes(48 + (data[at] >> k & 1) for k in range(7, -1, -1)))
                    at += 1
            elif v & 1:
                out.append(_states(data[at : at + width]))
                at += width
            else:
                out.append(f"{int.from_bytes(data[at : at + size], 'big') >> (8 * size - width):0{width}b}")
                at += size
        return np.array(places, np.int64), pa.array(out, pa.binary() if width < 0 else pa.string())


def _states(b: bytes) -> str:
    return b.decode("latin-1").lower().translate(str.maketrans("huwl-?", "xxxxxx"))


class Reader(DataSourceReader):
    """Reads the changes of the `signals` given (all where there are none) at times `start` to `end`, by whole blocks.

    With `marks` it gives the times alone, a time for every few bytes of a block."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wanted = {int(x) for x in options["signals"].split(",") if x} if "signals" in options else None
        self.low, self.high = int(options.get("start", 0)), int(options.get("end", (1 << 63) - 1))
        self.marks = "marks" in options

    def partitions(self) -> list[Block]:
        out = []
        with opened(self.path) as f:
            sections = [b for b in blocks(f) if b[0] in (CHANGES_PLAIN, CHANGES_ALIAS, CHANGES_ALIAS2)]
            for k, (kind, place, length) in enumerate(sections):
                head = _body(f, place, 16)
                if _long(head, 0) <= self.high and _long(head, 8) >= self.low:
                    out.append(Block(kind, place, length, k))
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one part where there are none
            return
        with opened(self.path) as f:
            if self.marks:
                times = _times(f, partition)
                times = np.repeat(times, max(1, partition.length // max(1, 8 * len(times))))
                for k in range(0, len(times), BATCH):
                    yield _batch([(-1, times[k : k + BATCH], np.zeros(len(times[k : k + BATCH]), np.int64), 0, pa.nulls(len(times[k : k + BATCH]), pa.string()))], "<d")
                return
            found = {b[0]: b for b in blocks(f) if b[0] in (HEADER, GEOMETRY)}
            widths = lengths(_body(f, *found[GEOMETRY][1:]))
            order = "<d" if _body(f, *found[HEADER][1:])[16:24] == struct.pack("<d", 2.7182818284590452354) else ">d"
            section = Section(f, partition)
        rows: list[tuple] = []
        n = 0
        for part in self._parts(section, widths):
            rows.append(part)
            n += len(part[1])
            if n >= BATCH:
                yield _batch(rows, order)
                rows, n = [], 0
        if rows:
            yield _batch(rows, order)

    def _parts(self, s: Section, widths: np.ndarray) -> Iterator[tuple]:
        """(handle, times, sequence numbers, width, values) of one handle at a time."""
        base = (s.block.number + 1) << 40
        if s.block.number == 0:  # values at the start of the dump
            frame, at = s.frame(), 0
            for handle, width in enumerate(widths[: s.handles].tolist()):
                size = 8 if width < 0 else width
                if width and (self.wanted is None or handle in self.wanted):
                    value = frame[at : at + size]
                    yield handle, np.array([s.begin]), np.zeros(1, np.int64), width, pa.array([value] if width < 0 else [_states(value)], pa.binary() if width < 0 else pa.string())
                at += size
        for handle in sorted(s.chains):
            if self.wanted is None or handle in self.wanted:
                width = int(widths[handle])
                places, values = s.values(handle, width)
                yield handle, s.times[places], base + np.arange(len(places)), width, values


def _batch(rows: list[tuple], order: str) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6)]
    for handle, t, seq, width, values in rows:
        none = pa.nulls(len(t), pa.string())
        real = pa.array([struct.unpack(order, v)[0] for v in values.to_pylist()], pa.float64()) if width < 0 else pa.nulls(len(t), pa.float64())
        for column, x in zip(columns, (pa.array(np.full(len(t), handle, np.int64)), pa.array(t, pa.int64()), pa.array(seq, pa.int64()), values if width > 0 else none, real, values if width == 0 else none), strict=True):
            column.append(x)
    sig, t, seq, bits, real, text = (pa.concat_arrays(c) for c in columns)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sig), np.int64)), sig, t, seq, bits, real, text], names=["dump_id", "sig_id", "t", "seq", "bits", "real", "str"])


class FstSource(DataSource):
    """Value changes of one FST file, as rows of the staging model."""

    @classmethod
    def name(cls) -> str:
        return "tracewright_fst"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_fst(spark: SparkSession, path: str) -> Dump:
    """The dump of an FST file. A missing, malformed or wholly gzip-wrapped file is a file error; of several values of a signal at one time the last holds."""
    try:
        with opened(path) as f:
            found: dict[int, tuple] = {}
            for b in blocks(f):
                found.setdefault(b[0], b)
            if WRAPPED in found:
                raise WaveError("file", f"'{path}': unpack this gzip-wrapped FST file first")
            name = next((found[k] for k in (NAMES_GZIP, NAMES_LZ4, NAMES_LZ4_TWICE) if k in found), None)
            if HEADER not in found or GEOMETRY not in found or name is None:
                raise WaveError("file", f"'{path}' is not a whole FST dump")
            head = _body(f, *found[HEADER][1:])
            nodes, signals = hierarchy(names(name[0], _body(f, *name[1:])))
    except (OSError, ValueError, IndexError, zlib.error, pa.ArrowException) as e:
        raise WaveError("file", f"cannot open '{path}': {str(e).splitlines()[0]}") from e
    start, end = _long(head, 0), _long(head, 8)
    if end >= 1 << 63:
        raise WaveError("file", "times beyond 2^63 - 1 are not supported")
    tens, rest = divmod(struct.unpack("b", head[64:65])[0], 3)
    if not -5 <= tens <= 0:
        raise WaveError("file", "invalid time scale")
    tick, unit = 10**rest, UNITS[-tens]
    spark.dataSource.register(FstSource)
    events = sorted({s[0] for s in signals if s[6] == "event"})

    def reading(**options: object) -> DataFrame:
        rows = spark.read.format("tracewright_fst").options(path=path, **{k: str(v) for k, v in options.items()}).load()
        return rows.withColumn("bits", F.when(~F.col("sig_id").isin(events), F.col("bits"))) if events else rows

    changes = reading()
    return Dump(
        changes,
        spark.createDataFrame(signals, SIGNALS),
        spark.createDataFrame(nodes, SCOPES),
        spark.createDataFrame([(0, tick, unit, start, end)], META),
        known_signals(signals),
        Timebase(tick, unit, start, end),
        marks=reading(marks=1).select("t"),
        reading=lambda ids, low, high: reading(signals=",".join(map(str, ids)), start=low, end=high),
    )
