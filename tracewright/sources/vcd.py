"""VCD text as a dump. The body is read as records that begin at time marks, so
Spark splits a file of any size and parses it without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dump import META, SCOPE_KINDS, SCOPES, SIGNAL_KINDS, SIGNALS, Dump, known_signals, type_of
from ..errors import WaveError
from ..functions.timebase import Timebase

#: Spellings of kinds that differ from the stable ones.
KINDS = {
    "shortint": "short_int",
    "longint": "long_int",
    "shortreal": "short_real",
    "realtime": "real_time",
    "realparameter": "real_parameter",
    "sparray": "sparse_array",
    "event_parameter": "parameter",
    "std_logic": "logic",
    "std_ulogic": "logic",
    "std_logic_vector": "bit_vector",
    "std_ulogic_vector": "bit_vector",
}
UNITS = ("s", "ms", "us", "ns", "ps", "fs")


def parse_header(text: str) -> tuple[int, str, list[tuple], list[tuple], dict[str, int]]:
    """(tick, unit, scopes, signals, id code -> sig_id) of the declarations; aliases share a sig_id."""
    words = iter(text.split())
    tick, unit, path = 1, "s", []
    scopes: dict[str, str] = {}
    signals: list[tuple] = []
    codes: dict[str, int] = {}

    def until_end() -> list[str]:
        out = []
        for w in words:
            if w == "$end":
                break
            out.append(w)
        return out

    for w in words:
        if w == "$timescale":
            m = re.fullmatch("([0-9]+)([a-z]+)", "".join(until_end()))
            if m is None or m[2] not in UNITS:
                raise WaveError("file", "invalid $timescale")
            tick, unit = int(m[1]), m[2]
        elif w == "$scope":
            kind, name = until_end()[:2]
            path.append(name)
            scopes.setdefault(".".join(path), kind if kind in SCOPE_KINDS else "unknown")
        elif w == "$upscope":
            until_end()
            path.pop()
        elif w == "$var":
            kind, width, code, *name = until_end()
            kind = KINDS.get(kind.lower(), kind.lower())
            kind = kind if kind in SIGNAL_KINDS else "unknown"
            full = name[0] if len(name) == 1 or re.fullmatch(r"\[-?[0-9]+:-?[0-9]+\]", name[1]) else "".join(name)
            sig = codes.setdefault(code, len(codes))
            bits = None if kind in ("event", "string") else int(width)
            t = type_of(kind, bits)
            signals.append((sig, ".".join([*path, full]), ".".join(path), full, kind, bits, t.kind, t.four, t.signed, None))
        elif w == "$enddefinitions":
            break
        elif w.startswith("$") and w != "$end":
            until_end()
    nodes = [(p, p.split("."), p.count("."), k) for p, k in scopes.items()]
    return tick, unit, nodes, signals, codes


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n#").withColumn("place", F.monotonically_increasing_id())


def read_vcd(spark: SparkSession, path: str) -> Dump:
    """The dump of a VCD file. A missing or malformed file is a file error; the last of several values at one time holds."""
    low = path.lower()
    try:
        raw = records(spark, path)
        first = raw.filter(F.col("value").contains("$enddefinitions")).limit(1).collect()
    except Exception as e:
        raise WaveError("file", f"cannot open '{path}': {str(e).splitlines()[0]}") from e
    if not first:
        if low.endswith((".fsdb", ".fsdb.gz")):
            raise WaveError("file", f"'{path}': FSDB input needs a reader that this build does not have")
        raise WaveError("file", f"'{path}' is not a VCD dump")
    text = first[0]["value"]
    head, _, early = text.partition("$enddefinitions")
    tick, unit, nodes, signals, codes = parse_header(head + " $enddefinitions")
    early = re.sub(r"^\s*\$end", "", early).strip()
    body = raw.filter(~F.col("value").contains("$enddefinitions"))
    timed = body.select(F.regexp_extract(F.substring("value", 1, 32), r"^\s*#?([0-9]+)", 1).cast("decimal(20,0)").alias("big"), "place", "value")
    bounds = timed.agg(F.min("big"), F.max("big"), F.count("*"), F.count_distinct("big")).first()
    if bounds[1] is not None and bounds[1] >= 1 << 63:
        raise WaveError("file", "times beyond 2^63 - 1 are not supported")
    start, end = (int(bounds[0]), int(bounds[1])) if bounds[2] else (0, 0)
    timed = timed.select(F.col("big").cast("long").alias("t"), "place", "value")
    if bounds[2] and bounds[2] != bounds[3]:  # a time that is marked again: later records win
        from pyspark.sql import Window as W

        timed = timed.withColumn("again", F.row_number().over(W.partitionBy("t").orderBy("place")))
    else:
        timed = timed.withColumn("again", F.lit(1))
    lines = timed.select("t", "again", F.posexplode(F.split(_spaced("value"), "\n")).alias("pos", "line"))
    if early:
        begun = spark.createDataFrame([(start, 0, k + 1, x.replace("\t", " ")) for k, x in enumerate(early.splitlines())], "t long, again int, pos int, line string")
        lines = lines.unionByName(begun)
    lines = lines.select("t", (F.col("again").cast("long") * (1 << 32) + F.col("pos")).alias("seq"), F.trim("line").alias("line")).filter("pos > 0 and line <> '' and not line like '$%'")
    changes = _values(spark, lines, codes, signals)
    marks = timed.select("t", F.explode(F.sequence(F.lit(0), (F.length("value") / 64).cast("int"))).alias("part")).select("t")  # a mark for every few values
    return Dump(
        changes,
        spark.createDataFrame(signals, SIGNALS),
        spark.createDataFrame(nodes, SCOPES),
        spark.createDataFrame([(0, tick, unit, start, end)], META),
        known_signals(signals),
        Timebase(tick, unit, start, end),
        marks=marks,
    )


def _values(spark: SparkSession, lines: DataFrame, codes: dict[str, int], signals: list[tuple]) -> DataFrame:
    """Value lines as changes: `0!`, `b01 !`, `r1.5 !`, `stext !`; short vectors extend by 0, x or z."""
    table = {}
    for sig, _, _, _, k, width, tk, *_ in signals:
        table.setdefault(sig, (k, width or 1, tk))
    ids = spark.createDataFrame([(c, s, table[s][1], table[s][2]) for c, s in codes.items()], "code string, sig_id long, width int, type_kind string")
    # each step reads the columns of the one before, so that no value is worked out twice
    long_form = F.substring("line", 1, 1).isin(*"bBrRsS")
    parts = lines.select(
        "t", "seq",
        F.when(long_form, F.expr("substring(substring_index(line, ' ', 1), 2)")).otherwise(F.substring("line", 1, 1)).alias("value"),
        F.when(~long_form, F.expr("ltrim(substring(line, 2))")).when(F.contains("line", F.lit(" ")), F.substring_index("line", " ", -1)).otherwise("").alias("code"),
    )
    plain = F.lower("value")
    for state in "huwl-":
        plain = F.replace(plain, F.lit(state), F.lit("x"))
    rows = parts.join(ids, "code").select("t", "seq", "sig_id", "width", "type_kind", "value", plain.alias("plain"))
    first = F.substring("plain", 1, 1)
    missing = F.col("width") - F.length("plain")
    full = F.when(missing == 0, F.col("plain")).when(missing < 0, F.expr("right(plain, width)")).otherwise(F.concat(F.repeat(F.when(first.isin("x", "z"), first).otherwise("0"), missing), F.col("plain")))
    return rows.select(
        F.lit(0).cast("long").alias("dump_id"), "sig_id", "t", "seq",
        F.when(~F.col("type_kind").isin("real", "string", "event"), full).alias("bits"),
        F.when(F.col("type_kind") == "real", F.col("value").try_cast("double")).alias("real"),
        F.when(F.col("type_kind") == "string", F.col("value")).alias("str"),
    )


def _spaced(text: str) -> Column:
    """Text whose lines end in a newline alone and whose tabs are spaces."""
    return F.replace(F.replace(F.col(text), F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(" "))


def stage(dump: Dump, path: str, buckets: int = 16) -> None:
    """Writes a dump as Parquet, its changes by signal and time, so that later queries read only what they name."""
    by = dump.changes.repartitionByRange(buckets, "sig_id", "t").sortWithinPartitions("sig_id", "t", "seq")
    by.write.mode("overwrite").parquet(f"{path}/changes")
    for name in ("signals", "scopes", "meta"):
        getattr(dump, name).write.mode("overwrite").parquet(f"{path}/{name}")


def staged(spark: SparkSession, path: str) -> Dump:
    return Dump(*(spark.read.parquet(f"{path}/{n}") for n in ("changes", "signals", "scopes", "meta")))
