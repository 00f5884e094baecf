"""Sampled state: signals as step functions, carried forward over a log of changes.

The log is narrow (a row for a signal, time and sequence number); a query
widens only the signals it names. Time is cut into ranges that hold about
equal numbers of changes. State is carried forward in two passes: each range
hands its last values to the ranges after it, and rows are completed within
their range. No window ever spans a whole dump, however dense or long it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dump import Dump, Signal

#: Changes of a range, and the most ranges of a dump.
RANGE_ROWS, MOST_RANGES = 1 << 20, 2048


def time_cuts(changes: DataFrame) -> list[int]:
    """The times at which ranges begin (but the first), so that ranges hold about RANGE_ROWS rows and every core has some."""
    fewest = 4 * int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = f"array({', '.join(f'{k / MOST_RANGES!r}D' for k in range(1, MOST_RANGES))})"
    n, found = changes.agg(F.count("*"), F.expr(f"percentile_approx(t, {places}, {4 * MOST_RANGES})")).first()
    ranges = min(MOST_RANGES, max(fewest, -(-n // RANGE_ROWS)))
    return sorted({int(found[k * MOST_RANGES // ranges - 1]) for k in range(1, ranges)}) if n else []


def range_of(cuts: list[int]) -> Column:
    """The range of t, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = ", ".join(str(1 << k) for k in reversed(range(len(cuts).bit_length())))
    held = "array(" + ", ".join(f"{t}L" for t in cuts) + ")"
    return F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= {len(cuts)} and get({held}, p + s - 1) <= t, p + s, p))")


def ranged(df: DataFrame, cuts: list[int], keys: tuple[str, ...] = ("dump_id",)) -> DataFrame:
    """df with the range of its times as `bucket`, partitioned by keys and range."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("bucket", range_of(cuts)).repartition(partitions, *keys, "bucket")


def carried(df: DataFrame, values: dict[str, Column], order: list[str], before: bool = False, keys: tuple[str, ...] = ("dump_id", "bucket")) -> DataFrame:
    """df with the last non-null value of each column up to (or, if `before`, only before) every row.

    keys are the partition and, last, the range of its order, as in ranged()."""
    raw = df.withColumns({f"__{n}": c for n, c in values.items()})
    rows = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    place = F.struct(*order)
    lasts = raw.groupBy(*keys).agg(*(F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in values))
    earlier = W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    handed = lasts.select(*keys, *(F.last(f"__{n}", True).over(earlier).alias(f"__{n}_in") for n in values))
    joined = raw.join(handed, list(keys), "left")
    filled = joined.withColumns({n: F.coalesce(F.last(f"__{n}", True).over(rows), F.col(f"__{n}_in")) for n in values})
    return filled.drop(*(f"__{n}" for n in values), *(f"__{n}_in" for n in values))


def value_column(signal: Signal) -> Column:
    return F.col({"real": "real", "string": "str"}.get(signal.type.kind, "bits"))


def log_slice(dump: Dump, refs: list[Signal], start: int, end: int) -> DataFrame:
    """The changes a window needs: those inside, and of each signal the last one before it."""
    inside = dump.slice(refs, start, end)
    if start <= dump.time.start:
        return inside
    columns = ["seq", "bits", "real", "str"]
    last = dump.slice(refs, dump.time.start, start - 1).groupBy("dump_id", "sig_id").agg(F.max_by(F.struct("t", *columns), F.struct("t", "seq")).alias("last"))
    return inside.unionByName(last.select("dump_id", "sig_id", "last.*").select(*inside.columns))


@dataclass
class States:
    """Rows (dump_id, t, bucket, start_raw, ...) at the times when one of the signals changed."""

    df: DataFrame
    at: dict[str, int]
    events: set[str]

    def now(self, path: str) -> Column:
        """The value at t; of an event, whether it occurred at t."""
        k = self.at[path]
        return F.col(f"o{k}") if path in self.events else F.col(f"c{k}")

    def before(self, path: str) -> Column:
        """The value at t - 1; of an event, whether it occurred exactly then."""
        k = self.at[path]
        return F.col(f"q{k}") if path in self.events else F.col(f"p{k}")


def states(dump: Dump, refs: list[Signal], start: int, end: int) -> States:
    """The state now and just before, of all signals, at every time when one of them changed."""
    refs = list({s.path: s for s in refs}.values())
    at = {s.path: k for k, s in enumerate(refs)}
    events = {s.path for s in refs if s.type.kind == "event"}
    own = log_slice(dump, refs, start, end)
    of = {s.path: F.col("sig_id") == s.sig_id for s in refs}
    aggregates = [
        F.max(F.when(of[s.path], True)).alias(f"o{k}") if s.path in events else F.max_by(F.when(of[s.path], value_column(s)), F.when(of[s.path], F.col("seq"))).alias(f"n{k}")
        for k, s in enumerate(refs)
    ]
    ticks = ranged(own, dump.cuts).groupBy("dump_id", "bucket", "t").agg(*aggregates)
    held = [k for k, s in enumerate(refs) if s.path not in events]
    heard = [k for k, s in enumerate(refs) if s.path in events]
    df = carried(ticks, {f"p{k}": F.col(f"n{k}") for k in held} | {f"last{k}": F.when(F.col(f"o{k}"), F.col("t")) for k in heard}, ["t"], before=True)
    df = df.withColumns({f"c{k}": F.coalesce(f"n{k}", f"p{k}") for k in held}).withColumns({f"q{k}": F.coalesce(F.col(f"last{k}") == F.col("t") - 1, F.lit(False)) for k in heard}).withColumns({f"o{k}": F.coalesce(f"o{k}", F.lit(False)) for k in heard})
    df = df.join(dump.meta.select("dump_id", "start_raw"), "dump_id")
    keep = ["dump_id", "t", "bucket", "start_raw", *(f"{x}{k}" for k in held for x in "cp"), *(f"{x}{k}" for k in heard for x in "oq")]
    return States(df.select(*keep), at, events)


def state_at(dump: Dump, refs: list[Signal], t: int) -> DataFrame:
    """One row for each dump: c<k>, the value of the k-th signal at t (events: whether it occurred then)."""
    own = dump.slice(refs, dump.time.start, t)
    out = [
        F.coalesce(F.max((F.col("sig_id") == s.sig_id) & (F.col("t") == t)), F.lit(False)).alias(f"c{k}")
        if s.type.kind == "event"
        else F.max_by(F.when(F.col("sig_id") == s.sig_id, value_column(s)), F.when(F.col("sig_id") == s.sig_id, F.struct("t", "seq"))).alias(f"c{k}")
        for k, s in enumerate(refs)
    ]
    return dump.meta.select("dump_id").join(own.groupBy("dump_id").agg(*out), "dump_id", "left")


def states_at(dump: Dump, refs: list[Signal], times: list[int]) -> DataFrame:
    """One row for each dump and place in times: dump_id, pos, t and c<k>, the bits of the k-th signal then; one pass for all times."""
    ids = sorted({s.sig_id for s in refs})
    asked = dump.meta.select("dump_id", F.posexplode(F.array(*(F.lit(t).cast("long") for t in times))).alias("pos", "t"))
    probes = asked.withColumn("sig_id", F.explode(F.array(*(F.lit(i).cast("long") for i in ids))))
    found = as_of(probes, dump.slice(refs, dump.time.start, max(times)), cuts=dump.cuts)
    return found.groupBy("dump_id", "pos", "t").agg(*(F.max(F.when(F.col("sig_id") == s.sig_id, F.col("bits"))).alias(f"c{k}") for k, s in enumerate(refs)))


def as_of(probes: DataFrame, changes: DataFrame, value: str = "bits", keys: tuple[str, ...] = ("dump_id", "sig_id"), cuts: list[int] | None = None) -> DataFrame:
    """probes (keys, t, ...) with `value` as of t: the last change at or before it, null if there is none.

    Probes and changes are merged in one log and carried forward by range,
    so neither side is broadcast and a busy key is split by time."""
    extra = [c for c in probes.columns if c not in (*keys, "t")]
    left = probes.select(*keys, "t", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("__probe"), F.lit(None).cast(changes.schema[value].dataType).alias("__v"), F.struct(*extra).alias("__row") if extra else F.lit(None).alias("__row"))
    right = changes.select(*keys, "t", "seq", F.lit(0).alias("__probe"), F.col(value).alias("__v"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    both = ranged(left.unionByName(right), time_cuts(changes) if cuts is None else cuts, keys)
    out = carried(both, {value: F.col("__v")}, ["t", "__probe", "seq"], keys=(*keys, "bucket")).filter("__probe = 1")
    return out.select(*keys, "t", *([f"__row.{c}" for c in extra]), value)
