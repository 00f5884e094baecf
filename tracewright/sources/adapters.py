"""Tables as dumps: an event table as a bus, a hierarchy of keys as scopes, texts as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dump import META, SIGNALS, Dump, known_signals, type_of
from ..functions.timebase import Timebase

#: Signals of the bus: path, kind, width, labels.
STATES = ("click", "error", "purchase", "signup", "view")
BUS = (
    ("top.clk", "wire", 1, None),
    ("top.rst_n", "wire", 1, None),
    ("top.valid", "wire", 1, None),
    ("top.ready", "wire", 1, None),
    ("top.data", "reg", 16, None),
    ("top.addr", "reg", 8, None),
    ("top.htrans", "reg", 2, None),
    ("top.state", "enum", 3, {s: format(k, "03b") for k, s in enumerate(STATES)}),
    ("top.tick", "event", None, None),
    ("top.temp", "real", 64, None),
)
#: For each signal, SQL for its bits and for whether an event changes it. k is the number in props.
RULES = {
    "top.clk": ("cast(event_id % 2 as string)", "true"),
    "top.rst_n": ("if(event_id >= 20, '1', '0')", "event_id in (0, 20)"),
    "top.valid": ("case when event_type in ('click', 'purchase', 'view') then '1' when event_type = 'error' then 'x' else '0' end", "true"),
    "top.ready": ("if(k % 3 <> 0, '1', '0')", "k % 2 = 0"),
    "top.data": ("case when k % 17 = 0 then repeat('x', 16) when k % 19 = 0 then repeat('z', 16) else lpad(bin(cast(round(value * 100) as bigint)), 16, '0') end", "k % 2 = 0"),
    "top.addr": ("lpad(bin(user_id % 256), 8, '0')", "k % 5 <> 0"),
    "top.htrans": ("if(k % 23 = 0, '1x', lpad(bin(k % 4), 2, '0'))", "true"),
    "top.state": ("lpad(bin(cast(array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) - 1 as bigint)), 3, '0')", "true"),
    "top.tick": ("cast(null as string)", "event_type = 'signup'"),
    "top.temp": ("cast(null as string)", "k % 7 = 0"),
}
#: The dump of an event: one dump for all, or by user.
FLEET = 8


def bus_dump(spark: SparkSession, sf_dir: str, fleet: bool = False) -> Dump:
    """The events table as value changes at t = 10 * event_id + 10, with all values 0 at t = 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bus_of(events, fleet)


def bus_of(events: DataFrame, fleet: bool = False) -> Dump:
    spark = events.sparkSession
    dump_id = f"user_id % {FLEET}" if fleet else "0L"
    rows = events.select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.expr(f"cast({dump_id} as bigint)").alias("dump_id"))
    cells = ", ".join(f"if({when}, struct({n}L as sig_id, {bits} as bits, {'value' if path == 'top.temp' else 'cast(null as double)'} as real), null)" for n, (path, (bits, when)) in enumerate(RULES.items()))
    rows = rows.select("dump_id", (F.col("event_id") * 10 + 10).alias("t"), F.expr(f"explode(array_compact(array({cells})))").alias("c"))
    live = rows.select("dump_id", "c.sig_id", "t", F.lit(0).cast("long").alias("seq"), "c.bits", "c.real", F.lit(None).cast("string").alias("str"))
    dumps = spark.range(FLEET).select(F.col("id").alias("dump_id")) if fleet else spark.range(1).select(F.col("id").alias("dump_id"))
    zero = ", ".join(f"struct({n}L as sig_id, {'cast(null as string)' if k == 'real' else repr('0' * (w or 0))} as bits, {'0D' if k == 'real' else 'cast(null as double)'} as real)" for n, (_, k, w, _) in enumerate(BUS) if k != "event")
    seed = dumps.select("dump_id", F.expr(f"explode(array({zero}))").alias("z")).select("dump_id", "z.sig_id", F.lit(0).cast("long").alias("t"), F.lit(-1).cast("long").alias("seq"), "z.bits", "z.real", F.lit(None).cast("string").alias("str"))
    end = events.agg(F.max("event_id")).first()[0]
    meta = dumps.select("dump_id", F.lit(1).cast("long").alias("tick_value"), F.lit("ns").alias("tick_unit"), F.lit(0).cast("long").alias("start_raw"), F.lit(0 if end is None else end * 10 + 10).cast("long").alias("end_raw"))
    entries = [(n, p, "top", p.rpartition(".")[2], k, w, type_of(k, w, lab).kind, type_of(k, w, lab).four, type_of(k, w, lab).signed, lab) for n, (p, k, w, lab) in enumerate(BUS)]
    scopes = spark.createDataFrame([("top", ["top"], 0, "module")], "path string, parts array<string>, depth int, kind string")
    bounds = Timebase(1, "ns", 0, 0 if end is None else end * 10 + 10)
    return Dump(live.unionByName(seed), spark.createDataFrame(entries, SIGNALS), scopes, meta, known_signals(entries), bounds, events.select((F.col("event_id") * 10 + 10).alias("t")))


def hierarchy_dump(spark: SparkSession, sf_dir: str) -> Dump:
    """Regions and nations as scopes, their customers as signals of a width that their key gives."""
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    top = region.select(F.col("r_name").alias("path"), F.array("r_name").alias("parts"), F.lit(0).alias("depth"), F.lit("module").alias("kind"))
    at = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("path"), F.array("r_name", "n_name").alias("parts"))
    low = at.select("path", "parts", F.lit(1).alias("depth"), F.lit("interface").alias("kind"))
    width = (F.col("c_custkey") % 64 + 1).cast("int")
    signals = customer.join(at, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sig_id"), F.concat_ws(".", "path", F.regexp_replace("c_name", r"\.", "_")).alias("path"), F.col("path").alias("scope_path"),
        F.regexp_replace("c_name", r"\.", "_").alias("name"), F.lower("c_mktsegment").alias("kind"), width.alias("width"), F.lit("bits").alias("type_kind"), F.lit(True).alias("four"), F.lit(False).alias("signed"), F.lit(None).cast("map<string,string>").alias("labels"),
    )
    changes = spark.createDataFrame([], "dump_id long, sig_id long, t long, seq long, bits string, real double, str string")
    return Dump(changes, signals, top.unionByName(low), spark.createDataFrame([(0, 1, "ns", 0, 0)], META))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as changes of one 2-bit signal: time is the order key, bits its status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bits = F.when(F.col("o_orderstatus") == "F", "01").when(F.col("o_orderstatus") == "O", "10").otherwise("xx")
    return orders.select(F.lit(0).cast("long").alias("dump_id"), F.col("o_custkey").alias("sig_id"), F.col("o_orderkey").alias("t"), F.lit(0).cast("long").alias("seq"), bits.alias("bits"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search topics: id from source and doc_id, the first line as title."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("description"), F.lit("").alias("headings"), F.col("text").alias("body"))
