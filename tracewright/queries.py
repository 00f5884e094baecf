"""Registered queries over the driver's tables, each with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dump import Dump
from .functions.bits import literal_text
from .operators import catalog, sampling, search, waves
from .operators.sampling import as_of, state_at, states
from .operators.triggers import edge, matched
from .operators.waves import Bindings, Source, change_rows, extract_rows, payload_paths, property_rows
from .plans.binding import bound
from .plans.columns import compiled
from .protocols import ahb, buses
from .sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The bus of the events table in DuckDB: value changes by signal, and the state now (c_) and before (p_) at each time.
_EVENTS = "e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k, event_id * 10 + 10 AS t, 0 AS d FROM events)"
_CELLS = {
    "clk": ("(event_id % 2)::VARCHAR", "true", "'0'"),
    "rst_n": ("CASE WHEN event_id >= 20 THEN '1' ELSE '0' END", "event_id IN (0, 20)", "'0'"),
    "valid": ("CASE WHEN event_type IN ('click', 'purchase', 'view') THEN '1' WHEN event_type = 'error' THEN 'x' ELSE '0' END", "true", "'0'"),
    "ready": ("CASE WHEN k % 3 <> 0 THEN '1' ELSE '0' END", "k % 2 = 0", "'0'"),
    "data": ("CASE WHEN k % 17 = 0 THEN repeat('x', 16) WHEN k % 19 = 0 THEN repeat('z', 16) ELSE lpad(bin(round(value * 100)::BIGINT), 16, '0') END", "k % 2 = 0", "repeat('0', 16)"),
    "addr": ("lpad(bin(user_id % 256), 8, '0')", "k % 5 <> 0", "repeat('0', 8)"),
    "htrans": ("CASE WHEN k % 23 = 0 THEN '1x' ELSE lpad(bin(k % 4), 2, '0') END", "true", "'00'"),
    "state": ("CASE event_type WHEN 'click' THEN '000' WHEN 'error' THEN '001' WHEN 'purchase' THEN '010' WHEN 'signup' THEN '011' ELSE '100' END", "true", "'000'"),
    "temp": ("value", "k % 7 = 0", "0.0"),
}


def _ctes(fleet: bool = False, names: tuple[str, ...] = tuple(_CELLS)) -> str:
    """CTEs e, raw and st; st has a row for each time, with t0 = the first time."""
    events = _EVENTS.replace("0 AS d", f"user_id % {adapters.FLEET} AS d") if fleet else _EVENTS
    cells = ", ".join(f"CASE WHEN {when} THEN {bits} END AS n_{n}" for n, (bits, when, _) in _CELLS.items() if n in names)
    zeros = ", ".join(f"{zero} AS n_{n}" for n, (_, _, zero) in _CELLS.items() if n in names)
    dumps = f"range({adapters.FLEET if fleet else 1})"
    now = ", ".join(f"last_value(n_{n} IGNORE NULLS) OVER (PARTITION BY d ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_{n}" for n in names)
    before = ", ".join(f"last_value(n_{n} IGNORE NULLS) OVER (PARTITION BY d ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_{n}" for n in names)
    return f"""{events},
raw AS (SELECT d, t, event_type = 'signup' AS tick, {cells} FROM e UNION ALL SELECT range AS d, 0 AS t, false AS tick, {zeros} FROM {dumps}),
st AS (SELECT d, t, tick, {now}, {before} FROM raw)"""


POSEDGE = "coalesce((p_clk = '0' AND c_clk <> '0') OR (p_clk IN ('x', 'z') AND c_clk = '1'), false)"
NEGEDGE = "coalesce((p_clk = '1' AND c_clk <> '1') OR (p_clk IN ('x', 'z') AND c_clk = '0'), false)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bus(spark: SparkSession, sf_dir: str, fleet: bool = False) -> Dump:
    return adapters.bus_dump(spark, sf_dir, fleet)


def _fired(dump: Dump, on: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Times at which an event fires."""
    terms = Bindings(dump, "top").event(on)
    from .plans import events as ev

    tracked = ["top.data", "top.addr"] if any(t.kind == "any" for t in terms) else []
    st = states(dump, [dump.signal(p) for p in sorted(ev.names(terms) | set(tracked))], start or dump.time.start, end or dump.time.end)
    return st.df.filter(matched(terms, st, tracked)).select("dump_id", "t")


# --- sources, catalog ---------------------------------------------------------------------------


@query(f"WITH {_ctes()} SELECT DISTINCT t FROM raw WHERE (n_data IS NOT NULL OR n_addr IS NOT NULL) AND t BETWEEN (SELECT max(t) // 4 FROM raw) AND (SELECT 3 * max(t) // 4 FROM raw)")
def s7_candidate_times(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    ids = [dump.signal(p).sig_id for p in ("top.data", "top.addr")]
    return dump.changes.filter(F.col("sig_id").isin(ids) & F.col("t").between(dump.time.end // 4, 3 * dump.time.end // 4)).select("t").distinct()


@query(f"WITH {_ctes()} SELECT DISTINCT t FROM raw WHERE n_addr IS NOT NULL OR tick")
def s9_candidate_times_with_events(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    return dump.changes.filter(F.col("sig_id").isin([dump.signal(p).sig_id for p in ("top.addr", "top.tick")])).select("t").distinct()


@query(f"WITH {_ctes()} SELECT d AS dump_id, max(t) AS t, arg_max(n_data, t) AS bits FROM raw WHERE n_data IS NOT NULL AND t < (SELECT max(t) // 2 FROM raw) GROUP BY d")
def s6_carry_before_window(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    middle = dump.time.end // 2
    rows = sampling.log_slice(dump, [dump.signal("top.data")], middle, dump.time.end).filter(F.col("t") < middle)
    return rows.select("dump_id", "t", "bits")


@query("SELECT 1::BIGINT AS tick_value, 'ns' AS unit, 0::BIGINT AS start, max(event_id) * 10 + 10 AS \"end\" FROM events")
def c1_info(spark, sf_dir):
    return catalog.info(_bus(spark, sf_dir)).df


@query("""SELECT path, depth, kind FROM (
    SELECT r_name AS path, 0 AS depth, 'module' AS kind FROM region
    UNION ALL SELECT r_name || '.' || n_name, 1, 'interface' FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE regexp_matches(path, 'A')""")
def c2_scope(spark, sf_dir):
    return catalog.scope_rows(adapters.hierarchy_dump(spark, sf_dir).scopes, "A").select("path", "depth", "kind")


@query("""SELECT r_name || '.' || n_name || '.' || replace(c_name, '.', '_') AS path, lower(c_mktsegment) AS kind, (c_custkey % 64 + 1)::INTEGER AS width
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = (SELECT min(r_name) FROM region) AND regexp_matches(c_name, '[02468]$')""")
def c3_signal(spark, sf_dir):
    dump = adapters.hierarchy_dump(spark, sf_dir)
    top = spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.min("r_name")).first()[0]
    return catalog.signal_rows(dump.signals, top, "[02468]$", None).select("path", "kind", "width")


@query("""WITH d AS (SELECT source || '/' || doc_id AS id, lower(split_part(text, chr(10), 1)) AS title, lower(coalesce(lang, '')) AS l, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
p AS (SELECT id, unnest(['license', 'src7', 'en']) AS tok, title, l, body FROM d),
s AS (SELECT id, CASE WHEN starts_with(lower(id), tok) THEN 0 WHEN contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), tok) OR contains(l, tok) THEN 1 WHEN contains(body, tok) THEN 3 END AS r FROM p)
SELECT id, false AS exact, count(r)::INTEGER AS matched, min(r)::INTEGER AS rank FROM s GROUP BY id HAVING count(r) > 0""")
def c6_search(spark, sf_dir):
    return search.search(adapters.topics(spark, sf_dir), "License src7 EN license")


# --- sampling -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_custkey AS sig_id, o_orderkey AS t, CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '10' ELSE 'xx' END AS bits FROM orders),
p AS (SELECT DISTINCT l_orderkey AS t, o_custkey % 100 + 1 AS sig_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.sig_id, p.t, c.bits FROM p ASOF LEFT JOIN c ON p.sig_id = c.sig_id AND p.t >= c.t""")
def a2_optional_as_of(spark, sf_dir):
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    probes = items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.lit(0).cast("long").alias("dump_id"), (F.col("o_custkey") % 100 + 1).alias("sig_id"), F.col("l_orderkey").alias("t")).distinct()
    return as_of(probes, adapters.order_changes(spark, sf_dir)).select("sig_id", "t", "bits")


@query(f"""WITH {_ctes()}, asked AS (SELECT unnest([5000, 15, 5000, 120]) AS t, unnest([0, 1, 2, 3])::INTEGER AS pos)
SELECT pos, asked.t::BIGINT AS t, c_data AS data, c_valid AS valid FROM asked ASOF JOIN st ON asked.t >= st.t""")
def a1_value_points(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    refs = [dump.signal("top.data"), dump.signal("top.valid")]
    return sampling.states_at(dump, refs, [5000, 15, 5000, 120]).select("pos", "t", F.col("c0").alias("data"), F.col("c1").alias("valid"))


@query(f"WITH {_ctes()}, u AS (SELECT DISTINCT t FROM raw) SELECT t, lag(t) OVER (ORDER BY t) AS previous FROM u")
def a4_previous_time(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    times = sampling.ranged(dump.changes.select("dump_id", "t"), dump.cuts).distinct()
    return sampling.carried(times, {"previous": F.col("t")}, ["t"], before=True).select("t", "previous")


@query(f"WITH {_ctes()} SELECT t, c_data AS data, p_data AS data_before, c_addr AS addr, p_ready AS ready_before FROM st")
def w1_state(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    st = states(dump, [dump.signal(f"top.{n}") for n in ("clk", "data", "addr", "ready")], 0, dump.time.end)
    return st.df.select("t", st.now("top.data").alias("data"), st.before("top.data").alias("data_before"), st.now("top.addr").alias("addr"), st.before("top.ready").alias("ready_before"))


# --- events -------------------------------------------------------------------------------------


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE coalesce(c_data <> p_data OR c_addr <> p_addr, false)")
def e1_wildcard(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "*")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE c_addr <> p_addr")
def e2_named(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "addr")


@query(f"WITH {_ctes(True)} SELECT d AS dump_id, t FROM st WHERE {POSEDGE}")
def e3_posedge_fleet(spark, sf_dir):
    return _fired(_bus(spark, sf_dir, True), "posedge clk")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE (p_valid = '1' AND c_valid <> '1') OR (p_valid = 'x' AND c_valid = '0')")
def e4_negedge(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "negedge valid")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE p_valid <> c_valid")
def e5_edge(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "edge valid")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE tick")
def e6_raw_event(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "tick")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE {POSEDGE} AND c_valid = '1' AND c_ready = '1'")
def e7_iff(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "posedge clk iff valid && ready")


@query(f"WITH {_ctes()} SELECT d AS dump_id, t FROM st WHERE ({NEGEDGE} AND c_addr LIKE '1%') OR tick")
def e8_union(spark, sf_dir):
    return _fired(_bus(spark, sf_dir), "negedge clk iff addr[7], tick")


# --- change, property, extract ------------------------------------------------------------------

_MOVED = "((c_data <> p_data) OR (c_addr <> p_addr))"


@query(f"WITH {_ctes()} SELECT t, t AS sample_t, c_data AS data, c_addr AS addr FROM st WHERE t > 500 AND {POSEDGE} AND {_MOVED}")
def q1_change_native(spark, sf_dir):
    return _changes(_bus(spark, sf_dir), "posedge clk", 500, waves.NATIVE)


_PRE = f"""m AS (SELECT d, t, p_data AS data, p_addr AS addr FROM st WHERE t > 500 AND {POSEDGE} AND t - 1 >= 0),
seed AS (SELECT d, arg_max(c_data, t) AS data, arg_max(c_addr, t) AS addr FROM st WHERE t <= 500 GROUP BY d),
b AS (SELECT m.*, coalesce(lag(m.data) OVER w, seed.data) AS b_data, coalesce(lag(m.addr) OVER w, seed.addr) AS b_addr FROM m JOIN seed USING (d) WINDOW w AS (PARTITION BY d ORDER BY t))"""


@query(f"WITH {_ctes()}, {_PRE} SELECT t, t - 1 AS sample_t, data, addr FROM b WHERE data <> b_data OR addr <> b_addr")
def q4_change_pre_edge(spark, sf_dir):
    return _changes(_bus(spark, sf_dir), "posedge clk", 500, waves.PRE_EDGE)


@query(f"WITH {_ctes(True)}, {_PRE} SELECT d AS dump_id, t, t - 1 AS sample_t, data, addr FROM b WHERE data <> b_data OR addr <> b_addr")
def q4_change_pre_edge_fleet(spark, sf_dir):
    return _changes(_bus(spark, sf_dir, True), "posedge clk", 500, waves.PRE_EDGE, True)


def _changes(dump: Dump, on: str, start: int, mode: str, fleet: bool = False) -> DataFrame:
    signals = [dump.signal("top.data"), dump.signal("top.addr")]
    rows, at = change_rows(dump, signals, Bindings(dump, "top").event(on), start, dump.time.end, mode)
    return rows.select(*(["dump_id"] if fleet else []), "t", "sample_t", F.col(f"s{at['top.data']}").alias("data"), F.col(f"s{at['top.addr']}").alias("addr"))


def _properties(dump: Dump, on: str, test: str, mode: str, capture: str, start: int = 0) -> DataFrame:
    b = Bindings(dump, "top")
    return property_rows(dump, b.event(on), b.value(test), start, dump.time.end, mode, capture).drop("dump_id")


@query(f"WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'match' AS kind FROM st WHERE {POSEDGE} AND p_valid = '1' AND p_ready = '1'")
def q6_property_match(spark, sf_dir):
    return _properties(_bus(spark, sf_dir), "posedge clk", "valid && ready", waves.PRE_EDGE, "match")


_TURNS = f"""m AS (SELECT t, coalesce(p_valid = '1' AND p_ready = '1', false) AS v FROM st WHERE {POSEDGE} AND t > 1000),
seed AS (SELECT coalesce(arg_max(c_valid, t) = '1' AND arg_max(c_ready, t) = '1', false) AS v FROM st WHERE t <= 1000),
b AS (SELECT t, v, coalesce(lag(v) OVER (ORDER BY t), (SELECT v FROM seed)) AS last FROM m)"""


@query(f"WITH {_ctes()}, {_TURNS} SELECT t, t - 1 AS sample_t, CASE WHEN v THEN 'assert' ELSE 'deassert' END AS kind FROM b WHERE v <> last")
def q7_property_switch(spark, sf_dir):
    return _properties(_bus(spark, sf_dir), "posedge clk", "valid && ready", waves.PRE_EDGE, "switch", 1000)


@query(f"WITH {_ctes()}, {_TURNS} SELECT t, t - 1 AS sample_t, 'assert' AS kind FROM b WHERE v AND NOT last")
def q7_property_assert(spark, sf_dir):
    return _properties(_bus(spark, sf_dir), "posedge clk", "valid && ready", waves.PRE_EDGE, "assert", 1000)


@query(f"WITH {_ctes()}, {_TURNS} SELECT t, t - 1 AS sample_t, 'deassert' AS kind FROM b WHERE last AND NOT v")
def q7_property_deassert(spark, sf_dir):
    return _properties(_bus(spark, sf_dir), "posedge clk", "valid && ready", waves.PRE_EDGE, "deassert", 1000)


def _payload(dump: Dump, sources: list[Source]) -> DataFrame:
    rows = extract_rows(dump, sources, 0, dump.time.end, "top")
    names = {f"v{k}": p.removeprefix("top.") for k, p in enumerate(payload_paths(dump, sources, "top"))}
    return rows.drop("dump_id").withColumnsRenamed(names)


@query(f"WITH {_ctes()} SELECT t, t - 1 AS sample_t, 0 AS ord, 'transfer' AS source, p_data AS data, p_addr AS addr FROM st WHERE {POSEDGE} AND p_valid = '1' AND p_ready = '1'")
def q8_extract_single(spark, sf_dir):
    return _payload(_bus(spark, sf_dir), [Source("transfer", "posedge clk", "valid && ready", ["data", "addr"])])


@query(f"""WITH {_ctes()} SELECT t, t - 1 AS sample_t, 0 AS ord, 'write' AS source, p_data AS data, NULL::VARCHAR AS addr FROM st WHERE {POSEDGE} AND p_valid = '1' AND p_htrans LIKE '1%'
UNION ALL SELECT t, t - 1, 1, 'any', NULL, p_addr FROM st WHERE {POSEDGE} AND p_ready = '1'
UNION ALL SELECT t, t - 1, 2, 'low', p_data, p_addr FROM st WHERE {NEGEDGE} AND c_valid = '1' AND p_addr LIKE '%1'""")
def q9_extract_multi(spark, sf_dir):
    return _payload(_bus(spark, sf_dir), [Source("write", "posedge clk", "valid && htrans[1]", ["data"]), Source("any", "posedge clk", "ready", ["addr"]), Source("low", "negedge clk iff valid", "addr[0]", ["data", "addr"])])


@query(f"WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'match' AS kind FROM st WHERE {POSEDGE} AND p_valid = '1' AND p_ready = '1' ORDER BY t LIMIT 51")
def q12_limited(spark, sf_dir):
    result = waves.property_check(_bus(spark, sf_dir), "posedge clk", "valid && ready", scope="top", capture="match")
    return result.ordered().limit((result.limit or 0) + 1).drop("dump_id")


# --- protocols ----------------------------------------------------------------------------------

_UP = "p_rst_n = '1'"


def _events_of(dump: Dump, built: tuple[list[Source], list[list[str]]]) -> DataFrame:
    return _payload(dump, built[0]).drop("ord")


@query(f"""WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'setup' AS source, p_addr AS addr, NULL::VARCHAR AS data, p_state AS state FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_htrans = '00'
UNION ALL SELECT t, t - 1, 'access-wait', p_addr, NULL, p_state FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_htrans LIKE '%1%' AND p_ready = '0'
UNION ALL SELECT t, t - 1, 'access-complete', p_addr, p_data, p_state FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_htrans LIKE '%1%' AND p_ready = '1'""")
def p1_apb(spark, sf_dir):
    found = {"pclk": "clk", "presetn": "rst_n", "psel": "valid", "penable": "htrans", "pready": "ready", "pwrite": "state", "paddr": "addr", "prdata": "data"}
    return _events_of(_bus(spark, sf_dir), buses.apb_sources(found, "apb3", include_wait=True))


@query(f"""WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'transfer' AS source, p_data AS data, p_addr AS addr FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_ready = '1'
UNION ALL SELECT t, t - 1, 'flush', NULL, NULL FROM st WHERE {POSEDGE} AND {_UP} AND p_htrans LIKE '%1%' AND p_ready = '1'
UNION ALL SELECT t, t - 1, 'sync-request', NULL, NULL FROM st WHERE {POSEDGE} AND {_UP} AND p_state LIKE '%1%'""")
def p3_atb(spark, sf_dir):
    found = {"atclk": "clk", "atresetn": "rst_n", "atvalid": "valid", "atready": "ready", "atdata": "data", "atid": "addr", "afvalid": "htrans", "afready": "ready", "syncreq": "state"}
    return _events_of(_bus(spark, sf_dir), buses.atb_sources(found))


@query(f"""WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'aw' AS source, p_addr AS addr, NULL::VARCHAR AS data FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_ready = '1'
UNION ALL SELECT t, t - 1, 'w', NULL, p_data FROM st WHERE {POSEDGE} AND {_UP} AND p_htrans LIKE '%1%' AND p_ready = '1'
UNION ALL SELECT t, t - 1, 'r', p_addr, p_data FROM st WHERE {POSEDGE} AND {_UP} AND p_state LIKE '%1%' AND p_valid = '1'""")
def p4_axi(spark, sf_dir):
    found = {"aclk": "clk", "aresetn": "rst_n", "awvalid": "valid", "awready": "ready", "awaddr": "addr", "wvalid": "htrans", "wready": "ready", "wdata": "data", "rvalid": "state", "rready": "valid", "rid": "addr", "rdata": "data"}
    return _events_of(_bus(spark, sf_dir), buses.axi_sources(found))


@query(f"WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'transfer' AS source, p_data AS data, p_addr AS addr FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1'")
def p5_axi_stream(spark, sf_dir):
    found = {"aclk": "clk", "aresetn": "rst_n", "tvalid": "valid", "tdata": "data", "tid": "addr"}
    return _events_of(_bus(spark, sf_dir), buses.stream_sources(found, tready_mode="implicit-high"))


@query(f"WITH {_ctes()} SELECT t, t - 1 AS sample_t, 'transfer' AS source, p_data AS data, p_addr AS addr FROM st WHERE {POSEDGE} AND {_UP} AND p_valid = '1' AND p_ready = '1'")
def p5_axi_stream_mapped(spark, sf_dir):
    found = {"aclk": "clk", "aresetn": "rst_n", "tvalid": "valid", "tready": "ready", "tdata": "data", "tid": "addr"}
    return _events_of(_bus(spark, sf_dir), buses.stream_sources(found, tready_mode="mapped"))


@query(f"""WITH {_ctes()}, g AS (SELECT t, p_rst_n AS rst, p_ready AS ready, p_htrans AS trans, p_valid AS wr, p_addr AS addr, p_data AS data FROM st WHERE {POSEDGE}),
s AS (SELECT *, CASE WHEN rst = '0' THEN 'empty' WHEN rst <> '1' OR ready NOT IN ('0', '1') THEN 'desynchronized' WHEN ready = '0' THEN NULL
    WHEN trans IN ('10', '11') THEN 'pending ' || CASE wr WHEN '0' THEN 'read' WHEN '1' THEN 'write' ELSE 'unknown' END WHEN trans IN ('00', '01') THEN 'empty' ELSE 'desynchronized' END AS setter FROM g),
w AS (SELECT *, coalesce(last_value(setter IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'desynchronized') AS was, lag(rst) OVER (ORDER BY t) AS last_rst FROM s),
k AS (SELECT *, rst = '1' AND ready IN ('0', '1') AS good, starts_with(was, 'pending') AS pending, CASE wr WHEN '0' THEN 'read' WHEN '1' THEN 'write' ELSE 'unknown' END AS now FROM w)
SELECT t, 'reset' AS event, NULL::VARCHAR AS transfer, NULL::VARCHAR AS direction, addr FROM k WHERE rst = '0' AND coalesce(last_rst <> '0', true)
UNION ALL SELECT t, 'data-stall', NULL, was[9:], addr FROM k WHERE good AND ready = '0' AND pending
UNION ALL SELECT t, 'data-complete', NULL, was[9:], addr FROM k WHERE good AND ready = '1' AND pending
UNION ALL SELECT t, 'address', CASE trans WHEN '10' THEN 'nonseq' ELSE 'seq' END, now, addr FROM k WHERE good AND ready = '1' AND trans IN ('10', '11')
UNION ALL SELECT t, 'idle', 'idle', NULL, addr FROM k WHERE good AND ready = '1' AND trans = '00'
UNION ALL SELECT t, 'busy', 'busy', now, addr FROM k WHERE good AND ready = '1' AND trans = '01'
UNION ALL SELECT t, 'desynchronized', NULL, NULL, addr FROM k WHERE was <> 'desynchronized' AND ((rst <> '0' AND NOT good) OR (good AND ready = '1' AND trans NOT IN ('00', '01', '10', '11')))""")
def p6_ahb(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    found = {"hclk": "clk", "hresetn": "rst_n", "hready": "ready", "htrans": "htrans", "hwrite": "valid", "haddr": "addr", "hrdata": "data"}
    rows = ahb.ahb_rows(dump, found, dump.time.end, "top", True, True, True)
    return rows.select("t", "event", "transfer", "direction", F.col("s_haddr").alias("addr"))


# --- expressions --------------------------------------------------------------------------------

#: A known number of a bit string, and the test that it has none, in DuckDB.
_NUM = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({0}, ''), lambda c: c::HUGEINT)), lambda a, c: a * 2 + c)"
_BAD = "regexp_matches({0}, '[xz]')"


def _known(sql: str, *of: str, width: int) -> str:
    return f"CASE WHEN {_BAD.format(' || '.join(of))} THEN repeat('x', {width}) ELSE {sql} END"


def _n(c: str) -> str:
    return _NUM.format(f"regexp_replace({c}, '[xz]', '0', 'g')")


def _bin(n: str, width: int) -> str:
    return f"lpad(right(bin(({n})::HUGEINT & ((1::HUGEINT << {width}) - 1)), {width}), {width}, '0')"


def _zip(a: str, b: str, body: str) -> str:
    return f"list_aggregate(list_transform(range(1, length({a}) + 1), lambda i: {body.replace('P', f'{a}[i]').replace('Q', f'{b}[i]')}), 'string_agg', '')"


_TRUTH = "CASE WHEN contains({0}, '1') THEN '1' WHEN regexp_matches({0}, '[xz]') THEN 'x' ELSE '0' END"
_A, _D, _H, _V, _R = "c_addr", "c_data", "c_htrans", "c_valid", "c_ready"
_ADDR16 = "repeat('0', 8) || c_addr"
_AND = "CASE WHEN P = '0' OR Q = '0' THEN '0' WHEN P = '1' AND Q = '1' THEN '1' ELSE 'x' END"
_OR = "CASE WHEN P = '1' OR Q = '1' THEN '1' WHEN P = '0' AND Q = '0' THEN '0' ELSE 'x' END"
_XOR = "CASE WHEN P IN ('x', 'z') OR Q IN ('x', 'z') THEN 'x' WHEN P = Q THEN '0' ELSE '1' END"
_SIGNED = f"({_n(_D)} - CASE WHEN c_data LIKE '1%' THEN 65536 ELSE 0 END)"

#: name: (expression over the bus, DuckDB's value of it on the state's columns)
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "f1_reference": ("data", _D),
    "f2_literals": ("{8'hf0, 4'bx0z1}", "'11110000x0z1'"),
    "f3_enum_label": ("state == type(state)::purchase", "CASE WHEN c_state = '010' THEN '1' ELSE '0' END"),
    "f4_group": ("(addr) & (8'hf0 | 8'h01)", "left(c_addr, 4) || '000' || right(c_addr, 1)"),
    "f10_type_cast": ("type(addr)'(data)", "right(c_data, 8)"),
    "f5_sign_cast": ("signed'(addr) < 8'sh0", "CASE WHEN c_addr LIKE '1%' THEN '1' ELSE '0' END"),
    "f6_resize_cast": ("bit[20]'(data)", "repeat('0', 4) || translate(c_data, 'xz', '00')"),
    "f6_sign_extend": ("logic[12]'(signed'(addr))", "repeat(left(c_addr, 1), 4) || c_addr"),
    "f8_real_to_bits": ("int'(temp)", _bin("trunc(c_temp)::BIGINT", 32)),
    "f11_bit_select": ("data[addr[3:0]]", "substr(c_data, (16 - " + _n("right(c_addr, 4)") + ")::BIGINT, 1)"),
    "f12_part_select": ("data[11:4]", "substr(c_data, 5, 8)"),
    "f12_reversed": ("data[4:11]", "reverse(substr(c_data, 5, 8))"),
    "f13_up_select": ("addr[htrans +: 4]", "CASE WHEN " + _BAD.format(_H) + " THEN 'xxxx' ELSE substr(c_addr, (8 - (" + _n(_H) + " + 3))::BIGINT, 4) END"),
    "f14_down_select": ("data[15 -: 6]", "left(c_data, 6)"),
    "f15_not": ("!data", "translate(" + _TRUTH.format(_D) + ", '01', '10')"),
    "f16_and": ("valid && data", "CASE WHEN c_valid = '0' THEN '0' WHEN " + _TRUTH.format(_D) + " = '0' THEN '0' WHEN c_valid = '1' AND " + _TRUTH.format(_D) + " = '1' THEN '1' ELSE 'x' END"),
    "f17_or": ("valid || data", "CASE WHEN c_valid = '1' THEN '1' WHEN " + _TRUTH.format(_D) + " = '1' THEN '1' WHEN c_valid = '0' AND " + _TRUTH.format(_D) + " = '0' THEN '0' ELSE 'x' END"),
    "f18_invert": ("~data", "translate(c_data, '01z', '10x')"),
    "f19_and": ("data & addr", _zip("c_data", f"({_ADDR16})", _AND)),
    "f19_or": ("data | addr", _zip("c_data", f"({_ADDR16})", _OR)),
    "f19_xor": ("data ^ addr", _zip("c_data", f"({_ADDR16})", _XOR)),
    "f19_xnor": ("data ~^ addr", "translate(" + _zip("c_data", f"({_ADDR16})", _XOR) + ", '01', '10')"),
    "f20_reduce_and": ("&htrans", "CASE WHEN contains(c_htrans, '0') THEN '0' WHEN regexp_matches(c_htrans, '[xz]') THEN 'x' ELSE '1' END"),
    "f20_reduce_nor": ("~|data", "translate(" + _TRUTH.format(_D) + ", '01', '10')"),
    "f20_reduce_xor": ("^data", "CASE WHEN " + _BAD.format(_D) + " THEN 'x' ELSE (length(replace(c_data, '0', '')) % 2)::VARCHAR END"),
    "f21_negate": ("-data", _known(_bin(f"65536 - {_n(_D)}", 16), _D, width=16)),
    "f22_add": ("data + addr", _known(_bin(f"{_n(_D)} + {_n(_A)}", 16), _D, _A, width=16)),
    "f22_subtract": ("addr - data", _known(_bin(f"{_n(_A)} - {_n(_D)} + 65536", 16), _D, _A, width=16)),
    "f22_multiply": ("data * addr", _known(_bin(f"{_n(_D)} * {_n(_A)}", 16), _D, _A, width=16)),
    "f23_divide": ("data / addr", "CASE WHEN " + _BAD.format(_D) + " OR " + _n(_A) + " = 0 THEN repeat('x', 16) ELSE " + _bin(f"{_n(_D)} // {_n(_A)}", 16) + " END"),
    "f23_signed_remainder": ("signed'(data) % 16'sd7", _known(_bin(f"(CASE WHEN {_SIGNED} < 0 THEN -((-{_SIGNED}) % 7) ELSE {_SIGNED} % 7 END) + 65536", 16), _D, width=16)),
    "f24_power": ("addr ** 2'd2", _bin(f"{_n(_A)} * {_n(_A)}", 8)),
    "f26_shift_left": ("data << htrans", "CASE WHEN " + _BAD.format(_H) + " THEN repeat('x', 16) ELSE substr(c_data || '000', (1 + " + _n(_H) + ")::BIGINT, 16) END"),
    "f26_shift_right": ("data >> htrans", "CASE WHEN " + _BAD.format(_H) + " THEN repeat('x', 16) ELSE substr('000' || c_data, (4 - " + _n(_H) + ")::BIGINT, 16) END"),
    "f26_arithmetic_right": ("signed'(data) >>> htrans", "CASE WHEN " + _BAD.format(_H) + " THEN repeat('x', 16) ELSE substr(repeat(left(c_data, 1), 3) || c_data, (4 - " + _n(_H) + ")::BIGINT, 16) END"),
    "f27_less": ("data < 16'd20000", "CASE WHEN " + _BAD.format(_D) + " THEN 'x' WHEN " + _n(_D) + " < 20000 THEN '1' ELSE '0' END"),
    "f27_signed_at_least": ("signed'(data) >= 16'sd100", "CASE WHEN " + _BAD.format(_D) + " THEN 'x' WHEN " + _SIGNED + " >= 100 THEN '1' ELSE '0' END"),
    "f28_equal": ("htrans == 2'b10", "CASE WHEN " + _BAD.format(_H) + " THEN 'x' WHEN c_htrans = '10' THEN '1' ELSE '0' END"),
    "f29_case_equal": ("htrans === 2'b1x", "CASE WHEN c_htrans = '1x' THEN '1' ELSE '0' END"),
    "f30_wild_equal": ("htrans ==? 2'b1x", "CASE WHEN c_htrans LIKE '1%' THEN '1' ELSE '0' END"),
    "f32_conditional": ("valid ? htrans : 2'b10", "CASE c_valid WHEN '1' THEN c_htrans WHEN '0' THEN '10' ELSE CASE WHEN c_htrans[1] = '1' THEN '1' ELSE 'x' END || CASE WHEN c_htrans[2] = '0' THEN '0' ELSE 'x' END END"),
    "f33_inside": ("addr inside {8'd3, [8'd10:8'd20], 8'b1111xxxx}", "CASE WHEN " + _n(_A) + " = 3 OR " + _n(_A) + " BETWEEN 10 AND 20 OR c_addr LIKE '1111%' THEN '1' ELSE '0' END"),
    "f34_concat": ("{htrans, addr, valid}", "c_htrans || c_addr || c_valid"),
    "f35_repeat": ("{3{htrans}}", "repeat(c_htrans, 3)"),
    "f36_triggered": ("tick.triggered()", "CASE WHEN tick THEN '1' ELSE '0' END"),
    "f37_truth": ("!(!data)", _TRUTH.format(_D)),
    "f22_wide": ("{data, data, data, data, addr} + 72'd1", _known("lpad(bin(" + _NUM.format("regexp_replace(c_data || c_data || c_data || c_data || c_addr, '[xz]', '0', 'g')") + " + 1), 72, '0')", _D, width=72)),
}


def _evaluated(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dump = _bus(spark, sf_dir)
        node = bound(text, waves.lookup(dump, "top"), lambda n: f"top.{n}")
        refs = [dump.signal(p) for p in sorted(node.signals() | {"top.clk"})]
        st = states(dump, refs, 0, dump.time.end)
        on = edge("posedge", st.before("top.clk"), st.now("top.clk"))
        return st.df.filter(on).select("t", compiled(node, st.now).alias("r"))

    return run


for _name, (_text, _sql) in EXPRESSIONS.items():
    QUERIES[_name] = _evaluated(_text)
    SQL[_name] = f"WITH {_ctes()} SELECT t, {_sql} AS r FROM st WHERE {POSEDGE}"


def _real(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _evaluated(text)(spark, sf_dir).select("t", F.round("r", 6).alias("r"))

    return run


QUERIES["f25_real_arithmetic"] = _real("temp * 2.0 + 1.5")
SQL["f25_real_arithmetic"] = f"WITH {_ctes()} SELECT t, round(c_temp * 2.0 + 1.5, 6) AS r FROM st WHERE {POSEDGE}"
QUERIES["f7_real_cast"] = _real("real'(addr) / 4.0")
SQL["f7_real_cast"] = f"WITH {_ctes()} SELECT t, round({_n(_A)}::DOUBLE / 4.0, 6) AS r FROM st WHERE {POSEDGE}"


def _hex(c: str, width: int) -> str:
    parts = [f"{c}[{k + 1}:{k + 4}]" for k in range(0, width, 4)]
    shown = " || ".join(f"CASE WHEN regexp_matches({p}, '^[01]+$') THEN lower(format('{{:x}}', ({_NUM.format(p)})::BIGINT)) WHEN {p} = 'zzzz' THEN 'z' ELSE 'x' END" for p in parts)
    return f"'{width}''h' || {shown}"


@query(f"WITH {_ctes()} SELECT t, {_hex('c_data', 16)} AS data, t || 'ns' AS time FROM st WHERE {POSEDGE}")
def f40_literal_text(spark, sf_dir):
    dump = _bus(spark, sf_dir)
    st = states(dump, [dump.signal("top.clk"), dump.signal("top.data")], 0, dump.time.end)
    on: Column = edge("posedge", st.before("top.clk"), st.now("top.clk"))
    return st.df.filter(on).select("t", literal_text(st.now("top.data"), 16).alias("data"), dump.time.column(F.col("t")).alias("time"))
