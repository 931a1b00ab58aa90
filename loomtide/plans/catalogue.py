"""The registered graph, spatial, profile and series queries, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import distances, expression, math as M
from ..operators import mutate, neural, profile, resolve, series, spatial, traverse
from ..operators.graph import TemporalGraph
from ..operators.index import Indexes
from ..sources import tabular

NOON = 1_705_320_000_000_000  # 15 January 2024, 12:00 UTC, in microseconds
FORK = 1_705_363_200_000_000  # 16 January 2024
HOUR = 3_600_000_000
DAY = 24 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VER = "ver AS (SELECT user_id AS id, CAST(0 AS BIGINT) AS world, epoch_us(ts) AS time, event_type, value, event_id FROM events)"
CHILD = f"child AS (SELECT id, CAST(1 AS BIGINT) AS world, time, event_type, value * 1.1 AS value FROM ver WHERE id % 5 = 0 AND time >= {FORK})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def versions(spark, sf_dir, extra: dict[str, str] | None = None) -> DataFrame:
    return tabular.versions(events(spark, sf_dir), "user_id", tabular.micros("ts"), {"event_type": "event_type", "value": "value", **(extra or {})})


def forked(spark, sf_dir) -> TemporalGraph:
    v = versions(spark, sf_dir)
    child = v.where((F.col("id") % 5 == 0) & (F.col("time") >= FORK)).withColumn("world", F.lit(1).cast("long")).withColumn("value", F.col("value") * 1.1)
    return TemporalGraph.of(v).fork(1, 0).write(child)


def rounded(x: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


# --- versions and as-of reads -------------------------------------------------


@query(f"WITH {VER} SELECT id, world, time, event_type, value FROM ver")
def version_build(spark, sf_dir):
    return versions(spark, sf_dir)


@query(f"WITH {VER} SELECT id, max(time) AS res_time, arg_max(event_type, time) AS event_type, arg_max(value, time) AS value FROM ver WHERE time <= {NOON} GROUP BY id")
def asof_single_time(spark, sf_dir):
    return resolve.as_of_single(versions(spark, sf_dir), NOON)


_REQ = f"req AS (SELECT event_id, id, time - (event_id % 7) * {HOUR} - 1 AS time FROM ver)"


def _requests(spark, sf_dir) -> DataFrame:
    return versions(spark, sf_dir, {"event_id": "event_id"}).select("event_id", "id", (F.col("time") - (F.col("event_id") % 7) * HOUR - 1).alias("time"))


@query(f"WITH {VER}, {_REQ} SELECT r.event_id, r.id, r.time, v.time AS res_time, v.event_type, v.value FROM req r ASOF JOIN ver v ON r.id = v.id AND r.time >= v.time")
def asof_per_row(spark, sf_dir):
    return resolve.as_of_rows(_requests(spark, sf_dir), versions(spark, sf_dir))


_FORK_READ = """
WITH {ver}, {child}, since AS (SELECT id, min(time) AS since FROM child GROUP BY id),
seen AS (SELECT id, time, event_type, value, 1 AS w FROM child UNION ALL SELECT v.id, v.time, v.event_type, v.value, 0 FROM ver v),
pick AS (SELECT s.*, CASE WHEN since <= {t} THEN 1 ELSE 0 END AS want FROM seen s LEFT JOIN since USING (id))
SELECT id, CAST(1 AS BIGINT) AS world, CAST({t} AS BIGINT) AS time, CAST(max(want) AS BIGINT) AS res_world, max(time) AS res_time, arg_max(event_type, time) AS event_type, round(arg_max(value, time), 4) AS value
FROM pick WHERE w = want AND time <= {t} GROUP BY id
"""


@query(_FORK_READ.format(ver=VER, child=CHILD, t=FORK + 3 * DAY))
def asof_world_fork(spark, sf_dir):
    g = forked(spark, sf_dir)
    ask = g.versions.select("id").distinct().select("id", F.lit(1).cast("long").alias("world"), F.lit(FORK + 3 * DAY).alias("time"))
    return g.lookup(ask).withColumn("value", rounded("value"))


@query(f"WITH {VER} SELECT id, max(time) FILTER (WHERE time <= {NOON}) AS t1, max(time) FILTER (WHERE time <= {NOON + 5 * DAY}) AS t2 FROM ver GROUP BY id HAVING count(*) FILTER (WHERE time <= {NOON}) > 0")
def travel_in_time(spark, sf_dir):
    v = versions(spark, sf_dir)
    a, b = (resolve.as_of_single(v, t).select("id", F.col("res_time").alias(n)) for t, n in ((NOON, "t1"), (NOON + 5 * DAY, "t2")))
    return a.join(b, "id")


@query(f"""WITH {VER}, {CHILD}, b AS (SELECT id, arg_max(value, time) AS v0 FROM ver WHERE time <= {FORK + DAY} GROUP BY id),
c AS (SELECT id, arg_max(value, time) AS v1 FROM child WHERE time <= {FORK + DAY} GROUP BY id)
SELECT id, round(v0, 4) AS v0, round(coalesce(v1, v0), 4) AS v1 FROM b LEFT JOIN c USING (id)""")
def travel_in_world(spark, sf_dir):
    g = forked(spark, sf_dir)
    a, b = (g.at(FORK + DAY, w).select("id", rounded("value").alias(f"v{w}")) for w in (0, 1))
    return a.join(b, "id")


# --- timelines ----------------------------------------------------------------


@query(f"WITH {VER} SELECT DISTINCT id, time FROM ver WHERE time >= {NOON} AND time < {NOON + 2 * DAY}")
def timepoints_desc(spark, sf_dir):
    return resolve.timepoints(versions(spark, sf_dir), NOON, NOON + 2 * DAY)


@query(f"WITH {VER}, {CHILD}, since AS (SELECT id, min(time) AS since FROM child GROUP BY id) SELECT DISTINCT id, time FROM (SELECT id, time FROM child UNION ALL SELECT v.id, v.time FROM ver v LEFT JOIN since USING (id) WHERE since IS NULL OR v.time < since) WHERE time >= {FORK - DAY} AND time < {FORK + DAY}")
def timepoints_fork(spark, sf_dir):
    return forked(spark, sf_dir).timepoints(1, FORK - DAY, FORK + DAY)


@query(f"WITH {VER} SELECT id, count(DISTINCT time) AS n FROM ver WHERE time >= {NOON} AND time < {NOON + 7 * DAY} GROUP BY id")
def count_timepoints(spark, sf_dir):
    return resolve.count_timepoints(versions(spark, sf_dir), NOON, NOON + 7 * DAY)


def _timeline_sql(order: str) -> str:
    return f"WITH {VER} SELECT id, time, value, pos FROM (SELECT id, time, value, CAST(row_number() OVER (PARTITION BY id ORDER BY time {order}) - 1 AS INTEGER) AS pos FROM ver WHERE time BETWEEN {NOON} AND {NOON + 9 * DAY}) WHERE pos < 5"


@query(_timeline_sql("ASC"))
def timeline_limit(spark, sf_dir):
    return resolve.timeline(versions(spark, sf_dir), NOON, NOON + 9 * DAY, 5).select("id", "time", "value", "pos")


@query(_timeline_sql("DESC"))
def timeline_reverse(spark, sf_dir):
    return resolve.timeline(versions(spark, sf_dir), NOON + 9 * DAY, NOON, 5).select("id", "time", "value", "pos")


@query(f"""WITH {VER}, r AS (SELECT id, time, value, row_number() OVER (PARTITION BY id ORDER BY time DESC) - 1 AS rn, count(*) OVER (PARTITION BY id) // 10 + 1 AS step FROM ver WHERE time BETWEEN {NOON} AND {NOON + 9 * DAY})
SELECT id, time, value, CAST(rn // step AS INTEGER) AS pos FROM r WHERE rn % step = 0 AND rn // step < 10""")
def timeline_sparse(spark, sf_dir):
    return resolve.timeline_sparse(versions(spark, sf_dir), NOON, NOON + 9 * DAY, 10).select("id", "time", "value", "pos")


@query(f"WITH {VER} SELECT id, max(time) AS res_time, {NOON} - max(time) AS dephasing FROM ver WHERE time <= {NOON} GROUP BY id")
def dephasing(spark, sf_dir):
    return resolve.dephasing(versions(spark, sf_dir), NOON)


# --- writes -------------------------------------------------------------------


@query(f"WITH {VER} SELECT id, time, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM ver WINDOW w AS (PARTITION BY id ORDER BY time)) WHERE n = 1 OR event_type IS DISTINCT FROM b")
def change_detect(spark, sf_dir):
    return mutate.change_detect(versions(spark, sf_dir).select("id", "time", "event_type"), "event_type")


@query(f"WITH {VER} SELECT id, time - time % {HOUR} + 1000 AS time, arg_max(event_type, time) AS event_type, arg_max(value, time) AS value FROM ver GROUP BY id, time - time % {HOUR} + 1000")
def time_sensitivity(spark, sf_dir):
    return mutate.time_sensitivity(versions(spark, sf_dir).drop("world"), HOUR, 1000)


@query(f"WITH {VER}, e AS (SELECT id, min(time) + {DAY} AS end_time FROM ver WHERE id % 3 = 0 GROUP BY id) SELECT id, max(time) AS res_time, arg_max(value, time) AS value FROM ver LEFT JOIN e USING (id) WHERE time <= {NOON} AND (end_time IS NULL OR {NOON} <= end_time) GROUP BY id")
def end_timeline(spark, sf_dir):
    v = versions(spark, sf_dir)
    ends = v.where("id % 3 = 0").groupBy("id").agg((F.min("time") + DAY).alias("end_time"))
    return mutate.end_timelines(resolve.as_of_single(v, NOON).withColumn("time", F.lit(NOON)), ends).select("id", "res_time", "value")


@query(f"WITH {VER} SELECT id, world, time, event_type, value FROM ver WHERE id % 4 <> 0")
def drop_node(spark, sf_dir):
    v = versions(spark, sf_dir)
    return TemporalGraph.of(v).drop_nodes(v.where("id % 4 = 0").select("id")).versions.select("id", "world", "time", "event_type", "value")


@query(f"""WITH {VER}, s AS (SELECT id, max(time) AS t, arg_max(value, time) AS v, arg_max(event_type, time) AS e FROM ver WHERE time <= {NOON} GROUP BY id)
SELECT id, {NOON} AS time, e AS event_type, CAST(id AS DOUBLE) AS value FROM s WHERE v IS DISTINCT FROM CAST(id AS DOUBLE)""")
def set_attribute(spark, sf_dir):
    g = TemporalGraph.of(versions(spark, sf_dir))
    before = g.versions.select("id").distinct()
    at = resolve.as_of_single(g.versions, NOON).where(F.col("res_time") < NOON).select("id", F.lit(0).cast("long").alias("world"), F.lit(NOON).alias("time"), F.col("id").cast("double").alias("value"))
    return g.set_attribute("value", at.join(before, "id")).versions.where(F.col("time") == NOON).select("id", "time", "event_type", "value")


@query(f"WITH {VER} SELECT id + 1000000 AS id, {NOON} AS time, arg_max(event_type, time) AS event_type, arg_max(value, time) AS value FROM ver WHERE time <= {NOON} GROUP BY id")
def clone_nodes(spark, sf_dir):
    g = TemporalGraph.of(versions(spark, sf_dir))
    at = g.versions.select("id", "world").distinct().withColumn("time", F.lit(NOON))
    return g.clone(at, 1_000_000).versions.where("id >= 1000000").select("id", "time", "event_type", "value")


@query("SELECT CAST(c_nationkey AS BIGINT) AS src, 'members' AS rel, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS pos, c_custkey AS dst FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def add_var_to(spark, sf_dir):
    sizes = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("size"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).join(sizes, "id", "left").na.fill(0, ["size"]).select(F.col("id").cast("long").alias("id"), "size")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src"), F.col("c_custkey").alias("id"))
    return mutate.add_to_relation(nations, members, "members")


@query(f"""WITH {VER}, s AS (SELECT id, arg_max(value, time) FILTER (WHERE time <= {NOON}) AS v FROM ver GROUP BY id)
SELECT id, {NOON} AS time, 'first' AS event_type, v AS value FROM s UNION ALL SELECT id, {NOON + 2}, 'second', v FROM s""")
def set_attribute_batch(spark, sf_dir):
    g = TemporalGraph.of(versions(spark, sf_dir))
    writes = F.array(*(F.struct(F.lit(NOON + t).alias("time"), F.lit(v).alias("value")) for t, v in ((0, "first"), (1, "first"), (2, "second"))))
    batch = g.versions.select("id").distinct().select("id", F.lit(0).cast("long").alias("world"), F.inline(writes))
    return g.set_attribute("event_type", batch).versions.where(F.col("time").between(NOON, NOON + 2)).select("id", "time", "event_type", "value")


@query(f"WITH {VER}, e AS (SELECT id, min(time) + {DAY} AS end_time FROM ver WHERE id % 3 = 0 GROUP BY id) SELECT id, max(time) AS res_time, arg_max(value, time) AS value FROM ver LEFT JOIN e USING (id) WHERE time <= {NOON} AND (end_time IS NULL OR {NOON} <= end_time) GROUP BY id")
def end_at(spark, sf_dir):
    v = versions(spark, sf_dir)
    ends = v.where("id % 3 = 0").groupBy("id", "world").agg((F.min("time") + DAY).alias("end_time"))
    return TemporalGraph.of(v).end(ends).at(NOON).select("id", "res_time", "value")


@query(f"WITH {VER}, r AS (SELECT event_id AS pos, id + event_id % 2 * 1000000 AS id, time - {HOUR} AS time FROM ver), f AS (SELECT r.pos, r.id, r.time, v.time AS res_time, v.value FROM r ASOF LEFT JOIN ver v ON r.id = v.id AND r.time >= v.time) SELECT * FROM f")
def lookup_all(spark, sf_dir):
    v = versions(spark, sf_dir, {"event_id": "event_id"})
    asked = v.select(F.col("event_id").alias("pos"), (F.col("id") + F.col("event_id") % 2 * 1_000_000).alias("id"), "world", (F.col("time") - HOUR).alias("time"))
    return TemporalGraph.of(v.drop("event_id")).lookup_all(asked).select("pos", "id", "time", "res_time", "value")


@query(f"WITH {VER} SELECT id, time, value, pos FROM (SELECT id, time, value, CAST(row_number() OVER (PARTITION BY id ORDER BY time DESC) - 1 AS INTEGER) AS pos FROM ver WHERE id % 10 < 3 AND time BETWEEN {NOON} AND {NOON + 9 * DAY}) WHERE pos < 4")
def lookup_times(spark, sf_dir):
    g = TemporalGraph.of(versions(spark, sf_dir))
    return g.lookup_times(g.versions.select("id").where("id % 10 < 3"), 0, NOON + 9 * DAY, NOON, 4).select("id", "time", "value", "pos")


@query("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) AS pos, dst FROM (SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderstatus <> 'F')")
def remove_from_relation(spark, sf_dir):
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return mutate.remove_from_relation(_order_edges(spark, sf_dir), closed, "orders").select("src", "pos", "dst")


@query("SELECT c_custkey AS src, coalesce(o_orderkey, c_custkey) AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def traverse_or_keep(spark, sf_dir):
    return mutate.traverse_or_keep(_customers(spark, sf_dir), _order_edges(spark, sf_dir), "orders").select("src", "id")


# --- indexes, selection, traversal --------------------------------------------


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def read_index(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return traverse.read_index(c.select("id", "segment", "nation"), c, segment="BUILDING", nation=7).select("id", "name")


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def read_index_all(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return traverse.read_index(c.select("id"), c).select("id", "segment")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 AND c_custkey % 10 <> 0")
def index_declared(spark, sf_dir):
    c = _customers(spark, sf_dir)
    held = Indexes.empty(spark).declare("home", "segment", "nation").update("home", c).unindex("home", c.where("id % 10 = 0"))
    return held.read("home", "BUILDING", 7).select("id")


@query(f"WITH {VER} SELECT id FROM (SELECT id, arg_max(event_type, time) AS e FROM ver WHERE time <= {NOON} GROUP BY id) WHERE e = 'click'")
def index_timed(spark, sf_dir):
    held = Indexes.empty(spark).declare("kind", "event_type", kind="timed").update("kind", versions(spark, sf_dir))
    return held.read("kind", "click", time=NOON).select("id")


@query("SELECT o_custkey AS owner, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def index_local(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return Indexes.empty(spark).declare("orders", "status", kind="local").update("orders", o).read("orders", "F")


@query("SELECT unnest(['home', 'kind']) AS name")
def index_names(spark, sf_dir):
    return Indexes.empty(spark).declare("home", "segment").declare("kind", "event_type", kind="timed").declare("home", "other").names()


@query(f"WITH {VER} SELECT id, arg_max(event_type, time) AS event_type, max(time) AS time FROM ver GROUP BY id")
def index_update_latest(spark, sf_dir):
    return traverse.update_index(versions(spark, sf_dir).select("id", "event_type", "time"), "time").select("id", "event_type", "time")


def _order_edges(spark, sf_dir) -> DataFrame:
    return tabular.foreign_key_edges(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "orders", ["o_orderkey"])


@query("SELECT o_custkey AS src, o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
def local_index(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    hits = traverse.read_index(keyed.select("id", "status"), keyed, status="F")
    return traverse.traverse(_customers(spark, sf_dir).select("id"), _order_edges(spark, sf_dir), "orders", hits).select("src", "id", "price")


@query("SELECT o_custkey AS src, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey AS id, o_totalprice AS price FROM orders")
def traverse_rel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return traverse.traverse(_customers(spark, sf_dir).select("id"), _order_edges(spark, sf_dir), "orders", orders).select("src", "pos", "id", "price")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, o_orderkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def traverse_two_hop(spark, sf_dir):
    homes = tabular.foreign_key_edges(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "customers", ["c_custkey"])
    first = traverse.traverse(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), homes, "customers").select(F.col("src").alias("nation"), "id")
    second = traverse.traverse(first.select("id").distinct(), _order_edges(spark, sf_dir), "orders").select("src", F.col("id").alias("order"))
    return first.join(second, first["id"] == second["src"]).select("nation", F.col("order").alias("id"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src) SELECT src, dst, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY src, dst")
def traverse_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return traverse.closure(edges)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9]7')")
def with_regex(spark, sf_dir):
    return traverse.with_regex(_customers(spark, sf_dir), "name", "Customer#0*[1-9]7").select("id", "name")


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment IS NULL OR NOT regexp_full_match(c_mktsegment, '(AUTO|MACH).*')")
def without_regex(spark, sf_dir):
    return traverse.without_regex(_customers(spark, sf_dir), "segment", "(AUTO|MACH).*").select("id", "segment")


@query("SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier WHERE s_acctbal > 1000 AND s_nationkey % 2 = 0")
def select_pred(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where((F.col("s_acctbal") > 1000) & (F.col("s_nationkey") % 2 == 0)).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))


@query("SELECT s_suppkey AS id, unnest(['name', 'balance']) AS attribute FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'name' FROM supplier WHERE s_acctbal <= 0")
def attributes_list(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return traverse.attribute_names(s)


@query("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst DESC) - 1 AS BIGINT) AS pos, dst FROM (SELECT o_orderkey AS src, o_custkey AS dst FROM orders)")
def opposite_edges(spark, sf_dir):
    return mutate.opposite(_order_edges(spark, sf_dir), "customer").select("src", "pos", "dst")


# --- expressions and pipelines ------------------------------------------------


@query("SELECT event_id, round(value * 2 + 3 - value ^ 2 / 7, 4) AS a, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / nullif(event_id % 5, 0) END, 4) AS b, CAST((event_id % 7) - 3 AS DOUBLE) AS c FROM events")
def expr_arith(spark, sf_dir):
    e, v = events(spark, sf_dir), F.col("value")
    quotient = M.divide(v, F.col("event_id") % 5)
    return e.select("event_id", rounded(v * 2 + 3 - F.pow(v, F.lit(2)) / 7).alias("a"), rounded(M.choose(M.truth(F.col("event_id") % 5 == 0), 0, quotient)).alias("b"), (M.remainder(F.col("event_id"), 7) - 3).alias("c"))


@query("SELECT event_id, CASE WHEN value > 50 AND event_id % 2 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a, CASE WHEN value > 90 OR event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS b, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS c, greatest(value, 40.0) AS d, least(value, 40.0) AS e FROM events")
def expr_logic(spark, sf_dir):
    odd = F.col("event_id") % 2
    return events(spark, sf_dir).select("event_id", M.both(M.truth(F.col("value") > 50), odd).alias("a"), M.either(M.truth(F.col("value") > 90), F.col("event_id") % 3).alias("b"), M.negated(odd).alias("c"), M.larger(F.col("value"), 40).alias("d"), M.smaller(F.col("value"), 40).alias("e"))


@query("SELECT event_id, round(sin(value), 6) AS a, round(cos(value), 6) AS b, round(atan(value), 6) AS c, round(sqrt(abs(value)), 6) AS d, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS e FROM events")
def expr_trig(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", *(rounded(x, 6).alias(n) for n, x in zip("abcd", (F.sin(v), F.cos(v), F.atan(v), F.sqrt(F.abs(v))), strict=True)), F.when(v > 0, rounded(M.log(v), 6)).alias("e"))


@query("SELECT event_id, floor(value * 10 + 0.5) / 10 AS a, floor((event_id - 50) / 2.0 + 0.5) AS b, floor(value) AS c, ceil(value) AS d FROM events")
def expr_round(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", M.round_half_up(v, 1).alias("a"), M.round_half_up((F.col("event_id") - 50) / 2, 0).alias("b"), F.floor(v).cast("double").alias("c"), F.ceil(v).cast("double").alias("d"))


@query("SELECT event_id, CAST(second(ts) AS DOUBLE) AS s, CAST(minute(ts) AS DOUBLE) AS mi, CAST(hour(ts) AS DOUBLE) AS h, CAST(day(ts) AS DOUBLE) AS d, CAST(month(ts) - 1 AS DOUBLE) AS mo, CAST(year(ts) AS DOUBLE) AS y, CAST(dayofweek(ts) AS DOUBLE) AS w FROM events")
def expr_date(spark, sf_dir):
    ms = F.floor(tabular.micros("ts") / 1000)
    f = {"s": M.seconds, "mi": M.minutes, "h": M.hours, "d": M.day, "mo": M.month, "y": M.year, "w": M.day_of_week}
    return events(spark, sf_dir).select("event_id", *(fn(ms).alias(n) for n, fn in f.items()))


@query("""SELECT event_id, round(value * 2 + 3 - value ^ 2 / 7, 4) AS a, CASE WHEN event_id % 5 = 0 AND value > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS b, CASE WHEN value > 50 THEN round(ln(value - 50), 6) ELSE -1.0 END AS c,
CASE WHEN event_id % 7 = 0 OR event_id % 3 = 0 AND value < 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS d, floor(-value / 3 + 0.5) AS e FROM events""")
def expr_text(spark, sf_dir):
    texts = {"a": "value * 2 + 3 - value ^ 2 / 7", "b": "value / (event_id % 5) > 1000000", "c": "IF(LOG(value - 50) > -1000000, LOG(value - 50), -1)", "d": "event_id % 7 = 0 || event_id % 3 = 0 && value < 20", "e": "ROUND(-value / 3, 0)"}
    out = {k: expression.compiled(t) for k, t in texts.items()}
    return events(spark, sf_dir).select("event_id", *((rounded(c, {"a": 4, "c": 6}[k]) if k in "ac" else c).alias(k) for k, c in out.items()))


@query("SELECT o_orderkey AS id, round(o_totalprice * 0.9 + 5, 4) AS net FROM orders")
def derived_attribute(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return traverse.derived(o, "net", rounded(F.col("price") * 0.9 + 5)).select("id", "net")


@query("SELECT s_suppkey AS id, s_acctbal AS x, 0 AS branch FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, -s_acctbal, 1 FROM supplier WHERE s_acctbal < 0")
def pipe_flat(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return traverse.pipe(s, lambda d: d.where("x > 5000"), lambda d: d.where("x < 0").withColumn("x", -F.col("x")))


@query("SELECT o_custkey AS id, o_orderkey AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS i FROM orders")
def map_index(spark, sf_dir):
    return traverse.numbered(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("item")), ["item"], ["id"])


@query("SELECT n_nationkey AS id, CAST(i AS INTEGER) AS i, n_nationkey * i AS x FROM nation, generate_series(2, 5) t(i)")
def loop_cross(spark, sf_dir):
    return traverse.loop(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), 2, 5).withColumn("x", F.col("id").cast("long") * F.col("i"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal >= 4000 THEN 'high' ELSE 'low' END AS band FROM supplier")
def if_else(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") >= 4000, "high").otherwise("low").alias("band"))


@query("WITH RECURSIVE r AS (SELECT s_suppkey AS id, CAST(s_suppkey + 1 AS BIGINT) AS x FROM supplier UNION ALL SELECT id, x * 3 FROM r WHERE x < 1000) SELECT id, max(x) AS x FROM r GROUP BY id")
def while_do(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1).cast("long").alias("x"))
    return traverse.while_do(s, lambda d: not d.where("x < 1000").isEmpty(), lambda d: d.withColumn("x", F.when(F.col("x") < 1000, F.col("x") * 3).otherwise(F.col("x"))))


@query("SELECT id, item FROM (SELECT o_custkey AS id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 3")
def get_element(spark, sf_dir):
    return map_index(spark, sf_dir).where("i = 2").select("id", "item")


# --- spatial ------------------------------------------------------------------


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("key"))


def _asked(points: DataFrame) -> DataFrame:
    return points.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("key").alias("q"))


_PAIRS = """WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS key FROM embeddings),
d AS (SELECT q.id AS query_id, c.id AS point_id, {distance} AS distance FROM p q JOIN p c ON q.id % 50 = 0)"""
_EUCLID = "sqrt(list_sum(list_transform(list_zip(c.key, q.key), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_COSINE = "1 - greatest(0.0, list_cosine_similarity(c.key, q.key))"
_RANKED = " SELECT query_id, point_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS INTEGER) AS rank FROM d{where}) WHERE rank <= {k}"


@query(_PAIRS.format(distance=_EUCLID) + _RANKED.format(where="", k=8))
def knn_around(spark, sf_dir):
    p = _points(spark, sf_dir)
    return spatial.around(p, _asked(p), k=8).select("query_id", "point_id", "rank")


@query(_PAIRS.format(distance=_EUCLID) + " SELECT query_id, point_id FROM d WHERE distance < 1.2")
def radius(spark, sf_dir):
    p = _points(spark, sf_dir)
    return spatial.radius_by_grid(p, _asked(p), 1.2).select("query_id", "point_id")


@query(_PAIRS.format(distance=_EUCLID) + _RANKED.format(where=" WHERE distance < 1.25", k=4))
def bounded_radius(spark, sf_dir):
    p = _points(spark, sf_dir)
    return spatial.around(p, _asked(p), k=4, radius=1.25).select("query_id", "point_id", "rank")


@query("SELECT vec_id AS point_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN 0.0 AND 0.2")
def area(spark, sf_dir):
    return spatial.area(_points(spark, sf_dir), [-0.1, 0.0], [0.1, 0.2]).select("point_id")


def _distance(f):
    def run(spark, sf_dir):
        p = _points(spark, sf_dir)
        return spatial.all_distances(p, _asked(p), f, 6)

    return run


_PEARSON = """(list_sum(list_transform(list_zip(c.key, q.key), lambda z: z[1] * z[2])) - list_sum(c.key) * list_sum(q.key) / 64) /
 sqrt((list_sum(list_transform(c.key, lambda x: x * x)) - list_sum(c.key) ** 2 / 64) * (list_sum(list_transform(q.key, lambda x: x * x)) - list_sum(q.key) ** 2 / 64))"""
for _name, _f, _sql in (("dist_euclid", distances.euclidean, _EUCLID), ("dist_cosine", distances.cosine, _COSINE), ("dist_pearson", distances.pearson, _PEARSON)):
    QUERIES[_name] = _distance(_f)
    ORACLES[_name] = _PAIRS.format(distance=_sql) + " SELECT query_id, point_id, round(distance, 6) AS distance FROM d"


@query("SELECT s_suppkey AS id, round(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(s_nationkey * 3 - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(s_nationkey * 3)) * pow(sin(radians(s_suppkey % 90 - 2.0) / 2), 2)))), 1) AS metres FROM supplier")
def dist_geo(spark, sf_dir):
    here = F.array((F.col("s_nationkey") * 3).cast("double"), (F.col("s_suppkey") % 90).cast("double"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), rounded(distances.geo(F.array(F.lit(48.0), F.lit(2.0)), here), 1).alias("metres"))


@query("SELECT event_id, round(sqrt(greatest((value - 50) ** 2 / 4.0, ((event_id % 24) - 12) ** 2 / 9.0)), 6) AS d FROM events")
def dist_gauss(spark, sf_dir):
    x = F.array(F.col("value"), (F.col("event_id") % 24).cast("double"))
    return events(spark, sf_dir).select("event_id", rounded(distances.gaussian(x, F.array(F.lit(50.0), F.lit(12.0)), F.array(F.lit(4.0), F.lit(9.0))), 6).alias("d"))


@query("SELECT CAST(floor(value / 25.0) AS BIGINT) AS cell0, CAST(floor(hour(ts) / 6.0) AS BIGINT) AS cell1, sum(1) AS n, CAST(sum(event_id) AS BIGINT) AS weight FROM events GROUP BY ALL")
def tree_profile(spark, sf_dir):
    p = events(spark, sf_dir).select(F.array(F.col("value"), F.hour("ts").cast("double")).alias("key"), "event_id")
    return spatial.tree_profile(p, [0.0, 0.0], [25.0, 6.0], "event_id")


# --- profiles -----------------------------------------------------------------


@query("SELECT event_type, count(value) AS total, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(coalesce(stddev_samp(value), 0), 4) AS std FROM events GROUP BY event_type")
def gauss_profile(spark, sf_dir):
    return profile.gaussian(events(spark, sf_dir), "value", "event_type").withColumn("avg", rounded("avg")).withColumn("std", rounded("std"))


@query("SELECT count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE value NOT BETWEEN 5 AND 60) AS rejected, count(*) FILTER (WHERE value BETWEEN 5 AND 60) AS accepted, min(value) FILTER (WHERE value BETWEEN 5 AND 60) AS min, max(value) FILTER (WHERE value BETWEEN 5 AND 60) AS max, round(avg(value) FILTER (WHERE value BETWEEN 5 AND 60), 4) AS avg FROM events")
def bounded_profile(spark, sf_dir):
    return profile.bounded(events(spark, sf_dir), "value", 5, 60).withColumn("avg", rounded("avg"))


@query(f"WITH {VER} SELECT CAST(floor((time % {DAY}) / {DAY // 4}) AS BIGINT) AS slot, count(value) AS total, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(coalesce(stddev_samp(value), 0), 4) AS std FROM ver GROUP BY 1")
def gauss_slots(spark, sf_dir):
    return profile.slots(versions(spark, sf_dir), "value", "time", DAY, 4).withColumn("avg", rounded("avg")).withColumn("std", rounded("std"))


@query("SELECT CASE WHEN grouping(s) = 1 THEN NULL ELSE s END AS slot, count(value) AS total, round(avg(value), 4) AS avg FROM (SELECT user_id % 3 + 3 * (event_id % 4) AS s, value FROM events) GROUP BY CUBE (s)")
def gauss_slot_array(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("a", F.col("user_id") % 3).withColumn("b", F.col("event_id") % 4)
    return profile.slot_array(e, "value", ["a", "b"], [3, 4]).withColumn("avg", rounded("avg"))


@query("SELECT event_type, count(value) AS total, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(coalesce(stddev_samp(value), 0), 4) AS std FROM events GROUP BY event_type")
def merged_profile(spark, sf_dir):
    days = profile.sums(events(spark, sf_dir).withColumn("day", F.to_date("ts")), "value", "event_type", "day")
    return profile.finished(profile.merged(days, "event_type")).select("event_type", "total", "min", "max", rounded("avg").alias("avg"), rounded("std").alias("std"))


@query("SELECT CAST(level AS INTEGER) AS level, CAST(floor(value / (40.0 / pow(2, level))) AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 4) AS mean, round(coalesce(var_samp(value), 0), 3) AS cov FROM events, generate_series(0, 2) t(level) GROUP BY ALL")
def cell_mixture(spark, sf_dir):
    cells = profile.cell_mixture(events(spark, sf_dir), ["value"], [0.0], [40.0], 3)
    return cells.select("level", F.col("cell")[0].alias("cell"), "n", rounded(F.col("mean")[0]).alias("mean"), rounded(F.col("cov")[0], 3).alias("cov"))


_CC = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 3) AS cov, round(corr({a}, {b}), 5) AS corr FROM lineitem" for k, a in enumerate(_CC) for b in _CC[k:]))
def gauss_cov_corr(spark, sf_dir):
    return profile.covariance(table(spark, sf_dir, "lineitem"), _CC).select("i", "j", rounded("cov", 3).alias("cov"), rounded("corr", 5).alias("corr"))


@query("SELECT CAST(least(floor(value / 10.0), 9) AS BIGINT) AS bin, count(*) AS n, 10.0 * (least(floor(value / 10.0), 9) + 0.5) AS center FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")
def histogram(spark, sf_dir):
    return profile.histogram(events(spark, sf_dir), "value", 0.0, 100.0, 10)


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 4) AS z, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 4) AS unit FROM events WINDOW w AS (PARTITION BY event_type)")
def normalise(spark, sf_dir):
    return profile.normalise(events(spark, sf_dir), "value", "event_type").select("event_id", rounded("z").alias("z"), rounded("unit").alias("unit"))


@query()
def p_value(spark, sf_dir):
    rows = profile.covariance(table(spark, sf_dir, "lineitem"), _CC).where("i <> j").collect()
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(r["i"], r["j"], float(r["corr"]), profile.p_value(r["corr"], n)) for r in rows], "i string, j string, corr double, p double")


@query()
def pca(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    means, components, _ = profile.pca(li, _CC, 2)
    return profile.project(li, _CC, means, components).select("l_orderkey", "l_linenumber", "pc0", "pc1")


@query()
def neural_net(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100_000).alias("p"), F.col("l_discount").alias("d"))
    net = neural.Network.of([2, 6, 1], ["tanh", "linear"])
    neural.learn(li, ["q", "d"], ["p"], net, rounds=8)
    return neural.predict(li, ["q", "d"], net).select("l_orderkey", "l_linenumber", F.col("prediction")[0].alias("p"))


# --- series -------------------------------------------------------------------


@query(f"WITH {VER} SELECT id, time, round(value - lag(value) OVER w - (lag(value) OVER w - lag(value, 2) OVER w), 4) AS d FROM ver WINDOW w AS (PARTITION BY id ORDER BY time) QUALIFY row_number() OVER w > 2")
def series_diff(spark, sf_dir):
    return series.difference(versions(spark, sf_dir), "value", 2).select("id", "time", rounded("d").alias("d"))


@query(f"WITH {VER}, p AS (SELECT id, value, lag(value, 3) OVER (PARTITION BY id ORDER BY time) AS y FROM ver) SELECT id, count(*) AS n, round(corr(value, y), 5) AS r FROM p WHERE y IS NOT NULL GROUP BY id HAVING count(*) > 2")
def series_autocorr(spark, sf_dir):
    return series.autocorrelation(versions(spark, sf_dir), "value", 3).where("n > 2").select("id", "n", rounded("r", 5).alias("r"))


@query(f"""WITH {VER}, r AS (SELECT id, value AS v, row_number() OVER (PARTITION BY id ORDER BY time) - 1 AS i FROM ver), e AS (SELECT id, v, p AS period, i % p AS ph, i // p AS c FROM r, generate_series(3, 6) t(p)),
w AS (SELECT *, count(*) OVER (PARTITION BY id, period, c) AS n FROM e), k AS (SELECT * FROM w WHERE n = period), f AS (SELECT id, period, ph, sum(v) AS f FROM e GROUP BY ALL),
x AS (SELECT id, period, c, corr(v, f) AS r FROM k JOIN f USING (id, period, ph) GROUP BY ALL) SELECT id, CAST(period AS INTEGER) AS period, round(avg(coalesce(r, 0)), 5) AS score FROM x GROUP BY ALL""")
def periodicity(spark, sf_dir):
    return series.periodicity(versions(spark, sf_dir), "value", 3, 6).select("id", "period", rounded("score", 5).alias("score"))


@query("SELECT user_id AS id, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x), 4) AS intercept FROM (SELECT user_id, value, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS x FROM events) GROUP BY user_id HAVING count(*) > 2")
def poly_fit(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("x", (F.col("time") - 1_704_067_200_000_000) / float(DAY))
    many = v.groupBy("id").agg(F.count("*").alias("n")).where("n > 2").select("id")
    return series.linear_fit(v.join(many, "id"), "x", "value").select("id", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("""SELECT user_id AS id, round(regr_slope(value, x) * 40 + regr_intercept(value, x), 3) AS fitted, round(sqrt(greatest(0, regr_syy(value, x) * (1 - regr_r2(value, x))) / count(*)), 3) AS rmse
FROM (SELECT user_id, value, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS x FROM events) GROUP BY user_id HAVING count(*) > 2""")
def poly_extrapolate(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("x", (F.col("time") - 1_704_067_200_000_000) / float(DAY))
    fits = series.polynomial_fit(v, "x", "value", 1).where("n > 2")
    return series.extrapolate(fits, fits.select("id", "rmse").withColumn("x", F.lit(40.0)).select("id", "x"), "x").join(fits.select("id", "rmse"), "id").select("id", rounded("fitted", 3).alias("fitted"), rounded("rmse", 3).alias("rmse"))


@query(f"WITH {VER}, p AS (SELECT id, k AS lag, value AS x, lag(value, CAST(k AS INTEGER)) OVER (PARTITION BY id, k ORDER BY time) AS y FROM ver, generate_series(0, 2) t(k)) SELECT id, CAST(lag AS INTEGER) AS lag, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY ALL")
def series_lags(spark, sf_dir):
    return series.autocorrelation_function(versions(spark, sf_dir), "value", 3).select("id", "lag", "n")


@query()
def poly_compress(spark, sf_dir):
    return series.compress(versions(spark, sf_dir), "value", precision=5.0, max_degree=6)


@query(f"""WITH {VER}, q AS (SELECT id, time, value, quantile_cont(value, 0.25) OVER w AS a, quantile_cont(value, 0.75) OVER w AS b FROM ver WINDOW w AS (PARTITION BY id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT id, time, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS outlier FROM q""")
def iqr_outliers(spark, sf_dir):
    return series.outliers(versions(spark, sf_dir), "value", 10).select("id", "time", "outlier")


# --- sources ------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) AS time, 'kind' AS attribute, event_type AS value, 'STRING' AS type FROM events")
def json_ingest(spark, sf_dir):
    messages = events(spark, sf_dir).select(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), tabular.micros("ts").alias("time"), F.struct(F.struct(F.col("event_type").alias("value"), F.lit("STRING").alias("type")).alias("kind")).alias("values"))).alias("value")
    )
    return tabular.parse_updates(messages)


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, part FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos, p FROM (SELECT doc_id, string_split_regex(text, '\\n') AS p FROM documents)) WHERE pos < coalesce(list_max(list_transform(p, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)), 0)")
def read_lines_split(spark, sf_dir):
    return tabular.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "\n").select("doc_id", "pos", "part")
