"""All queries of the engine on the test tables, with their SQL twins.

The domain's tables are mapped onto the test tables: agents are users, orders or customers; edges, nodes, cells and layers
are keys of the other tables. Computed doubles are rounded on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowengine.functions import expressions as X
from flowengine.operators import aoi, graph, passage, polygons, population, raster, scenario, simulate, spatial, species
from flowengine.plans import workflow
from flowengine.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- passage -------------------------------------------------------------------------------------------------------

EVENT_NODES = "CASE event_type {} END"


@query("""SELECT edge AS edge_id, count(DISTINCT l_orderkey) AS n FROM (SELECT l_orderkey, l_suppkey * 50 + l_partkey % 50 AS edge FROM lineitem) GROUP BY 1""")
def edge_passage(spark, d):
    visits = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 50 + F.col("l_partkey") % 50).alias("edge_id"))
    return passage.visits_passage(visits, "l_orderkey", "edge_id")


@query("""SELECT s AS edge_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1""")
def edge_passage_arrays(spark, d):
    hist = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("prior_e"))
    return passage.edge_passage(hist)


_FAMILIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH v AS (SELECT DISTINCT l_orderkey, o_orderpriority AS f, l_suppkey AS edge_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT edge_id, count(*) AS passage, count(*) FILTER (f = '1-URGENT') AS p1, count(*) FILTER (f = '2-HIGH') AS p2, count(*) FILTER (f = '3-MEDIUM') AS p3,
count(*) FILTER (f = '4-NOT SPECIFIED') AS p4, count(*) FILTER (f = '5-LOW') AS p5 FROM v GROUP BY 1""")
def edge_passage_by_family(spark, d):
    hist = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("prior_e"))
    hist = hist.join(t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family")), "o_orderkey")
    out = passage.family_passage(hist, families=_FAMILIES)
    return out.withColumnsRenamed({f"passage_{f}": f"p{f[0]}" for f in _FAMILIES})


@query("SELECT event_type AS node_id, count(*) AS n FROM events GROUP BY 1")
def node_passage_multiplicity(spark, d):
    hist = t(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") >= 0.5, F.col("event_type"))).alias("prior_v"), F.collect_list(F.when(~(F.col("value") >= 0.5) | F.col("value").isNull(), F.col("event_type"))).alias("retraced_v"))
    return passage.node_passage(hist, "prior_v", "retraced_v")


_FAM = "CASE l_orderkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'dog' WHEN 2 THEN 'bike' ELSE 'jog' END"
_COUNTS = ", ".join(f"coalesce(count(*) FILTER ({c}), 0) AS {n}" for n, c in [("passage", "true"), ("passage_aoi", "a = 1")] + [(f"passage_{f}{s}", f"f = '{f}'{x}") for f in X.FAMILIES for s, x in (("", ""), ("_aoi", " AND a = 1"))])


def _histories(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("prior_e"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("prior_e_aoi")).withColumn("family", F.expr(_FAM))


@query(f"""WITH h AS (SELECT DISTINCT l_orderkey, {_FAM} AS f, l_suppkey AS e, 0 AS a FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, {_FAM}, l_suppkey, 1 FROM lineitem WHERE l_returnflag = 'R')
SELECT s_suppkey AS edge_id, {_COUNTS.replace('FILTER (true)', 'FILTER (e IS NOT NULL)')} FROM supplier LEFT JOIN h ON e = s_suppkey GROUP BY 1""")
def passage_combine(spark, d):
    edges = t(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"))
    return passage.combined_passage(edges, _histories(spark, d))


@query("""WITH e AS (SELECT o_orderkey AS edge_id, o_custkey % 50 AS a, o_orderkey % 50 AS b, CAST(floor(o_totalprice / 1000) AS BIGINT) AS p FROM orders)
SELECT edge_id, CASE WHEN a IN (3, 7) OR b IN (3, 7) THEN p ELSE 0 END AS passage_aoi2 FROM e""")
def passage_aoi_incident(spark, d):
    edges = t(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") % 50).alias("from"), (F.col("o_orderkey") % 50).alias("to"), F.floor(F.col("o_totalprice") / 1000).alias("passage"))
    nodes = spark.createDataFrame([(3,), (7,)], "node_id long")
    return passage.incident_passage(edges, nodes).select("edge_id", "passage_aoi2")


def _moves(spark, d):
    return passage.trajectory_edges(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "from", event_type AS "to" FROM events QUALIFY "from" IS NOT NULL""")
def trajectory_edges(spark, d):
    return _moves(spark, d)


@query("""WITH m AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events),
e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM m WHERE a IS NOT NULL), i AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS edge_id FROM e)
SELECT i.edge_id, count(DISTINCT user_id) AS n FROM m JOIN i ON least(m.a, m.b) = i.a AND greatest(m.a, m.b) = i.b WHERE m.a IS NOT NULL GROUP BY 1""")
def trajectory_passage(spark, d):
    moves = _moves(spark, d)
    ends = moves.select(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to")).distinct()
    edges = graph.dense_ids(ends, ["from", "to"], "edge_id")
    return passage.visits_passage(passage.match_edges(moves, edges), "user_id", "edge_id")


@query("""SELECT s_suppkey AS edge_id, round(2 + 2.0 * (s_acctbal / (SELECT max(s_acctbal) FROM supplier)), 6) AS width FROM supplier""")
def line_style(spark, d):
    edges = t(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.col("s_acctbal").alias("passage"))
    return passage.line_style(edges, "passage", "passage").select("edge_id", r6("width").alias("width"))


@query("""SELECT s_suppkey AS edge_id, count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 = 1) AS selected FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1""")
def selected_passage(spark, d):
    edges = t(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"))
    return passage.selected_passage(passage.combined_passage(edges, _histories(spark, d)), 3, True)


@query("SELECT c_custkey AS node_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def start_points(spark, d):
    nodes = t(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return passage.start_points(nodes, t(spark, d, "orders").select(F.col("o_custkey").alias("start_v")))


# ---- weights and times ---------------------------------------------------------------------------------------------

_W = "greatest(least(p_retailprice * (1 - CASE WHEN p_size <> 0 THEN 1.0 / (k / 45.2423 * p_size) END), p_retailprice), 10)"


@query(f"""SELECT p_partkey, weighting, round(CASE WHEN p_size = 0 THEN 10 ELSE {_W} END, 6) AS w FROM part, (VALUES ('distance', 8.0::DOUBLE), ('little_attr', 4.0::DOUBLE), ('mostly_attr', 2.0::DOUBLE)) AS v(weighting, k)""")
def weighted_lengths(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("duln"))
    return rows.select(*X.weightings(["p_partkey"], "p_retailprice", "duln", 11.0)).select("p_partkey", "x.weighting", r6("x.w").alias("w"))


_TYPES = list(X.SPEED)
_TYPE_SQL = "CASE {} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_TYPES)) + " END"
_SPEED_SQL = "CASE {} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(X.SPEED.values())) + " END"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice / ({_SPEED_SQL.format('l_linenumber % 7')} * 1000 / 60.0)) AS BIGINT) AS minutes,
CAST(ceil(ceil(l_extendedprice / ({_SPEED_SQL.format('l_linenumber % 7')} * 1000 / 60.0)) * 3) AS BIGINT) AS steps FROM lineitem""")
def travel_time(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), F.col("l_linenumber") % 7 + 1)
    rows = t(spark, d, "lineitem").withColumn("minutes", X.travel_minutes(F.col("l_extendedprice"), X.lookup(X.SPEED, kind)))
    return rows.select("l_orderkey", "l_linenumber", "minutes", X.timesteps(F.col("minutes"), "m").alias("steps"))


@query("""SELECT n_nationkey, chr(65 + n_nationkey) AS label, CASE WHEN n_nationkey + 25 <= 26 THEN chr(n_nationkey + 89) ELSE chr(65 + CAST(floor((n_nationkey - 2) / 26) AS INT)) || chr(65 + (n_nationkey - 2) % 26) END AS later FROM nation""")
def aoi_labels(spark, d):
    n = F.col("n_nationkey")
    return t(spark, d, "nation").select("n_nationkey", X.aoi_label(n + 1).alias("label"), X.aoi_label(n + 25).alias("later"))


# ---- choices -------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS duln FROM customer GROUP BY 1),
r AS (SELECT c_custkey AS agent_id, o.n_nationkey AS node_id, duln, o.n_nationkey % 5 = 0 AS visited, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE -2.0 END * (o.n_nationkey % 2) AS bonus
  FROM customer JOIN nation h ON c_nationkey = h.n_nationkey JOIN nation o ON o.n_regionkey = h.n_regionkey AND o.n_nationkey <> h.n_nationkey LEFT JOIN b ON b.k = o.n_nationkey)
SELECT agent_id, node_id, round(CASE WHEN visited AND count(*) OVER w > 1 THEN 1e-5 ELSE exp((coalesce(duln, 0) + bonus) / 0.5) / sum(exp((coalesce(duln, 0) + bonus) / 0.5)) OVER w END, 6) AS p FROM r WINDOW w AS (PARTITION BY agent_id)""")
def route_choice_probs(spark, d):
    customer, nation = t(spark, d, "customer"), t(spark, d, "nation")
    duln = customer.groupBy(F.col("c_nationkey").alias("node_id")).agg((F.avg("c_acctbal") / 1000).alias("duln"))
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    other = nation.select(F.col("n_nationkey").alias("node_id"), "n_regionkey")
    routes = customer.join(home, "c_nationkey").join(other, "n_regionkey").where("node_id <> c_nationkey").join(duln, "node_id", "left")
    k = F.col("agent_id") % 3
    bonus = F.when(k == 0, 1.0).when(k == 1, 0.0).otherwise(-2.0) * (F.col("node_id") % 2)
    p = X.route_probability(F.col("duln"), bonus, F.col("node_id") % 5 == 0, "agent_id")
    return routes.withColumnRenamed("c_custkey", "agent_id").select("agent_id", "node_id", r6(p).alias("p"))


def _e(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


@query(f"""WITH a AS (SELECT vec_id, abs(atan2({_e(4)} - {_e(2)}, {_e(3)} - {_e(1)}) - atan2({_e(4)} - {_e(6)}, {_e(3)} - {_e(5)}) * 180 / {X.PI_AS_WRITTEN}) AS x FROM embeddings),
f AS (SELECT vec_id, CASE WHEN x > 180 THEN 360 - x ELSE x END AS x FROM a)
SELECT vec_id, round(x, 6) AS angle, CASE WHEN x <= 45 THEN 1.0 WHEN x <= 90 THEN 0.0 ELSE -2.0 END::DOUBLE AS bonus FROM f""")
def direction_bonus(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(6)]
    a = X.angle(*e)
    return t(spark, d, "embeddings").select("vec_id", r6(a).alias("angle"), X.direction_bonus(a).alias("bonus"))


_REACHED_SQL = f"""SELECT c_custkey AS agent_id, r_name AS aoi, CAST(r_regionkey AS BIGINT) AS node_id, CAST(500 + (c_custkey * 37 + r_regionkey * 911) % 3000 AS DOUBLE) AS distance, CAST(10 + r_regionkey * 7 AS DOUBLE) AS duln,
(r_regionkey + 1) * 250000.0::DOUBLE AS area, {_SPEED_SQL.format('c_custkey % 7')} AS speed, CASE c_custkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 120 WHEN 3 THEN 180 ELSE 240 END AS duration FROM customer, region"""
_UTILITY_SQL = f"""WITH x AS ({_REACHED_SQL}), g AS (SELECT min(duln) AS dl, max(duln) AS dh, min(duration) AS tl, max(duration) AS th FROM x),
y AS (SELECT *, greatest(distance / (speed * 1000), 0.01) AS hours, least(sqrt(area), 7000) AS size, min(distance) OVER (PARTITION BY agent_id) AS near, max(distance) OVER (PARTITION BY agent_id) AS far FROM x, g),
z AS (SELECT *, CASE WHEN hours <= 0.1 * duration / 60 THEN 3.23695 * (9 * (duln * size / duration - dl * 316 / th) / (dh * 15000 / tl - dl * 316 / th) + 1) - 6.65703 * (9 * (hours / duration - near / 20000 / th) / (far / 2000 / tl - near / 20000 / th) + 1) END AS u FROM y),
p AS (SELECT *, coalesce(exp(u) / sum(exp(u)) OVER (PARTITION BY agent_id), 0) AS p FROM z)"""


def _reached(spark, d):
    c, r = F.col("c_custkey"), F.col("r_regionkey")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (c % 7 + 1).cast("int"))
    rows = t(spark, d, "customer").join(F.broadcast(t(spark, d, "region")), how="cross")  # the five areas to every agent
    return rows.select(
        c.alias("agent_id"), F.col("r_name").alias("aoi"), r.cast("long").alias("node_id"), (500 + (c * 37 + r * 911) % 3000).cast("double").alias("distance"), (10 + r * 7).cast("double").alias("duln"),
        ((r + 1) * 250000.0).alias("area"), X.lookup(X.SPEED, kind).alias("speed"), F.element_at(F.array(*map(F.lit, X.DURATIONS)), (c % 5 + 1).cast("int")).alias("duration"),
    )


@query(_UTILITY_SQL + " SELECT agent_id, aoi, round(u, 6) AS u, round(p, 6) AS p FROM p")
def aoi_utility_probs(spark, d):
    return population.aoi_utility(_reached(spark, d)).select("agent_id", "aoi", r6("u").alias("u"), r6("p").alias("p"))


def _u(label: str, key: str, seed: int = 1) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{label}', CAST({key} AS VARCHAR))), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


@query(_UTILITY_SQL + f""", q AS (SELECT *, sum(p) OVER (PARTITION BY agent_id ORDER BY aoi) AS upto, sum(p) OVER (PARTITION BY agent_id) AS top FROM p WHERE p > 0),
s AS (SELECT agent_id, arg_min(node_id, aoi) AS goal_v, min(aoi) AS aoi_goal FROM q WHERE {_u('aoi', 'agent_id')} * top < upto GROUP BY 1)
SELECT c_custkey AS agent_id, coalesce(goal_v, -1) AS goal_v, coalesce(aoi_goal, 'NO_GOAL') AS aoi_goal FROM customer LEFT JOIN s ON agent_id = c_custkey""")
def aoi_draw_seeded(spark, d):
    return population.drawn_aoi(population.aoi_utility(_reached(spark, d)))


def _pick_sql(u: str, values: list, weights) -> str:
    below, cases = 0.0, []
    for v, w in list(zip(values, weights))[:-1]:
        below += w
        cases.append(f"WHEN {u} < {below / sum(weights)!r} THEN {v!r}")
    return f"CASE {' '.join(cases)} ELSE {values[-1]!r} END"


_TYPE_DRAW = _pick_sql(_u("type", "c_custkey"), list(X.TYPE_WEIGHT), list(X.TYPE_WEIGHT.values()))


def _agents(spark, d):
    return population.with_type(t(spark, d, "customer").select(F.col("c_custkey").alias("agent_id")))


@query(f"SELECT c_custkey AS agent_id, {_TYPE_DRAW} AS agent_type FROM customer")
def population_types(spark, d):
    return _agents(spark, d)


_DUR_CASES = " ".join(f"WHEN '{k}' THEN {_pick_sql(_u('duration', 'agent_id'), list(X.DURATIONS), w)}" for k, w in X.DURATION_WEIGHT.items())
_SPEED_OF = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SPEED.items())


@query(f"""WITH a AS (SELECT c_custkey AS agent_id, {_TYPE_DRAW} AS agent_type FROM customer)
SELECT agent_id, agent_type, CASE agent_type {_DUR_CASES} END AS time_ext, CASE agent_type {_SPEED_OF} END AS speed FROM a""")
def population_durations(spark, d):
    return population.with_duration(_agents(spark, d))


_MASS_SQL = "SELECT s_suppkey AS node_id, s_acctbal AS m FROM supplier WHERE s_acctbal > 0"


@query(f"""WITH m AS ({_MASS_SQL}), c AS (SELECT node_id, sum(m) OVER (ORDER BY node_id) AS upto, sum(m) OVER () AS total FROM m),
a AS (SELECT c_custkey AS agent_id, {_u('start_v', 'c_custkey')} * (SELECT max(total) FROM c) AS x FROM customer)
SELECT agent_id, (SELECT min(node_id) FROM c WHERE upto > x) AS start_v FROM a""")
def start_node_draw(spark, d):
    nodes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("residents"), F.lit(0.0).alias("new_residential"), F.lit(0.0).alias("parking"), F.lit(1.0).alias("parking_attr"))
    return population.drawn_nodes(t(spark, d, "customer").select(F.col("c_custkey").alias("agent_id")), population.node_mass(nodes))


# ---- rasters and species -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_brand, l_extendedprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY l_extendedprice DESC) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, round((median(v) FILTER (rn <= greatest(1, n // 4)) + median(v)) / 2, 6) AS blend FROM r GROUP BY 1""")
def top_quartile_blend(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_extendedprice").join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return raster.top_quartile_blend(rows, "p_brand", "l_extendedprice").select("p_brand", r6("blend").alias("blend"))


def _layers(spark, d):
    rows = t(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").alias("cell"), (F.col("l_suppkey") % 10).alias("layer"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("value"))


@query("""SELECT l_partkey AS cell, round(CASE WHEN count(*) FILTER (l_linenumber = 7) = 0 THEN sum(l_quantity * (l_suppkey % 10 + 1)) END, 6) AS sensitivity FROM lineitem GROUP BY 1""")
def sensitivity_matrix(spark, d):
    weights = spark.range(10).select(F.col("id").alias("layer"), (F.col("id") + 1).alias("weight"))
    return raster.sensitivity(_layers(spark, d), weights).select("cell", r6("sensitivity").alias("sensitivity"))


@query("""SELECT l_suppkey % 10 AS layer, round(sum(l_quantity) FILTER (l_linenumber <> 7), 6) AS cover FROM lineitem GROUP BY 1 HAVING cover > 0""")
def layer_cover(spark, d):
    return raster.layer_cover(_layers(spark, d)).select("layer", r6("cover").alias("cover"))


@query("""SELECT l_suppkey % 10 AS layer, min(l_quantity) FILTER (l_linenumber <> 7) AS low, max(l_quantity) FILTER (l_linenumber <> 7) AS high FROM lineitem GROUP BY 1""")
def layer_range(spark, d):
    return raster.layer_range(_layers(spark, d))


_THREAT = "CASE p_size % 6 WHEN 0 THEN 'CR' WHEN 1 THEN 'EN' WHEN 2 THEN 'VU' WHEN 3 THEN 'NT' WHEN 4 THEN 'LC' ELSE 'DD' END"
_PRIORITY = "CASE p_size % 5 WHEN 0 THEN 'PR1' WHEN 1 THEN 'PR2' WHEN 2 THEN 'PR3' WHEN 3 THEN 'PR4' ELSE '' END"


def _species(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("species"), F.expr(_THREAT).alias("threat"), F.expr(_PRIORITY).alias("ch_priority"))


@query(f"""WITH s AS (SELECT p_partkey AS species, {_THREAT} AS t, {_PRIORITY} AS p FROM part)
SELECT 's4' AS code, species FROM s WHERE p IN ('PR1', 'PR2', 'PR3') UNION ALL SELECT 's8', species FROM s WHERE t IN ('CR', 'EN', 'VU') UNION ALL SELECT 's1', species FROM s""")
def species_filter(spark, d):
    s = _species(spark, d)
    a, b, c = (species.filtered(s, code).select(F.lit(code).alias("code"), "species") for code in ("s4", "s8", "s1"))
    return a.unionByName(b).unionByName(c)


@query(f"""WITH s AS (SELECT p_partkey AS species, {_THREAT} AS t, {_PRIORITY} AS p FROM part)
SELECT species, CASE t WHEN 'CR' THEN 5 WHEN 'EN' THEN 4 WHEN 'VU' THEN 3 WHEN 'NT' THEN 2 WHEN 'LC' THEN 1 END AS by_threat, CASE p WHEN 'PR1' THEN 5 WHEN 'PR2' THEN 4 WHEN 'PR3' THEN 3 WHEN 'PR4' THEN 2 ELSE 1 END AS by_priority FROM s""")
def species_weights(spark, d):
    x = species.weighted(species.weighted(_species(spark, d)).withColumnRenamed("weight", "by_threat"), "priority")
    return x.select("species", "by_threat", F.col("weight").alias("by_priority"))


@query("""WITH m AS (SELECT p_partkey AS species, p_brand AS g FROM part UNION SELECT p_partkey, p_type FROM part), s AS (SELECT p_partkey AS species FROM part WHERE p_size > 10)
SELECT species FROM s WHERE species NOT IN (SELECT species FROM m WHERE g IN (SELECT min(p_brand) FROM part)) UNION SELECT species FROM m WHERE g IN (SELECT max(p_type) FROM part)""")
def species_toggles(spark, d):
    part = t(spark, d, "part")
    low, high = part.agg(F.min("p_brand"), F.max("p_type")).first()
    members = part.select(F.col("p_partkey").alias("species"), F.explode(F.array("p_brand", "p_type")).alias("group"))
    return species.toggled(part.where("p_size > 10").select(F.col("p_partkey").alias("species")), members, [high], [low])


@query("SELECT c_custkey, c_acctbal / count(*) OVER (PARTITION BY c_nationkey) AS share FROM customer")
def cell_mass_spread(spark, d):
    return raster.spread_mass(t(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "share").select("c_custkey", "share")


def _grid(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.col("p_retailprice").alias("value"))


@query("""WITH g AS (SELECT CAST(floor(p_partkey / 50) AS INT) AS r, p_partkey % 50 AS c, p_retailprice AS value FROM part)
SELECT c_custkey, value FROM customer LEFT JOIN g ON r = CAST(floor((400.0 - c_custkey % 400 * 0.99) / 10.0) AS INT) AND c = CAST(floor(c_custkey % 47 * 12.5 / 10.0) AS INT)""")
def raster_sample(spark, d):
    k = F.col("c_custkey")
    points = t(spark, d, "customer").select(k, (k % 47 * 12.5).alias("x"), (k % 400 * 0.99).alias("y"))
    return raster.sampled(points, _grid(spark, d), 0.0, 400.0, 10.0).select("c_custkey", "value")


_COMPONENTS = """WITH RECURSIVE n AS ({nodes}), e AS ({edges}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, c) AS (SELECT v, v FROM n UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.v WHERE r.c < s.b), l AS (SELECT v, min(c) AS c FROM r GROUP BY 1)"""
_CELLS = _COMPONENTS.format(
    nodes="SELECT p_partkey AS v FROM part WHERE p_partkey * 7919 % 100 < 45",
    edges="SELECT x.v AS a, y.v AS b FROM (SELECT p_partkey AS v FROM part WHERE p_partkey * 7919 % 100 < 45) x JOIN (SELECT p_partkey AS v FROM part WHERE p_partkey * 7919 % 100 < 45) y ON y.v = x.v + 50 OR (y.v = x.v + 1 AND x.v % 50 <> 49)",
)


@query(_CELLS + " SELECT CAST(floor(v / 50) AS INT) AS \"row\", CAST(v % 50 AS INT) AS col, c AS component FROM l")
def raster_threshold_components(spark, d):
    k = F.col("p_partkey")
    grid = t(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (100 - k * 7919 % 100).alias("value"))
    return raster.cell_components(raster.thresholded(grid, 56).drop("value"), 50)


# ---- space ---------------------------------------------------------------------------------------------------------

_RINGS = {"A": [(-0.3, -0.3), (0.1, -0.3), (0.1, 0.1), (-0.3, 0.1)], "B": [(0.0, 0.0), (0.3, 0.05), (0.15, 0.3)], "C": [(-0.2, 0.05), (-0.05, 0.25), (-0.25, 0.3), (-0.3, 0.1)]}
_SIDES = ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, r in _RINGS.items() for (a, b), (c, e) in zip(r, r[1:] + r[:1]))


@query(f"""WITH s(aoi, ax, ay, bx, by_) AS (SELECT v.a, v.b::DOUBLE, v.c::DOUBLE, v.d::DOUBLE, v.e::DOUBLE FROM (VALUES {_SIDES}) AS v(a, b, c, d, e)), p AS (SELECT vec_id, {_e(1)} AS x, {_e(2)} AS y FROM embeddings),
h AS (SELECT vec_id, aoi FROM p, s WHERE (ay > y) <> (by_ > y) AND x < ax + (y - ay) / (by_ - ay) * (bx - ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT p.vec_id, coalesce(min(aoi), '0') AS aoi FROM p LEFT JOIN h USING (vec_id) GROUP BY 1""")
def point_in_polygon(spark, d):
    points = t(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    rings = spark.createDataFrame([(n, [(float(a), float(b)) for a, b in r]) for n, r in _RINGS.items()], "aoi string, ring array<struct<x: double, y: double>>")
    return spatial.points_in_polygons(points, rings, 0.1).select("vec_id", "aoi")


_XY = f"SELECT vec_id, {_e(1)} AS x, {_e(2)} AS y FROM embeddings"


def _points(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


_TARGETS = [(i, round(0.3 - 0.07 * i, 2), round(0.05 * i - 0.2, 2)) for i in range(9)]
_TARGET_SQL = "(SELECT v.a::BIGINT AS target, v.b::DOUBLE AS tx, v.c::DOUBLE AS ty FROM (VALUES " + ", ".join(map(str, _TARGETS)) + ") AS v(a, b, c))"


@query(f"""SELECT vec_id, target, round(d, 6) AS distance FROM (SELECT vec_id, target, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM ({_XY}), {_TARGET_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, target) = 1""")
def nearest_feature(spark, d):
    targets = spark.createDataFrame(_TARGETS, "target long, x double, y double")
    return spatial.nearest(_points(spark, d), targets, "vec_id", "target").withColumn("distance", r6("distance"))


@query(f"SELECT vec_id FROM ({_XY}) WHERE EXISTS (SELECT 1 FROM {_TARGET_SQL} WHERE (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 0.05 * 0.05)")
def within_distance(spark, d):
    return spatial.within_distance(_points(spark, d), spark.createDataFrame(_TARGETS, "target long, x double, y double"), 0.05).select("vec_id")


# ---- graphs --------------------------------------------------------------------------------------------------------

_WHOLE = "SELECT DISTINCT l_suppkey AS a, 10000000000 + l_partkey AS b FROM lineitem"
_WHOLE_NODES = f"SELECT a AS v FROM ({_WHOLE}) UNION SELECT b FROM ({_WHOLE})"


def whole_graph(spark, d):
    """(nodes, edges): every supplier and part of lineitem, joined where they occur together."""
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("from"), (F.col("l_partkey") + 10_000_000_000).alias("to")).distinct()
    return e.select(F.explode(F.array("from", "to")).alias("node_id")).distinct(), e


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS node_id FROM supplier")
def graph_dense_ids(spark, d):
    return graph.dense_ids(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "node_id").select("s_suppkey", "node_id")


@query(f"""WITH e AS ({_WHOLE}) SELECT a AS node_id, b AS neighbour FROM e UNION SELECT b, a FROM e UNION SELECT v, v FROM ({_WHOLE_NODES})""")
def neighbourhood_1hop(spark, d):
    nodes, edges = whole_graph(spark, d)
    return graph.neighbourhood(edges, nodes)


@query(f"WITH e AS ({_WHOLE}) SELECT a AS src, list_sort(list(b)) AS neighbours FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) GROUP BY 1")
def adjacency_lists(spark, d):
    return graph.adjacency(whole_graph(spark, d)[1]).select("src", F.transform("neighbours", lambda x: x["dst"]).alias("neighbours"))


_GRAPH = f"""WITH RECURSIVE n AS ({_WHOLE_NODES}), e AS ({_WHOLE}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
l(v, c) USING KEY (v) AS (SELECT v, v FROM n UNION SELECT s.b, min(l.c) FROM l JOIN s ON s.a = l.v JOIN recurring.l AS o ON o.v = s.b WHERE l.c < o.c GROUP BY 1)"""


@query(_GRAPH + ", z AS (SELECT c, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, c LIMIT 1) SELECT v AS node_id FROM l WHERE c = (SELECT c FROM z)")
def largest_component(spark, d):
    return graph.largest_component(*whole_graph(spark, d))[0].select("node_id")


@query("SELECT min(o_orderkey) AS component, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus ORDER BY n DESC, component LIMIT 10")
def component_sizes_top10(spark, d):
    """Orders, each linked to the one before of the same customer and status: as many components as there are such series."""
    o = t(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    edges = o.select(F.col("o_orderkey").alias("from"), before.alias("to")).where(F.col("to").isNotNull())
    return graph.component_sizes(graph.components(o.select(F.col("o_orderkey").alias("node_id")), edges)).orderBy(F.desc("n"), "component").limit(10)


@query(_GRAPH + " SELECT c AS component, count(*) AS n FROM l GROUP BY 1")
def whole_component_sizes(spark, d):
    return graph.component_sizes(graph.components(*whole_graph(spark, d)))


def whole_ring(spark, d):
    """(weights, n): a ring of all n suppliers, with chords 7 and about the root of n further on, so that its width grows with n."""
    supplier = t(spark, d, "supplier")
    n = supplier.count()
    s = F.col("s_suppkey")
    one = lambda step, w: supplier.select((s % n).alias("from"), ((s + step) % n).alias("to"), w.cast("double").alias("w"))
    edges = one(1, 50 + s * 13 % 40).unionByName(one(7, 200 + s * 17 % 90)).unionByName(one(math.isqrt(n), 400 + s * 19 % 70))
    return graph.symmetric(edges, "w").withColumn("weighting", F.lit("distance")), n


def _some(w: DataFrame) -> DataFrame:
    """The stated query set: every node whose id is divisible by 20."""
    return w.where("src % 20 = 0").select("weighting", "src").distinct()


def _some_to_all(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stated query set to every node: all pairs, by their two sides."""
    return _some(w), w.select(F.col("src").alias("goal")).distinct()


_RING = """n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS k FROM supplier), e0 AS (SELECT s_suppkey % n AS src, (s_suppkey + 1) % n AS dst, CAST(50 + s_suppkey * 13 % 40 AS DOUBLE) AS w FROM supplier, n
UNION ALL SELECT s_suppkey % n, (s_suppkey + 7) % n, CAST(200 + s_suppkey * 17 % 90 AS DOUBLE) FROM supplier, n UNION ALL SELECT s_suppkey % n, (s_suppkey + k) % n, CAST(400 + s_suppkey * 19 % 70 AS DOUBLE) FROM supplier, n),
e AS (SELECT src, dst, min(w) AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0) GROUP BY 1, 2)"""
# rounds go on until no distance falls
_DIST = f"""WITH RECURSIVE {_RING}, r(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT src, src, 0.0::DOUBLE FROM e WHERE src % 20 = 0
UNION SELECT r.s, e.dst, min(r.d + e.w) FROM r JOIN e ON e.src = r.v LEFT JOIN recurring.r AS o ON o.s = r.s AND o.v = e.dst WHERE o.d IS NULL OR r.d + e.w < o.d GROUP BY 1, 2)"""


@query(_DIST + " SELECT s AS src, v AS goal, d AS distance FROM r")
def shortest_distance(spark, d):
    w, _ = whole_ring(spark, d)
    return graph.shortest_distances(w, _some_to_all(w)).select("src", "goal", "distance")


@query(_DIST + " SELECT s AS src, v AS node_id, d AS distance FROM r")
def relational_distance(spark, d):
    w, _ = whole_ring(spark, d)
    return graph.relational_distances(w, _some(w)).select("src", "node_id", "distance")


@query(_DIST + " SELECT s AS src, chr(CAST(65 + v % 3 AS INT)) AS aoi, v AS node_id, d AS distance FROM r WHERE v % 4 = 1 QUALIFY row_number() OVER (PARTITION BY s, v % 3 ORDER BY d, v) = 1")
def nearest_aoi_node(spark, d):
    w, _ = whole_ring(spark, d)
    labels = w.select(F.col("src").alias("node_id")).distinct().withColumn("aoi", F.when(F.col("node_id") % 4 == 1, F.chr(65 + F.col("node_id") % 3)).otherwise("0"))
    return graph.nearest_label_nodes(w, _some(w), labels).select("src", "aoi", "node_id", "distance")


# back from every goal, by the predecessor of the least (distance, id)
@query(_DIST + """, p AS MATERIALIZED (SELECT r.s, r.v, arg_min(q.v, (q.d, q.v)) AS up FROM r JOIN e ON e.dst = r.v JOIN r AS q ON q.s = r.s AND q.v = e.src AND q.d + e.w = r.d GROUP BY 1, 2),
walk AS (SELECT s, v AS goal, v AS here, [v] AS path FROM r WHERE s <> v UNION ALL SELECT walk.s, goal, up, list_prepend(up, path) FROM walk JOIN p ON p.s = walk.s AND p.v = here WHERE up <> walk.s)
SELECT walk.s AS src, goal, path FROM walk JOIN p ON p.s = walk.s AND p.v = here WHERE up = walk.s UNION ALL SELECT s, s, [s] FROM r WHERE s = v""")
def shortest_path_nodes(spark, d):
    w, _ = whole_ring(spark, d)
    return graph.shortest_paths(w, _some_to_all(w)).select("src", "goal", "path")


# ---- scenarios and simulation --------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT s_suppkey AS v, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y FROM supplier WHERE s_suppkey <> 5),
e AS (SELECT s_suppkey AS edge_id, s_suppkey AS a, s_suppkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS b, 1.0::DOUBLE AS shape_leng, 0.0::DOUBLE AS duln FROM supplier UNION ALL SELECT 1000001, 3, 8, NULL, 0),
k AS (SELECT * FROM e WHERE edge_id <> 9 AND a <> 5 AND b <> 5)
SELECT edge_id, a AS "from", b AS "to", round(coalesce(shape_leng, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) AS shape_leng, CASE WHEN edge_id = 7 THEN 3.5 ELSE 0 END::DOUBLE AS duln FROM k JOIN n p ON p.v = a JOIN n q ON q.v = b""")
def scenario_apply_edits(spark, d):
    s, supplier = F.col("s_suppkey"), t(spark, d, "supplier")
    top = supplier.agg(F.max(s)).first()[0]
    nodes = supplier.select(s.alias("node_id"), (s % 10).cast("double").alias("x"), F.floor(s / 10).cast("double").alias("y"), F.lit(0.0).alias("duln"))
    edges = supplier.select(s.alias("edge_id"), s.alias("from"), (s % top + 1).alias("to"), F.lit(1.0).alias("shape_leng"), F.lit(0.0).alias("duln"))
    log = [(1, "delete_node", 5, None, None, None), (2, "add_edge", 1000001, 3, 8, None), (3, "delete_edge", 9, None, None, None), (4, "change_edge", 7, None, None, 1.0), (5, "change_edge", 7, None, None, 2.5)]
    edits = spark.createDataFrame(log, "seq int, op string, id long, `from` long, `to` long, delta double").withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    out = scenario.edited(nodes, edges, edits)[1]
    return out.select("edge_id", "from", "to", r6("shape_leng").alias("shape_leng"), "duln")


_LEVELS = {k: ("walkBike{}", 4, "p_partkey % 4 + 1", "p_size % 4 + 1") for k in ("walk",)} | {"nat": ("hardNatur{}", 2, "p_partkey % 2 + 1", "p_size % 2 + 1"), "wid": ("width{}", 4, "p_partkey // 4 % 4 + 1", "p_size // 4 % 4 + 1")}


def _effect_sql(i: int, which: int) -> str:
    return " + ".join(f"CASE {x[which]} " + " ".join(f"WHEN {k} THEN {scenario.EFFECTS[x[0].format(k)][i]}" for k in range(1, x[1] + 1)) + " END" for x in _LEVELS.values())


@query("SELECT p_partkey, " + ", ".join(f'{_effect_sql(i, 3)} - ({_effect_sql(i, 2)}) AS "d_{c}"' for i, c in enumerate(scenario.EFFECT_COLUMNS)) + " FROM part")
def attribute_delta(spark, d):
    part = t(spark, d, "part").select("p_partkey", "p_size")
    for k, (name, _, old, new) in _LEVELS.items():
        for tag, e in (("old", old), ("new", new)):
            part = part.withColumn(f"{tag}_{k}", F.concat(F.lit(name[:-2]), F.expr(e.replace("//", "DIV")).cast("string")))
    out = scenario.attribute_delta(part, [f"old_{k}" for k in _LEVELS], [f"new_{k}" for k in _LEVELS])
    return out.select("p_partkey", *[f"d_{c}" for c in scenario.EFFECT_COLUMNS])


def simulation_inputs(spark, d):
    """The ring with its chords as the network, all customers as agents; the second half of the ring is the area."""
    ring, n = whole_ring(spark, d)
    s, half = F.col("s_suppkey"), n // 2
    supplier = t(spark, d, "supplier")
    nodes = supplier.select((s % n).alias("node_id"), F.cos(s * (2 * math.pi / n)).alias("x"), F.sin(s * (2 * math.pi / n)).alias("y"), F.when(s % n >= half, "A").otherwise("0").alias("aoi"))
    one = lambda step, k, w: supplier.select((s + k * n).alias("edge_id"), (s % n).alias("from"), ((s + step) % n).alias("to"), w.cast("double").alias("shape_leng"))
    edges = one(1, 0, 50 + s * 13 % 40).unionByName(one(7, 1, 200 + s * 17 % 90)).unionByName(one(math.isqrt(n), 2, 400 + s * 19 % 70))
    weights = ring.unionByName(ring.withColumn("weighting", F.lit("little_attr")))
    duln = nodes.join(F.broadcast(spark.createDataFrame([(k,) for k in X.SPEED], "agent_type string")), how="cross").select("agent_type", "node_id", (F.col("node_id") % 5).cast("double").alias("duln"))
    agents = population.with_duration(population.with_type(t(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"))))
    agents = agents.withColumns({"start_v": F.col("agent_id") % half, "goal_v": half + F.col("agent_id") % (n - half), "aoi_goal": F.lit("A")})
    return agents, weights, nodes, edges, duln


@query()
def simulate_passage(spark, d):
    agents, weights, nodes, edges, duln = simulation_inputs(spark, d)
    log = graph.cut(simulate.simulated(agents, weights, nodes, edges, duln))
    return passage.combined_passage(edges.select("edge_id"), simulate.histories(log, agents))


# ---- more of the inventory -----------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_partkey AS cell, abs(p_size * 9 - 255) / 255.0 AS alpha FROM part) SELECT cell, alpha::DOUBLE AS alpha FROM a""")
def grey_alpha(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("cell"), X.grey_alpha(F.col("p_size") * 9).alias("alpha"))


@query("SELECT s_nationkey, round(avg(s_acctbal) FILTER (s_acctbal > -20), 6) AS mean FROM supplier GROUP BY 1")
def mean_above(spark, d):
    return raster.mean_above(t(spark, d, "supplier"), "s_nationkey", "s_acctbal").select("s_nationkey", r6("mean").alias("mean"))


@query("SELECT l_suppkey % 10 AS layer, count(*) AS n FROM lineitem WHERE l_suppkey % 10 IN (SELECT l_suppkey % 10 FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_suppkey % 10 < 3 THEN 0 ELSE l_quantity END) > 0) GROUP BY 1")
def non_empty_layers(spark, d):
    x = _layers(spark, d).withColumn("value", F.when(F.col("layer") < 3, 0.0).otherwise(F.col("value")))
    return raster.non_empty_layers(x).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS node_id, s_acctbal AS mass FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, s_nationkey * (s_suppkey % 7) * 0.1::DOUBLE FROM supplier WHERE s_nationkey * (s_suppkey % 7) > 0")
def node_mass(spark, d):
    s = F.col("s_suppkey")
    nodes = t(spark, d, "supplier").select(s.alias("node_id"), F.col("s_acctbal").alias("residents"), F.lit(None).cast("double").alias("new_residential"), F.col("s_nationkey").cast("double").alias("parking"), (s % 7).cast("double").alias("parking_attr"))
    return population.node_mass(nodes)


@query("SELECT CAST(floor(sum(c_acctbal) / 50) AS BIGINT) AS n_agents, count(*) FILTER (c_acctbal > 0) AS active FROM customer")
def agent_counts(spark, d):
    return population.agent_number(t(spark, d, "customer"), "c_acctbal")


@query("SELECT o_orderkey, o_custkey % 11 AS family FROM orders WHERE o_custkey % 11 <> 0")
def routable_agents(spark, d):
    """Agents without a goal (-1) are not routed."""
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 == 0, -1).otherwise(F.col("o_custkey") % 11).alias("family"))
    return population.routable(rows, "family")


@query(f"""WITH e AS ({_WHOLE}) SELECT a AS "from", b AS "to" FROM e WHERE a % 10 = 3 OR b % 10 = 3""")
def incident_edges(spark, d):
    nodes, edges = whole_graph(spark, d)
    return graph.incident_edges(edges, nodes.where("node_id % 10 = 3"))


@query(f"""WITH n AS ({_WHOLE_NODES}), k AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM n WHERE v % 10 <> 3), e AS ({_WHOLE})
SELECT x.id AS "from", y.id AS "to" FROM e JOIN k x ON x.v = a JOIN k y ON y.v = b""")
def redensified_ids(spark, d):
    """Node ids closed up after deletions, and the ends of the edges that are left."""
    nodes, edges = whole_graph(spark, d)
    kept = graph.cut(graph.dense_ids(nodes.where("node_id % 10 <> 3"), ["node_id"], "id"))
    a, b = kept.select(F.col("node_id").alias("from"), F.col("id").alias("a")), kept.select(F.col("node_id").alias("to"), F.col("id").alias("b"))
    return edges.join(a, "from").join(b, "to").select(F.col("a").alias("from"), F.col("b").alias("to"))


@query("""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS node_id, o_custkey, o_orderpriority FROM orders),
l AS (SELECT node_id, CASE WHEN o_orderpriority = '5-LOW' THEN '0' ELSE 'L' || reverse(((node_id + 37 * (o_custkey % 3)) // 100 * 7)::VARCHAR) END AS aoi FROM n),
names AS (SELECT aoi AS name, row_number() OVER (ORDER BY length(aoi), aoi) AS k FROM l WHERE aoi <> '0' GROUP BY 1),
walk AS (SELECT 0::BIGINT AS k, node_id::BIGINT AS node_id, aoi FROM l
 UNION ALL SELECT k, node_id, CASE WHEN bool_or(core) OVER (ORDER BY node_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) THEN name WHEN mine THEN '0' ELSE aoi END
 FROM (SELECT *, mine AND size = max(size) FILTER (mine) OVER () AS core
 FROM (SELECT *, count(*) OVER (PARTITION BY mine, run) AS size
 FROM (SELECT names.k, node_id, aoi, name, aoi = name AS mine, node_id - row_number() OVER (PARTITION BY aoi = name ORDER BY node_id) AS run FROM walk JOIN names ON names.k = walk.k + 1))))
SELECT node_id, aoi FROM walk WHERE k = (SELECT count(*) FROM names)""")
def labels_in_turn(spark, d):
    """Areas of some hundred orders in a row, mixed where they meet; their names are not in the order of their places."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    place = F.floor((F.col("node_id") + 37 * (F.col("o_custkey") % 3)) / 100) * 7
    name = F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise(F.concat(F.lit("L"), F.reverse(place.cast("string"))))
    nodes = graph.cut(graph.dense_ids(orders, ["o_orderkey"], "node_id").select(F.col("node_id").cast("long"), name.alias("aoi")))
    n = nodes.count()
    edges = spark.range(1, n).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    return graph.labels_in_turn(nodes, edges)


@query(_DIST + " SELECT s AS src, min(d) AS distance, arg_min(v, (d, v)) AS goal FROM r, n WHERE v IN (n // 4, n // 2, 3 * n // 4) GROUP BY 1")
def nearest_of_goals(spark, d):
    w, n = whole_ring(spark, d)
    goals = spark.createDataFrame([(n // 4,), (n // 2,), (3 * n // 4,)], "goal long")
    pairs = _some(w).join(F.broadcast(goals), how="cross")
    found = graph.shortest_distances(w, pairs).where("distance > 0 OR src = goal")  # no weight is 0 here, so 0 is unreachable
    best = found.groupBy("src").agg(F.min(F.struct("distance", "goal")).alias("m"))
    return best.select("src", "m.distance", "m.goal")


@query("""WITH p AS (SELECT o_custkey AS src, o_orderkey AS goal, [o_custkey % 7, o_orderkey % 7, o_orderkey % 5] AS path FROM orders),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(i) AS id FROM (SELECT n_nationkey AS i, n_nationkey % 7 AS a, n_nationkey % 5 AS b FROM nation) GROUP BY 1, 2)
SELECT src, goal, x.id AS first_edge, y.id AS current FROM p LEFT JOIN e x ON x.a = least(path[1], path[2]) AND x.b = greatest(path[1], path[2]) LEFT JOIN e y ON y.a = least(path[2], path[3]) AND y.b = greatest(path[2], path[3])""")
def path_edges(spark, d):
    o, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    paths = t(spark, d, "orders").select(c.alias("src"), o.alias("goal"), F.array(c % 7, o % 7, o % 5).alias("path"))
    edges = t(spark, d, "nation").select(n.alias("edge_id"), (n % 7).cast("long").alias("from"), (n % 5).cast("long").alias("to"))
    return graph.path_edges(paths, edges).select("src", "goal", F.get("history", F.lit(0)).alias("first_edge"), "current")


_AREAS = "SELECT DISTINCT chr(CAST(65 + p_size % 3 AS INT)) AS aoi, CAST(floor(p_partkey / 50) AS INT) AS \"row\", CAST(p_partkey % 50 AS INT) AS col FROM part"


def _areas(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(F.chr(65 + F.col("p_size") % 3).alias("aoi"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"))


@query(f"""WITH a AS ({_AREAS}), m AS (SELECT DISTINCT aoi FROM a WHERE "row" = 2 AND col < 10)
SELECT aoi, "row", col FROM a WHERE aoi NOT IN (SELECT aoi FROM m) UNION SELECT 'Z', "row", col FROM a WHERE aoi IN (SELECT aoi FROM m) UNION SELECT 'Z', 2, range FROM range(10)""")
def aoi_merge(spark, d):
    drawn = spark.range(10).select(F.lit(2).alias("row"), F.col("id").cast("int").alias("col"))
    return aoi.merged(_areas(spark, d), drawn, "Z")


@query(f"""WITH a AS ({_AREAS}) SELECT * FROM a WHERE NOT ("row" = 2 AND col < 10)""")
def aoi_erase(spark, d):
    return aoi.erased(_areas(spark, d), spark.range(10).select(F.lit(2).alias("row"), F.col("id").cast("int").alias("col")))


@query(f"""WITH a AS ({_AREAS}) SELECT * FROM a WHERE aoi NOT IN (SELECT aoi FROM a GROUP BY aoi HAVING count(*) % 2 = 0)""")
def aoi_delete(spark, d):
    areas = _areas(spark, d)
    return aoi.removed(areas, areas.groupBy("aoi").count().where("count % 2 = 0"))


@query(f"""WITH a AS ({_AREAS}) SELECT DISTINCT a.aoi, CAST(p_size AS INT) AS size FROM a JOIN (SELECT p_size, floor(p_partkey / 50) AS r, (p_partkey + 1) % 50 AS c FROM part) b ON r = "row" AND c = col""")
def aoi_overlaps(spark, d):
    k = F.col("p_partkey")
    other = t(spark, d, "part").select(F.col("p_size").cast("int").alias("size"), F.floor(k / 50).cast("int").alias("row"), ((k + 1) % 50).cast("int").alias("col"))
    return aoi.overlapping(_areas(spark, d), other, "aoi", "size")


@query("""SELECT c_custkey AS agent_id, c_nationkey AS node_id FROM customer WHERE c_nationkey NOT IN (c_custkey % 25, c_custkey % 7) AND c_nationkey % 5 <> 4""")
def viable_routes(spark, d):
    """Routes that are neither the place before, nor retraced, nor outside the area: an anti join on (agent, node)."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    routes = t(spark, d, "customer").select(c.alias("agent_id"), n.cast("long").alias("node_id"))
    banned = t(spark, d, "customer").select(c.alias("agent_id"), F.explode(F.array(c % 25, c % 7)).alias("node_id"))
    area = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id")).where("node_id % 5 <> 4")
    return population.viable(routes, banned, area)


@query("""SELECT 'base' AS scenario_id, n_nationkey AS edge_id FROM nation UNION ALL SELECT 'base_2', n_nationkey FROM nation""")
def scenario_copy(spark, d):
    base = t(spark, d, "nation").select(F.lit("base").alias("scenario_id"), F.col("n_nationkey").alias("edge_id"))
    return scenario.copied(base, "base", scenario.free_name("base", ["base"]))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END AS walk_bike, CASE p_size % 3 WHEN 2 THEN 1 ELSE 2 END AS hard_natur, CASE p_size % 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 5 END AS road_width FROM part""")
def edit_codes(spark, d):
    s = F.col("p_size")
    edits = t(spark, d, "part").select("p_partkey", F.concat(F.lit("c"), s % 5).alias("signage"), F.concat(F.lit("c"), s % 3).alias("surface"), F.concat(F.lit("c"), s % 5).alias("width"))
    return scenario.edit_codes(edits).select("p_partkey", "walk_bike", "hard_natur", "road_width")


@query("""WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS s FROM part) SELECT DISTINCT g AS "group" FROM m WHERE g NOT IN (SELECT g FROM m WHERE s > 48)""")
def complete_groups(spark, d):
    members = t(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_size").alias("species")).distinct()
    return species.complete_groups(members.where("species <= 48").select("species").distinct(), members)


@query("""SELECT n_nationkey AS line_id, 'walk' AS layer, round(avg(v), 6) AS value FROM (SELECT n_nationkey, p_partkey, any_value(p_retailprice) AS v FROM nation JOIN part ON floor(p_partkey / 50) = n_nationkey % 4 AND p_partkey % 50 BETWEEN n_nationkey AND n_nationkey + 10 GROUP BY 1, 2) GROUP BY 1""")
def raster_line_mean(spark, d):
    """Each line runs along the middle of a raster row, from column n to n + 10."""
    n = F.col("n_nationkey")
    y = 400.0 - (n % 4 + 0.5) * 10.0
    lines = t(spark, d, "nation").select(n.alias("line_id"), F.array(F.struct(((n + 0.5) * 10.0).alias("x"), y.alias("y")), F.struct(((n + 10.5) * 10.0).alias("x"), y.alias("y"))).alias("coords"))
    return raster.line_mean(lines, _grid(spark, d).withColumn("layer", F.lit("walk")), 0.0, 400.0, 10.0, "line_id").withColumn("value", r6("value"))


@query("""SELECT CAST(ts AS TIMESTAMP) AS first_ts, event_type, n FROM (SELECT event_type, min(ts) AS ts, count(*) AS n FROM events GROUP BY 1)""")
def event_spans(spark, d):
    x = t(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return x.select(F.col("first_ts").cast("timestamp").alias("first_ts"), "event_type", "n")


# ---- files, lines and polygons -------------------------------------------------------------------------------------


def _at(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _square(x, y, side: float) -> F.Column:
    return F.array(*[F.struct((x + i * side).cast("double").alias("x"), (y + j * side).cast("double").alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])


def _order_lines(spark, d):
    """A line per order, from a point of its customer to one of its own, on whole coordinates."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    ends = t(spark, d, "orders").select(o.alias("line_id"), (c % 50).cast("double").alias("ax"), (c % 7).cast("double").alias("ay"), (o % 40 + 20).cast("double").alias("bx"), (o % 9).cast("double").alias("by"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return ends.withColumn("coords", F.array(point("ax", "ay"), point("bx", "by")))


_LINES = "SELECT o_orderkey AS line_id, (o_custkey % 50)::DOUBLE AS ax, (o_custkey % 7)::DOUBLE AS ay, (o_orderkey % 40 + 20)::DOUBLE AS bx, (o_orderkey % 9)::DOUBLE AS by_ FROM orders"


@query(f"SELECT line_id, CAST(line_id % 4 + 1 AS INT) AS walk_bike, (line_id % 3 + 0.5)::DOUBLE AS road_width FROM ({_LINES}) WHERE least(ax, bx) <= 25 AND greatest(ax, bx) >= 20 AND least(ay, by_) <= 5 AND greatest(ay, by_) >= 3")
def lines_in_box(spark, d):
    """Path lines written as a table and read back by a box, their text attributes as numbers."""
    at, k = _at(spark, "lines"), F.col("line_id")
    bounds = {"xmin": F.least("ax", "bx"), "xmax": F.greatest("ax", "bx"), "ymin": F.least("ay", "by"), "ymax": F.greatest("ay", "by"), "shape_leng": F.lit(1.0)}
    text = {"walk_bike": (k % 4).cast("string"), "road_width": F.concat((k % 3).cast("string"), F.lit(".5")), "hard_natur": F.lit("none")}
    _order_lines(spark, d).withColumns(bounds | text).drop("ax", "ay", "bx", "by").write.parquet(at)
    return files.lines(spark, at, (21.0, 4.0, 24.0, 4.0), 1.0).select("line_id", "walk_bike", "road_width")


@query(f"""WITH e AS ({_LINES}), p AS (SELECT ax AS x, ay AS y FROM e UNION SELECT bx, by_ FROM e), n AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS id FROM p)
SELECT row_number() OVER (ORDER BY line_id) AS edge_id, line_id, a.id AS "from", b.id AS "to" FROM e JOIN n a ON a.x = ax AND a.y = ay JOIN n b ON b.x = bx AND b.y = by_""")
def graph_of_lines(spark, d):
    return graph.lines_to_graph(_order_lines(spark, d).select("line_id", "coords"))[1].select("edge_id", "line_id", "from", "to")


@query("SELECT p_partkey FROM part WHERE p_size * 400 > 10000")
def large_lakes(spark, d):
    return files.large_lakes(t(spark, d, "part").select("p_partkey", (F.col("p_size") * 400).alias("shape_area"))).select("p_partkey")


_LAYERED = "SELECT 'layer' || p_size % 3 AS layer, CAST(floor(p_partkey / 50) AS INT) AS \"row\", CAST(p_partkey % 50 AS INT) AS col, p_retailprice AS value FROM part"


@query(f'SELECT layer, "row", col, value FROM ({_LAYERED}) WHERE layer IN (\'layer0\', \'layer2\') AND col BETWEEN 10 AND 29 AND "row" >= 1')
def cropped_raster(spark, d):
    """A raster saved by layer, cropped from its "new" source, saved and read back."""
    k, new, out = F.col("p_partkey"), _at(spark, "raster"), _at(spark, "cropped")
    grid = _grid(spark, d).join(t(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.concat(F.lit("layer"), F.col("p_size") % 3).alias("layer")), ["row", "col"])
    files.save_raster(grid.withColumns({"x": F.col("col") + 0.5, "y": -F.col("row") - 0.5}), new)
    files.save_cropped(spark, {"new": new}, "new", out, ["layer0", "layer2"], (10.0, -1e9, 30.0, -1.0))
    return files.raster(spark, out).select("layer", "row", "col", "value")


@query("SELECT p_partkey::VARCHAR AS part_key, p_brand AS brand, p_retailprice AS price FROM part")
def species_text(spark, d):
    """Semicolon text with decimal commas and dotted names, written and read back."""
    at = _at(spark, "species")
    price = F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ",")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("part.key"), F.col("p_brand").alias("brand"), price.alias("price"))
    rows.write.csv(at, sep=";", header=True)
    return files.species_table(spark, at, ["price"])


@query("SELECT p_size AS species, p_partkey AS cell FROM part WHERE p_size IN (3, 7, 30)")
def presence_of_species(spark, d):
    at = _at(spark, "presence")
    t(spark, d, "part").select(F.col("p_size").alias("species"), F.col("p_partkey").alias("cell")).write.partitionBy("species").parquet(at)
    return files.presence(spark, at, [3, 7, 30]).select(F.col("species").cast(t(spark, d, "part").schema["p_size"].dataType).alias("species"), "cell")


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS valid, s_suppkey % 2 = 0 AND s_suppkey % 10 + 4 < 10 AS inside FROM supplier")
def perimeters(spark, d):
    """Squares, every other one with crossing sides, as WKT and back through GeoJSON; those up to x = 10 lie in the country."""
    k = F.col("s_suppkey")
    x = (k % 10).cast("string")
    far = (k % 10 + 4).cast("string")
    corner = lambda a, b: F.concat(a, F.lit(f" {b}"))
    straight, crossed = [corner(x, 1), corner(far, 1), corner(far, 5), corner(x, 5)], [corner(x, 1), corner(far, 5), corner(far, 1), corner(x, 5)]
    wkt = lambda c: F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *c), F.lit("))"))
    ring = files.ring_from_geojson(files.geojson(files.ring_from_wkt(F.when(k % 2 == 0, wkt(straight)).otherwise(wkt(crossed)))))
    out = t(spark, d, "supplier").select("s_suppkey", ring.alias("ring"), _square(F.lit(-1.0), F.lit(-1.0), 11.0).alias("border"))
    ok = files.valid_perimeter(F.col("ring"))
    return out.select("s_suppkey", ok.alias("valid"), (ok & files.in_country(F.col("ring"), F.col("border"))).alias("inside"))


@query("SELECT 'nation' AS \"table\", n_nationkey AS k, 'step4' AS step FROM nation UNION ALL SELECT 'supplier', s_suppkey, 'step4' FROM supplier")
def snapshot_round_trip(spark, d):
    at = _at(spark, "snapshot")
    files.save_snapshot({"nation": t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")), "supplier": t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))}, at, "step4")
    step, tables = files.load_snapshot(spark, at)
    one = [df.select(F.lit(n).alias("table"), "k", F.lit(step).alias("step")) for n, df in sorted(tables.items())]
    return one[0].unionByName(one[1])


@query("SELECT l_orderkey AS agent_id, CASE WHEN l_orderkey % 2 = 0 THEN 'nicest' ELSE 'shortest' END AS behaviour, list(l_suppkey % 100 ORDER BY l_linenumber, l_suppkey) AS xs FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1 HAVING count(*) > 1")
def path_geometries(spark, d):
    """Nodes of a history as points in order; nodes without coordinates fall out, single points are left out."""
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("agent_id"), F.when(F.col("l_orderkey") % 2 == 0, "nicest").otherwise("shortest").alias("behaviour"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("to"))
    nodes = t(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 100).alias("x"), F.lit(0.0).alias("y"))
    return simulate.path_geometries(rows, nodes).select("agent_id", "behaviour", F.transform("coords", lambda p: p["x"]).alias("xs"))


def _customer_nodes(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("node_id"), (k % 40 + 0.25).cast("double").alias("x"), (F.floor(k / 40) + 0.5).cast("double").alias("y"), (k % 3).cast("double").alias("parking"))


def _nation_squares(spark, d):
    """A square of side 2 per nation along a diagonal over the lowest rows of nodes; from nation 20 on they hold no node."""
    n = F.col("n_nationkey")
    x = F.when(n >= 20, n - 20 + 0.3).otherwise(n).cast("double")
    y = F.when(n >= 20, -3.0).otherwise((n % 2).cast("double"))
    return t(spark, d, "nation").select(n.alias("id"), _square(x, y, 2.0).alias("ring"))


_HELD = """n AS (SELECT c_custkey AS v, (c_custkey % 40 + 0.25)::DOUBLE AS x, (floor(c_custkey / 40) + 0.5)::DOUBLE AS y, (c_custkey % 3)::DOUBLE AS parking FROM customer),
q AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 20 THEN n_nationkey - 20 + 0.3 ELSE n_nationkey END::DOUBLE AS px, CASE WHEN n_nationkey >= 20 THEN -3.0 ELSE n_nationkey % 2 END::DOUBLE AS py FROM nation),
w AS (SELECT id, v, count(*) OVER (PARTITION BY id) AS k, true AS inside FROM q JOIN n ON x > px AND x < px + 2 AND y > py AND y < py + 2),
h AS (SELECT * FROM w UNION ALL SELECT id, arg_min(v, ((x - px) * (x - px) + (y - py) * (y - py), v)), 1, false FROM q, n WHERE id NOT IN (SELECT id FROM w) GROUP BY id)"""


@query(f"WITH {_HELD} SELECT v AS node_id, round(coalesce((SELECT sum(4 / 30.0 / k) FROM h WHERE h.v = n.v), 0), 6)::DOUBLE AS parking FROM n")
def polygon_capacity(spark, d):
    return spatial.capacities(_nation_squares(spark, d), _customer_nodes(spark, d), 30.0, 1.0).select("node_id", r6("parking").alias("parking"))


@query(f"""WITH {_HELD}, a AS (SELECT v, max(id) AS last FROM h WHERE NOT inside GROUP BY 1), s AS (SELECT h.v, sum(4 / 15.0 / k) AS more FROM h LEFT JOIN a USING (v) WHERE inside AND (last IS NULL OR id > last) GROUP BY 1)
SELECT v AS node_id, round(CASE WHEN last IS NULL THEN parking ELSE 4 / 15.0 END + coalesce(more, 0), 6)::DOUBLE AS residents FROM n LEFT JOIN a USING (v) LEFT JOIN s USING (v)""")
def polygons_drawn(spark, d):
    nodes = _customer_nodes(spark, d).withColumnRenamed("parking", "residents")
    return scenario.with_polygons(nodes, _nation_squares(spark, d), 15.0, 1.0, "residents").select("node_id", r6("residents").alias("residents"))


@query(f"WITH {_HELD} SELECT v AS node_id, round(parking - coalesce((SELECT sum(4 / 30.0) FROM h WHERE h.v = n.v), 0), 6)::DOUBLE AS parking FROM n")
def polygons_removed(spark, d):
    return scenario.without_polygons(_customer_nodes(spark, d), _nation_squares(spark, d), 1.0).select("node_id", r6("parking").alias("parking"))


@query("SELECT p_partkey AS cell, p_retailprice AS value, chr(CAST(65 + floor(p_partkey % 50 / 10) AS INT)) AS aoi FROM part WHERE floor(p_partkey / 50) BETWEEN 1 AND 20")
def cells_in_polygons(spark, d):
    """Cells of a raster whose centre lies in one of five upright strips, ten columns wide."""
    grid = _grid(spark, d).withColumns({"cell": F.col("row") * 50 + F.col("col"), "x": F.col("col") + 0.5, "y": F.col("row") + 0.5})
    strip = F.array(*[F.struct((F.col("id") * 10 + 10 * i).cast("double").alias("x"), F.lit(1.0 + 20 * j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    strips = spark.range(5).select(F.chr(65 + F.col("id")).alias("aoi"), strip.alias("ring"))
    return aoi.cells_in(grid, strips, 5.0).select(F.col("cell").cast("long").alias("cell"), "value", "aoi")


_BANDS = "SELECT 'band' || CAST(floor(p_partkey / 250) AS INT) AS aoi, p_partkey AS cell, p_partkey % 50 < 25 AS low FROM part WHERE p_partkey % 50 <> 25"


@query(f"SELECT aoi, min(cell) AS component, count(*) AS n FROM ({_BANDS}) GROUP BY aoi, low")
def areas_cut_apart(spark, d):
    """Bands of five rows of cells, cut along column 25."""
    bands = _grid(spark, d).select(F.concat(F.lit("band"), F.floor(F.col("row") / 5)).alias("aoi"), "row", "col")
    line = bands.where("col = 25").select("row", "col")
    return aoi.cut_apart(bands, line, 50).groupBy("aoi", "component").agg(F.count("*").alias("n"))


@query("SELECT floor(p_partkey / 250)::BIGINT AS component, count(*) * 700.0::DOUBLE AS area FROM part GROUP BY 1 HAVING count(*) * 700 > 100000")
def large_areas(spark, d):
    grid = _grid(spark, d)
    return raster.aois(grid.select("row", "col", F.floor(F.col("row") / 5).alias("component")), grid, 700.0).select("component", "area")


@query("SELECT 'base_2' AS scenario_id, n_nationkey AS edge_id FROM nation")
def scenario_removed(spark, d):
    base = t(spark, d, "nation").select(F.lit("base").alias("scenario_id"), F.col("n_nationkey").alias("edge_id"))
    return scenario.removed(scenario.copied(base, "base", "base_2"), "base")


@query("""SELECT c_custkey AS agent_id, true AS active, 1 AS moving, 'shortest' AS behaviour, c_nationkey::BIGINT AS next_v, true AS fresh FROM customer""")
def agents_at_start(spark, d):
    agents = t(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_nationkey").cast("long").alias("start_v"))
    return population.initial_state(agents).select("agent_id", "active", "moving", "behaviour", "next_v", (F.col("prior_v").isNull() & (F.col("timer") == 0)).alias("fresh"))


_NEW = ("walkNat", "walkSoc", "biker", "ebike", "jogger", "dogNat", "dogProx")
_START = {c: scenario.EFFECT_COLUMNS.index(c) for c in _NEW}
_PAID = {c: sum(scenario.EFFECTS[x][i] for x in ("walkBike2", "hardNatur2", "width1")) for c, i in _START.items()}


@query("WITH g AS (SELECT floor(p_partkey / 50) AS r, p_partkey % 50 AS c, p_retailprice AS v, chr(CAST(65 + floor(p_partkey / 250) AS INT)) AS aoi FROM part), m AS (SELECT n_nationkey AS k, avg(v) AS m, min(aoi) AS aoi FROM nation JOIN g ON r = n_nationkey % 4 AND c BETWEEN n_nationkey AND n_nationkey + 10 GROUP BY 1) SELECT k AS edge_id, aoi, "
       + ", ".join(f'round(m * {i + 1} + {_PAID[c]}, 6) AS "{c}"' for i, c in enumerate(_NEW)) + " FROM m")
def new_paths(spark, d):
    """Paths drawn and submitted: the raster's mean of all seven kinds, the full effect of the chosen levels on top, and the area."""
    k = F.col("n_nationkey")
    y = 400.0 - (k % 4 + 0.5) * 10.0
    lines = t(spark, d, "nation").select(k.cast("long").alias("edge_id"), F.array(F.struct(((k + 0.5) * 10.0).alias("x"), y.alias("y")), F.struct(((k + 10.5) * 10.0).alias("x"), y.alias("y"))).alias("coords"))
    grid = _grid(spark, d).select("row", "col", F.posexplode(F.array(*map(F.lit, _NEW))).alias("i", "layer"), "value").withColumn("value", F.col("value") * (F.col("i") + 1)).drop("i")
    cells = _grid(spark, d).select("row", "col", F.chr(65 + F.floor(F.col("row") / 5)).alias("aoi"))
    drawn = scenario.surveyed(lines, grid, cells, 0.0, 400.0, 10.0, {c: c for c in _NEW})
    levels = scenario.attribute_effect(["w", "h", "b"])
    paid = drawn.withColumns({"w": F.lit("walkBike2"), "h": F.lit("hardNatur2"), "b": F.lit("width1")}).withColumns({f"d_{c}": levels[c].cast("double") for c in _NEW})
    end = lambda i, c: F.col("coords")[i][c]
    nodes = paid.select(F.posexplode(F.array(F.lit(0), F.lit(1))).alias("i", "_"), "edge_id", "coords").select((F.col("edge_id") * 2 + F.col("i")).alias("node_id"), F.get("coords", F.col("i"))["x"].alias("x"), F.get("coords", F.col("i"))["y"].alias("y"), *[F.lit(0.0).alias(c) for c in _NEW])
    none = F.lit(None).cast("double")
    log = paid.select(F.lit(1).alias("seq"), F.lit("add_edge").alias("op"), F.col("edge_id").alias("id"), (F.col("edge_id") * 2).alias("from"), (F.col("edge_id") * 2 + 1).alias("to"), end(0, "x").alias("x"), end(0, "y").alias("y"), "aoi", *_NEW, *[none.alias(f"d_{c}") for c in _NEW])
    change = log.withColumns({"seq": F.lit(2), "op": F.lit("change_edge")}).drop(*[f"d_{c}" for c in _NEW]).join(paid.select(F.col("edge_id").alias("id"), *[f"d_{c}" for c in _NEW]), "id")
    edges = nodes.select(F.col("node_id").alias("edge_id"), F.col("node_id").alias("from"), F.col("node_id").alias("to"), F.lit(0.0).alias("shape_leng"), *_NEW).where("false")
    out = scenario.edited(nodes, edges, log.unionByName(change), {c: f"d_{c}" for c in _NEW})[1]
    return out.select("edge_id", "aoi", *[r6(c).alias(c) for c in _NEW])


# ---- polygons, borders and oblique lines ---------------------------------------------------------------------------


def _ring(*corners) -> F.Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _bars(spark, d):
    """(nations' long, suppliers' short) oblique bars on whole coordinates: many cross, touch or hold each other, and a bar's
    middle is far from its ends."""
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    x, y = n * 5 % 60, n * 7 % 40
    long = t(spark, d, "nation").select(n.cast("long").alias("long"), _ring((x, y), (x + 20, y - 6), (x + 20, y - 5), (x, y + 1)).alias("ring"))
    x, y = s * 3 % 111, s * 4 % 92
    return long, t(spark, d, "supplier").select(s.alias("short"), _ring((x, y), (x + 1, y), (x + 7, y + 6), (x + 6, y + 6)).alias("ring"))


_BARS = """p AS (SELECT n_nationkey::BIGINT AS id, 'l' AS kind, unnest([[x, y], [x + 20, y - 6], [x + 20, y - 5], [x, y + 1]]) AS c, unnest([0, 1, 2, 3]) AS i FROM (SELECT n_nationkey, (n_nationkey * 5 % 60)::DOUBLE AS x, (n_nationkey * 7 % 40)::DOUBLE AS y FROM nation)
  UNION ALL SELECT s_suppkey, 's', unnest([[x, y], [x + 1, y], [x + 7, y + 6], [x + 6, y + 6]]), unnest([0, 1, 2, 3]) FROM (SELECT s_suppkey, (s_suppkey * 3 % 111)::DOUBLE AS x, (s_suppkey * 4 % 92)::DOUBLE AS y FROM supplier)),
g AS (SELECT a.id, a.kind, a.i, a.c[1] AS ax, a.c[2] AS ay, b.c[1] AS bx, b.c[2] AS by_ FROM p a JOIN p b ON a.id = b.id AND a.kind = b.kind AND b.i = (a.i + 1) % 4),
z AS (SELECT s.id AS short, l.id AS long, s.ax, s.ay, s.bx, s.by_, l.ax AS cx, l.ay AS cy, l.bx AS dx, l.by_ AS dy FROM g s JOIN g l ON s.kind = 's' AND l.kind = 'l'),
o AS (SELECT *, sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) AS o1, sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) AS o2, sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) AS o3, sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) AS o4 FROM z),
w AS (SELECT *, o1 * o2 <= 0 AND o3 * o4 <= 0 AND greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, by_) >= least(cy, dy) AND greatest(cy, dy) >= least(ay, by_) AS meet FROM o),
held AS (SELECT a.kind, a.id, g.id AS other FROM p a JOIN g ON g.kind <> a.kind WHERE a.i = 0 AND (g.ay > a.c[2]) <> (g.by_ > a.c[2]) AND a.c[1] < g.ax + (a.c[2] - g.ay) / nullif(g.by_ - g.ay, 0) * (g.bx - g.ax) GROUP BY ALL HAVING count(*) % 2 = 1),
nested AS (SELECT id AS short, other AS long FROM held WHERE kind = 's' UNION SELECT other, id FROM held WHERE kind = 'l')"""


def _to_side(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    s = f"least(greatest((({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay})), 0), 1)"
    return f"(pow({x} - ({ax} + {s} * ({bx} - {ax})), 2) + pow({y} - ({ay} + {s} * ({by} - {ay})), 2))"


_FROM_SIDE = f"least({_to_side('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {_to_side('bx', 'by_', 'cx', 'cy', 'dx', 'dy')}, {_to_side('cx', 'cy', 'ax', 'ay', 'bx', 'by_')}, {_to_side('dx', 'dy', 'ax', 'ay', 'bx', 'by_')})"


@query(f"WITH {_BARS} SELECT short, long FROM w WHERE meet UNION SELECT short, long FROM nested")
def areas_meeting(spark, d):
    """Pairs of bars that share a point: borders that cross or touch, and bars inside bars."""
    long, short = _bars(spark, d)
    return polygons.meeting(short, long, "short", "long")


@query(f"""WITH {_BARS}, m AS (SELECT short, long, min(CASE WHEN meet THEN 0 ELSE {_FROM_SIDE} END) AS d FROM w GROUP BY ALL UNION ALL SELECT short, long, 0 FROM nested),
q AS (SELECT short, long, round(sqrt(min(d)), 6) AS d FROM m GROUP BY ALL) SELECT short, min(d) AS distance, min(abs(d - e)) < 1e-6 AS nearest FROM q JOIN (SELECT short, min(d) AS e FROM q GROUP BY 1) USING (short) GROUP BY 1""")
def nearest_area(spark, d):
    """The distance of each short bar to the long bar nearest to its border; the bar that is named has that distance."""
    long, short = _bars(spark, d)
    found = graph.cut(polygons.nearest(short, long, "short", "long"))
    own = polygons.within(polygons.sides(short, "short"), polygons.sides(long, "long"), "short", "long", 200.0).withColumnRenamed("distance", "e")
    met = polygons.meeting(short, long, "short", "long").withColumn("meets", F.lit(True))
    right = F.when(F.col("meets").isNotNull(), F.col("distance") == 0).otherwise(F.abs(F.col("distance") - F.col("e")) < 1e-6)
    return found.join(own, ["short", "long"]).join(met, ["short", "long"], "left").select("short", r6("distance").alias("distance"), right.alias("nearest"))


@query(_COMPONENTS.format(nodes="SELECT p_partkey AS v FROM part", edges="SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_size % 3 = y.p_size % 3 AND (y.p_partkey = x.p_partkey + 50 OR (y.p_partkey = x.p_partkey + 1 AND x.p_partkey % 50 <> 49))")
       + """, c AS (SELECT chr(CAST(65 + p_size % 3 AS INT)) AS aoi, floor(p_partkey / 50) AS r, p_partkey % 50 AS c, l.c AS part FROM part JOIN l ON l.v = p_partkey),
k AS (SELECT aoi, r + i AS r, c + j AS c, count(*) AS n, max(c.r) > min(c.r) AND max(c.c) > min(c.c) AS across FROM c, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY aoi, r + i, c + j),
q AS (SELECT aoi, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 3) AS q3, count(*) FILTER (n = 2 AND across) AS qd FROM k GROUP BY aoi)
SELECT c.aoi, any_value(2 * parts - (q1 - q3 + 2 * qd) // 4)::BIGINT AS rings, any_value(parts - (q1 - q3 + 2 * qd) // 4)::BIGINT AS holes, any_value(q1 + q3 + 2 * qd)::BIGINT AS corners, count(*)::DOUBLE * 100 AS area
FROM c JOIN q USING (aoi) JOIN (SELECT aoi, count(DISTINCT part) AS parts FROM c GROUP BY 1) USING (aoi) GROUP BY 1""")  # fmt: skip
def area_outlines(spark, d):
    """Outlines of three scattered areas. In SQL, rings follow from the patches and Euler's number, corners from squares of four cells."""
    rings = polygons.outlines(_areas(spark, d), 0.0, 400.0, 10.0)
    return rings.groupBy("aoi").agg(F.count("*").alias("rings"), F.count_if("hole").alias("holes"), F.sum(F.size("ring")).alias("corners"), F.sum("area").alias("area"))


@query("""SELECT DISTINCT 'L' || p_size % 5 AS layer, CAST(floor(p_partkey / 50) AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col FROM part JOIN nation ON n_nationkey % 4 = p_size % 5
WHERE p_partkey % 50 + 0.5 > n_nationkey * 2 AND p_partkey % 50 + 0.5 < n_nationkey * 2 + 7 AND floor(p_partkey / 50) + 0.5 > n_nationkey % 5 AND floor(p_partkey / 50) + 0.5 < n_nationkey % 5 + 7""")
def masked_layers(spark, d):
    """Layers cut down to where their species is present; the layer of the fifth species, which is present nowhere, goes."""
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    grid = t(spark, d, "part").select(F.concat(F.lit("L"), F.col("p_size") % 5).alias("layer"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"))
    presence = t(spark, d, "nation").select(F.concat(F.lit("L"), n % 4).alias("layer"), _square(n * 2, n % 5, 7.0).alias("ring"))
    return raster.masked(grid.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), presence, 4.0).select("layer", "row", "col").distinct()


@query("""WITH s AS (SELECT o_orderkey AS line_id, o_orderkey % 31 * 1.3::DOUBLE + 0.2::DOUBLE AS au, o_orderkey % 17 * 1.7::DOUBLE + 0.1::DOUBLE AS av, o_custkey % 29 * 1.1::DOUBLE + 0.3::DOUBLE AS bu, o_custkey % 13 * 2.3::DOUBLE + 0.45::DOUBLE AS bv FROM orders),
r AS (SELECT *, unnest(range(floor(least(av, bv))::BIGINT, floor(greatest(av, bv))::BIGINT + 1)) AS r FROM s),
u AS (SELECT *, au + (greatest(least(av, bv), r) - av) * ((bu - au) / (bv - av)) AS u1, au + (least(greatest(av, bv), r + 1) - av) * ((bu - au) / (bv - av)) AS u2 FROM r)
SELECT line_id, count(*) AS cells, sum(r)::BIGINT AS "rows", sum(c)::BIGINT AS cols FROM (SELECT line_id, r, unnest(range(floor(least(u1, u2))::BIGINT, floor(greatest(u1, u2))::BIGINT + 1)) AS c FROM u) GROUP BY 1""")
def oblique_line_cells(spark, d):
    """The cells of a raster that oblique lines cross."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    end = lambda x, y: F.struct(x.cast("double").alias("x"), (F.lit(0.0) - y.cast("double")).alias("y"))
    lines = t(spark, d, "orders").select(o.alias("line_id"), F.array(end(o % 31 * 1.3 + 0.2, o % 17 * 1.7 + 0.1), end(c % 29 * 1.1 + 0.3, c % 13 * 2.3 + 0.45)).alias("coords"))
    cells = raster.line_cells(lines, 0.0, 0.0, 1.0, "line_id")
    return cells.groupBy("line_id").agg(F.count("*").alias("cells"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


_KINDS = list(X.SPEED)
_EDGE_DULN = "(CASE WHEN edge_id % 3 = 0 THEN 9 + i + edge_id % 11 ELSE (a % 5 + b % 5) * 0.5 + i + CASE WHEN a IN (6, 7) THEN 2.0 * (i + 1) ELSE 0 END + CASE WHEN b IN (6, 7) THEN 2.0 * (i + 1) ELSE 0 END END + CASE WHEN edge_id = 6 THEN 4.0 * (i + 1) ELSE 0 END)"


@query(f"""WITH e AS (SELECT s_suppkey AS edge_id, s_suppkey AS a, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS b, (50 + s_suppkey % 40)::DOUBLE AS len FROM supplier), k AS (SELECT unnest([{", ".join(f"'{x}'" for x in _KINDS)}]) AS agent_type, unnest(range(7)) AS i),
x AS (SELECT edge_id, agent_type, len, {_EDGE_DULN}::DOUBLE AS duln FROM e, k), v AS (SELECT * FROM (VALUES ('distance', 8.0::DOUBLE), ('little_attr', 4.0::DOUBLE), ('mostly_attr', 2.0::DOUBLE)) AS v(weighting, k))
SELECT edge_id, agent_type || ':' || weighting AS weighting, round(CASE WHEN duln = 0 THEN 10 ELSE greatest(least(len * (1 - 1 / (k / 45.2423 * duln)), len), 10) END, 6) AS w FROM x, v""")
def edge_attractiveness(spark, d):
    """Weights after edge 6 was changed, which raises its two ends as well: of the edges with an attractiveness of their own
    only this one moves; edges without take the mean of their ends."""
    s, supplier = F.col("s_suppkey"), t(spark, d, "supplier")
    n = supplier.count()
    nodes = supplier.select(s.alias("node_id"), s.cast("double").alias("x"), F.lit(0.0).alias("y"), *[(s % 5 + i).cast("double").alias(c) for i, c in enumerate(_KINDS)])
    own = [F.when(s % 3 == 0, 9.0 + i + s % 11).alias(c) for i, c in enumerate(_KINDS)]
    edges = supplier.select(s.alias("edge_id"), s.alias("from"), ((s + 1) % n).alias("to"), (50 + s % 40).cast("double").alias("shape_leng"), *own)
    change = spark.createDataFrame([(1, "change_edge", 6, None, None, None, None, *[4.0 * (i + 1) for i in range(7)])], "seq int, op string, id long, `from` long, `to` long, x double, y double, " + ", ".join(f"d_{c} double" for c in _KINDS))
    nodes, edges = scenario.edited(nodes, edges, change, {c: f"d_{c}" for c in _KINDS})
    w = workflow.edge_weights(nodes, edges, 11.0)
    ends = edges.select("edge_id", F.col("from").alias("src"), F.col("to").alias("dst"))
    return w.join(ends, ["src", "dst"]).select("edge_id", "weighting", r6("w").alias("w"))
