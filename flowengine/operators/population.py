"""Synthetic visitors: types, outing durations, start nodes and goals, drawn with reproducible uniforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowengine.functions import expressions as X

from .graph import cut

#: Ranges of nodes and of the cumulative mass, at least; each is one window, and there are as many as shuffle partitions if those are more.
BUCKETS = 32


def with_type(agents: DataFrame, seed: int = 1, key: str = "agent_id") -> DataFrame:
    return agents.withColumn("agent_type", X.pick(X.uniform(seed, F.lit("type"), F.col(key)), list(X.TYPE_WEIGHT), list(X.TYPE_WEIGHT.values())))


def with_duration(agents: DataFrame, seed: int = 1, key: str = "agent_id") -> DataFrame:
    u = X.uniform(seed, F.lit("duration"), F.col(key))
    value = F.lit(None).cast("int")
    for kind, weights in X.DURATION_WEIGHT.items():
        value = F.when(F.col("agent_type") == kind, X.pick(u, list(X.DURATIONS), list(weights))).otherwise(value)
    return agents.withColumn("time_ext", value).withColumn("speed", X.lookup(X.SPEED, F.col("agent_type")))


def initial_state(agents: DataFrame) -> DataFrame:
    """The columns an agent has before its first step."""
    none = F.lit(None).cast("array<bigint>")
    return agents.withColumns({
        "active": F.lit(True), "timer": F.lit(0.0), "moving": F.lit(1), "behaviour": F.lit("shortest"), "current_v": F.col("start_v"), "next_v": F.col("start_v"), "last_v": F.lit(None).cast("bigint"),
        "total_distance": F.lit(0.0), "time_not_accounted": F.lit(0.0), **{c: none for c in ("prior_v", "prior_e", "prior_e_aoi", "retraced_v")},
    })


def agent_number(nodes: DataFrame, residents: str = "residents", per_agent: float = 50.0) -> DataFrame:
    """One row (n_agents, active): one visitor for so many residents, and the nodes that have any."""
    return nodes.agg(F.coalesce(F.floor(F.sum(residents) / per_agent), F.lit(0)).alias("n_agents"), F.count_if(F.col(residents) > 0).alias("active"))


def routable(agents: DataFrame, goal: str = "goal_v") -> DataFrame:
    """Agents with a goal; -1 and null are none."""
    return agents.where(F.col(goal) != -1)


def viable(routes: DataFrame, banned: DataFrame, area: DataFrame) -> DataFrame:
    """Routes (agent_id, node_id) whose node lies in the area (node_id) and is not banned (agent_id, node_id): where an agent was, or has turned back."""
    return routes.join(banned.select("agent_id", "node_id").distinct(), ["agent_id", "node_id"], "left_anti").join(area.select("node_id").distinct(), "node_id", "left_semi").select(*routes.columns)


def node_mass(nodes: DataFrame, parking_intensity: float = 0.1) -> DataFrame:
    """(node_id, mass) of residents, parking by its attractiveness, and new residents; only positive finite masses count."""
    parts = F.array(F.col("residents"), F.col("new_residential"), F.col("parking") * F.col("parking_attr") * parking_intensity)
    return nodes.select("node_id", F.explode(parts).alias("mass")).where("mass > 0 AND NOT isnan(mass) AND mass < double('infinity')")


def drawn_nodes(agents: DataFrame, mass: DataFrame, seed: int = 1, key: str = "agent_id", out: str = "start_v") -> DataFrame:
    """Agents with a node drawn in proportion to its mass.

    The cumulative mass runs in node order, by range buckets of nodes and their sums. Nodes and draws are then dealt together
    by their place on it, so the draws of a heavy node spread over many tasks; in each a draw takes the next node, or
    the first node of a later part, of which there is one a part.
    """
    parts = max(BUCKETS, int(mass.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = mass.groupBy("node_id").agg(F.sum("mass").alias("mass")).repartitionByRange(parts, "node_id")
    keyed = cut(keyed.withColumn("bucket", F.spark_partition_id()))  # range partitions rise with the node
    inner = keyed.withColumn("upto", F.sum("mass").over(Window.partitionBy("bucket").orderBy("node_id")))
    sums = cut(inner.groupBy("bucket").agg(F.max("upto").alias("total")))  # one row a bucket
    low = sums.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("low"))
    all_ = sums.agg(F.sum("total")).first()[0] or 0.0
    u = X.uniform(seed, F.lit(out), F.col(key))
    draws = agents.select((u * all_).alias("at"), F.lit(0).alias("is_node"), F.lit(None).cast("bigint").alias("node"), F.struct(*agents.columns).alias("agent"))
    ends = inner.join(F.broadcast(low), "bucket").select((F.col("low") + F.col("upto")).alias("at"), F.lit(1).alias("is_node"), F.col("node_id").cast("bigint").alias("node"), F.lit(None).cast(draws.schema["agent"].dataType).alias("agent"))
    spread = draws.unionByName(ends).withColumn("_mix", F.when(F.col("is_node") == 0, F.xxhash64("agent")).otherwise(0))
    both = cut(spread.repartitionByRange(parts, "at", F.desc("is_node"), "_mix").withColumn("_part", F.spark_partition_id()))
    # seen from the end, the next node is the last one so far, which Spark keeps as it goes; a draw looks beyond equal places
    w = Window.partitionBy("_part").orderBy(F.desc("at"), "is_node", F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = both.groupBy("_part").agg(F.min(F.when(F.col("is_node") == 1, F.struct("at", "node"))).alias("_first"))  # one row a part
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select("_part", F.last("_first.node", ignorenulls=True).over(later).alias("_later"))
    # sums of doubles may leave a draw just beyond the last node: then it takes that node
    top = ends.agg(F.max(F.struct("at", "node")).alias("m")).select(F.col("m.node").alias("_top"))
    taken = F.coalesce(F.last("node", ignorenulls=True).over(w), "_later", "_top")
    found = both.join(F.broadcast(carried), "_part").join(F.broadcast(top), how="cross").withColumn(out, taken)
    return found.where("is_node = 0").select("agent.*", out)


def aoi_utility(reached: DataFrame) -> DataFrame:
    """Choice probabilities of areas of interest: reached (agent_id, aoi, distance, duln, area, speed, duration) with u and p.

    u is null where the walk takes over a tenth of the outing; an agent that reaches one area only takes it.
    """
    w = Window.partitionBy("agent_id")
    bounds = reached.agg(F.min("duln").alias("duln_low"), F.max("duln").alias("duln_high"), F.min("duration").alias("dur_low"), F.max("duration").alias("dur_high"))
    x = reached.join(F.broadcast(bounds), how="cross").withColumns({"_n": F.count("*").over(w), "_near": F.min("distance").over(w), "_far": F.max("distance").over(w)})
    hours = F.greatest(F.col("distance") / (F.col("speed") * 1000.0), F.lit(0.01))
    size = F.least(F.sqrt("area"), F.lit(7000.0))
    gain = X.rescaled(F.col("duln") * size / F.col("duration"), F.col("duln_low") * 316.0 / F.col("dur_high"), F.col("duln_high") * 15000.0 / F.col("dur_low"))
    cost = X.rescaled(hours / F.col("duration"), F.col("_near") / 20000.0 / F.col("dur_high"), F.col("_far") / 2000.0 / F.col("dur_low"))
    within = hours <= 0.1 * F.col("duration") / 60.0
    u = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.when(within, 3.23695 * gain - 6.65703 * cost))
    return x.withColumn("u", u).withColumn("p", F.coalesce(X.softmax(F.col("u"), ["agent_id"]), F.lit(0.0))).drop("_n", "_near", "_far", "duln_low", "duln_high", "dur_low", "dur_high")


def drawn_aoi(choices: DataFrame, seed: int = 1) -> DataFrame:
    """(agent_id, goal_v, aoi_goal): one area drawn by p in label order; none possible gives -1 and NO_GOAL."""
    w = Window.partitionBy("agent_id").orderBy("aoi")
    upto = choices.where("p > 0").select("agent_id", "aoi", "node_id", F.sum("p").over(w).alias("upto"), X.uniform(seed, F.lit("aoi"), F.col("agent_id")).alias("_u"))
    w = Window.partitionBy("agent_id")
    taken = upto.withColumn("_top", F.max("upto").over(w)).where((F.col("_u") * F.col("_top") < F.col("upto"))).groupBy("agent_id").agg(F.min_by("node_id", "aoi").alias("goal_v"), F.min("aoi").alias("aoi_goal"))
    return choices.select("agent_id").distinct().join(taken, "agent_id", "left").select("agent_id", F.coalesce("goal_v", F.lit(-1)).alias("goal_v"), F.coalesce("aoi_goal", F.lit("NO_GOAL")).alias("aoi_goal"))
