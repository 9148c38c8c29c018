"""Visitor simulation in three phases, each a few Spark jobs for all agents at once: the way out, the stroll in the area, the way home.

Agents never interact, and a walk is a way to its goal, moves inside one area, and a way back. Ways are shortest paths of distinct
pairs, joined to their agents. A stroll needs one area's nodes only, so agents meet those of their area (of a cell of it, where
the area is large) and no task holds the network. Output is one row per edge walked, so passage counts and path geometries
are plain DataFrame work on the log.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowengine.functions.expressions import FAMILY, STEPS_PER_MINUTE, lookup, timesteps, travel_minutes

from .graph import cut, shortest_paths

#: Fixed value: ticks after which a walk ends.
MAX_STEPS = 108_000
#: Moves into an area that a task holds (a larger area is walked cell by cell, of so many nodes), and agents that share a task.
AREA, CELL, AGENTS = 200_000, 16_384, 1_024
#: The edge of a move that has none.
NO_EDGE = -(1 << 63)
LOG = ("agent_id", "seq", "timestep", "behaviour", "from", "to", "edge_id", "in_aoi")
STATE = ("agent_id", "now", "upto", "t", "last", "at", "x", "y", "lx", "ly", "stack", "retraced", "times", "backs", "froms", "tos", "edges", "then")
_STACK = "array<struct<node: long, wait: long, x: double, y: double, edge: long>>"
_STATE = f"agent_id long, now long, upto long, t long, last long, at long, x double, y double, lx double, ly double, stack {_STACK}, retraced array<long>, times array<long>, backs array<boolean>, froms array<long>, tos array<long>, edges array<long>, then string"


def uniform(seed: int, *parts) -> float:
    """The draw of expressions.uniform."""
    return _draw("|".join(map(str, (seed, *parts))))


def _draw(name: str) -> float:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big") / 4294967296.0


def bonus(p, c, n) -> float:
    """Direction bonus as written: both vectors point into c and only the second angle is in degrees."""
    a = abs(math.atan2(c[1] - p[1], c[0] - p[0]) - math.atan2(c[1] - n[1], c[0] - n[0]) * 180.0 / 3.14159265359)
    a = 360.0 - a if a > 180 else a
    return 1.0 if a <= 45 else 0.0 if a <= 90 else -2.0


def _chances(options: list[tuple]) -> tuple:
    """Of the moves of one place, (node, x, y, wait, edge, pull): their nodes, the moves, and their chances."""
    top = max((m[5] for m in options), default=0.0)
    p = [math.exp((m[5] - top) / 0.5) for m in options]
    if len(options) > 1:
        whole = sum(p)
        p = [q / whole for q in p]
    return [m[0] for m in options], options, p, list(accumulate(p)), sum(p)


def stroll(a, moves: dict[int, list], seen: dict[float, dict], seed: int, width: int) -> tuple:
    """One agent's moves from its state until it turns home, its time ends, or it leaves the nodes at hand.

    `moves` has, per node, (node, x, y, metres, edge, duln) of its neighbours in the area by id; `seen` keeps them with their
    ticks and chances, by speed and by where an agent of this type comes from. A move goes to the stack with its ticks, and is
    undone from there where no neighbour is left. Returns the new state; `then` names the weighting of the way home, "" where
    the walk is over, None where it goes on in another cell.
    """
    t, last, at, x, y, lx, ly = int(a.t), int(a.last), int(a.at), a.x, a.y, a.lx, a.ly
    stack, retraced, hops = [(s["node"], s["wait"], s["x"], s["y"], s["edge"]) for s in a.stack], set(a.retraced), []
    came = len(a.path) > 0
    been = Counter([int(v) for v in a.path] + [s[0] for s in stack])  # nodes that the agent has left and not come back to
    start, time_ext, until, mine, known = a.start_v, a.time_ext, a.time_ext + a.extra, f"{seed}|{a.agent_id}|", seen.setdefault(a.speed, {})
    round_trip, cell, then = a.start_v == a.goal_v, at // width if width else 0, ""
    while t <= MAX_STEPS:
        if width and at // width != cell:
            then = None
            break
        timer = t / STEPS_PER_MINUTE
        if round_trip:
            if timer > time_ext and at == start and t > 1:
                break
        elif until <= timer:
            then = "distance"
            break
        key = (last, at, came or bool(stack))
        found = known.get(key)
        if found is None:
            ticks = lambda metres: max(1, math.ceil(math.ceil(metres / (a.speed * 1000 / 60)) * STEPS_PER_MINUTE))
            found = known[key] = _chances([(v, vx, vy, ticks(metres), edge, duln + (bonus((lx, ly), (x, y), (vx, vy)) if key[2] else 0.0)) for v, vx, vy, metres, edge, duln in moves.get(at, ()) if v != last])
        if retraced and not retraced.isdisjoint(found[0]):
            found = _chances([m for m in found[1] if m[0] not in retraced])
        to_nodes, options, p, upto, whole = found
        if options:
            if len(options) > 1 and not been.keys().isdisjoint(to_nodes):
                p = [1e-5 if v in been else q for v, q in zip(to_nodes, p)]
                upto, whole = list(accumulate(p)), sum(p)
            drawn = _draw(f"{mine}{t}") * whole
            to, tx, ty, wait, edge, _ = options[min(bisect_right(upto, drawn), len(upto) - 1)]
            stack.append((at, wait, x, y, edge))
            been[at] += 1
        else:
            retraced.add(at)
            if not stack:
                then = "little_attr"
                break
            to, wait, tx, ty, edge = stack.pop()
            if been[to] > 1:
                been[to] -= 1
            else:
                del been[to]
        hops.append((t, not options, at, to, edge))
        t += wait
        last, lx, ly, at, x, y = at, x, y, to, tx, ty
    names = ("node", "wait", "x", "y", "edge")
    kept = ([], []) if then is not None else ([dict(zip(names, s)) for s in stack], list(retraced))
    return int(a.upto) + len(hops), t, last, at, x, y, lx, ly, *kept, *(list(c) for c in (zip(*hops) if hops else ([], [], [], [], []))), then


def _strolled(agents: DataFrame, moves: DataFrame, duln: DataFrame, seed: int, area_rows: int) -> DataFrame:
    """(agent_id, now, upto, times, froms, tos, edges, .., then): a row for every agent and round, `upto` its hops so far; the row whose `then` is not null is the agent's last.

    `moves` is (aoi, u, v, x, y, metres, edge), the moves from any node to a neighbour in an area. Areas of up to `area_rows` moves are walked in
    one round. Of larger ones every round walks the cells where agents are, and hands those that leave a cell to the next.
    """
    sizes = moves.groupBy("aoi").agg(F.when(F.count("*") > area_rows, min(CELL, area_rows)).otherwise(0).cast("long").alias("width"))
    cell = lambda node: F.when(F.col("width") > 0, F.floor(node / F.col("width"))).otherwise(0)
    moves = cut(moves.join(sizes, "aoi").withColumn("cell", cell(F.col("u"))))
    agents = agents.join(sizes, "aoi", "left").withColumn("width", F.coalesce("width", F.lit(0)))
    fixed = [c for c in agents.columns if c not in ("upto", "t", "last", "at", "x", "y", "lx", "ly", "stack", "retraced", "now")]
    now, rounds = cut(agents.withColumns({"now": F.lit(0).cast("long"), "stack": F.expr(f"CAST(array() AS {_STACK})"), "retraced": F.expr("CAST(array() AS array<long>)")})), []

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list] = {}
        near = near.sort_values(["u", "v"])
        for u, *m in zip(*(near[c].tolist() for c in ("u", "v", "vx", "vy", "metres", "edge", "duln"))):
            by.setdefault(u, []).append(m)
        seen: dict[float, dict] = {}
        rows = [(a.agent_id, a.now, *stroll(a, by, seen, seed, int(a.width))) for a in own.itertuples(index=False)]
        return pd.DataFrame(rows, columns=STATE)

    while True:
        at = now.withColumn("cell", cell(F.col("at")))
        group = ["aoi", "cell", "agent_type"]
        share = cut(at.groupBy(*group).agg(F.ceil(F.count("*") / AGENTS).alias("parts")))  # a crowd is dealt to several tasks
        groups = share.agg(F.sum("parts")).first()[0]
        if not groups:
            break
        own = at.join(share, group).withColumn("part", F.pmod(F.xxhash64("agent_id"), F.col("parts")))
        near = moves.select("aoi", "cell", "u", "v", F.col("x").alias("vx"), F.col("y").alias("vy"), "metres", "edge").join(share.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), ["aoi", "cell"])
        near = near.join(duln, ["agent_type", "v"], "left").withColumn("duln", F.coalesce("duln", F.lit(0.0)))
        near = near.select(*[F.col(c).alias(c) for c in near.columns])
        keys = [*group, "part"]
        # a group's work follows its agents, not its bytes: twice as many partitions as groups, so that few share one
        own, near = (df.repartition(2 * groups, *keys) for df in (own, near))
        rounds.append(cut(own.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(run, _STATE)))
        rest = rounds[-1].where("then IS NULL").drop("times", "backs", "froms", "tos", "edges", "then").withColumn("now", F.col("now") + 1)
        now = cut(agents.select(*fixed).join(rest, "agent_id"))
    out = rounds[0] if rounds else cut(agents.sparkSession.createDataFrame([], _STATE))
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def _ways(agents: DataFrame, weights: DataFrame, src: str, goal: str, by: Column) -> DataFrame:
    """Agents with the weighting of their way (their type's own, where there is one), its metres and path; without a way they fall out."""
    named = weights.select("weighting").distinct()
    own = agents.withColumns({"_own": F.concat_ws(":", "agent_type", by), "_any": by}).join(named.select(F.col("weighting").alias("_own"), F.lit(True).alias("_is")), "_own", "left")
    own = own.withColumn("weighting", F.when(F.col("_is"), F.col("_own")).otherwise(F.col("_any"))).drop("_own", "_any", "_is")
    own = cut(own)
    pairs = own.select("weighting", F.col(src).alias("src"), F.col(goal).alias("goal")).distinct()
    found = shortest_paths(weights.join(pairs.select("weighting").distinct(), "weighting", "left_semi"), pairs).withColumnsRenamed({"src": src, "goal": goal, "distance": "metres"})
    return own.join(found, ["weighting", src, goal]).where(F.size("path") > 0).drop("weighting")


def _ticks(metres: Column, speed: Column) -> Column:
    return F.greatest(F.lit(1), timesteps(travel_minutes(metres, speed), "m"))


def simulated(agents: DataFrame, weights: DataFrame, nodes: DataFrame, edges: DataFrame, duln: DataFrame, seed: int = 1, as_written: bool = True, area_rows: int = AREA) -> DataFrame:
    """The log of all agents (agent_id, start_v, goal_v, aoi_goal, agent_type, speed, time_ext). `duln` is (agent_type, node_id, duln).

    Networks, areas and agents of any size: nothing is broadcast by hand or collected. Agents without a goal (-1 or null) or a way to it have no rows;
    without an area they turn home at their goal. Agents' ids are unique. Of parallel edges the one of the smallest id is walked.
    """
    one = edges.groupBy(F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b")).agg(F.min("edge_id").alias("edge_id"), F.min_by("shape_leng", "edge_id").alias("shape_leng"))
    one = cut(one)
    ends = lambda a, b: {"_a": F.least(a, b), "_b": F.greatest(a, b)}
    first = weights.agg(F.min("weighting")).first()[0]
    to = nodes.where("aoi IS NOT NULL").select(F.col("node_id").alias("v"), "aoi", "x", "y")
    moves = weights.where(F.col("weighting") == F.lit(first)).select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u != v").distinct().join(to, "v")
    moves = moves.join(agents.select(F.col("aoi_goal").alias("aoi")).distinct(), "aoi", "left_semi").withColumns(ends("u", "v")).join(one, ["_a", "_b"], "left")
    moves = moves.select("aoi", "u", "v", "x", "y", F.coalesce("shape_leng", F.lit(0.0)).alias("metres"), F.coalesce(F.col("edge_id").cast("long"), F.lit(NO_EDGE)).alias("edge"))

    who = cut(agents.where("goal_v != -1").select("agent_id", "start_v", "goal_v", F.coalesce("aoi_goal", F.lit("")).alias("aoi"), "agent_type", "speed", "time_ext"))
    out = _ways(who.where("start_v != goal_v"), weights, "start_v", "goal_v", F.lit("distance")).withColumn("wait", _ticks(F.col("metres"), F.col("speed")))
    out = out.withColumns({"t": 1 + F.col("wait"), "extra": (1 + F.col("wait") if as_written else F.col("wait") / STEPS_PER_MINUTE).cast("double")}).drop("wait", "metres")
    there = who.where("start_v = goal_v").withColumns({"path": F.expr("CAST(array() AS array<long>)"), "t": F.lit(1), "extra": F.lit(0.0)})
    gone = cut(out.unionByName(there).withColumn("t", F.col("t").cast("long")))
    xy = lambda key, *c: nodes.select(F.col("node_id").alias(key), F.col("x").cast("double").alias(c[0]), F.col("y").cast("double").alias(c[1]))
    begun = gone.where(F.col("t") <= MAX_STEPS).join(xy("start_v", "lx", "ly"), "start_v", "left").join(xy("goal_v", "x", "y"), "goal_v", "left")
    begun = begun.withColumns({"last": F.col("start_v"), "at": F.col("goal_v"), "upto": F.size("path").cast("long")})
    walked = _strolled(begun, moves, duln.select("agent_type", F.col("node_id").alias("v"), "duln"), seed, area_rows)
    turned = walked.where("then != ''").select("agent_id", "upto", "t", F.col("at").alias("turn_v"), "then")
    home = _ways(turned.join(who, "agent_id"), weights, "turn_v", "start_v", F.col("then"))

    leg = lambda start: F.posexplode(F.arrays_zip(F.concat(F.array(start), F.expr("slice(path, 1, greatest(size(path) - 1, 0))")).alias("a"), F.col("path").alias("b"))).alias("pos", "hop")
    # rows know their place in their phase, and phases how many hops the agent has behind it
    step = lambda df, before, t, behaviour, in_aoi, *edge: df.select("agent_id", (before + F.col("pos")).cast("int").alias("seq"), t.cast("long").alias("timestep"), behaviour.alias("behaviour"), F.col("hop.a").alias("from"), F.col("hop.b").alias("to"), F.lit(in_aoi).alias("in_aoi"), *edge)
    legs = step(gone.where(F.size("path") > 0).select("agent_id", leg("start_v")), F.lit(0), F.lit(1), F.lit("shortest"), False)
    legs = legs.unionByName(step(home.select("agent_id", "upto", "t", "then", leg("turn_v")), F.col("upto"), F.col("t"), F.when(F.col("then") == "distance", "shortest").otherwise("nicestShortest"), False))
    legs = legs.withColumns(ends("from", "to")).join(one.drop("shape_leng"), ["_a", "_b"], "left").select(*LOG)
    hops = F.posexplode(F.arrays_zip(F.col("times").alias("t"), F.col("backs").alias("back"), F.col("froms").alias("a"), F.col("tos").alias("b"), F.col("edges").alias("edge"))).alias("pos", "hop")
    edge = F.when(F.col("hop.edge") != NO_EDGE, F.col("hop.edge")).alias("edge_id")
    strolls = walked.select("agent_id", (F.col("upto") - F.size("times")).alias("before"), hops)
    return legs.unionByName(step(strolls, F.col("before"), F.col("hop.t"), F.when(F.col("hop.back"), "retracing").otherwise("nicest"), True, edge).select(*LOG))


def histories(log: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, family, prior_e, prior_e_aoi) from the log, in walking order."""
    hops = F.sort_array(F.collect_list(F.struct("seq", "edge_id", "in_aoi")))
    per = log.where("edge_id IS NOT NULL").groupBy("agent_id").agg(hops.alias("hops"))
    per = per.select("agent_id", F.col("hops.edge_id").alias("prior_e"), F.filter("hops", lambda h: h["in_aoi"])["edge_id"].alias("prior_e_aoi"))
    return agents.select("agent_id", lookup(FAMILY, F.col("agent_type")).alias("family")).join(per, "agent_id", "left")


def path_geometries(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(agent_id, behaviour, coords): the points each agent passed, by `seq` and node id; moves of one point only are left out."""
    at = nodes.select(F.col("node_id").alias("to"), F.struct("x", "y").alias("p"))
    pts = log.join(at, "to").groupBy("agent_id", "behaviour").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "to", "p"))), lambda v: v["p"]).alias("coords"))
    return pts.where(F.size("coords") > 1)
