"""A plain simulation in one process: one state machine per agent over the whole network. Tests hold the Spark phases against it."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np

from flowengine.functions.expressions import STEPS_PER_MINUTE
from flowengine.operators.simulate import MAX_STEPS, bonus, uniform


class Csr:
    """Adjacency of one weighting in flat arrays, nodes by rank of their id."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.nodes = np.unique(np.concatenate([src, dst]))
        order = np.lexsort((dst, src))
        self.to, self.w = np.searchsorted(self.nodes, dst[order]), w[order]
        self.start = np.searchsorted(np.searchsorted(self.nodes, src[order]), np.arange(len(self.nodes) + 1))

    def settle(self, source: int, goals: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
        """Distances and predecessors (by id), in settling order (distance, node id); stops when all goals are settled."""
        s = int(np.searchsorted(self.nodes, source))
        if s == len(self.nodes) or self.nodes[s] != source:
            return {source: 0.0}, {}
        best, before, done, heap = {s: 0.0}, {}, {}, [(0.0, s)]
        left = None if goals is None else set(goals)
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = d
            if left is not None:
                left.discard(int(self.nodes[v]))
                if not left:
                    break
            for e in range(self.start[v], self.start[v + 1]):
                u, x = int(self.to[e]), d + float(self.w[e])
                if x < best.get(u, np.inf):
                    best[u], before[u] = x, v
                    heapq.heappush(heap, (x, u))
        name = self.nodes
        return {int(name[v]): d for v, d in done.items()}, {int(name[u]): int(name[v]) for u, v in before.items() if u in done}


def path_to(before: dict[int, int], source: int, goal: int) -> list[int]:
    """Nodes after the source up to the goal; the goal alone where it is the source, nothing where it was not reached."""
    if source == goal:
        return [goal]
    path, v = [], goal
    while v in before:
        path.append(v)
        v = before[v]
    return path[::-1] if v == source else []


class World:
    """What all agents share: graphs by weighting, node attributes by id, edge ids by ends."""

    def __init__(self, graphs: dict[str, Csr], xy: dict[int, tuple[float, float]], aoi: dict[int, str], duln: dict[tuple[str, int], float], edge: dict[tuple[int, int], tuple[int, float]]):
        self.graphs, self.xy, self.aoi, self.duln, self.edge = graphs, xy, aoi, duln, edge
        g = next(iter(graphs.values()))
        self.near = {int(v): [int(g.nodes[u]) for u in g.to[g.start[i] : g.start[i + 1]]] for i, v in enumerate(g.nodes)}
        self.inside = self._inside

    def route(self, kind: str, weighting: str, src: int, goal: int) -> tuple[list[int], float]:
        name = f"{kind}:{weighting}"
        return self._route(name if name in self.graphs else weighting, src, goal)

    def _route(self, name: str, src: int, goal: int) -> tuple[list[int], float]:
        dist, before = self.graphs[name].settle(src, {goal})
        return path_to(before, src, goal), dist.get(goal, 0.0)

    def _inside(self, node: int, area: str) -> list[int]:
        """Neighbours of a node in the area, by id."""
        return sorted({v for v in self.near.get(node, []) if v != node and self.aoi.get(v) == area})


def walk(world: World, agent, seed: int, as_written: bool = True) -> list[tuple]:
    """The log of one agent: (agent_id, start_v, goal_v, aoi_goal, agent_type, speed, time_ext)."""
    me, start, goal, area, kind, speed, extent = agent
    if goal == -1:
        return []
    log: list[tuple] = []
    steps = lambda metres: max(1, math.ceil(math.ceil(metres / (speed * 1000 / 60)) * STEPS_PER_MINUTE))
    behaviour, current, last, nxt, t, path, prior, retraced, extra = "shortest", start, None, start, 1, None, [], set(), 0.0
    been = Counter()  # how often each node is in prior

    def log_hops(nodes: list[int], edges_in: bool) -> None:
        for a, b in zip(nodes, nodes[1:]):
            e = world.edge.get((min(a, b), max(a, b)))
            log.append((me, len(log), t, behaviour, a, b, e[0] if e else None, edges_in))

    while t <= MAX_STEPS:
        if t > 1 and behaviour == "retracing":
            behaviour = "nicest"
        elif t > 1:
            passed = path if path and behaviour in ("shortest", "nicestShortest") else [current]
            prior += passed
            been.update(passed)
        last, current = current, nxt
        timer = t / STEPS_PER_MINUTE
        if (timer > extent or behaviour in ("shortest", "nicestShortest")) and goal == start == current and t > 1:
            break
        if behaviour == "shortest" and goal == current:
            behaviour, path = "nicest", None
        if extent + extra <= timer:
            behaviour = "shortest" if goal != start else behaviour
            goal, path = start, None
        if behaviour == "nicest":
            options = [v for v in world.inside(current, area) if v != last and v not in retraced]
            if options:
                x = np.array([world.duln.get((kind, v), 0.0) + (bonus(world.xy[last], world.xy[current], world.xy[v]) if prior and last is not None else 0.0) for v in options])
                p = np.exp((x - x.max()) / 0.5)
                p /= p.sum()
                if len(options) > 1:
                    p = np.where([been[v] > 0 for v in options], 1e-5, p)
                nxt = options[int(min(np.searchsorted(np.cumsum(p), uniform(seed, me, t) * p.sum(), "right"), len(p) - 1))]
            else:
                behaviour = "retracing"
        if behaviour == "retracing":
            nxt = prior.pop() if prior else current
            been[nxt] -= 1
            retraced.add(current)
            if nxt == current:
                behaviour, goal, path = "nicestShortest", start, None
        if behaviour in ("shortest", "nicestShortest"):
            if not path:
                path, metres = world.route(kind, "distance" if behaviour == "shortest" else "little_attr", current, goal)
            else:
                metres = 0.0
            if not path:
                break
            nxt = goal = path[-1]
            log_hops([current, *path], False)
            wait = steps(metres)
            if behaviour == "shortest":
                extra += t + wait if as_written else wait / STEPS_PER_MINUTE
        else:
            e = world.edge.get((min(current, nxt), max(current, nxt)))
            log_hops([current, nxt], True)
            wait = steps(e[1] if e else 0.0)
        t += wait
    return log


def walked(agents, weights, nodes, edges, duln, seed: int = 1, as_written: bool = True) -> list[tuple]:
    """The log of all agents, from tables of any size that fit in here."""
    rows = weights.select("weighting", "src", "dst", "w").toPandas()
    graphs = {k: Csr(g.src.to_numpy(), g.dst.to_numpy(), g.w.to_numpy(float)) for k, g in rows.groupby("weighting")}
    n, e, d = (df.toPandas() for df in (nodes.select("node_id", "x", "y", "aoi"), edges.select("edge_id", "from", "to", "shape_leng"), duln.select("agent_type", "node_id", "duln")))
    e = e.sort_values("edge_id", ascending=False)  # of parallel edges the first stays
    ends = {(min(a, b), max(a, b)): (i, w) for i, a, b, w in e.itertuples(index=False)}
    world = World(graphs, dict(zip(n.node_id, zip(n.x, n.y))), dict(zip(n.node_id, n.aoi)), {(k, v): x for k, v, x in d.itertuples(index=False)}, ends)
    who = agents.select("agent_id", "start_v", "goal_v", "aoi_goal", "agent_type", "speed", "time_ext").collect()
    return [r for a in who for r in walk(world, tuple(a), seed, as_written)]
