"""Passage counts: how many agents pass each edge or node, per family, with and without areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowengine.functions.expressions import FAMILIES


def edge_passage(histories: DataFrame, history: str = "prior_e") -> DataFrame:
    """(edge_id, n): agents per edge, each agent once. The arrays are made distinct in place, so only partial counts shuffle."""
    return histories.select(F.explode(F.array_distinct(history)).alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("n"))


def visits_passage(visits: DataFrame, agent: str, edge: str) -> DataFrame:
    """The same from long (agent, edge) rows."""
    return visits.select(agent, edge).distinct().groupBy(edge).agg(F.count("*").alias("n"))


def family_passage(histories: DataFrame, family: str = "family", history: str = "prior_e", families=FAMILIES, prefix: str = "passage_") -> DataFrame:
    """(edge_id, passage, passage_<family>...): a fixed pivot in one aggregation."""
    one = histories.select(family, F.explode(F.array_distinct(history)).alias("edge_id"))
    return one.groupBy("edge_id").agg(F.count("*").alias(prefix.rstrip("_")), *[F.count_if(F.col(family) == f).alias(prefix + f) for f in families])


def node_passage(histories: DataFrame, *columns: str) -> DataFrame:
    """(node_id, n): visits with multiplicity over all the history columns; null histories are empty."""
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(histories.schema[c].dataType)) for c in columns])
    return histories.select(F.explode(every).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))


def combined_passage(edges: DataFrame, histories: DataFrame, families=FAMILIES) -> DataFrame:
    """Edges with passage counts added to what they had: passage takes both histories, passage_aoi the one in areas of interest.

    Both histories are counted in one shuffle: rows of the first carry aoi = 0, of the second aoi = 1.
    """
    def tagged(column: str, aoi: int):
        visits = F.coalesce(F.array_distinct(column), F.array().cast("array<bigint>"))
        return F.transform(visits, lambda e: F.struct(e.cast("bigint").alias("edge_id"), F.lit(aoi).alias("aoi")))

    both = histories.select("family", F.explode(F.concat(tagged("prior_e", 0), tagged("prior_e_aoi", 1))).alias("x")).select("family", "x.edge_id", "x.aoi")
    of = lambda f: F.lit(True) if f is None else F.col("family") == f
    names = [(None, "")] + [(f, "_" + f) for f in families]
    counts = both.groupBy("edge_id").agg(
        *[F.count_if(of(f)).alias(f"new{n}") for f, n in names], *[F.count_if(of(f) & (F.col("aoi") == 1)).alias(f"new{n}_aoi") for f, n in names]
    )
    have = set(edges.columns)
    old = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    added = {f"passage{n}{s}": old(f"passage{n}{s}") + F.coalesce(F.col(f"new{n}{s}"), F.lit(0)) for _, n in names for s in ("", "_aoi")}
    return edges.join(counts, "edge_id", "left").withColumns(added).drop(*[f"new{n}{s}" for _, n in names for s in ("", "_aoi")])


def incident_passage(edges: DataFrame, aoi_nodes: DataFrame) -> DataFrame:
    """Edges with passage_aoi2: the passage of edges with an end in an area of interest, else 0."""
    marked = aoi_nodes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array("from", "to")).alias("node_id")).join(marked, "node_id", "left_semi").select("edge_id").distinct().withColumn("_in", F.lit(True))
    return edges.join(ends, "edge_id", "left").withColumn("passage_aoi2", F.when(F.col("_in"), F.col("passage")).otherwise(0)).drop("_in")


def selected_passage(edges: DataFrame, group: int, aoi_only: bool, families=FAMILIES) -> DataFrame:
    """(edge_id, selected): the passage column of visitor group 1 (all) .. 5."""
    name = "passage" + ("" if group == 1 else "_" + families[group - 2]) + ("_aoi" if aoi_only else "")
    return edges.select("edge_id", F.col(name).alias("selected"))


def line_style(edges: DataFrame, selected: str, highest: str, factor: float = 2.0) -> DataFrame:
    """Edges with a line width: 2 + factor * selected / max(highest). The maximum is one aggregated row, not a window."""
    top = edges.agg(F.max(highest).alias("_top"))
    return edges.join(F.broadcast(top), how="cross").withColumn("width", 2.0 + F.coalesce(F.try_divide(F.col(selected), F.col("_top")), F.lit(0.0)) * factor).drop("_top")


def start_points(nodes: DataFrame, agents: DataFrame) -> DataFrame:
    """Nodes at which some agent starts."""
    return nodes.join(agents.select(F.col("start_v").alias("node_id")).distinct(), "node_id", "left_semi")


def trajectory_edges(steps: DataFrame, agent: str, order: list[str], node: str) -> DataFrame:
    """(agent, seq, from, to): moves between consecutive places of each agent."""
    w = Window.partitionBy(agent).orderBy(*order)
    moves = steps.select(agent, F.row_number().over(w).alias("seq"), F.lag(node).over(w).alias("from"), F.col(node).alias("to"))
    return moves.where(F.col("from").isNotNull())


def match_edges(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """Moves with edge_id: equal ends in either direction, the smallest id of parallel edges, null where no edge is."""
    one = edges.select(F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b"), "edge_id").groupBy("_a", "_b").agg(F.min("edge_id").alias("edge_id"))
    keyed = moves.withColumns({"_a": F.least("from", "to"), "_b": F.greatest("from", "to")})
    return keyed.join(one, ["_a", "_b"], "left").drop("_a", "_b")
