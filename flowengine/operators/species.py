"""Species: filters by priority and threat, weights, group toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowengine.functions.expressions import lookup

#: What each filter keeps; s1 keeps all.
PRIORITY_FILTERS = {"s2": ["PR1"], "s3": ["PR1", "PR2"], "s4": ["PR1", "PR2", "PR3"], "s5": ["PR1", "PR2", "PR3", "PR4"]}
THREAT_FILTERS = {"s6": ["CR"], "s7": ["CR", "EN"], "s8": ["CR", "EN", "VU"], "s9": ["CR", "EN", "VU", "NT"]}
THREAT_WEIGHT = {"CR": 5, "EN": 4, "VU": 3, "NT": 2, "LC": 1}
PRIORITY_WEIGHT = {"PR1": 5, "PR2": 4, "PR3": 3, "PR4": 2}


def filtered(species: DataFrame, code: str = "s8") -> DataFrame:
    if code in PRIORITY_FILTERS:
        return species.where(F.col("ch_priority").isin(PRIORITY_FILTERS[code]))
    return species.where(F.col("threat").isin(THREAT_FILTERS[code])) if code in THREAT_FILTERS else species


def weighted(species: DataFrame, by: str = "threat") -> DataFrame:
    """Species with `weight`: by threat (null for other codes) or by priority (1 for other codes)."""
    w = lookup(THREAT_WEIGHT, F.col("threat")) if by == "threat" else F.coalesce(lookup(PRIORITY_WEIGHT, F.col("ch_priority")), F.lit(1))
    return species.withColumn("weight", w)


def toggled(selected: DataFrame, members: DataFrame, on: list[str], off: list[str]) -> DataFrame:
    """Species after group toggles: those of groups switched off go, even if another group holds them, then those of `on` come back."""
    less = selected.select("species").subtract(members.where(F.col("group").isin(off)).select("species"))
    return less.union(members.where(F.col("group").isin(on)).select("species")).distinct()


def complete_groups(selected: DataFrame, members: DataFrame) -> DataFrame:
    """Groups all of whose species are selected."""
    missing = members.join(selected, "species", "left_anti").select("group").distinct()
    return members.select("group").distinct().join(missing, "group", "left_anti")
