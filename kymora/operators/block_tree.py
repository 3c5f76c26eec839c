"""Extremes of blocks in a tree, for searches that run over a whole series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.operators.ordered import null_safe_join
from kymora.session import cut_lineage

#: Children of a node.
FAN = 1024


def extreme_levels(df: DataFrame, keys: Sequence[str], index: str, value: str, fan: int = FAN) -> list[DataFrame]:
    """Tables of nodes: keys, __node, and the lowest and highest value of each of its children (__lo, __hi), in order.

    A child is a row of the series at level 0 and a node of the level below further up; ``index`` is dense from 0.
    The last level has one node for each series.
    """
    top = df.agg(F.max(index)).first()[0] or 0
    rows = df.select(*keys, F.col(index).cast("long").alias("__c"), F.col(value).cast("double").alias("__l"), F.col(value).cast("double").alias("__h"))
    levels = []
    while True:
        g = rows.groupBy(*keys, F.floor(F.col("__c") / fan).alias("__node")).agg(F.array_sort(F.collect_list(F.struct("__c", "__l", "__h"))).alias("__r"))
        level = g.select(*keys, "__node", F.transform("__r", lambda r: r["__l"]).alias("__lo"), F.transform("__r", lambda r: r["__h"]).alias("__hi"))
        top //= fan
        levels.append(cut_lineage(level) if top else level)
        if not top:
            return levels
        rows = levels[-1].select(*keys, F.col("__node").alias("__c"), F.array_min("__lo").alias("__l"), F.array_max("__hi").alias("__h"))


def _search(lo, hi, child, height, side, low) -> tuple[np.ndarray, np.ndarray]:
    """From each child outwards: the lowest value up to the first child with a higher one, and that child (-1: none)."""
    lo, hi, out, hold = np.asarray(lo, float), np.asarray(hi, float), np.array(low, float), np.full(len(child), -1)
    for k, (c, h, s) in enumerate(zip(child, height, side)):
        near, far = (hi[:c][::-1], lo[:c][::-1]) if s < 0 else (hi[c + 1 :], lo[c + 1 :])
        higher = near > h
        stop = int(higher.argmax()) if higher.any() else len(near)
        if stop:
            out[k] = min(out[k], far[:stop].min())
        if stop < len(near):
            hold[k] = c - 1 - stop if s < 0 else c + 1 + stop
    return out, hold


@F.pandas_udf(T.StructType().add("low", T.ArrayType(T.DoubleType())).add("hold", T.ArrayType(T.LongType())))
def _searched(lo: pd.Series, hi: pd.Series, child: pd.Series, height: pd.Series, side: pd.Series, low: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_search(*row) for row in zip(lo, hi, child, height, side, low)], columns=["low", "hold"])


def lowest_before_higher(points: DataFrame, levels: list[DataFrame], keys: Sequence[str], index: str, height: str, fan: int = FAN) -> DataFrame:
    """For each point and side (-1, 1) the lowest value between it and the first higher one, or the end of the series.

    A search starts in the point's own node, goes up level by level where nothing higher is met, and down again into the
    node that holds the first higher value.  Searches of one block of points share a row at every step, so a step copies
    a node once for each block whose searches go through it.
    """
    i = F.col(index).cast("long")
    open_ = points.select(
        *keys, i.alias("__i"), F.col(height).cast("double").alias("__h"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("__s"),
        F.floor(i / fan).alias("__home"), F.floor(i / fan).alias("__node"), (i % fan).cast("int").alias("__c"), F.col(height).cast("double").alias("__low"),
    )
    found: list[DataFrame] = []

    def step(queries: DataFrame, level: int) -> DataFrame:
        """Search the nodes of one level; __hold is the child met, null where nothing is higher."""
        dealt = queries.groupBy(*keys, "__home", "__node").agg(F.collect_list(F.struct("__i", "__h", "__s", "__c", "__low")).alias("__q"))
        met = null_safe_join(dealt, levels[level], [*keys, "__node"], "inner")
        part = lambda c: F.transform("__q", lambda q: q[c])
        out = met.select(*keys, "__home", "__node", "__q", _searched("__lo", "__hi", part("__c"), part("__h"), part("__s"), part("__low")).alias("__o"))
        rows = out.select(*keys, "__home", "__node", F.inline(F.arrays_zip("__q", F.col("__o.low").alias("__new"), F.col("__o.hold").alias("__hold"))))
        held = F.when(F.col("__hold") >= 0, F.col("__node") * fan + F.col("__hold"))
        rows = rows.select(*keys, "__home", "__node", "__q.__i", "__q.__h", "__q.__s", F.col("__new").alias("__low"), held.alias("__hold"))
        return cut_lineage(rows) if len(levels) > 1 else rows

    def settle(rows: DataFrame) -> None:
        found.append(rows.select(*keys, "__i", "__s", "__low"))

    top = len(levels) - 1
    falls: dict[int, list[DataFrame]] = {}
    for level in range(top + 1):
        out = step(open_, level)
        if not top:
            settle(out)
            break
        met, missed = out.filter("__hold IS NOT NULL"), out.filter("__hold IS NULL")
        if level:
            falls.setdefault(level - 1, []).append(met)
        else:
            settle(met)
        if level == top:
            settle(missed)
        else:
            open_ = missed.select(*keys, "__i", "__h", "__s", "__home", F.floor(F.col("__node") / fan).alias("__node"), (F.col("__node") % fan).cast("int").alias("__c"), "__low")
    edge = F.when(F.col("__s") < 0, F.lit(fan)).otherwise(F.lit(-1))
    for level in range(top - 1, -1, -1):
        now = reduce(DataFrame.unionByName, falls[level])
        out = step(now.select(*keys, "__i", "__h", "__s", "__home", F.col("__hold").alias("__node"), edge.alias("__c"), "__low"), level)
        if level:
            falls[level - 1].append(out)
        else:
            settle(out)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("__i", index)
