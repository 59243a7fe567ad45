"""Label-propagation clusters (G6) and the cluster report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.storage import cut


def propagate(labels: np.ndarray, start: np.ndarray, near: np.ndarray, max_sweeps: int) -> np.ndarray:
    """Sweeps over the nodes in order, each taking its neighbours' most frequent label, of equal ones the smallest.

    The neighbours of node k are near[start[k] : start[k + 1]], as places of nodes.
    """
    edges = start.tolist()
    for _ in range(max_sweeps):
        changed = False
        for k in range(len(labels)):
            around = labels[near[edges[k] : edges[k + 1]]]
            if len(around) == 1:
                best = around[0]
            elif len(around):
                held, counts = np.unique(around, return_counts=True)  # in order, so the first of the largest counts is the smallest label
                best = held[counts.argmax()]
            else:
                continue
            if best != labels[k]:
                labels[k], changed = best, True
        if not changed:
            break
    return labels


#: Link ends of a component up to which one task works on it.
MOST_LINKS = 20_000_000


def waves(links: DataFrame, max_sweeps: int) -> DataFrame:
    """(label, cluster) by the same sweeps over links(a, b) in both orientations, a node standing for its place in the order.

    In a sweep a node waits for its neighbours that come before it and sees the others as the last sweep left them. So a node's wave is one more than
    the latest of those it waits for, all nodes of a wave are decided at once, and a sweep is a join for each wave; nothing is held in one place.
    """
    waits = cut(links.filter("b < a"), "waits")
    level, changed = cut(links.select(F.col("a").alias("label")).distinct().withColumn("wave", F.lit(0)), "waves"), True
    while changed:
        after = waits.join(level.select(F.col("label").alias("b"), "wave"), "b").groupBy(F.col("a").alias("label")).agg((F.max("wave") + 1).alias("later"))
        moved = cut(level.join(after, "label", "left").select("label", F.coalesce("later", F.lit(0)).alias("wave"), (F.coalesce("later", F.lit(0)) != F.col("wave")).alias("moved")), "waves")
        level, changed = moved.select("label", "wave"), moved.filter("moved").limit(1).count() > 0
    dealt = cut(links.join(level.select(F.col("label").alias("a"), "wave"), "a"), "wave-links")
    last = level.agg(F.max("wave")).first()[0]
    held = [] if last is None else [level.filter(F.col("wave") == k).select("label", F.col("label").alias("cluster")) for k in range(last + 1)]
    for _ in range(max_sweeps):
        changed = 0
        for k in range(len(held)):
            now = reduce(DataFrame.union, held)
            votes = dealt.filter(F.col("wave") == k).join(now.select(F.col("label").alias("b"), "cluster"), "b").groupBy("a", "cluster").agg(F.count(F.lit(1)).alias("n"))
            most = votes.groupBy(F.col("a").alias("label")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("best"))
            new = cut(most.select("label", "best.cluster").join(held[k].withColumnRenamed("cluster", "before"), "label"), "wave-labels")
            changed += new.filter("cluster <> before").count()
            held[k] = new.select("label", "cluster")
        if not changed:
            break
    return reduce(DataFrame.union, held) if held else level.select("label", F.col("label").alias("cluster"))


def clusters(nodes: DataFrame, between: DataFrame, found: DataFrame, max_sweeps: int = 20, most_links: int = MOST_LINKS) -> DataFrame:
    """(fname, cluster) by asynchronous label propagation.

    Labels start as the names' ranks, which stand for the names: a component travels as numbers. A sweep is a chain of
    single decisions and never leaves a component, so each component of two notes and more is worked on by one
    task, in arrays of 8 bytes for each node and link end, if it has at most ``most_links`` of these; larger ones are swept in ``waves``
    over all tasks, with the same result.
    """
    ranked = ranks(nodes)
    number = lambda side: between.join(ranked.select(F.col("fname").alias(side), F.col("label").alias(f"label_{side}")), side)
    links = number("a").select("b", "label_a").join(ranked.select(F.col("fname").alias("b"), F.col("label").alias("label_b")), "b").select("label_a", "label_b")
    around = links.groupBy(F.col("label_a").alias("label")).agg(F.collect_set("label_b").alias("near"))
    rows = cut(ranked.join(found, "fname").join(around, "label", "left"), "linked")

    def work(group: pa.Table) -> pa.Table:
        own = group.column("label").to_numpy()
        order = np.argsort(own)
        lists = pa.compute.take(group.column("near").combine_chunks(), pa.array(order))
        own = own[order]
        start = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
        near = np.searchsorted(own, pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False))
        names = pa.compute.take(group.column("fname"), pa.array(order))
        return pa.table({"fname": names, "cluster": pa.array(propagate(own.copy(), start, near, max_sweeps), pa.int64())})

    linked = rows.filter("near is not null").select("component", "fname", "label", "near")
    large = cut(linked.groupBy("component").agg(F.sum(F.size("near")).alias("ends")).filter(F.col("ends") > most_links).select("component"), "large")
    some = large.limit(1).count() > 0
    worked = (linked.join(large, "component", "left_anti") if some else linked).groupBy("component").applyInArrow(work, "fname string, cluster long")
    out = worked.union(rows.filter("near is null").select("fname", F.col("label").alias("cluster")))
    if some:
        mine = linked.join(large, "component", "left_semi")
        swept = waves(mine.select(F.col("label").alias("a"), F.explode("near").alias("b")), max_sweeps)
        out = out.union(mine.select("fname", "label").join(swept, "label").select("fname", "cluster"))
    return out


def ranks(nodes: DataFrame) -> DataFrame:
    """(fname, label): each name's place in the order of all names, from counts per range of names."""
    names = nodes.select("fname").distinct()
    parted = names.repartitionByRange("fname").sortWithinPartitions("fname")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pd.DataFrame({"fname": batch["fname"], "part": part, "local": range(at, at + len(batch))})
            at += len(batch)

    held = cut(parted.mapInPandas(number, "fname string, part int, local long"), "name-ranks")
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    return held.join(before, "part").select("fname", (F.col("local") + F.col("before")).alias("label"))


def report(members: DataFrame, tags: DataFrame, least: int = 3) -> DataFrame:
    """(cluster, size, top_tags, members) of clusters of ``least`` notes or more, largest first.

    members(cluster, fname); tags(fname, tag), a row for each time a note has a tag. Five tags, by count, then name; ten members.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.slice(F.sort_array(F.collect_list("fname")), 1, 10).alias("members")).filter(F.col("size") >= least)
    counted = members.join(tags, "fname").groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("count"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "tag"))).filter("k <= 5")
    top = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag", "count"))), lambda x: F.struct(x["tag"].alias("tag"), x["count"].alias("count"))).alias("top_tags"))
    none = F.expr("cast(array() as array<struct<tag:string,count:bigint>>)")
    return sizes.join(top, "cluster", "left").select("cluster", "size", F.coalesce("top_tags", none).alias("top_tags"), "members").orderBy(F.desc("size"), "cluster")
