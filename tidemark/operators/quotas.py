"""Quotas and selection over ordered clips, without mutable counters."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(rows: DataFrame, keys: list[str], order: list[str], cap: Column, eligible: Column) -> DataFrame:
    """The first cap eligible rows of each key in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where(eligible).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def validation_cap(split: Column, cap: int, least: int = 2) -> Column:
    return F.when(split == "train", cap).otherwise(max(least, cap // 8))


def per_clip(events: DataFrame, keys: list[str], clip_order: str, cap: Column) -> DataFrame:
    """Events whose key has fewer than cap events in earlier clips: a clip's events pass together, so the last clip may overshoot."""
    earlier = Window.partitionBy(*keys).orderBy(clip_order).rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_n", F.count(F.lit(1)).over(earlier)).where(F.col("_n") < cap).drop("_n")


def coupled(clips: DataFrame, keys: list[str], order: str, empty: Column, cap: int) -> DataFrame:
    """The first cap clips of each key, of which at most a tenth may be empty; an empty clip beyond those is passed over."""
    rank = F.row_number().over(Window.partitionBy(*keys, "_empty").orderBy(order))
    rows = clips.withColumn("_empty", empty).withColumn("_e", rank).where(~F.col("_empty") | (F.col("_e") <= cap // 10))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= cap).drop("_r", "_e", "_empty")


def group_matrix(clips: DataFrame, group: list[str], label: str = "label", labels: list[str] | None = None) -> DataFrame:
    """A row for each group with a count column for each label."""
    return clips.groupBy(*group).pivot(label, labels).count().na.fill(0)


def greedy_cover(clips: DataFrame, group: str | list[str], label: str, cap: int, budget: int) -> DataFrame:
    """group, pick_ord, gain: groups picked one by one for the most remaining quota, weighted so that rare labels count like common ones.

    A clip with several labels is several rows.  The choice is sequential by
    nature: what reaches the driver is a count for each label of each group,
    which grows with row groups and not with clips.  Gains only ever fall, so a
    heap of earlier gains shows the next pick without looking at every group.
    """
    group = [group] if isinstance(group, str) else list(group)
    counts = clips.groupBy(*group, label).count().collect()
    have: dict[tuple, dict] = {}
    total: dict = {}
    for r in counts:
        have.setdefault(tuple(r[g] for g in group), {})[r[label]] = r["count"]
        total[r[label]] = total.get(r[label], 0) + r["count"]
    weight = {c: 1 / max(1, min(cap, n)) for c, n in total.items()}
    need = dict.fromkeys(total, cap)
    have = {g: {c: own[c] for c in sorted(own)} for g, own in have.items()}
    gain = lambda own: round(float(sum(min(n, need[c]) * weight[c] for c, n in own.items())), 9)  # noqa: E731  (so that equal gains are equal in any order of labels)
    heap = [(-gain(own), g, 0) for g, own in have.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < budget:
        negative, g, seen = heapq.heappop(heap)
        if seen < len(out):  # the gain is from before the last pick
            heapq.heappush(heap, (-gain(have[g]), g, len(out)))
        elif negative < 0:
            out.append((*g, len(out), -negative))
            for c, n in have[g].items():
                need[c] = max(need[c] - n, 0)
        else:
            break
    kinds = dict(clips.dtypes)
    return clips.sparkSession.createDataFrame(out, ", ".join([f"`{g}` {kinds[g]}" for g in group] + ["pick_ord int, gain double"]))


def top_groups(clips: DataFrame, group: list[str], picked: DataFrame, n: int) -> DataFrame:
    """The n groups with most validation clips among those not picked; ties go to the smaller group."""
    counts = clips.where("split = 'val'").groupBy(*group).agg(F.count(F.lit(1)).alias("n_val"))
    return counts.join(picked.select(*group), group, "left_anti").orderBy(F.desc("n_val"), *group).limit(n)


def select_rowgroups(clips: DataFrame, group: list[str], labels: str, cap: int, budget: int, n_val: int, known: list[str] | None = None) -> DataFrame:
    """group, pick_ord: the greedy cover of clips by their labels (an array column; unknown ones do not count), then the n_val groups with most validation clips."""
    pairs = clips.select(*group, F.explode(labels).alias("label"))
    if known is not None:
        pairs = pairs.where(F.col("label").isin(known))
    picks = greedy_cover(pairs, group, "label", cap, budget).select(*group, "pick_ord")
    order = F.row_number().over(Window.orderBy(F.desc("n_val"), *group))  # n_val rows
    more = top_groups(clips, group, picks, n_val).crossJoin(picks.agg(F.count(F.lit(1)).alias("_n"))).select(*group, (F.col("_n") + order - 1).cast("int").alias("pick_ord"))
    return picks.unionByName(more)


def in_pick_order(items: DataFrame, picks: DataFrame, group: list[str]) -> DataFrame:
    """items of the picked groups with pick_ord, one group after another; a group's items stay in one task's range."""
    return items.join(F.broadcast(picks.select(*group, "pick_ord")), group).repartitionByRange(F.col("pick_ord")).sortWithinPartitions("pick_ord")  # a row for each pick


def drawn(items: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """draw, label and key of n seeded draws: first a label, all alike, then one of its items, all alike.

    Labels and their counts are few; draws are made where they are numbered and
    meet their items by label and rank, so no label's items are gathered.
    """
    ranked = items.select(label, key, (F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)) - 1).alias("_at"))
    sizes = items.groupBy(label).count().withColumn("_label", F.row_number().over(Window.orderBy(label)) - 1)
    labels = sizes.count()
    if not labels:
        return ranked.select(F.lit(0).cast("long").alias("draw"), label, key).limit(0)
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(labels)).cast("int").alias("_label"), F.xxhash64(F.lit(seed + 1), "id").alias("_h"))
    draws = draws.join(F.broadcast(sizes), "_label").withColumn("_at", F.pmod("_h", F.col("count")).cast("int"))  # a row for each label
    return draws.join(ranked, [label, "_at"]).select("draw", label, key)


def head_of(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return first_n(rows, keys, order, F.lit(n), F.lit(True))


def copies(rows: DataFrame, more: int) -> DataFrame:
    """rows plus copy: each row as itself (copy 0) and more times again, to be augmented under the seed (row, copy)."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(more))))
