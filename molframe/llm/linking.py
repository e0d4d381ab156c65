"""Links between candidates that share keys, without forming all pairs of a crowded key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from molframe.plans.graph import components
from molframe.session import discard, materialise, scratch

#: Pairs compared in full for each candidate that is left; above it, one more central member goes first
#: as long as that halves them.
PAIRS_EACH = 6


def link(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], edges: DataFrame | None = None,
         payload: Sequence[str] = (), near: Callable[[list[Column], list[Column]], Column] | None = None
         ) -> DataFrame:
    """id, label for every id of ``members`` and ``edges``: the smallest id of its group.

    ``members``: key, id and the columns of ``payload``. All pairs of a key are compared by
    ``confirm`` (pairs a, b to confirmed pairs) unless they are in one group already: first the most
    central member of each key with the others; what is linked is contracted, and pairs that are
    still apart go on. ``near`` drops pairs by their payloads before; ``edges`` are links known already.
    """
    test = near or (lambda a, b: F.lit(True))
    nodes = members.select("id")
    if edges is not None:
        nodes = nodes.unionByName(edges.select(F.explode(F.array("a", "b")).alias("id")))
    nodes = materialise(nodes.distinct(), "nodes")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight"))
    left = materialise(members.join(weight, "id"), "members")
    stored = [left]
    labels = None if edges is None else materialise(components(nodes, edges), "labels")
    before = None
    while True:
        grouped = left.withColumn("label", F.col("id"))
        if labels is not None:
            moved = labels.filter("id != label").select("id", "label")
            grouped = left.join(moved, "id", "left").withColumn("label", F.coalesce("label", "id"))
        grouped = materialise(grouped, "grouped")
        inside = grouped.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        per_key = materialise(inside.groupBy("key").agg(
            F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"),
            F.max_by("label", "c").alias("main")).filter("n * n > sq"), "keys")
        total = per_key.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2)
                            .alias("p")).first()
        if not total["n"]:
            discard(grouped, per_key)
            break
        open_ = grouped.join(per_key.select("key", "main"), "key")
        last = total["p"] <= PAIRS_EACH * total["n"] or (before is not None and 2 * total["p"] > before)
        before = total["p"]
        own, other = [F.col(c) for c in payload], [F.col(f"_{c}") for c in payload]
        if last:
            # those outside the main group of a key with all others: at most four times the open pairs
            met = (open_.filter("label != main").join(
                open_.select("key", *[F.col(c).alias(f"_{c}") for c in ("id", "label", *payload)]), "key")
                .filter(F.expr("label != _label") & test(own, other))
                .select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")))
        else:
            centre = open_.groupBy("key").agg(F.max_by(F.struct("id", "label", *payload), F.struct(
                "weight", -F.col("id"))).alias("top")).select("key", *[F.col(f"top.{c}").alias(f"_{c}")
                                                                       for c in ("id", "label", *payload)])
            opened = materialise(open_.join(centre, "key"), "open")
            discard(*stored, grouped, per_key)
            met = opened.filter(F.expr("label != _label") & test(own, other)).select(
                F.col("_id").alias("a"), F.col("id").alias("b"))
            left, stored = opened.filter("id != _id").select("key", "id", *payload, "weight"), [opened]
        with scratch() as scope:
            new = scope.keep(materialise(confirm(met.distinct()), "links"))
        edges = new if edges is None else edges.unionByName(new)
        with scratch() as scope:
            now = scope.keep(materialise(components(nodes, edges), "labels"))
        discard(labels)
        labels = now
        if last:
            discard(*stored, grouped, per_key)
            break
    return nodes.withColumn("label", F.col("id")) if labels is None else labels
