"""Iterative graph work as joins. Lineage is cut by reliable checkpoints each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from molframe.plans.ordered import dense_index, running
from molframe.session import discard, scratch, settle


#: Edges that fit one task (16 bytes each).
FEW_EDGES = 100_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each connected component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds
    grows with the logarithm of the diameter, and minima are combined before the shuffle.
    """
    e = settle(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _fingerprint(e)
    # few edges need no shuffle: one task holds them all
    few = mark[0] <= FEW_EDGES
    while True:
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = (e.coalesce(1) if few else e).select(ways.alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # each star: its rim to the smallest member, and its centre too
        star = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, e = e, settle(star.select("e.*").filter("u != v").distinct())
        discard(old)
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    return nodes.select("id").join(e.select(F.col("u").alias("id"), F.col("v").alias("label")),
                                   "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def spread_nulls(key: str, by: str) -> Column:
    """``key`` (non-negative) with a negative value by the row's own ``by`` in place of null.

    A left join on it finds the same rows, and rows without a key do not meet in one task.
    """
    return F.coalesce(F.col(key), -1 - F.pmod(F.xxhash64(by), F.lit(1 << 40)))


def _fingerprint(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def bfs(starts: DataFrame, edges: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Level-synchronous search: key, id, dist, parent (smallest id on ties).

    ``starts``: key, id; ``edges``: key, a, b (undirected, one row each way is added here);
    many graphs run at once, one per key. A new level can only meet the two levels before it, so
    each round looks at those alone. With ``goals`` (key, id) the search of a key ends when all
    its goals are reached. The number of rounds is the longest distance.
    """
    e = edges.select("key", "a", "b")
    e = settle(e.unionByName(e.select("key", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    level = settle(starts.select("key", "id", F.lit(0).cast("bigint").alias("dist"),
                                 F.lit(None).cast(starts.schema["id"].dataType).alias("parent")))
    seen, before, step = [level], None, 0
    left = None if goals is None else settle(goals.join(level, ["key", "id"], "left_anti"))
    while True:
        step += 1
        front = level
        if left is not None:
            front = front.join(left.select("key").distinct(), "key", "left_semi")
        near = (front.select("key", F.col("id").alias("a")).join(e, ["key", "a"])
                .groupBy("key", F.col("b").alias("id")).agg(F.min("a").alias("parent")))
        for old in (level, before):
            if old is not None:
                near = near.join(old.select("key", "id"), ["key", "id"], "left_anti")
        nxt = settle(near.select("key", "id", F.lit(step).cast("bigint").alias("dist"), "parent"))
        if nxt.isEmpty():
            break
        seen.append(nxt)
        before, level = level, nxt
        if left is not None:
            left = settle(left.join(nxt, ["key", "id"], "left_anti"))
            if left.isEmpty():
                break
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


def paths(tree: DataFrame, goals: DataFrame) -> DataFrame:
    """Union of the tree paths from the start to each goal: key, goal, id, dist.

    Walks up by pointer doubling: round k adds the 2^k-th ancestors.
    """
    reached = goals.join(tree.select("key", "id", "dist"), ["key", "id"])
    rows = settle(reached.select("key", F.col("id").alias("goal"), "id", "dist"))
    jump = settle(tree.filter(F.col("parent").isNotNull()).select("key", "id",
                                                                   F.col("parent").alias("to")))
    step = 1
    while not jump.isEmpty():
        up = rows.join(jump, ["key", "id"]).select(
            "key", "goal", F.col("to").alias("id"), (F.col("dist") - step).alias("dist"))
        rows = settle(rows.unionByName(up))
        jump = settle(jump.join(jump.select("key", F.col("id").alias("to"), F.col("to").alias("_t")),
                                ["key", "to"]).select("key", "id", F.col("_t").alias("to")))
        step *= 2
    return rows


def rank(links: DataFrame) -> DataFrame:
    """Order from neighbour pointers alone. ``links``: id, n5. Result: id, head, pos, circular.

    Pointer doubling over unique ids: log2(n) joins without a hot key. A circle is opened at its
    smallest id.
    """
    def double(up):
        far = up.select(F.col("id").alias("_key"), F.col("to").alias("_to"), F.col("head").alias("_h"),
                        F.col("d").alias("_d"), F.col("low").alias("_low"))
        # finished rows have no next one: each gets a key of its own that matches nothing
        return settle(up.withColumn("_key", spread_nulls("to", "id")).join(far, "_key", "left").select(
            "id", F.col("_to").alias("to"), F.coalesce("_h", "head").alias("head"),
            (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"),
            F.least("low", "_low").alias("low")))

    def start(rows):
        to = F.col("n5")
        return settle(rows.select("id", to.alias("to"), F.coalesce(to, F.col("id")).alias("head"),
                                  F.when(to.isNull(), 0).otherwise(1).cast("bigint").alias("d"),
                                  F.least(F.coalesce(to, F.col("id")), F.col("id")).alias("low")))

    def open_count(up):
        return up.agg(F.count("to"), F.sum(F.when(F.col("to").isNotNull(), F.col("low"))
                                           .cast("decimal(38,0)"))).first()

    up = start(links)
    mark = open_count(up)
    while mark[0]:
        old, up = up, double(up)
        discard(old)
        now = open_count(up)
        # linear strands shrink each round; circles are done when their minima stand still
        if now == mark:
            break
        mark = now
    done = up.filter(F.col("to").isNull()).select("id", "head", F.col("d").alias("pos"),
                                                  F.lit(False).alias("circular"))
    circles = up.filter(F.col("to").isNotNull()).select("id", "low")
    if circles.isEmpty():
        return done
    cut = links.join(circles, "id").select("id", F.when(F.col("id") != F.col("low"), F.col("n5"))
                                           .alias("n5"))
    up = start(cut)
    while up.agg(F.count("to")).first()[0]:
        old, up = up, double(up)
        discard(old)
    return done.unionByName(up.select("id", "head", F.col("d").alias("pos"),
                                      F.lit(True).alias("circular")))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest by Boruvka rounds: a, b and the other columns of ``edges``.

    ``edges``: a < b, n (weight), more. Ties go to the smaller ids, so the forest is unique.
    """
    extra = [c for c in edges.columns if c not in ("a", "b")]
    left = settle(edges)
    nodes = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = settle(nodes.select("id", F.col("id").alias("label")))
    tree = None
    while True:
        at = lambda c, n: label.select(F.col("id").alias(c), F.col("label").alias(n))
        open_edges = settle(left.join(at("a", "_la"), "a").join(at("b", "_lb"), "b").filter(
            F.col("_la") != F.col("_lb")))
        if open_edges.isEmpty():
            break
        order = F.struct(-F.col("n"), F.col("a"), F.col("b"))
        best = (open_edges.select(F.explode(F.array("_la", "_lb")).alias("l"), order.alias("o"))
                .groupBy("l").agg(F.min("o").alias("o")).select("o.a", "o.b").distinct())
        won = settle(open_edges.join(best, ["a", "b"]).select("a", "b", *extra))
        tree = won if tree is None else tree.unionByName(won)
        label = settle(components(nodes, tree))
        left = open_edges.select("a", "b", *extra)
    return edges.limit(0) if tree is None else tree


def euler_tour(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Walks around trees as lists of arcs: key, u, v, arc, tree (its first arc), pos (from 0), down.

    ``edges``: key, a, b, each edge of a forest once; ``roots``: key, id, one node of each tree, where the
    walk begins (a tree without one is walked from its smallest node). From u to v the walk goes on to the
    neighbour of v after u, so the arcs are one list whose places ``rank`` finds in log rounds. ``down``
    arcs lead away from the root: each node but the root is v of one of them.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                             F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("w")
    root = roots.select("key", F.col("id").alias("u"), F.lit(True).alias("_root"))
    with scratch() as own:
        arcs = own.keep(settle(dense_index(edges.select("key", ways).select("key", "w.u", "w.v").join(
            root, ["key", "u"], "left"), ["key", "u"], ["v"], "arc", "_k", "_n")))
    # before the arc from u comes the one that enters u from the neighbour before, in a circle but at the root
    around = F.when(F.col("_k") > 0, F.col("arc") - 1).when(F.col("_root").isNull(), F.col("arc") + F.col("_n") - 1)
    # both ways of an edge meet in one row, so each arc is shuffled once
    up = F.col("u") < F.col("v")
    met = arcs.withColumn("_near", around).groupBy("key", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        *[F.max(F.when(way, F.col(c))).alias(f"{n}_{c}") for n, way in (("f", up), ("g", ~up)) for c in ("arc", "_near")])
    turn = lambda u, v, n, m: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(f"{n}_arc").alias("arc"),
                                       F.col(f"{m}_arc").alias("rev"), F.col(f"{n}__near").alias("_near"))
    both = settle(met.select("key", F.explode(F.array(turn("a", "b", "f", "g"), turn("b", "a", "g", "f"))).alias("w")).select(
        "key", "w.*"))
    discard(arcs)
    enters = both.select(F.col("arc").alias("_key"), F.col("rev").alias("n5"))
    links = both.withColumn("_key", spread_nulls("_near", "arc")).join(enters, "_key", "left")
    with scratch() as own:
        place = own.keep(settle(rank(links.select(F.col("arc").alias("id"), "n5")).select(
            F.col("id").alias("arc"), F.col("head").alias("tree"), "pos")))
    placed = both.join(place, "arc")
    # the way back tells its place to this arc, which stays where it is
    back = placed.select(F.col("rev").alias("arc"), F.col("pos").alias("_back"))
    return placed.join(back, "arc").select(
        "key", "u", "v", "arc", "tree", "pos", (F.col("pos") < F.col("_back")).alias("down"))


def sums_from_root(tour: DataFrame, value: Column, name: str) -> DataFrame:
    """key, id, ``name``: ``value`` summed over the arcs of the way from the root to each other node.

    ``value`` of an arc is minus that of its way back, so what the walk has left again adds up to nothing.
    """
    return running(tour, ["tree"], "pos", sums={name: value}).filter("down").select(
        "key", F.col("v").alias("id"), name)
