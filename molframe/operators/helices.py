"""Helix operators on grid marks and duplex runs.

``grid``: id, strand, pos (5' -> 3'), helix, offset, forward. Unplaced monomers have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import add, dot, norm, scale, sub, unit
from molframe.plans.ordered import dense_index, islands, neighbours, running

# Crossover gaps that fit each lattice, same direction first, opposite second.
HONEYCOMB_PERIOD, HONEYCOMB = 28, ([6, 13, 20, 27], [1, 4, 8])
SQUARE_PERIOD, SQUARE = 32, ([7, 15, 23, 31], [3, 11, 19, 27])


def crossovers(grid: DataFrame) -> DataFrame:
    """Consecutive monomers of a strand on different helices, with the marks around them."""
    g = neighbours(grid, ["strand"], "pos", {
        f"_{c}{k}": (F.col(c), k) for c in ("id", "pos", "helix", "offset", "forward")
        for k in (-1, 1, 2)})
    near = lambda k: F.col(f"_pos{k}") == F.col("pos") + k
    same_a = near(-1) & (F.col("_helix-1") == F.col("helix"))
    same_b = near(2) & (F.col("_helix2") == F.col("_helix1"))
    return g.filter(near(1) & (F.col("_helix1") != F.col("helix"))).select(
        F.col("helix").alias("from_helix"), F.col("_helix1").alias("to_helix"),
        F.col("offset").alias("from_offset"), F.col("_offset1").alias("to_offset"),
        F.col("id").alias("from_id"), F.col("_id1").alias("to_id"),
        F.col("forward").alias("from_forward"), F.col("_forward1").alias("to_forward"),
        F.when(same_a, F.col("offset") > F.col("_offset-1")).alias("from_rising"),
        F.when(same_b, F.col("_offset2") > F.col("_offset1")).alias("to_rising"))


def both_ways(c: DataFrame, *values: Column) -> DataFrame:
    """Each crossover seen from both helices: a, b and ``values`` as given."""
    one = c.select(F.col("from_helix").alias("a"), F.col("to_helix").alias("b"), *values)
    two = c.select(F.col("to_helix").alias("a"), F.col("from_helix").alias("b"), *values)
    return one.unionByName(two)


def connection_counts(grid: DataFrame) -> DataFrame:
    """Crossovers per ordered helix pair: a, b, n."""
    return both_ways(crossovers(grid)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def walk_votes(grid: DataFrame) -> DataFrame:
    """Per ordered helix pair: crossovers whose sides walk the same or the opposite way."""
    same = F.col("from_rising") == F.col("to_rising")
    return (both_ways(crossovers(grid), same.alias("same")).filter(F.col("same").isNotNull())
            .groupBy("a", "b").agg(F.count_if("same").alias("same_walk"),
                                   F.count_if(~F.col("same")).alias("diff_walk")))


def pair_weights(counts: DataFrame) -> DataFrame:
    """a < b with crossover count and summed degree."""
    degree = counts.groupBy("a").agg(F.sum("n").alias("deg"))
    return (counts.filter(F.col("a") < F.col("b"))
            .join(degree.select("a", F.col("deg").alias("_da")), "a")
            .join(degree.select(F.col("a").alias("b"), F.col("deg").alias("_db")), "b")
            .select("a", "b", "n", (F.col("_da") + F.col("_db")).alias("weight")))


def lattice_vote(grid: DataFrame, binders: list[int] | None = None) -> DataFrame:
    """honeycomb, square (votes) and kind, from the gaps between crossover points of a helix."""
    c = crossovers(grid)
    if binders:
        c = c.filter(~F.col("from_helix").isin(binders) & ~F.col("to_helix").isin(binders))
    side = lambda s: c.select(F.col(f"{s}_helix").alias("helix"), F.col(f"{s}_id").alias("id"),
                              F.col(f"{s}_offset").alias("offset"), F.col(f"{s}_forward").alias("fwd"))
    points = side("from").unionByName(side("to")).distinct()
    d = dense_index(points, ["helix"], ["offset", "id"], "_g", "_k")
    d = neighbours(d, ["helix"], "_k", {"_o": (F.col("offset"), -1), "_f": (F.col("fwd"), -1)})
    gap = F.col("offset") - F.col("_o")
    same = F.col("_f") == F.col("fwd")
    d = d.withColumn("gap", gap).filter((F.col("gap") > 0) & ~(same & (F.col("gap") == 1)))

    def fits(period, sets):
        r = F.pmod(F.col("gap"), F.lit(period))
        return F.when(same, r.isin(sets[0])).otherwise(r.isin(sets[1]))
    hc, sq = fits(HONEYCOMB_PERIOD, HONEYCOMB), fits(SQUARE_PERIOD, SQUARE)
    v = d.agg(F.count_if(hc & ~sq).alias("honeycomb"), F.count_if(sq & ~hc).alias("square"))
    return v.withColumn("kind", F.when(F.col("square") > F.col("honeycomb"), "square")
                        .otherwise("honeycomb"))


def shift_medians(grid: DataFrame) -> DataFrame:
    """Median offset shift per ordered helix pair: a, b, n, shift (adding it to b aligns b)."""
    c = crossovers(grid)
    s = F.col("from_offset") - F.col("to_offset")
    one = c.select(F.col("from_helix").alias("a"), F.col("to_helix").alias("b"), s.alias("s"))
    two = c.select(F.col("to_helix").alias("a"), F.col("from_helix").alias("b"), (-s).alias("s"))
    return one.unionByName(two).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.median("s") + 0.5).cast("bigint").alias("shift"))


def pair_cosine(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of the crossover-count vectors of helix pairs (a, b), leaving each other out."""
    c = counts.select("a", F.col("b").alias("nb"), "n")
    both = (pairs.select("a", "b").join(c, "a").withColumnRenamed("n", "_na")
            .join(c.select(F.col("a").alias("b"), "nb", F.col("n").alias("_nb")), ["b", "nb"]))
    dots = both.groupBy("a", "b").agg(F.sum(F.col("_na") * F.col("_nb")).alias("dot"))
    total = c.groupBy("a").agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    each = lambda x: total.select(F.col("a").alias(x), F.col("sq").alias("_s" + x))
    mutual = counts.select("a", "b", F.col("n").alias("_m"))
    m = F.coalesce(F.col("_m") * F.col("_m"), F.lit(0))
    sa, sb = F.col("_sa") - m, F.col("_sb") - m
    return (pairs.select("a", "b").join(dots, ["a", "b"], "left").join(each("a"), "a", "left")
            .join(each("b"), "b", "left").join(mutual, ["a", "b"], "left")
            .select("a", "b", F.when((sa > 0) & (sb > 0), F.least(F.lit(1.0), F.coalesce(
                "dot", F.lit(0)) / (F.sqrt(sa) * F.sqrt(sb)))).otherwise(0.0).alias("cosine")))


def grid_conflicts(grid: DataFrame, mono: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots claimed more than once: helix, forward, offset, n; monomers without a mark: id)."""
    slots = grid.groupBy("helix", "forward", "offset").agg(F.count(F.lit(1)).alias("n"))
    return slots.filter(F.col("n") > 1), mono.select("id").join(grid, "id", "left_anti")


def slot_overlap(grid: DataFrame, pairs: DataFrame) -> DataFrame:
    """Slots shared by helix pairs (a, b); 0 means disjoint."""
    slots = grid.select("helix", "forward", "offset").distinct()
    a = slots.withColumnRenamed("helix", "a")
    b = slots.withColumnRenamed("helix", "b")
    shared = (pairs.select("a", "b").join(a, "a").join(b, ["b", "forward", "offset"])
              .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    return pairs.select("a", "b").join(shared, ["a", "b"], "left").select(
        "a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def shadow(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """Share of each axis covered by the other's projection. ``pairs``: a0, a1, b0, b1 (points)."""
    def cover(s0, s1, x0, x1):
        axis = sub(s1, s0)
        size = norm(axis)
        t0, t1 = dot(sub(x0, s0), axis) / size, dot(sub(x1, s0), axis) / size
        low = F.greatest(F.lit(0.0), F.least(t0, t1))
        high = F.least(size, F.greatest(t0, t1))
        return F.when(size < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), high - low) / size)
    c = [F.col(n) for n in ("a0", "a1", "b0", "b1")]
    return (pairs.withColumn("cov_a", cover(*c)).withColumn("cov_b", cover(c[2], c[3], c[0], c[1]))
            .withColumn("overlap", F.greatest("cov_a", "cov_b") >= least))


def duplex_runs(mono: DataFrame, tolerance: int = 2) -> DataFrame:
    """Stretches where two strands stay paired antiparallel.

    Pairs (id < bp) of one strand pair whose positions add up to the same number follow each
    other; a run breaks where the next pair is more than ``tolerance`` steps away. Result:
    strand_a, strand_b, total, run, id, bp, pos_a, pos_b.
    """
    mates = mono.select(F.col("id").alias("bp"), F.col("strand").alias("strand_b"),
                        F.col("pos").alias("pos_b"))
    p = mono.filter(F.col("id") < F.col("bp")).select(
        F.col("strand").alias("strand_a"), F.col("pos").alias("pos_a"), "id", "bp").join(mates, "bp")
    key = ["strand_a", "strand_b", "total"]
    p = p.withColumn("total", F.col("pos_a") + F.col("pos_b"))
    d = dense_index(p, key, ["pos_a"], "_g", "_k").drop("_g", "len")
    d = neighbours(d, key, "_k", {"_last": (F.col("pos_a"), -1)})
    starts = F.col("_last").isNull() | (F.col("pos_a") - F.col("_last") > tolerance)
    return islands(d.withColumn("_new", starts), key, "_k", F.col("_new"), "run").drop(
        "_k", "_last", "_new")


RUN = ["strand_a", "strand_b", "total", "run"]


def duplex_ends(runs: DataFrame) -> DataFrame:
    """Four end monomers of each run of at least two pairs: start1, end1 (a), start2, end2 (b)."""
    e = runs.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("id", "pos_a").alias("start1"),
        F.max_by("id", "pos_a").alias("end1"), F.min_by("bp", "pos_b").alias("start2"),
        F.max_by("bp", "pos_b").alias("end2"))
    return e.filter(F.col("n") > 1)


def unpaired_runs(mono: DataFrame) -> DataFrame:
    """Unpaired monomers in runs: longer than 2 is 'ssdna' ('scaffold' on the longest strand of
    its structure), else 'stub'. Result: id, strand, first (pos), size, kind."""
    from molframe.operators.strands import scaffold
    d = neighbours(mono.select("structure", "strand", "pos", "id", F.col("bp").isNull().alias("_u")),
                   ["strand"], "pos", {"_before": (F.col("_u"), -1)})
    starts = F.col("_u") & ~F.coalesce("_before", F.lit(False))
    d = running(d.withColumn("_new", starts), ["strand"], "pos",
                lasts={"first": F.when(F.col("_new"), F.col("pos"))}).filter("_u")
    size = d.groupBy("strand", "first").agg(F.count(F.lit(1)).alias("size"))
    main = scaffold(mono).select("strand", F.lit(True).alias("_main"))
    return (d.join(size, ["strand", "first"]).join(main, "strand", "left")
            .select("id", "strand", "first", "size", F.when(F.col("size") <= 2, "stub")
                    .when(F.col("_main"), "scaffold").otherwise("ssdna").alias("kind")))


def helix_offsets(members: DataFrame) -> DataFrame:
    """Offset of each monomer along its helix of one duplex run: helix, id, side, offset.

    ``members``: helix, side ('a' walked 5' -> 3', 'b' walked 3' -> 5'), pos (dense along the
    walk of its side), id, bp. Insertions widen the gap between two paired anchors to the longer
    side; the first anchor sits at the longer unpaired head; other monomers count on from the
    anchor before them, heads back from the first.
    """
    a = members.filter(F.col("side") == "a").select("helix", F.col("pos").alias("pa"), "id", "bp")
    b = members.filter(F.col("side") == "b").select("helix", F.col("pos").alias("pb"),
                                                    F.col("id").alias("bp"))
    anchors = dense_index(a.join(b, ["helix", "bp"]), ["helix"], ["pa"], "_g", "_k").drop("_g", "len")
    anchors = neighbours(anchors, ["helix"], "_k", {"_a": (F.col("pa"), -1), "_b": (F.col("pb"), -1)})
    step = F.when(F.col("_a").isNull(), F.greatest("pa", "pb")).otherwise(
        F.greatest(F.col("pa") - F.col("_a"), F.col("pb") - F.col("_b")))
    anchors = running(anchors.withColumn("_step", step), ["helix"], "_k", sums={"at": F.col("_step")})
    marks = anchors.select("helix", F.col("id").alias("id"), F.col("at")).unionByName(
        anchors.select("helix", F.col("bp").alias("id"), F.col("at")))
    d = members.select("helix", "side", "pos", "id").join(marks, ["helix", "id"], "left")
    d = running(d, ["helix", "side"], "pos", lasts={
        "_off": F.col("at"), "_pos": F.when(F.col("at").isNotNull(), F.col("pos"))})
    head = d.filter(F.col("at").isNotNull()).groupBy("helix", "side").agg(
        F.min("pos").alias("_p0"), F.min_by("at", "pos").alias("_o0"))
    return d.join(head, ["helix", "side"], "left").select("helix", "id", "side", F.coalesce(
        F.col("_off") + F.col("pos") - F.col("_pos"),
        F.col("_o0") - (F.col("_p0") - F.col("pos")), "pos").alias("offset"))


def flip(grid: DataFrame, helices: DataFrame) -> DataFrame:
    """Mirror the given helices: offset = max + min - offset, direction swapped."""
    ends = grid.join(helices, "helix", "left_semi").groupBy("helix").agg(
        (F.max("offset") + F.min("offset")).alias("_sum"))
    d = grid.join(ends, "helix", "left")
    turned = F.col("_sum").isNotNull()
    return d.withColumn("offset", F.when(turned, F.col("_sum") - F.col("offset")).otherwise(
        F.col("offset"))).withColumn("forward", F.col("forward") != turned).drop("_sum")


def normalise(grid: DataFrame) -> DataFrame:
    """Shift all offsets so that the smallest is 0."""
    low = grid.agg(F.min("offset").alias("lo")).scalar()
    return grid.withColumn("offset", F.col("offset") - low)


def domains(grid: DataFrame) -> DataFrame:
    """Lattice domains of each strand: strand, domain (order), helix, forward, start, end."""
    g = neighbours(grid, ["strand"], "pos", {
        "_p": (F.col("pos"), -1), "_h": (F.col("helix"), -1), "_f": (F.col("forward"), -1),
        "_o": (F.col("offset"), -1)})
    step = F.when(F.col("forward"), 1).otherwise(-1)
    goes_on = ((F.col("_p") + 1 == F.col("pos")) & (F.col("_h") == F.col("helix"))
               & (F.col("_f") == F.col("forward")) & (F.col("_o") + step == F.col("offset")))
    d = islands(g.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["strand"], "pos",
                F.col("_new"), "domain")
    return d.groupBy("strand", "domain").agg(
        F.first("helix").alias("helix"), F.first("forward").alias("forward"),
        F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))


def axis_fit(mono: DataFrame, runs: DataFrame) -> DataFrame:
    """Axis of each duplex run: the direction that the backbone steps vary least in.

    Six moment sums per run give the 3x3 matrix; its smallest eigenvector is taken in closed
    form. ``mono``: id, n3, n5, bb. Oriented from the start pair to the end pair.
    """
    ends = duplex_ends(runs)
    site = mono.select("id", "bb")
    steps = []
    for me, nxt in (("id", "n3"), ("bp", "n5")):
        link = mono.select(F.col("id").alias(me), F.col("bb").alias("_p"), F.col(nxt).alias("_n"))
        after = site.select(F.col("id").alias("_n"), F.col("bb").alias("_q"))
        steps.append(runs.join(link, me).join(after, "_n").select(*RUN, "pos_a", sub(
            F.col("_q"), F.col("_p")).alias("s")))
    last = runs.groupBy(*RUN).agg(F.max("pos_a").alias("_last"))
    s = steps[0].unionByName(steps[1]).join(last, RUN).filter(F.col("pos_a") < F.col("_last"))
    v = F.col("s")
    moments = [F.covar_pop(v[a], v[b]).alias(a + b) for a, b in
               (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]
    m = s.groupBy(*RUN).agg(*moments)
    axis = smallest_eigenvector(m)
    point = lambda c: site.select(F.col("id").alias(c), F.col("bb").alias("_" + c))
    e = ends
    for c in ("start1", "end1", "start2", "end2"):
        e = e.join(point(c), c)
    guess = sub(add(F.col("_end1"), F.col("_start2")), add(F.col("_start1"), F.col("_end2")))
    # two pairs have too few steps for a fit: their axis is the line between the pairs' middles
    fitted = F.when(dot(F.col("axis"), F.col("_g")) < 0, scale(F.col("axis"), -1.0)).otherwise(F.col("axis"))
    line = F.when(dot(F.col("_g"), F.col("_g")) > 0, unit(F.col("_g")))
    return e.select(*RUN, "n", guess.alias("_g")).join(axis.select(*RUN, "axis"), RUN, "left").select(
        *RUN, "n", F.when(F.col("n") > 2, fitted).otherwise(line).alias("axis"))


def smallest_eigenvector(m: DataFrame) -> DataFrame:
    """Adds ``axis``, the unit eigenvector of the smallest eigenvalue of the symmetric matrix
    with columns xx, xy, xz, yy, yz, zz (trigonometric method)."""
    c = F.col
    q = (c("xx") + c("yy") + c("zz")) / 3
    p2 = ((c("xx") - c("_q")) * (c("xx") - c("_q")) + (c("yy") - c("_q")) * (c("yy") - c("_q"))
          + (c("zz") - c("_q")) * (c("zz") - c("_q"))
          + 2 * (c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz")))
    d = m.withColumn("_q", q).withColumn("_p", F.sqrt(p2 / 6))
    for n in ("xx", "yy", "zz"):
        d = d.withColumn("_" + n, (c(n) - c("_q")) / c("_p"))
    for n in ("xy", "xz", "yz"):
        d = d.withColumn("_" + n, c(n) / c("_p"))
    det = (c("_xx") * (c("_yy") * c("_zz") - c("_yz") * c("_yz"))
           - c("_xy") * (c("_xy") * c("_zz") - c("_yz") * c("_xz"))
           + c("_xz") * (c("_xy") * c("_yz") - c("_yy") * c("_xz")))
    phi = F.acos(F.least(F.greatest(c("_r"), F.lit(-1.0)), F.lit(1.0))) / 3
    d = d.withColumn("_r", det / 2).withColumn(
        "_low", c("_q") + 2 * c("_p") * F.cos(phi + 2 * 3.141592653589793 / 3))
    # the longest cross product of two rows of M - low I is the eigenvector
    row = lambda x, y, z: F.named_struct(F.lit("x"), x, F.lit("y"), y, F.lit("z"), z)
    d = d.withColumn("_1", row(c("xx") - c("_low"), c("xy"), c("xz"))).withColumn(
        "_2", row(c("xy"), c("yy") - c("_low"), c("yz"))).withColumn(
        "_3", row(c("xz"), c("yz"), c("zz") - c("_low")))
    from molframe.functions.geometry import cross
    for n, (u, v) in {"_12": ("_1", "_2"), "_13": ("_1", "_3"), "_23": ("_2", "_3")}.items():
        d = d.withColumn(n, cross(c(u), c(v)))
    size = {n: dot(c(n), c(n)) for n in ("_12", "_13", "_23")}
    best = F.greatest(*size.values())
    d = d.withColumn("_v", F.when(size["_12"] == best, c("_12")).when(
        size["_13"] == best, c("_13")).otherwise(c("_23")))
    return d.withColumn("axis", unit(c("_v"))).drop(*[n for n in d.columns if n.startswith("_")])
