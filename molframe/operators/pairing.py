"""Base pairs, spring edges and traps: distance joins and id joins.

``sites``: id, strand, pos, type (number), base, a1, a2, ns (base centre), n3, n5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import dist, dist2, dot, scale
from molframe.plans.graph import spread_nulls
from molframe.plans.ordered import dense_index, parts_for
from molframe.plans.spatial import (FEW_IN_CELL, FEW_PAIRS, HOT_CELL, axis_cell, crowded_join, matrix, nearest,
                                    segment_cells)
from molframe.session import discard, settle

EXACT, GRID, FACING, SAME_A2, ANGSTROM = 0.6, 0.65, -0.85, 0.85, 8.518


def complementary(t1: Column, t2: Column, b1: Column, b2: Column) -> Column:
    """Watson-Crick by type number; G-U is always allowed."""
    wc = (t1 != t2) & ((t1 + t2) % 3 == 0)
    wobble = ((b1 == "G") & (b2 == "U")) | ((b1 == "U") & (b2 == "G"))
    return wc | wobble


def _kinds(own: bool) -> Column:
    """Classes of bases under which a site is found (``own``) or looks for partners: type mod 3, and G or U."""
    t, g, u = F.col("type"), 3, 4
    wobble = F.when(F.col("base") == "G", g if own else u).when(F.col("base") == "U", u if own else g)
    return F.explode(F.array_compact(F.array(F.pmod(t if own else -t, F.lit(3)).cast("int"), wobble))).alias("_kind")


def nearest_partner(sites: DataFrame, cutoff: float, best: Column, group: list[str] | None = None) -> DataFrame:
    """id and the fields of ``best`` of each monomer's best facing partner nearer than ``cutoff``.

    ``best``: a struct of d, other, a1 and a2 (products), d first. Partners are looked for in growing balls
    and by base class, so the pairs that meet grow with the monomers, not with their square.
    """
    group = group or []
    cols = ["id", "type", "base", "a1", "a2", "ns", "n3", "n5"]
    left = sites.select(*group, _kinds(False), *[F.col(c).alias("l_" + c) for c in cols])
    right = sites.select(*group, _kinds(True), *[F.col(c).alias("r_" + c) for c in cols[:-2]])
    far = lambda n: F.coalesce(F.col(n) != F.col("r_id"), F.lit(True))
    fits = (F.col("l_id") != F.col("r_id")) & far("l_n3") & far("l_n5") & complementary(
        F.col("l_type"), F.col("r_type"), F.col("l_base"), F.col("r_base")) & (
        dot(F.col("l_a1"), F.col("r_a1")) < FACING)
    return nearest(left, right, cutoff, "l_ns", "r_ns", [*group, "l_id"], fits, best, [*group, "_kind"]).select(
        *group, F.col("l_id").alias("id"), "b.*")


def _ranked(*fields: str) -> Column:
    own = {"d": F.col("d"), "other": F.col("r_id"), "a1": dot(F.col("l_a1"), F.col("r_a1")),
           "a2": dot(F.col("l_a2"), F.col("r_a2"))}
    return F.struct(*[own[f].alias(f) for f in fields])


def pairs_exact(sites: DataFrame, cutoff: float = EXACT, group: list[str] | None = None) -> DataFrame:
    """Each monomer's nearest candidate, ties by id: id, other, d."""
    return nearest_partner(sites, cutoff, _ranked("d", "other"), group).select(*(group or []), "id", "other", "d")


def a2_score() -> Column:
    """Contest by the a2 product: any value above the bound beats any below; lower is better."""
    return -F.when(F.col("a2") > SAME_A2, F.col("a2")).otherwise(-2.0)


def rmsd_score(cutoff: float = GRID) -> Column:
    d, a = F.col("d") / cutoff, 1 + F.col("a1")
    return F.sqrt((d * d + a * a) / 2)


def pairs_contest(sites: DataFrame, score: Column, cutoff: float = GRID,
                  group: list[str] | None = None) -> DataFrame:
    """One-to-one pairs whatever the row order: id < other, d.

    Each seeker takes its nearest target (ties by a1 product, then id); each target keeps its
    best seeker by ``score`` (ties by id); mutual choices are pairs. Of the remaining choices
    between free monomers, those that are shortest at both ends are pairs.
    """
    group = group or []
    near = nearest_partner(sites, cutoff, _ranked("d", "a1", "other", "a2"), group)
    near = settle(near.withColumn("score", score))
    kept = near.groupBy(*group, F.col("other").alias("t")).agg(
        F.min_by("id", F.struct("score", "id")).alias("s"))
    # a target's own choice must be the seeker it keeps
    mutual = (near.select(*group, F.col("id").alias("t"), F.col("other").alias("s"), "d")
              .join(kept, [*group, "t", "s"]))
    back = mutual.select(*group, F.col("s").alias("t"), F.col("t").alias("s"))
    first = mutual.join(back, [*group, "t", "s"]).filter(F.col("t") < F.col("s")).select(
        *group, F.col("t").alias("id"), F.col("s").alias("other"), "d")
    taken = first.select(*group, F.explode(F.array("id", "other")).alias("id"))
    free = near.join(taken, [*group, "id"], "left_anti").join(
        taken.withColumnRenamed("id", "other"), [*group, "other"], "left_anti")
    e = free.select(*group, F.least("id", "other").alias("id"), F.greatest("id", "other")
                    .alias("other"), "d").distinct()
    ends = e.select(*group, F.explode(F.array("id", "other")).alias("at"), "d", "id", "other")
    short = ends.groupBy(*group, "at").agg(F.min(F.struct("d", "id", "other")).alias("m"))
    win = short.select(*group, "m.id", "m.other", "m.d").groupBy(*group, "id", "other").agg(
        F.count(F.lit(1)).alias("n"), F.first("d").alias("d")).filter(F.col("n") == 2)
    return first.unionByName(win.select(*group, "id", "other", "d"))


def long_strands(sites: DataFrame, least: int = 1000) -> DataFrame:
    """Sites of strands with at least ``least`` monomers."""
    wanted = sites.groupBy("strand").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return sites.join(wanted.select("strand"), "strand", "left_semi")


def drop_intra_strand(mono: DataFrame) -> DataFrame:
    """Pairs inside one strand are dropped, except in RNA. ``mono``: id, strand, class, bp."""
    mates = mono.select(F.col("id").alias("_key"), F.col("strand").alias("_s"))
    inside = (F.col("_s") == F.col("strand")) & (F.col("class") != "RNA")
    return (mono.withColumn("_key", spread_nulls("bp", "id")).join(mates, "_key", "left")
            .withColumn("bp", F.when(~F.coalesce(inside, F.lit(False)), F.col("bp"))).drop("_s", "_key"))


def connected_strands(mono: DataFrame, selection: DataFrame) -> DataFrame:
    """All monomers of strands paired with the selection."""
    mates = mono.join(selection.select("id"), "id", "left_semi").filter(
        F.col("bp").isNotNull()).select(F.col("bp").alias("id"))
    strands = mono.join(mates, "id", "left_semi").select("strand").distinct()
    return mono.join(strands, "strand", "left_semi")


def _met(points: DataFrame, angstrom: float, group: list[str] | None = None) -> DataFrame:
    """Pairs within a cutoff, inclusive, once each: i < j, d and both sides' columns; ``l_`` may be either of them."""
    group = group or []
    other = [c for c in points.columns if c not in group]
    left = points.select(*group, *[F.col(c).alias("l_" + c) for c in other])
    right = points.select(*group, *[F.col(c).alias("r_" + c) for c in other])
    return crowded_join(left, right, angstrom / ANGSTROM, "l_p", "r_p", group, once=("l_id", "r_id")).withColumns(
        {"i": F.least("l_id", "r_id"), "j": F.greatest("l_id", "r_id"), "d": F.sqrt("d2")})


def radius_edges(points: DataFrame, angstrom: float, group: list[str] | None = None) -> DataFrame:
    """Spring edges i < j within a cutoff, inclusive: i, j, d and both sides' columns l_* / r_*."""
    turned, other = F.col("l_id") > F.col("r_id"), [c for c in points.columns if c not in (group or [])]
    return _met(points, angstrom, group).withColumns({
        f"{s}_{c}": F.when(turned, F.col(f"{t}_{c}")).otherwise(F.col(f"{s}_{c}"))
        for s, t in ("lr", "rl") for c in other})


def torsion_edges(points: DataFrame, angstrom: float) -> DataFrame:
    """Radius edges; consecutive ones also carry four products and the two torsion constants."""
    rij = F.struct(*[(F.col("r_p")[a] - F.col("l_p")[a]).alias(a) for a in "xyz"])
    at = lambda s: dot(rij, F.col(s + "_a1"))
    # a pair that is turned round has the other direction too; few pairs are consecutive, so sides are not exchanged
    turned = F.col("l_id") > F.col("r_id")
    extra = F.array(F.when(turned, -at("r")).otherwise(at("l")), F.when(turned, at("l")).otherwise(-at("r")),
                    dot(F.col("l_a1"), F.col("r_a1")), dot(F.col("l_a3"), F.col("r_a3")), F.lit(1.3), F.lit(1.4))
    return _met(points, angstrom).select("i", "j", "d", F.when(
        F.col("j") - F.col("i") == 1, extra).alias("extra"))


def backbone_edges(points: DataFrame, limit: float = 1.0, k: float = 100.0) -> DataFrame:
    """n3 neighbours inside the set closer than ``limit``. ``points``: id, n3, p."""
    other = points.select(F.col("id").alias("n3"), F.col("p").alias("_q"))
    d = dist(F.col("p"), F.col("_q"))
    return points.join(other, "n3").filter(d < limit).select(
        F.col("id").alias("i"), F.col("n3").alias("j"), d.alias("d"), F.lit(k).alias("k"))


def residue_edges(bonds: DataFrame, particles: DataFrame, k: float = 100.0
                  ) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved bonds) of residue bonds (dataset, chain1, res1, chain2, res2).

    ``particles``: dataset, chain, residue, id, p. Serves hydrogen and disulphide bonds.
    """
    a = particles.select("dataset", F.col("chain").alias("chain1"), F.col("residue").alias("res1"),
                         F.col("id").alias("i"), F.col("p").alias("_a"))
    b = particles.select("dataset", F.col("chain").alias("chain2"), F.col("residue").alias("res2"),
                         F.col("id").alias("j"), F.col("p").alias("_b"))
    d = (bonds.join(a, ["dataset", "chain1", "res1"], "left")
         .join(b, ["dataset", "chain2", "res2"], "left"))
    ok = F.col("i").isNotNull() & F.col("j").isNotNull()
    keys = bonds.columns
    return (d.filter(ok).select("dataset", "i", "j", dist(F.col("_a"), F.col("_b")).alias("d"),
                                F.lit(k).alias("k")), d.filter(~ok).select(*keys))


def nonpolar_edges(points: DataFrame, angstrom: float = 4.0, k: float = 1.0) -> DataFrame:
    """Non-neighbour pairs closer than ``angstrom``. ``points``: id, n3, n5, p."""
    e = radius_edges(points, angstrom)
    apart = lambda c: F.coalesce(F.col(c) != F.col("j"), F.lit(True))
    return e.filter((F.col("d") < angstrom / ANGSTROM) & apart("l_n3") & apart("l_n5")).select(
        "i", "j", "d", F.lit(k).alias("k"))


# Atoms that carry the charge of a residue.
NEGATIVE = {"D": ["OD1", "OD2"], "E": ["OE1", "AE1", "OE2", "AE2"]}
POSITIVE = {"K": ["NZ"], "H": ["ND1", "AD1"], "R": ["NH1", "NH2"]}


#: Most pairs of charged atoms of two residues that are compared by columns.
FEW_ATOMS = 16


def salt_bridges(atoms: DataFrame, angstrom: float = 4.0, k: float = 10.0) -> DataFrame:
    """Residue pairs with facing charged atoms closer than ``angstrom``: i < j, k.

    ``atoms``: residue, letter, name, p. Each row brings the charged atoms of its residue along, so a pair of
    residues is kept where its first close pair of atoms meets, and pairs are not shuffled again.
    """
    def charged(table):
        test = F.lit(False)
        for l, names in table.items():
            test = test | ((F.col("letter") == l) & F.col("name").isin(*names))
        return F.array_sort(F.collect_set(F.when(test, F.col("p"))))
    residues = atoms.groupBy("residue").agg(charged(NEGATIVE).alias("neg"), charged(POSITIVE).alias("pos"))

    def side(which, prefix):
        return residues.select(*[F.col(c).alias(prefix + n) for c, n in (
            ("residue", "res"), ("neg", "neg"), ("pos", "pos"))], F.posexplode(which).alias(f"{prefix}k", f"{prefix}p"))
    radius = angstrom / ANGSTROM
    close = lambda a, b: F.sqrt(dist2(a, b)) < radius
    numbered = lambda c: F.transform(c, lambda p, i: F.struct(p.alias("p"), i.alias("k")))
    lk, rk = F.col("l_k"), F.col("r_k")
    left, right = side("neg", "l_"), side("pos", "r_")
    # few atoms have columns of their own, as functions of arrays are slow for each pair
    few = residues.agg(F.max(F.size("neg")), F.max(F.size("pos"))).first()
    if (few[0] or 0) * (few[1] or 0) <= FEW_ATOMS:
        names = lambda s, i: [f"_{s}{i}{a}" for a in "xyz"]
        for i in range(few[0] or 0):
            left = left.withColumns({c: F.get("l_neg", F.lit(i))[a] for c, a in zip(names("l", i), "xyz")})
        for i in range(few[1] or 0):
            right = right.withColumns({c: F.get("r_pos", F.lit(i))[a] for c, a in zip(names("r", i), "xyz")})
        earlier = F.lit(False)
        for i in range(few[0] or 0):
            for j in range(few[1] or 0):
                d = [F.col(a) - F.col(b) for a, b in zip(names("l", i), names("r", j))]
                near = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < radius
                earlier = earlier | (((lk > i) | ((lk == i) & (rk > j))) & F.coalesce(near, F.lit(False)))
    else:
        earlier = F.exists(numbered("l_neg"), lambda a: F.exists(numbered("r_pos"), lambda b: (
            (a["k"] < lk) | ((a["k"] == lk) & (b["k"] < rk))) & close(a["p"], b["p"])))
    # a residue may have both charges; then the pair counts with the smaller one negative
    turned = (F.col("l_res") > F.col("r_res")) & (F.size("r_neg") > 0) & (F.size("l_pos") > 0) & F.exists(
        "r_neg", lambda a: F.exists("l_pos", lambda b: close(a, b)))
    met = crowded_join(left, right, radius, "l_p", "r_p", strict=True)
    return met.filter((F.col("l_res") != F.col("r_res")) & ~earlier & ~turned).select(
        F.least("l_res", "r_res").alias("i"), F.greatest("l_res", "r_res").alias("j"), F.lit(k).alias("k"))


def frame_distances(frames: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distance of chosen pairs (a, b) in every frame: by, a, b, d, nm. ``frames``: by, id, p."""
    a = frames.select(*by, F.col("id").alias("a"), F.col("p").alias("_a")).join(pairs, "a")
    b = frames.select(*by, F.col("id").alias("b"), F.col("p").alias("_b"))
    d = dist(F.col("_a"), F.col("_b"))
    return a.join(b, [*by, "b"]).select(*by, "a", "b", d.alias("d"), (d * 0.8518).alias("nm"))


def pair_traps(mono: DataFrame, existing: DataFrame, stiff: float = 0.09, r0: float = 1.2,
               pbc: int = 1) -> DataFrame:
    """Existing traps and one per paired monomer unless an equal one exists."""
    new = mono.filter(F.col("bp").isNotNull()).select(
        F.col("id").alias("particle"), F.col("bp").alias("ref_particle"), F.lit(stiff).alias("stiff"),
        F.lit(r0).alias("r0"), F.lit(pbc).alias("pbc"))
    return existing.unionByName(new.join(existing, new.columns, "left_anti"))


def selection_traps(selection: DataFrame, stiff: float = 0.09, r0: float = 1.2
                    ) -> tuple[DataFrame, DataFrame]:
    """(traps of members (1,2), (3,4) .. both ways, odd member left over). ``selection``: ord, id."""
    d = dense_index(selection.select("ord", "id"), [], ["ord"], "_g", "_k")
    n = F.floor(F.col("_k") / 2)
    a = d.filter(F.col("_k") % 2 == 0).select(n.alias("n"), F.col("id").alias("a"))
    b = d.filter(F.col("_k") % 2 == 1).select(n.alias("n"), F.col("id").alias("b"))
    both = a.join(b, "n", "left")
    traps = both.filter(F.col("b").isNotNull()).select(F.explode(F.array(
        F.struct(F.col("a").alias("particle"), F.col("b").alias("ref_particle")),
        F.struct(F.col("b").alias("particle"), F.col("a").alias("ref_particle")))).alias("t"))
    return (traps.select("t.particle", "t.ref_particle", F.lit(stiff).alias("stiff"),
                         F.lit(r0).alias("r0")),
            both.filter(F.col("b").isNull()).select(F.col("a").alias("id")))


def forces_touching(forces: DataFrame, ids: DataFrame, only_acting: bool = False) -> DataFrame:
    """Forces on (or, unless ``only_acting``, also from) given monomers."""
    a = ids.select(F.col("id").alias("particle")).distinct()
    acting = forces.join(a, "particle", "left_semi")
    if only_acting:
        return acting
    return acting.unionByName(forces.join(a, "particle", "left_anti").join(
        a.withColumnRenamed("particle", "ref_particle"), "ref_particle", "left_semi"))


def remove_forces(forces: DataFrame, ids: DataFrame) -> DataFrame:
    a = ids.select(F.col("id").alias("particle")).distinct()
    return forces.join(a, "particle", "left_anti").join(
        a.withColumnRenamed("particle", "ref_particle"), "ref_particle", "left_anti")


def merge_edges(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Undirected edge set: equal pairs add k, self edges go."""
    i, j = F.least("i", "j"), F.greatest("i", "j")
    return (edges.filter(F.col("i") != F.col("j")).groupBy(*(by or []), i.alias("i"), j.alias("j"))
            .agg(F.sum("k").alias("k")))


OVERLAP, CYLINDER, OPPOSED = 25 / ANGSTROM, 50 / ANGSTROM, -0.9
#: Most halvings of the turn between opposed directions.
TURNS = 10


def _segment_d2(uu: Column, uv: Column, vv: Column, uw: Column, vw: Column, ww: Column) -> Column:
    """Squared distance of segments A + s u and B + t v (0 <= s, t <= 1) from products, with w = A - B.

    The least of the two ends of each segment against the other one and, where it lies inside
    both, the point of closest approach of the lines.
    """
    def end(start: Column, q: Column, axis: Column) -> Column:
        t = F.least(F.greatest(q / axis, F.lit(0.0)), F.lit(1.0))
        return start + t * (t * axis - 2 * q)

    ends = [end(ww, vw, vv), end(ww + uu + 2 * uw, vw + uv, vv),
            end(ww, -uw, uu), end(ww + vv - 2 * vw, uv - uw, uu)]
    det = uu * vv - uv * uv
    s, t = F.try_divide(uv * vw - vv * uw, det), F.try_divide(uu * vw - uv * uw, det)
    inside = (det > 1e-12) & s.between(0.0, 1.0) & t.between(0.0, 1.0)
    # at that point the line from A to B is at right angles to both
    return F.least(*ends, F.when(inside, ww + s * uw - t * vw))


def _apart(opposed: float) -> float:
    """How far apart a direction and another one turned round are where ``dot`` is ``opposed``."""
    return math.sqrt(max(1e-12, 2 + 2 * opposed))


def axis_candidates(ends: DataFrame, overlap: float = OVERLAP, length: float = CYLINDER,
                    opposed: float = OPPOSED, hot_cell: int = HOT_CELL) -> DataFrame:
    """Duplex ends whose axis cylinders overlap and point at each other: a < b, dot, dist (in Angstrom).

    ``ends``: id, origin, dir (unit). An axis is at home in the cells that it goes through and looks into
    those within ``overlap`` of its course, so two axes meet only where they pass near each other. Directions
    have cells too, and an axis looks into those near its opposite: ``dot`` is below ``opposed`` where one
    direction lies within sqrt(2 + 2 * opposed) of the other turned round.
    """
    cell, keys, ways = 2 * overlap, ["_cx", "_cy", "_cz"], ["_wx", "_wy", "_wz"]
    # directions that are no units, by rounding, may be a little further apart
    reach_way = math.sqrt(_apart(opposed) ** 2 + 1e-6)

    def side(s, reach):
        u = scale(F.col("dir"), length)
        own = ends.select(F.col("id").alias(s + "id"), F.col("origin").alias(s + "o"), F.col("dir").alias(s + "d"),
                          u.alias(s + "u"), dot(u, u).alias(s + "uu"), dot(u, F.col("origin")).alias(s + "uo"))
        way = F.col(s + "d")
        for a, k in zip("xyz", ways):
            own = own.withColumn(k, axis_cell(way[a], 2 * reach_way) if s == "r_" else F.explode(F.sequence(
                axis_cell(-way[a] - reach_way, 2 * reach_way), axis_cell(-way[a] + reach_way, 2 * reach_way))))
        return segment_cells(own, s + "o", s + "u", reach, cell, keys)
    probe, home, keys = matrix(side("l_", overlap), side("r_", 0.0), [*keys, *ways], hot_cell)
    c = F.col
    # few rows meet many times: as many tasks as copies need, whatever the size of the axes
    parts = parts_for(ends.sparkSession, probe.count())
    met = probe.repartition(parts, *keys).join(home.repartition(parts, *keys).hint("merge"), keys).filter(
        "l_id < r_id").withColumn("dot", dot(c("l_d"), c("r_d"))).filter(
        c("dot") < opposed)
    # a row of products apart from the bound on them: as one expression the bound is too long to be compiled
    products = {"_uu": c("l_uu"), "_uv": dot(c("l_u"), c("r_u")), "_vv": c("r_uu"),
                "_uw": c("l_uo") - dot(c("l_u"), c("r_o")), "_vw": dot(c("r_u"), c("l_o")) - c("r_uo"),
                "_ww": dist2(c("l_o"), c("r_o"))}
    near = _segment_d2(*[c(k) for k in products]) <= overlap * overlap
    return met.select("l_id", "r_id", "l_o", "r_o", "dot", F.inline(F.array(F.struct(*[
        v.alias(k) for k, v in products.items()])))).filter(near).select(
        c("l_id").alias("a"), c("r_id").alias("b"), "dot", (dist(c("l_o"), c("r_o")) * ANGSTROM).alias("dist")).distinct()


def one_to_one(candidates: DataFrame, key: str = "dot") -> DataFrame:
    """Greedy matching by lowest ``key`` (ties by ids), in rounds.

    A candidate that is the best at both its ends would be taken by the greedy order too, so
    each round takes all of those at once and drops what they touch.
    """
    left = settle(candidates)
    taken = None
    while not left.isEmpty():
        best = left.select(F.explode(F.array("a", "b")).alias("at"), key, "a", "b").groupBy(
            "at").agg(F.min(F.struct(key, "a", "b")).alias("m"))
        pick = (best.groupBy("m.a", "m.b").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") == 2).select("a", "b"))
        won = settle(left.join(pick, ["a", "b"]))
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("a", "b")).alias("a"))
        left = settle(left.join(used, "a", "left_anti").join(
            used.withColumnRenamed("a", "b"), "b", "left_anti").select(*candidates.columns))
    return candidates.limit(0) if taken is None else taken


def _next_turn(ends: DataFrame, overlap: float, length: float, opposed: float, before: float) -> float:
    """The largest halving of the turn of ``opposed``, at least twice ``before``, at which few axes meet.

    Where none does, as with equal directions, the largest that lets no more meet than the smallest.
    """
    keys, ways, turn, tried = ["_cx", "_cy", "_cz"], ["_wx", "_wy", "_wz"], _apart(opposed), []
    placed = settle(segment_cells(ends.select("origin", "dir", scale(F.col("dir"), length).alias("_u")), "origin",
                                  "_u", 0.0, 2 * overlap, keys).select(*keys, "dir"))
    rows = placed.count()
    for _ in range(TURNS):
        def cells(sign):
            return placed.groupBy(*keys, *[axis_cell(sign * F.col("dir")[a], 2 * turn).alias(k) for a, k in zip(
                "xyz", ways)]).agg(F.count(F.lit(1)).cast("double").alias("_p" if sign < 0 else "_h"))
        pairs = cells(1).join(cells(-1), [*keys, *ways]).agg(F.sum(F.col("_p") * F.col("_h"))).first()[0] or 0.0
        tried.append((pairs, turn))
        if pairs <= max(FEW_PAIRS, FEW_IN_CELL * rows) or turn < 2 * before:
            break
        turn /= 2
    else:
        least = min(pairs for pairs, _ in tried)
        turn = next(t for pairs, t in tried if pairs <= 1.05 * least)
    discard(placed)
    # twice ``before`` or more: what is nearer is decided
    return min(max(turn, 2 * before), _apart(opposed))


def axis_matching(ends: DataFrame, overlap: float = OVERLAP, length: float = CYLINDER, opposed: float = OPPOSED,
                  hot_cell: int = HOT_CELL) -> DataFrame:
    """``one_to_one`` of all ``axis_candidates``, without forming those of axes that are matched already.

    The greedy order takes the most opposed pairs first and what it decides depends on no later pair. So
    candidates are formed and matched up to a small turn between the directions, matched axes go, and the turn
    grows: at least twofold a round, and as far as few of the axes left meet.
    """
    most, turn, taken = _apart(opposed), 0.0, None
    left = settle(ends.select("id", "origin", "dir"))
    while True:
        turn = _next_turn(left, overlap, length, opposed, turn)
        limit = opposed if turn >= most else turn * turn / 2 - 1
        won = one_to_one(axis_candidates(left, overlap, length, limit, hot_cell))
        taken = won if taken is None else taken.unionByName(won)
        if turn >= most:
            return taken
        rest = settle(left.join(won.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti"))
        discard(left)
        left = rest


def bracket_traps(mono: DataFrame, matches: DataFrame, partners: DataFrame, stiff: float = 0.09,
                  r0: float = 1.2, pbc: int = 1) -> DataFrame:
    """Traps between bracket partners at the first match of each sequence in each strand.

    ``matches``: term, strand, start; ``partners``: id (= term), pos, partner.
    """
    first = matches.groupBy("term", "strand").agg(F.min("start").alias("start"))
    d = first.join(partners.filter(F.col("partner").isNotNull()).withColumnRenamed("id", "term"),
                   "term")
    at = d.select("strand", (F.col("start") + F.col("pos")).alias("_a"),
                  (F.col("start") + F.col("partner")).alias("_b"))
    m = mono.select("strand", "pos", "id")
    return (at.join(m.toDF("strand", "_a", "particle"), ["strand", "_a"])
            .join(m.toDF("strand", "_b", "ref_particle"), ["strand", "_b"])
            .select("particle", "ref_particle", F.lit(stiff).alias("stiff"), F.lit(r0).alias("r0"),
                    F.lit(pbc).alias("pbc")))
