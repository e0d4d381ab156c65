"""Joins: neighbours, pairs, spring edges, traps."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import dist, r, r_near, scale
from molframe.operators import pairing as P
from molframe.registry.core import query, r4

C = F.col


@query("jn_neighbours", """SELECT m.id, a.base AS base3, b.base AS base5 FROM mono m
    LEFT JOIN mono a ON a.id = m.n3 LEFT JOIN mono b ON b.id = m.n5""")
def _(spark, sf):
    from molframe.plans.ordered import neighbours
    return neighbours(A.monomers(spark, sf), ["strand"], "pos", {
        "base3": (C("base"), 1), "base5": (C("base"), -1)}).select("id", "base3", "base5")


@query("jn_pairs_exact", f"""SELECT id, arg_min(other, (d, other)) AS other, {r4('min(d)')} AS d
    FROM cand WHERE d < 0.6 GROUP BY id""")
def _(spark, sf):
    return P.pairs_exact(A.sites(spark, sf)).select("id", "other", r(C("d")).alias("d"))


def contest(score, where="true"):
    return f"""WITH near AS (SELECT id, other, d, {score} AS score FROM (SELECT *, row_number() OVER
    (PARTITION BY id ORDER BY d, a1, other) AS rn FROM cand WHERE d < 0.65 AND {where}) WHERE rn = 1),
    kept AS (SELECT other AS t, arg_min(id, (score, id)) AS s FROM near GROUP BY other),
    mut AS (SELECT n.id AS t, n.other AS s, n.d FROM near n JOIN kept k ON k.t = n.id
    AND k.s = n.other),
    fst AS (SELECT m.t AS id, m.s AS other, m.d FROM mut m JOIN mut w ON w.t = m.s AND w.s = m.t
    WHERE m.t < m.s), tk AS (SELECT id FROM fst UNION SELECT other FROM fst),
    e AS (SELECT DISTINCT least(id, other) AS id, greatest(id, other) AS other, d FROM near
    WHERE id NOT IN (SELECT id FROM tk) AND other NOT IN (SELECT id FROM tk)),
    sh AS (SELECT nd, min((d, id, other)) AS m FROM (SELECT id AS nd, * FROM e UNION ALL
    SELECT other, * FROM e) GROUP BY nd),
    snd AS (SELECT e.* FROM e JOIN sh x ON x.nd = e.id AND x.m = (e.d, e.id, e.other)
    JOIN sh y ON y.nd = e.other AND y.m = (e.d, e.id, e.other))
    SELECT id, other, {r4('d')} AS d FROM (SELECT * FROM fst UNION ALL SELECT * FROM snd)"""


A2_SCORE = "-CASE WHEN a2 > 0.85 THEN a2 ELSE -2.0::DOUBLE END"
RMSD = "sqrt(((d / 0.65) * (d / 0.65) + (1 + a1) * (1 + a1)) / 2)"


def rounded(d):
    return d.select("id", "other", r(C("d")).alias("d"))


@query("jn_pairs_grid", contest(A2_SCORE))
def _(spark, sf):
    return rounded(P.pairs_contest(A.sites(spark, sf), P.a2_score()))


@query("jn_pairs_rmsd", contest(RMSD))
def _(spark, sf):
    return rounded(P.pairs_contest(A.sites(spark, sf), P.rmsd_score()))


LONG = "(SELECT strand FROM sites GROUP BY strand HAVING count(*) >= 30)"


@query("jn_pairs_origami", contest(A2_SCORE, f"strand IN {LONG} AND ostrand IN {LONG}"))
def _(spark, sf):
    return rounded(P.pairs_contest(P.long_strands(A.sites(spark, sf), 30), P.a2_score()))


@query("jn_drop_intra_strand", """SELECT id, CASE WHEN id % 3 = 0 AND class <> 'RNA' THEN NULL
    WHEN id % 3 = 0 THEN coalesce(n3, n5) ELSE bp END AS bp FROM mono""")
def _(spark, sf):
    # every third monomer is paired with its own neighbour
    own = F.when(C("id") % 3 == 0, F.coalesce("n3", "n5")).otherwise(C("bp"))
    return P.drop_intra_strand(A.monomers(spark, sf).withColumn("bp", own)).select("id", "bp")


@query("jn_connected_strands", """SELECT id, strand FROM mono WHERE strand IN (SELECT b.strand
    FROM mono a JOIN mono b ON b.id = a.bp WHERE a.cluster = 3 AND a.color = 5 AND a.pos < 40)""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    picked = m.filter((C("cluster") == 3) & (C("color") == 5) & (C("pos") < 40))
    return P.connected_strands(m, picked).select("id", "strand")


DD = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


@query("jn_radius_edges", f"""SELECT a.id AS i, b.id AS j, {r4(DD)} AS d FROM pts a JOIN pts b
    ON a.id < b.id AND {DD} <= 2.0 / 8.518""")
def _(spark, sf):
    return P.radius_edges(A.points(spark, sf).select("id", "p"), 2.0).select(
        "i", "j", r_near(C("d")).alias("d"))


def dot3(u, v):
    return " + ".join(f"{u.replace('@', a)}*{v.replace('@', a)}" for a in "xyz")


@query("jn_torsion_edges", f"""SELECT a.id AS i, b.id AS j, {r4(DD)} AS d,
    {r4(f"CASE WHEN b.id = a.id + 1 THEN {dot3('(b.@-a.@)', 'a.a1@')} END")} AS e0,
    {r4(f"CASE WHEN b.id = a.id + 1 THEN -({dot3('(b.@-a.@)', 'b.a1@')}) END")} AS e1,
    {r4(f"CASE WHEN b.id = a.id + 1 THEN {dot3('a.a1@', 'b.a1@')} END")} AS e2,
    {r4(f"CASE WHEN b.id = a.id + 1 THEN {dot3('a.a3@', 'b.a3@')} END")} AS e3
    FROM pts a JOIN pts b ON a.id < b.id AND {DD} <= 3.0 / 8.518""")
def _(spark, sf):
    e = P.torsion_edges(A.points(spark, sf).select("id", "p", "a1", "a3"), 3.0)
    return e.select("i", "j", r_near(C("d")).alias("d"),
                    *[r(F.get("extra", F.lit(k))).alias(f"e{k}") for k in range(4)])


@query("jn_backbone_edges", f"""SELECT a.id AS i, b.id AS j, {r4(DD)} AS d, 100.0::DOUBLE AS k
    FROM sites a JOIN sites b ON b.id = a.n3 WHERE {DD} < 0.4""")
def _(spark, sf):
    return P.backbone_edges(A.sites(spark, sf).select("id", "n3", "p"), 0.4).select(
        "i", "j", r(C("d")).alias("d"), "k")


def particles(spark, sf):
    p = A.points(spark, sf)
    return p.select((C("label") % 2).alias("dataset"), C("strand").alias("chain"),
                    C("pos").alias("residue"), "id", "p")


BONDED = """SELECT a.id AS i, b.id AS j, {d} AS d, 100.0::DOUBLE AS k, NULL AS res1 FROM part t JOIN pts a
    ON a.label % 2 = t.p_size % 2 AND a.strand = t.p_partkey % 19 AND a.pos = t.{x} % 32
    JOIN pts b ON b.label % 2 = t.p_size % 2 AND b.strand = t.p_partkey % 23
    AND b.pos = (t.p_partkey + t.p_size) % 32
    UNION ALL SELECT NULL, NULL, NULL, NULL, t.{x} % 32 FROM part t LEFT JOIN pts a
    ON a.label % 2 = t.p_size % 2 AND a.strand = t.p_partkey % 19 AND a.pos = t.{x} % 32
    LEFT JOIN pts b ON b.label % 2 = t.p_size % 2 AND b.strand = t.p_partkey % 23
    AND b.pos = (t.p_partkey + t.p_size) % 32 WHERE a.id IS NULL OR b.id IS NULL"""


def residue_bonds(spark, sf, x):
    k = C("p_partkey")
    bonds = A.read(spark, sf, "part").select(
        (C("p_size") % 2).alias("dataset"), (k % 19).alias("chain1"), (C(x) % 32).alias("res1"),
        (k % 23).alias("chain2"), ((k + C("p_size")) % 32).alias("res2"))
    good, bad = P.residue_edges(bonds, particles(spark, sf))
    none = lambda t: F.lit(None).cast(t)
    return good.select("i", "j", r(C("d")).alias("d"), "k", none("bigint").alias("res1")).unionByName(
        bad.select(none("bigint").alias("i"), none("bigint").alias("j"), none("double").alias("d"),
                   none("double").alias("k"), C("res1").cast("bigint").alias("res1")))


@query("jn_hbond_edges", BONDED.format(d=r4(DD), x="p_size"))
def _(spark, sf):
    return residue_bonds(spark, sf, "p_size")


@query("jn_disulphide_edges", BONDED.format(d=r4(DD), x="p_partkey"))
def _(spark, sf):
    return residue_bonds(spark, sf, "p_partkey")


@query("jn_nonpolar_edges", f"""SELECT a.id AS i, b.id AS j, {r4(DD)} AS d, 1.0::DOUBLE AS k FROM sites a
    JOIN sites b ON a.id < b.id AND {DD} < 4.0 / 8.518 AND coalesce(a.n3, -1) <> b.id
    AND coalesce(a.n5, -1) <> b.id""")
def _(spark, sf):
    return P.nonpolar_edges(A.sites(spark, sf).select("id", "n3", "n5", "p")).select(
        "i", "j", r_near(C("d")).alias("d"), "k")


LETTER = "substr('DEKHRA', residue % 6 + 1, 1)"


@query("jn_salt_bridges", f"""WITH a AS (SELECT residue, {LETTER} AS l, name, x, y, z
    FROM residue_atoms), n AS (SELECT * FROM a WHERE (l = 'D' AND name IN ('OD1', 'OD2')) OR
    (l = 'E' AND name IN ('OE1', 'AE1', 'OE2', 'AE2'))), p AS (SELECT * FROM a WHERE
    (l = 'K' AND name = 'NZ') OR (l = 'H' AND name IN ('ND1', 'AD1')) OR
    (l = 'R' AND name IN ('NH1', 'NH2'))) SELECT DISTINCT least(a.residue, b.residue) AS i,
    greatest(a.residue, b.residue) AS j, 10.0::DOUBLE AS k FROM n a JOIN p b
    ON {DD} < 4.0 / 8.518""")
def _(spark, sf):
    letter = F.substring(F.lit("DEKHRA"), (C("residue") % 6 + 1).cast("int"), F.lit(1))
    atoms = A.atoms(spark, sf, A.RESIDUE_ATOMS).withColumn("letter", letter)
    return P.salt_bridges(atoms)


FD = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))"


@query("jn_frames_selection", f"""SELECT a.frame, a.particle AS a, b.particle AS b, {r4(FD)} AS d,
    {r4(FD + " * 0.8518")} AS nm FROM coords a JOIN coords b ON b.frame = a.frame
    AND b.particle = a.particle + 3 WHERE a.particle % 5 = 1""")
def _(spark, sf):
    c = A.coords(spark, sf).withColumnRenamed("particle", "id")
    ids = c.select("id").distinct().filter(C("id") % 5 == 1)
    pairs = ids.select(C("id").alias("a"), (C("id") + 3).alias("b"))
    return P.frame_distances(c, pairs, ["frame"]).select(
        "frame", "a", "b", r(C("d")).alias("d"), r(C("nm")).alias("nm"))


@query("jn_frame_params", """SELECT c.particle, c.frame, p.value FROM coords c LEFT JOIN (
    SELECT frame, count(*) AS value FROM coords GROUP BY frame HAVING frame % 3 <> 0) p
    ON p.frame = c.frame""")
def _(spark, sf):
    c = A.coords(spark, sf)
    params = c.groupBy("frame").agg(F.count(F.lit(1)).alias("value")).filter(C("frame") % 3 != 0)
    return c.join(params, "frame", "left").select("particle", "frame", "value")


@query("jn_dot_bracket_traps", """WITH s AS (SELECT strand, string_agg(base, '' ORDER BY pos) AS seq,
    max(class) AS class FROM mono GROUP BY strand), h AS (SELECT strand, strpos(seq, 'GATC') - 1 AS at
    FROM s WHERE contains(seq, 'GATC')), b(pos, partner) AS (VALUES (0, 3), (1, 2), (2, 1), (3, 0))
    SELECT a.id AS particle, c.id AS ref_particle, 0.09::DOUBLE AS stiff, 1.2::DOUBLE AS r0, 1 AS pbc
    FROM h JOIN b ON true JOIN mono a ON a.strand = h.strand AND a.pos = h.at + b.pos
    JOIN mono c ON c.strand = h.strand AND c.pos = h.at + b.partner""")
def _(spark, sf):
    from molframe.operators.sequences import search
    from molframe.sources.auxiliary import bracket_partners
    m = A.monomers(spark, sf)
    notation = spark.createDataFrame([("GATC", "(())")], "id string, notation string")
    partners, _errors = bracket_partners(notation)
    return P.bracket_traps(m, search(m, ["GATC"]), partners)


@query("jn_pair_traps", """SELECT id AS particle, bp AS ref_particle, 0.09::DOUBLE AS stiff,
    1.2::DOUBLE AS r0, 1 AS pbc FROM mono WHERE bp IS NOT NULL UNION ALL SELECT id, bp, 0.5, 1.2, 1
    FROM mono WHERE bp IS NOT NULL AND id % 4 = 0""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    # a quarter of the pairs have another trap, another quarter have the very same one
    stiff = F.when(C("id") % 4 == 0, 0.5).otherwise(0.09)
    have = m.filter(C("bp").isNotNull() & (C("id") % 4 < 2)).select(
        C("id").alias("particle"), C("bp").alias("ref_particle"), stiff.alias("stiff"),
        F.lit(1.2).alias("r0"), F.lit(1).alias("pbc"))
    return P.pair_traps(m, have)


@query("jn_selection_traps", """WITH s AS (SELECT id, row_number() OVER (ORDER BY color, id) - 1 AS k
    FROM mono WHERE cluster = 5 AND color IS NOT NULL), p AS (SELECT a.id AS a, b.id AS b FROM s a
    JOIN s b ON b.k = a.k + 1 WHERE a.k % 2 = 0) SELECT a AS particle, b AS ref_particle FROM p
    UNION ALL SELECT b, a FROM p
    UNION ALL SELECT id, NULL FROM s WHERE k % 2 = 0 AND k = (SELECT max(k) FROM s)""")
def _(spark, sf):
    m = A.monomers(spark, sf).filter((C("cluster") == 5) & C("color").isNotNull())
    sel = m.select((C("color").cast("bigint") * 10 ** 15 + C("id")).alias("ord"), "id")
    traps, odd = P.selection_traps(sel)
    # an odd member has no partner
    return traps.select("particle", "ref_particle").unionByName(odd.select(
        C("id").alias("particle"), F.lit(None).cast("bigint").alias("ref_particle")))


@query("jn_forces_by_element", """SELECT id AS particle, bp AS ref_particle, 'kept' AS side FROM mono a
    WHERE bp IS NOT NULL AND id % 7 <> 0 AND bp % 7 <> 0 UNION ALL SELECT id, bp, 'touching' FROM mono
    WHERE bp IS NOT NULL AND (id % 7 = 0 OR bp % 7 = 0)""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    forces = m.filter(C("bp").isNotNull()).select(C("id").alias("particle"),
                                                  C("bp").alias("ref_particle"))
    ids = m.filter(C("id") % 7 == 0).select("id")
    return P.remove_forces(forces, ids).withColumn("side", F.lit("kept")).unionByName(
        P.forces_touching(forces, ids).withColumn("side", F.lit("touching")))


def _apart(s, t):
    """Squared distance of the points at shares ``s`` and ``t`` of two segments with w between their origins."""
    return " + ".join(f"power(w{a} + ({s}) * u{a} - ({t}) * v{a}, 2)" for a in "xyz")


def _share(x):
    return f"least(greatest({x}, 0.0), 1.0)"


def _dots(p, q):
    return " + ".join(f"{p}{a} * {q}{a}" for a in "xyz")


LENGTH = f"{P.CYLINDER!r}::DOUBLE"


# the closest points lie at an end of a segment or where the lines come closest; pairs go in order of dot
@query("jn_axis_overlap", f"""WITH RECURSIVE two AS (SELECT a.id AS a, b.id AS b,
    a.a1x*b.a1x + a.a1y*b.a1y + a.a1z*b.a1z AS dot, (a.x - b.x) * 40 AS wx, (a.y - b.y) * 40 AS wy,
    (a.z - b.z) * 40 AS wz, a.a1x * {LENGTH} AS ux, a.a1y * {LENGTH} AS uy, a.a1z * {LENGTH} AS uz,
    b.a1x * {LENGTH} AS vx, b.a1y * {LENGTH} AS vy, b.a1z * {LENGTH} AS vz
    FROM pts a JOIN pts b ON a.id < b.id WHERE a.a1x*b.a1x + a.a1y*b.a1y + a.a1z*b.a1z < -0.9),
    pr AS (SELECT *, {_dots('u', 'u')} AS uu, {_dots('u', 'v')} AS uv, {_dots('v', 'v')} AS vv,
    {_dots('u', 'w')} AS uw, {_dots('v', 'w')} AS vw FROM two),
    ln AS (SELECT *, (uv * vw - vv * uw) / (uu * vv - uv * uv) AS s, (uu * vw - uv * uw) / (uu * vv - uv * uv) AS t
    FROM pr), d AS (SELECT a, b, dot, sqrt(wx * wx + wy * wy + wz * wz) * 8.518 AS dist, least(
    {_apart('0', _share('vw / vv'))}, {_apart('1', _share('(vw + uv) / vv'))},
    {_apart(_share('-uw / uu'), '0')}, {_apart(_share('(uv - uw) / uu'), '1')},
    CASE WHEN s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN {_apart('s', 't')} END) AS d2 FROM ln),
    c AS (SELECT a, b, dot, dist, row_number() OVER (ORDER BY dot, a, b) AS k FROM d
    WHERE d2 <= power({P.OVERLAP!r}::DOUBLE, 2)),
    g(k, used, won) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT c.k,
    CASE WHEN list_has_any(used, [a, b]) THEN used ELSE list_concat(used, [a, b]) END,
    NOT list_has_any(used, [a, b]) FROM g JOIN c ON c.k = g.k + 1)
    SELECT a, b, {r4('dot')} AS dot, {r4('dist')} AS dist FROM c JOIN g USING (k) WHERE won""")
def _(spark, sf):
    p = A.points(spark, sf)
    ends = p.select("id", scale(C("p"), 40.0).alias("origin"), C("a1").alias("dir"))
    return P.axis_matching(ends).select(
        "a", "b", r(C("dot")).alias("dot"), r(C("dist")).alias("dist"))


@query("agg_merge_edges", """SELECT least(l_orderkey, l_partkey) AS i, greatest(l_orderkey, l_partkey)
    AS j, sum(l_quantity) AS k FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY ALL""")
def _(spark, sf):
    e = A.read(spark, sf, "lineitem").select(C("l_orderkey").alias("i"), C("l_partkey").alias("j"),
                                             C("l_quantity").alias("k"))
    return P.merge_edges(e)


__all__ = ["dist"]
