"""Copies, merges and batch edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import flat
from molframe.operators import copies as G, edits as E
from molframe.registry.core import query, r4

C = F.col


@query("set_copy_remap", """WITH m AS (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN n5 END AS n5)
    FROM mono), t AS (SELECT max(id) AS top, max(cluster) AS last FROM m),
    k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM m WHERE color = 3),
    g AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS c FROM (SELECT DISTINCT cluster
    FROM m WHERE color = 3 AND cluster > 0))
    SELECT top + 1 + k.k AS id, m.strand, CAST(last + 1 + g.c AS INT) AS cluster, top + 1 + a.k AS n3,
    top + 1 + b.k AS n5, coalesce(top + 1 + c.k, CASE WHEN o.bp IS NULL THEN o.id END) AS bp,
    CASE WHEN a.k IS NULL AND x.n5 IS NULL THEN x.id END AS join3,
    CASE WHEN b.k IS NULL AND y.n3 IS NULL THEN y.id END AS join5
    FROM m JOIN k ON k.id = m.id CROSS JOIN t LEFT JOIN g ON g.cluster = m.cluster
    LEFT JOIN k a ON a.id = m.n3 LEFT JOIN k b ON b.id = m.n5 LEFT JOIN k c ON c.id = m.bp
    LEFT JOIN m x ON x.id = m.n3 LEFT JOIN m y ON y.id = m.n5
    LEFT JOIN m o ON o.id = m.bp AND c.k IS NULL""")
def _(spark, sf):
    m = A.monomers(spark, sf).select(
        "id", "strand", "cluster", "n3", F.when(C("id") % 11 != 0, C("n5")).alias("n5"), "bp", "color")
    out, lig = G.copy_remap(m.drop("color"), m.filter(C("color") == 3).select("id"))
    copies = out.join(m.select("id").hint("merge"), "id", "left_anti")
    lig = lig.select("id", C("n3").alias("join3"), C("n5").alias("join5"))
    return copies.join(lig.hint("merge"), "id", "left")


@query("set_lattice_copies", f"""WITH t AS (SELECT max(id) + 1 AS n FROM sites)
    SELECT id + c * n AS id, n3 + c * n AS n3, CAST(c AS INT) AS cell, {r4('x + (c % 3) * 80')} AS x,
    {r4('y + (c // 3 % 3) * 80')} AS y, {r4('z + (c // 9) * 80')} AS z FROM sites, t, range(27) r(c)""")
def _(spark, sf):
    s = A.sites(spark, sf).select("id", "n3", "n5", F.lit(None).cast("bigint").alias("bp"), "p")
    return G.lattice_copies(s, 80.0).select("id", "n3", "cell", *flat(C("p")))


@query("set_merge_systems", """SELECT structure AS file, id, row_number() OVER (ORDER BY structure, id)
    - 1 AS new_id, dense_rank() OVER (ORDER BY structure, strand) - 1 AS new_strand,
    CASE WHEN cluster IS NOT NULL THEN dense_rank() OVER (ORDER BY cluster IS NULL, structure, cluster)
    END AS new_cluster FROM mono""")
def _(spark, sf):
    m = A.monomers(spark, sf).select(C("structure").alias("file"), "id", "strand", "cluster")
    return G.merge_systems(m)


# Strands renumbered after cuts: order from the first cut on in circles, pieces, fresh ids.
def pieces(cut, lost5, kept="true"):
    return f"""WITH o AS (SELECT *, {cut} AS cut, CASE WHEN strand % 4 = 1 AND min(pos) FILTER ({cut})
    OVER (PARTITION BY strand) IS NOT NULL THEN (pos - min(pos) FILTER ({cut}) OVER (PARTITION BY
    strand) - 1 + len) % len ELSE pos END AS ord, CASE WHEN {lost5} THEN NULL ELSE n5 END AS c5
    FROM circ), r AS (SELECT *, row_number() OVER (PARTITION BY strand ORDER BY ord) - 1 AS k FROM o
    WHERE {kept}), p AS (SELECT *, sum(CASE WHEN c5 IS NULL OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION
    BY strand ORDER BY k) - 1 AS piece FROM r), f AS (SELECT strand, piece, row_number() OVER (ORDER BY
    strand, piece) AS n FROM (SELECT DISTINCT strand, piece FROM p WHERE piece > 0)),
    q AS (SELECT p.*, f.n, k - min(k) OVER (PARTITION BY p.strand, p.piece) AS np FROM p LEFT JOIN f
    ON f.strand = p.strand AND f.piece = p.piece)"""


OUT = ["id", "strand", "pos", "n3", "n5"]
NEW = "coalesce((SELECT max(strand) FROM mono) + n, strand) AS strand, np AS pos"


@query("edt_nick", pieces("id % 50 = 7", "n5 % 50 = 7") + f""" SELECT id, {NEW},
    CASE WHEN id % 50 <> 7 THEN n3 END AS n3, c5 AS n5 FROM q""")
def _(spark, sf):
    m = A.circles(spark, sf)
    return E.nick(m.select(*OUT), m.filter(C("id") % 50 == 7)).select(*OUT)


@query("edt_delete", pieces("id % 40 IN (3, 4)", "n5 % 40 IN (3, 4)", "id % 40 NOT IN (3, 4)") + f"""
    SELECT id, {NEW}, CASE WHEN n3 % 40 NOT IN (3, 4) THEN n3 END AS n3, c5 AS n5,
    CASE WHEN bp % 40 NOT IN (3, 4) THEN bp END AS bp FROM q""")
def _(spark, sf):
    m = A.circles(spark, sf)
    return E.delete(m.select(*OUT, "bp"), m.filter((C("id") % 40).isin(3, 4))).select(*OUT, "bp")


@query("edt_skip", """WITH k AS (SELECT * EXCLUDE (pos), row_number() OVER w - 1 AS pos,
    lead(id) OVER w AS a, lag(id) OVER w AS b, first_value(id) OVER (PARTITION BY strand ORDER BY pos)
    AS f, last_value(id) OVER (PARTITION BY strand ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND
    UNBOUNDED FOLLOWING) AS l FROM circ WHERE id % 40 NOT IN (3, 4)
    WINDOW w AS (PARTITION BY strand ORDER BY pos))
    SELECT id, strand, pos, coalesce(a, CASE WHEN strand % 4 = 1 THEN f END) AS n3,
    coalesce(b, CASE WHEN strand % 4 = 1 THEN l END) AS n5,
    CASE WHEN bp % 40 NOT IN (3, 4) THEN bp END AS bp FROM k""")
def _(spark, sf):
    m = A.circles(spark, sf)
    return E.skip(m, m.filter((C("id") % 40).isin(3, 4))).select(*OUT, "bp")


@query("edt_ligate", """WITH s AS (SELECT *, strand % 5 AS g, CASE WHEN strand % 5 < 3 THEN
    strand - strand % 5 ELSE strand END AS head FROM strands), b AS (SELECT *, sum(len) OVER
    (PARTITION BY head ORDER BY strand) - len AS before FROM s)
    SELECT m.id, b.head AS strand, CAST(b.before + m.pos AS BIGINT) AS pos, CASE WHEN m.n3 IS NOT NULL
    THEN m.n3 WHEN b.g = 3 THEN b.first WHEN b.g < 2 THEN x.first END AS n3,
    CASE WHEN m.n5 IS NOT NULL THEN m.n5 WHEN b.g = 3 THEN b.first + b.len - 1 WHEN b.g IN (1, 2)
    THEN y.first + y.len - 1 END AS n5 FROM mono m JOIN b ON b.strand = m.strand
    LEFT JOIN strands x ON x.strand = m.strand + 1 LEFT JOIN strands y ON y.strand = m.strand - 1""")
def _(spark, sf):
    m, s = A.monomers(spark, sf), A.strands(spark, sf)
    g, last = C("strand") % 5, C("first") + C("len") - 1
    nxt = s.select((C("strand") - 1).alias("strand"), C("first").alias("_next"))
    # chains of three, circles, and joints that must be refused: inner monomers, missing strands
    joints = s.join(nxt, "strand", "left").select(
        F.when(g == 4, C("first") + 5).otherwise(last).alias("a"),
        F.when(g < 2, F.coalesce("_next", F.lit(-1))).otherwise(C("first")).alias("b"), g.alias("g"))
    out, _rejected = E.ligate(m, joints.filter(C("g") != 2))
    return out.select(*OUT)


def bb(a, t="m"):
    s = {"x": f"0.34*{t}.ax + 0.3408*{t}.ay", "y": f"0.34*{t}.ay - 0.3408*{t}.ax", "z": "0"}[a]
    n = {"x": f"0.4*{t}.ax", "y": f"0.4*{t}.ay", "z": "0.2"}[a]
    return f"(CASE {t}.class WHEN 'DNA' THEN {s} WHEN 'RNA' THEN {n} ELSE 0 END)"


@query("edt_insert", f"""WITH i AS (SELECT m.*, {", ".join(
    f"(m.p{a} - {bb(a)}) + ((x.p{a} - {bb(a, 'x')}) - (m.p{a} - {bb(a)})) * (k + 1) / 4.0 + {bb(a)} AS q{a}"
    for a in "xyz")}, k + 1 AS sub, substr('ACG', CAST(k AS INT) + 1, 1) AS letter,
    row_number() OVER (ORDER BY m.id, k) + (SELECT max(id) FROM mono) AS fresh
    FROM circ m JOIN circ x ON x.id = m.n3, range(3) r(k) WHERE m.id % 500 = 9),
    u AS (SELECT id, strand, pos, 0 AS sub, base, px, py, pz FROM circ UNION ALL
    SELECT fresh, strand, pos, sub, letter, qx, qy, qz FROM i)
    SELECT id, strand, row_number() OVER w - 1 AS pos, base, coalesce(lead(id) OVER w,
    CASE WHEN strand % 4 = 1 THEN first_value(id) OVER w END) AS n3, coalesce(lag(id) OVER w,
    CASE WHEN strand % 4 = 1 THEN last_value(id) OVER (PARTITION BY strand ORDER BY pos, sub ROWS
    BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS n5, {r4('px', 8)} AS x,
    {r4('py', 8)} AS y, {r4('pz', 8)} AS z FROM u WINDOW w AS (PARTITION BY strand ORDER BY pos, sub)""")
def _(spark, sf):
    m = A.circles(spark, sf)
    ends = m.filter((C("id") % 500 == 9) | C("n3").isNull())
    out, _refused = E.insert(m, ends.select("id", F.lit("ACG").alias("sequence")))
    return out.select("id", "strand", "pos", "base", "n3", "n5", *flat(C("p"), "", 8))


@query("edt_set_sequence", """WITH s AS (SELECT id, bp, class, row_number() OVER (ORDER BY strand DESC,
    pos) - 1 AS o FROM mono WHERE color = 6), l AS (SELECT p_partkey AS o, substr('ACGGT',
    CAST(p_partkey % 5 AS INT) + 1, 1) AS c FROM part), w AS (SELECT id, c, o * 2 AS r FROM s
    JOIN l USING (o) UNION ALL SELECT bp, CASE WHEN class = 'RNA' THEN translate(c, 'AUGC', 'UACG')
    ELSE translate(c, 'ATGC', 'TACG') END, o * 2 + 1 FROM s JOIN l USING (o) WHERE bp IS NOT NULL),
    n AS (SELECT id, arg_max(c, r) AS c FROM w GROUP BY id)
    SELECT m.id, coalesce(n.c, m.base) AS base FROM mono m LEFT JOIN n ON n.id = m.id""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    letters = A.read(spark, sf, "part").select(C("p_partkey").alias("ord"), F.substring(
        F.lit("ACGGT"), (C("p_partkey") % 5 + 1).cast("int"), F.lit(1)).alias("letter"))
    return E.set_sequence(m, m.filter(C("color") == 6), letters, True).select("id", "base")


DOT = "(a1x*a3x + a1y*a3y + a1z*a3z)"
CROSS = {"x": "(a3y*a1z - a3z*a1y)", "y": "(a3z*a1x - a3x*a1z)", "z": "(a3x*a1y - a3y*a1x)"}


def spun(a):
    return f"(a1{a}*cos(th) + {CROSS[a]}*sin(th) + a3{a}*{DOT}*(1 - cos(th)))"


@query("edt_helix_dna", f"""WITH s AS (SELECT *, k, t, t * 35.9 * pi() / 180 AS th,
    substr('ACGGT', CAST(k AS INT) + 1, 1) AS letter FROM (SELECT *, (k + 1) * CASE WHEN id % 2 = 0 THEN
    -1.0 ELSE 1.0 END AS t FROM pts, range(5) r(k)))
    SELECT id, CAST(k AS INT) AS k, letter, {", ".join(f'''{r4(f"{a} + 0.6*a1{a} + a3{a}*t*0.3897628551303122 - 0.6*{spun(a)}")} AS p_{a},
    {r4(spun(a))} AS a1_{a}, {r4(f"{a} + 0.6*a1{a} + a3{a}*t*0.3897628551303122 + 0.6*{spun(a)}")} AS q_{a}'''
    for a in "xyz")} FROM s""")
def _(spark, sf):
    s = A.points(spark, sf).select("id", "p", "a1", "a3", F.when(C("id") % 2 == 0, "n3").otherwise(
        "n5").alias("towards"), F.lit("ACGGT").alias("sequence"))
    return E.dna_steps(s).select("id", "k", "letter", *flat(C("p"), "p_"), *flat(C("a1"), "a1_"),
                                 *flat(C("q"), "q_"))


def per_axis(form: str, name: str) -> str:
    """One SQL column per axis: ``@`` stands for the axis."""
    return ", ".join(f"{form.replace('@', a)} AS {name}{a}" for a in "xyz")


def inner(u: str, v: str) -> str:
    return "(" + " + ".join(f"{u}{a}*{v}{a}" for a in "xyz") + ")"


RNA_OUT = {"p_": "o@ + rad*rk@ + u@*n*0.3287 - 0.6*bond@", "a1_": "bond@", "a3_": "y@",
           "q_": "o@ + rad*rk@ + u@*n*0.3287 + 0.6*bond@", "b3_": "-y@"}


@query("edt_helix_rna", f"""WITH c AS (SELECT id, x AS px, y AS py, z AS pz, a1x, a1y, a1z, a3x, a3y, a3z,
    CASE WHEN id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS way, cos(radians(15.5)) AS cl,
    -sin(radians(15.5)) AS sl, sqrt(1.175*1.175 - cos(radians(15.5))*cos(radians(15.5))) AS rad FROM pts),
    t AS (SELECT *, {per_axis(f"a3@/sqrt({inner('a3', 'a3')})", "t")} FROM c),
    l AS (SELECT *, {per_axis(f"a1@ - t@*{inner('a1', 't')}", "l")} FROM t),
    u AS (SELECT *, {per_axis(f"way*(sl*l@/sqrt({inner('l', 'l')}) - cl*t@)", "u")} FROM l),
    f AS (SELECT *, {per_axis(f"a1@ - u@*{inner('a1', 'u')}", "f")} FROM u),
    e AS (SELECT *, {per_axis(f"way*f@/sqrt({inner('f', 'f')})", "e")} FROM f),
    r AS (SELECT *, ey*uz - ez*uy AS rx, ez*ux - ex*uz AS ry, ex*uy - ey*ux AS rz FROM e),
    o AS (SELECT *, {per_axis("p@ - 0.4*a1@ + way*(cl*e@ + sl*u@) - rad*r@", "o")} FROM r),
    n AS (SELECT *, k + 1 AS n, cos(radians(32.7)*(k + 1)) AS ck, sin(radians(32.7)*(k + 1)) AS sk
        FROM o, range(5) s(k)),
    k AS (SELECT *, {per_axis("e@*ck - r@*sk", "ek")}, {per_axis("r@*ck + e@*sk", "rk")} FROM n),
    b AS (SELECT *, {per_axis("way*(cl*ek@ + sl*u@)", "bond")}, {per_axis("way*(sl*ek@ - cl*u@)", "y")} FROM k)
    SELECT id, CAST(k AS INT) AS k, substr('ACGGU', CAST(k AS INT) + 1, 1) AS letter, {", ".join(
        f"{r4(form.replace('@', a))} AS {name}{a}" for name, form in RNA_OUT.items() for a in "xyz")} FROM b""")
def _(spark, sf):
    s = A.points(spark, sf).select("id", "p", "a1", "a3", F.when(C("id") % 2 == 0, "n3").otherwise(
        "n5").alias("towards"), F.lit("ACGGU").alias("sequence"))
    return E.rna_steps(s).select("id", "k", "letter", *[c for n, v in zip(
        RNA_OUT, ("p", "a1", "a3", "q", "b3")) for c in flat(C(v), n)])


EXTENSIONS = """(SELECT first + len - 1 AS e, strand, 'ACGT' AS seq, 3 AS way, len - 1 AS at FROM strands
    WHERE class IN ('DNA', 'RNA') AND strand % 2 = 1 UNION ALL SELECT first, strand, 'GGC', 5, 0
    FROM strands WHERE class IN ('DNA', 'RNA') AND strand % 3 = 0)"""


def extensions(spark, sf, extra=True):
    s = A.strands(spark, sf).filter(C("class").isin("DNA", "RNA"))
    out = s.filter(C("strand") % 2 == 1).select((C("first") + C("len") - 1).alias("id"),
                                                F.lit("ACGT").alias("sequence"))
    if extra:
        out = out.unionByName(s.filter(C("strand") % 3 == 0).select(
            C("first").alias("id"), F.lit("GGC").alias("sequence")))
        # inner monomers are refused
        out = out.unionByName(s.select((C("first") + 9).alias("id"), F.lit("AA").alias("sequence")))
    return out


@query("edt_extend_strand", f"""WITH d AS (SELECT *, length(seq) AS n, row_number() OVER (ORDER BY e, k)
    + (SELECT max(id) FROM mono) AS id FROM {EXTENSIONS}, range(4) r(k) WHERE k < length(seq))
    SELECT id, strand, substr(seq, CAST(k AS INT) + 1, 1) AS base,
    CASE WHEN way = 3 THEN at + k + 1 ELSE at - k - 1 END AS pos,
    CASE WHEN (way = 3) THEN CASE WHEN k < n - 1 THEN id + 1 END WHEN k = 0 THEN e ELSE id - 1 END AS n3,
    CASE WHEN (way = 5) THEN CASE WHEN k < n - 1 THEN id + 1 END WHEN k = 0 THEN e ELSE id - 1 END AS n5
    FROM d""".replace(" at ", ' "at" ').replace(" at,", ' "at",').replace("AS at", 'AS "at"'))
def _(spark, sf):
    new, _refused = E.extend_strand(A.monomers(spark, sf), extensions(spark, sf))
    return new.select("id", "strand", "base", "pos", "n3", "n5")


@query("edt_create_pair", f"""SELECT row_number() OVER (ORDER BY id) + (SELECT max(id) FROM mono) AS id,
    row_number() OVER (ORDER BY id) + (SELECT max(strand) FROM mono) AS strand,
    CASE WHEN class = 'RNA' THEN translate(base, 'AUGC', 'UACG') ELSE translate(base, 'ATGC', 'TACG')
    END AS base, id AS bp, {r4('px + 1.2 * ax', 6)} AS x, {r4('py + 1.2 * ay', 6)} AS y,
    {r4('pz', 6)} AS z, {r4('-ax')} AS a1_x, -1.0::DOUBLE AS a3_z FROM mono WHERE bp IS NULL
    AND class IN ('DNA', 'RNA')""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    d = E.create_pair(m, m.filter(C("class").isin("DNA", "RNA")))
    return d.select("id", "strand", "base", "bp", *flat(C("p"), "", 6),
                    (C("a1.x") + 0.0).alias("a1_x"), C("a3.z").alias("a3_z"))


@query("edt_extend_duplex", """WITH e AS (SELECT m.*, s.len AS slen FROM mono m JOIN strands s
    ON s.strand = m.strand AND m.id = s.first + s.len - 1 WHERE s.class IN ('DNA', 'RNA')
    AND s.strand % 2 = 1), mk AS (SELECT id AS bp, base, class, row_number() OVER (ORDER BY id) +
    (SELECT max(id) FROM mono) AS id, row_number() OVER (ORDER BY id) + (SELECT max(strand) FROM mono)
    AS strand FROM e WHERE bp IS NULL), top AS (SELECT greatest((SELECT max(id) FROM mono),
    coalesce((SELECT max(id) FROM mk), 0)) AS t),
    s AS (SELECT e.id AS nd, e.strand, e.class, coalesce(e.bp, mk.id) AS m, coalesce(x.strand, mk.strand)
    AS ms FROM e LEFT JOIN mk ON mk.bp = e.id LEFT JOIN mono x ON x.id = e.bp WHERE x.n5 IS NULL),
    d AS (SELECT *, t + 2 * row_number() OVER (ORDER BY nd, k) - 1 AS id,
    substr('ACGT', CAST(k AS INT) + 1, 1) AS base FROM s, top, range(4) r(k))
    SELECT id, strand, base, id + 1 AS bp, CASE WHEN k < 3 THEN id + 2 END AS n3,
    CASE WHEN k = 0 THEN nd ELSE id - 2 END AS n5 FROM d UNION ALL
    SELECT id + 1, ms, CASE WHEN class = 'RNA' THEN translate(base, 'AUGC', 'UACG') ELSE
    translate(base, 'ATGC', 'TACG') END, id, CASE WHEN k = 0 THEN m ELSE id - 1 END,
    CASE WHEN k < 3 THEN id + 3 END FROM d""")
def _(spark, sf):
    _made, new, _refused = E.extend_duplex(A.monomers(spark, sf), extensions(spark, sf, False))
    return new.select("id", "strand", "base", "bp", "n3", "n5")


THETA = "(k * 35.9 * pi() / 180)"
SEQS = """(SELECT p_partkey AS "key", substr(repeat('ACGT', 8), CAST(p_partkey % 4 AS INT) + 1,
    p_size % 20 + 1) AS seq FROM part)"""
CREATED = f"""(SELECT "key", CAST(k AS INT) AS k, seq, side, CASE side WHEN 1 THEN substr(seq, CAST(k AS INT)
    + 1, 1) ELSE translate(substr(seq, CAST(k AS INT) + 1, 1), 'ATGC', 'TACG') END AS base,
    0.6*sin{THETA} * CASE side WHEN 1 THEN 1 ELSE -1 END AS x,
    0.6 - 0.6*cos{THETA} * CASE side WHEN 1 THEN 1 ELSE -1 END AS y, k*0.3897628551303122 AS z
    FROM {{}}, range(32) r(k), range(1, 3) u(side) WHERE k < length(seq))"""


@query("edt_create_strand", f"""SELECT "key", CAST(side AS INT) AS side, k, base, {r4('x')} AS x,
    {r4('y')} AS y, {r4('z')} AS z FROM {CREATED.format(SEQS)}""")
def _(spark, sf):
    k = C("p_partkey")
    seq = F.substring(F.lit("ACGT" * 8), (k % 4 + 1).cast("int"), (C("p_size") % 20 + 1).cast("int"))
    s = A.read(spark, sf, "part").select(k.alias("key"), seq.alias("sequence"),
                                         F.lit("DNA").alias("class"))
    return E.create_strands(s, True).select("key", "side", "k", "base", *flat(C("p")))


BRIDGES = """(SELECT strand AS "key", 'GGGGGGGGG' AS seq FROM strands WHERE strand % 2 = 1)"""


@query("edt_connect_duplex", f"""WITH b AS (SELECT * FROM {CREATED.format(BRIDGES)}),
    o AS (SELECT "key", avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM b GROUP BY 1),
    c AS (SELECT strand, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM mono GROUP BY 1)
    SELECT b."key", CAST(side AS INT) AS side, CAST(CASE side WHEN 1 THEN k ELSE 8 - k END AS INT) AS pos,
    base, {", ".join(f"{r4(f'b.{a} - o{a} + (p.c{a} + q.c{a}) / 2')} AS {a}" for a in "xyz")}
    FROM b JOIN o ON o."key" = b."key" JOIN c p ON p.strand = b."key" JOIN c q
    ON q.strand = b."key" + 1""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    odd = A.strands(spark, sf).filter(C("strand") % 2 == 1)
    bridges = odd.select(C("strand").alias("key"), C("strand").alias("s1"),
                         (C("strand") + 1).alias("s2"), F.lit("G" * 9).alias("sequence"))
    placed, _joints = E.connect_duplex(m, bridges)
    return placed.select("key", "side", "pos", "base", *flat(C("p")))
