"""Helix, window and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import add, dist, flat, r, sub
from molframe.operators import helices as H, networks as N, pairing as P
from molframe.plans.ordered import dense_index, neighbours
from molframe.registry.core import query, r4
from molframe.sinks.lines import with_header

C = F.col

CROSS = """(SELECT *, CASE WHEN h0 = helix THEN offs > o0 END AS ra,
    CASE WHEN h2 = h1 THEN o2 > o1 END AS rb FROM (SELECT *, lag(helix) OVER w AS h0,
    lag(offs) OVER w AS o0, lead(id) OVER w AS i1, lead(helix) OVER w AS h1, lead(offs) OVER w AS o1,
    lead(forward) OVER w AS f1, lead(helix, 2) OVER w AS h2, lead(offs, 2) OVER w AS o2 FROM grid
    WINDOW w AS (PARTITION BY strand ORDER BY pos)) WHERE h1 <> helix)"""
BOTH = f"""(SELECT helix AS a, h1 AS b, offs - o1 AS s, ra = rb AS same FROM {CROSS} UNION ALL
    SELECT h1, helix, o1 - offs, ra = rb FROM {CROSS})"""
COUNTS = f"(SELECT a, b, count(*) AS n FROM {BOTH} GROUP BY a, b)"


@query("win_crossovers", f"""SELECT helix AS from_helix, h1 AS to_helix, offs AS from_offset,
    o1 AS to_offset, id AS from_id, i1 AS to_id FROM {CROSS}""")
def _(spark, sf):
    return H.crossovers(A.grid(spark, sf)).select(
        "from_helix", "to_helix", "from_offset", "to_offset", "from_id", "to_id")


@query("agg_connection_counts", f"SELECT * FROM {COUNTS}")
def _(spark, sf):
    return H.connection_counts(A.grid(spark, sf))


@query("agg_walk_votes", f"""SELECT a, b, count(*) FILTER (same) AS same_walk,
    count(*) FILTER (NOT same) AS diff_walk FROM {BOTH} WHERE same IS NOT NULL GROUP BY a, b""")
def _(spark, sf):
    return H.walk_votes(A.grid(spark, sf))


@query("agg_pair_weights", f"""WITH c AS {COUNTS}, d AS (SELECT a, sum(n) AS deg FROM c GROUP BY a)
    SELECT c.a, c.b, c.n, CAST(x.deg + y.deg AS BIGINT) AS weight FROM c JOIN d x ON x.a = c.a
    JOIN d y ON y.a = c.b WHERE c.a < c.b""")
def _(spark, sf):
    return H.pair_weights(H.connection_counts(A.grid(spark, sf)))


def isin(r, values):
    return f"{r} IN ({', '.join(map(str, values))})"


HC = f"CASE WHEN same THEN {isin('gap % 28', H.HONEYCOMB[0])} ELSE {isin('gap % 28', H.HONEYCOMB[1])} END"
SQ = f"CASE WHEN same THEN {isin('gap % 32', H.SQUARE[0])} ELSE {isin('gap % 32', H.SQUARE[1])} END"


@query("agg_lattice_vote", f"""WITH p AS (SELECT helix, id, offs, forward FROM {CROSS} UNION
    SELECT h1, i1, o1, f1 FROM {CROSS}), g AS (SELECT offs - lag(offs) OVER w AS gap,
    forward = lag(forward) OVER w AS same FROM p WINDOW w AS (PARTITION BY helix ORDER BY offs, id)),
    v AS (SELECT count(*) FILTER ({HC} AND NOT {SQ}) AS honeycomb,
    count(*) FILTER ({SQ} AND NOT {HC}) AS square FROM g WHERE gap > 0 AND NOT (same AND gap = 1))
    SELECT honeycomb, square, CASE WHEN square > honeycomb THEN 'square' ELSE 'honeycomb' END AS kind
    FROM v""")
def _(spark, sf):
    return H.lattice_vote(A.grid(spark, sf))


@query("agg_shift_median", f"""SELECT a, b, count(*) AS n, CAST(floor(median(s) + 0.5) AS BIGINT)
    AS shift FROM {BOTH} GROUP BY a, b""")
def _(spark, sf):
    return H.shift_medians(A.grid(spark, sf))


@query("agg_pair_cosine", f"""WITH c AS {COUNTS}, p AS (SELECT a.a, b.b FROM (SELECT DISTINCT a FROM c)
    a, (SELECT DISTINCT b FROM c) b WHERE a.a < b.b AND (b.b - a.a) IN (1, 2, 5)),
    v AS (SELECT p.a, p.b, sum(x.n * y.n) AS d FROM p JOIN c x ON x.a = p.a JOIN c y ON y.a = p.b
    AND y.b = x.b GROUP BY ALL), q AS (SELECT p.a, p.b, (SELECT sum(n * n) FROM c WHERE c.a = p.a
    AND c.b <> p.b) AS qa, (SELECT sum(n * n) FROM c WHERE c.a = p.b AND c.b <> p.a) AS qb FROM p)
    SELECT q.a, q.b, {r4('''CASE WHEN qa > 0 AND qb > 0 THEN least(1.0, coalesce(d, 0) / (sqrt(qa)
    * sqrt(qb))) ELSE 0.0 END''')} AS cosine FROM q LEFT JOIN v ON v.a = q.a AND v.b = q.b""")
def _(spark, sf):
    counts = H.connection_counts(A.grid(spark, sf))
    a = counts.select("a").distinct()
    pairs = a.select("a", F.explode(F.array(C("a") + 1, C("a") + 2, C("a") + 5)).alias("b"))
    pairs = pairs.join(a.withColumnRenamed("a", "b"), "b", "left_semi")
    return H.pair_cosine(counts, pairs).select("a", "b", r(C("cosine")).alias("cosine"))


@query("agg_grid_conflicts", """SELECT helix, forward, offs AS "offset", count(*) AS n, NULL AS id
    FROM grid WHERE id % 97 <> 0 GROUP BY ALL HAVING count(*) > 1 UNION ALL
    SELECT NULL, NULL, NULL, NULL, id FROM grid WHERE id % 97 = 0""")
def _(spark, sf):
    g = A.grid(spark, sf)
    slots, lost = H.grid_conflicts(g.filter(C("id") % 97 != 0), A.monomers(spark, sf))
    return slots.withColumn("id", F.lit(None).cast("bigint")).unionByName(
        lost, allowMissingColumns=True)


@query("agg_slot_overlap", f"""WITH s AS (SELECT DISTINCT helix, forward, offs FROM grid
    WHERE id % 3 = 0), p AS (SELECT a, b FROM {COUNTS} WHERE a < b)
    SELECT p.a, p.b, count(y.helix) AS shared FROM p LEFT JOIN s x ON x.helix = p.a LEFT JOIN s y
    ON y.helix = p.b AND y.forward = x.forward AND y.offs = x.offs GROUP BY p.a, p.b""")
def _(spark, sf):
    g = A.grid(spark, sf)
    pairs = H.connection_counts(g).filter(C("a") < C("b"))
    return H.slot_overlap(g.filter(C("id") % 3 == 0), pairs)


def cover(s, d, x, e):
    """Share of the axis s .. s + d (length 1) under x .. x + e."""
    t0 = " + ".join(f"({x}{a}-{s}{a})*{d}{a}" for a in "xyz")
    t1 = " + ".join(f"({x}{a}+{e}{a}-{s}{a})*{d}{a}" for a in "xyz")
    return r4(f"greatest(0, least(1.0, greatest({t0}, {t1})) - greatest(0.0, least({t0}, {t1})))")


@query("agg_shadow", f"""SELECT a.id AS a, {cover('a.', 'a.a1', 'b.', 'b.a1')} AS cov_a,
    {cover('b.', 'b.a1', 'a.', 'a.a1')} AS cov_b FROM pts a JOIN pts b ON b.id = a.id + 1""")
def _(spark, sf):
    p = A.points(spark, sf)
    ends = p.select("id", C("p").alias("a0"), add(C("p"), C("a1")).alias("a1"))
    pairs = ends.join(ends.select((C("id") - 1).alias("id"), C("a0").alias("b0"),
                                  C("a1").alias("b1")), "id")
    return H.shadow(pairs).select(C("id").alias("a"), r(C("cov_a")).alias("cov_a"),
                                  r(C("cov_b")).alias("cov_b"))


RUNS = """(SELECT *, sum(brk) OVER (PARTITION BY sa, sb, total ORDER BY pa) AS run FROM (
    SELECT *, CASE WHEN pa - lag(pa) OVER (PARTITION BY sa, sb, total ORDER BY pa) <= 2 THEN 0
    ELSE 1 END AS brk FROM (SELECT a.strand AS sa, b.strand AS sb, a.pos + b.pos AS total,
    a.id AS ia, b.id AS ib, a.pos AS pa, b.pos AS pb FROM mono a JOIN mono b ON b.id = a.bp
    WHERE a.id < a.bp)))"""


@query("win_duplex_runs", f"""SELECT sa AS strand_a, sb AS strand_b, total, CAST(run AS BIGINT) AS run,
    ia AS id, ib AS bp FROM {RUNS}""")
def _(spark, sf):
    return H.duplex_runs(A.monomers(spark, sf)).select("strand_a", "strand_b", "total", "run", "id",
                                                       "bp")


@query("win_duplex_ends", f"""SELECT sa AS strand_a, CAST(run AS BIGINT) AS run,
    arg_min(ia, pa) AS start1, arg_max(ia, pa) AS end1, arg_min(ib, pb) AS start2,
    arg_max(ib, pb) AS end2 FROM {RUNS} GROUP BY sa, sb, total, run HAVING count(*) > 1""")
def _(spark, sf):
    return H.duplex_ends(H.duplex_runs(A.monomers(spark, sf))).select(
        "strand_a", "run", "start1", "end1", "start2", "end2")


@query("agg_axis_fit")
def _(spark, sf):
    m = A.monomers(spark, sf)
    runs = H.duplex_runs(m)
    d = H.axis_fit(m.select("id", "n3", "n5", C("p").alias("bb")), runs)
    return d.select("strand_a", "run", "n", *flat(C("axis")))


@query("win_runs_unpaired", """WITH u AS (SELECT *, pos - row_number() OVER (PARTITION BY strand
    ORDER BY pos) AS g FROM mono WHERE bp IS NULL), s AS (SELECT structure, arg_max(strand,
    len * 1000000000 - strand) AS main FROM strands GROUP BY structure)
    SELECT u.id, u.strand, min(pos) OVER w AS first, count(*) OVER w AS size, CASE WHEN count(*) OVER w
    <= 2 THEN 'stub' WHEN u.strand = s.main THEN 'scaffold' ELSE 'ssdna' END AS kind
    FROM u JOIN s ON s.structure = u.structure WINDOW w AS (PARTITION BY u.strand, g)""")
def _(spark, sf):
    return H.unpaired_runs(A.monomers(spark, sf))


# Helices of one duplex each: odd strands with the next one, whose unpaired monomers of id % 3 = 0
# are cut out, so that the two sides have gaps of different length.
def helix_members(spark, sf):
    m = A.monomers(spark, sf).filter(C("class").isin("DNA", "RNA"))
    odd = C("strand") % 2 == 1
    helix = F.when(odd, C("strand")).otherwise(C("strand") - 1)
    m = m.filter(odd | C("bp").isNotNull() | (C("id") % 3 != 0))
    walk = F.when(odd, C("pos")).otherwise(-C("pos"))
    d = m.select(helix.alias("helix"), F.when(odd, "a").otherwise("b").alias("side"),
                 walk.alias("_w"), C("id").alias("member"), "bp")
    return dense_index(d, ["helix", "side"], ["_w"], "_g").select(
        "helix", "side", "pos", C("member").alias("id"), "bp")


@query("win_offsets", """WITH m AS (SELECT CASE WHEN strand % 2 = 1 THEN strand ELSE strand - 1 END
    AS helix, strand % 2 = 1 AS odd, id, bp, pos FROM mono WHERE class IN ('DNA', 'RNA')
    AND (strand % 2 = 1 OR bp IS NOT NULL OR id % 3 <> 0)),
    w AS (SELECT *, row_number() OVER (PARTITION BY helix, odd ORDER BY CASE WHEN odd THEN pos
    ELSE -pos END) - 1 AS k FROM m),
    a AS (SELECT x.helix, x.id, x.bp, x.k AS pa, y.k AS pb FROM w x JOIN w y ON y.id = x.bp
    WHERE x.odd), s AS (SELECT *, CASE WHEN lag(pa) OVER t IS NULL THEN greatest(pa, pb) ELSE
    greatest(pa - lag(pa) OVER t, pb - lag(pb) OVER t) END AS step FROM a
    WINDOW t AS (PARTITION BY helix ORDER BY pa)),
    o AS (SELECT *, sum(step) OVER (PARTITION BY helix ORDER BY pa) AS av FROM s),
    n AS (SELECT id, av FROM o UNION ALL SELECT bp, av FROM o),
    j AS (SELECT w.*, n.av FROM w LEFT JOIN n ON n.id = w.id),
    l AS (SELECT *, last_value(av IGNORE NULLS) OVER f AS lo, last_value(CASE WHEN av IS NOT NULL
    THEN k END IGNORE NULLS) OVER f AS lk, first_value(av IGNORE NULLS) OVER b AS fo,
    first_value(CASE WHEN av IS NOT NULL THEN k END IGNORE NULLS) OVER b AS fk FROM j
    WINDOW f AS (PARTITION BY helix, odd ORDER BY k ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY helix, odd ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT helix, id, CAST(coalesce(lo + k - lk, fo - (fk - k), k) AS BIGINT) AS "offset" FROM l""")
def _(spark, sf):
    return H.helix_offsets(helix_members(spark, sf)).select("helix", "id", "offset")


@query("win_flip", """SELECT id, helix, CASE WHEN helix % 3 = 0 THEN max(offs) OVER w + min(offs) OVER w
    - offs ELSE offs END AS "offset", forward <> (helix % 3 = 0) AS forward FROM grid
    WINDOW w AS (PARTITION BY helix)""")
def _(spark, sf):
    g = A.grid(spark, sf)
    return H.flip(g, g.filter(C("helix") % 3 == 0).select("helix").distinct()).select(
        "id", "helix", "offset", "forward")


@query("win_normalise_offsets", """SELECT id, offs + 37 - (SELECT min(offs) + 37 FROM grid) AS "offset"
    FROM grid""")
def _(spark, sf):
    return H.normalise(A.grid(spark, sf).withColumn("offset", C("offset") + 37)).select(
        "id", "offset")


@query("snk_domains", """WITH d AS (SELECT *, sum(brk) OVER (PARTITION BY strand ORDER BY pos) AS dom
    FROM (SELECT *, CASE WHEN lag(helix) OVER w = helix AND lag(forward) OVER w = forward AND
    lag(offs) OVER w + CASE WHEN forward THEN 1 ELSE -1 END = offs THEN 0 ELSE 1 END AS brk FROM grid
    WINDOW w AS (PARTITION BY strand ORDER BY pos))),
    s AS (SELECT structure, arg_max(strand, len * 1000000000 - strand) AS main FROM strands
    GROUP BY structure), l AS (SELECT d.strand, dom, min(helix) AS helix, min(forward) AS forward,
    min(offs) AS a, max(offs) + 1 AS b FROM d GROUP BY d.strand, dom)
    SELECT t.structure AS file, l.strand, CAST(dom AS BIGINT) AS domain, '{"helix":' || helix ||
    ',"forward":' || forward || ',"start":' || a || ',"end":' || b || '}' AS line,
    t.strand = s.main AS is_scaffold, CASE WHEN t.strand = s.main THEN '#0066cc' ELSE
    ['#f74308', '#57bb00', '#000000'][CAST(l.strand % 3 AS INT) + 1] END AS color,
    (SELECT max(offs) + 1 FROM grid g WHERE g.helix = l.helix) AS max_offset
    FROM l JOIN strands t ON t.strand = l.strand JOIN s ON s.structure = t.structure""")
def _(spark, sf):
    g = A.grid(spark, sf)
    top = g.groupBy("helix").agg((F.max("offset") + 1).alias("max_offset"))
    from molframe.operators.strands import scaffold
    main = scaffold(A.monomers(spark, sf)).select("structure", C("strand").alias("_main"))
    d = H.domains(g).join(top, "helix").join(
        A.strands(spark, sf).select("strand", "structure"), "strand").join(main, "structure")
    is_main = C("strand") == C("_main")
    staples = F.array(*[F.lit(c) for c in ("#f74308", "#57bb00", "#000000")])
    return d.select(C("structure").alias("file"), "strand", "domain", F.to_json(F.struct(
        "helix", "forward", "start", "end")).alias("line"), is_main.alias("is_scaffold"),
        F.when(is_main, "#0066cc").otherwise(F.get(staples, (C("strand") % 3).cast("int")))
        .alias("color"), "max_offset")


@query("win_position", """SELECT id, strand, pos FROM mono""")
def _(spark, sf):
    li = A.read(spark, sf, "lineitem").select(
        C("l_suppkey").alias("strand"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice", "l_shipdate")
    return dense_index(li, ["strand"], ["l_orderkey", "l_linenumber", "l_partkey",
                                        "l_extendedprice", "l_shipdate"]).select("id", "strand", "pos")


@query("win_track", f"""SELECT particle, frame, x, y, {r4('''sqrt((x - lag(x) OVER w) * (x - lag(x)
    OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w))''')} AS step FROM coords
    WINDOW w AS (PARTITION BY particle ORDER BY frame)""")
def _(spark, sf):
    c = neighbours(A.coords(spark, sf), ["particle"], "frame", {"_last": (C("p"), -1)})
    d = sub(C("p"), C("_last"))
    return c.select("particle", "frame", C("p.x").alias("x"), C("p.y").alias("y"),
                    r(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])).alias("step"))


@query("win_colour_path", f"""SELECT id, {r4('''(row_number() OVER (ORDER BY color, id) - 1)::DOUBLE
    / count(*) OVER ()''', 6)} AS hue FROM mono WHERE cluster = 2 AND color IS NOT NULL""")
def _(spark, sf):
    m = A.monomers(spark, sf).filter((C("cluster") == 2) & C("color").isNotNull())
    d = dense_index(m.select("color", C("id").alias("member")), [], ["color", "member"], "_g", "ord")
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return d.select(C("member").alias("id"), r(C("ord") / n, 6).alias("hue"))


@query("srt_first_members", """SELECT strand, pos, id, n AS rest FROM (SELECT strand, pos, id,
    greatest(len - 20, 0) AS n FROM mono) WHERE pos < 20""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    return m.filter(C("pos") < 20).select("strand", "pos", "id",
                                          F.greatest(C("len") - 20, F.lit(0)).alias("rest"))


def network(spark, sf):
    """Every strand of 32 points is a structure; springs within a cutoff."""
    p = A.points(spark, sf).select(C("strand").alias("structure"), C("pos").alias("id"), "p",
                                   (C("label") + 1.0).alias("mass"))
    e = P.radius_edges(p.select("structure", "id", "p"), 6.0, ["structure"]).select(
        "structure", "i", "j", (1.0 + (C("i") + C("j")) % 3).alias("k"))
    return p, e


@query("agg_hessian", f"""WITH p AS (SELECT strand AS s, pos AS i, [x, y, z] AS v, label + 1.0::DOUBLE AS m
    FROM pts), e AS (SELECT a.s, a.i, b.i AS j, 1.0::DOUBLE + (a.i + b.i) % 3 AS k, a.m AS mi, b.m AS mj,
    [b.v[1]-a.v[1], b.v[2]-a.v[2], b.v[3]-a.v[3]] AS d FROM p a JOIN p b ON b.s = a.s AND a.i < b.i
    AND sqrt((b.v[1]-a.v[1])*(b.v[1]-a.v[1]) + (b.v[2]-a.v[2])*(b.v[2]-a.v[2])
    + (b.v[3]-a.v[3])*(b.v[3]-a.v[3])) <= 6.0 / 8.518),
    w AS (SELECT *, k / (d[1]*d[1] + d[2]*d[2] + d[3]*d[3]) AS w FROM e),
    x AS (SELECT s, i, j, mi, mj, a, b, w * d[a + 1] * d[b + 1] AS v FROM w, range(3) t(a), range(3) u(b)),
    o AS (SELECT s, 3*i + a AS r, 3*i + b AS c, v / mi AS v FROM x UNION ALL
    SELECT s, 3*j + a, 3*j + b, v / mj FROM x UNION ALL
    SELECT s, 3*i + a, 3*j + b, -v / sqrt(mi * mj) FROM x UNION ALL
    SELECT s, 3*j + a, 3*i + b, -v / sqrt(mi * mj) FROM x)
    SELECT s AS structure, r AS "row", c AS col, {r4('sum(v)')} AS value FROM o GROUP BY ALL""")
def _(spark, sf):
    p, e = network(spark, sf)
    return N.hessian(e, p, ["structure"]).select("structure", "row", "col", r(C("value"))
                                                 .alias("value"))


@query("agg_fit_network", f"""WITH a AS (SELECT vec_id // 32 AS structure, vec_id % 32 AS id,
    abs(embedding[1]::DOUBLE) + 0.01 AS msf, (label + 1) * 0.1::DOUBLE AS y FROM embeddings),
    t AS (SELECT structure, id, y FROM a WHERE NOT (structure % 5 = 0 AND id = 31)),
    n AS (SELECT structure, count(*) AS n FROM a GROUP BY 1),
    k AS (SELECT structure, count(*) AS k FROM t GROUP BY 1),
    f AS (SELECT structure, sum(msf * t.y) / sum(msf * msf) AS m FROM a JOIN t USING (structure, id)
    WHERE structure IN (SELECT structure FROM n JOIN k USING (structure) WHERE n = k) GROUP BY 1)
    SELECT structure, {r4('m', 6)} AS m, {r4('1 / m', 6)} AS k, {r4('1 / m / 0.05709', 6)} AS sim_k,
    false AS mismatch FROM f UNION ALL SELECT structure, NULL, NULL, NULL, true FROM n
    LEFT JOIN k USING (structure) WHERE n IS DISTINCT FROM k""")
def _(spark, sf):
    e = A.read(spark, sf, "embeddings").select(
        F.floor(C("vec_id") / 32).alias("structure"), (C("vec_id") % 32).alias("id"),
        (F.abs(F.get("embedding", F.lit(0)).cast("double")) + 0.01).alias("msf"),
        ((C("label") + 1) * F.lit(0.1)).alias("y"))
    # every fifth structure has a target of another length
    target = e.filter(~((C("structure") % 5 == 0) & (C("id") == 31))).select("structure", "id", "y")
    fits, other = N.fit_network(e.select("structure", "id", "msf"), target)
    none = F.lit(None).cast("double")
    return fits.select("structure", *[r(C(c), 6).alias(c) for c in ("m", "k", "sim_k")],
                       F.lit(False).alias("mismatch")).unionByName(other.select(
                           "structure", none.alias("m"), none.alias("k"), none.alias("sim_k"),
                           F.lit(True).alias("mismatch")))
