"""Sinks: the lines each export would write."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import dist, vec
from molframe.registry.core import query
from molframe.sinks import structures as X

C = F.col


@query("snk_renumber", """SELECT structure, id, old_new, new_new, new_strand FROM newid""")
def _(spark, sf):
    e = A.exported(spark, sf)
    old = X.renumber(e, False).withColumnRenamed("new_id", "old_new")
    new = X.renumber(e, True).select("structure", "id", C("new_id").alias("new_new"))
    return old.join(new, ["structure", "id"])


TOP_OLD = """SELECT structure AS file, 0 AS line_no, head AS line FROM heads UNION ALL
    SELECT e.structure, n.old_new + 1, n.new_strand || ' ' || CASE WHEN e.class = 'sphere'
    THEN 'gs' || (dense_rank() OVER (PARTITION BY e.structure, e.class ORDER BY e.code) - 1)
    ELSE e.base END || ' ' || coalesce(n3.old_new, -1) || ' ' || coalesce(n5.old_new, -1) || CASE
    WHEN e.class = 'peptide' AND e.n3 IS NOT NULL THEN ' ' || n3.old_new ELSE '' END || CASE
    WHEN e.class = 'peptide' AND e.pos < e.len - 5 THEN ' ' || (n.old_new + 5) ELSE '' END
    FROM expo e JOIN newid n ON n.id = e.id LEFT JOIN newid n3 ON n3.id = e.n3
    LEFT JOIN newid n5 ON n5.id = e.n5"""


@query("snk_topology_old", TOP_OLD)
def _(spark, sf):
    return X.topology_old(A.exported(spark, sf))


def keyword_data(spark, sf):
    """A label for every odd strand; default keys must not be repeated."""
    s = A.strands(spark, sf)
    return s.filter(C("strand") % 2 == 1).select("structure", "strand", F.create_map(
        F.lit("label"), F.concat(F.lit("s"), "strand"), F.lit("type"), F.lit("DNA")).alias("kw"))


#: Letters or ids of a part in the queries, so that long lines have several.
WIDTH = 64

TOP_NEW = f"""SELECT structure AS file, 0 AS line_no, 0 AS part, head || ' 5->3' AS text, true AS last FROM heads
    UNION ALL SELECT s.structure, s.ord + 1, q.part, q.seq || CASE WHEN q.last THEN ' id=' || s.new_strand ||
    ' type=' || CASE q.class WHEN 'sphere' THEN 'generic' ELSE q.class END || ' circular=false' ||
    CASE WHEN s.strand % 2 = 1 THEN ' label=s' || s.strand ELSE '' END ELSE '' END, q.last
    FROM snum s JOIN (SELECT strand, pos // {WIDTH} AS part, max(class) AS class, string_agg(base, '' ORDER BY pos)
    AS seq, max(pos) = max(len) - 1 AS last FROM expo GROUP BY strand, pos // {WIDTH}) q ON q.strand = s.strand"""


@query("snk_topology_new", TOP_NEW)
def _(spark, sf):
    return X.topology_new(A.exported(spark, sf), keyword_data(spark, sf), WIDTH)


@query("snk_configuration", """WITH n AS (SELECT e.structure, n.new_new, regexp_replace(
    regexp_replace(printf('%.6f', px), '0+$', ''), '\\.$', '') || ' ' || CAST(py AS BIGINT) || ' '
    || CAST(pz AS BIGINT) || ' ' || CAST(ax AS BIGINT) || ' ' || CAST(ay AS BIGINT)
    || ' 0 0 0 1 0 0 0 0 0 0' AS line FROM expo e JOIN newid n ON n.id = e.id),
    b AS (SELECT structure, CAST(ceil(3 * max(greatest(px, py, pz))) AS BIGINT) AS b FROM expo
    GROUP BY structure)
    SELECT structure AS file, 0 AS line_no, 't = 0' AS line FROM b UNION ALL
    SELECT structure, 1, 'b = ' || b || ' ' || b || ' ' || b FROM b UNION ALL
    SELECT structure, 2, 'E = 0 0 0' FROM b UNION ALL SELECT structure, new_new + 3, line FROM n""")
def _(spark, sf):
    return X.configuration(A.exported(spark, sf))


def bonds(spark, sf):
    """Backbone springs of peptides; every fifth carries extra parameters."""
    e = A.exported(spark, sf).filter(C("class") == "peptide")
    other = e.select(C("id").alias("n3"), C("p").alias("q"))
    return e.join(other, "n3").select(
        "structure", C("id").alias("p1"), C("n3").alias("p2"),
        F.abs(C("p.y") - C("q.y")).alias("eq_dist"), F.lit("s").alias("type"),
        F.lit(2.5).alias("k"), F.when(C("pos") % 5 == 0, F.array(F.lit("1.3"), F.lit("1.4")))
        .otherwise(F.array().cast("array<string>")).alias("extra"))


PAR = """SELECT structure AS file, 0 AS line_no, CAST(sum(len) FILTER (class IN ('peptide',
    'sphere')) AS VARCHAR) AS line FROM strands GROUP BY structure UNION ALL
    SELECT a.structure, row_number() OVER (PARTITION BY a.structure ORDER BY i.new_new),
    i.new_new || ' ' || j.new_new || ' ' || CAST(abs(a.py - b.py) AS BIGINT) || ' s 2.5' || CASE
    WHEN a.pos % 5 = 0 THEN ' 1.3 1.4' ELSE '' END FROM expo a JOIN expo b ON b.id = a.n3
    JOIN newid i ON i.id = a.id JOIN newid j ON j.id = a.n3 WHERE a.class = 'peptide'"""


@query("snk_edges_par", PAR)
def _(spark, sf):
    return X.edges_par(A.exported(spark, sf), bonds(spark, sf))


MASSES = """WITH d AS (SELECT DISTINCT structure, code FROM mono WHERE class = 'sphere'),
    s AS (SELECT structure, code, dense_rank() OVER (PARTITION BY structure ORDER BY code) - 1 AS k
    FROM d) SELECT structure AS file, 0 AS line_no, CAST(max(k) + 27 AS VARCHAR) AS line FROM s
    GROUP BY structure UNION ALL SELECT structure, i + 1, i || ' 1 1' FROM (SELECT DISTINCT
    structure FROM s), range(27) t(i) UNION ALL SELECT structure, k + 28, (k + 27) || ' ' ||
    (code + 1) || ' ' || CASE code % 2 WHEN 0 THEN (code // 2) || '.5' ELSE
    CAST((code + 1) // 2 AS VARCHAR) END FROM s"""


@query("snk_masses", MASSES)
def _(spark, sf):
    return X.masses(A.exported(spark, sf))


@query("snk_sequences_csv", f"""WITH e AS (SELECT * REPLACE
    (CASE WHEN pos = 0 AND strand % 3 = 0 THEN NULL WHEN strand % 6 = 0 THEN NULL ELSE color * 70000
    END AS color) FROM expo), s AS (SELECT structure, strand, count(*) AS n, max(color) FILTER (pos = 0) AS c5,
    max(color) FILTER (pos = len - 1) AS c3 FROM e GROUP BY 1, 2),
    p AS (SELECT strand, pos // {WIDTH} AS part, string_agg(base, '' ORDER BY pos) AS seq,
    max(pos) = max(len) - 1 AS last FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY strand) AS line_no FROM s)
    SELECT DISTINCT structure AS file, 0 AS line_no, 0 AS part, 'name, seq, len, RGB' AS text, true AS last FROM s
    UNION ALL SELECT structure, line_no, part, CASE WHEN part > 0 THEN '' WHEN r.strand % 4 = 1 THEN 's' || r.strand
    || ',' ELSE 'strand_' || r.strand || ',' END || seq || CASE WHEN last THEN ',' || n || ',' ||
    coalesce((coalesce(c5, c3) >> 16) || '/' || ((coalesce(c5, c3) >> 8) & 255) || '/' ||
    (coalesce(c5, c3) & 255), ' ') ELSE '' END, last FROM r JOIN p ON p.strand = r.strand""")
def _(spark, sf):
    hidden = ((C("pos") == 0) & (C("strand") % 3 == 0)) | (C("strand") % 6 == 0)
    e = A.exported(spark, sf).withColumn("color", F.when(~hidden, C("color") * 70000))
    labels = A.strands(spark, sf).filter(C("strand") % 4 == 1).select(
        "strand", F.concat(F.lit("s"), "strand").alias("label"))
    return X.sequences_csv(e, labels=labels, part=WIDTH)


def trap_table(spark, sf):
    m = A.monomers(spark, sf).filter(C("bp").isNotNull())
    return m.select("structure", C("id").alias("ord"), F.lit("mutual_trap").alias("type"),
                    C("id").alias("particle"), C("bp").alias("ref_particle"),
                    F.lit(0.09).alias("stiff"), F.lit(1.2).alias("r0"), F.lit(1).alias("pbc"))


@query("snk_design_json", """WITH t AS (SELECT * FROM mono WHERE class <> 'sphere'),
    s AS (SELECT structure, strand, max(class) AS class, min(id) AS e5, max(id) AS e3,
    strand < max(strand) OVER (PARTITION BY structure) AS more FROM t GROUP BY structure, strand),
    f AS (SELECT structure, id, bp, id < max(id) OVER (PARTITION BY structure) AS more FROM mono
    WHERE bp IS NOT NULL), l(file, k1, k2, k3, line) AS (
    SELECT DISTINCT structure, -1::BIGINT, 0, 0::BIGINT,
    '{"box":[100.0,100.0,100.0],"systems":[{"id":0,"strands":[' FROM t UNION ALL
    SELECT structure, strand, 0, 0, '{"id":' || strand || ',"class":"' || CASE class WHEN 'peptide'
    THEN 'Peptide' ELSE 'NucleicAcidStrand' END || '","end3":' || e3 || ',"end5":' || e5 || ',"monomers":['
    FROM s UNION ALL
    SELECT structure, strand, 1, pos, '{"id":' || id || ',"type":"' || base || '","class":"' || class ||
    '","p":[' || px || ',' || py || ',' || pz || '],"a1":[' || ax || ',' || ay || ',0.0],"a3":[0.0,0.0,1.0]' ||
    coalesce(',"n3":' || n3, '') || coalesce(',"n5":' || n5, '') || coalesce(',"bp":' || bp, '') ||
    coalesce(',"cluster":' || cluster, '') || coalesce(',"color":' || color, '') || '}' ||
    CASE WHEN pos < len - 1 THEN ',' ELSE '' END FROM t UNION ALL
    SELECT structure, strand, 2, 0, ']}' || CASE WHEN more THEN ',' ELSE '' END FROM s UNION ALL
    SELECT DISTINCT structure, 1::BIGINT << 60, 0, 0, ']}],"forces":[' FROM t UNION ALL
    SELECT structure, 1::BIGINT << 60, 1, id, '{"type":"mutual_trap","particle":"' || id || '","ref_particle":' || bp ||
    ',"stiff":0.09,"r0":1.2,"PBC":1}' || CASE WHEN more THEN ',' ELSE '' END FROM f UNION ALL
    SELECT DISTINCT structure, 1::BIGINT << 60, 2, 0, '],"selections":[]}' FROM t)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY k1, k2, k3) - 1 AS line_no, line FROM l""")
def _(spark, sf):
    m = A.monomers(spark, sf).filter(C("class") != "sphere")
    return X.design_json(m, 100.0, trap_json(spark, sf))


def trap_json(spark, sf):
    return trap_table(spark, sf).select("structure", "ord", F.to_json(F.struct(
        "type", C("particle").cast("string").alias("particle"), "ref_particle", "stiff", "r0",
        C("pbc").alias("PBC"))).alias("json"))


@query("snk_unf_json", """SELECT structure AS file, count(*) FILTER (class <> 'peptide') AS n_nt,
    count(*) FILTER (class = 'peptide') AS n_aa, count(*) FILTER (cluster > 0) AS grouped,
    count(DISTINCT strand) FILTER (len > 1000) AS scaffolds FROM mono WHERE class <> 'sphere'
    GROUP BY structure""")
def _(spark, sf):
    # counted line by line; src_unf_json reads the whole document back
    l = X.unf_json(A.monomers(spark, sf), 100.0)
    has = lambda text: F.contains("line", F.lit(text))
    return l.groupBy("file").agg(
        F.count_if(has('"nbAbbrev":')).alias("n_nt"), F.count_if(has('"aaAbbrev":')).alias("n_aa"),
        F.count_if(C("line").rlike(r"^,?\d+$")).alias("grouped"),
        F.count_if(has('"isScaffold":true')).alias("scaffolds"))


@query("snk_forces", """WITH t AS (SELECT m.structure, m.id AS ord, n.new_new AS a, b.new_new AS b
    FROM mono m JOIN newid n ON n.id = m.id JOIN newid b ON b.id = m.bp)
    SELECT structure AS file, ord * 8 + k AS line_no, CASE k WHEN 0 THEN '{'
    WHEN 1 THEN '    type = mutual_trap' WHEN 2 THEN '    particle = ' || a
    WHEN 3 THEN '    ref_particle = ' || b WHEN 4 THEN '    stiff = 0.09' WHEN 5 THEN '    r0 = 1.2'
    WHEN 6 THEN '    PBC = 1' ELSE '}' END AS line FROM t, range(8) r(k)""")
def _(spark, sf):
    return X.forces_text(A.monomers(spark, sf), trap_table(spark, sf))[0]


@query("snk_index_groups", f"""WITH m AS (SELECT structure, strand, id, row_number() OVER (PARTITION BY strand
    ORDER BY id) - 1 AS k, dense_rank() OVER (PARTITION BY structure ORDER BY strand) - 1 AS line_no, len FROM mono)
    SELECT structure AS file, line_no, strand AS grp, k // {WIDTH} AS part, CASE WHEN k // {WIDTH} > 0 THEN ' ' ELSE ''
    END || string_agg(id, ' ' ORDER BY id) AS text, max(k) = max(len) - 1 AS last FROM m
    GROUP BY structure, line_no, strand, k // {WIDTH}""")
def _(spark, sf):
    return X.index_groups(A.monomers(spark, sf).select("structure", C("strand").alias("grp"), "id"), WIDTH)


FLUX = """SELECT particle % 4 AS f, CAST(row_number() OVER (PARTITION BY particle % 4
    ORDER BY particle, frame) AS BIGINT) AS x, y FROM coords"""


def flux_series(spark, sf):
    c = A.coords(spark, sf).withColumn("file", F.concat(F.lit("p"), C("particle") % 4))
    d = A.dense_index(c.drop("len"), ["file"], ["particle", "frame"], "_g", "_i")
    return d.select("file", (C("_i") + 1).alias("x"), (C("p.y") * C("p.y")).alias("msf"))


@query("snk_fluctuations", f"""WITH s AS ({FLUX}), t AS (SELECT f, max(x) AS top FROM s GROUP BY f)
    SELECT 'p' || f AS file, x AS line_no, CAST(y AS VARCHAR) || CASE WHEN x < top THEN ',' ELSE ''
    END AS line FROM s JOIN t USING (f) UNION ALL SELECT 'p' || f, 0, '{{"RMSF (nm)": [' FROM t
    UNION ALL SELECT 'p' || f, top + 1, ']}}' FROM t""")
def _(spark, sf):
    return X.fluctuations(flux_series(spark, sf))


__all__ = ["bonds", "flux_series", "keyword_data", "dist", "vec"]
