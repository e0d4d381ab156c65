"""Filters and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.planes import inside
from molframe.operators import filters as S, sequences as Q
from molframe.registry.core import query

C = F.col
OUT = ["id", "strand", "pos"]


@query("flt_by_ids", """WITH ids AS (SELECT DISTINCT l_orderkey * 7 AS id FROM lineitem)
    SELECT i.id, m.strand, m.id IS NULL AS missing FROM ids i LEFT JOIN mono m ON m.id = i.id""")
def _(spark, sf):
    ids = A.read(spark, sf, "lineitem").select((C("l_orderkey") * 7).alias("id"))
    found, missing = S.by_ids(A.monomers(spark, sf), ids)
    return found.select("id", "strand", F.lit(False).alias("missing")).unionByName(
        missing.select("id", F.lit(None).cast("bigint").alias("strand"),
                       F.lit(True).alias("missing")))


@query("flt_by_residue", """SELECT id, strand AS chain, pos AS residue FROM mono m
    WHERE class = 'peptide' AND (EXISTS (SELECT 1 FROM part p WHERE p_size % 2 = 0
    AND p_partkey % 500 = m.pos) OR EXISTS (SELECT 1 FROM part p WHERE p_size % 2 = 1
    AND p_partkey % 500 = m.pos AND p_partkey // 20 = m.strand))""")
def _(spark, sf):
    residues = S.by_class(A.monomers(spark, sf), "peptide").select(
        "id", C("strand").alias("chain"), C("pos").alias("residue"))
    wanted = A.read(spark, sf, "part").select(
        (C("p_partkey") % 500).alias("residue"),
        F.when(C("p_size") % 2 == 1, F.floor(C("p_partkey") / 20)).alias("chain")).distinct()
    return S.by_residue(residues, wanted).select("id", "chain", "residue")


@query("flt_ends", """SELECT id, strand, pos, 5 AS prime FROM mono WHERE n5 IS NULL
    UNION ALL SELECT id, strand, pos, 3 FROM mono WHERE n3 IS NULL""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    return (S.five_prime_ends(m).select(*OUT, F.lit(5).alias("prime"))
            .unionByName(S.three_prime_ends(m).select(*OUT, F.lit(3).alias("prime"))))


@query("flt_by_colour", """SELECT id, strand, pos, color FROM mono WHERE color IN (
    SELECT color FROM mono WHERE strand = 3 AND pos < 3)""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    picked = m.filter((C("strand") == 3) & (C("pos") < 3))
    return S.by_colour(m, picked).select(*OUT, "color")


@query("flt_id_range", """SELECT id, strand, pos FROM mono WHERE id >= (SELECT min(id) FROM mono
    WHERE strand = 2 AND color = 3) AND id < (SELECT max(id) FROM mono WHERE strand = 2
    AND color = 3)""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    return S.id_range(m, m.filter((C("strand") == 2) & (C("color") == 3))).select(*OUT)


@query("flt_strand_range", """SELECT m.id, m.strand, m.pos FROM mono m JOIN
    (SELECT strand, min(pos) AS lo, max(pos) AS hi FROM mono WHERE pos IN (40, 180)
    GROUP BY strand HAVING count(*) = 2) e ON e.strand = m.strand AND m.pos BETWEEN e.lo AND e.hi""")
def _(spark, sf):
    m, s = A.monomers(spark, sf), A.strands(spark, sf)
    ends = s.filter(C("len") > 180).select((C("first") + 180).alias("a"),
                                           (C("first") + 40).alias("b"))
    return S.strand_range(m, ends).select(*OUT)


@query("flt_invert", "SELECT id, strand, pos FROM mono WHERE color IS NULL OR color <> 2")
def _(spark, sf):
    m = A.monomers(spark, sf)
    return S.invert(m, m.filter(C("color") == 2)).select(*OUT)


PLANES = [(1, 0, 0, 0.2), (-1, 0, 0, 0.3), (0, 1, 0, 0.25), (0, -1, 0, 0.25), (0, 0, 1, 0.2),
          (0.5, 0, -1, 0.35)]


@query("flt_region", f"""SELECT id, strand, pos FROM pts WHERE {' AND '.join(
    f'x*({a}) + y*({b}) + z*({c}) + ({d}) >= 0' for a, b, c, d in PLANES)}""")
def _(spark, sf):
    return A.points(spark, sf).filter(inside(C("p"), PLANES)).select(*OUT)


@query("flt_by_strand_class", """SELECT id, strand, pos, class FROM mono
    WHERE class IN ('peptide', 'sphere')""")
def _(spark, sf):
    return S.by_class(A.monomers(spark, sf), "peptide", "sphere").select(*OUT, "class")


def search_sql(term, dna, rna):
    """Gaps between matches add up to their starts."""
    n = len(term)
    return f"""SELECT '{term}' AS term, strand, start FROM (
        SELECT strand, k, last, CAST(sum(gap) OVER (PARTITION BY strand ORDER BY k) + (k - 1) * {n}
        AS BIGINT) AS start FROM (SELECT strand, unnest(generate_series(1, len(ps))) AS k,
        unnest([length(x) FOR x IN ps]) AS gap, len(ps) AS last FROM (
        SELECT strand, CASE WHEN max(class) = 'RNA'
        THEN string_split_regex(string_agg(base, '' ORDER BY pos), '{rna}')
        ELSE string_split_regex(string_agg(base, '' ORDER BY pos), '{dna}') END AS ps
        FROM mono GROUP BY strand))) WHERE k < last"""


@query("flt_sequence", search_sql("AGCTW", "AGCT[AT]", "AGCT[AU]"))
def _(spark, sf):
    return Q.search(A.monomers(spark, sf), ["AGCTW"]).select("term", "strand", "start")


@query("flt_multi_sequence", f"""SELECT h.term, m.strand, m.id FROM ({search_sql(
    "AGCTW", "AGCT[AT]", "AGCT[AU]")} UNION ALL {search_sql("CCRG", "CC[AG]G", "CC[AG]G")}) h
    JOIN mono m ON m.strand = h.strand AND m.pos >= h.start AND m.pos < h.start + length(h.term)
    UNION ALL SELECT CAST(id AS VARCHAR), strand, id FROM mono WHERE id IN (17, 4000)""")
def _(spark, sf):
    return Q.multi_search(A.monomers(spark, sf), "agctw, CCRG 17,4000").select(
        "term", "strand", "id")


@query("flt_overstretched", """WITH b AS (SELECT a.id AS i, c.id AS j FROM mono a JOIN mono c
    ON c.id = a.n3 WHERE sqrt((a.px-c.px)*(a.px-c.px) + (a.py-c.py)*(a.py-c.py)
    + (a.pz-c.pz)*(a.pz-c.pz)) > 30) SELECT i AS id FROM b UNION SELECT j FROM b""")
def _(spark, sf):
    return S.overstretched(A.monomers(spark, sf).select("id", "n3", "p"), 30.0)


@query("flt_named_selection", """SELECT row_number() OVER (ORDER BY id) - 1 AS ord, id FROM mono
    WHERE color = 4""")
def _(spark, sf):
    # selections named by colour, kept in id order
    m = A.monomers(spark, sf)
    named = A.dense_index(m.select(C("id").alias("member"), F.concat(F.lit("colour "), "color")
                                   .alias("name")).dropna(), ["name"], ["member"], pos_col="ord")
    return S.named_selection(named.drop("id").withColumnRenamed("member", "id"),
                             "colour 4").select("ord", "id")
