"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions import nucleic as N
from molframe.functions.geometry import flat, r, vec
from molframe.operators import projections as P
from molframe.registry.core import query, r4

C = F.col
# a2 = a1 x a3 in the oracle
A2 = ("(a1y*a3z - a1z*a3y)", "(a1z*a3x - a1x*a3z)", "(a1x*a3y - a1y*a3x)")


def xyz(exprs, prefix=""):
    return ", ".join(f"{r4(e)} AS {prefix}{a}" for e, a in zip(exprs, "xyz"))


BB_DNA = [f"{a} - (0.34*a1{a} + 0.3408*{A2[i]})" for i, a in enumerate("xyz")]
BB_RNA = [f"{a} - (0.4*a1{a} + 0.2*a3{a})" for a in "xyz"]
IS_RNA = "label >= 5"


def classed(spark, sf):
    return A.points(spark, sf).withColumn("class", F.when(C("label") >= 5, "RNA").otherwise("DNA"))


@query("prj_sites", f"""SELECT id, {xyz([f"CASE WHEN {IS_RNA} THEN {b} ELSE {a} END"
                                         for a, b in zip(BB_DNA, BB_RNA)], "bb_")},
    {xyz([f"{a} + 0.4*a1{a}" for a in "xyz"], "ns_")} FROM pts""")
def _(spark, sf):
    d = classed(spark, sf)
    return (d.withColumn("bb", N.backbone_site(C("class"), C("p"), C("a1"), C("a3")))
            .withColumn("ns", N.base_site(C("p"), C("a1")))
            .select("id", *flat(C("bb"), "bb_"), *flat(C("ns"), "ns_")))


@query("prj_site_dna", f"SELECT id, {xyz(BB_DNA)} FROM pts")
def _(spark, sf):
    d = A.points(spark, sf).withColumn("bb", N.backbone_dna(C("p"), C("a1"), C("a3")))
    return d.select("id", *flat(C("bb")))


@query("prj_site_rna", f"SELECT id, {xyz(BB_RNA)} FROM pts")
def _(spark, sf):
    d = A.points(spark, sf).withColumn("bb", N.backbone_rna(C("p"), C("a1"), C("a3")))
    return d.select("id", *flat(C("bb")))


AXIS = f"sqrt({' + '.join(f'{e}*{e}' for e in A2)})"


@query("prj_a2", f"SELECT id, {xyz([f'{e} / {AXIS}' for e in A2])} FROM pts")
def _(spark, sf):
    d = classed(spark, sf).withColumn(
        "bb", N.backbone_site(C("class"), C("p"), C("a1"), C("a3")))
    d = d.withColumn("a2", N.a2_from_sites(C("class"), C("p"), C("bb"), C("a1"), C("a3")))
    return d.select("id", *flat(C("a2")))


# a1 x (a1 x a3) turned back is the part of a3 at right angles to a1, for DNA; RNA gives a3 itself
DOT13 = "(a1x*a3x + a1y*a3y + a1z*a3z)"
PERP = [f"(a3{a} - {DOT13}*a1{a})" for a in "xyz"]
PERP_N = f"sqrt({' + '.join(f'{e}*{e}' for e in PERP)})"


@query("prj_a3", f"""SELECT id, {xyz([f"CASE WHEN {IS_RNA} THEN a3{a} ELSE {e} / {PERP_N} END"
                                      for a, e in zip("xyz", PERP)])} FROM pts""")
def _(spark, sf):
    d = classed(spark, sf).withColumn(
        "bb", N.backbone_site(C("class"), C("p"), C("a1"), C("a3")))
    d = d.withColumn("a2", N.a2_from_sites(C("class"), C("p"), C("bb"), C("a1"), C("a3")))
    d = d.withColumn("a3n", N.a3_from_sites(C("class"), C("p"), C("bb"), C("a1"), C("a2")))
    return d.select("id", *flat(C("a3n")))


@query("prj_type_number", """SELECT id, CAST(CASE WHEN id % 50 = 7 THEN 12 WHEN id % 50 = 8 THEN 3
    ELSE code END AS INT) AS type_number FROM mono""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    code = F.when(C("id") % 50 == 7, "12").when(C("id") % 50 == 8, "U").otherwise(C("base"))
    return m.select("id", N.type_number(code).alias("type_number"))


@query("prj_complement", """SELECT id, CASE WHEN class = 'RNA' THEN
    CASE base WHEN 'A' THEN 'U' WHEN 'T' THEN 'A' WHEN 'G' THEN 'C' ELSE 'G' END
    ELSE substr('TCGA', code + 1, 1) END AS complement FROM mono""")
def _(spark, sf):
    base = F.when(C("class") == "RNA", F.translate("base", "T", "U")).otherwise(C("base"))
    return A.monomers(spark, sf).select("id", N.complement(base, C("class")).alias("complement"))


@query("prj_reverse_complement", """SELECT p_partkey AS id, reverse(translate(regexp_replace(
    upper(p_name), '[^ATCGRYSWN]', '', 'g'), 'ATCGRYSWN', 'TAGCYRSWN')) AS rc FROM part""")
def _(spark, sf):
    return A.read(spark, sf, "part").select(
        C("p_partkey").alias("id"), N.reverse_complement(C("p_name")).alias("rc"))


IUPAC_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.IUPAC.items()) + "}"


@query("prj_iupac_match", f"""SELECT id, letter, base = letter OR contains(
    CASE WHEN class = 'RNA' THEN replace({IUPAC_SQL}[letter], 'T', 'U') ELSE {IUPAC_SQL}[letter] END,
    base) AS matches FROM (SELECT *, substr('RYMKSWHBVDN', CAST(id % 11 AS INT) + 1, 1) AS letter
    FROM mono)""")
def _(spark, sf):
    m = A.monomers(spark, sf).withColumn(
        "letter", F.substring(F.lit("RYMKSWHBVDN"), (C("id") % 11 + 1).cast("int"), F.lit(1)))
    return m.select("id", "letter", N.iupac_match(C("base"), C("letter"), C("class"))
                    .alias("matches"))


RESIDUES = list(N.AMINO) + list(N.NUCLEIC) + ["HOH", "XXX"]


@query("prj_residue_code", f"""SELECT id, residue, CASE residue {' '.join(
    f"WHEN '{k}' THEN '{v}'" for k, v in {**N.AMINO, **N.NUCLEIC}.items())} END AS letter
    FROM (SELECT p_partkey AS id, [{', '.join(f"'{x}'" for x in RESIDUES)}]
    [CAST(p_partkey % {len(RESIDUES)} AS INT) + 1] AS residue FROM part)""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in RESIDUES])
    part = A.read(spark, sf, "part").select(
        C("p_partkey").alias("id"),
        F.get(names, (C("p_partkey") % len(RESIDUES)).cast("int")).alias("residue"))
    return (part.join(F.broadcast(N.residue_codes(spark)), "residue", "left")
            .select("id", "residue", "letter"))


@query("prj_units", f"""SELECT id, unit, {r4("x / CASE unit WHEN 'nm' THEN 0.8518 WHEN 'pm' THEN 851.8 ELSE 8.518 END", 6)} AS sim,
    {r4("x * 0.8518", 6)} AS nm, {r4("x * 8.518", 6)} AS angstrom, {r4("x * 851.8")} AS pm
    FROM (SELECT *, ['A', 'nm', 'pm', 'in'][CAST(id % 4 AS INT) + 1] AS unit FROM pts)""")
def _(spark, sf):
    unit = F.get(F.array(*[F.lit(u) for u in ("A", "nm", "pm", "in")]), (C("id") % 4).cast("int"))
    d = A.points(spark, sf).withColumn("unit", unit)
    x = C("p.x")
    return d.select("id", "unit", r(N.to_sim(x, C("unit")), 6).alias("sim"),
                    r(x * N.NM, 6).alias("nm"), r(x * N.ANGSTROM, 6).alias("angstrom"),
                    r(x * N.PM).alias("pm"))


@query("prj_bfactor", f"""SELECT event_id AS id, {r4("value * 8 * pi() * pi() / 3", 3)} AS bfactor,
    {r4("value * 3 / (8 * pi() * pi())", 6)} AS msf FROM events""")
def _(spark, sf):
    return A.read(spark, sf, "events").select(
        C("event_id").alias("id"), r(N.msf_to_bfactor(C("value")), 3).alias("bfactor"),
        r(N.bfactor_to_msf(C("value")), 6).alias("msf"))


@query("prj_msf_units", f"""SELECT event_id AS id, {r4("value / 100", 6)} AS nm_sqr,
    {r4("value * 100", 3)} AS a_sqr FROM events""")
def _(spark, sf):
    return A.read(spark, sf, "events").select(
        C("event_id").alias("id"), r(C("value") / 100, 6).alias("nm_sqr"),
        r(C("value") * 100, 3).alias("a_sqr"))


@query("prj_colour_mode", """SELECT id, CAST((strand + strand % 3) % 11 AS BIGINT) AS by_strand,
    CAST(strand % 3 % 11 AS BIGINT) AS by_system,
    CAST(CASE WHEN cluster > 0 THEN cluster % 11 ELSE -1 END AS BIGINT) AS by_cluster,
    CASE WHEN id % 5 <> 0 THEN id % 512 END AS by_overlay,
    CAST(coalesce(color, CASE WHEN id % 5 <> 0 THEN id % 512 END) AS BIGINT) AS by_custom
    FROM mono""")
def _(spark, sf):
    m = (A.monomers(spark, sf).withColumn("system", C("strand") % 3)
         .withColumn("overlay", F.when(C("id") % 5 != 0, C("id") % 512)))
    return m.select("id", *[P.colour_key(k).cast("bigint").alias(f"by_{k}")
                            for k in ("strand", "system", "cluster", "overlay", "custom")])


@query("prj_colour_scale", """SELECT event_id AS id, CAST(least(floor((value - lo) / (hi - lo) * 512),
    511) AS BIGINT) AS step FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def _(spark, sf):
    return P.colour_scale(A.read(spark, sf, "events")).select(C("event_id").alias("id"), "step")


@query("prj_colour_bounds", """SELECT event_id AS id, CAST(least(floor((least(greatest(value, 5.0),
    40.0) - 5.0) / 35.0 * 512), 511) AS BIGINT) AS step FROM events""")
def _(spark, sf):
    return A.read(spark, sf, "events").select(
        C("event_id").alias("id"), P.colour_index(C("value"), F.lit(5.0), F.lit(40.0)).alias("step"))


def selected(spark, sf):
    return A.points(spark, sf).filter(C("label") == 3)


@query("prj_translate", f"""SELECT id, {xyz([f"{a} + CASE WHEN label = 3 THEN {d} ELSE 0 END"
                                             for a, d in zip("xyz", (1.5, -2.0, 0.25))])} FROM pts""")
def _(spark, sf):
    d = P.translate(A.points(spark, sf), selected(spark, sf), vec(1.5, -2.0, 0.25))
    return d.select("id", *flat(C("p")))


def turned(v, c=None):
    """Quarter turn and more about z in the oracle: angle 0.7."""
    x, y, z = [f"({v}{a} - {c}{a})" if c else f"{v}{a}" for a in "xyz"]
    back = [f" + {c}{a}" if c else "" for a in "xyz"]
    return [f"{x}*cos(0.7) - {y}*sin(0.7){back[0]}", f"{x}*sin(0.7) + {y}*cos(0.7){back[1]}",
            f"{z}{back[2]}"]


@query("prj_rotate", f"""SELECT id, {", ".join(
    f"{r4(f'CASE WHEN label = 3 THEN {t} ELSE {v}{a} END')} AS {n}{a}"
    for v, n, c in (("", "p_", "c"), ("a1", "a1_", None), ("a3", "a3_", None))
    for a, t in zip("xyz", turned(v, c)))}
    FROM pts, (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts WHERE label = 3)""")
def _(spark, sf):
    d = P.rotate_selection(A.points(spark, sf), selected(spark, sf), vec(0, 0, 1), 0.7)
    return d.select("id", *flat(C("p"), "p_"), *flat(C("a1"), "a1_"), *flat(C("a3"), "a3_"))


@query("prj_move_to", f"""SELECT id, {xyz([f"{a} + CASE WHEN label = 3 THEN {t} - f{a} ELSE 0 END"
                                           for a, t in zip("xyz", (1, 2, 3))])} FROM pts,
    (SELECT arg_min(x, id) AS fx, arg_min(y, id) AS fy, arg_min(z, id) AS fz FROM pts
    WHERE label = 3)""")
def _(spark, sf):
    sel = selected(spark, sf).select("id", C("id").alias("ord"))
    return P.move_to(A.points(spark, sf), sel, vec(1, 2, 3)).select("id", *flat(C("p")))


D12 = "sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z))"


@query("prj_force_vector", f"""SELECT a.id AS particle, {xyz([
    f"(b.{c}-a.{c}) / {D12} * ({D12} - 1.2) * 0.09" for c in "xyz"], "f_")},
    {xyz([f"a.{c} + (b.{c}-a.{c}) / {D12} * 1.2" for c in "xyz"], "eq_")}
    FROM pts a JOIN pts b ON b.id = a.id + 1""")
def _(spark, sf):
    sites = A.points(spark, sf).select("id", C("p").alias("bb"))
    traps = sites.select(C("id").alias("particle"), (C("id") + 1).alias("ref_particle"),
                         F.lit(0.09).alias("stiff"), F.lit(1.2).alias("r0"))
    return P.trap_vectors(traps, sites).select("particle", *flat(C("force"), "f_"),
                                               *flat(C("eq_point"), "eq_"))
