"""Residue frames and chain classes from atom tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import cross, dot, norm, scale, sub, unit, vec

# Atom and residue names.
RING = ["C2", "C4", "C5", "C6", "N1", "N3"]
TRIPLES = [(i, j, k) for k in range(6) for j in range(k + 1, 6) for i in range(j + 1, 6)]
PYRIMIDINE_PAIRS = [("N3", "C6"), ("C2", "N1"), ("C4", "C5")]
PURINE_PAIRS = [("N1", "C4"), ("C2", "N3"), ("C6", "C5")]
PROTEIN_BACKBONE = ["N", "C", "O", "H", "CA"]
PROTEIN = ["ALA", "ARG", "ASN", "ASP", "CYS", "CYX", "GLN", "GLU", "GLY", "HIS", "HSD", "ILE",
           "MET", "LEU", "LYS", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "SEC", "PYL",
           "ASX", "GLX", "UNK"]
DNA = ["DG", "DT", "DA", "DC", "DU", "DI", "DN", "ADE", "THY", "GUA", "CYT"]
RNA = ["A", "C", "G", "I", "U", "TU", "N"]


def _total(vectors: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
    return F.aggregate(vectors, zero, lambda s, v: F.struct(
        *[(s[a] + v[a]).alias(a) for a in "xyz"]))


def nucleotide_frames(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Per residue: mean position, a1, a3, mean B. ``atoms``: by, letter, name, p, b.

    a3 sums the normals of all 20 triples of ring atoms on the C3' -> C5' side; a1 sums the
    differences of three facing atom pairs.
    """
    p = F.col("p")
    at = lambda *names: F.max(F.when(F.col("name").isin(*names), p))
    res = atoms.groupBy(*by).agg(
        F.max("letter").alias("letter"), F.avg("b").alias("b"),
        F.struct(*[F.avg(p[a]).alias(a) for a in "xyz"]).alias("p"),
        *[at(n).alias(n) for n in RING],
        at("C5'", "C5*").alias("_c5"), at("C3'", "C3*").alias("_c3"))
    res = res.filter(F.col("_c5").isNotNull() & F.col("_c3").isNotNull())
    res = res.withColumn("_along", sub(F.col("_c5"), F.col("_c3")))
    ring = F.array(*[F.col(n) for n in RING])
    triples = F.array(*[F.array(*[F.lit(i) for i in t]) for t in TRIPLES])
    pick = lambda t, i: F.get(F.col("_ring"), t[i])
    sides = F.transform(triples, lambda t: F.struct(
        unit(sub(pick(t, 0), pick(t, 1))).alias("v"), unit(sub(pick(t, 0), pick(t, 2))).alias("w")))
    usable = F.filter(F.col("_sides"), lambda s: F.abs(dot(s["v"], s["w"])) > 0.01)
    normals = F.transform(usable, lambda s: unit(cross(s["v"], s["w"])))
    turned = F.transform(F.col("_normals"), lambda n: scale(
        n, F.when(dot(n, F.col("_along")) < 0, -1.0).otherwise(1.0)))
    pyr = _total(F.array(*[sub(F.col(a), F.col(b)) for a, b in PYRIMIDINE_PAIRS]))
    pur = _total(F.array(*[sub(F.col(a), F.col(b)) for a, b in PURINE_PAIRS]))
    return (res.withColumn("_ring", ring).withColumn("_sides", sides)
            .withColumn("_normals", normals).withColumn("a3", _total(turned))
            .withColumn("a1", F.when(F.col("letter").isin("C", "T", "U"), pyr).otherwise(pur))
            .select(*by, "letter", "p", unit(F.col("a1")).alias("a1"),
                    unit(F.col("a3")).alias("a3"), "b"))


def protein_frames(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Per residue: CA position, a1 from the side chain, a3 = a1 x first axis not along it."""
    p = F.col("p")
    is_ca = F.col("name") == "CA"
    side = ~F.col("name").isin(*PROTEIN_BACKBONE)
    res = atoms.groupBy(*by).agg(
        F.max("letter").alias("letter"), F.max(F.when(is_ca, p)).alias("p"),
        F.coalesce(F.max(F.when(is_ca, F.col("b"))), F.lit(0.0)).alias("b"),
        F.struct(*[F.coalesce(F.sum(F.when(side, p[a])), F.lit(0.0)).alias(a) for a in "xyz"])
        .alias("_side")).filter(F.col("p").isNotNull())
    side_u = F.when(norm(F.col("_side")) == 0, vec(1, 0, 0)).otherwise(unit(F.col("_side")))
    res = res.withColumn("_u", side_u).withColumn("a1", unit(sub(F.col("_u"), F.col("p"))))
    a1 = F.col("a1")
    a3 = (F.when(a1["x"] < 0.99, cross(a1, vec(1, 0, 0)))
          .when(a1["y"] < 0.99, cross(a1, vec(0, 1, 0))).otherwise(cross(a1, vec(0, 0, 1))))
    return res.select(*by, "letter", "p", "a1", a3.alias("a3"), "b")


def chain_class(residues: DataFrame, by: list[str]) -> DataFrame:
    """pro / dna / rna / mixed per chain; where DNA and RNA meet, a U decides."""
    t = F.regexp_replace("residue", "[0-9]", "")
    r = residues.withColumn("_t", t)
    dna, pro, rna = (F.bool_or(F.col("_t").isin(*names)) for names in (DNA, PROTEIN, RNA))
    flags = r.groupBy(*by).agg(dna.alias("d"), pro.alias("p"), rna.alias("r"),
                               F.bool_or(F.col("_t").isin("U", "TU")).alias("u"))
    both = F.col("d") & F.col("r")
    d = F.when(both, ~F.col("u")).otherwise(F.col("d"))
    n = F.when(both, F.col("u")).otherwise(F.col("r"))
    return flags.select(*by, F.when(F.col("p") & (d | n), "mixed").when(F.col("p"), "pro")
                        .when(d, "dna").when(n, "rna").alias("class"))
