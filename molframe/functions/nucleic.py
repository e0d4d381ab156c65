"""Bases, residues, sites and units as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from molframe.functions.geometry import add, cross, dot, scale, sub, unit

# One simulation unit in other lengths, site offsets, IUPAC letters, residue codes.
NM, ANGSTROM, PM = 0.8518, 8.518, 851.8
SITE = 0.4
DNA_BACKBONE_A1, DNA_BACKBONE_A2 = 0.34, 0.3408
RNA_BACKBONE_A1, RNA_BACKBONE_A3 = 0.4, 0.2
IUPAC = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT",
         "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
AMINO = {"LYS": "K", "CYS": "C", "CYX": "C", "ALA": "A", "THR": "T", "GLU": "E", "GLN": "Q",
         "SER": "S", "ASP": "D", "ASN": "N", "HIS": "H", "HSD": "H", "GLY": "G", "PRO": "P",
         "ARG": "R", "VAL": "V", "ILE": "I", "LEU": "L", "MET": "M", "PHE": "F", "TYR": "Y",
         "TRP": "W"}
NUCLEIC = {"DC": "C", "DC3": "C", "DC5": "C", "DG": "G", "DG3": "G", "DG5": "G", "DT": "T",
           "DT3": "T", "DT5": "T", "T": "T", "T3": "T", "T5": "T", "DA": "A", "DA3": "A",
           "DA5": "A", "U": "U", "U3": "U", "U5": "U", "A": "A", "A3": "A", "A5": "A", "G": "G",
           "G3": "G", "G5": "G", "C": "C", "C3": "C", "C5": "C", "ADE": "A", "THY": "T",
           "CYT": "C", "GUA": "G"}
MSF_TO_B = 8 * math.pi ** 2 / 3


def base_site(p: Column, a1: Column) -> Column:
    return add(p, scale(a1, SITE))


def backbone_dna(p: Column, a1: Column, a3: Column) -> Column:
    return sub(p, add(scale(a1, DNA_BACKBONE_A1), scale(cross(a1, a3), DNA_BACKBONE_A2)))


def backbone_rna(p: Column, a1: Column, a3: Column) -> Column:
    return sub(p, add(scale(a1, RNA_BACKBONE_A1), scale(a3, RNA_BACKBONE_A3)))


def backbone_site(cls: Column, p: Column, a1: Column, a3: Column) -> Column:
    return (F.when(cls == "DNA", backbone_dna(p, a1, a3))
            .when(cls == "RNA", backbone_rna(p, a1, a3)).otherwise(p))


def a2_from_sites(cls: Column, p: Column, bb: Column, a1: Column, a3: Column) -> Column:
    """DNA: from the backbone site; RNA: a1 x a3."""
    dna = scale(add(sub(bb, p), scale(a1, DNA_BACKBONE_A1)), -1 / DNA_BACKBONE_A2)
    return unit(F.when(cls == "RNA", cross(a1, a3)).otherwise(dna))


def a3_from_sites(cls: Column, p: Column, bb: Column, a1: Column, a2: Column) -> Column:
    """DNA: a1 x a2 turned back; RNA: from the backbone site."""
    dna = scale(cross(a1, a2), -1.0 / dot(a1, a1))
    rna = scale(add(sub(bb, p), scale(a1, RNA_BACKBONE_A1)), -1 / RNA_BACKBONE_A3)
    return unit(F.when(cls == "RNA", rna).otherwise(dna))


def type_number(base: Column) -> Column:
    return (F.when(base == "A", 0).when(base == "G", 1).when(base == "C", 2)
            .when(base.isin("T", "U"), 3).otherwise(base.try_cast("int")))


def complement(base: Column, cls: Column) -> Column:
    return (F.when(cls == "RNA", F.translate(base, "AUGC", "UACG"))
            .otherwise(F.translate(base, "ATGC", "TACG")))


def reverse_complement(seq: Column) -> Column:
    kept = F.regexp_replace(F.upper(seq), "[^ATCGRYSWN]", "")
    return F.reverse(F.translate(kept, "ATCGRYSWN", "TAGCYRSWN"))


def iupac_class(letter: str, cls: str = "DNA") -> str:
    """Regex class of one IUPAC letter; a letter also stands for itself."""
    options = IUPAC.get(letter, "")
    if cls == "RNA":
        options = options.replace("T", "U")
    return f"[{letter}{options}]"


def iupac_regex(term: str, cls: str = "DNA") -> str:
    return "".join(iupac_class(c, cls) for c in term)


def iupac_match(base: Column, letter: Column, cls: Column) -> Column:
    def table(rna: bool):
        return F.create_map(*[x for k, v in IUPAC.items() for x in (
            F.lit(k), F.array(*[F.lit("U" if rna and c == "T" else c) for c in v]))])
    options = F.when(cls == "RNA", table(True)[letter]).otherwise(table(False)[letter])
    return F.coalesce((base == letter) | F.array_contains(options, base), base == letter)


def residue_codes(spark: SparkSession) -> DataFrame:
    """Three-letter residue -> one letter, kind protein / nucleic: a fixed table of about 60 rows."""
    rows = [(k, v, "protein") for k, v in AMINO.items()] + [(k, v, "nucleic")
                                                            for k, v in NUCLEIC.items()]
    return spark.createDataFrame(rows, "residue string, letter string, kind string")


def to_sim(x: Column, unit_name: Column) -> Column:
    """Length in A, nm or pm to simulation units; an unknown unit counts as Angstrom."""
    return x / F.when(unit_name == "nm", NM).when(unit_name == "pm", PM).otherwise(ANGSTROM)


def msf_to_bfactor(x: Column) -> Column:
    return x * MSF_TO_B


def bfactor_to_msf(x: Column) -> Column:
    return x / MSF_TO_B
