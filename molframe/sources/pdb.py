"""PDB files to atom, section and disulphide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from molframe.functions.geometry import vec
from molframe.functions.nucleic import ANGSTROM
from molframe.plans.ordered import dense_index, neighbours, running
from molframe.sources.lines import read_lines


def _cut(start: int, end: int):
    """Columns [start, end) of a line, counted from 0."""
    return F.substring("line", start + 1, end - start)


def _text(start: int, end: int):
    return F.trim(_cut(start, end))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms: file, line_no, serial, name, alt_loc, residue_type, chain, residue, chain_idx,
    residue_idx, p (simulation units), b.

    The chain id is one letter, or two when the second is not a digit; a digit or minus sign
    there belongs to the residue number. A chain starts where the id changes, or where residue
    numbers jump while the file has only one chain id. Chains without id are numbered.
    """
    a = read_lines(spark, path).filter(F.col("line").startswith("ATOM"))
    c1, c2 = _text(21, 22), _text(22, 23)
    digit, minus = c2.rlike("^[0-9]$"), c2 == "-"
    chain = F.when(digit | minus | (c2 == ""), c1).otherwise(F.concat(c1, c2))
    tail = F.regexp_replace(_cut(23, 28), " ", "")
    ident = F.concat(F.when(minus, "-").when(digit | (c1 == ""), c2).otherwise(""), tail)
    num = lambda s, e: _text(s, e).try_cast("double")
    d = a.select("file", "line_no", _text(6, 11).alias("serial"), _text(12, 16).alias("name"),
                 _text(16, 17).alias("alt_loc"), _text(17, 20).alias("residue_type"),
                 F.when(c1 == "", "").otherwise(chain).alias("chain"), ident.alias("residue"),
                 vec(*[num(30 + 8 * i, 38 + 8 * i) / ANGSTROM for i in range(3)]).alias("p"),
                 F.coalesce(num(60, 66), F.lit(0.0)).alias("b"))
    ids = d.groupBy("file").agg((F.min("chain") == F.max("chain")).alias("_single"))
    d = dense_index(d, ["file"], ["line_no"], "_g", "_pos").join(ids, "file")
    number = F.regexp_extract("residue", r"^-?\d+", 0).try_cast("bigint")
    d = neighbours(d.withColumn("_num", number), ["file"], "_pos", {
        "_chain": (F.col("chain"), -1), "_res": (F.col("residue"), -1), "_prev": (F.col("_num"), -1)})
    jump = F.coalesce(F.abs(F.col("_num") - F.col("_prev")) > 1, F.lit(False))
    starts = F.col("_chain").isNull() | (F.col("_chain") != F.col("chain")) | (
        jump & F.col("_single"))
    d = running(d.withColumn("_new", starts), ["file"], "_pos", sums={
        "chain_idx": F.when(F.col("_new"), 1).otherwise(0),
        "residue_idx": F.when(F.col("_new") | (F.col("_res") != F.col("residue")), 1).otherwise(0)})
    return d.select("file", "line_no", "serial", "name", "alt_loc", "residue_type",
                    F.when(F.col("chain") == "", F.col("chain_idx").cast("string"))
                    .otherwise(F.col("chain")).alias("chain"), "residue",
                    (F.col("chain_idx") - 1).alias("chain_idx"),
                    (F.col("residue_idx") - 1).alias("residue_idx"), "p", "b")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Chain sections: file, section, chain, start_line, end_line, is_copy.

    A TER or END line that follows atoms closes a section, unless one closed within the last
    three lines. With models, a chain id seen before marks a copy.
    """
    lines = read_lines(spark, path)
    atom = F.col("line").startswith("ATOM")
    end = (F.col("line").startswith("TER") | F.col("line").startswith("END")) & ~F.col(
        "line").startswith("ENDMDL")
    marks = lines.filter(atom | end).select("file", "line_no", atom.alias("atom"),
                                            F.when(atom, _text(21, 22)).alias("chain"))
    d = dense_index(marks, ["file"], ["line_no"], "_g", "_pos")
    d = neighbours(d, ["file"], "_pos", {"_after_atom": (F.col("atom"), -1),
                                         "_chain": (F.col("chain"), -1)})
    ends = d.filter(~F.col("atom") & F.col("_after_atom")).select(
        "file", F.col("line_no").alias("end_line"), F.col("_chain").alias("chain"))
    ends = dense_index(ends, ["file"], ["end_line"], "_g", "k")
    ends = neighbours(ends, ["file"], "k", {"_last": (F.col("end_line"), -1)})
    ends = ends.filter(F.col("_last").isNull() | (F.col("end_line") - F.col("_last") > 3))
    ends = dense_index(ends.select("file", "end_line", "chain"), ["file"], ["end_line"], "_g",
                       "section")
    first = marks.filter("atom").groupBy("file").agg(F.min("line_no").alias("_from"))
    models = lines.groupBy("file").agg(F.bool_or(F.col("line").startswith("ENDMDL")).alias("_mdl"))
    seen = ends.groupBy("file", "chain").agg(F.min("section").alias("_seen"))
    ends = neighbours(ends, ["file"], "section", {"_start": (F.col("end_line"), -1)})
    return (ends.join(seen, ["file", "chain"]).join(first, "file").join(models, "file")
            .select("file", "section", "chain", F.coalesce("_start", "_from").alias("start_line"),
                    "end_line", (F.col("_mdl") & (F.col("_seen") < F.col("section")))
                    .alias("is_copy")))


def read_disulphides(spark: SparkSession, path: str) -> DataFrame:
    """SSBOND rows: file, chain1, res1, chain2, res2."""
    b = read_lines(spark, path).filter(F.col("line").startswith("SSBOND"))
    return b.select("file", _text(15, 17).alias("chain1"),
                    _text(17, 21).try_cast("bigint").alias("res1"), _text(29, 31).alias("chain2"),
                    _text(31, 35).try_cast("bigint").alias("res2"))
