"""Topology files to monomer and strand tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from molframe.plans.ordered import dense_index
from molframe.session import materialise
from molframe.sinks.long_lines import BLOCK, RANGE, count_lines, read_pieces
from molframe.sources.lines import blocks, fields, read_lines, whole


def detect(spark: SparkSession, path: str) -> DataFrame:
    """file, dialect: 'new', 'old' or 'patchy' by header and line count."""
    per = count_lines(spark, path).filter("n > 0").withColumnRenamed("first", "header")
    h = fields(F.col("header"))
    first, second = whole(F.get(h, F.lit(0))), whole(F.get(h, F.lit(1)))
    return per.select("file", F.when(F.contains("header", F.lit("5->3")), "new")
                      .when(F.col("n") == first + 1, "old")
                      .when((F.col("n") == second + 1) | (F.col("n") == 2), "patchy")
                      .alias("dialect"))


def read_old(spark: SparkSession, path: str) -> DataFrame:
    """file, id, strand, base, n3, n5, connections, class, _corrupt (rows of fewer fields)."""
    rows = read_lines(spark, path).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    rna = rows.groupBy("file").agg(F.bool_or(F.contains("line", F.lit("U"))).alias("_rna"))
    f = F.col("f")
    ok = F.size(f) >= 4
    at = lambda i: whole(F.get(f, F.lit(i)))
    link = lambda i: F.when(ok & (at(i) >= 0), at(i))
    strand, base = F.when(ok, at(0)), F.when(ok, F.get(f, F.lit(1)))
    return rows.withColumn("f", fields(F.col("line"))).join(rna, "file").select(
        "file", (F.col("line_no") - 1).alias("id"), strand.alias("strand"), base.alias("base"),
        link(2).alias("n3"), link(3).alias("n5"),
        F.transform(F.slice(f, F.lit(5), F.size(f)), whole).alias("connections"),
        F.when(strand < 0, F.when(F.contains(base, F.lit("gs")), "sphere").otherwise("peptide"))
        .when(F.col("_rna"), "RNA").otherwise("DNA").alias("class"),
        F.when(~ok, F.col("line")).alias("_corrupt"))


def read_new(spark: SparkSession, path: str, size: int = RANGE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(strands: file, line_no, n, kw (map), type, circular; letters: file, line_no, at, text).

    Letters come in pieces that begin at place ``at`` of their strand. Lines start with their letters; what
    follows the first blank are keywords, a short text.
    """
    d = read_pieces(spark, path, size, block).filter("line_no > 0")
    key = ["file", "line_no"]
    # letters end at the first blank
    blank = F.instr("text", " ")
    ends = d.groupBy(*key).agg(F.coalesce(F.min(F.when(blank > 0, F.col("at") + blank - 1)),
                                          F.max(F.col("at") + F.length("text"))).alias("n")).filter("n > 0")
    d = materialise(d.join(ends, key), "new_topology")
    after = F.greatest(F.lit(0), F.col("n") - F.col("at")).cast("int")
    tails = d.filter(F.col("at") + F.length("text") > F.col("n")).groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.substring("text", after + 1, F.length("text")).alias("t")))),
        lambda x: x["t"]), "").alias("_tail"))
    flag = lambda v: F.when(F.lower(v).isin("true", "false"), F.lower(v)).otherwise(v)
    kw = F.expr("str_to_map(trim(_tail), '\\\\s+', '=')")
    strands = ends.join(tails, key, "left").withColumn("kw", F.transform_values(F.when(
        F.trim(F.coalesce("_tail", F.lit(""))) != "", kw).otherwise(
        F.create_map().cast("map<string,string>")), lambda k, v: flag(v))).select(
        *key, "n", "kw", F.coalesce(F.col("kw")["type"], F.lit("DNA")).alias("type"),
        (F.coalesce(F.col("kw")["circular"], F.lit("false")) == "true").alias("circular"))
    return strands, d.select(*key, "at", F.substring("text", F.lit(1), after).alias("text")).filter("text != ''")


def new_monomers(strands: DataFrame, letters: DataFrame) -> DataFrame:
    """Monomers of ``read_new``: file, line_no, pos, base, prev, next positions (wrapped if circular)."""
    one = letters.select("file", "line_no", "at", F.posexplode(F.split("text", "")).alias("k", "base")).filter(
        "base != ''").select("file", "line_no", (F.col("at") + F.col("k")).alias("pos"), "base")
    pos, last = F.col("pos"), F.col("n") - 1
    return one.join(strands.select("file", "line_no", "n", "type", "circular"), ["file", "line_no"]).select(
        "file", "line_no", "type", "pos", "base",
        F.when(pos < last, pos + 1).when(F.col("circular"), F.lit(0).cast("bigint")).alias("n3_pos"),
        F.when(pos > 0, pos - 1).when(F.col("circular"), last).alias("n5_pos"))


def read_patchy(spark: SparkSession, path: str, loro: bool = False) -> DataFrame:
    """Particles: file, id, species, sid (index inside the species), patch_spec."""
    rows = read_lines(spark, path).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    f = fields(F.col("line"))
    if not loro:
        cells = rows.filter(F.col("line_no") == 1).select("file", F.posexplode(f).alias("k", "t"))
        cells = cells.select("file", whole(F.col("t")).alias("species"),
                             F.col("k").cast("bigint").alias("k"),
                             F.lit(None).cast("string").alias("patch_spec"))
    else:
        cells = (rows.withColumn("f", f).filter(whole(F.get("f", F.lit(0))) > 0).select(
            "file", (F.col("line_no") - 1).alias("species"),
            F.explode(F.sequence(F.lit(1), whole(F.get("f", F.lit(0))))).alias("k"),
            F.get("f", F.lit(3)).alias("patch_spec")))
    # numbering inside each species, then over the file: species are consecutive for LORO files
    per = dense_index(cells, ["file", "species"], ["k"], pos_col="sid").drop("id", "len")
    order = ["species", "sid"] if loro else ["k"]
    return dense_index(per, ["file"], order, id_col="_g", pos_col="id").select(
        "file", "id", "species", "sid", "patch_spec")


def read_species(spark: SparkSession, particles: str, patches: str) -> tuple[DataFrame, DataFrame]:
    """(species: file, id, type, patches; patches: file, id, color, position, a1, a2).

    Both files are runs of ``name_N = { key = value ... }`` lines.
    """
    def keyed(path, name, keys):
        lines = read_lines(spark, path).withColumn("line", F.regexp_replace("line", " ", ""))
        mark = F.regexp_extract("line", rf"{name}_(\d+)", 1)
        b = blocks(lines.withColumn("_m", mark), ["file"], F.col("_m") != "")
        aggs = [F.max(whole(F.nullif(F.col("_m"), F.lit("")))).alias("id")]
        for k, pattern in keys.items():
            v = F.regexp_extract("line", rf"(?:^|[^a-z_]){k}=({pattern})", 1)
            aggs.append(F.max(F.when(v != "", v)).alias(k))
        return b.filter(F.col("block") > 0).groupBy("file", "block").agg(*aggs).drop("block")

    array = r"[,\d.\-+e]+"
    numbers = lambda c: F.transform(F.split(c, ","), lambda v: v.try_cast("double"))
    s = keyed(particles, "particle", {"type": r"-?\d+", "patches": array})
    species = s.select("file", "id", whole(F.col("type")).alias("type"), F.transform(
        F.filter(F.split("patches", ","), lambda v: v != ""), whole).alias("patches"))
    p = keyed(patches, "patch", {"color": r"-?\d+", "position": array, "a1": array, "a2": array})
    return species, p.select("file", "id", whole(F.col("color")).alias("color"),
                             *[numbers(F.col(k)).alias(k) for k in ("position", "a1", "a2")])


def species_patches(species: DataFrame, patches: DataFrame) -> DataFrame:
    """One row per (species, patch): file, species, type, ord, patch, color, position, a1, a2."""
    listed = species.select("file", F.col("id").alias("species"), "type",
                            F.posexplode("patches").alias("ord", "patch"))
    return listed.join(patches.withColumnRenamed("id", "patch"), ["file", "patch"], "left")
