"""Strand sequences and IUPAC search.

Letters are gathered in parts of fixed length, never a whole strand, so a strand that holds a
third of all monomers is many rows. Search runs on each part for every number of letters an
earlier match may already have used; one small fold per strand then picks the right variant.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from molframe.functions.nucleic import iupac_regex

PART = 1 << 18


def sequence_parts(mono: DataFrame, overlap: int = 0, part: int = PART) -> DataFrame:
    """strand, class, part, text, own (letters without the overlap into the next part)."""
    pos = F.col("pos")
    home = F.floor(pos / part)
    rows = mono.select("strand", "class", "pos", "base", home.alias("part"))
    if overlap:
        rows = rows.withColumn("part", F.explode(F.array_distinct(F.array(
            home, F.greatest(F.floor((pos - overlap) / part), F.lit(0))))))
    letters = F.array_sort(F.collect_list(F.struct("pos", "base")))
    return (rows.groupBy("strand", "part").agg(
        F.first("class").alias("class"), letters.alias("_l"),
        F.count_if(F.floor(pos / part) == F.col("part")).alias("own"))
        .select("strand", "class", "part", "own",
                F.array_join(F.transform("_l", lambda x: x["base"]), "").alias("text")))


def sequences(mono: DataFrame, part: int = PART) -> DataFrame:
    """Sequence 5' -> 3': strand, part, sequence. Only strands longer than ``part`` have part > 0."""
    return sequence_parts(mono, part=part).select("strand", "part", F.col("text").alias("sequence"))


def search(mono: DataFrame, terms: list[str], part: int = PART) -> DataFrame:
    """Leftmost non-overlapping matches of each term: term, strand, start, size.

    ``mono``: strand, class, pos, base. Terms are the caller's own short list.
    """
    terms = [t.strip().upper() for t in terms if t.strip()]
    longest = max(len(t) for t in terms)
    literal = F.array(*[F.struct(
        F.lit(t).alias("term"), F.lit(len(t)).alias("size"),
        F.lit(iupac_regex(t, "DNA")).alias("dna"), F.lit(iupac_regex(t, "RNA")).alias("rna"))
        for t in terms])
    probes = (sequence_parts(mono, longest - 1, part)
              .withColumn("t", F.explode(literal)).select("*", "t.*").drop("t")
              # letters of this part already used by a match that began before it
              .withColumn("entry", F.explode(F.sequence(
                  F.lit(0), F.when(F.col("part") == 0, 0).otherwise(F.col("size") - 1))))
              .withColumn("text", F.substring(
                  "text", F.col("entry") + 1,
                  (F.col("own") + F.col("size") - 1 - F.col("entry")).cast("int"))))
    pieces = F.split("text", F.when(F.col("class") == "RNA", F.col("rna"))
                     .otherwise(F.col("dna")), -1)
    gaps = probes.select("strand", "term", "size", "part", "own", "entry",
                         F.posexplode(F.transform(pieces, F.length)).alias("k", "gap"))
    w = W.partitionBy("strand", "term", "part", "entry").orderBy("k")
    hits = (gaps.withColumn("at", F.col("entry") + F.sum("gap").over(w) + F.col("k") * F.col("size"))
            # the last piece has no match after it
            .withColumn("last", F.lead("k").over(w).isNull()))
    used = F.when(~F.col("last"), F.col("at") + F.col("size")).otherwise(F.col("entry"))
    exits = (hits.groupBy("strand", "term", "part", "entry")
             .agg(F.greatest(F.max(used - F.col("own")), F.lit(0)).cast("bigint").alias("exit")))
    # Only strands of several parts need the fold; it holds one short array per part.
    maps = (exits.groupBy("strand", "term", "part")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))),
                             lambda x: x["exit"]).alias("m")))
    fold = maps.groupBy("strand", "term").agg(
        F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ms")).filter(F.size("ms") > 1)
    start = F.struct(F.array().cast("array<bigint>").alias("taken"),
                     F.lit(0).cast("bigint").alias("next"))
    taken = F.aggregate("ms", start, lambda acc, x: F.struct(
        F.concat(acc["taken"], F.array(acc["next"])).alias("taken"),
        F.get(x["m"], acc["next"].cast("int")).alias("next")))
    chosen = fold.select("strand", "term", F.posexplode(taken["taken"]).alias("part", "_entry"))
    return (hits.filter(~F.col("last")).join(chosen, ["strand", "term", "part"], "left")
            .filter(F.col("entry") == F.coalesce("_entry", F.lit(0)))
            .select("term", "strand", (F.col("part") * part + F.col("at")).alias("start"), "size"))


def members(mono: DataFrame, matches: DataFrame) -> DataFrame:
    """Monomers covered by matches: term, strand, start, id."""
    cells = matches.withColumn("pos", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("size") - 1)))
    return mono.select("strand", "pos", "id").join(cells, ["strand", "pos"]).select(
        "term", "strand", "start", "pos", "id")


def multi_search(mono: DataFrame, text: str) -> DataFrame:
    """Comma- or space-separated terms; a number selects the monomer of that id."""
    terms = [t for t in re.split(r"[,\s]+", text) if t]
    ids = [int(t) for t in terms if t.isdigit()]
    words = [t for t in terms if not t.isdigit()]
    out = mono.filter(F.col("id").isin(ids)).select(
        F.col("id").cast("string").alias("term"), "strand", F.col("pos").alias("start"), "pos", "id")
    if words:
        out = out.unionByName(members(mono, search(mono, words)))
    return out
