"""Forces, spring networks, hydrogen bonds, masses, id lists, sequences, brackets, parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from molframe.operators.residues import PROTEIN
from molframe.plans.ordered import dense_index, parts_for, running
from molframe.sinks.long_lines import BLOCK, RANGE, read_pieces
from molframe.sources.lines import blocks, fields, number, read_lines, whole

FORCE_TYPES = ["mutual_trap", "skew_trap", "repulsion_plane", "attraction_plane"]


def read_forces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forces, rejects): file, block, type, kw (map of the other keys); numbers by ``force_value``."""
    lines = read_lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    # a block starts at {; several blocks on one line are split first
    pieces = lines.select("file", "line_no", F.posexplode(F.split("line", "(?=\\{)")).alias("k", "line"))
    # tasks by lines, so that none sorts or groups more of them in a larger file
    parts = parts_for(spark, spark.read.text(path).count())
    b = blocks(dense_index(pieces.filter(F.col("line") != ""), ["file"], ["line_no", "k"], "_g",
                           "_pos", parts=parts).drop("line_no").withColumnRenamed("_pos", "line_no"),
               ["file"], F.contains("line", F.lit("{")), parts=parts)
    pair = F.split(F.regexp_replace("line", "[{}]", ""), "=", 2)
    kv = (b.select("file", "block", F.trim(F.get(pair, F.lit(0))).alias("key"),
                   F.trim(F.get(pair, F.lit(1))).alias("value"))
          .filter((F.col("key") != "") & F.col("value").isNotNull()))
    rest = F.map_from_entries(F.array_sort(F.collect_set(F.when(
        F.col("key") != "type", F.struct("key", "value")))))
    forces = kv.repartition(parts, "file", "block").groupBy("file", "block").agg(
        F.max(F.when(F.col("key") == "type", F.col("value"))).alias("type"), rest.alias("kw"))
    known = F.coalesce(F.col("type").isin(*FORCE_TYPES), F.lit(False))
    return forces.filter(known), forces.filter(~known)


def typed_forces(forces: DataFrame) -> DataFrame:
    """file, block, type, particle, particles, ref_particle, stiff, r0, stdev, pbc, position, dir."""
    kw = F.col("kw")
    num = lambda k: kw[k].try_cast("double")
    numbers = lambda k, t: F.when(kw[k].isNotNull(), F.transform(
        F.split(kw[k], r"\s*,\s*"), lambda v: v.try_cast(t)))
    return forces.select("file", "block", "type", kw["particle"].try_cast("bigint").alias("particle"),
                         numbers("particle", "bigint").alias("particles"),
                         kw["ref_particle"].try_cast("bigint").alias("ref_particle"),
                         num("stiff").alias("stiff"), num("r0").alias("r0"),
                         num("stdev").alias("stdev"), kw["PBC"].try_cast("int").alias("pbc"),
                         num("position").alias("position"), numbers("dir", "double").alias("dir"))


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects): file, p, q, eq_dist, type, k, extra."""
    rows = read_lines(spark, path).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    f = F.col("f")
    at = lambda i: F.get(f, F.lit(i))
    d = rows.withColumn("f", fields(F.col("line"))).select(
        "file", "line_no", "line", whole(at(0)).alias("p"), whole(at(1)).alias("q"),
        number(at(2)).alias("eq_dist"), at(3).alias("type"), number(at(4)).alias("k"),
        F.slice(f, F.lit(6), F.size(f)).alias("extra"))
    ok = (F.col("p").isNotNull() & F.col("q").isNotNull() & F.col("eq_dist").isNotNull()
          & F.col("k").isNotNull())
    return d.filter(ok).drop("line"), d.filter(~ok).select("file", "line_no", "line")


def read_hbonds(spark: SparkSession, path: str) -> DataFrame:
    """file, chain1, res1, chain2, res2 from both report layouts."""
    f = F.col("f")
    at = lambda i: F.get(f, F.lit(i))
    dotted = lambda i, j: F.get(F.split(at(i), r"\."), F.lit(j))
    res = lambda c: F.coalesce(c.isin(*PROTEIN), F.lit(False))
    rows = read_lines(spark, path).withColumn("f", fields(F.col("line")))
    first = res(at(0)) & res(at(3))
    second = ~res(at(0)) & res(at(1)) & res(at(5))
    d = rows.filter(first | second)
    pick = lambda a, b: F.when(first, a).otherwise(b)
    return d.select("file", pick(dotted(1, 1), dotted(0, 1)).alias("chain1"),
                    whole(pick(dotted(1, 0), at(2))).alias("res1"),
                    pick(dotted(4, 1), dotted(4, 1)).alias("chain2"),
                    whole(pick(dotted(4, 0), at(6))).alias("res2"))


def read_masses(spark: SparkSession, path: str) -> DataFrame:
    """file, subtype (from 0), mass, radius; nothing for files whose header is 27 or less."""
    lines = read_lines(spark, path).withColumn("f", fields(F.col("line")))
    usable = lines.filter((F.col("line_no") == 0) & (whole(F.get("f", F.lit(0))) > 27)).select("file")
    p = whole(F.get("f", F.lit(0)))
    return (lines.filter((F.col("line_no") > 0) & (p > 26)).join(usable, "file", "left_semi")
            .select("file", (p - 27).alias("subtype"),
                    number(F.get("f", F.lit(1))).cast("bigint").alias("mass"),
                    number(F.get("f", F.lit(2))).alias("radius")))


def apply_masses(spheres: DataFrame, masses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spheres with mass and radius, spheres of a subtype that the file lacks)."""
    s = spheres.withColumn("subtype", F.expr("try_cast(substring(base, 3) AS bigint)"))
    keys = ["file", "subtype"]
    return s.join(masses, keys), s.join(masses, keys, "left_anti")


def read_ids(spark: SparkSession, path: str, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """file, id from space-separated ids, also in lines of any length.

    A piece of a line may begin or end inside an id: its first and last ids are put together with those of
    the pieces around it.
    """
    d = read_pieces(spark, path, size, block)
    ids = F.split("text", r"\s")
    inner = d.select("file", F.explode(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0)))).alias("t"))
    # what stands at the borders of a piece: its last id begins before the first one of the next piece
    head = F.struct((2 * F.col("at")).alias("o"), F.get(ids, F.lit(0)).alias("t"), (F.col("at") == 0).alias("begins"))
    tail = F.struct((2 * (F.col("at") + F.length("text")) - 1).alias("o"), F.element_at(ids, -1).alias("t"), F.lit(True).alias("begins"))
    edge = d.select("file", "line_no", F.explode(F.when(F.size(ids) > 1, F.array(head, tail)).otherwise(
        F.array(head))).alias("e")).select("file", "line_no", "e.*")
    order = dense_index(edge, ["file"], ["line_no", "o"], "_g", "_k", "_m")
    joined = running(order, ["file"], "_k", sums={"_id": F.col("begins").cast("bigint")}).groupBy("file", "_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "t"))), lambda x: x["t"]), "").alias("t"))
    return inner.unionByName(joined.select("file", "t")).select("file", whole(F.col("t")).alias("id")).filter(
        F.col("id").isNotNull())


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, sequence: design CSV (third field) or one per line; ? becomes N."""
    lines = read_lines(spark, path)
    csv = lines.filter((F.col("line_no") == 0) & F.col("line").startswith(
        "Start,End,Sequence,Length,Color")).select("file", F.lit(True).alias("_csv"))
    d = lines.join(csv, "file", "left").filter(
        (F.col("line") != "") & ~(F.coalesce("_csv", F.lit(False)) & (F.col("line_no") == 0)))
    seq = F.when(F.col("_csv"), F.get(F.split("line", ","), F.lit(2))).otherwise(F.col("line"))
    return d.select("file", "line_no",
                    F.trim(F.upper(F.translate(seq, "?", "N"))).alias("sequence"))


# Bracket kinds.
OPEN, CLOSE = "([{", ")]}"


#: Characters of notations that are matched at a time.
MATCHED = 1 << 22


def bracket_partners(notation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, errors) of dot-bracket notations (id, notation).

    positions: id, pos, partner (NULL when unpaired or never closed). Errors: id, pos of a close
    without an open or of an unknown character; such notations give no positions. Depth is a
    running sum per bracket kind; opener and closer of one depth alternate, so the n-th opener
    meets the n-th closer. A notation is one value, so it is matched where it lies and nothing is shuffled.
    """
    own = notation.schema["id"].dataType
    shape = StructType([StructField("id", own), StructField("pos", IntegerType()), StructField("partner", IntegerType()),
                        StructField("error", BooleanType())])
    arrow = pa.schema([("pos", pa.int32()), ("partner", pa.int32()), ("error", pa.bool_())])

    def matched(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
            group = np.cumsum(sizes) // MATCHED
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                row, *columns = _partners([texts[i] or "" for i in at], sizes[at])
                for k in range(0, len(row), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[row[part]])), *[
                        pa.array(c[part], f.type, mask=m[part] if m is not None else None)
                        for (c, m), f in zip(columns, arrow)]], names=shape.names)
    found = notation.select("id", "notation").mapInArrow(matched, shape)
    return (found.filter("NOT error").select("id", "pos", "partner"), found.filter("error").select("id", "pos"))


def _partners(texts: list[str], sizes: np.ndarray) -> tuple:
    """Row of ``texts``, and (values, mask) of pos, partner and error: all positions of rows without an error, and
    the errors of the others."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    error, partner = code != ord("."), np.full(len(code), -1)
    for o, c in zip(OPEN, CLOSE):
        at = np.flatnonzero((code == ord(o)) | (code == ord(c)))
        error[at] = False
        if not len(at):
            continue
        step, r = np.where(code[at] == ord(o), 1, -1), row[at]
        total, first = np.cumsum(step), np.r_[True, r[1:] != r[:-1]]
        # depth begins anew in each row
        level = total - (total - step)[first][np.cumsum(first) - 1] + (step < 0)
        error[at] = (step < 0) & (level < 1)
        order = np.lexsort((at, level, r))
        a, b = order[:-1], order[1:]
        pair = (r[a] == r[b]) & (level[a] == level[b]) & (step[a] > 0) & (step[b] < 0)
        a, b = at[a[pair]], at[b[pair]]
        partner[a], partner[b] = pos[b], pos[a]
    bad = np.zeros(len(sizes), dtype=bool)
    bad[row[error]] = True
    use = np.flatnonzero(error | ~bad[row])
    return row[use], (pos[use], None), (partner[use], partner[use] < 0), (error[use], None)


def read_order_params_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with header, in long form: file, name, frame, value."""
    lines = read_lines(spark, path).filter(F.trim("line") != "")
    head = lines.filter(F.col("line_no") == 0).select(
        "file", F.posexplode(F.split(F.trim("line"), "\t")).alias("col", "name"))
    body = lines.filter(F.col("line_no") > 0).select(
        "file", (F.col("line_no") - 1).alias("frame"),
        F.posexplode(F.split("line", "\t")).alias("col", "v"))
    return body.join(head, ["file", "col"]).select("file", "name", "frame",
                                                   number(F.col("v")).alias("value"))


def read_cluster_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members: file, cluster, id; traps: file, particle, ref_particle, stiff, r0).

    Groups look like ``[a b -> (c d) -> (e)]``: every id left of an arrow is a source, ids in
    brackets are its targets.
    """
    lines = read_lines(spark, path)
    groups = lines.select("file", "line_no", F.posexplode(
        F.regexp_extract_all("line", F.lit(r"\[([^\]]*)\]"), 1)).alias("k", "g"))
    g = dense_index(groups, ["file"], ["line_no", "k"], "_g", "_pos").select(
        "file", (F.col("_pos") + 1).alias("cluster"), "g")
    arrows = g.select("file", "cluster", F.explode(F.regexp_extract_all(
        "g", F.lit(r"(\d+\s*->\s*\([^)]*\))"), 1)).alias("a"))
    t = arrows.select("file", "cluster", whole(F.regexp_extract("a", r"^(\d+)", 1)).alias("particle"),
                      F.explode(F.regexp_extract_all(F.regexp_extract("a", r"\((.*)\)", 1),
                                                     F.lit(r"(\d+)"), 1)).alias("r"))
    t = t.withColumn("ref_particle", whole(F.col("r")))
    members = t.select("file", "cluster", F.explode(F.array("particle", "ref_particle"))
                       .alias("id")).distinct()
    return members, t.select("file", "particle", "ref_particle", F.lit(0.09).alias("stiff"),
                             F.lit(1.2).alias("r0"))
