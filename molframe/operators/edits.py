"""Batch edits: an edit table applied to many strands at once gives new monomer tables.

``mono``: id, strand, pos (5' -> 3'), n3, n5, bp, base, class and, where needed, p, a1, a3.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import add, cross, dot, mean, rotate, scale, sub, unit, vec
from molframe.functions.nucleic import backbone_site, complement
from molframe.plans.graph import rank, spread_nulls
from molframe.plans.ordered import dense_index, few_or_merged, neighbours, running
from molframe.session import materialise

# Fixed values of ideal helices: turn per step (radians), rise per step, distances.
DNA_TURN, DNA_RISE, DNA_CENTRE = 35.9 * math.pi / 180, 0.3897628551303122, 0.6
RNA_TURN, RNA_RISE, RNA_FUDGE = 32.7 * math.pi / 180, 0.3287, 0.4
START_FRAMES = [("DNA", (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, -1.0)),
                ("RNA", (0.0, 0.0, 0.0), (0.0, 0.9636304532086232, -0.2672383760782569),
                 (0.0, -0.2672383760782569, -0.9636304532086232))]
RNA_TILT, RNA_CHORD, RNA_DIAMETER = -15.5 * math.pi / 180, 2.0, 2.35


def split_strands(mono: DataFrame, starts: Column, order: str = "pos") -> DataFrame:
    """Renumber strands that break where ``starts`` holds (in ``order``): strand, pos, piece.

    The first piece keeps the strand id; later ones get fresh ids above the largest.
    """
    d = dense_index(mono.drop("len").withColumn("_new", starts), ["strand"], [order], "_g", "_k").drop("_g")
    d = d.withColumn("_new", F.col("_new") | (F.col("_k") == 0))
    d = running(d, ["strand"], "_k", sums={"_piece": F.when(F.col("_new"), 1).otherwise(0)},
                lasts={"_at": F.when(F.col("_new"), F.col("_k"))})
    later = d.filter(F.col("_piece") > 1).select("strand", "_piece").distinct()
    fresh = dense_index(later, [], ["strand", "_piece"], "_g", "_n").select("strand", "_piece", "_n")
    # from the stored rows, not by another run of what made ``mono``
    top = d.agg(F.max("strand").alias("m")).scalar()
    out = d.join(fresh, ["strand", "_piece"], "left")
    return out.withColumns({
        "piece": F.col("_piece") - 1, "pos": F.col("_k") - F.col("_at"),
        "strand": F.coalesce(top + 1 + F.col("_n"), F.col("strand"))}).drop(
        "_new", "_k", "_piece", "_at", "_n", "len")


def _opened(mono: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``_order``: pos, or for a circular strand the position after its first cut.

    ``cuts``: id of the monomers whose 3' link goes.
    """
    s = mono.groupBy("strand").agg(F.bool_and(F.col("n3").isNotNull()).alias("_circ"),
                                   F.count(F.lit(1)).alias("_len"))
    at = mono.join(cuts.select("id").distinct(), "id", "left_semi").groupBy("strand").agg(
        F.min("pos").alias("_cut"))
    d = mono.join(few_or_merged(materialise(s.join(at, "strand", "left"), "opened")), "strand")
    turned = F.pmod(F.col("pos") - F.col("_cut") - 1, F.col("_len"))
    return d.withColumn("_order", F.when(F.col("_circ") & F.col("_cut").isNotNull(), turned)
                        .otherwise(F.col("pos"))).drop("_circ", "_len", "_cut")


def nick(mono: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut after each monomer of ``cuts`` (id): a circle opens, a linear strand splits."""
    c = cuts.select("id").distinct()
    d = _opened(mono, c).join(c.withColumn("_cut3", F.lit(True)), "id", "left")
    d = d.join(c.select(F.col("id").alias("n5"), F.lit(True).alias("_cut5")), "n5", "left")
    cut3, cut5 = (F.coalesce(x, F.lit(False)) for x in ("_cut3", "_cut5"))
    d = d.withColumns({"n3": F.when(~cut3, F.col("n3")), "n5": F.when(~cut5, F.col("n5"))}).drop(
        "_cut3", "_cut5")
    return split_strands(d, F.col("n5").isNull(), "_order").drop("_order")


def ligate(mono: DataFrame, joints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(monomers, rejected joints): join an open 3' end ``a`` to an open 5' end ``b`` each.

    Joined strands take the id of the strand that leads the chain; a strand joined to itself
    becomes circular. Joints of ends that are not open, or used twice, are rejected.
    """
    a = mono.select(F.col("id").alias("a"), F.col("strand").alias("_sa"), F.col("n3").alias("_n3"))
    b = mono.select(F.col("id").alias("b"), F.col("strand").alias("_sb"), F.col("n5").alias("_n5"))
    j = joints.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    uses = lambda c, n: joints.groupBy(c).agg(F.count(F.lit(1)).alias(n))
    j = j.join(uses("a", "_ua"), "a").join(uses("b", "_ub"), "b")
    ok = (F.col("_sa").isNotNull() & F.col("_sb").isNotNull() & F.col("_n3").isNull()
          & F.col("_n5").isNull() & (F.col("_ua") == 1) & (F.col("_ub") == 1))
    good = j.filter(ok)
    d = (mono.join(good.select(F.col("a").alias("id"), F.col("b").alias("_to")), "id", "left")
         .join(good.select(F.col("b").alias("id"), F.col("a").alias("_from")), "id", "left")
         .withColumns({"n3": F.coalesce("n3", "_to"), "n5": F.coalesce("n5", "_from")})
         .drop("_to", "_from", "len"))
    sizes = mono.groupBy("strand").agg(F.count(F.lit(1)).alias("_n"))
    link = good.select(F.col("_sb").alias("id"), F.col("_sa").alias("n5"))
    chain = rank(sizes.select(F.col("strand").alias("id")).join(link, "id", "left"))
    order = sizes.join(chain.select(F.col("id").alias("strand"), "head", F.col("pos").alias("_r")),
                       "strand")
    order = running(order, ["head"], "_r", sums={"_end": F.col("_n")}).select(
        "strand", "head", (F.col("_end") - F.col("_n")).alias("_before"))
    out = d.join(order, "strand").withColumns({
        "strand": F.col("head"), "pos": F.col("_before") + F.col("pos")}).drop("head", "_before")
    return out, j.filter(~ok).select("a", "b")


def _unlinked(d: DataFrame, gone: DataFrame, links: list[str]) -> DataFrame:
    """``d`` without the ids of ``gone``, and null in ``links`` that lead to them.

    Links are looked up as (id, link) alone, so whole rows are shuffled once, by id.
    """
    refs = d.select("id", F.posexplode(F.array(*links)).alias("_which", "_key")).filter("_key IS NOT NULL")
    lost = refs.join(gone.select(F.col("id").alias("_key")), "_key", "left_semi").groupBy("id").agg(
        *[F.max(F.col("_which") == i).alias(f"_lost_{c}") for i, c in enumerate(links)])
    d = d.join(gone, "id", "left_anti").join(lost, "id", "left")
    return d.withColumns({c: F.when(~F.coalesce(f"_lost_{c}", F.lit(False)), F.col(c)) for c in links}).drop(
        *[f"_lost_{c}" for c in links])


def delete(mono: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove monomers; strands split around them, links and pairs to them go."""
    g = gone.select("id").distinct()
    d = _unlinked(_opened(mono, g), g, ["n3", "n5", "bp"])
    return split_strands(d, F.col("n5").isNull(), "_order").drop("_order")


def skip(mono: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove monomers and join their neighbours; strands keep their ids."""
    g = gone.select("id").distinct()
    s = mono.groupBy("strand").agg(F.bool_and(F.col("n3").isNotNull()).alias("_circ"))
    d = mono.drop("len").join(g, "id", "left_anti").withColumnRenamed("pos", "_old")
    d = dense_index(d, ["strand"], ["_old"], "_g", "pos").drop("_g", "_old")
    ends = d.groupBy("strand").agg(F.min_by("id", "pos").alias("_first"),
                                   F.max_by("id", "pos").alias("_last"))
    d = neighbours(d, ["strand"], "pos", {"_n3": (F.col("id"), 1), "_n5": (F.col("id"), -1)})
    d = d.join(s, "strand").join(ends, "strand")
    d = d.withColumns({"n3": F.coalesce("_n3", F.when(F.col("_circ"), F.col("_first"))),
                       "n5": F.coalesce("_n5", F.when(F.col("_circ"), F.col("_last")))})
    lost = g.select(F.col("id").alias("_key"), F.lit(True).alias("_lost"))
    d = d.withColumn("_key", spread_nulls("bp", "id")).join(lost, "_key", "left").withColumn(
        "bp", F.when(F.col("_lost").isNull(), F.col("bp")))
    return d.drop("_key", "_n3", "_n5", "_circ", "_first", "_last", "_lost", "len")


def _letters(table: DataFrame) -> DataFrame:
    """One row per letter of ``sequence``: k from 0, n, letter."""
    return (table.withColumn("n", F.length("sequence"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumn("letter", F.substring("sequence", F.col("k") + 1, F.lit(1))).drop("sequence"))


def insert(mono: DataFrame, inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(monomers, refused inserts) of sequences put after a monomer (id, sequence).

    New backbone sites lie evenly on the gap; a strand end refuses. New monomers get fresh ids.
    """
    site = backbone_site(F.col("class"), F.col("p"), F.col("a1"), F.col("a3"))
    at = inserts.join(mono.select("id", "strand", "pos", "class", "n3", "a1", "a3", site.alias("_b")),
                      "id", "left")
    refused = at.filter(F.col("n3").isNull()).select("id", "sequence")
    after = mono.select(F.col("id").alias("n3"), site.alias("_e"))
    new = _letters(at.join(after, "n3"))
    new = dense_index(new.withColumnRenamed("n", "_n"), [], ["id", "k"], "_g", "_new").drop("_g")
    share = (F.col("k") + 1) / (F.col("_n") + 1)
    to = add(F.col("_b"), scale(sub(F.col("_e"), F.col("_b")), share))
    # the centre follows from the backbone site and the axes of the monomer before
    off = backbone_site(F.col("class"), vec(0, 0, 0), F.col("a1"), F.col("a3"))
    top = mono.agg(F.max("id").alias("m")).scalar()
    added = new.withColumn("_to", to).withColumn("_off", off).select(
        "strand", "pos", (F.col("k") + 1).alias("_sub"), (top + 1 + F.col("_new")).alias("id"),
        "class", F.col("letter").alias("base"), F.lit(None).cast("bigint").alias("bp"),
        sub(F.col("_to"), F.col("_off")).alias("p"), "a1", "a3")
    keep = ["strand", "pos", "id", "class", "base", "bp", "p", "a1", "a3"]
    s = mono.groupBy("strand").agg(F.bool_and(F.col("n3").isNotNull()).alias("_circ"))
    d = mono.select(*keep).withColumn("_sub", F.lit(0)).unionByName(added)
    d = dense_index(d.withColumnRenamed("pos", "_old").withColumnRenamed("id", "member"),
                    ["strand"], ["_old", "_sub"], "_g", "pos").drop("_g", "_old", "_sub")
    d = d.withColumnRenamed("member", "id").drop("len")
    ends = d.groupBy("strand").agg(F.min_by("id", "pos").alias("_first"),
                                   F.max_by("id", "pos").alias("_last"))
    d = neighbours(d, ["strand"], "pos", {"n3": (F.col("id"), 1), "n5": (F.col("id"), -1)})
    d = d.join(s, "strand").join(ends, "strand").withColumns({
        "n3": F.coalesce("n3", F.when(F.col("_circ"), F.col("_first"))),
        "n5": F.coalesce("n5", F.when(F.col("_circ"), F.col("_last")))})
    return d.drop("_circ", "_first", "_last"), refused


def set_sequence(mono: DataFrame, selection: DataFrame, letters: DataFrame,
                 with_pairs: bool = False) -> DataFrame:
    """Write letters over a selection, strands by descending id, 5' -> 3'; the shorter wins.

    ``selection``: id; ``letters``: ord (from 0), letter. With ``with_pairs`` the pairs take the
    complements.
    """
    s = mono.join(selection.select("id"), "id", "left_semi").select(
        (-F.col("strand")).alias("_s"), "pos", F.col("id").alias("member"), "bp", "class")
    s = dense_index(s, [], ["_s", "pos"], "_g", "ord").join(letters, "ord")
    new = s.select(F.col("member").alias("id"), "letter", F.lit(0).alias("_by"), "ord")
    if with_pairs:
        new = new.unionByName(s.filter(F.col("bp").isNotNull()).select(
            F.col("bp").alias("id"), complement(F.col("letter"), F.col("class")).alias("letter"),
            F.lit(1).alias("_by"), "ord"))
    # the last write counts: order of the selection, own letter before the pair's complement
    new = new.groupBy("id").agg(F.max_by("letter", F.struct("ord", "_by")).alias("_l"))
    return (mono.join(new, "id", "left").withColumn("base", F.coalesce("_l", "base")).drop("_l"))


def dna_steps(starts: DataFrame) -> DataFrame:
    """Ideal DNA steps from open ends: adds p, a1, a3 and the complement's q, b1, b3 per letter.

    ``starts``: key columns, p, a1, a3, towards ('n3' / 'n5'), sequence. The k-th turn and rise
    are closed forms, so every step is a row of its own.
    """
    d = _letters(starts.withColumns({"_p": F.col("p"), "_a1": F.col("a1"), "_dir": unit(F.col("a3"))}))
    sign = F.when(F.col("towards") == "n3", -1.0).otherwise(1.0)
    d = d.withColumn("_t", (F.col("k") + 1) * sign)
    d = d.withColumn("_x", rotate(F.col("_a1"), F.col("_dir"), F.col("_t") * DNA_TURN))
    centre = add(add(F.col("_p"), scale(F.col("_a1"), DNA_CENTRE)),
                 scale(F.col("_dir"), F.col("_t") * DNA_RISE))
    d = d.withColumn("_c", centre)
    x, c = F.col("_x"), F.col("_c")
    return d.withColumns({
        "p": sub(c, scale(x, DNA_CENTRE)), "a1": x, "a3": F.col("_dir"),
        "q": add(c, scale(x, DNA_CENTRE)), "b1": scale(x, -1.0), "b3": scale(F.col("_dir"), -1.0)
    }).drop("_p", "_a1", "_dir", "_t", "_x", "_c")


def rna_steps(starts: DataFrame) -> DataFrame:
    """Ideal RNA steps (A-form): same columns as ``dna_steps``.

    Works in the frame of the helix: ``_h_u`` along its axis, ``_h_e`` along the level part of the bond
    between the two bases, ``_h_r`` radial towards the bond's middle. The middles lie on a screw
    line, the bond turns with them at a constant lean, and both bases sit on it at equal distances
    from the middle; so each step follows from k alone. The axis lies in the plane of a1 and a3.
    """
    lean, rise = math.cos(RNA_TILT), math.sin(RNA_TILT)
    radius = math.sqrt((RNA_DIAMETER / 2) ** 2 - (RNA_CHORD / 2 * lean) ** 2)
    level = lambda v, along: unit(sub(v, scale(along, dot(v, along))))
    col = F.col

    d = starts.withColumns({"_h_way": F.when(col("towards") == "n3", 1.0).otherwise(-1.0),
                            "_h_p": col("p"), "_h_a1": col("a1"), "_h_t": unit(col("a3"))})
    d = d.withColumn("_h_u", scale(sub(scale(level(col("_h_a1"), col("_h_t")), rise), scale(col("_h_t"), lean)),
                                 col("_h_way")))
    d = d.withColumn("_h_e", scale(level(col("_h_a1"), col("_h_u")), col("_h_way")))
    d = d.withColumn("_h_r", cross(col("_h_e"), col("_h_u")))
    bond = lambda e: scale(add(scale(e, lean), scale(col("_h_u"), rise)), col("_h_way"))
    # the screw line's start, less the radial part that every step adds again
    d = d.withColumn("_h_o", sub(add(sub(col("_h_p"), scale(col("_h_a1"), RNA_FUDGE)),
                                   scale(bond(col("_h_e")), RNA_CHORD / 2)), scale(col("_h_r"), radius)))

    d = _letters(d).withColumn("_h_n", col("k") + 1)
    c, w = F.cos(col("_h_n") * RNA_TURN), F.sin(col("_h_n") * RNA_TURN)
    d = d.withColumns({"_h_ek": sub(scale(col("_h_e"), c), scale(col("_h_r"), w)),
                       "_h_rk": add(scale(col("_h_r"), c), scale(col("_h_e"), w))})
    d = d.withColumns({
        "_h_m": add(add(col("_h_o"), scale(col("_h_rk"), radius)), scale(col("_h_u"), col("_h_n") * RNA_RISE)),
        "_h_b": bond(col("_h_ek")),
        "_h_y": scale(sub(scale(col("_h_ek"), rise), scale(col("_h_u"), lean)), col("_h_way"))})
    half = scale(col("_h_b"), RNA_CHORD / 2 - RNA_FUDGE)
    return d.withColumns({
        "p": sub(col("_h_m"), half), "a1": col("_h_b"), "a3": col("_h_y"),
        "q": add(col("_h_m"), half), "b1": scale(col("_h_b"), -1.0), "b3": scale(col("_h_y"), -1.0)}).drop(
        *[c for c in d.columns if c.startswith("_h_")])


def _steps(starts: DataFrame) -> DataFrame:
    dna = dna_steps(starts.filter(F.col("class") != "RNA"))
    return dna.unionByName(rna_steps(starts.filter(F.col("class") == "RNA")))


def open_ends(mono: DataFrame, extensions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts with ``towards``: the 3' side if open, else the 5' side; refused extensions)."""
    e = extensions.join(mono.select("id", "strand", "pos", "class", "n3", "n5", "bp", "p", "a1",
                                    "a3"), "id", "left")
    e = e.withColumn("towards", F.when(F.col("class").isNull(), None)
                     .when(F.col("n3").isNull(), "n3").when(F.col("n5").isNull(), "n5"))
    return (e.filter(F.col("towards").isNotNull()),
            e.filter(F.col("towards").isNull()).select("id", "sequence"))


def extend_strand(mono: DataFrame, extensions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new monomers, refused): grow open ends (id, sequence) along the ideal helix.

    New monomers: end, k, id, strand, pos (after or before the end), base, class, n3, n5, p, a1,
    a3. The end's own link is its first new monomer.
    """
    starts, refused = open_ends(mono, extensions)
    s = _steps(starts.select(F.col("id").alias("end"), "strand", F.col("pos").alias("_at"), "class",
                             "towards", "p", "a1", "a3", "sequence"))
    return _grown(mono, s), refused


def _grown(mono: DataFrame, steps: DataFrame) -> DataFrame:
    top = mono.agg(F.max("id").alias("m")).scalar()
    d = dense_index(steps, [], ["end", "k"], "_g", "_i").drop("_g")
    d = d.withColumn("id", top + 1 + F.col("_i"))
    before = F.when(F.col("k") == 0, F.col("end")).otherwise(F.col("id") - 1)
    after = F.when(F.col("k") < F.col("n") - 1, F.col("id") + 1)
    n3 = F.col("towards") == "n3"
    return d.withColumns({
        "n5": F.when(n3, before).otherwise(after), "n3": F.when(n3, after).otherwise(before),
        "pos": F.when(n3, F.col("_at") + F.col("k") + 1).otherwise(F.col("_at") - F.col("k") - 1),
        "base": F.col("letter")}).drop("_i", "_at", "letter")


def create_pair(mono: DataFrame, chosen: DataFrame) -> DataFrame:
    """Complement monomers for unpaired ones: id, strand (fresh), base, class, bp, p, a1, a3."""
    m = mono.join(chosen.select("id").distinct(), "id", "left_semi").filter(F.col("bp").isNull())
    d = dense_index(m.withColumnRenamed("id", "bp_").drop("bp", "len"), [], ["bp_"], "_g", "_i")
    top = mono.agg(F.max("id").alias("m")).scalar()
    last = mono.agg(F.max("strand").alias("m")).scalar()
    return d.select((top + 1 + F.col("_i")).alias("id"), (last + 1 + F.col("_i")).alias("strand"),
                    F.lit(0).cast("bigint").alias("pos"),
                    complement(F.col("base"), F.col("class")).alias("base"), "class",
                    F.col("bp_").alias("bp"),
                    add(F.col("p"), scale(F.col("a1"), 1.2)).alias("p"),
                    scale(F.col("a1"), -1.0).alias("a1"), scale(F.col("a3"), -1.0).alias("a3"))


def extend_duplex(mono: DataFrame, extensions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs made where missing, new monomers of both strands, refused).

    The end grows towards its open side while its pair's facing side must be open too; new
    monomers are paired with their complements.
    """
    e = mono.join(extensions, "id", "left_semi").filter(F.col("bp").isNull())
    made = create_pair(mono, e.select("id"))
    mate = mono.select(F.col("id").alias("_m"), F.col("strand").alias("_ms"), F.col("pos").alias(
        "_mp"), F.col("n3").alias("_m3"), F.col("n5").alias("_m5"))
    mate = mate.unionByName(made.select(
        F.col("id").alias("_m"), F.col("strand").alias("_ms"), F.col("pos").alias("_mp"),
        F.lit(None).cast("bigint").alias("_m3"), F.lit(None).cast("bigint").alias("_m5")))
    s = extensions.join(mono.select("id", "strand", "pos", "class", "n3", "n5", "bp", "p", "a1",
                                    "a3"), "id")
    s = s.join(made.select(F.col("bp").alias("id"), F.col("id").alias("_made")), "id", "left")
    s = s.withColumn("_m", F.coalesce("bp", "_made")).join(mate, "_m")
    towards = F.when(F.col("n5").isNull() & F.col("_m3").isNull(), "n5").when(
        F.col("n3").isNull() & F.col("_m5").isNull(), "n3")
    s = s.withColumn("towards", towards)
    refused = s.filter(F.col("towards").isNull()).select("id", "sequence")
    g = _steps(s.filter(F.col("towards").isNotNull()).select(
        F.col("id").alias("end"), "strand", F.col("pos").alias("_at"), "class", "towards", "p", "a1",
        "a3", "sequence", "_m", "_ms", "_mp"))
    top = mono.unionByName(made, allowMissingColumns=True).agg(F.max("id").alias("m")).scalar()
    d = dense_index(g, [], ["end", "k"], "_g", "_i").drop("_g").withColumn(
        "id", top + 1 + 2 * F.col("_i"))
    n3 = F.col("towards") == "n3"
    first, last = F.col("k") == 0, F.col("k") == F.col("n") - 1
    out, back = F.when(~last, F.col("id") + 2), lambda end: F.when(first, F.col(end)).otherwise(
        F.col("id") - 2)
    one = d.select("end", "k", "id", "strand", F.col("letter").alias("base"), "class",
                   (F.col("id") + 1).alias("bp"), F.when(n3, out).otherwise(back("end")).alias("n3"),
                   F.when(n3, back("end")).otherwise(out).alias("n5"), "p", "a1", "a3",
                   (F.col("_at") + F.when(n3, F.col("k") + 1).otherwise(-F.col("k") - 1)).alias("pos"))
    own = F.col("id") + 1
    out2 = F.when(~last, own + 2)
    back2 = F.when(first, F.col("_m")).otherwise(own - 2)
    two = d.select("end", "k", own.alias("id"), F.col("_ms").alias("strand"), complement(
        F.col("letter"), F.col("class")).alias("base"), "class", F.col("id").alias("bp"),
        F.when(n3, back2).otherwise(out2).alias("n3"), F.when(n3, out2).otherwise(back2).alias("n5"),
        F.col("q").alias("p"), F.col("b1").alias("a1"), F.col("b3").alias("a3"),
        (F.col("_mp") + F.when(n3, -F.col("k") - 1).otherwise(F.col("k") + 1)).alias("pos"))
    return made, one.unionByName(two), refused


def create_strands(sequences: DataFrame, duplex: bool = False) -> DataFrame:
    """New strands (or duplexes) at the origin from (key, sequence, class).

    Result: key, side (1, 2), k (5' -> 3' of side 1), base, class, p, a1, a3. The first base
    stands at the origin, the rest follow the ideal helix towards 3'.
    """
    # one start frame per class, as a table: constants would be folded into every later step
    frames = sequences.sparkSession.createDataFrame(
        START_FRAMES, "class string, p struct<x:double,y:double,z:double>, "
        "a1 struct<x:double,y:double,z:double>, a3 struct<x:double,y:double,z:double>")
    s = sequences.join(F.broadcast(frames), "class").withColumn("towards", F.lit("n3"))
    first = s.select("key", "class", F.lit(0).alias("k"), F.substring("sequence", 1, 1).alias("letter"),
                     "p", "a1", "a3", add(F.col("p"), scale(F.col("a1"), 1.2)).alias("q"),
                     scale(F.col("a1"), -1.0).alias("b1"), scale(F.col("a3"), -1.0).alias("b3"))
    rest = s.filter(F.length("sequence") > 1).withColumn("sequence", F.expr("substring(sequence, 2)"))
    grown = _steps(rest).withColumn("k", F.col("k") + 1).select(*first.columns)
    both = first.unionByName(grown)
    one = both.select("key", F.lit(1).alias("side"), "k", F.col("letter").alias("base"), "class", "p",
                      "a1", "a3")
    if not duplex:
        return one
    return one.unionByName(both.select(
        "key", F.lit(2).alias("side"), "k", complement(F.col("letter"), F.col("class")).alias("base"),
        "class", F.col("q").alias("p"), F.col("b1").alias("a1"), F.col("b3").alias("a3")))


def connect_duplex(mono: DataFrame, bridges: DataFrame, end: str = "n3") -> tuple[DataFrame, DataFrame]:
    """(bridge monomers, joints) between strands s1 and s2: key, s1, s2, sequence.

    A duplex of the sequence is centred between the two strand centres. For the 3' variant the
    joints run from the 3' ends of s2 and s1 to the 5' ends of the bridge's two strands; for the
    5' variant from the bridge's 3' ends to their 5' ends. Bridge monomers are keyed by
    (key, side, pos); joints name those and the strands.
    """
    d = create_strands(bridges.select("key", "sequence", F.lit("DNA").alias("class")), True)
    c = mono.groupBy("strand").agg(mean(F.col("p")).alias("c"))
    goal = (bridges.join(c.toDF("s1", "_c1"), "s1").join(c.toDF("s2", "_c2"), "s2")
            .select("key", scale(add(F.col("_c1"), F.col("_c2")), 0.5).alias("_goal"),
                    F.length("sequence").alias("_n")))
    own = d.groupBy("key").agg(mean(F.col("p")).alias("_own"))
    shift = sub(F.col("_goal"), F.col("_own"))
    placed = d.join(goal, "key").join(own, "key").withColumn("p", add(F.col("p"), shift))
    pos = F.when(F.col("side") == 1, F.col("k")).otherwise(F.col("_n") - 1 - F.col("k"))
    placed = placed.select("key", "side", pos.alias("pos"), "base", "class", "p", "a1", "a3")
    at = F.lit(0) if end == "n3" else F.length("sequence") - 1
    joints = bridges.select("key", F.explode(F.array(
        F.named_struct(F.lit("strand"), F.col("s2"), F.lit("side"), F.lit(1)),
        F.named_struct(F.lit("strand"), F.col("s1"), F.lit("side"), F.lit(2)))).alias("j"),
        at.alias("pos"))
    return placed, joints.select("key", "j.strand", "j.side", "pos")
