"""Export of monomer tables. Sinks give rows (file, line_no, line) for ``write_lines``, or lines in parts
for ``write_parts`` where a line holds a whole strand or group.

``mono``: structure, strand, class, pos, id, base, n3, n5, bp, cluster, color, p, a1, a3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import scale
from molframe.functions.nucleic import NM, backbone_site, base_site
from molframe.operators.sequences import PART, sequences
from molframe.plans.ordered import dense_index, few_or_merged, parts_for, running
from molframe.session import settle
from molframe.sinks.lines import with_header
from molframe.sinks.long_lines import as_parts

SCAFFOLD = 1000


def strand_numbers(mono: DataFrame) -> DataFrame:
    """structure, strand, class, len, new_strand, first (new id of its first monomer), ord.

    Peptides come first (-1, -2 ..), then spheres on the same count, then nucleic acids (1, 2 ..).
    """
    rank = F.when(F.col("class") == "peptide", 0).when(F.col("class") == "sphere", 1).otherwise(2)
    s = mono.groupBy("structure", "strand").agg(F.first("class").alias("class"),
                                                F.count(F.lit(1)).alias("len"))
    s = dense_index(s.withColumn("_rank", rank), ["structure"], ["_rank", "strand"], "_g", "ord",
                    "_n")
    s = running(s, ["structure"], "ord", sums={
        "_end": F.col("len"), "_neg": F.when(F.col("_rank") < 2, 1).otherwise(0)})
    return s.select("structure", "strand", "class", "len", "ord",
                    F.when(F.col("_rank") < 2, -(F.col("ord") + 1))
                    .otherwise(F.col("ord") + 1 - F.col("_neg")).alias("new_strand"),
                    (F.col("_end") - F.col("len")).alias("first"))


def renumber(mono: DataFrame, new_format: bool) -> DataFrame:
    """structure, id -> new_id, new_strand. The old format lists nucleic acids 3' -> 5'."""
    s = strand_numbers(mono).select("structure", "strand", "len", "new_strand", "first")
    back = ~F.col("class").isin("peptide", "sphere") & F.lit(not new_format)
    at = F.when(back, F.col("len") - 1 - F.col("pos")).otherwise(F.col("pos"))
    return (mono.drop("len").join(s, ["structure", "strand"])
            .select("structure", "id", (F.col("first") + at).alias("new_id"), "new_strand"))


def mixed_structures(mono: DataFrame) -> DataFrame:
    """Structures with both DNA and RNA: the old format cannot hold them."""
    return (mono.filter(F.col("class").isin("DNA", "RNA")).groupBy("structure")
            .agg(F.min("class").alias("a"), F.max("class").alias("b"))
            .filter(F.col("a") != F.col("b")).select("structure"))


def counts(mono: DataFrame) -> DataFrame:
    """Header counts per structure."""
    s = mono.groupBy("structure", "strand").agg(F.first("class").alias("class"),
                                                F.count(F.lit(1)).alias("n"))
    na = ~F.col("class").isin("peptide", "sphere")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return s.groupBy("structure").agg(
        F.sum("n").alias("particles"), F.count(F.lit(1)).alias("strands"), n(na).alias("nuc"),
        n(F.col("class") == "peptide").alias("aa"), n(F.col("class") == "sphere").alias("gs"),
        F.count_if(na).alias("nucleic"), F.count_if(F.col("class") == "peptide").alias("peptide"))


def _header(mono: DataFrame, *tail: str) -> DataFrame:
    c = counts(mono)
    parts = ["particles", "strands"]
    extra = F.when(F.col("gs") > 0, F.concat_ws(" ", "nuc", "aa", "nucleic", "peptide")).when(
        F.col("aa") > 0, F.concat_ws(" ", "nuc", "aa", "nucleic"))
    return c.select(F.col("structure").alias("file"),
                    F.concat_ws(" ", *parts, extra, *[F.lit(t) for t in tail]).alias("line"))


def sphere_subtypes(mono: DataFrame) -> DataFrame:
    """structure, mass, radius, subtype (from 0): one subtype per distinct mass."""
    m = mono.filter(F.col("class") == "sphere").groupBy("structure", "mass").agg(
        F.min("radius").alias("radius"))
    return dense_index(m, ["structure"], ["mass"], "_g", "subtype").select(
        "structure", "mass", "radius", "subtype")


def topology_old(mono: DataFrame) -> DataFrame:
    """Rows ``strand type n3 n5`` in new ids; structures that mix DNA and RNA are left out.

    Spheres carry their mass subtype; peptide and sphere rows end with bonded ids above their
    own, where ``mono`` has ``connections``.
    """
    mono = mono.join(mixed_structures(mono), "structure", "left_anti")
    new = settle(renumber(mono, False))
    spark, keys = mono.sparkSession, ["structure", "id"]
    parts = parts_for(spark, new.count())
    found = new.select("structure", F.col("id").alias("_to"), F.col("new_id").alias("_new")).repartition(
        parts, "structure", "_to")
    # links and bonds are looked up as ids, so whole rows are shuffled once
    linked = [F.struct(F.lit(c).alias("k"), F.col(c).alias("to")) for c in ("n3", "n5")]
    refs = mono.select(*keys, F.explode(F.array(*linked)).alias("r"))
    if "connections" in mono.columns:
        refs = refs.unionByName(mono.filter(F.col("class").isin("peptide", "sphere")).select(*keys, F.explode(
            F.transform("connections", lambda to: F.struct(F.lit("bond").alias("k"), to.alias("to")))).alias("r")))
    refs = refs.filter("r.to IS NOT NULL").select(*keys, F.col("r.k").alias("_k"), F.col("r.to").alias("_to"))
    met = refs.repartition(parts, "structure", "_to").join(found.hint("merge"), ["structure", "_to"]).select(
        *keys, "_k", "_new")
    own = lambda k: F.max(F.when(F.col("_k") == k, F.col("_new")))
    met = settle(met.repartition(parts, *keys).groupBy(*keys).agg(
        own("n3").alias("_n3"), own("n5").alias("_n5"), F.collect_list(F.when(
            F.col("_k") == "bond", F.col("_new"))).alias("_to")))
    d = mono.join(new, keys).join(met, keys, "left")
    kind = F.col("base")
    if "mass" in mono.columns:
        # few masses beside their spheres
        d = d.join(few_or_merged(settle(sphere_subtypes(mono).drop("radius"))), ["structure", "mass"], "left")
        kind = F.when(F.col("class") == "sphere", F.concat(F.lit("gs"), "subtype")).otherwise(kind)
    bonds = F.filter("_to", lambda x: (x > F.col("new_id")) & (x != F.coalesce("_n5", F.lit(-1))))
    tail = F.nullif(F.array_join(F.transform(F.array_sort(bonds), lambda x: x.cast("string")), " "), F.lit(""))
    rows = d.select(F.col("structure").alias("file"), F.col("new_id").alias("line_no"), F.concat_ws(
        " ", "new_strand", kind, F.coalesce("_n3", F.lit(-1)), F.coalesce("_n5", F.lit(-1)), tail)
        .alias("line"))
    return with_header(_header(mono), rows)


def topology_new(mono: DataFrame, kw: DataFrame | None = None, part: int = PART) -> DataFrame:
    """``SEQ id= type= circular= extras`` per strand in parts of ``part`` letters (file, line_no, part, text,
    last); ``kw``: structure, strand, kw (map)."""
    per = mono.groupBy("strand").agg(F.bool_and(F.col("n3").isNotNull()).alias("circular"),
                                     F.count(F.lit(1)).alias("_letters"))
    d = strand_numbers(mono).join(per, "strand")
    extra = F.lit(None).cast("string")
    if kw is not None:
        d = d.join(kw, ["structure", "strand"], "left")
        entries = F.array_sort(F.map_entries(F.map_filter(
            "kw", lambda k, v: ~k.isin("id", "type", "circular"))))
        extra = F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(
            e["key"], F.lit("="), e["value"])), " "), F.lit(""))
    kind = F.when(F.col("class") == "sphere", "generic").otherwise(F.col("class"))
    tail = F.concat(F.lit(" "), F.concat_ws(" ", F.concat(F.lit("id="), "new_strand"), F.concat(
        F.lit("type="), kind), F.concat(F.lit("circular="), "circular"), extra))
    d = d.select("strand", F.col("structure").alias("file"), (F.col("ord") + 1).alias("line_no"), tail.alias("tail"), "_letters")
    last = F.col("part") == F.floor((F.col("_letters") - 1) / part)
    rows = sequences(mono, part).join(d, "strand").select(
        "file", "line_no", "part", F.when(last, F.concat("sequence", "tail")).otherwise(F.col("sequence")).alias("text"),
        last.alias("last"))
    return as_parts(_header(mono, "5->3").withColumn("line_no", F.lit(0))).unionByName(rows)


def _number(c: Column) -> Column:
    """Shortest text that reads back as the same number, without exponent or trailing .0."""
    text = F.format_string("%.6f", c)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def configuration(mono: DataFrame, new_format: bool = True) -> DataFrame:
    """``t``, ``b``, ``E`` and one row of 15 numbers per monomer; box = ceil(3 x largest coordinate)."""
    p = F.col("p")
    big = F.max(F.greatest(*[F.abs(p[a]) for a in "xyz"]))
    box = mono.groupBy("structure").agg(F.ceil(3 * big).alias("b"))
    head = box.select(F.col("structure").alias("file"), F.posexplode(F.array(
        F.lit("t = 0"), F.concat_ws(" ", F.lit("b ="), "b", "b", "b"), F.lit("E = 0 0 0")))
        .alias("line_no", "line"))
    numbers = [_number(F.col(v)[a]) for v in ("p", "a1", "a3") for a in "xyz"]
    rows = mono.join(renumber(mono, new_format), ["structure", "id"]).select(
        F.col("structure").alias("file"), (F.col("new_id") + 3).alias("line_no"),
        F.concat_ws(" ", *numbers, *[F.lit("0")] * 6).alias("line"))
    return head.select("file", F.col("line_no").cast("bigint"), "line").unionByName(rows)


def edges_par(mono: DataFrame, edges: DataFrame) -> DataFrame:
    """Network edges in new ids. ``edges``: structure, p1, p2, eq_dist, type, k, extra."""
    new = settle(renumber(mono, True).select("structure", "id", "new_id"))
    a = new.toDF("structure", "p1", "n1")
    b = new.toDF("structure", "p2", "n2")
    head = counts(mono).select(F.col("structure").alias("file"),
                               (F.col("aa") + F.col("gs")).cast("string").alias("line"))
    d = edges.join(a, ["structure", "p1"]).join(b, ["structure", "p2"])
    d = dense_index(d, ["structure"], ["n1", "n2"], "_g", "_row")
    rows = d.select(F.col("structure").alias("file"), F.col("_row").alias("line_no"), F.concat_ws(
        " ", "n1", "n2", _number(F.col("eq_dist")), "type", _number(F.col("k")),
        F.nullif(F.array_join(F.transform("extra", lambda x: x.cast("string")), " "), F.lit("")))
        .alias("line"))
    return with_header(head, rows)


def masses(mono: DataFrame) -> DataFrame:
    """Header, 27 default rows, then one row per distinct sphere mass."""
    sub = sphere_subtypes(mono)
    head = sub.groupBy(F.col("structure").alias("file")).agg(
        (F.max("subtype") + 27).cast("string").alias("line"))
    default = head.select("file", F.explode(F.sequence(F.lit(0), F.lit(26))).alias("i")).select(
        "file", F.col("i").cast("bigint").alias("line_no"),
        F.concat(F.col("i"), F.lit(" 1 1")).alias("line"))
    rows = sub.select(F.col("structure").alias("file"), (F.col("subtype") + 27).alias("line_no"),
                      F.concat_ws(" ", F.col("subtype") + 27, _number(F.col("mass")),
                                  _number(F.col("radius"))).alias("line"))
    return with_header(head, default.unionByName(rows))


def sequences_csv(mono: DataFrame, selection: DataFrame | None = None, labels: DataFrame | None = None,
                  part: int = PART) -> DataFrame:
    """``name, seq, len, RGB`` per (selected) strand in parts of ``part`` letters; colour of the 5' end, else
    of the 3' end. ``labels``: strand, label (in place of ``strand_<id>``)."""
    if selection is not None:
        wanted = mono.join(selection.select("id"), "id", "left_semi").select("strand").distinct()
        mono = mono.join(wanted, "strand", "left_semi")
    per = mono.groupBy("structure", "strand").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("color", "pos").alias("c5"),
        F.max_by("color", "pos").alias("c3"))
    c = F.coalesce("c5", "c3").cast("bigint")
    rgb = F.concat_ws("/", F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255),
                      c.bitwiseAND(255))
    d = dense_index(per, ["structure"], ["strand"], "_g", "_row", "_k")
    name = F.concat(F.lit("strand_"), "strand")
    if labels is not None:
        d = d.join(labels, "strand", "left")
        name = F.coalesce(F.nullif("label", F.lit("")), name)
    d = d.select("strand", F.col("structure").alias("file"), (F.col("_row") + 1).alias("line_no"), "n",
                 F.concat(name, F.lit(",")).alias("head"), F.concat_ws(
                     ",", F.lit(""), "n", F.when(c.isNotNull(), rgb).otherwise(" ")).alias("tail"))
    last = F.col("part") == F.floor((F.col("n") - 1) / part)
    rows = sequences(mono, part).join(d, "strand").select("file", "line_no", "part", F.concat(
        F.when(F.col("part") == 0, F.col("head")).otherwise(""), "sequence", F.when(last, F.col("tail")).otherwise("")
    ).alias("text"), last.alias("last"))
    head = d.select("file").distinct().select("file", F.lit(0).alias("line_no"), F.lit("name, seq, len, RGB").alias("line"))
    return as_parts(head).unionByName(rows)


def _vector(v: Column) -> Column:
    return F.array(v["x"], v["y"], v["z"])


def nested_lines(parts: list[DataFrame], rows: int) -> DataFrame:
    """Lines of a nested document: each part has file, k1, k2, k3 (sort keys) and line.

    ``rows``: about how many there are, so that a task sorts no more of them where the document is larger.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dense_index(out, ["file"], ["k1", "k2", "k3"], "_g", "line_no", parts=parts_for(
        out.sparkSession, rows)).select("file", "line_no", "line")


def _keyed(df: DataFrame, k1, k2, k3, line: Column) -> DataFrame:
    big = lambda k: (k if isinstance(k, Column) else F.lit(k)).cast("bigint")
    return df.select(F.col("structure").alias("file"), big(k1).alias("k1"), big(k2).alias("k2"),
                     big(k3).alias("k3"), line.alias("line"))


END = 1 << 60


def design_json(mono: DataFrame, box: float, forces: DataFrame | None = None) -> DataFrame:
    """Native design document, one monomer per line, so a document of any size stays spread.

    ``forces``: structure, ord, json (text of one force). Lines sort as: head, per strand its
    opening, monomers and closing, then forces.
    """
    keyed = mono.withColumn("_n", F.col("len"))
    fields = F.struct("id", F.col("base").alias("type"), "class", _vector(F.col("p")).alias("p"),
                      _vector(F.col("a1")).alias("a1"), _vector(F.col("a3")).alias("a3"),
                      "n3", "n5", "bp", "cluster", "color")
    comma = F.when(F.col("pos") < F.col("_n") - 1, ",").otherwise("")
    body = _keyed(keyed, F.col("strand"), 1, F.col("pos"), F.concat(F.to_json(fields), comma))
    s = keyed.groupBy("structure", "strand").agg(
        F.first("class").alias("class"), F.min_by("id", "pos").alias("e5"),
        F.max_by("id", "pos").alias("e3"))
    last = s.groupBy("structure").agg(F.max("strand").alias("_last"))
    s = s.join(last, "structure")
    kind = F.when(F.col("class") == "peptide", "Peptide").otherwise("NucleicAcidStrand")
    opening = _keyed(s, F.col("strand"), 0, 0, F.format_string(
        '{"id":%d,"class":"%s","end3":%d,"end5":%d,"monomers":[', "strand", kind, "e3", "e5"))
    closing = _keyed(s, F.col("strand"), 2, 0, F.concat(
        F.lit("]}"), F.when(F.col("strand") < F.col("_last"), ",").otherwise("")))
    one = mono.select("structure").distinct()
    head = _keyed(one, -1, 0, 0, F.lit(
        f'{{"box":[{box},{box},{box}],"systems":[{{"id":0,"strands":['))
    mid = _keyed(one, END, 0, 0, F.lit(']}],"forces":['))
    tail = _keyed(one, END, 2, 0, F.lit('],"selections":[]}'))
    parts = [head, opening, body, closing, mid, tail]
    if forces is not None:
        top = forces.groupBy("structure").agg(F.max("ord").alias("_top"))
        parts.append(_keyed(forces.join(top, "structure"), END, 1, F.col("ord"), F.concat(
            "json", F.when(F.col("ord") < F.col("_top"), ",").otherwise(""))))
    return nested_lines(parts, mono.count() + (forces.count() if forces is not None else 0))


def unf_json(mono: DataFrame, box: float) -> DataFrame:
    """UNF document in nm: strands with site centres, pairs and neighbours; groups from clusters."""
    p, a1, a3 = F.col("p"), F.col("a1"), F.col("a3")
    or_none = lambda c: F.coalesce(F.col(c), F.lit(-1))
    alt = F.array(F.struct(
        _vector(scale(base_site(p, a1), NM)).alias("nucleobaseCenter"),
        _vector(scale(backbone_site(F.col("class"), p, a1, a3), NM)).alias("backboneCenter"),
        _vector(a3).alias("baseNormal"), _vector(a1).alias("hydrogenFaceDir")))
    nt = F.to_json(F.struct("id", F.col("base").alias("nbAbbrev"), or_none("bp").alias("pair"),
                            or_none("n5").alias("prev"), or_none("n3").alias("next"),
                            F.lit(0).alias("pdbId"), alt.alias("altPositions")))
    aa = F.to_json(F.struct("id", F.lit("").alias("secondary"), F.col("base").alias("aaAbbrev"),
                            or_none("n5").alias("prev"), or_none("n3").alias("next"),
                            F.lit(0).alias("pdbId"),
                            F.array(_vector(scale(p, NM))).alias("altPositions")))
    is_aa = F.col("class") == "peptide"
    used = mono.filter(F.col("class").isin("DNA", "RNA", "peptide"))
    comma = F.when(F.col("pos") < F.col("len") - 1, ",").otherwise("")
    # nucleic acids sort before peptides: one block each
    block = F.when(is_aa, END + 1).otherwise(0) + F.col("strand")
    body = _keyed(used, block, 1, F.col("pos"), F.concat(F.when(is_aa, aa).otherwise(nt), comma))
    s = used.groupBy("structure", "strand").agg(
        F.first("class").alias("class"), F.max("len").alias("len"),
        F.min_by("id", "pos").alias("e5"), F.max_by("id", "pos").alias("e3"),
        F.min_by("color", "pos").alias("color"))
    last = s.groupBy("structure", (F.col("class") == "peptide").alias("_aa")).agg(
        F.max("strand").alias("_last"))
    s = s.withColumn("_aa", F.col("class") == "peptide").join(last, ["structure", "_aa"])
    colour = F.when(F.col("color").isNotNull(), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(
        F.col("color").cast("bigint"))), 6, "0"))).otherwise("")
    na_open = F.format_string(
        '{"id":%d,"name":"strand_%d","isScaffold":%s,"naType":"%s","color":"%s","fivePrimeId":%d,'
        '"threePrimeId":%d,"pdbFileId":0,"chainName":"","nucleotides":[', "strand", "strand",
        (F.col("len") > SCAFFOLD).cast("string"), "class", colour, "e5", "e3")
    aa_open = F.format_string(
        '{"id":%d,"chainName":"strand_%d","color":"%s","pdbFileId":0,"nTerm":%d,"cTerm":%d,'
        '"aminoAcids":[', "strand", "strand", colour, "e5", "e3")
    s_block = F.when(F.col("_aa"), END + 1).otherwise(0) + F.col("strand")
    opening = _keyed(s, s_block, 0, 0, F.when(F.col("_aa"), aa_open).otherwise(na_open))
    closing = _keyed(s, s_block, 2, 0, F.concat(
        F.lit("]}"), F.when(F.col("strand") < F.col("_last"), ",").otherwise("")))
    one = mono.select("structure").distinct()
    head = _keyed(one, -1, 0, 0, F.lit(
        '{"format":"unf","version":"1.0.0","lengthUnits":"nm","angularUnits":"deg",'
        f'"simData":{{"boxSize":[{box},{box},{box}]}},"externalFiles":[],"lattices":[],'
        '"structures":[{"id":0,"name":"","naStrands":['))
    mid = _keyed(one, END, 0, 0, F.lit('],"aaChains":['))
    tail = _keyed(one, 2 * END, 0, 0, F.lit(
        ']}],"molecules":{"ligands":[],"bonds":[],"nanostructures":[]},"groups":['))
    groups = used.filter(F.col("cluster") > 0)
    top = groups.groupBy("structure").agg(F.max("cluster").alias("_last"))
    per = groups.groupBy("structure", "cluster").agg(F.min("id").alias("_first")).join(top, "structure")
    at = lambda c: F.lit(2 * END) + c
    g_open = _keyed(per, at(F.col("cluster")), 0, 0, F.format_string(
        '{"name":"group%d","id":%d,"includedObjects":[', F.col("cluster") - 1, F.col("cluster") - 1))
    g_body = _keyed(groups.join(per.select("structure", "cluster", "_first"),
                                ["structure", "cluster"]), at(F.col("cluster")), 1, F.col("id"),
                    F.concat(F.when(F.col("id") > F.col("_first"), ",").otherwise(""), "id"))
    g_close = _keyed(per, at(F.col("cluster")), 2, 0, F.concat(
        F.lit("]}"), F.when(F.col("cluster") < F.col("_last"), ",").otherwise("")))
    finish = _keyed(one, 3 * END, 0, 0, F.lit(
        '],"connections":[],"modifications":[],"misc":{}}'))
    # a line for each monomer, and one for its place in a group
    return nested_lines([head, opening, body, closing, mid, tail, g_open, g_body, g_close, finish],
                        used.count() + groups.count())


def forces_text(mono: DataFrame, forces: DataFrame, new_format: bool = True
                ) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects): mutual-trap blocks in new ids; a missing particle rejects the force.

    ``forces``: structure, ord, type, particle, ref_particle, stiff, r0, pbc.
    """
    new = settle(renumber(mono, new_format).select("structure", "id", "new_id"))
    d = (forces.join(new.toDF("structure", "particle", "_a"), ["structure", "particle"], "left")
         .join(new.toDF("structure", "ref_particle", "_b"), ["structure", "ref_particle"], "left"))
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pairs = [("type", F.col("type")), ("particle", F.col("_a")), ("ref_particle", F.col("_b")),
             ("stiff", _number(F.col("stiff"))), ("r0", _number(F.col("r0"))), ("PBC", F.col("pbc"))]
    lines = F.array(F.lit("{"), *[F.concat(F.lit(f"    {k} = "), v) for k, v in pairs], F.lit("}"))
    rows = d.filter(ok).select(F.col("structure").alias("file"), "ord",
                               F.posexplode(lines).alias("k", "line"))
    return (rows.select("file", (F.col("ord") * 8 + F.col("k")).alias("line_no"), "line"),
            d.filter(~ok).select("structure", "ord"))


def index_groups(members: DataFrame, width: int = 4096) -> DataFrame:
    """Member ids per coarse particle, one line per group: ``members``: structure, grp, id.

    A line comes in parts of ``width`` ids: file, line_no, grp, part, text, last.
    """
    d = dense_index(members, ["structure", "grp"], ["id"], "_g", "_k", "_n")
    part = F.floor(F.col("_k") / width)
    lines = d.groupBy("structure", "grp", part.alias("part"), "_n").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("ids"))
    numbers = dense_index(lines.filter("part = 0").select("structure", "grp"), ["structure"], ["grp"], "_g", "line_no", "_m")
    return lines.join(numbers.select("structure", "grp", "line_no"), ["structure", "grp"]).select(
        F.col("structure").alias("file"), "line_no", "grp", "part", F.concat(
            F.when(F.col("part") > 0, " ").otherwise(""), "ids").alias("text"),
        (F.col("part") == F.floor((F.col("_n") - 1) / width)).alias("last"))


def fluctuations(series: DataFrame) -> DataFrame:
    """``{"RMSF (nm)": [...]}`` of series (file, x, msf in nm^2), one number per line."""
    top = series.groupBy("file").agg(F.max("x").alias("_top"))
    body = series.join(top, "file").select(
        "file", F.col("x").cast("bigint").alias("line_no"), F.concat(
            F.sqrt("msf").cast("string"), F.when(F.col("x") < F.col("_top"), ",").otherwise(""))
        .alias("line"))
    head = top.select("file", F.lit(0).cast("bigint").alias("line_no"),
                      F.lit('{"RMSF (nm)": [').alias("line"))
    tail = top.select("file", (F.col("_top") + 1).cast("bigint").alias("line_no"),
                      F.lit("]}").alias("line"))
    return head.unionByName(body).unionByName(tail)
