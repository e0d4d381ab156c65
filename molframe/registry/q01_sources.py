"""Sources: model tables are written as files to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe import adapters as A
from molframe.functions.geometry import flat, r, vec
from molframe.plans.ordered import dense_index, parts_for
from molframe.registry.core import query, r4
from molframe.registry.files import written, written_parts
from molframe.registry.q02_sinks import FLUX, WIDTH, bonds, flux_series, keyword_data, trap_json
from molframe.sinks import structures as X
from molframe.session import materialise
from molframe.sinks.long_lines import as_parts
from molframe.sources import auxiliary as U, json_files as J, pdb as B, topology as T, trajectory as Y
from molframe.sources.lines import read_lines

C = F.col


def lines(df: DataFrame, file, order: list, line, extra: list[DataFrame] | None = None, rows: int | None = None) -> DataFrame:
    """Render rows as lines: numbered inside ``file`` by ``order``, in as many tasks as about ``rows`` of them need."""
    keys = [o.cast("bigint").alias(f"k{i}") for i, o in enumerate(order)]
    d = df.select(file.alias("file"), *keys, line.alias("line"))
    for e in extra or []:
        d = d.unionByName(e)
    return dense_index(d, ["file"], [f"k{i}" for i in range(len(order))], "_g", "line_no", parts=parts_for(
        df.sparkSession, rows) if rows else None).select("file", "line_no", "line")


def single(df: DataFrame, file, keys: list[int], line) -> DataFrame:
    """One extra line per file for ``lines``."""
    return df.select(file.alias("file")).distinct().select(
        "file", *[F.lit(k).cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)],
        line.alias("line"))


@query("src_topology_old", """SELECT e.structure AS file, n.old_new AS id, n.new_strand AS strand,
    CASE WHEN e.class = 'sphere' THEN 'gs' || (dense_rank() OVER (PARTITION BY e.structure, e.class
    ORDER BY e.code) - 1) ELSE e.base END AS base, n3.old_new AS n3, n5.old_new AS n5,
    (CASE WHEN e.class = 'peptide' AND e.n3 IS NOT NULL THEN 1 ELSE 0 END) +
    (CASE WHEN e.class = 'peptide' AND e.pos < e.len - 5 THEN 1 ELSE 0 END) AS n_bonds, e.class,
    NULL AS _corrupt FROM expo e JOIN newid n ON n.id = e.id LEFT JOIN newid n3 ON n3.id = e.n3
    LEFT JOIN newid n5 ON n5.id = e.n5 UNION ALL SELECT structure, sum(len), NULL, NULL, NULL, NULL,
    0, NULL, '7 A' FROM strands GROUP BY structure""")
def _(spark, sf):
    def text():
        top = materialise(X.topology_old(A.exported(spark, sf)), "lines")
        bad = top.groupBy("file").agg((F.max("line_no") + 1).alias("line_no"), F.lit("7 A").alias("line"))
        return top.unionByName(bad)
    d = T.read_old(spark, written(text))
    # a corrupt row has no class of its own
    return d.select("file", "id", "strand", "base", "n3", "n5",
                    F.greatest(F.size("connections"), F.lit(0)).alias("n_bonds"),
                    F.when(C("_corrupt").isNull(), C("class")).alias("class"), "_corrupt")


@query("src_topology_new", """SELECT e.structure AS file, s.ord + 1 AS line_no, e.pos, e.base,
    CASE WHEN e.class = 'sphere' THEN 'generic' ELSE e.class END AS type,
    CASE WHEN e.pos < e.len - 1 THEN e.pos + 1 END AS n3_pos,
    CASE WHEN e.pos > 0 THEN e.pos - 1 END AS n5_pos,
    CASE WHEN e.strand % 2 = 1 THEN 's' || e.strand END AS label
    FROM expo e JOIN snum s ON s.strand = e.strand""")
def _(spark, sf):
    path = written_parts(X.topology_new(A.exported(spark, sf), keyword_data(spark, sf), WIDTH))
    s, letters = T.read_new(spark, path)
    labels = s.select("file", "line_no", F.col("kw")["label"].alias("label"))
    return T.new_monomers(s, letters).join(labels, ["file", "line_no"])


def patchy(spark, sf):
    """One line of species per brand and thousand of keys."""
    part = A.read(spark, sf, "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))),
                                    lambda x: (x["p_size"] % 5).cast("string")), " ")
    # a file holds the keys of one thousand, so its line stays short at any size
    file = F.concat_ws("-", "p_brand", F.floor(C("p_partkey") / 1000).cast("string"))
    d = part.groupBy(file.alias("file")).agg(
        text.alias("line"), F.count(F.lit(1)).alias("n"))
    return d.select("file", F.posexplode(F.array(F.concat(C("n"), F.lit(" 5")), C("line"))).alias(
        "line_no", "line"))


@query("src_topology_detect", """SELECT structure AS file, 'old' AS dialect FROM strands
    GROUP BY 1 UNION ALL SELECT 'new-' || structure, 'new' FROM strands GROUP BY 1 UNION ALL
    SELECT DISTINCT p_brand || '-' || (p_partkey // 1000), 'patchy' FROM part""")
def _(spark, sf):
    e = A.exported(spark, sf)
    new = lambda: X.topology_new(e).withColumn("file", F.concat(F.lit("new-"), "file"))
    return T.detect(spark, written_parts(lambda: as_parts(X.topology_old(e)), new, lambda: as_parts(patchy(spark, sf))))


@query("src_patchy_topology", """SELECT p_brand || '-' || (p_partkey // 1000) AS file, 'plain' AS variant, row_number() OVER (
    PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) - 1 AS id, p_size % 5 AS species,
    row_number() OVER (PARTITION BY p_brand, p_partkey // 1000, p_size % 5 ORDER BY p_partkey) - 1
    AS sid, NULL AS patch_spec FROM part
    UNION ALL SELECT p_type, 'loro', row_number() OVER (PARTITION BY p_type ORDER BY p_partkey, k) - 1,
    dense_rank() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1, k - 1, 'spec' || p_partkey
    FROM part, range(1, 6) t(k) WHERE k <= p_size % 5""")
def _(spark, sf):
    plain = T.read_patchy(spark, written(patchy(spark, sf)))
    part = A.read(spark, sf, "part").filter(C("p_size") % 5 > 0)
    f = C("p_type")
    body = lines(part, f, [C("p_partkey")], F.concat_ws(
        " ", C("p_size") % 5, F.lit("2"), F.lit("0,1"), F.concat(F.lit("spec"), "p_partkey")),
        [single(part, f, [-1], F.lit("0 0"))])
    loro = T.read_patchy(spark, written(body), loro=True)
    return plain.withColumn("variant", F.lit("plain")).unionByName(
        loro.withColumn("variant", F.lit("loro")))


@query("src_patchy_species", """SELECT p_brand AS file, p_partkey AS species, p_size AS type, o AS ord,
    p_partkey + o AS patch, p_size % 3 AS color, (p_partkey + o) % 7 + 0.5::DOUBLE AS px FROM part,
    range(2) t(o)""")
def _(spark, sf):
    part, f, key = A.read(spark, sf, "part"), C("p_brand"), C("p_partkey")
    text = F.array(F.concat(F.lit("particle_"), key, F.lit(" = {")),
                   F.concat(F.lit("  type = "), "p_size"),
                   F.concat(F.lit("  patches = "), key, F.lit(","), key + 1), F.lit("}"))
    rows = part.select(f.alias("b"), key.alias("k"), F.posexplode(text).alias("i", "t"))
    particles = written(lines(rows, C("b"), [C("k"), C("i")], C("t")))
    x = F.concat((C("id") % 7).cast("string"), F.lit(".5,-1,0.25"))
    patch = part.select(f.alias("b"), "p_size", F.explode(F.array(key, key + 1)).alias("id"),
                        F.explode(F.array(F.lit(0))).alias("z"))
    # a patch listed by two particles is written once, with the colour of the one that owns it
    own = part.select(f.alias("b"), key.alias("id"), (C("p_size") % 3).alias("color"))
    patch = patch.select("b", "id").distinct().join(own, ["b", "id"], "left")
    text = F.array(F.concat(F.lit("patch_"), "id", F.lit(" = {")),
                   F.concat(F.lit("  color = "), F.coalesce("color", F.lit(9))),
                   F.concat(F.lit("  position = "), x), F.lit("  a1 = 1,0,0"), F.lit("}"))
    rows = patch.select("b", "id", F.posexplode(text).alias("i", "t"))
    patches = written(lines(rows, C("b"), [C("id"), C("i")], C("t")))
    species, p = T.read_species(spark, particles, patches)
    owner = species.select("file", C("id").alias("species"), (C("type") % 3).alias("color"))
    return T.species_patches(species, p).drop("color").join(owner, ["file", "species"]).select(
        "file", "species", "type", C("ord").cast("bigint").alias("ord"), "patch", "color",
        F.get("position", F.lit(0)).alias("px"))


# Frames as text: coordinates in hundredths, so that both engines print the same digits.
def frame_lines(spark, sf):
    c = A.coords(spark, sf).withColumn("f", F.concat(F.lit("r"), C("particle") % 4))
    cents = F.round(C("p.x") * 100).cast("bigint")
    body = F.concat_ws(" ", cents, C("p.y").cast("bigint"), "frame", F.lit("1 0 0 0 0 1 0 0 0 0 0 0"))
    one = c.select("f", "frame").distinct()
    head = one.select("f", "frame", F.posexplode(F.array(
        F.concat(F.lit("t = "), C("frame") * 1000), F.lit("b = 50 50 50"), F.lit("E = 0 0 0")))
        .alias("k", "t"))
    heads = head.select(C("f").alias("file"), C("frame").cast("bigint").alias("k0"),
                        F.lit(0).cast("bigint").alias("k1"), C("k").cast("bigint").alias("k2"),
                        C("t").alias("line"))
    return lines(c, C("f"), [C("frame"), F.lit(1), C("particle")], body, [heads])


@query("src_trajectory", f"""WITH s AS (SELECT particle % 4 AS f, count(DISTINCT particle) AS n
    FROM coords GROUP BY 1), k AS (SELECT particle % 4 AS f, frame, count(*) AS m FROM coords
    GROUP BY 1, 2) SELECT 'r' || s.f AS file, c.frame, c.frame * 1000 AS time,
    row_number() OVER (PARTITION BY s.f, c.frame ORDER BY particle) - 1 AS id,
    {r4("round(x * 100)")} AS x, y, 1.0::DOUBLE AS a1_x, 1.0::DOUBLE AS a3_z, false AS rejected
    FROM coords c JOIN s ON s.f = particle % 4 JOIN k ON k.f = s.f AND k.frame = c.frame WHERE k.m = s.n
    UNION ALL SELECT 'r' || s.f, frame, frame * 1000, NULL, NULL, NULL, NULL, NULL, true
    FROM k JOIN s ON s.f = k.f WHERE k.m < s.n""")
def _(spark, sf):
    sizes = (A.coords(spark, sf).select(F.concat(F.lit("r"), C("particle") % 4).alias("file"),
                                        "particle").distinct()
             .groupBy("file").agg(F.count(F.lit(1)).alias("n_monomers")))
    c, f, rejected = Y.read_trajectory(spark, written(frame_lines(spark, sf), ".dat"), sizes)
    good = c.join(f.select("file", "frame", "time"), ["file", "frame"]).select(
        "file", "frame", "time", "id", C("p.x").alias("x"), C("p.y").alias("y"),
        C("a1.x").alias("a1_x"), C("a3.z").alias("a3_z"), F.lit(False).alias("rejected"))
    return good.unionByName(rejected.select("file", "frame", "time", F.lit(True).alias("rejected")),
                            allowMissingColumns=True)


@query("src_frame_catalogue", """WITH t AS (SELECT particle % 4 AS f, frame, length('t = ' || frame * 1000) AS head,
    length(CAST(round(x * 100) AS BIGINT) || ' ' || CAST(y AS BIGINT) || ' ' || frame) + 25 AS b
    FROM coords), l AS (SELECT f, frame, count(*) AS n, CAST(sum(b) + max(head) + 24 AS BIGINT)
    AS n_bytes FROM t GROUP BY f, frame)
    SELECT 'r' || f AS file, frame AS ordinal, frame, frame * 1000 AS time, n, n_bytes,
    CAST(sum(n_bytes) OVER (PARTITION BY f ORDER BY frame) - n_bytes AS BIGINT) AS offset FROM l""")
def _(spark, sf):
    return Y.catalogue(Y.read_frames(read_lines(spark, written(frame_lines(spark, sf), ".dat"))))


@query("src_xyz", f"""SELECT 'r' || (particle % 4) AS file, row_number() OVER (PARTITION BY
    particle % 4 ORDER BY particle, frame) - 1 AS id, row_number() OVER (PARTITION BY particle % 4
    ORDER BY particle, frame) - 1 AS strand, 'A' AS base, {r4("round(x * 100)")} AS x, y, z
    FROM coords""")
def _(spark, sf):
    c, f = A.coords(spark, sf), F.concat(F.lit("r"), C("particle") % 4)
    text = F.concat_ws(" ", F.round(C("p.x") * 100).cast("bigint"), C("p.y"), C("p.z"))
    blank = single(c, f, [1 << 60, 0], F.lit(""))
    path = written(lines(c, f, [C("particle"), C("frame")], text, [blank]), ".xyz")
    d = Y.read_xyz(spark, path)
    return d.select("file", "id", "strand", "base", *[C("p")[a].alias(a) for a in "xyz"])


@query("src_design_json", f"""SELECT structure AS file, 0 AS system, strand, pos, id, base, class,
    n3, n5, bp, cluster, color, {r4('px', 6)} AS x, ax AS a1_x, 1.0::DOUBLE AS a3_z FROM mono
    WHERE class <> 'sphere'""")
def _(spark, sf):
    m = A.monomers(spark, sf).filter(C("class") != "sphere")
    path = written(lambda: X.design_json(m, 100.0, trap_json(spark, sf)), ".json", m.count())
    d = J.read_design(spark, path)
    return d.select("file", "system", "strand", "pos", "id", "base", "class", "n3", "n5", "bp",
                    "cluster", "color", r(C("p.x"), 6).alias("x"), C("a1.x").alias("a1_x"),
                    C("a3.z").alias("a3_z"))


@query("src_unf_json", f"""SELECT structure AS file, 0 AS system, strand, pos, id, base, class,
    n3, n5, bp, {r4('px', 6)} AS x, {r4('py', 6)} AS y, {r4('pz', 6)} AS z FROM mono
    WHERE class <> 'sphere'""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    d = J.read_unf(spark, written(lambda: X.unf_json(m, 100.0), ".unf", m.count()))
    return d.select("file", "system", "strand", "pos", "id", "base", "class", "n3", "n5", "bp",
                    *flat(C("p"), "", 6))


def cells(spark, sf):
    """Lattice cells of the grid: one per (helix, offset, strand, direction)."""
    g = A.grid(spark, sf).withColumn("file", F.concat(F.lit("f"), F.floor(C("strand") / 10) % 4))
    ids = lambda fwd: F.array_sort(F.collect_list(F.when(C("forward") == fwd, C("id"))))
    return g.groupBy("file", "helix", "offset", "strand", F.floor(C("pos") / 2).alias("part")).agg(
        ids(True).alias("forward"), ids(False).alias("backward"))


TURN = "34.3 * pi() / 180"


@query("src_unf_lattice", f"""WITH g AS (SELECT id, helix, forward, offs AS z, 'f' ||
    ((strand // 10) % 4) AS file, helix // 6 AS hr, helix % 6 AS hc FROM grid),
    c AS (SELECT *, CASE WHEN file IN ('f0', 'f2') THEN hc * 1.7320508 / 0.8518 + 1 / 0.8518
    ELSE hc * 2 / 0.8518 + 1 / 0.8518 END AS cx, CASE WHEN file IN ('f0', 'f2') THEN
    (hr + (hr + 1 - hc % 2) // 2) * 2 / 0.8518 + 2 / 0.8518 * (0.5 + (hc % 2) * 0.5)
    ELSE hr * 2 / 0.8518 + 1 / 0.8518 END AS cy,
    10 * pi() / 180 * helix + z * 1.0 * {TURN} AS ang, CASE WHEN forward THEN 1 ELSE -1 END AS sgn
    FROM g) SELECT file, id, {r4("cx - sgn * 0.6 * cos(ang) + 1 / 0.8518", 3)} AS x,
    {r4("cy - sgn * 0.6 * sin(ang)", 3)} AS y, {r4("z * 0.332 / 0.8518", 3)} AS z,
    {r4("sgn * cos(ang)", 3)} AS a1_x, sgn::DOUBLE AS a3_z FROM c""")
def _(spark, sf):
    # a cell for each monomer at most
    c, rows = cells(spark, sf), A.monomers(spark, sf).count()
    f, h, k = C("file"), C("helix"), C("offset")
    cell = F.to_json(F.struct(k.alias("number"), C("forward").alias("fiveToThreeNts"),
                              C("backward").alias("threeToFiveNts")))
    first = c.groupBy("file", "helix").agg(F.min(F.struct("offset", "strand", "part")).alias("f"))
    body = c.join(first, ["file", "helix"])
    comma = F.when(F.struct("offset", "strand", "part") > C("f"), ",").otherwise("")
    kind = F.when(f.isin("f0", "f2"), "honeycomb").otherwise("square")
    heads = first.join(first.groupBy("file").agg(F.min("helix").alias("h0")), "file")
    key = lambda *v: [(x if not isinstance(x, int) else F.lit(x)).cast("bigint").alias(f"k{i}")
                      for i, x in enumerate(v)]
    opening = heads.select("file", *key(h, 0, 0, 0), F.format_string(
        '%s{"latticePosition":[%d,%d],"initialAngle":%d,"cells":[',
        F.when(h > C("h0"), ",").otherwise(""), F.floor(h / 6), h % 6, h * 10).alias("line"))
    closing = heads.select("file", *key(h, 2, 0, 0), F.lit("]}").alias("line"))
    start = c.select("file").distinct().select("file", *key(-1, 0, 0, 0), F.concat(F.lit(
        '{"lengthUnits":"nm","angularUnits":"deg","lattices":[{"id":0,"type":"'), kind, F.lit(
        '","position":[1,0,0],"orientation":[0,0,0],"virtualHelices":[')).alias("line"))
    finish = c.select("file").distinct().select("file", *key(99, 0, 0, 0),
                                                F.lit("]}]}").alias("line"))
    doc = lambda: lines(body, f, [h, F.lit(1), k, C("strand") * 1000000000 + C("part")], F.concat(comma, cell),
                        [opening, closing, start, finish], rows)
    d = J.read_lattice(spark, written(doc, ".unf", rows))
    return d.select("file", "id", *flat(C("p"), "", 3), r(C("a1.x"), 3).alias("a1_x"),
                    C("a3.z").alias("a3_z"))


def atom_lines(spark, sf):
    """ATOM rows; a chain of 25 residues ends in TER; four files, with models in two of them."""
    a = A.atoms(spark, sf).withColumn("f", F.concat(F.lit("m"), F.floor(C("residue") / 125) % 4))
    chain_no = F.floor(C("residue") / 25)
    chain = F.char(65 + chain_no % 3)
    text = F.format_string("ATOM  %5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f",
                           (C("residue") * 21 + C("k")) % 100000, C("name"),
                           F.concat(F.lit("D"), "letter"), chain, C("residue") % 10000,
                           C("p.x") * 100, C("p.y") * 100, C("p.z") * 100, C("b") / 10)
    order = [chain_no, F.lit(0), C("residue"), C("k")]
    ters = a.select(C("f").alias("file"), chain_no.alias("k0")).distinct()
    end = lambda kind, text, rows: rows.select(
        "file", C("k0").cast("bigint"), F.lit(kind).cast("bigint").alias("k1"),
        F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("k3"),
        F.lit(text).alias("line"))
    models = ters.filter(C("file").isin("m1", "m3"))
    bonds = a.filter((C("k") == 0) & (C("residue") % 40 == 0)).select(
        C("f").alias("file"), F.lit(-1).cast("bigint").alias("k0"),
        F.lit(0).cast("bigint").alias("k1"), C("residue").alias("k2"),
        F.lit(0).cast("bigint").alias("k3"), F.format_string(
            "SSBOND   1 CYS %s %4d    CYS B %4d", chain, C("residue") % 10000,
            (C("residue") + 3) % 10000).alias("line"))
    return lines(a, C("f"), order, text, [end(1, "TER", ters), end(2, "ENDMDL", models), bonds])


PDB = "'m' || ((residue // 125) % 4)"


@query("src_pdb_atoms", f"""SELECT {PDB} AS file, (residue * 21 + k) % 100000 AS serial, name,
    'D' || letter AS residue_type, chr(CAST(65 + (residue // 25) % 3 AS INT)) AS chain,
    CAST(residue % 10000 AS VARCHAR) AS residue, dense_rank() OVER (PARTITION BY {PDB}
    ORDER BY residue // 25) - 1 AS chain_idx, dense_rank() OVER (PARTITION BY {PDB} ORDER BY residue)
    - 1 AS residue_idx, {r4("round(x * 100, 3) / 8.518", 5)} AS x FROM atoms""")
def _(spark, sf):
    d = B.read_atoms(spark, written(atom_lines(spark, sf), ".pdb"))
    return d.select("file", C("serial").cast("bigint").alias("serial"), "name", "residue_type",
                    "chain", "residue", "chain_idx", "residue_idx", r(C("p.x"), 5).alias("x"))


@query("src_pdb_sections", f"""WITH c AS (SELECT {PDB} AS file, residue // 25 AS n, count(*) AS m,
    count(*) FILTER (k = 0 AND residue % 40 = 0) AS bonds FROM atoms GROUP BY ALL),
    s AS (SELECT file, row_number() OVER w - 1 AS section, chr(CAST(65 + n % 3 AS INT)) AS chain,
    CAST(sum(bonds) OVER (PARTITION BY file) AS BIGINT) AS head, CAST(sum(m) OVER w AS BIGINT) AS
    upto, CASE WHEN file IN ('m1', 'm3') THEN 2 ELSE 1 END AS extra FROM c
    WINDOW w AS (PARTITION BY file ORDER BY n)),
    e AS (SELECT *, head + upto + section * extra AS end_line FROM s)
    SELECT file, section, chain, coalesce(lag(end_line) OVER (PARTITION BY file ORDER BY section),
    head) AS start_line, end_line, extra = 2 AND row_number() OVER (PARTITION BY file, chain
    ORDER BY section) > 1 AS is_copy, NULL AS res1, NULL AS res2 FROM e UNION ALL
    SELECT {PDB}, NULL, chr(CAST(65 + (residue // 25) % 3 AS INT)), NULL, NULL, NULL,
    residue % 10000, (residue + 3) % 10000 FROM atoms WHERE k = 0 AND residue % 40 = 0""")
def _(spark, sf):
    path = written(atom_lines(spark, sf), ".pdb")
    none = lambda t: F.lit(None).cast(t)
    bonds = B.read_disulphides(spark, path).select(
        "file", none("bigint").alias("section"), C("chain1").alias("chain"),
        none("bigint").alias("start_line"), none("bigint").alias("end_line"),
        none("boolean").alias("is_copy"), "res1", "res2")
    return B.read_sections(spark, path).withColumns(
        {"res1": none("bigint"), "res2": none("bigint")}).unionByName(bonds)


@query("src_forces", """SELECT 'f' || (particle % 3) AS file, row_number() OVER (PARTITION BY
    particle % 3 ORDER BY particle) AS block, 'mutual_trap' AS type, particle AS particle,
    NULL AS n_particles, n AS ref_particle, 0.09::DOUBLE AS stiff, NULL AS position, 0 AS rejected
    FROM (SELECT l_suppkey AS particle, count(*) AS n FROM lineitem GROUP BY 1) UNION ALL
    SELECT 'planes', p_partkey * 2 + 1, 'repulsion_plane', NULL, 2, NULL, 1.5::DOUBLE, p_size + 0.5::DOUBLE, 0
    FROM part UNION ALL SELECT 'planes', p_partkey * 2 + 2, 'string', NULL, NULL, NULL, NULL,
    NULL, 1 FROM part""")
def _(spark, sf):
    li = A.read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("a")).agg(
        F.count(F.lit(1)).alias("n"))
    key = lambda k, v: F.concat(F.lit(f"  {k} = "), v)
    text = F.array(F.lit("{ # a trap"), key("type", F.lit("mutual_trap")),
                   key("particle", C("a")), F.lit("# not read"), key("ref_particle", C("n")),
                   key("stiff", F.lit("0.09 # comment")), key("r0", F.lit("1.2")), F.lit("}"))
    rows = li.select(F.concat(F.lit("f"), C("a") % 3).alias("f"), "a",
                     F.posexplode(text).alias("i", "t"))
    part = A.read(spark, sf, "part")
    text = F.array(F.lit("{"), key("type", F.lit("repulsion_plane")),
                   key("particle", F.concat_ws(", ", C("p_partkey"), C("p_partkey") + 1)),
                   key("stiff", F.lit("1.5")), key("dir", F.lit("0, 0, 1")),
                   key("position", F.concat("p_size", F.lit(".5"))), F.lit("}"),
                   F.lit("{"), key("type", F.lit("string")), F.lit("}"))
    planes = part.select(F.lit("planes").alias("f"), C("p_partkey").alias("a"),
                         F.posexplode(text).alias("i", "t"))
    rows = rows.unionByName(planes)
    good, bad = U.read_forces(spark, written(lines(rows, C("f"), [C("a"), C("i")], C("t"))))
    both = U.typed_forces(good).withColumn("rejected", F.lit(0)).unionByName(
        U.typed_forces(bad).withColumn("rejected", F.lit(1)))
    return both.select("file", "block", "type", "particle", F.when(F.size("particles") > 1, F.size(
        "particles")).alias("n_particles"), "ref_particle", "stiff", "position", "rejected")


@query("src_overlay", """SELECT structure AS file, 'Score' AS key, 'scalar' AS kind,
    row_number() OVER (PARTITION BY structure ORDER BY id) - 1 AS idx, code::DOUBLE AS value,
    NULL AS v_sum FROM mono UNION ALL SELECT structure, 'Motion', 'motion', row_number() OVER (
    PARTITION BY structure ORDER BY id) - 1, NULL, code + pos % 7 + 1.0::DOUBLE FROM mono UNION ALL
    SELECT structure, 'Arrows', 'arrow', row_number() OVER (PARTITION BY structure ORDER BY id) - 1,
    NULL, pos + 15.0::DOUBLE FROM mono WHERE pos < 5 UNION ALL SELECT structure, 'Short', 'mismatch', 3,
    NULL, NULL FROM mono GROUP BY structure""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    # a score and a motion for each monomer
    f, rows = C("structure"), 2 * m.count()
    first = F.when(C("id") > C("_first"), ",").otherwise("")

    def block(rows, k, name, text, closing="]"):
        low = rows.groupBy("structure").agg(F.min("id").alias("_first"))
        head = single(rows, f, [k, 0, 0], F.lit(("," if k else "{") + f'"{name}": ['))
        tail = single(rows, f, [k, 2, 0], F.lit(closing))
        body = rows.join(low, "structure").select(
            f.alias("file"), F.lit(k).cast("bigint").alias("k0"), F.lit(1).cast("bigint").alias("k1"),
            C("id").alias("k2"), F.concat(first, text).alias("line"))
        return [head, tail, body]

    vector = lambda *v: F.concat(F.lit("["), F.concat_ws(",", *v), F.lit("]"))
    blocks = block(m, 0, "Score", C("code").cast("string"))
    blocks += block(m, 1, "Motion", vector(C("code"), C("pos") % 7, F.lit(1)))
    blocks += block(m.filter(C("pos") < 5), 2, "Arrows", vector(
        C("pos"), *[F.lit(i) for i in range(1, 6)]))
    short = single(m, f, [3, 0, 0], F.lit(',"Short": [1,2,3]}'))
    start = lambda: lines(m.limit(0), f, [F.lit(0), F.lit(0), C("id")], F.lit(""), blocks + [short], rows)
    sizes = m.groupBy(f.alias("file")).agg(F.count(F.lit(1)).alias("n_monomers"))
    values, bad = J.read_overlay(spark, written(start, ".json", rows), sizes)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    good = values.select("file", "key", "kind", C("idx").cast("bigint").alias("idx"), "value",
                         total.alias("v_sum"))
    return good.unionByName(bad.select(
        "file", "key", F.lit("mismatch").alias("kind"), C("n").cast("bigint").alias("idx"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("v_sum")))


@query("src_edges_par", """SELECT a.structure AS file, i.new_new AS p, j.new_new AS q,
    abs(a.py - b.py) AS eq_dist, 's' AS type, 2.5::DOUBLE AS k, CASE WHEN a.pos % 5 = 0 THEN '1.3 1.4' ELSE ''
    END AS extra FROM expo a JOIN expo b ON b.id = a.n3 JOIN newid i ON i.id = a.id
    JOIN newid j ON j.id = a.n3 WHERE a.class = 'peptide'""")
def _(spark, sf):
    path = written(X.edges_par(A.exported(spark, sf), bonds(spark, sf)), ".par")
    good, _bad = U.read_edges(spark, path)
    return good.select("file", "p", "q", "eq_dist", "type", "k", F.array_join("extra", " ")
                       .alias("extra"))


@query("src_hbonds", """SELECT p_brand AS file, chr(CAST(65 + p_size % 3 AS INT)) AS chain1,
    p_partkey AS res1, 'B' AS chain2, p_partkey + 4 AS res2 FROM part WHERE p_partkey % 4 <> 3""")
def _(spark, sf):
    part, key = A.read(spark, sf, "part"), C("p_partkey")
    chain = F.char(65 + C("p_size") % 3)
    first = F.concat_ws(" ", F.lit("LYS"), F.concat(key, F.lit("."), chain), F.lit("N  ALA"),
                        F.concat(key + 4, F.lit(".B")), F.lit("O no 2.9 3.1"))
    second = F.concat_ws(" ", F.concat(F.lit("#1."), chain), F.lit("GLY"), key, F.lit("N #1.B ASP"),
                         key + 4, F.lit("O no 2.9"))
    other = F.lit("HOH 4.A O HOH 5.A O no 3 3")
    text = F.when(key % 4 == 3, other).when(key % 2 == 0, first).otherwise(second)
    return U.read_hbonds(spark, written(lines(part, C("p_brand"), [key], text)))


@query("src_masses", """SELECT structure AS file, id, class, (code + 1)::BIGINT AS mass,
    (code + 1) * 0.5::DOUBLE AS radius, false AS missing FROM mono WHERE class = 'sphere' UNION ALL
    SELECT structure, id, class, NULL, NULL, true FROM mono WHERE class = 'peptide'""")
def _(spark, sf):
    e = A.exported(spark, sf)
    masses = U.read_masses(spark, written(X.masses(e), ".mass"))
    sub = X.sphere_subtypes(e).select("structure", "mass", "subtype")
    # peptides pose as spheres of a subtype that no file has
    named = e.filter(C("class").isin("sphere", "peptide")).join(sub, ["structure", "mass"], "left")
    named = named.select(C("structure").alias("file"), "id", "class", F.concat(
        F.lit("gs"), F.coalesce("subtype", F.lit(99))).alias("base"))
    found, missing = U.apply_masses(named, masses)
    return found.select("file", "id", "class", "mass", "radius", F.lit(False).alias("missing")) \
        .unionByName(missing.select("file", "id", "class", F.lit(None).cast("bigint").alias("mass"),
                                    F.lit(None).cast("double").alias("radius"),
                                    F.lit(True).alias("missing")))


@query("src_id_list", "SELECT structure AS file, id FROM mono")
def _(spark, sf):
    m = A.monomers(spark, sf)
    path = written_parts(X.index_groups(m.select("structure", C("strand").alias("grp"), "id"), WIDTH))
    return U.read_ids(spark, path)


@query("src_sequence_csv", """SELECT CASE strand % 2 WHEN 0 THEN 'csv' ELSE 'plain' END AS file,
    replace(string_agg(base, '' ORDER BY pos), 'A', 'N') AS sequence, count(*) AS n FROM mono
    GROUP BY strand, pos // 20, strand % 2""")
def _(spark, sf):
    m = A.monomers(spark, sf).groupBy("strand", F.floor(C("pos") / 20).alias("w")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
        .alias("s"))
    low = F.lower(F.translate("s", "A", "?"))
    csv = C("strand") % 2 == 0
    f = F.when(csv, "csv").otherwise("plain")
    text = F.when(csv, F.concat_ws(",", F.lit("0[1],2[3]"), low, F.length("s"), F.lit(
        "#fff"))).otherwise(low)
    head = single(m.filter(csv), f, [-1, 0], F.lit("Start,End,Sequence,Length,Color"))
    d = U.read_sequences(spark, written(lines(m, f, [C("strand"), C("w")], text, [head])))
    return d.select("file", "sequence", F.length("sequence").cast("bigint").alias("n"))


@query("src_dot_bracket", """WITH b AS (SELECT p_partkey AS id, p_size AS n, unnest(range(5 * p_size))
    AS pos FROM part) SELECT id, pos, CASE WHEN pos < 3 * n THEN CASE pos % 3 WHEN 2 THEN NULL
    ELSE 5 * n - 1 - (pos // 3) * 2 - pos % 3 + 0 END ELSE
    ((5 * n - 1 - pos) // 2) * 3 + (5 * n - 1 - pos) % 2 END AS partner FROM b""")
def _(spark, sf):
    b = A.brackets(spark, sf)
    path = written(lambda: lines(b, F.lit("brackets"), [C("id")], C("notation")))
    notation = read_lines(spark, path).select(C("line_no").alias("id"), C("line").alias("notation"))
    pairs, _errors = U.bracket_partners(notation)
    return pairs.select("id", C("pos").cast("bigint").alias("pos"),
                        C("partner").cast("bigint").alias("partner"))


@query("src_order_params", f"""WITH p AS (SELECT frame, count(*) AS n, max(y) AS top FROM coords
    GROUP BY frame) SELECT 'text' AS file, 'n' AS name, frame, n::DOUBLE AS value FROM p UNION ALL
    SELECT 'text', 'top', frame, top FROM p UNION ALL SELECT 'json', 'n', frame, CASE WHEN
    frame % 3 <> 0 THEN n END FROM p""")
def _(spark, sf):
    p = A.coords(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n"),
                                                 F.max("p.y").alias("top"))
    f = F.lit("text")
    text = lines(p, f, [C("frame")], F.concat_ws("\t", "n", "top"),
                 [single(p, f, [-1], F.lit("n\ttop"))])
    g = F.lit("json")
    value = F.when(C("frame") % 3 == 0, "NaN").otherwise(C("n").cast("string"))
    doc = lines(p, g, [C("frame")], F.concat(F.when(C("frame") > 0, ",").otherwise(""), value),
                [single(p, g, [-1], F.lit('{"n": [')), single(p, g, [1 << 60], F.lit("]}"))])
    a = U.read_order_params_text(spark, written(text))
    b = J.read_order_params(spark, written(doc, ".json"))
    return a.unionByName(b.withColumn("frame", C("frame").cast("bigint")))


@query("src_fluctuations", f"""SELECT 'p' || f AS file, x, (y * y)::DOUBLE AS y, 'msf' AS kind,
    'nm_sqr' AS unit FROM ({FLUX})""")
def _(spark, sf):
    d = J.read_fluctuations(spark, written(X.fluctuations(flux_series(spark, sf)), ".json"))
    return d.select("file", "x", "y", "kind", "unit")


@query("src_force_matrix", f"""SELECT 's' || a.strand AS file, a.pos AS p1, b.pos AS p2,
    ((a.pos * 7 + b.pos) % 5)::DOUBLE AS k, {r4('''sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)
    + (b.z-a.z)*(b.z-a.z))''')} AS eq_dist FROM pts a JOIN pts b ON b.strand = a.strand
    AND b.pos > a.pos WHERE (a.pos * 7 + b.pos) % 5 <> 0""")
def _(spark, sf):
    # one document per strand of 32 points: the matrix of a document is as long as its square
    p = A.points(spark, sf)
    listed = F.array_sort(F.collect_list(F.struct("pos", "p")))
    n = F.size("l")
    ij = F.sequence(F.lit(0), n * n - 1)
    d = p.groupBy("strand").agg(listed.alias("l")).select("strand", F.to_json(F.struct(
        F.transform("l", lambda e: F.lit(1.0)).alias("simMasses"),
        F.transform("l", lambda e: F.lit(0.5)).alias("radii"),
        F.transform("l", lambda e: F.array(e["p"]["x"], e["p"]["y"], e["p"]["z"]))
        .alias("coordinates"),
        F.transform(ij, lambda x: ((F.floor(x / n) * 7 + x % n) % 5).cast("double"))
        .alias("force constant matrix (ox units)"))).alias("line"))
    path = written(d.select(F.concat(F.lit("s"), "strand").alias("file"),
                            F.lit(0).alias("line_no"), "line"), ".json")
    return J.read_force_matrix(spark, path).select("file", "p1", C("p2").cast("bigint").alias("p2"),
                                                   "k", r(C("eq_dist")).alias("eq_dist"))


@query("src_cluster_topology", """WITH g AS (SELECT 'c' || (p_size % 4) AS file, p_partkey AS a,
    row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS cluster FROM part)
    SELECT DISTINCT file, cluster, a + d AS id, NULL AS ref_particle FROM g, range(4) t(d) UNION ALL
    SELECT file, NULL, a + (d // 2) * 3, a + d % 2 + 1 FROM g, range(3) t(d)""")
def _(spark, sf):
    part, k = A.read(spark, sf, "part"), C("p_partkey")
    # two groups of the reference's form on one line: a -> (a+1 a+2) and a+3 -> (a+1)
    text = F.concat(F.lit("["), k, F.lit(" -> ("), k + 1, F.lit(" "), k + 2, F.lit(") "), k + 3,
                    F.lit(" -> ("), k + 1, F.lit(")]"))
    path = written(lines(part, F.concat(F.lit("c"), C("p_size") % 4), [k], text))
    members, traps = U.read_cluster_topology(spark, path)
    return members.withColumn("ref_particle", F.lit(None).cast("bigint")).unionByName(
        traps.select("file", F.lit(None).cast("bigint").alias("cluster"),
                     C("particle").alias("id"), "ref_particle"))


__all__ = ["vec"]
