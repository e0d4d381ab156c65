"""Aggregations over strands, centres, residues, plates and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import flat, r
from molframe.operators import centres as K, history as H, plates as P, residues as R, strands as S
from molframe.operators.sequences import PART, sequences
from molframe.registry.core import query, r4

C = F.col
BOX = 50.0


def avg_xyz(places=4, src="p"):
    return ", ".join(f"{r4(f'avg({src}{a})', places)} AS {a}" for a in "xyz")


@query("agg_sequence", f"""SELECT strand, pos // {PART} AS part, string_agg(base, '' ORDER BY pos)
    AS sequence FROM mono GROUP BY ALL""")
def _(spark, sf):
    return sequences(A.monomers(spark, sf))


@query("agg_selection_sequence", f"""SELECT strand, pos // {PART} AS part,
    string_agg(base, '' ORDER BY pos) AS sequence FROM mono WHERE color = 4 GROUP BY ALL""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    return S.selection_sequence(m, m.filter(C("color") == 4))


@query("agg_strand_length", """SELECT strand % 3 AS system, strand, count(*) AS length,
    CAST(sum(count(*)) OVER (PARTITION BY strand % 3) AS BIGINT) AS system_length FROM mono
    GROUP BY strand""")
def _(spark, sf):
    return S.lengths(A.monomers(spark, sf).withColumn("system", C("strand") % 3))


@query("agg_length_groups", """SELECT length, count(*) OVER (PARTITION BY length) AS n_strands,
    strand FROM (SELECT strand, count(*) AS length FROM mono GROUP BY strand)""")
def _(spark, sf):
    return S.length_groups(A.monomers(spark, sf))


@query("agg_sequence_counts", """SELECT sequence, count(*) AS n, min(strand) AS strand FROM (
    SELECT strand * 1000000000 + pos // 4 AS strand, string_agg(base, '' ORDER BY pos) AS sequence
    FROM mono GROUP BY strand, pos // 4) GROUP BY sequence""")
def _(spark, sf):
    # words of four letters as strands, so that sequences repeat
    m = A.monomers(spark, sf).withColumn("strand", C("strand") * 1000000000 + F.floor(C("pos") / 4))
    return S.sequence_counts(m).select("sequence", "n", "strand")


@query("agg_is_circular", """SELECT strand, strand % 4 = 1 AS circular FROM mono GROUP BY strand""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    closed = F.when(C("strand") % 4 == 1, F.coalesce("n3", C("id") - C("len") + 1))
    return S.circular(m.withColumn("n3", F.coalesce(closed, "n3")))


@query("agg_scaffold", """SELECT structure, arg_max(strand, len * 1000000000 - strand) AS strand,
    max(len) AS length FROM strands GROUP BY structure""")
def _(spark, sf):
    return S.scaffold(A.monomers(spark, sf))


@query("agg_contains_u", """SELECT structure, bool_or(class = 'RNA' AND base = 'T') AS is_rna
    FROM mono GROUP BY structure""")
def _(spark, sf):
    base = F.when((C("class") == "RNA") & (C("base") == "T"), "u").otherwise(C("base"))
    return S.contains_u(A.monomers(spark, sf).withColumn("base", base))


@query("agg_strand_centre", f"SELECT strand, {avg_xyz()} FROM mono GROUP BY strand")
def _(spark, sf):
    return K.centre(A.monomers(spark, sf), ["strand"]).select("strand", *flat(C("p")))


@query("agg_system_centre", f"SELECT structure, {avg_xyz()} FROM mono GROUP BY structure")
def _(spark, sf):
    return K.centre(A.monomers(spark, sf), ["structure"]).select("structure", *flat(C("p")))


@query("agg_selection_centre", f"""SELECT frame, {avg_xyz(8, '')} FROM coords
    WHERE particle % 3 = 1 GROUP BY frame""")
def _(spark, sf):
    c = A.coords(spark, sf)
    chosen = c.filter(C("particle") % 3 == 1).select("particle")
    return K.selection_centre(c, chosen, "particle", ["frame"]).select("frame", *flat(C("p"), "", 8))


BB = ", ".join(f"""avg({a} + 0.4*a1{a}) AS o{a}, avg({a} - (0.34*a1{a} + 0.3408*{e})) AS b{a}"""
               for a, e in zip("xyz", ("(a1y*a3z - a1z*a3y)", "(a1z*a3x - a1x*a3z)",
                                       "(a1x*a3y - a1y*a3x)")))
BO = "sqrt((bx-ox)*(bx-ox) + (by_-oy)*(by_-oy) + (bz-oz)*(bz-oz))"


@query("agg_mean_orientation", f"""SELECT strand, {", ".join(
    f"{r4('o' + a)} AS o{a}" for a in "xyz")}, {", ".join(
    f"{r4(f'(b{s}-o{a}) / {BO}')} AS d{a}" for a, s in zip("xyz", ("x", "y_", "z")))}
    FROM (SELECT strand, {BB.replace(' AS by', ' AS by_')} FROM pts GROUP BY strand)""")
def _(spark, sf):
    p = A.points(spark, sf).withColumn("class", F.lit("DNA"))
    return K.mean_orientation(p, ["strand"]).select(
        "strand", *flat(C("origin"), "o"), *flat(C("direction"), "d"))


@query("agg_axis_a3", f"""SELECT strand, {", ".join(
    f"{r4(f's{a} / sqrt(sx*sx + sy*sy + sz*sz)')} AS {a}" for a in "xyz")} FROM (
    SELECT p.strand, {", ".join(f"avg(a3{a} * CASE WHEN a3x*fx + a3y*fy + a3z*fz < 0 THEN -1 ELSE 1 END) AS s{a}" for a in "xyz")}
    FROM pts p JOIN (SELECT strand, arg_min(a3x, pos) AS fx, arg_min(a3y, pos) AS fy,
    arg_min(a3z, pos) AS fz FROM pts GROUP BY strand) f ON f.strand = p.strand GROUP BY p.strand)""")
def _(spark, sf):
    return K.mean_a3(A.points(spark, sf), ["strand"]).select("strand", *flat(C("a3")))


def ring(a):
    k = f"(2 * pi() / {BOX})"
    return f"(atan2(-avg(sin({a} * {k})), -avg(cos({a} * {k}))) + pi()) / {k}"


@query("agg_periodic_centre", f"""SELECT frame, {", ".join(
    f"{r4(ring(a))} AS {a}" for a in "xy")} FROM coords GROUP BY frame""")
def _(spark, sf):
    return K.periodic_centre(A.coords(spark, sf), ["frame"], BOX).select(
        "frame", *flat(C("p"))[:2])


def wrap(e, goal=25.0):
    s = f"({e}) + {25.0 - goal}"
    return f"({s}) - {BOX} * floor(({s}) / {BOX}) - {25.0 - goal}"


@query("agg_wrap_box", f"""SELECT id, {", ".join(f"{r4(wrap('p' + a), 6)} AS m{a}" for a in "xyz")},
    {", ".join(f"{r4(f'p{a} + ({wrap(f"c{a}", 0)}) - c{a}', 6)} AS s{a}" for a in "xyz")}
    FROM mono m JOIN (SELECT strand, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM mono
    GROUP BY strand) c ON c.strand = m.strand""")
def _(spark, sf):
    m = A.monomers(spark, sf)
    one = K.wrap_monomers(m, BOX).select("id", *flat(C("p"), "m", 6))
    whole = K.wrap_strands(m, ["strand"], BOX, 0.0).select("id", *flat(C("p"), "s", 6))
    return one.join(whole, "id")


@query("agg_centre_frames", f"""SELECT particle, frame, {", ".join(
    f"{r4(wrap(f'{a} + 10 - c{a}', 10.0))} AS {a}" for a in "xy")} FROM coords c JOIN (
    SELECT frame AS f, {", ".join(f"{ring(a)} AS c{a}" for a in "xy")} FROM coords GROUP BY frame)
    ON f = frame""")
def _(spark, sf):
    return K.centre_frames(A.coords(spark, sf), ["frame"], BOX, 10.0).select(
        "particle", "frame", *flat(C("p"))[:2])


@query("agg_bounds", f"""SELECT structure, {", ".join(f'''{r4(f"""CASE WHEN max(p{a}) - min(p{a}) < 2
    THEN 2.5 ELSE max(p{a}) - min(p{a}) END""")} AS {a}''' for a in "xy")}, 2.5::DOUBLE AS z FROM mono
    GROUP BY structure""")
def _(spark, sf):
    flatter = A.monomers(spark, sf).withColumn("p", C("p").withField("z", C("p.z") / 10))
    return K.bounds(flatter, ["structure"]).select(
        "structure", *[r(C(a)).alias(a) for a in "xyz"])


TRIPLES = ", ".join(f"('{R.RING[i]}', '{R.RING[j]}', '{R.RING[k]}')" for i, j, k in R.TRIPLES)


def d3(u, v):
    return "({0}x*{1}x + {0}y*{1}y + {0}z*{1}z)".format(u, v)


@query("agg_residue_frames", f"""WITH tri(ta, tb, tc) AS (VALUES {TRIPLES}),
    seg AS (SELECT p.residue, {", ".join(f"p.{x}-q.{x} AS v{x}, p.{x}-s.{x} AS w{x}" for x in "xyz")}
        FROM tri JOIN atoms p ON p.name = ta JOIN atoms q ON q.name = tb AND q.residue = p.residue
        JOIN atoms s ON s.name = tc AND s.residue = p.residue),
    nrm AS (SELECT residue, vy*wz - vz*wy AS nx, vz*wx - vx*wz AS ny, vx*wy - vy*wx AS nz,
        {d3('v', 'w')} / sqrt({d3('v', 'v')} * {d3('w', 'w')}) AS cosine FROM seg),
    al AS (SELECT residue, {", ".join(f"sum(CASE WHEN name = 'C5''' THEN {x} WHEN name = 'C3''' THEN -{x} ELSE 0 END) AS t{x}" for x in "xyz")} FROM atoms GROUP BY residue),
    a3 AS (SELECT n.residue, {", ".join(f"sum(n{x} / sqrt({d3('n', 'n')}) * CASE WHEN {d3('n', 't')} < 0 THEN -1 ELSE 1 END) AS s{x}" for x in "xyz")}
        FROM nrm n JOIN al ON al.residue = n.residue WHERE abs(cosine) > 0.01 GROUP BY n.residue),
    a1 AS (SELECT residue, any_value(letter) AS letter, avg(b) AS b, {", ".join(f"avg({x}) AS p{x}, sum({x} * CASE WHEN letter IN ('C', 'T') THEN CASE name WHEN 'N3' THEN 1 WHEN 'C6' THEN -1 WHEN 'C2' THEN 1 WHEN 'N1' THEN -1 WHEN 'C4' THEN 1 WHEN 'C5' THEN -1 ELSE 0 END ELSE CASE name WHEN 'N1' THEN 1 WHEN 'C4' THEN -1 WHEN 'C2' THEN 1 WHEN 'N3' THEN -1 WHEN 'C6' THEN 1 WHEN 'C5' THEN -1 ELSE 0 END END) AS u{x}" for x in "xyz")} FROM atoms GROUP BY residue)
    SELECT a1.residue, letter, {r4('b')} AS b, {", ".join(f"{r4('p' + x)} AS p_{x}, {r4(f'u{x} / sqrt({d3("u", "u")})')} AS a1_{x}, {r4(f's{x} / sqrt({d3("s", "s")})')} AS a3_{x}" for x in "xyz")}
    FROM a1 JOIN a3 ON a3.residue = a1.residue""")
def _(spark, sf):
    d = R.nucleotide_frames(A.atoms(spark, sf), ["residue"])
    return d.select("residue", "letter", r(C("b")).alias("b"), *flat(C("p"), "p_"),
                    *flat(C("a1"), "a1_"), *flat(C("a3"), "a3_"))


@query("agg_residue_frames_protein", f"""WITH s AS (SELECT residue, any_value(letter) AS letter,
    max(CASE WHEN name = 'CA' THEN b END) AS b, {", ".join(f"max(CASE WHEN name = 'CA' THEN {x} END) AS p{x}, sum(CASE WHEN name NOT IN ('N', 'C', 'O', 'H', 'CA') THEN {x} ELSE 0 END) AS s{x}" for x in "xyz")}
    FROM residue_atoms GROUP BY residue),
    d AS (SELECT residue, letter, b, px, py, pz, {", ".join(f"s{x} / sqrt({d3('s', 's')}) - p{x} AS d{x}" for x in "xyz")} FROM s),
    u AS (SELECT residue, letter, b, px, py, pz, {", ".join(f"d{x} / sqrt({d3('d', 'd')}) AS u{x}" for x in "xyz")} FROM d)
    SELECT residue, letter, {r4('b')} AS b, {", ".join(f"{r4('p' + x)} AS p_{x}, {r4('u' + x)} AS a1_{x}" for x in "xyz")},
    {r4("CASE WHEN ux < 0.99 THEN 0 ELSE -uz END")} AS a3_x, {r4("CASE WHEN ux < 0.99 THEN uz ELSE 0 END")} AS a3_y,
    {r4("CASE WHEN ux < 0.99 THEN -uy ELSE ux END")} AS a3_z FROM u""")
def _(spark, sf):
    d = R.protein_frames(A.atoms(spark, sf, A.RESIDUE_ATOMS), ["residue"])
    return d.select("residue", "letter", r(C("b")).alias("b"), *flat(C("p"), "p_"),
                    *flat(C("a1"), "a1_"), *flat(C("a3"), "a3_"))


KINDS = [["LYS", "ALA", "GLY"], ["DA", "DT", "DG3"], ["A", "U", "G5"], ["DA", "A", "C"],
         ["DA", "U", "C"], ["ALA", "DC", "GLY"], ["HOH", "XXX", "ZZ"]]


@query("agg_chain_class", """SELECT p_brand AS chain, CASE CAST(substr(p_brand, 7) AS INT) % 7
    WHEN 0 THEN 'pro' WHEN 1 THEN 'dna' WHEN 2 THEN 'rna' WHEN 3 THEN 'dna' WHEN 4 THEN 'rna'
    WHEN 5 THEN 'mixed' END AS class FROM part GROUP BY p_brand""")
def _(spark, sf):
    kinds = F.array(*[F.array(*[F.lit(n) for n in k]) for k in KINDS])
    number = F.substring("p_brand", 7, 9).cast("int") % 7
    res = A.read(spark, sf, "part").select(
        C("p_brand").alias("chain"),
        F.get(F.get(kinds, number), (C("p_partkey") % 3).cast("int")).alias("residue"))
    return R.chain_class(res, ["chain"])


OLIGOS = """SELECT p_partkey AS strand, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' ' || p_size
    ELSE p_name END AS sequence FROM part"""


def oligos(spark, sf):
    name = F.when(C("p_partkey") % 9 == 0, F.concat_ws(" ", "p_name", "p_size"))
    return A.read(spark, sf, "part").select(
        C("p_partkey").alias("strand"), F.coalesce(name, "p_name").alias("sequence"))


@query("jn_plate_lookup", f"""SELECT o.strand, o.sequence, p.plate, p.well FROM ({OLIGOS}) o
    LEFT JOIN plates p ON p.sequence = o.sequence""")
def _(spark, sf):
    return P.lookup(oligos(spark, sf), A.plates(spark, sf)).select(
        "strand", "sequence", "plate", "well")


@query("jn_orphans", f"""SELECT strand, sequence FROM ({OLIGOS}) o WHERE length(sequence) < 12
    AND sequence NOT IN (SELECT sequence FROM plates)""")
def _(spark, sf):
    return P.orphans(oligos(spark, sf), A.plates(spark, sf), 12).select("strand", "sequence")


@query("agg_plate_report", f"""SELECT h.plate, h.well, CAST(NULL AS BIGINT) AS strand, count(*) AS n
    FROM ({OLIGOS}) o JOIN (SELECT sequence, min({{'plate': plate, 'well': well}}) AS h FROM plates
    GROUP BY 1) f ON f.sequence = o.sequence GROUP BY ALL UNION ALL SELECT NULL, NULL, strand, 1
    FROM ({OLIGOS}) o WHERE sequence NOT IN (SELECT sequence FROM plates)""")
def _(spark, sf):
    return P.full_report(oligos(spark, sf), A.plates(spark, sf))


@query("src_plate_db", """WITH h AS (SELECT * FROM plates WHERE CAST(substr(plate, 7) AS INT) % 2 = 0)
    SELECT plate, sequence, well, 'kept' AS origin FROM h UNION ALL
    SELECT plate, sequence, upper(well), 'new' FROM plates
    WHERE plate NOT IN (SELECT plate FROM h)""")
def _(spark, sf):
    from molframe.sources.json_files import plate_registry
    from molframe.registry.files import written
    p = A.plates(spark, sf)
    # one registry file per first letter of the sequence; its wells differ from the stored ones
    wells = F.map_from_entries(F.collect_list(F.struct("sequence", F.upper("well"))))
    per = p.groupBy("plate", F.substring("sequence", 1, 1).alias("file")).agg(wells.alias("w"))
    docs = per.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct("plate", "w")))).alias("line"))
    incoming = plate_registry(spark, written(docs.withColumn("line_no", F.lit(0)), ".json"))
    here = p.filter(F.substring("plate", 7, 9).cast("int") % 2 == 0)
    return P.import_plates(here.withColumn("origin", F.lit("kept")),
                           incoming.withColumn("origin", F.lit("new"))).select(
        "plate", "sequence", "well", "origin")


@query("agg_index_average", f"""SELECT p_size AS grp, {r4("avg(l_extendedprice)", 3)} AS value
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_size""")
def _(spark, sf):
    values = A.read(spark, sf, "lineitem").select(C("l_partkey").alias("id"),
                                                  C("l_extendedprice").alias("value"))
    groups = A.read(spark, sf, "part").select(C("p_size").alias("grp"), C("p_partkey").alias("id"))
    return S.index_average(values, groups).select("grp", r(C("value"), 3).alias("value"))


def xy(spark, sf):
    return A.read(spark, sf, "lineitem").select("l_linenumber", C("l_quantity").alias("x"),
                                                C("l_extendedprice").alias("y"))


@query("agg_least_squares", f"""SELECT l_linenumber, {r4("regr_slope(l_extendedprice, l_quantity)")}
    AS m, {r4("regr_intercept(l_extendedprice, l_quantity)")} AS b FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return S.least_squares(xy(spark, sf), ["l_linenumber"]).select(
        "l_linenumber", r(C("m")).alias("m"), r(C("b")).alias("b"))


@query("agg_least_squares_origin", f"""SELECT l_linenumber, {r4('''sum(l_quantity * l_extendedprice)
    / sum(l_quantity * l_quantity)''')} AS m FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return S.least_squares_origin(xy(spark, sf), ["l_linenumber"]).select(
        "l_linenumber", r(C("m")).alias("m"))


CELL = 2.0 / 8.518


@query("agg_grid_mass", f"""WITH lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts),
    c AS (SELECT id, x, y, z, {", ".join(f"CAST(floor(({a} - l{a}) / ({CELL!r}::DOUBLE)) AS BIGINT) AS c{a}" for a in "xyz")} FROM pts, lo)
    SELECT cx, cy, cz, id, count(*) OVER w AS mass, {", ".join(f"{r4(f'avg({a}) OVER w')} AS {a}" for a in "xyz")}
    FROM c WINDOW w AS (PARTITION BY cx, cy, cz)""")
def _(spark, sf):
    cells, members = S.grid_mass(A.points(spark, sf), 2.0)
    cells = cells.select("cx", "cy", "cz", "mass", *[r(C(a)).alias(a) for a in "xyz"])
    return members.join(cells, ["cx", "cy", "cz"])


@query("agg_latest_commit", """SELECT project, arg_max(commit, coalesce(created, 0) * 100000
    + commit) AS commit, max(coalesce(created, 0)) AS created FROM commits GROUP BY project""")
def _(spark, sf):
    return H.latest(A.commits(spark, sf))


LOCAL, REMOTE = "project % 7 <> 1 AND NOT (project % 5 = 2 AND commit % 2 = 1)", """project % 6 <> 2
    AND NOT (project % 4 = 3 AND commit > 2)"""


def both(spark, sf):
    c = A.commits(spark, sf)
    return c.filter(LOCAL), c.filter(REMOTE)


@query("agg_sync_status", f"""WITH l AS (SELECT project, count(*) AS n FROM commits WHERE {LOCAL}
    GROUP BY 1), q AS (SELECT project, count(*) AS n FROM commits WHERE {REMOTE} GROUP BY 1),
    s AS (SELECT DISTINCT project FROM (SELECT project, commit FROM commits WHERE {REMOTE}
    EXCEPT SELECT project, commit FROM commits WHERE {LOCAL}))
    SELECT project, CASE WHEN q.n IS NULL THEN 'local' WHEN l.n IS NULL THEN 'remote'
    WHEN l.n > q.n THEN 'push' WHEN l.n < q.n THEN 'pull' ELSE 'synced' END AS status,
    project IN (SELECT project FROM s) AS stale FROM l FULL JOIN q USING (project)""")
def _(spark, sf):
    return H.sync_status(*both(spark, sf))


@query("srt_commits", "SELECT project, commit, coalesce(created, 0) AS created FROM commits")
def _(spark, sf):
    return H.chronological(A.commits(spark, sf)).select(
        "project", "commit", F.coalesce("created", F.lit(0)).alias("created"))


@query("srt_page", """SELECT project, created FROM (SELECT project, max(coalesce(created, 0))
    AS created FROM commits GROUP BY project) ORDER BY created DESC, project LIMIT 6 OFFSET 6""")
def _(spark, sf):
    return H.page(H.latest(A.commits(spark, sf)), 1).select("project", "created")


@query("win_commit_name", """SELECT project, base, base || ' ' || (coalesce(max(TRY_CAST(
    regexp_extract(name, ' (\\d+)$', 1) AS BIGINT)), 0) + 1) AS next_name FROM (SELECT project, name,
    regexp_replace(name, ' \\d+$', '') AS base FROM commits) GROUP BY project, base""")
def _(spark, sf):
    return H.next_names(A.commits(spark, sf))


@query("set_missing_commits", f"""SELECT project, commit, name FROM commits WHERE ({LOCAL})
    OR ({REMOTE})""")
def _(spark, sf):
    return H.missing_commits(*both(spark, sf)).select("project", "commit", "name")


@query("set_remote_only", f"""SELECT DISTINCT project, 'local' AS origin FROM commits WHERE {LOCAL}
    UNION ALL SELECT DISTINCT project, 'remote' FROM commits WHERE {REMOTE} AND project NOT IN
    (SELECT project FROM commits WHERE {LOCAL})""")
def _(spark, sf):
    return H.remote_only(*both(spark, sf))


@query("grf_branches", """WITH RECURSIVE leaf AS (SELECT project, commit, row_number() OVER
    (PARTITION BY project ORDER BY commit) AS n FROM commits c WHERE NOT EXISTS (SELECT 1
    FROM commits k WHERE k.project = c.project AND k.parent = c.commit)),
    up(project, n, commit, back) AS (SELECT project, n, commit, 0 FROM leaf UNION ALL
    SELECT u.project, u.n, c.parent, u.back + 1 FROM up u JOIN commits c ON c.project = u.project
    AND c.commit = u.commit WHERE c.parent IS NOT NULL)
    SELECT project, CASE WHEN n = 1 THEN 'main' ELSE 'branch ' || n END AS branch,
    CAST(max(back) OVER (PARTITION BY project, n) - back AS BIGINT) AS depth, commit FROM up""")
def _(spark, sf):
    return H.branches(A.commits(spark, sf))
