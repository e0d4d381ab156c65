"""Streaming and user-function queries: streams run to their end over a landing folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import adapters as A
from molframe.functions.geometry import r
from molframe.operators import observables as O
from molframe.plans.ordered import dense_index
from molframe.registry.core import query, r4
from molframe.session import new_folder
from molframe.streaming import frames as S

C = F.col


#: Fewest lines of one piece of the landed trajectory (frames go over the borders of pieces), and most pieces:
#: those of a longer trajectory are longer, as a writer that fills its files would leave them.
PIECE, PIECES = 500, 100


def landing(spark, sf) -> str:
    """Every frame of the coordinates as lines of one trajectory, cut into pieces of ``PIECE`` lines or more.

    A last piece with the header of one more frame, without monomers, ends the frame before it.
    """
    c = dense_index(A.coords(spark, sf).drop("len"), ["frame"], ["particle"], "_g", "row")
    line = F.concat_ws(" ", F.round(C("p.x") * 100).cast("bigint"), C("p.y").cast("bigint"), "frame",
                       F.lit("1 0 0 0 0 1 0 0 0 0 0 0"))
    frames = c.select("frame").distinct()
    frames = frames.unionByName(frames.agg((F.max("frame") + 1).alias("frame")))
    heads = frames.select("frame", F.posexplode(F.array(
        F.concat(F.lit("t = "), "frame"), F.lit("b = 50 50 50"), F.lit("E = 0 0 0"))).alias("row", "line"))
    lines = heads.unionByName(c.select("frame", (C("row") + 3).alias("row"), line.alias("line")))
    lines = dense_index(lines, [], ["frame", "row"], "_g", "pos")
    path = new_folder(spark, "landing")
    size = max(PIECE, -(-lines.count() // PIECES))
    (lines.select(F.lit("run").alias("file"), F.floor(C("pos") / size).alias("piece"), "pos", "line")
     .repartition("piece").sortWithinPartitions("piece", "pos").drop("pos")
     .write.partitionBy("file", "piece").text(path))
    return path


def arriving(spark, sf):
    return S.stream_lines(spark, landing(spark, sf), 7)


def finish(q):
    q.awaitTermination()


ROWS = """SELECT frame AS time, row_number() OVER (PARTITION BY frame ORDER BY particle) - 1 AS id,
    round(x * 100)::DOUBLE AS x, y, z FROM coords"""


@query("stm_frames", ROWS)
def _(spark, sf):
    out = new_folder(spark, "out")
    finish(S.observe(arriving(spark, sf), S.positions, out, new_folder(spark, "check")))
    d = spark.read.schema("time bigint, id bigint, x double, y double, z double").parquet(out)
    return d.select("time", "id", "x", "y", "z")


def centres(spark, sf) -> str:
    sel = A.coords(spark, sf).select(C("particle").alias("id")).distinct().filter(C("id") % 3 == 0)
    out = new_folder(spark, "centres")
    finish(S.observe(arriving(spark, sf), S.centre_of(sel, "thirds"), out,
                     new_folder(spark, "check")))
    return out


CENTRE = "selection string, file string, time bigint, x double, y double, z double"


@query("stm_centre", f"""SELECT time, {r4('avg(x)')} AS x, {r4('avg(y)')} AS y FROM ({ROWS})
    WHERE id % 3 = 0 GROUP BY time""")
def _(spark, sf):
    d = spark.read.schema(CENTRE).parquet(centres(spark, sf))
    return d.select("time", r(C("x")).alias("x"), r(C("y")).alias("y"))


@query("stm_distance", f"""WITH f AS ({ROWS}) SELECT a.time, a.id AS a, b.id AS b,
    {r4('sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))')} AS d FROM f a JOIN f b ON b.time = a.time
    AND b.id = a.id + 2 WHERE a.id % 4 = 0""")
def _(spark, sf):
    ids = A.coords(spark, sf).select(C("particle").alias("a")).distinct().filter(C("a") % 4 == 0)
    pairs = ids.select("a", (C("a") + 2).alias("b"))
    out = new_folder(spark, "distances")
    finish(S.observe(arriving(spark, sf), S.distances_of(pairs), out,
                     new_folder(spark, "check")))
    d = spark.read.schema("file string, time bigint, a bigint, b bigint, d double, nm double").parquet(out)
    return d.select("time", "a", "b", r(C("d")).alias("d"))


@query("stm_track", f"""WITH c AS (SELECT id % 3 AS selection, time AS frame, avg(x) AS x, avg(y) AS y,
    avg(z) AS z FROM ({ROWS}) GROUP BY ALL) SELECT CAST(selection AS VARCHAR) AS selection, frame,
    {r4('x')} AS x, {r4('''sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w)
    * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w))''')} AS step FROM c
    WINDOW w AS (PARTITION BY selection ORDER BY frame)""")
def _(spark, sf):
    ids = A.coords(spark, sf).select(C("particle").alias("id")).distinct()
    out = new_folder(spark, "centres")
    finish(S.observe(arriving(spark, sf), S.centres_of(ids.select(
        (C("id") % 3).cast("string").alias("selection"), "id")), out, new_folder(spark, "check")))
    stored = spark.read.schema(CENTRE).parquet(out)
    # a replayed file gives its frames again
    d = S.track(stored.unionByName(stored.filter("time % 7 = 0")))
    return d.select("selection", "frame", r(C("x")).alias("x"), r(C("step")).alias("step"))


def span(frames):
    """Size and extent of each selection in each frame."""
    return frames.groupBy("selection", "frame").agg(
        F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("span"))


@query("udf_observable", f"""SELECT CAST(particle % 3 AS VARCHAR) AS selection, frame, count(*) AS n,
    {r4('max(x) - min(x)')} AS span FROM coords GROUP BY particle % 3, frame""")
def _(spark, sf):
    c = A.coords(spark, sf).select(C("particle").alias("id"), "frame", "p.x")
    sel = c.select("id").distinct().select((C("id") % 3).cast("string").alias("selection"), "id")
    O.register_observable("span", span)
    d = O.observe("span", O.selected(c, sel))
    return d.select("selection", "frame", "n", r(C("span")).alias("span"))
