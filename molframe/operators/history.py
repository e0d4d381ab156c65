"""Projects and their commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe.plans.ordered import dense_index
from molframe.session import settle


def _made(c: str = "created"):
    return F.coalesce(F.col(c), F.lit(0))


def latest(commits: DataFrame) -> DataFrame:
    """Newest commit per project, the higher id on equal dates."""
    return commits.groupBy("project").agg(
        F.max_by("commit", F.struct(_made(), F.col("commit"))).alias("commit"),
        F.max(_made()).alias("created"))


def chronological(commits: DataFrame) -> DataFrame:
    return commits.orderBy("project", _made(), "commit")


def page(projects: DataFrame, number: int, size: int = 6) -> DataFrame:
    """Page ``number`` (from 0), newest first."""
    return projects.orderBy(F.desc("created"), "project").offset(number * size).limit(size)


def next_names(commits: DataFrame) -> DataFrame:
    """Next default name per (project, base): the highest numeric suffix plus one."""
    base = F.regexp_extract("name", r"^(.*?)(?: (\d+))?$", 1)
    number = F.regexp_extract("name", r" (\d+)$", 1).try_cast("bigint")
    return (commits.groupBy("project", base.alias("base"))
            .agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n"))
            .select("project", "base", F.concat_ws(" ", "base", "n").alias("next_name")))


def sync_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local / remote / synced / push / pull per project by commit counts, and whether a remote
    commit is missing here."""
    count = lambda d, n: d.groupBy("project").agg(F.count(F.lit(1)).alias(n))
    missing = (remote.join(local.select("project", "commit"), ["project", "commit"], "left_anti")
               .select("project").distinct().withColumn("stale", F.lit(True)))
    l, r = F.col("n_local"), F.col("n_remote")
    return (count(local, "n_local").join(count(remote, "n_remote"), "project", "full_outer")
            .join(missing, "project", "left")
            .select("project", F.when(r.isNull(), "local").when(l.isNull(), "remote")
                    .when(l > r, "push").when(l < r, "pull").otherwise("synced").alias("status"),
                    F.coalesce("stale", F.lit(False)).alias("stale")))


def missing_commits(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local history plus the remote commits whose id is absent."""
    return local.unionByName(remote.join(local.select("project", "commit"),
                                         ["project", "commit"], "left_anti"))


def remote_only(local: DataFrame, remote: DataFrame) -> DataFrame:
    """All local projects, then remote ones without a local twin."""
    here = local.select("project").distinct().withColumn("origin", F.lit("local"))
    there = (remote.select("project").distinct().join(here, "project", "left_anti")
             .withColumn("origin", F.lit("remote")))
    return here.unionByName(there)


def branches(commits: DataFrame) -> DataFrame:
    """project, branch, depth (0 = root), commit: one branch per leaf, the first leaf is main.

    Pointer doubling: round k adds to every branch the 2^k-th ancestors of the commits it has
    so far, so a history of depth n takes log2(n) joins on (project, commit), which is unique.
    """
    node = commits.select("project", "commit", "parent")
    parents = node.select("project", F.col("parent").alias("commit")).dropna().distinct()
    leaves = node.join(parents, ["project", "commit"], "left_anti").select("project", "commit")
    rows = settle(dense_index(leaves, ["project"], ["commit"], pos_col="ord").select(
        "project", "ord", "commit", F.lit(0).cast("bigint").alias("back")))
    jump = settle(node.filter(F.col("parent").isNotNull())
                  .select("project", "commit", F.col("parent").alias("to")))
    step = 1
    while not jump.isEmpty():
        further = rows.join(jump, ["project", "commit"]).select(
            "project", "ord", F.col("to").alias("commit"), (F.col("back") + step).alias("back"))
        rows = settle(rows.unionByName(further))
        jump = settle(jump.join(jump.select("project", F.col("commit").alias("to"),
                                            F.col("to").alias("_to")), ["project", "to"])
                      .select("project", "commit", F.col("_to").alias("to")))
        step *= 2
    top = rows.groupBy("project", "ord").agg(F.max("back").alias("_top"))
    name = F.when(F.col("ord") == 0, "main").otherwise(
        F.concat(F.lit("branch "), F.col("ord") + 1))
    return rows.join(top, ["project", "ord"]).select(
        "project", name.alias("branch"), (F.col("_top") - F.col("back")).alias("depth"), "commit")
