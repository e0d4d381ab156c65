"""Spring networks: Hessian, fluctuations and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: force unit in simulation terms.
SIM_FORCE = 0.05709


def hessian(edges: DataFrame, particles: DataFrame, by: list[str]) -> DataFrame:
    """Mass-weighted Hessian as sparse entries: by, row, col, value.

    ``edges``: by, i, j, k; ``particles``: by, id, p, mass. Each edge gives 36 entries, which
    are summed with a map-side combine.
    """
    side = lambda n: particles.select(*by, F.col("id").alias(n), F.col("p").alias("_p" + n),
                                      F.col("mass").alias("_m" + n))
    e = edges.join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
    d = [F.col("_pj")[a] - F.col("_pi")[a] for a in "xyz"]
    e = e.select(*by, "i", "j", "k", "_mi", "_mj", F.array(*d).alias("_d"))
    d2 = sum(F.get("_d", F.lit(n)) * F.get("_d", F.lit(n)) for n in range(3))
    e = e.withColumn("_w", F.col("k") / d2)
    entries = []
    for a in range(3):
        for b in range(3):
            v = F.col("_w") * F.get("_d", F.lit(a)) * F.get("_d", F.lit(b))
            mixed = -v / F.sqrt(F.col("_mi") * F.col("_mj"))
            for r, c, x in (("i", "i", v / F.col("_mi")), ("j", "j", v / F.col("_mj")),
                            ("i", "j", mixed), ("j", "i", mixed)):
                entries.append(F.named_struct(F.lit("row"), F.col(r) * 3 + a, F.lit("col"),
                                              F.col(c) * 3 + b, F.lit("value"), x))
    return (e.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")
            .groupBy(*by, "row", "col").agg(F.sum("value").alias("value")))


def fit_network(msf: DataFrame, target: DataFrame, by: str = "structure"
                ) -> tuple[DataFrame, DataFrame]:
    """(fits: by, m, k, sim_k; structures whose target has another length).

    ``target``: by, id, y. Line through the origin y = m x; k = 1 / m.
    """
    n = lambda d, c: d.groupBy(by).agg(F.count(F.lit(1)).alias(c))
    sizes = n(msf, "_n").join(n(target, "_t"), by, "full_outer")
    equal = F.coalesce(F.col("_n") == F.col("_t"), F.lit(False))
    both = msf.join(target, [by, "id"]).join(sizes.filter(equal).select(by), by, "left_semi")
    m = F.sum(F.col("msf") * F.col("y")) / F.sum(F.col("msf") * F.col("msf"))
    fits = both.groupBy(by).agg(m.alias("m")).withColumn("k", 1 / F.col("m")).withColumn(
        "sim_k", F.col("k") / SIM_FORCE)
    return fits, sizes.filter(~equal).select(by)
