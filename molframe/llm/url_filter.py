"""URL filter: path rules first, then exact membership in a list by a Bloom filter cascade.

Level 1 encodes the listed keys. The unlisted keys of the corpus that pass it are its false
positives, and level 2 encodes those; level 3 encodes the listed keys that pass level 2, and so on
until no key is left. A key is listed if the first level that rejects it has an even number.
Because the complete key universe took part, the answer is exact for every key of the corpus, and
pages are judged in one scan without a join.

The filters are broadcast in groups of at most ``BROADCAST_BYTES``. Listed keys are dealt over
shards of about ``SHARD_KEYS`` by hash; a longer list means more groups, each with its own scan of
the rows that its shards cover, not a larger broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from molframe.llm.core import LOWER, UPPER, lower_ascii, query, table
from molframe.session import materialise

SHARD_KEYS = 2_000_000
BROADCAST_BYTES = 64 << 20
MAX_RULES = 1_000
#: False positive rate of each level.
RATE = 0.1

#: Rules of the registered query (fixed values of its contract): host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Host labels whose pages make up the list of the registered query.
LISTED_LABELS = ["cheap-pills", "free-casino", "spam-farm", "tionsh", "tiontion"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = lower_ascii(F.coalesce(F.regexp_extract(url, shape, 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's. At most
    ``MAX_RULES``: they are compiled into one expression.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules can be compiled; put plain keys on the list")
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h1, h2, level: int, n_bits: int, hashes: int) -> np.ndarray:
    a = _mix(h1.astype(np.uint64) + np.uint64(2 * level + 1))
    b = _mix(h2.astype(np.uint64) + np.uint64(2 * level + 2)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(n_bits) for i in range(hashes)])


def _passes(h1, h2, level: int, bits: np.ndarray, hashes: int) -> np.ndarray:
    at = _positions(h1, h2, level, len(bits) * 64, hashes)
    hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return hit.all(axis=0)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), F.col(key)).alias("h2"))


def _level(members: DataFrame, level: int, count: int) -> tuple[np.ndarray, int]:
    """Bits of one level: set positions are combined in each task, then by word."""
    n_bits = 64 * max(1, math.ceil(count * -math.log(RATE) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(RATE)))

    def set_bits(batches):
        for pdf in batches:
            at = np.unique(_positions(pdf.h1.to_numpy(), pdf.h2.to_numpy(), level, n_bits, hashes))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "mask": mask.view(np.int64)})

    rows = (members.mapInPandas(set_bits, "word long, mask long")
            .groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas())
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return bits, hashes


def build_cascade(universe: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Levels of the cascade for ``universe``: h1, h2, listed (one row per key).

    A level is built by a job that returns its bits, about five per member; members shrink to
    a tenth every other level, and the loop ends when none is left.
    """
    spark = universe.sparkSession
    own = universe.filter("listed").select("h1", "h2")
    other = universe.filter("NOT listed").select("h1", "h2")
    levels: list[tuple[np.ndarray, int]] = []
    count = own.count()
    while count:
        level = len(levels)
        bits, hashes = _level(own, level, count)
        levels.append((bits, hashes))
        sent = spark.sparkContext.broadcast(bits)

        @F.pandas_udf("boolean")
        def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(_passes(h1.to_numpy(), h2.to_numpy(), level, sent.value, hashes))

        own, other = materialise(other.filter(passes("h1", "h2")), "cascade"), own
        count = own.count()
    return levels


def shards_for(listed: int, others: int) -> int:
    """Shards of at most ``SHARD_KEYS`` members in any level: the first holds the listed keys, the
    second the share ``RATE`` of all others, later ones a share of these."""
    return max(1, math.ceil((listed + RATE * others) / SHARD_KEYS))


def listed_in(df: DataFrame, key: str, listed: DataFrame, name: str = "listed") -> DataFrame:
    """``df`` with boolean ``name``: whether ``key`` is one of the keys of ``listed``.

    ``listed``: one column of that name, any number of rows; null is never listed. Keys are
    compared by 128 bits of hash. Repeated keys and rows count once; an empty list lists nothing.
    """
    spark = df.sparkSession
    on = _keys(listed.filter(F.col(key).isNotNull()), key).withColumn("listed", F.lit(1))
    all_keys = _keys(df.filter(F.col(key).isNotNull()), key).withColumn("listed", F.lit(0))
    universe = materialise(on.unionByName(all_keys).groupBy("h1", "h2").agg(
        (F.max("listed") == 1).alias("listed")), "universe")
    counts = dict(universe.groupBy("listed").count().collect())
    shards = shards_for(counts.get(True, 0), counts.get(False, 0))
    per_group = max(1, BROADCAST_BYTES // int(SHARD_KEYS * 1.2))
    hashed = df.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(1), F.col(key))})
    shard_of = lambda h: F.pmod(h, F.lit(shards))
    out = None
    for low in range(0, shards, per_group):
        own = range(low, min(low + per_group, shards))
        cascades = spark.sparkContext.broadcast({s: build_cascade(
            universe.filter(shard_of(F.col("h2")) == s)) for s in own})

        @F.pandas_udf("boolean")
        def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
            a, b = h1.to_numpy(), h2.to_numpy()
            found = np.zeros(len(a), bool)
            for s, levels in cascades.value.items():
                at = np.flatnonzero(b % shards == s)
                for i, (bits, hashes) in enumerate(levels):
                    ok = _passes(a[at], b[at], i, bits, hashes)
                    found[at[~ok]] = i % 2 == 1
                    at = at[ok]
                found[at] = len(levels) % 2 == 1
            return pd.Series(found)

        part = hashed.filter(shard_of(F.col("_h2")).between(own[0], own[-1])) if shards > 1 else hashed
        part = part.withColumn(name, F.col(key).isNotNull() & member("_h1", "_h2")).drop("_h1", "_h2")
        out = part if out is None else out.unionByName(part)
    return out


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per row of ``pages``.

    ``listed`` has a column ``key`` (host + path). The verdict is the rule's; where no rule fits,
    ``block`` for a listed key and ``allow`` otherwise. A null url has empty host and path.
    """
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("key", F.concat("host", "path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return listed_in(split, "key", listed).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed")


_ORACLE = f"""
WITH s AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) AS r(h, p, v)),
l AS (SELECT DISTINCT host || path AS key FROM s
  WHERE len(list_intersect(string_split(host, '.'), {LISTED_LABELS})) > 0),
f AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
    arg_max(v, length(h || p)) AS v FROM s LEFT JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, key IS NOT NULL AS listed,
  coalesce(v, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN l ON host || path = key
"""


@query("op1_url_filter", _ORACLE)
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, path = host_path(F.col("url"))
    listed = pages.filter(F.arrays_overlap(F.split(host, "\\."), F.array(*map(F.lit, LISTED_LABELS)))
                          ).select(F.concat(host, path).alias("key"))
    return url_filter(pages, listed)
