"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores the measurements beside one long whose bits say
which rules failed. Policies are versioned masks over those bits: changing one reads the ledger,
never the texts. ``ablations`` counts, for each rule of a policy, what it rejects and what it alone
rejects, from the counts of the distinct masks. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import SPACE, query, table, texts, words

#: Characters counted as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"

#: Name and condition that makes a text fail; bit i of the ledger is rule i.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > 2 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "n_words >= 10 AND word_chars < 2 * n_words"),
]

#: Versioned policies: names of the rules that reject a text.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"],
}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    ``n_repeat_words`` counts the words inside 5-word windows that occur twice or more in the
    text. Hashes of the windows only tell whether a text has such windows at all (equal windows
    have equal hashes); the windows of those texts are then compared as text. A null text is an
    empty one; repeated rows are measured one by one.
    """
    split = texts(docs).select("doc_id", "text", words(F.col("text")).alias("w"),
                               F.filter(F.split("text", "\n"), lambda x: F.btrim(
                                   x, F.lit(SPACE)) != "").alias("lines"))
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = hashed.withColumn("win", F.expr(
        "CASE WHEN size(h) < 5 THEN CAST(array() AS array<bigint>) ELSE "
        "transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i+1], h[i+2], h[i+3], h[i+4])) END"))
    flagged = windows.select("*", (F.size(F.array_distinct("win")) < F.size("win")).alias("rep"))
    exact = flagged.withColumn("s", F.expr(
        "CASE WHEN rep THEN array_sort(transform(sequence(0, size(w) - 5), i -> named_struct("
        "'k', concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]), 'p', i))) "
        "ELSE CAST(array() AS array<struct<k:string,p:int>>) END"))
    places = exact.withColumn("p", F.expr(
        "array_sort(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].k = x.k) OR "
        "(i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].k = x.k)), x -> x.p))"))
    covered = ("aggregate(p, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct("
               "'n', a.n + 5 - greatest(a.e - x, 0), 'e', x + 5), a -> a.n)")
    return places.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"))


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measurements of ``measure`` and ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0)))
    return measure(docs).withColumn("fail_bits", bits)


def mask_of(policy: str, rules=RULES, policies=POLICIES) -> int:
    names = [n for n, _ in rules]
    return sum(1 << names.index(n) for n in policies[policy])


def apply_policy(rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """A ledger with boolean ``name``: no rule of the policy failed."""
    mask = F.lit(mask_of(policy)).cast("bigint")
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only: texts that a rule of the policy rejects, and that it alone rejects.

    The ledger shrinks to its distinct masks (at most 2 to the number of rules) before the shuffle.
    """
    mask = mask_of(policy)
    seen = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit"))
                              for i, (n, _) in enumerate(RULES) if n in POLICIES[policy]])).alias("r")
    failed = seen.select("n", F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("m"), bit)
    return failed.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.expr("m & r.bit != 0"), F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.expr("m = r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
_ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x != '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
  FROM k, (SELECT unnest(range(5)) AS o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  len(text) - len(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {mask_of('base')} != 0 AS base_failed, fail_bits & {mask_of('v2')} = 0 AS kept, fail_bits FROM b
"""


@query("op6_quality_rules", _ORACLE)
def op6_quality_rules(spark, sf_dir):
    rows = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), "v2"), "base", "base_ok")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")
