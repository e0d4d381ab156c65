"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word starts one window of ``LONGEST`` lead columns, padded with
nulls at the end of its piece. ROLLUP over the columns then sums windows with equal first words, which gives
the occurrences of every shorter phrase (and, at the top level, all words of a language) without an explosion
per length.

A phrase as frequent as asked for has frequent parts only, so a window may end before a pair or triple of
words that is too rare: nothing that is counted in the end loses an occurrence. Rare pairs and triples are
recognised by a filter of fixed size over their hashes; a false hit only makes a window longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import query, table
from molframe.session import materialise

LONGEST, AT_LEAST, TOP = 5, 100, 2000
#: Bits of a filter: 8 MB however large the corpus is.
FILTER_BITS = 26
#: Words of which a worker keeps the number; then it starts anew.
VOCABULARY = 100_000
#: Bytes of text that are counted together, and that are split into words at once.
TEXT_AT_ONCE, SLICE = 3_000_000, 500_000
#: Fixed values of the contract: ends of pieces and blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_U = np.uint64
_PIECES = bytes(10 if c in ENDS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


class _Vocabulary(dict):
    """Numbers of words of one language as they come: 0 ends a piece, -1 is no word."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0, b"": -1})
        self.words, self._hashes = [b"\n"], np.zeros(1, np.uint64)
        self._seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word):
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def hashes(self) -> np.ndarray:
        new = self.words[len(self._hashes):]
        more = np.fromiter((xxhash.xxh3_64_intdigest(w, self._seed) for w in new), np.uint64, len(new))
        self._hashes = np.concatenate([self._hashes, more])
        return self._hashes


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0x165667B19E3779F9))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a translated text of about ``SLICE`` bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            if cut < 0:
                cut = min((x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0), default=len(text) - 1)
            end = cut + 1
        yield text[at:end]
        at = end


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, _Vocabulary, np.ndarray]]:
    """lang, vocabulary and word numbers of whole texts of ``TEXT_AT_ONCE`` bytes or more (the rest of a batch
    may be less), 0 between pieces and at the end."""
    known: dict[str, tuple[_Vocabulary, list[np.ndarray]]] = {}

    def ready(lang):
        v, parts = known.pop(lang)
        if len(v) <= most:
            known[lang] = v, []
        return lang, v, np.concatenate([*parts, np.zeros(LONGEST, np.int32)])

    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass").translate(_PIECES))
        for lang, found in by_lang.items():
            held = 0
            for text in found:
                if lang not in known:
                    known[lang] = _Vocabulary(lang), []
                v, parts = known[lang]
                for part in _slices(text):
                    tokens = part.replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(v.__getitem__, tokens), np.int32, len(tokens))
                    parts.append(ids[ids >= 0])
                parts.append(np.zeros(1, np.int32))
                held += len(text)
                if held >= TEXT_AT_ONCE:
                    held = 0
                    yield ready(lang)
            by_lang[lang] = []
            if known.get(lang, (None, []))[1]:
                yield ready(lang)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h >> _U(65 - (8 * len(bits)).bit_length())
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0


def _lengths(ids: np.ndarray, h: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of the window at each place as far as ``filters`` (of pairs, then triples) let it go, and the
    hashes of one word, two words and so on."""
    word = h[ids]
    real = ids > 0
    grams, far = [word], real.copy()
    n = real.astype(np.int64)
    good = real
    for k in range(2, len(filters) + 2):
        nxt = np.concatenate([word[k - 1:], np.zeros(k - 1, np.uint64)])
        grams.append(_mixed(grams[-1], nxt))
        far = far & np.concatenate([real[k - 1:], np.zeros(k - 1, bool)])
        good = good & far & _passes(grams[-1], filters[k - 2])
        if k > 2:
            # a run of k words needs both of its runs of k - 1 words
            good = good & np.concatenate([before[1:], np.zeros(1, bool)])
        before = good
        n = n + good
    # beyond the filters: every run of that many words inside the window is frequent
    for k in range(len(filters) + 2, LONGEST + 1):
        nxt = np.concatenate([before[k - len(filters) - 1:], np.zeros(k - len(filters) - 1, bool)])
        good = good & nxt
        n = n + good
    return n, grams


def _gram_counts(docs: DataFrame, shared: list, at_least: int) -> DataFrame:
    """h: hashes of frequent pairs (no filter yet) or of frequent triples (one filter)."""
    size, most = len(shared) + 2, VOCABULARY

    def count(batches):
        filters = [s.value for s in shared]
        for _, v, ids in _pieces(batches, most):
            h = v.hashes()
            if not filters:
                every = ids > 0
                pair = _mixed(h[ids[:-1]], h[ids[1:]])[every[:-1] & every[1:]]
                hashes, n = np.unique(pair, return_counts=True)
            else:
                length, grams = _lengths(ids, h, filters)
                both = length >= size - 1
                ok = both & np.concatenate([both[1:], np.zeros(1, bool)]) & np.concatenate(
                    [ids[size - 1:] > 0, np.zeros(size - 1, bool)])
                nxt = np.concatenate([h[ids[size - 1:]], np.zeros(size - 1, np.uint64)])
                hashes, n = np.unique(_mixed(grams[-1], nxt)[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= at_least).select("h")


def _filter(hashes: DataFrame):
    """The filter over ``hashes``, broadcast: at most 2 to the ``FILTER_BITS`` bits come to the driver."""
    words = hashes.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("at")).groupBy(
        F.shiftright("at", 6).cast("int").alias("k")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["k"].to_numpy()] = words["b"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def lead_windows(docs: DataFrame, filters: list) -> DataFrame:
    """lang, w1 to w5, c: padded windows and how often they start. Every word starts one."""
    most = VOCABULARY

    def read(batches):
        own = [s.value for s in filters]
        for lang, v, ids in _pieces(batches, most):
            h = v.hashes()
            length, _ = _lengths(ids, h, own)
            start = np.flatnonzero(length > 0)
            columns = [np.where(length[start] > k, ids[start + k], 0).astype(np.int64) for k in range(LONGEST)]
            if not len(start):
                continue
            # equal windows are numbered column by column, exactly
            group = columns[0]
            for c in columns[1:]:
                _, first, group = np.unique(group * len(h) + c, return_index=True, return_inverse=True)
            names, n = pa.array([None, *v.words[1:]], pa.binary()), np.bincount(group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), *[names.take(pa.array(c[first])).cast(pa.string()) for c in columns],
                 pa.array(n)], ["lang", *_WORDS, "c"])

    return docs.mapInArrow(read, f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, c long")


def phrase_counts(docs: DataFrame, at_least: int = AT_LEAST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to 5 words (lang, words, f) and all words of each language (lang, n).

    ``docs``: lang, text. A null lang is ``und``, a null text is empty.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = _filter(_gram_counts(rows, [], at_least))
    triples = _filter(_gram_counts(rows, [pairs], at_least))
    longest = lead_windows(rows, [pairs, triples]).groupBy("lang", *_WORDS).agg(F.sum("c").alias("c"))
    level = F.lit(LONGEST) - F.bit_count(F.grouping_id()).cast("int")
    sums = longest.rollup("lang", *_WORDS).agg(level.alias("k"), F.sum("c").alias("f"))
    # k is -1 for all languages together, 0 for all words of one; a prefix that ends in padding is no phrase
    whole = F.element_at(F.array(*_WORDS), F.greatest("k", F.lit(1))).isNotNull()
    kept = materialise(sums.filter((F.col("k") == 0) | ((F.col("k") > 0) & whole & (F.col("f") >= at_least))).select(
        "lang", "k", F.slice(F.array(*_WORDS), 1, F.greatest("k", F.lit(0))).alias("words"), "f"), "phrases")
    return kept.filter("k > 0").select("lang", "words", "f"), kept.filter("k = 0 AND f > 0").select(
        "lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, at_least: int = AT_LEAST, top: int | None = TOP, absorbed: int = 100
                 ) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of phrases of 2 to 5 words with ``at_least`` occurrences.

    A phrase scores 1000 * a * n / (l * r), rounded down, at its lowest-scoring cut (the first of equal ones).
    Phrases inside a longer one with at least ``absorbed`` percent of their occurrences are dropped. The first
    ``top`` of each language are returned (all if it is None), by score, occurrences and phrase. Null texts
    are empty, null languages are ``und``; repeated rows count as often as they come; other columns of
    ``docs`` are left behind. Without words nothing is returned.
    """
    phrases, totals = phrase_counts(docs.select("lang", "text"), at_least)
    size = F.size("words")
    found = phrases.filter(size >= 2).select("lang", "words", F.col("f").alias("a"))
    cut = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"),
        F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    part = lambda side, f: phrases.select("lang", F.col("words").alias(side), F.col("f").alias(f))
    exact = lambda c: f"CAST({c} AS DECIMAL(17, 0))"
    scored = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(
        F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").withColumn("score", F.expr(
            f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')})"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # parts of longer candidates: at most nine each
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"))
                      for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2)])
    inner = found.filter(size > 2).select("lang", "words", "a", F.explode(spans).alias("s")).filter(
        F.expr("s.i + s.m - 1 <= size(words) AND s.m < size(words)")).select(
        "lang", F.expr("slice(words, s.i, s.m)").alias("words"), F.col("a").alias("longer")).groupBy(
        "lang", "words").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "words"], "left").filter(F.coalesce(
        100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    out = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.expr("CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS bigint)")
    ranked = out.withColumn("rank", rank)
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op11_collocations")
def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
