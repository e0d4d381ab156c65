"""Substring dedup: seed and extend over winnowed anchors.

Seeds: of the 25-word grams inside a window of 50 words the one with the smallest hash is its anchor, so
equal windows have equal anchors. Anchors that occur in one document only are dropped by counting,
before any text is compared. Extend: every 50-word window whose anchor is shared is the seed extended
both ways to the threshold; it gets a hash of its whole word sequence, the smallest document of each
sequence is found by a minimum, and consecutive windows of a document merge to maximal repeats.

Taking a minimum per sequence instead of comparing documents pairwise gives the same words at a cost
that is linear in the copies of a passage. Copies of a whole document are settled by a digest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import query, table, texts, words
from molframe.llm.unit_cache import UnitCache, once
from molframe.session import materialise

WINDOW = 50
#: Ids of which a broadcast is at most 16 MB.
BROADCAST_IDS = 1_000_000
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    cache = once("plain word hashes", lambda: UnitCache(xxhash.xxh3_64_intdigest))
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (modulo 2 to the 64) of every run of ``k`` values."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    inverse = _U(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.full(n, base, np.uint64))
    back = np.cumprod(np.full(n, inverse, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * back)])
    x = (total[k:] - total[:-k]) * power[:n - k + 1]
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of the grams of half its length inside it."""
    gram = window // 2
    x, width = rolling(h, gram, _BASES[0]), window - gram + 1
    if len(x) < width:
        return np.zeros(0, np.uint64)
    # minima over runs by doubling
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, digest (SHA-256 of the words joined by spaces), anchors (distinct)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, found = [], [], []
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                n.append(len(own))
                digest.append(hashlib.sha256(b" ".join(own)).digest())
                found.append(np.unique(anchors(_hashes(own), window)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_words", "digest", "anchors"])

    return texts(docs).mapInArrow(read, "doc_id long, n_words long, digest binary, anchors array<long>")


def seeded_windows(chosen: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, doc_id, row, start: hashed windows of (doc_id, row, text, shared) whose anchor is shared."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            for i, (doc, row, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row", "text")])):
                h = _hashes(words_of(text))
                own = np.sort(shared[i].values.to_numpy().view(np.uint64))
                anchor = anchors(h, window)
                place = np.minimum(np.searchsorted(own, anchor), len(own) - 1)
                start = np.flatnonzero(own[place] == anchor)
                if not len(start):
                    continue
                one, two = (rolling(h, window, b)[start] for b in _BASES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array((two >> _U(32)).astype(np.uint32).view(np.int32)),
                     pa.array(np.full(len(start), doc)), pa.array([row] * len(start)), pa.array(start.astype(np.int32))],
                    ["k1", "k2", "doc_id", "row", "start"])

    return chosen.mapInArrow(extend, "k1 long, k2 int, doc_id long, row string, start int")


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words (first, number) that windows at these starts cover."""
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [-1]])]
    return list(zip(first.tolist(), (last - first + window).tolist()))


def remove_spans(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, length in spans:
        out += words[at:start]
        at = start + length
    return out + words[at:]


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text, kept_sha256: one row per row of ``docs``.

    ``spans`` are the maximal repeats: words inside windows of ``window`` words that also start in
    a document with a smaller doc_id. ``kept_text`` is the rest, joined by spaces; null where
    nothing was removed (the text is kept). Null texts have no words. Rows that repeat a doc_id do not
    count against each other and each keeps its own text and spans; those with equal words are treated
    alike. Of a null doc_id nothing is removed.
    """
    read = materialise(digests(texts(docs), window), "digests")
    known = read.filter("doc_id IS NOT NULL")
    # rows of one id with different words are told apart by their digest; all others have no mark
    again = materialise(known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter(
        "a != b").select(F.col("doc_id").alias("_again")), "again")
    mark = lambda d, digest: d.join(_few(again), d["doc_id"] == again["_again"], "left").withColumn(
        "row", F.when(F.col("_again").isNotNull(), digest).otherwise("")).drop("_again")
    rows = mark(texts(docs), F.sha2(F.array_join(words("text"), " "), 256))
    classes = materialise(known.filter(f"n_words >= {window}").groupBy("digest").agg(
        F.min("doc_id").alias("rep")), "classes")
    # one document stands for all with the same words
    seeds = known.join(classes, [known["digest"] == classes["digest"], known["doc_id"] == classes["rep"]]
                       ).select("doc_id", F.explode("anchors").alias("anchor")).distinct()
    shared = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    wanted = materialise(seeds.join(shared, "anchor").groupBy("doc_id").agg(
        F.collect_list("anchor").alias("shared")), "shared")
    own = rows.dropna(subset=["doc_id"]).join(_few(wanted.select("doc_id")), "doc_id", "left_semi")
    windows = materialise(seeded_windows(own.join(wanted, "doc_id"), window), "windows")
    first = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
                                            ).filter("first < last").select("k1", "k2", "first")
    later = materialise(windows.join(first, ["k1", "k2"]).filter("first < doc_id").groupBy("doc_id", "row").agg(
        F.collect_set("start").alias("starts")), "repeats")
    hit = rows.dropna(subset=["doc_id"]).join(_few(later.select("doc_id")), "doc_id", "left_semi")
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(s.values.to_numpy(), window) for s in batch.column("starts")]
            kept = [b" ".join(remove_spans(words_of(t), s))
                    for t, s in zip(batch.column("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array(
                    [[{"start": a, "length": n} for a, n in s] for s in spans], shape),
                pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "row", "spans", "kept_text", "kept_sha"])

    edited = hit.join(later, ["doc_id", "row"]).mapInArrow(
        cut, "doc_id long, row string, spans array<struct<start:bigint,length:bigint>>, kept_text string, "
             "kept_sha string").dropDuplicates(["doc_id", "row"])
    of = mark(read.drop("anchors"), F.lower(F.hex("digest"))).join(classes, "digest", "left").join(
        edited, ["doc_id", "row"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("length")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", none))
    return of.select(
        "doc_id", "n_words", F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
        .alias("n_removed"), spans.alias("spans"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(
            F.coalesce("kept_sha", F.lower(F.hex("digest")))).alias("kept_sha256"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
