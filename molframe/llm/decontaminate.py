"""Benchmark decontamination with an FM-index per training shard.

A shard is a group of whole documents inside one task. Its words become tokens of the benchmark's
vocabulary; runs of other words can be in no phrase, so only runs at least as long as the shortest
phrase enter the index (``fm_index``). All phrases are searched backward through the index, their
occurrences are located and merged to removal spans. No shuffle.

Phrases are broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words; a larger benchmark takes
more passes, which carry the spans found so far with the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import query, table
from molframe.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_TOKENS = 2_000_000
#: Word characters (fixed values of the contract) as bytes: digits, a-z and all beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122
                  or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Phrases:
    """Distinct windows of a block of benchmark items as rows of tokens, with their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.items = [sorted(v) for v in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, p in zip(self.patterns, found):
            row[window - len(p):] = p


def blocks(benchmark: DataFrame, id_col: str, window: int) -> Iterator[Phrases]:
    """The items, streamed to the driver and cut into blocks of ``BLOCK_WORDS`` words."""
    items, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), "text").toLocalIterator():
        words = words_of(text or "")
        items.append((item if item is not None else "", words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield Phrases(items, window)
            items, size = [], 0
    if items:
        yield Phrases(items, window)


def _shards(rows: Iterable[list[bytes]], phrases: Phrases) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Groups of documents: tokens with a 0 after each document, and the sizes."""
    get, parts, sizes, total = phrases.vocabulary.get, [], [], 0
    for words in rows:
        ids = np.zeros(len(words) + 1, np.int64)
        ids[:-1] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        parts.append(ids)
        sizes.append(len(ids))
        total += len(ids)
        if total >= SHARD_TOKENS:
            yield np.concatenate(parts), sizes
            parts, sizes, total = [], [], 0
    if parts:
        yield np.concatenate(parts), sizes


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Start (in ``ids``) and phrase of every occurrence in one shard."""
    known = np.flatnonzero(ids)
    none = np.zeros(0, np.int64)
    if not len(known) or not phrases.shortest:
        return none, none
    cut = np.flatnonzero(np.diff(known) > 1) + 1
    first = np.concatenate([[0], cut])
    length = np.diff(np.concatenate([first, [len(known)]]))
    long = length >= phrases.shortest
    if not long.any():
        return none, none
    begin, length = known[first[long]], length[long]
    # each kept run and the 0 that follows it in ids
    source = np.repeat(begin - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1)
    source += np.arange(len(source))
    index = FMIndex(ids[source])
    low, high = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(low < high)
    count = high[found] - low[found]
    rows = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return source[index.locate(rows)], np.repeat(found, count)


def find_spans(rows: Iterable[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Per document: merged spans (first word, words) and the items with occurring windows.

    Documents are taken one by one, so that the words of one only are held as objects.
    """
    out: list[tuple[list[tuple[int, int]], list[str]]] = []
    for ids, sizes in _shards(rows, phrases):
        start, phrase = occurrences(ids, phrases)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + phrases.lengths[phrase], -1)
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        begin = np.flatnonzero(~hit[:-1] & hit[1:])
        end = np.flatnonzero(hit[:-1] & ~hit[1:])
        offset = np.concatenate([[0], np.cumsum(sizes)])
        found: list[tuple[list, set]] = [([], set()) for _ in sizes]
        for doc, b, e in zip(np.searchsorted(offset, begin, "right") - 1, begin, end):
            found[doc][0].append((int(b - offset[doc]), int(e - b)))
        pairs = np.unique(np.stack([np.searchsorted(offset, start, "right") - 1, phrase]), axis=1)
        for doc, p in pairs.T:
            found[doc][1].update(phrases.items[p])
        out += [(spans, sorted(items)) for spans, items in found]
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length - out[-1][0]))
        else:
            out.append((start, length))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id",
                  window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, spans, items, row (all columns): one row per row of ``docs``.

    ``spans`` are the removal spans (first word, number of words) that occurrences of windows of
    ``window`` words cover, merged; ``items`` the items they come from, sorted as strings. An item
    of fewer words is one window; a null text has no words; a null item id is the empty string.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
                       F.array().cast("array<string>").alias("items"),
                       F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    spark = docs.sparkSession
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def one_pass(rows: DataFrame, phrases: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = [], [], []

                def split(texts=batch.column("text").to_pylist()):
                    for t in texts:
                        words = words_of(t)
                        n_words.append(len(words))
                        yield words

                for (new, own), s, i in zip(find_spans(split(), sent.value), batch.column("spans").to_pylist(),
                                            batch.column("items").to_pylist()):
                    old = [(x["start"], x["length"]) for x in s]
                    spans.append([{"start": a, "length": n} for a, n in merge_spans(old + new)])
                    items.append(sorted({*i, *own}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                     pa.array(spans, shape), pa.array(items, pa.list_(pa.string())), batch.column("row")],
                    ["doc_id", "text", "n_words", "spans", "items", "row"])

        return rows.mapInArrow(mark, rows.schema)

    some = False
    for phrases in blocks(benchmark, item_col, window):
        rows, some = one_pass(rows, phrases), True
    return rows if some else one_pass(rows, Phrases([], window))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for start, length in spans:
        out.append(text[at:places[start][0]])
        at = places[start + length - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id",
                  window: int = WINDOW) -> DataFrame:
    """``docs`` (all columns) with the removal spans cut out of ``text``; nulls become empty texts."""
    marked = contamination(docs, benchmark, item_col, window).select("text", "spans", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut_spans(t, [(x["start"], x["length"]) for x in s]) if s else t for t, s in zip(
                batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), batch.column("row")], ["text", "row"])

    shape = marked.select("text", "row").schema
    return marked.mapInArrow(cut, shape).select(
        *[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.length)").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
