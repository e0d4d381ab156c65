"""Packing by cutting-stock column generation.

Documents are encoded and cut at multiples of the sequence size; what remains of each is an item. The
items' length histogram (lengths rounded up to multiples of ``UNIT``, so of bounded size) is the
demand of a cutting-stock problem: a linear program over patterns, whose columns are priced by a
knapsack dynamic program. Patterns are used a whole number of times, what rounding leaves is placed
by first fit, and the documents of each length class, ranked, take the places of its patterns in
order. Only the histogram and the patterns reach the driver.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from molframe.llm.core import query, table, texts
from molframe.llm.unit_cache import UnitCache, once
from molframe.session import materialise

SIZE = 2048
UNIT = 8
END_ID = 1
#: The plan is at most this share above the optimum of the linear program.
GAP = 1e-3
#: Pivots between two inversions of the basis.
REFRESH = 50
#: Ranks are counted inside buckets of about this many pieces, of at least ``MIN_BUCKETS``.
BUCKET_PIECES, MIN_BUCKETS = 50_000, 256


def _gpt_bytes() -> dict[str, int]:
    """Characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of a byte-level BPE vocabulary in the format of the tokenizers library.

    A space between two characters that are no white space starts a new unit of the vocabulary's word
    pattern, so texts are cut there and units are cached. Missing units are merged by rank with
    tiktoken, which gives the same ids if every piece arises by rank from the two pieces of its
    own merge (``same_merges``, tested over the whole vocabulary); texts with special strings or
    unusual white space go to tokenizers as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        own = _gpt_bytes()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.ranks = {bytes(own[c] for c in piece): i for piece, i in model["model"]["vocab"].items()
                      if piece not in self.special}
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
                       for m in model["model"]["merges"]]
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.by_rank = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=self.ranks, special_tokens={})
        self.cache = UnitCache(self._first_unit)

    def same_merges(self) -> bool:
        own = _gpt_bytes()
        for left, right in self.merges:
            a, b = (bytes(own[c] for c in x) for x in (left, right))
            limit, parts = self.ranks[a + b], [bytes([x]) for x in a + b]
            while True:
                r, i = min(((self.ranks.get(parts[i] + parts[i + 1], limit), i)
                            for i in range(len(parts) - 1)), default=(limit, 0))
                if r >= limit:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if parts != [a, b]:
                return False
        return True

    def _first_unit(self, unit: str) -> bytes:
        return array("I", self.by_rank.encode_ordinary(" " + unit)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers of this machine's byte order (little-endian)."""
        if not text:
            return b""
        units = text.split(" ")
        plain = all(units) and not any(s in text for s in self.special)
        if plain and all(u.isprintable() or not (u[0].isspace() or u[-1].isspace()) for u in units):
            first = array("I", self.by_rank.encode_ordinary(units[0])).tobytes()
            return b"".join([first, *map(self.cache.__getitem__, units[1:])])
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def encode_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID,
                  keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): each document cut every ``size`` ids.

    ``end_id`` follows each document, so an empty or null text is one piece of one id.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("ids", path), lambda: Encoder(path))
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at:at + 4 * size]
                    row = (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:5 + keep_ids])

    return texts(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, "
                                       "doc_tokens long" + ", ids array<int>" * keep_ids)


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable multiset of sizes, as counts."""
    use = np.flatnonzero(value > 1e-12)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own, worth = sizes[use], value[use]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(own, room, "right")
        best[room] = best[room - 1]
        if fits:
            total = best[room - own[:fits]] + worth[:fits]
            k = int(total.argmax())
            if total[k] > best[room] + 1e-12:
                best[room], choice[room] = total[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[use[choice[room]]] += 1
            room -= own[choice[room]]
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns (size -> count) and how often each is used; every demand is met exactly.

    Revised simplex over equality rows, one per size. It starts from patterns of one size and ends
    within ``GAP`` of a lower bound, or after 20 pivots per size.
    """
    if not demand:
        return []
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    basis = np.diag(capacity // sizes).astype(float)
    inverse, used = np.diag(1.0 / np.diag(basis)), need / np.diag(basis)
    for turn in range(20 * len(sizes)):
        if turn % REFRESH == REFRESH - 1:
            # rounding errors of the updates would add up
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ need, 0)
        worth, column = best_pattern(sizes, inverse.sum(axis=0), capacity)
        # no plan has fewer sequences than the sizes fill, or than the duals say
        if used.sum() <= (1 + GAP) * max(need @ sizes / capacity, used.sum() / max(worth, 1)):
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        move = max(0.0, ratio[out])
        used = np.maximum(used - move * step, 0)
        used[out] = move
        inverse[out] /= step[out]
        other = np.arange(len(sizes)) != out
        inverse[other] -= np.outer(step[other], inverse[out])
        basis[:, out] = column
    plan: list[tuple[Counter, int]] = []
    left = Counter(demand)
    for k in np.argsort(-used, kind="stable"):
        pattern = Counter({int(s): int(c) for s, c in zip(sizes, basis[:, k]) if c})
        times = min([int(used[k] + 1e-6), *(left[s] // c for s, c in pattern.items())])
        if times > 0:
            plan.append((pattern, times))
            for s, c in pattern.items():
                left[s] -= c * times
    # what rounding down has left: the longest that fit, as often as the counts allow
    left = +left
    while left:
        room, pattern = capacity, Counter()
        for s in sorted(left, reverse=True):
            pattern[s] = min(room // s, left[s])
            room -= s * pattern[s]
        pattern = +pattern
        times = min(left[s] // c for s, c in pattern.items())
        plan.append((pattern, times))
        for s, c in pattern.items():
            left[s] -= c * times
        left = +left
    return plan


def pack(pieces: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with sequence_id and offset.

    Pieces of a class are ranked by bucket, then by document, so that a class of any size is ranked in
    many tasks. Offsets are sums inside one sequence.
    """
    spark = pieces.sparkSession
    whole = -(-size // unit)
    own = pieces.columns
    stored = materialise(pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    demand = {r["_class"]: r["n"] for r in stored.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = demand.pop(whole, 0)
    # a class stands for its longest length; whole sequences need no plan
    plan = [(Counter({whole: 1}), full)] * bool(full) + cutting_stock(demand, size // unit)
    places, base, taken = [], 0, Counter()
    for pattern, times in plan:
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            places.append((c, taken[c], taken[c] + n * times, n, base, slot))
            taken[c] += n * times
            slot += n
        base += times
    table_ = spark.createDataFrame(places, "_class int, _low long, _high long, _n int, _base long, _slot int")
    buckets = max(MIN_BUCKETS, -(-(sum(demand.values()) + full) // BUCKET_PIECES))
    dealt = stored.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = (dealt.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_k"))
             .select("_class", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_first")))
    order = W.partitionBy("_class", "_bucket").orderBy("doc_id", "start")
    ranked = (dealt.withColumn("_at", F.row_number().over(order) - 1).join(first, ["_class", "_bucket"])
              .withColumn("_rank", F.col("_at") + F.col("_first")))
    # at most a row for each class of each pattern: (size / unit) squared
    placed = ranked.join(F.broadcast(table_), "_class").filter("_rank >= _low AND _rank < _high")
    seated = placed.select(*own, (F.col("_base") + F.floor((F.col("_rank") - F.col("_low")) / F.col("_n")))
                           .cast("bigint").alias("sequence_id"),
                           (F.col("_slot") + F.pmod(F.col("_rank") - F.col("_low"), F.col("_n"))).alias("_slot"))
    so_far = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return seated.select(*own, "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0))
                         .cast("bigint").alias("offset"))


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, input_ids, doc_ids, lengths from packed pieces with ``ids``.

    A sequence has at most ``size`` ids; it is padded to ``size`` unless its length is a power of two.
    """
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(
        F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    even = F.bit_count(n) == 1
    return joined.select("sequence_id", F.when(even, ids).otherwise(F.concat(
        ids, F.array_repeat(F.lit(pad_id), F.lit(size) - n))).alias("input_ids"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    return pack(encode_pieces(docs, path, size), size, unit)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
