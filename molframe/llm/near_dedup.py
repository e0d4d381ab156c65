"""Near-duplicate documents by SuperMinHash.

Each shingle of a document draws its ranks from one random permutation of the signature's slots
instead of independent ones, which lowers the variance, and a document stops drawing when no later rank
can lower its signature (after two or three rounds for most). Signatures are cut into bands;
documents that share a band are candidates, links are confirmed on full shingle sets, and linked
documents are grouped by distributed union-find (minimum labels over stars).

Equal sets are collapsed before anything else. In a bucket of many candidates not all pairs are formed:
its most central member is compared with the others first, what is linked is contracted, and only
pairs that are still in different groups go on, until few enough are left to be compared in full.
So no link between different groups is lost and a group of n copies takes about n comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from molframe.llm.core import query, table, texts
from molframe.llm.linking import link
from molframe.llm.unit_cache import UnitCache, once
from molframe.session import materialise

#: Rows of a band and bands: at similarity 0.8 a pair is missed with probability 3e-6.
ROWS, BANDS = 5, 32
SIMILARITY = 80
#: Shingles that are hashed at once.
CHUNK = 200_000
#: Elements times slots of a set that are held at once.
BLOCK = 1 << 26
#: Documents in keys of ``CROWD`` and more carry a sketch of ``64 * LONGS`` single bits of a longer
#: signature; pairs that it puts ``SLACK`` percent (4.5 standard deviations) too low are not compared.
CROWD, LONGS, SLACK = 64, 32, 6
#: Ids of which a broadcast is at most 16 MB.
BROADCAST_IDS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; fewer words are one shingle."""
    import xxhash

    cache = once("word hashes", lambda: UnitCache(xxhash.xxh3_64_intdigest))
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _U(3) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row per set: slot values are (round, random number) as one integer.

    A very long set is signed in blocks; its signature is their minimum.
    """
    block = max(1, BLOCK // slots)
    if all(len(s) <= block for s in sets):
        return _signed(sets, slots)
    parts = [s[i:i + block] for s in sets for i in range(0, max(1, len(s)), block)]
    first = np.cumsum([0, *(max(1, -(-len(s) // block)) for s in sets)])[:-1]
    one_by_one = np.concatenate([_signed([p], slots) for p in parts])
    return np.minimum.reduceat(one_by_one, first, axis=0)


def _signed(sets: list[np.ndarray], slots: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    none = _U(0xFFFFFFFFFFFFFFFF)
    signature = np.full(len(sets) * slots, none, np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
    row = np.arange(len(element))
    for j in range(slots):
        if not len(row):
            break
        draw = mix(element[row] + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        # the next step of a shuffle: position j takes one of the positions from j on
        take = j + (((draw & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        slot = order[row, take]
        order[row, take] = order[row, j]
        np.minimum.at(signature, doc[row] * slots + slot, (_U(j) << _U(32)) | (draw >> _U(32)))
        on = signature.reshape(-1, slots).max(axis=1) >= _U(j + 1) << _U(32)
        row = row[on[doc[row]]]
    return signature.reshape(-1, slots)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band; equal keys mean the same band with equal values."""
    parts = signature.reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for r in range(rows):
        key = mix(key * _U(3) + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), bands (array of keys)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text").to_pylist()
            sets: list[np.ndarray] = []
            first = size = 0
            for i, t in enumerate(text):
                sets.append(shingles(t, k))
                size += len(sets[-1])
                if size >= CHUNK or i + 1 == len(text):
                    keys = band_keys(super_minhash(sets, rows * bands), rows, bands)
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None
                                  for s in sets], pa.binary()),
                        pa.array([b if len(s) else None for s, b in zip(sets, keys)], pa.list_(pa.int64()))],
                        ["doc_id", "n_shingles", "digest", "bands"])
                    first, size, sets = i + 1, 0, []

    return texts(docs).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, set: full sets of shingle hashes."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                             ["id", "set"])

    return docs.mapInArrow(build, "id long, set array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """id, sketch: the lowest bit of each slot of a signature of ``64 * LONGS`` slots."""
    slots = 64 * LONGS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.values.to_numpy().view(np.uint64) for s in batch.column("set")]
            rows: list[np.ndarray] = []
            first = size = 0
            for i, s in enumerate(own):
                size += len(s)
                if size * slots >= CHUNK * 256 or i + 1 == len(own):
                    bits = super_minhash(own[first:i + 1], slots) & _U(1)
                    rows += list(np.packbits(bits.astype(bool), axis=1).view(np.int64))
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int64()))],
                                             ["id", "sketch"])

    return sets.select("id", "set").mapInArrow(build, "id long, sketch array<long>")


def _near(a: list[Column], b: list[Column], similarity: int) -> Column:
    """Whether the sketches allow a link; true where one is missing."""
    apart = F.lit(0)
    for i in range(LONGS):
        apart = apart + F.bit_count(a[0][i].bitwiseXOR(b[0][i]))
    return F.coalesce(apart * 200 <= 64 * LONGS * (100 - similarity + SLACK), F.lit(True))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= similarity * union."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("_sa"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("_sb"))
    na, nb = F.size("_sa"), F.size("_sb")
    sized = pairs.join(one, "a").join(two, "b").filter(
        100 * F.least(na, nb) >= similarity * F.greatest(na, nb))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return sized.filter(100 * common >= similarity * (na + nb - common)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` whether it is the row's own.
    Documents without words are linked with nothing. Rows that repeat a doc_id are one document
    only if their texts agree; of a null doc_id the component is null and the row is kept.
    """
    rows = texts(docs)
    signed = materialise(signatures(rows, k), "signatures")
    known = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes, [known["digest"] == classes["digest"], known["doc_id"] == classes["rep"]]
                      ).select("rep", F.explode("bands").alias("key")).distinct()
    shared = reps.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = materialise(reps.join(shared, "key").select("key", F.col("rep").alias("id")), "candidates")
    needed = materialise(members.select(F.col("id").alias("doc_id")).distinct(), "needed")
    few = needed.count() <= BROADCAST_IDS
    chosen = rows.dropna(subset=["doc_id"]).join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    sets = materialise(shingle_sets(chosen, k), "sets")
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWD)
    crowd = members.join(crowded.select("key"), "key", "left_semi").select("id").distinct()
    sketched = materialise(sketches(sets.join(crowd, "id", "left_semi")), "sketches")
    members = members.join(sketched, "id", "left")
    labels = link(members, lambda pairs: _confirmed(pairs, sets, similarity), None, ["sketch"],
                  lambda a, b: _near(a, b, similarity)).filter("id != label").select(
        F.col("id").alias("rep"), "label")
    of = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(
        labels, "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return of.select("doc_id", "n_shingles", own.alias("component_id"),
                     F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``removed``; null ids stay."""
    ids = materialise(removed.select(F.col("doc_id").alias("_id")).distinct(), "removed")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("bigint") == F.col("_id"), "left_anti")


@query("op9_near_dedup")
def op9_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
