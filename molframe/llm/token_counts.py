"""Token counts at every prefix by dynamic programming over a BPE vocabulary.

The encoding of a prefix ends in exactly one piece: of the pieces that end there, the one that is
compatible with the last piece of what precedes it (two pieces are compatible if encoding their
joined text gives them back). So ``count[i] = count[i - len(piece)] + 1``, and one pass over a text
yields the exact count of each of its prefixes. They are stored as one signed byte per character, the
change of the count, from which lengths, truncation points and budget questions are answered
without encoding anything again.

No piece of the vocabulary reaches across a space that follows another character, so texts are cut
there, and frequent units come from a cache. Spaces join one another after all other merges, so a run
of spaces is counted by its length, whatever follows it: work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import query, table, texts
from molframe.llm.unit_cache import UnitCache, once

#: The model writes a space as this character; here it is a space throughout.
MARK = "▁"
UNITS = re.compile(" +[^ ]*")


class PrefixCounter:
    """Counts for one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        plain = [i for i in range(m.get_piece_size()) if not (
            m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = {m.id_to_piece(i).replace(MARK, " "): m.get_score(i) for i in plain}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        merged = sorted((p for p in pieces if len(p) > 1 and p.strip(" ")), key=lambda p: -pieces[p])
        runs = [p for p in pieces if len(p) > 1 and not p.strip(" ")]
        # merges happen in the order of scores: spaces join one another only after all else
        if runs and merged and max(pieces[p] for p in runs) >= pieces[merged[-1]]:
            raise ValueError("runs of spaces are merged before other pieces")
        if any(p.startswith("  ") for p in merged):
            raise ValueError("a piece holds more than one space and another character")
        # tokens of 0, 1, 2 .. spaces, up to the longest run that is one piece
        self.longest = max(map(len, runs), default=1)
        self.spaces = [0, 1, *(len(m.encode(" " * (n - 1))) for n in range(2, self.longest + 1))]
        single = [p for p in pieces if len(p) == 1]
        self.rank = {p: i for i, p in enumerate([*single, *merged])}
        self.halves: dict[str, tuple[str, str]] = {p: (p, p) for p in single}
        for p in merged:
            parts = self._merge(p, self.rank[p])
            if len(parts) == 2:
                self.halves[p] = (parts[0], parts[1])
        # pieces by their characters from the last to the first; the piece itself is at None
        self.ends: dict = {}
        for p in self.halves:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[None] = p
        self.fits: dict[str, dict[str, bool]] = {p: {} for p in self.halves}

    def _merge(self, text: str, limit: int) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if r >= limit:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether encoding ``left + right`` gives these two pieces.

        Undoes the later of the two last merges, again and again, and looks whether the parts
        that then touch would have been merged before it.
        """
        rank, halves, limit = self.rank, self.halves, 1 << 60
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            turn = rank[left] > rank[right]
            for _ in range(2):
                if turn and len(left) > 1:
                    limit, left = rank[left], halves[left][1]
                    break
                if not turn and len(right) > 1:
                    limit, right = rank[right] + 1, halves[right][0]
                    break
                turn = not turn
            else:
                return True

    def unit(self, unit: str) -> bytes:
        """Changes of the count over the prefixes of ``unit``, one signed byte each.

        A unit without its space is one that a single space precedes.
        """
        tail = unit.lstrip(" ")
        n = max(len(unit) - len(tail), 1)
        counts, alone = self._counts(f" {tail}")
        if n > 1:
            # the last of the spaces either joins the piece behind it or ends the run
            with_last, without = self._run(n), self._run(n - 1)
            counts = [*map(self._run, range(n)),
                      *(c - 1 + with_last if a else c + without for c, a in zip(counts[1:], alone[1:]))]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def _run(self, n: int) -> int:
        """Tokens of ``n`` spaces: whole longest pieces from the left, then the rest."""
        whole, rest = divmod(n, self.longest)
        return whole + self.spaces[rest]

    def _counts(self, unit: str) -> tuple[list[int], list[bool]]:
        """Tokens of every prefix of ``unit`` (one space in front), and whether the space is one of them."""
        ends, fits = self.ends, self.fits
        counts, last, alone = [0], [None], [False]
        for i in range(1, len(unit) + 1):
            node, j = ends, i
            while j:
                j -= 1
                node = node.get(unit[j])
                if node is None:
                    # outside the vocabulary: a token for each byte, and nothing merges with it
                    last.append(None)
                    counts.append(counts[-1] + len(unit[i - 1].encode()))
                    alone.append(alone[-1])
                    break
                piece = node.get(None)
                if piece is None:
                    continue
                before = last[j]
                if before is not None:
                    known = fits[piece]
                    ok = known.get(before)
                    if ok is None:
                        ok = known[before] = self._compatible(before, piece)
                    if not ok:
                        continue
                last.append(piece)
                counts.append(counts[j] + 1)
                alone.append(alone[j] if j else i == 1)
                break
        return counts, alone


def prefix_deltas(text: str, path: str) -> bytes:
    """One signed byte per character: count of the prefix that ends there minus the one before.

    The space that the model puts before a text is folded into the first character.
    """
    if not text:
        return b""
    cache = once(("prefix counts", path), lambda: UnitCache(PrefixCounter(path).unit))
    text = text.replace(MARK, " ")
    # between single spaces a unit is a space and what follows; runs of spaces stay together
    single = not text.startswith(" ") and "  " not in text
    units = text.split(" ") if single else UNITS.findall(" " + text)
    flat = b"".join(map(cache.__getitem__, units))
    return bytes([(flat[0] + flat[1]) & 255]) + flat[2:]


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Exact number of tokens of the first ``n_chars`` characters."""
    return int(np.frombuffer(deltas, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, limit_chars, prefix_deltas: one row per row of ``docs``.

    ``limit_chars``: characters of the longest prefix of at most ``limit`` tokens. A null text is
    empty (0 tokens). No shuffle: every text is treated in its own task, in Arrow batches.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [prefix_deltas(t, model_path) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_bytes"),
                pa.array([tokens_at(d, len(d)) for d in data], pa.int64()),
                pa.array([longest_within(d, limit) for d in data], pa.int64()),
                pa.array(data, pa.binary())],
                ["doc_id", "n_bytes", "n_tokens", "limit_chars", "prefix_deltas"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, limit_chars long, "
                                  "prefix_deltas binary")


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    counted = prefix_counts(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"),
                          "limit_chars")
