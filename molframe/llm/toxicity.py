"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector and as the mean and maximum of the vectors of its character runs. The network
reads windows of ``WINDOW`` words; attention weighs the places of a window. Windows start every ``STEP``
words and so overlap by half; all windows of a text are scored and the highest one counts.

Labels are known for texts only, so training alternates: the network picks the highest window of each text,
then is fitted to those by backpropagation through time (numpy, Adam). A logistic curve over texts that were
left out of the fit turns the highest window into a probability. At most ``TRAIN_ROWS`` labelled texts of at
most ``TRAIN_CHARS`` characters are fitted on the driver; scoring covers whole texts, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from molframe.llm.core import query, table

TRAIN_ROWS, TRAIN_CHARS = 4000, 50_000
WINDOW, STEP = 24, 12
#: Rows and widths of the vectors of words and of character runs, hidden units per direction, attention units.
WORDS, WORD_DIM, RUNS, RUN_DIM, HIDDEN, ATTENTION = 1 << 13, 4, 1 << 15, 6, 8, 8
RUN_LENGTHS = (3, 4, 5, 6)
ROUNDS, EPOCHS, BATCH, RATE = 4, 3, 64, 0.01
#: Words a worker keeps, words it scores together, characters it splits at once.
CACHE, TOGETHER, SLICE = 150_000, 300_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words between white space, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + SLICE
        # a cut never falls into a word
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


@dataclass
class Spelling:
    """Rows of the vectors of some words: one per word, and several runs (``first`` marks where they start)."""

    word: np.ndarray
    run: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Spelling:
        text = "".join(f"\x02{w}\x03" for w in words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(size)
        start = end - size
        # the hash of any run from differences of one running sum
        power = np.cumprod(np.full(len(code), _BASE, np.uint64))
        back = np.cumprod(np.full(len(code), pow(_BASE, -1, 1 << 64), np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + _U(1)) * back)])

        def hashed(a, b, rows):
            x = (total[b] - total[a]) * power[a]
            x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
            return ((x ^ (x >> _U(29))) % _U(rows)).astype(np.int32)
        at, run = [], []
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(code))
        for n in RUN_LENGTHS:
            fits = place + n <= end[owner]
            at.append(owner[fits])
            run.append(hashed(place[fits], place[fits] + n, RUNS))
        at, run = np.concatenate(at), np.concatenate(run)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(words))
        return cls(hashed(start, end, WORDS), run[order], np.cumsum(count) - count)

    def part(self, which: np.ndarray) -> Spelling:
        last = np.append(self.first[1:], len(self.run))
        n = (last - self.first)[which]
        first = np.cumsum(n) - n
        run = self.run[np.repeat(self.first[which] - first, n) + np.arange(n.sum())]
        return Spelling(self.word[which], run, first)

    def vectors(self, word: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Inputs of the network: word vector, mean and maximum of the run vectors."""
        if not len(self.word):
            return np.zeros((0, WORD_DIM + 2 * RUN_DIM), np.float32)
        v = run[self.run]
        n = np.diff(np.append(self.first, len(self.run)))[:, None]
        return np.hstack([word[self.word], np.add.reduceat(v, self.first) / n, np.maximum.reduceat(v, self.first)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name, and the curve (slope, shift) from the highest window to a probability."""

    w: dict[str, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        x, h = WORD_DIM + 2 * RUN_DIM, HIDDEN
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls({"word": small(WORDS, WORD_DIM), "run": small(RUNS, RUN_DIM), "in": make(x, 6 * h),
                    "in0": np.zeros(6 * h, np.float32), "on": make(h, 3 * h), "back": make(h, 3 * h),
                    "look": make(2 * h, ATTENTION), "see": make(ATTENTION), "out": make(2 * h),
                    "out0": np.zeros(1, np.float32)})

    def inputs(self, spelling: Spelling) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return spelling.vectors(self.w["word"], self.w["run"]) @ self.w["in"] + self.w["in0"]

    def run(self, given: np.ndarray, ids: np.ndarray, keep: bool = False):
        """A logit per window. ``given``: gate inputs by word; ``ids``: words of the windows, -1 beyond the end."""
        h, (n, size) = HIDDEN, ids.shape
        here = (ids >= 0).astype(np.float32)
        states, tape = np.zeros((n, size, 2 * h), np.float32), {}
        for d, name in enumerate(("on", "back")):
            u, state = self.w[name], np.zeros((n, h), np.float32)
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                p = given[ids[:, t], 3 * h * d:3 * h * (d + 1)]
                gate = _sigmoid(p[:, :2 * h] + state @ u[:, :2 * h])
                update, reset = gate[:, :h], gate[:, h:]
                new = np.tanh(p[:, 2 * h:] + (reset * state) @ u[:, 2 * h:])
                if keep:
                    tape[d, t] = state, update, reset, new
                state = state + here[:, t, None] * update * (new - state)
                states[:, t, d * h:(d + 1) * h] = state
        seen = np.tanh(states @ self.w["look"])
        weight = np.exp(np.clip(seen @ self.w["see"], -20, 20)) * here
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logit = pooled @ self.w["out"] + self.w["out0"][0]
        return (logit, (here, states, tape, seen, weight, pooled)) if keep else logit

    def gradients(self, spelling: Spelling, ids: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict:
        """Of the logistic loss over windows ``ids`` (into ``spelling``) with labels ``y``."""
        h, w, g = HIDDEN, self.w, {}
        x = spelling.vectors(w["word"], w["run"])
        given = x @ w["in"] + w["in0"]
        logit, (here, states, tape, seen, weight, pooled) = self.run(given, ids, keep=True)
        d = (_sigmoid(logit) - y) * importance / len(y)
        g["out"], g["out0"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * w["out"]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["see"] = np.einsum("nt,nta->a", d_score, seen)
        d_seen = d_score[:, :, None] * w["see"] * (1 - seen ** 2)
        g["look"] = np.einsum("nth,nta->ha", states, d_seen)
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_seen @ w["look"].T
        d_given = np.zeros_like(given)
        for side, name in enumerate(("on", "back")):
            u, d_u, carried = w[name], np.zeros_like(w[name]), 0
            for t in range(ids.shape[1] - 1, -1, -1) if side == 0 else range(ids.shape[1]):
                state, update, reset, new = tape[side, t]
                d_state = d_states[:, t, side * h:(side + 1) * h] + carried
                step = here[:, t, None] * d_state
                d_new = step * update * (1 - new ** 2)
                back = d_new @ u[:, 2 * h:].T
                d_gate = np.hstack([step * (new - state) * update * (1 - update), back * state * reset * (1 - reset)])
                d_u[:, :2 * h] += state.T @ d_gate
                d_u[:, 2 * h:] += (reset * state).T @ d_new
                carried = d_state - step * update + back * reset + d_gate @ u[:, :2 * h].T
                real = ids[:, t] >= 0
                np.add.at(d_given, (ids[real, t], slice(3 * h * side, 3 * h * (side + 1))),
                          np.hstack([d_gate, d_new])[real])
            g[name] = d_u
        g["in"], g["in0"] = x.T @ d_given, d_given.sum(axis=0)
        d_x = d_given @ w["in"].T
        g["word"], g["run"] = np.zeros_like(w["word"]), np.zeros_like(w["run"])
        np.add.at(g["word"], spelling.word, d_x[:, :WORD_DIM])
        n = np.diff(np.append(spelling.first, len(spelling.run)))
        owner = np.repeat(np.arange(len(n)), n)
        np.add.at(g["run"], spelling.run, (d_x[:, WORD_DIM:WORD_DIM + RUN_DIM] / n[:, None])[owner])
        # the maximum passes its gradient to the runs that hold it, in equal parts
        v, top = w["run"][spelling.run], x[:, WORD_DIM + RUN_DIM:]
        held = (v == top[owner]).astype(np.float32)
        share = d_x[:, WORD_DIM + RUN_DIM:] / np.maximum(np.add.reduceat(held, spelling.first), 1)
        np.add.at(g["run"], spelling.run, held * share[owner])
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.curve[0] * np.asarray(logit, float) + self.curve[1])


def windows_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of ``n`` words that lie one after the other: places of their words (-1 beyond the end of
    the text), text of each window, first window of each text. A text without words has an empty window."""
    count = np.maximum(0, -(-(n - WINDOW) // STEP)) + 1
    owner = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    inside = (np.arange(len(owner)) - first[owner])[:, None] * STEP + np.arange(WINDOW)
    return np.where(inside < n[owner, None], (np.cumsum(n) - n)[owner, None] + inside, -1), owner, first


def _logits(net: Network, given: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logit of every window; ``at`` are places in ``ids`` or -1."""
    out = np.empty(len(at), np.float32)
    ids = np.append(ids, -1)
    for k in range(0, len(at), 2048):
        out[k:k + 2048] = net.run(given, ids[at[k:k + 2048]])
    return out


def _odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log odds of label 1 against its share, drawn to 0 where there is little evidence."""
    p = (pos + 10 * share) / (pos + neg + 10)
    return np.clip(np.log(p / (1 - p)) - np.log(share / (1 - share)), -4, 4)


def fit(texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
    """Train on texts with labels 0 and 1; a fifth of them only shapes the final curve."""
    net = Network.new(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        net.curve = 0.0, float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for part in words_of(t) for w in part), np.int64) for t in texts]
    spelling = Spelling.of(list(number))
    ids, n = np.concatenate(docs), np.array([len(d) for d in docs])
    at, owner, first = windows_of(n)
    apart = rng.permutation(len(y)) % 5 == 0
    # both vectors begin with the log odds of the words and runs of the texts that are fitted
    seen = np.zeros((2, len(number)))
    for d, label, left in zip(docs, y, apart):
        if not left:
            seen[int(label), np.unique(d)] += 1
    of_run = np.repeat(np.arange(len(number)), np.diff(np.append(spelling.first, len(spelling.run))))
    per_run = [np.bincount(spelling.run, seen[k][of_run], RUNS) for k in (1, 0)]
    per_word = [np.bincount(spelling.word, seen[k], WORDS) for k in (1, 0)]
    net.w["word"][:, 0] = _odds(*per_word, share)
    net.w["run"][:, 0] = _odds(*per_run, share)
    hint = net.w["word"][spelling.word, 0] + np.maximum.reduceat(net.w["run"][spelling.run, 0], spelling.first) if number else np.zeros(0)
    level = np.append(np.append(hint, -9.0)[np.append(ids, -1)], -9.0)
    logit = level[at].max(axis=1)
    importance = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0

    def all_logits():
        given = np.empty((len(number), 6 * HIDDEN), np.float32)
        for k in range(0, len(number), 20_000):
            given[k:k + 20_000] = net.inputs(spelling.part(np.arange(k, min(k + 20_000, len(number)))))
        return _logits(net, given, ids, at)

    for _ in range(ROUNDS):
        # the highest window of each text (the first of equal ones)
        best = np.lexsort((np.arange(len(owner)), -logit, owner))[first]
        chosen = np.append(ids, -1)[at[best]]
        for _ in range(EPOCHS):
            order = rng.permutation(np.flatnonzero(~apart))
            for k in range(0, len(order), BATCH):
                rows = order[k:k + BATCH]
                which, local = np.unique(chosen[rows], return_inverse=True)
                local = local.reshape(-1, WINDOW)
                if which[0] < 0:
                    which, local = which[1:], local - 1
                step += 1
                g = net.gradients(spelling.part(which), local, y[rows], importance[rows])
                for name, v in g.items():
                    m, s = moments[name]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    net.w[name] -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        logit = all_logits()
    top, label = np.maximum.reduceat(logit, first)[apart].astype(float), y[apart]
    slope, shift = 1.0, 0.0
    for _ in range(50):
        # Newton steps with a weak pull to the logit itself
        p = _sigmoid(slope * top + shift)
        g = np.array([((p - label) * top).sum() + 0.1 * (slope - 1), (p - label).sum() + 0.1 * shift])
        v = p * (1 - p)
        hess = np.array([[(v * top * top).sum() + 0.1, (v * top).sum()], [(v * top).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        slope, shift = slope - move[0], shift - move[1]
    net.curve = float(slope), float(shift)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """Fit on labelled documents that are not held out: ``rows`` labels at most, by the hash of their id.

    An id with both labels is left out; of documents that repeat an id the smallest text counts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_y")).filter("y = _y")
    total = known.count()
    if total > 2 * rows:
        # the hash that orders the sample thins it out first
        known = known.filter(F.xxhash64("doc_id") < F.lit(int((3 * rows / total - 1) * (1 << 63))))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(
        F.length("text") <= TRAIN_CHARS)
    sample = of.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("y").alias("y")).orderBy("doc_id").toArrow()
    return fit(sample["text"].to_pylist(), sample["y"].to_numpy().astype(np.float32))


class _Scorer:
    """Scores texts one after the other; gate inputs of words are computed once."""

    def __init__(self, net: Network):
        self.net, self.number, self.given = net, {}, np.zeros((0, 6 * HIDDEN), np.float32)

    def _numbers(self, words: list[str], new: list[str]) -> np.ndarray:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number)
                new.append(w)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str]) -> np.ndarray:
        new: list[str] = []
        docs = [[self._numbers(part, new) for part in words_of(t)] for t in texts]
        parts = [self.given]
        for k in range(0, len(new), 10_000):
            parts.append(self.net.inputs(Spelling.of(new[k:k + 10_000])).astype(np.float32))
        self.given = np.concatenate(parts)
        n = np.array([sum(map(len, d)) for d in docs])
        at, _, first = windows_of(n)
        ids = np.concatenate([np.zeros(0, np.int64), *[p for d in docs for p in d]])
        given = self.given if len(self.given) else np.zeros((1, 6 * HIDDEN), np.float32)
        top = np.maximum.reduceat(_logits(self.net, given, ids, at), first)
        if len(self.number) > CACHE:
            self.number, self.given = {}, self.given[:0]
        return self.net.probability(top)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``, in one scan without a shuffle.

    Null and empty texts have one window without words and are scored like any other. Repeated rows get equal
    scores; other columns are left behind. Without labels of both kinds every score is the smoothed share of label 1.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(net.value)
        for batch in batches:
            size = np.cumsum([len(t) for t in batch.column("text").to_pylist()]) // (6 * TOGETHER)
            cuts = np.flatnonzero(np.diff(size, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                part = batch.slice(a, b - a)
                scores = scorer.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores)],
                                                 ["doc_id", "held_out", "score"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(read, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
