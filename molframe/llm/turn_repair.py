"""Conversation repair: the cheapest edits that make roles alternate.

Turns are in place ``i`` of ``n`` and roles in one of four states (nothing yet, after system, after user,
after assistant). Keeping, changing, deleting and inserting turns are the edges of that lattice. Two heaps
search it from both ends (bidirectional Dijkstra); the search ends when no crossing of equal cost can be
left, and of all crossings with the least cost the one with the least edit string wins.

A conversation may hold a third of all turns. Turns are numbered by one range shuffle and cut into blocks of
``BLOCK``; a block that may be continued is solved for every pair of states at its ends, and the few results
per block are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molframe.llm.core import SPACE, query, table
from molframe.plans.ordered import dense_index
from molframe.session import materialise

#: Turns solved together.
BLOCK = 256
#: Fixed values of the contract: costs of edits.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a role may follow.
AFTER = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (START, ASSISTANT)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEY = ["_none", "_conv"]
_KEY = "_none boolean, _conv long"


def damaged(conversations: DataFrame) -> DataFrame:
    """_none, _conv (key of the conversation), turn, role, text of the turns that are left.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 removes ``.!?``, 3 repeats
    it, 4 makes its role user. Nulls count as one space.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("_conv"),
        F.col("turn").cast("bigint").alias("turn"), word("role").alias("role"), word("text").alias("text"),
        (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("_d"))
    d = F.col("_d")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter(d != 0).select(
        *KEY, "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with id (place in the table ordered by conversation and turn), fault and kind of the role.

    Turns of equal number are ordered by role and text.
    """
    rows = dense_index(turns, [], [*KEY, "turn", "role", "text"]).drop("pos")
    bare = F.btrim("text", F.lit(SPACE))
    first = rows.filter(bare != "").groupBy(*KEY, "role", F.unhex(F.sha2("text", 256)).alias("_t")).agg(
        F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
    initial = F.substring("role", 1, 1)
    # ids are unique, so this join has no hot key
    return rows.join(first, "id", "left").select(
        *KEY, "id", "turn", "role", "text",
        F.when(bare == "", BLANK).when(F.col("_first").isNull(), DUPLICATE).when(
            ~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT)
        .otherwise(START).alias("kind"))


def _ways(kind: int, fault: int) -> list[tuple[int, int, int, str]]:
    """Edges over one turn: state before, state after, cost, initial of the edit."""
    out = [(s, s, DELETE, "D") for s in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_OFF if fault == TRUNCATED else 0
    for s in range(4):
        if s in AFTER.get(kind, ()):
            out.append((s, kind, KEEP + more, "K"))
        out.append((s, NEXT[s], REROLE + more, "R"))
    return out


_WAYS = {chr(65 + 4 * fault + kind): _ways(kind, fault) for fault in range(4) for kind in range(4)}
_FORTH = {c: [[(t, w, e) for s, t, w, e in ways if s == x] for x in range(4)] for c, ways in _WAYS.items()}
_BACK = {c: [[(s, w, e) for s, t, w, e in ways if t == x] for x in range(4)] for c, ways in _WAYS.items()}
_BEFORE = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def solve(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Least cost, then least edit string, from ``start`` before the first turn to one of ``ends`` after the
    last one, and which end that is. ``codes``: a letter per turn for its fault and kind.

    Two different strings of one cost between the same ends are never the beginning of each other, since more
    edits over the same turns are insertions, which cost. So the best string of a node holds for every way on.
    """
    n = len(codes)
    forth, back = {(0, start): (0, "")}, {(n, t): (0, "", t) for t in ends}
    # keeping costs nothing and leads to a later turn: the reverse heap takes later places first
    up, down = [(0, "", 0, start)], [(0, -n, t) for t in ends]
    done_up, done_down = set(), set()
    best = None

    def cross(x, w, e, y):
        nonlocal best
        a, b = forth[x], back[y]
        found = (a[0] + w + b[0], a[1] + e + b[1], b[2])
        if best is None or found < best:
            best = found

    if (0, start) in back:
        best = (0, "", start)
    while up and down and (best is None or up[0][0] + down[0][0] <= best[0] or not done_down):
        if done_down and up[0][0] <= down[0][0]:
            cost, label, i, s = heappop(up)
            x = i, s
            if x in done_up:
                continue
            done_up.add(x)
            steps = [((i, NEXT[s]), INSERT, "I")]
            if i < n:
                steps += [((i + 1, t), w, e) for t, w, e in _FORTH[codes[i]][s]]
            for y, w, e in steps:
                if y in done_down:
                    cross(x, w, e, y)
                new = (cost + w, label + e)
                if y not in done_up and (y not in forth or new < forth[y]):
                    forth[y] = new
                    heappush(up, (*new, *y))
        else:
            cost, place, t = heappop(down)
            y = i, t = -place, t
            if y in done_down:
                continue
            done_down.add(y)
            _, label, end = back[y]
            steps = [((i, s), INSERT, "I") for s in _BEFORE[t]]
            if i > 0:
                steps += [((i - 1, s), w, e) for s, w, e in _BACK[codes[i - 1]][t]]
            for x, w, e in steps:
                if x in done_up:
                    cross(x, w, e, y)
                new = (cost + w, e + label, end)
                if x not in done_down and (x not in back or new < back[x]):
                    again = x in back and back[x][0] == new[0]
                    back[x] = new
                    if not again:
                        heappush(down, (new[0], -x[0], x[1]))
    return best


def _illegal(kinds: list[int]) -> int:
    return sum(a not in AFTER.get(b, ()) or a == START for a, b in zip(kinds, kinds[1:]))


def _solved(rows: DataFrame) -> DataFrame:
    """A row per conversation and block of places: its codes, illegal pairs, and its best ways.

    Places are dense over the whole table, so a group that touches no end of its block is a conversation.
    """
    size = BLOCK
    groups = rows.groupBy(*KEY, F.floor(F.col("id") / size).cast("bigint").alias("block")).agg(
        F.min("id").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "id", F.char(65 + 4 * F.col("fault") + F.col("kind")).alias("c")))), lambda x: x["c"]), "").alias("codes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            open_, illegal, ways = [], [], []
            for block, first, codes in zip(d["block"], d["first"], d["codes"]):
                left, right = first == block * size, first + len(codes) == (block + 1) * size
                found = []
                for s in range(4) if left else (START,):
                    # whole: the best of the final states
                    for ends in [(t,) for t in range(4)] if right else [FINAL] if not left else [(t,) for t in FINAL]:
                        way = solve(codes, s, ends)
                        if way is not None:
                            found.append({"s": s, "t": way[2], "cost": way[0], "audit": way[1]})
                open_.append(left or right)
                illegal.append(_illegal([(ord(c) - 65) % 4 for c in codes]))
                ways.append(found)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*KEY, "block", "first", "codes")], pa.array(open_), pa.array(illegal, pa.int64()),
                 pa.array(ways, _WAY)], [*KEY, "block", "first", "codes", "open", "illegal", "ways"])

    return groups.mapInArrow(read, f"{_KEY}, block long, first long, codes string, open boolean, illegal long, "
                                   "ways array<struct<s:int,t:int,cost:bigint,audit:string>>")


_WAY = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_CHOSEN = f"{_KEY}, block long, s long, cost long, audit string, illegal long"


def _joined(blocks: DataFrame) -> DataFrame:
    """The chosen way of every block of conversations that go over several, in one pass in their order.

    A state keeps its best way since the last block that all states agree on; earlier ones are written out.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, labels, last, pairs, out = None, {}, None, {}, []

        def emit(piece):
            block, s, cost, audit = piece
            out.append((*key, block, s, cost, audit, pairs.pop(block)))

        def end():
            if key is not None:
                cost, _, pieces = min((c, "".join(p[3] for p in ps), ps) for t, (c, ps) in labels.items() if t in FINAL)
                for p in pieces:
                    emit(p)

        def ready():
            rows = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)],
                                              [*KEY, "block", "s", "cost", "audit", "illegal"])
            out.clear()
            return rows

        for batch in batches:
            for r in batch.to_pylist():
                if (r["_none"], r["_conv"]) != key:
                    end()
                    key, labels, last = (r["_none"], r["_conv"]), {START: (0, [])}, None
                kinds = [(ord(c) - 65) % 4 for c in (r["codes"][0], r["codes"][-1])]
                pairs[r["block"]] = r["illegal"] + (0 if last is None else _illegal([last, kinds[0]]))
                last, new = kinds[1], {}
                for w in r["ways"]:
                    if w["s"] in labels:
                        cost, pieces = labels[w["s"]]
                        found = (cost + w["cost"], [*pieces, (r["block"], w["s"], w["cost"], w["audit"])])
                        old = new.get(w["t"])
                        if old is None or found[0] < old[0] or found[0] == old[0] and "".join(
                                p[3] for p in found[1]) < "".join(p[3] for p in old[1]):
                            new[w["t"]] = found
                labels = new
                ways = [ps for _, ps in labels.values()]
                while len(ways[0]) > 1 and all(ps[0] == ways[0][0] for ps in ways):
                    emit(ways[0][0])
                    for ps in ways:
                        del ps[0]
            if out:
                yield ready()
        end()
        if out:
            yield ready()

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(read, _CHOSEN)


def _edits(chosen: DataFrame) -> DataFrame:
    """_none, _conv, block, k, id (null if inserted), edit, new (role of changed and inserted turns)."""
    names = {USER: "user", ASSISTANT: "assistant"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, out = batch.to_pydict(), []
            for i, audit in enumerate(d["audit"]):
                at, state = 0, d["s"][i]
                for k, e in enumerate(audit):
                    kind = (ord(d["codes"][i][at]) - 65) % 4 if e == "K" else None
                    state = state if e == "D" else NEXT[state] if e in "RI" else kind
                    if e != "D":
                        out.append((i, k, None if e == "I" else d["first"][i] + at, e, None if e == "K" else names[state]))
                    at += e != "I"
            if out:
                row, k, id_, e, new = map(list, zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(row) for c in (*KEY, "block")], pa.array(k, pa.int32()), pa.array(id_, pa.int64()),
                     pa.array(e), pa.array(new, pa.string())], [*KEY, "block", "k", "id", "edit", "new"])

    return chosen.mapInArrow(read, f"{_KEY}, block long, k int, id long, edit string, new string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What repairing ``turns`` (conv_id, turn, role, text) takes and gives, as two tables.

    The first has a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    The second holds the repaired turns: conv_id, block, k (their order), turn, role, text, edit. Inserted turns
    have no number and an empty text; roles other than system, user and assistant (by their first letter; a
    role without letters too) are changed or deleted. A null role or text counts as one space, a null conv_id
    is a conversation of its own, null turns come first, repeated rows are duplicates; turns of equal number
    are ordered by role and text. Other columns are left behind; an empty table gives empty tables.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return _repair(turns.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("_conv"),
        F.col("turn").cast("bigint").alias("turn"), word("role"), word("text")))


def _repair(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = materialise(faults(keyed), "faults")
    conv = F.when(~F.col("_none"), F.col("_conv")).alias("conv_id")
    solved = materialise(_solved(rows.select(*KEY, "id", "fault", "kind")), "solved")
    way = F.col("ways")[0]
    whole = solved.filter("NOT open").select(*KEY, "block", way["s"].alias("s"), way["cost"].alias("cost"),
                                             way["audit"].alias("audit"), "illegal")
    chosen = materialise(whole.unionByName(_joined(solved.filter("open"))), "chosen")
    edits = materialise(_edits(chosen.select(*KEY, "block", "s", "audit").join(
        solved.select(*KEY, "block", "first", "codes"), [*KEY, "block"])), "edits")
    added = edits.filter("id IS NULL").select(conv, "block", "k", F.lit(None).cast("bigint").alias("turn"),
                                              F.col("new").alias("role"), F.lit("").alias("text"), "edit")
    kept = edits.filter("id IS NOT NULL").select("id", "block", "k", "edit", "new").join(rows, "id").select(
        conv, "block", "k", "turn", F.coalesce("new", "role").alias("role"), "text", "edit")
    n = lambda f: F.sum((F.col("fault") == f).cast("bigint"))
    # turns are counted once before their conversation, which may be large
    per_turn = rows.groupBy(*KEY, "turn").agg(n(BLANK).alias("blank"), n(DUPLICATE).alias("duplicate"),
                                              n(TRUNCATED).alias("truncated"))
    counts = per_turn.groupBy(*KEY).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    sums = chosen.groupBy(*KEY).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(
            F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    summary = counts.join(sums, KEY).select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, kept.unionByName(added)


def digests(turns: DataFrame) -> DataFrame:
    """_none, _conv, sha: SHA-256 of the ``role:text`` lines of each conversation.

    Such a digest can only be taken in order: a conversation streams through one task, which holds no more of
    it than the state of the digest.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            d = batch.to_pydict()
            for none, c, role, text in zip(d["_none"], d["_conv"], d["role"], d["text"]):
                if (none, c) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (none, c), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], [*KEY, "sha"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], [*KEY, "sha"])

    keyed = turns.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).alias("_conv"),
                         "block", "k", "role", "text")
    return keyed.repartition(*KEY).sortWithinPartitions(*KEY, "block", "k").drop("block", "k").mapInArrow(
        read, f"{_KEY}, sha string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest of each conversation; those without turns after the damage have zeros."""
    summary, repaired = _repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    key = lambda d: d.select(F.col("conv_id").isNull().alias("_none"), F.coalesce(
        "conv_id", F.lit(0)).alias("_conv"), *[c for c in d.columns if c != "conv_id"])
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = key(every).join(key(summary), KEY, "left").join(digests(repaired), KEY, "left").fillna(zero | {"audit": ""})
    return out.select(F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), *zero, "audit",
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))
