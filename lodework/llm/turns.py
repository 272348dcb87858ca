"""Repair of conversation structure: cheapest edits, ties decided by ranking paths with doubled pointers.

Edits read a conversation's rows in order and move between four states (nothing yet, after the system row, after a user
row, after an assistant row).  A backward pass over (row, state) gives the least cost to the end.  The arcs that keep it
are ranked by the first 1, 2, 4, .. letters of the audit that follows them: an arc's rank for twice as many letters is
the rank of the pair (its rank, the rank of the arc its pointer leads to), and its pointer becomes the pointer's pointer.
A node's least arc by rank starts its least audit, which is read off through the doubled pointers.

Rows are dealt out by ranges of (conversation, turn, role, beginning of the text) and sorted, so a conversation that
holds a large part of the table is spread over tasks.  Conversations that lie inside a range and are not long are
repaired where they are read.  Those at the borders of ranges, and long ones, are cut into pieces of ``PIECE`` rows: a
piece gives the least cost between any two states, these are folded from the end, each piece ranks its own paths for each
state it may be entered in, and the rows stream past once more for the repaired text's hash.  What one task holds of a
conversation is 16 numbers per piece, and the audit, which is a value of its result row.

Defined results: null role and text are one space, also in the damage's checksum; a null conv_id is a conversation of
its own; rows of equal turn are ordered by role and text; a role without a letter can not be kept; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.session import stage

START, SYSTEM, USER, ASSISTANT = range(4)
#: State that an inserted (or re-roled) row leads to, by the state before it.
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FAR = 1 << 40  # no way
#: Rows of a piece of a long conversation, and characters beyond which a conversation counts as long.
PIECE, LONG_CHARS = 4096, 1 << 24
#: Rows of the conversations ranked together.
TOGETHER = 8192


def flaw(text: str) -> int:
    """BLANK, TRUNCATED or 0."""
    end = text.rstrip(SPACE)
    return BLANK if not end else 0 if end[-1] in ".!?" else TRUNCATED


def initial_code(role: str) -> int:
    """0: system, 1: user, 2: assistant, by the first letter; 3: any other role."""
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def costs_to_end(initials: list[int], faults: list[int], end: list[int], tail: bool) -> np.ndarray:
    """Least cost from (row, state) to the end, whose states cost ``end``; at the ``tail`` of a conversation rows may be added."""
    n = len(initials)
    out = np.empty((n + 1, 4), np.int64)
    f0, fs, fu, fa = end
    if tail:
        fu, fa = min(fu, INSERT_COST + fa), min(fa, INSERT_COST + fu)
        f0, fs = min(f0, INSERT_COST + fu), min(fs, INSERT_COST + fu)
    out[n] = f0, fs, fu, fa
    for i in range(n - 1, -1, -1):
        fault, who = faults[i], initials[i]
        c0, cs, cu, ca = f0 + DELETE_COST, fs + DELETE_COST, fu + DELETE_COST, fa + DELETE_COST
        if fault != BLANK and fault != DUPLICATE:
            cut = TRUNCATED_COST if fault == TRUNCATED else 0
            to_user, to_assistant = fu + cut, fa + cut
            change_u, change_a = to_user + REROLE_COST, to_assistant + REROLE_COST
            if who == 1:
                change_u = to_user
            elif who == 2:
                change_a = to_assistant
            c0, cs, ca, cu = min(c0, change_u), min(cs, change_u), min(ca, change_u), min(cu, change_a)
            if who == 0:
                c0 = min(c0, fs + cut)
        fu, fa = min(cu, INSERT_COST + ca), min(ca, INSERT_COST + cu)
        f0, fs = min(c0, INSERT_COST + fu), min(cs, INSERT_COST + fu)
        out[i] = f0, fs, fu, fa
    return np.minimum(out, FAR)


def optimal_arcs(initials, faults, cost: np.ndarray, tail: bool):
    """Arcs (from node, letter, to node) that lie on cheapest paths; a node is 4 * row + state."""
    n = len(initials)
    initials, faults = np.asarray(initials, np.int64), np.asarray(faults, np.int64)
    usable, cut = (faults != BLANK) & (faults != DUPLICATE), np.where(faults == TRUNCATED, TRUNCATED_COST, 0)
    rows, found = np.arange(n), []

    def add(letter, levels, state, step, to, price, allowed):
        keep = allowed & (cost[levels, state] < FAR) & (cost[levels, state] == price + cost[levels + step, to])
        found.append((4 * levels[keep] + state, np.full(keep.sum(), ord(letter)), 4 * (levels[keep] + step) + to))

    may_insert = np.arange(n + 1 if tail else n)
    every = np.ones(n, bool)
    for state in range(4):
        add("D", rows, state, 1, state, DELETE_COST, every)
        add("I", may_insert, state, 0, NEXT[state], INSERT_COST, np.ones(len(may_insert), bool))
        add("K", rows, state, 1, NEXT[state], KEEP_COST + cut, usable & (initials == NEXT[state] - 1))
        add("R", rows, state, 1, NEXT[state], REROLE_COST + cut, usable)
    add("K", rows, START, 1, SYSTEM, KEEP_COST + cut, usable & (initials == 0))
    return tuple(np.concatenate(x) for x in zip(*found))


def least_audits(tails: np.ndarray, letters: np.ndarray, heads: np.ndarray, nodes: int, starts: np.ndarray) -> list[str]:
    """The least audit from each start node over the given arcs, which have no cycle."""
    if not len(tails):
        return ["" for _ in starts]
    end = len(tails)  # the arc after the last one

    def least_arc(rank):
        order = np.lexsort((rank, tails))
        first = np.ones(len(order), bool)
        first[1:] = tails[order][1:] != tails[order][:-1]
        best = np.full(nodes, end)
        best[tails[order][first]] = order[first]
        return best

    rank = np.unique(letters, return_inverse=True)[1] + 1
    best = least_arc(rank)
    follow = np.append(best[heads], end)  # arc that comes 1, 2, 4, .. letters later on the least path
    length = np.append(np.ones(end, np.int64), 0)
    doubled = []
    while True:
        doubled.append(follow)
        if (follow == end).all():
            break
        pair = rank * (end + 1) + np.append(rank, 0)[follow[:-1]]
        rank = np.unique(pair, return_inverse=True)[1] + 1
        length = length + length[follow]
        follow = follow[follow]
    best = np.append(least_arc(rank), end)
    first = best[starts]
    sizes = length[first]
    at = np.repeat(first, sizes)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k, pointer in enumerate(doubled):
        at = np.where(place >> k & 1, pointer[at], at)
    text = np.append(letters, 0)[at].astype(np.uint8).tobytes().decode()
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def audits(pieces: list[tuple]) -> list[list[str | None]]:
    """For each piece (initials, faults, end costs, tail, entry states) the least audits by entry state, None where there is no way."""
    arcs, starts, offset, open_ = [], [], 0, []
    for initials, faults, end, tail, entries in pieces:
        cost = costs_to_end(initials, faults, end, tail)
        a, letters, b = optimal_arcs(initials, faults, cost, tail)
        arcs.append((a + offset, letters, b + offset))
        starts += [offset + state for state in entries]
        open_.append([cost[0, state] < FAR for state in entries])
        offset += 4 * (len(initials) + 1)
    found = iter(least_audits(*(np.concatenate(x) for x in zip(*arcs)), offset, np.array(starts, np.int64)))
    return [[text if ok else None for ok, text in zip(flags, found)] for flags in open_]


class Repair:
    """Reads a conversation's rows in order with their part of the audit; counts faults and hashes the repaired rows."""

    def __init__(self):
        self.state, self.cost, self.illegal, self.faults = START, 0, 0, [0, 0, 0, 0]
        self.low = self.high = self.last_turn = None
        self.turns, self.initial, self.some = 0, None, False
        self.hash = hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def insert(self) -> None:
        self.state = int(NEXT[self.state])
        self.cost += INSERT_COST
        self.write("user" if self.state == USER else "assistant", "")

    def row(self, turn, role: str, text: str, fault: int, edit: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.faults[fault] += 1
        if edit == "D":
            self.cost += DELETE_COST
            return
        self.cost += TRUNCATED_COST if fault == TRUNCATED else 0
        if edit == "R":
            self.cost += REROLE_COST
        if edit == "K" and role[:1] == "s":
            self.state = SYSTEM
        else:
            self.state = int(NEXT[self.state])
        self.write(role if edit == "K" else "user" if self.state == USER else "assistant", text)

    def result(self, audit: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults[1:], self.illegal, self.cost, audit, self.hash.hexdigest())


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
ACCEPTED = [0, FAR, FAR, 0]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after the damage that the checksum of conversation and turn decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).where("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _whole(convs: list[tuple]) -> Iterator[tuple]:
    """(conv_id, result) of conversations given as (conv_id, rows)."""
    pieces = []
    for _, rows in convs:
        seen, faults = set(), []
        for _, role, text in rows:
            fault = flaw(text)
            faults.append(fault if fault == BLANK else DUPLICATE if (role, text) in seen else fault)
            seen.add((role, text))
        pieces.append(([initial_code(r[1]) for r in rows], faults, ACCEPTED, True, [START]))
    for (conv, rows), (_, faults, *_), (audit,) in zip(convs, pieces, audits(pieces)):
        repair, letters = Repair(), iter(audit)
        for (turn, role, text), fault in zip(rows, faults):
            while (edit := next(letters)) == "I":
                repair.insert()
            repair.row(turn, role, text, fault, edit)
        for _ in letters:
            repair.insert()
        yield conv, repair.result(audit)


def _first_pass(id_type: str) -> tuple:
    """Mapper over sorted ranges: results of the conversations inside, rows of those that cross a border or are long."""
    schema = (f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, "
              "range int, place bigint, turn bigint, role string, text string, fault int, digest binary")

    def run(batches):
        convs, size, place = [], 0, 0
        current, rows, chars, is_first, spilt = None, [], 0, True, False
        kind = None

        def results():
            nonlocal convs, size
            made = list(_whole(convs))
            convs, size = [], 0
            columns = [pa.array([c for c, _ in made], kind)]
            columns += [pa.array([r[i] for _, r in made], t) for i, t in enumerate(RESULT_TYPES)]
            columns += [pa.nulls(len(made), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        def spill(conv, number, some):
            """Rows that go on to the pieces."""
            nonlocal place
            m = len(some)
            columns = [pa.array([conv] * m, kind), *(pa.nulls(m, t) for t in RESULT_TYPES), pa.array([number] * m, pa.int32()), pa.array(range(place, place + m), pa.int64()),
                       pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some]), pa.array([r[2] for r in some]), pa.array([flaw(r[2]) for r in some], pa.int32()),
                       pa.array([hashlib.md5(f"{r[1]}\0{r[2]}".encode("utf-8", "surrogatepass")).digest() for r in some], pa.binary())]
            place += m
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["conv_id", *RESULT, "range", "place", "turn", "role", "text", "fault", "digest"]
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            ids, turns, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            number = batch.column(4)[0].as_py()
            for conv, turn, role, text in zip(ids, turns, roles, texts):
                if current is None or current[0] != conv:
                    if current is not None:
                        if is_first or spilt:
                            if rows:
                                yield spill(current[0], number, rows)
                        else:
                            convs.append((current[0], rows))
                            size += len(rows)
                            if size >= TOGETHER:
                                yield results()
                        is_first = False
                    current, rows, chars, spilt = (conv,), [], 0, False
                rows.append((turn, role, text))
                chars += len(text)
                if len(rows) >= PIECE or chars > LONG_CHARS:
                    yield spill(conv, number, rows)
                    rows, chars, spilt = [], 0, True
        if current is not None:
            if rows:  # the last one may go on in the next range
                yield spill(current[0], number, rows)
            if convs:
                yield results()

    return run, schema


def _pieces(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``range``, ``piece``, ``codes`` (initial and fault of each row, in order) of the rows of long conversations."""
    code = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    coded = rows.select("conv_id", "range", "piece", F.struct("place", (code * 4 + F.col("fault")).alias("code")).alias("item"))
    return coded.groupBy("conv_id", "range", "piece").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["code"]).alias("codes"))


def _transfers(codes: list[int]) -> list[int]:
    """Least cost from each state to each state, 16 numbers."""
    initials, faults = [c >> 2 for c in codes], [c & 3 for c in codes]
    return [int(x) for to in range(4) for x in costs_to_end(initials, faults, [0 if s == to else FAR for s in range(4)], False)[0]]


def _long(rows: DataFrame, id_type: str) -> DataFrame:
    """Results of the conversations whose rows went on to the pieces."""
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("range", "place")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    again = (F.struct("range", "place") != F.col("first")) & (F.col("fault") != BLANK)
    rows = stage(rows.join(firsts, (F.col("digest") == F.col("d")) & F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "range", "place", F.expr(f"place div {PIECE}").alias("piece"), "turn", "role", "text", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "turns-rows")
    pieces = stage(_pieces(rows), "turns-pieces")

    def steps(batches):
        for batch in batches:
            found = [_transfers(codes) for codes in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["conv_id", "range", "piece", "least"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        """Cost to the end of the conversation at the end of each of its pieces, from the last piece back."""
        group = group.sort_values(["range", "piece"], kind="stable", ignore_index=True)
        least = np.stack(group["least"].to_numpy()).reshape(-1, 4, 4)  # piece, to, from
        ends, end = [None] * len(least), None
        for i in range(len(least) - 1, -1, -1):
            if end is None:  # the tail ranks its own end
                ends[i] = ACCEPTED
                end = costs_to_end([], [], ACCEPTED, True)[0]
            else:
                ends[i] = end.tolist()
            end = np.minimum((least[i] + end[:, None]).min(axis=0), FAR)
        return pd.DataFrame({"conv_id": group["conv_id"], "range": group["range"], "piece": group["piece"], "ends": ends, "tail": [i == len(ends) - 1 for i in range(len(ends))]})

    matrices = pieces.mapInArrow(steps, f"conv_id {id_type}, range int, piece bigint, least array<bigint>")
    folded = matrices.groupBy("conv_id").applyInPandas(fold, f"conv_id {id_type}, range int, piece bigint, ends array<bigint>, tail boolean")
    folded = folded.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.col("piece").alias("p"), "ends", "tail")
    joined = pieces.join(folded, (F.col("range") == F.col("r")) & (F.col("piece") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))

    def rank(batches):
        for batch in batches:
            pieces = [([c >> 2 for c in codes], [c & 3 for c in codes], ends, tail, range(4))
                      for codes, ends, tail in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            found = audits(pieces) if pieces else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], ["conv_id", "range", "piece", "audits"])

    ranked = joined.select("conv_id", "range", "piece", "codes", "ends", "tail").mapInArrow(rank, f"conv_id {id_type}, range int, piece bigint, audits array<string>")
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = ranked.select("conv_id", "range", "piece", F.lit(-1).cast("bigint").alias("place"), "audits", nothing("bigint").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("int").alias("fault"))
    lines = rows.select("conv_id", "range", "piece", "place", nothing("array<string>").alias("audits"), "turn", "role", "text", "fault")
    # a hash over a conversation's text has to read it in order: its rows stream through one task, which keeps none of them
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "range", "piece", "place")

    def read(batches):
        current, repair, audit, letters, kind, done = None, None, [], iter(()), None, []

        def close():
            for _ in letters:
                repair.insert()
            done.append((current[0], repair.result("".join(audit))))

        def give():
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), *(pa.array([r[i] for _, r in done], t) for i, t in enumerate(RESULT_TYPES))], ["conv_id", *RESULT])
            done.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            for conv, found, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7, 8))):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, repair, audit, letters = (conv,), Repair(), [], iter(())
                if found is not None:
                    audit.append(found[repair.state])
                    letters = iter(audit[-1])
                    continue
                while (edit := next(letters)) == "I":
                    repair.insert()
                repair.row(turn, role, text, fault, edit)
            if len(done) > TOGETHER:
                yield give()
        if current is not None:
            close()
            yield give()

    types = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return stream.mapInArrow(read, f"conv_id {id_type}, {types}")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its faults after damage, the cost and audit of its cheapest repair and the hash of the result."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    # a beginning of the text sorts like the text, so that ranges may cut between rows of equal turn and role
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    run, schema = _first_pass(id_type)
    passed = stage(ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("range")).mapInArrow(run, schema), "turns-passed")
    inside = passed.where("audit IS NOT NULL").select("conv_id", *RESULT)
    across = _long(passed.where("audit IS NULL").select("conv_id", "range", "place", "turn", "role", "text", "fault", "digest"), id_type)
    results = inside.unionByName(across).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(results, every["conv_id"].eqNullSafe(results["c"]), "left")
    nothing = hashlib.sha256().hexdigest()
    defaults = {**{name: F.lit(0).cast("bigint") for name in RESULT[:6]}, "audit": F.lit(""), "repaired_sha256": F.lit(nothing)}
    return joined.select("conv_id", *(F.coalesce(name, default).alias(name) for name, default in defaults.items()))
