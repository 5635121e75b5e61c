"""Conversation structure repair: the cheapest edits that turn a conversation's roles into (s?(ua)+)?.

A conversation is a row of turns. Faults of a turn: blank (nothing but spaces), duplicate (role and text seen
earlier), truncated (the last character that is no space is none of ``.!?``); the first that holds counts. Edits:
Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate turns), Insert an empty user or
assistant turn anywhere 5; a truncated turn that stays costs 5 more. The cheapest edits are written as their initials
in order; ties go to the string that is least by ASCII.

Nodes of the edit lattice are (turns consumed, state of the role pattern). Bidirectional Dijkstra searches it: a heap
from the start and a heap from the end take turns, and go on until no two unsettled nodes could meet at the best cost,
so that every crossing of that cost is known. Every node of a cheapest path is then settled from at least one side.
A letter leads from a node to one other, so the least string is read off by following the least letter that stays on a
cheapest path: backwards from the crossings the forward side is marked, on the other side the reverse distances tell.

A long conversation is cut into chunks of ``CHUNK`` turns, searched each between all states it may begin and end in,
in tasks of their own; the few results of a chunk are then joined along the conversation. That is exact: letters fix
costs, so of two cheapest strings to the same node neither begins with the other. Texts never meet in one task's memory:
they go sorted through a digest. What is one value per conversation is its string of edits, a byte or so a turn.

Corner cases: null roles and texts are one space; turns stand in the order of turn (null first), role, text, copy;
a repeated row is a turn of its own (and so a duplicate); a null conv_id is one conversation; a role whose initial is
none of s, u and a cannot be kept; an empty table gives no rows; other columns are left out. Long texts cost nothing
in the search, which sees a code per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.saved import saved

CHUNK = 2048
SPACES = "\t\n\x0b\x0c\r "
#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_WANTED = (USER, USER, ASSISTANT, USER)  # the role an edit gives in each state
_ENDS = (NOTHING, ASSISTANT)
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 1, 2, 5, 5
_FAR = 1 << 40
Edge = tuple[str, int, int]


def _moves(initial: str, fault: str) -> list[list[Edge]]:
    """For each state the edits of a turn, least letter first: (move, cost, next state). Moves: D, K, U and A (rerole)."""
    extra = _TRUNCATED if fault == "t" else 0
    out = []
    for state in range(4):
        edges = [("D", _DELETE, state)]
        if fault not in "bd":
            if (kept := _NEXT.get(initial, (None,) * 4)[state]) is not None:
                edges.append(("K", _KEEP + extra, kept))
            edges.append(("UA"[_WANTED[state] == ASSISTANT], _REROLE + extra, _WANTED[state]))
        out.append(edges)
    return out


_TABLE = {(i, f): _moves(i, f) for i in "sua-" for f in "bdt."}


class Lattice:
    """The edit lattice of a run of turns, each given as (initial, fault) codes; node 4 * turns consumed + state."""

    def __init__(self, codes: str):
        self.rows = [_TABLE[codes[i], codes[i + 1]] for i in range(0, len(codes), 2)]
        self.n = len(self.rows)

    def after(self, node: int) -> list[Edge]:
        """Edges out of a node, least audit letter first (D, I, K, R)."""
        i, state = divmod(node, 4)
        insert = ("ua"[_WANTED[state] == ASSISTANT], _INSERT, 4 * i + _WANTED[state])
        if i == self.n:
            return [insert]
        first, *rest = ((move, cost, 4 * i + 4 + to) for move, cost, to in self.rows[i][state])
        return [first, insert, *rest]

    def before(self, node: int) -> list[tuple[int, int]]:
        """(cost, node) of the edges into a node."""
        i, state = divmod(node, 4)
        out = [(_INSERT, 4 * i + s) for s in range(4) if _WANTED[s] == state]
        if i:
            out += [(cost, 4 * i - 4 + s) for s in range(4) for _, cost, to in self.rows[i - 1][s] if to == state]
        return out

    def search(self, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
        """(cost, moves) of the cheapest way from a first state to one of the last states, None where there is none."""
        size, ends = 4 * self.n + 4, [4 * self.n + g for g in goals]
        ahead, back = [_FAR] * size, [_FAR] * size
        done, met = bytearray(size), bytearray(size)
        ahead[start] = 0
        forward, reverse = [(0, start)], []
        for g in ends:
            back[g] = 0
            reverse.append((0, g))
        best = min((back[start], _FAR))
        while forward and reverse and forward[0][0] + reverse[0][0] <= best:
            if len(forward) <= len(reverse):
                cost, node = heappop(forward)
                if done[node]:
                    continue
                done[node] = 1
                for _, c, to in self.after(node):
                    if cost + c < ahead[to]:
                        ahead[to] = cost + c
                        heappush(forward, (cost + c, to))
                        best = min(best, cost + c + back[to])
            else:
                cost, node = heappop(reverse)
                if met[node]:
                    continue
                met[node] = 1
                for c, to in self.before(node):
                    if cost + c < back[to]:
                        back[to] = cost + c
                        heappush(reverse, (cost + c, to))
                        best = min(best, cost + c + ahead[to])
        return None if best >= _FAR else (best, self._least(start, ends, best, ahead, back))

    def _least(self, start, ends, best, ahead, back) -> str:
        """The least string over all crossings of the best cost. Distances that add up to the best cost are final, heap or no heap."""
        on_path = bytearray(len(ahead))
        todo = []
        for node in range(len(ahead)):
            if ahead[node] <= best and (
                ahead[node] + back[node] == best or any(ahead[node] + c + back[to] == best for _, c, to in self.after(node))
            ):
                on_path[node] = 1
                todo.append(node)
        while todo:
            node = todo.pop()
            for c, of in self.before(node):
                if not on_path[of] and ahead[of] + c == ahead[node]:
                    on_path[of] = 1
                    todo.append(of)
        out, node, cost, last = [], start, 0, set(ends)
        while cost < best or node not in last:
            for move, c, to in self.after(node):
                now = cost + c
                if now + back[to] == best or on_path[to] and now == ahead[to]:
                    out.append(move)
                    node, cost = to, now
                    break
            else:
                raise AssertionError("a cheapest path has no next edge")
        return "".join(out)


def audit_of(moves: str) -> str:
    return moves.translate(str.maketrans("UAua", "RRII"))


def joined_chunks(parts: list[tuple[int, int, int, int, str]]) -> tuple[int, str]:
    """(cost, moves) of a conversation from (chunk, first state, last state, cost, moves) of its chunks."""
    reached: dict[int, tuple[int, str, str]] = {NOTHING: (0, "", "")}
    by_chunk: dict[int, list] = {}
    for chunk, first, last, cost, moves in parts:
        by_chunk.setdefault(chunk, []).append((first, last, cost, moves))
    for _, ways in sorted(by_chunk.items()):
        found: dict[int, list] = {}
        for first, last, cost, moves in ways:
            if first in reached:
                c, audit, so_far = reached[first]
                found.setdefault(last, []).append((c + cost, audit + audit_of(moves), so_far + moves))
        reached = {last: min(ways) for last, ways in found.items()}
    cost, _, moves = min(reached[s] for s in _ENDS if s in reached)
    return cost, moves


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (from 0), initial, fault (``b``, ``d``, ``t`` or ``.``), illegal (boolean)."""
    said = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", "turn", *said, *(["copy"] if "copy" in turns.columns else [F.lit(0).alias("copy")]))
    rows = rows.repartition("conv_id")  # all windows below go by conversation
    order = (F.asc_nulls_first("turn"), "role", "text", "copy")
    kept = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order[0], "copy")) > 1)
    line = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(line) - 1).withColumn("initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("initial").over(line), "initial")
    fault = F.when(kept == "", "b").when(F.col("seen"), "d").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".")
    rows = rows.withColumn("fault", fault).withColumn("illegal", ~F.coalesce(pair.isin("su", "ua", "au"), pair.isNull()))
    return rows.select("conv_id", "turn", "role", "text", "place", "initial", "fault", "illegal")


_FOUND = "conv_id bigint, chunk bigint, chunks bigint, first int, last int, cost bigint, moves string"


def _search_chunks(batches: Iterator[pa.RecordBatch]):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        for conv, chunk, chunks, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "chunks", "codes")), strict=True):
            lattice = Lattice(codes)
            firsts = [NOTHING] if chunk == 0 else range(4)
            lasts = [_ENDS] if chunks == 1 else [(s,) for s in (range(4) if chunk < chunks - 1 else _ENDS)]
            for first in firsts:
                for goals in lasts:
                    if (way := lattice.search(first, goals)) is not None:
                        out.append((conv, chunk, chunks, first, goals[0], *way))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])


def _join_group(pdf):
    cost, moves = joined_chunks(list(pdf[["chunk", "first", "last", "cost", "moves"]].itertuples(index=False, name=None)))
    return pdf.head(1)[["conv_id"]].assign(cost=cost, moves=moves)


def cheapest_edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, cost, moves of every conversation in ``placed`` rows. Moves: K, D, U and A (rerole), u and a (insert)."""
    code = F.concat(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-"), "fault")
    rows = rows.select("conv_id", "place", code.alias("code"), F.floor(F.col("place") / chunk).alias("chunk"))
    parts = rows.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("codes"))
    parts = parts.withColumn("chunks", F.max("chunk").over(Window.partitionBy("conv_id")) + 1)
    found = saved(parts.mapInArrow(_search_chunks, _FOUND))
    long_ones = found.where("chunks > 1").groupBy("conv_id").applyInPandas(_join_group, "conv_id bigint, cost bigint, moves string")
    return found.where("chunks = 1").select("conv_id", "cost", "moves").unionByName(long_ones)


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place, step, role, text: what is left of ``placed`` rows after ``edits``, in the order of place, step.

    A step of a place is an inserted turn before it or, last of all, the turn of that place.
    """
    moves = edits.select("conv_id", F.posexplode(F.split("moves", "(?<=[KDUA])")).alias("place", "moves"))
    edited = moves.select("conv_id", "place", F.posexplode(F.split("moves", "(?<=.)(?=.)")).alias("step", "move")).where("move NOT IN ('', 'D')")
    kept = edited.where("move IN ('K', 'U', 'A')")
    same = (F.col("r.conv_id").eqNullSafe(F.col("e.conv_id"))) & (F.col("r.place") == F.col("e.place"))
    role = F.when(F.col("move") == "K", F.col("role")).otherwise(_role("move"))
    stay = rows.alias("r").join(kept.alias("e"), same).select("r.conv_id", "r.place", "step", role.alias("role"), "text")
    new = edited.where("move IN ('u', 'a')").select("conv_id", "place", "step", _role("move").alias("role"), F.lit("").alias("text"))
    return stay.unionByName(new)


def _role(move: str) -> Column:
    return F.when(F.lower(F.col(move)) == "u", "user").otherwise("assistant")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the hash of ``role:text`` of a conversation's repaired turns, joined by line breaks.

    Turns are sorted by conversation and go through the hash a batch at a time, whatever the length of a conversation.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield _hashes(out)
        if state is not None:
            yield _hashes([(now, state.hexdigest())])

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return lines.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, every: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: counts of what is wrong, the cheapest edits and a digest of the repaired turns.

    ``every`` names further conversations (conv_id) that may have no turns: zeros, no edits, the hash of nothing.
    """
    rows = saved(placed(conversations.withColumn("conv_id", F.col("conv_id").cast("bigint"))))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = [F.sum((F.col("fault") == f).cast("bigint")).alias(n) for n, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))]
    wrong = rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), *counts, F.sum(F.col("illegal").cast("bigint")).alias("illegal"))
    edits = saved(cheapest_edits(rows, chunk))
    hashes = digests(repaired_turns(rows, edits))
    ids = rows.select("conv_id") if every is None else every.select(F.col("conv_id").cast("bigint").alias("conv_id"))
    out = ids.distinct()
    for part in (wrong, edits.select("conv_id", "cost", F.translate("moves", "UAua", "RRII").alias("audit")), hashes):
        other = part.withColumnRenamed("conv_id", "other_id")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zeros = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows damaged by crc32 of ``conv_id:turn`` modulo 20 (a null is one space).

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("how", F.crc32(F.concat_ws(":", *part)) % 20).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
