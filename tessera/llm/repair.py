"""Conversation structure repair: the cheapest edits that make a conversation alternate, by A* on the edit lattice.

Rows are kept, given another role or deleted, and turns without a text are inserted, so that the initials of the roles read `(s?(ua)+)?`. A lattice node is (rows done, state of
that pattern). What is left to pay has a bound from suffix sums: each blank or repeated row ahead must be deleted, and each cut-off row ahead costs its charge, as deleting it
costs more. Nodes are taken by (cost plus bound, audit), where the audit is the string of edits so far, so the first goal is the cheapest, and of equal ones the first in ASCII order.
(Two audits that reach one node at one cost are never prefixes of each other, so what follows can't turn their order.)

Long conversations are searched in blocks of rows, from each state to each state; a conversation's blocks pass in order through a fold that keeps the best path to each state and gives
out what all of them share. So no step holds a conversation: what a task keeps of one is a hash, the audit, and paths that haven't met yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLOCK = 256
#: States of the pattern: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The role that an inserted or renamed turn has, by state, and the state after it.
NEXT = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: (state, other): what it costs at most to go on from state as from other, so a way to other that costs more than that in addition is of no use.
#: After a, all goes on as after s; as at the beginning too, but that an s must be deleted; one inserted turn leads from u to a and back.
INSTEAD = {(ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE, (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): INSERT + DELETE}
SPACES = " \t\n\x0b\x0c\r"
Found = dict[int, tuple[int, str]]


def search(codes: str, start: int = START, last: bool = True) -> Found:
    """The cheapest (cost, audit) by state that rows can end in; with `last` only the best end.

    A row's code: x for one that must go, else the initial of its role (s, u, a, or o for any other), in capitals if its text is cut off. Turns after the last row are
    inserted only if it is the conversation's last.
    """
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] == "x" else CUT_OFF if codes[i].isupper() else 0)
    heap, done, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        bound, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - ahead[i]
        if i == n and last and state in ENDS:
            return {state: (cost, audit)}
        if i == n and not last:
            found[state] = (cost, audit)
            continue
        heappush(heap, (cost + INSERT + ahead[i], audit + "I", i, AFTER[state]))
        if i < n:
            heappush(heap, (cost + DELETE + ahead[i + 1], audit + "D", i + 1, state))
            if (code := codes[i]) != "x":
                charge = CUT_OFF if code.isupper() else 0
                heappush(heap, (cost + REROLE + charge + ahead[i + 1], audit + "R", i + 1, AFTER[state]))
                if (then := KEPT.get((code.lower(), state))) is not None:
                    heappush(heap, (cost + charge + ahead[i + 1], audit + "K", i + 1, then))
    return found


_short = lru_cache(200_000)(search)


class Fold:
    """Best paths through the blocks of one conversation, in order. What all of them begin with is settled and given out."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str, list[tuple[int, str]]]] = {START: (0, "", [])}

    def step(self, block: int, codes: str, last: bool) -> list[tuple[int, str]]:
        find = _short if len(codes) <= 64 else search
        new: dict[int, tuple[int, str, list[tuple[int, str]]]] = {}
        for state, (cost, audit, path) in self.best.items():
            for to, (more, edits) in find(codes, state, last).items():
                if to not in new or (cost + more, audit + edits) < new[to][:2]:
                    new[to] = (cost + more, audit + edits, [*path, (block, edits)])
        if last:
            return min(new.values())[2]
        useless = {to for (state, to), more in INSTEAD.items() if state in new and to in new and new[state][0] + more < new[to][0]}
        new = {s: way for s, way in new.items() if s not in useless}
        first = next(iter(new.values()))[2]
        shared = 0
        while shared < len(first) and all(path[shared] == first[shared] for *_, path in new.values()):
            shared += 1
        skip = sum(len(edits) for _, edits in first[:shared])
        self.best = {s: (cost, audit[skip:], path[shared:]) for s, (cost, audit, path) in new.items()}
        return first[:shared]


def streamed(df: DataFrame, columns: Sequence[str], order: str, schema: str, make: Callable[[], Any]) -> DataFrame:
    """conv_id and the columns of schema: rows of each conversation pass, in order, through an object of make(), whose row(*values, last) gives rows.

    A conversation is in one partition, sorted, and passes row by row, so it isn't gathered.
    """
    kind = StructType([df.schema["conv_id"], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, out = None, None, []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

        size = 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting is not None:
                    last = waiting[0] != values[0]
                    out += [(waiting[0], *r) for r in current.row(*waiting[1:], last)]
                if waiting is None or waiting[0] != values[0]:
                    current = make()
                waiting = values
                size += sum(len(v) for v in values if isinstance(v, str))
                if out and (len(out) >= 1000 or size > 1 << 20):
                    yield table(out)
                    out, size = [], 0
        if waiting is not None:
            out += [(waiting[0], *r) for r in current.row(*waiting[1:], True)]
        if out:
            yield table(out)

    common.bound_batches(df.sparkSession)
    return df.select("conv_id", *columns).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), order).select("conv_id", *columns).mapInArrow(run, kind)


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, fault (blank, duplicate, truncated or null) of rows conv_id, turn, role, text.

    Rows go in order of turn (nulls first), then role and text. A row is blank without a character besides ASCII white space, a duplicate if an earlier row has its role and text, and truncated if
    its last such character isn't one of `.!?`; the first of these counts. Null roles and texts are one space. A null conv_id is a conversation like any other.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("_one"))
    rows = common.prefix_sums(plain, {"_one": "place"}, ["turn", "role", "text"], ["conv_id"]).drop("_one")
    rows = common.stored(rows, "placed")
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("place").alias("place")).select("conv_id", "place", F.lit(True).alias("first"))
    r, f = rows.alias("r"), firsts.alias("f")
    joined = r.join(f, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.place") == F.col("f.place")), "left")
    said = F.rtrim(F.col("r.text"), F.lit(SPACES))
    fault = F.when(said == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(said, F.lit(1)).isin(*".!?"), "truncated")
    return joined.select(*(f"r.{c}" for c in ("conv_id", "place", "turn", "role", "text")), fault.alias("fault"))


def edited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """faulted() rows with `edits`: I for each turn inserted before a row, then K, R or D for the row; inserts at the end stand with the last row."""
    spark = rows.sparkSession
    rows = common.stored(rows, "faulted")
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    blocks = rows.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", code.alias("code")))).alias("all"))
    blocks = blocks.select("conv_id", "block", F.array_join("all.code", "").alias("codes"))

    class Blocks(Fold):
        def row(self, number: int, codes: str, last: bool) -> list[tuple[int, str]]:
            return self.step(number, codes, last)

    found = streamed(blocks, ["block", "codes"], "block", "block long, audit string", Blocks)
    single = found.select("conv_id", "block", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+$)?"), F.lit(0))).alias("at", "edits"))
    single = single.select("conv_id", (F.col("block") * block + F.col("at")).alias("place"), "edits")
    r, e = rows.alias("r"), common.stored(single, "edits").alias("e")
    joined = r.join(e, F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("r.place") == F.col("e.place")))
    return joined.select(*(f"r.{c}" for c in rows.columns), "e.edits")


class _Turns:
    """The repaired turns of one conversation, row by row: (place among them, edit, role, text)."""

    def __init__(self) -> None:
        self.state, self.n = START, 0

    def row(self, role: str, text: str, edits: str, last: bool) -> list[tuple[int, str, str, str]]:
        out = []
        for edit in edits:
            if edit == "D":
                continue
            new = (role, text) if edit == "K" else (NEXT[self.state], text if edit == "R" else "")
            self.state = KEPT[role[:1], self.state] if edit == "K" else AFTER[self.state]
            out.append((self.n, edit, *new))
            self.n += 1
        return out


class _Summary:
    """Counts, costs, audit and hash of one conversation; the row after the last gives them."""

    def __init__(self) -> None:
        self.turns, self.hash, self.audit, self.cost, self.illegal, self.before = _Turns(), hashlib.sha256(), [], 0, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.turn = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, fault: str | None, edits: str, last: bool) -> list[tuple]:
        if turn is not None and turn != self.turn:
            self.low, self.turn, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        for place, _, r, t in self.turns.row(role, text, edits, last):
            self.hash.update(f"{chr(10) if place else ''}{r}:{t}".encode("utf-8", "surrogatepass"))
        self.cost += sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[x] for x in edits) + CUT_OFF * (fault == "truncated" and "D" not in edits)
        self.audit.append(edits)
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.distinct
        return [(gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())] if last else []


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of edited() rows: conv_id, n (from 0), edit (K, R or I), role, text. Conversations that lose all rows have none."""
    return streamed(rows.withColumn("_place", F.col("place")), ["role", "text", "edits"], "_place", "n long, edit string, role string, text string", _Turns)


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation of edited() rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` joined by line feeds)."""
    kind = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return streamed(rows, ["turn", "role", "text", "fault", "edits"], "place", kind, _Summary)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn` modulo 20 (nulls are written as one space):

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes its role user; other rows stay.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations as the contract says, repair them, and give each one's counts, costs and digests.

    A conversation that the damage leaves without rows has zeros, an empty audit and the hash of an empty text.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = summaries(edited(faulted(damaged(turns)))).alias("g")
    every = turns.select("conv_id").distinct().alias("c")
    joined = every.join(got, F.col("c.conv_id").eqNullSafe(F.col("g.conv_id")), "left")
    counts = [F.coalesce(f"g.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("c.conv_id", *counts, F.coalesce("g.audit", F.lit("")).alias("audit"), F.coalesce("g.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
