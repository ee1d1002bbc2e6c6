"""Repair of damaged conversations by iterative-deepening A*.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Rows are
kept (0), given the role that fits (2), deleted (3; blank rows and repeats have
to be) or preceded by an inserted empty row (2); a truncated row that stays
costs 1 more. The search is depth-first in ASCII order of the edits (``D``, ``I``,
``K``, ``R``) under a growing cost bound, so the first path that it accepts is the
cheapest and, of equal ones, the least. States that failed are remembered with
the budget they had.

Rows are range-partitioned by conversation and turn, so a conversation of any
length is spread over tasks; texts are sorted there and stay. What the search
needs of a row is two letters, collected in chunks of at most ``1 << CHUNK`` rows.
One task then holds the letters of a conversation and searches it in pieces of
``PIECE`` rows, last piece first, once per state in which a piece may begin; only
inserts before a row belong to its piece, so the least string of each piece makes
the least string of all. Texts are not held: they stream through in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Buffer, map_rows, rows, stage

CHUNK = 12  # bits of a row number inside a chunk
PIECE = 32
KEPT_CHARACTER = r"[^\x20\x09-\x0D]"
COMPLETE = r"[.!?][\x20\x09-\x0D]*\z"

# ---- fixed values: edits and the states of the role pattern ------------------
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = (2, 2, 3, 2)  # state after an inserted or rewritten row
ROLE = {2: "user", 3: "assistant"}
AT_END = (0, 4, 2, 0)  # cost of the inserts that complete the pattern
COMPLETION = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
# -----------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, dropped`` after the damage that crc32 of
    ``conv_id:turn`` names: one in twenty each is dropped (it stays as a mark
    without role and text), emptied, stripped of ``.!?``, repeated, made a user's.
    A null counts as one space."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    hit = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).when(k != 0, F.col("text"))
    times = F.when(k == 3, 2).otherwise(1)
    changed = hit.select("conv_id", "turn", F.when(k == 4, "user").when(k != 0, F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"), times.alias("times"))
    return changed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "__copy")


def ordered(turns: DataFrame) -> DataFrame:
    """Staged rows in the order of conversation, turn (nulls first), role and
    text, with their row number ``at``, ``fault`` (without repeats) and ``initial``."""
    whole = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("dropped", F.lit(False)).alias("dropped") if "dropped" in turns.columns else F.lit(False).alias("dropped"))
    sort = ["conv_id", "turn", "role", "text"]
    spread = whole.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*sort)
    fault = (F.when(F.col("dropped"), "x").when(~F.col("text").rlike(KEPT_CHARACTER), "b")
             .when(~F.col("text").rlike(COMPLETE), "t").otherwise("o"))
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("?")
    digest = F.when(fault.isin("t", "o"), F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256))
    return stage(spread.select(F.monotonically_increasing_id().alias("at"), *sort, fault.alias("fault"), initial.alias("initial"), digest.alias("digest")), "turns")


def coded(rows_: DataFrame) -> DataFrame:
    """Per conversation and chunk the two letters of each row, in order, and the
    extent of its turns. Repeats are found on digests; the row numbers that meet
    in the join are unique, so no conversation or text is a hot key."""
    firsts = rows_.where(F.col("digest").isNotNull()).groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("digest").isNotNull() & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    present = F.col("fault") != "x"
    narrow = rows_.select("conv_id", "turn", "at", "fault", "initial", "digest").join(firsts, "at", "left").select(
        "conv_id", F.shiftright("at", CHUNK).alias("chunk"), F.when(present, F.col("turn")).alias("turn"),
        F.when(present, F.struct("at", F.concat(fault, "initial").alias("letters"))).alias("row"))
    chunks = narrow.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list("row")).alias("list"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    return chunks.select("conv_id", "chunk", F.array_join(F.transform("list", lambda r: r["letters"]), "").alias("letters"), "low", "high", "turns")


def search(letters: str, state: int, after: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost (with ``after``, by the state at the end), edits and last state of the
    cheapest repair of some rows from ``state`` on."""
    faults, initials = letters[::2], letters[1::2]
    n, tail = len(faults), min(after)
    forced = [f in "bd" for f in faults]
    least, following = [tail] * (n + 1), [""] * (n + 1)  # cost that is certain from row i on; the next initial that may stay
    for i in range(n - 1, -1, -1):
        if forced[i]:
            least[i], following[i] = least[i + 1] + DELETE, following[i + 1]
        else:
            # an edit mends two wrong neighbours at most, for 2 beyond what is counted
            broken = following[i + 1] != "" and initials[i] + following[i + 1] not in LEGAL
            least[i], following[i] = least[i + 1] + broken + TRUNCATED * (faults[i] == "t"), initials[i]
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def descend(i: int, q: int, budget: int) -> int:
        """The last state of the first path within ``budget``, or -1."""
        if i == n:
            return q if after[q] <= budget else -1
        wrong = following[i] != "" and (q, following[i]) not in NEXT
        if least[i] + wrong > budget or failed.get((i, q), -1) >= budget:
            return -1
        stays = TRUNCATED * (faults[i] == "t")
        steps = [("D", i + 1, q, DELETE)]
        if not forced[i]:
            steps += [("I", i, FILL[q], INSERT)]
            if (kept := NEXT.get((q, initials[i]))) is not None:
                steps += [("K", i + 1, kept, KEEP + stays)]
            steps += [("R", i + 1, FILL[q], REROLE + stays)]
        for name, row, to, cost in steps:
            if cost <= budget:
                path.append(name)
                if (end := descend(row, to, budget - cost)) >= 0:
                    return end
                path.pop()
        failed[i, q] = budget
        return -1

    bound = least[0]
    while (end := descend(0, state, bound)) < 0:
        bound += 1
    return bound, "".join(path), end


def edits(chunks: list[str]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and per chunk the state it begins in and its edits."""
    pieces = [(c, letters[i : i + 2 * PIECE]) for c, letters in enumerate(chunks) for i in range(0, len(letters), 2 * PIECE)]
    found, after = [], AT_END
    for k in range(len(pieces) - 1, -1, -1):
        starts = range(4) if k else (0,)
        found.append([search(pieces[k][1], q, after) for q in starts])
        after = tuple(x[0] for x in found[-1])
    state, cost = 0, after[0]
    out = [[0, ""] for _ in chunks]
    seen = -1
    for (c, _), options in zip(pieces, reversed(found)):
        for skipped in range(seen + 1, c + 1):
            out[skipped][0] = state
        seen = c
        _, path, end = options[state]
        out[c][1] += path
        state = end
    for skipped in range(seen + 1, len(chunks)):
        out[skipped][0] = state
    out[-1][1] += COMPLETION[state]
    return cost, [(q, path) for q, path in out]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _groups(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Adjacent rows with the same first value."""
    group: list[tuple] = []
    for row in rows(batches, *names):
        if group and row[0] != group[0][0]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def plan(chunks: DataFrame) -> DataFrame:
    """Staged edits per conversation and chunk; the last chunk's row also has the
    conversation's counts, ``cost`` and ``audit``."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out_schema = pa.schema([("conv_id", _arrow(kind)), ("chunk", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), *[(n, pa.int64()) for n in names], ("audit", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buffer(out_schema)
        for group in _groups(batches, "conv_id", "chunk", "letters", "low", "high", "turns"):
            cost, parts = edits([g[2] for g in group])
            counts, illegal, before = dict.fromkeys("bdt", 0), 0, ""
            low, high, distinct = None, None, 0
            for _, _, letters, first, last, turns in group:
                initials = letters[1::2]
                for fault in counts:
                    counts[fault] += letters[::2].count(fault)
                pairs = before + initials
                illegal += sum(pairs[i : i + 2] not in LEGAL for i in range(len(pairs) - 1))
                before = pairs[-1:]
                if first is not None:
                    distinct += turns - (first == high)
                    low, high = first if low is None else low, last
            gaps = min(high - low + 1 - distinct, 2**63 - 1) if distinct else 0
            last = (gaps, *counts.values(), illegal, cost, "".join(p for _, p in parts))
            for k, (row, (state, path)) in enumerate(zip(group, parts)):
                out.add(row[0], row[1], state, path, *(last if k == len(group) - 1 else [None] * len(last)), weight=2 * len(path))
                if out.full():
                    yield out.take()
        yield out.take()

    longs = ", ".join(f"{n} bigint" for n in names)
    return stage(map_rows(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), solve,
                          f"conv_id {kind}, chunk bigint, state int, edits string, {longs}, audit string"), "turn-edits")


@dataclass
class Repair:
    rows: DataFrame  # the rows in order, staged
    edits: DataFrame  # per conversation and chunk, staged

    def conversations(self) -> DataFrame:
        """Per conversation its counts, ``cost`` and ``audit``."""
        return self.edits.where(F.col("audit").isNotNull()).drop("chunk", "state", "edits")

    def turns(self) -> DataFrame:
        """The repaired rows ``conv_id, edit, role, text``, each conversation's
        adjacent and in order. Texts pass one by one."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        chunk = F.shiftright("at", CHUNK).alias("chunk")
        null = F.lit(None).cast("string")
        both = self.edits.select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), "state", F.col("edits").alias("role"), null.alias("text")).unionByName(
            self.rows.where(F.col("fault") != "x").select("conv_id", chunk, "at", F.lit(0).alias("state"), "role", "text"))
        dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at")
        schema = pa.schema([("conv_id", _arrow(kind)), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, conv, path, at, q = Buffer(schema), None, "", 0, 0

            def inserted() -> None:
                nonlocal at, q
                while path[at : at + 1] == "I":
                    at, q = at + 1, FILL[q]
                    out.add(conv, "I", ROLE[q], "")

            for conv_id, _, number, state, role, text in rows(batches, "conv_id", "chunk", "at", "state", "role", "text"):
                if number < 0:
                    inserted()  # what completes the conversation before
                    conv, path, at, q = conv_id, role, 0, state
                    continue
                inserted()
                edit, at = path[at], at + 1
                if edit == "K":
                    q = NEXT[q, role[0]]
                elif edit == "R":
                    q = FILL[q]
                    role = ROLE[q]
                if edit != "D":
                    out.add(conv, edit, role, text, weight=len(text))
                if out.full():
                    yield out.take()
            inserted()
            yield out.take()

        return map_rows(dealt, apply, f"conv_id {kind}, edit string, role string, text string")


def repair(turns: DataFrame) -> Repair:
    """Repair all conversations of ``turns`` (``conv_id, turn, role, text`` and, as
    an option, ``dropped``; other columns are ignored).

    A null role or text is one space; rows without conversation are one
    conversation; null turns come first; rows of one turn are ordered by role and
    text. A role that begins with none of ``s``, ``u``, ``a`` (also an empty one)
    cannot be kept. A conversation whose rows are all dropped has zeros, an empty
    audit and no rows. Repeated rows are duplicates. An empty table gives empty
    results. What one task holds of a conversation is two letters a row."""
    in_order = ordered(turns)
    return Repair(in_order, plan(coded(in_order)))


def fingerprints(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the rows that ``Repair.turns`` gives: SHA-256
    of ``role:text``, newline-joined. A hash reads its conversation in one task,
    as a stream."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buffer(pa.schema([("conv_id", _arrow(kind)), ("repaired_sha256", pa.string())]))
        state, current = None, None
        for conv_id, role, text in rows(batches, "conv_id", "role", "text"):
            if state is None or conv_id != current:
                if state is not None:
                    out.add(current, state.hexdigest())
                state, current = hashlib.sha256(), conv_id
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
            if out.full():
                yield out.take()
        if state is not None:
            out.add(current, state.hexdigest())
        yield out.take()

    return map_rows(turns, digest, f"conv_id {kind}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The damaged table repaired: one row per conversation with its counts,
    ``cost``, ``audit`` and ``repaired_sha256``."""
    done = repair(damage(conversations))
    facts, hashes = done.conversations(), fingerprints(done.turns())
    nothing = hashlib.sha256(b"").hexdigest()
    return facts.alias("f").join(hashes.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id")), "left").select(
        "f.*", F.coalesce("h.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
