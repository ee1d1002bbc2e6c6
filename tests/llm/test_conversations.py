import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from newsloom.llm import conversations as C

COLUMNS = "conv_id long, turn long, role string, text string, cost long, audit string, dropped_by string, at long, fault string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash", 3, "clash") for r in rows], COLUMNS)


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        out[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(turns):
    """Cheapest edits by a shortest-path search over (cost, audit)."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, rows = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            break
        key = (i, roles[-1:], "x" if roles else "")
        if key in done:
            continue
        done.add(key)
        ok = lambda r: re.fullmatch("(s?(ua)*u?)", r)
        for role in ("user", "assistant"):
            if ok(roles + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*rows, f"{role}:")))
        if i < len(turns):
            _, role, text = turns[i]
            more = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, rows))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and ok(roles + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*rows, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if ok(roles + to[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + to[0], (*rows, f"{to}:{text}")))
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(rows).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in C.repaired(table(spark, rows)).collect()}
    want = {conv: plain(turns) for conv, turns in damaged(rows).items()}
    assert got == want


def test_given_table(spark, small):
    path = small.inputFiles()[0].replace("documents", "conversations")
    check(spark, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(path).collect()])


def test_random_conversations(spark):
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "", " \t", "What?", "Well, ", None, "ok!\n", "done. ."]
    rows = []
    for conv in range(300):
        for turn in range(draw.randrange(9)):
            rows.append((conv, draw.choice([turn, turn, turn, 1, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"Text {turn}."))
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (None, None, "assistant", "No.")]
    check(spark, rows)


def test_long_conversation(spark):
    """Longer than a piece and than a chunk, spread over tasks."""
    draw = random.Random(6)
    rows = [(1, t // 2 * 3, draw.choice(["user", "assistant", "assistant", "system"]), f"Text {t % 4000}" + draw.choice([".", "?", "", " "])) for t in range(9000)]
    rows += [(2, None, "user", "Same."), *[(2, 1, "user", "Same.")] * 200]
    check(spark, rows)


def test_pieces_give_the_least_edits():
    """Pieces of a conversation and the whole of it agree."""
    draw = random.Random(7)
    for _ in range(200):
        letters = "".join(draw.choice("ooootbd") + draw.choice("sua?uaua") for _ in range(draw.randrange(1, 30)))
        cost, path, end = C.search(letters, 0, C.AT_END)
        whole = (cost, path + C.COMPLETION[end])
        before, C.PIECE = C.PIECE, draw.choice([1, 2, 5])
        try:
            cut = draw.randrange(0, len(letters) // 2 + 1) * 2
            cost, parts = C.edits([letters[:cut], letters[cut:]])
        finally:
            C.PIECE = before
        assert (cost, "".join(p for _, p in parts)) == whole


@pytest.mark.parametrize("letters,cost,audit", [("", 0, ""), ("ouoa", 0, "KK"), ("ou", 2, "KI"), ("bu", 3, "D"), ("oaou", 4, "IKKI"), ("ouou", 2, "KR"), ("osou", 2, "KKI")])
def test_small_cases(letters, cost, audit):
    found, parts = C.edits([letters])
    assert (found, "".join(p for _, p in parts)) == (cost, audit)


def test_empty(spark):
    assert C.repaired(table(spark, [])).count() == 0
    assert C.repair(C.damage(table(spark, []))).turns().count() == 0
