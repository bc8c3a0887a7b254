"""Conversation repair against a plain shortest path over all edits, piece sizes and edge rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.llm import conversation_repair

SPACE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def damage(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        told = [" " if v is None else v for v in (conv, turn, role, text)]
        draw = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        row = [turn, told[2], told[3]]
        if draw == 1:
            row[2] = ""
        if draw == 2:
            row[2] = re.sub("[.!?]", "", row[2])
        if draw == 4:
            row[1] = "user"
        kept[conv] += [row] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return kept


def search(rows, faults):
    """(cost, audit, lines) by best-first search over (cost, audit): the first one out is the least."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if k == len(rows) and FORM.fullmatch(roles):
            return cost, audit, lines
        shape = (k, "" if not roles else "s" if roles == "s" else roles[-1])
        if not FORM.fullmatch(roles + "a") and not FORM.fullmatch(roles) and not FORM.fullmatch(roles + "ua"):
            continue
        if best.setdefault(shape, (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", k, roles + role[0], (*lines, f"{role}:")))
        if k < len(rows):
            _, own, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + (own[:1] or "?"), (*lines, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, roles + role[0], (*lines, f"{role}:{text}")))
    raise AssertionError


def brute(rows):
    out, kept = [], damage(rows)
    for conv in {r[0] for r in rows}:
        turns = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            told = text.strip(SPACE)
            faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {r[0] for r in turns if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = search(turns, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


def repaired(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversation_repair.repair(conversation_repair.damaged(frame), "copies", **options)


def some(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", "umpire", None]
    texts = ["Yes.", "No", "what?  ", " \n", "", None, "é!", "a.b", "...", "longer text\nin lines."] + [f"text {k}." for k in range(30)]
    return [(rng.choice([None, *range(n // 8)]), rng.choice([None, *range(14)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece_rows", [1, 3, conversation_repair.PIECE_ROWS])
def test_random_conversations_equal_a_search_over_all_edits(spark, piece_rows):
    rows = some(600, piece_rows)
    assert ordered(repaired(spark, rows, piece_rows=piece_rows).collect()) == ordered(brute(rows))


def test_the_table_equals_brute_force(spark, sf_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert ordered(repaired(spark, rows).collect()) == ordered(brute(rows))


def test_a_conversation_with_most_rows_and_a_row_with_most_copies(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(900)}{rng.choice(['.', '', '!'])}") for k in range(3000)]
    rows += [(8, None, "user", "the same.")] * 500 + [(9, 1, "user", "the same.")] * 500 + [(k, 0, "user", "Hello.") for k in range(10, 400)]
    want = ordered(brute(rows))
    assert ordered(repaired(spark, rows, piece_rows=50).collect()) == want
    assert ordered(repaired(spark, rows).collect()) == want


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = some(400, 9)
    frame = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for piece_rows in (2, 1000):
        turns = conversation_repair.repaired_turns(frame, "copies", piece_rows).collect()
        lines = defaultdict(list)
        for r in sorted(turns, key=lambda r: r.position):
            lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert {conv: hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() for conv in {r[0] for r in rows}} == {r[0]: r[-1] for r in brute(rows)}


def test_edge_tables(spark):
    assert repaired(spark, []).collect() == []
    one = spark.createDataFrame([("x", 1, "user", "Hi.", 3), ("x", 2**62, "assistant", "w " * 300_000 + ".", 4)], "conv_id string, turn long, role string, text string, copies int")
    wide = one.withColumns({c: F.lit("clash") for c in ("seen", "content", "place", "cost", "n", "first")})
    found = conversation_repair.repair(wide).first()
    assert (found.conv_id, found.gaps, found.cost, found.audit) == ("x", 2**62 - 2, 0, "KK")
    far = conversation_repair.repair(spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id int, turn long, role string, text string")).first()
    assert far.gaps == 2**63 - 1
    lost = conversation_repair.repair(one.withColumn("copies", F.lit(0)), "copies").first()
    assert tuple(lost) == ("x", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
