from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries as registered
from quillspark.llm import turn_repair

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Uniform-cost search over (rows read, state), each row (role, text, fault): least (cost, audit)."""
    queue, done = [(0, "", 0, "e", [])], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in "ea":
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for to in "ua":
            if (state, to) in NEXT:
                heapq.heappush(queue, (cost + 5, audit + "I", i, NEXT[state, to], [*out, ("user" if to == "u" else "assistant", "")]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, NEXT[state, role[:1]], [*out, (role, text)]))
                for to in "ua":
                    if (state, to) in NEXT:
                        heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, NEXT[state, to], [*out, ("user" if to == "u" else "assistant", text)]))
    raise AssertionError("no repair")


def brute(rows: list[tuple], damaged: bool) -> dict:
    of, ids = defaultdict(list), {r[0] for r in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damaged else 19
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        of[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c in ids:
        turns = sorted(of[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in turns:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        cost, audit, fixed = cheapest(faulty)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[c] = (gaps, *(sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def results(df) -> dict:
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(registered.op11_turn_repair(spark, f"/root/testdata/{sf}")) == brute(rows, True)


def of_rows(spark, rows, block=256):
    """repair() without damage, as brute() gives it."""
    df = spark.createDataFrame(rows, SCHEMA)
    out = turn_repair.repair(df, block=block)
    return results(out.withColumn("turns", F.sha2(turn_repair.written(F.col("turns")), 256)))


def test_random_conversations_in_small_blocks(spark):
    rng = random.Random(7)
    texts, roles = ["Ja.", "No", "  ", "", "So!", "What?", "cut off", ".. x", None], ["user", "assistant", "system", "tool", "", None, "u", "server"]
    rows = []
    for c in range(300):
        n = rng.choice([1, 2, 3, 5, 8, 20])
        for i in range(n):
            text = rng.choice(texts)
            rows.append((c, rng.choice([i, i, i + 3, None, 2 * i]), rng.choices(roles, [5, 5, 2, 1, 1, 1, 1, 1])[0], text if text is None or rng.random() < 0.5 else text + rng.choice(["a.", "b.", "c"])))
    want = brute(rows, False)
    assert of_rows(spark, rows, block=2) == want and of_rows(spark, rows) == want


def test_long_conversation_of_one_turn_number(spark):
    rng = random.Random(3)
    rows = [(None, None if i % 2 else 5, rng.choice(["user", "assistant"]), f"text {rng.randrange(400)}{rng.choice(['.', ''])}") for i in range(1500)]
    rows += [(1, 0, "user", "Very long. " * 50_000), (1, 1, "assistant", "x" * 500_000)]
    assert of_rows(spark, rows, block=64) == brute(rows, False)


def test_extra_columns_and_ids_without_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x"), (2, 0, "user", "Hi", 4, "y")], f"{SCHEMA}, c int, block string")
    ids = spark.createDataFrame([(1,), (1,), (7,), (None,)], "conv_id long")
    out = {r.conv_id: r for r in turn_repair.repair(rows, ids).collect()}
    assert set(out) == {1, 2, 7, None} and out[7].audit == "" and out[7].cost == 0 and out[7].turns == []
    assert [(t.edit, t.role, t.text) for t in out[1].turns] == []  # deleting costs 2, an answer 5
    assert out[2].audit == "D"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damage(empty), empty).count() == 0
