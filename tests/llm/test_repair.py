"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfare.llm import queries, repair
from tests.oracle import SF

GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if h:
            role, text = "user" if h == 4 else show(role), "" if h == 1 else re.sub("[.!?]", "", show(text)) if h == 2 else show(text)
            out += [(turn, role, text)] * (2 if h == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return sorted(out, key=key)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Dijkstra over (row, roles so far) by (cost, audit); the pattern is checked on whole role strings, prefixes by what they may become."""
    may = re.compile(r"(s?(ua)*u?)?")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, made
        steps = [("I", 5, i, role[0], (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 2, i + 1, "", None))
            if fault[i] not in ("blank", "duplicate"):
                late = 5 * (fault[i] == "truncated")
                steps.append(("K", late, i + 1, role[:1] or "?", (role, text)))
                steps += [("R", 1 + late, i + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for letter, price, j, more, line in steps:
            if may.fullmatch(roles + more) and cost + price <= 2 * len(rows):
                heapq.heappush(heap, (cost + price, audit + letter, j, roles + more, made + (() if line is None else (line,))))
    raise AssertionError("no repair")


def brute(conv, rows):
    own = damaged(rows)
    fault = faults(own)
    cost, audit, made = cheapest(own, fault)
    turns = {t for t, _, _ in own if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def of(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


FIELDS = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def test_minimum_equals_a_search():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for k in range(rng.randrange(8))]
        fault = faults(rows)
        own = bytes(repair.byte_of(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, fault))
        want = cheapest(rows, fault)[:2]
        assert repair.repair(own) == want
        assert repair.repair(own, block=1) == want and repair.repair(own, block=3) == want


def test_blocks_change_nothing_on_long_transcripts():
    rng = random.Random(2)
    own = bytes(repair.byte_of(rng.choice("suuuaaat"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(700))
    assert repair.repair(own, 700) == repair.repair(own, 64) == repair.repair(own, 7)


def test_query_equals_the_search_on_the_whole_table(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert got == {brute(c, r) for c, r in of(rows).items()} and len(got) == len(of(rows))


def test_edges(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 5]), rng.choice([None, "user", "assistant", "system", "tool", ""]), rng.choice([None, "", " \t\x0b", "one.", "two", "drei!  \n", "é?"])) for c in [None, *range(60)] for _ in range(rng.randrange(1, 7))]
    rows += [(100, k, "user" if k % 2 == 0 else "assistant", "x" * 200_000 + ".") for k in range(4)]
    dropped = next(c for c in range(200, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("digest", "fault", "dropped", "cost", "audit", "decided", "_h", "_copy")])
    got = sorted((tuple(r[f] for f in FIELDS) for r in repair.digest(df).collect()), key=repr)
    assert got == sorted((brute(c, r) for c, r in of(rows).items()), key=repr)
    assert next(g for g in got if g[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5_000])
def test_one_long_conversation(spark, n):
    df = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Line "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (got,) = repair.digest(df).collect()
    rows = [tuple(r) for r in df.collect()]
    own = damaged(rows)
    fault = faults(own)
    assert (got.blank, got.duplicate, got.truncated) == tuple(fault.count(f) for f in ("blank", "duplicate", "truncated"))
    assert len(got.audit.replace("I", "")) == len(own) and 0 < got.cost <= 2 * len(own)
