import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from railpulse.llm import conversation_repair as c

from .conftest import DIRS

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WORD = "[^\x20\x09-\x0d]"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault): least by cost, then by audit, over all edit sequences."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if s == "end":
            return cost, audit, lines
        if i == len(rows) and s in (0, 3):
            heapq.heappush(heap, (cost, audit, i, "end", lines))
            s = int(s)
        t, role = NEXT[s]
        heapq.heappush(heap, (cost + 5, audit + "I", i, t, (*lines, f"{role}:")))
        if i < len(rows):
            own, text, fault = rows[i]
            extra = 5 * (fault == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, lines))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, t, (*lines, f"{role}:{text}")))
                if s in (k := KEEP.get(own[:1], {})):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, k[s], (*lines, f"{own}:{text}")))
    raise AssertionError


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_report(rows, damaged=True):
    """Every conversation's result from rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        own = convs[conv]
        if d == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        own += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.findall(WORD, text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True)),
                     cost, audit, digest("\n".join(lines)))
    return out


def as_dict(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def talks(spark):
    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
        return df.selectExpr("*", "1 as number", "'x' as audit", "0L as node", "0 as item", "2 as copies", "'k' as conv", "1 as no_conv", "1 as chunk", "0 as cost")
    return make


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIRS['small']}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = c.op13_conversation_repair(spark, DIRS["small"])
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_dict(got) == plain_report(rows)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_long_conversations_over_chunks(spark, talks, monkeypatch, bits):
    monkeypatch.setattr(c, "CHUNK_BITS", bits)
    monkeypatch.setattr(c, "TREE_BITS", 1)
    rng = random.Random(bits)
    rows = []
    for conv, n in ((1, 300), (2, 1), (3, 40), (None, 25), (4, 3), (5, 120)):
        rows += [(conv, rng.choice([None, *range(n)]) if conv == 5 else i, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]),
                  rng.choice(["Fine.", "Yes!", "cut off", " ", f"Number {i}.", f"part {i}", f"Also {i}?"])) for i in range(n)]
    df = talks(rows, 5)
    assert as_dict(c.report(c.repair(df), df)) == plain_report(rows, damaged=False)


def test_repaired_rows_are_valid_and_hash_alike(spark, talks):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["user", "assistant", "system"]), f"Row {k} {i}.") for k in range(30) for i in range(rng.randrange(12))]
    df = talks(rows)
    r = c.repair(df)
    want = {k: x[-1] for k, x in as_dict(c.report(r, df)).items()}
    lines, roles = defaultdict(list), defaultdict(str)
    for x in c.repaired_rows(r).orderBy("conv", "number", "place").collect():
        lines[x.conv].append(f"{x.role}:{x.text}")
        roles[x.conv] += x.role[0]
    assert {k: digest("\n".join(lines[k])) for k in want} == want
    assert all(re.fullmatch("(s?(ua)+)?", roles[k]) for k in want)


def test_many_equal_rows(talks):
    rows = [(7, 3, "user", "Same again.")] * 5000 + [(7, 4, "assistant", "Yes.")] + [(7, 4, "assistant", " ")] * 700 + [(8, 1, "user", "Hi.")]
    df = talks(rows)
    assert as_dict(c.report(c.repair(df), df)) == plain_report(rows, damaged=False)
    damaged = c.damage(df)
    assert as_dict(c.report(c.repair(damaged), df)) == plain_report(rows)


def test_edges(spark, talks):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (1, None, "user", ""), (2, 5, "", "No role."),
            (3, 1, "user", "x" * 2_000_000 + "."), (3, 2, "assistant", "\x0b\x0c"), (3, 3, "assistant", "é𝄞!  \n"), (4, 1, "user", "one"),
            (4, 1, "assistant", "Two."), (4, 1, "assistant", "Two."), (4, -(2 ** 62), "system", "S."), (4, 2 ** 62, "assistant", "End."),
            (0, 1, "user", "Q?"), (0, 2, "assistant", "A."), (-1, 1, "system", "Only."), (9, 2 ** 63 - 1, "user", "Q?"), (9, -2 ** 63, "user", "Q? ")]
    df = talks(rows)
    assert as_dict(c.report(c.repair(c.damage(df)), df)) == {
        k: (min(v[0], 2 ** 63 - 1), *v[1:]) for k, v in plain_report(rows).items()}
    assert as_dict(c.report(c.repair(df), df)) == {
        k: (min(v[0], 2 ** 63 - 1), *v[1:]) for k, v in plain_report(rows, damaged=False).items()}
    lost = talks([(i, 0, "user", "Gone.") for i in range(200)])
    got = as_dict(c.report(c.repair(lost.where("false")), lost.where(F.col("conv_id") < 3)))
    assert got == {i: (0, 0, 0, 0, 0, 0, "", digest("")) for i in range(3)}
    assert c.report(c.repair(talks([])), talks([])).count() == 0 and c.repaired_rows(c.repair(talks([]))).count() == 0


def test_crossings_over_any_tree():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(1, 12)
        faults = [rng.choices(["", "truncated", "blank"], rng.choice([(8, 1, 1), (1, 1, 1), (1, 3, 0)]))[0] for _ in range(n)]
        initials = rng.choices("sua-", rng.choice([(1, 4, 4, 1), (1, 1, 1, 1)]), k=n)
        rows = [c.Row(i, i, x, c.FORCED if f == "blank" else c.INITIALS.index(x) + 4 * (f == "truncated"), 1)
                for i, (x, f) in enumerate(zip(initials, faults, strict=True))]
        at = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(4)))})
        parts = [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        leaves = [c.summary(p) for p in parts]
        last, cost = c.combined([c.combined(leaves[:2]), *([c.combined(leaves[2:])] if leaves[2:] else [])]).whole()
        states = c.crossings([x.moves for x in leaves], c.START, last)
        audit = "".join(e[1] for p, a, b in zip(parts, states[:-1], states[1:], strict=True) for e in c.edits(p, a, b)) + c.TAIL[last]
        assert (cost, audit) == cheapest([(x, "", f) for x, f in zip(initials, faults, strict=True)])[:2]
