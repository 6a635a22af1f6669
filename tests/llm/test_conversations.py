"""Conversation repair against plain versions: all edits tried, and a shortest-path search of another kind."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import queries as Q
from plumbline.llm.conversations import Repairer, damaged, repair_report, repaired_rows

FORM = re.compile("(s?(ua)+)?")


def all_edits(rows, most=2):
    """Every (cost, audit, output) with up to ``most`` insertions at a place; rows: (initial, fault)."""
    found = [(0, "", "")]

    def inserted(states):
        out = list(states)
        for n in range(1, most + 1):
            for roles in itertools.product("ua", repeat=n):
                out += [(c + 5 * n, a + "I" * n, o + "".join(roles)) for c, a, o in states]
        return out

    for initial, fault in rows:
        nxt = []
        for c, a, o in inserted(found):
            nxt.append((c + 2, a + "D", o))
            if fault not in "bd":
                late = 5 * (fault == "t")
                nxt.append((c + late, a + "K", o + (initial or "")) if initial else (c + late + 10**6, a + "K", o))
                nxt += [(c + late + 1, a + "R", o + x) for x in "ua"]
        found = nxt
    return min((c, a, o) for c, a, o in inserted(found) if FORM.fullmatch(o))


def classes(rows):
    return bytes(3 * ("sua".index(i) if i and i in "sua" else 3) + (2 if f in "bd" else 1 if f == "t" else 0) for i, f in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from("-tbd")), max_size=3))
def test_every_edit_tried(rows):
    assert Repairer().repair(classes(rows)) == all_edits(rows)[:2]


def plain(rows):
    """(cost, audit) by dynamic programming from the front, with whole audits held."""
    best = {"": (0, "")}

    def insert(states):
        for _ in range(4):
            for s, (c, a) in list(states.items()):
                for x in "ua":
                    if (t := step(s, x)) and ((c + 5, a + "I") < states.get(t, (10**9, ""))):
                        states[t] = (c + 5, a + "I")
        return states

    def step(s, x):
        return x if (s == "" and x in ("s", "u")) or (s + x) in ("su", "ua", "au") else None

    for initial, fault in rows:
        nxt = {}
        for s, (c, a) in insert(best).items():
            moves = [(s, c + 2, "D")]
            if fault not in "bd":
                late = 5 * (fault == "t")
                moves += [(step(s, initial), c + late, "K")] + [(step(s, x), c + late + 1, "R") for x in "ua"]
            for t, cost, e in moves:
                if t is not None and (cost, a + e) < nxt.get(t, (10**9, "")):
                    nxt[t] = (cost, a + e)
        best = nxt
    return min(v for s, v in insert(best).items() if s in ("", "a"))


def test_long_sequences():
    rng = random.Random(5)
    repairer = Repairer()
    for n in (50, 400):
        for odds in ("sua", "ua", "u", "uax"):
            rows = [(rng.choice(odds), rng.choice("------tbd")) for _ in range(n)]
            assert repairer.repair(classes(rows)) == plain(rows)
    assert repairer.repair(bytes([3] * 10_000)) == (5_000, "KR" * 5_000)  # 10,000 sound user rows


def expected(table):
    """The contract's rows by plain Python."""
    groups, order = defaultdict(list), lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    for conv, turn, role, text in table:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        groups[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=order)
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\f\r")
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
        cost, audit = plain([(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)])
        out, k = [], 0
        for e in audit:
            needed = "assistant" if out and out[-1][0][:1] == "u" else "user"
            if e == "I":
                out.append((needed, ""))
                continue
            _, role, text = rows[k]
            k += 1
            if e != "D":
                out.append((role if e == "K" else needed, text))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        yield (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(spark, df, table):
    made = list(expected(table))
    theirs = sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)
    assert theirs == sorted((x for x, _ in made), key=str)
    return {x[0]: out for x, out in made}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(spark, Q.op12_conversation_repair(spark, f"/root/testdata/{sf}"), table)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 3, 9, -2]), rng.choice(["user", "assistant", "system", "User", "tool", "", None, "été"]), rng.choice(["Hi.", "Hi", " \t", "", None, "Was?\n\n", "so ", "é!"])) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    rows += [(100, 0, "user", "One."), (100, 0, "user", "One.")] + [(101, k, "user" if k % 2 else "assistant", f"Long {k}." + "x. " * 3000) for k in range(700)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, fault string, audit string, gone int, conv long").repartition(5)
    outs = same(spark, repair_report(damaged(df), gone=F.col("gone")), rows)
    whole = defaultdict(list)
    for r in repaired_rows(damaged(df), gone=F.col("gone")).orderBy("conv_id", "at").collect():
        whole[r.conv_id].append((r.role, r.text))
        assert r.edit in "KRI" and r.at == len(whole[r.conv_id]) - 1
    assert {k: v for k, v in outs.items() if v} == dict(whole)
    empty = df.limit(0)
    assert repair_report(damaged(empty)).count() == 0 and repaired_rows(empty).count() == 0


def test_lost_conversations_and_other_keys(spark):
    lost = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, t, "user", "x.") for c, t in lost], "conv_id long, turn long, role string, text string")
    found = repair_report(damaged(df), gone=F.col("gone")).collect()
    assert sorted(r.conv_id for r in found) == sorted({c for c, _ in lost})
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in found)
    named = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "assistant", "y.")], "k string, n int, who string, said string")
    assert repair_report(named, "k", "n", "who", "said").first().audit == "KK"
