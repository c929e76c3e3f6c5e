"""Conversation repair: against brute force, over cut conversations, and awkward rows."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from medialake.llm import ordering, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part string, _at int"


def brute(codes):
    """(cost, audit) by trying all edits."""

    @functools.lru_cache(None)
    def best(i, node, inserted):
        found = [(0, "")] if i == len(codes) and node in (0, 3) else []
        for a, step, to, cost in repair.ARCS[codes[i]][node] if i < len(codes) else repair._LAST[node]:
            if a != "I" or inserted < 4:
                rest = best(i + step, to, 0 if step else inserted + 1)
                found += [(rest[0] + cost, a + rest[1])] if rest else []
        return min(found) if found else None

    return best(0, 0, 0)


def test_traversal_of_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        codes = [rng.choice([0, 1, 2, 3, 1, 2, 1, 2]) | rng.choice([0, 0, 0, 4, 8, 16, 24]) for _ in range(rng.randint(1, 11))]
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randint(0, 3))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        names = ("first", "matrix", "blank", "duplicate", "truncated", "illegal", "heads", "tails")
        *sums, cost, bounds = repair._bounds([dict(zip(names, repair._summary(0, c))) | {"part": i} for i, c in enumerate(parts)])
        audit, _ = repair._linked([{"part": i, "first": 0, "walks": repair._walks(c, b, cost)} for i, (c, b) in enumerate(zip(parts, bounds))])
        assert (cost, audit) == brute(tuple(codes)), codes
        assert sums == list(repair._bounds([dict(zip(names, repair._summary(0, codes))) | {"part": 0}])[:4])


def expected(rows):
    """The contract, a conversation at a time."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, faults = set(), [], [0, 0, 0]
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            initial = "sua".find(role[0]) if role and role[0] in "sua" else 3
            codes.append(initial | {0: 4, 1: 16, 2: 8, None: 0}[fault])
        turns = [r[0] for r in found if r[0] is not None]
        illegal = sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))
        cost, audit = brute(tuple(codes)) if codes else (0, "")
        lines, i, node = [], 0, 0
        for a in audit:
            if a == "K":
                node = {0: 1, 1: 2, 2: 3}[codes[i] & 3]
                lines.append(f"{found[i][1]}:{found[i][2]}")
            elif a in "IR":
                node = 3 if node == 2 else 2
                lines.append(f"{'user' if node == 2 else 'assistant'}:{found[i][2] if a == 'R' else ''}")
            i += a != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    return {r[0]: tuple(r[1:]) for r in queries.op11_repair(spark, str(tmp_path)).collect()}


def awkward_rows():
    rng = random.Random(5)
    texts = ["Hello there.", "Yes!", "What", "", None, " \n ", "a b c?", "x" * 200_000 + ".", "ÄÖ ü…"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "no turn."), (None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, None, None, None), (8, 3, "user", "tie."), (8, 3, "assistant", "tie."), (9, 1, "user", "twice."), (9, 1, "user", "twice.")]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = awkward_rows()
    assert run(spark, rows, tmp_path) == expected(rows)


def test_a_conversation_over_many_ranges(spark, tmp_path, monkeypatch):
    """One conversation with most rows is cut into segments, with the same result."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hm.", "Go on", "Right!", "", f"Row {t}."])) for t in range(300)] + [(2, t, "user", "Well.") for t in range(40)] + [(3, 0, "user", "Same.")] * 60

    def many(rows, keys):
        told = rows.withColumn("_copy", F.monotonically_increasing_id())
        return ordering.materialise(told.repartitionByRange(23, *keys, "_copy").sortWithinPartitions(*keys, "_copy").drop("_copy").withColumn("_at", F.monotonically_increasing_id()))

    monkeypatch.setattr(repair, "range_sorted", many)
    monkeypatch.setattr(repair, "_bounds", lambda s, f=repair._bounds: f(s))
    want = {}

    def slow(codes):  # too long for the recursion: one cheapest path by the operator's own single segment
        sums = dict(zip(("first", "matrix", "blank", "duplicate", "truncated", "illegal", "heads", "tails"), repair._summary(0, codes))) | {"part": 0}
        *_, cost, bounds = repair._bounds([sums])
        return cost, repair._linked([{"part": 0, "first": 0, "walks": repair._walks(list(codes), bounds[0], cost)}])[0]

    monkeypatch.setitem(globals(), "brute", slow)
    want = expected(rows)
    assert run(spark, rows, tmp_path) == want


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}


@pytest.mark.parametrize("n", [1, 2])
def test_roles_and_texts_of_the_repaired_turns(spark, n):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Bye.")] * n, "conv_id long, turn long, role string, text string")
    found = repair.repair(rows)
    assert [(r.role, r.text) for r in found.turns.orderBy("part", "k").collect()] == [("system", "Be kind."), ("user", "Hello."), ("assistant", "Bye.")]
    assert found.summary.first().cost == 3 + 4 * 3 * (n - 1)
