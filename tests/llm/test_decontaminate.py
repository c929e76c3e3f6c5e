import hashlib
import re

import numpy as np

from medialake.llm import decontaminate
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if own := windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_documents_in_one_and_many_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    for kw in ({}, {"max_words": 100}):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench, **kw).collect()}
        assert got == expected
        clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, **kw).collect()}
        assert clean == {d for d, x in expected.items() if not x[4]}
    assert any(x[4] for x in expected.values())


def test_matcher_equals_all_windows():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(str(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))).encode()) for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 3 + i % 4], int(rng.integers(0, 400))))) for i in range(40)]
    docs += [(100 + i, items[i][1].decode()) for i in range(30)]
    for window in (1, 2, 5, 10, 11):
        m = decontaminate.Matcher(items, window)
        m.CHUNK = 97
        windows = {}
        for i, t in items:
            w = t.split()
            for k in range(max(1, len(w) - window + 1)) if w else ():
                windows.setdefault(tuple(w[k : k + window]), set()).add(i)
        for _, t in docs:
            w, hit, found = t.encode().split(), set(), set()
            for k in range(len(w)):
                for n in range(1, window + 1):
                    if own := windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                        hit.update(range(k, k + n))
                        found |= own
            spans, items_found = m.scan(w)
            assert {p for a, z in spans for p in range(a, z + 1)} == hit and items_found == found


def test_offsets_point_into_the_original(spark):
    text = "Ünïcode before: ONE two, three -- FOUR five six seven eight nine ten eleven; after"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "one two three four five six seven eight nine ten"), ("short", "after")], "item_id string, text string")
    r = decontaminate.find_hits(docs, bench).first()
    assert [text[o.start : o.end] for o in r.offsets] == ["ONE two, three -- FOUR five six seven eight nine ten", "after"] and r["items"] == ["q", "short"] and r.n_hit == 11


def test_cases(spark):
    bench = spark.createDataFrame([("a", None), ("b", ""), ("c", "!!"), ("d", "alpha beta gamma delta"), ("d", "alpha beta gamma delta"), ("e", "Alpha, beta gamma delta"), (None, "naïve")], "item_id string, text string")
    rows = decontaminate.contamination(awkward(spark), bench).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[1].n_items == 2 and by[1].n_hit == 4 and by[8].contaminated and by[8].n_items == 0
    assert not by[2].contaminated and by[2].n_words == 0 and not by[6].contaminated
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(awkward(spark), none).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(awkward(spark), none).count() == 11
    assert decontaminate.contamination(empty(spark), bench).count() == 0
