import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import common, langid, mixing, topics
from tests.llm.cases import awkward, empty


def sums(cells, p, d):
    out = {}
    for k, m in cells.items():
        out[k[d]] = out.get(k[d], 0) + m * p[k]
    return out


def brute_rake(cells, goal, budget, rounds=5000):
    """Cell by cell, in Python numbers."""
    w = {k: budget / sum(cells.values()) for k in cells}
    for _ in range(rounds):
        for d, target in enumerate(goal):
            have = sums(cells, {k: min(1, x) for k, x in w.items()}, d)
            w = {k: min(1e200, x * (budget * target[k[d]] / have[k[d]] if have[k[d]] else 0)) for k, x in w.items()}
    return {k: min(1, x) for k, x in w.items()}


def test_raking_meets_the_marginals():
    cells = {("a", "x"): 50.0, ("a", "y"): 10.0, ("b", "x"): 20.0, ("b", "y"): 20.0}
    goal = [{"a": 0.4, "b": 0.6}, {"x": 0.5, "y": 0.5}]
    p, met = mixing.calibrate(cells, goal, 40.0)
    want = brute_rake(cells, goal, 40.0)
    for d, target in enumerate(goal):
        for v, got in sums(cells, p, d).items():
            assert abs(got / 40 - target[v]) < 2e-4 and abs(met[d][v] - target[v]) < 1e-12
    assert all(abs(p[k] - want[k]) < 1e-3 and 0 <= p[k] <= 1 for k in cells)
    odds = (50 * p["a", "x"] * 20 * p["b", "y"]) / (10 * p["a", "y"] * 20 * p["b", "x"])
    assert abs(odds - 5) < 0.02  # raking keeps the odds ratio


def test_cells_that_give_all_they_have_and_budgets_that_cannot_be_met():
    rng = np.random.default_rng(2)
    cells = {k: float(rng.integers(1, 1000)) ** 2 for k in itertools.product("abcd", "xyz", "pq")}
    goal = mixing.tempered(cells, 3, 0.3)
    total = sum(cells.values())
    p, _ = mixing.calibrate(cells, goal, 0.9 * total)
    spent = sum(cells[k] * p[k] for k in cells)
    assert max(p.values()) == 1 and 0.05 * total < spent < 0.9 * total
    for d, target in enumerate(goal):
        assert all(abs(x / spent - target[v]) < 1e-3 for v, x in sums(cells, p, d).items())
    want = brute_rake(cells, goal, spent)
    assert all(abs(p[k] - want[k]) < 0.05 for k in cells)
    assert all(target[v] * spent * 1.1 > 0 for target in goal for v in target)


def test_contradicting_targets_move_towards_the_own_shares():
    cells = {("a", "x"): 60.0, ("b", "x"): 20.0, ("c", "y"): 20.0}  # the first decides the second
    p, met = mixing.calibrate(cells, [{"a": 0.1, "b": 0.1, "c": 0.8}, {"x": 0.9, "y": 0.1}], 50.0)
    spent = sum(cells[k] * p[k] for k in cells)
    assert spent > 0
    for d in (0, 1):
        assert all(abs(x / spent - met[d][v]) < 1e-3 for v, x in sums(cells, p, d).items())


def test_shares_meet_the_targets_in_all_dimensions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed = mixing.materialise(mixing.described(docs, topics.fit(docs), keep=["doc_id"]))
    plan = mixing.plan(placed)
    found = mixing.calibrated(placed, plan)
    rows = mixing.report(found, plan).collect()
    assert {r.dimension for r in rows} == {0, 1, 2} and len({r.value for r in rows if r.dimension == 2}) >= 4
    assert all(abs(r.target - r.expected) < 0.001 for r in rows)
    assert all(abs(r.target - r.drawn) < 0.03 for r in rows), [r for r in rows if abs(r.target - r.drawn) >= 0.03]
    assert abs(sum(abs(r.target - r.drawn) for r in rows) / len(rows)) < 0.01
    again = mixing.calibrated(placed.repartition(5), plan)
    assert sorted(r[0] for r in found.where("kept").select("row.doc_id").collect()) == sorted(r[0] for r in again.where("kept").select("row.doc_id").collect())


def test_more_cells_than_the_driver_takes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{rng.integers(6)}", "abc"[int(rng.integers(9)) // 4], "word " * int(rng.integers(1, 40))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    placed = mixing.materialise(mixing.described(docs, None, dims=("source", "lang")))
    few, many = mixing.plan(placed, dims=2), mixing.plan(placed, dims=2, max_cells=3)
    assert few.small and not many.small
    for plan in (few, many):
        found = mixing.calibrated(placed, plan)
        assert found.count() == 1500
        assert all(abs(r.target - r.expected) < 0.002 for r in mixing.report(found, plan).collect())


def test_topics_tell_word_use_apart():
    rng = np.random.default_rng(5)
    bags = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    texts = [" ".join(rng.choice(bags[i % 3], 30)).encode() for i in range(90)]
    model = topics.train(texts, 3)
    found = [model.topic(topics.word_counts(t)) for t in texts]
    assert len({(i % 3, t) for i, t in enumerate(found)}) == 3 == len(set(found))
    assert topics.train([b"", b" \n"]) is None
    long = b"ab cd\n" * 300_000
    assert topics.word_counts(long) == {b"ab": 300_000, b"cd": 300_000}
    for t, k in zip(texts[:20], found):  # nearest centre, by hand
        c = topics.word_counts(t)
        v = np.zeros(topics.WIDTH)
        for w, n in c.items():
            at = topics.zlib.crc32(w) % topics.WIDTH
            v[at] += np.log1p(n) * model.idf[at]
        assert int((model.centres.T @ v).argmax()) == k


def test_cases(spark):
    docs = awkward(spark)
    placed = mixing.described(docs, topics.fit(docs))
    rows = mixing.calibrated(placed, mixing.plan(placed)).collect()
    assert len(rows) == 11 and all(0 <= r.p <= 1 for r in rows) and {r.d0 for r in rows} == {"web", mixing.NONE}
    assert {r.d2 for r in rows if r.row.doc_id in (2, 3, 4)} == {mixing.NONE}
    by = [r.kept for r in rows if r.row.doc_id == 1]
    assert by[0] == by[1]
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty(spark)).count() == 0
    none = mixing.plan(placed, targets=[{"book": 1.0}, {"en": 1.0}, {"prose": 1.0}])
    assert {r.p for r in none.cells.collect()} == {0.0}
    clash = docs.withColumns({c: F.lit(7) for c in ("row", "d0", "tokens", "p", "kept", "cell", "x")})
    assert mixing.mix(clash).columns == clash.columns and {r.d0 for r in mixing.mix(clash).collect()} <= {7}
    bad = spark.createDataFrame([(1, bytearray(b"a \xff b"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) text", "'s' source", "'l' lang")
    assert mixing.described(bad, None).first().tokens == 3


def test_the_budget_is_held_and_drawn_shares_meet_the_targets(spark):
    """Both ways of raking, on a table in which one text holds a twentieth of all tokens."""
    for sf, most in (("sf0.01", 0.02), ("sf0.1", 0.01)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        placed = mixing.materialise(mixing.described(docs, topics.fit(docs), keep=["doc_id"]))
        for limit in (200_000, 5) if sf == "sf0.01" else (200_000,):
            plan = mixing.plan(placed, max_cells=limit)
            found = mixing.calibrated(placed, plan)
            assert plan.small == (limit > 5)
            rows = mixing.report(found, plan).collect()
            assert all(abs(r.target - r.drawn) < most and abs(r.target - r.expected) < 0.001 for r in rows), sf
            whole, kept = found.agg(F.sum("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")))).first()
            assert 0.67 < kept / whole < 0.73


def test_held_budget_cuts_goals_and_decides_large_documents():
    rng = np.random.default_rng(7)
    cells = {k: float(rng.integers(1, 1000)) ** 2 for k in itertools.product("abcd", "xyz", "pq")}
    large = [(0.1, ("a", "x", "p"), 20_000, 1), (0.2, ("b", "y", "q"), 15_000, 2), (0.95, ("c", "z", "p"), 9_000, 1)]
    for _, cell, tokens, copies in large:
        cells[cell] += tokens * copies
    total = sum(cells.values())
    p, met, kept = mixing.calibrate_held(cells, mixing.tempered(cells, 3, 0.3), 0.6, large)
    assert kept[0.95, ("c", "z", "p"), 9_000] is False
    given = {k: (m - sum(t * n for _, c, t, n in large if c == k)) * p[k] + sum(t * n for d, c, t, n in large if c == k and kept[d, c, t]) for k, m in cells.items()}
    assert abs(sum(given.values()) / total - 0.6) < 0.01
    for d, goal in enumerate(met):
        for v, target in goal.items():
            got = sum(g for k, g in given.items() if k[d] == v)
            assert abs(got / sum(given.values()) - target) < 1e-3 and got <= sum(m for k, m in cells.items() if k[d] == v) + 1e-6


def test_goals_are_filled_up_to_what_there_is():
    got = mixing.filled(np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.5, 0.9]))
    assert np.allclose(got, [0.2, 0.48, 0.32])
    assert np.allclose(mixing.filled(np.array([0.5, 0.5, 0.0]), np.array([0.3, 0.4, 1.0])), [0.3, 0.4, 0.0])


def test_goals_filled_as_a_table(spark):
    rows = [("a", 0.5, 0.2), ("b", 0.3, 0.5), ("c", 0.2, 0.9)]
    got = {r.value: r.goal for r in mixing.filled_table(spark.createDataFrame(rows, "value string, goal double, most double")).collect()}
    assert all(abs(got[v] - x) < 1e-4 for v, x in zip("abc", (0.2, 0.48, 0.32)))


def test_the_least_step():
    for first in range(18):
        tries = []
        got = mixing.least_pull(lambda r, first=first, tries=tries: tries.append(r) or (r if r * 16 >= first else None))
        assert got[1] == min(first, 16) and len(tries) <= 6


def test_topics_are_learned_from_all_texts(spark):
    """More texts than a sample held, one longer than it took: equal to all of them counted by hand, however they are dealt."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'abc'[i % 3]}{j}" for j in rng.integers(40, size=30)) for i in range(2400)] + ["long words " * 3000, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = topics.fit(docs.repartition(3), topics=3)
    held = Counter(p for t in texts if t for p in {topics.zlib.crc32(w.encode()) % topics.WIDTH for w in t.split()})
    assert np.allclose(model.idf, [np.log(2402 / (1 + held[p])) + 1 for p in range(topics.WIDTH)])
    vectors = [topics.packed(topics.word_counts(t.encode())) for t in texts if t]
    x, own = topics._dense(vectors, model.idf), np.array(model.nearest(vectors))
    for k in range(3):
        mean = x[own == k].sum(axis=0)
        assert np.allclose(model.centres[:, k], mean / np.linalg.norm(mean), atol=1e-5)
    again = topics.fit(docs.repartition(7), topics=3)
    assert (again.centres == model.centres).all() and (topics.train([(t or "").encode() for t in texts[::-1]], 3).centres == model.centres).all()


def test_rounds_read_texts_that_may_change_only(spark):
    """Texts that surely keep their topic are not read again, and the centres are those of reading all in each round."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{j}" for j in rng.normal(i / 2, 30, size=60).astype(int)) for i in range(2000)]
    vectors = [topics.packed(topics.word_counts(t.encode())) for t in texts]
    read, sums, kept = [], topics._by_centre, topics._open

    def noted(make):
        def made(*args):
            part = make(*args)
            return lambda some: (read.append(len(some)), part(some))[1]

        return made

    with pytest.MonkeyPatch.context() as m:
        m.setattr(topics, "_by_centre", noted(sums))
        m.setattr(topics, "_open", noted(kept))
        found, reads = {}, {}
        for little, ahead in ((-1, 3), (0.02, 3), (0.5, 0.3), (0.5, 3)):
            read.clear()
            m.setattr(topics, "_LITTLE", little)
            m.setattr(topics, "_AHEAD", ahead)
            found[little, ahead], reads[little, ahead] = topics.learn(vectors, 6, still=0).centres, sum(read)
    assert reads[0.02, 3] < 0.8 * reads[-1, 3]
    assert all((c == found[-1, 3]).all() for c in found.values())
    table = spark.createDataFrame([(v,) for v in vectors], "vec binary").repartition(3)
    assert (topics.learn(table, 6, still=0).centres == found[-1, 3]).all()


def test_mixing_leaves_texts_once_and_models_leave_no_tables(spark):
    """What a stage writes stays until its result is written, so no text stays twice and nothing stays that only a model was learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for fit in (langid.fit, lambda docs: topics.learn(spark.createDataFrame([(topics.packed(topics.word_counts(r.text.encode())),) for r in docs.collect() if r.text and r.text.split()], "vec binary"))):
        before = common.written()
        assert fit(docs) is not None and common.written() == before
    before = common.written()
    mixed = mixing.mix(docs)
    left = [spark.read.parquet(path).schema for path in common._WRITTEN[before:]]
    assert sum("row" in s.names and "text" in s["row"].dataType.names for s in left) == 1
    placed = mixing.described_by_all(docs, keep=["doc_id"])
    kept = mixing.calibrated(placed, mixing.plan(placed)).where("kept").select("row.doc_id")
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in kept.collect())


def test_short_texts_counted_together():
    """Many texts at once give what each gives alone, whatever their bytes."""
    rng = np.random.default_rng(9)
    some = list(b" \t\n\x0b\x0c\rAaBz")
    texts = [None, b"", b" \n", b" a ", b"\xff A\x00b\x0bB\x1c\x85 \xa0", b"x" * 31 + b" " + b"Y" * 32 + b" " + b"z" * 33, "\u00c9t\u00e9 \u00e9t\u00e9".encode()]
    texts += [bytes(rng.choice([*range(256), *some * 20], size=n).astype(np.uint8)) for n in rng.integers(0, 400, size=400)]
    texts += [b"Ab cd " * (topics.PIECE // 4), b"e" * 5000, b"last one"]
    counts = [topics.word_counts(t) for t in texts]
    assert topics.counted(texts) == ([sum(c.values()) for c in counts], [topics.packed(c) for c in counts])
    assert topics.counted([]) == ([], [])


def test_a_round_reads_no_text_twice(spark):
    """Also in the rounds that write the texts that may change; of a table of vectors, too, which is read a few to a row."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{j}" for j in rng.normal(i / 2, 30, size=60).astype(int)) for i in range(500)]
    vectors = [topics.packed(topics.word_counts(t.encode())) for t in texts]
    reads, opened, sums, kept = [], [], topics._by_centre, topics._open
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topics, "_by_centre", lambda *args: lambda some: (reads.append(len(some)), sums(*args)(some))[1])
        m.setattr(topics, "_open", lambda *args: lambda some: (reads.append(len(some)), opened.append(len(some)), kept(*args)(some))[2])
        topics.learn(vectors, 6, rounds=10, still=0)
    assert opened and len(reads) == 10
    rows = topics._stored(spark.createDataFrame([(v,) for v in vectors[:43]], "vec binary").coalesce(1))
    assert rows.count() == 6 and all(".snappy." not in f for f in rows.inputFiles())
    assert [v for r in rows.toArrow().to_batches() for v in topics._vectors(r)] == vectors[:43]


def test_rounds_read_two_bytes_an_entry(spark):
    """Vectors for the rounds are less than half as long as before, and come back as they were, those with rare weights too."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{j}" for j in rng.zipf(1.3, size=n).clip(1, 5000)) for n in rng.integers(1, 600, size=300)] + ["same " * 40, "same " * 31 + "other " * 5000]
    vectors = [topics.packed(topics.word_counts(t.encode())) for t in texts]
    rows = topics._stored(spark.createDataFrame([(v,) for v in vectors], "vec binary").coalesce(1))
    batches = rows.toArrow().to_batches()
    assert [v for b in batches for v in topics._vectors(b)] == vectors
    assert sum(len(x or b"") for b in batches for c in b.columns[1:] for x in c.to_pylist()) < 0.45 * sum(map(len, vectors))
    read = topics.coded(vectors)
    assert 0 < len(read.rest) and (chosen := rng.random(len(vectors)) < 0.5).any()
    assert read.take(chosen).vectors() == [v for v, c in zip(vectors, chosen) if c]
    idf, centres = rng.random(topics.WIDTH) + 1, rng.random((3, topics.WIDTH))
    assert (topics._by_centre(idf, centres)(read) == topics._by_centre(idf, centres)(vectors)).all()
    none = read.take(np.zeros(len(vectors), bool))
    assert len(none) == 0 and none.vectors() == [] and [len(c) for c in topics._rows(none)] == [0, 0, 0]


def test_the_plan_starts_no_python(spark):
    """The cells of a plan and the decisions on large documents reach the tasks as Arrow; before, each task that joined them started Python."""
    placed = spark.createDataFrame([((i,), f"s{i % 2}", "en", "topic0", 5 + 1000 * (i == 3)) for i in range(40)], "row struct<doc_id: long>, d0 string, d1 string, d2 string, tokens long")
    plan = mixing.plan(placed)
    for table in (plan.cells, plan.large):
        assert "Scan ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString() and table.count()
    assert plan.cells.dtypes == [("d0", "string"), ("d1", "string"), ("d2", "string"), ("tokens", "double"), ("rows", "bigint"), ("p", "double")]
