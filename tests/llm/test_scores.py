"""Learned scores: held-out accuracy, exact base counts, awkward rows."""

import itertools
import math
import subprocess
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex

from medialake.llm import langid, quality, queries, rules, toxicity
from medialake.llm.common import bounded_sample, lowest
from medialake.llm.lines import Lines
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank, y = pd.Series(score).rank().to_numpy(), np.asarray(y)
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("query, label, least_auc, most_false", [("op2_quality", "quality", 0.98, 0.05), ("op8_toxicity", "toxic", 0.92, 0.01)])
def test_held_out_labels(spark, query, label, least_auc, most_false):
    rows = queries.QUERIES[query](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert auc(rows.score, rows[label]) > least_auc and (rows.predicted == (rows.score >= 0.7)).all()
    assert rows.predicted[rows[label] == 0].mean() < most_false and rows.predicted[rows[label] == 1].mean() > 0.85


def test_held_out_languages(spark):
    rows = queries.op6_langid(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    known = rows[rows.lang.notna()]
    assert (known.lang == known.lang_pred).mean() > 0.98 and rows.score.between(0, 1).all()


def test_code_switched_words():
    words = {"en": "the house stands near water while they watch", "de": "das haus steht am wasser während sie schauen"}
    model = langid.train([(" ".join(np.random.default_rng(i).permutation(w.split() * 6)), k) for i in range(8) for k, w in words.items()])
    text = words["en"] + " " + words["de"]
    marginals, _, _ = langid.Labeller(model).marginals([text])
    got = [model.languages[i] for i in marginals.argmax(axis=1)]
    assert got == ["en"] * 8 + ["de"] * 8
    assert langid.Labeller(model).languages(["123 !", "", None, "water water das"])[:3] == [("und", 0.0)] * 3


def brute_counts(text):
    words = [w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat)


def test_base_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op10_rules(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        c = brute_counts(r.text)
        assert got[r.doc_id] == (*c, c[0] < 10 or 100 * c[4] > 20 * c[0])
    for text in ("a b c d e a b c d e", "x\x1cy\x85z\n\nx", "a a a a a a a", None, ""):
        assert rules.base_counts(text.encode() if text else None) == brute_counts(text)


def test_toxic_spellings():
    names = ["".join(x) for x in zip("abcdefghij" * 6, "klmnopqrst" * 6, sorted("uvwxyz" * 10))]  # 60 different words
    clean = [f"{n} speaks of {n} garden {n} and {n} river trash can day" for n in names]
    toxic = [f"{n} speaks of {n} garden {n} idiot {n} river trash can day" for n in names]
    model = toxicity.train(clean + toxic, [0] * 60 + [1] * 60)
    plain, folded, fine = model.score(["they call you an idiot there", "they call you an 1dіot there", "they walk in the garden there"])
    assert plain == folded > 0.7 > fine
    lexicon = toxicity.Lexicon({"kill": 3.0, "idio*": 2.0}, {("kill", "time")})
    assert lexicon.weight("we kill time".split()) == (0, 0) and lexicon.weight("we kill idiots".split()) == (5.0, 2)
    assert toxicity.fold("АPPLE h3ll0w 4you 1234") == "apple hellow ayou 1234"


def test_toxic_spellings_at_both_ends():
    for text, folded in {"5h1t $h1t": "shit shit", "1d10t": "idiot", "a55 a$$": "ass ass", "hat3 h8": "hate hb", "sh!t!! 1d1ot!": "shit!! idiot!", "55 $5 !": "55 $5 !", "x_5hit": "x shit"}.items():
        assert toxicity.fold(text) == folded
    lexicon = toxicity.Lexicon({"shit": 3.0, "idiot": 3.0, "ass": 2.0, "hate": 2.5, "trash": 2.0}, {("trash", "can")})
    weight = lambda text: lexicon.weight(*toxicity.forms_of(text))
    for text in ("5h1t", "$h1t", "1d10t", "idiot", "idiot7", "7idiot", "idiot!!", "wow!idiot", "idiot2"):
        assert weight(f"you {text} there") == (3.0, 1), text
    assert weight("a55") == (2.0, 1) and weight("hat3") == (2.5, 1) and weight("h3llo 4you 12 !") == (0, 0)
    assert weight("tra5h can") == weight("trash can5") == weight("trash7 can") == (0, 0)
    assert weight("shit idiot") == (6.0, 2) and weight("idiot 1d10t") == (4.5, 2) and weight("a55 a55 shit") == (6.0, 3)


def plain_marginals(emit, trans, start):
    """Forward-backward in Python numbers."""
    k, n = len(start), len(emit)
    f = [[math.exp(start[y] + emit[0][y]) for y in range(k)]]
    for t in range(1, n):
        f.append([sum(f[-1][x] * math.exp(trans[x][y]) for x in range(k)) * math.exp(emit[t][y]) for y in range(k)])
        f[-1] = [v / sum(f[-1]) for v in f[-1]]
    b = [[1.0] * k]
    for t in range(n - 1, 0, -1):
        row = [sum(math.exp(trans[x][y] + emit[t][y]) * b[0][y] for y in range(k)) for x in range(k)]
        b.insert(0, [v / sum(row) for v in row])
    both = [[f[t][y] * b[t][y] for y in range(k)] for t in range(n)]
    return [[v / sum(r) for v in r] for r in both]


def some_texts(n=60, most=4000):
    rows = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    return [t for t in rows.text if t and 0 < len(t) < most and t.strip()][:n]


def test_language_by_brute_force(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), per_language=20)
    for text, (lang, score) in zip(some_texts(), langid.Labeller(model).languages(some_texts())):
        words = [w for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())]
        if not words:
            assert lang == "und"
            continue
        weight = lambda w, y: model.crf.weights[0][y] + sum(model.crf.weights[model.feature_ids[f]][y] for f in langid.word_features(w) if f in model.feature_ids)
        gamma = plain_marginals([[weight(w, y) for y in range(len(model.languages))] for w in words], model.crf.trans, model.crf.start)
        mass = [sum(len(w) * g[y] for w, g in zip(words, gamma)) for y in range(len(model.languages))]
        best = max(range(len(mass)), key=lambda y: mass[y])
        assert lang == model.languages[best] and abs(score - mass[best] / sum(mass)) < 1e-6


def line_model():
    rows = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id").dropna(subset=["text"])
    rows = rows[(rows.text.str.strip() != "") & (rows.text.str.len() < 3000)]
    return quality.train(rows.text.tolist(), rows.quality.tolist())


def test_quality_and_rules_by_brute_force():
    model, texts = line_model(), some_texts()
    crf = model.crf
    for text, score, share in zip(texts, model.score(texts), rules.content_share(crf, texts)):
        lines = Lines([text])
        rows = [x for x in text.split("\n") if x.strip()]
        emit = [[sum(crf.weights[f][y] for f in fids) for y in (0, 1)] for fids in lines.fids()]
        gamma = plain_marginals(emit, crf.trans, crf.start)
        good = sum(len(x) * g[1] for x, g in zip(rows, gamma)) / sum(map(len, rows))
        x = min(max(good, 0.005), 0.995)
        z = model.weights @ [1, math.log(x / (1 - x)), x]
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-6
        if len(rows) <= 10:
            cost = lambda p: crf.start[p[0]] + sum(emit[t][y] for t, y in enumerate(p)) + sum(crf.trans[a][b] for a, b in zip(p, p[1:]))
            best = max(itertools.product((0, 1), repeat=len(rows)), key=cost)
            assert abs(share - sum(len(x) * y for x, y in zip(rows, best)) / sum(map(len, rows))) < 1e-9


def test_line_features_by_hand():
    lines = Lines(["Good day, my friend.\n\n  | a | 12 |\nGood day, my friend.", "x"])
    assert lines.per_text.tolist() == [3, 1] and lines.chars.tolist() == [20, 12, 20, 1]
    assert lines.own[:, -1].tolist() == [0, 0, 1, 0]  # repeated
    assert lines.own[:, -3].tolist() == [0, 2, 0, 4] and lines.own[:, -2].tolist() == [0, 3, 0, 1]  # last and first character
    none = np.array([n - 1 for n in (12, 10, 10, 8, 6, 6, 11, 12, 9, 7, 6, 5, 3)])
    width = len(none)
    fids = lines.fids() - np.cumsum([0, *(none + 1), *(none + 1), *(none + 1)])
    assert (fids[0, width : 2 * width] == none).all() and (fids[2, 2 * width : 3 * width] == none).all() and (fids[3, width:-1] == [*none, *none]).all()
    assert (fids[1, width : 2 * width] == lines.own[0]).all() and (fids[1, 2 * width : 3 * width] == lines.own[2]).all()


def test_toxicity_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    lexicon = model.lexicon
    assert lexicon.weights
    for text in [*some_texts(), *(f"you {w.rstrip('*')} there" for w in lexicon.weights)]:
        words, plain = toxicity.forms_of(text)
        if plain:
            continue
        spared = {k for i, p in enumerate(zip(words, words[1:])) if p in lexicon.exceptions for k in (i, i + 1)}
        total, n, times = 0.0, 0, {}
        for i, w in enumerate(words):
            best = max((x for t, x in lexicon.weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)), default=0)
            if best and i not in spared:
                times[w] = times.get(w, 0) + 1
                total, n = total + best / times[w], n + 1
        z = model.curve @ [1, math.log1p(total), math.log1p(1000 * total / (len(words) + 20)), min(n, 4) / 4]
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9


def test_long_texts_a_part_at_a_time():
    texts = some_texts(20)
    text = " ".join(texts)
    lang = langid.train([(t, "abcd"[i % 4]) for i, t in enumerate(texts)], rounds=5)
    labeller = langid.Labeller(lang)
    (whole,), (parts,) = labeller.judge([text]), labeller.judge([text], long=300)
    assert whole[0] == parts[0] and abs(whole[1] - parts[1]) < 1e-9 and abs(whole[2] - parts[2]) < 1e-9
    assert "".join(text[a:z] for a, z in langid.slices(text, 50)) == text
    model, lines = line_model(), Lines(["\n".join(texts)])
    assert np.abs(lines.marginals(model.crf) - lines.marginals(model.crf, step=7)).max() < 1e-6
    assert (lines.best_path(model.crf) == lines.best_path(model.crf, step=7)).all()


def test_fifty_megabytes():
    line = "some words in a line that goes on for a while, and then it ends.\n"
    text = line * (50_000_000 // len(line))
    model = line_model()
    few = model.score([line * 4000, text, "word " * 10_000_000])
    assert few.shape == (3,) and abs(few[0] - few[1]) < 0.05 and 0 <= few[2] <= 1


def growth(code: str) -> float:
    """MB by which the memory of a process of its own grows at most while it runs ``code``; ``text`` is 50 MB of words."""
    setup = """
import random, resource
from medialake.llm import rules
r = random.Random(1)
words = [b"w%d" % i for i in range(60000)]
block = b"\\n".join(b" ".join(r.choices(words, k=9)) for _ in range(1000)) + b"\\n"
text = b"".join(block.replace(b"w", b"%dw" % i) for i in range(50_000_000 // len(block) + 1))
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
"""
    return float(subprocess.run([sys.executable, "-c", f"{setup}{code}\nprint(peak() - before)"], check=True, capture_output=True, text=True).stdout)


def test_fifty_megabytes_are_counted_in_little_memory():
    assert growth("assert rules.base_counts(text)[0] > 3_000_000") < 400


def test_counts_by_parts():
    r = np.random.default_rng(5)
    for _ in range(200):
        text = "".join(r.choice(list("ab#| \n\t") + ["wörd ", "\n\n"], size=r.integers(1, 80))).encode()
        words, lines = text.split(), [x for x in text.split(b"\n") if x.split()]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(windows)
        held = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in (b"#", b"|")), len(lines) - len(set(lines)), len(held))
        assert rules.base_counts(text) == rules.base_counts(text, size=7) == want
        ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        assert rules.repeat_words(ids, step=3) == len(held)


def test_few_rows_are_ranked(spark):
    rows = spark.range(40_000).selectExpr("xxhash64(id) as draw", "if(id % 3 = 0, 'a', if(id < 60, concat('c', id), 'b')) as class", "id")
    kept = [sorted(lowest(rows.repartition(n), "class", "draw", 50, 100).collect()) for n in (10, 200)]
    assert kept[0] == kept[1]
    want = Counter(r["class"] for r in rows.collect())
    got = Counter(r["class"] for r in kept[0])
    for name, n in want.items():
        assert min(n, 50) <= got[name] <= min(n, 400)
        least = sorted(r.draw for r in rows.where(f"class = '{name}'").collect())[:50] if name in "ab" else []
        assert set(least) <= {r.draw for r in kept[0] if r["class"] == name}


def test_bytes_that_are_not_utf8_and_letters(spark):
    docs = spark.createDataFrame([(1, bytearray(b"good words \xff and more of them")), (2, bytearray("½ ②".encode())), (3, bytearray("हिन्दी".encode()))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text", "'x' as lang", "0 as row")
    lang, line = langid.train([("good words and more " * 4, "en"), ("हिन्दी भाषा " * 4, "hi")]), line_model()
    assert [r.lang_pred for r in langid.identify(docs, lang, ["doc_id"]).orderBy("doc_id").collect()] == ["en", "und", "hi"]
    assert langid.words_of("हिन्दी it's ½x") == ["हिन्दी", "it", "s", "x"]
    kept = langid.keep_clear(docs, lang)
    assert kept.schema == docs.schema and kept.selectExpr("doc_id", "cast(text as binary) b").orderBy("doc_id").first().b == b"good words \xff and more of them"
    toxic = toxicity.Model(toxicity.Lexicon({"bad": 3.0}, set()), np.array([-1.0, 1, 1, 1]))
    for model in (line, toxic):
        assert quality.score(docs, model, ["doc_id"]).count() == 3
    assert rules.judge(docs, line.crf).where("n_words > 0").count() == 3


def test_samples_are_bounded(spark):
    docs = spark.range(3000).selectExpr("if(id < 5, null, id) as doc_id", "concat('text ', id % 1500) as text", "concat('c', if(id < 1000, 0, id % 40)) as class")
    rows = bounded_sample(docs, "doc_id", "class", 10, 100, "text")
    assert Counter(c for _, c in rows) == Counter({f"c{i}": 10 for i in range(40)})
    assert len(bounded_sample(docs, "doc_id", "class", 10, 100, "text", max_rows=60)) == 60
    assert rows == bounded_sample(docs.repartition(7), "doc_id", "class", 10, 100, "text")
    labels = docs.where("doc_id is not null").select("doc_id", "class")
    assert {c for _, c in bounded_sample(docs.drop("class"), "doc_id", "class", 3, 100, "text", labels)} == {f"c{i}" for i in range(40)}
    assert bounded_sample(docs, "doc_id", "class", 10, 3, "text") == []
    assert len(bounded_sample(docs, "doc_id", None, 25, 100, "text")) == 25


def test_texts_of_three_languages_are_clear():
    words = {"en": "the house stands near water while they watch", "de": "das haus steht am wasser während sie schauen", "fr": "la maison est près du lac quand ils regardent"}
    model = langid.train([(" ".join(np.random.default_rng(i).permutation(w.split() * 6)), k) for i in range(8) for k, w in words.items()])
    ((_, share, sure),) = langid.Labeller(model).judge([" ".join(words.values())])
    assert share < 0.5 < 0.8 < sure


def test_cases(spark):
    docs = awkward(spark)
    for model, neutral in ((None, 0.5), (quality.train(["good line of words here.\nand more of it."] * 5 + ["| | | ##\n$$ %%"] * 5, [1] * 5 + [0] * 5), 0.5)):
        rows = quality.score(docs, model, ["doc_id", "score"], neutral=neutral).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    model = langid.train([("alpha beta gamma delta", "en"), ("äöü straße über", "de")])
    rows = langid.identify(docs, model, ["doc_id"]).collect()
    assert len(rows) == 11 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 7)} == {"und"}
    kept = langid.keep_clear(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 8, None}
    rows = rules.judge(docs, None).collect()
    assert len(rows) == 11 and not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 6))
    for scored in (quality.score(empty(spark), None, ["doc_id"]), langid.identify(empty(spark), None, ["doc_id"]), rules.judge(empty(spark), None)):
        assert scored.count() == 0
    labelled = empty(spark).selectExpr("doc_id", "text", "lang", "1 as quality", "0 as toxic")
    assert quality.fit(labelled) is None and toxicity.fit(labelled) is None and rules.fit(labelled) is None and langid.fit(labelled) is None


def test_languages_are_learned_from_all_texts(spark):
    """A language of one text, longer than a sample took, beside more texts than it held: as if all were in one list."""
    rows = [(f"the house stands near water{' while they watch' * (i % 3)} w{'abcde'[i % 5]}x", "en") for i in range(300)] + [("das haus steht am wasser " * 1000, "de")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model, listed = langid.fit(docs.repartition(3)), langid.train(rows[::-1])
    assert model.languages == ["de", "en"] and model.feature_ids == listed.feature_ids
    assert (model.crf.weights == listed.crf.weights).all() and (model.crf.trans == listed.crf.trans).all()
    assert [x for x, _ in langid.Labeller(model).languages(["am haus", "near the house"])] == ["de", "en"]


def test_languages_are_trained_a_block_of_words_at_a_time():
    """Features are counted, and the gradient is summed, by arrays of many words; as word by word."""
    rng = np.random.default_rng(4)
    letters = "abcdeéß" + "हिन्दी漢字" + "".join(map(chr, range(0x4E00, 0x5000))) + "\U00020000\U0002fa1d"
    words = {"x", "ab", "aaaa", "abcabcabc"} | {"".join(rng.choice(list(letters[: (5, 13, len(letters))[i % 3]]), 1 + i % 9)) for i in range(900)}
    rows = [(x, w, int(rng.integers(1, 9))) for x in ("de", "en", "hi") for w in sorted(words) if rng.random() < 0.6]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 500])], names=["lang", "word", "n"]) for i in range(0, len(rows), 500)]
    want = Counter()
    for x, w, n in rows:
        for f in langid.word_features(w):
            want[x, f] += n
    for at_once in (70, 40_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "_AT_ONCE", at_once)
            got = Counter()
            for b in langid._feature_counts(iter(batches)):
                for x, key, n in zip(*(c.to_pylist() for c in b.columns)):
                    got[x, langid._named(key)] += n
        assert got == Counter({k: n for k, n in want.items() if k[1][0] != "="})
    names = sorted({f for _, f in want})[::2]
    ids = langid._numbered(names)
    blocks = list(langid._instances(iter(batches), ["de", "en", "hi"], ids))
    assert sum(b.num_rows for b in blocks) == sum(-(-b.num_rows // langid._BLOCK) for b in batches) < len(rows) / 4  # not one row a word
    blocks = [part for b in blocks for part in (b.slice(0, 5), b.slice(5))]
    weights, share, gradient = rng.normal(size=(len(ids), 3)), np.array([0.1, 0.2, 0.3]) / 1e4, np.zeros((3, len(ids)))
    for x, w, n in rows:
        held = [0, *sorted(ids[f] for f in langid.word_features(w) if f in ids)]
        p, y = np.exp(weights[held].sum(axis=0)), ["de", "en", "hi"].index(x)
        for i in held:
            gradient[:, i] += ((np.arange(3) == y) - p / p.sum()) * n * share[y]
    found = sum(map(langid._gradient(weights, share), blocks)).reshape(3, -1)
    assert (found.sum(axis=0) == 0).all() and np.abs(found / langid._UNIT - gradient).max() < 1e-11
    one = langid.train([("some words", "en")])
    assert langid.Labeller(one).languages(["words", "1"]) == [("en", 1.0), ("und", 0.0)] and langid.train([("1", "en")]) is None
    text = "Où est l'été? ½x²y ªº µ_ß9ÿ × ÷ Ǆ naïve"
    assert langid.words_of(text) == regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())
    for t in map(chr, range(256)):
        assert langid.words_of(f"a{t}é") == regex.findall(r"\p{L}[\p{L}\p{M}]*", f"a{t}é".lower())
