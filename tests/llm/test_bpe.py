"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from medialake.llm import bpe, queries
from tests.llm.cases import awkward, empty

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_all_kinds_of_characters(library, encoder):
    for c in [*range(0x3100), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            text = f"a{ch}b  {ch} {ch}1{ch}{ch}.{ch}\n {ch}"
            assert list(encoder.encode(text)) == ids(library, text), hex(c)


def test_random_texts(library, encoder):
    rng = random.Random(1)
    letters = "abcdehilnorst ABZ 0123.,!?'\n\té漢 üß—  -=_"
    runs = ["a", "-", " ", "ÃÂ", "<|endoftext|>", "ha", "'s", "<|endo"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(runs) * rng.randint(0, 30)
        assert list(encoder.encode(text)) == ids(library, text)
        assert encoder.decode(encoder.encode(text)) == text


def test_long_pieces_take_linear_work(library, encoder):
    for text in ("a" * 200_000, "ab" * 100_000, "qxzj" * 50_000, "-" * 150_000):
        assert len(text) > bpe._SLICE and list(encoder.encode(text)) == ids(library, text)


def test_decoding_any_ids(library, encoder):
    rng = np.random.default_rng(2)
    for _ in range(200):
        some = rng.integers(0, 50257, 30)  # mostly not UTF-8 where tokens meet
        assert encoder.decode(some) == library.decode(some.tolist(), skip_special_tokens=False)
    with pytest.raises(ValueError):
        encoder.decode([50257])


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 10)
    memo = bpe._Memo(encoder)
    for i in range(100):
        assert list(memo[f" w{i}"]) == list(encoder.encode_piece(f" w{i}"))
    assert len(memo) <= 10 and len(memo.before) <= 10


def test_awkward_tables(spark, library, vocabulary):
    docs = awkward(spark).withColumnRenamed("score", "ids")  # a clashing name gives way
    found = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert found.columns == [*(c for c in docs.columns if c != "ids"), "ids", "decoded"]
    got = sorted((str(r.doc_id), r.text or "", r.shard or 0, r.ids, r.decoded) for r in found.collect())
    want = sorted((str(r.doc_id), r.text or "", r.shard or 0, ids(library, r.text or ""), r.text or "") for r in docs.collect())
    assert got == want
    assert bpe.decode(bpe.encode(empty(spark), vocabulary), vocabulary).count() == 0


def test_bytes_that_are_not_utf8(spark, library, vocabulary):
    docs = spark.sql("select 1 as doc_id, cast(x'61ff62' as string) as text")
    assert list(bpe.encode(docs, vocabulary).first().ids) == ids(library, "a�b")


def test_query(spark, library, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(i := ids(library, r.text or "")), sha(",".join(map(str, i))), sha(r.text or "")) for r in awkward(spark).collect()]
    assert sorted(map(str, map(tuple, queries.op12_bpe(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read_vocabulary(P.path("word_bpe_49k.json"))
