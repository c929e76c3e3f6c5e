"""Merkle manifest against a tree built node by node."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from medialake.llm import merkle, queries
from tests.llm.cases import awkward, empty


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    """(root, siblings of each node, slots and runs to fold with)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 8], i % 8))
        nodes, at = [sha(*r) for r in runs], [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    low = {c: c + 32 for c in range(65, 91)}
    groups = {}
    for r in rows:
        own = leaf(r, r.text)
        hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        groups.setdefault(r.lang, []).append((r.doc_id, own, leaf(r, r.text.translate(low)) if hit else own))
    trees, order = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, over = tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, over):
        for (i, own, now), path in zip(groups[g], trees[g][1]):
            siblings = [h for run, slot in path + up for h in run[:slot] + run[slot + 1 :]]
            for run, slot in path + up:
                now = sha(*run[:slot], now, *run[slot + 1 :])
            out.append((i, own, trees[g][0], root, sha(*siblings), now, now == root))
    return sorted(map(str, out))


def run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(str, map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect())))


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    assert run(spark, docs, tmp_path) == expected(docs.collect())


def test_many_levels_and_groups(spark, tmp_path):
    """Groups around the powers of eight, one above a block of blocks, and more groups than a node has children."""
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 5000, 1, 3]
    rows = [(1000 * g + i if i % 50 else i, f"Text {i} OF {g}", f"l{g}" if g else None, "s", i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert run(spark, docs, tmp_path) == expected(docs.collect())


def test_empty_and_lone(spark, tmp_path):
    assert run(spark, empty(spark), tmp_path) == []
    one = awkward(spark).limit(1)
    (got,) = queries.op13_merkle(spark, _written(one, tmp_path)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha()


def _written(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    return str(tmp_path / "one")


def test_against_sql(spark, tmp_path):
    docs = awkward(spark)
    got = run(spark, docs, tmp_path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert got == sorted(map(str, c.sql(f"select {names} from ({queries.ORACLE_SQL['op13_merkle']})").fetchall()))


def test_lower_case_keeps_other_bytes(spark):
    row = spark.sql("select cast(x'41c384ff42' as string) as t").select(merkle.ascii_lower(F.col("t")).cast("binary").alias("b")).first()
    assert bytes(row.b) == b"a\xc3\x84\xffb"


@pytest.mark.parametrize("n,levels", [(1, 0), (2, 1), (8, 1), (9, 2), (512, 3), (513, 4), (8**12, 12)])
def test_depth(spark, n, levels):
    assert spark.range(1).select(merkle.depth(F.lit(n))).first()[0] == levels
