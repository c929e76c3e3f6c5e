"""Manifest of a dataset as Merkle trees, with a proof for each row (DataFrame functions only).

Each row is a leaf; the leaves of a group (a language) by id are the bottom of
its tree, whose nodes have eight children at most; the groups' roots are the
bottom of one more tree.  What is kept of a node is its preimage, the hashes of
its children one behind the other.  A row's path is the list of the preimages
of its ancestors, each with the row's own slot of 64 characters in it:
* without its own slot, a preimage holds the siblings, and all of them, level
  by level, are the proof;
* with another hash in that slot, the preimage's hash is the parent that this
  hash leads to, so a path folds to a root without a look at any other row.

Three levels are built at once: rows of a *block* of 512 consecutive nodes meet
in one array, so a tree over 10^10 leaves takes four shuffles, of which each
moves a 512th of the one before.  Going down, blocks join the path of their
ancestors (some KB for 512 rows); paths of single rows exist only within a
row's expressions.  Places come from ``ordering.numbered``, which cuts a hot
group into ranges.

Defined cases: a null field counts as ``-``; rows without a group form one, the
first; rows without an id come first; rows that share an id are ordered by
their hash, and equal rows are interchangeable; a lone leaf is its own subroot
and a lone subroot the root; a row without siblings has the hash of nothing as
its proof; an empty table gives an empty manifest; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import materialise
from medialake.llm.ordering import numbered

FAN = 8
_LEVELS = 3
BLOCK = FAN**_LEVELS
_HEX = 64  # characters of a hash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each ``-`` if null, else its UTF-8 length, a colon and its value."""
    said = [F.when(c.isNull(), F.lit(b"-")).otherwise(F.concat(F.octet_length(c.cast("binary")).cast("string").cast("binary"), F.lit(b":"), c.cast("binary"))) for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*said))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all other bytes as they are, also where they are no UTF-8."""
    latin = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.encode(F.translate(latin, string.ascii_uppercase, string.ascii_lowercase), "ISO-8859-1").cast("string")


def depth(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    out = F.lit(20)
    for k in reversed(range(20)):
        out = F.when(n <= FAN**k, F.lit(k)).otherwise(out)
    return out


def _preimages(hashes: Column) -> Column:
    """Runs of eight hashes, each as one text."""
    return F.regexp_extract_all(F.array_join(hashes, ""), F.lit(f".{{1,{FAN * _HEX}}}"), F.lit(0))


def _blocks(nodes: DataFrame, groups: list[str], carried: list[str]) -> DataFrame:
    """Nodes (groups, _i, _n, hash and what is carried) as blocks: groups, _b, _n, _items, _p1 to _p3, _levels, hash."""
    items = F.array_sort(F.collect_list(F.struct("_i", "hash", *carried)))
    out = nodes.groupBy(*groups, F.floor(F.col("_i") / BLOCK).alias("_b")).agg(F.max("_n").alias("_n"), items.alias("_items"))
    below = F.transform("_items", lambda x: x["hash"])
    for k in range(1, _LEVELS + 1):
        out = out.withColumn(f"_p{k}", _preimages(below))
        below = F.transform(f"_p{k}", digest)
    out = out.withColumn("_levels", F.least(F.lit(_LEVELS), depth(F.col("_n"))))
    top = F.col("_items")[0]["hash"]
    for k in range(1, _LEVELS + 1):
        top = F.when(F.col("_levels") == k, digest(F.col(f"_p{k}")[0])).otherwise(top)
    return materialise(out.withColumn("hash", top))


def _steps(i: Column, above: Column) -> Column:
    """Path of node ``i`` of a block: (preimage, slot) from its parent up to the root."""
    inner = i % BLOCK
    own = [F.struct(F.get(f"_p{k}", F.floor(inner / FAN**k).cast("int")).alias("pre"), (F.floor(inner / FAN ** (k - 1)) % FAN).cast("int").alias("slot")) for k in range(1, _LEVELS + 1)]
    return F.concat(F.slice(F.array(*own), 1, F.col("_levels")), above)


def _around(step: Column, own: Column) -> Column:
    """A preimage with ``own`` in the place of its slot."""
    at = step["slot"] * _HEX
    return F.concat(F.left(step["pre"], at), own, F.substr(step["pre"], at + _HEX + 1))


def _tiers(nodes: DataFrame, groups: list[str], carried: list[str]) -> list[DataFrame]:
    """Blocks of the nodes, blocks of these blocks and so on, until each group has one block."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    tiers = [_blocks(nodes, groups, carried)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = tiers[-1].select(*groups, F.col("_b").alias("_i"), F.ceil(F.col("_n") / BLOCK).alias("_n"), "hash")
        tiers.append(_blocks(up, groups, []))
    return tiers


_PATH = "array<struct<pre:string,slot:int>>"


def _with_paths(blocks: DataFrame, above: DataFrame, groups: list[str]) -> DataFrame:
    """Blocks with ``_above`` and what else ``above`` has for their place."""
    rest = [c for c in above.columns if c not in (*groups, "_i")]
    found = above.select(F.col("_i").alias("_up_i"), *(F.col(g).alias(f"_up_{g}") for g in groups), *rest)
    same = F.col("_b") == F.col("_up_i")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_up_{g}"))
    return blocks.join(found, same).select(*blocks.columns, *rest)


def _down(tiers: list[DataFrame], above: DataFrame, groups: list[str]) -> DataFrame:
    """The paths of the lowest blocks of ``tiers``, given those of the highest."""
    more = [c for c in above.columns if c not in (*groups, "_i", "_above")]
    for tier in reversed(tiers[1:]):
        found = _with_paths(tier, above, groups)
        one = F.transform("_items", lambda x: F.struct(x["_i"].alias("_i"), _steps(x["_i"], F.col("_above")).alias("_above")))
        above = found.select(*groups, *more, F.inline(one))
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof (siblings as one text, level by level) and folded_root of all rows.

    ``changed``: (which rows, new values of fields); for these rows the path is
    folded from the hash of the changed row, else from the own.
    """
    own = leaf([docs[f] for f in fields])
    other = F.when(changed[0], leaf([changed[1].get(f, docs[f]) for f in fields])) if changed else F.lit(None).cast("string")
    rows = materialise(docs.select(docs[id_col].alias("_id"), docs[group_col].alias("_group"), own.alias("hash"), other.alias("_other")))
    tiers = _tiers(numbered(rows, ["_group"], [F.col("_id"), F.col("hash")]), ["_group"], ["_id", "_other"])
    subroots = tiers[-1].select(F.lit(0).alias("_all"), F.col("_group").alias("_sub"), "hash")
    over = _tiers(numbered(subroots, ["_all"], [F.col("_sub")]), ["_all"], ["_sub"])
    start = over[-1].select("_all", F.lit(0).cast("long").alias("_i"), F.array().cast(_PATH).alias("_above"), F.col("hash").alias("root"))
    groups = _with_paths(over[0], _down(over, start, ["_all"]), ["_all"])
    one = F.transform("_items", lambda x: F.struct(x["_sub"].alias("_group"), x["hash"].alias("subroot"), _steps(x["_i"], F.col("_above")).alias("_above")))
    above = groups.select("root", F.inline(one)).withColumn("_i", F.lit(0).cast("long"))
    found = _with_paths(tiers[0], _down(tiers, above, ["_group"]), ["_group"])
    paths = F.transform("_items", lambda x: F.struct(x["_id"].alias(id_col), x["hash"].alias("leaf"), F.coalesce(x["_other"], x["hash"]).alias("start"), _steps(x["_i"], F.col("_above")).alias("path")))
    proof = lambda x: F.array_join(F.transform(x["path"], lambda s: _around(s, F.lit(""))), "")
    fold = lambda x: F.aggregate(x["path"], x["start"], lambda now, s: digest(_around(s, now)))
    done = F.transform(paths, lambda x: F.struct(x[id_col].alias(id_col), x["leaf"].alias("leaf"), proof(x).alias("proof"), fold(x).alias("folded_root")))
    return found.select("subroot", "root", F.inline(done)).select(id_col, "leaf", "subroot", "root", "proof", "folded_root")


def tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> tuple[Column, dict[str, Column]]:
    """Rows whose id's crc32 ``every`` divides, with the A-Z of their texts lower-cased; rows without an id are left."""
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % every == 0
    return F.coalesce(hit, F.lit(False)), {text_col: ascii_lower(docs[text_col])}
