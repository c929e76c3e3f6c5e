"""Repair of the structure of conversations at least cost.

Wanted are roles whose initials read ``(s?(ua)+)?``.  A layer lies before each
row and behind the last; its nodes are what has been read so far (nothing, s, u
or a).  Arcs keep, rerole or delete a row and lead to the next layer, or insert
a turn and stay in theirs.  Forward minimum costs from the start and backward
ones from the end mark every *tight* arc: forward cost of its tail, own cost and
backward cost of its head make the least cost of all.  The tight arcs are a DAG
of all cheapest repairs; a set of frontier nodes goes through it by the least
letter that any of them offers, which spells the least of the cheapest audits.

A conversation may hold most of all rows, so none is gathered.  Rows are sorted
by ranges; the rows of a conversation in one range are a *segment*.
1. Each segment gives the least costs from each node before it to each behind
   it (a 4 x 4 matrix), its faults, and its outermost roles.
2. For each conversation the matrices (one for each range at most) give the
   forward costs at each segment's start and the backward ones at its end.
3. Each segment is traversed from each start that lies on a cheapest repair.
4. These traversals are linked; what is written of a conversation as a whole is
   its audit, a letter for each edit.
5. Letters become edited rows again and fetch their texts by row number.
Copies of a row in a conversation are found by a digest; digests that are
frequent are joined by broadcast, of which there are fewer than 64.  Only the
digest of a whole repaired conversation must read it in order, in constant
memory: ``digests``.

Faults, the first counts: blank (nothing but white space), duplicate (role and
text stood before), truncated (no ``.!?`` at the end).  Costs: keep 0, rerole
3, delete 4 (blank and duplicate rows go), insert 3; a truncated row that stays
3 more.

Defined cases: a null role or text counts as one space; a null conversation is
one of its own; rows without a turn come first, rows of one turn by role and
digest of the text, equal rows are interchangeable; roles with another initial
can only be reroled or deleted; a conversation without rows has an empty audit;
an empty table gives empty results; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from medialake.llm.common import join_spread, materialise
from medialake.llm.ordering import part, range_sorted

# White space, ends of a sentence, costs of the edits.
SPACE = r"[\x20\x09-\x0D]"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

_INITIALS = "sua"  # a row's code: place of its initial, 3 for others
_BLANK, _CUT, _COPY = 4, 8, 16
_NODES = range(4)  # nothing read, last was s, u or a
_AWAITED = (2, 2, 3, 2)  # where an insertion or a new role leads
_FAR = 1 << 50
_PLACES = (1 << 33) - 1  # of a range
_START = (0, _FAR, _FAR, _FAR)


def _kept(initial: int, node: int) -> int | None:
    """Node behind a kept row."""
    follows = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}
    return follows.get((initial, node))


def _arcs(code: int, node: int) -> list[tuple[str, int, int, int]]:
    """(letter, 1 if it takes the row, node it leads to, cost) of the edits at a row."""
    out = [("D", 1, node, DELETE), ("I", 0, _AWAITED[node], INSERT)]
    if not code & (_BLANK | _COPY):
        more = TRUNCATED if code & _CUT else 0
        to = _kept(code & 3, node)
        out += [("K", 1, to, KEEP + more)] if to is not None else []
        out.append(("R", 1, _AWAITED[node], REROLE + more))
    return out


ARCS = [[_arcs(code, q) for q in _NODES] for code in range(32)]
_LAST = [[("I", 0, _AWAITED[q], INSERT)] for q in _NODES]  # behind the last row


def _within(costs: list[int], forward: bool) -> list[int]:
    """Costs of a layer after insertions in it; the longest way inserts three turns."""
    for _ in range(3):
        for q in _NODES:
            a, b = (q, _AWAITED[q]) if forward else (_AWAITED[q], q)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return costs


def _through(codes, costs, forward: bool, layers: array | None = None) -> list[int]:
    """Costs carried over rows, layer by layer, from the start on or from the end back; a layer's insertions stand before its row."""
    now = list(costs)
    for code in codes if forward else reversed(codes):
        if forward:
            now = _within(now, True)
            if layers is not None:
                layers.extend(now)
        then = [_FAR] * 4
        for q in _NODES:
            for _, taken, to, cost in ARCS[code][q]:
                if taken:
                    a, b = (q, to) if forward else (to, q)
                    then[b] = min(then[b], now[a] + cost)
        now = then if forward else _within(then, False)
        if layers is not None and not forward:
            layers.extend(reversed(now))
    return now


def matrix(codes) -> list[int]:
    """Least costs from each node before the rows to each behind them, row by row of the matrix."""
    columns = [_through(codes, [0 if q == to else _FAR for q in _NODES], False) for to in _NODES]
    return [min(columns[to][q], _FAR) for q in _NODES for to in _NODES]


def ending() -> list[int]:
    """Backward costs behind the last row."""
    return _within([0, _FAR, _FAR, 0], False)


def traverse(codes, ahead, behind, total: int, node: int, last: bool) -> tuple[str, str]:
    """(letters, nodes that they lead to): the least letters of cheapest repairs from ``node`` through a segment.

    ``ahead`` and ``behind``: forward costs before the first and backward costs
    behind the last row.
    """
    fore, back = array("q"), array("q")
    end = _within(_through(codes, ahead, True, fore), True) if last else _through(codes, ahead, True, fore)
    fore.extend(end)
    _through(codes, behind, False, back)
    back.reverse()
    back.extend(behind)
    frontier, layer, letters, nodes = {node}, 0, [], []
    while layer < len(codes) or last and not any(q in (0, 3) and fore[4 * layer + q] == total for q in frontier):
        arcs = ARCS[codes[layer]] if layer < len(codes) else _LAST
        tight = [(a, step, to) for q in frontier for a, step, to, cost in arcs[q] if fore[4 * layer + q] + cost + back[4 * (layer + step) + to] == total]
        least, step, _ = min(tight)
        frontier = {to for a, _, to in tight if a == least}
        letters.append(least)
        nodes.append(str(min(frontier)))  # from one node a letter leads to one node, so there is no other
        layer += step
    return "".join(letters), "".join(nodes)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations with faults by crc32 of ``conversation:turn``: one in twenty each dropped, emptied, without ends, repeated, or of role user."""
    told = F.concat(*(x if i == 1 else F.coalesce(rows[x].cast("string"), F.lit(" ")) for i, x in enumerate((conv_col, F.lit(":"), turn_col))))
    kind = F.crc32(told.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    hurt = rows.where(kind != 0).select(conv_col, turn_col, F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return hurt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_copy", "_times")


def _sorted_rows(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """conv, turn, role, text, digest, code and ``_at`` of the rows, in ranges."""
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    own = rows.select(rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))
    initial = F.substr("role", F.lit(1), F.lit(1))
    code = F.lit(3)
    for i, c in enumerate(_INITIALS):
        code = F.when(initial == c, i).otherwise(code)
    bare = F.regexp_replace("text", f"{SPACE}+$", "")
    code += F.when(bare == "", _BLANK).when(~F.right(bare, F.lit(1)).isin(*ENDS), _CUT).otherwise(0)
    return range_sorted(own.withColumn("code", code.cast("long")), [F.col("conv"), F.col("turn"), F.col("role"), F.col("digest")])


def _segments(placed: DataFrame) -> DataFrame:
    """(conv, part, codes): codes and places of a segment's rows, a number each; rows seen before are told by a second one."""
    key = F.md5(F.concat(F.col("conv").isNull().cast("string"), F.lit("\0"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.lit("\0"), F.col("role"), F.lit("\0"), F.col("digest")).cast("binary"))
    slim = placed.select("conv", "_at", "code", key.alias("_key"))
    seen = materialise(slim.groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1"))
    copies = join_spread(slim.select("conv", "_at", "_key"), seen, "_key", "_rows", placed.count()).where("_at > _first")
    told = slim.select("conv", "_at", "code").unionByName(copies.select("conv", "_at", F.lit(_COPY).cast("long").alias("code")))
    number = F.col("_at").bitwiseAND(F.lit(_PLACES)) * 32 + F.col("code")
    return told.groupBy("conv", part().alias("part")).agg(F.sort_array(F.collect_list(number)).alias("codes"))


def _rows_of(column: pa.Array):
    """(first place, codes) of each segment of an Arrow column of numbers."""
    for x in column:
        v = x.values.to_numpy(zero_copy_only=False)
        place, code = v >> 5, v & 31
        first = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
        yield int(place[0]), np.bitwise_or.reduceat(code, first).tolist()


_SUMMARY = "first long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, heads long, tails long"


def _summary(first: int, codes: list[int]) -> tuple:
    blank = sum(1 for c in codes if c & _BLANK)
    copy = sum(1 for c in codes if c & _COPY and not c & _BLANK)
    cut = sum(1 for c in codes if c & _CUT and not c & (_COPY | _BLANK))
    bad = sum(_breaks(a, b) for a, b in zip(codes, codes[1:]))
    return first, matrix(codes), blank, copy, cut, bad, codes[0] & 3, codes[-1] & 3


def _breaks(a: int, b: int) -> bool:
    """Whether two neighbours' roles may not follow each other."""
    return (a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1))


_BOUNDS = "part:long,first:long,ahead:array<long>,behind:array<long>,last:boolean"
_WALKS = "array<struct<start:long,letters:string,nodes:string>>"
_CHOSEN = "array<struct<part:long,first:long,letters:string,nodes:string>>"


def _bounds(segments: list[dict]) -> tuple:
    """Sums of a conversation's segments, its least cost, and the costs at their bounds."""
    sums = [sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += sum(_breaks(a["tails"], b["heads"]) for a, b in zip(segments, segments[1:]))
    fore, back = [list(_START)], [ending()]
    for s in segments:
        fore.append([min(fore[-1][q] + s["matrix"][4 * q + to] for q in _NODES) for to in _NODES])
    for s in reversed(segments):
        back.append([min(s["matrix"][4 * q + to] + back[-1][to] for to in _NODES) for q in _NODES])
    back.reverse()
    bounds = [{"part": s["part"], "first": s["first"], "ahead": fore[i], "behind": back[i + 1], "last": i + 1 == len(segments)} for i, s in enumerate(segments)]
    return *sums, back[0][0], bounds


def _walks(codes: list[int], bound: dict, total: int) -> list[dict]:
    """The traversal from each start of a segment that is on a cheapest repair."""
    before = _through(codes, bound["behind"], False)
    out = []
    for q in _NODES:
        if bound["ahead"][q] + before[q] == total:
            letters, nodes = traverse(codes, bound["ahead"], bound["behind"], total, q, bound["last"])
            out.append({"start": q, "letters": letters, "nodes": nodes})
    return out


def _linked(segments: list[dict]) -> tuple[str, list[dict]]:
    """(audit, letters by segment) of the traversals that follow each other from the start."""
    node, chosen = 0, []
    for s in segments:
        walk = next(w for w in s["walks"] if w["start"] == node)
        chosen.append({"part": s["part"], "first": s["first"], "letters": walk["letters"], "nodes": walk["nodes"]})
        node = int(walk["nodes"][-1])
    return "".join(x["letters"] for x in chosen), chosen


def _edits(first: int, letters: str, nodes: str):
    """(edit, new role or None, place or None) of each letter."""
    place = first
    for a, node in zip(letters, nodes):
        role = None if a in "DK" else "user" if node == "2" else "assistant"
        yield a, role, None if a == "I" else place
        place += a != "I"


def _made(rows: DataFrame, made: str, run) -> DataFrame:
    """``conv`` of ``rows``, and the columns that ``run(batch)`` makes of an Arrow batch, one row for one."""
    schema = to_arrow_schema(StructType.fromDDL(made))

    def work(batches):
        for b in batches:
            found = list(run(b))
            columns = [pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([b.column("conv"), *columns], names=["conv", *schema.names])

    return rows.mapInArrow(work, f"conv {_conv_type(rows)}, {made}")


def _conv_type(rows: DataFrame) -> str:
    return rows.schema["conv"].dataType.simpleString()


def _gathered(segments: DataFrame) -> DataFrame:
    """(conv, segments in order): one row for each range that a conversation lies in, at most."""
    rest = [c for c in segments.columns if c not in ("conv", "part")]
    return segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *rest))).alias("segments"))


def _same_conv(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Join on the conversation, null or not, and further keys."""
    found = other.withColumnsRenamed({k: f"_{k}" for k in ("conv", *keys)})
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return rows.join(found, same).drop("_conv", *(f"_{k}" for k in keys))


def _as_rows(linked: DataFrame) -> DataFrame:
    """(conv, part, k, edit, role, at): one row for each letter; ``at`` is null for an inserted turn."""

    def work(batches):
        for b in batches:
            for i, (p, first, letters, nodes) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "first", "letters", "nodes")))):
                found = list(_edits(first, letters, nodes))
                for low in range(0, len(found), 10_000):
                    some = found[low : low + 10_000]
                    at = [None if x[2] is None else (p << 33) + x[2] for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("conv").take(pa.array([i] * len(some))), pa.array([p] * len(some), pa.int64()), pa.array(range(low, low + len(some)), pa.int64()), pa.array([x[0] for x in some]), pa.array([x[1] for x in some], pa.string()), pa.array(at, pa.int64())],
                        names=["conv", "part", "k", "edit", "role", "at"],
                    )

    return linked.mapInArrow(work, f"conv {_conv_type(linked)}, part long, k long, edit string, role string, at long")


@dataclass
class Repaired:
    """What ``repair`` found: one row a conversation that has rows, and the turns of the repaired ones."""

    summary: DataFrame  # conv, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv, part, k (in this order), edit, role, text


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> Repaired:
    placed = _sorted_rows(rows, conv_col, turn_col)
    segments = materialise(_segments(placed))
    sums = _made(segments, f"part long, {_SUMMARY}", lambda b: ((p, *_summary(*x)) for p, x in zip(b.column("part").to_pylist(), _rows_of(b.column("codes")))))
    bounds = materialise(_made(_gathered(sums), f"blank long, duplicate long, truncated long, illegal long, cost long, bounds array<struct<{_BOUNDS}>>", lambda b: map(_bounds, b.column("segments").to_pylist())))
    told = bounds.select("conv", "cost", F.explode("bounds").alias("bound")).withColumn("part", F.col("bound.part"))
    walks = _made(_same_conv(segments, told, "part"), f"part long, first long, walks {_WALKS}", lambda b: ((x["part"], first, _walks(codes, x, total)) for (first, codes), x, total in zip(_rows_of(b.column("codes")), b.column("bound").to_pylist(), b.column("cost").to_pylist())))
    linked = materialise(_made(_gathered(walks), f"audit string, chosen {_CHOSEN}", lambda b: map(_linked, b.column("segments").to_pylist())))
    edits = materialise(_as_rows(linked.select("conv", F.inline("chosen"))))
    own = placed.select(F.col("_at").alias("at"), F.col("role").alias("_role"), "text")
    kept = edits.where("edit in ('K', 'R')").join(own, "at").select("conv", "part", "k", "edit", F.coalesce("role", "_role").alias("role"), "text")
    turns = kept.unionByName(edits.where("edit = 'I'").select("conv", "part", "k", "edit", "role", F.lit("").alias("text")))
    return Repaired(_same_conv(bounds.drop("bounds"), linked.select("conv", "audit")), turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256 of its turns as ``role:text`` lines); conversations are read in order, a turn at a time."""
    ordered = turns.select("conv", "part", "k", F.concat("role", F.lit(":"), "text").cast("binary").alias("line")).repartition("conv").sortWithinPartitions("conv", "part", "k")

    def work(batches):
        digest = conv = kind = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv", "sha256"])
        for b in batches:
            kind = b.column("conv").type
            for now, line in zip(b.column("conv").to_pylist(), b.column("line")):
                if digest is None or now != conv:
                    if digest is not None:
                        yield row()
                    digest, conv = hashlib.sha256(), now
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
        if digest is not None:
            yield row()

    return ordered.mapInArrow(work, f"conv {_conv_type(turns)}, sha256 string")


def gaps(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, gaps): turns missing between the first and the last; 0 without any."""
    t = F.col(turn_col)
    return rows.groupBy(F.col(conv_col).alias("conv")).agg(F.coalesce(F.max(t) - F.min(t) + 1 - F.countDistinct(t), F.lit(0)).cast("long").alias("gaps"))
