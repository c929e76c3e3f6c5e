"""Mix of sources by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Raking scales the cells
until their sums along each dimension meet the target shares.  No cell can give
more than it has: its weight is cut at its own tokens in every step of the
raking, so the others make up for it and the targets still hold.  What a cell
gives over what it has is the probability with which each of its documents is
sampled.

The token budget is ``share`` of all tokens and is held; the goals give way.
1. No goal may ask of a value more than it has: goals are cut there, and what
   is cut goes to the others in proportion.
2. Documents of more than a 2000th of all tokens, of which there are fewer than
   2000, are decided first, in the order of their hash: one is kept if its hash
   is below ``share`` and none of its goals is exceeded.  The rest of each goal
   is left to the others, so one long text does not swing a share.
3. Where the dimensions contradict each other, all goals move together towards
   the table's own shares, by the least of sixteen steps at which raking settles
   (at the last one every document has the same probability).
``report`` tells the targets after this, the expected and the drawn share of
every value.  ``calibrate`` alone does the other thing: it holds the targets and
finds the largest budget.

Up to ``max_cells`` cells are raked on the driver, more as a table by Spark with
group sums for each dimension; the budget and the steps are the same.  Sampling
compares a hash of the id with the probability, so a rerun, or a lost executor,
gives the same documents.

Defined cases: a null source or language, or a text without words, counts as
``(none)``; a null or empty text has no tokens and the probability of its cell;
targets naming no cell are left out and the rest scaled to 1; a cell of a value
without target gets 0; null ids share one draw; repeated rows share theirs; an
empty table gives an empty result; other columns are kept, whatever their
names; bytes that are not UTF-8 part no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm import topics
from medialake.llm.common import join_spread, materialise, release, written

NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-4
Cells = dict[tuple, float]
Shares = list[dict[str, float]]


# --- raking -----------------------------------------------------------------
def tempered(cells: Cells, dims: int, power: float) -> Shares:
    """Target shares along each dimension: own shares to ``power``, scaled to 1."""
    out = []
    for d in range(dims):
        sums: dict[str, float] = {}
        for key, mass in sorted(cells.items()):
            sums[key[d]] = sums.get(key[d], 0.0) + mass
        raised = {v: s**power if s > 0 else 0.0 for v, s in sums.items()}
        total = sum(raised.values()) or 1.0
        out.append({v: r / total for v, r in raised.items()})
    return out


class _Grid:
    """Cells as arrays: mass, and for each dimension the value's number and the goals."""

    def __init__(self, cells: Cells, targets: Shares):
        self.keys = sorted(cells)
        self.mass = np.array([cells[k] for k in self.keys], dtype=float)
        self.at, self.own, self.values = [], [], []
        goals = []
        for d, target in enumerate(targets):
            values = sorted({k[d] for k in self.keys})
            number = {v: i for i, v in enumerate(values)}
            self.at.append(np.array([number[k[d]] for k in self.keys], dtype=np.int64))
            self.own.append(np.bincount(self.at[-1], weights=self.mass, minlength=len(values)))
            self.values.append(values)
            goal = np.where(self.own[-1] > 0, [target.get(v, 0.0) for v in values], 0.0)
            goals.append(goal / goal.sum() if goal.sum() else goal)
        self.goals = goals

    def bound(self, goals) -> float:
        """No budget above this can be met: a value would have to give more than it has."""
        return min([float((own[g > 0] / g[g > 0]).min()) for own, g in zip(self.own, goals) if (g > 0).any()], default=0.0)

    def rake(self, goals, budget: float, rounds: int = 300, tolerance: float = TOLERANCE) -> np.ndarray | None:
        """Probability of each cell at which the sums along each dimension are ``budget`` times the goals; None if they do not settle."""
        p = np.full(len(self.mass), min(1.0, budget / max(self.mass.sum(), 1e-300)))
        weight = p.copy()  # before the cut at 1
        for _ in range(rounds):
            for at, goal in zip(self.at, goals):
                sums = np.bincount(at, weights=self.mass * np.minimum(1, weight), minlength=len(goal))
                weight *= np.divide(budget * goal, sums, out=np.zeros_like(goal), where=sums > 0)[at]
                np.minimum(weight, 1e200, out=weight)
            p = np.minimum(1, weight)
            worst = max(float(np.abs(np.bincount(at, weights=self.mass * p, minlength=len(g)) / budget - g).max()) for at, g in zip(self.at, goals))
            if worst < tolerance:
                return p
        return None


def calibrate(cells: Cells, targets: Shares, budget: float, trials: int = 12) -> tuple[Cells, Shares]:
    """(probability of each cell, targets they meet): see the module's head."""
    g = _Grid(cells, targets)
    if not g.mass.sum() or not all(goal.sum() for goal in g.goals):
        return dict.fromkeys(g.keys, 0.0), [dict.fromkeys(v, 0.0) for v in g.values]
    own = [o / o.sum() for o in g.own]

    def mixed(r):
        return [(1 - r) * goal + r * o for goal, o in zip(g.goals, own)]

    def largest(goals):
        high = min(budget, g.bound(goals))
        if (p := g.rake(goals, high)) is not None:
            return p
        low, best = high, None
        for _ in range(trials):
            low /= 2
            if (best := g.rake(goals, low)) is not None:
                break
        for _ in range(trials if best is not None else 0):
            mid = (low + high) / 2
            found = g.rake(goals, mid)
            low, high, best = (mid, high, found) if found is not None else (low, mid, best)
        return best

    goals, p = g.goals, largest(g.goals)
    if p is None:  # the dimensions contradict each other
        low, high = 0.0, 1.0
        goals, p = own, np.full(len(g.mass), min(1.0, budget / g.mass.sum()))
        for _ in range(trials):
            mid = (low + high) / 2
            found = largest(mixed(mid))
            low, high = (low, mid) if found is not None else (mid, high)
            goals, p = (mixed(mid), found) if found is not None else (goals, p)
    p = np.where(g.mass > 0, p, p[(g.mass > 0) & (p > 0)].min(initial=1.0))
    return dict(zip(g.keys, p.tolist())), [dict(zip(v, goal.tolist())) for v, goal in zip(g.values, goals)]


def filled(goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``goal`` (shares) cut at ``most``, what is cut given to the others in proportion; sums to 1, or to all of ``most``."""
    out, free = np.minimum(goal, most), goal > 0
    for _ in range(len(goal) + 1):
        free &= out < most
        left = 1 - out.sum()
        if left < 1e-12 or not free.any():
            break
        out[free] += left * goal[free] / goal[free].sum()
        out = np.minimum(out, most)
    return out


_ROOM = 0.98  # of what a value has may be asked of it, so that raking settles
_STEPS = 16


def least_pull(rake, steps: int = _STEPS):
    """(result, step) of the least step from 0 (the goals) to ``steps`` (the own shares) at which ``rake`` gives a result; the last is taken to give one."""
    low, high, best = -1, steps, None
    while high - low > 1:
        mid = max(0, (low + high) // 2) if low >= 0 else 0 if best is None and high == steps else (low + high) // 2
        found = rake(mid / steps)
        low, high, best = (low, mid, found) if found is not None else (mid, high, best)
    return (best, high) if best is not None else (rake(1.0), steps)


def decide_large(large: list[tuple], goals: list[dict], budget: float, share: float) -> tuple[dict[tuple, bool], list[dict]]:
    """(decision by key, tokens kept by value): large documents in the order of their draw.

    ``large``: (draw, cell, tokens, copies); copies share a decision.
    """
    kept, sums = {}, [{} for _ in goals]
    for draw_, cell, tokens, copies in sorted(large):
        size = tokens * copies
        ok = draw_ < share and all(s.get(v, 0.0) + size <= budget * g.get(v, 0.0) for s, g, v in zip(sums, goals, cell))
        kept[draw_, cell, tokens] = ok
        if ok:
            for s, v in zip(sums, cell):
                s[v] = s.get(v, 0.0) + size
    return kept, sums


def calibrate_held(cells: Cells, targets: Shares, share: float, large: list[tuple] = ()) -> tuple[Cells, Shares, dict[tuple, bool]]:
    """(probability of each cell's other documents, shares that are met, decisions on large ones) at a budget of ``share``.

    ``cells`` holds the tokens of all documents, the large ones too.
    """
    g = _Grid(cells, targets)
    nothing = dict.fromkeys(g.keys, 0.0), [dict.fromkeys(v, 0.0) for v in g.values], {(d, c, t): False for d, c, t, _ in large}
    allowed = np.logical_and.reduce([goal[at] > 0 for goal, at in zip(g.goals, g.at)]) if g.keys else np.zeros(0, bool)
    total = float(g.mass[allowed].sum())
    if not total:
        return nothing
    sums = lambda mass: [np.bincount(at, weights=mass, minlength=len(v)) for at, v in zip(g.at, g.values)]
    budget = share * total
    goals = [filled(np.where(own > 0, goal, 0.0), _ROOM * own / budget) for goal, own in zip(g.goals, sums(np.where(allowed, g.mass, 0.0)))]
    kept, taken = decide_large(large, [dict(zip(v, goal.tolist())) for v, goal in zip(g.values, goals)], budget, share)
    number = {k: i for i, k in enumerate(g.keys)}
    mass = np.where(allowed, g.mass, 0.0)
    for _, cell, tokens, copies in large:
        if allowed[number[cell]]:
            mass[number[cell]] -= tokens * copies
    mass = np.maximum(mass, 0.0)
    done = [np.array([t.get(v, 0.0) for v in values]) for t, values in zip(taken, g.values)]
    rest, have = max(0.0, min(budget - done[0].sum(), _ROOM * mass.sum())), sums(mass)
    if not rest:
        return dict.fromkeys(g.keys, 0.0), [dict(zip(v, (d / max(d.sum(), 1e-300)).tolist())) for v, d in zip(g.values, done)], kept
    own = [h / mass.sum() for h in have]
    wanted = [filled(x / x.sum() if (x := np.where(h > 0, np.maximum(budget * goal - d, 0.0), 0.0)).sum() else o, _ROOM * h / rest) for goal, d, h, o in zip(goals, done, have, own)]
    wanted = [w / w.sum() for w in wanted]
    small = _Grid.__new__(_Grid)
    small.mass, small.at = mass, g.at
    mixed = lambda r: [(1 - r) * w + r * o for w, o in zip(wanted, own)]
    p, step = least_pull(lambda r: small.rake(mixed(r), rest) if r < 1 else np.full(len(mass), rest / mass.sum()))
    p = np.where(allowed, p, 0.0)
    met = [(d + rest * w) / (d.sum() + rest) for d, w in zip(done, mixed(step / _STEPS))]
    return dict(zip(g.keys, p.tolist())), [dict(zip(v, m.tolist())) for v, m in zip(g.values, met)], kept


def rake_table(cells: DataFrame, targets: list[DataFrame], budget: float, rounds: int = 40, tolerance: float = 1e-3) -> DataFrame | None:
    """``cells`` (d0, ..., tokens, rows) with p, raked by Spark; None if the sums do not settle.

    ``targets`` has one table (value, goal) a dimension.  Each round is written.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.lit(budget / total))
    given = F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight")))
    for _ in range(rounds):
        for d, goal in enumerate(targets):
            sums = now.groupBy(f"d{d}").agg(given.alias("sum"))
            factors = sums.join(goal, sums[f"d{d}"] == goal["value"], "left").select(f"d{d}", F.when(F.col("sum") > 0, F.coalesce("goal", F.lit(0.0)) * budget / F.col("sum")).otherwise(1.0).alias("factor"))
            now = now.join(factors, f"d{d}").withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.lit(1e200))).drop("factor")
        now = materialise(now.select(*cells.columns, "weight"))
        worst = 0.0
        for d, goal in enumerate(targets):
            sums = now.groupBy(f"d{d}").agg(given.alias("sum"))
            both = sums.join(goal, sums[f"d{d}"] == goal["value"], "left")
            worst = max(worst, both.agg(F.max(F.abs(F.col("sum") / budget - F.coalesce("goal", F.lit(0.0))))).first()[0] or 0.0)
        if worst < tolerance:
            return now.withColumn("p", F.least(F.lit(1.0), "weight")).drop("weight")
    return None


# --- documents --------------------------------------------------------------
def counted(docs: DataFrame, text_col: str = "text", dims=DIMENSIONS, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, or all), those dimensions that ``docs`` has as d0, d1, ..., tokens, and vec (what the text's topic is found from)."""

    @F.arrow_udf("tokens long, vec binary")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            tokens, vectors = topics.counted(b.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(vectors, pa.binary())], names=["tokens", "vec"])

    own = [docs[d].cast("string").alias(f"d{i}") for i, d in enumerate(dims) if d in docs.columns]
    found = docs.select(F.struct(*(docs[c] for c in keep or docs.columns)).alias("row"), *own, read(docs[text_col].cast("binary")).alias("x"))
    return found.select(*found.columns[:-1], "x.tokens", "x.vec")


def placed(found: DataFrame, model: topics.Model | None, dims=DIMENSIONS) -> DataFrame:
    """A ``counted`` table with all dimensions, and without vec."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def topic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            own = iter(shared.value.nearest(b.drop_null().to_pylist()) if shared.value else [])
            yield pa.array([f"topic{next(own)}" if shared.value and some else None for some in b.is_valid().to_pylist()], pa.string())

    values = [F.coalesce(F.col(f"d{i}") if f"d{i}" in found.columns else topic("vec"), F.lit(NONE)).alias(f"d{i}") for i, _ in enumerate(dims)]
    return found.select("row", *values, "tokens")


def described(docs: DataFrame, model: topics.Model | None, text_col: str = "text", dims=DIMENSIONS, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, or all), the dimensions as d0, d1, ..., and tokens.

    ``topic`` is found from the text, unless ``docs`` has a column of that name.
    """
    return placed(counted(docs, text_col, dims, keep), model, dims)


def described_by_all(docs: DataFrame, text_col: str = "text", dims=DIMENSIONS, keep: list[str] | None = None, topic_count: int = 8) -> DataFrame:
    """``described``, written, by topics that are learned from all rows of ``docs``; texts are read once.

    What this writes on the way is removed, so the rows are left there once.
    """
    before = written()
    found = materialise(counted(docs, text_col, dims, keep))
    out = materialise(placed(found, topics.learn(found.select("vec").where("vec is not null"), topic_count), dims))
    release(docs.sparkSession, before, newest=1)
    return out


@dataclass
class Plan:
    """``cells``: d0, ..., tokens, rows, p; ``targets`` that they meet: a list of shares, or of tables (value, goal).

    ``large``: decisions on large documents, (draw, d0, ..., size, decided), fewer than ``_PARTS``.
    """

    cells: DataFrame
    targets: list
    small: bool
    rows: int
    large: DataFrame | None = None


#: A document with more than one of so many parts of all tokens is large.
_PARTS = 2000


def _cell_sums(placed: DataFrame, dims: int) -> DataFrame:
    return placed.groupBy(*(f"d{i}" for i in range(dims))).agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("rows"))


def _large(placed: DataFrame, total: float, dims: int, id_col: str) -> list[tuple]:
    """(draw, cell, tokens, copies) of the documents that are large; fewer than ``_PARTS``, as each has more than that part of all tokens."""
    names = [f"d{i}" for i in range(dims)]
    found = placed.where(F.col("tokens") * _PARTS > total).groupBy(draw(F.col("row")[id_col]).alias("draw"), *names, "tokens").count().collect()
    return [(r.draw, tuple(r[n] for n in names), r.tokens, r["count"]) for r in found]


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def _told(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the driver, sent as Arrow, so that no task starts Python to read them."""
    if not rows:
        return spark.createDataFrame(rows, schema)
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], names=list(names)))


def _decisions(spark, kept: dict[tuple, bool], dims: int) -> DataFrame | None:
    schema = "draw double, " + ", ".join(f"d{i} string" for i in range(dims)) + ", size long, decided double"
    return _told(spark, [(d, *cell, t, float(ok)) for (d, cell, t), ok in kept.items()], schema) if kept else None


def plan(placed: DataFrame, targets: Shares | None = None, share: float = 0.7, power: float = 0.7, dims: int = len(DIMENSIONS), max_cells: int = 200_000, id_col: str = "doc_id") -> Plan:
    """Probability of each cell of a ``described`` table at a budget of ``share``; without ``targets`` the own shares, tempered by ``power``, are the goal."""
    sums = materialise(_cell_sums(placed, dims))
    n, rows, total = sums.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0.0))).first()
    spark = placed.sparkSession
    large = _large(placed, total, dims, id_col)
    if n > max_cells:
        return _plan_table(sums, targets, share, power, dims, rows, large)
    found = sums.collect()
    cells = {tuple(r[:dims]): float(r.tokens or 0) for r in found}
    p, met, kept = calibrate_held(cells, targets or tempered(cells, dims, power), share, large)
    schema = ", ".join(f"d{i} string" for i in range(dims)) + ", tokens double, rows long, p double"
    return Plan(_told(spark, [(*r, p[tuple(r[:dims])]) for r in found], schema), met, True, rows, _decisions(spark, kept, dims))


def filled_table(goals: DataFrame) -> DataFrame:
    """``filled`` for a table (value, goal, most, ...): goal becomes the least of most and a multiple of itself that lets all sum to 1."""
    low, high = 0.0, 1e6
    for _ in range(4):  # the multiple to one part in 10^7 of the range
        tries = [low + (high - low) * i / 64 for i in range(65)] if low else [0.0, *np.geomspace(1e-3, high, 64).tolist()]
        sums = goals.agg(*(F.sum(F.least(F.col("most"), F.col("goal") * t)) for t in tries)).first()
        at = next((i for i, x in enumerate(sums) if (x or 0.0) >= 1), len(tries) - 1)
        low, high = tries[max(0, at - 1)], tries[at]
    return goals.withColumn("goal", F.least(F.col("most"), F.col("goal") * high))


def _plan_table(sums: DataFrame, targets, share: float, power: float, dims: int, rows: int, large: list[tuple]) -> Plan:
    """``plan`` for cells that are too many for the driver, by the same steps."""
    spark, names, raised = sums.sparkSession, [f"d{d}" for d in range(dims)], []
    told = lambda pairs, column: spark.createDataFrame(list(pairs), f"value string, {column} double")
    for d in range(dims):
        own = sums.groupBy(F.col(f"d{d}").alias("value")).agg(F.sum("tokens").alias("own")).where("own > 0")
        goal = own.join(told(targets[d].items(), "goal"), "value") if targets else own.withColumn("goal", F.pow("own", F.lit(power)))
        raised.append(materialise(goal.where("goal > 0").select("value", "goal")))
    allowed = sums
    for d, goal in enumerate(raised):
        allowed = allowed.join(goal.select(F.col("value").alias(f"d{d}")), f"d{d}", "left_semi")
    allowed = materialise(allowed)
    total = allowed.agg(F.sum("tokens")).first()[0] or 0.0
    if not total:
        return Plan(sums.withColumn("p", F.lit(0.0)), [g.select("value", F.lit(0.0).alias("goal")) for g in raised], False, rows, _decisions(spark, {(d, c, t): False for d, c, t, _ in large}, dims))
    budget = share * total

    def cut(goals: DataFrame, own: DataFrame, part: float) -> DataFrame:
        whole = goals.agg(F.sum("goal")).first()[0] or 1.0
        return filled_table(goals.withColumn("goal", F.col("goal") / whole).join(own, "value").withColumn("most", F.col("own") * _ROOM / part))

    by = lambda cells, d: cells.groupBy(F.col(f"d{d}").alias("value")).agg(F.sum("tokens").alias("own"))
    goals = [materialise(cut(g, by(allowed, d), budget)) for d, g in enumerate(raised)]
    few = lambda d: told([(v, 0.0) for v in sorted({c[d] for _, c, _, _ in large})], "_")
    known = [{r.value: r.goal for r in goals[d].join(few(d), "value").collect()} for d in range(dims)] if large else [{}] * dims
    kept, taken = decide_large(large, known, budget, share)
    less: dict[tuple, float] = {}
    for _, cell, tokens, copies in large:
        less[cell] = less.get(cell, 0.0) + tokens * copies
    gone = spark.createDataFrame([(*c, x) for c, x in less.items()], ", ".join(f"{n} string" for n in names) + ", less double")
    others = materialise(allowed.join(gone, names, "left").withColumn("tokens", F.greatest(F.lit(0.0), F.col("tokens") - F.coalesce("less", F.lit(0.0)))).select(*names, "tokens", "rows"))
    mass, spent = others.agg(F.sum("tokens")).first()[0], sum(taken[0].values())
    rest = max(0.0, min(budget - spent, _ROOM * mass))
    wanted = []
    for d, g in enumerate(goals):
        left = g.select("value", "goal").join(told(taken[d].items(), "taken"), "value", "left").select("value", F.greatest(F.lit(0.0), F.col("goal") * budget - F.coalesce("taken", F.lit(0.0))).alias("goal"), F.coalesce("taken", F.lit(0.0)).alias("taken"))
        wanted.append(materialise(cut(left, by(others, d), rest or 1.0).withColumn("own", F.col("own") / (mass or 1.0))))
    mixed = lambda r: [w.select("value", ((1 - r) * F.col("goal") + r * F.col("own")).alias("goal")) for w in wanted]
    same = lambda: others.withColumn("p", F.lit(rest / mass if mass else 0.0))
    p, step = least_pull(lambda r: rake_table(others, mixed(r), rest) if r < 1 else same()) if rest else (same(), _STEPS)
    r = step / _STEPS
    met = [w.select("value", ((F.col("taken") + rest * ((1 - r) * F.col("goal") + r * F.col("own"))) / max(spent + rest, 1e-300)).alias("goal")) for w in wanted]
    cells = sums.join(p.select(*names, "p"), names, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return Plan(materialise(cells), met, False, rows, _decisions(spark, kept, dims))


def draw(id_col: Column, seed: int = 11) -> Column:
    """Uniform in [0, 1), a function of the id."""
    return F.pmod(F.xxhash64(id_col.cast("string"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def calibrated(placed: DataFrame, plan: Plan, id_col: str = "doc_id") -> DataFrame:
    """A ``described`` table with p (probability; 0 or 1 for the large documents, which are decided) and kept.

    Up to ``max_cells`` cells are broadcast, and the decisions, fewer than 2000; of more only those that hold a great part of the rows.
    """
    names = [c for c in plan.cells.columns if c.startswith("d")]
    if plan.small:
        found = placed.join(F.broadcast(plan.cells.select(*names, "p")), names)
    else:
        keyed = placed.withColumn("cell", F.struct(*names))
        found = join_spread(keyed, plan.cells.select(F.struct(*names).alias("cell"), "rows", "p"), "cell", "rows", plan.rows).drop("cell", "rows")
    if plan.large is not None:
        own = draw(F.col("row")[id_col]) == F.col("draw")
        for n in names:
            own &= F.col(n) == F.col(f"_{n}")
        decided = F.broadcast(plan.large.withColumnsRenamed({n: f"_{n}" for n in names}))
        columns = found.columns
        found = found.join(decided, own & (F.col("tokens") == F.col("size")), "left").withColumn("p", F.coalesce("decided", "p")).select(*columns)
    return found.withColumn("kept", draw(F.col("row")[id_col]) < F.col("p"))


def report(placed: DataFrame, plan: Plan) -> DataFrame:
    """(dimension, value, target, expected, drawn): shares of tokens in a ``calibrated`` table."""
    names = [c for c in plan.cells.columns if c.startswith("d")]
    spark, parts = placed.sparkSession, None
    for d, name in enumerate(names):
        goal = plan.targets[d]
        goal = spark.createDataFrame(list(goal.items()) or [], "value string, target double") if isinstance(goal, dict) else goal.select("value", F.col("goal").alias("target"))
        sums = placed.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("tokens") * F.col("p")).alias("e"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("k"))
        all_e, all_k = (x or 1 for x in sums.agg(F.sum("e"), F.sum("k")).first())
        part = sums.join(goal, "value", "left").select(F.lit(d).alias("dimension"), "value", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("e") / all_e).alias("expected"), (F.col("k") / all_k).alias("drawn"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims=DIMENSIONS, topic_count: int = 8, **kw) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns.

    Texts are read once: the rows are written with their dimensions and tokens.
    """
    found = described_by_all(docs, text_col, dims, topic_count=topic_count)
    return calibrated(found, plan(found, dims=len(dims), id_col=id_col, **kw), id_col).where("kept").select("row.*")
