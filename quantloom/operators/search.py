"""Search over kinds of models and their parameters, all candidates scored together.

Candidates are numbers of a grid that is never listed: a number is decoded digit by digit (mixed radix) into a kind and its parameters.  Linear kinds meet the rows
once, as moments of every fold and side: a candidate's coefficients come from the training moments, its error from the test moments, so a thousand penalties cost
no further pass.  Trees see bins only: rows of equal bins are added up once, then trees grow level by level with one aggregate by (variant, fold, node, feature, bin)
for all candidates and folds, and a tree's upper levels are the shallower trees.  What is joined or stored has the size of candidates x folds, or of tree cells.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.linear import dot, solve_symmetric
from quantloom.functions.scalar import div
from quantloom.operators.series import Layers
from quantloom.session import checkpointed

#: Parameters of each kind and what stands in for those that a grid does not name.
KINDS = {"linear": {}, "ridge": {"alpha": 1.0}, "lasso": {"alpha": 1.0}, "elastic_net": {"alpha": 1.0, "l1_ratio": 0.5}, "tree": {"depth": 3, "min_rows": 1, "bins": 16}}
SWEEPS = 200


@dataclass(frozen=True)
class Candidate:
    number: int
    kind: str
    parameters: tuple[tuple[str, float], ...]

    def __getitem__(self, name: str) -> float:
        return dict(self.parameters)[name]

    @property
    def text(self) -> str:
        return ",".join(f"{k}={v:g}" for k, v in sorted(self.parameters))


def grid_size(grid: Mapping[str, Mapping[str, Sequence]]) -> int:
    return sum(prod(len(v) for v in p.values()) for p in grid.values())


def decode(grid: Mapping[str, Mapping[str, Sequence]], number: int) -> Candidate:
    """The candidate of a number: kinds stand one after the other, within a kind the last parameter changes fastest."""
    rest = number
    for kind, parameters in grid.items():
        size = prod(len(v) for v in parameters.values())
        if rest < size:
            chosen = {}
            for name, values in reversed(list(parameters.items())):
                rest, digit = divmod(rest, len(values))
                chosen[name] = values[digit]
            return Candidate(number, kind, tuple(({**KINDS[kind], **chosen}).items()))
        rest -= size
    raise IndexError(f"{number} is beyond the grid")


def candidates(grid: Mapping[str, Mapping[str, Sequence]], n: int | None = None, seed: int = 42) -> list[Candidate]:
    """All candidates of the grid, or n different ones drawn by the seed; all where the grid has no more than n."""
    for kind, parameters in grid.items():
        if kind not in KINDS or set(parameters) - set(KINDS[kind]):
            raise ValueError(f"unknown kind or parameter: {kind} {sorted(parameters)}")
    total = grid_size(grid)
    numbers = range(total) if n is None or n >= total else sorted(random.Random(seed).sample(range(total), n))
    return [decode(grid, k) for k in numbers]


# ---- linear kinds, from moments ------------------------------------------------------------------------------------------
def fold_moments(folds: DataFrame, features: list[str], y: str) -> DataFrame:
    """(fold, and for train and test each: n, means, population variances and covariances); one pass, one row per fold."""
    k = len(features)
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(features)] + [F.covar_pop(x, y).alias(f"q{i}") for i, x in enumerate(features)]
    aggs += [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    m = checkpointed(folds.dropna(subset=[y, *features]).where("side IN ('train', 'test')").groupBy("fold", "side").agg(*aggs))
    names = [c for c in m.columns if c not in ("fold", "side")]
    sides = [m.where(F.col("side") == s).select("fold", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in ("train", "test")]
    return sides[0].join(sides[1], "fold")


def penalised(c: list[list[Column]], q: list[Column], l1: Column, l2: Column) -> Column:
    """Array of slopes that minimise b'Cb / 2 - q'b + l1 |b| + l2 b'b / 2, by coordinate descent."""
    k = len(q)
    cov, rhs = F.array(*[F.array(*row) for row in c]), F.array(*q)
    pull = lambda b, j: F.get(rhs, j) - F.aggregate(F.zip_with(F.get(cov, j), b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v) + F.get(F.get(cov, j), j) * F.get(b, j)
    soft = lambda v: F.signum(v) * F.greatest(F.abs(v) - l1, F.lit(0.0))
    put = lambda b, j: F.transform(b, lambda v, i: F.when(i == j, F.coalesce(div(soft(pull(b, j)), F.get(F.get(cov, j), j) + l2), F.lit(0.0))).otherwise(v))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SWEEPS * k - 1)), F.array(*[F.lit(0.0)] * k), lambda b, t: put(b, (t % k).cast("int")))


def linear_scores(folds: DataFrame, features: list[str], y: str, todo: list[Candidate]) -> DataFrame:
    """(candidate, fold, mse) of the linear kinds."""
    spark, k = folds.sparkSession, len(features)
    rows = [(c.number, c["alpha"] * 1.0 if c.kind == "lasso" else c["alpha"] * c["l1_ratio"] if c.kind == "elastic_net" else 0.0,
             c["alpha"] * (1 - c["l1_ratio"]) if c.kind == "elastic_net" else 0.0, c["alpha"] * 1.0 if c.kind == "ridge" else 0.0) for c in todo]
    asked = spark.createDataFrame(rows, "candidate long, l1 double, l2 double, summed double")
    d = fold_moments(folds, features, y).join(F.broadcast(asked), F.lit(True))               # folds x candidates, as many rows as there are scores
    ly = Layers(d)
    col = lambda side, name: F.col(f"{side}_{name}")
    cov = {s: [[col(s, f"c{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)] for s in ("train", "test")}
    q = {s: [col(s, f"q{i}") for i in range(k)] for s in ("train", "test")}
    l2 = ly.let(F.col("l2") + F.col("summed") / F.col("train_n"))
    direct = solve_symmetric(ly.let, [[ly.let(v + l2) if i == j else v for j, v in enumerate(row)] for i, row in enumerate(cov["train"])], q["train"])
    slow = ly.let(F.when(F.col("l1") > 0, penalised(cov["train"], q["train"], F.col("l1"), l2)))
    beta = [ly.let(F.when(F.col("l1") > 0, F.get(slow, i)).otherwise(direct[i])) for i in range(k)]
    bias = F.col("train_my") - F.col("test_my") + dot(beta, [col("test", f"m{i}") - col("train", f"m{i}") for i in range(k)])
    fitted = dot(beta, [dot(row, beta) for row in cov["test"]])
    mse = F.col("test_vy") - 2 * dot(beta, q["test"]) + fitted + bias * bias
    return ly.frame({"mse": mse}, keep=["candidate", "fold"])


# ---- trees, level by level ------------------------------------------------------------------------------------------------
def tree_scores(folds: DataFrame, features: list[str], y: str, todo: list[Candidate]) -> DataFrame:
    """(candidate, fold, mse) of regression trees over equal-width bins; splits take the largest fall of squared error, ties the first feature and lowest bin."""
    spark = folds.sparkSession
    rows = folds.dropna(subset=[y, *features]).where("side IN ('train', 'test')")
    edges = checkpointed(rows.agg(*[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]))       # one row
    kinds = sorted({(int(c["min_rows"]), int(c["bins"])) for c in todo})
    variants = spark.createDataFrame([(v, m, b) for v, (m, b) in enumerate(kinds)], "variant int, min_rows int, bins int")
    slot = lambda i, c: F.least(F.coalesce(F.floor(div(F.col(c) - F.col(f"lo_{i}"), F.col(f"hi_{i}") - F.col(f"lo_{i}")) * F.col("bins")), F.lit(0)), F.col("bins") - 1)
    placed = rows.join(F.broadcast(edges), F.lit(True)).join(F.broadcast(variants), F.lit(True)).select(
        "variant", "fold", (F.col("side") == "train").alias("train"), F.col(y).cast("double").alias("y"), F.array(*[slot(i, c).cast("int") for i, c in enumerate(features)]).alias("at"))
    base = checkpointed(placed.groupBy("variant", "fold", "train", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
                        .withColumn("node", F.lit(1).cast("long")))                          # the one pass over the rows
    deepest, scores = max(int(c["depth"]) for c in todo), []
    for level in range(deepest + 1):
        long = base.select("variant", "fold", "node", "train", "n", "s", "q", F.posexplode("at").alias("feature", "bin"))
        added = lambda own, c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(("" if own is train else "t") + c)
        train, test = F.col("train"), ~F.col("train")
        cells = checkpointed(long.groupBy("variant", "fold", "node", "feature", "bin").agg(added(train, "n"), added(train, "s"), added(test, "n"), added(test, "s"), added(test, "q")))
        nodes = cells.where("feature = 0").groupBy("variant", "fold", "node").agg(*[F.sum(c).alias(c) for c in ("n", "s", "tn", "ts", "tq")])
        mean = div(F.col("s"), F.col("n"))
        error = F.sum(F.col("tq") - 2 * mean * F.col("ts") + mean * mean * F.col("tn"))
        scores.append(nodes.groupBy("variant", "fold").agg(div(error, F.sum("tn")).alias("mse")).withColumn("depth", F.lit(level)))
        if level == deepest:
            break
        splits = checkpointed(best_splits(cells, variants))
        base = base.join(splits, ["variant", "fold", "node"], "left").select(
            "variant", "fold", "train", "n", "s", "q", "at",
            F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.get("at", "feature") > F.col("edge")).cast("long")).alias("node"))
    all_scores = reduce(DataFrame.unionByName, scores)
    asked = spark.createDataFrame([(c.number, kinds.index((int(c["min_rows"]), int(c["bins"]))), int(c["depth"])) for c in todo], "candidate long, variant int, depth int")
    return asked.join(all_scores, ["variant", "depth"]).select("candidate", "fold", "mse")


def best_splits(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant, fold, node, feature, edge) of the nodes that can be split: left are the bins up to `edge`."""
    by = ["variant", "fold", "node", "feature"]
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    c = cells.select(*by, "bin", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    c = c.join(F.broadcast(variants), "variant")
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    c = c.where((F.col("nl") >= F.col("min_rows")) & (nr >= F.col("min_rows")) & (nr > 0) & (F.col("nl") > 0))
    gain = F.round(F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("s") * F.col("s") / F.col("n"), 12)       # sums in another order may not decide a tie
    c = c.withColumn("gain", gain).where("gain > 0")
    return c.groupBy("variant", "fold", "node").agg(F.max(F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best")).select(
        "variant", "fold", "node", (-F.col("best.col2")).alias("feature"), (-F.col("best.col3")).alias("edge"))


# ---- the search -----------------------------------------------------------------------------------------------------------
def model_search(folds: DataFrame, features: list[str], y: str, todo: list[Candidate]) -> DataFrame:
    """(candidate, kind, parameters, mse, deviation, folds, place): mean and population deviation of the test error over the folds, best first by `place`.

    `folds` holds rows with `fold` and `side` (train, test), as the fold operators make them.  Rows with a null feature or target are left out, as are folds without rows on
    either side or without a unique fit; a candidate that no fold can score is not returned.  Errors that agree to 12 digits are placed by the candidate's number.
    """
    linear, trees = [c for c in todo if c.kind != "tree"], [c for c in todo if c.kind == "tree"]
    parts = [f(folds, features, y, some) for f, some in ((linear_scores, linear), (tree_scores, trees)) if some]
    if not parts:
        raise ValueError("no candidates")
    scores = reduce(DataFrame.unionByName, parts).where("mse IS NOT NULL AND NOT isnan(mse)")
    a = scores.groupBy("candidate").agg(F.avg("mse").alias("mse"), F.stddev_pop("mse").alias("deviation"), F.count(F.lit(1)).alias("folds"))
    names = folds.sparkSession.createDataFrame([(c.number, c.kind, c.text) for c in todo], "candidate long, kind string, parameters string")
    best = Window.partitionBy(F.lit(0)).orderBy(F.round("mse", 12), "candidate")       # one row per candidate
    return names.join(a, "candidate").select("candidate", "kind", "parameters", "mse", "deviation", "folds", F.row_number().over(best).alias("place"))
