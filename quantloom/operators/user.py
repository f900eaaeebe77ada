"""Places where user functions plug in."""

from __future__ import annotations

import pickle
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def map_groups(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    """User function over the rows of one key; the caller vouches that a key is bounded (bars are, by the calendar)."""
    return df.groupBy(key).applyInPandas(f, schema)


def aggregate_function(f):
    """User aggregate over a pandas series, for `groupBy().agg()` on bounded keys."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        return f(x)
    return run


def search_parameters(df: DataFrame, key: str, name: str, values, objective) -> DataFrame:
    """(name, key, score, error) of a Python objective for each parameter value and key; a failure scores minus infinity and says why in `error`.

    Every (value, key) is one task unit, so the search spreads over the cluster.
    """
    runs = df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    kind = dict(df.dtypes)[key]

    def run(ids, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            score, error = float(objective(pdf, ids[0])), None
        except Exception as e:  # noqa: BLE001  (a failing run must not end the search)
            score, error = float("-inf"), f"{type(e).__name__}: {e}"
        return pd.DataFrame({name: [ids[0]], key: [ids[1]], "score": [score], "error": [error]})
    return runs.groupBy(name, key).applyInPandas(run, f"{name} double, {key} {kind}, score double, error string")


class Aggregate:
    """A user aggregate in four steps, so that no task needs all rows of a key.  States must be picklable and stay small; merge must not care for the order of states."""

    def start(self):
        raise NotImplementedError

    def add(self, state, rows: pd.DataFrame):
        """The state with some rows of one key added; returns it."""
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state):
        """The value of a key; None is null."""
        raise NotImplementedError


SHARE = 400                 # rows of a key that are folded together
MOST_STATES = 20_000        # held by a task before it puts them out; a key that comes again starts a new state, which is merged later


def partial_aggregate(df: DataFrame, keys, columns, aggregate: Aggregate, out: str = "value", kind: str = "double", fan: int = 64) -> DataFrame:
    """(keys, out) of a user aggregate over `columns`, one row per key.

    Rows of a key come together in parts of some `SHARE` rows, so that `add` runs once a part and not for every few rows that a batch holds of a key; each part is folded into a state, put
    out as bytes.  States are merged in two levels: by key and `fan` slots of parts, then by key.  A key with a third of all rows is many parts, and no task sees more than its share.  Null
    keys are a key; an empty table gives no rows.
    """
    keys, columns = list(keys), list(columns)
    named = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    kinds = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    work = df.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("_key"), F.monotonically_increasing_id().alias("_id"), *columns)          # one text a key: whole numbers and nulls stay what they are
    many = work.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1))).cast("int")
    work = work.join(many, "_key", "left").select("_key", part.alias("_part"), *columns).repartition("_key", "_part").sortWithinPartitions("_key", "_part")

    def in_frames(pairs, names, value):
        while some := list(islice(pairs, 5000)):
            yield pd.DataFrame([[*key, value(state)] for key, state in some], columns=names, dtype=object)

    def fold(frames):
        def folded():
            states = {}
            for f in frames:
                for key, part in f.groupby(["_key", "_part"], sort=False)[columns]:
                    states[key] = aggregate.add(states[key] if key in states else aggregate.start(), part)
                if len(states) > MOST_STATES:
                    yield from states.items()
                    states = {}
            yield from states.items()
        yield from in_frames((((key, part % fan), state) for (key, part), state in folded()), ["_key", "_slot", "_state"], pickle.dumps)

    def merged(frames):
        """One state for rows that follow each other with the same key (and slot)."""
        now, state = None, None
        for f in frames:
            for *key, raw in f.itertuples(index=False):
                new = pickle.loads(raw)
                if key == now:
                    state = aggregate.merge(state, new)
                    continue
                if now is not None:
                    yield now, state
                now, state = key, new
        if now is not None:
            yield now, state

    def by_slot(frames):
        yield from in_frames(merged(frames), ["_key", "_slot", "_state"], pickle.dumps)

    def by_key(frames):
        yield from in_frames(merged(frames), ["_key", out], aggregate.finish)

    schema = "_key string, _slot int, _state binary"
    level = work.mapInPandas(fold, schema)
    level = level.repartition("_key", "_slot").sortWithinPartitions("_key", "_slot").mapInPandas(by_slot, schema)
    final = level.drop("_slot").repartition("_key").sortWithinPartitions("_key").mapInPandas(by_key, f"_key string, `{out}` {kind}")
    return final.withColumn("_key", F.from_json("_key", kinds)).select(*[F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)], out)
