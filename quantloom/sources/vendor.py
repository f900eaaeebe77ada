"""Landed vendor payloads to bars.  Payload text is parsed JVM-side and exploded; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.operators.clean import keep_first

FIELDS = ("open", "high", "low", "close", "volume")


def wide_to_long(wide: DataFrame, ts: str = "ts") -> DataFrame:
    """`TICKER_Field` columns to rows (ts, symbol, lower-case fields)."""
    names = [c for c in wide.columns if c != ts]
    fields = {}
    for c in names:
        ticker, field = c.rsplit("_", 1)
        fields.setdefault(ticker, {})[field.lower().replace(" ", "_")] = c
    order = sorted({f for v in fields.values() for f in v})
    rows = [F.struct(F.lit(t).alias("symbol"),
                     *[(F.col(f"`{v[f]}`") if f in v else F.lit(None)).cast("double").alias(f) for f in order])
            for t, v in fields.items()]
    return wide.select(ts, F.explode(F.array(*rows)).alias("r")).select(ts, "r.*")


def with_provider(df: DataFrame, provider: str) -> DataFrame:
    return df.withColumn("provider", F.lit(provider))


def date_map_bars(payloads: DataFrame, names=FIELDS, between=None) -> DataFrame:
    """(symbol, payload) with payload {date: {field: text}} to bars."""
    m = F.from_json("payload", "map<string,map<string,string>>")
    rows = payloads.select("symbol", F.explode(m).alias("date", "fields")).select(
        "symbol", F.col("date").cast("timestamp_ntz").alias("ts"),
        *[F.col("fields")[n].cast("double").alias(n) for n in names])
    return rows.where(F.col("ts").between(*between)) if between else rows


# Short field names of the record payload.
RECORD_NAMES = {"uOpen": "open", "uHigh": "high", "uLow": "low", "uClose": "close", "uVolume": "volume"}


def record_array_bars(payloads: DataFrame) -> DataFrame:
    """(payload) with {symbol: {chart: [record]}} to bars; adjusted close = close."""
    record = "struct<date:string," + ",".join(f"{n}:double" for n in RECORD_NAMES) + ">"
    m = F.from_json("payload", f"map<string,struct<chart:array<{record}>>>")
    rows = payloads.select(F.explode(m).alias("symbol", "v")).select("symbol", F.explode("v.chart").alias("r"))
    return rows.select("symbol", F.col("r.date").cast("timestamp_ntz").alias("ts"),
                       *[F.col(f"r.{n}").alias(to) for n, to in RECORD_NAMES.items()],
                       F.col("r.uClose").alias("adj_close"))


def column_table_bars(payloads: DataFrame, names=FIELDS) -> DataFrame:
    """(symbol, payload) with {column_names: [...], data: [[...]]} to bars, columns found by name."""
    p = F.from_json("payload", "struct<column_names:array<string>,data:array<array<string>>>")
    rows = payloads.select("symbol", p.alias("p")).select("symbol", "p.column_names", F.explode("p.data").alias("row"))

    def value(n: str) -> Column:
        return F.try_element_at("row", F.array_position("column_names", n).cast("int"))
    return rows.select("symbol", value("date").cast("timestamp_ntz").alias("ts"),
                       *[value(n).cast("double").alias(n) for n in names])


def union_frames(frames) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def by_priority(providers: dict[str, DataFrame], preferred: str | None = None, keys=("symbol", "ts")) -> DataFrame:
    """Row-level failover: the first provider (preferred one first) that has a key supplies its row."""
    names = sorted(providers, key=lambda n: n != preferred) if preferred else list(providers)
    ranked = union_frames([with_provider(providers[n], n).withColumn("_rank", F.lit(i)) for i, n in enumerate(names)])
    return keep_first(ranked, list(keys), ["_rank"]).drop("_rank")


def monthly_factors(df: DataFrame, period: str = "period", columns=()) -> DataFrame:
    """`yyyyMM` rows in percent to dated rows in decimals."""
    return df.select(F.to_date(F.concat(F.col(period), F.lit("01")), "yyyyMMdd").alias("month"),
                     *[(F.col(c) / 100).alias(c) for c in columns])


def resample(bars: DataFrame, rule: str, keys=("symbol",)) -> DataFrame:
    """Calendar buckets: `W` is labelled with its Sunday, `ME` with the month end; empty buckets do not appear."""
    label = {"W": F.date_add(F.to_date(F.date_trunc("week", "ts")), 6), "ME": F.last_day("ts")}[rule]
    return bars.groupBy(*keys, label.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
