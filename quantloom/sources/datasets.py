"""Dataset versions, catalog, audit, lineage and model registry as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quantloom.operators.sets import schema_rows

# Kinds of change.
CHANGE_TYPES = ("CREATE", "UPDATE", "APPEND", "DELETE", "SCHEMA_CHANGE", "METADATA_UPDATE")


def schema_text(df: DataFrame) -> str:
    return ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))


def schema_checksum(df: DataFrame) -> Column:
    return F.md5(F.lit(schema_text(df)))


def content_checksum(df: DataFrame, columns=None, method: str = "xxhash64") -> DataFrame:
    """One row (rows, checksum) that does not depend on row order.

    Row hashes are added as 38-digit decimals, an aggregate combined map-side.
    """
    columns = list(columns or df.columns)
    if method == "xxhash64":
        h = F.xxhash64(*columns).cast("decimal(38,0)")
    else:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
        h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("checksum"))


def describe_dataset(df: DataFrame, dataset_id: str, fmt="parquet", codec="snappy", tags=None) -> DataFrame:
    """One catalog row: rows, columns, schema map, format, codec, checksum, tags."""
    fields = [F.lit(v) for nt in df.dtypes for v in nt]
    tag_items = [F.lit(str(v)) for kv in (tags or {}).items() for v in kv]
    tag_map = F.create_map(*tag_items) if tag_items else F.create_map().cast("map<string,string>")
    return content_checksum(df).select(
        F.lit(dataset_id).alias("dataset_id"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.create_map(*fields).alias("schema"), F.lit(fmt).alias("format"), F.lit(codec).alias("codec"), "checksum",
        tag_map.alias("tags"))


def storage_stats(catalog: DataFrame) -> DataFrame:
    """Counts and bytes in total, by format and by codec; oldest and newest dataset on the total row."""
    return (catalog.groupingSets([[], ["format"], ["codec"]], "format", "codec").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("bytes").alias("bytes"),
        F.min(F.struct("created_at", "dataset_id"))["dataset_id"].alias("oldest"),
        F.max(F.struct("created_at", "dataset_id"))["dataset_id"].alias("newest")))


def expired_datasets(catalog: DataFrame, as_of, days: int) -> DataFrame:
    return catalog.where(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def expired_versions(versions: DataFrame, as_of, keep_versions=10, keep_days=30) -> DataFrame:
    """Versions beyond the newest `keep_versions` of their dataset and older than `keep_days`.

    The newest ones come from a ranking that Spark limits per task before the shuffle; the rest is an anti join.
    """
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("version_number"))
    kept = versions.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep_versions)
    old = expired_datasets(versions, as_of, keep_days)
    return old.join(kept.select("dataset_id", "version_number"), ["dataset_id", "version_number"], "left_anti")


class VersionStore:
    """Versions of a dataset under `root/data/dataset=.../version=...`, described by `root/versions`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.root}/versions") if fs.exists(path) else None

    def latest_number(self, dataset_id: str) -> int:
        known = self.versions()
        if known is None:
            return 0
        return known.where(F.col("dataset_id") == dataset_id).agg(F.coalesce(F.max("version_number"), F.lit(0))).first()[0]

    def write(self, dataset_id: str, df: DataFrame, user: str, change_type: str, created_at: str, tags=(), note=""):
        """Store the rows once, then describe what was stored."""
        if change_type not in CHANGE_TYPES:
            raise ValueError(f"unknown change type {change_type}")
        number = self.latest_number(dataset_id) + 1
        path = f"{self.root}/data/dataset={dataset_id}/version={number}"
        df.write.mode("error").parquet(path)
        stored = self.spark.read.parquet(path)
        row = content_checksum(stored).select(
            F.lit(dataset_id).alias("dataset_id"), F.lit(f"{dataset_id}_v{number}").alias("version_id"),
            F.lit(number).alias("version_number"),
            F.lit(f"{dataset_id}_v{number - 1}" if number > 1 else None).cast("string").alias("parent_id"),
            F.lit(created_at).cast("timestamp_ntz").alias("created_at"), F.lit(user).alias("created_by"),
            F.lit(change_type).alias("change_type"), F.lit(note).alias("note"), F.col("checksum").alias("data_hash"),
            schema_checksum(stored).alias("schema_hash"), F.col("rows").alias("row_count"),
            F.lit(len(stored.columns)).cast("long").alias("column_count"),
            F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        audit_rows = row.select("dataset_id", F.col("created_by").alias("user_id"), F.col("change_type").alias("action"),
                                F.lit("version_store").alias("source"), F.col("created_at").alias("ts"),
                                F.create_map(F.lit("version"), F.col("version_id")).alias("details"))
        audit_rows.coalesce(1).write.mode("append").parquet(f"{self.root}/audit")
        return number

    def read(self, dataset_id: str, number: int | None = None) -> DataFrame:
        number = number or self.latest_number(dataset_id)
        return self.spark.read.parquet(f"{self.root}/data/dataset={dataset_id}/version={number}")

    def list(self, dataset_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return page(self.versions().where(F.col("dataset_id") == dataset_id), [F.desc("version_number")], limit, offset)

    def audit(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/audit")


def page(df: DataFrame, order, limit=None, offset=0) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def audit_trail(audit: DataFrame, dataset_id=None, user_id=None, action=None, start=None, end=None, limit=None,
                offset=0) -> DataFrame:
    """Conjunction of the given filters, newest first, ties by event id."""
    for name, value in (("dataset_id", dataset_id), ("user_id", user_id), ("action", action)):
        if value is not None:
            audit = audit.where(F.col(name) == value)
    if start is not None:
        audit = audit.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        audit = audit.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    ties = [F.desc(c) for c in ("event_id",) if c in audit.columns]
    return page(audit, [F.desc("ts"), *ties], limit, offset)


def version_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts: rows of both versions, added, removed and changed rows, changed cells."""
    common = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_old_{c}") for c in common])
    b = new.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_new_{c}") for c in common])
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    cells = sum((F.when(F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), 0).otherwise(1) for c in common), F.lit(0))
    j = a.join(b, keys, "full_outer").withColumn("_cells", F.when(both, cells).otherwise(0))
    return j.agg(F.count("_a").alias("rows_old"), F.count("_b").alias("rows_new"),
                 F.count_if(F.col("_a").isNull()).alias("added_rows"),
                 F.count_if(F.col("_b").isNull()).alias("removed_rows"),
                 F.count_if(F.col("_cells") > 0).alias("changed_rows"), F.sum("_cells").alias("changed_cells"))


def keyless_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one version holds, from one aggregate over both."""
    cols = old.columns
    both = old.withColumn("_d", F.lit(-1)).unionByName(new.select(*cols).withColumn("_d", F.lit(1)))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("only_new"),
                   F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("only_old"))


def schema_diff(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, old_type, new_type) for added, removed and retyped columns."""
    a = schema_rows(spark, old).withColumnRenamed("type", "old_type")
    b = schema_rows(spark, new).withColumnRenamed("type", "new_type")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .otherwise("changed"))
    return a.join(b, "name", "full_outer").where(~F.col("old_type").eqNullSafe(F.col("new_type"))).select(
        "name", change.alias("change"), "old_type", "new_type")


def lineage_edges(edges: DataFrame) -> DataFrame:
    """Both directions of (upstream, downstream, transformation) as distinct rows (dataset, direction, other).

    Neighbours stay rows: a dataset that feeds very many others is never gathered into one array.
    """
    up = edges.select(F.col("downstream").alias("dataset"), F.lit("upstream").alias("direction"),
                      F.col("upstream").alias("other"), "transformation")
    down = edges.select(F.col("upstream").alias("dataset"), F.lit("downstream").alias("direction"),
                        F.col("downstream").alias("other"), "transformation")
    return up.unionByName(down).distinct()


def registered_models(models: DataFrame, contains: str | None = None, active_only=False) -> DataFrame:
    """Newest version (text order) of each model; keyed rows (name, version, active, metrics...)."""
    if contains is not None:
        models = models.where(F.contains("name", F.lit(contains)))
    if active_only:
        models = models.where("active")
    rest = [c for c in models.columns if c not in ("name", "version")]
    best = models.groupBy("name").agg(F.max(F.struct("version", *rest)).alias("_r"))
    return best.select("name", "_r.*")


def register_model(models: DataFrame, row: DataFrame, overwrite=False) -> DataFrame:
    """Registry with the row added; an existing (name, version) is an error unless it may be replaced."""
    key = ["name", "version"]
    if not overwrite and not models.join(row.select(*key), key, "left_semi").isEmpty():
        raise ValueError("model version exists")
    return models.join(row.select(*key), key, "left_anti").unionByName(row)


def set_active(models: DataFrame, name: str, version: str, active: bool) -> DataFrame:
    hit = (F.col("name") == name) & (F.col("version") == version)
    return models.withColumn("active", F.when(hit, F.lit(active)).otherwise(F.col("active")))
