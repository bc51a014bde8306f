"""A Parquet table that is updated by key: updates are added as files, and only the buckets that they touch are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below path whose writing has ended, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and fs.exists(done(s.getPath(), "_SUCCESS")))


class KeyedTable:
    """Rows by key under path.

    base=<v> holds rows in order of the key's bucket, delta=<v> the last update
    of each key of one put, and where=<v> says in which version each bucket's
    base lies. A version's folders are written before its where, whose
    _SUCCESS file makes it count: a put or compaction that is lost half-way
    leaves the table as it was, and is simply done again. Nothing is rewritten
    in place.

    Null keys are one key. Repeated and tied updates of a put: the greatest
    version stands, of equals the one of greater values as JSON. Columns must
    not be named _bucket, _names, _at or _new.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _versions(self, kind: str) -> list[int]:
        return [int(f.split("=")[1]) for f in complete(self.spark, self.path) if f.startswith(f"{kind}=")]

    def _next(self) -> int:
        return max([-1, *self._versions("base"), *self._versions("delta"), *self._versions("where")]) + 1

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _where(self) -> dict[int, int]:
        """bucket → version of its base; at most `buckets` rows."""
        last = max(self._versions("where"), default=None)
        return {} if last is None else {r.bucket: r.version for r in self.spark.read.parquet(f"{self.path}/where={last:09}").collect()}

    def _write_base(self, df: DataFrame, v: int, kept: dict[int, int], touched: list[int]) -> None:
        df.repartition(len(touched), "_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").parquet(f"{self.path}/base={v:09}")
        now = kept | dict.fromkeys(touched, v)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/where={v:09}")

    def create(self, df: DataFrame) -> None:
        """The first rows; one a key."""
        self._write_base(self._bucketed(df), self._next(), {}, list(range(self.buckets)))

    def put(self, updates: DataFrame, version: str) -> None:
        """The last update of each key; its columns replace the row's, null or not, and columns that it lacks stay."""
        names = [c for c in updates.columns if c not in (self.key, version)]
        new = F.struct(*names)
        last = updates.groupBy(self.key).agg(F.max_by(new, F.struct(F.col(version), F.to_json(new))).alias("_new")).select(self.key, "_new.*")
        self._bucketed(last).withColumn("_names", F.array(*map(F.lit, names)).cast("array<string>")).sortWithinPartitions("_bucket").write.mode("overwrite").parquet(f"{self.path}/delta={self._next():09}")

    def _deltas(self, where: dict[int, int]) -> DataFrame | None:
        """Updates that are later than the base of their bucket."""
        out = None
        for v in self._versions("delta"):  # one term a put since the last compaction
            buckets = [b for b in range(self.buckets) if where.get(b, -1) < v]
            if buckets:
                d = self.spark.read.parquet(f"{self.path}/delta={v:09}").where(F.col("_bucket").isin(buckets)).withColumn("_at", F.lit(v))
                out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        return out

    def _base(self, where: dict[int, int], buckets: set[int]) -> DataFrame | None:
        out = None
        for v in sorted({v for b, v in where.items() if b in buckets}):
            d = self.spark.read.parquet(f"{self.path}/base={v:09}").where(F.col("_bucket").isin([b for b in sorted(buckets) if where.get(b) == v]))
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        return out

    def _merged(self, where: dict[int, int], deltas: DataFrame, touched: set[int]) -> DataFrame:
        """Rows of touched buckets: each column from the last put that has it, in one grouping."""
        base = self._base(where, touched)
        rows = deltas
        if base is not None:
            names = [c for c in base.columns if c not in (self.key, "_bucket")]
            rows = base.withColumns({"_names": F.array(*map(F.lit, names)).cast("array<string>"), "_at": F.lit(-1)}).unionByName(deltas, allowMissingColumns=True)
        names = [c for c in rows.columns if c not in (self.key, "_bucket", "_names", "_at")]
        last = [F.max_by(F.struct(c), F.when(F.array_contains("_names", c), F.col("_at"))).alias(c) for c in names]
        return rows.groupBy("_bucket", self.key).agg(*last).select("_bucket", self.key, *[F.col(c)[c].alias(c) for c in names])

    def _touched(self, deltas: DataFrame) -> set[int]:
        return {r[0] for r in deltas.select("_bucket").distinct().collect()}  # at most `buckets` numbers

    def read(self) -> DataFrame:
        """Rows as they stand; buckets without later updates are read as they lie."""
        where = self._where()
        deltas = self._deltas(where)
        touched = self._touched(deltas) if deltas is not None else set()
        quiet = self._base(where, set(where) - touched)
        if not touched:
            return quiet.drop("_bucket")
        merged = self._merged(where, deltas, touched)
        return (merged if quiet is None else quiet.unionByName(merged, allowMissingColumns=True)).drop("_bucket")

    def compact(self) -> list[int]:
        """Rewrite the buckets that have later updates, and tell which; files of the others stay."""
        where = self._where()
        deltas = self._deltas(where)
        touched = sorted(self._touched(deltas)) if deltas is not None else []
        if touched:
            self._write_base(self._merged(where, deltas, set(touched)), self._next(), where, touched)
        return touched
