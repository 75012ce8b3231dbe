"""The state that a method makes of each profile, kept between runs and made anew only where the profile's rows have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, by: str = "profile_id") -> DataFrame:
    """(by, fingerprint): a digest of each profile's rows in any order, repeated ones counted; each task hands on one row a profile."""
    columns = sorted(rows.columns)
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(packed), F.xxhash64(packed, F.lit(1))
    total = lambda x: F.sum(x.cast("decimal(20,0)")).cast("string")  # noqa: E731  wide enough for 10 ** 10 rows a profile
    return rows.groupBy(by).agg(F.sha2(F.concat_ws(":", F.lit(",".join(columns)), F.count(F.lit(1)).cast("string"), total(one), total(two)).cast("binary"), 256).alias("fingerprint"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class IngestCache:
    """Parquet tables below ``root``: the states by run, a manifest for each run, and the runs that were committed.

    ``method`` names what makes the states, and its parameters: other ones have
    a cache of their own. A run writes the states of changed profiles, then its
    manifest (which profile has its state from which run), and is committed by
    one small file; what an unfinished run has left is never read, since the
    next one takes another number and its manifest doesn't name it.
    """

    def __init__(self, spark: SparkSession, root: str, method: str, by: str = "profile_id") -> None:
        self.spark, self.by = spark, by
        self.root = f"{root.rstrip('/')}/{method}"

    def _last(self, what: str) -> int:
        df = _read(self.spark, f"{self.root}/{what}")
        return 0 if df is None else df.agg(F.max("run")).first()[0] or 0

    def manifest(self) -> DataFrame | None:
        """(by, fingerprint, run) of the last committed run."""
        last = self._last("commits")
        return self.spark.read.parquet(f"{self.root}/manifests/run={last}").withColumnsRenamed({"made_in": "run"}) if last else None

    def load(self) -> DataFrame | None:
        """The states of the last committed run, with the run that made each; None before the first."""
        manifest = self.manifest()
        if manifest is None:
            return None
        states = self.spark.read.option("basePath", f"{self.root}/states").option("mergeSchema", "true").parquet(f"{self.root}/states")
        return states.join(manifest.select(self.by, F.col("run").cast(states.schema["run"].dataType).alias("run")), [self.by, "run"], "left_semi")

    def ingest(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The states of all profiles of ``rows``, each as ``make`` gives it; profiles whose rows are as in the last run aren't made again.

        ``make`` must give each profile's rows from that profile's rows alone,
        with the column ``by``. Profiles that are gone from ``rows`` are gone
        from the result.
        """
        now, before = fingerprints(rows, self.by), self.manifest()
        run = max(self._last("commits"), self._last("begun")) + 1
        self._mark("begun", run)
        kept = None
        if before is not None:
            kept = before.join(now, [self.by, "fingerprint"], "left_semi")
            changed = now.join(before, [self.by, "fingerprint"], "left_anti")
        else:
            changed = now
        changed.write.mode("overwrite").parquet(f"{self.root}/changed/run={run}")
        changed = self.spark.read.schema(changed.schema).parquet(f"{self.root}/changed/run={run}")
        make(rows.join(changed.select(self.by), self.by, "left_semi")).write.mode("overwrite").parquet(f"{self.root}/states/run={run}")
        made = changed.select(self.by, "fingerprint", F.lit(run).cast("long").alias("made_in"))
        if kept is not None:
            made = made.unionByName(kept.select(self.by, "fingerprint", F.col("run").cast("long").alias("made_in")))
        made.write.mode("overwrite").parquet(f"{self.root}/manifests/run={run}")
        self._mark("commits", run)
        return self.load()

    def _mark(self, what: str, run: int) -> None:
        self.spark.range(1).select(F.lit(run).cast("long").alias("run")).coalesce(1).write.mode("append").parquet(f"{self.root}/{what}")


__all__ = ["IngestCache", "fingerprints"]
