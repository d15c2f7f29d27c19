"""New patch extracts as a stream: each micro-batch replaces the patches it brings (X1) and upserts their airports (R2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terralith.operators import places
from terralith.shared import removed, shared_folder
from terralith.sources.readers import PATCH, read_map_elements

#: The number behind a v, of its own in a path: an extract's version.
VERSION = r".*[/_=]v([0-9]+)(?:[/_.]|$)"
FILES = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "patch_id string, version long, newest boolean, batch long"
REGISTRY = "name string, length_m double, lat double, lon double, source string, version long, patch_id string, batch long"


def process_new_patches(spark: SparkSession, source: str, schema: str | StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Start a query that reads footprint files below ``source`` as they come, applies ``transform``, and overwrites the patches found in ``target``.

    The checkpoint holds which files were done, and a replayed batch overwrites
    the same partitions, so the result is as if each file had been read once.
    """

    def replace(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch_id").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Elements = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass
class Increments:
    """Patches and the airport registry, kept from versioned map extracts that come in any order and any number of times.

    ``buildings`` makes rows with a patch_id from (nodes, ways, relations), ``airports`` rows
    (patch_id, name, length_m, lat, lon, source). Below ``target`` lie

    * ``buildings/patch_id=/version=``: each version of a patch, written once,
    * ``registry/batch=``: the whole registry after a batch,
    * ``ledger/batch=``: which extracts a batch read, and whether each was its patch's newest so far; written
      last, so a batch counts once its ledger rows are there.

    A batch works from what the ledger has of batches before it, never from its own rows. So a batch
    that is replayed after a failure, at whatever point it broke off, writes the same again. Registry entries
    keep the version and patch they come from, and the merge takes the best by (source, version,
    patch, length): it is the same in any order, and reading an extract again changes nothing.
    """

    spark: SparkSession
    target: str
    buildings: Elements
    airports: Elements

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """A table by batches, or nothing before its first."""
        path = f"{self.target}/{name}"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else None

    def ledger(self, before: int | None = None) -> DataFrame:
        found = self._table("ledger", LEDGER)
        found = self.spark.createDataFrame([], LEDGER) if found is None else found
        return found if before is None else found.where(F.col("batch") < before)

    def registry(self, before: int | None = None) -> DataFrame:
        """The registry after the last batch (of those before one)."""
        last = self.ledger(before).agg(F.max("batch")).first()[0]
        found = None if last is None else self._table("registry", REGISTRY)
        return self.spark.createDataFrame([], REGISTRY).drop("batch") if found is None else found.where(F.col("batch") == last).drop("batch")

    def current(self, schema: str | StructType) -> DataFrame:
        """The buildings of each patch's newest version; ``schema`` has their columns with patch_id and version."""
        newest = self.ledger().groupBy("patch_id").agg(F.max("version").alias("version"))
        return self.spark.read.schema(schema).parquet(f"{self.target}/buildings").join(F.broadcast(newest), ["patch_id", "version"], "left_semi")

    def apply(self, files: DataFrame, batch: int) -> None:
        """Take a batch's files (path) in. The list of a batch's paths is all that the driver holds; maxFilesPerTrigger bounds it."""
        extract = files.select("path", F.regexp_extract("path", PATCH, 1).alias("patch_id"), F.regexp_extract("path", VERSION, 1).try_cast("bigint").alias("version")).where("patch_id <> '' AND version IS NOT NULL")
        done = self.ledger(batch)
        unread = extract.join(done.select("patch_id", "version"), ["patch_id", "version"], "left_anti")
        # One copy of an extract serves, were it delivered twice in a batch.
        known = done.groupBy("patch_id").agg(F.max("version").alias("known"))
        best = F.max("version").over(Window.partitionBy("patch_id"))
        chosen = unread.groupBy("patch_id", "version", F.regexp_replace("path", r"[^/]*$", "").alias("folder")).agg(F.collect_list("path").alias("paths"))
        chosen = chosen.groupBy("patch_id", "version").agg(F.min_by("paths", "folder").alias("paths"))
        judged = chosen.join(known, "patch_id", "left").withColumn("newest", (best == F.col("version")) & (F.col("version") > F.coalesce("known", F.lit(-1))))
        plan = judged.select("patch_id", "version", "newest", "paths").collect()
        if not plan:
            return
        # Extracts are parsed once; buildings and airports take what they need from a table. Versions of a patch are kept apart as if they were patches.
        held = shared_folder(self.spark, "elements")

        def kept(every: DataFrame) -> DataFrame:
            every.write.parquet(held)
            return self.spark.read.schema(every.schema).parquet(held)

        own = F.concat_ws("@", F.regexp_extract("path", PATCH, 1), F.regexp_extract("path", VERSION, 1))
        try:
            elements = read_map_elements(self.spark, [p for r in plan for p in r.paths], own, kept)
            if fresh := {r.patch_id: r.version for r in plan if r.newest}:
                self._replace(elements, fresh)
            self._register(elements, batch)
        finally:
            removed(self.spark, held)
        self._commit([(r.patch_id, r.version, r.newest) for r in plan], batch)

    def _replace(self, elements: tuple[DataFrame, ...], versions: dict[str, int]) -> None:
        """Write the patches' new versions; what readers see changes only with the ledger."""
        listed = F.broadcast(self.spark.createDataFrame([(f"{p}@{v}", p, v) for p, v in versions.items()], "own string, patch_id string, version long"))
        newest = (df.withColumnRenamed("patch_id", "own").join(listed, "own").drop("own", "version") for df in elements)
        rows = self.buildings(*newest).join(listed.drop("own"), "patch_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch_id", "version").parquet(f"{self.target}/buildings")

    def _register(self, elements: tuple[DataFrame, ...], batch: int) -> None:
        found = self.airports(*elements).select("name", "length_m", "lat", "lon", "source", F.split_part("patch_id", F.lit("@"), F.lit(2)).cast("bigint").alias("version"), F.split_part("patch_id", F.lit("@"), F.lit(1)).alias("patch_id"))
        places.merged_airports(self.registry(batch), found).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.target}/registry")

    def _commit(self, rows: list[tuple], batch: int) -> None:
        ledger = self.spark.createDataFrame([(*r, batch) for r in rows], LEDGER)
        ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.target}/ledger")

    def stream(self, source: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
        """Start a query that takes in the extracts below ``source`` (any depth) that it hasn't seen, some at once."""
        listed = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(source).select("path")
        return listed.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
