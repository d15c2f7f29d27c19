"""Writers of faces, reports and run logs (K1, K3, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_faces(faces: DataFrame, path: str, files: int = 8) -> None:
    """Faces with at least three corners, a folder per patch, level of detail and group; only what is written is replaced.

    A group is written by up to ``files`` tasks, so that a city's patch isn't one task's work.
    """
    part = F.pmod(F.xxhash64("corners"), F.lit(files))
    faces.where(F.size("corners") >= 3).repartition("patch_id", "lod", "grp", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch_id", "lod", "grp").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per patch."""
    report.write.mode("overwrite").partitionBy("patch_id").json(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
