"""Tables written once to the shared folder and read back by every operator.

Several branches of one plan, and many plans, read the same updates and the same
reference data. Writing them once as Parquet spares each branch the derivation, gives
the planner true sizes for its join choices, and lets filters and column choices reach
the files. The folder is the one the cluster names in ``spark.checkpoint.dir``, so the
loss of an executor costs nothing but a re-read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routescope.session import shared_folder

_landed: dict[tuple[str, str, str], str] = {}


def landed_path(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> str:
    """Where the table ``name`` derived from ``folder`` lies; built at its first use in this
    application."""
    app = spark.sparkContext.applicationId
    key = (app, folder, name)
    if key not in _landed:
        tag = hashlib.md5(folder.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark).rstrip('/')}/routescope/{app}/{tag}/{name}"
        build(spark, folder).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        _landed[key] = path
    return _landed[key]


def landed(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    return spark.read.parquet(landed_path(spark, folder, name, build, partition_by))


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/routescope/{app}/{purpose}-{uuid.uuid4().hex[:12]}"


def landed_feed(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame], slices: int, files: int
) -> str:
    """Where a feed lies: the rows of ``build`` by their column ``slice``, written slice after slice in ``files``
    files each, so that a stream that takes so many files a batch sees one slice at a time."""
    app = spark.sparkContext.applicationId
    key = (app, folder, name)
    if key not in _landed:
        tag = hashlib.md5(folder.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark).rstrip('/')}/routescope/{app}/{tag}/{name}"
        rows = build(spark, folder)
        for k in range(slices):
            rows.where(rows["slice"] == k).drop("slice").repartition(files, "seq").write.mode("overwrite" if k == 0 else "append").parquet(path)
        _landed[key] = path
    return _landed[key]


def landed_files(spark: SparkSession, folder: str, name: str, write: Callable[[SparkSession, str, str], object]) -> str:
    """The folder that ``write`` (spark, source folder, folder to fill) filled, at its first use in this application."""
    app = spark.sparkContext.applicationId
    key = (app, folder, name)
    if key not in _landed:
        tag = hashlib.md5(folder.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark).rstrip('/')}/routescope/{app}/{tag}/{name}"
        write(spark, folder, path)
        _landed[key] = path
    return _landed[key]


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table of a ``fresh_folder`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
