"""A SQL surface: operator outputs as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routescope.plans.registry import QUERIES
from routescope.sources import adapters as A

TABLES = {
    "paths": A.paths, "updates": A.updates, "prefix2as": A.prefix2as, "asrel": A.asrel, "asprob": A.asprob,
    "aut": A.aut, "org": A.org, "targets": A.targets, "catalogue": A.catalogue, "traffic": A.traffic,
}


def register_tables(spark: SparkSession, folder: str) -> list[str]:
    """The adapter views under their names."""
    for name, build in TABLES.items():
        build(spark, folder).createOrReplaceTempView(name)
    return list(TABLES)


def register_query(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The output of a registered query under the query's name."""
    df = QUERIES[name](spark, folder)
    df.createOrReplaceTempView(name)
    return df
