"""Queries of the library's operators over the standard tables and over generated lattices, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every() -> dict[str, Query]:
    from latticeflow.queries import documents, evidence, lattice, sites, streams, tables

    return lattice.QUERIES | tables.QUERIES | documents.QUERIES | streams.QUERIES | sites.QUERIES | evidence.QUERIES
