"""The registered queries over the library's own operators, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    WITH m AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
    SELECT target, count(*) AS n_links FROM m GROUP BY target ORDER BY n_links DESC, target LIMIT 10""")
def hubs_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n_links")).orderBy(F.desc("n_links"), "target").limit(10)
