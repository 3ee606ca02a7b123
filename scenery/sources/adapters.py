"""Scene, pose and rollout tables derived from the driver's tables, for Spark and as SQL.

Each table is written once, in the SQL that Spark and DuckDB share but for how an
array's element is reached; `spark_view` runs it and `sql_view` gives the other form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

At = Callable[[str, int], str]


def _numbers(at: At, count: int = 22) -> str:
    return ", ".join(f"CAST({at('embedding', i)} AS DOUBLE) AS e{i}" for i in range(1, count + 1))


def _objects(at: At) -> str:
    return f"""
    SELECT vec_id % 20 AS scene_id, vec_id AS object_id, concat('l', CAST(label AS STRING)) AS label,
           CAST(floor(vec_id / 20) AS BIGINT) % 5 AS frame_id,
           e1 * 10 AS x, e2 * 10 AS y, e3 * 10 AS z,
           e1 * 10 - abs(e4) AS x0, e2 * 10 - abs(e5) AS y0, e3 * 10 - abs(e6) AS z0,
           e1 * 10 + abs(e4) AS x1, e2 * 10 + abs(e5) AS y1, e3 * 10 + abs(e6) AS z1,
           least(CAST(1.0 AS DOUBLE), abs(e7) * 4) AS visibility,
           e8 * 5 AS cx, e9 * 5 AS cy, e10 * 5 AS cz,
           abs(e11) * 300 AS u0, abs(e12) * 200 AS v0, abs(e11) * 300 + abs(e13) * 300 AS u1, abs(e12) * 200 + abs(e14) * 200 AS v1,
           e15 > 0 AS occluded, e16 > 0 AS truncated
    FROM (SELECT vec_id, label, {_numbers(at)} FROM embeddings) AS numbered"""


def _poses(at: At) -> str:
    return f"""
    SELECT scene_id, vec_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY vec_id) AS INT) AS frame_id, ax, ay, az, tx, ty, tz
    FROM (SELECT vec_id % 20 AS scene_id, vec_id, e17 * 2 AS ax, e18 * 2 AS ay, e19 * 2 AS az, e20 * 5 AS tx, e21 * 5 AS ty, e22 * 5 AS tz
          FROM (SELECT vec_id, label, {_numbers(at)} FROM embeddings) AS numbered) AS posed"""


ROLLOUTS = """
    SELECT l_orderkey AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos,
           l_discount * 10 AS score, CAST(l_quantity AS INT) AS length, l_discount AS reward, l_tax AS value,
           CAST(l_partkey % 16 AS INT) AS task, l_partkey % 7 <> 0 AS is_valid, l_returnflag AS response
    FROM lineitem"""

VIEWS: dict[str, Callable[[At], str]] = {"objects": _objects, "poses": _poses, "rollouts": lambda at: ROLLOUTS}
SOURCES = {"objects": "embeddings", "poses": "embeddings", "rollouts": "lineitem"}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; nothing is registered in the session."""
    text = VIEWS[name](lambda array, i: f"element_at({array}, {i})")
    source = SOURCES[name]
    return spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def sql_view(name: str) -> str:
    """The same table as a common table expression for DuckDB."""
    return f"{name} AS ({VIEWS[name](lambda array, i: f'{array}[{i}]')})"


def with_views(*names: str, rest: str = "") -> str:
    """WITH clause of the named tables, to which `rest` may add others."""
    return "WITH " + ", ".join([*(sql_view(n) for n in names), *([rest] if rest else [])]) + "\n"
