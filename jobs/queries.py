"""The jobs as queries: each runs its function twice over the whole tables into a new folder, and gives the output of the second run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.plans.base import trend_sql
from pluvia.session import shared_dir

from . import nation_extremes, text_extremes


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_nation_extremes(spark: SparkSession, root: str) -> DataFrame:
    folder, config = _folder(spark, "job1"), json.loads(nation_extremes.CONFIG.read_text())
    for _ in range(2):
        out = nation_extremes.run(spark, root, f"{folder}/annual", **config)
    digits = lambda *cols: [F.round(c, 6).alias(c) for c in cols]
    return out.select("REGION", "DOMAIN", "YEAR", "N_EVENTS", "N_EXTREME", *digits("THRESHOLD", "MEAN_EXTREME", "SHARE", "SLOPE", "P_VALUE"))


def job2_text_extremes(spark: SparkSession, root: str) -> DataFrame:
    folder, config = _folder(spark, "job2"), json.loads(text_extremes.CONFIG.read_text())
    # a pattern: the table may be a single file, which a stream takes by pattern only
    for _ in range(2):
        out = text_extremes.run(spark, f"{root}/documents.parquet*", f"{folder}/extremes", f"{folder}/checkpoint", **config)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_nation_extremes, job2_text_extremes)}

ORACLE: dict[str, str] = {
    "job1_nation_extremes": f"""
WITH e AS (
  SELECT coalesce(r_name, 'UNKNOWN') AS REGION, coalesce(n_name, 'UNKNOWN') AS DOMAIN, year(o_orderdate)::INT AS YEAR, o_totalprice::DOUBLE AS v
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  WHERE year(o_orderdate) BETWEEN 1995 AND 2001),
ranked AS (SELECT *, row_number() OVER (PARTITION BY REGION, DOMAIN ORDER BY v) AS i, count(*) OVER (PARTITION BY REGION, DOMAIN) AS n FROM e WHERE v IS NOT NULL),
th AS (SELECT REGION, DOMAIN, v AS THRESHOLD FROM ranked WHERE i = ceil(0.99::DOUBLE * n)),
g AS (SELECT REGION, DOMAIN, y::INT AS YEAR FROM (SELECT DISTINCT REGION, DOMAIN FROM e), generate_series(1995, 2001) t(y)),
a AS (SELECT REGION, DOMAIN, YEAR, count(*)::BIGINT AS n, count(*) FILTER (v > THRESHOLD)::BIGINT AS x, sum(v) FILTER (v > THRESHOLD) AS s FROM e LEFT JOIN th USING (REGION, DOMAIN) GROUP BY ALL),
d AS (SELECT g.*, coalesce(n, 0) AS N_EVENTS, coalesce(x, 0) AS N_EXTREME, THRESHOLD, s / nullif(x, 0) AS MEAN_EXTREME, x / nullif(n, 0) AS SHARE FROM g LEFT JOIN a USING (REGION, DOMAIN, YEAR) LEFT JOIN th USING (REGION, DOMAIN)),
{trend_sql("d", "REGION, DOMAIN", "SHARE")}
SELECT REGION, DOMAIN, YEAR, N_EVENTS, N_EXTREME, round(THRESHOLD, 6) AS THRESHOLD, round(MEAN_EXTREME, 6) AS MEAN_EXTREME, round(SHARE, 6) AS SHARE, round(slope, 6) AS SLOPE, round(p_value, 6) AS P_VALUE
FROM d JOIN sl USING (REGION, DOMAIN) JOIN mk USING (REGION, DOMAIN)""",
    "job2_text_extremes": r"""
WITH s AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words) AS i, count(*) OVER (PARTITION BY source)::BIGINT AS n FROM s),
t AS (SELECT source, words AS threshold FROM r WHERE i = ceil(0.9::DOUBLE * n))
SELECT doc_id, r.source, lang, words, threshold, n, CASE WHEN r.source IS NULL THEN 'none' ELSE 's-' || regexp_replace(r.source, '[^A-Za-z0-9._-]', '_', 'g') END AS SHELF
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE words > threshold""",
}
