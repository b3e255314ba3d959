"""Query op8_url_filter: every url of pages under the four rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.url_filter import RULES, filter_urls, write_index
from tidemark.runtime import table

NAME = "op8_url_filter"

ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM q
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_index(spark, RULES)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), index).select("page_id", "host", "path", "rule", "verdict")
