"""Merge candidates, ranked paths, applied merges and column profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import cells
from quillspark.operators import entities, graph, profiles
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, a.label AS kind, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3 ORDER BY 4 DESC, 1, 2 LIMIT 500""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 closest pairs of one label."""
    return entities.merge_candidates(read(spark, sf_dir, "embeddings"), 0.3, 500, "vec_id", "label")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), F.col("l_quantity").cast("double").alias("weight"))


@query("""
WITH e AS (SELECT l_suppkey AS s, l_partkey + 1000000000 AS p, sum(CASE WHEN l_quantity > 0 THEN l_quantity ELSE 1 END)::DOUBLE AS w FROM lineitem GROUP BY ALL),
x AS (SELECT a.s AS src, b.s AS dst, a.p AS via, a.w + b.w AS weight FROM e a JOIN e b ON a.p = b.p AND b.s = a.s + 1)
SELECT * FROM (SELECT src, dst, via, weight, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, via) AS INTEGER) AS nth FROM x) WHERE nth <= 5""")
def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paths between each supplier and the one with the next number."""
    one = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    out = entities.ranked_paths(_edges(spark, sf_dir), one, 2, 5)
    return out.select("src", "dst", F.element_at("path", 2).alias("via"), "weight", "nth")


_MERGED = """
WITH d AS (SELECT s_nationkey AS root, s_suppkey AS node, s_name AS name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS degree FROM supplier),
best AS (SELECT *, first_value(node) OVER (PARTITION BY root ORDER BY degree DESC, strlen(name) DESC, node) AS survivor FROM d),
e AS (SELECT DISTINCT survivor AS node, l_partkey, l_quantity FROM lineitem JOIN best ON l_suppkey = node),
f AS (SELECT DISTINCT survivor AS node, date_trunc('month', l_shipdate) AS file FROM lineitem JOIN best ON l_suppkey = node)
SELECT survivor AS node, any_value(name) FILTER (node = survivor) AS name, string_agg(name, '|' ORDER BY name) FILTER (node <> survivor) AS aliases,
  (SELECT count(*) FROM e WHERE e.node = survivor) AS n_edges, (SELECT count(*) FROM f WHERE f.node = survivor) AS n_files FROM best GROUP BY survivor
"""


@query(_MERGED)
def applied_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each nation merged into the one with most orders, their parts and months with them."""
    edges = _edges(spark, sf_dir)
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("root"), F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    members = rows.join(degrees, "node", "left").fillna(0, ["degree"])
    merges = members.join(graph.survivors(members).select("root", "survivor"), "root").select("node", "survivor")
    months = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.date_trunc("month", "l_shipdate").alias("file"))
    nodes, edges, files = entities.merged_tables(rows.select("node", "name", F.array().cast("array<string>").alias("aliases")), edges, months, merges)
    parts = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_edges"))
    held = files.groupBy("node").agg(F.count("*").alias("n_files"))
    joined = nodes.select("node", "name", F.when(F.size("aliases") > 0, F.array_join("aliases", "|")).alias("aliases"))
    return joined.join(parts, "node", "left").join(held, "node", "left").fillna(0, ["n_edges", "n_files"])


_CELLS = {
    "key": "o_orderkey::VARCHAR", "status": "o_orderstatus", "price": "o_totalprice::VARCHAR", "day": "o_orderdate::DATE::VARCHAR", "priority": "o_orderpriority", "clerk": "'Clerk#' || o_orderkey",
    "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE 'no' END", "code": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE '00' || (o_custkey % 40) END",
}
_NULLS = ", ".join(f"'{t}'" for t in cells.NULL_TOKENS)
_PROFILES = rf"""
WITH l AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, o_orderkey AS pos, trim({text}) AS t FROM orders" for c, text in _CELLS.items())}),
k AS (SELECT *, coalesce(t <> '' AND lower(t) NOT IN ({_NULLS}), false) AS f, coalesce(lower(t) IN ({_NULLS}), false) AS token, regexp_matches(t, '^(0[0-9]+|[0-9]{{16,}})$') AS kept FROM l),
c AS (SELECT *, f AND NOT kept AND regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS d, f AND NOT kept AND regexp_matches(t, '^[+-]?[0-9]+([.][0-9]*)?$') AS num FROM k),
v AS (SELECT *, CASE WHEN num THEN regexp_replace(CAST(TRY_CAST(t AS DOUBLE) AS DECIMAL(38, 6))::VARCHAR, '[.]?0+$', '') ELSE t END AS value FROM c),
s AS (SELECT name, count(*) AS n, count(*) FILTER (f) AS filled, count(*) FILTER (token) AS null_tokens, count(*) FILTER (num) AS numeric, count(*) FILTER (d) AS dates,
  count(*) FILTER (f AND lower(t) IN ('ja', 'yes', 'true', 'x', '✓', 'wahr', 'nein', 'no', 'false', 'falsch')) AS bools, count(*) FILTER (f AND NOT num AND NOT d AND regexp_matches(t, '^[0-9]+([._\-/][0-9A-Za-z_]+)+$')) AS ids, count(*) FILTER (f AND regexp_matches(t, '^[0-9]+$')) AS digits, min(length(t)) FILTER (f) AS w0, max(length(t)) FILTER (f) AS w1, count(DISTINCT lower(t)) FILTER (f) AS nl,
  count(*) FILTER (f AND NOT num AND NOT d) AS texts, count(*) FILTER (regexp_matches(t, '^0[0-9]+$')) AS leading_zero, count(DISTINCT value) FILTER (f) AS nd,
  min(TRY_CAST(t AS DOUBLE)) FILTER (num) AS x0, max(TRY_CAST(t AS DOUBLE)) FILTER (num) AS x1, min(t) FILTER (d) AS d0, max(t) FILTER (d) AS d1, array_to_string(list_slice(list(t ORDER BY pos) FILTER (f), 1, 3), '|') AS samples FROM v GROUP BY name),
r AS (SELECT *, CASE WHEN filled = 0 THEN 'text' WHEN name IN ('key', 'code') OR leading_zero > 0 OR ids >= 0.8 * filled OR (digits = filled AND w0 = w1 AND w0 >= 4 AND filled >= 3 AND nd >= 0.9 * filled) OR (digits = filled AND nd = filled AND x0 = 1 AND x1 = filled) THEN 'id'
  WHEN dates >= 0.9 * filled THEN 'date' WHEN filled >= 2 AND bools = filled AND nl <= 2 THEN 'boolean' WHEN numeric >= 0.9 * filled THEN 'measure' WHEN filled >= 5 AND nd <= 50 AND nd <= greatest(3, 0.2 * filled) THEN 'category' ELSE 'text' END AS role FROM s),
w AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value) AS nth FROM v WHERE f GROUP BY name, value),
x AS (SELECT name, string_agg(value, '|' ORDER BY nth) AS value_set FROM w WHERE nth <= 50 GROUP BY name)
SELECT name, role, n, n - filled AS nulls, null_tokens, numeric, dates, 0::BIGINT AS times, CASE WHEN role = 'boolean' THEN filled ELSE 0 END AS bools, CASE WHEN role = 'boolean' THEN 0 ELSE texts END AS texts, leading_zero, 0::BIGINT AS long_digits,
  coalesce(regexp_replace(CAST(x0 AS DECIMAL(38, 6))::VARCHAR, '[.]?0+$', ''), d0) AS low, coalesce(regexp_replace(CAST(x1 AS DECIMAL(38, 6))::VARCHAR, '[.]?0+$', ''), d1) AS high,
  CASE WHEN role IN ('id', 'category', 'text') AND nd <= 10000 THEN nd ELSE -1 END AS n_distinct, role IN ('id', 'category', 'text') AND nd > 10000 AS overflow, 0::BIGINT AS long_values, samples,
  CASE WHEN role IN ('id', 'category', 'text') AND nd <= 10000 THEN value_set END AS value_set FROM r JOIN x USING (name)
"""


@query(_PROFILES)
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of orders as cells of a sheet, one with as many values as rows."""
    o = read(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise("no")
    code = F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("00"), (F.col("o_custkey") % 40).cast("string")))
    sheet = o.select(
        F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("priority"), F.concat(F.lit("Clerk#"), F.col("o_orderkey")).alias("clerk"), urgent.alias("urgent"), code.alias("code"),
    )
    out = profiles.column_profiles(sheet, "at")
    return out.withColumns({"samples": F.array_join("samples", "|"), "value_set": F.array_join("value_set", "|")})
