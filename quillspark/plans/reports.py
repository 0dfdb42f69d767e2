"""Operational reports, columns of sheets, and what user SQL may call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions import cells
from quillspark.operators import reports, tabular
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT doc_id AS id, net FROM (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END - coalesce(toxic, 0))::BIGINT AS net FROM labels GROUP BY doc_id) WHERE net < 0 ORDER BY net, id LIMIT 20")
def worst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1) - F.coalesce("toxic", F.lit(0)))
    return reports.worst(read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(net.alias("net")), 20)


@query("SELECT l_returnflag AS tool, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS error_rate FROM lineitem GROUP BY l_returnflag")
def tool_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.struct(F.col("l_returnflag").alias("tool"), F.col("l_quantity").alias("duration"), (F.col("l_discount") > 0.05).alias("failed"))
    return reports.tool_mix(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call).alias("calls")))


@query("""
SELECT kb, count(*) AS sources, max(synced) AS last, bool_or(failures > 0) AS failing
FROM (SELECT c_nationkey AS kb, c_custkey AS synced, CASE WHEN c_acctbal < -900 THEN 1 ELSE 0 END AS failures FROM customer UNION ALL SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END FROM supplier) GROUP BY kb""")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kb"), F.col("c_custkey").alias("synced"), F.when(F.col("c_acctbal") < -900, 1).otherwise(0).alias("failures"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kb"), F.col("s_suppkey").alias("synced"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("failures"))
    return reports.sync_stats([a, b])


@query("""
SELECT kb, kind, CAST(epoch(TIMESTAMP '2010-01-01') - epoch(min(seen)) AS BIGINT) AS seconds
FROM (SELECT o_orderstatus AS kb, 'order' AS kind, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) AS seen FROM orders UNION ALL SELECT l_linestatus, 'shipment', l_shipdate FROM lineitem) GROUP BY kb, kind""")
def source_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kb"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("succeeded"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("attempted"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kb"), F.col("l_shipdate").alias("succeeded"), F.col("l_shipdate").alias("attempted"))
    return reports.sync_age({"order": orders, "shipment": items}, "2010-01-01")


@query("SELECT ts AS at, value FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def purchase_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("ts").alias("at"), "value")
    return reports.history(rows, "purchase", "2024-01-05", "2024-01-20")


@query("SELECT count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, count(*) FILTER (turn >= 3) AS recent FROM conversations")
def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.turn_counts(read(spark, sf_dir, "conversations"), F.col("turn") >= 3)


@query("""
SELECT 'documents' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'characters', sum(n_chars)::DOUBLE FROM documents UNION ALL SELECT 'pages', count(*)::DOUBLE FROM pages
UNION ALL SELECT 'conversations', count(DISTINCT conv_id)::DOUBLE FROM conversations UNION ALL SELECT 'events', count(*)::DOUBLE FROM events UNION ALL SELECT 'labelled', count(*)::DOUBLE FROM labels""")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").alias("n")
    one = {t: read(spark, sf_dir, t).agg(n) for t in ("documents", "pages", "events")}
    more = {"characters": read(spark, sf_dir, "documents").agg(F.sum("n_chars")), "conversations": read(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id")), "labelled": read(spark, sf_dir, "labels").agg(n)}
    return reports.snapshot(one | more)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.format_string('[{"score": %s}, {"score": 0.5}]', (F.col("value") / 1000).cast("string")).alias("sources"))


@query("SELECT CAST(ts AS DATE) AS day, round(avg(s), 6) AS mean, count(DISTINCT event_id) AS answers FROM (SELECT event_id, ts, unnest([value / 1000, 0.5]) AS s FROM events) GROUP BY day")
def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_scores(_answers(spark, sf_dir))


@query("SELECT * FROM (SELECT event_id AS id, round((value / 1000 + 0.5) / 2, 6) AS mean FROM events) WHERE mean < 0.3 ORDER BY mean, id LIMIT 20")
def weak_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.weak_answers(_answers(spark, sf_dir))


@query("SELECT o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL")
def generated_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT conv_id) AS chats, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role <> 'user') AS answered FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'web' ELSE 'api' END AS lang FROM conversations) GROUP BY lang")
def chats_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("lang", F.when(F.col("conv_id") % 2 == 0, "web").otherwise("api"))
    return rows.groupBy("lang").agg(F.countDistinct("conv_id").alias("chats"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") != "user").alias("answered"))


@query("SELECT p_brand AS x, count(*) AS y FROM part GROUP BY p_brand ORDER BY y DESC, x LIMIT 10")
def brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.chart(read(spark, sf_dir, "part"), "p_brand", None, "count", 10)


@query("SELECT p_type AS x, round(avg(p_retailprice), 6) AS y FROM part GROUP BY p_type ORDER BY x LIMIT 100")
def price_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.chart(read(spark, sf_dir, "part"), "p_type", "p_retailprice", "avg", 100).withColumn("y", F.round("y", 6))


@query("SELECT 'o_orderpriority' AS name, count(*) AS failures FROM orders UNION ALL SELECT 'o_totalprice', 0 FROM (SELECT 1) UNION ALL SELECT 'day', 0 FROM (SELECT 1)")
def coercion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    return tabular.coercion_failures(rows, {"o_orderpriority": "numeric", "o_totalprice": "numeric", "day": "date"})


@query("SELECT 'points' AS name, false AS comma UNION ALL SELECT 'commas', (SELECT sum(CASE WHEN length(split_part(c_acctbal::VARCHAR, '.', 2)) <= 2 THEN 1 ELSE -1 END) > 0 FROM customer)")
def decimal_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("c_acctbal").cast("string")
    return tabular.decimal_comma(read(spark, sf_dir, "customer").select(cell.alias("points"), F.replace(cell, F.lit("."), F.lit(",")).alias("commas")))


_NULLS = ", ".join(f"'{t}'" for t in cells.NULL_TOKENS)
_DATES = " OR ".join(f"regexp_matches(t, '^{p}$')" for p, _ in cells.DATE_LAYOUTS + cells.TIME_LAYOUTS)


def _statistics(table: str, columns: dict[str, str]) -> str:
    """SQL of column_statistics over columns as text."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS name, {text} AS cell FROM {table}" for c, text in columns.items())
    return rf"""WITH l AS (SELECT name, trim(cell) AS t, cell FROM ({parts})),
m AS (SELECT *, coalesce(t <> '' AND lower(t) NOT IN ({_NULLS}), false) AS f,
  regexp_matches(replace(t, ',', ''), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AND NOT regexp_matches(t, '^(0[0-9]+|[0-9]{{16,}})$') AS num, {_DATES} AS d,
  lower(t) IN ('true', 'false', 'yes', 'no', 'ja', 'nein') AS b, regexp_matches(t, '^(0[0-9]+|[0-9]{{16,}}|[0-9]+([._\-/][0-9A-Za-z_]+)+)$') AS i FROM l),
s AS (SELECT name, count(*) AS n, count(*) FILTER (f) AS filled, count(*) FILTER (f AND num) AS numeric, count(*) FILTER (f AND d) AS dates, count(*) FILTER (f AND b) AS bools, count(*) FILTER (f AND i) AS ids, count(DISTINCT cell) FILTER (f) AS n_distinct FROM m GROUP BY name)
"""


_CUSTOMER = _statistics("customer", {c: f"{c}::VARCHAR" for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")})
_ORDERS = _statistics("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice::VARCHAR", "o_orderdate": "o_orderdate::DATE::VARCHAR", "o_orderpriority": "o_orderpriority"})


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.column_statistics(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@query(_CUSTOMER + "SELECT * FROM s")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer(spark, sf_dir)


@query(_ORDERS + "SELECT name, CASE WHEN filled = 0 OR ids > 0 AND numeric < filled AND dates < filled THEN 'text' WHEN bools = filled THEN 'boolean' WHEN dates = filled THEN 'date' WHEN numeric = filled THEN 'numeric' ELSE 'text' END AS type FROM s")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    return tabular.column_types(tabular.column_statistics(orders))


@query(_CUSTOMER + """SELECT name, CASE WHEN filled = 0 THEN 'text' WHEN ids * 2 > filled AND numeric < filled THEN 'id' WHEN dates >= 0.9 * filled THEN 'date' WHEN bools = filled AND n_distinct <= 2 THEN 'boolean'
WHEN numeric >= 0.9 * filled THEN 'measure' WHEN n_distinct <= 50 AND n_distinct * 2 <= filled THEN 'category' ELSE 'text' END AS role FROM s""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.column_roles(_customer(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN strftime(DATE '1899-12-30' + p_size, '%Y-%m-%d') ELSE strftime(TIMESTAMP '1899-12-30' + to_days(p_size) + to_hours(CAST(p_partkey % 4 * 6 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') END AS iso FROM part")
def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", cells.from_serial(F.col("p_size") + (F.col("p_partkey") % 4) * 0.25).alias("iso"))


@query("SELECT p_partkey, concat_ws(' | ', 'Name: ' || p_name, 'Brand: ' || p_brand, CASE WHEN p_size > 25 THEN 'Size: ' || p_size END) AS line FROM part")
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", cells.key_values({"Name": F.col("p_name"), "Brand": F.col("p_brand"), "Size": size}).alias("line"))


@query("SELECT n_regionkey, n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS _rowid FROM nation")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read(spark, sf_dir, "nation").union(spark.createDataFrame([(99, "Total", 0), (98, "Summe 2024", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    return tabular.data_rows(totals, "n_regionkey", "n_name", ["n_nationkey"]).select("n_regionkey", "n_nationkey", "_rowid")


@query("""
SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS priorities, len(array_agg(o_orderkey)) AS orders, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey""")
def grouped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.expr("listagg(o_orderpriority, '; ') WITHIN GROUP (ORDER BY o_orderkey)")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed.alias("priorities"), F.size(F.collect_list("o_orderkey")).cast("long").alias("orders"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down, round(c_acctbal)::BIGINT AS near, trunc(c_acctbal)::BIGINT AS cut, nullif(c_nationkey, 3) AS k, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM customer")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return read(spark, sf_dir, "customer").select("c_custkey", F.abs(x).alias("a"), F.ceil(x).alias("up"), F.floor(x).alias("down"), F.round(x).cast("long").alias("near"), cut.alias("cut"), F.nullif("c_nationkey", F.lit(3)).alias("k"), F.greatest("c_nationkey", F.lit(10)).alias("g"), F.least("c_nationkey", F.lit(10)).alias("l"))


@query("""
SELECT c_custkey, split_part(c_name, '#', 2) AS tail, CAST(strpos(c_name, '#') AS INTEGER) AS at, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title, right(c_name, 4) AS last, substr(c_name, 3, 5) AS mid,
  replace(trim('  ' || c_name || ' '), '#', '-') AS plain, concat_ws('/', c_name, c_mktsegment) AS both FROM customer""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.split_part(name, F.lit("#"), F.lit(2)).alias("tail"), F.instr(name, "#").alias("at"), F.initcap("c_mktsegment").alias("title"), F.right(name, F.lit(4)).alias("last"), F.substring(name, 3, 5).alias("mid"),
        F.replace(F.btrim(F.concat(F.lit("  "), name, F.lit(" "))), F.lit("#"), F.lit("-")).alias("plain"), F.concat_ws("/", name, "c_mktsegment").alias("both"),
    )


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, CAST(date_part('year', o_orderdate) AS INTEGER) AS year, CAST(extract(quarter FROM o_orderdate) AS INTEGER) AS quarter, date_diff('day', o_orderdate::DATE, DATE '2005-01-01')::INTEGER AS age,
  make_date(CAST(date_part('year', o_orderdate) AS INTEGER), 1, 1) AS first, strftime(o_orderdate, '%d.%m.%Y') AS shown, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::DATE AS parsed, CAST(replace('1,234', ',', '') AS BIGINT) AS parsed_number FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_trunc("month", d).cast("date").alias("month"), F.date_part(F.lit("year"), d).alias("year"), F.extract(F.lit("quarter"), d).alias("quarter"), F.datediff(F.lit("2005-01-01").cast("date"), d.cast("date")).alias("age"),
        F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("first"), F.date_format(d, "dd.MM.yyyy").alias("shown"), F.to_date(F.date_format(d, "yyyyMMdd"), "yyyyMMdd").alias("parsed"), F.to_number(F.lit("1,234"), F.lit("9,999")).cast("long").alias("parsed_number"),
    )


@query("""
SELECT event_id, round(avg(value) OVER near, 4) AS moving, round(sum(value) OVER upto, 4) AS running, first_value(event_id) OVER near AS first FROM events
WINDOW near AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), upto AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def framed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near, upto = by.rowsBetween(-2, 2), by.rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(near), 4).alias("moving"), F.round(F.sum("value").over(upto), 4).alias("running"), F.first("event_id").over(near).alias("first"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    page = rows.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query("""
SELECT c_custkey, coalesce(n, 0) AS n, latest FROM customer, LATERAL (SELECT count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_custkey = c_custkey)""")
def lateral_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    return read(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "latest")


@query("SELECT DISTINCT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey OR n_regionkey = s_nationkey")
def either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on one key or another: two equal joins, then distinct, not a nested loop."""
    nations, suppliers = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    first = nations.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "s_suppkey")
    return first.union(nations.join(suppliers, F.col("n_regionkey") == F.col("s_nationkey")).select("n_nationkey", "s_suppkey")).distinct()


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)")
def parts_without_large_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = read(spark, sf_dir, "lineitem").where("l_quantity >= 48")
    return read(spark, sf_dir, "part").join(large, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")
