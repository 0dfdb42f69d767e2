"""Operational aggregates, conversations, evaluation, columns, graphs, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions import cells
from quillspark.operators import evaluation, fusion, graph, tabular, vector
from quillspark.sources.tables import page_links, page_texts, read, snapshot_changes
from quillspark.streaming import events as streams


def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c, kind: read(spark, sf_dir, t).select(F.col(c).cast("date").alias("day"), F.lit(kind).alias("kind"))
    both = one("events", "ts", "event").union(one("orders", "o_orderdate", "order")).union(one("lineitem", "l_shipdate", "shipment"))
    return both.groupBy("day", "kind").agg(F.count("*").alias("n"))


def chat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"))


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count("*").alias("n"))


def judge_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.when(F.col("event_type") == "purchase", F.col("value"))
    return read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.round(F.avg(scored), 4).alias("mean"), F.count("*").alias("n"))


def feedback_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1) - F.coalesce("toxic", F.lit(0)))
    return read(spark, sf_dir, "labels").groupBy("doc_id").agg(net.alias("net")).where("net <> 0")


def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    files = docs.groupBy("source").agg(F.count("*").alias("files"), F.count(F.when(F.col("n_chars") > 5000, 1)).alias("long_files"))
    judged = docs.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("toxic"), F.round(F.avg("quality"), 4).alias("quality"))
    return files.join(judged, "source", "left").select("source", "files", "long_files", F.coalesce("toxic", F.lit(0)).alias("toxic"), "quality", F.round(F.col("long_files") / F.col("files"), 4).alias("long_share"))


def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("2024-12-31").cast("date"), F.col("ts").cast("date"))
    return read(spark, sf_dir, "events").select("event_id", F.round(fusion.recency(age.cast("double"), 30.0), 6).alias("score"))


def message_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the number of turns before it and the text of the one just before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.row_number().over(w) - 1).withColumn("previous", F.lag("text").over(w))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("before").cast("long").alias("before"), "previous")


def user_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("n"), F.rank().over(price).alias("r"), F.dense_rank().over(price).alias("d"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, o = (read(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    return both.union(c.select(F.col("c_custkey").cast("int")).subtract(o.select(F.col("o_custkey").cast("int"))))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: the newest order."""
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the nearest vectors, where those of the query's label are relevant."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    ranked = vector.cosine_top_k(rows, asked, 10)
    return evaluation.label_metrics(ranked, rows.select(F.col("vec_id").alias("id"), "label"), 10)


def pairwise_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("wins"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("wins"), F.col("n"))
    return won.select("source", "wins", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evenly_spaced(read(spark, sf_dir, "documents"), "source", "doc_id", 5).select("source", "doc_id")


def value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tabular.value_index(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])
    literals = spark.createDataFrame([("BUILDING",), ("mach",), ("000001",)], "literal string")
    return tabular.look_up(index, literals, 5)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", cells.identifier(F.col("p_name")).alias("name"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), F.col("l_quantity").alias("weight"))


def entity_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def reached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within_hops(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 2)


def entity_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.simple_paths(_edges(spark, sf_dir), spark.createDataFrame([(1, 2)], "src long, dst long"), 2)
    return out.select("src", "dst", F.element_at("path", 2).alias("via"), "hops")


def entity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.personalised_pagerank(_edges(spark, sf_dir), spark.createDataFrame([(1,), (2,)], "node long"))
    return out.select("node", F.round("score", 6).alias("score"))


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all vectors at cosine 0.35 or more, directly or not."""
    return graph.merge_clusters(vector.similarity_links(read(spark, sf_dir, "embeddings"), 0.35))


def page_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(read(spark, sf_dir, "pages"))


def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read(spark, sf_dir, "pages"))


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return snapshot_changes(docs.where("doc_id % 10 <> 3"), docs.where("doc_id % 10 <> 7"), "doc_id", "digest")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events drained into hourly counts."""
    out = streams.drained(spark, streams.windowed_counts(_stream(spark, sf_dir), "1 hour"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(read(spark, sf_dir, "events"), "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        documents_by_source, daily_activity, chat_stats, outcome_histogram, latency_percentiles, judge_daily_means, feedback_net, source_overview, recency_scores, message_ancestors, user_windows, set_operations,
        pricing_summary, latest_order, customers_without_orders, retrieval_quality, pairwise_wins, spaced_sample, value_lookup, identifiers, entity_degrees, reached_entities, entity_paths,
        entity_ranks, merged_entities, page_link_targets, plain_pages, changed_documents, hourly_events, user_sessions,
    )
}

_EDGES = "WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, l_quantity AS weight FROM lineitem)"

ORACLES = {
    "documents_by_source": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
    "daily_activity": "SELECT day, kind, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, 'event' AS kind FROM events UNION ALL SELECT CAST(o_orderdate AS DATE), 'order' FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 'shipment' FROM lineitem) GROUP BY ALL",
    "chat_stats": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY role",
    "outcome_histogram": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type",
    "judge_daily_means": "SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 4) AS mean, count(*) AS n FROM events GROUP BY day",
    "feedback_net": "SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END - coalesce(toxic, 0))::BIGINT AS net FROM labels GROUP BY doc_id HAVING net <> 0",
    "source_overview": """
SELECT f.source, files, long_files, coalesce(toxic, 0)::BIGINT AS toxic, quality, round(long_files / files, 4) AS long_share
FROM (SELECT source, count(*) AS files, count(CASE WHEN n_chars > 5000 THEN 1 END) AS long_files FROM documents GROUP BY source) f
LEFT JOIN (SELECT source, sum(toxic) AS toxic, round(avg(quality), 4) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source) j USING (source)""",
    "recency_scores": "SELECT event_id, round(pow(2.0::DOUBLE, -greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-12-31')::DOUBLE, 0) / 30), 6) AS score FROM events",
    "message_ancestors": "SELECT conv_id, turn, before, previous FROM (SELECT *, row_number() OVER w - 1 AS before, lag(text) OVER w AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
    "user_windows": """
SELECT o_orderkey, row_number() OVER w::INTEGER AS n, rank() OVER p::INTEGER AS r, dense_rank() OVER p::INTEGER AS d, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""",
    "set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT CAST(c_custkey AS INTEGER) FROM customer EXCEPT SELECT CAST(o_custkey AS INTEGER) FROM orders)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "latest_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "retrieval_quality": """
WITH s AS (SELECT q.vec_id AS query_id, q.label AS ql, d.vec_id AS id, d.label AS dl, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
n AS (SELECT query_id, count(*) AS n FROM s WHERE ql = dl GROUP BY query_id),
h AS (SELECT query_id, count(*) AS got, count(CASE WHEN ql = dl THEN 1 END) AS h, min(CASE WHEN ql = dl THEN rank END) AS first, sum(CASE WHEN ql = dl THEN 1.0::DOUBLE / log2(rank + 1) END) AS dcg FROM r WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(h / n, 6) AS recall, round(h / got, 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
       round(CASE WHEN h > 0 THEN dcg / list_sum(list_transform(range(1, h + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM n JOIN h USING (query_id)""",
    "pairwise_wins": """
WITH w AS (SELECT source, sum(quality)::BIGINT AS wins, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), p AS (SELECT *, wins / n AS p, 1.96::DOUBLE AS z FROM w)
SELECT source, wins, n, round(greatest((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 0), 6) AS low, round(least((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 1), 6) AS high FROM p""",
    "spaced_sample": """
WITH a AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY source)
SELECT DISTINCT source, ids[CAST(floor(i * len(ids) / 5.0) AS BIGINT) + 1] AS doc_id FROM a, range(0, 5) AS r(i) WHERE len(ids) > 5 UNION ALL SELECT source, unnest(ids) FROM a WHERE len(ids) <= 5""",
    "identifiers": r"SELECT p_partkey, left(CASE WHEN regexp_matches(t, '^[0-9]') THEN 'col_' || t ELSE t END, 63) AS name FROM (SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(p_name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM part)",
    "value_lookup": """
WITH v AS (SELECT 'c_mktsegment' AS name, c_mktsegment AS cell, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY ALL),
l AS (SELECT unnest(['BUILDING', 'mach', '000001']) AS literal),
k AS (SELECT literal, name, cell, n, CASE WHEN lower(cell) = lower(literal) THEN 0 WHEN starts_with(lower(cell), lower(literal)) THEN 1 ELSE 2 END AS kind FROM v JOIN l ON contains(lower(cell), lower(literal)))
SELECT * FROM (SELECT literal, CAST(row_number() OVER (PARTITION BY literal ORDER BY kind, n DESC, name, cell) AS INTEGER) AS nth, name, cell, kind, n FROM k) WHERE nth <= 5""",
    "entity_degrees": _EDGES + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node",
    "reached_entities": _EDGES + ", p AS (SELECT DISTINCT dst FROM e WHERE src = 1), s AS (SELECT DISTINCT src FROM e JOIN p USING (dst) WHERE src <> 1) SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT dst, 1 FROM p UNION ALL SELECT src, 2 FROM s",
    "entity_paths": _EDGES + " SELECT 1::BIGINT AS src, 2::BIGINT AS dst, dst AS via, 2 AS hops FROM (SELECT DISTINCT dst FROM e WHERE src = 1 INTERSECT SELECT DISTINCT dst FROM e WHERE src = 2)",
    "changed_documents": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'created' ELSE 'deleted' END AS change FROM documents WHERE doc_id % 10 IN (3, 7)",
    "hourly_events": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": "SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS n FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY user_id",
}
