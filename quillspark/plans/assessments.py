"""Evaluation, filters, ranked lists and entity graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.operators import chunks, evaluation, filters, fusion, graph
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read
from quillspark.streaming import events as streams
from quillspark.streaming import memory

REGISTRY = Registry()
query = REGISTRY.query

# evaluation -------------------------------------------------------------------------------------

_REPORTS = "SELECT event_type AS route, value / 100 AS recall, CASE WHEN user_id % 3 <> 0 THEN value END AS judged, value AS latency, CASE WHEN user_id % 7 = 0 THEN 'failed' END AS error FROM events"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, error = F.when(F.col("user_id") % 3 != 0, F.col("value")), F.when(F.col("user_id") % 7 == 0, "failed")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("route"), (F.col("value") / 100).alias("recall"), judged.alias("judged"), F.col("value").alias("latency"), error.alias("error"))


@query(f"""
WITH g AS (SELECT route, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(judged), 6) AS judged, list_sort(list(latency)) AS l FROM ({_REPORTS}) WHERE error IS NULL GROUP BY route)
SELECT route, n, recall, judged, l[CAST(ceil(n * 0.5::DOUBLE) AS BIGINT)] AS p50, l[CAST(ceil(n * 0.95::DOUBLE) AS BIGINT)] AS p95 FROM g""")
def evaluation_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_reports(spark, sf_dir), ["recall", "judged"], ["route"])


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT CASE WHEN i >= n THEN '' WHEN i * 4 < n THEN '0-25' WHEN i * 4 < n * 2 THEN '25-50' WHEN i * 4 < n * 3 THEN '50-75' ELSE '75-100' END AS bucket, count(*) AS hits FROM t GROUP BY bucket""")
def depth_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("i"), n.alias("n"))
    return rows.groupBy(evaluation.depth_bucket(F.col("i"), F.col("n")).alias("bucket")).agg(F.count("*").alias("hits"))


_ROUTED = "SELECT CASE l_returnflag WHEN 'A' THEN 'global_synthesis' WHEN 'R' THEN 'complex_reasoning' ELSE '' END AS wanted, CASE l_linestatus WHEN 'F' THEN 'complex_reasoning' ELSE 'lookup' END AS got FROM lineitem"


@query(f"SELECT *, round(\"right\" / n, 6) AS accuracy FROM (SELECT count(*) AS n, count(*) FILTER (replace(wanted, 'global_synthesis', 'complex_reasoning') = got) AS \"right\" FROM ({_ROUTED}) WHERE wanted <> '' AND got <> '')")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("l_returnflag") == "A", "global_synthesis").when(F.col("l_returnflag") == "R", "complex_reasoning").otherwise("")
    return evaluation.routing_accuracy(read(spark, sf_dir, "lineitem").select(wanted.alias("wanted"), F.when(F.col("l_linestatus") == "F", "complex_reasoning").otherwise("lookup").alias("got")))


@query("""
SELECT *, round(fired / nullif(eligible, 0), 6) AS fire_rate, round(failed / nullif(fired, 0), 6) AS error_rate FROM (
  SELECT l_returnflag, count(*) FILTER (l_quantity > 10) AS eligible, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS fired, count(*) FILTER (l_discount > 0.02 AND l_tax > 0.07) AS failed FROM lineitem GROUP BY l_returnflag)""")
def tabular_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 10).alias("eligible"), (F.col("l_discount") > 0.02).alias("fired"), (F.col("l_tax") > 0.07).alias("failed"))
    return evaluation.rates(rows, ["l_returnflag"])


_POOL = """
WITH c AS (SELECT source, sum(quality)::BIGINT AS wins, sum(toxic)::BIGINT AS losses, count(*) - sum(quality)::BIGINT AS ties FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT *, wins + losses AS n, wins / nullif(wins + losses, 0) AS p, 1.96::DOUBLE AS z FROM c)
SELECT source, {a} AS wins, {b} AS losses, ties, round({a} / nullif(n, 0), 6) AS win_rate, round(CASE WHEN n = 0 THEN 0 ELSE greatest((q + z*z/(2*n) - z*sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n), 0) END, 6) AS low,
  round(CASE WHEN n = 0 THEN 1 ELSE least((q + z*z/(2*n) + z*sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n), 1) END, 6) AS high FROM (SELECT *, {a} / nullif(n, 0) AS q FROM p)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("source", F.col("quality").cast("long").alias("wins"), F.col("toxic").cast("long").alias("losses"), (1 - F.col("quality")).cast("long").alias("ties"))


@query(_POOL.format(a="wins", b="losses"))
def pooled_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pooled(_counts(spark, sf_dir), ["source"])


@query(_POOL.format(a="losses", b="wins"))
def mirrored_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pooled(evaluation.mirrored(_counts(spark, sf_dir)), ["source"])


@query("""
SELECT conv_id::VARCHAR || '#t' || nth::VARCHAR AS question_id, conv_id, nth, text AS question, history FROM (
  SELECT *, CAST(count(*) FILTER (role = 'user') OVER w AS INTEGER) AS nth, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN role || ': ' || text END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.expanded_turns(read(spark, sf_dir, "conversations")).withColumn("history", F.array_join("history", "\n"))


@query(r"""
SELECT min(conv_id * 1000 + turn) AS nth FROM conversations WHERE role = 'user' AND lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) <> '' GROUP BY lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))""")
def distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("nth"), "text")
    return evaluation.distinct_questions(rows, "text", "nth").select("nth")


@query("SELECT s_suppkey AS query_id, n_nationkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey OR lower(n_name) = 'nation_' || (s_suppkey % 25)")
def cited_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.array("s_nationkey").alias("ids"), F.array(F.concat(F.lit("Nation_"), (F.col("s_suppkey") % 25).cast("string"))).alias("names"))
    return evaluation.truth(asked, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("SELECT o_orderkey, metric, count(*) OVER () AS total FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS metric FROM orders) ORDER BY metric DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def run_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("metric"))
    return evaluation.run_page(runs, "metric", "o_orderkey", 25, 2)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def baseline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    return evaluation.baseline(runs, "1999-01-01", "o_orderdate", "done", "o_orderkey").select("o_orderkey")


# filters ----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang IN ('en', 'fr')")
def tenant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_tenant(read(spark, sf_dir, "documents"), "src1", ["en", "fr"], "source", "lang").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'de'")
def visible_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_kind(read(spark, sf_dir, "documents"), None, "lang", "de").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src2'")
def metadata_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return filters.with_metadata(rows, {"lang": "en", "source": "src2"}).select("doc_id")


_DATED = "SELECT *, coalesce(CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) END, DATE '1998-06-01') AS day FROM orders"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumns({"published_at": F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate").cast("date")), "created_at": F.lit("1998-06-01").cast("date")})


@query(f"SELECT o_orderkey FROM ({_DATED}) WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_window(_dated(spark, sf_dir), filters.effective_date(), "1998-01-01", "1998-12-31").select("o_orderkey")


@query(f"SELECT o_orderkey, day FROM ({_DATED}) ORDER BY day DESC, o_orderkey LIMIT 50")
def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.newest(_dated(spark, sf_dir), filters.effective_date(), 50, "o_orderkey").select("o_orderkey", filters.effective_date().alias("day"))


@query("SELECT DISTINCT o_custkey AS file_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def ids_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("file_id"))
    return filters.both_ids(left, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id")))


@query("SELECT event_id FROM events WHERE value >= 50")
def least_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.at_least(read(spark, sf_dir, "events"), 50.0, "value").select("event_id")


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 1000)")
def visible_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    out = read(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_nationkey").alias("n_nationkey"))
    return filters.visible(read(spark, sf_dir, "nation"), members, out, "n_nationkey").select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^(SMALL|red) w')")
def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.named(read(spark, sf_dir, "part"), "^(SMALL|red) w", "p_name").select("p_partkey")


_GRADED = "SELECT o_custkey AS query_id, count(*) FILTER (o_orderpriority = '1-URGENT') AS relevant, count(*) FILTER (o_orderpriority = '2-HIGH') AS ambiguous, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) AS relevant_files FROM orders GROUP BY o_custkey"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", "relevant").when(F.col("o_orderpriority") == "2-HIGH", "ambiguous").otherwise("irrelevant")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("file_id"), grade.alias("grade"))


@query(f"SELECT *, CASE WHEN relevant >= 3 OR (relevant > 0 AND relevant_files = 1) THEN 'proceed' WHEN relevant > 0 THEN 'rewrite' WHEN ambiguous > 0 THEN 'proceed' ELSE 'abstain' END AS action FROM ({_GRADED})")
def grade_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.grade_action(_graded(spark, sf_dir), 3)


@query(f"SELECT *, CASE WHEN relevant + ambiguous > 0 THEN 'proceed' ELSE 'abstain' END AS action FROM ({_GRADED})")
def grade_actions_after_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.grade_action(_graded(spark, sf_dir), 3, rewritten=True)


@query("SELECT l_orderkey AS query_id, count(*) < 3 OR NOT coalesce(bool_or(l_quantity / 50 >= 0.9), false) AS low FROM lineitem GROUP BY l_orderkey")
def unsure_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.low_confidence(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_quantity") / 50).alias("score")), 0.9)


# ranked lists: each user's events by value ----------------------------------------------------------

_RANKED = """
WITH ranked AS (SELECT * FROM (SELECT user_id AS query_id, event_id AS id, event_type AS group_id, round(value, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 20),
keyword AS (SELECT * FROM (SELECT user_id AS query_id, event_id AS id, event_type AS group_id, round(value, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 20)
"""


def _ranked(spark: SparkSession, sf_dir: str, by_time: bool = False) -> DataFrame:
    order = ["ts", "event_id"] if by_time else [F.desc("value"), "event_id"]
    rows = read(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where("rank <= 20")
    return rows.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("event_type").alias("group_id"), F.round("value", 6).alias("score"), "rank")


@query(_RANKED + "SELECT query_id, ranked.id, round(score + coalesce(0.3::DOUBLE * pow(2.0::DOUBLE, -greatest(age, 0) / 14.0::DOUBLE), 0), 6) AS score FROM ranked LEFT JOIN (SELECT event_id AS id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')::DOUBLE AS age FROM events WHERE event_type <> 'click') USING (id)")
def recency_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = read(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("event_id").alias("id"), F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")).alias("age_days"))
    return fusion.with_recency(_ranked(spark, sf_dir), ages, 0.3, 14.0)


@query(_RANKED + "SELECT query_id, ranked.id, round(score + 0.2::DOUBLE * least(coalesce(n, 0), 3) / 3, 6) AS score FROM ranked LEFT JOIN (SELECT event_id AS id, event_id % 5 AS n FROM events WHERE event_id % 2 = 0) USING (id)")
def bridge_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("n"))
    return fusion.with_bridges(_ranked(spark, sf_dir), tally, 0.2)


@query(_RANKED + "SELECT query_id, round(CASE WHEN count(score) < 2 THEN 0 ELSE stddev_pop(score) END, 6) AS spread FROM ranked GROUP BY query_id")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.score_spread(_ranked(spark, sf_dir))


@query(_RANKED + "SELECT query_id, id, CAST(source AS INTEGER) AS source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY source, rank) AS n FROM (SELECT *, 0 AS source FROM ranked UNION ALL SELECT *, 1 FROM keyword)) WHERE n = 1")
def lists_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.union_once([_ranked(spark, sf_dir), _ranked(spark, sf_dir, by_time=True)], ["id"]).select("query_id", "id", "source")


@query(_RANKED + "SELECT query_id, id, CAST(floor((rank - 1) / 6) AS INTEGER) AS batch FROM ranked")
def list_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.batches(_ranked(spark, sf_dir), 6).select("query_id", "id", "batch")


@query(_RANKED + """
, f AS (SELECT * FROM ranked WHERE rank <= 8), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank) AS n FROM keyword) WHERE n = 1) WHERE m <= 4),
j AS (SELECT coalesce(f.query_id, b.query_id) AS query_id, coalesce(f.id, b.id) AS id, coalesce(f.group_id, b.group_id) AS group_id, f.score AS s, f.rank AS r, b.rank AS k FROM f FULL JOIN b ON f.query_id = b.query_id AND f.id = b.id),
t AS (SELECT *, CASE WHEN k IS NOT NULL THEN max(s) OVER (PARTITION BY query_id) ELSE s END AS score, (query_id, group_id) IN (SELECT (query_id, group_id) FROM b) AS strong FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r IS NOT NULL, strong DESC, coalesce(r, k)) AS place FROM t)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r IS NULL, r, k) AS INTEGER) AS rank FROM o WHERE place <= 8""")
def keyword_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.keyword_floor(_ranked(spark, sf_dir).where("rank <= 8"), _ranked(spark, sf_dir, by_time=True), 8)
    return out.select("query_id", "id", "score", "rank")


@query(_RANKED + "SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id % 7 ORDER BY rank) AS n FROM ranked) WHERE n = 1")
def first_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir).withColumn("parent_id", F.col("id") % 7)
    return chunks.one_per_parent(hits, read(spark, sf_dir, "documents").select("doc_id", "text")).select("query_id", "id", "score")


# entity graphs: suppliers and parts, each order a chunk -------------------------------------------

_EDGES = "WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, l_orderkey AS chunk FROM lineitem), d AS (SELECT node, count(*)::DOUBLE AS score FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)\n"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), F.col("l_orderkey").alias("chunk"))


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir)).select("node", F.col("degree").cast("double").alias("score"))


@query(_EDGES + "SELECT node, score FROM d WHERE node NOT IN (1, 2) ORDER BY score DESC, node LIMIT 20")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_entities(_degrees(spark, sf_dir), spark.createDataFrame([(1,), (2,)], "node long"), 20)


@query(_EDGES + "SELECT chunk, round(sum(CASE WHEN n IN (1, 2) THEN 1 ELSE score END), 6) AS score FROM (SELECT chunk, unnest([src, dst]) AS n FROM e) JOIN d ON n = node GROUP BY chunk")
def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_scores(_edges(spark, sf_dir), _degrees(spark, sf_dir), spark.createDataFrame([(1,), (2,)], "node long"))


@query("SELECT id, m * (m - 1) // 2 AS n FROM (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 2000 GROUP BY l_orderkey) WHERE m > 1")
def bridge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("node"))
    return graph.bridge_tally(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("node")), seeds)


@query(_EDGES + """, p AS (SELECT DISTINCT dst AS via FROM e WHERE src = 1 INTERSECT SELECT DISTINCT dst FROM e WHERE src = 2)
SELECT chunk, round(sum(0.5::DOUBLE), 6) AS score FROM (SELECT DISTINCT chunk, via FROM p JOIN e ON dst = via AND src IN (1, 2)) GROUP BY chunk""")
def path_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    paths = graph.simple_paths(edges.withColumn("weight", F.lit(1.0)), spark.createDataFrame([(1, 2)], "src long, dst long"), 2)
    return graph.path_chunks(paths, edges)


@query("SELECT name, node, canonical FROM (SELECT b AS name, n_nationkey::BIGINT AS node, lower(n_name) = lower(b) AS canonical, row_number() OVER (PARTITION BY b ORDER BY lower(n_name) <> lower(b), n_nationkey) AS k FROM nation, (SELECT unnest(['nation_3', 'Region 1']) AS b) WHERE lower(n_name) = lower(b) OR lower('region ' || n_regionkey) = lower(b)) WHERE k <= 5")
def entities_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("aliases"))
    return graph.by_name(entities, spark.createDataFrame([("nation_3",), ("Region 1",)], "name string"), 5)


@query("""
WITH q AS (SELECT DISTINCT p_type AS query_id, unnest([p_type, 'ring', 'small']) AS token FROM part), t AS (SELECT DISTINCT p_partkey AS node, unnest(string_split(p_name, ' ')) AS token FROM part)
SELECT query_id, node, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, node) AS n FROM (SELECT query_id, node, count(*) AS overlap FROM q JOIN t USING (token) GROUP BY ALL)) WHERE n <= 10""")
def entities_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    asked = parts.select(F.col("p_type").alias("query_id"), F.array("p_type", F.lit("ring"), F.lit("small")).alias("tokens")).distinct()
    return graph.by_tokens(parts.select(F.col("p_partkey").alias("node"), F.split("p_name", " ").alias("tokens")), asked, 10)


_MEMBERS = "WITH m AS (SELECT s_nationkey AS root, s_suppkey AS node, s_name AS name, count(l_orderkey) AS degree FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL), b AS (SELECT root, first(node ORDER BY degree DESC, strlen(name) DESC, node) AS survivor, first(name ORDER BY degree DESC, strlen(name) DESC, node) AS own FROM m GROUP BY root)\n"


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("degree"))
    rows = read(spark, sf_dir, "supplier").join(degree, "s_suppkey", "left")
    return graph.survivors(rows.select(F.col("s_nationkey").alias("root"), F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"), F.coalesce("degree", F.lit(0)).alias("degree")))


@query(_MEMBERS + "SELECT root, survivor, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name <> own), '') AS aliases FROM b JOIN m USING (root) GROUP BY ALL")
def entity_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).withColumn("aliases", F.array_join("aliases", ","))


@query(_MEMBERS + "SELECT DISTINCT survivor AS src, l_partkey + 1000000000 AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN b ON s_nationkey = root")
def entities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = read(spark, sf_dir, "supplier").join(_survivors(spark, sf_dir), F.col("s_nationkey") == F.col("root")).select(F.col("s_suppkey").alias("node"), "survivor")
    return graph.merged_edges(_edges(spark, sf_dir).select("src", "dst"), merges)


@query("SELECT k, string_agg(a, ',' ORDER BY a) AS aliases FROM (SELECT c_nationkey AS k, c_mktsegment AS a FROM customer UNION SELECT s_nationkey, left(s_name, 8) FROM supplier) GROUP BY k")
def entities_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.array("c_mktsegment").alias("aliases"))
    two = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.array(F.left("s_name", F.lit(8))).alias("aliases"))
    return graph.upserted(one, two, ["k"]).select("k", F.array_join("aliases", ",").alias("aliases"))


@query("""
WITH RECURSIVE t(root, node, depth) AS (SELECT r_regionkey, r_regionkey, 0 FROM region UNION ALL SELECT root, child, depth + 1 FROM t JOIN (
  SELECT n_regionkey AS parent, 1000 + n_nationkey AS child FROM nation UNION ALL SELECT 1000 + c_nationkey, 1000000 + c_custkey FROM customer) ON node = parent) SELECT root::BIGINT AS root, node::BIGINT AS node, depth FROM t""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), (1000 + F.col("n_nationkey")).cast("long").alias("node"))
    children = nations.union(read(spark, sf_dir, "customer").select((1000 + F.col("c_nationkey")).cast("long"), 1_000_000 + F.col("c_custkey")))
    return graph.descendants(children, read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("root")))


@query("""
WITH RECURSIVE t(root, node, depth) AS (SELECT conv_id * 1000 + max(turn), conv_id * 1000 + max(turn), 0 FROM conversations GROUP BY conv_id UNION ALL
  SELECT root, node - 1, depth + 1 FROM t WHERE EXISTS (SELECT 1 FROM conversations WHERE conv_id * 1000 + turn = node - 1)) SELECT * FROM t""")
def message_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last message and, by its parent links, all before it."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id").distinct()
    links = rows.select((F.col("node") + 1).alias("parent"), "node")
    return graph.descendants(links, rows.groupBy("conv_id").agg(F.max("node").alias("root")).select("root"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w, event_type, value FROM events) GROUP BY ALL")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed_counts(read(spark, sf_dir, "events"), "1 hour", slide="30 minutes")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT conv_id * 1000 + turn AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as steps of a plan: each needs the turn before it and the third before it."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id").distinct()
    w = Window.partitionBy("conv_id").orderBy("node")
    before = rows.select("node", F.lag("node").over(w).alias("one"), F.lag("node", 3).over(w).alias("three"))
    needs = before.select("node", F.explode(F.array("one", "three")).alias("parent")).where("parent IS NOT NULL")
    return graph.dependency_levels(rows.select("node"), needs)


@query("""
WITH n AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s QUALIFY session = max(session) OVER (PARTITION BY user_id))
SELECT user_id AS chat, string_agg(event_id::VARCHAR || ':' || event_type, '|' ORDER BY ts, event_id) AS notes, count(*)::INTEGER AS n FROM last WHERE back <= 20 GROUP BY user_id""")
def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of notes leaves of each chat: the newest 20 since its last pause of six hours."""
    notes = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    text = F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))
    stream = memory.remembered(notes.select(F.col("user_id").alias("chat"), text.alias("text"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq")), newest=20, ttl_hours=6)
    out = streams.drained(spark, stream, "update")
    return out.where("NOT expired").groupBy("chat").agg(F.max_by(F.struct("notes", "n"), F.struct("updated", "batch_order")).alias("x")).select("chat", "x.notes", "x.n")
