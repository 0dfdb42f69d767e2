"""Scores of retrieval results against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg) of each query in truth (query_id, id).

    ranked: (query_id, id, rank). Precision divides by what was retrieved; the ideal gain is
    that of as many hits as were found.
    """
    sizes = truth.groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(truth.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return _metrics(sizes, hits)


def label_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The same where all others of a query's label are its truth: labels (id, label) holds queries and candidates.
    Labels are counted and those of hits compared, so that no label's rows meet one another."""
    n = labels.groupBy("label").agg((F.count("*") - 1).alias("n"))
    asked = ranked.select("query_id").distinct().join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    sizes = asked.join(n, F.col("wanted") == F.col("label")).where("n > 0").select("query_id", "n")
    hits = ranked.where(F.col("rank") <= k).join(asked, "query_id").join(labels.select("id", "label"), "id").withColumn("hit", F.when(F.col("label") == F.col("wanted"), 1))
    return _metrics(sizes, hits)


def _metrics(sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """sizes (query_id, n), hits (query_id, rank, hit: 1 or null)."""
    gain = F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + 1))
    found = hits.groupBy("query_id").agg(F.count("*").alias("got"), F.count("hit").alias("h"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    out = sizes.join(found, "query_id", "left").fillna(0, ["got", "h"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return out.select(
        "query_id",
        F.round(F.col("h") / F.col("n"), 6).alias("recall"),
        F.round(F.when(F.col("got") > 0, F.col("h") / F.col("got")).otherwise(0.0), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(F.col("h") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a win rate, held to 0..1; (0, 1) without a trial."""
    p = wins / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(high, F.lit(1.0)))


def regressions(now: DataFrame, before: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """(key, metric, delta) where a metric fell by more than its limit."""
    both = now.select(key, *[F.col(m).alias(f"{m}__now") for m in limits]).join(before.select(key, *limits), key)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"{m}__now") - F.col(m), 6).alias("delta"), F.lit(x).alias("most")) for m, x in limits.items()]))
    return both.select(key, each.alias("x")).select(key, "x.*").where("delta < -most").drop("most")


def evenly_spaced(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Up to n rows of each group at equal distances in order."""
    w = Window.partitionBy(group)
    out = rows.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("all", F.count("*").over(w))
    nth = F.floor((F.col("at") * n + F.col("all") - 1) / F.col("all"))
    return out.where((F.col("all") <= n) | ((nth < n) & (F.floor(nth * F.col("all") / n) == F.col("at")))).drop("at", "all")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*keys, names...): the value at place ceil(share * n) of each group in order."""
    w = Window.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w.orderBy(value))).withColumn("all", F.count("*").over(w))
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("at") == F.greatest(F.ceil(F.col("all") * p), F.lit(1)), F.col(value))).alias(n) for n, p in shares.items()])


def summary(reports: DataFrame, metrics: list[str], keys: list[str], latency: str = "latency") -> DataFrame:
    """(*keys, n, means..., p50, p95): reports without an error, by keys; a metric's mean is over those that have it."""
    good = reports.where("error IS NULL OR error = ''")
    means = good.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    return means.join(nearest_rank(good, keys, latency, {"p50": 0.5, "p95": 0.95}), keys, "left")


def depth_bucket(index: Column, total: Column) -> Column:
    """Quarter of its document in which a chunk lies; empty where the position is none."""
    bad = (total <= 0) | (index < 0) | (index >= total)
    return F.when(bad, "").when(index * 4 < total, "0-25").when(index * 4 < total * 2, "25-50").when(index * 4 < total * 3, "50-75").otherwise("75-100")


def routing_accuracy(rows: DataFrame) -> DataFrame:
    """(n, right, accuracy) of (wanted, got): the two names of whole-corpus questions are one route."""
    one = lambda c: F.when(F.col(c) == "global_synthesis", "complex_reasoning").otherwise(F.col(c))
    out = rows.where("coalesce(wanted, '') <> '' AND coalesce(got, '') <> ''").agg(F.count("*").alias("n"), F.count_if(one("wanted") == one("got")).alias("right"))
    return out.withColumn("accuracy", F.round(F.col("right") / F.nullif("n", F.lit(0)), 6))


def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, eligible, fired, failed, fire_rate, error_rate) of booleans eligible, fired and failed; a rate of nothing is null."""
    out = rows.groupBy(*keys).agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("fired")).alias("fired"), F.count_if(F.col("fired") & F.col("failed")).alias("failed"))
    return out.withColumn("fire_rate", F.round(F.col("fired") / F.nullif("eligible", F.lit(0)), 6)).withColumn("error_rate", F.round(F.col("failed") / F.nullif("fired", F.lit(0)), 6))


def pooled(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, wins, losses, ties, win_rate, low, high) of counts summed up; ties are in no rate."""
    out = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "ties")])
    n = F.col("wins") + F.col("losses")
    low, high = wilson(F.col("wins"), F.nullif(n, F.lit(0)))
    return out.select(*keys, "wins", "losses", "ties", F.round(F.col("wins") / F.nullif(n, F.lit(0)), 6).alias("win_rate"), F.round(F.when(n == 0, 0.0).otherwise(low), 6).alias("low"), F.round(F.when(n == 0, 1.0).otherwise(high), 6).alias("high"))


def mirrored(counts: DataFrame) -> DataFrame:
    """Wins and losses exchanged: the other side's counts."""
    return counts.withColumns({"wins": F.col("losses"), "losses": F.col("wins")})


def expanded_turns(turns: DataFrame) -> DataFrame:
    """(question_id, conv_id, nth, question, history) of conversations (conv_id, turn, role, text): a question for
    each user turn, named id#tN, with all earlier texts that aren't blank. A conversation is held whole."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    earlier = F.collect_list(F.when(F.trim("text") != "", F.concat_ws(": ", "role", "text"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    rows = turns.withColumn("history", earlier).withColumn("nth", nth.cast("int")).where("role = 'user'")
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("#t"), F.col("nth").cast("string")).alias("question_id"), "conv_id", "nth", F.col("text").alias("question"), "history")


def distinct_questions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each question, letter case and white space aside; blank ones go."""
    same = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(key), F.lit("")), r"\s+", " ")))
    first = rows.select(same.alias("same"), order).where("same <> ''").groupBy("same").agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


def truth(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, id) of questions (query_id, ids, names) and documents (id, name): what must be cited, by id or by name."""
    by_id = questions.select("query_id", F.explode("ids").alias("id")).join(documents.select("id"), "id", "left_semi").select("query_id", "id")
    by_name = questions.select("query_id", F.explode("names").alias("name")).withColumn("name", F.lower("name")).join(documents.select("id", F.lower("name").alias("name")), "name").select("query_id", "id")
    return by_id.union(by_name).distinct()


def run_page(runs: DataFrame, metric: str, id_col: str, size: int, page: int) -> DataFrame:
    """Runs by a metric, largest first and missing ones last, one page of them, with the number of all."""
    total = runs.agg(F.count("*").alias("total"))  # one row
    return runs.crossJoin(F.broadcast(total)).orderBy(F.desc_nulls_last(metric), id_col).offset(size * page).limit(size)


def baseline(runs: DataFrame, before: str, at: str, done: str, id_col: str) -> DataFrame:
    """The latest finished run before a moment."""
    return runs.where(F.col(done) & (F.col(at) < F.lit(before).cast("timestamp_ntz"))).orderBy(F.desc(at), F.desc(id_col)).limit(1)
