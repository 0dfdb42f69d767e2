"""Entity graphs: edges (src, dst, weight) between longs, taken as undirected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.operators.scratch import Rounds

_ROWS = 1_000_000  # rows of a task that sums by key, about


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v, w) both ways; parallel edges are summed, weights of 0 or less count 1, self-loops go."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    one = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    return one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """rows, n or so, dealt out by key before they are summed: a task's sums are of about _ROWS rows,
    while those of an input split would be of all keys in it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / _ROWS)), key)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return _dealt(ends, 2 * edges.count(), "node").groupBy("node").agg(F.count("*").alias("degree"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, depth): nodes at most `hops` edges away from seeds (node), with their least depth.

    Edges both ways are kept once; each hop goes on from the nodes that the one before it reached first.
    """
    one = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = _cut(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    front = seeds.select("node", F.lit(0).alias("depth")).distinct()
    reached = front
    for depth in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        front = _cut(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.union(front)
    return reached


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(node, score) by power iteration; a node without edges gives its mass back to the seeds.

    Scores are checkpointed each round, so that lineage stays short. Links are dealt out once, by the
    end that scores come from. Only a seed can be without edges, as links go both ways.
    """
    both = undirected(edges)
    out = both.groupBy("u").agg(F.sum("w").alias("total"))
    links = both.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p"))
    links = links.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u").persist()
    start = seeds.select("node").distinct()
    start = start.crossJoin(F.broadcast(start.agg(F.count("*").alias("n")))).select("node", (1.0 / F.col("n")).alias("s"))
    scores = start.select("node", F.col("s").alias("score"))
    sinks = _cut(start.select("node").join(links.select(F.col("u").alias("node")), "node", "left_anti"))
    for _ in range(rounds):
        passed = scores.join(links, scores["node"] == links["u"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        lost = scores.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        new = passed.join(start, "node", "full").crossJoin(F.broadcast(lost))
        base = F.coalesce("s", F.lit(0.0))
        new = new.select("node", (damping * (F.coalesce("got", F.lit(0.0)) + base * F.col("lost")) + (1 - damping) * base).alias("score"))
        new = _cut(new)
        change = new.withColumnRenamed("score", "b").join(scores.withColumnRenamed("score", "a"), "node", "full").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0]
        scores = new
        if change < tolerance:
            break
    return scores


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def simple_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """(src, dst, path, hops): paths without repeated nodes of at most `hops` edges between pairs (src, dst)."""
    both = undirected(edges).select("u", "v")
    open_ = pairs.select("src", "dst", F.array("src").alias("path")).distinct()
    out = None
    for _ in range(hops):
        step = open_.join(both, F.element_at("path", -1) == F.col("u")).where(~F.array_contains("path", F.col("v")))
        step = step.select("src", "dst", F.concat("path", F.array("v")).alias("path"))
        ended = step.where(F.element_at("path", -1) == F.col("dst"))
        out = ended if out is None else out.union(ended)
        open_ = step.where(F.element_at("path", -1) != F.col("dst"))
    return out.select("src", "dst", "path", (F.size("path") - 1).alias("hops"))


def merge_clusters(pairs: DataFrame) -> DataFrame:
    """(node, root): nodes joined by pairs (a, b), directly or not, and the least of each group."""
    edges = _cut(pairs.select("a", "b").union(pairs.select("b", "a")))  # read twice a round
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        least = edges.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = _cut(roots.join(least, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")))
        roots = new.select("node", "root")
        if new.where("moved").isEmpty():
            return roots


def top_entities(scores: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k best nodes (node, score) that are no seeds; k is held to 1..200."""
    return scores.join(seeds.select("node").distinct(), "node", "left_anti").orderBy(F.desc("score"), "node").limit(min(max(k, 1), 200))


def chunk_scores(edges: DataFrame, scores: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk, score): the sum over a chunk's edges (src, dst, chunk) of their ends' scores; a seed counts 1."""
    pool = scores.join(seeds.select("node").distinct(), "node", "left_anti").select("node", "score").union(seeds.select("node", F.lit(1.0)).distinct())
    ends = edges.select("chunk", F.explode(F.array("src", "dst")).alias("node"))
    n = 2 * edges.count()
    scored = _dealt(ends, n, "node").join(pool, "node").select("chunk", "score")
    return _dealt(scored, n, "chunk").groupBy("chunk").agg(F.round(F.sum("score"), 6).alias("score"))


def bridge_tally(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, n): in how many pairs of different seeds each chunk of mentions (id, node) takes part."""
    held = mentions.join(seeds.select("node").distinct(), "node", "left_semi").distinct().groupBy("id").agg(F.count("*").alias("m"))
    return held.select("id", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("n")).where("n > 0")


def path_chunks(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, score): the sum of 1 / hops over the paths (path, hops) that use an edge (src, dst, chunk) of the chunk."""
    steps = paths.select("path", "hops", F.explode(F.sequence(F.lit(1), F.col("hops"))).alias("i"))
    steps = steps.select("path", "hops", F.element_at("path", F.col("i")).alias("u"), F.element_at("path", F.col("i") + 1).alias("v"))
    steps = steps.select("path", "hops", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    of = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "chunk").distinct()
    used = steps.join(of, ["x", "y"]).select("path", "hops", "chunk").distinct()
    return used.groupBy("chunk").agg(F.round(F.sum(1 / F.col("hops")), 6).alias("score"))


def by_name(entities: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """(name, node, canonical): entities (node, name, aliases) with a name (name) as theirs or as an alias, letter
    case aside; own names first, n for each."""
    keys = entities.select("node", F.explode(F.concat(F.array(F.struct(F.lower("name").alias("key"), F.lit(0).alias("kind"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("key"), F.lit(1).alias("kind"))))).alias("k"))
    keys = keys.groupBy("node", F.col("k.key").alias("key")).agg(F.min("k.kind").alias("kind"))
    found = names.select("name", F.lower("name").alias("key")).distinct().join(keys, "key")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("kind", "node"))
    return found.withColumn("nth", nth).where(F.col("nth") <= n).select("name", "node", (F.col("kind") == 0).alias("canonical"))


def by_tokens(entities: DataFrame, questions: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, node, overlap): entities (node, tokens) that share tokens with a question (query_id, tokens), n for each."""
    one = entities.select("node", F.explode(F.array_distinct("tokens")).alias("token"))
    asked = questions.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    met = asked.join(one, "token").groupBy("query_id", "node").agg(F.count("*").alias("overlap"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "node"))
    return met.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def survivors(members: DataFrame) -> DataFrame:
    """(root, survivor, aliases) of members (root, node, name, degree): the node of most edges, then longest name in
    bytes, then least number; the names of the others are its aliases, in order."""
    best = F.max(F.struct("degree", F.octet_length("name").alias("size"), (-F.col("node")).alias("minus"), "name")).alias("b")
    names = F.array_sort(F.collect_set("name"))
    out = members.groupBy("root").agg(best, names.alias("names"))
    return out.select("root", (-F.col("b.minus")).alias("survivor"), F.array_remove("names", F.col("b.name")).alias("aliases"))


def merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with each end replaced by merges (node, survivor); loops go, and so do edges that became equal."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(merges.select(F.col("node").alias(end), F.col("survivor").alias("new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return out.where("src <> dst").select(*edges.columns).distinct()


def upserted(known: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(*key, aliases): entities of both tables, one of each key, with all of their aliases in order."""
    both = known.select(*key, "aliases").unionByName(found.select(*key, "aliases"))
    return both.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))


def without_file(edges: DataFrame, mentions: DataFrame, file: int) -> tuple[DataFrame, DataFrame]:
    """Edges (file, ...) and mentions (node, file) without those of a file; nodes of no other file are gone from both."""
    left = mentions.where(F.col("file") != file)
    alive = left.select("node").distinct()
    kept = edges.where(F.col("file") != file)
    for end in ("src", "dst"):
        kept = kept.join(alive.select(F.col("node").alias(end)), end, "left_semi")
    return kept, left


def descendants(children: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): each node below each root (root) by children (parent, node), with its least depth.

    A level a round, until one brings nothing new, so that trees of any depth end whole; a node that
    is its own ancestor is not entered again.
    """
    with Rounds(children.sparkSession) as rounds:
        links = rounds.keep(children.select(F.col("parent").alias("p"), F.col("node").alias("c")).where("p IS NOT NULL AND c IS NOT NULL").distinct())
        level = rounds.keep(roots.where("root IS NOT NULL").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
        out, depth = level, 0
        while not level.isEmpty():
            depth += 1
            below = level.join(links, F.col("node") == F.col("p")).select("root", F.col("c").alias("node")).distinct()
            level = rounds.keep(below.join(out.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")))
            out = out.union(level)
            if depth % 16 == 0:
                out = rounds.keep(out)  # else the plan grows with the depth
        return rounds.result(out)


def dependency_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes (node) that need none, else one more than the highest level needed (needs: node, parent).

    A round a level takes off the nodes all of whose parents are gone. A repeated node, a parent
    that is no node, and a cycle are errors.
    """
    with Rounds(nodes.sparkSession) as rounds:
        left = rounds.keep(nodes.select("node"))
        needs = rounds.keep(needs.select("node", "parent").where("parent IS NOT NULL").distinct())
        if left.groupBy("node").count().where("count > 1").limit(1).count():
            raise ValueError("a node is given twice")
        if needs.join(left.select(F.col("node").alias("parent")), "parent", "left_anti").limit(1).count():
            raise ValueError("a parent is no node")
        out, level = None, 0
        while not left.isEmpty():
            waits = needs.join(left.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
            ready = rounds.keep(left.join(waits, "node", "left_anti").select("node", F.lit(level).cast("long").alias("level")))
            if ready.isEmpty():
                raise ValueError("the nodes have a cycle")
            out = ready if out is None else out.union(ready)
            left, level = rounds.keep(left.join(ready, "node", "left_anti")), level + 1
            if level % 16 == 0:
                out = rounds.keep(out)
        return rounds.result(out if out is not None else left.withColumn("level", F.lit(0).cast("long")))
