"""Entity tables: merge candidates of one type, ranked paths, and merges applied to every table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.operators.graph import merged_edges, undirected
from quillspark.operators.scratch import Rounds

_BLOCK, _TILE = 4096, 256  # vectors of a block that meets every other one of its type; of a block whose products are held at once


def merge_candidates(entities: DataFrame, least: float, most: int, id_col: str = "node", kind_col: str = "kind", vector_col: str = "embedding", block: int = _BLOCK) -> DataFrame:
    """(a, b, kind, score): the `most` pairs of entities of one type with the highest cosine, of `least` or more;
    a < b, ties to smaller a, then b. A null type is a type of its own.

    Exact: all pairs of a type's blocks meet in a group, which returns its best `most` pairs; the
    best of all are among those. Cosines are rounded to six digits. Null, zero and non-finite
    vectors, null ids and repeated ids make no pair; vectors of different lengths don't meet.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = entities.select(F.col(id_col).cast("long").alias("id"), F.col(kind_col).alias("kind"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    rows = rows.where(F.forall("v", lambda x: F.abs(x) < F.lit(float("inf"))) & F.exists("v", lambda x: x != 0))
    # as many blocks as the largest type needs
    largest = rows.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, math.ceil(largest / block))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "kind", "v", "own", F.size("v").alias("dim"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kind_type = rows.schema["kind"].dataType.simpleString()

    def best(met: pa.Table) -> pa.Table:
        own = met["own"].to_numpy()
        order = np.argsort(own, kind="stable")
        ids, own = met["id"].to_numpy()[order], own[order]
        v = met["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        one = met["x"][0].as_py() == met["y"][0].as_py()
        split = 0 if one else int((own == met["x"][0].as_py()).sum())
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for at in range(0, len(ids) if one else split, _TILE):
            upto = min(at + _TILE, len(ids) if one else split)
            cosine = np.round(unit[at:upto] @ unit[split:].T, 6)
            i, j = np.nonzero(cosine >= max(least, held[2][-1] if len(held[2]) == most else least))
            a, b = ids[at:upto][i], ids[split:][j]
            if one:
                keep = a < b  # the other order stands in the mirrored place
            else:
                keep = a != b
            score = cosine[i, j][keep]
            a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            a, b, score = np.append(held[0], a), np.append(held[1], b), np.append(held[2], score)
            top = np.lexsort((b, a, -score))[:most]
            held = a[top], b[top], score[top]
        kind = pa.array([met["kind"][0].as_py()] * len(held[0]), met["kind"].type)
        return pa.table({"a": held[0], "b": held[1], "kind": kind, "score": held[2]})

    pairs = rows.groupBy("kind", "dim", "x", "y").applyInArrow(best, f"a long, b long, kind {kind_type}, score double")
    return pairs.orderBy(F.desc("score"), "a", "b").limit(most)


def ranked_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3, most: int = 5) -> DataFrame:
    """(src, dst, nth, path, hops, weight, score): for each pair (src, dst) the `most` best paths of at most `hops`
    edges (1 to 6) without repeated nodes: shorter first, then heavier, then by the path; score is 1 / hops.

    Edges (src, dst, weight) count both ways, parallel ones as one of their weights' sum. An open
    path is first joined to its target; only pairs with fewer than `most` paths go on, since
    longer paths come after shorter ones. A pair of one node has no path.
    """
    if not 1 <= hops <= 6:
        raise ValueError("hops must be 1 to 6")
    with Rounds(edges.sparkSession) as rounds:
        both = rounds.keep(undirected(edges))
        open_ = rounds.keep(pairs.select("src", "dst").where("src <> dst").distinct().select("src", "dst", F.array("src").alias("path"), F.lit(0.0).alias("weight")))
        found = None
        for hop in range(1, hops + 1):
            ends = both.select(F.col("u").alias("last"), F.col("v").alias("dst"), "w")
            at_end = open_.withColumn("last", F.element_at("path", -1)).join(ends, ["last", "dst"])
            step = rounds.keep(at_end.select("src", "dst", F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight")))
            found = step if found is None else found.union(step)
            if hop == hops:
                break
            full = found.groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= most)
            on = open_.join(full, ["src", "dst"], "left_anti").join(both, F.element_at("path", -1) == F.col("u"))
            on = on.where((F.col("v") != F.col("dst")) & ~F.array_contains("path", F.col("v")))
            open_ = rounds.keep(on.select("src", "dst", F.concat("path", F.array("v")).alias("path"), (F.col("weight") + F.col("w")).alias("weight")))
        out = found.withColumn("hops", F.size("path") - 1)
        nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("hops", F.desc("weight"), "path"))
        out = out.withColumn("nth", nth).where(F.col("nth") <= most)
        return rounds.result(out.select("src", "dst", "nth", "path", "hops", "weight", (1 / F.col("hops")).alias("score")))


def merged_tables(nodes: DataFrame, edges: DataFrame, files: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) after merges (node, survivor), each node once.

    nodes (node, name, aliases): the survivor takes the names and aliases of its group as aliases,
    in order and without its own name; the others go. Edges (src, dst, ...) and files (node,
    file) move to the survivor; loops and repeated rows go. A survivor that is merged itself isn't
    followed, and merges without their survivor in nodes lose nothing: their rows stay as they are.
    """
    real = merges.where("node <> survivor").select("node", "survivor").distinct()
    real = real.join(nodes.select(F.col("node").alias("survivor")), "survivor", "left_semi").select("node", "survivor")
    none = F.array().cast("array<string>")
    own = F.concat(F.array("name"), F.coalesce("aliases", none))
    given = nodes.join(real, "node").groupBy(F.col("survivor").alias("node")).agg(F.flatten(F.collect_list(own)).alias("given"))
    left = nodes.join(real, "node", "left_anti").join(given, "node", "left")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.col("given"))))
    every = F.filter(every, lambda a: a.isNotNull() & ~a.eqNullSafe(F.col("name")))
    left = left.select("node", "name", F.when(F.col("given").isNull(), F.coalesce("aliases", none)).otherwise(every).alias("aliases"))
    held = files.join(real, "node", "left").select(F.coalesce("survivor", "node").alias("node"), "file").distinct()
    return left, merged_edges(edges, real), held
