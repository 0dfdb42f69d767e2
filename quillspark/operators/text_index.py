"""A stored keyword index: postings with positions, and corpus statistics kept by increments.

Batches of changed documents are appended; what a batch adds to or takes from document
frequencies, document counts and lengths is written beside its postings, so that statistics
are sums of small tables and no text is read again. Applying a batch number again replaces it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import questions
from quillspark.functions.text import lexemes
from quillspark.operators.index_scores import Asked
from quillspark.operators.keyword import top_k
from quillspark.operators.scratch import Rounds

_POSTINGS = "corpus string, id long, lexeme string, tf int, dl int, positions array<int>"
_TABLES = {
    "postings": _POSTINGS,
    "versions": "corpus string, id long, deleted boolean, dl int",
    "terms": "corpus string, lexeme string, df long",
    "sizes": "corpus string, n long, length long, at timestamp",
}
_FEW = 100_000  # lexemes asked for that are sent to every task; with more, postings are dealt by lexeme
_WORDS = 200_000  # words of queries that are sent to every task at once
_AT_ONCE = 1 << 18  # words that are put in order together; a longer text is taken by itself


def positional(docs: DataFrame) -> DataFrame:
    """Postings of docs (corpus, id, text): a row for each distinct lexeme of a text with its places
    from 0, and one without a lexeme for each text, which carries dl, the number of its
    distinct lexemes, where it has none. Words are counted where their text is: nothing is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            ends = np.flatnonzero(b.column(2).is_null().to_numpy(zero_copy_only=False))
            if len(ends) and held + len(b) >= _AT_ONCE:
                cut = int(ends[-1]) + 1
                yield _inverted(*_texts([*parts, b.slice(0, cut)]))
                parts, held = [b.slice(cut)], len(b) - cut
            else:
                parts.append(b)
                held += len(b)
        if held:
            yield _inverted(*_texts(parts))

    rows = docs.select(F.col("corpus").cast("string").alias("corpus"), F.col("id").cast("long").alias("id"), lexemes(F.col("text").cast("string")).alias("t"))
    # a row for each word and one without for the text's end: a batch's size does not hang on its texts' lengths
    words = rows.select("corpus", "id", F.explode(F.concat("t", F.array(F.lit(None).cast("string")))).alias("lexeme"))
    return words.mapInArrow(run, _POSTINGS)


def _texts(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, pa.ListArray]:
    """(corpus, ids, words) of whole texts, whose words come as rows up to one without."""
    met = pa.Table.from_batches(parts).combine_chunks()
    corpus, ids, words = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in met.columns)
    last = words.is_null().to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(last)
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int32)
    return corpus.take(pa.array(ends)), ids.take(pa.array(ends)), pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(~last)))


def _inverted(corpus: pa.Array, ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    lengths = np.diff(words.offsets.to_numpy())
    owner = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((place, code, owner))
    owner, code, place = owner[order], code[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(owner) else np.zeros(0, np.int64)
    tf = np.diff(np.append(starts, len(owner)))
    dl = np.bincount(owner[starts], minlength=len(ids))
    whose = np.concatenate((owner[starts], np.arange(len(ids)))).astype(np.int64)
    offsets = np.concatenate((starts, np.full(len(ids) + 1, len(owner)))).astype(np.int32)
    lexeme = pa.concat_arrays([coded.dictionary.take(pa.array(code[starts])).cast(pa.string()), pa.nulls(len(ids), pa.string())])
    columns = [corpus.take(pa.array(whose)), ids.take(pa.array(whose)), lexeme, pa.array(np.append(tf, np.zeros(len(ids), np.int64)).astype(np.int32)), pa.array(dl[whose].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, names=["corpus", "id", "lexeme", "tf", "dl", "positions"])


class TextIndex:
    """The tables of an index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in _TABLES.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}/batch=-1")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{_TABLES[name]}, batch long").parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def apply(self, batch: int, changes: DataFrame) -> None:
        """changes (corpus, id, text, deleted, at): documents that are new, have a new text, or are gone.

        Of several changes of a document in a batch the last by `at` counts, a deletion first among
        equals. Deleting an unknown document changes nothing. A null corpus or id is no document.
        """
        last = _newest(changes)
        self._write("postings", batch, positional(last.where("NOT deleted")).sortWithinPartitions("lexeme"))
        mine = self.table("postings").where(F.col("batch") == batch)
        held = mine.where("lexeme IS NULL").select("corpus", "id", F.lit(False).alias("deleted"), "dl")
        gone = last.where("deleted").select("corpus", "id", "deleted", F.lit(0).alias("dl"))
        self._write("versions", batch, held.unionByName(gone))
        touched = self.table("versions").where(F.col("batch") == batch).select("corpus", "id")
        old = self.documents(batch).join(touched, ["corpus", "id"], "left_semi")
        left = self.table("postings", batch).join(old.select("corpus", "id", "batch"), ["corpus", "id", "batch"], "left_semi")
        terms = mine.select("corpus", "lexeme", F.lit(1).alias("df")).unionByName(left.select("corpus", "lexeme", F.lit(-1).alias("df")))
        terms = terms.where("lexeme IS NOT NULL").groupBy("corpus", "lexeme").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write("terms", batch, terms)
        none = F.lit(None).cast("timestamp")
        sizes = held.select("corpus", F.lit(1).alias("n"), "dl", none.alias("at")).unionByName(old.select("corpus", F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"), none.alias("at")))
        sizes = sizes.unionByName(last.select("corpus", F.lit(0).alias("n"), F.lit(0).alias("dl"), F.col("at").cast("timestamp").alias("at")))
        self._write("sizes", batch, sizes.groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("dl").cast("long").alias("length"), F.max("at").alias("at")))

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies a stream of changes batch by batch; a batch that is run again after a failure replaces itself."""
        return changes.writeStream.foreachBatch(lambda rows, n: self.apply(n, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def documents(self, before: int | None = None) -> DataFrame:
        """(corpus, id, batch, dl): documents that are there, and the batch that wrote them."""
        newest = self.table("versions", before).groupBy("corpus", "id").agg(F.max(F.struct("batch", "deleted", "dl")).alias("x"))
        return newest.where("NOT x.deleted").select("corpus", "id", "x.batch", "x.dl")

    def postings(self, lexemes_: DataFrame | None = None) -> DataFrame:
        """Postings of documents that are there; with lexemes_ (corpus, lexeme) of those alone, before anything is dealt out."""
        rows = self.table("postings").where("lexeme IS NOT NULL")
        if lexemes_ is not None:
            few = lexemes_.select("corpus", "lexeme").distinct()
            rows = rows.join(F.broadcast(few) if few.count() <= _FEW else few, ["corpus", "lexeme"], "left_semi")
        return rows.join(self.documents().select("corpus", "id", "batch"), ["corpus", "id", "batch"], "left_semi").drop("batch")

    def sizes(self) -> DataFrame:
        """(corpus, n, avgdl, at): documents, their mean number of distinct lexemes, and the newest change."""
        sums = self.table("sizes").groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.max("at").alias("at"))
        return sums.select("corpus", "n", F.when(F.col("n") > 0, F.try_divide(F.col("length"), F.col("n"))).otherwise(0.0).alias("avgdl"), "at")

    def terms(self) -> DataFrame:
        """(corpus, lexeme, df)."""
        return self.table("terms").groupBy("corpus", "lexeme").agg(F.sum("df").alias("df")).where("df > 0")

    def compacted(self, folder: str) -> TextIndex:
        """The same index in another folder, as one batch."""
        new = TextIndex(self.spark, folder)
        live = self.documents()
        new._write("postings", 0, self.table("postings").join(live.select("corpus", "id", "batch"), ["corpus", "id", "batch"], "left_semi").drop("batch").sortWithinPartitions("lexeme"))
        new._write("versions", 0, live.select("corpus", "id", F.lit(False).alias("deleted"), "dl"))
        new._write("terms", 0, self.terms())
        new._write("sizes", 0, self.table("sizes").groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.max("at").alias("at")))
        return new


def _newest(changes: DataFrame) -> DataFrame:
    """The change of each document that counts, (corpus, id, at, deleted, text); texts that have no other stay where they are."""
    rows = changes.where("corpus IS NOT NULL AND id IS NOT NULL").select("corpus", "id", "at", F.coalesce("deleted", F.lit(False)).alias("deleted"), "text")
    several = rows.groupBy("corpus", "id").agg(F.count("*").alias("n")).where("n > 1").select("corpus", "id")
    n = several.limit(_FEW + 1).count()
    if not n:
        return rows
    several = F.broadcast(several) if n <= _FEW else several
    met = rows.join(several, ["corpus", "id"], "left_semi").groupBy("corpus", "id").agg(F.max(F.struct("at", "deleted", "text")).alias("x"))
    return rows.join(several, ["corpus", "id"], "left_anti").unionByName(met.select("corpus", "id", "x.*"))


def stale(newest: DataFrame, sizes: DataFrame, now: str, max_age_hours: float = 24.0, busy: DataFrame | None = None) -> DataFrame:
    """(corpus, newest): corpora whose statistics are missing, older than the newest document, or older than
    max_age_hours; not those that are being filled (busy: corpus). The most lately changed come first.

    newest: (corpus, newest) of the documents; sizes as TextIndex.sizes() gives them.
    """
    known = sizes.select("corpus", F.col("at").alias("refreshed"))
    old = F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.lit(max_age_hours * 3600))
    out = newest.join(known, "corpus", "left").where(F.col("refreshed").isNull() | (F.col("refreshed") < F.col("newest")) | (F.col("refreshed") < old))
    if busy is not None:
        out = out.join(busy.select("corpus"), "corpus", "left_anti")
    return out.select("corpus", "newest").orderBy(F.desc("newest"), "corpus")


def parts(queries: DataFrame) -> DataFrame:
    """(query_id, corpus, part, phrase, terms) of queries (query_id, corpus, text): what a document must hold.

    Each quoted phrase and each e-mail address is a part whose lexemes stand side by side; what is
    left is one part, of which any lexeme will do. Parts without lexemes go.
    """
    rest = questions.without_quoted(F.col("text"))
    split = queries.select("query_id", "corpus", F.concat(questions.quoted_phrases(F.col("text")), questions.emails(rest)).alias("phrases"), questions.without_emails(rest).alias("rest"))
    one = F.transform("phrases", lambda p: F.struct(F.lit(True).alias("phrase"), lexemes(p).alias("terms")))
    any_ = F.array(F.struct(F.lit(False).alias("phrase"), F.array_distinct(lexemes(F.col("rest"))).alias("terms")))
    found = split.select("query_id", "corpus", F.posexplode(F.concat(one, any_)).alias("part", "x"))
    return found.select("query_id", "corpus", "part", "x.phrase", "x.terms").where("size(terms) > 0")


def _asked(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, corpus, part, phrase, offset, lexeme, df, n, avgdl): the words of queries' parts; df is null where no document has the lexeme."""
    wanted = parts(queries).select("query_id", "corpus", "part", "phrase", F.posexplode("terms").alias("offset", "lexeme"))
    sizes = index.sizes().where("n > 0").select("corpus", "n", "avgdl")
    return wanted.join(index.terms(), ["corpus", "lexeme"], "left").join(sizes, "corpus")


def search(index: TextIndex, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, corpus, id, score, rank): the k best documents of a query's corpus that hold all parts of the
    query (query_id, corpus, text), by BM25 over all of its lexemes. k1 is held to 0.5..3, b to 0..1.

    Statistics are the stored ones. A query without lexemes, or of an unknown corpus, finds nothing.
    Blocks of about _WORDS words of queries go to every task; the postings of their lexemes are dealt
    out once a block, by document, and phrases and scores are found there, so that of a task's
    documents k a query are left.
    """
    k1, b = min(max(k1, 0.5), 3.0), min(max(b, 0.0), 1.0)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, corpus string, id long, score double"
    with Rounds(index.spark) as rounds:
        asked = rounds.keep(_asked(index, queries))
        blocks = max(1, -(-asked.count() // _WORDS))
        of = F.pmod(F.xxhash64("query_id", "corpus"), F.lit(blocks))
        found = [_of_block(index, asked.where(of == i), schema, k, k1, b) for i in range(blocks)]
        out = index.spark.createDataFrame([], schema) if all(f is None for f in found) else reduce(DataFrame.unionByName, [f for f in found if f is not None])
        out = out.withColumn("score", F.round("score", 6)).withColumn("of", F.struct("query_id", "corpus"))
        return rounds.result(top_k(out, k, "of").select("query_id", "corpus", "id", "score", "rank"))


def _of_block(index: TextIndex, asked: DataFrame, schema: str, k: int, k1: float, b: float) -> DataFrame | None:
    """(query_id, corpus, id, score): at least the k best documents of each query."""
    spark = index.spark
    words = asked.toArrow()
    if not words.num_rows:
        return None
    rows = words.select(["query_id", "corpus", "part", "phrase", "offset", "lexeme", "df", "n", "avgdl"]).to_pylist()
    names = list(dict.fromkeys((r["query_id"], r["corpus"]) for r in rows))
    corpora = {c: i for i, c in enumerate(sorted({c for _, c in names}))}
    number = {name: i for i, name in enumerate(names)}
    code: dict[tuple[str, str], int] = {}
    pairs: dict[tuple[int, int], list] = {}
    phrases: dict[tuple[int, int], list[tuple[int, int]]] = {}
    loose_parts, avgdl = np.zeros(len(names), np.int64), np.ones(len(names))
    in_phrase: set[int] = set()
    for r in rows:
        q = number[r["query_id"], r["corpus"]]
        avgdl[q] = r["avgdl"]
        known = r["df"] is not None
        c = code.setdefault((r["corpus"], r["lexeme"]), len(code)) if known else -1
        if r["phrase"]:
            phrases.setdefault((q, r["part"]), []).append((r["offset"], c))
            in_phrase.add(c)
        else:
            loose_parts[q] = 1
        if known:
            idf = math.log((r["n"] - r["df"] + 0.5) / (r["df"] + 0.5) + 1)
            pair = pairs.setdefault((q, c), [idf, False])
            pair[1] = pair[1] or not r["phrase"]
    if not code:
        return None
    n_phrases = np.bincount([q for q, _ in phrases], minlength=len(names))
    whole = [(q, [c for _, c in sorted(of)]) for (q, _), of in phrases.items() if all(c >= 0 for _, c in of)]
    keys, values = np.array(list(pairs), np.int64).reshape(-1, 2), list(pairs.values())
    what = Asked(len(names), len(code), np.array([corpora[c] for _, c in names]), n_phrases, loose_parts, avgdl, keys[:, 0], keys[:, 1], np.array([v[0] for v in values]), np.array([v[1] for v in values]), whole, k, k1, b)
    lexemes_ = spark.createDataFrame(pa.table({"corpus": [c for c, _ in code], "lexeme": [x for _, x in code], "of": pa.array([corpora[c] for c, _ in code], pa.int32()), "code": pa.array(range(len(code)), pa.int32()), "placed": [i in in_phrase for i in range(len(code))]}))
    held = index.table("postings").join(F.broadcast(lexemes_), ["corpus", "lexeme"])
    held = held.select(F.col("of").alias("corpus"), "id", "batch", "code", "tf", "dl", F.when(F.col("placed"), F.col("positions")).alias("positions"))
    known = spark.createDataFrame(list(corpora.items()), "corpus string, of int")
    versions = index.table("versions").join(F.broadcast(known), "corpus")
    versions = versions.select(F.col("of").alias("corpus"), "id", "batch", F.lit(-1).alias("code"), F.col("deleted").cast("int").alias("tf"), "dl", F.lit(None).cast("array<int>").alias("positions"))
    dealt = held.unionByName(versions).repartition("id", "corpus").sortWithinPartitions("id", "corpus")
    best = dealt.mapInArrow(what.run, "query int, id long, score double")
    said = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], f"query int, {schema.split(', id long')[0]}")
    return best.join(F.broadcast(said), "query").select("query_id", "corpus", "id", "score")
