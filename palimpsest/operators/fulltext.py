"""Full-text search over a table of postings: (doc, term, pos), all in DataFrame operations."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stem, terms

#: Folders of a stored index; a term's is given by its checksum.
BUCKETS = 64


def postings(docs: DataFrame, doc: str, text: str, stemmed: bool = False) -> DataFrame:
    """doc, term, pos, n_terms: one row for each term of each document. `store` writes it for searches."""
    t = docs.select(F.col(doc).alias("doc"), terms(F.col(text), stemmed).alias("ts")).withColumn("n_terms", F.size("ts").cast("long"))
    return t.select("doc", "n_terms", F.posexplode("ts").alias("pos", "term")).select("doc", "term", F.col("pos").cast("long").alias("pos"), "n_terms")


def store(docs: DataFrame, doc: str, text: str, path: str, stemmed: bool = False, mode: str = "error") -> None:
    """Writes postings in a folder for each bucket of terms, sorted by term, so that a search reads the row groups of its
    terms alone; mode append adds documents. A frequent term is split by document."""
    made = postings(docs, doc, text, stemmed).withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int"))
    made.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc", "pos").write.partitionBy("bucket").mode(mode).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_terms(index: DataFrame, query: list[str]) -> DataFrame:
    """The postings of some terms; of a stored index, only their folders and row groups are read."""
    if "bucket" in index.columns:
        index = index.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in query})))
    return index.where(F.col("term").isin(sorted(set(query))))


def query_terms(df: DataFrame, query: str, stemmed: bool = False) -> list[str]:
    """A query's terms, as the documents' are made."""
    row = df.sparkSession.range(1).select(terms(F.lit(query), stemmed).alias("ts")).first()
    return list(row.ts)


def text_search(index: DataFrame, total: int, query: list[str]) -> DataFrame:
    """doc, score: sum over the query's terms of tf * idf, tf being a term's share of its document and idf the logarithm
    of all documents over those with the term. Only the query's postings are read."""
    own = of_terms(index, query)
    tf = own.groupBy("term", "doc").agg((F.count(F.lit(1)) / F.max("n_terms")).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # over the same shuffle, so postings are read once
    often = F.create_map(*[F.lit(x) for t in sorted(set(query)) for x in (t, query.count(t))])[F.col("term")] if query else F.lit(1)
    weight = often * F.col("tf") * F.log(F.lit(float(total)) / F.col("df"))
    # As many rows as the query has terms: its size is known before it is broadcast.
    return tf.join(F.broadcast(df), "term").groupBy("doc").agg(F.sum(weight).alias("score"))


def _begins(phrase: list[str]) -> Column:
    """Where the phrase would begin, by each posting; a term that stands in it twice names two places."""
    return F.filter(F.array(*[F.when(F.col("term") == t, F.struct((F.col("pos") - k).alias("begin"), F.lit(k).alias("k"))) for k, t in enumerate(phrase)]), lambda x: x.isNotNull())


def phrase_search(index: DataFrame, query: list[str]) -> DataFrame:
    """doc, places: documents with the terms one behind the other, and how often. One aggregation, no self joins: a place
    counts if all terms agree on where the phrase begins."""
    begun = of_terms(index, query).select("doc", F.explode(_begins(query)).alias("b"))
    full = begun.groupBy("doc", "b.begin").agg(F.count_distinct("b.k").alias("n")).where(F.col("n") == len(query))
    return full.groupBy("doc").agg(F.count(F.lit(1)).alias("places"))


def near_search(index: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """doc, nearest: documents where two terms are at most so many places apart, and how few. Each posting is held against
    the last one of the other term."""
    w = Window.partitionBy("doc").orderBy("pos")
    at = lambda t: F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w)
    if first == second:
        gap = F.col("pos") - F.lag("pos").over(w)
    else:
        gap = F.col("pos") - F.when(F.col("term") == first, at(second)).otherwise(at(first))
    found = of_terms(index, [first, second]).withColumn("gap", gap).groupBy("doc").agg(F.min("gap").alias("nearest"))
    return found.where(F.col("nearest") <= distance)


def boolean_search(index: DataFrame, docs: DataFrame, expr: tuple) -> DataFrame:
    """doc: documents that satisfy an expression: ("term", t), ("phrase", [t, ...]), ("and", e, ...), ("or", e, ...), ("not", e).
    The index is read once for all its terms; `docs`, which has the column doc, only if documents with none of them may
    satisfy it."""
    leaves: list[tuple] = []

    def gather(e: tuple) -> None:
        kind, *args = e
        if kind in ("term", "phrase"):
            leaves.append(e)
        elif kind in ("and", "or", "not"):
            for x in args:
                gather(x)
        else:
            raise ValueError(f"unknown expression: {kind}")

    gather(expr)
    leaf = {id(e): f"l{k}" for k, e in enumerate(leaves)}

    def value(e: tuple) -> Column:
        kind, *args = e
        if kind in ("term", "phrase"):
            return F.coalesce(leaf[id(e)], F.lit(False))
        if kind == "not":
            return ~value(args[0])
        return reduce(lambda a, b: a & b if kind == "and" else a | b, map(value, args))

    def bare(e: tuple) -> bool:
        """What a document without any of the terms gets."""
        kind, *args = e
        return not bare(args[0]) if kind == "not" else False if kind in ("term", "phrase") else (all if kind == "and" else any)(map(bare, args))

    def holds(e: tuple) -> Column:
        if e[0] == "term":
            return F.max(F.col("term") == e[1])
        places = [F.collect_set(F.when(F.col("term") == t, F.col("pos") - k)) for k, t in enumerate(e[1])]
        return F.size(reduce(F.array_intersect, places)) > 0

    own = of_terms(index, [t for e in leaves for t in ([e[1]] if e[0] == "term" else e[1])])
    found = own.groupBy("doc").agg(*[holds(e).alias(leaf[id(e)]) for e in leaves])
    if bare(expr):
        found = docs.select("doc").join(found, "doc", "left")
    return found.where(value(expr)).select("doc")


def fuzzy_search(index: DataFrame, term: str, distance: int = 1) -> DataFrame:
    """doc, term, distance: terms within an edit distance."""
    made = index.select("doc", "term").distinct().withColumn("distance", F.levenshtein(F.col("term"), F.lit(term), distance))
    return made.where((F.col("distance") >= 0) & (F.col("distance") <= distance))


def page(results: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of results, best first, ties by document."""
    return results.orderBy(F.desc("score"), "doc").offset(offset).limit(limit)


def highlight(docs: DataFrame, text: str, query: list[str], width: int = 160) -> DataFrame:
    """docs with `snippet` (around the first hit) and the query's terms set in ** **."""
    if not query:
        return docs.withColumn("snippet", F.substring(F.col(text), 1, width))
    pattern = r"(?i)\b(" + "|".join(query) + r")\b"
    first = F.regexp_instr(F.col(text), F.lit(pattern))
    begin = F.greatest(F.lit(1), first - width // 2)
    return docs.withColumn("snippet", F.regexp_replace(F.substring(F.col(text), begin, F.lit(width)), pattern, "**$1**"))


def document_frequency(index: DataFrame, stemmed_again: bool = False) -> DataFrame:
    """term, df: in how many documents each term is."""
    term = stem(F.col("term")) if stemmed_again else F.col("term")
    return index.select(term.alias("term"), "doc").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
