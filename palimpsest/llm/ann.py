"""Approximate nearest neighbours over balanced posting lists.

A sample that grows with the table is cut, by balanced halving, into clusters; their centroids are joined in a graph that
every executor holds in memory. Each vector goes to the lists of the centroids almost as near as its nearest one, so
vectors on a boundary stand in several lists. A query searches the graph for centroids, keeps the lists whose distance is
within a ratio of the nearest one's, and is compared with what these hold. Batches of vectors search together. Equal
vectors are one class, compared once, whose rows all count as neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rested, ship, written

#: Vectors in one block of a posting list; longer lists have several.
BLOCK = 2048
#: Vectors that the driver fits (coarse) centroids on, and that one task fits finer ones on.
FIT = 16384
#: Sampled vectors for each centroid.
EACH = 32
#: Centroids at most, as every executor holds them: lists grow with tables beyond MOST * list_size vectors.
MOST = 1 << 18


def balanced(x: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Centroids of clusters of at most `size` vectors, by halving along the line between two means."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        v = x[at]
        if len(at) <= size:
            out.append(v.mean(0))
            continue
        a, b = v[rng.choice(len(at), 2, replace=False)]
        for _ in range(8):
            side = ((v - a) ** 2).sum(1) < ((v - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = v[side].mean(0), v[~side].mean(0)
        order = np.argsort(v @ (b - a), kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return np.array(out)


def distances(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of all of q to all of at, but for rounding."""
    return np.maximum((q**2).sum(1)[:, None] + (at**2).sum(1) - 2 * (q @ at.T), 0)


def neighbours(at: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """For centroids given by their numbers, their nearest others and the next in order, which keeps the graph in one
    piece."""
    k = min(degree, len(at) - 1)
    out = np.empty((len(rows), k + 1), np.int32)
    out[:, k] = (rows + 1) % len(at)
    for i in range(0, len(rows), 256):
        own = rows[i : i + 256]
        d = distances(at[own], at)
        d[np.arange(len(own)), own] = np.inf
        if k:
            out[i : i + 256, :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


@dataclass
class Centroids:
    """Centroids, and for each its neighbours; searched best first, a batch of vectors at a time."""

    at: np.ndarray
    near: np.ndarray

    def batch(self) -> int:
        """How many vectors may search together: what each has seen takes 5 bytes a centroid."""
        return int(np.clip((1 << 24) // max(len(self.at), 1), 16, 1024))

    def search(self, q: np.ndarray, most: int, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the `most` nearest centroids found for each vector, and their squared distances, nearest first; -1
        and infinity where there are fewer. Each step looks at the neighbours of the `wide` nearest centroids of the beam
        not looked at yet."""
        q, n = np.asarray(q, np.float32), len(self.at)
        beam = max(beam, most)
        hubs = np.unique(np.linspace(0, n - 1, min(n, 256)).astype(np.int64))
        d = distances(q, self.at[hubs])
        start = np.argsort(d, axis=1, kind="stable")[:, : min(8, len(hubs), beam)]
        rows = np.arange(len(q))[:, None]
        ids, dist = np.full((len(q), beam), -1), np.full((len(q), beam), np.inf, np.float32)
        ids[:, : start.shape[1]], dist[:, : start.shape[1]] = hubs[start], d[rows, start]
        fresh = ids >= 0  # not looked at yet
        seen, turn = np.zeros((len(q), n), bool), np.empty((len(q), n), np.int32)
        seen[rows, hubs[start]] = True
        while True:
            live = np.flatnonzero(fresh.any(1))
            if not len(live):
                break
            waiting = np.where(fresh[live], dist[live], np.inf)
            pick = np.argpartition(waiting, min(wide, beam) - 1, axis=1)[:, : min(wide, beam)]
            ok = np.isfinite(np.take_along_axis(waiting, pick, 1))
            fresh[live[:, None], pick] = False
            r, c = np.nonzero(ok)
            to = self.near[ids[live[r], pick[r, c]]]
            r, to = np.repeat(r, to.shape[1]), to.ravel()
            new = ~seen[live[r], to]
            r, to = r[new], to[new]
            turn[live[r], to] = np.arange(len(r), dtype=np.int32)  # of one seen twice in this step, the last counts
            new = turn[live[r], to] == np.arange(len(r))
            r, to = r[new], to[new]
            seen[live[r], to] = True
            away = ((self.at[to] - q[live[r]]) ** 2).sum(1)
            # Into the beam: what is new, padded to the widest row.
            count = np.bincount(r, minlength=len(live))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more = np.full((len(live), count.max(initial=0)), -1), np.full((len(live), count.max(initial=0)), np.inf, np.float32)
            more_ids[r, place], more[r, place] = to, away
            all_d = np.concatenate([dist[live], more], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], more_ids], 1), best, 1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], more_ids >= 0], 1), best, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _vectors(col: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, a, b) of the rows that take part: with an id, not null, not zero, all components finite. a and b name
    equal vectors, by 128 bits."""
    kind = "array<float>" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "array<double>"
    v = F.col(embedding).cast(kind)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = F.col(vec_id).isNotNull() & finite & F.exists(v, lambda x: x != 0)
    zero = F.transform(v, lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind)  # no negative zeros
    some = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), zero.alias("v"))
    return some.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))


@dataclass
class Index:
    """lists: (list, blocks, a, b, vid, v), blocks being how many blocks the list has; blocks: (list, blocks), one row for
    each list; classes: (a, b, vec_id, copy), the k + 1 least ids of each class of equal vectors, vid being the very least;
    copy numbers rows that share the id too."""

    centroids: Centroids
    lists: DataFrame
    blocks: DataFrame
    classes: DataFrame
    width: int
    k: int


def _sampled(classes: DataFrame, share: float) -> DataFrame:
    return classes if share >= 1 else classes.where(F.pmod(F.col("b"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(classes: DataFrame, total: int, width: int, list_size: int) -> np.ndarray:
    """Centroids, one for list_size classes, up to MOST. Up to FIT / EACH of them the driver fits on FIT classes at most,
    chosen by their hash; of more, it fits coarse ones, and tasks fit those of each coarse cell on EACH classes for each
    centroid, a cell in parts of FIT."""
    spark = classes.sparkSession
    vectors = lambda df: (lambda t: _vectors(t.column("v").combine_chunks(), width, np.float32) if t.num_rows else np.zeros((0, width), np.float32))(df.select("v").toArrow())
    x = vectors(_sampled(classes, FIT / max(total, 1)).orderBy("b", "a"))
    want = min(max(total // list_size, 1), MOST)
    if want * EACH <= FIT or len(x) == total:
        return balanced(x, max(1, -(-len(x) // want))) if len(x) else x
    coarse = balanced(x, max(1, len(x) * 256 // want))
    share = min(1.0, want * EACH / total)
    held = spark.sparkContext.broadcast(coarse)

    @rested
    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = distances(_vectors(b.column("v"), width, np.float32), held.value).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), b.column("a"), b.column("v")], names=["cell", "a", "v"])

    cells = written(_sampled(classes, share).select("a", "v").mapInArrow(cell, f"cell long, a long, v {classes.schema['v'].dataType.simpleString()}"), "cells")
    parts = written(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FIT).cast("long").alias("parts")), "parts")
    group = cells.join(F.broadcast(parts), "cell").withColumn("part", F.pmod("a", "parts"))  # one row a coarse centroid, FIT at most

    def finer(t: pa.Table) -> pa.Table:
        made = balanced(_vectors(t.column("v").combine_chunks(), width, np.float32), EACH)
        return pa.table({"v": pa.array(list(made.astype(np.float32)), pa.list_(pa.float32()))})

    return vectors(group.groupBy("cell", "part").applyInArrow(finer, "v array<float>"))


def graph(spark, at: np.ndarray, degree: int = 24) -> Centroids:
    """Centroids joined to their nearest ones; where there are many, tasks look for these."""
    if len(at) <= 4096:
        return Centroids(at, neighbours(at, np.arange(len(at)), degree) if len(at) else np.zeros((0, 1), np.int32))
    held = spark.sparkContext.broadcast(at)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("id").to_numpy()
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(neighbours(held.value, rows, degree)), pa.list_(pa.int32()))], names=["id", "near"])

    t = spark.range(len(at)).mapInArrow(run, "id long, near array<int>").toArrow().sort_by("id")
    return Centroids(at, t.column("near").combine_chunks().flatten().to_numpy().reshape(len(at), -1))


def build(vectors: DataFrame, k: int, list_size: int = 256, closure: float = 1.15, copies: int = 6) -> Index:
    """An index for up to k neighbours over usable vectors of one width. Every vector is indexed, in up to `copies` lists
    whose centroids are within `closure` times the distance of its nearest one."""
    spark = ship(vectors.sparkSession)
    # k + 1 least ids of equal vectors: a query may be one of them. Ranked before the shuffle too, so none gathers a group.
    w = Window.partitionBy("a", "b").orderBy("vec_id")
    ranked = written(vectors.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1), "classes")
    classes = ranked.select("a", "b", "vec_id", F.row_number().over(Window.partitionBy("a", "b", "vec_id").orderBy("n")).alias("copy"))
    single = ranked.where("n = 1").select("a", "b", F.col("vec_id").alias("vid"), "v")
    one = single.agg(F.count(F.lit(1)).alias("total"), F.max(F.size("v")).alias("width")).first()
    width, kind = one.width or 0, vectors.schema["v"].dataType.simpleString()
    centroids = graph(spark, fit(single, one.total, width, list_size))
    held = spark.sparkContext.broadcast(centroids)

    @rested
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, c.batch()):
                b = batch.slice(at, c.batch())
                lists, d = c.search(_vectors(b.column("v"), width, np.float32), copies, 16)
                row, place = np.nonzero(np.isfinite(d) & (d <= closure**2 * d[:, :1] + 1e-12))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, place].astype(np.int64)), *(b.column(n).take(take) for n in ("a", "b", "vid", "v"))], names=["list", "a", "b", "vid", "v"])

    lists = written(single.mapInArrow(assign, f"list long, a long, b long, vid long, v {kind}"), "lists")
    blocks = written(lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "blocks")
    return Index(centroids, lists, blocks, classes, width, k)


def search(index: Index, queries: DataFrame, k: int, probes: int = 48, ratio: float = 1.6, least: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, v, a, b), its own row left out, by Euclidean
    distance in double precision; ties go to the smaller vec_id. The `least` nearest lists are read, and of the next ones,
    up to `probes`, those whose centroid is within `ratio` times the distance of the nearest."""
    if k > index.k:
        raise ValueError("the index was built for fewer neighbours")
    spark, width = queries.sparkSession, index.width
    held = spark.sparkContext.broadcast(index.centroids)
    kind = queries.schema["v"].dataType.simpleString()
    own = ["query_id", "qa", "qb"]

    @rested
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches if len(c.at) else ():
            for at in range(0, batch.num_rows, c.batch()):
                b = batch.slice(at, c.batch())
                lists, d = c.search(_vectors(b.column("v"), width, np.float32), probes, 2 * probes)
                near = np.isfinite(d) & ((d <= ratio**2 * d[:, :1] + 1e-12) | (np.arange(d.shape[1]) < least))
                row, place = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, place].astype(np.int64)), *(b.column(n).take(take) for n in ("vec_id", "a", "b", "v"))], names=["list", *own, "q"])

    asked = queries.groupBy("vec_id", "a", "b").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    asked = written(asked, "queries")
    times = asked.select(F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"), "times")
    asked = written(asked.select("vec_id", "a", "b", "v").mapInArrow(probe, f"list long, query_id long, qa long, qb long, q {kind}"), "probes")
    # Every block of a list meets every block of its queries; both are of bounded size, however many ask for one list.
    shares = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("shares"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sizes = written(index.blocks.join(shares, "list"), "sizes")
    left = index.lists.join(sizes, "list").withColumn("block", F.pmod("a", "blocks")).withColumn("share", every("shares"))
    right = asked.join(sizes, "list").withColumn("share", F.pmod(F.xxhash64(*own), "shares")).withColumn("block", every("blocks"))
    part = ["list", "block", "share"]
    keep = k + 1  # a query may meet itself
    columns = [*own, "a", "b", "vid"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in [*columns, "score"]})
        v, q = (_vectors(t.column(n).combine_chunks(), width) for t, n in ((left, "v"), (right, "q")))
        near, vid = distances(q, v), left.column("vid").to_numpy()
        if len(v) > keep:  # what rounding may hide is let through, and measured exactly
            slack = 1e-9 * ((q**2).sum(1) + (v**2).sum(1).max())
            row, at = np.nonzero(near <= (np.partition(near, keep - 1, axis=1)[:, keep - 1] + slack)[:, None])
        else:
            row, at = (x.ravel() for x in np.indices(near.shape))
        score = np.concatenate([np.sqrt(np.cumsum((v[at[i : i + 65536]] - q[row[i : i + 65536]]) ** 2, axis=1)[:, -1]) for i in range(0, len(at), 65536)])
        order = np.lexsort((vid[at], score, row))
        row, at, score = row[order], at[order], score[order]
        first = np.searchsorted(row, row)
        some = np.arange(len(row)) - first < keep
        row, at, score = row[some], at[some], score[some]
        cols = [right.column(n).to_numpy()[row] for n in own] + [left.column(n).to_numpy()[at] for n in ("a", "b", "vid")]
        return pa.table(dict(zip([*columns, "score"], [*cols, score])))

    left, right = left.select(*part, "a", "b", "vid", "v"), right.select(*part, *own, "q")
    met = left.groupBy(*part).cogroup(right.groupBy(*part)).applyInArrow(compare, ", ".join(f"{n} long" for n in columns) + ", score double")
    best = Window.partitionBy(*own).orderBy("score", "vid")
    met = met.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")
    near = met.join(index.classes, ["a", "b"]).where("not (a = qa and b = qb and vec_id = query_id and copy = 1)")
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("score", "vec_id"))
    near = near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).join(times, own)
    # Rows that share both id and vector have an answer each.
    near = near.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return near.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest others of each row whose id is divisible by `every`.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those without an id
    or of another width than most; with fewer than k candidates all are returned. Every row is a candidate but the
    query's own: rows that share an id, or the vector too, are neighbours of each other, and each has its answer. An empty
    table gives no rows. Other columns are ignored.
    """
    good = usable(vectors, vec_id, embedding)
    width = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    good = good.where(F.size("v") == (width.w if width else 0))
    return search(build(good, k), good.where(F.col("vec_id") % every == 0), k)


def brute(rows: list[tuple], every: int, k: int) -> list[tuple]:
    """(query_id, rank, vec_id, score) by comparing all; for tests."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = []
    for own, (q, v) in enumerate(good):
        if q % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            at = [a for a in np.lexsort((ids, d)) if a != own][:k]
            out += [(int(q), n + 1, int(ids[a]), float(d[a])) for n, a in enumerate(at)]
    return out
