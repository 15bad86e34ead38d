"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Unit vectors are assigned to the nearest of a set of coarse centroids; what is left of
them is quantised part by part. A query looks into the lists of its nearest centroids,
as many as the sample needs to find ``RECALL`` of its own nearest neighbours there: few
where vectors cluster, many where they are spread evenly. It ranks their members by look-ups in
tables of its products with the quantised parts (asymmetric distances).

The nearest lists are searched first; the k-th best exact score found there is the
query's floor. In the other lists a member is reranked exactly, in double precision,
if its approximate score, with the error that its own quantisation leaves, reaches the
floor. So the number reranked follows from the vectors and has no cap: the members of a
group of near copies, whose codes coincide, are all reranked.

Lists are cut into chunks of bounded size by a hash of the row. A chunk's members come
first in its task and are held, its queries follow in batches and are not, so no list,
however full or sought, is gathered or copied. The centroids are fitted on a bounded
sample; every valid row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialize

K = 5
#: Vectors that the centroids are fitted on, at most: those of least hash of the id; how
#: many of them ask for the number of lists, and the share of their neighbours to be found.
SAMPLE = 20_000
ASKERS = 500
RECALL = 0.96
#: Coarse lists: the square root of the rows, at most this.
MAX_LISTS = 1024
#: Rows that a query's first lists must hold together, if there are so many.
LEAST_ROWS = 250
#: Parts of a residual, values of each, and members of a list reranked for a first floor.
PARTS = 16
VALUES = 256
FIRST = 16
#: Standard deviations of an approximate score's error within which a member is reranked.
DEVIATIONS = 2.5
CHUNK_ROWS = 8192
#: Queries whose scores are worked out at once.
TOGETHER = 64
ROUNDS = 15
#: More than what double precision loses in a product of unit vectors.
ROUNDING = 1e-9


class Index(NamedTuple):
    """Coarse centroids, the parts' values, and the members and chunks of each list."""

    coarse: np.ndarray  # lists x dimensions
    cuts: np.ndarray  # bounds of the parts
    values: list[np.ndarray]  # part: values x its dimensions
    probes: int  # lists that a query looks into
    sizes: np.ndarray  # rows of each list
    chunks: np.ndarray  # parts that each is cut into


def valid(vector: Column, dimensions: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dimensions) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    d = (centre**2).sum(axis=1) - 2 * (x @ centre.T)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit(x: np.ndarray, rows: int, k: int = K, recall: float = RECALL, seed: int = 3) -> Index:
    """Centroids and part values for unit vectors ``x`` sampled from ``rows`` rows, and the
    number of lists that hold ``recall`` of the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(MAX_LISTS, round(np.sqrt(rows)), len(x) // 16)))
    coarse = _kmeans(x, lists, rng)
    own = nearest(x, coarse, 1)[:, 0]
    rest = x - coarse[own]
    d = x.shape[1]
    cuts = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
    values = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(VALUES, len(x)), rng) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Index(coarse, cuts, values, _probes_needed(x, coarse, own, k, recall), np.zeros(lists, np.int64), np.ones(lists, np.int64))


def _probes_needed(x: np.ndarray, coarse: np.ndarray, own: np.ndarray, k: int, recall: float) -> int:
    """How many of a vector's nearest lists hold ``recall`` of its k nearest in the sample.

    Neighbours in a sample are further away than in all rows, so this is rather too many.
    """
    asks = np.linspace(0, len(x) - 1, min(ASKERS, len(x))).astype(int)
    k = min(k, len(x) - 1)
    if not k:
        return 1
    near = x[asks] @ x.T
    near[np.arange(len(asks)), asks] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = nearest(x[asks], coarse, len(coarse))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(coarse))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List and part values of each unit vector, and the length of what they leave."""
    near = nearest(x, index.coarse, 1)[:, 0]
    rest = x - index.coarse[near]
    codes, left = [], rest.copy()
    for a, b, v in zip(index.cuts, index.cuts[1:], index.values, strict=False):
        codes.append(nearest(rest[:, a:b], v, 1)[:, 0])
        left[:, a:b] -= v[codes[-1]]
    return near, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((left * left).sum(axis=1))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, in double precision, row by row alike."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


_ROW = "list int, chunk int, query boolean, rid long, id long, floor double, error double, code binary, vector array<{}>"


def _index_rows(index: Index, d: int):
    """Each row's list, code and error, beside the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), d)
            if len(x):
                near, codes, error = encode(index, _unit(x))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns[:3], pa.array(error), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(3)], names=["list", "rid", "id", "asks", "error", "code", "vector"])

    return run


def _probes(index: Index, d: int, first: bool):
    """A row for each chunk that a query looks into: of its first lists, or of its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = index.chunks
        for batch in batches:
            x = _matrix(batch.column(3), d)
            if not len(x):
                continue
            order = nearest(_unit(x), index.coarse, len(index.coarse))
            head = np.minimum((np.cumsum(index.sizes[order], axis=1) < LEAST_ROWS).sum(axis=1) + 1, len(index.coarse))
            at = [order[r, :n] if first else order[r, n : max(n, index.probes)] for r, n in enumerate(head.tolist())]
            row = np.repeat(np.arange(len(x)), [int(chunks[a].sum()) for a in at])
            lists = np.concatenate([np.repeat(a, chunks[a]) for a in at])
            piece = np.concatenate([np.arange(c) for a in at for c in chunks[a]] or [np.zeros(0, np.int64)])
            for a in range(0, len(row), 8192):
                some = row[a : a + 8192]
                same = pa.array(some)
                columns = [pa.array(lists[a : a + 8192].astype(np.int32)), pa.array(piece[a : a + 8192].astype(np.int32)), pa.array(np.ones(len(some), bool))]
                columns += [batch.column(0).take(same), batch.column(1).take(same), batch.column(2).take(same), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.binary()), batch.column(3).take(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "chunk", "query", "rid", "id", "floor", "error", "code", "vector"])

    return run


class _Chunk:
    """The members of one chunk, and the search among them."""

    def __init__(self, index: Index, place: int, rows: list[pa.RecordBatch], d: int):
        table = pa.Table.from_batches(rows)
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        self.index, self.rid, self.id = index, table.column("rid").to_numpy()[order], table.column("id").to_numpy()[order]
        self.x = np.concatenate([_matrix(c, d) for c in table.column("vector").chunks])[order]
        self.codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        error = table.column("error").to_numpy()[order]
        # a vector's product with one near itself is short by the square of what its code
        # leaves; with others the error is as of a random direction
        self.margin = error * (error + DEVIATIONS / np.sqrt(d)) + ROUNDING
        self.centre = index.coarse[place]

    def approximate(self, u: np.ndarray) -> np.ndarray:
        """Scores of all members for some unit queries, by tables of the queries' products."""
        near = np.broadcast_to(u @ self.centre, (len(self.id), len(u))).copy()
        for j, (a, b) in enumerate(zip(self.index.cuts, self.index.cuts[1:], strict=False)):
            near += (self.index.values[j] @ u[:, a:b].T)[self.codes[:, j]]
        return near.T

    def search(self, rid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, counts: list) -> Iterator[tuple]:
        for a in range(0, len(rid), TOGETHER):
            for one, v, least, near in zip(rid[a : a + TOGETHER], q[a : a + TOGETHER], floor[a : a + TOGETHER], self.approximate(_unit(q[a : a + TOGETHER])), strict=True):
                near[self.rid == one] = -np.inf
                best, s = np.zeros(0, np.int64), np.zeros(0)
                if np.isneginf(least):
                    best = np.argpartition(-near, min(FIRST, len(near)) - 1)[:FIRST]
                    best = best[~np.isneginf(near[best])]
                    s = cosine(v, self.x[best])
                    least = np.partition(s, -k)[-k] if len(s) >= k else least
                open_ = near + self.margin >= least - ROUNDING
                open_[best] = False
                open_ &= ~np.isneginf(near)
                more = np.flatnonzero(open_)
                best, s = np.concatenate((best, more)), np.concatenate((s, cosine(v, self.x[more])))
                counts[0] += len(near)
                counts[1] += len(best)
                top = np.lexsort((self.rid[best], self.id[best], -s))[:k]
                if len(top):
                    yield np.full(len(top), one), self.id[best][top], self.rid[best][top], s[top]


def _search(index: Index, d: int, k: int):
    """Streams sorted rows: a chunk's members, which are held, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, chunk, counts = [], None, None, [0, 0]
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]), [True]))) if len(keys) else []
            for a, b in zip(edge, edge[1:], strict=False):
                part = batch.slice(a, b - a)
                if keys[a] != now:
                    held, now, chunk = [], keys[a], None
                if not asks[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                chunk = chunk or _Chunk(index, int(keys[a] >> 32), held, d)
                floor = np.nan_to_num(part.column(5).to_numpy(zero_copy_only=False), nan=-np.inf, neginf=-np.inf)
                out = list(chunk.search(part.column(3).to_numpy(), _matrix(part.column(8), d), floor, k, counts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rid", "vec_id", "vec_rid", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([counts[0]]), pa.array([counts[1]]), pa.array([0.0])], names=["rid", "vec_id", "vec_rid", "score"])

    return run


def _best(met: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id", "vec_rid"))
    return met.where("rid >= 0").withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, counts: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by cosine.

    ``queries`` says which rows are queries; all valid rows but the query's own are its
    candidates. A query gets k rows, or all there are. Ties go to the smaller id. Vectors
    of any numeric type, in double precision; those that are null, zero, of
    another length than most, or that hold null or non-finite components take no part,
    nor do null ids. Rows that repeat an id are candidates, and queries, each by itself.
    An empty table gives no rows; other columns are ignored. ``counts``, where given,
    gets the lists, those looked into, and the members scored and reranked.
    """
    fresh(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.where("id is not null and size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    d = lengths["d"]
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vector"), d))
    n = rows.count()
    if not n:
        return empty
    got = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).toArrow().column(0).combine_chunks()
    index = fit(_unit(_matrix(got, d)), n, k, recall)
    stored = materialize(rows.mapInArrow(_index_rows(index, d), f"list int, rid long, id long, asks boolean, error double, code binary, vector array<{kind}>"), "ann-index")
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in stored.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    index = index._replace(sizes=sizes, chunks=np.maximum(1, -(-sizes // CHUNK_ROWS)))
    chunks = F.element_at(F.array(*(F.lit(int(c)) for c in index.chunks)), F.col("list") + 1)
    names = [f.split()[0] for f in _ROW.split(", ")]
    members = stored.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")).withColumn("query", F.lit(False)).withColumn("floor", F.lit(None).cast("double")).select(*names)
    asked = stored.where("asks").select("rid", "id", F.lit(None).cast("double").alias("floor"), "vector")

    def met(asking: DataFrame, first: bool, label: str) -> DataFrame:
        probes = asking.mapInArrow(_probes(index, d, first), _ROW.format(kind))
        both = members.unionByName(probes).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "query", "rid")
        return materialize(both.mapInArrow(_search(index, d, k), "rid long, vec_id long, vec_rid long, score double"), label)

    near = met(asked, True, "ann-first")
    floors = _best(near, k).groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("rid", F.when(F.col("n") == k, F.col("least")).alias("floor"))
    far = met(asked.drop("floor").join(floors, "rid", "left").select("rid", "id", "floor", "vector"), False, "ann-others")
    if counts is not None:
        scored = near.unionByName(far).where("rid < 0").agg(F.sum("vec_id").alias("a"), F.sum("vec_rid").alias("b")).first()
        counts |= {"lists": len(sizes), "probes": index.probes, "scored": scored["a"], "reranked": scored["b"]}
    found = _best(near.unionByName(far), k)
    ids = asked.select("rid", F.col("id").alias("query_id"))
    return found.join(ids, "rid").select("query_id", "rank", "vec_id", "score")
