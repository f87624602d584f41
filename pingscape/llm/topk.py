"""Exact top-k inner products of a query set against all vectors, longest vectors first.

Vectors are whole numbers, so scores are exact. All vectors are rotated to the axes of their second-moment matrix
(the right singular vectors of the table), which puts most of a product into the first axes: the sum over these plus
the product of what is left of both lengths is, by Cauchy-Schwarz, never below the whole product. Vectors come by
descending length; a query's k-th best score so far prunes first whole blocks, by length alone, then single vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import stored, tasks

BLOCK_ROWS, QUERY_ROWS, HEAD_ROWS = 4096, 2048, 1024
#: Products in doubles are exact below this.
EXACT = float(2**52)
#: Stands for no score yet; real scores are above.
NONE = -(2**62)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, one row per vec_id; see `top_k` for what takes no part."""
    x = F.col("`embedding`").cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good
    )
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return rows.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    edges, flat = column.offsets.to_numpy(), column.values.to_numpy()
    length = np.diff(edges)
    if len(length) and (length == width).all():
        return flat[edges[0] : edges[-1]].reshape(-1, width)
    out = np.zeros((len(length), width), np.int64)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of all outer products; width * width numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "x"])

    parts = rows.select("v").mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in parts:
        out[r["i"]] = r["x"]
    return out.reshape(width, width)


def _packed(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows in their order as blocks: (longest, ids, vectors), both as binary 64-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
            return pa.RecordBatch.from_arrays(
                [pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())],
                names=["longest", "ids", "vectors"],
            )

        ids, held = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            held = np.concatenate([held, _matrix(batch.column(1), width)])
            while len(ids) >= size:
                yield block(ids[:size], held[:size])
                ids, held = ids[size:], held[size:]
        if len(ids):
            yield block(ids, held)

    return rows.select("vec_id", "v").mapInArrow(pack, "longest double, ids binary, vectors binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Search:
    """A block of queries with the k best found so far and the bounds that prune."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, near: int, k: int):
        self.ids, self.q, self.k, self.axes, self.near = ids, vectors, k, axes, near
        self.f = vectors.astype(float)
        turned = self.f @ axes
        self.head, self.length = turned[:, :near], np.sqrt((self.f**2).sum(1))
        self.rest = np.sqrt((turned[:, near:] ** 2).sum(1))
        self.found_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found = np.full((len(ids), k), NONE, np.int64)

    def least(self) -> np.ndarray:
        """The score a vector must reach to matter: the k-th best so far."""
        return np.where(self.found[:, -1] == NONE, -np.inf, self.found[:, -1].astype(float))

    def needed_length(self) -> float:
        """Below this length no vector can be among the best of any query of the block."""
        least = self.least()
        if (least <= 0).any():
            return 0.0
        return float((least / self.length).min()) * (1 - 1e-9)

    def look(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        m = vectors.astype(float)
        length = np.sqrt((m**2).sum(1))
        if length.max(initial=0) < self.needed_length():
            return
        turned = m @ self.axes
        rest = np.sqrt((turned[:, self.near :] ** 2).sum(1))
        slack = 0.5 + 1e-9 * (1 + float(self.length.max(initial=0)) * float(length.max(initial=0)))
        exact = float(self.length.max(initial=0)) * float(length.max(initial=0)) < EXACT
        least = self.least()
        for a in range(0, len(self.ids), 256):
            rows = slice(a, a + 256)
            bound = self.head[rows] @ turned[:, : self.near].T
            bound += np.outer(self.rest[rows], rest) + slack
            alive = bound >= least[rows, None]
            alive &= self.ids[rows, None] != ids[None, :]
            some = np.flatnonzero(alive.any(0))
            if not len(some):
                continue
            scores = (self.f[rows] @ m[some].T).astype(np.int64) if exact else self.q[rows] @ vectors[some].T
            for i in np.flatnonzero(alive.any(1)).tolist():
                own = np.flatnonzero(alive[i, some])
                better = own[scores[i, own] >= self.found[a + i, -1]]
                if len(better):
                    s = np.concatenate([self.found[a + i], scores[i, better]])
                    d = np.concatenate([self.found_ids[a + i], ids[some[better]]])
                    top = _best(s, d, self.k)
                    self.found[a + i], self.found_ids[a + i] = s[top], d[top]

    def rows(self) -> pa.RecordBatch:
        real = self.found_ids != np.iinfo(np.int64).max
        query = np.repeat(self.ids, self.k).reshape(-1, self.k)
        return pa.RecordBatch.from_arrays(
            [pa.array(query[real]), pa.array(self.found_ids[real]), pa.array(self.found[real])], names=["query_id", "vec_id", "score"]
        )


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best whole-number inner products of every query: (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows with another vec_id; ties go to the
    smaller vec_id, and a query with fewer candidates returns all. Rows with a null id, a null vector, or null or
    non-finite components take no part. Rows that repeat a vec_id are one vector, the smallest in array order. A
    shorter vector counts as filled up with zeros. Empty tables, or none left, give an empty result. Scores must fit
    64-bit numbers. Other columns are not read.
    """
    rows = stored(whole_vectors(vectors, scale))
    kind = "query_id long, rank int, vec_id long, score long"
    width, queries = rows.agg(F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not width or not queries:
        return spark.createDataFrame([], kind)
    axes = np.linalg.eigh(moments(rows, width))[1][:, ::-1]
    near = max(1, width // 4)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")).alias("norm")
    sized = rows.withColumn("norm", norm)
    longest = sized.orderBy(F.desc("norm"), "vec_id").limit(HEAD_ROWS).collect()  # HEAD_ROWS vectors at most
    head_ids = np.array([r["vec_id"] for r in longest], np.int64)
    head = np.zeros((len(longest), width), np.int64)
    for i, r in enumerate(longest):
        head[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast((axes, head_ids, head))

    def searched(row: dict) -> Search:
        axes, head_ids, head = shared.value
        ids = np.frombuffer(row["ids"], np.int64)
        search = Search(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1), axes, near, k)
        search.look(head_ids, head)
        return search

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                search = searched(row)
                name = int(search.ids.min())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([search.needed_length()]), pa.array([row["ids"]], pa.binary()), pa.array([row["vectors"]], pa.binary())],
                    names=["name", "needed", "ids", "vectors"],
                )

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, search = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if search is not None:
                        yield search.rows()
                    name, search = row["name"], searched({"ids": row["ids"], "vectors": row["vectors"]})
                ids = np.frombuffer(row["c_ids"], np.int64)
                search.look(*_without(ids, np.frombuffer(row["c_vectors"], np.int64).reshape(len(ids), -1), shared.value[1]))
        if search is not None:
            yield search.rows()

    parts = -(-queries // QUERY_ROWS)
    asked = sized.filter(F.col("vec_id") % every == 0).repartitionByRange(parts, "vec_id")
    asked = stored(_packed(asked, width, QUERY_ROWS).mapInArrow(begin, "name long, needed double, ids binary, vectors binary"))
    by_length = sized.repartitionByRange(tasks(rows), F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = stored(_packed(by_length, width, BLOCK_ROWS).withColumnsRenamed({"ids": "c_ids", "vectors": "c_vectors"}))
    names = asked.select("name", "needed").collect()  # two numbers per QUERY_ROWS queries
    wanted = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["needed"]).alias("needed")) for r in names])
    meets = F.explode(F.filter(wanted, lambda q: q["needed"] <= F.col("longest")))
    pairs = blocks.withColumn("q", meets).select(F.col("q.name").alias("name"), "longest", "c_ids", "c_vectors").join(asked, "name")
    place = F.xxhash64("name", "c_ids")
    dealt = pairs.withColumn("place", place).repartition("place").sortWithinPartitions("name", F.desc("longest"))
    found = dealt.select("name", "ids", "vectors", "c_ids", "c_vectors").mapInArrow(search_blocks, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _without(ids: np.ndarray, vectors: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = ~np.isin(ids, seen)
    return ids[new], vectors[new]
