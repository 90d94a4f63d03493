"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors become integers, floor(scale * x). Candidates are laid out vertically, dimension by
dimension, in groups of bounded size; queries come in chunks. Each pair of chunk and group adds up
scores one block of dimensions at a time. What the remaining dimensions can still add is at most the
product of the remaining norms, so candidates that cannot reach a query's k-th best score so far are
dropped and the survivors compacted before the next block.

The queries are a stated part of the rows and meet every candidate, in blocks: a group of candidates
is sent to each chunk of queries once, and only k rows per query and group come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.llm.vectors import matrix, usable
from sensorcast.staging import stage

CHUNK = 512  # queries that are searched together
GROUP = 65_536  # candidates in a group
TILE = 4_096  # candidates whose scores are held at a time
STEP = 16  # dimensions in a block


def quantise(vector: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 32 bits, or 64 where a component needs them."""
    whole = np.floor(scale * vector)
    top = np.abs(whole).max()
    if not top < 2.0**62:
        raise OverflowError("a component is too large for a whole number of 64 bits")
    return whole.astype(np.int32 if top < 2.0**31 else np.int64)


def whole_matrix(cells, dim: int) -> np.ndarray:
    """Rows from their bytes, whatever their width."""
    cells = list(cells)
    if all(len(c) == 4 * dim for c in cells):
        return matrix(cells, dim, "<i4")
    return np.array([np.frombuffer(c, f"<i{len(c) // dim}") for c in cells], np.int64)


def _reach(score: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """What a score can come to at most, with room for rounding."""
    score = score.astype(float)
    return score + np.abs(score) * 1e-14 + bound * (1 + 1e-9) + 1e-6


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.floor = np.full(queries, np.iinfo(np.int64).min)

    def add(self, rows, scores, ids) -> None:
        rows, scores, ids = (np.concatenate(x) for x in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, rows, "left")
        rank = np.arange(len(rows)) - first
        kept = rank < self.k
        full = rank == self.k - 1
        self.floor[rows[full]] = scores[full]
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]


def search(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """``queries`` is (queries, dimensions), ``columns`` the candidates' (dimensions, candidates)."""
    dim = len(columns)
    # Doubles add whole numbers exactly below 2**53 and are multiplied fast; beyond, 64-bit integers, or any.
    top = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(columns).max(initial=0), 1)) * dim
    kind = np.float64 if top < 2.0**52 else np.int64 if top < 2.0**62 else object
    order = np.argsort(-np.square(queries.astype(float)).sum(axis=0), kind="stable")
    queries, columns = queries[:, order].astype(kind), columns[order].astype(kind)
    blocks = [slice(at, min(at + STEP, dim)) for at in range(0, dim, STEP)]
    own = np.square(queries.astype(float))
    others = np.square(columns.astype(float))
    best = Best(len(queries), k)
    for at in range(0, columns.shape[1], TILE):
        tile, names = columns[:, at : at + TILE], ids[at : at + TILE]
        mass = others[:, at : at + TILE]
        score = np.zeros((len(queries), tile.shape[1]), kind)
        pairs = None
        floor = np.where(best.floor > np.iinfo(np.int64).min, best.floor.astype(float), -np.inf)
        for block in blocks:
            rest = slice(block.stop, dim)
            if pairs is None:
                score += queries[:, block] @ tile[block]
                bound = np.sqrt(own[:, rest].sum(axis=1))[:, None] * np.sqrt(mass[rest].sum(axis=0))[None, :]
                alive = _reach(score, bound) >= floor[:, None]
                columns_alive = alive.any(axis=0)
                if columns_alive.mean() < 0.5:
                    tile, mass, names = tile[:, columns_alive], mass[:, columns_alive], names[columns_alive]
                    score, alive = score[:, columns_alive], alive[:, columns_alive]
                if block.stop == dim or alive.mean() < 0.1:
                    pairs = np.nonzero(alive)
                    held = score[pairs]
            else:
                q, c = pairs
                held = held + (queries[q, block] * tile[block, :].T[c]).sum(axis=1)
                bound = np.sqrt(own[:, rest].sum(axis=1))[q] * np.sqrt(mass[rest].sum(axis=0))[c]
                alive = _reach(held, bound) >= floor[q]
                pairs, held = (q[alive], c[alive]), held[alive]
        q, c = pairs
        other = names[c] != query_ids[q]
        if kind is object and any(not -(1 << 63) <= v < 1 << 63 for v in held[other]):
            raise OverflowError("a score is too large for a long")
        best.add(q[other], held[other].astype(np.int64), names[c][other])
    return best


def _rows(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, data) of the usable rows; data holds integers of 32 or 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = usable(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([n for n, _ in found], pa.int64())),
                    pa.array([len(v) for _, v in found], pa.int32()),
                    pa.array([quantise(v, scale).tobytes() for _, v in found], pa.binary()),
                ],
                names=["vec_id", "dim", "data"],
            )

    columns = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    return embeddings.select(*columns).filter("vec_id is not null").mapInArrow(run, "vec_id long, dim int, data binary")


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all other vectors.

    ``is_query`` is a condition on vec_id. Null vectors, empty ones and those with null or non-finite
    components take no part, nor do rows without vec_id; only vectors of equal length are compared.
    Fewer than k others give fewer rows, none give none, ties go to the smaller vec_id. Each repeated
    row is a candidate of its own, rows with the query's vec_id are not; repeated query rows give
    their result once, and a vec_id with different vectors gives the best over them. Components and scores of any
    size are exact; one that a long cannot hold is an error. Other columns are ignored; an empty table gives no rows.
    """
    rows = stage(_rows(embeddings, scale), "vectors")
    queries = rows.filter(is_query)
    sizes = (
        rows.groupBy("dim")
        .agg(F.count("*").alias("candidates"), F.count_if(is_query).alias("queries"))
        .select(
            "dim",
            F.ceil(F.col("candidates") / GROUP).cast("int").alias("groups"),
            F.ceil(F.col("queries") / CHUNK).cast("int").alias("chunks"),
        )
        .filter("chunks > 0")
    )
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = (
        rows.join(sizes, "dim")
        .select("vec_id", "dim", "data", place("groups").alias("part"), "chunks")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks")
    )
    right = (
        queries.join(sizes, "dim")
        .select(F.col("vec_id").alias("query_id"), F.col("dim").alias("q_dim"), F.col("data").alias("query"), place("chunks").alias("q_chunk"), "groups")
        .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .drop("groups")
    )

    def pair(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(candidates) or not len(asked):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        asked = asked.drop_duplicates(["query_id", "query"])
        dim = int(asked["q_dim"].iloc[0])
        query_ids = asked["query_id"].to_numpy()
        columns = np.ascontiguousarray(whole_matrix(candidates["data"], dim).T)
        best = search(whole_matrix(asked["query"], dim), query_ids, columns, candidates["vec_id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(names, (query_ids[best.rows], best.ids, best.scores))))

    asked = right.groupBy("q_dim", "q_part", "q_chunk")
    found = left.groupBy("dim", "part", "chunk").cogroup(asked).applyInPandas(
        pair, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
