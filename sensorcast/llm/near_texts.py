"""Near-duplicate texts by SuperMinHash.

Each document becomes the set of its word shingles. Texts with equal sets are one class and only its
smallest doc_id goes on. A signature of correlated permutation ranks puts classes into bands; classes that
meet in a band, directly or through others, form a cluster outside of which no link is sought.
Inside a cluster the full sets are compared: clusters are cut into blocks of bounded size, a task gets
two blocks, finds pairs through their rarest shingles (two sets that are similar enough share one of
them), confirms them on the full sets and joins them by union-find, skipping pairs that are already
connected. Tasks return spanning forests, which are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sensorcast.llm.components import components
from sensorcast.llm.words import Memo, doc_columns, hash_memo, mix, windows, word_hashes
from sensorcast.staging import stage

WORDS = 5
BANDS, ROWS = 25, 5  # at similarity 0.85 a pair misses all bands with probability 4e-7
BLOCK = 1_500  # texts in a block
BLOCK_SHINGLES = 1_000_000  # shingles in a block, about
BROADCAST = 500_000  # cluster members that are sent to all tasks; more are joined by shuffling


def shingle_set(text: str | None, memo: Memo, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(found, memo), min(words, len(found))))


def super_min_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Signature of a set of distinct hashes.

    Each element walks through its own random permutation of the slots and offers slot p[j] the value
    j + r. Once all slots hold less than the next j, no element can lower any, and the walk stops."""
    out = np.full(size, np.inf)
    if not len(values):
        return out
    place = np.broadcast_to(np.arange(size, dtype=np.int16), (len(values), size))
    rows = np.arange(len(values))
    for j in range(size):
        drawn = mix(values + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = (drawn >> np.uint64(11)).astype(float) / 2**53
        step = (mix(drawn) >> np.uint64(33)).astype(np.int64) % (size - j)
        if j == 0:
            slot = step
        else:
            if j == 1:
                place = place.copy()
                place[rows, first] = 0
                # Position 0 is never read again.
            slot = place[rows, j + step].astype(np.int64)
            place[rows, j + step] = place[:, j]
        if j == 0:
            first = slot
        np.minimum.at(out, slot, j + r)
        if out.max() < j + 1:
            break
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    return np.array(
        [xxhash.xxh3_64_intdigest(p.tobytes(), seed=b) for b, p in enumerate(parts)], np.uint64
    ).view(np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), ">i8")
    return int(both[0]), int(both[1])


def _signatures(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            n, one, two, bands = [], [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), memo)
                a, b = _digest(values) if len(values) else (None, None)
                n.append(len(values))
                one.append(a)
                two.append(b)
                bands.append(band_keys(super_min_hash(values, BANDS * ROWS)) if len(values) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    return doc_columns(documents).mapInArrow(run, schema)


def joined(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Component label per set, from links of 100 * intersection >= percent * union.

    Sets are distinct and not empty. Pairs are sought between the two values of ``side``, or among
    all if there is just one. Exact: similar sets share a shingle among their rarest ones, as
    many as could be missing from the other, plus one."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, side = [sets[i] for i in order], sizes[order], side[order]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(flat)
    rank = np.empty(len(frequency), np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
    flat = rank[flat]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = [np.sort(flat[starts[i] : starts[i + 1]]) for i in range(n)]
    prefix = [x[: len(x) - (-(-percent * len(x)) // 100) + 1] for x in ids]
    # Of each side the postings: the sets that have a shingle in their prefix, in order of size.
    both = len(np.unique(side)) > 1
    owner = np.repeat(np.arange(n), [len(p) for p in prefix])
    term = np.concatenate(prefix)
    by_term = np.lexsort((owner, term))
    owner, term = owner[by_term], term[by_term]
    first = np.searchsorted(term, np.arange(len(frequency) + 1))
    joined_ids = np.concatenate(ids)
    marked = np.zeros(len(frequency), bool)
    root = np.arange(n)
    for i in range(n):
        lists = [owner[first[t] : first[t + 1]] for t in prefix[i]]
        near = np.unique(np.concatenate(lists))
        near = near[(near < i) & (100 * sizes[near] >= percent * sizes[i])]
        near = near[root[near] != root[i]]
        if both:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        marked[ids[i]] = True
        # A few at a time, nearest in size first, as most of the others are then already connected.
        near, width = near[::-1], 8
        while len(near):
            part, near = near[:width], near[width:]
            spans = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in part])
            cuts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            common = np.add.reduceat(marked[joined_ids[spans]].astype(np.int64), cuts)
            for p in part[100 * common >= percent * (sizes[i] + sizes[part] - common)]:
                if root[p] != root[i]:
                    root[root == root[p]] = root[i]
            near, width = near[root[near] != root[i]], width * 2
        marked[ids[i]] = False
    out = np.empty(n, np.int64)
    out[order] = root
    return out


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; texts link when 100 times the common
    shingles are at least ``percent`` times all shingles of both.

    Words are separated by ASCII white space and A-Z are lower-cased. Null, empty and blank texts have no
    shingles and link with nothing. Rows with the same text link, whatever their ids; rows with the
    same doc_id have the components of their own texts. A row without doc_id has its component, or null if none of
    it has one, and is not kept. An empty table gives no rows; other columns are ignored.
    """
    found = classified(documents, percent)
    component = F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def classified(documents: DataFrame, percent: int) -> DataFrame:
    """(d1, d2, doc_id, n_shingles, rep, component_id, first) of every row: the class of its text, the smallest
    doc_id of the class and of its group, and whether the class is the group's first. The last three are null
    without words, and where all rows of the text lack a doc_id."""
    signed = stage(_signatures(documents), "signatures")
    classes = stage(
        signed.filter("d1 is not null and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )
    # Classes with the same smallest doc_id (repeated ids) stay apart by a number of their own.
    named = F.xxhash64("d1", "d2").alias("node")
    banded = classes.select(named, F.explode("bands").alias("key"))
    least = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    meetings = banded.join(least, "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    clusters = components(meetings)
    members = stage(
        classes.select(named, "rep", "n", "d1", "d2").join(
            clusters.select("node", F.col("component").alias("cluster")), "node"
        ),
        "members",
    )
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "cluster").select(
        "node", "cluster", "blocks", "d1", "d2", F.col("rep").alias("doc_id"), F.pmod("node", "blocks").cast("int").alias("block")
    )
    small = members.count() <= BROADCAST
    texts = doc_columns(documents).join(F.broadcast(placed) if small else placed, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            at, held = [], []
            for i, (text, d1, d2) in enumerate(
                zip(batch.column("text"), batch.column("d1").to_pylist(), batch.column("d2").to_pylist())
            ):
                values = shingle_set(text.as_py(), memo)
                # Another text may have the same doc_id.
                if len(values) and _digest(values) == (d1, d2):
                    at.append(i)
                    held.append(values.tobytes())
            kept = batch.select(["node", "cluster", "blocks", "block"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(held, pa.binary())], names=["node", "cluster", "blocks", "block", "data"]
            )

    filled = texts.mapInArrow(sets, "node long, cluster long, blocks int, block int, data binary")
    paired = (
        filled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        nodes = frame["node"].to_numpy()
        labels = joined([np.frombuffer(b, np.uint64) for b in frame["data"]], frame["block"].to_numpy(), percent)
        least_of = pd.Series(nodes).groupby(labels).transform("min").to_numpy()
        apart = nodes != least_of
        return pd.DataFrame({"a": nodes[apart], "b": least_of[apart]})

    links = paired.groupBy("cluster", "low", "high").applyInPandas(link, "a long, b long")
    groups = components(links)
    grouped = classes.select(named, "d1", "d2", "rep").join(groups, "node", "left")
    group = F.coalesce("component", "node")
    least = grouped.groupBy(group.alias("group")).agg(F.min(F.struct("rep", "node")).alias("least"))
    found = grouped.select(group.alias("group"), "node", "rep", "d1", "d2").join(least, "group")
    return signed.select("doc_id", "n_shingles", "d1", "d2").join(
        found.select(
            "d1", "d2", "rep", F.col("least.rep").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first")
        ),
        ["d1", "d2"],
        "left",
    )


def with_class(documents: DataFrame) -> DataFrame:
    """All columns and the text's class as ``__d1``, ``__d2``, null for texts without words."""
    own = documents.select("*", F.col("text").cast("string").alias("__text"))
    schema = StructType([*documents.schema.fields, StructField("__d1", LongType()), StructField("__d2", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            sets = (shingle_set(text.as_py(), memo) for text in batch.column(batch.num_columns - 1))
            found = [_digest(values) if len(values) else (None, None) for values in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))],
                names=schema.names,
            )

    return own.mapInArrow(run, schema)
