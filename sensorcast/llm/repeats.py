"""Repeated word windows, found level by level with doubled lengths.

A window of the contract's length can only occur twice if the windows of half its length in it do. At
the first level each long window therefore names one of its half-length windows, the one
with the smallest hash, so that equal windows name equal ones; only those that occur more than once
let their long windows live on, and just these are extended to twice the length and counted. The same step
would take any further level; it ends when no candidate is left or the asked length is reached.

Hashes are counted in bins. Documents meet bins and texts in chunks of columns, not row by row, and
repeats inside a chunk are settled where they are read, so a passage that very many documents share
sends one entry per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorcast.llm.words import ascii_words, hash_memo, mix, windows, word_hashes
from sensorcast.staging import stage

WORDS_PER_BIN = 2_000_000
HOT = 1_000  # a window's entries are dealt over pieces of at most about 1/HOT of all entries
CHUNK = 1_000_000  # windows that a task gathers before it sends them to the bins


def anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(half, at): hashes of the half-length windows and, per window of ``length`` words, the place
    of the half-length window with the smallest scrambled hash in it, the first of equal ones."""
    half = (length + 1) // 2
    grams = windows(hashes, half)
    n = len(hashes) - length + 1
    if n <= 0:
        return grams, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(mix(grams), length - half + 1)
    return grams, view.argmin(axis=1) + np.arange(n)


def _keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows with the same id and text share a key and are told apart by nothing else."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def _packed(documents: DataFrame, bins: int, schema_text: str = "z") -> DataFrame:
    """(bin, key, doc_id, z): texts compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [None if not t.is_valid else compress(t.as_buffer()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["key", "doc_id", schema_text]
            )

    packed = _keyed(documents).mapInArrow(run, f"key long, doc_id long, {schema_text} binary")
    return packed.withColumn("bin", F.pmod("key", F.lit(bins)).cast("int"))


def _unpacked(value) -> str | None:
    return None if value is None else zstandard.ZstdDecompressor().decompress(value).decode("utf-8", "surrogatepass")


def remove_repeats(documents: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, after removing each word that lies in a
    window of ``length`` words whose word sequence also starts anywhere else, in the same document
    or another. Windows are judged on the input.

    Words are what ASCII white space separates, unchanged. Null, empty and blank texts have no words and the
    hash of the empty string; shorter texts than ``length`` lose nothing. Repeated rows repeat each
    other. A null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            named, counts = [], []
            for text in batch.column(2):
                words = ascii_words(text.as_py())
                counts.append(len(words))
                grams, at = anchors(word_hashes(words, memo), length)
                named.append(grams[np.unique(at)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.list_(pa.int64()))],
                names=["key", "n_words", "anchors"],
            )

    level = stage(_keyed(documents).mapInArrow(first, "key long, n_words long, anchors array<long>"), "anchors")
    bins = max(12, -(-(level.agg(F.sum("n_words")).first()[0] or 0) // WORDS_PER_BIN))
    each = level.select("key", F.explode("anchors").alias("anchor"))
    # Entries of a very common window would meet in one task; they are dealt over pieces of bounded size.
    entries = level.agg(F.sum(F.size("anchors"))).first()[0] or 1
    counted = each.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1")
    again = stage(counted.select("anchor", F.ceil(F.col("c") * HOT / entries).alias("pieces")), "repeated-anchors")
    common = F.broadcast(again.filter("pieces > 1"))  # fewer than HOT rows
    dealt = each.join(common, "anchor", "left").select(
        "key", "anchor", F.pmod("key", F.coalesce("pieces", F.lit(1))).alias("piece")
    )
    pieces = again.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    # What goes on: documents with the half-length windows that occur more than once.
    alive = (
        dealt.join(pieces, ["anchor", "piece"])
        .select("key", "anchor")
        .distinct()
        .withColumn("bin", F.pmod("key", F.lit(bins)).cast("int"))
    )

    def extend(texts: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        memo = hash_memo()
        out, keys, places, hashes = [], [], [], []

        def flush():
            k, p, h = (np.concatenate(x) if x else np.empty(0) for x in (keys, places, hashes))
            keys.clear(), places.clear(), hashes.clear()
            if not len(h):
                return
            _, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            many = count[inverse] > 1
            # Settled here; the bin of the hash is told by one of them.
            out.append((int(k[0] % bins), 1, k[many].tobytes(), p[many].tobytes(), b"", b""))
            k, p, h, many = k[at], p[at], h[at], count > 1
            to = (mix(h) % np.uint64(bins)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            k, p, h, many, to = k[order], p[order], h[order], many[order], to[order]
            edges = np.searchsorted(to, np.arange(bins + 1))
            for b in np.unique(to).tolist():
                s = slice(edges[b], edges[b + 1])
                out.append((b, 0, k[s].tobytes(), p[s].tobytes(), h[s].tobytes(), many[s].tobytes()))

        wanted = {key: group.to_numpy() for key, group in kept.groupby("key")["anchor"]}
        held = 0
        for key, z in zip(texts["key"].tolist(), texts["z"]):
            if key not in wanted:
                continue
            own = word_hashes(ascii_words(_unpacked(z)), memo)
            grams, at = anchors(own, length)
            live = np.flatnonzero(np.isin(grams.view(np.int64), wanted[key])[at])
            if len(live):
                keys.append(np.full(len(live), key, np.int64))
                places.append(live.astype(np.int32))
                hashes.append(windows(own, length)[live])
                held += len(live)
                if held >= CHUNK:
                    flush()
                    held = 0
        flush()
        return pd.DataFrame(out, columns=["bin", "settled", "keys", "places", "hashes", "many"])

    columns = "bin int, settled int, keys binary, places binary, hashes binary, many binary"
    sent = _packed(documents, bins).groupBy("bin").cogroup(alive.groupBy("bin")).applyInPandas(extend, columns)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        settled = frame[frame["settled"] == 1]
        rest = frame[frame["settled"] == 0]
        load = lambda part, name, kind: np.frombuffer(b"".join(part[name]), kind)
        k, p, h = load(rest, "keys", "<i8"), load(rest, "places", "<i4"), load(rest, "hashes", "<u8")
        many = load(rest, "many", bool)
        if len(h):
            _, inverse, total = np.unique(h, return_inverse=True, return_counts=True)
            known = np.bincount(inverse, many, minlength=len(total)) > 0
            twice = ((total > 1) | known)[inverse] & ~many
            k, p = k[twice], p[twice]
        k = np.concatenate([load(settled, "keys", "<i8"), k])
        p = np.concatenate([load(settled, "places", "<i4"), p])
        to = k % bins
        order = np.argsort(to, kind="stable")
        k, p, to = k[order], p[order], to[order]
        edges = np.searchsorted(to, np.arange(bins + 1))
        rows = [(b, k[edges[b] : edges[b + 1]].tobytes(), p[edges[b] : edges[b + 1]].tobytes()) for b in np.unique(to).tolist()]
        return pd.DataFrame(rows, columns=["bin", "keys", "places"])

    marks = sent.groupBy("bin").applyInPandas(count, "bin int, keys binary, places binary")

    def remove(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(found["keys"]), "<i8")
        places = np.frombuffer(b"".join(found["places"]), "<i4")
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        rows = []
        for key, doc_id, z in zip(texts["key"].tolist(), texts["doc_id"], texts["z"]):
            words = ascii_words(_unpacked(z))
            own = places[np.searchsorted(keys, key, "left") : np.searchsorted(keys, key, "right")]
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, own, 1)
            np.add.at(steps, np.minimum(own + length, len(words)), -1)
            covered = np.cumsum(steps)[:-1] > 0
            kept = [w for w, c in zip(words, covered.tolist()) if not c] if len(own) else words
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        made = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        return made.astype({"doc_id": "Int64", "n_words": "int64", "n_removed": "int64"})

    return (
        _packed(documents, bins)
        .groupBy("bin")
        .cogroup(marks.groupBy("bin"))
        .applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
