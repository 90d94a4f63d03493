"""Cost-balanced packing of documents into sequences of bounded length.

Training on a sequence costs a part linear in its tokens and a part quadratic in the length of each
piece, as attention stays inside a document. Documents are tokenised and cut where they are read:
full sequences leave at once, and what remains of each document waits in a block. A block is packed
in descending order, each piece to the cheapest sequence that still has room for it; pieces for which
none has room are cut into the gaps. Nothing is shuffled, and memory is bounded by the block.

Cutting needs the checksum of any part of a document, but not its ids: checksums of the beginnings
are kept every ``GRID`` ids, and the checksum of a part follows from those of two beginnings.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sensorcast.llm.words import doc_columns

GRID = 16
BLOCK = 4096
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)
_ODD_SPACE = re.compile(r"[^\S \n]")
_LOOK_AHEAD = r"\s+(?!\S)|"


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, equal to those of the ``tokenizers`` file.

    The ranks encode faster than the file and give the same ids, but for texts that name a special
    token or hold white space other than spaces and line feeds; those go to the file itself. Where no
    two white spaces meet, the pattern needs no look-ahead."""

    def __init__(self, json_file: str, rank_file: str, pattern: str):
        self._file = Tokenizer.from_file(json_file)
        self._special = [t.content for t in self._file.get_added_tokens_decoder().values()]
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = pattern.replace(_LOOK_AHEAD, "")
        self._ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(name in text for name in self._special):
            ids = self._file.encode(text, add_special_tokens=False).ids
        elif "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
            ids = self._ranks.encode_ordinary(text)
        else:
            ids = self._plain.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(json_file: str, rank_file: str, pattern: str) -> Encoder:
    return Encoder(json_file, rank_file, pattern)


class Piece:
    """A run of ids of one document; ``crcs[k]`` is the checksum of its first ``k * GRID`` ids."""

    __slots__ = ("doc", "start", "length", "crcs", "crc", "total")

    def __init__(self, doc, start, ids: memoryview, total):
        self.doc, self.start, self.length, self.total = doc, start, len(ids) // 4, total
        crc, self.crcs = 0, [0]
        for at in range(0, len(ids) - 4 * GRID + 1, 4 * GRID):
            crc = zlib.crc32(ids[at : at + 4 * GRID], crc)
            self.crcs.append(crc)
        self.crc = zlib.crc32(ids[4 * GRID * (len(self.crcs) - 1) :], crc)

    def part(self, begin: int, end: int) -> int:
        """Checksum of ids ``begin`` to ``end``; both are multiples of GRID, or ``end`` the length."""
        whole = self.crc if end == self.length else self.crcs[end // GRID]
        nulls = bytes(4 * (end - begin))
        return whole ^ zlib.crc32(nulls, self.crcs[begin // GRID]) ^ zlib.crc32(nulls)


def pack_block(pieces: list[Piece], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048):
    """Assign pieces shorter than ``capacity``: (piece, begin, end, sequence, offset, cost) and the
    number of sequences. Descending; each to the cheapest sequence with room, ties to the first;
    pieces without room are cut into gaps, again the cheapest first."""
    count = -(-sum(p.length for p in pieces) // capacity)
    cost, used = np.zeros(count), np.zeros(count, np.int64)
    out, over = [], []

    def put(piece, begin, end, k):
        spent = linear * (end - begin) + quadratic * (end - begin) ** 2
        out.append((piece, begin, end, int(k), int(used[k]), spent))
        cost[k] += spent
        used[k] += end - begin

    for piece in sorted(pieces, key=lambda p: -p.length):
        room = np.where(used + piece.length <= capacity, cost, np.inf)
        k = int(room.argmin())
        if room[k] < np.inf:
            put(piece, 0, piece.length, k)
        else:
            over.append(piece)
    for piece in over:
        begin = 0
        while begin < piece.length:
            left = piece.length - begin
            room = np.where(capacity - used >= min(left, GRID), cost, np.inf)
            k = int(room.argmin())
            if room[k] == np.inf:
                cost, used = np.append(cost, 0.0), np.append(used, 0)
                k = len(used) - 1
            free = int(capacity - used[k])
            end = piece.length if left <= free else begin + free // GRID * GRID
            put(piece, begin, end, k)
            begin = end
    return out, len(used)


def pack(
    documents: DataFrame,
    json_file: str,
    rank_file: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece of a document: which sequence it is in and where, with a checksum of its ids.

    A document is its token ids followed by ``end_id``, so a null or empty text is one id. ids_crc32 is
    the CRC-32 of the piece's ids as little-endian 32-bit values; cost is what the piece costs in
    training. ``rank_file`` holds the vocabulary of ``json_file`` as ranks. A null doc_id stays null;
    repeated rows are packed each; an empty table gives no rows; other columns are ignored. Sequences
    are numbered by partition and block, so a task that runs again gives the same rows.
    """
    if capacity % GRID:
        raise ValueError(f"capacity must be a multiple of {GRID}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_file, rank_file, pattern).ids
        tail = np.asarray([end_id], "<u4").tobytes()
        following = TaskContext.get().partitionId() << 32
        rows, waiting = [], []

        def flush():
            nonlocal following, waiting
            placed, used = pack_block(waiting, capacity)
            for p, begin, end, k, offset, spent in placed:
                rows.append((p.doc, p.start + begin, end - begin, p.part(begin, end), p.total, following + k, offset, spent))
            following += used
            waiting = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 7 + [pa.float64()]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + tail)
                total = len(ids) // 4
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                    rows.append((doc, start, capacity, crc, total, following, 0, capacity + capacity**2 / 2048))
                    following += 1
                if full < total:
                    waiting.append(Piece(doc, full, ids[4 * full :], total))
                    if len(waiting) >= block:
                        flush()
            if rows:
                yield made()
        if waiting:
            flush()
            yield made()

    return doc_columns(documents).mapInArrow(run, SCHEMA)
