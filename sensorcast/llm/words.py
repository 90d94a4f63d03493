"""Words, their hashes and the documents' columns, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Memo(dict):
    """A dict that computes missing values and starts again from ``base`` when it holds ``limit`` of them,
    so that its memory is bounded whatever the vocabulary."""

    def __init__(self, compute, limit: int = 400_000, base: dict | None = None):
        super().__init__(base or {})
        self._compute, self._limit, self._base = compute, limit, base or {}

    def __missing__(self, key):
        if len(self) >= self._limit + len(self._base):
            self.clear()
            self.update(self._base)
        value = self[key] = self._compute(key)
        return value


class UnitTable(dict):
    """Values of text units, filled many at a time by ``compute(units) -> values``; starts again from
    ``base`` once it holds ``limit`` more, so that its memory is bounded."""

    def __init__(self, compute, limit: int = 400_000, base: dict | None = None):
        super().__init__(base or {})
        self._compute, self._limit, self._base = compute, limit, base or {}

    def add(self, needed: set) -> None:
        """Make sure that all ``needed`` units have values."""
        new = {u for u in needed if u not in self}
        if len(self) + len(new) > self._limit + len(self._base) and new:
            self.clear()
            self.update(self._base)
            new = {u for u in needed if u not in self}
        if new:
            units = list(new)
            self.update(zip(units, self._compute(units)))


def slices(column, most_bytes: int = 4_000_000) -> Iterator[list]:
    """The Python values of an Arrow string column, in runs of about ``most_bytes`` at most."""
    begin, held = 0, 0
    sizes = pa.compute.binary_length(column).to_pylist()
    for end, size in enumerate(sizes):
        held += size or 0
        if held >= most_bytes:
            yield column.slice(begin, end + 1 - begin).to_pylist()
            begin, held = end + 1, 0
    if begin < len(sizes):
        yield column.slice(begin).to_pylist()


def doc_columns(documents: DataFrame) -> DataFrame:
    """Just (doc_id long, text string), whatever other columns there are."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hash_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` words; runs of other lengths hash differently.

    Built by doubling: a run of 2n words is the mix of two runs of n."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    # value[i] covers `have` words from i on; powers holds runs of powers of two.
    power, size, value, have = hashes, 1, None, 0
    rest = length
    while rest:
        if rest & 1:
            if value is None:
                value, have = power, size
            else:
                m = len(power) - have
                value = mix(value[:m] * odd + mix(power[have : have + m] + np.uint64(have)))
                have += size
        rest >>= 1
        if rest:
            power = mix(power[:-size] * odd + mix(power[size:] + np.uint64(size)))
            size *= 2
    return value[:n]
