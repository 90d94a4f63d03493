"""Token counts with a whole-token shortcut for sentencepiece BPE models.

A text is cut where no token of the vocabulary can reach across: before a space that follows another
character, and around line feeds. That this holds is proved from the vocabulary when a model is
loaded, as is which strings between two cuts are one token by themselves: each vocabulary string is
encoded alone, and those that give a single token are counted from then on without the library. Only
other strings are merged by the library, each once per worker while it stays in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame

from sensorcast.llm.words import UnitTable, doc_columns, slices

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class TokenCounter:
    """Counts the tokens that ``SentencePieceProcessor.encode`` gives for texts, without special tokens."""

    def __init__(self, model_file: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.separable = self._proved(pieces)
        spaced, bare = {}, {}
        if self.separable:
            # What a line feed adds, and what an empty unit (the space put in front) counts.
            self._empty = len(self._encode(["\n"])[0]) - 1
            after_space = [p[1:] for p in pieces if p[:1] == SPACE and p[1:] and SPACE not in p[1:]]
            alone = [p for p in pieces if p and SPACE not in p and p != "\n"]
            spaced = {u: 1 for u, n in zip(after_space, self._count_spaced(after_space)) if n == 1}
            bare = {u: 1 for u, n in zip(alone, self._count_bare(alone)) if n == 1}
        self.whole = (frozenset(spaced), frozenset(bare))
        self._spaced = UnitTable(self._count_spaced, base=spaced)
        self._bare = UnitTable(self._count_bare, base=bare)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def _proved(self, pieces: list[str]) -> bool:
        """No piece has a space after another character, none of several characters has a line feed,
        the model leaves characters as they are and puts one space in front."""
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in pieces):
            return False
        probe = "a  b e\u0301 c"
        kept = "".join(self._model.encode(probe, out_type=str)) == SPACE + probe.replace(" ", SPACE)
        return kept and self._model.encode("\n", out_type=str)[:1] == [SPACE] and self._model.encode("") == []

    def _count_spaced(self, units: list[str]) -> list[int]:
        """Tokens of units that a space precedes; the library puts that space back."""
        return [len(ids) for ids in self._encode(units)]

    def _count_bare(self, units: list[str]) -> list[int]:
        """Tokens of units that no space precedes: what they add after a line feed."""
        return [len(ids) - self._empty - 1 for ids in self._encode(["\n" + u for u in units])]

    def _split(self, text: str) -> tuple[int, list[str], list[str]]:
        """Tokens known at once, units after a space, and other units."""
        padded = f" {text} "
        if SPACE not in text and "  " not in padded and " \n" not in padded and "\n " not in padded:
            if "\n" not in text:
                return 0, text.split(" "), []
            lines = text.split("\n")
            spaced, bare = lines[0].split(" "), []
            for line in lines[1:]:
                if line:
                    words = line.split(" ")
                    bare.append(words[0])
                    spaced += words[1:]
            return len(lines) - 1, spaced, bare
        known, spaced, bare = 0, [], []
        for unit in _UNITS.findall(SPACE + text.replace(" ", SPACE)):
            if unit == "\n":
                known += 1
            elif unit == SPACE:
                known += self._empty
            elif unit[0] == SPACE:
                spaced.append(unit[1:])
            else:
                bare.append(unit)
        return known, spaced, bare

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.separable:
            return [len(ids) for ids in self._encode([t or "" for t in texts])]
        parts = [self._split(t) if t else (0, [], []) for t in texts]
        for table, at in ((self._spaced, 1), (self._bare, 2)):
            new = set()
            for part in parts:
                new.update(part[at])
            table.add(new)
        spaced, bare = self._spaced.__getitem__, self._bare.__getitem__
        return [n + sum(map(spaced, s)) + sum(map(bare, b)) for n, s, b in parts]


@lru_cache(maxsize=2)
def counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, over its whole text.

    ``model_file`` is a sentencepiece model that every executor finds at that place. A null text counts
    as empty: no bytes, no tokens. A null doc_id stays null; rows with the same doc_id, and repeated
    rows, are counted each. Other columns are ignored and an empty table gives an empty result. A model
    for which the cuts cannot be proved is run over whole texts instead.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model_file).counts
        for batch in batches:
            texts = batch.column(1)
            tokens = [n for part in slices(texts) for n in of(part)]
            n_bytes = [0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return doc_columns(documents).mapInArrow(count, SCHEMA)
