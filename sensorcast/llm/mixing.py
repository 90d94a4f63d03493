"""Mixing sources to target weights by iterative proportional fitting.

The corpus is reduced to one row per (source, language, topic) cell with its tokens. The cells'
weights are then raked: scaled to meet the target share of each source, of each language and of each
topic in turn, until all three hold. A document is kept with the probability its cell's weight
gives it, decided by a hash of its id, so that the choice is the same whenever it is made. Shares come
before quantity: cells give at most what they have, and less than ``keep`` of all tokens stays where a scarce
category could not give its share of more.

Categories without a stated target are pooled under ``OTHER``, so the number of cells is bounded by
the targets that the caller states, whatever the data.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.staging import stage

OTHER = "(other)"
BROADCAST = 500_000  # documents with rows in several cells that are sent to all tasks; more are joined by shuffling
DIMENSIONS = ("source", "lang", "topic")


def form_of(text: Column) -> Column:
    """Topic of a text by its form, where no topic column is at hand: tables, marked-up noise, prose."""
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when(F.regexp_count(text, F.lit(r"[#$%&*!]{2}")) > 5, "noise")
        .otherwise("prose")
    )


def token_estimate(text: Column) -> Column:
    """Words of the whole text as tokens, 0 for a null or blank one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pooled(column: Column, targets: dict[str, float]) -> Column:
    known = F.lit(list(targets))
    return F.when(F.array_contains(known, column.cast("string")), column.cast("string")).otherwise(OTHER)


def rake(
    tokens: np.ndarray, cells: list[tuple], targets: tuple[dict, ...], rounds: int = 200, tolerance: float = 1e-9
) -> np.ndarray:
    """Token weight per cell, summing to one, whose marginals are the targets.

    Targets are scaled to the categories that have tokens; pooled categories share what is left of
    each dimension's targets, or keep their own share of the tokens if nothing is left."""
    weight = tokens / tokens.sum()
    masks = []
    for d, stated in enumerate(targets):
        own = [cell[d] for cell in cells]
        wanted = {name: share for name, share in stated.items() if name in set(own)}
        if OTHER in own and OTHER not in wanted:
            kept = float(weight[[c == OTHER for c in own]].sum())
            left = max(0.0, 1.0 - sum(stated.values()))
            wanted[OTHER] = left if left > 1e-12 else kept
        total = sum(wanted.values())
        masks.append([(np.array([c == name for c in own]), share / total) for name, share in sorted(wanted.items())])
    for _ in range(rounds):
        worst = 0.0
        for masked in masks:
            for mask, share in masked:
                have = weight[mask].sum()
                if have > 0:
                    worst = max(worst, abs(have - share))
                    weight[mask] *= share / have
        if worst < tolerance:
            break
    return weight / weight.sum()


def probabilities(tokens: np.ndarray, weight: np.ndarray, keep: float) -> np.ndarray:
    """Per cell, min(1, scale * weight / share of tokens), with the scale for which ``keep`` of all
    tokens is expected; cells at 1 pass what they cannot give on to the others."""
    ratio = weight / (tokens / tokens.sum())
    wanted, low, high = keep * tokens.sum(), 0.0, 1.0
    while (np.minimum(1.0, high * ratio) * tokens).sum() < wanted * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(1.0, middle * ratio) * tokens).sum() < wanted else (low, middle)
    return np.minimum(1.0, high * ratio)


def _fill(weight: np.ndarray, room: np.ndarray, share: float) -> float:
    """The factor by which ``weight``, no cell over its ``room``, sums to ``share``, which the room allows."""
    order = np.argsort(room / weight)
    full = np.concatenate([[0.0], np.cumsum(room[order])])[:-1]
    rest = np.cumsum(weight[order][::-1])[::-1]
    at = min(int(np.sum(full + rest * (room / weight)[order] < share)), len(order) - 1)
    return (share - full[at]) / rest[at]


def within_room(
    tokens: np.ndarray, cells: list[tuple], weight: np.ndarray, keep: float, rounds: int = 200, tolerance: float = 1e-9
) -> tuple[np.ndarray, float]:
    """Weights with the marginals of ``weight`` and the part of all tokens to keep, at most ``keep`` and as
    large as is found, so that no cell gives more tokens than it has.

    Cells that would are held at what they have, and the others are raked on."""
    share = tokens / tokens.sum()
    masks = []
    for d in range(len(cells[0])):
        own = np.array([cell[d] for cell in cells])
        masks += [(mask, float(weight[mask].sum())) for mask in (own == name for name in sorted(set(own)))]
    masks = [(mask & (weight > 0), wanted) for mask, wanted in masks if wanted > 0]

    def raked(part: float) -> np.ndarray | None:
        room, free = share / part, weight.copy()
        for _ in range(rounds):
            worst = 0.0
            for mask, wanted in masks:
                if room[mask].sum() < wanted:
                    return None
                worst = max(worst, abs(np.minimum(free, room)[mask].sum() - wanted))
                free[mask] *= _fill(free[mask], room[mask], wanted)
            if worst < tolerance:
                return np.minimum(free, room)
        return None

    low = min(keep, float((share / weight.clip(1e-300)).min()) * (1 - 1e-12))  # no cell is full
    best, high = weight, keep
    if low < keep and (made := raked(keep)) is not None:
        return made, keep
    while high - low > 1e-3 * high:
        part = (low + high) / 2
        made = raked(part)
        low, high, best = (part, high, made) if made is not None else (low, part, best)
    return best, low


def together(marked: DataFrame, into: str) -> DataFrame:
    """``marked`` with one cell for all rows of a doc_id and text, the least of theirs.

    Rows that differ in source or language would else have different probabilities for one hash."""
    key = F.xxhash64("doc_id", "text")
    cell = F.struct(f"{into}.source", f"{into}.lang")
    split = stage(
        marked.groupBy(key.alias("__key"))
        .agg(F.min(cell).alias("__cell"), F.max(cell).alias("__most"))
        .filter("__cell <> __most")
        .drop("__most"),
        "split-rows",
    )
    rows = split.count()
    if not rows:
        return marked
    found = marked.join(F.broadcast(split) if rows <= BROADCAST else split, key == F.col("__key"), "left")
    own = F.struct(
        F.coalesce("__cell.source", f"{into}.source").alias("source"),
        F.coalesce("__cell.lang", f"{into}.lang").alias("lang"),
        f"{into}.topic",
        f"{into}.tokens",
    )
    return found.withColumn(into, own).drop("__key", "__cell")


def mix(
    documents: DataFrame,
    source: dict[str, float],
    lang: dict[str, float],
    topic: dict[str, float],
    keep: float = 0.5,
    seed: int = 7,
    topic_of: Column | None = None,
) -> DataFrame:
    """All columns of ``documents`` and, as a last column, a struct: source, lang, topic (pooled),
    tokens, weight (the raked token share of the cell in what is kept), probability and kept. It is named ``mix``,
    with underscores added while there is such a column. ``keep`` is an upper bound of the part of all
    tokens that is expected to stay; a warning names the part if the shares leave less.

    Null or unlisted sources, languages and topics count as OTHER. Documents without tokens weigh
    nothing and have their cell's probability; where a cell has no tokens at all, they are kept. Ties do not
    occur: the decision is a hash of doc_id and text, so repeated rows are kept or left out together
    (if they differ in source or language, all count to the least of these)
    and a null doc_id is decided by its text. An empty table gives an empty result.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must be over 0 and at most 1")
    own = F.struct(
        pooled(F.col("source"), source).alias("source"),
        pooled(F.col("lang"), lang).alias("lang"),
        pooled(form_of(F.col("text")) if topic_of is None else topic_of, topic).alias("topic"),
        token_estimate(F.col("text")).alias("tokens"),
    )
    into = "mix"
    while into in map(str.lower, documents.columns):
        into += "_"
    marked = together(documents.withColumn(into, own), into)
    sums = (
        marked.groupBy(*[F.col(f"{into}.{d}").alias(d) for d in DIMENSIONS])
        .agg(F.sum(f"{into}.tokens").alias("tokens"))
        .filter("tokens > 0")
        .collect()  # at most (sources + 1) * (languages + 1) * (topics + 1) stated categories
    )
    cells = [tuple(row[d] for d in DIMENSIONS) for row in sums]
    fitted = {}
    if cells:
        tokens = np.array([float(row["tokens"]) for row in sums])
        weight = rake(tokens, cells, (source, lang, topic))
        weight, reached = within_room(tokens, cells, weight, keep)
        if reached < keep:
            warnings.warn(f"the shares leave {reached:.4f} of the tokens, not {keep}", stacklevel=2)
        fitted = {c: (float(w), float(p)) for c, w, p in zip(cells, weight, probabilities(tokens, weight, reached))}
    key = F.concat_ws("\0", *[F.col(f"{into}.{d}") for d in DIMENSIONS])
    looked = F.lit(0.0), F.lit(1.0)
    if fitted:
        pairs = [x for c, wp in fitted.items() for x in (F.lit("\0".join(c)), F.array(F.lit(wp[0]), F.lit(wp[1])))]
        found = F.create_map(*pairs)[key]
        looked = F.coalesce(found[0], F.lit(0.0)), F.coalesce(found[1], F.lit(1.0))
    uniform = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    return (
        marked.withColumn(into, F.struct(f"{into}.*", looked[0].alias("weight"), looked[1].alias("probability")))
        .withColumn(into, F.struct(f"{into}.*", (uniform < F.col(f"{into}.probability")).alias("kept")))
    )
