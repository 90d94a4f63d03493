"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's expression the trigrams that any match must contain are derived, as an AND of ORs
of ANDs. One pass writes the postings of just these trigrams; intersecting them gives the rows each rule
has to look at, and the expressions verify those rows. Rules without mandatory trigrams look at every
row. Spans come from the texts between matches and the matches themselves, whose lengths add up to
positions.
"""

from __future__ import annotations

import re._constants as codes
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.staging import stage

BROADCAST = 500_000  # candidate rows that are sent to all tasks; more are joined by shuffling
STRINGS = 64  # literal alternatives that are followed through an expression


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. ``any_case`` says that
    letters which the trigrams come from match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The kinds of secrets in the order they are listed. Where the whole match has to be long enough,
# the least length stands in the pattern, as a run that is too short has no longer part.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)


def _strings(items, limit: int) -> list[str] | None:
    """All strings that a parsed piece matches, or None if there are too many."""
    found = [""]
    for op, value in items:
        if op is codes.LITERAL:
            parts = [chr(value)]
        elif op is codes.IN and all(o is codes.LITERAL for o, _ in value):
            parts = [chr(v) for _, v in value]
        elif op is codes.SUBPATTERN:
            parts = _strings(value[3], limit)
        elif op is codes.BRANCH:
            options = [_strings(x, limit) for x in value[1]]
            parts = None if None in options else [s for o in options for s in o]
        elif op is codes.MAX_REPEAT and value[1] == 1:
            inner = _strings(value[2], limit)
            parts = None if inner is None else (inner if value[0] else ["", *inner])
        else:
            parts = None
        if parts is None or len(found) * len(parts) > limit:
            return None
        found = [a + b for a in found for b in parts]
    return found


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def mandatory(rule: Rule) -> list[frozenset[frozenset[str]]]:
    """Clauses that all hold for a text with a match; a clause holds if all trigrams of one of its
    sets are in the text (in the lower-cased text, for a rule of any case)."""
    clauses, run = [], []

    def close():
        found = _strings(run, STRINGS) if run else None
        if found and min(map(len, found)) >= 3:
            sets = {trigrams(s.lower() if rule.any_case else s) for s in found}
            # A set with all of another's trigrams says nothing more.
            clauses.append(frozenset(s for s in sets if not any(o < s for o in sets)))
        run.clear()

    for item in parser.parse(rule.pattern):
        if _strings([*run, item], STRINGS) is None:
            close()
            if _strings([item], STRINGS) is None:
                continue
        run.append(item)
    close()
    return clauses


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(found.alias("match"), sizes.alias("part"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    none = F.lit(None).cast("struct<start:long,kind:int,end:long>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array_compact(F.array(none)).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["match"])
        span = F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind"), end.cast("long").alias("end"))
        kept = F.when(F.char_length(part["part"]) >= rule.least, F.array(span)).otherwise(F.array_compact(F.array(none)))
        return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], kept).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, zero, step)["spans"]).otherwise(
        F.array_compact(F.array(none))
    )


def _candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, rules): bit n of rules is set if rule n may match a row with that key. Only rows that some
    rule with mandatory trigrams may match are there."""
    wanted = {n: mandatory(rule) for n, rule in enumerate(rules)}
    terms = sorted({(rules[n].any_case, t) for n, cs in wanted.items() for c in cs for s in c for t in s})
    low = F.lower("__text")
    present = [
        F.when(F.contains(low if any_case else F.col("__text"), F.lit(gram)), F.lit(number))
        for number, (any_case, gram) in enumerate(terms)
    ]
    # The index: one posting per trigram and row.
    postings = stage(
        keyed.select(F.explode(F.array_compact(F.array(*present))).alias("gram"), F.col("__key").alias("row_key")),
        "postings",
    )
    words = -(-len(terms) // 60) or 1
    has = lambda number: (F.col(f"w{number // 60}").bitwiseAND(F.lit(1 << number % 60))) != 0
    rows = postings.groupBy("row_key").agg(
        *[
            F.bit_or(
                F.when(F.floor(F.col("gram") / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 60)).otherwise(F.lit(0).cast("long"))
            ).alias(f"w{w}")
            for w in range(words)
        ]
    )
    number_of = {term: n for n, term in enumerate(terms)}

    def holds(n: int) -> Column:
        every = []
        for clause in wanted[n]:
            any_set = [
                reduce(lambda a, b: a & b, [has(number_of[(rules[n].any_case, t)]) for t in sorted(grams)])
                for grams in sorted(clause, key=sorted)
            ]
            every.append(reduce(lambda a, b: a | b, any_set))
        return reduce(lambda a, b: a & b, every)

    flags = [F.when(holds(n), F.lit(1 << n)).otherwise(F.lit(0)) for n, clauses in wanted.items() if clauses]
    return rows.select("row_key", reduce(lambda a, b: a + b, flags).cast("long").alias("rules")).filter("rules <> 0")


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``documents`` and, as a last column, an array of (start, kind, end): spans in code points,
    by start and then by rule; kind is the number of the rule. It is named ``secrets``, with
    underscores added while there is such a column.

    A null or empty text has an empty array. Whole texts are looked at, whatever their length.
    Repeated rows and rows that share a doc_id are looked at each; a null doc_id does no harm; an
    empty table gives no rows.
    """
    into = "secrets"
    while into in map(str.lower, documents.columns):
        into += "_"
    # Everything beside the row itself goes into one column, whatever names the documents have.
    own = [F.col(f"`{c}`") for c in documents.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id"), text)  # a clash of keys only makes a row a candidate
    keyed = documents.select(F.struct(*own).alias("row"), text.alias("__text"), key.alias("__key"))
    indexed = [n for n, rule in enumerate(rules) if mandatory(rule)]
    if indexed:
        found = stage(_candidates(keyed.select("__text", "__key"), rules), "candidates")
        small = found.count() <= BROADCAST
        side = F.broadcast(found) if small else found.hint("shuffle_hash")
        keyed = keyed.join(side, F.col("__key") == F.col("row_key"), "left")
        flags = F.coalesce(F.col("rules"), F.lit(0).cast("long"))
    spans = []
    for n, rule in enumerate(rules):
        matches = _spans(F.col("__text"), rule, n)
        if n in indexed:
            nothing = F.array().cast("array<struct<start:long,kind:int,end:long>>")
            matches = F.when(flags.bitwiseAND(F.lit(1 << n)) != 0, matches).otherwise(nothing)
        spans.append(matches)
    fields = [F.col("row").getField(c).alias(c) for c in documents.columns]
    return keyed.select(*fields, F.array_sort(F.concat(*spans)).alias(into))


def count_of(spans: Column, number: int) -> Column:
    """How many spans are of the rule with that number."""
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    shown = F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``documents`` with each stretch of text that spans cover replaced by ``mask``; spans that
    overlap or touch are one stretch. ``n_chars``, where it is a column, is counted anew."""
    found = scan(documents, rules)
    spans, text = F.col(found.columns[-1]), F.col("text").cast("string")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        apart = (span["start"] > state["at"]) | (state["at"] == 0)
        added = F.when(apart, F.concat(state["out"], between, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), added.alias("out"))

    done = F.aggregate(spans, zero, step)
    rest = F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text))
    clean = F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(F.col("text"))
    changed = {"text": clean}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size(spans) > 0, F.char_length(clean).cast(kind)).otherwise(F.col("n_chars"))
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])
