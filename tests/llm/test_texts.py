"""Text operators against brute force, over odd documents and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import documents, workers  # noqa: F401
from tokenizers import Tokenizer

from sensorcast.llm import near_texts, packing, repeats, secret_scan, token_counts
from sensorcast.llm import settings as production


def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def pack(documents, **more):
    return packing.pack(
        documents, production.BYTE_BPE, production.BYTE_BPE_RANKS, production.BYTE_BPE_PATTERN, **more
    )


def encoder():
    return packing.encoder(production.BYTE_BPE, production.BYTE_BPE_RANKS, production.BYTE_BPE_PATTERN)


FILE = Tokenizer.from_file(production.BYTE_BPE)
PIECES = sentencepiece.SentencePieceProcessor(model_file=production.PIECE_BPE)
ODD = st.text(st.sampled_from(list(" \n\t\r▁ab,.é'sZ1\x00\x1c\x85\xa0　ﬁ中🙂²_")), max_size=20)


def test_token_counts(documents):
    want = sorted(
        ((i, len((t or "").encode()), n := len(PIECES.encode(t or "")), n > 4096) for i, t in pairs(documents)), key=str
    )
    assert sorted((tuple(r) for r in token_counts.token_counts(documents, production.PIECE_BPE).collect()), key=str) == want


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_token_counts_of_any_text(text):
    assert token_counts.counter(production.PIECE_BPE).counts([text]) == [len(PIECES.encode(text))]


def test_whole_tokens_are_proved():
    counter = token_counts.counter(production.PIECE_BPE)
    assert counter.separable
    assert all(len(PIECES.encode(w)) == 1 for w in list(counter.whole[0])[::97])


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_ids_of_any_text(text):
    assert encoder().ids(text) == np.asarray(FILE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(documents):
    ids = defaultdict(list)
    for i, t in pairs(documents):
        ids[i].append(np.asarray([*FILE.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    rows = pack(documents).collect()
    sequences, covered = defaultdict(list), Counter()
    for r in rows:
        begin, end = 4 * r["start"], 4 * (r["start"] + r["length"])
        assert r["ids_crc32"] in [zlib.crc32(x[begin:end]) for x in ids[r["doc_id"]] if len(x) == 4 * r["doc_tokens"]]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: sum(map(len, x)) // 4 for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert rows == sorted(pack(documents).collect(), key=rows.index)


def test_packing_leaves_little_room_and_balances_cost():
    rnd = np.random.default_rng(1)
    pieces = [packing.Piece(n, 0, memoryview(bytes(4 * int(k))), 0) for n, k in enumerate(rnd.integers(1, 2048, 3000))]
    placed, used = packing.pack_block(pieces, 2048)
    assert used <= 1.005 * sum(p.length for p in pieces) / 2048
    cost = np.zeros(used)
    for *_, k, _, spent in placed:
        cost[k] += spent
    assert np.std(cost[:-3]) < 0.15 * cost.mean()


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(documents):
    rows = [(i, shingled(t)) for i, t in pairs(documents)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root = [root[b] if r == root[a] else r for r in root]
    want = []
    for n, (i, s) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        component = i if not s else min(ids, default=None)
        want.append((i, len(s), component, i is not None and i == component))
    assert sorted((tuple(r) for r in near_texts.near_duplicates(documents).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("split", [False, True])
def test_joined_is_exact(split):
    rnd = np.random.default_rng(4)
    base = [rnd.integers(0, 2**60, 60).astype(np.uint64) for _ in range(4)]
    sets = []
    for n in range(150):
        own = base[n % 4].copy()
        change = rnd.choice(60, rnd.integers(0, 9), replace=False)
        own[change] = rnd.integers(0, 2**60, len(change)).astype(np.uint64)
        sets.append(np.unique(own))
    sets = [s for n, s in enumerate(sets) if not any(np.array_equal(s, o) for o in sets[:n])]
    side = np.arange(len(sets)) % 2 if split else np.zeros(len(sets), int)
    root = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            linked = 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)
            if linked and (not split or side[a] != side[b]):
                root[root == root[a]] = root[b]
    got = near_texts.joined(sets, side, 85)
    same = lambda x: {tuple(np.flatnonzero(x == r)) for r in x}
    assert same(got) == same(root)


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 400).astype(np.uint64)
    one, two = np.unique(pool[:300]), np.unique(pool[100:])
    share = np.mean(near_texts.super_min_hash(one, 125) == near_texts.super_min_hash(two, 125))
    assert abs(share - 0.5) < 0.15
    assert np.isfinite(near_texts.super_min_hash(one[:1], 125)).all()


def test_secrets(documents):
    found = secret_scan.scan(documents)
    name = found.columns[-1]
    assert name == "secrets_"
    rules = [
        (re.compile(secret_scan.RULES[0].pattern), lambda m: len(m[2]) >= 8),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    for row in found.collect():
        text = row["text"] or ""
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m))
        assert [tuple(s) for s in row[name]] == want
    (text,) = [r["text"] for r in found.filter(f"size({name}) > 0").collect()]
    (masked,) = [r["text"] for r in secret_scan.redact(documents).filter("doc_id = 15 and text like 'x =%'").collect()]
    assert masked.count("[secret]") == 4 and "AKIA" not in masked and "token=short" in masked
    assert secret_scan.redact(documents).filter("text not like '%[secret]%' or text is null").count() == documents.count() - 1
    assert "AKIA" in text


def test_mandatory_trigrams():
    assign, access, hexes = (secret_scan.mandatory(r) for r in secret_scan.RULES)
    assert len(assign) == 1 and frozenset({"tok", "oke", "ken"}) in assign[0] and len(assign[0]) == 6
    assert access == [frozenset({frozenset({"AKI", "KIA"})})] and hexes == []


def test_repeats(documents):
    texts = pairs(documents)
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = {k + n for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for n in range(35)}
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r) for r in repeats.remove_repeats(documents).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: token_counts.token_counts(d, production.PIECE_BPE),
        pack,
        near_texts.near_duplicates,
        secret_scan.scan,
        secret_scan.redact,
        repeats.remove_repeats,
    ],
)
def test_empty_table(documents, operator):
    assert rows_of(operator(documents.limit(0))) == []


def test_secrets_beside_columns_of_any_name(workers):
    text = "password = abcd1234efgh and on"
    rows = [(1, text, 5, 6, 7, 8, 9), (2, None, 5, 6, 7, 8, 9)]
    schema = "doc_id long, text string, row_key int, rules int, row int, __text int, `a.b` int"
    frame = workers.createDataFrame(rows, schema)
    scanned = secret_scan.scan(frame)
    assert scanned.columns == [*frame.columns, "secrets"]
    masked = secret_scan.redact(frame)
    assert masked.columns == frame.columns
    assert sorted(tuple(r) for r in masked.collect()) == [(1, "[secret] and on", 5, 6, 7, 8, 9), (2, None, 5, 6, 7, 8, 9)]
