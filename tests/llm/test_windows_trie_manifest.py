"""Window packing, the conversation trie and the Merkle manifest against plain versions of themselves."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillon.llm import merkle, trie, windows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# op11


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"abcXYZ 123.,'\n\t  é中🙂  \x1c<|>", "<|endoftext|>", "'s", " don't ", "the", "  "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "a", " a", "a ", "\n", "a\nb c"]


def test_blocks_of_texts_have_the_tokenizers_ids(tokenizer):
    texts = odd_texts(3000)
    flat, ends = windows.ByteTokenizer(VOCABULARY, public_tokenizers.PATTERN).block(pa.array(texts))
    got = [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packing(rows, docs, tokenizer, capacity):
    """Each id in one piece, sequences without gaps, and none of them padded."""
    want = sorted(([d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")] for d, t in docs), key=str)
    held: dict = {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append(r)
    assert {d for d, _ in docs} == set(held)
    for d, copies in itertools.groupby(want, key=lambda w: w[0]):
        ids = next(copies)[1]
        n = 1 + sum(1 for _ in copies)
        pieces = sorted(held[d], key=lambda r: (r["start"], r["length"]))
        if n == 1:
            assert np.cumsum([0, *(p["length"] for p in pieces[:-1])]).tolist() == [p["start"] for p in pieces]
        assert sum(p["length"] for p in pieces) == n * len(ids)
        for p in pieces:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]])
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity


@pytest.mark.parametrize("capacity", [16, 1024])
def test_window_packing_places_every_id(spark, tokenizer, capacity):
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate(odd_texts(300, 2))] + [(1000 + i, "word " * rng.randint(0, 2500)) for i in range(30)] + [(5, "same")] + [(None, "none here")]
    frame = spark.createDataFrame([(d, t, 7, 8, 9) for d, t in docs if d != 5] + [(5, "same", 0, 0, 0)] * 3, "doc_id long, text string, task long, number long, length long").repartition(5)
    rows = windows.packed_documents(frame, VOCABULARY, public_tokenizers.PATTERN, capacity).collect()
    check_packing(rows, [x for x in docs if x[0] != 5] + [(5, "same")] * 3, tokenizer, capacity)


def test_window_packing_of_an_empty_table(spark):
    assert windows.packed_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_combinations_are_all_ways_to_fill_a_window():
    parts = windows.combinations(12)
    want = {tuple(sorted(c, reverse=True)) for n in (2, 3) for c in itertools.product(range(1, 12), repeat=n) if sum(c) == 12}
    assert sorted(tuple(x for x in p if x) for p in parts.tolist()) == sorted(want)


def test_weights_are_the_least_squares_and_counts_take_what_there_is():
    rng = np.random.default_rng(2)
    parts = windows.combinations(24)
    for scale in (3, 1000, 10**9):
        histogram = rng.integers(0, scale, 25)
        histogram[0] = histogram[24] = 0
        x = windows.least_squares(parts, histogram, rounds=400, added=8)
        residual = (histogram - windows.used(parts, x, 24))[1:] / max(1, histogram.max())
        slope = np.concatenate(([0], residual))[parts].sum(axis=1)
        # the conditions of an optimum: no combination improves, and those in use are level
        assert (x >= 0).all() and slope.max() < 1e-5 and abs(slope[x > 1e-9 * scale]).max() < 1e-5
        left = histogram - windows.used(parts, windows.rounded(parts, x, histogram), 24)
        assert left.min() >= 0
        same = (parts[:, :, None] == parts[:, None, :]).sum(axis=2)
        left[0] = 1 << 60
        assert (left[parts] // same).min(axis=1).max() == 0  # no whole combination is left


def test_frequent_length_goes_to_windows_by_arithmetic():
    histogram = np.zeros(17, np.int64)
    histogram[[5, 11, 3]] = [10**12, 10**12, 7]
    plan = windows.layout(histogram)
    number = np.array([0, 1, 10**12 - 1])
    a, b = plan.window(np.full(3, 5), number), plan.window(np.full(3, 11), number)
    assert (a[0] == b[0]).all() and (np.abs(a[1] - b[1]) > 0).all()
    assert [c[1] - c[0] for c in plan.cuts(0, 21)] == [16, 4, 1]


# op12


def md5_of(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_trie(rows):
    own: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    for c, turns in own.items():
        turns.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), md5_of(*y[1:])))
        own[c] = [y[1:] for y in turns]
    whole = {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + own[c][zlib.crc32(str(c).encode()) % 6 :]) for c in own}
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(whole[c]) == len(n)))).encode()).hexdigest()
    return sorted([(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], ends(n)) for n, m in members.items()], key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "x" * t, None, "same", "same", "same"])) for c in range(330) if rng.random() > 0.1 for t in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 12]))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(8)]
    rows += [(c, t, "user", f"deep{t if t < 33 else c}") for c in (2000, 2001, 2005) for t in range(40)]
    rows += [*rows[:30], (None, 1, "user", "x"), (3000, 0, "user", "long " * 50_000)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("segment", "shard"), [(128, 16_384), (4, 13), (7, 50)])
def test_trie(spark, turns, segment, shard):
    """Also with conversations over several segments, and nodes over several shards."""
    frame = spark.createDataFrame([(*r, "clash", 1) for r in turns], "conv_id long, turn long, role string, text string, id string, at long")
    got = trie.conversation_trie(frame, segment, shard).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(turns)


@pytest.mark.parametrize("rows", [[], [(107, 1, "user", "x")], [(100, 1, None, None), (107, None, "user", "")]])
def test_trie_of_few_rows(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == (plain_trie(rows) if rows else [])


# op13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """The root, and for each leaf the siblings to its left and right by level from below."""
    paths, held = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        over, over_held = [], []
        for a in range(0, len(digests), 16):
            run = digests[a : a + 16]
            for k in range(len(run)):
                for i in held[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            over.append(h(*run))
            over_held.append([i for x in held[a : a + 16] for i in x])
        digests, held = over, over_held
    return digests[0], paths


def plain_manifest(rows):
    leaf = [h(*map(field, r)) for r in rows]
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    start = [h(*map(field, r[:4]), field(lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else x for r, x in zip(rows, leaf)]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subroot, way = {}, {}
    for s in sources:
        own = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        subroot[s], paths = plain_tree([leaf[i] for i in own])
        way |= dict(zip(own, paths))
    root, above = plain_tree([subroot[s] for s in sources])
    above, out = dict(zip(sources, above)), []
    for i, r in enumerate(rows):
        path, x = way[i] + above[r[1]], start[i]
        for a, b in path:
            x = h(*a, x, *b)
        out.append((r[0], leaf[i], subroot[r[1]], root, h(*[d for a, b in path for d in a + b]), x, x == root))
    return sorted(out, key=str)


def manifest_rows(n):
    rng = random.Random(2)
    rows = [(i if rng.random() > 0.02 else None, rng.choice(["a", "a", "a", "b", "é", None, "", f"z{rng.randint(0, 40)}"]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "ABC é x" * rng.randint(0, 9), "abc"])) for i in range(n)]
    return rows + rows[:40] + [rows[7]] * 40 + [(n + 1, "a", None, None, "LONG text " * 30_000)]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("rows", [manifest_rows(1500), manifest_rows(20)[:1], manifest_rows(20)[:17], [(1, "a", None, None, "X"), (2, "b", None, None, "Y")]])
def test_manifest(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], FIELDS + ", digest string, at long")
    assert sorted(map(tuple, merkle.manifest(frame).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], FIELDS)).collect() == []


def test_records_hold_each_content_once(spark):
    """A thousand equal leaves make one record a level, and the ends of the levels."""
    nodes = spark.range(1000).selectExpr("'s' as group", "id as at", "1000L as n", "'same' as digest")
    above, _ = merkle.levels(nodes, "test")
    assert [x.count() for x in above] == [63, 4, 1] and merkle.records(above).count() == 2 + 2 + 1
