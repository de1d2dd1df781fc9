"""Each corpus operator against a plain version of itself, on small tables with awkward rows."""

import base64
import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, langid, licenses, lm, packing, quality, simhash, sketch, warc
from quillon.llm.shared import id_remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, block long"
WORDS = "the of and to in tion ha er on re an he ed nd ou".split()


def text(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [text(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " x", None, "", " \n\t ", "a", "a b", "é ß Ünï  🙂　z\x1cq's 12 '\n\n  end ", "the the the the the the " * 30, "l1 word\nl1 word\n\nl1 word\n l1 word", "# $ % ### && |", text(rng, 30000)]
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, 0, 9, "clash", 7) for i, t in enumerate(texts)]
    return [*out, out[5], (None, texts[2], "en", "s1", 0, 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words_of(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# op4


def plain_fingerprint(t):
    w = words_of(ascii_lower(t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs, rows):
    got = simhash.near_groups(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter(prints)
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    low = {g: min((p[0] for p, h in zip(prints, group) if h == g and p[0] is not None), default=None) for g in group}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((p[0], low[g]) for p, g in zip(prints, group))


def test_links_between_random_fingerprints(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(20):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(frame, tile_rows=8)).collect()}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    group = {s: s for s in signed}
    changed = True
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(group[a], group[b])
            if group[a] != m or group[b] != m:
                group[a] = group[b] = m
                changed = True
    assert all(roots.get(s, s) == group[s] for s in signed)


def test_dense_tiles_are_thinned():
    rng = np.random.default_rng(0)
    base = np.uint64(0xABCDEF)
    left = np.unique(base ^ (np.uint64(1) << rng.integers(0, 20, 15).astype(np.uint64)))
    u, v = simhash.forest(left, left, 3, True)
    assert 0 < len(u) <= len(left)
    u, v = simhash.forest(left, np.unique(left ^ np.uint64(1 << 40)), 3, False)
    assert set(u) | set(v) >= set(left) and len(u) <= 4 * len(left)


def test_drop_near_copies_keeps_one_each(docs, empty, rows):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = simhash.near_groups(docs).filter("component_id is not null").select("component_id").distinct()
    assert sorted(i for i in ids if i is not None) == sorted(r.component_id for r in groups.collect())
    assert simhash.near_groups(empty).collect() == [] and simhash.drop_near_copies(empty).collect() == []


# op5


def test_quality_counts_match_brute_force(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.with_counts(docs).collect())
    want = Counter()
    for r in rows:
        w, t = words_of(r[1]), r[1] or ""
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    assert quality.judged(empty).collect() == [] and quality.keep_good(empty).columns == empty.columns


def test_a_bad_host_takes_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "bad", None, "spam.example", 0, 0, "", 0) for i in range(200)]
    rows += [(1000 + i, good, None, f"host{i % 20}", 0, 0, "", 0) for i in range(400)] + [(5000, good, None, None, 0, 0, "", 0)]
    judged = quality.judged(spark.createDataFrame(rows, DOCS))
    kept = {r.doc_id for r in judged.filter("kept").collect()}
    assert kept == {1000 + i for i in range(400)} | {5000}


def test_hosts_of_one_document_are_not_condemned(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad" if i % 10 == 0 else good, None, f"host{i}", 0, 0, "", 0) for i in range(1000)]
    judged = quality.judged(spark.createDataFrame(rows, DOCS))
    assert judged.filter("kept").count() == 900 and judged.filter("base_failed").count() == 100


def test_prior_matches_beta_binomial_moments(spark):
    rng = random.Random(12)
    hosts = [(f"h{i}", n := rng.randint(1, 60), rng.randint(0, n)) for i in range(50)]
    frame = spark.createDataFrame([(h, n, f) for h, n, f in hosts], "host string, n long, failed long")
    m, s = quality.prior(frame, "failed")
    total, k = sum(n for _, n, _ in hosts), len(hosts)
    assert m == pytest.approx(sum(f for *_, f in hosts) / total)
    spread = sum(n * (f / n - m) ** 2 for _, n, f in hosts)
    rho = (spread / (m * (1 - m)) - (k - 1)) / (total - k - sum(n * (n - 1) for _, n, _ in hosts) / total)
    assert s == pytest.approx(min(1e6, max(1.0, 1 / rho - 1)))


def test_kept_documents_keep_their_own_columns(spark):
    good = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, good, "s", 7, False, None), (2, "bad", "s", 8, True, "x")], "doc_id long, text string, source string, n_words long, kept boolean, __host string")
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [(1, good, "s", 7, False, None)]


# op3


def test_language_model_learns_and_abstains(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": "kra plo stu vem".split(), "bb": "lio nea uma oui".split()}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(30)), k if i % 9 else None, "s", 0, 0, "", 0) for i, k in enumerate(rng.choices(["aa", "bb"], k=400))]
    truth = {r[0]: ("aa" if "kra" in r[1] or "plo" in r[1] or "stu" in r[1] or "vem" in r[1] else "bb") for r in rows}
    rows += [(900, None, "aa", "s", 0, 0, "", 0), (901, "12 ... !", "aa", "s", 0, 0, "", 0), (902, "", "bb", "s", 0, 0, "", 0)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == k and 0.5 < got[i].score <= 1 for i, k in truth.items())
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert langid.identify(empty).collect() == []
    kept = langid.keep_known(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and kept.count() == 400


def test_letters_beyond_the_basic_plane_count(spark):
    rng = random.Random(2)
    kinds = {"got": [chr(c) for c in range(0x10330, 0x10341)], "ff": [chr(c) for c in range(0x1E922, 0x1E933)]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=4)) for _ in range(20)), k, "s", 0, 0, "", 0) for i, k in enumerate(rng.choices(["got", "ff"], k=200))]
    frame = spark.createDataFrame([*rows, (900, "🙂 🙂", "ff", "s", 0, 0, "", 0)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score > 0.5) for r in langid.identify(frame).collect()}
    assert got == {r[0]: (r[2], True) for r in rows} | {900: ("und", False)}
    assert langid.keep_known(frame).count() == 200


def plain_language_model(rows, dims):
    """idf, FTRL weights and temperature by loops over coordinates, of (id, text, lang) in the order of training."""
    langs = sorted({k for _, _, k in rows})
    counts = [langid.features(t, dims) for _, t, _ in rows]
    idf = [math.log((1 + len(rows)) / (1 + sum(c[j] > 0 for c in counts))) + 1 for j in range(dims)]

    def vector(c):
        x = {j: math.log1p(c[j]) * idf[j] for j in range(dims) if c[j]}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {j: v / norm for j, v in x.items()} | {dims: 1.0}

    def fit(examples):
        z, n = {}, {}

        def weight(j, k):
            zi, l1, l2 = z.get((j, k), 0.0), 0 if j == dims else langid.L1, 0 if j == dims else langid.L2
            return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((langid.BETA + math.sqrt(n.get((j, k), 0.0))) / langid.ALPHA + l2)

        for _ in range(langid.EPOCHS):
            for x, y in examples:
                w = {(j, k): weight(j, k) for j in x for k in range(len(langs))}
                e = [math.exp(sum(x[j] * w[j, k] for j in x)) for k in range(len(langs))]
                for k in range(len(langs)):
                    for j in x:
                        g, old = x[j] * (e[k] / sum(e) - (k == y)), n.get((j, k), 0.0)
                        n[j, k] = old + g * g
                        z[j, k] = z.get((j, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[j, k]
        return lambda x: [sum(x[j] * weight(j, k) for j in x) for k in range(len(langs))]

    data = [(vector(c), langs.index(k)) for c, (_, _, k) in zip(counts, rows)]
    logits, aside = fit(data), []
    for f in range(langid.FOLDS):
        part = fit([d for i, d in enumerate(data) if i % langid.FOLDS != f])
        aside += [(part(x), y) for x, y in data[f :: langid.FOLDS]]
    n = len(aside)

    def loss(t):
        total = 0.0
        for z, y in aside:
            e = [math.exp(v / t) for v in z]
            total -= sum(((n + 1) / (n + len(langs)) if k == y else 1 / (n + len(langs))) * math.log(v / sum(e)) for k, v in enumerate(e))
        return total

    return langs, lambda t: logits(vector(langid.features(t, dims))), loss


@pytest.mark.parametrize("size", [90, 24])
def test_language_model_matches_plain_ftrl(spark, size):
    rng = random.Random(size)
    rows = [(i, "".join(rng.choices("abcdef" if k == "aa" else "defghi", k=rng.randint(3, 9))) + " é", k) for i, k in enumerate(rng.choices(["aa", "bb", "cc"], [5, 3, 2], k=size))]
    dims = 64
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(frame, dims=dims)
    order = {r.doc_id: r.t for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("t")).collect()}
    langs, logits, loss = plain_language_model(sorted(rows, key=lambda r: order[r[0]]), dims)
    assert model.langs == langs
    for _, t, _ in rows[:10]:
        assert model.logits(langid.features(t, dims)) == pytest.approx(logits(t), rel=1e-4, abs=1e-5)
    assert all(loss(model.temperature) <= loss(model.temperature * f) + 1e-6 for f in (0.9, 0.99, 1.01, 1.1) if abs(math.log(model.temperature * f)) < 4)


def test_fitted_rows_mix_frequent_and_rare_languages(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 60 == 0, "rare").otherwise("often").alias("lang"), F.lit("text").alias("text"))
    model = langid.train(frame, fit_rows=200, dims=64)
    # the same text in both languages: an even share of each was fitted, in turns, so that neither wins by far
    p = np.exp(model.logits(langid.features("text", 64)))
    assert model.langs == ["often", "rare"] and 0.3 < p[0] / p.sum() < 0.7


def test_language_stage_takes_columns_of_any_name(spark):
    rows = [(i, "eins zwei drei" if i % 2 else "one two three", "de" if i % 2 else "en", 0.5, "x", "y", [1]) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, __text string, tags array<int>")
    kept = langid.keep_known(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
    slab, langid.SLAB = langid.SLAB, 7
    try:
        cut = langid.features("a long text without an end " * 50)
    finally:
        langid.SLAB = slab
    assert (cut == langid.features("a long text without an end " * 50)).all()


# op8


def test_packing_is_whole_and_tight(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(700, "<|endoftext|>é <|STARTOFTEXT|>a<|startoftext|>b|> <| x", None, None, 0, 0, "", 0), (701, "\x0b a\x0cB\r\n\t<|endoftext|><|endoftext|> ", None, None, 0, 0, "", 0)]
    docs, rows = docs.unionByName(docs.sparkSession.createDataFrame(odd, DOCS)), [*rows, *odd]
    assert 49407 in tokenizer.encode(odd[0][1], add_special_tokens=False).ids
    got = packing.packed_documents(docs, path).collect()
    want = Counter()
    import zlib

    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r[0], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 4096) + 1
    assert packing.packed_documents(empty, path).collect() == []


def test_plain_words_of_a_block_are_merged_in_one_call():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, (ids, tokens) = random.Random(8), packing.word_tokens(path)
    assert len(ids) == len(tokens) == len(set(tokens)) and packing.merges_by_rank(path)
    strings = [t.rstrip(b"\n").decode() for t in tokens if re.fullmatch(rb"[!-;=-~]+\n?", t)]
    texts = [" ".join("".join(rng.choices(strings, k=rng.randint(1, 5))) for _ in range(400)) for _ in range(20)]
    texts += ["Don't we'LL \t'tis--'s 1234 x<y |>\n", "", " ", "ÀÉÿ ßØÞ Ünïcode's", "a" * 3000, "q" + "they'reall" * 400]
    words = packing.WordTokenizer(path)
    tokenizer, words.tokenizer, words.model = words.tokenizer, None, None  # neither is asked for a plain word
    got, ends = words.block(pa.array([*texts, None]))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(got, ends[:-1])] == [*want, []]
    words.tokenizer = tokenizer
    other = ["<|endoftext|>A B", "e\u0301t\u00e9 don\u2019t \u4e2d\u6587 H\u0331", "plain only", "\x00\x1c 5\u00d76"]
    got, ends = words.block(pa.array(other))
    assert [x.tolist() for x in np.split(got, ends[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in other]


@pytest.mark.parametrize("older", [False, True])
def test_tokens_that_their_own_text_does_not_give_are_not_merged_by_rank(spark, tmp_path, older):
    import json
    import zlib

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    pairs, letters = [("b", "c"), ("a", "b"), ("ab", "c")], [t for t, i in file["model"]["vocab"].items() if i < 512]
    file["model"]["vocab"] = {t: i for i, t in enumerate([*letters, *map("".join, pairs)])}
    file["model"]["merges"] = [" ".join(p) for p in pairs] if older else pairs
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    text, tokenizer = "abcx Abc ab bcd", Tokenizer.from_file(str(path))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    # abc is made of ab and c, but in abcx it is b and c that merge first
    assert not packing.merges_by_rank(str(path)) and packing.WordTokenizer(str(path)).block(pa.array([text]))[0].tolist() != want
    (row,) = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(path)).collect()
    assert (row.length, row.ids_crc32) == (len(want) + 1, zlib.crc32(np.array([*want, 1], "<u4").tobytes()))


def test_sum_of_squares_takes_the_least_sum():
    lengths = np.array(random.Random(2).choices(range(1, 40), k=200))
    bins, offsets = packing.sum_of_squares(lengths, 64)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        s, fits = lengths[i], [b for b, g in gaps.items() if g >= lengths[i]]
        if bins[i] not in gaps:
            assert not fits
            gaps[bins[i]] = 64
        else:
            total = lambda b: sum(c * c for g, c in Counter({**gaps, b: gaps[b] - s}.values()).items() if g)  # noqa: E731, B023
            assert total(bins[i]) == min(map(total, fits))
        assert offsets[i] == 64 - gaps[bins[i]]
        gaps[bins[i]] -= s


# op9


def test_edit_report_matches_brute_force(docs, rows, empty):
    def grams(t):
        w = words_of(ascii_lower(t or ""))
        return {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))} if w else set()

    unique = [r for r in rows if r[0] is not None and r[0] != 5]
    frame = docs.filter("doc_id is not null and doc_id <> 5")
    order = sorted(unique, key=lambda r: -r[0])
    got = {r.doc_id: r for r in sketch.edit_report(frame, k=1 << 20).collect()}
    assert len(got) == len(order)
    for a, b in zip(order, order[1:] + order[:1]):
        mine, other = a[1] or "", b[1] or ""
        cut = len(mine) // 3
        changed = mine[: len(mine) - cut] + other[:cut]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h:016x}" for h in sorted(grams(mine)))
        assert r.near_edited == pytest.approx(like(grams(mine), grams(changed))) and r.near_next == pytest.approx(like(grams(mine), grams(other)))
    assert sketch.edit_report(docs).count() == len(rows) and sketch.edit_report(empty).collect() == []
    assert sketch.edit_report(docs.limit(1)).count() == 1


def test_sketch_estimates(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(5000)]
    a = rng.sample(pool, 3000)
    ta, tb = " ".join(a), " ".join(a[:2000])
    sa, sb = sketch.sketch(ta, 256), sketch.sketch(tb, 256)
    assert sketch.resemblance(sa, sb, 256) == pytest.approx(2 / 3, abs=0.1) and sketch.containment(sb, sa, 256) > 0.9
    assert sketch.distinct(sa, 256) == pytest.approx(2996, rel=0.2)
    assert (sketch.merge(sa, sb, 256) == sa).mean() > 0.99 and (sketch.from_hex(sketch.to_hex(sa)) == sa).all()
    frame = spark.createDataFrame([(1, "p", ta), (2, "p", tb), (3, "q", None)], "doc_id long, part string, text string")
    merged = {r.part: r.hashes for r in sketch.merged(sketch.sketches(frame, ("part",), k=256), "part", 256).collect()}
    assert [(h + 2**63) for h in merged["p"]] == sketch.merge(sa, sb, 256).tolist() and "q" not in merged


# op2


def test_bpe_round_trip(docs, rows, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    tokens = bpe.token_bytes(docs.sparkSession, path)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), tokens).collect())
    assert got == Counter((r[0], tuple(encoder.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert bpe.decode(bpe.encode(empty, path, public_tokenizers.PATTERN), tokens).collect() == []


def test_pretokens_of_odd_white_space():
    import regex

    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choices([" ", "  ", "\n", "\t", "a", "Bc", "'s", "é", "12", "!", " ", "　", "\x1c"], k=rng.randint(0, 12)))
        u = "".join(rng.choices(["a b", " ", "C.", "x1"], k=rng.randint(0, 5)))
        codes, ends, words = bpe.number_pretokens(pa.array([t, None, u]), public_tokenizers.PATTERN)
        found = [[words[i] for i in codes[a:b]] for a, b in zip([0, *ends[:-1]], ends)]
        assert found == [regex.findall(public_tokenizers.PATTERN, x) for x in (t, "", u)]


def test_decoding_fails_on_unknown_ids_and_keeps_nulls(spark):
    tokens = spark.createDataFrame([(0, bytearray(b"a")), (2, bytearray(b"\xff\x00"))], "id int, bytes binary")
    frame = spark.createDataFrame([(1, [0, 2, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(frame, tokens).collect()} == {1: b"a\xff\x00a", 2: None, 3: bytearray()}
    for bad in (1, -1, 3):
        with pytest.raises(Exception, match="not in the token-byte table"):
            bpe.decode(spark.createDataFrame([(1, [0, bad])], "doc_id long, ids array<int>"), tokens).collect()


# op6


class PlainKatz:
    """Counts, discounts and probabilities by dictionaries."""

    def __init__(self, train, order):
        self.order, self.n = order, sum(map(len, train))
        self.counts = [Counter(g for t in train for g in self.grams(t, k)) for k in range(1, order + 1)]
        self.starts = len(train)
        self.d = [lm.discounts(Counter(x.values())) for x in self.counts]
        self.unknown = 1 - sum(self.less(c, 0) for c in self.counts[0].values()) / self.n if self.n else 1.0
        self.after = {}
        for k, x in enumerate(self.counts):
            for g in x:
                self.after.setdefault(g[:-1], []).append(g)
        self.total, self.alpha, self.p = map(functools.cache, (self.total, self.alpha, self.p))

    def grams(self, tokens, k):
        padded = ["<s>"] * (k - 1) + tokens
        return [tuple(padded[i : i + k]) for i in range(len(tokens))]

    def less(self, c, k):
        return c * self.d[k][c - 1] if c <= lm.MAX_DISCOUNTED else c - lm.TOP_LOSS

    def total(self, context):
        return sum(self.counts[len(context)][g] for g in self.after.get(context, []))

    def p(self, gram):
        k = len(gram) - 1
        c = self.counts[k][gram]
        if c:
            return self.less(c, k) / (self.total(gram[:-1]) if k else self.n)
        return self.alpha(gram[:-1]) * self.p(gram[1:]) if k else self.unknown

    def alpha(self, context):
        grams = self.after.get(context)
        return (1 - sum(map(self.p, grams))) / (1 - sum(self.p(g[1:]) for g in grams)) if grams else 1.0

    def score(self, tokens):
        return sum(math.log10(self.p(g)) for g in self.grams(tokens, self.order))


def _out_of(i):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_scores_and_normalisation(docs, rows, empty, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "PART_BYTES", 60000)
    tokens = [[*words_of(ascii_lower(r[1] or ""))[:200 if order == 3 else None], lm.END] for r in rows]
    cut = [(*r[:1], None if r[1] is None else " ".join(t[:-1]), *r[2:]) for r, t in zip(rows, tokens)]
    frame = docs.sparkSession.createDataFrame(cut, DOCS).repartition(3).cache()
    plain = PlainKatz([t for r, t in zip(rows, tokens) if not _out_of(r[0])], order)
    n, v, uni = plain.n, len(plain.counts[0]), plain.counts[0]
    for context in [c for c in plain.after if len(c) == order - 1][:25]:
        assert sum(plain.p((*context, *w)) for w in uni) + plain.p((*context, "never seen")) == pytest.approx(1)
    want = Counter((r[0], len(t), sum(uni[w,] > 0 for w in t), round(sum(math.log10((uni[w,] + 1) / (n + v + 1)) for w in t), 6), round(plain.score(t), 6)) for r, t in zip(rows, tokens))
    got = lm.scores(frame, id_remainder("doc_id", 7) == 2, order=order).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(r.held_out == _out_of(r.doc_id) and r.train_tokens == n for r in got)
    frame.unpersist()


def test_katz_model_is_stored_and_scores_other_tables(spark, docs, rows, empty):
    learned = [(r[0], " ".join(words_of(r[1])[:60])) for r in rows]
    model = lm.train(spark.createDataFrame(learned, "doc_id long, text string").repartition(2), order=3)
    plain = PlainKatz([[*words_of(ascii_lower(t)), lm.END] for _, t in learned], 3)
    grams, contexts = model.grams(spark).collect(), model.contexts(spark).collect()
    assert Counter((r.order, r["count"]) for r in grams) == Counter((k, c) for k, x in enumerate(plain.counts, 1) for c in x.values())
    assert sorted(round(r.p, 9) for r in grams) == sorted(round(plain.p(g), 9) for x in plain.counts for g in x)
    assert sorted(round(r.alpha, 6) for r in contexts) == sorted(round(plain.alpha(c), 6) for c in plain.after if c)
    other = [(1, learned[3][1] + " Zzz zzz the of"), (1, "the of the of"), (2, None), (3, "unknown words only"), (None, "The " * 500)]
    want = Counter((i, round(plain.score([*words_of(ascii_lower(t or "")), lm.END]), 6)) for i, t in other)
    assert Counter((r.doc_id, round(r.score, 6)) for r in lm.score(spark.createDataFrame(other, "doc_id long, text string"), model).collect()) == want
    held = id_remainder("doc_id", 7) == 2
    assert lm.scores(empty, held).collect() == [] and {r.score for r in lm.scores(docs, F.lit(True)).collect()} == {0.0}
    assert lm.score(empty, model).collect() == []


# op7


def test_warc_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, f"http://www.H{i % 5}.example.com/P{i % 3}?q={i}", text(rng, 50)) for i in range(60)]
    rows += [(100, "https://a.b/", None), (90, "https://a.b/", ""), (80, None, rows[3][2]), (3, "http://dup.example/", rows[3][2]), (None, "x y", rows[4][2]), (None, "z", "only"), (200, "é", "w" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first_id int").repartition(3)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        body, low = (h or "").encode(), first.get(h or "")
        refers = low if low is not None and i != low else None
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers] += 1
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_loser_tree_merges():
    rng = random.Random(7)
    for k in range(6):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("fan_in", [3, 128])
def test_capture_history_is_one_order_over_all_ranges(spark, monkeypatch, tmp_path, fan_in):
    for name, value in (("RANGE_ROWS", 100), ("RUN_ROWS", 90), ("GROUP_ROWS", 16), ("FAN_IN", fan_in), ("WINDOW_ROWS", 7), ("OPEN_FILES", 2), ("FILE_BYTES", 2000)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(8)
    rows = [(i if i % 50 else None, f"http://h{rng.choice([0, 0, 0, 0, 1, 2, 3])}.example/", f"p{i % 40}" if i % 3 else text(rng, 5)) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    runs = warc.write(pages, f"file://{tmp_path}")
    assert runs.count() >= 10
    got = warc.read(runs, f"file://{tmp_path}").collect()
    keys = [(r.url_key, r.captured_at, r.file, r.offset) for r in got]
    assert keys == sorted(keys) and len(set(keys)) == len(rows) and [r.position for r in got] == list(range(len(rows)))
    assert [tuple(r)[:9] for r in warc.capture_history(runs, f"file://{tmp_path}").collect()] == [tuple(r)[:9] for r in got]
    number, before = Counter(), {}
    for r in got:
        number[r.url_key] += 1
        assert (r.capture_no, r.previous_page_id, r.record_page_id) == (number[r.url_key], before.get(r.url_key), r.page_id)
        before[r.url_key] = r.page_id
    assert Counter((r.page_id, r.url_key) for r in got) == Counter((i, warc.url_key(u)) for i, u, _ in rows)


def test_captures_come_back_in_the_merged_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/", f"p{i}") for i in range(30)], "page_id long, url string, html string").repartition(3)
    back = warc.round_trip(pages).collect()
    assert [(r.position, r.page_id, r.capture_no, r.previous_page_id) for r in back] == [(k, i, i // 3 + 1, i - 3 if i > 2 else None) for k, i in enumerate(sorted(range(30), key=lambda i: (i % 3, i)))]
    assert warc.captured_at(10**15) == warc.captured_at(None) == "" and warc.parse(warc.record(10**15, "u", b"x", None, warc.digest(b"x")))["page_id"] == 10**15


# op10


def plain_repair_cost(roles):
    best = {"": 0}
    for role in roles:
        new = {}
        for last, c in best.items():
            for given in chat.ROLES:
                cost = c + (0 if given == role else chat.RELABEL)
                ways = [cost] * ((last, given) in chat.LEGAL) + [cost + chat.MERGE] * (last == given) + [cost + chat.INSERT for f in chat.ROLES if (last, f) in chat.LEGAL and (f, given) in chat.LEGAL]
                for w in ways:
                    new[given] = min(new.get(given, w), w)
        best = new
    return min(c + chat.FINAL[chat.STATES.index(s)] for s, c in best.items())


def test_chat_repair_over_seams(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "bot", None]), f"t{i}") for i in range(400)]
    for conv in range(2, 40):
        rows += [(conv, i, rng.choice(["user", "assistant", "system"]), f"c{conv}-{i}") for i in range(rng.randint(1, 6))]
    rows += [(50, None, "user", None), (50, 1, "assistant", ""), (50, 1, "assistant", ""), (None, 1, "user", "lost")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(4)
    got = {}
    for r in chat.formatted(frame).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for conv, turns in got.items():
        turns.sort(key=lambda r: r.seq)
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:2]) + ((r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        assert [t.turn for t in turns] == [r[1] for r in mine]
        assert sum(t.cost for t in turns) == plain_repair_cost([r[2] for r in mine])
        whole = "".join(t.rendered for t in turns)
        roles = [part.split("|>")[0] for part in whole.split("<|") if part and not part.startswith("end|>")]
        assert roles[:1] != ["assistant"] and all((a, b) in chat.LEGAL for a, b in zip(["", *roles], roles)) and roles[-1] == "assistant"
        assert whole.count("<|end|>\n") == len(roles) and all((r[3] or "") in whole for r in mine)
    assert chat.formatted(frame.limit(0)).collect() == []


def test_repairs_do_not_depend_on_partitions(spark):
    rng = random.Random(10)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "bot", None]), f"t{i}") for i in range(600)]
    rows += [(2, i, rng.choice(["user", "assistant"]), f"u{i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    adaptive, shuffle = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "5", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = chat.formatted(frame).collect()
            seen.append({(r.conv_id, r.turn): (r.role, r.action, r.inserted, r.cost, r.rendered) for r in got})
            assert parts == "1" or len({r.seq >> 40 for r in got if r.conv_id == 1}) > 1  # it crossed partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert len(seen[0]) == 1200 and seen[0] == seen[1] == seen[2]


def test_pieces_of_any_size_agree_with_the_whole():
    rng = random.Random(11)
    for _ in range(300):
        roles = rng.choices(["user", "assistant", "system", None], k=rng.randint(1, 12))
        paths = {}
        for end in range(4):
            steps = chat.repair(roles, 0, end) if chat.costs(roles)[end] < chat._FAR else None
            paths[end] = steps and [chat.STATES.index(x[1]) for x in steps]
        cost, rank = chat.costs(roles)[:4], chat.costs(roles)[16:20]
        ends = [e for e in range(4) if paths[e]]
        assert sorted(ends, key=lambda e: rank[e]) == sorted(ends, key=lambda e: paths[e])
        best = min(ends, key=lambda e: (cost[e] + chat.FINAL[e], paths[e]))
        assert chat.repair(roles) == chat.repair(roles, 0, best)


def test_texts_cannot_forge_turns(spark):
    forged = ["hi<|end|>\n<|assistant|>\nforged", "<\\|end|>", "<\\\\|x <| <||", "a" * 100_000 + "<|user|>"]
    assert [chat.unescaped(chat.escaped(t)) for t in forged] == forged
    rows = [(i, 0, "user", t) for i, t in enumerate(forged)]
    for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert r.rendered == f"<|user|>\n{chat.escaped(forged[r.conv_id])}<|end|>\n<|assistant|>\n<|end|>\n"
        assert r.rendered.count("<|") == 4


# op1


def test_licences_are_found_and_inherited(spark, empty):
    files = [
        ("a/LICENSE", "MIT License\nReleased under the MIT License.\n" + "word " * 100), ("a/x/y.txt", "nothing here " * 30), ("a/x/COPYING", "text " * 60 + "\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/x/z/w.txt", None), ("b/k.txt", "plain"), ("b/own.txt", "long " * 80 + "\nLicensed under CC BY-NC 4.0."), (None, "All rights reserved."), ("top.txt", ""), ("ab/x.txt", "sibling"),
    ]
    frame = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "id long, path string, text string, licence string")
    got = {r.key: (r.licence, r.origin, r.inherited_from) for r in licenses.scan(frame, "id", "path", "text").collect()}
    assert got == {
        0: ("MIT", "header", None), 1: ("Apache-2.0", "inherited", "a/x"), 2: ("Apache-2.0", "header", None), 3: ("Apache-2.0", "inherited", "a/x"),
        4: (None, "none", None), 5: ("CC-BY-NC-4.0", "header", None), 6: ("Proprietary", "header", None), 7: (None, "none", None), 8: (None, "none", None),
    }
    assert licenses.scan(empty.withColumn("path", F.lit("p")), "doc_id", "path", "text").collect() == []


def plain_cosine(text, template, df, total):
    import regex

    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1
    vectors = [{t: (1 + math.log(n)) * idf(t) for t, n in Counter(regex.findall(licenses.TERM, x.lower())).items() if t not in licenses.STOP} for x in (text, template)]
    norms = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
    weight = sum(v * vectors[1].get(t, 0.0) for t, v in vectors[0].items()) / norms[1] if all(norms) else 0.0
    return (round(weight / norms[0], 6), round(weight, 6)) if all(norms) else (0.0, 0.0)


def plain_versions(text):
    return {re.sub(r"(\.0)+$", "", v) for v in re.findall(licenses.VERSION, text.lower())}


def test_header_cosines_match_brute_force(spark):
    import regex

    rng = random.Random(13)
    templates = [(k, t) for k, texts in licenses.TEMPLATES.items() for t in texts]
    df = Counter(t for _, x in templates for t in set(regex.findall(licenses.TERM, x.lower())))
    texts = [t for _, t in templates]
    for _ in range(80):
        words = rng.choice(texts).split() + rng.choice(texts).split()[: rng.randint(0, 6)]
        texts.append(" ".join(w for w in words if rng.random() < 0.8) + rng.choice(["", "\n\nMore prose of no use here. And more", " trailing words on the line " * 3]))
    texts += ["", None, "/*\n * Copyright (c) 2020 Jane Doe. All rights reserved.\n */\ncode", "prose. " * 40 + "Released under MIT. " + "and seventeen more words " * 5, "Ein Satz ohne alles\n" * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    cut = frame.select("row", licenses.segments(F.coalesce("text", F.lit("")), licenses.anchor()).alias("segments"))
    got = {r.row: (r.licence, r.cosine, r.whole) for r in licenses.headers(cut).collect()}

    def parts(t):
        s = regex.split(r"(?<=[.!?;]) ", regex.sub(r"[ \t\n\x0b\f\r]+", " ", t))
        runs = [" ".join(s[i : i + k]) for i in range(len(s)) for k in (1, 2, 3)]
        return [t, *regex.split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", t), *t.split("\n"), *runs]

    want = {}
    full = {x for k, xs in licenses.TEMPLATES.items() if k in licenses.WHOLE_TEXTS for x in xs[-1:]}
    for i, t in enumerate(texts):  # all parts are compared, without the anchor
        found = []
        for at, p in enumerate(parts(t or "")):
            fit = [(k, x) for k, x in templates if not plain_versions(p) or not plain_versions(x) or plain_versions(p) & plain_versions(x)]
            (cosine, weight), k, x = min(((plain_cosine(p, x, df, len(templates)), k, x) for k, x in fit), key=lambda v: (-v[0][1], v[1]))
            if cosine >= licenses.MIN_COSINE:
                found.append((k == licenses.LAST, -weight, -cosine, k, at == 0 and x in full))
        if found:
            best = min(found)
            want[i] = (best[3], -best[2], any(f[4] for f in found))
    assert {i: (k, pytest.approx(c, abs=2e-6), w) for i, (k, c, w) in want.items()} == got
    assert all(got[i][0] == k for i, (k, _) in enumerate(templates)) and got[len(texts) - 2][0] == "MIT"


def test_licences_of_real_files(spark):
    """Variants of known texts, current identifiers, versions and directories."""
    bsd = licenses.TEMPLATES["BSD-3-Clause"][-1].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "REGENTS OR").replace("copyright holder", "University")
    x11 = licenses.TEMPLATES["MIT"][-1].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version."
    files = {
        "bsd/COPYRIGHT.txt": ("Copyright (c) 1994 The Regents of the University. All rights reserved.\n\n" + bsd, "BSD-3-Clause"),
        "bsd/a.c": ("int main", "BSD-3-Clause"),
        "x11/LICENSE": ("Copyright (C) 1996 X Consortium\nAll rights reserved.\n\n" + x11 + "\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising.", "MIT"),
        "x11/a.c": ("int main", "MIT"),
        "mix/LICENSE": ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "mix/gpl2.c": ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0-only"),
        "mix/gpl3.c": ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0-or-later"),
        "mix/agpl.c": ("# SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"),
        "mix/lgpl.c": ("SPDX-License-Identifier: LGPL-2.1-or-later.", "LGPL-2.1-or-later"),
        "mix/two.rs": ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + "fn main " * 50, "MIT OR Apache-2.0"),
        "mix/with.c": ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0"),
        "mix/unknown.c": ("SPDX-License-Identifier: LicenseRef-Acme", "LicenseRef-Acme"),
        "mix/none.c": ("int y;", "Apache-2.0"),
        "v/one.py": ("# SPDX-License-Identifier: MIT", "MIT"),
        "v/two.py": ("print()", None),
        "l/lgpl21.c": (lgpl.format("2.1"), "LGPL-2.1"),
        "l/lgpl3.c": (lgpl.format("3"), "LGPL-3.0"),
        "c/by3.txt": ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
        "c/by4.txt": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        "g/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n" + "Everyone is permitted to copy and distribute verbatim copies. " * 30, "GPL-3.0"),
        "g/x.c": ("int z;", "GPL-3.0"),
        "m/LICENSE": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n" + "words of no notice here " * 40, "MPL-2.0"),
        "p/a.c": ("Copyright 2020 Acme. All rights reserved.", "Proprietary"),
    }
    frame = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    rows = licenses.scan(frame, "path", "path", "text").collect()
    assert {r.path: r.licence for r in rows} == {p: k for p, (_, k) in files.items()}
    assert {r.path for r in rows if r.origin == "inherited"} == {"bsd/a.c", "x11/a.c", "mix/none.c", "g/x.c"}


def test_rows_keep_their_own_licences(spark):
    mit = next(t for t in licenses.TEMPLATES["MIT"] if t.startswith("Permission"))
    files = [(None, "p/a.txt", "Released under the MIT License."), (None, "q/b.txt", "nothing"), (1, "r/c.txt", "nothing here at all"), (1, "s/d.txt", "Released under the MIT License. " + "zebra quagga okapi " * 200), (2, "t/LEGAL", "The MIT License\n\nCopyright 2021 X\n\n" + mit), (3, "t/u/e.txt", ""), (4, "s/f.txt", "plain"), (5, "v/g.txt", "w " * 300_000 + "\nAll rights reserved.")]
    frame = spark.createDataFrame(files, "id long, path string, text string").repartition(2)
    got = {r.path: (r.key, r.licence, r.origin, r.inherited_from) for r in licenses.scan(frame, "id", "path", "text").collect()}
    assert got == {
        "p/a.txt": (None, "MIT", "header", None), "q/b.txt": (None, None, "none", None), "r/c.txt": (1, None, "none", None), "s/d.txt": (1, "MIT", "header", None),
        "t/LEGAL": (2, "MIT", "header", None), "t/u/e.txt": (3, "MIT", "inherited", "t"), "s/f.txt": (4, None, "none", None), "v/g.txt": (5, "Proprietary", "header", None),
    }


def test_licence_query_inherits_from_true_ancestors(spark):
    from quillon.llm.queries import QUERIES

    rows = QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.path for r in rows}) == len(rows) == 1000 and len({r.path.count("/") for r in rows}) == 4
    given = {r.inherited_from for r in rows if r.origin == "inherited"}
    above = 0
    for r in rows:
        if r.origin != "header":
            steps = r.path.split("/")[:-1]
            near = next((a for n in range(len(steps), 0, -1) if (a := "/".join(steps[:n])) in given), None)
            assert r.inherited_from == near and (r.origin == "inherited") == (near is not None)
            above += near is not None and near != "/".join(steps)
    assert above > 0


# pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = [(i, "".join(rng.choices("abcdefgh", k=5)) + " " + text(rng, 60), "en", f"s{i % 5}", 0) for i in range(60)]
    bad = [(100, "short", "en", "s1", 0), (101, "same words again and " * 40, "en", "s1", 0), (102, None, "en", "s2", 0), (103, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "s2", 0), (104, clean[0][1], "en", "s3", 0)]
    path = f"file://{tmp_path}"
    spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == list(range(60))
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(range(60))


def test_pipeline_stages_handle_awkward_tables(spark, tmp_path):
    """Clashing columns, null and repeated ids, repeated rows; and no row at all."""
    import corpus_pipeline

    rng = random.Random(12)
    columns = "doc_id int, text string, lang string, source string, n_chars long, __id string, component_id int, lang_pred string, __host int, __bad int, kept int, score double, fp long"
    clean = [(i, "".join(rng.choices("abcdefgh", k=5)) + " " + text(rng, 60), "en", f"s{i % 5}", 0, f"x{i}", 1, "zz", 2, 3, 4, 0.5, 6) for i in range(40)]
    odd = [clean[3], clean[3], (None, *clean[4][1:]), (None, text(rng, 50), *clean[5][2:]), (7, text(rng, 55), *clean[7][2:]), (None, None, *clean[0][2:])]
    docs = spark.createDataFrame(clean + odd, columns).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], columns).dtypes
    kept = docs.collect()
    # one row of each id, but for ids all of whose rows are copies of an earlier document
    assert sorted({r.doc_id for r in kept if r.doc_id is not None}) == list(range(40)) and len([r for r in kept if r.doc_id == 3]) == 1
    seven = sorted(str(t) for i, t, *_ in clean + odd if i == 7)
    assert [r.text for r in kept if r.doc_id == 7] == seven[:1]
    empty_path = f"file://{tmp_path}/none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty_path}/documents.parquet")
    assert corpus_pipeline.run(spark, empty_path).collect() == []
