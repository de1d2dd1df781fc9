"""Word segmentation and the alias automaton, against trying everything."""

import itertools
import math
import random

import duckdb

from quillon.operators import aliases, segment


def every_cut(run):
    for n in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), n):
            yield [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]


def test_words_are_the_likeliest_of_all_cuts():
    rng = random.Random(7)
    letters = "营业收入和"
    counts = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 500) for _ in range(60)}
    total = sum(counts.values())
    scores, floor = {w: math.log(n / total) for w, n in counts.items()}, -math.log(total)
    for _ in range(150):
        run = "".join(rng.choices(letters, k=rng.randint(1, 10)))
        got = segment.words_of(run, scores, floor, 4)
        value = lambda ws: sum(scores.get(w, floor if len(w) == 1 else -1e18) for w in ws)
        assert "".join(got) == run and math.isclose(value(got), max(map(value, every_cut(run))))


def test_numbers_letters_and_marks():
    assert segment.words_of("2023年收入12.5亿元，占8%。A1 b", {"收入": -1.0}, -9.0, 2) == ["2023", "年", "收入", "12", ".", "5", "亿", "元", "，", "占", "8", "%", "。", "A1", "b", "2023", "12.5亿元，"[:-1], "8%", "1"]


def test_dictionaries_sent_and_joined_agree(spark, monkeypatch):
    texts = [(1, "营业收入和净利润"), (2, "净利润2023年"), (3, None), (4, "no han"), (5, ""), (6, "收入" * 300)]
    rows = spark.createDataFrame(texts, "id int, text string")
    words = spark.createDataFrame([("营业收入", 5), ("收入", 9), ("净利润", 4), ("利润", 3), ("和", 20), ("营业", 1), ("x", 0)], "word string, n long")
    sent = {r.id: r.words for r in segment.segmented(rows, "text", words).collect()}
    assert sent[1] == ["营业收入", "和", "净利润"] and sent[3] == [] and sent[4] == ["no", "han"] and sent[6] == ["收入"] * 300
    monkeypatch.setattr(segment, "BROADCAST_WORDS", 2)
    assert {r.id: r.words for r in segment.segmented(rows, "text", words).collect()} == sent


def test_dictionary_of_a_corpus(spark):
    rng = random.Random(3)
    text = [("".join(rng.choice(["营业", "收入", "甲", "乙", "丙", "丁", "戊", "己", "庚", "辛", "壬", "癸", "子", "丑", "寅", "卯"]) for _ in range(40)) + " x",) for _ in range(60)] + [(None,)]
    got = {r.word: r.n for r in segment.word_counts(spark.createDataFrame(text, "text string"), longest=3, least=5, cohesion=5.0).collect()}
    whole = "\n".join(t for t, in text if t)
    assert "营业" in got and "收入" in got and "甲乙" not in got
    assert all(n == sum(whole.startswith(w, i) for i in range(len(whole))) for w, n in got.items())


def plain_aliases(text, pairs):
    found = sorted((text.find(a), -len(a), s) for a, s in pairs if a and a in text)
    return list(dict.fromkeys(s for *_, s in found))


def test_automaton_finds_what_single_searches_find():
    rng = random.Random(5)
    pairs = {"".join(rng.choices("abc🙂", k=rng.randint(1, 6))): f"s{i % 50}" for i in range(200)}
    machine = aliases.automaton(list(pairs.items()))
    texts = ["".join(rng.choices("abcd🙂", k=rng.choice([0, 3, 20, 400, 1000]))) for _ in range(60)]
    text, alias, start = machine.matches(texts)
    names = sorted(pairs)
    want = {(i, names.index(a), p) for i, t in enumerate(texts) for a in pairs for p in range(len(t)) if t.startswith(a, p)}
    assert set(zip(text.tolist(), alias.tolist(), start.tolist())) == want and len(text) == len(want)
    assert machine.shorts_in(texts) == [plain_aliases(t, pairs.items()) for t in texts]


def test_a_hundred_thousand_aliases(spark):
    rng = random.Random(6)
    pairs = list({"".join(rng.choices("abcdefgh", k=rng.randint(5, 12))): None for _ in range(100_000)})
    table = spark.createDataFrame([(a, f"s{i}") for i, a in enumerate(pairs)] + [("", "none"), (pairs[0], "t")], "alias string, short string")
    texts = [(i, "x".join([rng.choice(pairs), "zz", rng.choice(pairs)])) for i in range(200)] + [(200, None), (201, "")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r.companies for r in aliases.find_aliases(rows, "text", table).collect()}
    short = {a: f"s{i}" for i, a in enumerate(pairs)}
    by_size = {}
    for a in pairs:
        by_size.setdefault(len(a), set()).add(a)
    for i, t in texts[:50]:
        found = sorted((t.find(t[p : p + n]), -n, short[t[p : p + n]]) for n, known in by_size.items() for p in range(len(t) - n + 1) if t[p : p + n] in known)
        assert got[i] == list(dict.fromkeys(s for *_, s in found))
    assert got[200] == got[201] == []
    assert {r.id: r.companies for r in aliases.find_aliases(rows, "text", table, chars=300_000).collect()} == got


def test_registered_words_match_sql(spark):
    from quillon.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in "nation customer orders".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("question_words", "bm25_words"):
        got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


def test_scores_stay_with_their_documents(spark, monkeypatch):
    from quillon.operators import lexical

    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    corpus = spark.createDataFrame([(i * 7 % 400, rng.choices(words, [1 / (n + 1) for n in range(30)], k=rng.randint(0, 12))) for i in range(400)] + [(401, None), (402, [])], "key long, words array<string>").repartition(5)
    asked = spark.createDataFrame([(q, rng.choices([*words, "unknown"], k=4)) for q in range(9)] + [(9, [])], "qid long, words array<string>")
    shown = lambda df: [(r.qid, r.key, round(r.score, 9), r["rank"]) for r in df.orderBy("qid", "rank").collect()]
    here = lexical.bm25_top_k(corpus, asked, 6)
    assert "hashpartitioning(qid" in (plan := here._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(qid#" in plan and ", key#" not in "".join(x for x in plan.split("\n") if "hashpartitioning(qid" in x)
    got = shown(here)
    monkeypatch.setattr(lexical, "BLOCK_PARTS", 10)
    assert shown(lexical.bm25_top_k(corpus, asked, 6)) == got
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 3)
    assert shown(lexical.bm25_top_k(corpus, asked, 6)) == got and len(got) > 30


def test_runs_are_remembered_not_for_ever(monkeypatch):
    monkeypatch.setattr(segment, "KNOWN_RUNS", 2)
    scores, known = {"收入": -1.0, "入和": -0.5, "和": -2.0}, {}
    texts = ["收入和a收入", "收入和", "和", "入和收", "收入"] * 2
    assert [segment.words_of(t, scores, -9.0, 2, known) for t in texts] == [segment.words_of(t, scores, -9.0, 2) for t in texts] and len(known) <= 2
