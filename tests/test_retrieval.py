"""Retrieval operators: the registered SQL on the smallest tables, and hand-made edge cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answer, chunking, dense, evaluate, layout, metadata, query, ranking, retriever
from quillon.plans.catalog import ORACLE_SQL, QUERIES
from quillon.plans.retrieval import _questions

DATA = "/root/testdata/sf0.001"
FAST = ["bm25_topk", "dense_topk", "hybrid_topk", "truncate_text", "chunk_windows", "route_relaxed", "file_name_metadata", "citation_check", "metrics_by_type", "table_to_markdown", "route_chunks", "bm25_routed", "retrieve_fact", "retrieve_summary", "retrieve_compare", "answers_routed", "chunk_documents", "chunk_grid_stats", "standard_chunks", "parse_query", "compare_subqueries", "item_ranks", "experiment_summary", "index_reports"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer orders lineitem events documents embeddings benchmark".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


def test_segments_keep_tables_whole(spark):
    rows = [(1, "a\n[TABLE_START]x[TABLE_END] \n[table_start]y[table_end]b"), (2, "[TABLE_START] open"), (3, None), (4, " \n ")]
    got = [(r.id, r.segment_index, r.segment_type) for r in chunking.segments(spark.createDataFrame(rows, "id int, text string")).orderBy("id", "segment_index").collect()]
    assert got == [(1, 1, "text"), (1, 2, "table"), (1, 3, "table"), (1, 4, "text"), (2, 1, "text")]
    with pytest.raises(ValueError):
        chunking.check_sizes(10, 10)


def test_queries_are_parsed(spark):
    rows = [(1, "甲公司和乙公司2023年营业收入谁更高"), (2, "甲2024年第一季度主要趋势"), (3, "no match"), (4, None)]
    parsed = query.parse_queries(spark.createDataFrame(rows, "qid int, query string"), {"甲": "A", "甲公司": "A", "乙公司": "B"})
    got = {r.qid: (r.companies, r.year, r.period, r.metric, r.question_type) for r in parsed.collect()}
    assert got == {1: (["A", "B"], "2023", "annual", "营业收入", "compare"), 2: (["A"], "2024", "q1", "", "summary"), 3: ([], "", "", "", "fact"), 4: ([], "", "", "", "fact")}
    assert [r.sub_query for r in query.compare_subqueries(parsed).orderBy("sub_idx").collect()] == ["A2023年营业收入是多少？", "B2023年营业收入是多少？"]


def test_fusion_of_one_sided_and_equal_lists(spark):
    schema = "qid int, key int, score double, rank int"
    a, b = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 1.0, 2)], schema), spark.createDataFrame([(1, 11, 3.0, 1), (2, 5, 1.0, 1)], schema)
    assert [(r.qid, r.key, r.score) for r in ranking.fuse(a, b, 5).orderBy("qid", "rank").collect()] == [(1, 11, 1.0), (1, 10, 0.5), (2, 5, 0.5)]


def test_metrics_of_misses(spark):
    ranks = spark.createDataFrame([(1, "a", "m", 1), (2, "a", "m", -1), (3, "b", "m", 6)], "qid int, question_type string, method string, rank int")
    r = evaluate.metrics(ranks).first()
    assert (r.recall_3, r.recall_10, r.top1, r.mrr_5) == (pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert evaluate.combined_ranks(ranks, ("method",)).first().rank == -1
    assert "| m |" in evaluate.markdown(evaluate.metrics(ranks), "t")


def test_layout_pieces(spark):
    x = np.array([50.0, 52, 330, 331, 50])
    assert layout.column_labels(x, 600).tolist() == [0, 0, 1, 1, 0] and layout.column_labels(np.array([5.0]), 600).tolist() == [0]
    rows = spark.createDataFrame([([["h", "v|w"], [None, " "], ["a", "1"], ["b"], ["c", "2元"], ["d", "3"]],)], "rows array<array<string>>")
    r = rows.select(layout.table_to_markdown(F.col("rows")).alias("m"), layout.is_valid_table(F.col("rows")).alias("ok")).first()
    assert r.m.split("\n")[:3] == ["| h | v\\|w |", "|---|---|", "| a | 1 |"] and r.ok


def test_overrides_win(spark):
    docs = spark.createDataFrame([("d1", "某某股份有限公司：2023年年度报告.pdf", ""), ("d2", "x.pdf", "乙集团有限公司\n2022 年 半年度报告")], "doc_id string, source_file string, text string")
    overrides = spark.createDataFrame([("d1", "2021")], "doc_key string, year string")
    got = {r.doc_id: (r.company_short, r.year, r.period) for r in metadata.document_metadata(docs, overrides).collect()}
    assert got == {"d1": ("某某", "2021", "annual"), "d2": ("乙", "2022", "semi_annual")}


def test_citations_and_names(spark):
    row = spark.range(1).select(answer.citations(F.lit("[E2] [E1, E2] [E2] [E10]")).alias("c"), T.doc_ids_match(F.lit("某某股份2023年年度报告.pdf"), F.lit("某某股份：2023年报")).alias("same"), T.is_garbled(F.lit("ab(cid:12)")).alias("bad")).first()
    assert row.c == ["E2", "E10"] and row.same and row.bad


def test_product_quantiser_finds_the_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5000, 64)))], "key long, vector array<float>").repartition(3).cache()
    asked = vectors.filter("key % 50 = 0").withColumnRenamed("key", "qid")
    books = dense.train_codebooks(vectors)
    found = {(r.qid, r.key): r.score for r in dense.pq_top_k(asked, dense.encode_codes(vectors, books), books, 10).collect()}
    exact = {(r.qid, r.key): r.score for r in dense.exact_top_k(asked, vectors, 10).collect()}
    assert len(found) == len(exact) == 1000 and len(found.keys() & exact.keys()) >= 900
    assert all(found[p] == pytest.approx(exact[p]) for p in found.keys() & exact.keys())


def test_pq_recall_is_registered(spark):
    assert QUERIES["pq_recall"](spark, DATA).first().recall >= 0.9


def test_questions_grow_with_orders(spark):
    parsed = _questions(spark, DATA).cache()
    assert parsed.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert {r.question_type for r in parsed.select("question_type").distinct().collect()} == {"compare", "summary", "fact"}
    assert {r.period for r in parsed.select("period").distinct().collect()} == {"q1", "semi_annual", "q3", "annual"}
    assert parsed.select("metric").distinct().count() > 10 and parsed.select("year").distinct().count() > 3
    assert parsed.filter("qid % 10 = 7 and size(companies) > 0 or qid % 10 <> 7 and size(companies) <> if(qid % 3 = 0, 2, 1)").count() == 0
    subs = query.compare_subqueries(parsed)
    assert subs.count() == 2 * parsed.filter("qid % 3 = 0 and qid % 10 <> 7").count() > 0


def test_segments_grow_with_lines(spark):
    got = QUERIES["segment_orders"](spark, DATA)
    want = duckdb.connect().sql(ORACLE_SQL["segment_orders"].replace("from lineitem", f"from '{DATA}/lineitem.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_routing_meets_counts_of_documents(spark):
    plan = QUERIES["route_relaxed"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_compare_and_summary_questions_are_retrieved(spark):
    chunks = spark.createDataFrame(
        [(1, "A 2023 营业收入 10 亿元", ["A"], "2023", "annual"), (2, "A 2023 毛利率", ["A"], "2023", "annual"), (3, "B 2023 主营业务收入 9 亿元", ["B"], "2023", "annual"), (4, "unrelated", ["C"], "2022", "")],
        "key int, text string, companies array<string>, year string, period string",
    )
    rows = [(1, "甲公司和乙公司2023年营业收入谁更高"), (2, "甲公司2023年主要趋势"), (3, "no company here")]
    parsed = query.parse_queries(spark.createDataFrame(rows, "qid int, query string"), {"甲公司": "A", "乙公司": "B"})
    dense_hits = spark.createDataFrame([(q, k, 1.0 / (q + k)) for q in (1, 2, 3) for k in (1, 2, 3, 4)], "qid int, key int, score double")
    got = retriever.retrieve_by_type(parsed, chunks, dense_hits).collect()
    compared = {r.sub_idx: [x.key for x in sorted(got, key=lambda x: x["rank"]) if x.qid == 1 and x.sub_idx == r.sub_idx] for r in got if r.qid == 1}
    assert compared == {0: [1], 1: [3]}  # what scores nothing is left out
    assert {1} <= {r.key for r in got if r.qid == 2} <= {1, 2} and {1} <= {r.key for r in got if r.qid == 3}


def test_names_contain_companies(spark):
    """Against comparing all pairs, with short names, none, and letters that no name has."""
    import random

    from quillon.operators import routing

    rng = random.Random(8)
    draw = lambda lo, hi: "".join(rng.choices("ab甲乙公司", k=rng.randint(lo, hi)))
    names, needles = {draw(1, 9) for _ in range(150)}, {draw(1, 4) for _ in range(60)} | {"zz", "z"}
    got = routing.containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in names], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in needles for y in names if x in y)


def test_routes_by_parts_of_names_and_periods_alone(spark):
    from quillon.operators import routing

    chunks = [(1, "d1", ["甲公司"], "2023", "annual"), (2, "d1", ["甲公司"], "2023", "q1"), (3, "d2", ["乙"], "2022", ""), (4, "d3", ["丙", "A甲 B"], "2022", None), (5, "d4", None, None, "q1")]
    frame = spark.createDataFrame(chunks, "key int, doc string, companies array<string>, year string, period string")
    asked = [(1, "甲", "", ""), (2, "甲公司", "2023", "q3"), (3, "", "", "q1"), (4, "", "2022", "annual"), (5, "", "", ""), (6, "丁", "2023", ""), (7, "a 甲", "", "annual"), (8, "甲", "", "")]
    questions = spark.createDataFrame(asked, "qid int, company_short string, year string, period string")
    routed = routing.routes(questions, frame)
    pairs = routed.asked.join(routed.candidates(), "route").collect()
    found = {q: sorted(r.key for r in pairs if r.qid == q) for q in range(1, 9)}
    assert found == {1: [1, 2, 4], 2: [1, 2], 3: [2, 3, 4, 5], 4: [3, 4], 5: [], 6: [], 7: [4], 8: [1, 2, 4]}
    assert {r.qid: (r.chunks, r.docs, r.level) for r in routed.counts().collect()} == {1: (3, 2, 0), 2: (2, 1, 1), 3: (4, 4, 0), 4: (2, 2, 0), 5: (5, 4, 2), 6: (5, 4, 2), 7: (1, 1, 0), 8: (3, 2, 0)}
    assert routed.asked.select("route").distinct().count() == 7  # equal questions share a route
    assert {r.qid for r in routing.routes(questions, frame, fallback=False).counts().collect()} == {1, 2, 3, 4, 5, 7, 8}


def test_summaries_search_a_coarse_corpus_again(spark):
    """Of a summary only the coarse dense hits are candidates, and a scorer orders what is fused."""
    chunks = spark.createDataFrame([(k, f"word{k} common", ["A"], "", "") for k in range(8)], "key int, text string, companies array<string>, year string, period string")
    parsed = spark.createDataFrame([(1, "common word7 word3", "summary", "", "", "", ""), (2, "common word7", "fact", "", "", "", "")], "qid int, query string, question_type string, company_short string, year string, period string, metric string")
    hits = spark.createDataFrame([(q, k, 1.0 - k / 10) for q in (1, 2) for k in range(8)], "qid int, key int, score double")
    got = retriever.final_candidates(parsed, chunks, hits, k=20, coarse_k=4).collect()
    assert {r.key for r in got if r.qid == 1} == {0, 1, 2, 3} and {r.key for r in got if r.qid == 2} == set(range(8))
    least = retriever.final_evidence(parsed.withColumn("companies", F.array().cast("array<string>")), chunks, hits, lambda q, t: -F.length(t) + F.col("key"), k=2).collect()
    assert [r.key for r in sorted(least, key=lambda r: r["rank"]) if r.qid == 2] == [7, 6]
    both = retriever.retrieve(parsed.filter("qid = 2"), chunks, hits, k=3, hybrid=False)
    assert [r.key for r in both.orderBy("rank").collect()][0] == 7


def test_subqueries_have_their_own_vectors(spark):
    chunks = spark.createDataFrame([(k, "same text", ["A" if k < 2 else "B"], "", "") for k in range(4)], "key int, text string, companies array<string>, year string, period string")
    parsed = spark.createDataFrame([(1, "A and B 和", ["A", "B"], "A", "", "", "")], "qid int, query string, companies array<string>, company_short string, year string, period string, metric string")
    hits = spark.createDataFrame([(1, 0, 1, 0.9), (1, 0, 0, 0.1), (1, 1, 2, 0.9), (1, 1, 3, 0.5)], "qid int, sub_idx int, key int, score double")
    got = retriever.retrieve_compare(parsed, chunks, hits, k_each=1).collect()
    assert {(r.sub_idx, r.key) for r in got} == {(0, 1), (1, 2)}


def test_items_are_evaluated(spark):
    items = spark.createDataFrame([(1, "fact", ["某某2023年年报"], ["营业收入", "毛利率"]), (2, "summary", ["x"], ["风电", "组件"]), (3, "fact", ["missing"], [])], "qid int, question_type string, truths array<string>, keywords array<string>")
    hits = spark.createDataFrame([(1, "m", "某某：2023年年报.pdf", "无", 1), (1, "m", "某某：2023年年报.pdf", "收入 毛利率", 2), (2, "m", "y", "风力发电", 1), (2, "m", "x", "风力发电", 2)], "qid int, method string, doc_id string, content string, rank int")
    assert {r.qid: (r.doc_rank, r.evidence_rank) for r in evaluate.item_ranks(items, hits).collect()} == {1: (1, 2), 2: (2, 2), 3: (-1, -1)}
    row = spark.range(1).select(evaluate.experiment_sizes(F.lit("a/all_cs1024_ov50.jsonl")).alias("e"), metadata.document_title(*map(F.lit, ("甲", "2023", "q1", "", "t", "f.pdf", "d"))).alias("a"), metadata.document_title(*map(F.lit, ("甲", "", "q1", "", "", "x/f.pdf", "d"))).alias("b")).first()
    assert tuple(row.e) == ("all_cs1024_ov50", 1024, 50) and (row.a, row.b) == ("甲2023年第一季度报告", "f")


def test_windows_of_any_text(spark):
    texts = [(0, None), (1, ""), (2, "a"), (3, "x" * 100), (4, "ab。" * 40), (5, "𝒳" * 50), (6, "\n\n" * 30)]
    rows = spark.createDataFrame(texts, "id int, text string")
    for size, overlap, soft in ((10, 3, True), (10, 9, True), (10, 0, False), (7, 6, False)):
        got = {r.id: r.w for r in rows.select("id", chunking.windows(F.col("text"), size, overlap, soft).alias("w")).collect()}
        assert got[0] is None and got[1] == []
        for i, text in texts[2:]:
            starts, ends = [w.start for w in got[i]], [w.start + len(w.content) for w in got[i]]
            assert all(text[w.start :].startswith(w.content) and 0 < len(w.content) <= size for w in got[i])
            assert starts[0] == 0 and ends[-1] == len(text) and starts == sorted(set(starts))
            assert all(b == (e - overlap if e - overlap > a else e) for a, e, b in zip(starts, ends, starts[1:]))
    with pytest.raises(ValueError):
        chunking.windows(F.col("text"), 5, 5)


def test_bm25_of_empty_and_null_texts(spark):
    from quillon.operators.lexical import bm25_top_k

    corpus = spark.createDataFrame([(1, "red 红色 fox"), (2, None), (3, ""), (4, "blue fox"), (5, "green"), (6, "green")], "key int, text string")
    asked = spark.createDataFrame([(1, "red"), (2, None), (3, "green green"), (4, "unknown")], "qid int, text string")
    got = [(r.qid, r.key) for r in bm25_top_k(corpus, asked, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, 1), (3, 5), (3, 6)]
    assert bm25_top_k(corpus.limit(0), asked, 5).count() == 0 and bm25_top_k(corpus, asked.limit(0), 5).count() == 0


def test_comparisons_are_answered_from_both_companies(spark):
    chunks = spark.createDataFrame([(1, "A 营业收入 10", ["A"], "2023", "annual"), (2, "B 营业收入 9", ["B"], "2023", "annual")], "key int, text string, companies array<string>, year string, period string")
    rows = [(1, "甲公司和乙公司2023年营业收入谁更高"), (2, "甲公司2023年营业收入是多少")]
    parsed = query.parse_queries(spark.createDataFrame(rows, "qid int, query string"), {"甲公司": "A", "乙公司": "B"})
    hits = spark.createDataFrame([(q, k, 1.0) for q in (1, 2) for k in (1, 2)], "qid int, key int, score double")
    got = {r.qid: ([e.chunk_id for e in r.evidences], r.refused, r.question_type) for r in retriever.answer_questions(parsed, chunks, hits).collect()}
    assert got == {1: (["1", "2"], False, "compare"), 2: (["1"], False, "fact")}


def test_best_of_a_row_by_its_neighbourhoods():
    from quillon.operators import dense

    rng = np.random.default_rng(3)
    keys = rng.permutation(700)
    score = np.round(rng.normal(size=(20, 700)), 2)  # many ties
    score[:, rng.random(700) < 0.5] = -np.inf
    score[3] = -np.inf
    score[4, 7:] = -np.inf
    rows, columns = dense.best_of(score, keys, 4)
    for r in range(20):
        want = sorted((-s, key) for s, key in zip(score[r].tolist(), keys.tolist()) if s != -np.inf)[:4]
        assert [(-score[r, c], keys[c]) for c in columns[rows == r]] == want
    whole = dense.best_of(score, keys, 4, finite=False)
    assert (whole[0] == rows).all() and (whole[1] == columns).all()


def test_lists_meet_queries_in_blocks(spark, monkeypatch):
    from quillon.operators import dense

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[:300] = x[0] + x[:300] / 100  # one long list
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<float>")
    queries = vectors.filter("key % 7 = 0").withColumnRenamed("key", "qid")
    centres = dense.train_centres(vectors, 12)
    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")
    monkeypatch.setattr(dense, "VECTOR_BYTES", 32 * 90)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 40)
    monkeypatch.setattr(dense, "ROWS_AT_ONCE", 16)
    for probes in (1, 3, 12):
        found = dense.ivf_top_k(queries, dense.assign(vectors, centres), centres, 5, probes)
        got = {(r.qid, r["rank"]): (r.key, round(r.score, 6)) for r in found.collect()}
        want = {}
        for q in range(0, 600, 7):
            in_lists = np.flatnonzero(np.isin(near[:, 0], near[q, :probes]))
            score = x[in_lists].astype(float) @ x[q].astype(float)
            for rank, i in enumerate(np.lexsort((in_lists, -np.round(score, 9)))[:5].tolist()):
                want[q, rank + 1] = (int(in_lists[i]), round(float(score[i]), 6))
        assert got == want
    exact = {(r.qid, r["rank"]): r.key for r in dense.exact_top_k(queries, vectors, 5).collect()}
    assert exact == {at: key for at, (key, _) in got.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(list_id" not in plan  # no query is copied for each of its lists


def test_grid_stats_are_those_of_the_chunks(spark, monkeypatch):
    import random

    rng = random.Random(6)
    pieces = ["\n\n", "\n", "。", "；", ". ", "! ", "，", ", ", " ", "\t", "\r\n", "\r", "　", " ", "\x85", "word", "字", "𝒳", "a" * 60, "[TABLE_START]\n| a |\n[table_end]", "[TABLE_START]", "\x1c"]
    texts = ["".join(rng.choices(pieces, [8 if len(p) < 5 and p.isalnum() else 1 for p in pieces], k=rng.choice([0, 3, 40, 900]))) for _ in range(80)] + [None, "", " \n ", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = chunking.chunk_stats(chunking.chunk_grid(docs, (40, 256), (0, 20, 50)), "chunk_size", "overlap")
    shown = lambda df: sorted(map(tuple, df.collect()))
    got = chunking.grid_stats(docs, (40, 256), (0, 20, 50))
    assert got.columns == want.columns and got.dtypes == want.dtypes and shown(got) == shown(want)
    plain, pairs = [chunking.normal_text(t) for t in texts if t and "\x85" not in t], [(40, 0), (40, 20), (256, 50), (7, 3)]
    cuts = sorted((i, len(c.strip(chunking.WHITE))) for i, how in enumerate(pairs) for t in plain for _, c in chunking.cut(t, *how, True))
    for few in (0, 5, 10**9):
        monkeypatch.setattr(chunking, "FEW", few)
        assert sorted(zip(*(x.tolist() for x in chunking.window_lengths(plain, pairs)))) == cuts
    assert chunking.grid_stats(docs.limit(0)).collect() == []
