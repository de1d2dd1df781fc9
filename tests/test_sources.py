"""Sources, sinks, jobs and streams, on files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, jobs
from quillon.streaming.incremental import stream_chunks

TEXT = "甲股份有限公司\n2023年年度报告\n\n" + "营业收入增长。" * 60 + "\n[TABLE_START]\n| a | b |\n[TABLE_END]\n尾"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "甲股份有限公司：2023年年度报告.md").write_text(TEXT, encoding="utf-8")
    (tmp_path / "in" / "empty.md").write_text("", encoding="utf-8")
    (tmp_path / "in" / "other.txt").write_text("not read", encoding="utf-8")
    return tmp_path


def test_folder_becomes_chunk_files_and_indexes(spark, folder):
    stats = {r.chunk_size: r for r in jobs.chunk_folder(spark, f"{folder}/in", f"{folder}/chunks", ((128, 20), (256, 50))).collect()}
    assert set(stats) == {128, 256} and all(r.table_chunks == 1 and r.doc_count == 1 for r in stats.values()) and stats[128].total_chunks > stats[256].total_chunks
    chunks = files.read_chunks(spark, f"{folder}/chunks/experiment=all_cs128_ov20")
    row = chunks.first()
    assert (row.doc_title, row.doc_type, row.company_short, row.year, row.period, row.chunk_size) == ("甲股份有限公司2023年年度报告", "annual_report", "甲", "2023", "annual", 128)
    encoder = lambda texts: [[float(len(t)), 1.0, float(len(t) % 7), 2.0, 0.0, 1.0, 3.0, 1.0] for t in texts]
    reports = {r.kind: r for r in jobs.index_chunks(spark, f"{folder}/chunks/experiment=all_cs128_ov20", f"{folder}/index", encoder, jobs.KINDS).collect()}
    assert {k: r.vectors for k, r in reports.items()} == dict.fromkeys(jobs.KINDS, chunks.count()) and reports["flat"].lists == 0 < reports["ivf"].lists
    with pytest.raises(ValueError):
        jobs.build_index(chunks, "unknown")


def test_bad_chunk_files_fail(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text(json.dumps({"chunk_id": "1", "content": "x"}), encoding="utf-8")
    with pytest.raises(Exception, match="no doc_id"):
        files.read_chunks(spark, f"{tmp_path}/bad.jsonl").collect()
    with pytest.raises(FileNotFoundError):
        files.read_markdown(spark, f"{tmp_path}")


def test_items_and_overrides_are_read(spark, tmp_path):
    items = [{"query": "q", "ground_truth_doc_id": "a"}, {"query": "r", "ground_truth_doc_id": ["a", "b"]}, {"query": "s"}]
    (tmp_path / "eval.jsonl").write_text("\n".join(map(json.dumps, items)), encoding="utf-8")
    assert {r.query: r.ground_truth_doc_ids for r in files.read_eval_items(spark, f"{tmp_path}/eval.jsonl").collect()} == {"q": ["a"], "r": ["a", "b"], "s": []}
    (tmp_path / "o.json").write_text(json.dumps({"d1": {"year": "2020"}, "d2": {"company": "x"}}), encoding="utf-8")
    assert {(r.doc_key, r.year, r.company) for r in files.read_overrides(spark, f"{tmp_path}/o.json", ("year", "company")).collect()} == {("d1", "2020", None), ("d2", None, "x")}


def test_page_files_are_decoded_once(spark, tmp_path):
    for name, content in (("a", b"one"), ("b", b"bad"), ("c", b"done")):
        (tmp_path / f"{name}.pdf").write_bytes(content)

    def decoder(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"text": content.decode()}]

    parsed = files.parse_files(spark, str(tmp_path), decoder, spark.createDataFrame([("c",)], "doc_id string")).collect()
    assert {(r.doc_id, r.status, r.error) for r in parsed} == {("a", "parsed", None), ("b", "failed", "broken")}


def test_stream_chunks_new_files_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "words of a text. " * 20)], "doc_id long, text string")
    for i in range(2):
        docs.withColumn("doc_id", F.col("doc_id") + i).write.mode("append").parquet(f"{tmp_path}/in")
        stream_chunks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", "doc_id long, text string", 100, 10).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("doc_id").distinct().count() == 2 and got.count() == got.select("chunk_id").distinct().count()


def test_folders_are_parsed_in_runs(spark, tmp_path):
    """Done, empty, failed and changed files over several runs, and one that dies before its log."""
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    for name, content in (("done", b"one"), ("void", b"empty"), ("broken", b"bad"), ("grown", b"x")):
        (folder / f"{name}.pdf").write_bytes(content)
    (folder / "other.txt").write_text("not read")
    state = {b"empty": "", b"bad": None}

    def decoder(content, known=dict(state)):
        if content in known and known[content] is None:
            raise ValueError("broken")
        return known.get(content, content.decode())

    first = {r.name: (r.status, r.characters) for r in files.parse_folder(spark, str(folder), out, decoder).collect()}
    assert first == {"done.pdf": ("parsed", 3), "void.pdf": ("parsed", 0), "broken.pdf": ("failed", 0), "grown.pdf": ("parsed", 1)}
    (folder / "grown.pdf").write_bytes(b"longer")
    second = {r.name: (r.status, r.characters) for r in files.parse_folder(spark, str(folder), out, lambda c: {b"empty": "now", b"bad": "mended"}.get(c, c.decode())).collect()}
    assert second == {"done.pdf": ("skipped", None), "void.pdf": ("parsed", 3), "broken.pdf": ("parsed", 6), "grown.pdf": ("parsed", 6)}
    # texts of a run without a log do not count
    spark.createDataFrame([("done.pdf", 3, "parsed", None, 4, 0.0, "half", 9)], files.PARSED + ", run int").write.mode("append").partitionBy("run").parquet(f"{out}/texts")
    assert {r.name: r.text for r in files.read_parsed(spark, out).collect()} == {"done.pdf": "one", "void.pdf": "now", "broken.pdf": "mended", "grown.pdf": "longer"}
    third = files.parse_folder(spark, str(folder), out, lambda c: "never").collect()
    assert {r.status for r in third} == {"skipped"} and {r.run for r in third} == {3}
    assert {r.status for r in files.parse_folder(spark, str(folder), out, lambda c: "all", force=True).collect()} == {"parsed"}
    assert {r.text for r in files.read_parsed(spark, out).collect()} == {"all"}


def test_files_and_queries_are_found(spark, tmp_path):
    for name in ("b.jsonl", "a.jsonl", "c.txt"):
        (tmp_path / name).write_text(json.dumps({"query": f" {name} "}) + "\n" + json.dumps({"query": "  "}) + "\n" + json.dumps({"other": 1}))
    found = files.find_jsonl_files(spark, str(tmp_path), f"{tmp_path}/a.jsonl")
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.jsonl", "b.jsonl"]
    assert [r.query for r in files.read_queries(spark, found[0]).collect()] == ["a.jsonl"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.find_jsonl_files(spark, f"{tmp_path}/none")
