"""Dense search: exact by blocks, inverted lists, product quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import DIGITS, top_k

BLOCK_ROWS = 2048
#: Bytes of vectors that meet blocks of queries at once; the larger, the fewer copies of queries and hits are shuffled.
VECTOR_BYTES = 4 << 20
#: Queries whose products with a block are held at a time, and neighbours of which only the best is compared at first.
ROWS_AT_ONCE, NEIGHBOURS = 256, 64
#: Vectors of a block that the product quantiser hands on for each query to be rescored.
PQ_CANDIDATES = 160


def _blocks(rows: DataFrame, id_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids array<long>, flat array<float>): rows packed by the thousand, by hash of their id."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select(F.col(id_col).cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))
    return packed.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("flat")).withColumn("blocks", F.lit(blocks))


def _block_rows(vectors: DataFrame, rows: int) -> int:
    """How many of so many vectors are a block: VECTOR_BYTES of them, or BLOCK_ROWS where else cores would idle."""
    first = vectors.select(F.size("vector")).first()
    full = max(1, VECTOR_BYTES // (4 * max(1, first[0] if first else 1)))
    return max(min(full, BLOCK_ROWS), min(full, -(-rows // (2 * vectors.sparkSession.sparkContext.defaultParallelism))))


def best_of(score: np.ndarray, keys: np.ndarray, k: int, finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The row and column of the k best scores of each row, in order; ties of DIGITS digits go to the lower key, -inf is none.

    The kth of the neighbourhoods' best is below the kth of all, so few scores are sorted. Scores that may be NaN are sorted whole.
    """
    if not finite or score.shape[1] < k * NEIGHBOURS:
        order = np.lexsort((np.broadcast_to(keys, score.shape), -np.round(score, DIGITS)), axis=1)[:, :k]
        rows, columns = np.repeat(np.arange(len(score)), order.shape[1]), order.ravel()
        shown = score[rows, columns] != -np.inf
        return rows[shown], columns[shown]
    whole = score.shape[1] // NEIGHBOURS * NEIGHBOURS
    most = score[:, :whole].reshape(len(score), -1, NEIGHBOURS).max(axis=2)
    least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - 2 * 10.0**-DIGITS
    rows, columns = np.nonzero(score >= np.maximum(least, np.finfo(float).min)[:, None])
    order = np.lexsort((keys[columns], -np.round(score[rows, columns], DIGITS), rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, key, score, rank) by inner product of queries (qid, vector) with vectors (key, vector).

    Blocks of queries meet blocks of vectors on the block's number; each pair is a matrix product that hands on
    k hits a query, so what is shuffled next is k rows for each query and block.
    """
    q, v = _blocks(queries, "qid"), _blocks(vectors, "key", _block_rows(vectors, vectors.count()))
    sides = q.select(F.col("ids").alias("qids"), F.col("flat").alias("q"), F.monotonically_increasing_id().alias("n"))
    n_blocks = v.agg(F.max("blocks")).first()[0] or 1
    sides = sides.select("qids", "q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, keys = b.column(0)[r].values.to_numpy(), b.column(2)[r].values.to_numpy()
                left = b.column(1)[r].values.to_numpy().reshape(len(qids), -1).astype(np.float64)
                right = b.column(3)[r].values.to_numpy().reshape(len(keys), -1).astype(np.float64)
                finite = bool(np.isfinite(left).all() and np.isfinite(right).all())
                for at in range(0, len(qids), ROWS_AT_ONCE):
                    score = left[at : at + ROWS_AT_ONCE] @ right.T
                    rows, columns = best_of(score, keys, k, finite)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + rows]), pa.array(keys[columns]), pa.array(score[rows, columns])], ["qid", "key", "score"])

    pairs = sides.join(v.select("block", "ids", F.col("flat").alias("v")), "block").select("qids", "q", "ids", "v")
    return top_k(pairs.mapInArrow(run, "qid long, key long, score double"), k)


def list_count(n: int) -> int:
    """Inverted lists for n vectors."""
    return min(1000, max(10, int(4 * math.sqrt(n))), max(1, n))


def train_centres(vectors: DataFrame, n: int, rounds: int = 5, sample: int = 50_000) -> np.ndarray:
    """Spherical k-means over at most sample vectors drawn by hash; n x dimension numbers."""
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toPandas()
    x = np.array(rows["vector"].tolist(), np.float64)
    centres = x[:n].copy()
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])
        for j in range(len(centres)):
            if (at == j).any():
                centres[j] = x[at == j].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the nearest centres of each vector, the nearest first."""
    score = x @ centres.T
    return score.argmax(axis=1)[:, None] if probes == 1 and len(centres) else np.argsort(-score, axis=1, kind="stable")[:, :probes]


def assign(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """vectors with list_id: a row for each of their nearest probes centres. The centres are bounded by list_count."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names, schema = vectors.columns, vectors.schema.simpleString().removeprefix("struct<").removesuffix(">")
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(at).flatten().to_numpy()
            near = _nearest(flat.reshape(b.num_rows, -1), shared.value, probes)
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in b.columns] + [pa.array(near.ravel().astype(np.int32))], [*names, "list_id"])

    return vectors.mapInArrow(run, f"{schema}, list_id int")


def ivf_top_k(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probes: int = 10) -> DataFrame:
    """Hits of queries among the lists of their nearest centres; indexed is assign()'s result.

    Lists are dealt to blocks of about equal size, a long one to several. A query goes once to each block that has one of
    its lists; a list's vectors meet the block's queries that ask for it in one matrix product.
    """
    spark, n_lists = queries.sparkSession, len(centres)
    held = {r.list_id: r.n for r in indexed.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # a row for each centre at most
    total = sum(held.values())
    rows = _block_rows(indexed, total)
    parts = np.array([-(-held.get(i, 0) // rows) for i in range(n_lists)], np.int64)  # 0 for a list of none
    piece = np.cumsum(parts) - parts
    size = np.repeat([held.get(i, 0) / max(1, parts[i]) for i in range(n_lists)], parts)
    block_of = ((np.cumsum(size) - size / 2) // rows).astype(np.int64)  # of each piece
    n_blocks = int(block_of.max(initial=0)) + 1
    shared = spark.sparkContext.broadcast((centres, parts, piece, block_of))
    groups = max(1, -(-queries.count() // BLOCK_ROWS))
    qid, key = queries.schema["qid"].dataType.simpleString(), indexed.schema["key"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts, piece, block_of = shared.value
        for b in batches:
            near = _nearest(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), centres, probes)
            asked, of = np.repeat(np.arange(b.num_rows), near.shape[1]), near.ravel()
            n = parts[of]
            asked, lists = np.repeat(asked, n), np.repeat(of, n)
            block = block_of[np.repeat(piece[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            code = np.unique((asked * n_blocks + block) * n_lists + lists)  # a list may have several pieces in a block
            goes, lists = np.divmod(code, n_lists)
            starts = np.flatnonzero(np.diff(goes, prepend=-1))
            asked, block = np.divmod(goes[starts], n_blocks)
            offsets = pa.array(np.concatenate((starts, [len(goes)])), pa.int32())
            picked = pa.array(asked)
            yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), pa.array(block), pa.ListArray.from_arrays(offsets, pa.array(lists, pa.int32()))], ["qid", "vector", "block", "lists"])

    floats = F.col("vector").cast("array<float>").alias("vector")
    routed = queries.select("qid", floats).mapInArrow(route, f"qid {qid}, vector array<float>, block long, lists array<int>")
    sides = routed.groupBy("block", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("side")).agg(F.collect_list(F.struct("qid", "vector", "lists")).alias("s"))
    sides = sides.select("block", F.col("s.qid").alias("qids"), F.flatten("s.vector").alias("q"), F.col("s.lists").alias("lists"))
    table = spark.createDataFrame([(i, [int(x) for x in block_of[piece[i] : piece[i] + parts[i]]]) for i in range(n_lists) if parts[i]], "list_id int, blocks array<long>")
    dealt = indexed.select("key", floats, "list_id").join(F.broadcast(table), "list_id")  # a row for each centre at most
    dealt = dealt.withColumn("block", F.get("blocks", F.pmod(F.xxhash64("key"), F.size("blocks")).cast("int")))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("list_id", "key", "vector"))).alias("v"))
    packed = packed.select("block", F.col("v.key").alias("keys"), F.flatten("v.vector").alias("v"), F.col("v.list_id").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, keys, own = (b.column(c)[r].values.to_numpy() for c in (0, 3, 5))
                left, right = (b.column(c)[r].values.to_numpy().reshape(n, -1).astype(np.float64) for c, n in ((1, len(qids)), (4, len(keys))))
                wanted = b.column(2)[r].values
                asked, lists = np.repeat(np.arange(len(qids)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                finite = bool(np.isfinite(left).all() and np.isfinite(right).all())
                for at in range(0, len(qids), ROWS_AT_ONCE):
                    low, high = np.searchsorted(asked, (at, at + ROWS_AT_ONCE))
                    score = np.full((min(ROWS_AT_ONCE, len(qids) - at), len(keys)), -np.inf)
                    for a, z in zip(begins, [*begins[1:], len(keys)]):
                        of = asked[low:high][lists[low:high] == own[a]]
                        if len(of):
                            score[of - at, a:z] = left[of] @ right[a:z].T
                    rows, columns = best_of(score, keys, k, finite)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + rows]), pa.array(keys[columns]), pa.array(score[rows, columns])], ["qid", "key", "score"])

    pairs = sides.join(packed, "block").select("qids", "q", "lists", "keys", "v", "own")
    return top_k(pairs.mapInArrow(run, f"qid {qid}, key {key}, score double"), k)


def train_codebooks(vectors: DataFrame, m: int = 8, bits: int = 8, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """m codebooks of 2**bits centres each, by k-means over each part of at most sample vectors drawn by hash."""
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toPandas()
    x = np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), m, -1)
    books = x[: 2**bits].transpose(1, 0, 2).copy()
    for part in range(m):
        own = x[:, part]
        for _ in range(rounds):
            at = ((own[:, None] - books[part][None]) ** 2).sum(axis=2).argmin(axis=1)
            for j in np.unique(at):
                books[part, j] = own[at == j].mean(axis=0)
    return books


def encode_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, codes, vector): the nearest centre of each part, beside the vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(shared.value), -1)
            codes = np.stack([((x[:, p, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1) for p, book in enumerate(shared.value)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16())), b.column(1)], ["key", "codes", "vector"])

    rows = vectors.select("key", F.col("vector").cast("array<float>").alias("vector"))
    return rows.mapInArrow(run, "key long, codes array<smallint>, vector array<float>")


def pq_top_k(queries: DataFrame, coded: DataFrame, books: np.ndarray, k: int, candidates: int = PQ_CANDIDATES, rows: int | None = None) -> DataFrame:
    """(qid, key, score, rank): in each block of coded vectors the best candidates by coded score, rescored by the full vectors.

    coded is encode_codes()'s result. Blocks of queries meet blocks of coded vectors as in exact_top_k; a block holds
    BLOCK_ROWS vectors by hash of their id, so the candidates of a query grow with the table. The books bound the broadcast.
    rows is the number of vectors, which else takes one more encoding to count.
    """
    q, blocks = _blocks(queries, "qid"), max(1, -(-(coded.count() if rows is None else rows) // BLOCK_ROWS))
    sides = q.select(F.col("ids").alias("qids"), F.col("flat").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = coded.select("key", "codes", "vector", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "codes", "vector"))).alias("rows"))
    packed = packed.select("block", F.col("rows.key").alias("ids"), F.flatten("rows.codes").alias("codes"), F.flatten("rows.vector").alias("v"))
    shared = queries.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(shared.value)
        for b in batches:
            for r in range(b.num_rows):
                qids, left, keys, codes, right = (c[r].values.to_numpy() for c in b.columns)
                left, right = left.reshape(len(qids), -1).astype(np.float64), right.reshape(len(keys), -1).astype(np.float64)
                codes = codes.reshape(len(keys), m).astype(np.int64)
                for at in range(0, len(qids), 128):
                    asked = left[at : at + 128]
                    tables = np.einsum("qmd,mcd->qmc", asked.reshape(len(asked), m, -1), shared.value)
                    score = sum(tables[:, p, codes[:, p]] for p in range(m))
                    wide = np.lexsort((np.broadcast_to(keys, score.shape), -np.round(score, DIGITS)), axis=1)[:, : max(k, candidates)]
                    score = np.einsum("qcd,qd->qc", right[wide], asked)
                    ranked = np.lexsort((keys[wide], -np.round(score, DIGITS)), axis=1)[:, :k]
                    best, found = np.take_along_axis(score, ranked, axis=1), keys[np.take_along_axis(wide, ranked, axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[at : at + 128], ranked.shape[1])), pa.array(found.ravel()), pa.array(best.ravel())], ["qid", "key", "score"])

    pairs = sides.join(packed, "block").select("qids", "q", "ids", "codes", "v")
    return top_k(pairs.mapInArrow(run, "qid long, key long, score double"), k)
