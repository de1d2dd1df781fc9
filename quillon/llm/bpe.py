"""Byte-level BPE encoding and decoding of whole tables by a global distinct-word shuffle.

Null texts count as empty and have no ids. Repeated rows are encoded each; an empty table gives an empty result.
Columns other than the two named ones are dropped. There are no special tokens: their strings are plain text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.blocks import BLOCK_BYTES, cuts_of, expand, list_column, pack_codes, part_count, unpack_codes
from quillon.llm.shared import gathered, give_back, map_batches, unused

_encoders: dict[str, object] = {}
#: Marks that are a pre-token of their own after letters.
MARKS = frozenset(".,;:!?")
#: Pre-tokens whose ids are put in place at a time.
SLICE_CODES = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def number_pretokens(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pre-token numbers of all texts one after another, where each text's end, and the distinct pre-tokens.

    A single blank between two other characters that are not white space always begins a pre-token, so texts are
    cut there first and each distinct chunk is matched once. Texts with other blanks are matched whole.
    """
    find = regex.compile(pattern).findall
    words: dict[str, int] = {}
    texts = pa.compute.fill_null(texts, "")
    pieces = pa.compute.split_pattern(texts, " ")
    n_pieces = pieces.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(n_pieces)
    known = pieces.flatten().dictionary_encode()
    bodies = known.dictionary.to_pylist()
    # a text's first chunk is numbered apart, as no blank goes before it
    codes = known.indices.to_numpy().copy()
    codes[ends - n_pieces] += len(bodies)
    used = np.bincount(codes, minlength=2 * len(bodies)) > 0
    flat, sizes, whole = array("i"), np.zeros(2 * len(bodies), np.int32), np.zeros(2 * len(bodies), bool)
    for i in np.flatnonzero(used).tolist():
        body = bodies[i % len(bodies)]
        chunk = body if i >= len(bodies) else " " + body
        if body.isalpha():  # one run of letters
            flat.append(words.setdefault(chunk, len(words)))
            sizes[i] = 1
        elif body[:-1].isalpha() and body[-1] in MARKS:
            flat.append(words.setdefault(chunk[:-1], len(words)))
            flat.append(words.setdefault(chunk[-1], len(words)))
            sizes[i] = 2
        elif not body or body[0].isspace() or body[-1].isspace():
            whole[i] = True
        else:
            found = find(chunk)
            flat.extend([words.setdefault(p, len(words)) for p in found])
            sizes[i] = len(found)
    del bodies, known, pieces
    flat, starts = np.array(flat, np.int32), np.cumsum(sizes, dtype=np.int64) - sizes
    if not whole.any():
        text_ends = np.concatenate(([0], np.cumsum(sizes[codes])))[ends]
        return flat[expand(codes, starts, sizes)], text_ends, list(words)
    out, odd = [], np.add.reduceat(whole[codes], ends - n_pieces) > 0
    for i, (a, b) in enumerate(zip((ends - n_pieces).tolist(), ends.tolist())):
        if odd[i]:
            found = find(texts[i].as_py())
            out.append(np.fromiter((words.setdefault(p, len(words)) for p in found), np.int32, len(found)))
        else:
            out.append(flat[expand(codes[a:b], starts, sizes)])
    return np.concatenate(out), np.cumsum([len(x) for x in out]), list(words)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, parts: int) -> Iterator[tuple]:
    """Of each block its number, ids, word numbers, their ends, words and the words' parts, in the order of these, and a check of the words."""
    block = TaskContext.get().partitionId() << 32
    for b in gathered(batches, 1, BLOCK_BYTES):
        codes, ends, words = number_pretokens(b.column(1), pattern)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        order = np.argsort(keys % np.uint64(parts), kind="stable")
        renumbered = np.empty(len(words), np.int32)
        renumbered[order] = np.arange(len(words), dtype=np.int32)
        check = xxhash.xxh64_intdigest(keys[order].tobytes()) >> 1
        yield block, b.column(0), renumbered[codes], ends, [words[i] for i in order.tolist()], (keys[order] % np.uint64(parts)).astype(np.int64), check
        del codes, ends, words, keys, order, renumbered
        give_back()
        block += 1


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>). The ranks, of the vocabulary's size, go to every task; each distinct pre-token is encoded once.

    A block of BLOCK_BYTES of text, a whole task's as a rule, has one dictionary of pre-tokens. The blocks are made
    twice, once for their words and once for their positions: both together don't fit the disk of a shuffle, and
    numbering costs a fraction of the rest. So docs must give the same rows in the same order again, as files do;
    else materialise() it first. Each block has a check of its words, and one that comes out differently fails the
    query.
    """
    known_ranks = read_ranks(vocabulary)
    ranks = docs.sparkSession.sparkContext.broadcast(known_ranks)
    # ids of small vocabularies travel as 16 bits, read back unsigned
    narrow = max(known_ranks.values()) < 1 << 16
    parts = part_count(docs, text_col)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of a block's words."""
        for block, _, _, _, words, part, check in _blocks(batches, pattern, parts):
            cuts = cuts_of(part)
            n = len(cuts) - 1
            columns = [pa.array(part[cuts[:-1]], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([check] * n, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words, pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "of_block", "check", "words"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block with its positions."""
        for block, ids, codes, ends, _, _, check in _blocks(batches, pattern, parts):
            values = [[block], [ids.to_pylist()], [ends.tolist()], [pack_codes(codes)], [check]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()))], ["block", "docs", "ends", "codes", "check"])

    def encode_part(table: pa.Table) -> pa.Table:
        """The ids of all words of a part, each distinct word being encoded once: sizes by word, and all ids."""
        import tiktoken

        if vocabulary not in _encoders:
            _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        per_row, words = list_column(table, "words")
        known = words.dictionary_encode()
        ids = [_encoders[vocabulary].encode_ordinary(w) for w in known.dictionary.to_pylist()]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, at = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), known.indices.to_numpy().astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(per_row)))
        sizes = n[at]
        id_ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
        ids = flat[expand(at, np.cumsum(n) - n, n)]
        ids = ids.astype(np.uint16).view(np.int16) if narrow else ids
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in ((ends, sizes.astype(np.int32)), (id_ends, ids))]
        return pa.table([table.column("of_block"), table.column("check"), table.column("part"), *lists], names=["of_block", "check", "part", "sizes", "ids"])

    def reassemble(block: pa.Table, found: pa.Table) -> pa.Table:
        """The ids of a block's documents, a few megabytes at a time."""
        docs_of, ends = block.column("docs")[0].as_py(), np.array(block.column("ends")[0].as_py(), np.int64)
        if set(found.column("check").to_pylist()) - {block.column("check")[0].as_py()}:
            raise ValueError("the documents were not the same when read again; materialise() them before encoding")
        found = found.sort_by("part")
        sizes = list_column(found, "sizes")[1].to_numpy().astype(np.int64)
        values, codes = list_column(found, "ids")[1].to_numpy(), unpack_codes(block.column("codes")[0].as_py())
        values = values.view(np.uint16) if narrow else values
        starts = np.cumsum(sizes) - sizes
        out, first = [], 0
        while first < len(docs_of):
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + SLICE_CODES, side="right")))
            part = codes[begin : ends[last - 1]]
            total = np.concatenate(([0], np.cumsum(sizes[part])))[np.concatenate(([0], ends[first:last] - begin))]
            ids = pa.array(values[expand(part, starts, sizes)].astype(np.int32)) if len(part) else pa.array([], pa.int32())
            out.append(pa.record_batch([pa.array(docs_of[first:last], pa.int64()), pa.ListArray.from_arrays(pa.array(total, pa.int32()), ids)], names=["doc_id", "ids"]))
            first = last
        return pa.Table.from_batches(out)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = map_batches(picked, deal, "part int, of_block long, check long, words array<string>")
    found = dealt.groupBy("part").applyInArrow(encode_part, f"of_block long, check long, part int, sizes array<int>, ids array<{'smallint' if narrow else 'int'}>")
    placed = map_batches(picked, place, "block long, docs array<long>, ends array<long>, codes binary, check long")
    return placed.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(reassemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, bytes): the token-byte table."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(vocabulary).items()], "id int, bytes binary")


def decode(encoded: DataFrame, tokens: DataFrame, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """encoded's columns in keep and decoded binary: each id looked up in the token-byte table, in order.

    The table is joined as one broadcast row of its bytes by id, of the vocabulary's size; bytes travel as strings,
    which Spark does not check, so that they can be strung together. Null ids give null; an id that is not in the
    table fails the query.
    """
    top = tokens.agg(F.max("id")).first()[0]
    names = [unused(f"__{n}", list(keep)) for n in ("ids", "bytes")]
    dense = tokens.sparkSession.range(0 if top is None else top + 1).select(F.col("id").cast("int").alias("id")).join(tokens, "id", "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.col("bytes").cast("string").alias("b"))))
    table = dense.agg(F.transform(listed, lambda x: x["b"]).alias(names[1]))
    rows = encoded.select(F.col("ids").alias(names[0]), *keep).join(F.broadcast(table), F.lit(True))
    lost = F.raise_error(F.lit("an id is not in the token-byte table")).cast("string")
    text = F.array_join(F.transform(names[0], lambda i: F.coalesce(F.get(F.col(names[1]), i), lost)), "")
    return rows.select(*keep, text.cast("binary").alias("decoded"))
