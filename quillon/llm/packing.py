"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Null texts count as empty: they are one piece that holds only the end id. Repeated rows are packed as often as
they occur. Ties in the packing rule go to the smallest gap that fits; which sequence number a piece gets is not
part of the result. An empty table gives an empty result; other columns are dropped. The strings of the
tokenizer's special tokens are those tokens in a text too, as add_special_tokens=False leaves it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import expand
from quillon.llm.shared import gathered, map_batches, materialise

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together.
SHARD_PIECES = 4096
#: Sequences filled up to this share are packed a second time, across shards.
OPEN_SHARE = 0.95
#: Text whose distinct chunks are encoded once.
BLOCK_BYTES = 10 << 20


class WordTokenizer:
    """Ids of whole texts by a lower-casing tokenizer with word ends that drops white space, a block of texts at a time.

    White space separates words before anything else does, so a text's ids are those of its chunks between ASCII
    white space in order. Chunks of ASCII and Latin-1 letters, which need no normalisation but lower case, are cut
    by the tokenizer's own pattern, and the words of a block's distinct ones are merged together in one call; all
    others, and those that may hold a special token, go to the tokenizer whole.

    The call merges by the ranks of tokens, the tokenizer by those of pairs. Both come to the same ids where each
    token is what the tokenizer makes of that token's own text: two neighbours that make up a token, but are not the
    pair that merges into it, would be what is left of its text. With by_rank false no chunk is merged by ranks.
    """

    PLAIN = "^[\\x21-\\x7eÀ-ÖØ-öø-ÿ]*$"
    PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
    #: Ends a word in place of the tokenizer's mark; no chunk holds it.
    MARK = "\n"

    def __init__(self, path: str, by_rank: bool = True) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_rank = by_rank
        if by_rank:
            ids, tokens = word_tokens(path)
            self.ids = np.array(ids, np.uint32)
            ranks = {token: rank for rank, token in enumerate(tokens)}
            self.last = np.fromiter((len(token) > 1 and token.endswith(self.MARK.encode()) for token in tokens), bool, len(tokens))
            self.encoding = tiktoken.Encoding("own", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={})

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, and where each chunk's begin and how many they are."""
        plain = np.zeros(len(chunks), bool)
        if self.by_rank:
            plain = pa.compute.and_not(pa.compute.match_substring_regex(chunks, self.PLAIN), pa.compute.match_substring(chunks, "<|")).to_numpy(zero_copy_only=False)
        sizes, flat = np.zeros(len(chunks), np.int64), []
        if plain.any():
            marked = pa.compute.replace_substring_regex(pa.compute.utf8_lower(chunks.filter(pa.array(plain))), self.PARTS, f"\\1{self.MARK}")
            words = np.cumsum(pa.compute.count_substring(marked, self.MARK).to_numpy())
            text = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), "")[0].as_py()
            ranks = self.encoding.encode_to_numpy(text, disallowed_special=())
            word_ends = np.concatenate(([0], np.flatnonzero(self.last[ranks]) + 1))
            sizes[plain] = np.diff(word_ends[words], prepend=0)
            flat.append(self.ids[ranks])
        others = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks.filter(pa.array(~plain)).to_pylist()]
        sizes[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        flat.append(np.fromiter(chain.from_iterable(others), np.uint32))
        # the others' ids stand behind those of the plain chunks
        starts = np.empty(len(chunks), np.int64)
        order = np.argsort(~plain, kind="stable")
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat), starts, sizes

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, as unsigned 32-bit numbers, and where each text's end."""
        chunks = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
        numbered = chunks.flatten().dictionary_encode()
        flat, starts, sizes = self.chunks(numbered.dictionary)
        codes = numbered.indices.to_numpy()
        ends = np.cumsum(chunks.value_lengths().to_numpy(), dtype=np.int64)
        return flat[expand(codes, starts, sizes)], np.concatenate(([0], np.cumsum(sizes[codes])))[ends]


def merge_pairs(model: dict) -> list[tuple[str, str]]:
    """The pairs that a tokenizer file's model merges, written as lists or, in older files, with a blank between."""
    return [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]


def word_tokens(path: str) -> tuple[list[int], list[bytes]]:
    """Ids and bytes of a tokenizer file's tokens in the order in which they merge; a word's end is WordTokenizer.MARK.

    Bytes come first, then bytes that end a word, so that a word's last byte takes its mark before anything merges.
    Tokens that hold the mark as a character of the text are left out.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, end, mark = model["vocab"], model["end_of_word_suffix"], WordTokenizer.MARK.encode()
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    octet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ids, tokens = [], []
    for token in chain(octet, (c + end for c in octet), map("".join, merge_pairs(model))):
        body = bytes(map(octet.__getitem__, token.removesuffix(end)))
        if mark not in body or token in octet:
            ids.append(vocabulary[token])
            tokens.append(body + mark if token.endswith(end) else body)
    return ids, tokens


def merges_by_rank(path: str) -> bool:
    """Whether each token of a tokenizer file has one rank and is what the file's model makes of the token's own text."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, pairs = model["end_of_word_suffix"], merge_pairs(model)
    products = list(map("".join, pairs))
    if not end or len(set(products)) < len(products):
        return False
    options = {"vocab": model["vocab"], "merges": pairs}
    ending, inner = BPE(**options, end_of_word_suffix=end), BPE(**options)
    return all(len((ending if p.endswith(end) else inner).tokenize(p.removesuffix(end))) == 1 for p in products)


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut where longer than capacity."""
    by_rank = merges_by_rank(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = WordTokenizer(vocabulary, by_rank)
        words = _tokenizers[vocabulary]
        for b in gathered(batches, 1, BLOCK_BYTES):
            rows: list[tuple] = []
            all_ids, ends = words.block(b.column(1))
            all_ids = np.insert(all_ids, ends, END_ID).astype("<u4", copy=False)
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            for doc, begin, end in zip(b.column(0).to_pylist(), [0, *ends], ends):
                for k, at in enumerate(range(begin, end, capacity)):
                    cut = all_ids[at : min(at + capacity, end)]
                    rows.append((doc, k, at - begin, len(cut), zlib.crc32(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(picked, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in decreasing order of length.

    A piece goes to the open bin after which the sum over all gaps of (number of open bins with that gap) squared
    is smallest; a new bin is opened only where none fits, as few bins are the aim, and is not weighed against the
    open ones. Moving a bin from gap h to gap h - s changes the sum by
    2 (N[h-s] - N[h]) + 2, and by 1 - 2 N[h] where it fills the bin.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    opened = 0
    for i in order:
        s = int(lengths[i])
        fitting = count[s:capacity]
        change = np.where(fitting > 0, 2 * (count[: capacity - s] - fitting) + 2, 1 << 60)
        if len(change) and fitting[0] > 0:
            change[0] -= 1
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < 1 << 60:
            gap = s + k
            at = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > s:
            open_bins[gap - s].append(at)
            count[gap - s] += 1
    return bins, offsets


def _packed(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """items (key, length) with sequence and offset, packed in shards of about SHARD_PIECES; sequence numbers are unique within a level."""
    shards = max(1, -(-items.count() // SHARD_PIECES))

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("length", "descending"), ("ticket", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        fill = np.bincount(bins, table.column("length").to_numpy()).astype(np.int64)
        table = table.append_column("sequence", pa.array((2 * shard + level << 32) + bins)).append_column("at", pa.array(offsets)).append_column("fill", pa.array(fill[bins]))
        return table.drop_columns(["shard", "ticket"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    ticket = F.xxhash64(*items.columns)
    dealt = items.withColumn("ticket", ticket).withColumn("shard", F.pmod(F.col("ticket"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, f"{fields}, sequence long, at long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items, which have a length of at most capacity, with sequence_id and offset.

    Full pieces are sequences of their own. The others are packed by sum_of_squares in shards dealt by hash; the
    sequences that a shard leaves open are packed once more as wholes, across shards.
    """
    first = materialise(_packed(items.filter(F.col("length") < capacity), 0, capacity), "packed")
    still_open = F.col("fill") <= OPEN_SHARE * capacity
    leftover = first.filter(still_open).groupBy("sequence").agg(F.max("fill").alias("length"))
    second = _second(leftover, capacity)
    names = items.columns
    closed = first.filter(~still_open).select(*names, F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))
    moved = first.filter(still_open).join(second, "sequence").select(*names, "sequence_id", (F.col("at") + F.col("base")).alias("offset"))
    full = items.filter(F.col("length") >= capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return closed.unionByName(moved).unionByName(full)


def _second(leftover: DataFrame, capacity: int) -> DataFrame:
    """(sequence, sequence_id, base): where each open sequence goes as a whole."""
    again = _packed(materialise(leftover.select(F.col("sequence").alias("was"), "length"), "open"), 1, capacity)
    return again.select(F.col("was").alias("sequence"), F.col("sequence").alias("sequence_id"), F.col("at").alias("base"))


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(materialise(pieces(docs, vocabulary, capacity=capacity), "pieces"), capacity)
