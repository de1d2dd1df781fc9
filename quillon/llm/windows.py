"""Packing of tokenised documents into windows by non-negative least squares over the histogram of piece lengths.

Documents are cut at full windows; what is left of each, shorter than a window, is counted by length. Shallow
combinations, two or three lengths that add up to a window, are weighed against that histogram by non-negative least
squares, the weights are rounded to repeat counts that the histogram can meet, and further combinations are taken
greedily while any is left whole. Residual pieces are laid end to end and cut where a window is full. The tokens after
the last full window become sequences of powers of two, which need no padding, so no sequence is padded.

Only the histogram, of one row for each length, meets on the driver. A piece finds its place from its length and its
running number among pieces of that length by arithmetic, so neither a frequent length nor a window is a group.

Null texts count as empty: they hold only the end id. Repeated rows are packed as often as they occur. Very long texts
are whole windows and one remainder; a text must fit a task. Ties between equal lengths go by the order in which rows
are read, which only decides the window's number. An empty table gives an empty result; other columns are dropped,
whatever their names. Strings of the tokenizer's special tokens are those tokens in a text too, as
add_special_tokens=False leaves it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.blocks import expand
from quillon.llm.shared import gathered, map_batches, materialise

CAPACITY = 1024
END_ID = 0
#: Most lengths that a combination joins.
DEPTH = 3
#: Rounds of the solver and combinations that each adds; what they leave is packed by the steps that follow.
ROUNDS, ADDED = 60, 64
#: Text whose distinct chunks are encoded once.
BLOCK_BYTES = 10 << 20
#: White space: a chunk that is empty or has some at an end does not stand alone.
SPACE = "\t\n\v\f\r\x1c-\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
BOUND = f"^[{SPACE}]|[{SPACE}]$|^$"


class ByteTokenizer:
    """Ids of whole texts by a byte-level tokenizer file, a block of texts at a time.

    A single blank between two other characters that are not white space begins a pre-token, so a text's ids are
    those of its chunks between such blanks in order. The distinct chunks of a block are encoded together as one
    text, and told apart by the bytes of their tokens. Texts with other blanks, and those that hold a special token,
    are encoded whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        octet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(octet.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def whole(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def together(self, chunks: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks joined by mark, and where each chunk's begin and how many they are; a blank belongs to the chunk after it."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        listed = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
        text = pa.compute.binary_join(listed, mark)[0].as_py()
        ids = self.encoding.encode_to_numpy(mark + text, disallowed_special=())
        token_ends = np.cumsum(self.sizes[ids])
        n = pa.compute.binary_length(chunks).to_numpy().astype(np.int64)
        ends = np.cumsum(n + 1)
        begin = np.searchsorted(token_ends, ends - n - (mark == " "), side="right")
        # the byte before a chunk is its mark's; a token that ends there is not the chunk's
        if mark == " ":
            begin = np.searchsorted(token_ends - self.sizes[ids], ends - n - 1)
        return ids, begin, np.searchsorted(token_ends, ends, side="left") + 1 - begin

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        texts = pa.compute.fill_null(texts, "")
        pieces = pa.compute.split_pattern(texts, " ")
        n_pieces = pieces.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(n_pieces)
        known = pieces.flatten().dictionary_encode()
        codes, n = known.indices.to_numpy().astype(np.int64), len(known.dictionary)
        bound = pa.compute.match_substring_regex(known.dictionary, BOUND).to_numpy(zero_copy_only=False)
        odd = np.add.reduceat(bound[codes], ends - n_pieces) > 0 if len(texts) else np.zeros(0, bool)
        for s in self.special:
            odd |= pa.compute.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # a text's first chunk has no blank before it and is encoded apart; an odd text takes the place of its first chunk
        firsts = ends - n_pieces
        opening = np.unique(codes[firsts[~odd]])
        number = np.full(n, -1)
        number[opening] = np.arange(len(opening))
        standing = np.flatnonzero(~bound)
        place = np.full(n, -1)
        place[standing] = np.arange(len(standing))
        inner = self.together(known.dictionary.take(pa.array(standing)), " ")
        begun = self.together(known.dictionary.take(pa.array(opening)), "\n")
        others = [self.whole(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()]
        flat = np.concatenate([inner[0], begun[0], *others]).astype(np.uint32)
        other_sizes = np.fromiter(map(len, others), np.int64, len(others))
        starts = np.concatenate((inner[1], len(inner[0]) + begun[1], len(inner[0]) + len(begun[0]) + np.cumsum(other_sizes) - other_sizes))
        sizes = np.concatenate((inner[2], begun[2], other_sizes))
        new = place[codes]
        new[firsts[~odd]] = len(standing) + number[codes[firsts[~odd]]]
        new[firsts[odd]] = len(standing) + len(opening) + np.arange(len(others))
        kept = ~np.repeat(odd, n_pieces)
        kept[firsts] = True
        per_text = np.add.reduceat(np.where(kept, sizes[new], 0), firsts) if len(texts) else np.zeros(0, np.int64)
        return flat[expand(new[kept], starts, sizes)], np.cumsum(per_text)


_tokenizers: dict[tuple[str, str], ByteTokenizer] = {}


def cut_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, number, ids): full windows with their checksum, and each document's remainder.

    A remainder has its ids, as unsigned 32-bit numbers by significance, and its running number among the task's of that length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vocabulary, pattern
        if key not in _tokenizers:
            _tokenizers[key] = ByteTokenizer(*key)
        task, seen = TaskContext.get().partitionId(), [0] * capacity
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number", "ids"]
        types = [pa.int64()] * 7 + [pa.binary()]
        for b in gathered(batches, 1, BLOCK_BYTES):
            flat, ends = _tokenizers[key].block(b.column(1))
            rows: list[tuple] = []
            for doc, begin, end in zip(b.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                ids = np.append(flat[begin:end], np.uint32(END_ID)).astype("<u4", copy=False)
                for at in range(0, len(ids), capacity):
                    cut = ids[at : at + capacity]
                    if len(cut) == capacity:
                        rows.append((doc, at, capacity, zlib.crc32(cut), len(ids), task, None, None))
                    else:
                        rows.append((doc, at, len(cut), None, len(ids), task, seen[len(cut)], by_significance(cut)))
                        seen[len(cut)] += 1
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), types)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(picked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long, ids binary")


def by_significance(ids: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: the high ones are mostly zero and compress away."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_significance(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def combinations(capacity: int = CAPACITY, depth: int = DEPTH) -> np.ndarray:
    """All ways to fill a window with two to depth lengths, descending, padded by zeros; depth is 2 or 3."""
    a = np.arange(capacity - 1, 0, -1)
    pairs = np.stack((a, capacity - a, 0 * a), axis=1)[a >= capacity - a]
    if depth < 3:
        return pairs
    first, second = (x.ravel() for x in np.meshgrid(a, a, indexing="ij"))
    third = capacity - first - second
    return np.concatenate((pairs, np.stack((first, second, third), axis=1)[(first >= second) & (second >= third) & (third > 0)]))


def used(parts: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length counts of the combinations take."""
    total = np.bincount(parts.ravel(), np.repeat(counts, parts.shape[1]), capacity + 1)
    total[0] = 0
    return total


def least_squares(parts: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS, added: int = ADDED) -> np.ndarray:
    """Non-negative weights of the combinations whose pieces come closest to the histogram, at most one for each length being positive.

    An active set grows by the combinations along which the squared error falls fastest, no two of them sharing a
    length; after each growth its own least squares are solved, going no further than to where a weight becomes zero,
    which is then dropped. Where that brings the error no lower, half as many are added, down to one.
    """
    capacity, scale = len(histogram) - 1, max(1.0, float(histogram.max()))
    goal, x = histogram / scale, np.zeros(len(parts))
    active, error = np.zeros(0, np.int64), np.inf

    def solved() -> np.ndarray:
        a = np.zeros((capacity + 1, len(active)))
        for j in range(parts.shape[1]):
            a[parts[active, j], np.arange(len(active))] += 1
        a[0] = 0
        return np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ goal)

    for _ in range(rounds):
        residual = goal - used(parts, x, capacity)
        residual[0] = 0
        before, error = error, float(residual @ residual)
        if error > before * (1 - 1e-6):
            added //= 2
        slope = residual[parts].sum(axis=1)
        slope[active] = 0
        order = np.argsort(-slope, kind="stable")[: 40 * added]
        taken, fresh = np.zeros(capacity + 1, bool), []
        for s in order[slope[order] > 1e-7].tolist():
            lengths = parts[s][parts[s] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                fresh.append(s)
                if len(fresh) >= added:
                    break
        if not fresh or not added:
            break
        active = np.concatenate((active, np.array(fresh, np.int64)))
        while len(active):
            z, now = solved(), x[active]
            low = z <= 1e-12
            if not low.any():
                x[active] = z
                break
            step = (now[low] / np.maximum(now[low] - z[low], 1e-300)).min()
            now = now + step * (z - now)
            now[low & (now <= 1e-12)] = 0
            if (keep := now > 0).all():
                now[np.flatnonzero(low)[0]], keep = 0, np.arange(len(now)) != np.flatnonzero(low)[0]
            x[active] = now
            active = active[keep]
    return x * scale


def rounded(parts: np.ndarray, weights: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts near weights that take no more pieces than there are, topped up greedily while a whole combination is left."""
    capacity, counts = len(histogram) - 1, np.rint(weights).astype(np.int64)
    over = used(parts, counts, capacity).astype(np.int64) - histogram
    for length in np.flatnonzero(over[1:] > 0) + 1:
        holders = np.flatnonzero((parts == length).any(axis=1) & (counts > 0))
        for s in holders[np.argsort(-counts[holders], kind="stable")].tolist():
            if over[length] <= 0:
                break
            less = min(int(counts[s]), -(-int(over[length]) // int((parts[s] == length).sum())))
            counts[s] -= less
            for part in parts[s][parts[s] > 0].tolist():
                over[part] -= less
    left = -over
    left[0] = 1 << 60
    same = (parts[:, :, None] == parts[:, None, :]).sum(axis=2)  # how often each length occurs in its combination
    while len(parts):
        room = (left[parts] // same).min(axis=1)
        s = int(room.argmax())
        if room[s] <= 0:
            break
        counts[s] += room[s]
        np.subtract.at(left, parts[s][parts[s] > 0], room[s])
    return counts


@dataclass
class Layout:
    """Where the numbered pieces of each length go."""

    capacity: int
    #: Of each length the first of its slots in windows, their number, and its first token among the residual ones.
    first: np.ndarray
    slots: np.ndarray
    stream: np.ndarray
    #: Of each run of slots, in order of length: its last slot's successor, its first, slots a window, first window, offset.
    run_end: np.ndarray
    run_first: np.ndarray
    run_slots: np.ndarray
    run_window: np.ndarray
    run_offset: np.ndarray
    windows: int
    #: Where sequences of residual tokens begin after the last full window, and their end.
    tail: np.ndarray

    def window(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of pieces whose number is below their length's slots."""
        at = self.first[length] + number
        run = np.searchsorted(self.run_end, at, side="right")
        q, m = at - self.run_first[run], self.run_slots[run]
        return self.run_window[run] + q // m, self.run_offset[run] + q % m * length

    def cuts(self, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) of the residual tokens from begin to end."""
        full = int(self.tail[0])
        while begin < end:
            if begin < full:
                sequence, start = begin // self.capacity, begin // self.capacity * self.capacity
                to = start + self.capacity
            else:
                k = int(np.searchsorted(self.tail, begin, side="right")) - 1
                sequence, start, to = full // self.capacity + k, int(self.tail[k]), int(self.tail[k + 1])
            yield begin, min(end, to), self.windows + sequence, begin - start
            begin = to


def layout(histogram: np.ndarray, depth: int = DEPTH) -> Layout:
    """histogram[n] pieces of length n, 0 < n < capacity; it has capacity + 1 entries."""
    capacity = len(histogram) - 1
    parts = combinations(capacity, depth)
    counts = rounded(parts, least_squares(parts, histogram), histogram) if histogram.any() else np.zeros(len(parts), np.int64)
    chosen = np.flatnonzero(counts)
    parts, counts = parts[chosen], counts[chosen]
    runs = []
    for (lengths, n), window in zip(zip(parts.tolist(), counts.tolist()), (np.cumsum(counts) - counts).tolist()):
        offset = 0
        for length in sorted(set(lengths) - {0}, reverse=True):
            m = lengths.count(length)
            runs.append((length, m * n, m, window, offset))
            offset += m * length
    length, n, m, window, offset = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    slots = np.bincount(length, n, capacity + 1).astype(np.int64)
    residual = (histogram - slots) * np.arange(capacity + 1)
    total = int(residual.sum())
    rest = total % capacity
    powers = [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]
    tail = total - rest + np.concatenate(([0], np.cumsum(powers))).astype(np.int64)
    ends = np.cumsum(n)
    return Layout(capacity, np.cumsum(slots) - slots, slots, np.cumsum(residual) - residual, ends, ends - n, m, window, offset, int(counts.sum()), tail)


def packed_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Windows of combinations are numbered from 0, those of residual pieces after them, and full windows of a single
    document below 0.
    """
    pieces = materialise(cut_documents(docs, vocabulary, pattern, capacity), "pieces")
    rest = pieces.filter("number is not null")
    counted = rest.groupBy("task", "length").agg(F.count("*").alias("n"))  # at most one row for each length and task
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # fewer rows than a window has tokens
        histogram[length] = n
    plan = pieces.sparkSession.sparkContext.broadcast(layout(histogram))
    ranked = rest.join(counted.select("task", "length", before.alias("before")), ["task", "length"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = plan.value
        for b in batches:
            length, number = b.column(2).to_numpy(), b.column(4).to_numpy()
            fits = number < at.slots[length]
            windows, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            windows[fits], offsets[fits] = at.window(length[fits], number[fits])
            stream = at.stream[length] + (number - at.slots[length]) * length
            rows = []
            for k, (doc, start, n, tokens, _, data) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                ids = from_significance(data)
                if fits[k]:
                    rows.append((doc, start, n, zlib.crc32(ids), tokens, int(windows[k]), int(offsets[k])))
                    continue
                base = int(stream[k])
                for begin, end, sequence, offset in at.cuts(base, base + n):
                    rows.append((doc, start + begin - base, end - begin, zlib.crc32(ids[begin - base : end - base]), tokens, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names)

    numbered = ranked.select("doc_id", "start", "length", "doc_tokens", (F.col("number") + F.col("before")).alias("number"), "ids")
    placed = map_batches(numbered, place, ", ".join(f"{n} long" for n in names))
    full = pieces.filter("number is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
