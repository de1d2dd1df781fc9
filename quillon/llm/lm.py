"""Katz backoff language model of any order over words, with Good-Turing discounts, counted and evaluated on Spark.

Null texts count as empty: their one token is the end. Repeated rows count, and are scored, as often as they
occur. Without any training row every token is unknown with probability one. An empty table gives an empty
result; columns other than the two named ones are dropped. A long run of one word is one word and one n-gram of
each order with a high count.

Words and n-grams are counted by 64-bit hashes: of 10^9 distinct ones about one pair in forty corpora shares a
count, of 10^12 some 27,000 pairs do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.blocks import cuts_of, pack_codes, pack_keys, part_count, unpack_codes, unpack_keys
from quillon.llm.shared import discard, gathered, give_back, map_batches, materialise, scratch_path, setting, shuffles_removed

#: The end token; no word contains white space.
END = "\n"
ORDER = 2
#: Counts up to this are discounted after Good and Turing.
MAX_DISCOUNTED = 5
#: Greater counts, which Katz leaves as they are, lose this much: else a context all of whose followers are so
#: frequent would leave no mass at all to others.
TOP_LOSS = 0.1
#: Text of a block, and behind the n-grams of one part and of one folder of the stored tables.
BLOCK_BYTES, PART_BYTES, TABLE_BYTES = 5 << 20, 2 << 20, 48 << 20
#: Most folders of a stored table for each order; they grow beyond that, which costs no memory.
MAX_TABLE_PARTS = 10_000
_START = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """A trained model. path has the tables grams (order, part, context, word, count, p, lower) and contexts (order, part, context, alpha).

    grams has a row for each n-gram, by hash of its context and of its last word: its count, its discounted
    probability p, and that of the n-gram without its first word. contexts has the backoff weight of each context.
    Both are in folders by order and part: the context's hash modulo parts, for single words, whose context is
    one, their own hash's.
    """

    path: str
    order: int
    parts: int
    train_tokens: int
    vocabulary: int
    starts: int
    unknown: float
    discounts: tuple[tuple[float, ...], ...]

    def grams(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("context long, word long, count long, p double, lower double, order int, part int").parquet(f"{self.path}/grams")

    def contexts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("context long, alpha double, order int, part int").parquet(f"{self.path}/contexts")


def discounts(of_counts: dict[int, int]) -> list[float]:
    """Factors d_1..d_k of Katz: (r*/r - m) / (1 - m), r* = (r+1) n_{r+1} / n_r, m = (k+1) n_{k+1} / n_1.

    A factor that the count-of-counts leave undefined or outside (0, 1) is (r - 0.5) / r instead.
    """
    n = lambda r: of_counts.get(r, 0)
    m = (MAX_DISCOUNTED + 1) * n(MAX_DISCOUNTED + 1) / n(1) if n(1) else 1.0
    out = []
    for r in range(1, MAX_DISCOUNTED + 1):
        d = ((r + 1) * n(r + 1) / n(r) / r - m) / (1 - m) if n(r) and m < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    """c times its discount."""
    table = np.array([0.0] + [r * x for r, x in enumerate(d, 1)])
    return np.where(c <= MAX_DISCOUNTED, table[np.minimum(c, MAX_DISCOUNTED)], c - TOP_LOSS)


def number_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, an end token after each, where each text's end, and the hashes by number, ascending."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    known = split.flatten().dictionary_encode()
    words = known.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in [END, *words]], np.uint64)
    codes, is_word = known.indices.to_numpy() + 1, np.array([bool(w) for w in [END, *words]])
    shown = is_word[codes]
    size = np.diff(np.concatenate(([0], np.cumsum(shown)))[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))])
    ends = np.cumsum(size + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    places = np.ones(len(out), bool)
    places[ends - 1] = False
    out[places] = codes[shown]
    distinct, number = np.unique(hashes[is_word], return_inverse=True)
    of = np.zeros(len(hashes), np.int64)
    of[is_word] = number
    return of[out].astype(np.int32), ends, distinct


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and that of its last word."""
    x = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ ((b << np.uint64(23)) | (b >> np.uint64(41)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def gram_keys(codes: np.ndarray, ends: np.ndarray, hashes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hash of the n-gram that ends at each token and that of its context, texts being padded by starts."""
    first, start, word = np.concatenate(([0], ends[:-1])), np.full(1, _START), hashes[codes]
    out = [(word, np.zeros(len(codes), np.uint64))]
    for n in range(2, order + 1):
        context = np.concatenate((start, out[-1][0][:-1]))
        context[first] = start
        out.append((mixed(context, word), context))
        start = mixed(start, np.full(1, _START))
    return out


def _distinct(codes: np.ndarray, hashes: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, ascending, and which one ends at each token."""
    return (hashes, codes) if n == 1 else np.unique(keys, return_inverse=True)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so that a block's ascending keys fall into them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _deal(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """(kind, part, of_block, keys, counts): for each block, order (kind) and part the distinct n-grams and how often the training texts have them; order n has n * parts parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in gathered(batches, 1, BLOCK_BYTES):
            codes, ends, hashes = number_words(b.column(1))
            learned = np.repeat(b.column(2).to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
            for n, (gram, _) in enumerate(gram_keys(codes, ends, hashes, order), 1):
                keys, at = _distinct(codes, hashes, gram, n)
                counts, part = np.bincount(at, learned, len(keys)).astype(np.int64), _part(keys, n * parts)
                del at
                cuts = cuts_of(part)
                runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [pa.array(np.full(len(runs), n, np.int32)), pa.array(part[cuts[:-1]], pa.int32()), pa.array([block] * len(runs), pa.int64()), pa.array([pack_keys(keys[i:j]) for i, j in runs], pa.binary()), pa.array([pack_codes(counts[i:j]) for i, j in runs], pa.binary())]
                del keys, counts, part
                yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "of_block", "keys", "counts"])
            del codes, ends, hashes, learned, gram, columns
            give_back()
            block += 1

    return map_batches(docs, run, "kind int, part int, of_block long, keys binary, counts binary")


def _count(table: pa.Table) -> pa.Table:
    """Global counts of a part's n-grams in the order they came, doubled, and plus one in the one place that stands for the n-gram; and, once for each part, how many have counts of 0 to MAX_DISCOUNTED + 1, how many greater ones, and the sum of these."""
    runs = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_codes(x) for x in table.column("counts").to_pylist()]
    _, first, at = np.unique(np.concatenate(runs), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    answers = 2 * total[at]
    answers[first] += 1
    top = MAX_DISCOUNTED + 1
    great = total > top
    summary = [*np.bincount(total[~great], minlength=top + 1).tolist(), int(great.sum()), int(total[great].sum())]
    ends = np.cumsum([len(r) for r in runs])
    packed = [pack_codes(answers[e - len(r) : e], 8) for r, e in zip(runs, ends)]
    return pa.table([table.column("of_block"), table.column("kind"), table.column("part"), pa.array(packed, pa.binary()), pa.array([summary] + [None] * (len(runs) - 1), pa.list_(pa.int64()))], names=["of_block", "kind", "part", "answers", "summary"])


class _State:
    """A block with the global counts of its n-grams: for each order n keys, at (the n-gram of each token), count, own, context, context_count and p by n-gram."""

    def __init__(self, block: pa.Table, counted: pa.Table, model: Model) -> None:
        self.codes, self.ends = unpack_codes(block.column("codes")[0].as_py()).astype(np.int32), np.array(block.column("ends")[0].as_py(), np.int64)
        self.hashes = unpack_keys(block.column("hashes")[0].as_py())
        self.begins = np.concatenate(([0], self.ends[:-1]))
        counted = counted.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds = counted.column("kind").to_numpy()
        answers = counted.column("answers").to_pylist()
        self.orders, before = [], None
        for n, (gram, context) in enumerate(gram_keys(self.codes, self.ends, self.hashes, model.order), 1):
            keys, at = _distinct(self.codes, self.hashes, gram, n)
            both = np.concatenate([unpack_codes(a, 8).astype(np.int64) for a, k in zip(answers, kinds) if k == n])
            count, own = both >> 1, (both & 1).astype(bool)
            del both
            at = at.astype(np.int32)
            place = np.empty(len(keys), np.int32)
            place[at] = np.arange(len(at), dtype=np.int32)
            del keys
            if n == 1:
                context_count = np.full(len(place), max(model.train_tokens, 1))
                p = np.where(count > 0, discounted(count, model.discounts[0]) / context_count, model.unknown)
            else:
                follows = np.concatenate(([0], before["count"][before["at"][:-1]]))
                follows[self.begins] = model.starts
                context_count = follows[place]
                p = discounted(count, model.discounts[n - 1]) / np.maximum(context_count, 1)
            before = {"n": n, "at": at, "count": count, "own": own, "context": context[place], "context_count": context_count, "p": p, "place": place}
            self.orders.append(before)


def _block_rows(docs: DataFrame) -> DataFrame:
    """(block, docs, flags, ends, codes, hashes) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in gathered(batches, 1, BLOCK_BYTES):
            codes, ends, hashes = number_words(b.column(1))
            values = [[block], [b.column(0).to_pylist()], [b.column(2).to_pylist()], [ends.tolist()], [pack_codes(codes)], [pack_keys(hashes)]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["block", "docs", "flags", "ends", "codes", "hashes"])
            block += 1

    return map_batches(docs, run, "block long, docs array<long>, flags array<boolean>, ends array<long>, codes binary, hashes binary")


def _counted(docs: DataFrame, order: int, path: str) -> tuple[Model, DataFrame]:
    """The model, its tables still to be written, and the counts by block, of docs (doc_id, text, flag: learn from it)."""
    parts = part_count(docs, part_bytes=PART_BYTES)
    starts = docs.filter("flag").count()
    counted = materialise(_deal(docs, order, parts).groupBy("kind", "part").applyInArrow(_count, "of_block long, kind int, part int, answers binary, summary array<long>"), "lm-counts")
    sums = counted.filter("summary is not null").groupBy("kind").agg(*[F.sum(F.element_at("summary", i + 1)) for i in range(MAX_DISCOUNTED + 4)]).collect()
    by_order = {r[0]: list(r[1:]) for r in sums}
    seen = [by_order.get(n, [0] * (MAX_DISCOUNTED + 4)) for n in range(1, order + 1)]
    top, words = MAX_DISCOUNTED + 1, seen[0]
    tokens = sum(r * words[r] for r in range(1, top + 1)) + words[top + 2]
    d = tuple(tuple(discounts(dict(enumerate(x[: top + 1])))) for x in seen)
    mass = sum(r * f * words[r] for r, f in enumerate(d[0], 1)) + words[top] * (top - TOP_LOSS) + words[top + 2] - TOP_LOSS * words[top + 1]
    table_parts = min(MAX_TABLE_PARTS, part_count(docs, part_bytes=TABLE_BYTES))
    model = Model(path, order, table_parts, tokens, sum(words[1 : top + 2]), starts, 1 - mass / tokens if tokens else 1.0, d)
    return model, counted.select("of_block", "kind", "part", "answers")


def _packed_grams(state: _State, model: Model) -> pa.Table:
    """Of the n-grams that a block stands for, a row for each order and part, by context: what their probabilities are made of."""
    rows, lower = [], None
    for o in state.orders:
        pick = np.flatnonzero(o["own"] & (o["count"] > 0))
        by = o["context"][pick] if o["n"] > 1 else state.hashes[state.codes[o["place"][pick]]]
        part = (by % np.uint64(model.parts)).astype(np.int64)
        sort = np.lexsort((o["context"][pick], part))
        pick, part = pick[sort], part[sort]
        at = o["place"][pick]
        numbers = [o["count"][pick], o["context_count"][pick]] + [lower[x][lower["at"][at]] if lower else np.zeros(len(pick), np.int64) for x in ("count", "context_count")]
        cuts = cuts_of(part)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            words, of = np.unique(state.codes[at[i:j]], return_inverse=True)  # numbered in the order of their hashes
            rows.append((o["n"], int(part[i]), pack_keys(o["context"][pick[i:j]]), pack_keys(state.hashes[words]), pack_codes(of), *[pack_codes(x[i:j], 8) for x in numbers]))
        lower = o
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["order", "part", *_PACKED])


def _store(model: Model, packed: DataFrame) -> None:
    """Write the model's tables from the packed rows of all blocks."""
    spark, d = packed.sparkSession, model.discounts

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part, contexts, words, of, *numbers in zip(*(c.to_pylist() for c in b.columns)):
                contexts = unpack_keys(contexts).view(np.int64)
                count, total, count_below, total_below = (unpack_codes(x, 8).astype(np.int64) for x in numbers)
                p = discounted(count, d[n - 1]) / total
                below = discounted(count_below, d[n - 2]) / total_below if n > 1 else np.zeros(len(p))
                values = [contexts, unpack_keys(words).view(np.int64)[unpack_codes(of)], count, p, below, np.full(len(p), n, np.int32), np.full(len(p), part, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["context", "word", "count", "p", "lower", "order", "part"])

    # four tasks for each folder, so that few folders meet in one
    spread = packed.repartition(4 * model.order * model.parts, "order", "part")
    rows = map_batches(spread, unpack, "context long, word long, count long, p double, lower double, order int, part int")
    # a task has few folders to write and need not sort, and spill, its rows by them
    with shuffles_removed(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):
        rows.write.option("compression", "zstd").partitionBy("order", "part").parquet(f"{model.path}/grams")
    # what a context's n-grams leave over, by what their last words have one order down
    left = model.grams(spark).filter("order > 1").groupBy("order", "part", "context").agg(F.sum("p").alias("kept"), F.sum("lower").alias("covered"))
    alpha = (1 - F.col("kept")) / (1 - F.col("covered"))
    with shuffles_removed(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):
        left.select("context", alpha.alias("alpha"), "order", "part").write.option("compression", "zstd").partitionBy("order", "part").parquet(f"{model.path}/contexts")


#: What _packed_grams() packs: contexts, the distinct words and which one each n-gram has, then counts of the n-gram, its
#: context, the n-gram one order down and that one's context.
_PACKED = ("contexts", "words", "of", "count", "total", "count_below", "total_below")
_GRAM_SCHEMA = "order int, part int, " + ", ".join(f"{c} binary" for c in _PACKED)


def _picked(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("flag"))


def train(docs: DataFrame, order: int = ORDER, path: str | None = None, text_col: str = "text") -> Model:
    """A model of all docs, with its tables in path, by default in the shared scratch folder."""
    if order < 1:
        raise ValueError("the order is at least 1")
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("flag"))
    model, counts = _counted(rows, order, path or scratch_path(docs.sparkSession, "lm-model"))

    def grams(block: pa.Table, counted: pa.Table) -> pa.Table:
        return _packed_grams(_State(block, counted, model), model)

    packed = materialise(_with_counts(rows, counts, grams, _GRAM_SCHEMA), "lm-grams")
    discard(counts)
    _store(model, packed)
    discard(packed)
    return model


def _with_counts(docs: DataFrame, counts: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over each block of docs and the global counts of its n-grams."""
    return _block_rows(docs).groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(run, schema)


def _evaluated(model: Model, state: _State) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """log10 of the probability of each token at the highest order that has it, and by order the tokens that back off there with their known contexts.

    The recursion goes down from the highest order: a token that an order has is done there; one that it has not
    takes the backoff weight of its context, if that was ever seen, and goes on one order down.
    """
    log, todo, backs = np.zeros(len(state.codes)), np.ones(len(state.codes), bool), []
    for o in reversed(state.orders):
        seen = o["count"][o["at"]] > 0
        done = todo & (seen | (o["n"] == 1))
        log[done] = np.log10(np.maximum(o["p"][o["at"][done]], 1e-300))
        todo &= ~done
        back = np.flatnonzero(todo & (o["context_count"][o["at"]] > 0))
        backs.append((o["n"], back, o["context"][o["at"][back]]))
    return log, backs


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, by a model of the rows not held out.

    The model is stored; its rows come from one pass with the scores' sums, in which each block of texts asks for
    the global counts of its own n-grams. Backoff weights are read from the stored table: a block asks for each of its
    contexts once, so that a frequent context has a row for each block, not for each document.
    """
    spark = docs.sparkSession
    rows = _picked(docs, ~held_out, id_col, text_col)
    model, counts = _counted(rows, order, scratch_path(spark, "lm-model"))

    def score(block: pa.Table, counted: pa.Table) -> pa.Table:
        """Rows of three kinds: the model's n-grams that the block stands for, packed; a document's sums; a context that the block's documents back off from, with these and how often."""
        state = _State(block, counted, model)
        grams = _packed_grams(state, model)
        log, backs = _evaluated(model, state)
        words = state.orders[0]
        c, length = words["count"][words["at"]], np.diff(state.ends, prepend=0)
        doc = np.repeat(np.arange(len(length)), length)
        sums = lambda x: np.bincount(doc, x, len(length))
        base = sums(np.log10((c + 1) / (model.train_tokens + model.vocabulary + 1)))
        number, n_docs, empty = block.column("block")[0].as_py(), len(length), pa.nulls
        head = [pa.array(np.full(n_docs, number)), pa.array(np.arange(n_docs)), block.column("docs").combine_chunks().flatten(), pa.compute.invert(block.column("flags").combine_chunks().flatten())]
        head += [pa.array(x) for x in (length, sums(c > 0).astype(np.int64), base, sums(log))]
        tables = [pa.table([*head, empty(n_docs, pa.int32()), empty(n_docs, pa.int64()), empty(n_docs, pa.list_(pa.int64())), empty(n_docs, pa.list_(pa.int64()))], names=_SCORE)]
        for n, at, context in backs:
            if not len(at):
                continue
            sort = np.lexsort((doc[at], context))
            of, where = context[sort], doc[at][sort]
            new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (where[1:] != where[:-1]))))
            times, of, where = np.diff(new, append=len(sort)), of[new], where[new]
            cuts = cuts_of(of)
            k = len(cuts) - 1
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (where, times)]
            none = [empty(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            tables.append(pa.table([pa.array(np.full(k, number)), *none, pa.array(np.full(k, n, np.int32)), pa.array(of[cuts[:-1]].view(np.int64)), *lists], names=_SCORE))
        del state, log, backs, words, c, doc
        give_back()
        # in the schema's order of columns, the others null
        return pa.concat_tables([*tables, grams], promote_options="default").select([*_SCORE, "part", *_PACKED])

    schema = "block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, order int, context long, rows array<long>, times array<long>, part int, " + ", ".join(f"{c} binary" for c in _PACKED)
    out = materialise(_with_counts(rows, counts, score, schema), "lm-scores")
    discard(counts)
    _store(model, out.filter("part is not null").select("order", "part", *_PACKED))
    asked = out.filter("context is not null").select("block", "order", "context", "rows", "times")
    found = asked.join(model.contexts(spark).select("order", "context", "alpha"), ["order", "context"])
    each = found.select("block", F.log10("alpha").alias("log_alpha"), F.explode(F.arrays_zip("rows", "times")).alias("x"))
    weights = each.groupBy("block", F.col("x.rows").alias("row")).agg(F.sum(F.col("x.times") * F.col("log_alpha")).alias("backoff"))
    whole = out.filter("row is not null").join(weights, ["block", "row"], "left")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("log") + F.coalesce("backoff", F.lit(0.0))).alias("score"))


_SCORE = ["block", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log", "order", "context", "rows", "times"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, score) per row of any docs, by the tables of a stored model.

    A row for each document and distinct n-gram is joined with grams by context and word, from the highest order
    down, and with contexts where it backs off. Frequent n-grams are skewed keys of these joins, which adaptive
    execution splits.
    """
    spark, n = docs.sparkSession, model.order
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    picked = materialise(picked, "lm-asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1, BLOCK_BYTES):
            codes, ends, hashes = number_words(b.column(1))
            keys = gram_keys(codes, ends, hashes, n)
            doc = np.repeat(b.column(0).to_numpy(), np.diff(ends, prepend=0))
            order = np.lexsort((keys[-1][0], doc))
            same = (doc[order][1:] == doc[order][:-1]) & (keys[-1][0][order][1:] == keys[-1][0][order][:-1])
            new = np.flatnonzero(np.concatenate(([True], ~same)))
            first, times = order[new], np.diff(new, append=len(order))
            values = [doc[first], times, hashes[codes[first]].view(np.int64), *[c[first].view(np.int64) for _, c in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)

    names = ["row", "times", "word", *[f"context_{k}" for k in range(1, n + 1)]]
    asked = map_batches(picked.select("row", "text"), run, ", ".join(f"{c} long" for c in names))
    for k in range(1, n + 1):
        grams = model.grams(spark).filter(F.col("order") == k).select(F.col("context").alias(f"context_{k}"), "word", F.col("p").alias(f"p_{k}"))
        asked = asked.join(grams, [f"context_{k}", "word"], "left")
        if k > 1:
            known = model.contexts(spark).filter(F.col("order") == k).select(F.col("context").alias(f"context_{k}"), F.col("alpha").alias(f"alpha_{k}"))
            asked = asked.join(known, f"context_{k}", "left")
    log = F.log10(F.greatest(F.coalesce("p_1", F.lit(model.unknown)), F.lit(1e-300)))
    for k in range(2, n + 1):
        log = F.when(F.col(f"p_{k}").isNotNull(), F.log10(f"p_{k}")).otherwise(F.coalesce(F.log10(f"alpha_{k}"), F.lit(0.0)) + log)
    sums = asked.groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.when(F.col("p_1").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * log).alias("score"))
    return picked.select("row", "doc_id").join(sums, "row").drop("row")
