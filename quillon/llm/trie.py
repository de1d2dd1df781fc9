"""Prefix trie of conversations by sorted matrices of turn ids.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Conversations
become rows of turn ids, are range-partitioned by them, and each shard lays its rows out as a matrix, padded behind
their ends. After a lexical sort the columns where a row differs from the one before, accumulated from the left by
or, mark where the nodes of every depth begin, so that sums over runs give every depth's figures at once.

Nodes that reach a shard's first or last row may go on in the next one. They are two chains a shard, and are put
together by their prefix's digest: counts add up, and what a chain's nodes hold is added to those above them by a sum
along the chain. So no node is a group of its members, however many they are. Only the digest of the members that end
at such a node is taken by one task, as its definition demands: it streams packed chunks in order and holds one.

A long conversation is cut into segments of SEGMENT_TURNS turns; a segment goes on from the digest of all before it,
so the trie is one of segments whose roots are the ends of others. What lies below a segment's end is summed first, in
a pass over the later segments only, and carried up along the conversation that stands for each node.

Turns are ordered by number, null first; turns of equal number by role and then by their digest, repeated rows being
turns of their own. A null role or text is empty. Rows with a null conv_id belong to no conversation and are left out.
Turns are told apart by a 128-bit digest of role and text, so a very long text costs no more than a short one after
one scan. An empty table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.ranks import ranked
from quillon.llm.shared import joined, map_batches, materialise

SEGMENT_TURNS = 128
#: Rows of a shard, about; a row has SEGMENT_TURNS turns at most.
SHARD_ROWS = 16_384
#: A conversation takes up to HEADS - 1 first turns from the first of its hundred.
HEADS, FAMILY = 6, 100
NO_ENDS = hashlib.sha256(b"").hexdigest()

RAW = "task int, side int, d int, k long, key string, up string, conv_id long, parent long, up_side int, n_convs long, n_children long, n_leaves long, saved long, chars long, weight long, leaf boolean, goes_on boolean, ends_sha256 string, ends array<long>"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, id, chars): turns in order, from 0 on; id is the digest of role and text, chars the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    turns = rows.filter("conv_id is not null").select("conv_id", "turn", "role", F.unhex(named).alias("id"), F.length("text").cast("long").alias("chars"))
    return materialise(ranked(turns, ["conv_id"], ["turn", "role", "id"], "turns").select("conv_id", "at", "id", "chars"), "numbered")


def rebuilt(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, n, id, chars) of conversations whose first turns are those of the first of their family, and (conv_id) of those left without turns.

    A conversation c takes the first h turns of c - c % family and goes on with its own after h, h being the unsigned
    CRC-32 of the decimal c modulo heads.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.filter(F.col("at") >= h).select("conv_id", F.lit(1).alias("part"), F.col("at").alias("was"), "id", "chars")
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("at") < heads - 1)).select(F.col("conv_id").alias("base"), "at", "id", "chars")
    known = turns.filter("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    given = known.join(first, "base").filter("at < h").select("conv_id", F.lit(0).alias("part"), F.col("at").alias("was"), "id", "chars")
    whole = materialise(ranked(own.unionByName(given), ["conv_id"], ["part", "was"], "rebuilt").drop("part", "was"), "whole")
    return whole, known.select("conv_id").join(whole.filter("at = 0"), "conv_id", "left_anti")


def segments(turns: DataFrame, bare: DataFrame, size: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, k, ids, chars, last, root, above): at most size turns a row; last marks a conversation's end.

    root tells apart what comes before, and above is the smallest conversation that begins so, this one for the first segment.
    """
    k = F.floor(F.col("at") / size).cast("long")
    packed = turns.groupBy("conv_id", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "chars"))).alias("t"), F.max("n").alias("n"))  # at most size turns
    cut = packed.select("conv_id", "k", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"), ((F.col("k") + 1) * size >= F.col("n")).alias("last"))
    none = bare.select("conv_id", F.lit(0).cast("long").alias("k"), F.array().cast("array<binary>").alias("ids"), F.array().cast("array<long>").alias("chars"), F.lit(True).alias("last"))
    cut = materialise(cut.unionByName(none), "segments")
    if cut.filter("k > 0").isEmpty():
        return cut.withColumn("root", F.lit("")).withColumn("above", F.col("conv_id"))
    # of each segment two hashes of all before it, and of those through it, by narrow rows
    full = F.size("ids") == size
    long = cut.join(cut.filter((F.col("k") == 0) & full).select("conv_id"), "conv_id", "left_semi").select("conv_id", "k", full.alias("full"), F.md5(F.array_join(F.transform("ids", F.hex), "").cast("binary")).alias("s"))
    in_order = Window.partitionBy("conv_id").orderBy("k")
    hashes = lambda end: F.concat_ws(":", *[F.bit_xor(F.xxhash64(F.lit(seed), "k", "s")).over(in_order.rowsBetween(Window.unboundedPreceding, end)).cast("string") for seed in (1, 2)])
    roots = materialise(long.select("conv_id", "k", "full", hashes(-1).alias("root"), hashes(0).alias("through")), "roots")
    tops = roots.filter("full").groupBy(F.col("through").alias("root")).agg(F.min("conv_id").alias("above"))
    named = roots.filter("k > 0").join(tops, "root").select("conv_id", "k", "root", "above")
    rooted = cut.join(named, ["conv_id", "k"], "left")
    return materialise(rooted.withColumns({"root": F.coalesce("root", F.lit("")), "above": F.coalesce("above", "conv_id")}), "rooted")


def _shard(task: int, b: pa.RecordBatch) -> pa.Table:
    """The nodes of a shard's rows (root, ids, conv_id, k, chars, last, saved, leaves, kids, above)."""
    roots, root = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
    lists, conv = b.column(1), b.column(2).to_numpy()
    lens = lists.value_lengths().to_numpy().astype(np.int64)
    n, width = len(lens), int(lens.max())
    ids = np.frombuffer(b"".join(lists.flatten().to_pylist()), "S16") if lens.any() else np.zeros(0, "S16")
    names, code = np.unique(ids, return_inverse=True)
    first = np.cumsum(lens) - lens
    matrix = np.zeros((n, width), np.int32)
    matrix[np.repeat(np.arange(n), lens), np.arange(len(ids)) - np.repeat(first, lens)] = code + 1
    order = np.lexsort((conv, *matrix.T[::-1], root))
    matrix, root, conv, lens, first = matrix[order], root[order], conv[order], lens[order], first[order]
    k = b.column(3).to_numpy()[order]
    chars = b.column(4).flatten().to_numpy()
    last = b.column(5).to_numpy(zero_copy_only=False)[order]
    carried = [b.column(i).to_numpy()[order] for i in (6, 7, 8)]
    lowest = {True: np.minimum(conv, b.column(9).to_numpy()[order]), False: conv}  # by whether the depth is 0

    begins = np.ones((n, width + 1), bool)
    begins[1:, 0] = root[1:] != root[:-1]
    begins[1:, 1:] = matrix[1:] != matrix[:-1]
    begins = np.logical_or.accumulate(begins, axis=1)
    out, chains = [], {0: [], 1: []}
    below = None  # of the depth below: starts, and what its closed nodes hold
    for d in range(width, -1, -1):
        start = np.flatnonzero(begins[:, d])
        end = np.append(start[1:], n)
        real = lens[start] >= d
        count = end - start
        low = np.minimum.reduceat(lowest[d == 0], start)
        owner = lambda rows: np.searchsorted(start, rows, side="right") - 1  # noqa: B023, E731
        here = np.flatnonzero((lens == d) & ~last)
        saved, leaves, kids = (_add(owner(here), c[here], len(start)) for c in carried)
        goes_on = np.bincount(owner(here), minlength=len(start)) > 0
        if below is not None:
            at, shut, b_saved, b_leaves = below
            for total, values in ((kids, np.ones(len(at), np.int64)), (saved, b_saved), (leaves, b_leaves)):
                total += _add(at[shut], values[shut], len(start))
        own = chars[first[start][real] + d - 1] if d else np.zeros(int(real.sum()), np.int64)
        length = np.zeros(len(start), np.int64)
        length[real] = own
        weight = (count - 1) * length
        is_open = real & ((start == 0) | (end == n))
        shut = real & ~is_open
        leaf = shut & (kids == 0) & ~goes_on
        leaves = np.where(leaf, 1, leaves)
        saved = np.where(shut, saved + weight, saved)
        ending = np.flatnonzero((lens == d) & last)
        ended = owner(ending)
        bounds = np.searchsorted(ended, np.arange(len(start) + 1))
        up = np.searchsorted(np.flatnonzero(begins[:, d - 1]), start, side="right") - 1 if d else np.zeros(len(start), np.int64)
        if d:
            up_start = np.flatnonzero(begins[:, d - 1])
            up_end = np.append(up_start[1:], n)
            up_low = np.minimum.reduceat(lowest[d == 1], up_start)
            up_side = np.where(up_start == 0, 0, np.where(up_end == n, 1, -1))[up]
            parent = up_low[up]
        else:
            up_side, parent = np.full(len(start), -1), np.zeros(len(start), np.int64)
        for i in np.flatnonzero(is_open).tolist():
            ends = conv[ending[bounds[i] : bounds[i + 1]]]
            row = (d, int(k[start[i]]), int(low[i]), int(count[i]), int(kids[i]), int(leaves[i]), int(saved[i]), int(length[i]), bool(goes_on[i]), ends)
            sides = [s for s, touches in ((0, start[i] == 0), (1, end[i] == n)) if touches]
            chains[sides[0]].append(row)
            if len(sides) == 2:  # the whole shard: it counts in one chain only
                chains[1].append((*row[:3], 0, 0, 0, 0, row[7], row[8], ends[:0]))
        some = np.flatnonzero(shut)
        digests = [hashlib.sha256(",".join(map(str, conv[ending[bounds[i] : bounds[i + 1]]].tolist())).encode()).hexdigest() for i in some.tolist()]
        m, none = len(some), lambda kind, m=len(some): pa.nulls(m, kind)
        inner = up_side[some] < 0
        columns = [
            pa.array(np.full(m, task, np.int32)), none(pa.int32()), pa.array(np.full(m, d, np.int32)), pa.array(k[start[some]]), none(pa.string()), none(pa.string()), pa.array(low[some]),
            pa.array(parent[some], mask=~inner if d else np.ones(m, bool)), pa.array(up_side[some].astype(np.int32), mask=inner), pa.array(count[some]), pa.array(kids[some]), pa.array(leaves[some]), pa.array(saved[some]), pa.array(length[some]),
            pa.array(weight[some]), pa.array(leaf[some]), pa.array(goes_on[some]), pa.array(digests, pa.string()), none(pa.list_(pa.int64())),
        ]
        out.append(pa.table(columns, names=NAMES))
        below = up[real], shut[real], saved[real], leaves[real]
    for side, rows in chains.items():
        end_row = 0 if side == 0 else n - 1
        prefix = hashlib.md5(roots[root[end_row]].encode())
        keys, flat = [prefix.hexdigest()], names[matrix[end_row] - 1] if width else []
        for d in range(int(lens[end_row])):
            prefix.update(bytes(flat[d]).ljust(16, b"\0"))
            keys.append(prefix.hexdigest())
        made = [(task, side, d, kk, keys[d], keys[d - 1] if d else None, c, None, None, cnt, kids, leaves, saved, ch, None, None, on, None, ends.tolist()) for d, kk, c, cnt, kids, leaves, saved, ch, on, ends in rows]
        out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*made), TYPES)], names=NAMES))
    return pa.concat_tables(out)


NAMES = [x.split()[0] for x in RAW.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in RAW.split(", ")]


def _add(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, exact at any size."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _end_digests(raw: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes that cross shards: their chunks of ends, which are in order from task to task, are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
        for b in batches:
            for key, ends in zip(b.column(0).to_pylist(), b.column(1)):
                text = ",".join(map(str, ends.values.to_pylist())).encode()
                if key == current:
                    state.update(b"," + text)
                    continue
                if current is not None:
                    yield row()
                current, state = key, hashlib.sha256(text)
        if current is not None:
            yield row()

    chunks = raw.filter("size(ends) > 0").select("key", "task", "side", "ends").repartition("key").sortWithinPartitions("key", "task", "side").select("key", "ends")
    return map_batches(chunks, run, "key string, ends_sha256 string")


def nodes(paths: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, k, d, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, weight, leaf, ends_sha256) of paths' trie.

    paths are segments() with saved, leaves and kids, what their conversations carry up from later segments. d is the
    depth within the segment, 0 its root.
    """
    count = paths.count()
    place = F.concat(F.lpad(F.col("k").cast("string"), 20, "0"), F.col("root")).alias("root")
    rows = paths.select(place, "ids", "conv_id", "k", "chars", "last", "saved", "leaves", "kids", "above").repartitionByRange(max(1, -(-count // shard_rows)), "root", "ids", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield from _shard(TaskContext.get().partitionId(), joined(held)).combine_chunks().to_batches(max_chunksize=20_000)

    raw = materialise(map_batches(rows, run, RAW), "shards")
    chain = raw.filter("side is not null")
    whole = chain.groupBy("key").agg(
        F.max("up").alias("up"), F.max("d").alias("d"), F.max("k").alias("k"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("goes_on").alias("goes_on"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.min(F.struct("task", "side")).alias("owner"),
    )
    whole = materialise(whole, "crossing")
    kids = whole.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    whole = whole.withColumn("leaf", (F.col("n_children") == 0) & ~F.col("goes_on")).withColumn("weight", (F.col("n_convs") - 1) * F.col("chars"))
    whole = materialise(whole.drop("more"), "counted")
    # what a chain's nodes hold of the shard, and the weight of those that it owns, counts for themselves and all above
    own = F.col("owner") == F.struct("task", "side")
    links = chain.select("task", "side", "d", "key", "saved", "n_leaves").join(whole.select("key", "owner", "leaf", "weight", "conv_id"), "key")
    upward = Window.partitionBy("task", "side").orderBy(F.desc("d"))
    weight, leaf = F.when(own, F.col("weight")).otherwise(0), F.when(own & F.col("leaf"), 1).otherwise(0)
    summed = links.select("key", F.sum(F.col("saved") + weight).over(upward).alias("saved_tokens"), F.sum(F.col("n_leaves") + leaf).over(upward).alias("n_leaves"))
    held = summed.groupBy("key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = whole.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    crossing = whole.join(held, "key").join(parents, "up", "left").join(_end_digests(raw), "key", "left")
    names = ["conv_id", "k", "d", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "weight", "leaf", "ends_sha256"]
    crossing = crossing.select("conv_id", "k", "d", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "weight", "leaf", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    # nodes below a chain have their parent from it, found by its place
    shut = raw.filter("side is null")
    ups = links.select("task", F.col("side").alias("up_side"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("of"))
    shut = shut.join(ups, ["task", "up_side", "d"], "left").withColumn("parent_conv_id", F.coalesce("parent", "of")).withColumnRenamed("saved", "saved_tokens")
    return shut.select(*names).unionByName(crossing.select(*names))


def prefix_trie(turns: DataFrame, bare: DataFrame, size: int = SEGMENT_TURNS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all nodes.

    turns are (conv_id, at, n, id, chars) with n turns a conversation, bare the (conv_id) of those without turns.
    """
    cut = segments(turns, bare, size)
    zero = {c: F.lit(0).cast("long") for c in ("saved", "leaves", "kids")}
    deep = cut.filter("k > 0")
    if deep.isEmpty():
        paths = cut.withColumns(zero)
    else:
        found = nodes(deep.withColumns(zero), shard_rows).filter("d > 0")
        held = found.groupBy("conv_id", "k").agg(F.sum("weight").alias("w"), F.sum(F.col("leaf").cast("long")).alias("l"), F.sum((F.col("d") == 1).cast("long")).alias("c"))
        later = deep.select("conv_id", "k").join(held, ["conv_id", "k"], "left").fillna(0, ["w", "l", "c"])
        back = Window.partitionBy("conv_id").orderBy(F.desc("k"))
        carried = later.select("conv_id", (F.col("k") - 1).alias("k"), F.sum("w").over(back).alias("saved"), F.sum("l").over(back).alias("leaves"), F.col("c").alias("kids"))
        paths = materialise(cut.join(carried, ["conv_id", "k"], "left").fillna(0, ["saved", "leaves", "kids"]), "carrying")
    found = nodes(paths, shard_rows).filter("d > 0 or k = 0")
    return found.select("conv_id", (F.col("k") * size + F.col("d")).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, size: int = SEGMENT_TURNS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """prefix_trie() of conversations (conv_id, turn, role, text) rebuilt by their families."""
    return prefix_trie(*rebuilt(numbered_turns(conversations)), size, shard_rows)
