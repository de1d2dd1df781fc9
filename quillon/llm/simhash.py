"""SimHash near-duplicate groups by tiled exact comparison of fingerprints.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other; repeated
rows fall into one group; an empty table gives an empty result. Columns other than the two named ones are
dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import broadcast_if_small, map_batches, materialise, unused

SHINGLE_WORDS = 3
HASH_SEED = 42
TILE_ROWS = 4096
#: Rows of the left tile that are compared at once, which bounds the comparison's memory to 8 MB.
SLAB_ROWS = 256


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 values, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())]
    values, set_bits = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        octets = values[at : at + 65536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * set_bits > len(values)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(picked, run, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between the values of two tiles: all of them, or a spanning forest where there are more links than values."""
    rows, cols = [], []
    for at in range(0, len(left), SLAB_ROWS):
        near = np.bitwise_count(left[at : at + SLAB_ROWS, None] ^ right[None, :]) <= radius
        if same:
            near &= np.arange(at, at + near.shape[0])[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        if len(i):
            rows.append(i + at)
            cols.append(j)
        if sum(map(len, rows)) > 4 * (len(left) + len(right)):
            rows, cols = _thin(rows, cols, len(left), len(right), same)
    if rows:
        rows, cols = _thin(rows, cols, len(left), len(right), same)
    values = left if same else np.concatenate((left, right))
    if not rows:
        return values[:0], values[:0]
    u, v = rows[0], cols[0] + (0 if same else len(left))
    return values[u], values[v]


def _thin(rows: list, cols: list, n_left: int, n_right: int, same: bool) -> tuple[list, list]:
    """Where links outnumber values, replace them by at most one link per value that joins the same values."""
    shift = 0 if same else n_left
    u, v = np.concatenate(rows), np.concatenate(cols) + shift
    n = n_left + (0 if same else n_right)
    if len(u) <= n:
        return [u], [v - shift]
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    if same:
        return [label[member]], [member]
    # between two tiles a link needs an end in each: chain through one left and one right member of the component
    first_left = np.full(n, -1)
    first_right = np.full(n, -1)
    lefts, rights = np.unique(u), np.unique(v)
    first_left[label[lefts][::-1]] = lefts[::-1]
    first_right[label[rights][::-1]] = rights[::-1]
    out_u = np.concatenate((lefts, first_left[label[rights]]))
    out_v = np.concatenate((first_right[label[lefts]], rights))
    return [out_u], [out_v - shift]


def near_links(values: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): links that join every two distinct fingerprints within radius bits, directly or over others.

    values has the distinct fingerprints as fp. They are laid out in tiles of equal population counts in each of
    the four 16-bit quarters. The Hamming distance is at least the sum of the quarters' count differences, so
    only tile pairs where that sum is within radius are compared, each exactly. There are 17**4 such counts at
    most, which bounds the table that is broadcast.
    """
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)).cast("int")
    cell = sum((quarter(i) * 17**i for i in range(1, 4)), quarter(0))
    placed = values.select("fp", cell.alias("cell"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    tiles = materialise(
        placed.join(F.broadcast(parts), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    step_array = F.array(*[F.struct(*[F.lit(x).alias(f"s{i}") for i, x in enumerate(d)]) for d in steps])
    digit = lambda i: F.floor(F.col("cell") / 17**i) % 17
    moved = tiles.select("cell", "part", F.explode(step_array).alias("s")).select(
        F.col("cell").alias("a_cell"), F.col("part").alias("a_part"), *[(digit(i) + F.col(f"s.s{i}")).cast("int").alias(f"d{i}") for i in range(4)]
    )
    moved = moved.filter(" and ".join(f"d{i} between 0 and 16" for i in range(4)))
    target = sum((F.col(f"d{i}") * 17**i for i in range(1, 4)), F.col("d0"))
    moved = moved.select("a_cell", "a_part", target.alias("b_cell"))
    pairs = moved.join(tiles.select(F.col("cell").alias("b_cell"), F.col("part").alias("b_part")), "b_cell")
    pairs = pairs.filter("a_cell <> b_cell or a_part <= b_part")
    pairs = pairs.join(tiles.select(F.col("cell").alias("a_cell"), F.col("part").alias("a_part"), F.col("fps").alias("a")), ["a_cell", "a_part"])
    pairs = pairs.join(tiles.select(F.col("cell").alias("b_cell"), F.col("part").alias("b_part"), F.col("fps").alias("b")), ["b_cell", "b_part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            a_col, b_col = batch.column(0), batch.column(1)
            a_off, b_off = a_col.offsets.to_numpy(), b_col.offsets.to_numpy()
            a_all, b_all = a_col.values.to_numpy().view(np.uint64), b_col.values.to_numpy().view(np.uint64)
            for k, same in enumerate(batch.column(2).to_pylist()):
                u, v = forest(a_all[a_off[k] : a_off[k + 1]], b_all[b_off[k] : b_off[k + 1]], radius, same)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
                yield pa.RecordBatch.from_arrays(columns, ["u", "v"])

    same = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") == F.col("b_part"))
    return map_batches(pairs.select("a", "b", same.alias("same")), compare, "u long, v long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links; root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder. The
    neighbourhoods are only ever aggregated to a minimum, never collected, so that a hub costs no memory.
    """
    links = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = materialise(small.filter("u <> v").distinct(), "small-star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: component_id is the smallest doc_id reachable over links of radius bits or less."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(near_links(classes.select("fp"), radius))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(linked.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Ids that are broadcast to drop their documents, so that texts stay where they are; more are joined by shuffle.
BROADCAST_IDS = 500_000


def drop_near_copies(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that share a doc_id, null included, one stays if any of them is the first of its group: the one that
    comes first by its columns, compared as text from the left, nulls first.
    """
    mark = unused("doc_id", docs.columns)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    verdicts = near_groups(docs, radius=radius).groupBy("doc_id").agg(F.max(first).alias("kept"), F.count("*").alias("copies"))
    apart = materialise(verdicts.filter("not kept or copies > 1").select(F.col("doc_id").alias(mark), "kept"), "dropped")
    same = docs["doc_id"].cast("long").eqNullSafe(apart[mark])
    out = docs.join(broadcast_if_small(apart, BROADCAST_IDS), same, "left_anti")
    repeated = apart.filter("kept")
    if repeated.isEmpty():
        return out
    # rows of one doc_id are few as a rule, but may be many: the least is kept by an aggregate, not by sorting them
    shared = docs.join(broadcast_if_small(repeated, BROADCAST_IDS), docs["doc_id"].cast("long").eqNullSafe(repeated[mark]), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = shared.groupBy("doc_id").agg(F.min_by(whole, order).alias("row"))
    return out.unionByName(kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
