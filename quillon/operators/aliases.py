"""All aliases in a text at once: an automaton of their characters, as arrays.

A state is a prefix of an alias. Its fail state is the longest other prefix that it ends with, its link the nearest
state on the way of fails that ends an alias. Texts are cut into strips that overlap by the longest alias, and the
strips of a batch go through the automaton in step, a character of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of aliases that one automaton holds; more are dealt to several, which all texts meet.
AUTOMATON_CHARS = 4_000_000
#: New characters of a strip.
STRIP = 128
SHIFT = np.int64(21)


@dataclass
class Automaton:
    #: Ascending state << 21 | character of each edge, and where it leads.
    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    #: The alias that a state ends, or -1, and the next state that ends one, or 0.
    ends: np.ndarray
    link: np.ndarray
    shorts: list[str]
    sizes: np.ndarray
    longest: int

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(open_):
            key = (state[open_] << SHIFT) | letter[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[open_[hit]] = self.targets[at[hit]]
            open_ = open_[~hit & (state[open_] > 0)]
            state[open_] = self.fail[state[open_]]
        return out

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, alias, start) of every occurrence."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        strips = -(-sizes // STRIP)
        text = np.repeat(np.arange(len(texts)), strips)
        new = (np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)) * STRIP
        start, end = np.maximum(0, new - self.longest + 1), np.minimum(new + STRIP, sizes[text])
        state, found = np.zeros(len(text), np.int64), []
        if not len(self.edges):
            return (np.zeros(0, np.int64),) * 3
        for i in range(int((end - start).max()) if len(text) else 0):
            live = np.flatnonzero(start + i < end)
            at = start[live] + i
            state[live] = self._step(state[live], flat[begins[text[live]] + at])
            now = state[live]
            rows = np.flatnonzero((now > 0) & (at >= new[live]))  # an earlier strip has what ends before
            now, at, where = now[rows], at[rows], text[live][rows]
            while len(now):
                hit = self.ends[now] >= 0
                found.append((where[hit], self.ends[now[hit]], at[hit] - self.sizes[self.ends[now[hit]]] + 1))
                now = self.link[now]
                more = now > 0
                now, at, where = now[more], at[more], where[more]
        return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ())))  # type: ignore[return-value]

    def shorts_in(self, texts: list[str]) -> list[list[str]]:
        """The distinct short names in each text, in order of first place, of equal places the longer alias first."""
        text, alias, start = self.matches(texts)
        order = np.lexsort((alias, -self.sizes[alias], start, text)) if len(text) else np.zeros(0, np.int64)
        out: list[dict[str, None]] = [{} for _ in texts]
        for i, a in zip(text[order].tolist(), alias[order].tolist()):
            out[i].setdefault(self.shorts[a])
        return [list(x) for x in out]


def automaton(aliases: list[tuple[str, str]]) -> Automaton:
    """Of (alias, short) pairs; empty aliases are left out, repeated ones keep the first short name in order of text."""
    known: dict[str, str] = {}
    for alias, short in sorted((a, s) for a, s in aliases if a):
        known.setdefault(alias, short)
    names = list(known)
    next_, ends, children = {}, [-1], [[]]
    for k, name in enumerate(names):
        at = 0
        for letter in map(ord, name):
            key = at << 21 | letter
            if key not in next_:
                next_[key] = len(ends)
                children[at].append((letter, len(ends)))
                ends.append(-1)
                children.append([])
            at = next_[key]
        ends[at] = k
    fail, link, queue = [0] * len(ends), [0] * len(ends), [0]
    for at in queue:
        for letter, child in children[at]:
            back = fail[at]
            while at and back and (back << 21 | letter) not in next_:
                back = fail[back]
            fail[child] = next_.get(back << 21 | letter, 0) if at else 0
            link[child] = fail[child] if ends[fail[child]] >= 0 else link[fail[child]]
            queue.append(child)
    edges = np.fromiter(next_, np.int64, len(next_))
    order = np.argsort(edges)
    sizes = np.array([len(n) for n in names], np.int64)
    return Automaton(edges[order], np.fromiter(next_.values(), np.int64, len(next_))[order], np.array(fail, np.int64), np.array(ends, np.int64), np.array(link, np.int64), [known[n] for n in names], sizes, int(sizes.max()) if len(names) else 1)


def find_aliases(rows: DataFrame, text_col: str, aliases: DataFrame, out: str = "companies", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """rows with out, the short names of the aliases (alias, short) in the text, in order of first place, without repeats.

    Aliases of up to chars characters make one automaton, which every task gets. More are dealt by hash to several,
    each built in the tasks that use it; texts meet all of them and their finds are merged by place.
    """
    listed = aliases.filter("alias <> ''").groupBy("alias").agg(F.min("short").alias("short"))
    total = listed.agg(F.sum(F.char_length("alias"))).first()[0] or 0
    names, schema = rows.columns, rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    at = names.index(text_col)
    if total <= chars:
        machine = rows.sparkSession.sparkContext.broadcast(automaton([(r.alias, r.short) for r in listed.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = machine.value.shorts_in([t or "" for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*names, out])

        return rows.mapInArrow(run, f"{schema}, {out} array<string>")
    shards = -(-total // chars)
    dealt = listed.withColumn("shard", F.pmod(F.xxhash64("alias"), F.lit(shards)).cast("int"))
    texts = rows.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    # texts are dealt in parts, so that a shard's texts are many groups
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    asked = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).select("text", "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("of_shard"))
    copies = dealt.select("alias", "short", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_part"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        machine, said = automaton(list(zip(right.column("alias").to_pylist(), right.column("short").to_pylist()))), left.column("text").to_pylist()
        text, alias, start = machine.matches(said)
        return pa.table([pa.array([said[i] for i in text.tolist()], pa.string()), pa.array(start), pa.array(-machine.sizes[alias] if len(alias) else alias), pa.array([machine.shorts[a] for a in alias.tolist()], pa.string())], names=["__text", "start", "size", "short"])

    hits = asked.groupBy("of_shard", "part").cogroup(copies.groupBy("shard", "of_part")).applyInArrow(search, "__text string, start long, size long, short string")
    first = hits.groupBy("__text", "short").agg(F.min(F.struct("start", "size")).alias("at"))
    merged = first.groupBy("__text").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "short"))), lambda x: x["short"]).alias(out))
    none = F.array().cast("array<string>")
    return rows.join(merged, F.col(text_col) == F.col("__text"), "left").select(*names, F.coalesce(out, none).alias(out))
