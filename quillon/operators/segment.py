"""Words of texts without blanks: the likeliest path through a graph of dictionary words.

Runs of Han characters are cut where the product of the words' shares is largest; runs of Latin letters and digits are
words, as is every other character that is not white space. Numbers count once more, with the unit that follows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest word in characters, and the words that are sent to every task; more are found by a join.
MAX_WORD, BROADCAST_WORDS = 16, 500_000
#: Runs of Han characters whose words a task remembers.
KNOWN_RUNS = 50_000
HAN = "一-鿿"
RUNS = re.compile(f"[{HAN}]+|[A-Za-z0-9À-ÿ]+|[^\\s{HAN}A-Za-z0-9À-ÿ]")
#: A number with its separators, and the units that may follow it.
UNITS = "亿元|万元|千元|元|GWh|GW|MW|兆瓦时|万千瓦时|万辆|万吨"
NUMBERS = re.compile(rf"\d[\d,，.]*(?:{UNITS}|%)?", re.I)


def best_path(length: int, found: Mapping[int, list[tuple[int, float]]], floor: float) -> list[tuple[int, int]]:
    """(start, end) of the words of a run of so many characters; found has the words from each start by their end and log share.

    A character that begins no word stands alone with the log share floor. Of equally likely paths the one whose
    first word is longer is taken, from the end backwards.
    """
    best, step = [0.0] * (length + 1), [0] * length
    for i in range(length - 1, -1, -1):
        ways = found.get(i, [])
        if not any(end == i + 1 for end, _ in ways):
            ways = [*ways, (i + 1, floor)]
        best[i], step[i] = max((score + best[end], end) for end, score in ways)
    out, at = [], 0
    while at < length:
        out.append((at, step[at]))
        at = step[at]
    return out


def words_of(text: str, scores: Mapping[str, float], floor: float, longest: int, known: dict[str, list[str]] | None = None) -> list[str]:
    """The words of a text. known remembers those of runs from call to call with the same scores."""
    out: list[str] = []
    for match in RUNS.finditer(text):
        run = match.group()
        if not "一" <= run[0] <= "鿿":
            out.append(run)
            continue
        if known is not None and run in known:
            out += known[run]
            continue
        found = {i: [(i + n, scores[run[i : i + n]]) for n in range(1, min(longest, len(run) - i) + 1) if run[i : i + n] in scores] for i in range(len(run))}
        words = [run[a:b] for a, b in best_path(len(run), found, floor)]
        out += words
        if known is not None:
            if len(known) >= KNOWN_RUNS:
                known.clear()
            known[run] = words
    return out + NUMBERS.findall(text)


def segmented(rows: DataFrame, text_col: str, dictionary: DataFrame, out: str = "words") -> DataFrame:
    """rows with out, the array of the text's words; dictionary has (word, n) with n occurrences.

    A dictionary of up to BROADCAST_WORDS goes to every task. Of a larger one each task gets what its texts may hold:
    the distinct runs of characters of all texts are joined with it, and the words found with their texts.
    """
    words = dictionary.filter((F.col("n") > 0) & (F.char_length("word") <= MAX_WORD)).groupBy("word").agg(F.sum("n").alias("n"))
    some = words.select("word", "n", F.log("n").alias("log")).limit(BROADCAST_WORDS + 1).collect()
    few = len(some) <= BROADCAST_WORDS
    total, longest = (sum(r.n for r in some), max((len(r.word) for r in some), default=1)) if few else words.agg(F.sum("n"), F.max(F.char_length("word"))).first()
    floor = -math.log(total or 1)
    names, schema = rows.columns, rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    at = names.index(text_col)
    known = rows.sparkSession.sparkContext.broadcast({r.word: r.log + floor for r in some}) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[str]] | None = {} if few else None
        for b in batches:
            texts = b.column(at).to_pylist()
            own = [known.value] * len(texts) if few else [dict(x or []) for x in b.column(len(names)).to_pylist()]
            found = [words_of(t or "", s, floor, longest, runs) for t, s in zip(texts, own)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.list_(pa.string()))], [*names, out])

    if few:
        return rows.mapInArrow(run, f"{schema}, {out} array<string>")
    texts = rows.select(F.col(text_col).alias("__text")).distinct()
    runs = texts.select("__text", F.explode(F.regexp_extract_all(F.coalesce("__text", F.lit("")), F.lit(f"([{HAN}]+)"), F.lit(1))).alias("run"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("run")))).alias("n")
    parts = runs.select("__text", "run", size).select("__text", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - F.col("n") + 1), lambda i: F.substr("run", i, F.col("n")))).alias("word")).distinct()
    held = parts.join(words.select("word", (F.log("n") + floor).alias("score")), "word").groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("__words"))
    return rows.join(held, F.col(text_col) == F.col("__text"), "left").select(*names, "__words").mapInArrow(run, f"{schema}, {out} array<string>")


def word_counts(corpus: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """(word, n): a dictionary from a corpus. Single Han characters, and runs of up to longest that occur least times and hold together.

    A run holds together if it is cohesion times as frequent as its two parts would make it by chance, wherever it is cut.
    """
    runs = corpus.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"([{HAN}]+)"), F.lit(1))).alias("run"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.char_length("run") - n + 1), lambda i: F.substr("run", i, F.lit(n)))
    grams = F.flatten(F.array(*[F.when(F.char_length("run") >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))
    counts = runs.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.filter(F.char_length("word") == 1).agg(F.sum("n").alias("total"))
    multi = counts.filter((F.char_length("word") > 1) & (F.col("n") >= least))
    split = multi.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("i")).select("word", "n", F.substr("word", F.lit(1), F.col("i")).alias("a"), F.substr("word", F.col("i") + 1).alias("b"))
    parts = split.join(counts.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    bound = parts.join(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("ratio"))  # one row
    return counts.filter(F.char_length("word") == 1).unionByName(bound.filter(F.col("ratio") >= cohesion).select("word", "n"))
