"""Quality rules: per-document counts, then host verdicts from shrunken failure rates. SQL functions only.

Null texts have no words and fail. A null host belongs to no host: its documents are judged alone. Repeated rows
count as often as they occur; an empty table gives an empty result. with_counts() and judged() replace columns of
docs that are called like theirs; keep_good() returns the columns of docs as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import WORD, broadcast_if_small, materialise

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Further rules by which hosts are judged: symbols and repeated lines by words, mean length of words.
MAX_SYMBOL_PERCENT, MAX_DUP_LINES_PERCENT, MAX_WORD_CHARS = 50, 20, 40
#: A host goes where its shrunken failure rate of a rule is above this.
MAX_HOST_RATE = 0.5
#: The greatest strength of a prior.
MAX_STRENGTH = 1e6
#: Hosts that go are few; up to so many are broadcast, more are joined by shuffle.
BROADCAST_HOSTS = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more; windows are compared by their XXH64 chain."""
    n = F.size(words)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW_WORDS)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = _let(ordered, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return _let(
            places,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW_WORDS).alias("last")),
                lambda acc, i: F.struct((acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW_WORDS))).alias("sum"), i.alias("last")),
                lambda acc: acc["sum"],
            ),
        )

    several = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n >= WINDOW_WORDS, several).otherwise(0)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with COUNTS, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counts = _let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    out = docs.withColumn("__counts", counts)
    out = out.withColumns({k: F.col(f"__counts.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}).drop("__counts")
    return out.withColumns({
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })


def rules() -> dict[str, Column]:
    """Whether a document breaks each rule, by its counts. The first two are the base rules; the others only count against its host."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * n,
        "long_words": F.col("word_chars") > MAX_WORD_CHARS * n,
    }


def base_failed() -> Column:
    return rules()["few_words"] | rules()["repeats"]


def prior(hosts: DataFrame, failed: str) -> tuple[float, float]:
    """Mean m and strength s of a beta prior, by the moments of beta-binomial counts of `failed` among n a host.

    The spread of the hosts' rates f/n about the mean m = sum f / sum n, weighted by n, has the expected value
    m(1-m) ((K-1) + rho (N - K - sum n(n-1)/N)) for K hosts and N documents; that gives rho = 1 / (s+1), from which
    the spread that counts have by chance is taken off. s is kept within 1 and 1e6; where the counts say nothing
    (hosts of one document, or all alike) it is 1e6, so that every host gets the mean.
    """
    f, n = F.col(failed), F.col("n")
    r = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(f * f / n).alias("q"), F.sum(n.cast("double") * (n - 1)).alias("pairs")).first()
    if not r.n:
        return 0.0, MAX_STRENGTH
    m = r.f / r.n
    room = r.n - r.k - r.pairs / r.n
    if not 0 < m < 1 or room <= 0:
        return m, MAX_STRENGTH
    rho = ((r.q - r.n * m * m) / (m * (1 - m)) - (r.k - 1)) / room
    return m, MAX_STRENGTH if rho <= 0 else min(MAX_STRENGTH, max(1.0, 1 / rho - 1))


def host_rates(scored: DataFrame, host_col: str) -> DataFrame:
    """(host, n, and for base_failed and each rule the failures and rate_<rule>): rates are posterior means under a beta prior fitted to all hosts.

    The driver gets the sums over hosts by which the priors are fitted.
    """
    judged_by = {"base_failed": F.col("base_failed"), **rules()}
    counted = scored.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
    hosts = materialise(counted.agg(F.count("*").alias("n"), *[F.count_if(test).alias(name) for name, test in judged_by.items()]), "hosts")
    out = hosts
    for name in judged_by:
        m, s = prior(hosts, name)
        out = out.withColumn(f"rate_{name}", (F.col(name) + F.lit(m * s)) / (F.col("n") + F.lit(s)))
    return out


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep_text: bool = True, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs with COUNTS, base_failed and kept: false too where the host's rate of any rule is above max_host_rate. The counts are made once and written with what is kept of docs."""
    scored = with_counts(docs, text_col).withColumn("base_failed", base_failed())
    scored = materialise(scored if keep_text else scored.drop(text_col), "quality")
    rates = host_rates(scored, host_col)
    over = F.greatest(*[F.col(c) for c in rates.columns if c.startswith("rate_")]) > max_host_rate
    bad = materialise(rates.filter(over).select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "bad-hosts")
    joined = scored.join(broadcast_if_small(bad, BROADCAST_HOSTS), F.col(host_col) == F.col("__host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(own, F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return judged(rows, "host", keep_text=False).filter("kept").select("doc.*")
