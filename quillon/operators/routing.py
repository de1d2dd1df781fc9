"""Routes of questions to chunks by company, year and period.

Questions that ask for the same company, year and period share a route, and chunks with the same names, year and
period a group; routes meet groups, so what is joined grows with neither the questions nor the chunks of a document.
A company meets every group one of whose names contains it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scratch import stored
from quillon.functions.text import normalize_text
from quillon.operators.metadata import period_matches

#: Characters of the grams by which names are found.
GRAM = 2


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name) of names (name) that contain needles (needle); both distinct, none empty.

    A needle looks names up by the one of its grams that the fewest names have, and what is found is compared. Needles
    shorter than a gram are looked up by their characters.
    """
    out = None
    for n, own in ((GRAM, needles.filter(F.char_length("needle") >= GRAM)), (1, needles.filter(F.char_length("needle").between(1, GRAM - 1)))):
        held = names.filter(F.char_length("name") >= n).select("name", F.explode(_grams(F.col("name"), n)).alias("gram"))
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        asked = own.select("needle", F.explode(_grams(F.col("needle"), n)).alias("gram")).join(counts, "gram", "left")
        # a gram that no name has rules its needle out
        rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0")
        found = rarest.select("needle", "g.gram").join(held, "gram").filter(F.contains("name", F.col("needle"))).select("needle", "name")
        out = found if out is None else out.unionByName(found)
    return out


@dataclass
class Routes:
    #: (qid, route), (route, group, level), (route) that search all chunks, and (key, doc, group) of all chunks.
    asked: DataFrame
    found: DataFrame
    whole: DataFrame
    placed: DataFrame

    def candidates(self) -> DataFrame:
        """(route, key, doc) of the routes that do not search all chunks."""
        return self.found.join(self.placed, "group").select("route", "key", "doc")

    def counts(self) -> DataFrame:
        """(qid, chunks, docs, level): how many candidates each question has; level 2 for those that search all."""
        size = [F.count("*").alias("chunks"), F.count_distinct("doc").alias("docs")]
        by_route = self.found.join(self.placed, "group").groupBy("route").agg(*size, F.min("level").alias("level"))
        every = self.placed.agg(*size).withColumn("level", F.lit(2))  # one row
        return self.asked.join(by_route.unionByName(self.whole.join(F.broadcast(every)).select("route", "chunks", "docs", "level")), "route").drop("route")


def _digest(*values: Column) -> Column:
    return F.md5(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])).cast("binary"))


def routes(asked: DataFrame, chunks: DataFrame, fallback: bool = True) -> Routes:
    """Routes of questions (qid, company_short, year, period) among chunks (key, companies, year, period and, if they have it, doc).

    companies are the names that a chunk goes by: of its company, document and file. Level 0 are the groups of the
    question's company, year and period, a group without a period passing; level 1 those of any period where there are
    none. A question that asks for nothing searches all chunks, and with fallback so does one that finds none. What
    the routes are made of is written once, as searches read it several times.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce("companies", F.array().cast("array<string>")), normalize_text)))
    doc = F.col("doc") if "doc" in chunks.columns else F.col("key")
    sides = chunks.select("key", doc.alias("doc"), names.alias("names"), text("year").alias("c_year"), text("period").alias("c_period"))
    sides = stored(sides.withColumn("group", _digest(F.col("names"), F.col("c_year"), F.col("c_period"))), "placed")
    groups = sides.groupBy("group").agg(F.first("names").alias("names"), F.first("c_year").alias("c_year"), F.first("c_period").alias("c_period"))
    wanted = asked.select("qid", normalize_text(F.col("company_short")).alias("company"), text("year").alias("year"), text("period").alias("period"))
    wanted = stored(wanted.withColumn("route", _digest(F.col("company"), F.col("year"), F.col("period"))), "routes")
    filters = wanted.select("route", "company", "year", "period").distinct()

    spelt = groups.select("group", "c_year", "c_period", F.explode("names").alias("name")).filter("name <> ''")
    named = filters.filter("company <> ''")
    pairs = containing(named.select(F.col("company").alias("needle")).distinct(), spelt.select("name").distinct())
    hits = named.join(pairs, F.col("company") == F.col("needle")).join(spelt, "name").filter("year = '' or year = c_year")
    hits = hits.select("route", "group", "c_period", "period").distinct()
    # without a company the classes of year and period decide: by equal years, or by equal or no periods
    classes = groups.select("group", "c_year", "c_period")
    rest = filters.filter("company = '' and (year <> '' or period <> '')").select("route", "year", "period")
    dated = rest.filter("year <> ''").join(classes, F.col("year") == F.col("c_year")).select("route", "group", "c_period", "period")
    undated = rest.filter("year = ''").select("route", "period", F.explode(F.array("period", F.lit(""))).alias("passes"))
    undated = undated.join(classes, F.col("passes") == F.col("c_period")).select("route", "group", "c_period", "period")
    hits = hits.unionByName(dated).unionByName(undated)
    hits = stored(hits.select("route", "group", F.when(period_matches(F.col("c_period"), F.col("period")), 0).otherwise(1).alias("level")), "routed")
    best = hits.groupBy("route").agg(F.min("level").alias("best"))
    found = hits.join(best, "route").filter("level = best").drop("best")
    whole = filters if fallback else filters.filter("company = '' and year = '' and period = ''")
    return Routes(wanted.select("qid", "route"), found, whole.select("route").join(best, "route", "left_anti"), sides.select("key", "doc", "group"))
