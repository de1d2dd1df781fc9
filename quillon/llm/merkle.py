"""Merkle manifest of a table: a content-addressed DAG over its rows, and inclusion proofs by descent from its root.

H is the lower-case hexadecimal SHA-256 of its inputs strung together, digests being taken as hexadecimal text. Of
each source the leaves in order of doc_id, sixteen at a time, become their H, level by level, until one node is left,
the source's subroot; a lone leaf is that itself. The subroots in order of source, null first, likewise give the root.

The DAG is stored as records (digest, children), each digest once, whatever the number of places that its content
has. A proof is found by descent: a request goes from the root to the child that the next digit of its rank in base
sixteen names, and takes the other children along; in the end its path is read backwards. Requests whose leaves share
digits have the same path so far and travel as one row down to the runs of sixteen leaves, so a level has one request
a node and the root has one, not one a leaf.

Rows of a source are placed by range partitions and grouped by sixteen, so a source of any size is spread over tasks.
Nulls are leaves' fields of their own kind (`-`); a null doc_id comes first, has no decimal form and is never
tampered with. Rows with the same doc_id follow one another in order of their leaves, so repeated rows are leaves of
equal digest, each with its own place and proof. Empty texts have zero bytes; very long ones are hashed in one go and
must fit a task. An empty table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.ranks import ranked
from quillon.llm.shared import materialise

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"
#: Rows are tampered with where this divides the checksum of their id.
TAMPER = 5


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """H of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]))


def tampered(text: Column, doc_id: Column, divisor: int = TAMPER) -> Column:
    """The text with A-Z in lower case where divisor divides the unsigned CRC-32 of the decimal doc_id; null otherwise."""
    return F.when(F.crc32(doc_id.cast("string")) % divisor == 0, F.translate(text, UPPER, LOWER))


def levels(nodes: DataFrame, name: str, fan_out: int = FAN_OUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (group, at, n, digest), each with children, and the last node of each group with its height.

    at runs from 0 to n - 1 in each group. A group that has come down to one node goes no further.
    """
    found, below = [], nodes
    tops = nodes.filter("n = 1").select("group", "digest", F.lit(0).alias("height"))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        kids = F.sort_array(F.collect_list(F.struct("at", "digest")))  # at most fan_out of them
        runs = below.filter("n > 1").groupBy("group", F.floor(F.col("at") / fan_out).cast("long").alias("run")).agg(F.max("n").alias("n"), kids.alias("kids"))
        level = runs.select("group", F.col("run").alias("at"), F.ceil(F.col("n") / fan_out).cast("long").alias("n"), F.transform("kids", lambda k: k["digest"]).alias("children"))
        below = materialise(level.withColumn("digest", digest(F.array_join("children", ""))), f"{name}-level")
        found.append(below)
        tops = tops.unionByName(below.filter("n = 1").select("group", "digest", F.lit(len(found)).alias("height")))
        largest = -(-largest // fan_out)
    return found, tops


def records(above: list[DataFrame]) -> DataFrame | None:
    """(digest, children): what is stored, each digest once."""
    parts = [level.select("digest", "children") for level in above]
    return materialise(reduce(DataFrame.unionByName, parts).dropDuplicates(["digest"]), "records") if parts else None


def _siblings(kids: str, digit: Column) -> Column:
    """The digests to the left and to the right of a child."""
    return F.struct(F.array_join(F.slice(kids, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(kids, digit + 2, F.size(kids)), "").alias("right"))


def descend(requests: DataFrame, stored: DataFrame | None, height: int, stop: int) -> DataFrame:
    """requests (height, at, digest, path, ...) followed down from their tops to the nodes of level stop, or their own if that is lower.

    path has, from the top on, what stands to the left and to the right of the way at each level; at is the node's
    place on its level, whose digits in base sixteen are the way. A request of a lower tree waits.
    """
    others = [c for c in requests.columns if c not in ("height", "at", "digest", "path")]
    for level in range(height, stop, -1):
        opened = requests.filter(F.col("height") == level).join(stored, "digest").select(*others, "at", "path", "children", F.posexplode("children").alias("digit", "child"))
        place = (F.col("at") * FAN_OUT + F.col("digit")).alias("at")
        went = opened.select(*others, F.lit(level - 1).alias("height"), place, F.col("child").alias("digest"), F.concat("path", F.array(_siblings("children", F.col("digit")))).alias("path"))
        requests = materialise(requests.filter(F.col("height") < level).unionByName(went), "requests")
    return requests


def folded(start: Column, path: Column) -> Column:
    """The root that start has by a path, from its bottom up."""
    return F.aggregate(F.reverse(path), start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs (FIELDS).

    folded_root is computed from the tampered leaf, where tampered() gives one, and the original siblings.
    """
    own = [F.col(f) for f in FIELDS]
    changed = tampered(F.col("text"), F.col("doc_id"))
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, leaf(*own[:-1], changed))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("group"), leaf(*own).alias("digest"), altered.alias("altered"))
    leaves = materialise(ranked(hashed, ["group"], ["doc_id", "digest"], "leaves"), "placed")
    above, tops = levels(leaves, "leaf")
    # sources have places too, as one group: there may be as many as rows
    subroots = tops.select(F.lit("").alias("group"), F.col("group").alias("source"), "digest", F.col("height").alias("source_height"))
    heads = materialise(ranked(subroots, ["group"], ["source"], "sources"), "subroots")
    over, root = levels(heads, "source")
    stored = records(above + over)

    way = F.array().cast(PATH).alias("path")
    asked = root.select("height", F.lit(0).cast("long").alias("at"), "digest", F.col("digest").alias("root"), way)  # one row, or none
    reached = descend(asked, stored, len(over), 0).select("at", "root", "path")
    asked = heads.join(reached, "at").select(F.col("source_height").alias("height"), F.lit(0).cast("long").alias("at"), "digest", "path", F.col("source").alias("of"), F.col("digest").alias("subroot"), "root")
    runs = descend(asked, stored, len(above), 1)
    # the last step is taken a run at a time, its siblings told apart beside the leaves
    if stored is None:
        runs = runs.withColumn("children", F.lit(None).cast("array<string>"))
    else:
        runs = runs.join(stored.withColumn("height", F.lit(1)), ["digest", "height"], "left")
    ways = runs.select("of", F.col("at").alias("run"), "path", "children", "subroot", "root")
    joined = leaves.join(ways, F.col("group").eqNullSafe(F.col("of")) & (F.floor(F.col("at") / FAN_OUT) == F.col("run")))
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_siblings("children", (F.col("at") % FAN_OUT).cast("int")))))
    followed = joined.select("doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", whole.alias("path"))
    proof = F.array_join(F.transform(F.reverse("path"), lambda s: F.concat(s["left"], s["right"])), "")
    rows = followed.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
