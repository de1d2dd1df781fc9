"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, langid, licenses, lm, merkle, packing, quality, simhash, sketch, trie, warc, windows
from quillon.llm.shared import WORD, id_remainder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document stands none to three levels below its source, by nested ranges of its id.

    Level and name come from the id's hash, so that files of all levels share directories; every eighth file is
    named as a licence file.
    """
    docs = _read(spark, sf_dir, "documents")
    ranges = F.transform(F.array(*map(F.lit, (10_000, 1000, 100))), lambda n: F.concat(F.lit("r"), F.floor(F.coalesce("doc_id", F.lit(0)) / n).cast("string")))
    level, named = id_remainder("doc_id", 4), F.floor(id_remainder("doc_id", 32) / 4) == 0
    name = F.concat(F.when(named, "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.slice(ranges, F.lit(1), level.cast("int")), name)
    return licenses.scan(docs.withColumn("path", path), "doc_id", "path", "text").withColumnRenamed("key", "doc_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, bpe.token_bytes(spark, vocabulary))
    ids_text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_read(spark, sf_dir, "documents"), keep_text=False)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_read(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "file", "offset", "position", "capture_no", "previous_page_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_report(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_read(spark, sf_dir, "conversations"))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.packed_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_quality_rules": op5_quality_rules,
    "op6_katz": op6_katz,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_chat_format": op10_chat_format,
    "op11_window_packing": op11_window_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}


def _crc32_sql(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal text, bit by bit."""
    octets = f"list_transform(range(1, length({number}::varchar) + 1), lambda i: ascii(substring({number}::varchar, i, 1))::bigint)"
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda a, b: {step}), 4294967295)"


def _whole(number: str, by: int) -> str:
    return f"cast(({number} - {number} % {by}) / {by} as bigint)"


def _tree_sql(name: str, levels: int = 6) -> str:
    """The levels over a table name0 (g, pos, n, d), each with children: a tree of at most 16 to the power of levels leaves a group."""
    one = f"{{name}}{{i}} as (select g, {_whole('pos', 16)} as pos, {_whole('(n + 15)', 16)} as n, list(d order by pos) as kids, sha256(string_agg(d, '' order by pos)) as d from {{name}}{{j}} where n > 1 group by g, {_whole('pos', 16)}, n)"
    tops = " union all ".join(f"select g, d from {name}{i} where n = 1" for i in range(levels + 1))
    return ",\n".join([*[one.format(name=name, i=i, j=i - 1) for i in range(1, levels + 1)], f"{name}_top as ({tops})"])


def _way_sql(name: str, rows: str, out: str, levels: int = 6) -> str:
    """rows (g, pos, ...) with the siblings of each level, from the bottom up."""
    digit = lambda i: f"({_whole('r.pos', 16 ** (i - 1))} % 16)"
    sides = ", ".join(f"{{'l': array_to_string({name}{i}.kids[1:{digit(i)}], ''), 'r': array_to_string({name}{i}.kids[{digit(i)} + 2:], ''), 'k': {name}{i}.kids is not null}}" for i in range(1, levels + 1))
    joins = " ".join(f"left join {name}{i} on {name}{i}.g is not distinct from r.g and {name}{i}.pos = {_whole('r.pos', 16**i)}" for i in range(1, levels + 1))
    return f"{out} as (select r.*, list_filter([{sides}], lambda s: s.k) as way from {rows} r {joins})"


def _leaf_sql(text: str) -> str:
    field = lambda v: f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _fold_sql(start: str) -> str:
    return f"list_reduce(list_concat([{{'l': '', 'r': '', 'k': {start}}}], list_transform(way, lambda s: {{'l': s.l, 'r': s.r, 'k': ''}})), lambda a, s: {{'l': '', 'r': '', 'k': sha256(s.l || a.k || s.r)}}).k"


ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": f"""
with words as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)
), repeated as (
  select distinct doc_id, i + k as p from (select doc_id, i, count(*) over (partition by doc_id, s) as c from windows), (select unnest(range(0, 5)) as k) where c > 1
), lines as (
  select doc_id, count(*) - count(distinct l) as d from (select doc_id, unnest(string_split(text, chr(10))) as l from words) where regexp_matches(l, '{WORD}') group by doc_id
), counts as (
  select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(d, 0) as bigint) as n_dup_lines, cast(coalesce(r, 0) as bigint) as n_repeat_words
  from words left join lines using (doc_id) left join (select doc_id, count(*) as r from repeated group by doc_id) using (doc_id)
), failed as (
  select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from counts
), ruled as (
  select source, unnest([{{'r': 'base_failed', 'x': base_failed}}, {{'r': 'few_words', 'x': n_words < {quality.MIN_WORDS}}},
    {{'r': 'repeats', 'x': 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words}}, {{'r': 'symbols', 'x': 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words}},
    {{'r': 'dup_lines', 'x': 100 * n_dup_lines > {quality.MAX_DUP_LINES_PERCENT} * n_words}}, {{'r': 'long_words', 'x': word_chars > {quality.MAX_WORD_CHARS} * n_words}}]) as t
  from failed where source is not null
), hosts as (
  select t.r as r, source, count(*)::double as n, sum(t.x::int)::double as f from ruled group by t.r, source
), sums as (
  select r, sum(f) / sum(n) as m, sum(n) as n, count(*) as k, sum(f * f / n) as q, sum(n * (n - 1)) as pairs from hosts group by r
), fitted as (
  select r, m, case when m > 0 and m < 1 and n - k - pairs / n > 0 then ((q - n * m * m) / (m * (1 - m)) - (k - 1)) / (n - k - pairs / n) end as rho from sums
), prior as (
  select r, m, case when rho > 0 then least({quality.MAX_STRENGTH}, greatest(1.0, 1 / rho - 1)) else {quality.MAX_STRENGTH} end as s from fitted
), bad as (
  select distinct source from hosts join prior using (r) where (f + m * s) / (hosts.n + s) > {quality.MAX_HOST_RATE}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (source is null or source not in (select source from bad)) as kept
from failed""",
    "op12_prefix_trie": f"""
with t as (select conv_id as c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} as m, turn from conversations where conv_id is not null),
seq as (select c, list(m order by turn nulls first, m.r, m.x) as s, {_crc32_sql('c')} % 6 as h from t group by c),
whole as (select a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) as s from seq a left join seq b on b.c = a.c - a.c % 100),
member as (select c, d, s[1:d] as k, len(s) = d as ends from (select c, s, unnest(range(0, len(s) + 1)) as d from whole)),
node as (select k, d, min(c) as c, count(*) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as e from member group by k, d),
kid as (select k[1:d - 1] as k, count(*) as n from node where d > 0 group by all),
held as (select node.k, d, node.c, node.n, e, coalesce(kid.n, 0) as kids, case when d = 0 then 0 else (node.n - 1) * length(node.k[d].x) end as w from node left join kid on node.k = kid.k),
up as (select k[1:j] as k, sum((kids = 0)::bigint) as leaves, sum(w) as saved from (select *, unnest(range(0, d + 1)) as j from held) group by k[1:j])
select h.c as conv_id, cast(h.d as bigint) as depth, p.c as parent_conv_id, h.n as n_convs, cast(h.kids as bigint) as n_children, cast(up.leaves as bigint) as n_leaves, cast(up.saved as bigint) as saved_tokens, h.e as ends_sha256
from held h join up on h.k = up.k left join node p on h.d > 0 and p.k = h.k[1:h.d - 1]""",
    "op13_merkle_manifest": f"""
with leaf0 as (select source as g, row_number() over (partition by source order by doc_id nulls first, {_leaf_sql('text')}) - 1 as pos, count(*) over (partition by source) as n, {_leaf_sql('text')} as d, doc_id,
  case when {_crc32_sql('doc_id')} % 5 = 0 then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as altered from documents),
{_tree_sql('leaf')},
head0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, d, g as source from leaf_top),
{_tree_sql('head')},
{_way_sql('leaf', 'leaf0', 'low')},
{_way_sql('head', 'head0', 'high')},
whole as (select low.doc_id, low.d as leaf, low.altered, high.d as subroot, head_top.d as root, list_concat(low.way, high.way) as way from low join high on low.g is not distinct from high.source, head_top)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) as proof_sha256, {_fold_sql('coalesce(altered, leaf)')} as folded_root, {_fold_sql('coalesce(altered, leaf)')} = root as verified from whole""",
}
