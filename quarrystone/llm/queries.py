"""The queries ``opN_<name>`` over the tables of a folder, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, linededup, media, merkle, mixing, neardup, packing, pitmanyor, quality, simhash, spelling, substring, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_repeated_lines(docs)
    return out.select("doc_id", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return pitmanyor.score(table(spark, sf_dir, "documents"), held_out)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after three edits: words replaced, characters deleted, words inserted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    part = lambda k: F.floor(n * k / 4).cast("int")
    edit = lambda start, length, text: F.struct(start.alias("start"), (start + length).cast("int").alias("end"), text.alias("text"))
    edits = F.array(
        edit(part(1), 24, F.coalesce(F.substring("text", 1, 30), F.lit(""))),
        edit(part(2), 11, F.lit("")),
        edit(part(3), 0, F.lit(" and 3 more words, here")),
    )
    return tokencount.count_tokens(docs.withColumn("edits", edits.cast(tokencount.EDIT_TYPE))).drop("text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_quality_classifier, op3_substring_dedup, op4_pitman_yor_scoring, op5_media_columns, op6_source_mixing, op7_minhash_near_dedup,
        op8_line_dedup, op9_imatch_fingerprints, op10_edited_token_counts, op11_spelling_variants, op12_merkle_manifest, op13_simhash_near_dedup,
    )
}

OP8_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents
), kept as (
    select doc_id, i, trim(line, concat(' ', chr(9), chr(13))) as l, row_number() over (partition by doc_id order by i) as k
    from lines where trim(line, concat(' ', chr(9), chr(13))) <> ''
), windows as (
    select * from (
        select doc_id, k, l, lead(l, 1) over w as l1, lead(l, 2) over w as l2 from kept window w as (partition by doc_id order by k)
    ) where l2 is not null
), later as (
    select doc_id, k from (select doc_id, k, row_number() over (partition by l, l1, l2 order by doc_id, k) as n from windows) where n > 1
), gone as (
    select distinct kept.doc_id, kept.i from kept join (select distinct doc_id, k + j as k from later, range(3) t(j)) c on kept.doc_id = c.doc_id and kept.k = c.k
), rest as (
    select lines.doc_id, string_agg(line, chr(10) order by lines.i) filter (where gone.i is null) as t, count(gone.i) as n
    from lines left join gone on lines.doc_id = gone.doc_id and lines.i = gone.i group by lines.doc_id
)
select d.doc_id, coalesce(n, 0) as n_removed, sha256(case when d.text is null then null else coalesce(t, '') end) as kept_sha256
from documents d left join rest on d.doc_id = rest.doc_id
"""

#: crc32 of a list of bytes, bit by bit, as SQL has no such function.
CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], {}), lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda x, b: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
LOWERED = f"translate({{}}, '{merkle.UPPER}', '{merkle.LOWER}')"

OP11_SQL = f"""
with recursive runs as (
    select doc_id, {LOWERED.format("run")} as w, count(*) as c
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as run from documents) where length(run) >= 6 group by all
), hashed as (
    select w, c, {CRC32.format("flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] end))")} as h from runs
), counted as (
    select word, cast(sum(c) as bigint) as n from (
        select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from hashed
    ) where length(word) >= 6 group by word having sum(c) >= 5
), cut as (
    select word, n, i, left(word, i) || substr(word, i + 2) as d from (select word, n, unnest(range(length(word))) as i from counted)
), near as (
    select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.d = b.d and a.word <> b.word
    union select a.word, a.n, b.word, b.n from counted a join cut b on a.word = b.d
    union select b.word, b.n, a.word, a.n from counted a join cut b on a.word = b.d
), best as (
    select word, n, count(*) as n_near, first(other order by other_n desc, encode(other)) as form, max(other_n) as form_n from near group by all
), taken as (
    select word, n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from best
), walk as (
    select word, word as here, 0 as depth from counted union all select walk.word, form, depth + 1 from walk join taken on here = taken.word where form is not null
)
select word, form, root, n, coalesce(n_near, 0) as n_near, form_n
from counted left join taken using (word) join (select word, arg_max(here, depth) as root from walk group by word) using (word)
"""


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(cast({c} as varchar)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _up_sql(key: str) -> str:
    return f"select {key}, lvl + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], '')))"


OP12_SQL = f"""
with recursive leaves as (
    select doc_id, lang, {_leaf_sql("text")} as leaf, {_leaf_sql(LOWERED.format("text"))} as low,
        {CRC32.format("list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ord(x)::bigint)")} % 3 = 0 as tampered from documents
), placed as (
    select *, row_number() over () as id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves
), up as (
    select lang, 0 as lvl, list(leaf order by pos) as nodes from placed group by lang
    union all {_up_sql("lang")} from up where len(nodes) > 1
), subroots as (
    select lang, nodes[1] as subroot, row_number() over (order by encode(lang) nulls first) - 1 as lang_pos from up where len(nodes) = 1
), high as (
    select 0 as one, 0 as lvl, list(subroot order by lang_pos) as nodes from subroots having count(*) > 0
    union all {_up_sql("one")} from high where len(nodes) > 1
), spots as (
    select id, lvl, pos // cast(pow(8, lvl) as bigint) as p, nodes from placed join up on placed.lang is not distinct from up.lang where len(nodes) > 1
    union all select id, 100 + lvl, lang_pos // cast(pow(8, lvl) as bigint), nodes
    from placed join subroots on placed.lang is not distinct from subroots.lang, high where len(nodes) > 1
), paths as (
    select id, list([array_to_string(nodes[p // 8 * 8 + 1 : p], ''), array_to_string(nodes[p + 2 : p // 8 * 8 + 8], '')] order by lvl) as path from spots group by id
), folded as (
    select doc_id, leaf, subroot, (select nodes[1] from high where len(nodes) = 1) as root, sha256(array_to_string(flatten(coalesce(path, [])), '')) as proof_sha256,
        list_reduce(list_concat([[case when tampered then low else leaf end]], coalesce(path, [])), lambda acc, p: [sha256(concat(p[1], acc[1], p[2]))])[1] as folded_root
    from placed join subroots on placed.lang is not distinct from subroots.lang left join paths using (id)
)
select *, folded_root = root as verified from folded
"""

ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
