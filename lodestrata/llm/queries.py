"""The registered queries opN_* of this subpackage, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mix import mix_sources
from .ngram_join import ngram_join
from .quality import quality_scores
from .shard import shuffle_to_shards, utf8_size
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_digests, write_tokens


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha(c) -> F.Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir), keep="largest")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(spark, write_tokens(_read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir))


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle_to_shards(_read(spark, sf_dir).select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_read(spark, sf_dir), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_mix_sources, op4_ngram_join, op5_line_dedup, op6_token_files, op7_substring_dedup, op8_shuffle_shards, op9_decontaminate, op10_quality)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op5_line_dedup": """
        with l as (
            select doc_id, i, lines[i] as line,
                   translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents) d, unnest(range(1, len(lines) + 1)) as u(i)),
        k as (select key, min(doc_id) as owner from l where length(key) >= 10 group by key having count(distinct doc_id) > 1),
        m as (select l.*, k.owner is not null and k.owner <> l.doc_id as gone from l left join k using (key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op9_decontaminate": f"""
        with b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
        bw as (select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as span
               from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) as u(i) where len(w) > 0),
        d as (select doc_id, {_WORDS} as w from documents),
        ns as (select distinct n from bw),
        dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as span from d, ns, unnest(range(1, len(w) - n + 2)) as u(i) where len(w) >= n),
        m as (select doc_id, i, n, item from dw join bw using (n, span)),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by doc_id),
        t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join h using (doc_id) left join t using (doc_id)""",
}
