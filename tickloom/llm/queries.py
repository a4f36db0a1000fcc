"""One query for each operator of this subpackage, over its whole table, and SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, fingerprint, katz, license_scan, line_dedup, mixing, ngram_join, packing, quality, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/thousand/hundred/doc_id; those without a source lie in a directory of their own."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("(none)")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"), "doc_id")
    return license_scan.scan(_table(spark, sf_dir, "documents").withColumn("path", path))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("p_good")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_line_dedup, op2_ngram_join, op3_license_scan, op4_warc, op5_katz, op6_packing, op7_mixing, op8_token_counts, op9_fingerprints, op10_quality_rules)}
ORACLES: dict[str, str] = {
    "op2_ngram_join": """
        with recursive words as (
            select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents), sets as (
            select rid, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words), held as (
            select rid, len(s) as n, unnest(s) as shingle from sets), links as (
            select a.rid as x, b.rid as y from held a join held b on a.shingle = b.shingle and a.rid <> b.rid where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))), reached as (
            select rid, rid as other from sets union select r.rid, l.y from reached r join links l on l.x = r.other)
        select s.doc_id, len(s.s) as n_shingles, min(o.doc_id) as component_id from sets s join reached r on r.rid = s.rid join sets o on o.rid = r.other group by s.rid, s.doc_id, len(s.s)""",
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
             q as (select page_id, strlen(h) as n, sha1(h) as d, max(page_id) over (partition by h) as m from p)
        select page_id, n as payload_bytes, d as payload_digest,
               case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> m then m end as refers_to
        from q""",
}
