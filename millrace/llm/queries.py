"""The queries ``op1_`` to ``op10_`` and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, classlm, exact, jaccard, langid, packing, pii, spm, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer())


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_texts(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return spm.encode_documents(_table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {
        # plain self-join on shingles: for tables of some thousands of documents
        "op4_jaccard_join": r"""
            with recursive t as (
                select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
            s as (
                select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from t),
            n as (select doc_id, count(*) as n from s group by doc_id),
            pairs as (select a.doc_id as u, b.doc_id as v, count(*) as both_have from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
            links as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * both_have >= 90 * (x.n + y.n - both_have)),
            edges as (select u, v from links union all select v, u from links),
            reach as (select doc_id as node, doc_id as seen from documents union select r.node, e.v from reach r join edges e on r.seen = e.u),
            least as (select node, min(seen) as component_id from reach group by node)
            select t.doc_id, coalesce(n.n, 0) as n_shingles, component_id from t left join n on t.doc_id = n.doc_id join least on t.doc_id = node
        """,
        "op7_warc": """
            with t as (select page_id, coalesce(html, '') as body from pages),
            s as (select page_id, body, octet_length(encode(body)) as n from t),
            g as (select body, max(page_id) as keep from s where n >= 1000 group by body)
            select s.page_id, s.n as payload_bytes, sha1(s.body) as payload_digest,
                   case when g.keep is null or g.keep = s.page_id then 'response' else 'revisit' end as record_type,
                   case when g.keep <> s.page_id then g.keep end as refers_to
            from s left join g on s.body = g.body and s.n >= 1000
        """,
        "op8_exact_dedup": """
            with t as (select doc_id, coalesce(text, '') as body from documents),
            g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
            select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size,
                   t.doc_id is not distinct from g.keep_id as kept, sha256(t.body) as text_sha256
            from t join g on t.body = g.body
        """,
    }
