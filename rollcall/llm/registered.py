"""Registered queries of this subpackage, one per operator, over whole tables, and comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import class_ngrams, fingerprints, html_extraction, lexical_search, license_scan, parity_join, pii, quality_rules, sentencepiece_codec, sharding, source_mix, token_counts, whitening

MODEL = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(_documents(spark, sf_dir)).select(columns)


def op4_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(_documents(spark, sf_dir), words=4, percent=85)


def op5_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(MODEL))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_documents(spark, sf_dir)).drop("findings")


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(_documents(spark, sf_dir), public_tokenizers.path(MODEL))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.report(_documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.score_documents(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    query.__name__: query
    for query in (
        op1_tag_path_ratios, op2_consistent_weighted_sampling, op3_quality_rules, op4_parity_sketch_join, op5_balanced_label_propagation,
        op6_token_counts, op7_license_scan, op8_sentencepiece_codec, op9_source_mix, op10_personal_data,
        op11_chebyshev_whitening, op12_best_position_search, op13_class_ngrams, pipeline,
    )
}


def _rule_sql(rule: quality_rules.Rule) -> str:
    value = f"{rule.measure} / greatest({rule.per}, 1)" if rule.per else rule.measure
    bounds = [f"{value} >= {rule.least}"] * (rule.least is not None) + [f"{value} <= {rule.most}"] * (rule.most is not None)
    return " and ".join(bounds)


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
QUALITY_SQL = rf"""
with texts as (
    select row_number() over () as r, cast(doc_id as bigint) as doc_id, coalesce(text, '') as text from documents
), word_lists as (
    select r, doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines
    from texts
), windows as (
    select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
    from (select r, words, unnest(range(1, len(words) - 1)) as i from word_lists)
), repeated as (
    select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from windows) where n > 1
), covered as (
    select r, count(distinct i + d) as n_repeat_words from repeated, (select unnest([0, 1, 2]) as d) group by r
), counts as (
    select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines,
        len(list_filter(words, lambda x: x in ({_STOP}))) as n_stop_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣◦]\s'))) as n_bullet_lines,
        len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...') or ends_with(rtrim(x, ' '), '…'))) as n_ellipsis_lines
    from word_lists left join covered using (r)
), judged as (
    select *, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words as base_failed from counts
)
select doc_id, cast(n_words as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
    not base_failed and {" and ".join(_rule_sql(rule) for rule in quality_rules.RULES)} as kept
from judged
"""
SEARCH_SQL = r"""
with doc_terms as (
    select r, doc_id, unnest(terms) as term, len(terms) as n from (
        select row_number() over () as r, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents
    )
), item_terms as (
    select q, item_id, term, count(*) as times from (
        select q, item_id, unnest(terms) as term from (
            select row_number() over () as q, item_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
            from benchmark
        )
    ) group by all
), totals as (
    select count(distinct r) as big_n, count(*) as big_l from doc_terms
), held as (
    select r, doc_id, n, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by all
), weights as (
    select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from held, totals group by term, big_n
), impacts as (
    select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))) as impact
    from held join weights using (term), totals
), scored as (
    select q, item_id, r, doc_id, sum(times * impact) as score from impacts join item_terms using (term) group by all
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0)
where rank <= 10
"""
SQL = {"op3_quality_rules": QUALITY_SQL, "op12_best_position_search": SEARCH_SQL}
