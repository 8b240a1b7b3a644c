"""One registered query for each training-data operator, and for the pipeline of five of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import articles, chat, decontamination, embeddings, language, licenses, near_duplicates, packing, prefixes, scoring, secrets, spelling, urls

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents"), tokenizer_path()),
        "op2_minhash_near_dedup": lambda s, d: near_duplicates.near_duplicates(table(s, d, "documents")),
        "op3_secret_scan": lambda s, d: secrets.digest(secrets.find_secrets(table(s, d, "documents"))),
        "op4_embedding_near_dedup": lambda s, d: embeddings.near_duplicate_vectors(table(s, d, "embeddings")),
        "op5_lm_scoring": lambda s, d: scoring.score(table(s, d, "documents")),
        "op6_benchmark_decontamination": lambda s, d: decontamination.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_license_scan": lambda s, d: licenses.scan_licenses(table(s, d, "documents")),
        "op8_language_id": lambda s, d: language.identify(table(s, d, "documents")),
        "op9_url_filter": lambda s, d: urls.judge_urls(table(s, d, "pages")),
        "op10_chat_formatting": lambda s, d: chat.rotate(table(s, d, "conversations")),
        "op11_conversation_prefixes": lambda s, d: prefixes.prefix_trie(table(s, d, "conversations")),
        "op12_html_extraction": lambda s, d: articles.extract_articles(table(s, d, "pages")),
        "op13_spelling_variants": lambda s, d: spelling.spelling_variants(table(s, d, "documents")),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": decontamination.CONTAMINATED_SQL, "op10_chat_formatting": chat.ROTATE_SQL, "op11_conversation_prefixes": prefixes.PREFIX_SQL, "op13_spelling_variants": spelling.SPELLING_SQL}
