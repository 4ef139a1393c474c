"""Queries of the operators in this folder, and SQL for those that SQL can express."""

from . import bpe, embedding_dups, mixing, ngram_join, quality, sharding, token_counts, token_files, url_filter, warc

QUERIES = {
    "op1_kd_shards": sharding.query,
    "op2_token_files": token_files.query,
    "op3_warc": warc.query,
    "op4_quality_rules": quality.query,
    "op5_embedding_dups": embedding_dups.query,
    "op6_bpe": bpe.query,
    "op7_token_counts": token_counts.query,
    "op8_temperature_mixing": mixing.query,
    "op9_url_filters": url_filter.query,
    "op10_ngram_join": ngram_join.query,
}
ORACLES = {
    "op3_warc": warc.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op5_embedding_dups": embedding_dups.ORACLE,
    "op9_url_filters": url_filter.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
