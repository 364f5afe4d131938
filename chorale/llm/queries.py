"""The registered queries of this package: one thin query per operator, over its whole table."""

from __future__ import annotations

from . import convrepair, langid, lmscore, mixing, neardup, packing, pieces, quality, sharding, spelling, tokencount, topk, urls
from .common import table


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_sharding": lambda spark, sf: sharding.shard_digest(table(spark, sf, "documents")),
        "op2_lm_scoring": lambda spark, sf: lmscore.score_documents(table(spark, sf, "documents")),
        "op3_quality_rules": lambda spark, sf: quality.quality_digest(table(spark, sf, "documents")),
        "op4_ngram_jaccard_join": lambda spark, sf: neardup.neardup_digest(table(spark, sf, "documents")),
        "op5_packing": lambda spark, sf: packing.pack(table(spark, sf, "documents")),
        "op6_url_filters": lambda spark, sf: urls.url_digest(table(spark, sf, "pages")),
        "op7_language_id": lambda spark, sf: langid.lang_digest(table(spark, sf, "documents")),
        "op8_exact_top_k": lambda spark, sf: topk.top_k(table(spark, sf, "embeddings")),
        "op9_token_counts": lambda spark, sf: tokencount.token_digest(table(spark, sf, "documents")),
        "op10_mixing": lambda spark, sf: mixing.mix_digest(table(spark, sf, "documents")),
        "op11_spelling_variants": lambda spark, sf: spelling.variant_digest(table(spark, sf, "documents")),
        "op12_conversation_repair": lambda spark, sf: convrepair.repair_digest(table(spark, sf, "conversations")),
        "op13_sentencepiece": lambda spark, sf: pieces.piece_digest(table(spark, sf, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.SHARDS_SQL, "op3_quality_rules": quality.QUALITY_SQL, "op4_ngram_jaccard_join": neardup.COMPONENTS_SQL, "op6_url_filters": urls.URLS_SQL, "op8_exact_top_k": topk.TOPK_SQL, "op10_mixing": mixing.MIX_SQL, "op11_spelling_variants": spelling.VARIANTS_SQL, "op12_conversation_repair": convrepair.REPAIR_SQL}
