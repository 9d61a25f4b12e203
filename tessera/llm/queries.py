"""Queries of the corpus operators and their DuckDB SQL."""

import corpus_pipeline

from . import chat, embeddings, jaccard, language, mixing, packing, quality, repair, sentencepieces, spelling, sql, token_files, toxicity, urls

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_neardup": embeddings.op5_embedding_neardup,
    "op6_language_id": language.op6_language_id,
    "op7_token_files": token_files.op7_token_files,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filters": urls.op9_url_filters,
    "op10_mixing": mixing.op10_mixing,
    "op11_sentencepiece": sentencepieces.op11_sentencepiece,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_ngram_jaccard": sql.JACCARD,
    "op2_chat_formatting": sql.CHAT,
    "op3_quality_rules": sql.QUALITY,
    "op5_embedding_neardup": sql.EMBEDDINGS,
    "op12_conversation_repair": sql.REPAIR,
    "op13_spelling_variants": sql.SPELLING,
}
