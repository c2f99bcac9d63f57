"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from docsnap.llm import chat, decontaminate, dialogues, embeddings, language, lexical, mixing
from docsnap.llm import ngram_join, personal, quality, records, substrings, subtrees
from docsnap.llm.common import table


def op1_language(spark, folder):
    return language.predicted_languages(table(spark, folder, "documents"))


def op2_mixing(spark, folder):
    return mixing.mixed_words(table(spark, folder, "documents"))


def op3_suffix_dedup(spark, folder):
    return substrings.without_repeats(table(spark, folder, "documents"))


def op4_personal_data(spark, folder):
    return personal.personal_data(table(spark, folder, "documents"))


def op5_decontaminate(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_quality(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_chat_format(spark, folder):
    return chat.conversation_digests(table(spark, folder, "conversations"))


def op8_ngram_join(spark, folder):
    return ngram_join.ngram_links(table(spark, folder, "documents"))


def op9_embeddings(spark, folder):
    return embeddings.vector_links(table(spark, folder, "embeddings"))


def op10_token_records(spark, folder):
    return records.token_records(table(spark, folder, "documents"))


def op11_lexical_search(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_substring_dedup(spark, folder):
    return subtrees.without_earlier(table(spark, folder, "documents"))


def op13_conversation_trie(spark, folder):
    return dialogues.conversation_trie(table(spark, folder, "conversations"))


QUERIES = (
    op1_language,
    op2_mixing,
    op3_suffix_dedup,
    op4_personal_data,
    op5_decontaminate,
    op6_quality,
    op7_chat_format,
    op8_ngram_join,
    op9_embeddings,
    op10_token_records,
    op11_lexical_search,
    op12_substring_dedup,
    op13_conversation_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.SQL,
        "op7_chat_format": chat.SQL,
        "op8_ngram_join": ngram_join.SQL,
        "op11_lexical_search": lexical.SQL,
        "op12_substring_dedup": subtrees.SQL,
        "op13_conversation_trie": dialogues.SQL,
    }
