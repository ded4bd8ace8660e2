"""Queries over the whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from tickerloom.llm import oracles
from tickerloom.llm.gam import quality
from tickerloom.llm.lempel import remove_repeated_words
from tickerloom.llm.merkle import manifest
from tickerloom.llm.minhash import Settings, near_duplicates
from tickerloom.llm.mixing import mix
from tickerloom.llm.packing import pack_documents
from tickerloom.llm.phrases import collocations
from tickerloom.llm.pii import detect
from tickerloom.llm.rules import judge
from tickerloom.llm.simhash import fingerprint_edits
from tickerloom.llm.sources import table, tokenizer_path
from tickerloom.llm.suffixes import remove_repeats
from tickerloom.llm.token_output import packed_ids
from tickerloom.llm.urls import filter_urls

TOKENIZER = "word_bpe_49k.json"

QUERIES = {
    "op1_near_duplicates": lambda spark, folder: near_duplicates(table(spark, folder, "documents"), Settings(percent=85)),
    "op2_repeated_passages": lambda spark, folder: remove_repeats(table(spark, folder, "documents")),
    "op3_quality": lambda spark, folder: quality(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op4_packing": lambda spark, folder: pack_documents(table(spark, folder, "documents"), tokenizer_path(TOKENIZER), 4096),
    "op5_url_filter": lambda spark, folder: filter_urls(table(spark, folder, "pages")),
    "op6_host_rules": lambda spark, folder: judge(table(spark, folder, "documents")),
    "op7_token_matrices": lambda spark, folder: packed_ids(table(spark, folder, "documents"), tokenizer_path(TOKENIZER), 4096),
    "op8_fingerprints": lambda spark, folder: fingerprint_edits(table(spark, folder, "documents")),
    "op9_mixing": lambda spark, folder: mix(table(spark, folder, "documents")),
    "op10_personal_data": lambda spark, folder: detect(table(spark, folder, "documents")),
    "op11_merkle_manifest": lambda spark, folder: manifest(table(spark, folder, "documents")),
    "op12_repeated_words": lambda spark, folder: remove_repeated_words(table(spark, folder, "documents")),
    "op13_collocations": lambda spark, folder: collocations(table(spark, folder, "documents")),
}

CHECKS = {
    "op1_near_duplicates": oracles.NEAR_DUPLICATES,
    "op2_repeated_passages": oracles.REPEATS,
    "op6_host_rules": oracles.HOST_RULES,
    "op9_mixing": oracles.MIXING,
    "op11_merkle_manifest": oracles.MANIFEST,
    "op12_repeated_words": oracles.REPEATED_WORDS,
    "op13_collocations": oracles.COLLOCATIONS,
}
