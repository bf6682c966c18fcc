"""The registered queries of the operators and the SQL they are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from viewforge.llm import lexical, lines, prefix_trie
from viewforge.llm.byte_pairs import decode_ids, encode_texts, written_ids
from viewforge.llm.lines import drop_boilerplate
from viewforge.llm.near_copies import near_duplicates
from viewforge.llm.packing import pack_along_curve
from viewforge.llm.postings import decontaminate
from viewforge.llm.prefix_trie import ordered_turns, spliced_turns, trie
from viewforge.llm.rule_ensemble import score_quality
from viewforge.llm.rule_lists import judge_by_rules
from viewforge.llm.secrets import scan_secrets
from viewforge.llm.substrings import remove_repeats
from viewforge.llm.surrogates import replace_personal_data
from viewforge.llm.token_files import read_token_files, write_token_files
from viewforge.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_substring_dedup(spark, sf_dir):
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark, sf_dir):
    return score_quality(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    judged = judge_by_rules(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "rule")


def op3_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), similarity=0.8).select("doc_id", "class_id", "class_size")


def op4_surrogates(spark, sf_dir):
    return replace_personal_data(documents(spark, sf_dir).select("doc_id", "text"), key="surrogates of the registered query")


def op5_line_dedup(spark, sf_dir):
    kept = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"), host="source", ratio=0.1, min_pages=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op6_packing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pack_along_curve(docs, TOKENIZER, end_id=2, length=4096, by_word=True).drop("ids")


def op7_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir).select("doc_id", "text"), path, TOKENIZER, end_id=1, by_word=True)
    return read_token_files(spark, path)


def op9_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), items, window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_secrets(spark, sf_dir):
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    written = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(F.array_join(F.filter(written, lambda s: ~s.startswith("named:")), ","), 256).alias("base_sha256"),
        F.array_join(written, ",").alias("spans"),
    )


def op11_prefix_trie(spark, sf_dir):
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie(*spliced_turns(turns, block=20, most=4))


def op12_byte_pairs(spark, sf_dir):
    encoded = encode_texts(documents(spark, sf_dir).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    decoded = decode_ids(written_ids(encoded, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("written", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_lexical_search(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(documents(spark, sf_dir), items, k=10)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_surrogates": op4_surrogates,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE = {
    "op5_line_dedup": lines.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
