"""The queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from . import audio, bpe, common, forest, mixing, pii, simhash, style_tree, token_store, tool_calls, toxicity

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def op1_token_ids(spark, sf_dir):
    path = common.shared_path(spark, "tokens")
    token_store.write_token_store(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_store.read_token_store(spark, path, ids=False)


def op2_media(spark, sf_dir):
    return audio.features(audio.stored(audio.store_texts(common.table(spark, sf_dir, "documents"))))


def op3_embedding_neardup(spark, sf_dir):
    return forest.near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.personal_data(common.table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op7_html(spark, sf_dir):
    return style_tree.extract(common.table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_bpe(spark, sf_dir):
    return bpe.encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_tool_calls(spark, sf_dir):
    return tool_calls.link_conversations(common.table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_media, op3_embedding_neardup, op4_mixing, op5_pii, op6_simhash, op7_html, op8_toxicity, op9_bpe, op10_tool_calls)}
ORACLES: dict[str, str] = {}
