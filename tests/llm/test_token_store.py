import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tallyspark.llm import common, queries, token_store

SF = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encode(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 0], dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_the_library(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in common.table(spark, SF, "documents").select("doc_id", "text").collect())
    ids = encode([x for _, x in docs])
    starts = np.cumsum([0, *map(len, ids)])
    want = {(d, int(s), len(i), zlib.crc32(i.tobytes())) for (d, _), s, i in zip(docs, starts, ids)}
    assert {tuple(r) for r in queries.op1_token_ids(spark, SF).collect()} == want


def test_round_trip_and_short_access(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 64)
    path = common.shared_path(spark, "t")
    token_store.write_token_store(odd_docs, path, PATH)
    got = token_store.read_token_store(spark, path).collect()
    assert len(got) == odd_docs.count()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(x.tobytes() for x in encode(texts))
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *(r["n_tokens"] for r in by_start)])[:-1].tolist()
    assert [r["doc_id"] for r in by_start] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))
    few = token_store.read_token_store(spark, path, [7, 2]).collect()
    assert {(r["doc_id"], r["start"]) for r in few} == {(r["doc_id"], r["start"]) for r in got if r["doc_id"] in (7, 2)}


def test_empty_and_wrong_dictionary(spark, no_docs):
    path = common.shared_path(spark, "t")
    token_store.write_token_store(no_docs, path, PATH)
    assert token_store.read_token_store(spark, path).count() == 0
    other = common.shared_path(spark, "t")
    spark.createDataFrame([("0" * 64, bytearray(b"x"), 2)], "dict_hash string, dictionary binary, width int").write.parquet(f"{other}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_token_store(spark, other)


def test_trained_dictionary_serves_short_documents():
    samples = encode([f"the quick brown fox number {i} jumps over the lazy dog {i * 7}" for i in range(400)])
    raw = token_store.train_dictionary([x.astype("<u2").tobytes() for x in samples])
    assert raw and len(token_store.dictionary_hash(raw)) == 64


def test_words_go_to_the_merges_as_the_library_splits_them():
    t = tokenizers.Tokenizer.from_file(PATH)
    assert token_store._splits_at_blanks(t)
    own = token_store._tokenizer(t.to_str())
    for text in (" ªº µ ǅ ʰ́ 𝒳 x́", "don't I'LL 's", " <|endoftext|> a<|endoftext|>b", "a <|endoftext|> b", "x  <|endoftext|>\n\nWas.\nThe, end", "a,\nb.\n\tC\n 'd\n", "\nA b", " İ ı ſ ẞ Straße,", "中文 字 ɐ", "a  b\n c", ""):
        assert np.array_equal(np.append(np.frombuffer(own.of(text), "<u4"), 0), encode([text])[0]), text


def test_other_tokenizers_are_not_taken_apart():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.normalizer = tokenizers.normalizers.Lowercase()
    assert not token_store._splits_at_blanks(t)
    own = token_store._tokenizer(t.to_str())
    assert np.frombuffer(own.of("a Word"), "<u4").tolist() == t.encode("a Word", add_special_tokens=False).ids


def test_many_texts_at_once_equal_the_library():
    import random

    rng, own = random.Random(5), token_store._tokenizer(tokenizers.Tokenizer.from_file(PATH).to_str())
    parts = ["the", "Rend", "naïve", "ñ", "中", "x1", "12", ",", ".", "\n", "\r\n", "\t", " ", "  ", "'s", "<|endoftext|>", "\u3000", "\x1c", "-", "ɐb", "\u0301", "é", "_", "I'm"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(20_000)]
    texts += [" ".join(rng.choices(parts[:12], k=40)) for _ in range(2_000)]
    got = [np.append(np.frombuffer(x, "<u4"), 0) for x in own.of_many(texts, 5_000)]
    assert all(np.array_equal(a, b) for a, b in zip(got, encode(texts), strict=True))
    small = common.PieceCache(own.compute, 50, own.compute_words)
    assert [np.append(np.frombuffer(x, "<u4"), 0).tolist() for x in small.of_many(texts[-300:], 300)] == [x.tolist() for x in encode(texts[-300:])]


def test_words_of_other_kinds_are_computed_together_and_once():
    own, single, together = token_store._tokenizer(tokenizers.Tokenizer.from_file(PATH).to_str()), [], []

    def one(piece):
        single.append(piece)
        return own.compute(piece)

    def many(pieces):
        together.append(pieces)
        return own.compute_pieces(pieces)

    cache = common.GroupedCache(one, 5_000, own.compute_words, many)
    words = [f"né{i}%%%" for i in range(2_000)] + ["x" * 60 + "1", "a1,", "tab\tbed", "end\x1cof", "12.", "中1"]
    texts = [" ".join(["the", *words[k::40]]) for k in range(40)] * 2
    got = [np.append(np.frombuffer(x, "<u4"), 0) for x in cache.of_many(texts, 20_000)]
    assert all(np.array_equal(a, b) for a, b in zip(got, encode(texts), strict=True))
    assert len(single) < 40 and max(map(len, together)) > 100
    asked = [p for part in together for p in part if len(p) <= cache.LONGEST]
    assert len(asked) == len(set(asked)) >= 2_000
    tiny = common.GroupedCache(own.compute, 7, own.compute_words, own.compute_pieces)
    assert [np.append(np.frombuffer(x, "<u4"), 0).tolist() for x in tiny.of_many(texts[:9], 900)] == [x.tolist() for x in encode(texts[:9])]
    assert len(tiny) <= 7 and len(tiny.older) <= 7
