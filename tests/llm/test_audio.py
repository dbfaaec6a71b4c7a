import hashlib
import zlib

import numpy as np
import pytest

from tallyspark.llm import audio, common, queries

SF = "/root/testdata/sf0.001"


def test_tables():
    assert audio.MULAW[0x00] == -32124 and audio.MULAW[0x80] == 32124 and audio.MULAW[0xFF] == 0 and audio.MULAW[0x7F] == 0
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0xAA] == 32256 and audio.ALAW[0x2A] == -32256


def one_block(block):
    value, index, out = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88), []
    out.append(value)
    for b in block[4:]:
        for n in (b & 15, b >> 4):
            step = audio.STEPS[index]
            d = step >> 3
            if n & 1:
                d += step >> 2
            if n & 2:
                d += step >> 1
            if n & 4:
                d += step
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + audio.INDEX_CHANGES[n & 7]))
            out.append(value)
    return out


def test_adpcm_equals_one_block_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (40, 192), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [one_block(b.tobytes()) for b in blocks]


def test_resampling():
    x = np.arange(-50, 50, dtype=np.int16) * 100
    y = audio.resample_double(x)
    assert len(y) == 200 and (y[0::2] == x).all() and (y[3:-5:2] == (x[1:-3] + x[2:-2]) // 2).all()
    assert len(audio.resample_double(x[:0])) == 0


def test_query_equals_brute_force(spark):
    want = {}
    for r in common.table(spark, SF, "documents").collect():
        raw = (r["text"] or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[r["doc_id"]] = (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    got = queries.op2_media(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_round_trip(spark, odd_docs, codec):
    media = audio.store_texts(odd_docs, codec)
    rows = audio.resampled_pcm(media).collect()
    for r in rows:
        kind, payload = audio.from_wav(bytes(r["media"]))
        assert kind == codec and len(payload) % 192 == 0 and len(payload) >= 192
        assert bytes(r["pcm"]) == audio.resample_double(audio.pcm_of(payload, codec)).tobytes()
    assert sorted(audio.from_wav(bytes(r["media"]))[1][: r["n_bytes"]] for r in rows) == sorted((r["text"] or "").encode() for r in odd_docs.collect())


def test_empty(spark, no_docs):
    assert audio.features(audio.store_texts(no_docs)).count() == 0
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxWAVE")


def test_packed_pcm_loses_nothing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 5, 191, 384):
        x = rng.integers(-32768, 32768, n).astype("<i2")
        assert len(audio.pack_pcm(x)) == 2 * n and audio.unpack_pcm(audio.pack_pcm(x)).tolist() == x.tolist()
    edge = np.array([-32768, 32767] * 9, "<i2")
    assert audio.unpack_pcm(audio.pack_pcm(edge)).tolist() == edge.tolist()


def test_query_stores_resampled_pcm_and_reads_it_back(spark, tmp_path, monkeypatch):
    want = {}
    for r in common.table(spark, SF, "documents").collect():
        raw = (r["text"] or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[r["doc_id"]] = audio.resample_double(audio.MULAW[np.frombuffer(pay, np.uint8)]).tobytes()
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    got = queries.op2_media(spark, SF).collect()
    assert {r["doc_id"]: (r["pcm_bytes"], r["pcm_sha256"]) for r in got} == {k: (len(x), hashlib.sha256(x).hexdigest()) for k, x in want.items()}
    assert all(r["feature"].endswith(f"pcm16k={zlib.crc32(want[r['doc_id']])}") for r in got)
    files = spark.read.parquet(f"{tmp_path}/media-*").select("doc_id", "pcm").collect()
    assert {r["doc_id"]: audio.unpack_pcm(bytes(r["pcm"])).tobytes() for r in files} == want and len(files) == len(want)


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_features_are_of_the_stored_pcm(spark, odd_docs, codec):
    media = audio.store_texts(odd_docs, codec)
    want = [(len(x), hashlib.sha256(x).hexdigest()) for x in (bytes(r["pcm"]) for r in audio.resampled_pcm(media).collect())]
    assert sorted((r["pcm_bytes"], r["pcm_sha256"]) for r in audio.features(media).collect()) == sorted(want)
    other = np.arange(-7, 8, dtype="<i2")
    changed = audio.with_pcm(media).selectExpr("doc_id", "n_bytes", "media", f"unhex('{audio.pack_pcm(other).hex()}') as pcm")
    assert {r["pcm_sha256"] for r in audio.features(changed).collect()} == {hashlib.sha256(other.tobytes()).hexdigest()}
