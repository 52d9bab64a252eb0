"""Queries as a whole against the library or their definitions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")

from markovine.llm import registry  # noqa: E402

AZ = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_token_files_query(spark, sf, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i in sorted(texts):
        ids = tk.encode(texts[i], add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = registry.op1_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_bpe_stream_query(spark, sf, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    want = []
    for i in sorted(texts):
        ids = tk.encode(texts[i], add_special_tokens=False).ids
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tk.decode(ids, skip_special_tokens=False)))
        want.append((i, len(ids), *digests))
    got = registry.op6_bpe_stream(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_simhash_query(spark, sf, texts):
    prints = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(AZ))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = registry.op3_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, f"{prints[i]:016x}", find(i)) for i in ids]


@pytest.mark.parametrize("query", [registry.op7_language_id, registry.op10_toxicity, registry.op11_compression_quality])
def test_learned_queries_return_every_row(spark, sf, texts, query):
    got = query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    parts = 4
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == 2) and 0 <= r["score"] <= 1 for r in got)
