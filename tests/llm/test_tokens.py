import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probelight.llm import bpe, common, queries, token_ids
from tests.llm.helpers import EDGE_TEXTS, documents

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))
PIECES = bpe.Pieces(RANKS)
PARTS = st.sampled_from(["a", "b", "s", "t", "'", "'s", "'ll", "'re", "'v", " ", "  ", "\n", "1", "!", "é", "漢", "😀", "́", "\x85", "\xa0", "E", "<|endoftext|>", "word", "Σ", ".", ","])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), min_size=1, max_size=6))
def test_pretokenisation_and_merging_match_tiktoken(texts):
    raw, at = common.text_buffers(pa.array(texts))
    ids, id_at, marks, mark_at = bpe.encode_texts(raw, at, PIECES)
    for i, t in enumerate(texts):
        assert ids[id_at[i] : id_at[i + 1]].tolist() == TIKTOKEN.encode_ordinary(t)
        assert marks[mark_at[i + 1] - 1] == len(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=30).map("".join))
def test_words_match_whole_texts(text):
    found = token_ids.WordIds(WORDS, "<u2").look_up([text])[0]
    assert np.frombuffer(found, "<u2").tolist() == WORDS.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    built = token_ids.EliasFano.build(values)
    read = token_ids.EliasFano(built.n, built.low_bits, built.high.tobytes(), built.low.tobytes(), built.select_at.tobytes())
    assert read.select(np.arange(len(values))).tolist() == values.tolist() == [read[i] for i in range(len(values))]


def test_every_code_point_before_an_ending():
    """A letter, number or other sign takes the apostrophe after it or leaves it; all planes that have signs."""
    points = [c for c in (*range(0x40000), *range(0xE0000, 0xE0200), *range(0xF0000, 0xF0040)) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        texts = [f"x{chr(c)}'s" for c in points[lo : lo + 20_000]]
        raw, at = common.text_buffers(pa.array(texts))
        ids, id_at, _, _ = bpe.encode_texts(raw, at, PIECES)
        wrong = [t for i, t in enumerate(texts) if ids[id_at[i] : id_at[i + 1]].tolist() != TIKTOKEN.encode_ordinary(t)]
        assert not wrong, wrong[:5]


def test_byte_bpe_edges(spark):
    docs = documents(spark, EDGE_TEXTS).withColumn("ids", F.lit(1))
    ranks = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.digest(bpe.encode(docs, ranks), ranks).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        ids = TIKTOKEN.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("texts", [EDGE_TEXTS, []])
def test_token_shards(spark, texts, tmp_path):
    docs = documents(spark, texts).withColumn("start", F.lit("x"))
    token_ids.write_shards(docs, P.path("word_bpe_49k.json"), str(tmp_path / "shards"))
    got = sorted(tuple(r) for r in token_ids.read_documents(spark, str(tmp_path / "shards")).collect())
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*WORDS.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_queries_over_the_whole_table(spark, sf_dir):
    """Both queries against the libraries, text by text."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {r.doc_id: r for r in queries.op8_byte_bpe(spark, sf_dir).collect()}
    shards = {r.doc_id: r for r in queries.op10_token_ids(spark, sf_dir).collect()}
    assert set(pieces) == set(shards) == set(texts)
    at = 0
    for i in sorted(texts):
        ids = TIKTOKEN.encode_ordinary(texts[i])
        spelled = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (pieces[i].n_tokens, pieces[i].ids_sha256, pieces[i].decoded_sha256) == (len(ids), spelled, hashlib.sha256(texts[i].encode()).hexdigest())
        own = np.array([*WORDS.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert (shards[i].start, shards[i].n_tokens, shards[i].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_small_caches_change_nothing(monkeypatch):
    """Caches that overflow at every batch give the same ids."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(token_ids, "CACHE_BYTES", 2000)
    words, pieces = token_ids.WordIds(WORDS, "<u2"), bpe.Pieces(RANKS)
    for k in range(0, 300, 3):
        texts = [f"word{i} other{i % 7}, again {i * 31}!" for i in range(k, k + 3)]
        raw, at = common.text_buffers(pa.array(texts))
        ids, id_at, _, _ = bpe.encode_texts(raw, at, pieces)
        for i, (t, found) in enumerate(zip(texts, words.look_up(texts), strict=True)):
            assert ids[id_at[i] : id_at[i + 1]].tolist() == TIKTOKEN.encode_ordinary(t)
            assert np.frombuffer(found, "<u2").tolist() == WORDS.encode(t, add_special_tokens=False).ids
    assert len(words) < 60 and len(pieces) < 60


def test_null_and_repeated_ids(spark, tmp_path):
    """Null ids come first; rows of one id stand together."""
    rows = [(2, "b b"), (None, "n"), (1, "a"), (1, "a"), (None, None)]
    token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"), str(tmp_path / "shards"))
    got = sorted(token_ids.read_documents(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2] and sorted(r.n_tokens for r in got) == [1, 2, 2, 2, 3]
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
