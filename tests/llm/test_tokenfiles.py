import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioframe.llm import tokenfiles as tf
from folioframe.llm.kernels import HashIndex, text_bytes

PATH = P.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World. it's 12 O'Clock!!", "a\x1cb Σίσυφος ΟΔΟΣ İstanbul", "é é ﬁ ＡＢ ǅ ªº日本語 テスト。 x", "<|endoftext|> and <|startoftext|>x", "same same.", "same same.", " \t\n ", "word " * 3000, "x,. y., z.. é, a1. 1, A\u030a. ½. \u00a0nb\u00a0sp. \u2028z <|endoftext|>. e\u0301a\u0301.", "don't we're ,. ., a.b a,, '' ''s"]


def test_words_match_the_library():
    tok = Tokenizer.from_file(PATH)
    flat, lens = tf.WordEncoder(PATH).encode(*text_bytes(pa.array(TEXTS)))
    ends = np.cumsum(lens)
    for i, t in enumerate(TEXTS):
        assert flat[ends[i] - lens[i] : ends[i]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocabulary", [2, 5, 1000, 49408, 100_000])
def test_frames_give_random_access(vocabulary):
    rng = np.random.default_rng(vocabulary)
    ids = rng.integers(0, vocabulary, 10_001)
    bits = tf.bits_for(vocabulary)
    data = tf.make_frame(3, 0, np.array([1, 2]), np.array([1, 10_000]), ids, bits, block=512) + tf.FRAME_END.encode()
    (f,) = tf.frames(data)
    assert f.packed.size <= 10_001 * bits / 8 + 25 and f.ids().tolist() == ids.tolist()
    for a, b in ((0, 1), (511, 513), (9000, 10_001), (5, 5)):
        assert f.ids(a, b).tolist() == ids[a:b].tolist()


def test_files(spark, tmp_path):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (4, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(3)
    tf.write_files(df, str(tmp_path / "f"), PATH, 2, 3, frame_ids=700)
    got = sorted(tuple(r) for r in tf.with_starts(tf.read_files(spark, str(tmp_path / "f"))).collect() if r.doc_id is not None)
    tok, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(x for x in want if x[0] is not None)
    tf.write_files(df.limit(0), str(tmp_path / "g"), PATH, 2, 3)
    assert tf.with_starts(tf.read_files(spark, str(tmp_path / "g"))).count() == 0


def test_hash_index():
    rng = np.random.default_rng(0)
    index, known = HashIndex(4), {}
    for n in (3, 50, 1, 4000):
        keys = np.unique(np.concatenate([rng.integers(0, 40, n), rng.integers(0, 2**63, n)])).astype(np.uint64)
        new = keys[index.find(keys) < 0]
        index.add(new)
        for k in new.tolist():
            known[k] = len(known)
        assert index.find(keys).tolist() == [known[k] for k in keys.tolist()]
    assert index.find(np.array([41], np.uint64)).tolist() == [-1]
