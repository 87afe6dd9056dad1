import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from folioframe.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "a" * 5000, "The cat's  sat\n\n on\tthe mat. ", "éèß日本語テキスト" * 120, "x\x1cy\u0085z w v 😀👍", "\x00\x01 nul", "1234567 ²½ ..!!", "same", "same"]


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_pieces_match_the_library(enc):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdefghij étion\n'") for _ in range(rng.randrange(2000))) for _ in range(20)]
    texts.append("".join(rng.choice("etaoinsrhldé") for _ in range(3000)))
    c = bpe.codec(PATH, P.PATTERN)
    got = c.encode_texts(texts)
    assert [x.tolist() for x, _ in got] == [enc.encode_ordinary(t) for t in texts]
    assert c.decode([x for x, _ in got]) == [t.encode() for t in texts]


def test_frames(spark, enc):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "no id", None)], "doc_id bigint, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode(df, PATH, P.PATTERN, digests=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids) == (len(ids), ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in [*enumerate(TEXTS), (None, "no id")]}
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
