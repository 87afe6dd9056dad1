import re

import numpy as np
import pyarrow as pa

from folioframe.llm import blocks, kernels

TEXTS = ["", None, "one  two\tthree", "\n", "ONE two", "éé ü", "x" * 3000, "a\x1cb c", "end "]


def test_words_match_the_pattern():
    data, offsets = kernels.text_bytes(pa.array(TEXTS))
    w = kernels.Words(data, offsets)
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.start, w.end)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert got == [x for t in want for x in t]
    assert np.diff(w.first).tolist() == [len(t) for t in want]
    h, f = w.hashes(), w.hashes(fold=True)
    assert h[got.index("one")] != h[got.index("ONE")] and f[got.index("one")] == f[got.index("ONE")]
    assert len(set(h.tolist())) == len(set(got))


def test_hashes_do_not_depend_on_place():
    words = [f"w{i % 97}" for i in range(400_000)]
    data, offsets = kernels.text_bytes(pa.array([" ".join(words)]))
    w = kernels.Words(data, offsets)
    h = w.hashes()
    assert len(np.unique(h)) == 97 and (h[:97] == h[97 * 4000 : 97 * 4001]).all()
    g, ok = kernels.grams(h, w.first, 5)
    assert ok.sum() == 400_000 - 4 and len(np.unique(g[ok])) == 97


def test_grams_stay_in_their_text():
    h = np.arange(10, dtype=np.uint64)
    _, ok = kernels.grams(h, np.array([0, 3, 3, 4, 10]), 3)
    assert np.flatnonzero(ok).tolist() == [0, 4, 5, 6, 7]


def test_blocks_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    a = np.arange(1000) - 500
    k, b = blocks.unpack_keys(blocks.pack_keys(keys, a))
    assert (k == keys).all() and (b == a).all()
    t = blocks.scatter(7, keys, (a,), 16)
    whole = blocks.concat([x for _, _, x in blocks.gather(t)], 2)
    assert (whole[0] == keys).all() and (whole[1] == a).all() and set(t.column("src").to_pylist()) == {7}
    assert blocks.scatter(0, keys[:0], (a[:0],), 4).num_rows == 0


def test_lookup_and_cover():
    table = np.array([3, 2**63, 2**64 - 1], np.uint64)
    assert kernels.lookup(np.array([2**64 - 1, 4, 3], np.uint64), table).tolist() == [2, -1, 0]
    flag = np.zeros(8, bool)
    flag[[1, 2]] = True
    assert np.flatnonzero(kernels.runs_cover(flag, 3, np.array([0, 8]))).tolist() == [1, 2, 3, 4]
