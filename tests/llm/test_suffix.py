import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioframe.llm import suffix, suffix_dedup
from folioframe.llm.blocks import unpack_keys


def test_suffix_array_matches_sorting():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 5, 7, 50, 301):
        for top in (1, 2, 5, 200):
            s = rng.integers(1, top + 1, n)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert suffix.suffix_array(s).tolist() == want


def test_long_repetitive_texts():
    rng = np.random.default_rng(8)
    bits = [rng.integers(1, 4, 70) for _ in range(40)]
    s = np.concatenate([np.append(bits[int(i)][int(rng.integers(20)) :], 9) for i in rng.integers(0, 40, 3000)])
    sa = suffix.suffix_array(s)
    assert (np.bincount(sa, minlength=len(s)) == 1).all()
    b = bytes(s.astype(np.uint8).tolist())
    assert all(b[i:] < b[j:] for i, j in zip(sa[:-1:7].tolist(), sa[1::7].tolist()))


def test_prefix_classes():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 600).astype(np.int16)
    data[rng.choice(600, 12, replace=False)] = 256
    data[-1] = 256
    stop = np.flatnonzero(data == 256)
    valid = np.array([stop[np.searchsorted(stop, i)] - i >= 9 for i in range(600)])
    order, new = suffix.prefix_classes(data, valid, 9)
    strings = [bytes(data[i : i + 9].astype(np.uint8)) for i in order]
    assert sorted(order.tolist()) == np.flatnonzero(valid).tolist()
    assert strings == sorted(strings)
    assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def brute(rows, width):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            if d is not None:
                least[b[i : i + width]] = min(least.get(b[i : i + width], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if d is not None and least[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["é", "the ", "of ", "ab", "ion", "\n", "zz, "]
    make = lambda a, b: "".join(rng.choices(vocab, k=rng.randrange(a, b)))
    passages = [make(10, 60) for _ in range(15)]
    rows = [(d, "".join(rng.choice(passages) if rng.random() < 0.4 else make(0, 25) for _ in range(rng.randrange(0, 8)))) for d in range(220)]
    rows += [(300, None), (301, ""), (None, passages[0]), (None, passages[0]), (7, passages[1] * 2), (7, passages[1] * 2), (303, "a" * 400), (304, "a" * 300), (305, "ab" * 90)]
    rows += [(400 + i, rows[5][1] + "x" * i) for i in range(30)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, width in ((1, 50), (2, 24)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, dst int")
        got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffix_dedup.dedup_bytes(df, width, with_text=True).collect()), key=str)
        assert got == brute(rows, width)
        # The same with every gram of differing stretches split.
        got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffix_dedup.dedup_bytes(df, width, with_text=True, hot=0).collect()), key=str)
        assert got == brute(rows, width)
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0


def test_hot_gram_is_split():
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 120).astype(np.uint8)).decode()
    made = [(d, "".join(map(chr, rng.integers(97, 123, 60))) + passage + "".join(map(chr, rng.integers(97, 123, 60)))) for d in range(600)]
    made += [(d + 600, t[:90]) for d, t in made[:5]]
    step = suffix_dedup.Stretches(50, 4, texts=True, hot=100)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("src", pa.int32())])
    dealt = [pa.Table.from_pylist([{"doc_id": d, "text": t, "src": s} for d, t in made if d % 8 == s], schema) for s in range(8)]

    def by(tables, column, n):
        whole = pa.concat_tables(tables)
        return [whole.filter(pc.equal(whole.column(column), i)) for i in range(n)]

    shared = by([step.shared_grams(t) for t in by([step.send_grams(t) for t in dealt], "dst", 4)], "src", 8)
    sent = [step.send_stretches(t, r) for t, r in zip(dealt, shared)]
    assert all(suffix_dedup.of_kind(t, suffix_dedup.STRING).num_rows == 4 for t in sent)
    least = by([step.classify(t) for t in by(sent, "dst", 4)], "src", 8)
    got = pa.concat_tables([step.finish(t, r) for t, r in zip(dealt, least)]).to_pylist()
    assert sorted((tuple(r.values()) for r in got), key=str) == brute(made, 50)
    # No reducer holds the differing stretches of a split gram.
    entries = sum(len(unpack_keys(p[8 : 8 + int.from_bytes(p[:8], "little")])[0]) for t in sent for p in suffix_dedup.of_kind(t, 0).column("payload").to_pylist())
    assert entries < 600
