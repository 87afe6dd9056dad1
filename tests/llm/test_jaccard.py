import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folioframe.llm import jaccard
from folioframe.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    sets = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [rng.choices(vocab, k=rng.randrange(1, 90)) for _ in range(25)]
    rows = []
    for d in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        t = " ".join(w)
        rows.append((d, t.upper() if rng.random() < 0.2 else t.replace(" ", "\n", 1)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  B"), (504, "a"), (None, "a b"), (None, " ".join(bases[0])), (505, "x " * 300)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, k, num, size in ((2, 5, 80, 8 << 20), (3, 2, 70, 6000), (5, 3, 100, 3000)):
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
        monkeypatch.setattr(jaccard, "AT_ONCE", 1 << 18 if size > 10000 else 64)
        monkeypatch.setattr(jaccard, "ENTRIES_AT_ONCE", 1 << 20 if size > 10000 else 40)
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, component string")
        got = jaccard.join(df, k, num, 100).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, num, 100)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(6000, 6100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    u, v = jaccard.forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    want = dict(zip(u.tolist(), v.tolist())) | {x: x for x in v.tolist()}
    assert got == want


def test_dense_sets_take_bounded_time_and_memory():
    """1,000 sets of 2,000 shingles that share 70 % and do not link."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 2900, dtype=np.uint64))
    n = 2000
    sets = [np.sort(rng.choice(pool, n, replace=False)) for _ in range(1000)]
    table = pa.table({"doc_id": pa.array(range(1000), pa.int64()), "n": pa.array([n] * 1000, pa.int64()), "rare": pa.array([0] * 1000, pa.int64()), "grams": pa.array([x.tobytes() for x in sets], pa.binary()), "a": [0] * 1000, "b": [0] * 1000, "side": [False] * 1000, "lower": [False] * 1000})
    began = time.process_time()
    tracemalloc.start()
    assert jaccard.Join(4, 85, 100, 8).verify(table).num_rows == 0
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert time.process_time() - began < 40


def test_many_near_copies_link(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for d in range(300):
        w = list(base)
        w[rng.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300


@pytest.mark.parametrize("least, most", [(1, 9), (1, 2**63 - 1)])
def test_one_row_of_each_group(spark, least, most):
    """Repeated and null doc_ids; their numbers go above the doc_ids, or all rows are numbered."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    near = a.replace("a39", "other")
    rows = [(least, a), (2, near), (7, a), (7, b), (8, c), (8, c), (None, a), (None, d), (None, d), (4, f), (5, f), (6, e), (6, e + " more"), (most, " "), (3, ""), (3, ""), (None, None), (None, None)]
    df = spark.createDataFrame([(x, t, "n") for x, t in rows], "doc_id bigint, text string, component_id string")
    got = jaccard.first_of_groups(df, 4, 80, 100)
    assert got.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    sixes = [r for r in got if r[0] == 6]
    assert len(sixes) == 1
    want = [(least, a), (7, b), (8, c), (None, d), (4, f), (most, " "), (3, ""), (3, ""), (None, None), (None, None)]
    assert got == sorted(want + sixes, key=str)
    assert jaccard.first_of_groups(df.limit(0)).collect() == []
