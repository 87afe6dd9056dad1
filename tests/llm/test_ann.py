import numpy as np

from folioframe.llm import ann


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 50 == 0:
            s = ann.cosine(v, m)
            out[i] = sorted((-x, j) for (j, _), x in zip(good, s.tolist()) if j != i)[:k]
    return out


def corpus(n=3000):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(n)]
    hot = rows[0][1]
    rows += [(10_000 + i, hot) for i in range(1500)] + [(20_000 + i, [2 * x for x in hot]) for i in range(3)]
    rows += [(50_000, None), (50_050, [0.0] * 16), (50_100, [1.0] * 15 + [None]), (50_150, [float("nan")] * 16), (50_200, [1.0] * 5), (None, hot), (50_250, [1e300] * 16)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")


def run(df, **more):
    return ann.search(df, df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding"), **more).collect()


def test_all_cells_give_the_exact_result(spark):
    rows = corpus()
    got = {}
    for r in run(frame(spark, rows), share=1.0):
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [got[q][i + 1][0] for i in range(5)] == [j for _, j in best]
        assert [got[q][i + 1][1] for i in range(5)] == [-s for s, _ in best]


def test_recall(spark):
    rows = corpus()
    got = {(r.query_id, r.vec_id) for r in run(frame(spark, rows))}
    want = {(q, j) for q, best in brute(rows, 5).items() for _, j in best}
    assert len(got & want) >= 0.9 * len(want)


def test_the_heap_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 8))
    index = ann.fit(v, 5, centroids=6)
    index.share = 0.3
    counts = np.bincount(index.cells(v), minlength=36)
    bits = np.unpackbits(index.walk(v[:20], counts), axis=1)[:, :36]
    for q, met in zip(v[:20], bits, strict=True):
        da, db = index.halves(ann.unit(q[None, :]))
        order = np.argsort((da[0][:, None] + db[0]).ravel())
        m = int(met.sum())
        assert set(np.flatnonzero(met)) == set(order[:m].tolist())
        assert counts[order[:m]].sum() >= 150 > counts[order[: m - 1]].sum()


def test_small_tables(spark):
    assert run(frame(spark, [(0, None)])) == []
    assert run(frame(spark, [(0, [1.0, 2.0])])) == []
    rows = run(frame(spark, [(0, [1.0, 0.0]), (7, [1.0, 1.0]), (3, [2.0, 2.0])]))
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 3), (2, 7)]


def test_cells_are_dealt_over_shards():
    counts = np.array([3, 0, 5, 40, 0, 2, 9, 1])
    first, split = ann.dealt(counts, 10)
    assert first.tolist() == [0, 0, 0, 1, 5, 5, 6, 6] and split.tolist() == [1, 1, 1, 4, 1, 1, 1, 1]


def test_many_shards_and_blocks_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 70)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 9)
    rows = corpus(800)
    got = {(r.query_id, r.vec_id) for r in run(frame(spark, rows), share=1.0)}
    assert got == {(q, j) for q, best in brute(rows, 5).items() for _, j in best}
