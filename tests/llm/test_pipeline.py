"""The pipeline on a small corpus, stage by stage against plain Python."""

import random

import public_tokenizers as P
import tiktoken
from test_decontaminate import brute as edit_distance
from test_jaccard import brute as groups

import corpus_pipeline as cp
from folioframe.llm import bpe, pii, queries


def corpus():
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(500)]
    items = [" ".join(rng.choices(vocab, k=20)) for _ in range(5)]
    docs, labels = [], []
    for d in range(400):
        w = rng.choices(vocab, k=rng.randrange(15, 90))
        toxic = d % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "vile"])
        if d % 41 == 7:
            w += items[d % 5].split()
        if d % 23 == 3:
            w += [f"me{d}@mail.example.com"]
        docs.append([d, " ".join(w), "en", f"src{d % 3}", 0])
        labels.append((d, 1, int(toxic)))
    for d in range(400, 440):
        base = docs[d - 400][1].split()
        if d % 2:
            base[rng.randrange(len(base))] = "changed"
        docs.append([d, " ".join(base), "fr", "src9", 0])
    docs += [[440, "", "en", "s", 0], [441, None, None, None, None]]
    for x in docs:
        x[4] = len(x[1] or "")
    return docs, labels, items


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now = queries.table(spark, sf, "documents")
    kept = {d[0]: d[1] for d in docs}
    seen = []
    for i, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, now, sf)
        if i + 1 < len(cp.STAGES):
            assert tuple(df.columns) == cp.COLUMNS
            df.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
        rows = df.collect()
        if name == "toxicity":
            kept = {d: t for d, t in kept.items() if not {"nasty", "vile"} & set((t or "").split())}
        elif name == "near_duplicates":
            kept = {d: kept[d] for d, _, c in groups(list(kept.items()), 5, 80, 100) if c == d}
        elif name == "decontamination":
            kept = {d: t for d, t in kept.items() if all(edit_distance(x.split(), (t or "").split()) > 4 for x in items)}
        elif name == "pii":
            kept = {d: t and pii.rewrite(queries.PII_KEY, t, {})[0] for d, t in kept.items()}
            assert all(r.n_chars == (0 if r.text is None else len(r.text)) for r in rows if r.doc_id != 441)
        if name != "tokens":
            assert {r.doc_id: r.text for r in rows} == kept, name
        seen.append(len(rows))
    assert seen[0] < len(docs) and seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[4] == seen[2]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.ids for r in rows} == {d: enc.encode_ordinary(t or "") for d, t in kept.items()}
    assert sorted(r.doc_id for r in cp.run(spark, sf).collect()) == sorted(kept)
