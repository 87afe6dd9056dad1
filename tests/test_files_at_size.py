"""Files made, saved and parsed at size: what one pass, one batch or one join value may hold."""

from folioframe.sources import editing, pdf


def test_saved_files_are_few_folders_and_whole(spark, tmp_path):
    files = spark.createDataFrame([(str(i), f"data {i}\n".encode()) for i in range(600)] + [("a/b c=1", b"x"), ("7", b"data 7\n"), ("7", b"other"), (None, b"")], "doc_id string, data binary")
    editing.save(files.repartition(3), f"{tmp_path}/out")
    found = {p: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    names = sorted(p.name.removeprefix("doc_id=") for p in found)
    assert names == sorted([*map(str, range(600)), "7", "a%2Fb c%3D1", "__HIVE_DEFAULT_PARTITION__"])
    assert sorted(found.values()) == sorted([*(f"data {i}\n".encode() for i in range(600)), b"x\n", b"other\n", b"\n"])
    assert len({p.parent for p in found}) <= 257


def test_files_are_made_rewritten_and_parsed_in_one_pass(spark):
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(5)], "doc_id string, text string")
    r = pdf.Relations(pdf.rotated(pdf.from_texts(rows), 90))
    plan = r.page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, r.page.select("doc_id", "rotate").collect())) == [(str(i), 90) for i in range(5)]


def test_batches_of_files_are_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    monkeypatch.setattr(pdf, "BATCH_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(50)]), pa.array([b"x" * 300] * 50)], names=["doc_id", "data"])
    out = list(pdf.made_files(Rows(), pdf._pairs).run(iter([batch])))
    assert sum(b.num_rows for b in out) == 50 and max(b.nbytes for b in out) < 2000


def test_profiles_read_only_what_their_rules_need():
    from folioframe.plans import rules

    used = set().union(*(rules._reads(x.find.__code__) for x in rules.RULES if x.profiles & rules.X4))
    assert "page_use" in used and not used & {"struct_node", "limit", "content_op"}
