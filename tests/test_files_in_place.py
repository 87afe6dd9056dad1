"""What is read once of equal bytes, and queries whose answer is worked out where a file is parsed."""

import pytest

from folioframe.plans import filecat
from folioframe.sources import builder, content, interactive, pdf
from folioframe.sources.pdfsyntax import Ref, Stream, load, serialise

DATA = "/root/testdata/sf0.001"
SPEC = {"pages": [{"lines": [["one", "P", 0]]}], "fonts": [{"name": "Sans", "unicode": True}]}


def test_parts_of_files_follow_the_table_and_not_the_cores(spark, tmp_path):
    spark.range(60000).selectExpr("id", "uuid() AS x").coalesce(1).write.parquet(f"{tmp_path}/t")
    assert pdf.parts_of(spark.read.parquet(f"{tmp_path}/t")) > 16


def test_dictionaries_of_streams_and_trailers_are_read_once():
    first, second = (load(serialise({1: {"Pages": Ref(3)}, 2: Stream({"Kind": [1.5, b"x"]}, raw)}, {"Root": Ref(1)})) for raw in (b"abc", b"xyz"))
    assert first.objects[2].dict is second.objects[2].dict and (first.objects[2].raw, second.objects[2].raw) == (b"abc", b"xyz")
    assert first.trailer == second.trailer == {"Root": Ref(1), "Size": 3}
    cut = b"<</A (stream) /B 1>>\nstream\nab"
    body = b"%PDF-1.4\n1 0 obj\n" + cut + b"\nendstream\nendobj\n"
    data = body + b"xref\n0 2\n0000000000 65535 f\r\n0000000009 00000 n\r\ntrailer\n<</Root 1 0 R /Size 2>>\nstartxref\n%d\n%%%%EOF\n" % len(body)
    assert [load(data).objects[1].dict for _ in range(3)] == [{"A": b"stream", "B": 1}] * 3


def test_a_kept_object_is_written_under_each_number():
    docs = [load(builder.Builder(SPEC).build()) for _ in range(3)]
    page = docs[2].objects[docs[2].pages()[0][0]]
    for num in (5, 7, 5):
        assert b"\n%d 0 obj\n<</Type /Page " % num in serialise({num: page}, {})


@pytest.mark.parametrize("name", ["file_code_maps", "file_cross_references", "file_documents", "file_flattened", "file_layers"])
def test_queries_parse_each_file_once_and_join_nothing(spark, name):
    df = filecat.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "folioframe-" not in plan


def test_facts_of_a_file_equal_its_rows():
    doc = load(builder.Builder(SPEC | {"layers": [{"name": "a"}, {"name": "b", "visible": False}], "fields": [[None, "f", "Tx", "v", 1], [0, "x", None, None, None]], "update": "new", "info": {"title": "old"}}).build())
    codes = list(pdf.READERS["code_map"]("d", doc))
    assert [x[3:] for x in pdf.READERS["code_map_use"]("d", doc)] == [(len(codes), 32, 126, True)]
    assert content.map_span(b"1 beginbfchar <01> <0041> endbfchar") == (1, 1, 1, False) and content.map_span(b"") is None
    assert list(pdf.READERS["xref_use"]("d", doc)) == [("d", False, "used", max(e.depth for e in doc.xref.values()))] == [("d", False, "used", 1)]
    assert list(interactive.layer_uses("d", doc)) == [(*x, []) for x in interactive.layers("d", doc)] and len(doc.get(doc.catalog, "OCProperties", "OCGs")) == 2
    assert interactive.field_count("d", doc) == len(list(interactive.fields("d", doc))) == 2


def test_files_that_cannot_be_read_have_rows_of_doc_and_forms(spark):
    rows = spark.createDataFrame([("a", b"no file"), ("b", builder.Builder(SPEC | {"info": {"title": "t"}, "lang": "en"}).build())], "doc_id string, data binary")
    r = pdf.Relations(rows)
    assert sorted(map(tuple, r.form_use.collect())) == [("a", 0), ("b", 0)]
    assert sorted(map(tuple, r.of(doc=("doc_id", "title", "has_lang", "catalog")).doc.select("doc_id", "title", "has_lang").collect())) == [("a", None, False), ("b", "t", True)]
