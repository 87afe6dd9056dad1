"""Files of which only the objects that are asked for are read: the same rows, also of damaged files."""

import random

import pdfmaker

from folioframe.plans import filecat
from folioframe.sources import builder, pdf
from folioframe.sources.pdfsyntax import Objects, Ref, load, serialise

SPECS = [filecat.customer_file(k, f"Customer#{k}", k % 25, 9000.0 if k % 2 else -5.0, ("BUILDING", "AUTOMOBILE", "HOUSEHOLD")[k % 3]) for k in range(50)]


def rows(name: str, data: bytes, lazy: bool) -> str:
    doc, error = pdf._parsed("d", data, b"", lazy)
    problems: list = []
    return repr((list(pdf._rows(name, "d", data, doc, error, problems)), problems, error))


def test_embedded_files_are_read_without_the_pages():
    for packed in (False, True):
        data = builder.Builder(SPECS[1] | {"packed": packed}).build()
        doc, whole = load(data, lazy=True), load(data)
        assert [x[1:4] for x in pdf.READERS["embedded_file"]("d", doc)] == [("Customer#1.txt", "text/plain", "Data")]
        unread = {num for num, x in doc.objects.held.items() if x.__class__ is tuple}
        pages = whole.pages()
        assert {num for num, _ in pages} | {p["Contents"].num for _, p in pages} <= unread and len(unread) > len(whole.objects) // 2
        assert len(doc.objects) == len(whole.objects) and list(doc.objects.items()) == list(whole.objects.items())


def test_lazy_documents_have_the_rows_of_whole_ones():
    files = [builder.Builder(s).build() for s in SPECS] + [pdfmaker.classic(), pdfmaker.packed()]
    draw, lazy = random.Random(5), 0
    for data in files:
        for cuts in range(4):
            bad = bytearray(data)
            for _ in range(cuts):
                bad[draw.randrange(len(bad))] = draw.randrange(256)
            lazy += isinstance(getattr(pdf._parsed("d", bytes(bad), b"", True)[0], "objects", None), Objects)
            for name in pdf.FOLLOWED:
                assert rows(name, bytes(bad), True) == rows(name, bytes(bad), False)
    assert lazy > 100


def test_an_unread_object_still_tells_a_damaged_file():
    objects = pdfmaker.objects(extra={90: {"A": 1}})
    good = serialise(objects, {"Root": Ref(1)})
    assert isinstance(load(good, lazy=True).objects, Objects)
    for bad in (good.replace(b"90 0 obj", b"91 0 obj"), good.replace(b"/A 1", b"/A " + b"[" * 1500), good.replace(b"/A 1", b"/A " + b"7" * 5000)):
        whole, lazy = (pdf._parsed("d", bad, b"", x) for x in (False, True))
        assert lazy == whole and not isinstance(getattr(lazy[0], "objects", None), Objects)
        assert lazy[1] is not None or lazy[0].rebuilt


def test_small_tables_of_files_are_dealt_out_in_parts_enough_for_even_rounds(spark, tmp_path):
    spark.range(20000).selectExpr("id", "uuid() AS x").coalesce(1).write.parquet(f"{tmp_path}/t")
    size = int(str(spark.read.parquet(f"{tmp_path}/t")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert pdf.parts_of(spark.read.parquet(f"{tmp_path}/t")) == -(-4 * size // pdf.ROW_BYTES) <= pdf.FEW_PARTS


def test_file_embedded_reads_lazily_with_the_rows_of_before(spark):
    df = filecat.QUERIES["file_embedded"](spark, "/root/testdata/sf0.001")
    files = filecat.customer_files(filecat.Tables(spark, "/root/testdata/sf0.001"))
    want = sorted((int(i), x[1], x[2], x[3]) for i, data in files.collect() for x in pdf.READERS["embedded_file"](i, load(data)))
    assert sorted((x["k"], x["name"], x["mime"], x["relationship"]) for x in df.collect()) == want and want and "embedded_file" in pdf.FOLLOWED
