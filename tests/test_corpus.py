import struct

from pdfmaker import N, classic
from pyspark.sql import functions as F

from folioframe.operators import corpus
from folioframe.sources import content, metadata, pdf
from folioframe.sources.pdfsyntax import Ref, Stream, load
from folioframe.sources.pdf import Relations

PACKET = """<?xpacket begin=''?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:dc='d' xmlns:a='p'>
<rdf:Description a:part='2'><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>T</rdf:li><rdf:li xml:lang='de'>U</rdf:li></rdf:Alt></dc:title><a:s rdf:parseType='Resource'><a:q>1</a:q></a:s></rdf:Description>
<rdf:Description><a:part>3</a:part></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end='w'?>"""


def test_packet():
    got = metadata.xmp_properties(PACKET)
    assert got == [(0, "p", "part", "simple", None, "2"), (1, "d", "title", "alt", "x-default", "T"), (2, "d", "title", "alt", "de", "U"), (3, "p", "s", "struct", None, None), (4, "p", "part", "simple", None, "3")]
    assert metadata.xmp_properties("<broken") == []


def profile():
    head = bytearray(128)
    head[:4], head[8:10], head[12:24], head[36:40] = struct.pack(">I", 144), b"\x02\x40", b"prtrCMYKLab ", b"acsp"
    return bytes(head) + struct.pack(">I4sII", 1, b"wtpt", 144, 0)


def test_profile():
    assert metadata.profile_header(profile()) == (144, "2.4.0", "Output", "CMYK", "Lab", 0, ["wtpt"])
    assert metadata.profile_header(b"x" * 200) is None and metadata.fixed(b"\xff\xff\x80\x00") == -0.5


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "doc_id string, data binary")


def test_relations_and_labels(spark):
    data = classic(
        pages=("a", "b", "c", "d"),
        catalog={"Metadata": Ref(60), "OutputIntents": [{"S": N("GTS_PDFA1"), "DestOutputProfile": Ref(61)}], "PageLabels": {"Nums": [0, {"S": N("r")}, 2, {"S": N("D"), "P": b"A-", "St": 5}]}, "Dests": {"top": [Ref(6), N("Fit")], "gone": [Ref(99)]}},
        extra={60: Stream({}, PACKET.encode()), 61: Stream({"N": 4}, profile())},
    )
    r = Relations(files(spark, x=data))
    assert [(p.name, p.value) for p in r.xmp_prop.where("form = 'simple'").orderBy("ord").collect()] == [("part", "2"), ("part", "3")]
    icc = r.icc_profile.collect()
    assert [(i.obj_num, i["class"], i.space) for i in icc] == [(61, "Output", "CMYK")]
    labels = corpus.page_labels(r.page, r.page_label)
    assert [x.label for x in labels.orderBy("page_idx").collect()] == ["i", "ii", "A-5", "A-6"]
    assert {(d.name, d.page_idx) for d in r.named_dest.collect()} == {("top", 1), ("gone", None)}
    more = spark.createDataFrame([("y", i) for i in (0, 3, 27, 1993)], "doc_id string, page_idx int")
    marks = spark.createDataFrame([("y", 3, "A", None, 1), ("y", 1990, "R", "p", 1990)], "doc_id string, start int, style string, prefix string, first int")
    assert [x.label for x in corpus.page_labels(more, marks).orderBy("page_idx").collect()] == ["1", "A", "Y", "pMCMXCIII"]


def texts(data):
    doc = load(data)
    return [content.page_text(doc, p).text for _, p in doc.pages()]


def test_page_transforms(spark):
    a, b = classic(pages=("one", "two", "three")), classic(pages=("four",))
    cut = {x.doc_id: bytes(x.data) for x in pdf.extracted(files(spark, a=a), 1, 2).collect()}["a"]
    assert texts(cut) == ["two", "three"] and len(cut) < len(a)
    turned = load(bytes(pdf.rotated(files(spark, a=a), 90).first().data))
    assert [p["Rotate"] for _, p in turned.pages()] == [90, 90, 90]
    both = files(spark, a=a, b=b).withColumn("g", F.lit("all")).withColumn("o", F.when(F.col("doc_id") == "b", 0).otherwise(1))
    assert texts(bytes(pdf.merged(both, "g", "o").first().data)) == ["four", "one", "two", "three"]


def test_case_names(spark):
    df = spark.createDataFrame([("/c/Suite test suite 6-1-13-t09-fail-e.pdf",), ("/c/readme.pdf",)], "p string").select(corpus.case_of(F.col("p")).alias("c"), corpus.clause_key(F.lit("see clause 6.2.11")).alias("k"))
    a, b = df.collect()
    assert tuple(a.c) == ("6.1.13", 9, False, "e") and b.c is None and a.k == "6.2.11"


def test_verdicts(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<report><jobs><job><item><name>/x/a.pdf</name></item><validationReport isCompliant="false"><details>
      <rule clause="6.1.2" testNumber="1" status="failed"/><rule clause="6.1.2" testNumber="1" status="failed"/><rule clause="6.1.3" testNumber="2" status="passed"/></details></validationReport></job>
      <job><item><name>b.pdf</name></item></job><job><item><name>a.pdf</name></item><validationReport isCompliant="true"/></job></jobs></report>""")
    v = corpus.read_verdicts(spark, str(tmp_path / "r.xml"))
    got = sorted((x.file_name, x.compliant, [tuple(f) for f in x.failed]) for x in v.collect())
    assert got == [("a.pdf", False, [("6.1.2", 1)]), ("a.pdf", True, []), ("b.pdf", False, [])]
    assert [x.file_name for x in corpus.conflicting(v).collect()] == ["a.pdf"]
