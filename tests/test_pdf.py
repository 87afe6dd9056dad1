import random
import zlib

import pytest
from pdfmaker import N, classic, objects, packed, updated

from folioframe.functions import codecs
from folioframe.sources import content, pdf
from folioframe.sources.pdfsyntax import Ref, Stream, load, serialise


def text(data):
    doc = load(data)
    return [content.page_text(doc, p).text for _, p in doc.pages()]


def test_codecs_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 5, 300, 20_000):
        for data in (bytes(rng.choices(range(256), k=n)), bytes(rng.choices(b"ab", k=n)), b"z" * n):
            assert codecs.lzw_decode(codecs.lzw_encode(data)) == data
            assert codecs.runlength_decode(codecs.runlength_encode(data)) == data
            assert codecs.ascii85_decode(codecs.ascii85_encode(data)) == data
            assert codecs.asciihex_decode(codecs.asciihex_encode(data)) == data
            assert codecs.decode(codecs.asciihex_encode(zlib.compress(data)), ["AHx", "Fl"], []) == data
    assert codecs.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    assert codecs.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert codecs.predict(bytes([1, 1, 1, 2, 5, 5]), {"Predictor": 15, "Columns": 2}) == bytes([1, 2, 6, 7])
    with pytest.raises(ValueError):
        codecs.decode(b"", ["Nope"], [])


def test_ways_to_store_a_file():
    assert text(classic(pages=("One", "Two"))) == ["One", "Two"]
    assert text(packed(pages=("One", "Two"))) == ["One", "Two"]
    assert text(b"junk\n" + classic()) == ["Hello"]
    two = updated(classic(), {5: Stream({}, b"BT /F1 10 Tf (New) Tj ET")}, 6)
    assert text(two) == ["New"]
    assert load(two).xref[5].depth == 0 and load(two).xref[4].depth == 1
    broken = classic().replace(b"startxref\n", b"startxref\n9")
    assert text(broken) == ["Hello"] and load(broken).rebuilt
    with pytest.raises(ValueError):
        load(b"nothing")


def test_text_fold():
    split = objects(pages=(b"BT /F1 10 Tf 1 0 0 1 10 70",))
    split[4]["Contents"] = [Ref(5), Ref(6)]
    split[6] = Stream({}, b"Tm (A) Tj 20 0 Td (B) Tj 0 -12 Td [(C) -2000 (D)] TJ ET")
    assert text(serialise(split, {"Root": Ref(1)})) == ["A B\nC D"]
    form = objects(pages=(b"/X Do /X Do",), extra={6: Stream({"Type": N("XObject"), "Subtype": N("Form"), "Resources": {"Font": {"F1": Ref(3)}, "XObject": {"X": Ref(6)}}}, b"BT /F1 10 Tf (f) Tj ET /X Do")})
    form[2]["Resources"]["XObject"] = {"X": Ref(6)}
    assert text(serialise(form, {"Root": Ref(1)})) == ["f f"]
    marked = load(classic(pages=(b"/P <</MCID 3>> BDC BT /F1 9 Tf (in) Tj ET EMC /Artifact BMC BT /F1 9 Tf 0 90 Td (out) Tj ET EMC",)))
    assert [(f[0], f[7]) for f in content.page_text(marked, marked.pages()[0][1]).fragments] == [("in", 3), ("out", None)]
    assert content.to_unicode(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <00790079>] endbfrange") == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "yy"}
    ops = list(content.operators(b"q BI /W 2 /H 1 /BPC 8 ID \x00\xff EI Q"))
    assert [o for o, _ in ops] == ["q", "BI", "Q"] and ops[1][1][0]["W"] == 2


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "doc_id string, data binary")


def test_relations(spark, tmp_path):
    tree = {10: {"Type": N("StructTreeRoot"), "K": [Ref(11)], "RoleMap": {"Head": N("H1")}}, 11: {"S": N("Document"), "K": [Ref(12), 0, Ref(13)]}, 12: {"S": N("H1")}, 13: {"S": N("P"), "K": Ref(11)}, 20: {"Orphan": True}}
    a = classic(pages=("One", ""), catalog={"StructTreeRoot": Ref(10)}, extra=tree, page={"Annots": [{"Subtype": N("Link"), "F": 4}]})
    for name, data in (("a.pdf", a), ("b.pdf", packed()), ("bad.pdf", b"no")):
        (tmp_path / name).write_bytes(data)
    r = pdf.read(spark, str(tmp_path))
    docs = {x.doc_id.rsplit("/", 1)[1]: x for x in r.doc.collect()}
    assert docs["bad.pdf"].error and docs["a.pdf"].n_pages == 2 and docs["b.pdf"].version == "1.5" and docs["a.pdf"].bytes_after_eof == 0
    nodes = [(x.node, x.parent, x.ord, x.type) for x in r.struct_node.orderBy("node").collect()]
    assert nodes == [(0, None, 0, None), (1, 0, 0, "Document"), (2, 1, 0, "H1"), (3, 1, 1, "P")]
    assert [(x.src, x.dst) for x in r.role_map.collect()] == [("Head", "H1")]
    assert r.annot.count() == 2 and r.annot.first().flags == 4
    assert {x.subset_tag for x in r.font.collect()} == {"ABCDEF"}
    assert {x.doc_id.rsplit("/", 1)[1]: x.text for x in r.document_text().collect()} == {"a.pdf": "One", "b.pdf": "Hello"}
    assert r.page.where("media_box[2] = 612.0").count() == 3
    assert r.content_op.where("op = 'Tj'").count() == 3 and r.text_fragment.count() == 2
    assert r.stream.where("error IS NOT NULL").count() == 0 and r.xref.count() > 10
    live = {x.obj_num for x in r.live_objects().where("doc_id LIKE '%a.pdf'").collect()}
    assert 13 in live and 20 not in live
    assert r.object_text.where("obj_num = 20").first().canon == '{"Orphan": true}'


def test_optimised(spark):
    big = classic(pages=("word " * 400,), extra={20: {"Orphan": True}})
    out = {x.doc_id: bytes(x.data) for x in pdf.optimised(files(spark, a=big)).collect()}["a"]
    assert len(out) < len(big) and text(out) == text(big) and 20 not in load(out).objects
