"""What a process keeps of the files it meets, and what is looked up where a file is parsed."""

from folioframe.sources import builder, content, pdf
from folioframe.sources.pdfsyntax import KEPT_BYTES, STORE, Ref, load

SPEC = {"pages": [{"lines": [["one", "P", 0]]}], "fonts": [{"name": "Sans", "unicode": True, "embedded": True}], "structure": [[0, "Document", {}, None, None], [1, "P", {}, 0, 0]], "outline": [[0, "Top", 0]]}


def made(n: int, **more) -> list[bytes]:
    return [builder.Builder(SPEC | more | {"info": {"title": f"file {i}"}}).build() for i in range(n)]


def test_equal_objects_are_read_and_written_once():
    for packed in (False, True):
        files = made(4, packed=packed)
        docs = [load(f) for f in files]
        shared = [n for n in docs[3].objects if docs[3].objects[n] is docs[2].objects[n]]
        assert len(shared) > 5 and docs[3].objects[2] != docs[2].objects[2]
        assert STORE.size <= KEPT_BYTES
        again = [pdf._with_pages(d, [p for _, p in d.pages()], 90) for d in docs]
        assert [load(x).get(load(x).trailer, "Info", "Title") for x in again] == [b"file %d" % i for i in range(4)]


def test_objects_whose_bytes_do_not_tell_them_are_not_kept():
    def file(size: int) -> bytes:
        body = b"%PDF-1.4\n1 0 obj\n<</Type /Catalog>>\nendobj\n"
        at = [9, len(body)]
        body += b"2 0 obj\n<</Length 3 0 R>>\nstream\nabcdef\nendstream \nendobj\n"
        at.append(len(body))
        body += b"3 0 obj\n%d\nendobj\n" % size
        rows = b"".join(b"%010d 00000 n\r\n" % a for a in at)
        return body + b"xref\n0 4\n0000000000 65535 f\r\n" + rows + b"trailer\n<</Root 1 0 R /Size 4>>\nstartxref\n%d\n%%%%EOF\n" % len(body)

    assert [load(file(n)).objects[2].raw for n in (6, 6, 6, 6)] == [b"abcdef"] * 4
    broken = [file(6).replace(b"<</Type /Catalog>>\nendobj", b"<</Type /Catalog>>\nstream")] * 3
    assert [type(load(f).objects[1]).__name__ for f in broken] == ["Stream"] * 3


def test_zeros_of_either_sign_are_apart():
    m = content._IDENTITY
    for y in (0, 0.0, -0.0, 0):
        got = content._array(content._moved(1.5, y, m))
        assert got[2, 0] == 1.5 and content._moved(1.5, y, m) == content._shifted.__wrapped__(1.5, y, m)


def test_references_fonts_and_live_objects_need_no_join(spark):
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(made(3))], "doc_id string, data binary")
    r = pdf.Relations(rows)
    for df in (r.referenced(), r.font_inventory(), r.object_use, r.of(page=("doc_id", "rotate")).page):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 1
    got = {(x["src"], x["path"], x["type"]) for x in r.referenced().where("doc_id = '1'").collect()}
    assert (0, "/Root", "Catalog") in got and (1, "/Pages", "Pages") in got
    assert {(x["base_font"], x["used_codes"] == sorted(set(b"one")), tuple(x["pages_used_on"])) for x in r.font_inventory().collect()} == {("Sans", True, (0,))}
    assert r.object_use.where("live").count() == r.live.count() == r.object_use.count()
    assert r.of(page=("doc_id", "rotate")).page.columns == ["doc_id", "rotate"]


def test_a_reference_that_dangles_has_no_kind():
    doc = load(made(1)[0])
    doc.objects[1] = doc.objects[1] | {"Odd": Ref(999)}
    assert ("d", 1, "/Odd", 999, None, None) in list(pdf.READERS["reference"]("d", doc))
