"""Small page-description files for tests."""

import zlib

from folioframe.sources.pdfsyntax import Name, Ref, Stream, serialise, written

N = Name


def objects(pages=("Hello",), extra=None, catalog=None, page=None):
    objs = {1: {"Type": N("Catalog"), "Pages": Ref(2)} | (catalog or {}), 2: {"Type": N("Pages"), "Kids": [], "Count": len(pages), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3)}}}, 3: {"Type": N("Font"), "Subtype": N("Type1"), "BaseFont": N("ABCDEF+Sans"), "FirstChar": 32, "Widths": [500] * 95}}
    num = 4
    for text in pages:
        body = text if isinstance(text, bytes) else b"BT /F1 10 Tf 100 700 Td (" + text.encode("latin-1") + b") Tj ET"
        objs[num] = {"Type": N("Page"), "Parent": Ref(2), "Contents": Ref(num + 1)} | (page or {})
        objs[num + 1] = Stream({}, body)
        objs[2]["Kids"].append(Ref(num))
        num += 2
    return objs | (extra or {})


def classic(**kw):
    return serialise(objects(**kw), {"Root": Ref(1), "ID": [b"a" * 16, b"b" * 16]})


def packed(**kw):
    """Cross-reference stream and object stream; content streams deflated with a PNG predictor on the table."""
    objs = objects(**kw)
    streams = {n: Stream(x.dict | {"Filter": N("FlateDecode")}, zlib.compress(x.raw)) for n, x in objs.items() if isinstance(x, Stream)}
    plain = {n: x for n, x in objs.items() if n not in streams}
    head, body = "", b""
    for n, x in plain.items():
        head += f"{n} {len(body)} "
        body += written(x) + b" "
    holder = max(objs) + 1
    streams[holder] = Stream({"Type": N("ObjStm"), "N": len(plain), "First": len(head), "Filter": N("FlateDecode")}, zlib.compress(head.encode() + body))
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    at = {}
    for n, x in sorted(streams.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + written(x) + b"\nendobj\n"
    table = holder + 1
    at[table] = len(out)
    rows = [bytes([0, 0, 0, 0, 0])]
    for n in range(1, table + 1):
        if n in plain:
            rows.append(bytes([2]) + holder.to_bytes(3, "big") + bytes([list(plain).index(n)]))
        else:
            rows.append(bytes([1]) + at[n].to_bytes(3, "big") + b"\0")
    raw, before = b"", bytes(5)
    for r in rows:
        raw += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before))
        before = r
    x = Stream({"Type": N("XRef"), "Size": table + 1, "W": [1, 3, 1], "Root": Ref(1), "Filter": N("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 5}}, zlib.compress(raw))
    out += b"%d 0 obj\n" % table + written(x) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at[table]
    return bytes(out)


def updated(first: bytes, changes: dict, size: int) -> bytes:
    """An incremental update."""
    prev = int(first.rsplit(b"startxref", 1)[1].split()[0])
    out, at = bytearray(first), {}
    for n, x in changes.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + written(x) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n\r\n" % (n, a) for n, a in at.items())
    return bytes(out + b"trailer\n" + written({"Size": size, "Root": Ref(1), "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
