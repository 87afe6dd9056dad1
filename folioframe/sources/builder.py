"""Page-description files from plain specifications: the sink behind `from_specs`.

A specification is a dictionary (JSON text in a DataFrame):

    version, info {title, author, trapped}, id (bool), lang, xmp [[namespace, prefix, name, value]], marked, suspects,
    show_title, pages [{lines [[text, tag, mcid]], rotate, media, trim, annots [{subtype, flags, contents, rect, ap,
    struct, action, oc}], ops (raw operators before the text), font, images}], fonts [{name, embedded, unicode}], roles
    {src: dst}, structure [[parent, type, {Alt, ID, Scope, Headers, ColSpan, RowSpan, Lang, Obj: [page, annotation]}, page, mcid]], outline
    [[parent, title, page]], labels [[start, style, prefix, first]], dests {name: page}, files [{name, mime, relation,
    text}], intents [{subtype, identifier, space}], fields [[parent, name, type, value, flags]], layers [{name,
    visible}], actions [{S, N}] (each the next of the one before), requirements

and its layout: packed (object streams with a cross-reference stream), update (a second title in an incremental update),
broken (startxref points nowhere), tail (bytes after the end).
"""

from __future__ import annotations

import json
import marshal
import struct
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.sources.pdf import _pairs, made_files
from folioframe.sources.pdfsyntax import STORE, Name, Ref, Stream, framed, serialise, text_of, written

#: Namespaces of the metadata that are written most.
NAMESPACES = {"dc": "http://purl.org/dc/elements/1.1/", "xmp": "http://ns.adobe.com/xap/1.0/", "pdf": "http://ns.adobe.com/pdf/1.3/", "pdfaid": "http://www.aiim.org/pdfa/ns/id/", "pdfuaid": "http://www.aiim.org/pdfua/ns/id/", "pdfxid": "http://www.npes.org/pdfx/ns/id/"}


def xmp_packet(properties: list[list[str]]) -> bytes:
    """A metadata packet of [namespace, prefix, name, value] properties; dc:title is written as language alternatives."""
    spaces = {p: ns for ns, p, _, _ in properties}
    body = ""
    for _, prefix, name, value in properties:
        v = escape(value)
        body += f"<{prefix}:{name}>" + (f"<rdf:Alt><rdf:li xml:lang='x-default'>{v}</rdf:li></rdf:Alt>" if (prefix, name) == ("dc", "title") else v) + f"</{prefix}:{name}>"
    declared = "".join(f" xmlns:{p}='{ns}'" for p, ns in spaces.items())
    text = f"<?xpacket begin='﻿' id='W5M0MpCehiHzreSzNTczkc9d'?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about=''{declared}>{body}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end='w'?>"
    return text.encode()


def to_unicode_map(codes: dict[int, str], width: int = 1) -> bytes:
    """A mapping stream of codes to texts; runs of consecutive codes and texts become ranges."""
    runs: list[list] = []
    for code in sorted(codes):
        text = codes[code]
        last = runs[-1] if runs else None
        if last and code == last[1] + 1 and len(text) == len(last[2]) == 1 and ord(text) == ord(last[2]) + code - last[0] and code >> 8 == last[0] >> 8:
            last[1] = code
        else:
            runs.append([code, code, text])
    hexed = lambda t: t.encode("utf-16-be").hex().upper()
    out = [f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def /CMapType 2 def 1 begincodespacerange <{'00' * width}> <{'FF' * width}> endcodespacerange"]
    for at in range(0, len(runs), 100):
        part = runs[at : at + 100]
        single, many = [r for r in part if r[0] == r[1]], [r for r in part if r[0] != r[1]]
        if single:
            out.append(f"{len(single)} beginbfchar " + " ".join(f"<{a:0{2 * width}X}> <{hexed(t)}>" for a, _, t in single) + " endbfchar")
        if many:
            out.append(f"{len(many)} beginbfrange " + " ".join(f"<{a:0{2 * width}X}> <{b:0{2 * width}X}> <{hexed(t)}>" for a, b, t in many) + " endbfrange")
    return "\n".join([*out, "endcmap end end"]).encode()


def icc_header(space: str, kind: str = "prtr") -> bytes:
    """A profile of a header and no tags."""
    body = bytearray(132)
    body[0:4], body[8:12], body[12:16], body[16:20], body[20:24], body[36:40] = (132).to_bytes(4, "big"), b"\x02\x40\0\0", kind.encode(), space.ljust(4).encode(), b"Lab ", b"acsp"
    return bytes(body)


def text_string(s: str) -> bytes:
    return s.encode("ascii") if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be")


class Builder:
    """Objects under construction; numbers are given out in the order of `add`."""

    def __init__(self, spec: dict):
        self.spec, self.objs, self.annots = spec, {}, {}

    def add(self, x) -> Ref:
        num = len(self.objs) + 1
        self.objs[num] = x
        return Ref(num)

    def part(self, make: Callable, *given):
        """What `make` adds and gives; where it was given the same at the same number before, the objects of then. It must
        reach for nothing but its arguments and leave earlier objects as they are."""
        start = len(self.objs)
        try:
            key = marshal.dumps((make.__name__, start, *given), 2)
        except ValueError:
            return make(*given)
        found = STORE.known.get(key)
        if found is None:
            out = make(*given)
            added = [self.objs[n] for n in range(start + 1, len(self.objs) + 1)]
            STORE.keep(key, len(key), (out, added), added)
            return out
        for n, x in enumerate(found[1], start + 1):
            self.objs[n] = x
        return found[0]

    def build(self) -> bytes:
        s = self.spec
        catalog: dict = {"Type": Name("Catalog")}
        root = self.add(catalog)
        info = {k.capitalize(): Name(v) if k == "trapped" else text_string(v) for k, v in (s.get("info") or {}).items() if v is not None}
        info_ref = self.add(info) if info else None
        fonts = [self.part(self._font, f) for f in s.get("fonts") or [{"name": "Helvetica"}]]
        tree: dict = {"Type": Name("Pages"), "Kids": [], "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {f"F{i + 1}": f for i, f in enumerate(fonts)}}}
        tree_ref = self.add(tree)
        catalog["Pages"] = tree_ref
        layers = [self.part(self._layer, x["name"]) for x in s.get("layers") or []]
        if layers:
            off = [r for r, x in zip(layers, s["layers"], strict=True) if not x.get("visible", True)]
            catalog["OCProperties"] = {"OCGs": layers, "D": {"Name": b"Default", "Order": layers, "OFF": off}}
            tree["Resources"]["Properties"] = {f"L{i}": r for i, r in enumerate(layers)}
        pages = [self._page(i, p, tree_ref, tree["Resources"], layers) for i, p in enumerate(s.get("pages") or [])]
        tree["Kids"], tree["Count"] = pages, len(pages)
        if s.get("lang"):
            catalog["Lang"] = text_string(s["lang"])
        if s.get("xmp"):
            catalog["Metadata"] = self.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xmp_packet(s["xmp"])))
        if s.get("marked") is not None:
            catalog["MarkInfo"] = {"Marked": s["marked"]} | ({"Suspects": True} if s.get("suspects") else {})
        if s.get("show_title"):
            catalog["ViewerPreferences"] = {"DisplayDocTitle": True}
        if s.get("structure"):
            catalog["StructTreeRoot"] = self.part(self._structure, s["structure"], s.get("roles") or {}, [p.num for p in pages], [(*k, r.num) for k, r in self.annots.items()])
        if s.get("outline"):
            catalog["Outlines"] = self.part(self._outline, s["outline"], [p.num for p in pages])
        if s.get("labels"):
            nums: list = []
            for start, style, prefix, first in s["labels"]:
                nums += [start, ({"S": Name(style)} if style else {}) | ({"P": text_string(prefix)} if prefix else {}) | ({"St": first} if first else {})]
            catalog["PageLabels"] = {"Nums": nums}
        names: dict = {}
        if s.get("dests"):
            names["Dests"] = {"Names": [y for k in sorted(s["dests"]) for y in (text_string(k), [pages[s["dests"][k]], Name("Fit")])]}
        if s.get("files"):
            names["EmbeddedFiles"] = {"Names": [y for f in sorted(s["files"], key=lambda f: f["name"]) for y in (text_string(f["name"]), self._file(f))]}
        if names:
            catalog["Names"] = names
        if s.get("intents"):
            catalog["OutputIntents"] = [{"S": Name(x["subtype"]), "OutputConditionIdentifier": text_string(x["identifier"])} | ({"DestOutputProfile": self.part(self._profile, x["space"])} if x.get("space") else {}) for x in s["intents"]]
        if s.get("fields"):
            catalog["AcroForm"] = {"Fields": self.part(self._fields, s["fields"])}
        if s.get("actions"):
            catalog["OpenAction"] = self.part(self._action, s["actions"])
        if s.get("requirements"):
            catalog["Requirements"] = [{"S": Name("EnableJavaScripts")}]
        trailer = {"Root": root} | ({"Info": info_ref} if info_ref else {}) | ({"ID": [b"0" * 16, b"1" * 16]} if s.get("id", True) else {})
        version = s.get("version", "1.7")
        out = packed(self.objs, trailer, version) if s.get("packed") else serialise(self.objs, trailer, version)
        if s.get("update") and info_ref:
            out = updated(out, {info_ref.num: info | {"Title": text_string(s["update"])}}, trailer)
        if s.get("broken"):
            at = out.rindex(b"startxref")
            out = out[:at] + b"startxref\n7\n%%EOF\n"
        return out + (s.get("tail") or "").encode()

    def _layer(self, name: str) -> Ref:
        return self.add({"Type": Name("OCG"), "Name": text_string(name)})

    def _profile(self, space: str) -> Ref:
        return self.add(Stream({"N": 3 if space == "RGB" else 4}, icc_header(space)))

    def _font(self, f: dict) -> Ref:
        d = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f["name"]), "FirstChar": 32, "LastChar": 126, "Widths": [500] * 95, "Encoding": Name("WinAnsiEncoding")}
        if f.get("embedded"):
            d["FontDescriptor"] = self.add({"Type": Name("FontDescriptor"), "FontName": Name(f["name"]), "FontFile": self.add(Stream({}, b"%!font"))})
        if f.get("unicode"):
            d["ToUnicode"] = self.add(Stream({}, to_unicode_map({c: chr(c) for c in range(32, 127)})))
        return self.add(d)

    def _page(self, at: int, p: dict, parent: Ref, resources: dict, layers: list) -> Ref:
        body = (p.get("ops") or "").encode()
        body += b"BT /F%d 10 Tf 12 TL 50 742 Td\n" % (p.get("font") or 1)
        for text, tag, mcid in p.get("lines") or []:
            shown = written(text_string(text)) + b" Tj T*\n"
            if tag == "Artifact":
                shown = b"/Artifact BMC " + shown + b"EMC\n"
            elif tag:
                shown = b"/%s <</MCID %d>> BDC " % (tag.encode(), mcid) + shown + b"EMC\n"
            body += shown
        body += b"ET"
        page = {"Type": Name("Page"), "Parent": parent, "Contents": self.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))}
        for key, name in (("rotate", "Rotate"), ("media", "MediaBox"), ("trim", "TrimBox"), ("tabs", "Tabs")):
            if p.get(key) is not None:
                page[name] = Name(p[key]) if key == "tabs" else p[key]
        if p.get("images"):
            page["Resources"] = resources | {"XObject": {f"I{i}": self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "ColorSpace": Name(space), "BitsPerComponent": 8}, bytes(w * h * (3 if space == "DeviceRGB" else 1)))) for i, (w, h, space) in enumerate(p["images"])}}
        if p.get("annots"):
            page["Annots"] = [self._annot(a, layers) for a in p["annots"]]
            self.annots |= {(at, k): r for k, r in enumerate(page["Annots"])}
        return self.add(page)

    def _annot(self, a: dict, layers: list) -> Ref:
        d = {"Type": Name("Annot"), "Subtype": Name(a["subtype"]), "Rect": a.get("rect") or [10, 10, 60, 30]}
        if a.get("flags") is not None:
            d["F"] = a["flags"]
        if a.get("contents"):
            d["Contents"] = text_string(a["contents"])
        if a.get("ap"):
            d["AP"] = {"N": self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 1, 1]}, b""))}
        if a.get("action"):
            d["A"] = {"S": Name(a["action"])}
        if a.get("oc") is not None and layers:
            d["OC"] = layers[a["oc"]]
        return self.add(d)

    def _structure(self, nodes: list, roles: dict, pages: list, annots: list) -> Ref:
        annots = {(page, k): Ref(num) for page, k, num in annots}
        root: dict = {"Type": Name("StructTreeRoot"), "K": []}
        refs = [self.add(root)]
        if roles:
            root["RoleMap"] = {k: Name(v) for k, v in roles.items()}
        for parent, kind, attributes, page, mcid in nodes:
            d: dict = {"Type": Name("StructElem"), "S": Name(kind), "P": refs[parent], "K": []}
            grid = {}
            for k, v in (attributes or {}).items():
                if k == "Obj":
                    d["K"].append({"Type": Name("OBJR"), "Obj": annots[tuple(v)]})
                elif k == "Scope":
                    grid[k] = Name(v)
                elif k in ("ColSpan", "RowSpan"):
                    grid[k] = int(v)
                elif k == "Headers":
                    grid[k] = [text_string(x) for x in v.split(",")]
                elif v is not None:
                    d[k] = text_string(v)
            if grid:
                d["A"] = {"O": Name("Table")} | grid
            if page is not None and page < len(pages):
                d["Pg"] = Ref(pages[page])
            if mcid is not None:
                d["K"].append(mcid)
            refs.append(self.add(d))
            self.objs[refs[parent].num]["K"].append(refs[-1])
        return refs[0]

    def _outline(self, entries: list, pages: list) -> Ref:
        items: list[dict] = [{"Type": Name("Outlines")}]
        refs = [self.add(items[0])]
        last: dict[int, int] = {}
        for parent, title, page in entries:
            d = {"Title": text_string(title), "Parent": refs[parent], "Dest": [Ref(pages[page]), Name("Fit")]}
            items.append(d)
            refs.append(self.add(d))
            here = len(refs) - 1
            if parent in last:
                items[last[parent]]["Next"], d["Prev"] = refs[here], refs[last[parent]]
            else:
                items[parent]["First"] = refs[here]
            last[parent] = here
            items[parent]["Last"] = refs[here]
        return refs[0]

    def _file(self, f: dict) -> Ref:
        data = f["text"].encode()
        held = self.add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name(f.get("mime") or "text/plain"), "Filter": Name("FlateDecode")}, zlib.compress(data)))
        name = text_string(f["name"])
        return self.add({"Type": Name("Filespec"), "F": name, "EF": {"F": held, "UF": held}} | ({"UF": name} if f.get("uf", True) else {}) | ({"AFRelationship": Name(f["relation"])} if f.get("relation") else {}))

    def _fields(self, fields: list) -> list[Ref]:
        top, items, refs = [], [], []
        for parent, name, kind, value, flags in fields:
            d: dict = {"T": text_string(name)} if name is not None else {}
            d |= ({"FT": Name(kind)} if kind else {}) | ({"V": text_string(value)} if value is not None else {}) | ({"Ff": flags} if flags is not None else {})
            items.append(d)
            refs.append(self.add(d))
            if parent is None:
                top.append(refs[-1])
            else:
                d["Parent"] = refs[parent]
                items[parent].setdefault("Kids", []).append(refs[-1])
        return top

    def _action(self, chain: list[dict]) -> Ref:
        after = None
        for x in reversed(chain):
            after = self.add({"Type": Name("Action"), "S": Name(x["S"])} | ({"N": Name(x["N"])} if x.get("N") else {}) | ({"Next": after} if after else {}))
        return after


#: A row of a cross-reference stream.
_ROW = struct.Struct(">BIH")


def packed(objects: dict, trailer: dict, version: str = "1.7", per_stream: int = 100) -> bytes:
    """A file whose objects other than streams lie in object streams, behind a cross-reference stream."""
    plain = [n for n in sorted(objects) if not isinstance(objects[n], Stream)]
    streams = {n: x for n, x in objects.items() if isinstance(x, Stream)}
    num, place = max(objects, default=0), {}
    for at in range(0, len(plain), per_stream):
        num += 1
        head, body, size = [], [], 0
        for k, n in enumerate(plain[at : at + per_stream]):
            place[n] = (num, k)
            head.append(b"%d %d " % (n, size))
            body.append(text_of(objects[n]))
            size += len(body[-1]) + 1
        start = b"".join(head)
        streams[num] = Stream({"Type": Name("ObjStm"), "N": len(head), "First": len(start), "Filter": Name("FlateDecode")}, zlib.compress(b"".join((start, b" ".join(body), b" "))))
    out, used = bytearray(f"%PDF-{version}\n".encode() + b"%\xe2\xe3\xcf\xd3\n"), {}
    for n in sorted(streams):
        used[n] = len(out)
        out += framed(n, streams[n])
    table = num + 1
    used[table] = len(out)
    rows = [b"\0\0\0\0\0\xff\xff"] + [_ROW.pack(2, *place[n]) if n in place else _ROW.pack(1, used[n], 0) if n in used else bytes(7) for n in range(1, table + 1)]
    x = Stream({"Type": Name("XRef"), "Size": table + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")} | trailer, zlib.compress(b"".join(rows)))
    out += b"%d 0 obj\n" % table + written(x) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % used[table]
    return bytes(out)


def updated(first: bytes, changes: dict, trailer: dict) -> bytes:
    """The file with an incremental update that writes some objects anew."""
    prev = int(first[first.rindex(b"startxref") + 9 :].split()[0])
    out, at = bytearray(first), {}
    for n, x in sorted(changes.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + written(x) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n\r\n" % (n, a) for n, a in at.items())
    return bytes(out + b"trailer\n" + written(trailer | {"Size": max(changes) + 1, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def from_specs(df: DataFrame, key: str = "doc_id", spec: str | Column = "spec") -> DataFrame:
    """doc_id, data: a file for each specification (JSON)."""
    chosen = F.col(spec) if isinstance(spec, str) else spec
    rows = df.select(F.col(key).cast("string").alias("doc_id"), chosen.alias("spec"))
    return made_files(rows, lambda batch: ((doc_id, Builder(json.loads(x)).build()) for doc_id, x in _pairs(batch)))


def from_rows(df: DataFrame, key: str, spec: Callable[..., dict]) -> DataFrame:
    """doc_id, data: a file for each row, by the specification that a function makes of the row's columns in order."""

    def make(batch: pa.RecordBatch):
        for doc_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield doc_id, Builder(spec(*row)).build()

    return made_files(df.select(F.col(key).cast("string").alias("doc_id"), *df.columns), make)
