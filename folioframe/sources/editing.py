"""Rewriting files: metadata, stamps, annotations, forms, decryption; reports of what a rewrite saves; writing out."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.sources import builder
from folioframe.sources.pdf import _reached, _rewritten, remade, source_of
from folioframe.sources.pdfsyntax import Document, Name, Ref, Stream, load, serialise, written


class Draft:
    """A document's objects under change."""

    def __init__(self, doc: Document):
        self.doc, self.objs = doc, dict(doc.objects)
        self.root = doc.trailer["Root"].num
        self.next = max(self.objs, default=0)

    def add(self, x) -> Ref:
        self.next += 1
        self.objs[self.next] = x
        return Ref(self.next)

    @property
    def catalog(self) -> dict:
        return self.objs[self.root]

    def put(self, key: str, value) -> None:
        self.objs[self.root] = self.catalog | {key: value}

    def drop(self, key: str) -> None:
        self.objs[self.root] = {k: v for k, v in self.catalog.items() if k != key}

    def pages(self) -> Iterator[tuple[int, dict, dict]]:
        """(number, own dictionary, dictionary with inherited values) of each page that is an object of its own."""
        for num, p in self.doc.pages():
            if num is not None and isinstance(self.objs.get(num), dict):
                yield num, self.objs[num], p

    def done(self) -> bytes:
        trailer = {k: v for k, v in self.doc.trailer.items() if k != "Encrypt"}
        live = _reached(self.objs, [trailer.get("Root"), trailer.get("Info")])
        return serialise({n: self.objs[n] for n in sorted(live) if n in self.objs}, trailer, self.doc.version)


def _changed(files: DataFrame, change: Callable[[Draft], None]) -> DataFrame:
    def run(doc: Document) -> bytes:
        draft = Draft(doc)
        change(draft)
        return draft.done()

    return _rewritten(files, run)


def decrypted(files: DataFrame, password: bytes = b"") -> DataFrame:
    """The files without encryption."""
    return remade(files, lambda data: Draft(load(data, password)).done())


def with_metadata(files: DataFrame, properties: list[list[str]]) -> DataFrame:
    """The files with a metadata packet of [namespace, prefix, name, value] in place of their own."""
    packet = builder.xmp_packet(properties)
    return _changed(files, lambda d: d.put("Metadata", d.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, packet))))


def with_labels(files: DataFrame, ranges: list[tuple[int, str | None, str | None, int | None]]) -> DataFrame:
    """The files with page labels of (start, style, prefix, first)."""
    nums: list = []
    for start, style, prefix, first in sorted(ranges, key=lambda r: r[0]):
        nums += [start, ({"S": Name(style)} if style else {}) | ({"P": builder.text_string(prefix)} if prefix else {}) | ({"St": first} if first else {})]
    return _changed(files, lambda d: d.put("PageLabels", {"Nums": nums}))


def stamped(files: DataFrame, text: str, x: float = 36, y: float = 36, size: float = 9, under: bool = False) -> DataFrame:
    """The files with a line of text on every page, above or under its content, marked as an artifact."""

    def change(d: Draft) -> None:
        font = d.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        body = b"/Artifact BMC q BT /OwnStamp %s Tf %s %s Td " % tuple(map(written, (size, x, y))) + written(builder.text_string(text)) + b" Tj ET Q EMC"
        mine, open_, close = d.add(Stream({}, body)), d.add(Stream({}, b"q")), d.add(Stream({}, b"Q"))
        for num, own, page in list(d.pages()):
            res = d.doc.resolve(page.get("Resources")) or {}
            fonts = d.doc.resolve(res.get("Font")) or {}
            old = own.get("Contents")
            old = list(d.doc.resolve(old)) if isinstance(d.doc.resolve(old), list) else [old] if old is not None else []
            d.objs[num] = own | {"Resources": res | {"Font": fonts | {"OwnStamp": font}}, "Contents": [mine, *old] if under else [open_, *old, close, mine]}

    return _changed(files, change)


def with_annotation(files: DataFrame, page: int, subtype: str, rect: list[float], contents: str, flags: int = 4) -> DataFrame:
    """The files with one more annotation on a page; files without that page stay as they are."""

    def change(d: Draft) -> None:
        pages = list(d.pages())
        if page < len(pages):
            num, own, _ = pages[page]
            new = d.add({"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": rect, "F": flags, "Contents": builder.text_string(contents)})
            d.objs[num] = own | {"Annots": [*(d.doc.resolve(own.get("Annots")) or []), new]}

    return _changed(files, change)


def without_annotations(files: DataFrame, subtypes: list[str]) -> DataFrame:
    """The files without annotations of the given subtypes."""

    def change(d: Draft) -> None:
        for num, own, _ in list(d.pages()):
            kept = [a for a in d.doc.resolve(own.get("Annots")) or [] if d.doc.get(d.doc.resolve(a), "Subtype") not in subtypes]
            d.objs[num] = {k: v for k, v in own.items() if k != "Annots"} | ({"Annots": kept} if kept else {})

    return _changed(files, change)


def flattened(files: DataFrame) -> DataFrame:
    """The files with widgets' normal appearances drawn into their pages, and without widgets and form."""

    def change(d: Draft) -> None:
        doc = d.doc
        for num, own, page in list(d.pages()):
            kept, body, forms = [], b"", {}
            for a in doc.resolve(own.get("Annots")) or []:
                w = doc.resolve(a)
                if not isinstance(w, dict) or doc.resolve(w.get("Subtype")) != "Widget":
                    kept.append(a)
                    continue
                look = doc.get(w, "AP", "N")
                if isinstance(look, dict):
                    look = doc.resolve(look.get(doc.resolve(w.get("AS"))))
                box = [doc.resolve(v) for v in doc.resolve(w.get("Rect")) or []]
                if not isinstance(look, Stream) or len(box) != 4 or (doc.resolve(w.get("F")) or 0) & 2:
                    continue
                own_box = [doc.resolve(v) for v in doc.resolve(look.dict.get("BBox")) or [0, 0, 1, 1]]
                sx, sy = ((box[i + 2] - box[i]) / ((own_box[i + 2] - own_box[i]) or 1) for i in (0, 1))
                key = f"Flat{len(forms)}"
                forms[key] = d.add(Stream(look.dict | {"Type": Name("XObject"), "Subtype": Name("Form")}, look.raw))
                body += b"q " + b" ".join(written(round(float(v), 6)) for v in (sx, 0, 0, sy, box[0] - own_box[0] * sx, box[1] - own_box[1] * sy)) + b" cm /%s Do Q\n" % key.encode()
            if not forms and len(kept) == len(doc.resolve(own.get("Annots")) or []):
                continue
            res = doc.resolve(page.get("Resources")) or {}
            old = own.get("Contents")
            old = list(doc.resolve(old)) if isinstance(doc.resolve(old), list) else [old] if old is not None else []
            new = {k: v for k, v in own.items() if k != "Annots"} | ({"Annots": kept} if kept else {})
            if forms:
                new |= {"Resources": res | {"XObject": (doc.resolve(res.get("XObject")) or {}) | forms}, "Contents": [d.add(Stream({}, b"q")), *old, d.add(Stream({}, b"Q\n" + body))]}
            d.objs[num] = new
        d.drop("AcroForm")

    return _changed(files, change)


def reordered(files: DataFrame, order: Callable[[int], list[int]]) -> DataFrame:
    """The files with their pages in another order: `order` gives the old indexes for a number of pages; those that it
    leaves out are deleted, and those that it repeats are copied."""
    from folioframe.sources.pdf import _with_pages

    def run(doc: Document) -> bytes:
        held = [p for _, p in doc.pages()]
        return _with_pages(doc, [held[i] for i in order(len(held)) if 0 <= i < len(held)])

    return _rewritten(files, run)


def repaired_destinations(files: DataFrame) -> DataFrame:
    """The files without named destinations, outline entries' targets and link targets that lead to no page. Names are
    followed from one to the next until they end or come round."""

    def change(d: Draft) -> None:
        doc = d.doc
        pages = {num for num, _ in doc.pages()}
        from folioframe.sources.pdf import _names

        names = {builder.text_string(str(k)) if not isinstance(k, bytes) else k: v for k, v in [*(doc.get(doc.catalog, "Dests") or {}).items(), *_names(doc, doc.get(doc.catalog, "Names", "Dests"))]}

        def lands(x, seen: frozenset = frozenset()) -> bool:
            x = doc.resolve(x)
            if isinstance(x, dict):
                return lands(x.get("D"), seen)
            if isinstance(x, (bytes, str)):
                key = x if isinstance(x, bytes) else builder.text_string(x)
                return key not in seen and key in names and lands(names[key], seen | {key})
            return isinstance(x, list) and bool(x) and isinstance(x[0], Ref) and x[0].num in pages

        for num, x in list(d.objs.items()):
            if isinstance(x, dict):
                if "Dest" in x and not lands(x["Dest"]):
                    d.objs[num] = {k: v for k, v in x.items() if k != "Dest"}
                if isinstance(doc.resolve(x.get("A")), dict) and doc.get(doc.resolve(x["A"]), "S") == "GoTo" and not lands(doc.resolve(x["A"]).get("D")):
                    d.objs[num] = {k: v for k, v in d.objs[num].items() if k != "A"}

    return _changed(files, change)


def optimise_report(files: DataFrame) -> DataFrame:
    """doc_id, objects_before, objects_after (numbers that the trailer reaches, dangling ones included), bytes_before,
    bytes_after and streams_deflated of the rewrite without unreachable objects and with plain streams deflated."""

    def measured(data: bytes) -> tuple:
        doc = load(data)
        live = _reached(doc.objects, [doc.trailer.get("Root"), doc.trailer.get("Info")])
        out, smaller = {}, 0
        for num in sorted(live & set(doc.objects)):
            x = doc.objects[num]
            if isinstance(x, Stream) and "Filter" not in x.dict and len(z := zlib.compress(x.raw, 9)) < len(x.raw):
                x, smaller = Stream({k: v for k, v in x.dict.items() if k != "DecodeParms"} | {"Filter": Name("FlateDecode")}, z), smaller + 1
            out[num] = x
        return len(doc.objects), len(live), len(data), len(serialise(out, doc.trailer, doc.version)), smaller

    source, make = source_of(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["objects_before", "objects_after", "bytes_before", "bytes_after", "streams_deflated"]
        for batch in batches:
            rows = [(doc_id, *measured(data)) for doc_id, data in make(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]], names=["doc_id", *names])

    return source.mapInArrow(run, "doc_id string, objects_before bigint, objects_after bigint, bytes_before bigint, bytes_after bigint, streams_deflated bigint")


#: Characters that Spark escapes in the names of partitions' folders.
_ESCAPED = frozenset(map(chr, range(1, 32))) | frozenset("\"#%'*/:=?\\\x7f{[]^")


def _placed(base: str, key: str, data: bytes) -> None:
    """One file below a folder; a task that is run again finds its files there."""
    at = f"{base}/{zlib.crc32(key.encode()) & 255:02x}"
    os.makedirs(at, exist_ok=True)
    draft = f"{at}/.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(data)
    try:
        os.link(draft, f"{at}/doc_id={key}")
    except FileExistsError:
        with open(f"{at}/doc_id={key}", "rb") as f:
            same = f.read() == data
        if not same:
            other = f"{base}/again-{hashlib.sha256(data).hexdigest()}"
            os.makedirs(other, exist_ok=True)
            os.replace(draft, f"{other}/doc_id={key}")
            return
    os.remove(draft)


def save(files: DataFrame, folder: str, name: str = "doc_id") -> None:
    """Write each row's data as a file of its own below `folder`, with `doc_id=...` in its path: a file is there whole or
    not at all. Data end with one line end. Into a folder of a mounted file system tasks write files themselves, in one of
    256 folders by the id's checksum; rows with the id of another and other data go to folders by their hash, equal rows
    are one file. Any other store is written by Spark's committer, in a folder `doc_id=...` for each file."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder) and not folder.startswith("file:/"):
        body = F.expr("CASE WHEN endswith(data, X'0A') THEN substring(data, 1, octet_length(data) - 1) ELSE data END")
        files.select(F.col(name).cast("string").alias("doc_id"), body.cast("string").alias("value")).write.partitionBy("doc_id").option("lineSep", "\n").text(folder)
        return
    base = re.sub(r"^file:/+", "/", folder)
    source, make = source_of(files) if name == "doc_id" else source_of(files.select(F.col(name).cast("string").alias("doc_id"), "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for n, (doc_id, data) in enumerate(make(batch), 1):  # noqa: B007
                key = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in doc_id) if doc_id else "__HIVE_DEFAULT_PARTITION__"
                _placed(base, key, (data or b"").removesuffix(b"\n") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if os.path.exists(base):
        raise FileExistsError(base)
    source.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
