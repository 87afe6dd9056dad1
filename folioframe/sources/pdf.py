"""Page-description files as relations.

`read(spark, path)` scans files with Spark's binary reader, so any store works; each relation is one pass over them,
parsed on the executors a file at a time. A file that cannot be read at all gives one row of `doc` with its error and no
rows elsewhere. All relations carry doc_id (the path), so what belongs to a document never needs another document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioframe.functions import codecs
from folioframe.functions.glyphs import document_text
from folioframe.sources import content, interactive, metadata, usage
from folioframe.sources.pdfsyntax import STORE, Document, Ref, Stream, _edges_of, load

BATCH_ROWS = 5000
#: Pages of a file whose text is kept for its next relation.
KEPT_FOLDS = 64
#: A batch that Python hands over ends with the row that brings it to so many bytes.
BATCH_BYTES = 1 << 22
#: Stored bytes of a table that one partition of files built from it should take: rows are small against the work on
#: their files, some ms for each kB stored, so that parts are even and do not hang on the cores known when a query starts.
ROW_BYTES = 1 << 16
#: Up to so many parts take a quarter of that, as of few parts the last round would leave most cores idle.
FEW_PARTS = 256

SCHEMAS = {
    "doc": "doc_id string, error string, version string, header_offset int, rebuilt boolean, n_objects int, n_pages int, trailer string, catalog string, info string, xmp string, binary_marker boolean, size bigint, bytes_after_eof int, title string, has_lang boolean",
    "xref": "doc_id string, obj_num int, kind string, a bigint, b int, depth int",
    "xref_use": "doc_id string, rebuilt boolean, catalog_kind string, depth int",
    "obj": "doc_id string, obj_num int, kind string, type string, subtype string, body string",
    "object_text": "doc_id string, obj_num int, canon string",
    "ref_edge": "doc_id string, src int, path string, dst int",
    "reference": "doc_id string, src int, path string, dst int, kind string, type string",
    "object_use": "doc_id string, obj_num int, type string, live boolean",
    "used_font": "doc_id string, obj_num int, base_font string, subset_tag string, kind string, is_embedded boolean, has_to_unicode boolean, has_widths boolean, used_codes array<int>, pages_used_on array<int>",
    "stream": "doc_id string, obj_num int, filters array<string>, raw_length bigint, declared_length bigint, data_length bigint, error string",
    "page": "doc_id string, page_idx int, obj_num int, media_box array<double>, crop_box array<double>, rotate int, body string",
    "content_op": "doc_id string, page_idx int, seq int, op string, operands string",
    "text_fragment": "doc_id string, page_idx int, seq int, text string, x double, y double, font_name string, font_size double, width double, text_offset int, mcid int",
    "page_text": "doc_id string, page_idx int, text string",
    "annot": "doc_id string, page_idx int, ord int, subtype string, flags int, body string, obj_num int",
    "struct_node": "doc_id string, node int, parent int, ord int, type string, body string",
    "role_map": "doc_id string, src string, dst string",
    "font": "doc_id string, obj_num int, base_font string, subset_tag string, kind string, is_embedded boolean, has_to_unicode boolean, has_widths boolean",
    "embedded_file": "doc_id string, name string, mime string, relationship string, data binary",
    "output_intent": "doc_id string, ord int, subtype string, identifier string, profile_ref int, has_profile boolean",
    "xmp_prop": "doc_id string, ord int, namespace string, name string, form string, lang string, value string",
    "icc_profile": "doc_id string, obj_num int, size bigint, version string, class string, space string, pcs string, intent int, tags array<string>",
    "page_label": "doc_id string, start int, style string, prefix string, first int",
    "named_dest": "doc_id string, name string, page_idx int",
    "object_spacing": "doc_id string, obj_num int, heading_ok boolean, end_ok boolean",
    "xref_section": "doc_id string, at bigint, spacing_ok boolean",
    "code_map": "doc_id string, obj_num int, base_font string, code int, text string",
    "code_map_use": "doc_id string, obj_num int, base_font string, n_codes bigint, first int, last int, same boolean",
    "outline": "doc_id string, node int, parent int, ord int, title string",
    "live": "doc_id string, obj_num int",
    "font_body": "doc_id string, obj_num int, subtype string, base_font string, body string, flags int",
    "jp2_image": "doc_id string, obj_num int, has_space boolean, components int, depth int, bpcc boolean, specs array<struct<meth:int,approx:int,enum:bigint>>",
    "group": "doc_id string, obj_num int, space string",
    "hex_string": "doc_id string, n_odd int, n_bad int",
    "limit": "doc_id string, obj_num int, long_strings int, long_names int, big_integers int",
    "problem": "doc_id string, relation string, error string",
    **interactive.SCHEMAS,
    **usage.SCHEMAS,
}


_ENCODER = json.JSONEncoder(ensure_ascii=False)


def _json(x) -> str:
    return _ENCODER.encode(content.plain(x))


#: Keys that lead upwards, sideways or into the structure tree and pages; a resolved text leaves references there alone.
_UPWARDS = ("Parent", "P", "Kids", "K", "Pg", "ParentTree", "Contents", "StructParent", "Dest", "Popup", "Prev", "Next", "First", "Last", "Obj")


_INNER = (Ref, Stream, dict, list)


def _resolved(doc: Document, x, path: frozenset = frozenset()):
    """An object with its references followed, but where they lead back; a stream shows as its dictionary with `#stream`."""
    if x.__class__ is Ref:
        # What leads back to nothing on its way is the same from everywhere.
        whole = doc.kept.setdefault("resolved", {})
        if x.num in path:
            doc.kept["cuts"] = doc.kept.get("cuts", 0) + 1
            return content.plain(x)
        if x.num in whole:
            return whole[x.num]
        at, cuts = doc.resolve(x), doc.kept.get("cuts", 0)
        known = STORE.by_id.get(id(at))
        if known is not None and not _edges_of(at):
            if "resolved" not in known.facts:
                known.facts["resolved"] = _resolved(doc, at)
            return known.facts["resolved"]
        out = _resolved(doc, at, path | {x.num})
        if doc.kept.get("cuts", 0) == cuts:
            whole[x.num] = out
        return out
    if isinstance(x, Stream):
        return {"#stream": True} | _resolved(doc, x.dict, path)
    if isinstance(x, dict):
        return {k: _resolved(doc, v, path) if v.__class__ in _INNER else content.plain(v) for k, v in x.items() if k not in _UPWARDS or not isinstance(v, (Ref, list))}
    if isinstance(x, list):
        return [v if v.__class__ is int else _resolved(doc, v, path) for v in x]
    return content.plain(x)


def _full(doc: Document, x) -> str:
    return _ENCODER.encode(_resolved(doc, x))


def _canonical(doc: Document, x, path: frozenset = frozenset()):
    """A text that is equal for equal content: keys in order, numbers in one form, streams by their bytes' hash, and
    `...` where an object leads back to itself."""
    if isinstance(x, Ref):
        if x.num in path:
            return "..."
        path = path | {x.num}
    x = doc.resolve(x)
    if isinstance(x, Stream):
        d = {k: v for k, v in x.dict.items() if k not in ("Length", "Filter", "DecodeParms", "DL")}
        return {"#": f"{codecs.fnv1a64(x.raw):016x}", **_canonical(doc, d, path)}
    if isinstance(x, dict):
        return {k: _canonical(doc, x[k], path) for k in sorted(x) if k not in _UPWARDS}
    if isinstance(x, list):
        return [_canonical(doc, y, path) for y in x]
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.6g}"
    return content.plain(x)


def _reached(objects: dict, starts: list) -> set[int]:
    """The numbers that references lead to, dangling ones included."""
    live, todo = set(), list(starts)
    while todo:
        for _, num in _edges_of(todo.pop()):
            if num not in live:
                live.add(num)
                todo.append(objects.get(num))
    return live


def _fact(x, name: str, make: Callable):
    """What `make` gives of an object alone, worked out once of a kept one."""
    known = STORE.by_id.get(id(x))
    if known is None:
        return make(x)
    if name not in known.facts:
        known.facts[name] = make(x)
    return known.facts[name]


def _kind(x) -> str:
    for kind, types in (("bool", bool), ("number", (int, float)), ("dict", dict), ("array", list), ("stream", Stream), ("string", bytes), ("ref", Ref)):
        if isinstance(x, types):
            return kind
    return "null" if x is None else "name"


def _box(doc: Document, v) -> list[float] | None:
    v = doc.resolve(v)
    got = [doc.resolve(x) for x in v] if isinstance(v, list) else []
    return [float(x) for x in got] if len(got) == 4 and all(isinstance(x, (int, float)) for x in got) else None


def _name(x) -> str | None:
    return str(x) if isinstance(x, str) else None


def _text(x) -> str | None:
    return document_text(x) if isinstance(x, bytes) else None


def _tree(doc: Document, root, children: Callable) -> Iterator[tuple[int, int | None, int, object]]:
    """(node, parent, ord, object) in preorder; nodes are numbered as they are met, cycles are cut at references."""
    seen, count, stack = set(), 0, [(root, None, 0)]
    while stack:
        at, parent, ord_ = stack.pop()
        if isinstance(at, Ref):
            if at.num in seen:
                continue
            seen.add(at.num)
        x = doc.resolve(at)
        if not isinstance(x, dict):
            continue
        node, count = count, count + 1
        yield node, parent, ord_, x
        stack += [(k, node, i) for i, k in reversed(list(enumerate(children(x))))]


def _names(doc: Document, root) -> Iterator[tuple[bytes, object]]:
    """Leaves of a name tree."""
    for _, _, _, x in _tree(doc, root, lambda d: doc.resolve(d.get("Kids")) or []):
        pairs = doc.resolve(x.get("Names")) or []
        yield from zip(pairs[::2], pairs[1::2])


def _wanted(doc: Document, name: str, column: str) -> bool:
    """Whether a column that is long to make is asked for."""
    columns = doc.kept.get("columns", {}).get(name)
    return columns is None or column in columns


def _objects(doc_id: str, doc: Document):
    body = _wanted(doc, "obj", "body")
    for num, x in sorted(doc.objects.items()):
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        yield doc_id, num, _kind(x), _name(doc.resolve(d.get("Type"))), _name(doc.resolve(d.get("Subtype"))), _fact(x, "json", _json) if body else None


def _references(doc_id: str, doc: Document):
    """Each reference with the kind and type of its object, null where it dangles; none leaves a file."""
    facts: dict[int, tuple] = {}
    for src, x in [(0, doc.trailer), *sorted(doc.objects.items())]:
        for path, dst in _edges_of(x):
            if dst not in facts:
                to = doc.objects.get(dst)
                d = to.dict if isinstance(to, Stream) else to if isinstance(to, dict) else {}
                facts[dst] = (_kind(to), _name(doc.resolve(d.get("Type")))) if dst in doc.objects else (None, None)
            yield (doc_id, src, path, dst, *facts[dst])


def _object_uses(doc_id: str, doc: Document):
    """Objects and whether the trailer reaches them."""
    live = _reached(doc.objects, [doc.trailer])
    for num, x in sorted(doc.objects.items()):
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        yield doc_id, num, _name(doc.resolve(d.get("Type"))), num in live


def _used_fonts(doc_id: str, doc: Document):
    """Fonts with the codes that pages show in them and the pages that do, both sorted; empty where none does."""
    used: dict[int, tuple[set, set]] = {}
    try:
        for _, page, num, _, codes, _, _ in usage.font_uses(doc_id, doc):
            if num is not None and codes:
                held = used.setdefault(num, (set(), set()))
                held[0].update(codes)
                held[1].add(page)
    finally:
        # An error ends the uses, as it ends font_use; the fonts are there with those before it.
        for row in _fonts(doc_id, doc):
            codes, pages = used.get(row[1], ((), ()))
            yield (*row, sorted(codes), sorted(pages))


def _object_texts(doc_id: str, doc: Document):
    for num, x in sorted(doc.objects.items()):
        yield doc_id, num, _ENCODER.encode(_canonical(doc, x))


def _streams(doc_id: str, doc: Document):
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, Stream):
            names, size, error = [], None, None
            try:
                names = x.filters(doc.resolve)[0]
                size = len(x.data(doc.resolve))
            except Exception as e:  # noqa: BLE001 a damaged stream is a row with its error
                error = f"{type(e).__name__}: {e}"
            length = doc.resolve(x.dict.get("Length"))
            yield doc_id, num, names, len(x.raw), length if isinstance(length, int) else None, size, error


def _pages(doc_id: str, doc: Document):
    for i, (num, p) in enumerate(doc.pages()):
        r = doc.resolve(p.get("Rotate"))
        yield doc_id, i, num, _box(doc, p.get("MediaBox")), _box(doc, p.get("CropBox")), r if isinstance(r, int) else None, _full(doc, p) if _wanted(doc, "page", "body") else None


def _ops(doc_id: str, doc: Document):
    for i, (_, p) in enumerate(doc.pages()):
        for seq, (op, v) in enumerate(content.operators(doc.content(p))):
            yield doc_id, i, seq, op, _json(v)


def _fold(doc: Document, at: int, page: dict) -> content.TextFold:
    """The text of a page, made once for all relations that are read from it; of many pages, made anew."""
    folds = doc.kept.setdefault("folds", {})
    found = folds.get(at) or content.page_text(doc, page)
    if len(folds) < KEPT_FOLDS:
        folds[at] = found
    return found


def _fragments(doc_id: str, doc: Document):
    for i, (_, p) in enumerate(doc.pages()):
        for seq, f in enumerate(_fold(doc, i, p).fragments):
            yield (doc_id, i, seq, *f)


def _texts(doc_id: str, doc: Document):
    for i, (_, p) in enumerate(doc.pages()):
        yield doc_id, i, _fold(doc, i, p).text


def _annots(doc_id: str, doc: Document):
    for i, (_, p) in enumerate(doc.pages()):
        for k, a in enumerate(doc.resolve(p.get("Annots")) or []):
            d = doc.resolve(a)
            if isinstance(d, dict):
                f = doc.resolve(d.get("F"))
                yield doc_id, i, k, _name(doc.resolve(d.get("Subtype"))), f if isinstance(f, int) else None, _full(doc, d), a.num if isinstance(a, Ref) else None


def _elements(doc: Document) -> Callable:
    def kids(d: dict) -> list:
        k = doc.resolve(d.get("K"))
        return [x for x in (k if isinstance(k, list) else [d.get("K")]) if isinstance(y := doc.resolve(x), dict) and ("S" in y or y.get("Type") == "StructElem")]

    return kids


def _structure(doc_id: str, doc: Document):
    for node, parent, ord_, x in _tree(doc, doc.catalog.get("StructTreeRoot"), _elements(doc)):
        yield doc_id, node, parent, ord_, _name(doc.resolve(x.get("S"))), _full(doc, {k: v for k, v in x.items() if k != "K"})


def _roles(doc_id: str, doc: Document):
    for k, v in (doc.get(doc.catalog, "StructTreeRoot", "RoleMap") or {}).items():
        yield doc_id, k, _name(doc.resolve(v))


def _fonts(doc_id: str, doc: Document):
    inner = {r.num for x in doc.objects.values() if isinstance(x, dict) and isinstance(doc.resolve(x.get("DescendantFonts")), list) for r in doc.resolve(x["DescendantFonts"]) if isinstance(r, Ref)}
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, dict) and doc.resolve(x.get("Type")) == "Font" and num not in inner:
            own = x
            down = doc.resolve(x.get("DescendantFonts"))
            if isinstance(down, list) and down and isinstance(doc.resolve(down[0]), dict):
                own = doc.resolve(down[0])
            base = _name(doc.resolve(x.get("BaseFont"))) or ""
            descriptor = doc.get(own, "FontDescriptor") or {}
            embedded = any(doc.get(descriptor, k) is not None for k in ("FontFile", "FontFile2", "FontFile3"))
            tag = base[:6] if len(base) > 7 and base[6] == "+" and base[:6].isascii() and base[:6].isalpha() and base[:6].isupper() else None
            yield doc_id, num, base, tag, _name(doc.resolve(x.get("Subtype"))), embedded, "ToUnicode" in x, "Widths" in x or "W" in own


def _embedded(doc_id: str, doc: Document):
    seen = set()
    specs = [(n, s) for n, s in _names(doc, doc.get(doc.catalog, "Names", "EmbeddedFiles"))]
    specs += [(b"", s) for s in doc.resolve(doc.catalog.get("AF")) or []]
    for name, spec in specs:
        if isinstance(spec, Ref) and spec.num in seen:
            continue
        if isinstance(spec, Ref):
            seen.add(spec.num)
        s = doc.get(spec, "EF", "UF") or doc.get(spec, "EF", "F")
        if isinstance(s, Stream):
            title = _text(doc.get(spec, "UF")) or _text(doc.get(spec, "F")) or _text(name)
            yield doc_id, title, _name(doc.resolve(s.dict.get("Subtype"))), _name(doc.get(spec, "AFRelationship")), s.data(doc.resolve)


def _intents(doc_id: str, doc: Document):
    for i, x in enumerate(doc.resolve(doc.catalog.get("OutputIntents")) or []):
        d = doc.resolve(x)
        if isinstance(d, dict):
            p = d.get("DestOutputProfile")
            yield doc_id, i, _name(doc.resolve(d.get("S"))), _text(doc.resolve(d.get("OutputConditionIdentifier"))), p.num if isinstance(p, Ref) else None, isinstance(doc.resolve(p), Stream)


def _outlines(doc_id: str, doc: Document):
    def kids(d: dict) -> list:
        out, at, seen = [], d.get("First"), set()
        while at is not None and isinstance(doc.resolve(at), dict) and id(doc.resolve(at)) not in seen:
            seen.add(id(doc.resolve(at)))
            out.append(at)
            at = doc.resolve(at).get("Next")
        return out

    for node, parent, ord_, x in _tree(doc, doc.catalog.get("Outlines"), kids):
        if parent is not None:
            yield doc_id, node, parent, ord_, _text(doc.resolve(x.get("Title")))


def _spacing(doc_id: str, doc: Document):
    """How objects stand in the file, in the order of their offsets."""
    heading = re.compile(rb"(?<=[\r\n])\d+ \d+ obj(?:\r\n|\r|\n)")
    end = re.compile(rb"(?:\r\n|\r|\n)endobj(?:\r\n|\r|\n)")
    for num, e in sorted(doc.xref.items(), key=lambda x: (x[1].a, x[0])):
        if e.kind == "used" and num in doc.objects:
            at = e.a + doc.header_offset
            stop = doc.data.find(b"endobj", at)
            good = stop >= 0 and end.match(doc.data, stop - (2 if doc.data[stop - 2 : stop] == b"\r\n" else 1))
            yield doc_id, num, bool(heading.match(doc.data, at)), bool(good)


def _sections(doc_id: str, doc: Document):
    """Classic cross-reference tables: one line end after the keyword, one space inside a heading and a line end after."""
    for m in re.finditer(rb"(?<![a-z])xref(?=[ \t\r\n\x00\f])", doc.data):
        yield doc_id, m.start(), bool(re.match(rb"xref(?:\r\n|\r|\n)\d+ \d+(?:\r\n|\r|\n)", doc.data[m.start() : m.start() + 64]))


def _codes(doc_id: str, doc: Document):
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, dict) and doc.resolve(x.get("Type")) == "Font":
            m = doc.get(x, "ToUnicode")
            if isinstance(m, Stream):
                for code, text in sorted(content.to_unicode(m.data(doc.resolve)).items()):
                    yield doc_id, num, _name(doc.resolve(x.get("BaseFont"))), code, text


def _code_uses(doc_id: str, doc: Document):
    """Fonts with a mapping: how many codes it has, from where to where, and whether each stands for its own character."""
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, dict) and doc.resolve(x.get("Type")) == "Font":
            m = doc.get(x, "ToUnicode")
            if isinstance(m, Stream) and (span := content.map_span(m.data(doc.resolve))):
                yield (doc_id, num, _name(doc.resolve(x.get("BaseFont"))), *span)


def _xref_uses(doc_id: str, doc: Document):
    """How the catalog is entered and how many updates back entries go."""
    if doc.xref:
        root = doc.trailer.get("Root")
        own = doc.xref.get(root.num) if isinstance(root, Ref) else None
        yield doc_id, doc.rebuilt, own.kind if own else None, max(e.depth for e in doc.xref.values())


def _xmp(doc_id: str, doc: Document):
    m = doc.get(doc.catalog, "Metadata")
    if isinstance(m, Stream):
        for row in metadata.xmp_properties(m.data(doc.resolve).decode("utf-8", "replace")):
            yield (doc_id, *row)


def _profiles(doc_id: str, doc: Document):
    intents = {row[4] for row in _intents(doc_id, doc)}
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, Stream) and (isinstance(doc.resolve(x.dict.get("N")), int) or num in intents) and x.dict.get("Type") != "ObjStm":
            head = metadata.profile_header(x.data(doc.resolve))
            if head:
                yield (doc_id, num, *head)


def _labels(doc_id: str, doc: Document):
    for _, _, _, x in _tree(doc, doc.catalog.get("PageLabels"), lambda d: doc.resolve(d.get("Kids")) or []):
        nums = doc.resolve(x.get("Nums")) or []
        for start, v in zip(nums[::2], nums[1::2]):
            d = doc.resolve(v)
            if isinstance(start, int) and isinstance(d, dict):
                first = doc.resolve(d.get("St"))
                yield doc_id, start, _name(doc.resolve(d.get("S"))), _text(doc.resolve(d.get("P"))), first if isinstance(first, int) else None


def _destinations(doc_id: str, doc: Document):
    index = {num: i for i, (num, _) in enumerate(doc.pages())}
    old = doc.get(doc.catalog, "Dests") or {}
    pairs = [(k, v) for k, v in old.items()] + [(_text(doc.resolve(k)), v) for k, v in _names(doc, doc.get(doc.catalog, "Names", "Dests"))]
    for name, v in pairs:
        d = doc.resolve(v)
        d = doc.resolve(d.get("D")) if isinstance(d, dict) else d
        page = d[0] if isinstance(d, list) and d else None
        yield doc_id, name, index.get(page.num) if isinstance(page, Ref) else None


def _live(doc_id: str, doc: Document):
    """Object numbers reachable from the trailer, dangling ones included."""
    yield from ((doc_id, num) for num in sorted(_reached(doc.objects, [doc.trailer])))


_STRINGS = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|%[^\r\n]*|<<|>>|<([^<>]*)>", re.S)


def _hex_strings(doc_id: str, doc: Document):
    """Hexadecimal strings of objects and page content with an odd number of digits, or with other characters."""
    texts = []
    for num, e in sorted(doc.xref.items()):
        if e.kind == "used" and num in doc.objects:
            at = e.a + doc.header_offset
            stop = min((x for x in (doc.data.find(b"endobj", at), doc.data.find(b"stream", at)) if x >= 0), default=len(doc.data))
            texts.append(doc.data[at:stop])
    texts += [doc.content(p) for _, p in doc.pages()]
    odd = bad = 0
    for t in texts:
        for m in _STRINGS.finditer(t):
            if m[1] is not None:
                bare = re.sub(rb"[ \t\r\n\f\x00]", b"", m[1])
                odd += len(bare) % 2
                bad += bool(re.search(rb"[^0-9A-Fa-f]", bare))
    yield doc_id, odd, bad


def _limits(doc_id: str, doc: Document):
    """Objects with strings of over 32767 bytes, names of over 127, or integers of over 32 bits."""

    def values(x):
        if isinstance(x, (dict, Stream)):
            for k, v in (x.dict if isinstance(x, Stream) else x).items():
                yield k if isinstance(k, str) else str(k)
                yield from values(v)
        elif isinstance(x, list):
            for v in x:
                yield from values(v)
        else:
            yield x

    for num, x in sorted(doc.objects.items()):
        found = list(values(x))
        got = sum(isinstance(v, bytes) and len(v) > 32767 for v in found), sum(isinstance(v, str) and len(v.encode("latin-1", "replace")) > 127 for v in found), sum(isinstance(v, int) and not isinstance(v, bool) and not -(2**31) <= v < 2**31 for v in found)
        if any(got):
            yield (doc_id, num, *got)


def _font_bodies(doc_id: str, doc: Document):
    """Fonts with their references followed, and their descriptor's flags."""
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, dict) and doc.resolve(x.get("Type")) == "Font":
            flags = doc.get(x, "FontDescriptor", "Flags")
            yield doc_id, num, _name(doc.resolve(x.get("Subtype"))), _name(doc.resolve(x.get("BaseFont"))), _full(doc, {k: v for k, v in x.items() if k not in ("Widths", "CharProcs", "Resources")}), flags if isinstance(flags, int) else None


def _jp2(doc_id: str, doc: Document):
    """What the boxes of JPEG 2000 images declare; images whose boxes cannot be read have no row."""
    for num, x in sorted(doc.objects.items()):
        if isinstance(x, Stream) and x.dict.get("Subtype") == "Image" and "JPXDecode" in x.filters(doc.resolve)[0]:
            found = metadata.jp2_header(x.raw)
            if found:
                yield (doc_id, num, "ColorSpace" in x.dict, *found)


def _groups(doc_id: str, doc: Document):
    """Transparency groups with an explicit blending space (its name, or its array's first)."""
    for num, x in sorted(doc.objects.items()):
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        g = doc.resolve(d.get("Group"))
        if isinstance(g, dict) and doc.resolve(g.get("S")) == "Transparency" and "CS" in g:
            space = doc.resolve(g["CS"])
            yield doc_id, num, _name(doc.resolve(space[0]) if isinstance(space, list) and space else space)


READERS: dict[str, Callable] = {
    "font_body": _font_bodies,
    "jp2_image": _jp2,
    "group": _groups,
    "xref": lambda i, d: ((i, n, e.kind, e.a, e.b, e.depth) for n, e in sorted(d.xref.items())),
    "xref_use": _xref_uses,
    "obj": _objects,
    "reference": _references,
    "object_use": _object_uses,
    "used_font": _used_fonts,
    "object_text": _object_texts,
    "ref_edge": lambda i, d: ((i, n, p, t) for n, x in [(0, d.trailer), *sorted(d.objects.items())] for p, t in _edges_of(x)),
    "stream": _streams,
    "page": _pages,
    "content_op": _ops,
    "text_fragment": _fragments,
    "page_text": _texts,
    "annot": _annots,
    "struct_node": _structure,
    "role_map": _roles,
    "font": _fonts,
    "embedded_file": _embedded,
    "output_intent": _intents,
    "outline": _outlines,
    "object_spacing": _spacing,
    "xref_section": _sections,
    "code_map": _codes,
    "code_map_use": _code_uses,
    "xmp_prop": _xmp,
    "icc_profile": _profiles,
    "page_label": _labels,
    "named_dest": _destinations,
    "live": _live,
    "hex_string": _hex_strings,
    "limit": _limits,
    "form_field": interactive.fields,
    "action": interactive.actions,
    "layer": interactive.layers,
    "layered": interactive.layered,
    "layer_use": interactive.layer_uses,
    "page_image": interactive.images,
    "colorant": interactive.colorants(_canonical),
    "resource_use": interactive.resources,
    "object_ref": interactive.object_refs(_tree, _elements),
    "content_item": interactive.content_items(_tree, _elements),
    "page_use": usage.page_uses,
    "font_use": usage.font_uses,
    "do_edge": usage.do_edges,
}


def _problems(doc_id: str, doc: Document):
    """Relations that a damaged file breaks off, with their errors; they hold the rows before it."""
    for name, reader in READERS.items():
        try:
            for _ in reader(doc_id, doc):
                pass
        except Exception as e:  # noqa: BLE001 any error of a reader is a row
            yield doc_id, name, f"{type(e).__name__}: {e}"


def _rows(name: str, doc_id: str, data: bytes, doc: Document | None, error: str | None, problems: list | None = None) -> Iterator[tuple]:
    """The rows of one relation of one file. A reader's error ends them; `problem` tells, and so does the list if given."""
    if name == "doc":
        yield _describe(doc_id, data, doc, error)
    elif name == "form_use":
        yield doc_id, interactive.field_count(doc_id, doc) if doc is not None else 0
    elif doc is not None:
        try:
            yield from (_problems if name == "problem" else READERS[name])(doc_id, doc)
        except Exception as e:  # noqa: BLE001 the relation `problem` has it
            if problems is not None:
                problems.append((doc_id, name, f"{type(e).__name__}: {e}"))


def _describe(doc_id: str, data: bytes, doc: Document | None, error: str | None) -> tuple:
    end = data.rfind(b"%%EOF")
    after = len(data) - end - 5 if end >= 0 else None
    if after is not None and data[end + 5 :] in (b"\n", b"\r", b"\r\n"):
        after = 0
    if doc is None:
        return doc_id, error, *[None] * 10, len(data), after, None, False
    second = re.match(rb"%PDF-\d\.\d[ \t]*(?:\r\n|\r|\n)%([^\r\n]*)", data[doc.header_offset : doc.header_offset + 200])
    marker = bool(second) and len(second[1]) >= 4 and all(b > 127 for b in second[1][:4])
    m = doc.get(doc.catalog, "Metadata") if _wanted(doc, "doc", "xmp") else None
    xmp = m.data(doc.resolve).decode("utf-8", "replace") if isinstance(m, Stream) else None
    trailer = _json(doc.trailer) if _wanted(doc, "doc", "trailer") else None
    catalog = _full(doc, doc.catalog) if _wanted(doc, "doc", "catalog") else None
    info = _full(doc, doc.trailer.get("Info")) if _wanted(doc, "doc", "info") else None
    title, lang = _text(doc.get(doc.trailer, "Info", "Title")), doc.get(doc.catalog, "Lang")
    return doc_id, None, doc.version, doc.header_offset, doc.rebuilt, len(doc.objects), len(doc.pages()), trailer, catalog, info, xmp, marker, len(data), after, title, lang is not None


#: Relations whose readers follow references from the catalog without recursion, so that objects they do not meet need not
#: be read and those they meet are read from a shallow stack.
FOLLOWED = {"embedded_file", "output_intent", "outline", "role_map", "page_label", "xmp_prop", "named_dest", "content_op"}


def _parsed(doc_id: str, data: bytes, password: bytes, lazy: bool = False) -> tuple[Document | None, str | None]:
    try:
        return load(data, password, lazy), None
    except Exception as e:  # noqa: BLE001 an unreadable file is a row of doc
        return None, f"{type(e).__name__}: {e}"


def parts_of(df: DataFrame) -> int:
    """Partitions for files built from a table, by the size of what is scanned; 1 where Catalyst does not know it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 if size >= 1 << 60 else max(1, -(-size // ROW_BYTES), min(FEW_PARTS, -(-4 * size // ROW_BYTES)))


Pairs = Iterator[tuple[str | None, bytes | None]]


def _pairs(batch: pa.RecordBatch) -> Pairs:
    for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
        yield doc_id.as_py(), data.as_py()


def made_files(rows: DataFrame, make: Callable[[pa.RecordBatch], Pairs]) -> DataFrame:
    """doc_id, data: what `make` gives for batches of rows, a few MB at once. The frame keeps both, so that rewriting and
    parsing can follow in the same pass and files need not go back to the JVM between steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, data in make(batch):
                held.append((doc_id, data))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield _files(held)
                    held, size = [], 0
            if held:
                yield _files(held)
                held, size = [], 0

    files = rows.mapInArrow(run, "doc_id string, data binary")
    files.made_from = (rows, make)
    return files


def _files(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], names=["doc_id", "data"])


def source_of(files: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], Pairs]]:
    """The rows that files come from and what makes them in Python: what they were made of, or the files themselves."""
    return getattr(files, "made_from", None) or (files.select("doc_id", "data"), _pairs)


def _sized(row: tuple) -> int:
    """About the bytes of a row that vary."""
    return 64 + sum(len(v) for v in row if v.__class__ is str or v.__class__ is bytes)


class Relations:
    """Lazy relations over files of (doc_id, data). Each is a pass over the files of its own; `together` gives them all
    from one pass."""

    def __init__(self, files: DataFrame, password: bytes = b"", columns: dict[str, tuple] | None = None):
        self.files, self.password, self.columns = files, password, columns or {}
        self._made: dict[str, DataFrame] = {}
        #: What rules derive from these relations and share.
        self.shared: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._relation(name)
        return self._made[name]

    def of(self, **columns: tuple) -> Relations:
        """The same relations, some of them with these columns alone; others are not made. An error that making a left
        out column would have met ends nothing then."""
        return Relations(self.files, self.password, self.columns | columns)

    def _schema(self, name: str) -> tuple[T.StructType, list[int] | None]:
        """A relation's columns, and which of a reader's they are where some are left out."""
        whole, columns = T.StructType.fromDDL(SCHEMAS[name]), self.columns.get(name)
        if columns is None:
            return whole, None
        return T.StructType([whole[c] for c in columns]), [whole.names.index(c) for c in columns]

    def _relation(self, name: str) -> DataFrame:
        schema, picks = self._schema(name)
        arrow, password, columns = to_arrow_schema(schema), self.password, self.columns

        source, make = source_of(self.files)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for batch in batches:
                for doc_id, data in make(batch):
                    data = data or b""
                    doc, error = _parsed(doc_id, data, password, name in FOLLOWED)
                    if doc is not None:
                        doc.kept["columns"] = columns
                    for row in _rows(name, doc_id, data, doc, error):
                        row = row if picks is None else tuple(row[i] for i in picks)
                        rows.append(row)
                        size += _sized(row)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows, arrow)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, arrow)
                    rows, size = [], 0

        return source.mapInArrow(run, schema)

    def together(self, names: list[str] | None = None) -> Relations:
        """The same relations read from one table that a single parse of each file writes: a row has the relation's name,
        by which the table is partitioned, and its columns in a struct; other structs are null and never read."""
        from folioframe.plans.runtime import written

        names = list(names or SCHEMAS)
        readers = [n for n in names if n != "problem"]
        schema = T.StructType([T.StructField("rel", T.StringType())] + [T.StructField(n, self._schema(n)[0]) for n in names])
        arrow, password, columns = to_arrow_schema(schema), self.password, self.columns
        picks = {n: self._schema(n)[1] for n in names}

        def packed(name: str, rows: list[tuple]) -> pa.RecordBatch:
            kind = arrow.field(name).type
            held = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], fields=list(kind))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *[held if n == name else pa.nulls(len(rows), arrow.field(n).type) for n in names]], schema=arrow)

        source, make = source_of(self.files)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: dict[str, list[tuple]] = {n: [] for n in names}
            sizes = dict.fromkeys(names, 0)
            for batch in batches:
                for doc_id, data in make(batch):
                    data = data or b""
                    doc, error = _parsed(doc_id, data, password, FOLLOWED.issuperset(names))
                    if doc is not None:
                        doc.kept["columns"] = columns
                    for name in readers:
                        for row in _rows(name, doc_id, data, doc, error, rows.get("problem")):
                            row = row if picks[name] is None else tuple(row[i] for i in picks[name])
                            rows[name].append(row)
                            sizes[name] += _sized(row)
                            if len(rows[name]) >= BATCH_ROWS or sizes[name] >= BATCH_BYTES:
                                yield packed(name, rows[name])
                                rows[name], sizes[name] = [], 0
            for name in names:
                if rows[name]:
                    yield packed(name, rows[name])

        table = written(source.mapInArrow(run, schema), by="rel")
        made = Relations(self.files, self.password, self.columns)
        made._made = {n: table.where(F.col("rel") == n).select(f"{n}.*") for n in names}
        return made

    def document_text(self, separator: str = "\n\n") -> DataFrame:
        """doc_id and the texts of its pages in order; blank pages are skipped."""
        pages = self.page_text.where(F.trim("text") != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", "text"))).alias("p"))
        return pages.select("doc_id", F.concat_ws(separator, F.col("p.text")).alias("text"))

    def live_objects(self) -> DataFrame:
        """(doc_id, obj_num) reachable from the trailer, dangling numbers included; edges never leave a file, so each is
        walked where it is parsed."""
        return self.live

    def referenced(self) -> DataFrame:
        """Each reference with the kind and type of its object, null where it dangles; looked up where its file is parsed."""
        return self.reference

    def mcid_text(self) -> DataFrame:
        """doc_id, page_idx, mcid, text: a marked sequence's fragments in order of their places in the page's text, joined
        by a line end where the text between them has one and else by a space, if anything lies between them."""
        w = Window.partitionBy("doc_id", "page_idx", "mcid").orderBy("text_offset", "seq")
        parts = self.text_fragment.where("mcid IS NOT NULL").join(self.page_text.withColumnRenamed("text", "whole"), ["doc_id", "page_idx"])
        end = F.lag(F.col("text_offset") + F.char_length("text")).over(w)
        gap = F.substr("whole", end + 1, F.col("text_offset") - end)
        parts = parts.withColumn("piece", F.concat(F.when(F.col("text_offset") > end, F.when(F.contains(gap, F.lit("\n")), "\n").otherwise(" ")).otherwise(""), F.col("text")))
        found = parts.groupBy("doc_id", "page_idx", "mcid").agg(F.array_sort(F.collect_list(F.struct("text_offset", "seq", "piece"))).alias("p"))
        return found.select("doc_id", "page_idx", "mcid", F.trim(F.array_join("p.piece", "")).alias("text"))

    def tag_tree(self) -> DataFrame:
        """doc_id, node, parent, ord, type and the text of the node's own marked content, in order, joined by spaces."""
        held = self.content_item.join(self.mcid_text(), ["doc_id", "page_idx", "mcid"]).where("text <> ''")
        held = held.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p")).select("doc_id", "node", F.array_join("p.text", " ").alias("text"))
        return self.struct_node.select("doc_id", "node", "parent", "ord", "type").join(held, ["doc_id", "node"], "left").withColumn("text", F.coalesce("text", F.lit("")))

    def font_inventory(self) -> DataFrame:
        """Fonts with the codes that pages show in them and the pages that do, both sorted; empty where none does. Brought
        together where their file is parsed."""
        return self.used_font

    def annotation_parents(self) -> DataFrame:
        """doc_id, obj_num, node: the structure element that encloses an object by an object reference; the last counts."""
        return self.object_ref.groupBy("doc_id", "obj_num").agg(F.max("node").alias("node"))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


def read(spark: SparkSession, path: str, glob: str = "*.pdf", password: bytes = b"") -> Relations:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return Relations(files.select(F.col("path").alias("doc_id"), F.col("content").alias("data")), password)


def optimised(files: DataFrame) -> DataFrame:
    """doc_id, data: rewritten without unreachable objects and with unfiltered streams deflated where that is smaller."""
    import zlib

    from folioframe.sources.pdfsyntax import Name, serialise

    def shrink(data: bytes) -> bytes:
        doc = load(data)
        if "Encrypt" in doc.trailer:
            raise ValueError("an encrypted file cannot be rewritten")
        live, out = _reached(doc.objects, [doc.trailer.get("Root"), doc.trailer.get("Info")]), {}
        for num in live & set(doc.objects):
            x = doc.objects[num]
            if isinstance(x, Stream) and "Filter" not in x.dict and len(z := zlib.compress(x.raw, 9)) < len(x.raw):
                x = Stream({k: v for k, v in x.dict.items() if k != "DecodeParms"} | {"Filter": Name("FlateDecode")}, z)
            out[num] = x
        return serialise(out, doc.trailer, doc.version)

    return remade(files, shrink)


def _with_pages(doc: Document, keep: list[dict], turn: int = 0) -> bytes:
    """The file with the given pages only, each with its inherited attributes, under one flat page tree."""
    from folioframe.sources.pdfsyntax import Name, serialise

    objs, kids = dict(doc.objects), []
    root = doc.trailer["Root"].num
    tree = max(objs, default=0) + 1
    for i, page in enumerate(keep):
        rotate = doc.resolve(page.get("Rotate"))
        objs[tree + 1 + i] = page | {"Parent": Ref(tree), "Rotate": ((rotate if isinstance(rotate, int) else 0) + turn) % 360}
        kids.append(Ref(tree + 1 + i))
    objs[tree] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    objs[root] = doc.catalog | {"Pages": Ref(tree)}
    live = _reached(objs, [doc.trailer.get("Root"), doc.trailer.get("Info")])
    return serialise({n: objs[n] for n in live if n in objs}, doc.trailer, doc.version)


def remade(files: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, data: each file changed, in the same pass that makes it."""
    rows, make = source_of(files)
    return made_files(rows, lambda batch: ((doc_id, change(data)) for doc_id, data in make(batch)))


def _rewritten(files: DataFrame, change: Callable[[Document], bytes]) -> DataFrame:
    return remade(files, lambda data: change(load(data)))


def extracted(files: DataFrame, start: int, count: int) -> DataFrame:
    """Files of pages start .. start + count - 1 alone."""
    return _rewritten(files, lambda doc: _with_pages(doc, [p for _, p in doc.pages()][start : start + count]))


def rotated(files: DataFrame, degrees: int) -> DataFrame:
    """Files whose pages are turned further by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("pages turn by multiples of 90 degrees")
    return _rewritten(files, lambda doc: _with_pages(doc, [p for _, p in doc.pages()], degrees))


def merged(files: DataFrame, group: str, order: str) -> DataFrame:
    """One file a group with the pages of its files in order. files: group, order, doc_id, data. Objects of later files
    get numbers above those of earlier ones. A group's files meet in one task, as their one output does."""

    def shift(x, by: int):
        if isinstance(x, Ref):
            return Ref(x.num + by, x.gen)
        if isinstance(x, Stream):
            return Stream(shift(x.dict, by), x.raw)
        if isinstance(x, dict):
            return {k: shift(v, by) for k, v in x.items()}
        return [shift(v, by) for v in x] if isinstance(x, list) else x

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending"), ("doc_id", "ascending")])
        whole, pages, by = None, [], 0
        for data in table.column("data"):
            doc = load(data.as_py())
            own, most = [p for _, p in doc.pages()], max(doc.objects, default=0)
            if whole is None:
                whole, pages = doc, own
            else:
                # Of later files only what their pages lead to is kept; the page tree above them is not.
                live = _reached(doc.objects, [{k: v for k, v in p.items() if k != "Parent"} for p in own])
                pages += [shift(p, by) for p in own]
                whole.objects.update({n + by: shift(doc.objects[n], by) for n in live if n in doc.objects})
            by += most
        out = _with_pages(whole, pages)
        return pa.table({"doc_id": [str(table.column(group)[0].as_py())], "data": pa.array([out], pa.binary())})

    return files.groupBy(group).applyInArrow(join, "doc_id string, data binary")


def from_texts(df: DataFrame, key: str = "doc_id", text: str = "text", lines_a_page: int = 60, size: float = 10.0) -> DataFrame:
    """doc_id, data: a file for each text, a line of text a line of the page; null counts as empty."""
    from folioframe.sources.pdfsyntax import Name, serialise, written

    def build(text: str) -> bytes:
        lines = text.split("\n")
        objs: dict = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [], "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3)}}}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}
        for at in range(0, len(lines), lines_a_page):
            num = len(objs) + 1
            shown = b"".join((written(b"\xfe\xff" + x.encode("utf-16-be")) + b" Tj T*\n") if x else b"T*\n" for x in lines[at : at + lines_a_page])
            objs[num] = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(num + 1)}
            objs[num + 1] = Stream({}, b"BT /F1 %g Tf %g TL 50 742 Td\n" % (size, 1.2 * size) + shown + b"ET")
            objs[2]["Kids"].append(Ref(num))
        objs[2]["Count"] = len(objs[2]["Kids"])
        return serialise(objs, {"Root": Ref(1)})

    return made_files(df.select(F.col(key).cast("string").alias("doc_id"), text), lambda batch: ((doc_id, build(x or "")) for doc_id, x in _pairs(batch)))
