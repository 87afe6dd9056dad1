"""Readers of what users act on: form fields, actions, layers; and images, colorants and resources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from folioframe.functions.glyphs import document_text
from folioframe.sources import content
from folioframe.sources.pdfsyntax import Document, Ref, Stream

SCHEMAS = {
    "form_field": "doc_id string, node int, parent int, full_name string, name string, type string, value string, flags int, is_terminal boolean, has_aa boolean, tu string, lang string",
    "action": "doc_id string, origin string, ord int, depth int, obj_num int, s string, n string",
    "layer": "doc_id string, obj_num int, name string, visible boolean",
    "layer_use": "doc_id string, obj_num int, name string, visible boolean, annots array<boolean>",
    "form_use": "doc_id string, n_fields bigint",
    "layered": "doc_id string, page_idx int, kind string, ord int, visible boolean",
    "page_image": "doc_id string, page_idx int, name string, obj_num int, width int, height int, bits int, space string, filters array<string>, n_bytes bigint",
    "colorant": "doc_id string, obj_num int, kind string, name string, alternate string, tint string, in_colorants boolean, nchannel boolean",
    "resource_use": "doc_id string, page_idx int, owner int, category string, name string, obj_num int",
    "object_ref": "doc_id string, node int, obj_num int",
    "content_item": "doc_id string, node int, page_idx int, mcid int, ord int",
}
PROCESS = ("Cyan", "Magenta", "Yellow", "Black")


def _name(x) -> str | None:
    return str(x) if isinstance(x, str) else None


def _text(x) -> str | None:
    return document_text(x) if isinstance(x, bytes) else None


def _dict(doc: Document, x) -> dict:
    x = doc.resolve(x)
    return x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}


def _list(doc: Document, x) -> list:
    x = doc.resolve(x)
    return x if isinstance(x, list) else []


def fields(doc_id: str, doc: Document) -> Iterator[tuple]:
    """Fields in preorder. Type, value and flags are inherited; kids without a name of their own are widgets of their
    parent; names join by dots."""
    stack = [(k, None, "", {}, frozenset()) for k in reversed(_list(doc, doc.get(doc.catalog, "AcroForm", "Fields")))]
    count = 0
    while stack:
        ref, parent, prefix, above, path = stack.pop()
        d = _dict(doc, ref)
        if not d or (isinstance(ref, Ref) and ref.num in path):
            continue
        name = _text(doc.resolve(d.get("T")))
        if name is None and parent is not None:
            continue
        full = f"{prefix}.{name}" if prefix and name else prefix or name or ""
        got = above | {k: doc.resolve(d[k]) for k in ("FT", "V", "Ff") if k in d}
        kids = [k for k in _list(doc, d.get("Kids")) if "T" in _dict(doc, k)]
        value = got.get("V")
        node, count = count, count + 1
        flags = got.get("Ff")
        shown = _text(value) if isinstance(value, bytes) else _name(value) if isinstance(value, str) else None if value is None else json.dumps(content.plain(value))
        yield doc_id, node, parent, full, name, _name(got.get("FT")), shown, flags if isinstance(flags, int) else None, not kids, "AA" in d, _text(doc.resolve(d.get("TU"))), _text(doc.resolve(d.get("Lang")))
        path = path | {ref.num} if isinstance(ref, Ref) else path
        stack += [(k, node, full, got, path) for k in reversed(kids)]


def _chain(doc: Document, start) -> Iterator[tuple[int, int | None, dict]]:
    """(depth, number, action) of an action and those after it, each once."""
    seen, todo = set(), [(start, 0)]
    while todo:
        at, depth = todo.pop(0)
        if isinstance(at, Ref):
            if at.num in seen:
                continue
            seen.add(at.num)
        d = _dict(doc, at)
        if not d:
            continue
        yield depth, at.num if isinstance(at, Ref) else None, d
        after = doc.resolve(d.get("Next"))
        todo += [(x, depth + 1) for x in (after if isinstance(after, list) else [d["Next"]] if isinstance(after, dict) else [])]


def actions(doc_id: str, doc: Document) -> Iterator[tuple]:
    """All actions with those that follow them, by where they start."""
    starts: list[tuple[str, object]] = [("open", doc.catalog.get("OpenAction"))]
    starts += [(f"document:{k}", v) for k, v in _dict(doc, doc.catalog.get("AA")).items()]
    for i, (_, p) in enumerate(doc.pages()):
        starts += [(f"page{i}:{k}", v) for k, v in _dict(doc, p.get("AA")).items()]
        for a in _list(doc, p.get("Annots")):
            d = _dict(doc, a)
            starts += [(f"annot{i}", d.get("A"))] + [(f"annot{i}:{k}", v) for k, v in _dict(doc, d.get("AA")).items()]
    starts += [(f"object{n}", Ref(n)) for n, x in sorted(doc.objects.items()) if isinstance(x, dict) and doc.resolve(x.get("Type")) == "Action"]
    ord_, seen = 0, set()
    for origin, start in starts:
        for depth, num, d in _chain(doc, start):
            if num is not None and num in seen:
                continue
            seen.add(num)
            if "S" in d or doc.resolve(d.get("Type")) == "Action":
                yield doc_id, origin, ord_, depth, num, _name(doc.resolve(d.get("S"))), _name(doc.resolve(d.get("N")))
                ord_ += 1


def _states(doc: Document) -> dict[int, bool]:
    """Whether each layer is shown by the default configuration."""
    oc = _dict(doc, doc.catalog.get("OCProperties"))
    d = _dict(doc, oc.get("D"))
    shown = {r.num: doc.resolve(d.get("BaseState")) != "OFF" for r in _list(doc, oc.get("OCGs")) if isinstance(r, Ref)}
    for key, to in (("ON", True), ("OFF", False)):
        shown.update({r.num: to for r in _list(doc, d.get(key)) if isinstance(r, Ref)})
    return shown


def is_visible(doc: Document, ref, states: dict[int, bool]) -> bool:
    """A layer by its state, a membership by its policy over its layers; what has neither is visible."""
    d = _dict(doc, ref)
    if doc.resolve(d.get("Type")) == "OCMD":
        groups = doc.resolve(d.get("OCGs"))
        refs = [r for r in (groups if isinstance(groups, list) else [d.get("OCGs")]) if isinstance(r, Ref)]
        on = [states.get(r.num, True) for r in refs]
        if not on:
            return True
        policy = _name(doc.resolve(d.get("P"))) or "AnyOn"
        return {"AllOn": all(on), "AnyOff": not all(on), "AllOff": not any(on)}.get(policy, any(on))
    return states.get(ref.num, True) if isinstance(ref, Ref) else True


def layers(doc_id: str, doc: Document) -> Iterator[tuple]:
    for num, shown in sorted(_states(doc).items()):
        yield doc_id, num, _text(doc.resolve(_dict(doc, Ref(num)).get("Name"))), shown


def _held_annots(doc: Document, states: dict[int, bool]) -> Iterator[tuple[int, int, bool]]:
    """(page, place, whether it is visible) of annotations of any layer."""
    for i, (_, p) in enumerate(doc.pages()):
        for k, a in enumerate(_list(doc, p.get("Annots"))):
            if "OC" in _dict(doc, a):
                yield i, k, is_visible(doc, _dict(doc, a)["OC"], states)


def layer_uses(doc_id: str, doc: Document) -> Iterator[tuple]:
    """Layers, each with whether the file's annotations of any layer are visible, in order."""
    found: list[bool] = []
    try:
        for _, _, visible in _held_annots(doc, _states(doc)):
            found.append(visible)
    finally:
        # An error ends the annotations; the layers are there with those before it.
        for row in layers(doc_id, doc):
            yield (*row, found)


def field_count(doc_id: str, doc: Document) -> int:
    """How many fields `fields` gives; an error ends them."""
    n = 0
    try:
        for _ in fields(doc_id, doc):
            n += 1
    except Exception:  # noqa: BLE001 `problem` has it with form_field
        pass
    return n


def layered(doc_id: str, doc: Document) -> Iterator[tuple]:
    """What belongs to a layer: annotations and XObjects of pages by /OC, marked content by /OC BDC."""
    states = _states(doc)
    for i, (_, p) in enumerate(doc.pages()):
        for k, a in enumerate(_list(doc, p.get("Annots"))):
            if "OC" in _dict(doc, a):
                yield doc_id, i, "annot", k, is_visible(doc, _dict(doc, a)["OC"], states)
        for k, x in enumerate(_dict(doc, doc.get(p.get("Resources"), "XObject")).values()):
            if "OC" in _dict(doc, x):
                yield doc_id, i, "xobject", k, is_visible(doc, _dict(doc, x)["OC"], states)
        held = _dict(doc, doc.get(p.get("Resources"), "Properties"))
        for k, (op, v) in enumerate(content.operators(doc.content(p))):
            if op == "BDC" and len(v) == 2 and v[0] == "OC" and isinstance(v[1], str):
                yield doc_id, i, "content", k, is_visible(doc, held.get(v[1]), states)


def images(doc_id: str, doc: Document) -> Iterator[tuple]:
    """Image XObjects that a page's resources name, those of forms included."""
    for i, (_, p) in enumerate(doc.pages()):
        seen, todo = set(), [_dict(doc, p.get("Resources"))]
        while todo:
            for name, ref in _dict(doc, todo.pop().get("XObject")).items():
                x = doc.resolve(ref)
                if not isinstance(x, Stream) or id(x) in seen:
                    continue
                seen.add(id(x))
                if x.dict.get("Subtype") == "Form":
                    todo.append(_dict(doc, x.dict.get("Resources")))
                elif x.dict.get("Subtype") == "Image":
                    size = [v if isinstance(v := doc.resolve(x.dict.get(k)), int) else None for k in ("Width", "Height", "BitsPerComponent")]
                    space = doc.resolve(x.dict.get("ColorSpace"))
                    space = doc.resolve(space[0]) if isinstance(space, list) and space else space
                    yield (doc_id, i, name, ref.num if isinstance(ref, Ref) else None, *size, _name(space), x.filters(doc.resolve)[0], len(x.raw))


def _spaces(doc: Document, x, path: tuple = ()) -> Iterator[list]:
    """Colour space arrays inside an object, not through references."""
    if isinstance(x, list):
        if x and isinstance(x[0], str) and x[0] in ("Separation", "DeviceN"):
            yield x
        for y in x:
            yield from _spaces(doc, y)
    elif isinstance(x, (dict, Stream)):
        for y in (x.dict if isinstance(x, Stream) else x).values():
            yield from _spaces(doc, y)


def colorants(canonical: Callable) -> Callable:
    def read(doc_id: str, doc: Document) -> Iterator[tuple]:
        for num, x in sorted(doc.objects.items()):
            for space in _spaces(doc, x):
                if len(space) < 4:
                    continue
                alternate, tint = (json.dumps(canonical(doc, y), ensure_ascii=False) for y in space[2:4])
                if space[0] == "Separation":
                    yield doc_id, num, "Separation", _name(doc.resolve(space[1])), alternate, tint, None, None
                    continue
                more = _dict(doc, space[4]) if len(space) > 4 else {}
                known = _dict(doc, more.get("Colorants"))
                for name in _list(doc, space[1]):
                    yield doc_id, num, "DeviceN", _name(doc.resolve(name)), alternate, tint, name in known, doc.resolve(more.get("Subtype")) == "NChannel"

    return read


def resources(doc_id: str, doc: Document) -> Iterator[tuple]:
    """Resources by category and name, of pages (owner 0) and, once a page, of the forms they lead to."""
    for i, (_, p) in enumerate(doc.pages()):
        seen, todo = set(), [(0, p.get("Resources"))]
        while todo:
            owner, held = todo.pop(0)
            for category, names in _dict(doc, held).items():
                for name, ref in _dict(doc, names).items():
                    num = ref.num if isinstance(ref, Ref) else None
                    yield doc_id, i, owner, category, name, num
                    x = doc.resolve(ref)
                    if category == "XObject" and isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and num not in seen:
                        seen.add(num)
                        todo.append((num or 0, x.dict.get("Resources")))


def _nodes(doc: Document, tree: Callable, kids: Callable) -> Iterator[tuple[int, dict, Ref | None]]:
    """(node, element, its page) in the numbering of struct_node."""
    page_of: dict[int, Ref | None] = {}
    for node, parent, _, x in tree(doc, doc.catalog.get("StructTreeRoot"), kids):
        own = x.get("Pg")
        page_of[node] = own if isinstance(own, Ref) else page_of.get(parent)
        yield node, x, page_of[node]


def object_refs(tree: Callable, kids: Callable) -> Callable:
    def read(doc_id: str, doc: Document) -> Iterator[tuple]:
        for node, x, _ in _nodes(doc, tree, kids(doc)):
            k = doc.resolve(x.get("K"))
            for y in k if isinstance(k, list) else [k]:
                d = _dict(doc, y)
                if doc.resolve(d.get("Type")) == "OBJR" and isinstance(d.get("Obj"), Ref):
                    yield doc_id, node, d["Obj"].num

    return read


def content_items(tree: Callable, kids: Callable) -> Callable:
    """Marked content that structure elements hold: numbers on the element's page, or with a page of their own."""

    def read(doc_id: str, doc: Document) -> Iterator[tuple]:
        index = {num: i for i, (num, _) in enumerate(doc.pages())}
        for node, x, page in _nodes(doc, tree, kids(doc)):
            k = doc.resolve(x.get("K"))
            for ord_, y in enumerate(k if isinstance(k, list) else [k]):
                y = doc.resolve(y)
                at = page
                if isinstance(y, dict) and doc.resolve(y.get("Type")) == "MCR":
                    at = y["Pg"] if isinstance(y.get("Pg"), Ref) else page
                    y = doc.resolve(y.get("MCID"))
                if isinstance(y, int) and not isinstance(y, bool):
                    yield doc_id, node, index.get(at.num) if at else None, y, ord_

    return read
