"""What page content uses: one walk over a page's operators, through its forms, that gathers facts for rules."""

from __future__ import annotations

from collections.abc import Iterator

from folioframe.functions.glyphs import ENCODINGS, encoding_map
from folioframe.sources import content
from folioframe.sources.pdfsyntax import Document, Name, Ref, Stream

SCHEMAS = {
    "page_use": "doc_id string, page_idx int, device array<string>, untagged boolean, nested boolean, actual_text array<int>, fallback array<int>, icc_overprint boolean, transparent boolean, blend_space string, has_group boolean, long_strings int, big_integers int",
    "font_use": "doc_id string, page_idx int, obj_num int, base_font string, codes array<int>, shown array<int>, unmapped array<int>",
    "do_edge": "doc_id string, page_idx int, dst int, n int, marked boolean",
}
FAMILIES = {"g": "Gray", "G": "Gray", "rg": "RGB", "RG": "RGB", "k": "CMYK", "K": "CMYK"}
DEVICE = {"DeviceGray": "Gray", "G": "Gray", "DeviceRGB": "RGB", "RGB": "RGB", "DeviceCMYK": "CMYK", "CMYK": "CMYK"}
FILLS, STROKES = ("f", "F", "f*", "B", "B*", "b", "b*"), ("S", "s", "B", "B*", "b", "b*")
SHOWS = ("Tj", "TJ", "'", '"')
#: Operators that name a resource, and its category.
NAMED = {"Do": "XObject", "Tf": "Font", "gs": "ExtGState", "sh": "Shading", "cs": "ColorSpace", "CS": "ColorSpace", "scn": "Pattern", "SCN": "Pattern"}


def reliable_codes(doc: Document, font: dict) -> set[int] | None:
    """The codes that have a text without guessing; None: all of them."""
    m = doc.get(font, "ToUnicode")
    known = {c for c, t in content.to_unicode(m.data(doc.resolve)).items() if t} if isinstance(m, Stream) else set()
    if doc.get(font, "Subtype") == "Type0":
        down = doc.get(font, "DescendantFonts")
        info = doc.get(doc.resolve(down[0]), "CIDSystemInfo") if isinstance(down, list) and down else None
        return None if doc.get(info, "Ordering") in (b"GB1", b"CNS1", b"Japan1", b"Korea1") else known
    enc = doc.get(font, "Encoding")
    if isinstance(enc, str):
        return known | set(ENCODINGS.get(enc, {}))
    if isinstance(enc, dict):
        base = doc.get(enc, "BaseEncoding") or (None if doc.get(font, "Subtype") == "Type3" else "StandardEncoding")
        return known | set(encoding_map(base, [doc.resolve(x) for x in doc.resolve(enc.get("Differences")) or []]))
    flags = doc.get(font, "FontDescriptor", "Flags")
    symbolic = isinstance(flags, int) and flags & 4
    return known if symbolic or doc.get(font, "Subtype") == "Type3" else known | set(ENCODINGS["StandardEncoding"])


class Walk:
    def __init__(self, doc: Document, tagged: set[int]):
        self.doc, self.tagged = doc, tagged
        self.device: set[str] = set()
        self.untagged = self.nested = self.overprint = self.transparent = False
        self.actual: set[int] = set()
        self.fallback: set[int] = set()
        self.fonts: dict[int, list] = {}
        self.edges: dict[int, int] = {}
        self.marks: list[str] = []
        self.long_strings = self.big_integers = 0

    def _family(self, x, spaces: dict) -> str | None:
        """The device family of a colour space, by name or array; special spaces count by their base."""
        doc, seen = self.doc, 0
        x = doc.resolve(x)
        while seen < 8:
            seen += 1
            if isinstance(x, str):
                if x in DEVICE:
                    family = DEVICE[x]
                    return None if f"Default{family.title() if family == 'Gray' else family}" in spaces else family
                if x not in spaces:
                    return None
                x = doc.resolve(spaces[x])
            elif isinstance(x, list) and x:
                head = doc.resolve(x[0])
                at = {"Indexed": 1, "I": 1, "Pattern": 1, "Separation": 2, "DeviceN": 2}.get(head, 0 if head in DEVICE else None)
                if at is None or len(x) <= at:
                    return None
                x = doc.resolve(x[at])
            else:
                return None
        return None

    def _use(self, family: str | None) -> None:
        if family:
            self.device.add(family)

    def run(self, data: bytes, own: dict, above: dict, owner: int, page: bool, path: tuple = ()) -> None:
        """own: the stream's own resources; above: those a reader falls back on."""
        doc = self.doc
        held = {k: {**self._names(above, k), **self._names(own, k)} for k in {*own, *above}}
        spaces = held.get("ColorSpace", {})
        fill = stroke = False
        state = {"font": None, "render": 0, "op": False, "opm": 0, "icc": False}
        stack: list[dict] = []
        depth = len(self.marks)
        for op, v in content.operators(data):
            if v:
                self._limits(v)
            if op in NAMED and v and isinstance(v[0 if op not in ("scn", "SCN") else -1], Name):
                name = v[0 if op not in ("scn", "SCN") else -1]
                category = NAMED[op]
                if name not in self._names(own, category) and name in self._names(above, category) and name not in DEVICE and name != "Pattern":
                    self.fallback.add(owner)
            if op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op in FAMILIES:
                self._use(self._family(Name(f"Device{FAMILIES[op]}"), spaces))
                state["icc"] = False
            elif op in ("cs", "CS") and v and isinstance(v[0], Name):
                self._use(self._family(v[0], spaces))
                icc = doc.resolve(spaces.get(v[0]))
                profile = doc.resolve(icc[1]) if isinstance(icc, list) and len(icc) > 1 and doc.resolve(icc[0]) == "ICCBased" else None
                state["icc"] = isinstance(profile, Stream) and doc.resolve(profile.dict.get("N")) == 4
            elif op == "gs" and v:
                self._state(doc.resolve(held.get("ExtGState", {}).get(v[0])), state)
            elif op == "Tr" and v and isinstance(v[0], int):
                state["render"] = v[0]
            elif op == "Tf" and v:
                state["font"] = held.get("Font", {}).get(v[0])
            elif op == "BI" and v:
                if v[0].get("IM", v[0].get("ImageMask")) is not True:
                    self._use(self._family(v[0].get("CS", v[0].get("ColorSpace", Name("DeviceGray"))), spaces))
                self._painted()
            elif op in ("BMC", "BDC"):
                self._mark(v, held)
            elif op == "EMC" and len(self.marks) > depth:
                self.marks.pop()
            elif op in SHOWS:
                self._shown(v, state)
                self._painted()
            elif op == "sh":
                self._painted()
            elif op == "Do" and v:
                self._do(held.get("XObject", {}).get(v[0]), spaces, held, owner, path)
            if op in ("g", "rg", "k", "cs", "sc", "scn"):
                fill = True
            elif op in ("G", "RG", "K", "CS", "SC", "SCN"):
                stroke = True
            elif op in FILLS or op in STROKES:
                if page and "DefaultGray" not in spaces and ((op in FILLS and not fill) or (op in STROKES and not stroke)):
                    self.device.add("Gray")
                self.overprint = self.overprint or (page and state["icc"] and state["op"] and state["opm"] == 1)
                self._painted()
        del self.marks[depth:]

    def _names(self, resources: dict, category: str) -> dict:
        d = self.doc.resolve(resources.get(category))
        return d if isinstance(d, dict) else {}

    def _limits(self, operands: list) -> None:
        for x in operands:
            kind = x.__class__
            if kind is int:
                if not -(2**31) <= x < 2**31:
                    self.big_integers += 1
            elif kind is bytes:
                if len(x) > 32767:
                    self.long_strings += 1
            elif kind is list:
                self._limits(x)

    def _state(self, d, state: dict) -> None:
        if not isinstance(d, dict):
            return
        doc = self.doc
        if isinstance(doc.resolve(d.get("op", d.get("OP"))), bool):
            state["op"] = doc.resolve(d.get("op", d.get("OP")))
        if isinstance(doc.resolve(d.get("OPM")), int):
            state["opm"] = doc.resolve(d["OPM"])
        blend = doc.resolve(d.get("BM"))
        alpha = [doc.resolve(d.get(k)) for k in ("ca", "CA")]
        mask = doc.resolve(d.get("SMask"))
        self.transparent = self.transparent or isinstance(mask, dict) or (isinstance(blend, str) and blend not in ("Normal", "Compatible")) or any(isinstance(a, (int, float)) and a < 1 for a in alpha)

    def _mark(self, v: list, held: dict) -> None:
        props = v[1] if len(v) > 1 else None
        props = self.doc.resolve(held.get("Properties", {}).get(props)) if isinstance(props, Name) else props
        mcid = self.doc.resolve(props.get("MCID")) if isinstance(props, dict) else None
        kind = "artifact" if v and v[0] == "Artifact" else "tagged" if isinstance(mcid, int) and mcid in self.tagged else "mcid" if isinstance(mcid, int) else "other"
        if (kind == "artifact" and {"tagged", "mcid"} & set(self.marks)) or (kind in ("tagged", "mcid") and "artifact" in self.marks):
            self.nested = True
        if isinstance(mcid, int) and "ActualText" in props:
            self.actual.add(mcid)
        self.marks.append(kind)

    def _painted(self) -> None:
        if "artifact" not in self.marks and "tagged" not in self.marks:
            self.untagged = True

    def _shown(self, v: list, state: dict) -> None:
        ref = state["font"]
        d = self.doc.resolve(ref)
        if not isinstance(d, dict) or not v:
            return
        num = ref.num if isinstance(ref, Ref) else -1
        if num not in self.fonts:
            self.fonts[num] = [d, set(), set()]
        wide = self.doc.get(d, "Subtype") == "Type0"
        for s in v[-1] if isinstance(v[-1], list) else [v[-1]]:
            if isinstance(s, bytes):
                codes = [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s), 2)] if wide else list(s)
                self.fonts[num][1].update(codes)
                if state["render"] != 3:
                    self.fonts[num][2].update(codes)

    def _do(self, ref, spaces: dict, held: dict, owner: int, path: tuple) -> None:
        doc, x = self.doc, self.doc.resolve(ref)
        if not isinstance(x, Stream):
            return
        if x.dict.get("Subtype") == "Image":
            if doc.resolve(x.dict.get("ImageMask")) is not True:
                self._use(self._family(x.dict.get("ColorSpace"), spaces))
            self.transparent = self.transparent or "SMask" in x.dict
            self._painted()
        elif x.dict.get("Subtype") == "Form" and id(x) not in path:
            num = ref.num if isinstance(ref, Ref) else -1
            self.edges[num] = self.edges.get(num, 0) + 1
            group = doc.resolve(x.dict.get("Group"))
            self.transparent = self.transparent or (isinstance(group, dict) and doc.resolve(group.get("S")) == "Transparency")
            own = doc.resolve(x.dict.get("Resources"))
            self.run(x.data(doc.resolve), own if isinstance(own, dict) else {}, held, num, False, (*path, id(x)))


def _above(doc: Document, page) -> dict:
    """The nearest resources strictly above a page."""
    seen, at = set(), page
    while isinstance(at, dict) and id(at) not in seen:
        seen.add(id(at))
        at = doc.resolve(at.get("Parent"))
        held = doc.resolve(at.get("Resources")) if isinstance(at, dict) else None
        if isinstance(held, dict):
            return held
    return {}


def _walks(doc: Document) -> Iterator[tuple[int, dict, Walk]]:
    """The walk of each page. Done once a document, whichever relations ask."""
    have = getattr(doc, "_walks", None)
    if have is None:
        tagged: dict[int | None, set[int]] = {}
        todo, seen = [(doc.catalog.get("StructTreeRoot"), None)], set()
        while todo:
            at, page = todo.pop()
            if isinstance(at, Ref):
                if at.num in seen:
                    continue
                seen.add(at.num)
            x = doc.resolve(at)
            if isinstance(x, int) and not isinstance(x, bool):
                tagged.setdefault(page, set()).add(x)
            elif isinstance(x, dict):
                page = x["Pg"].num if isinstance(x.get("Pg"), Ref) else page
                k = x.get("MCID") if doc.resolve(x.get("Type")) == "MCR" else x.get("K")
                todo += [(y, page) for y in (doc.resolve(k) if isinstance(doc.resolve(k), list) else [k])]
        have = []
        for i, (num, p) in enumerate(doc.pages()):
            w = Walk(doc, tagged.get(num, set()) | tagged.get(None, set()))
            raw = doc.resolve(doc.objects.get(num)) if num is not None else p
            own = doc.resolve(raw.get("Resources")) if isinstance(raw, dict) else None
            w.run(doc.content(p), own if isinstance(own, dict) else {}, _above(doc, raw), 0, True)
            have.append((i, p, w))
        doc._walks = have
    yield from have


def page_uses(doc_id: str, doc: Document) -> Iterator[tuple]:
    for i, p, w in _walks(doc):
        group = doc.resolve(p.get("Group"))
        space = doc.resolve(group.get("CS")) if isinstance(group, dict) else None
        space = doc.resolve(space[0]) if isinstance(space, list) and space else space
        yield doc_id, i, sorted(w.device), w.untagged, w.nested, sorted(w.actual), sorted(w.fallback), w.overprint, w.transparent, str(space) if isinstance(space, str) else None, isinstance(group, dict), w.long_strings, w.big_integers


def font_uses(doc_id: str, doc: Document) -> Iterator[tuple]:
    known: dict[int, set | None] = {}
    for i, _, w in _walks(doc):
        for num, (d, codes, shown) in sorted(w.fonts.items()):
            if num not in known or num == -1:
                known[num] = reliable_codes(doc, d)
            base = doc.resolve(d.get("BaseFont"))
            missing = [] if known[num] is None else sorted(codes - known[num])
            yield doc_id, i, num if num >= 0 else None, str(base) if isinstance(base, str) else "", sorted(codes), sorted(shown), missing


def do_edges(doc_id: str, doc: Document) -> Iterator[tuple]:
    for i, _, w in _walks(doc):
        for num, n in sorted(w.edges.items()):
            x = doc.objects.get(num)
            held = doc.resolve(x.dict.get("Resources")) if isinstance(x, Stream) else None
            props = doc.get(held, "Properties") if isinstance(held, dict) else None
            marked = isinstance(x, Stream) and any(op == "BDC" and len(v) > 1 and "MCID" in ((doc.resolve((props or {}).get(v[1])) or {}) if isinstance(v[1], Name) else v[1]) for op, v in content.operators(x.data(doc.resolve)))
            yield doc_id, i, num, n, marked
