"""Content streams: operators, and text by an ordered fold over them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from folioframe.functions.glyphs import document_text, encoding_map
from folioframe.sources.pdfsyntax import _CONSTANTS, _VALUE, END, STORE, Document, Keyword, Name, Parser, Ref, Stream, _edges_of, _named, _string, _value, _worded

MAX_FORM_DEPTH = 24


def operators(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) in order; an inline image is one `BI` with its dictionary and bytes."""
    at, operands = 0, []
    while True:
        # Names, numbers, strings and words, as most tokens are, are told here; the rest as any object.
        m = _VALUE.match(data, at)
        kind = m.lastindex
        if kind == 4:
            raw, at = m[4], m.end()
            v = float(raw) if b"." in raw else int(raw)
        elif kind == 11 and m[11] not in _CONSTANTS:
            v, at = _worded(m[11]), m.end()
        elif kind == 7:
            v, at = _string(m[7]), m.end()
        elif kind == 3:
            v, at = _named(m[3]), m.end()
        else:
            v, at = _value(data, at)
        if v.__class__ is Keyword:
            if v == END:
                return
            if v == "BI":
                p, d = Parser(data, at), {}
                while not isinstance(key := p.value(), Keyword):
                    d[str(key)] = p.value()
                at = p.lex.at + 1
                m = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, at)
                stop = m.start() if m else len(data)
                p.lex.at = m.end() if m else len(data)
                stop, start, at = stop, at, p.lex.at
                yield "BI", [d, data[start:stop]]
            else:
                yield str(v), operands
            operands = []
        else:
            operands.append(v)


def to_unicode(data: bytes) -> dict[int, str]:
    """Codes to text of a mapping stream: single codes first, then ranges, which overwrite. Not to be changed: maps of
    lately met streams are kept."""
    return _mapped(data) if len(data) <= 1 << 14 else _mapped.__wrapped__(data)


@lru_cache(64)
def _mapped(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = data.decode("latin-1")
    unit = lambda h: bytes.fromhex(h if len(h) % 2 == 0 else h + "0").decode("utf-16-be", "ignore")
    for block in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        for code, to in re.findall(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]*)\s*>", block):
            out[int(code, 16)] = unit(to)
    for block in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, one, many in re.findall(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*(?:<\s*([0-9A-Fa-f]*)\s*>|\[(.*?)\])", block, re.S):
            if many:
                for k, to in enumerate(re.findall(r"<\s*([0-9A-Fa-f]*)\s*>", many)):
                    out[int(a, 16) + k] = unit(to)
            elif one:
                base = unit(one)
                for k in range(min(int(b, 16) - int(a, 16), 0xFFFF) + 1):
                    out[int(a, 16) + k] = base[:-1] + chr(min(0x10FFFF, ord(base[-1]) + k)) if base else ""
    return out


def map_span(data: bytes) -> tuple[int, int, int, bool] | None:
    """How many codes a mapping has, the first, the last, and whether each stands for its own character; None without any."""
    return _spanned(data) if len(data) <= 1 << 14 else _spanned.__wrapped__(data)


@lru_cache(64)
def _spanned(data: bytes) -> tuple[int, int, int, bool] | None:
    codes = to_unicode(data)
    return (len(codes), min(codes), max(codes), all(chr(c % 256) == t for c, t in codes.items())) if codes else None


class Font:
    def __init__(self, doc: Document, d: dict):
        self.name = str(doc.get(d, "BaseFont") or "")
        self.wide = doc.get(d, "Subtype") == "Type0"
        m = doc.get(d, "ToUnicode")
        self.map = to_unicode(m.data(doc.resolve)) if isinstance(m, Stream) else {}
        enc = doc.get(d, "Encoding")
        self.encoding = encoding_map(enc, []) if isinstance(enc, str) else encoding_map(doc.get(enc, "BaseEncoding"), [doc.resolve(x) for x in doc.get(enc, "Differences") or []]) if isinstance(enc, dict) else {}
        self.first = doc.get(d, "FirstChar") or 0
        self.widths = [w if isinstance(w := doc.resolve(x), (int, float)) else 0 for x in doc.get(d, "Widths") or []]
        self.default = 1000.0 if self.wide else 500.0
        self.table = {c: t for c, t in (self.encoding | self.map).items() if c < 256}
        self.advances: dict[tuple, Advances] = {}

    def codes(self, s: bytes) -> list[int]:
        return [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s), 2)] if self.wide else list(s)

    def width(self, code: int) -> float:
        k = code - self.first
        return float(self.widths[k]) if 0 <= k < len(self.widths) else self.default

    def text(self, s: bytes) -> str:
        if s[:2] == b"\xfe\xff":
            return s[2:].decode("utf-16-be", "ignore")
        if self.wide:
            return "".join(self.map.get(c, chr(c)) for c in self.codes(s))
        return s.decode("latin-1").translate(self.table)


def _font_of(doc: Document, d: dict) -> Font:
    """A font; of kept objects alone it is kept with its dictionary, for the mapping that it was made with."""
    known, m = STORE.by_id.get(id(d)), doc.get(d, "ToUnicode")
    if known is None or any(path.split("/")[1] not in ("ToUnicode", "FontDescriptor", "DescendantFonts") for path, _ in _edges_of(d)):
        return Font(doc, d)
    if m is not None and (id(m) not in STORE.by_id or _edges_of(m)):
        return Font(doc, d)
    held = known.facts.get("font")
    if held is None or held[0] is not m:
        held = known.facts["font"] = m, Font(doc, d)
    return held[1]


class Advances(dict):
    """How far a code moves the pen in one state, worked out when it is first met."""

    def __init__(self, font: Font | None, size: float, tc: float, tw: float, tz: float):
        self.font, self.state = font, (size, tc, tw, tz)

    def __missing__(self, code: int) -> float:
        size, tc, tw, tz = self.state
        self[code] = ((self.font.width(code) if self.font else 500.0) / 1000 * size + tc + (tw if code == 32 else 0)) * tz
        return self[code]


def _matrix(v: list) -> np.ndarray:
    a, b, c, d, e, f = v
    return np.array([[a, b, 0], [c, d, 0], [e, f, 1]], np.float32)


_UNIT = np.eye(3, dtype=np.float32)
#: Matrices are held by their bytes, so that what follows from equal ones is worked out once.
_IDENTITY = _UNIT.tobytes()


def _array(m: bytes) -> np.ndarray:
    return np.frombuffer(m, np.float32).reshape(3, 3)


def _moved(x: float, y: float, m: bytes) -> bytes:
    """A translation by x, y times a matrix."""
    plain = (x or x.__class__ is int) and (y or y.__class__ is int)  # zeros of either sign are equal as keys
    return _shifted(x, y, m) if plain else _shifted.__wrapped__(x, y, m)


@lru_cache(1 << 13)
def _shifted(x: float, y: float, m: bytes) -> bytes:
    move = _UNIT.copy()
    move[2, 0], move[2, 1] = x, y
    return (move @ _array(m)).tobytes()


@lru_cache(1 << 13)
def _placed(rise: float, tm: bytes, ctm: bytes) -> tuple[float, float]:
    place = np.array([0, rise, 1], np.float32) @ _array(tm) @ _array(ctm)
    return float(place[0]), float(place[1])


def _place(rise: float, tm: bytes, ctm: bytes) -> tuple[float, float]:
    return (_placed if rise or math.copysign(1, rise) > 0 else _placed.__wrapped__)(rise, tm, ctm)


@lru_cache(1 << 13)
def _gap(x: float, y: float, px: float, py: float, size: float) -> str:
    """What stands for the way between two places."""
    dx, dy = abs(np.float32(x) - np.float32(px)), abs(np.float32(y) - np.float32(py))
    if np.float32(np.hypot(dx, dy)) > np.float32(0.2 * size):
        if dy > np.float32(0.5 * size):
            return "\n"
        if dx > np.float32(0.2 * size):
            return " "
    return ""


class TextFold:
    """Fragments and running text of a page. Geometry is in 32-bit floats."""

    def __init__(self, doc: Document):
        self.doc, self.fragments, self.out, self.length = doc, [], [], 0
        self.pen: tuple | None = None
        self.bare: dict[tuple, Advances] = {}
        self.marks: list[tuple[str, int | None]] = []
        # All pages of a file share its fonts, each held with the dictionary that it was made of.
        self.fonts: dict[int, tuple[dict, Font]] = doc.kept.setdefault("fonts", {})

    def run(self, data: bytes, resources, ctm: bytes | None = None, path: tuple[int, ...] = ()) -> None:
        doc = self.doc
        ctm = _IDENTITY if ctm is None else ctm
        stack, state = [], {"ctm": ctm, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0}
        tm = line = _IDENTITY
        for op, v in operators(data):
            try:
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q" and stack:
                    state = stack.pop()
                elif op == "cm":
                    state["ctm"] = (_matrix(v) @ _array(state["ctm"])).tobytes()
                elif op == "BT":
                    tm = line = _IDENTITY
                elif op == "Tf":
                    state["font"], state["size"] = self._font(resources, v[0]), float(v[1])
                elif op in ("Tc", "Tw", "TL", "Ts"):
                    state[op.lower()] = float(v[0])
                elif op == "Tz":
                    state["tz"] = float(v[0]) / 100
                elif op in ("Td", "TD"):
                    if op == "TD":
                        state["tl"] = -float(v[1])
                    tm = line = _moved(*v[:2], line)
                elif op == "Tm":
                    tm = line = _matrix(v).tobytes()
                elif op in ("T*", "'", '"'):
                    if op == '"':
                        state["tw"], state["tc"] = float(v[0]), float(v[1])
                    tm = line = _moved(0, -state["tl"], line)
                    if op != "T*":
                        tm = self._show(v[-1], state, tm)
                elif op == "Tj":
                    tm = self._show(v[0], state, tm)
                elif op == "TJ":
                    for x in v[0]:
                        if isinstance(x, bytes):
                            tm = self._show(x, state, tm)
                        elif isinstance(x, (int, float)):
                            tm = _moved(-x / 1000 * state["size"] * state["tz"], 0, tm)
                elif op in ("BMC", "BDC"):
                    props = v[1] if len(v) > 1 else None
                    props = doc.get(resources, "Properties", props) if isinstance(props, Name) else props
                    mcid = props.get("MCID") if isinstance(props, dict) else None
                    self.marks.append((str(v[0]), mcid if isinstance(mcid, int) else None))
                elif op == "EMC" and self.marks:
                    self.marks.pop()
                elif op == "Do":
                    self._form(resources, v[0], state, path)
            except (IndexError, TypeError, ValueError, AttributeError):
                continue  # an operator with wrong operands is passed over

    def _font(self, resources, name) -> Font | None:
        d = self.doc.get(resources, "Font", name)
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            self.fonts[id(d)] = d, _font_of(self.doc, d)
        return self.fonts[id(d)][1]

    def _form(self, resources, name, state: dict, path: tuple[int, ...]) -> None:
        """A form is run each time it is invoked, but never inside itself."""
        x = self.doc.get(resources, "XObject", name)
        if isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and id(x) not in path and len(path) < MAX_FORM_DEPTH:
            m = self.doc.get(x, "Matrix")
            ctm = (_matrix([self.doc.resolve(y) for y in m]) @ _array(state["ctm"])).tobytes() if isinstance(m, list) and len(m) == 6 else state["ctm"]
            self.run(x.data(self.doc.resolve), self.doc.get(x, "Resources") or resources, ctm, (*path, id(x)))

    def _mcid(self) -> int | None:
        for tag, mcid in reversed(self.marks):
            if tag == "Artifact":
                return None
            if mcid is not None:
                return mcid
        return None

    def _show(self, s, state: dict, tm: bytes) -> bytes:
        font, size = state["font"], state["size"]
        if not isinstance(s, bytes):
            return tm
        text = font.text(s) if font else s.decode("latin-1")
        width = 0.0
        for step in map(self._advances(font, state).__getitem__, font.codes(s) if font else s):
            width += step
        x, y = _place(state["ts"], tm, state["ctm"])
        if self.pen is not None and text and (gap := _gap(x, y, *self.pen, size)):
            self._put(gap)
        if text:
            self.fragments.append((text, x, y, font.name if font else None, float(size), float(width), self.length, self._mcid()))
            self._put(text)
        tm = _moved(width, 0, tm)
        self.pen = _place(state["ts"], tm, state["ctm"])
        return tm

    def _advances(self, font: Font | None, state: dict) -> Advances:
        key = state["size"], state["tc"], state["tw"], state["tz"]
        held = self.bare if font is None else font.advances
        if key not in held:
            if len(held) >= 64:
                held.clear()
            held[key] = Advances(font, *key)
        return held[key]

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.out)


def page_text(doc: Document, page: dict) -> TextFold:
    fold = TextFold(doc)
    fold.run(doc.content(page), page.get("Resources"))
    return fold


_PLAIN: dict = {
    Name: lambda x: "/" + x,
    bytes: lambda x: "s:" + document_text(x),
    Ref: lambda x: f"r:{x.num} {x.gen}",
    Stream: lambda x: plain(x.dict),
    list: lambda x: [y if y.__class__ is int else plain(y) for y in x],
    dict: lambda x: {k: plain(v) for k, v in x.items()},
}


def plain(x):
    """An object as a value that JSON can hold: names `/N`, strings `s:text`, references `r:num gen`."""
    how = _PLAIN.get(x.__class__)
    return how(x) if how else x
