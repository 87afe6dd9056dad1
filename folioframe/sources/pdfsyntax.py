"""Objects of a page-description file: reading them from bytes and writing them.

Python values stand for objects: None, bool, int, float, bytes (string), list and dict as they are, and Name, Ref and
Stream of this module.
"""

from __future__ import annotations

import re
import struct
from binascii import hexlify, unhexlify
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field
from functools import lru_cache

from folioframe.functions import codecs
from folioframe.sources.security import Decryptor

SPACE = b" \t\r\n\f\x00"
DELIMITERS = b"()<>[]{}/%"
MAX_PREV = 100
#: Bytes of objects whose values a process keeps, and the longest that is kept.
KEPT_BYTES, KEPT_OBJECT = 1 << 23, 1 << 14
#: Marks that open a dictionary or an array up to which no file nests too deeply to be read, as Python's recursion goes.
SHALLOW = 500


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes

    def filters(self, resolve=lambda x: x) -> tuple[list[str], list[dict]]:
        f = resolve(self.dict.get("Filter", self.dict.get("F")))
        p = resolve(self.dict.get("DecodeParms", self.dict.get("DP")))
        names = [str(resolve(x)) for x in (f if isinstance(f, list) else [f])] if f is not None else []
        parms = [x if isinstance(x := resolve(y), dict) else {} for y in (p if isinstance(p, list) else [p])] if p is not None else []
        return names, [{k: resolve(v) for k, v in x.items()} for x in parms]

    def data(self, resolve=lambda x: x) -> bytes:
        return codecs.decode(self.raw, *self.filters(resolve))


class Known:
    """A kept object and what was worked out for it alone: its text, also as an indirect object of a number, its
    references, rows of relations."""

    __slots__ = ("value", "text", "framed", "edges", "facts")

    def __init__(self, value):
        self.value, self.text, self.framed, self.edges, self.facts = value, None, (None, b""), None, {}


class Store:
    """Objects of the files that a process meets, by what they were made of: files of one producer share most of theirs.
    A key is kept from the second time on; over the limit all goes and keeping starts anew. Kept objects never change."""

    def __init__(self, limit: int):
        self.limit, self.size, self.marks = limit, 0, 0
        self.known: dict = {}
        self.by_id: dict[int, Known] = {}
        self.met = bytearray(1 << 20)

    def keep(self, key, size: int, value, parts: list) -> None:
        mark = hash(key) & (len(self.met) - 1)
        if not self.met[mark]:
            if self.marks > len(self.met) >> 2:
                self.met, self.marks = bytearray(len(self.met)), 0
            self.met[mark] = 1
            self.marks += 1
            return
        if self.size + size > self.limit:
            self.size = 0
            self.known.clear()
            self.by_id.clear()
        self.size += size
        self.known[key] = value
        for x in parts:
            self.by_id[id(x)] = Known(x)


STORE = Store(KEPT_BYTES)


class Keyword(str):
    __slots__ = ()


END = Keyword("")


_GAP = rb"(?:[ \t\r\n\f\x00]++|%[^\r\n]*+)"
_END = rb"(?![^ \t\r\n\f\x00()<>\[\]{}/%])"
# Groups: name, number, two of a dictionary's marks, hexadecimal and plain literal string, start of any other literal
# string, delimiter, word. At the end of the data none has matched.
_PLAIN = _GAP + rb"*+(?:/([^ \t\r\n\f\x00()<>\[\]{}/%]*+)|([+-]?(?:\d++\.?\d*+|\.\d++)" + _END + rb")|(<<)|(>>)|<([^>]*+)>?|\(([^()\\]*+)\)|(\()|([\[\]{}>)])|([^ \t\r\n\f\x00()<>\[\]{}/%]++)|)"
_TOKEN = re.compile(_PLAIN)
# The same with references before all else, as groups 1 and 2.
_VALUE = re.compile(_PLAIN.replace(rb"*+(?:/", rb"*+(?:(\+?\d++)" + _GAP + rb"++([+-]?\d++)" + _GAP + rb"++R" + _END + rb"|/", 1))
# A key and a value that is a reference (groups 2 and 3), a name or an integer; without one, any other value follows.
_PAIR = re.compile(_GAP + rb"*+/([^ \t\r\n\f\x00()<>\[\]{}/%]*+)" + _GAP + rb"*+(?:(\+?\d++)" + _GAP + rb"++([+-]?\d++)" + _GAP + rb"++R" + _END + rb"|/([^ \t\r\n\f\x00()<>\[\]{}/%]*+)|([+-]?\d++)" + _END + rb"|)")
_INTEGERS = re.compile(rb"((?:[ \t\r\n]*+[+-]?\d++(?=[ \t\r\n\]]))*+)[ \t\r\n]*+\]")
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
_HEADING = re.compile(rb"[ \t\r\n\f\x00]*+(\d++)[ \t\r\n\f\x00]++(\d++)[ \t\r\n\f\x00]++obj" + _END)
_STREAM = re.compile(_GAP + rb"*+stream" + _END)
_ROW = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \r| \n|\r\n)")
_ROWS = re.compile(rb"(?:\d{10} \d{5} [nf](?: \r| \n|\r\n))*+")
_PLACES = re.compile(rb"[0-9 \t\r\n\f]*+")
#: Widths of fields that `struct` reads.
_WIDTHS = {1: "B", 2: "H", 4: "I", 8: "Q"}


@lru_cache(4096)
def _named(raw: bytes) -> Name:
    return Name((_ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw).decode("latin-1"))


@lru_cache(4096)
def _keyed(raw: bytes) -> str:
    return str(_named(raw))


@lru_cache(4096)
def _referred(num: bytes, gen: bytes) -> Ref:
    return Ref(int(num), int(gen))


@lru_cache(4096)
def _worded(raw: bytes) -> Keyword:
    return Keyword(raw.decode("latin-1"))


def _string(raw: bytes) -> bytes:
    """A hexadecimal string."""
    try:
        return unhexlify(raw)
    except ValueError:
        return codecs.asciihex_decode(raw)


def _literal(d: bytes, i: int) -> tuple[bytes, int]:
    """The literal string whose parenthesis is before i, and where it ends."""
    depth, out = 1, bytearray()
    escapes = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
    while i < len(d):
        c = d[i]
        if c == 92:
            i += 1
            n = d[i] if i < len(d) else 92
            if 48 <= n <= 55:
                m = re.match(rb"[0-7]{1,3}", d[i : i + 3])
                out.append(int(m[0], 8) & 255)
                i += len(m[0])
                continue
            if n == 13:
                i += 1 + (d[i + 1 : i + 2] == b"\n")
                continue
            if n != 10:
                out.append(escapes.get(n, n))
            i += 1
            continue
        if c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                i += 1
                break
        out.append(c)
        i += 1
    return bytes(out), i


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        """The next number, name, string, or keyword; structure marks come as keywords."""
        m = _TOKEN.match(self.data, self.at)
        kind, self.at = m.lastindex, m.end()
        if kind is None:
            return END
        raw = m[kind]
        if kind == 1:
            return _named(raw)
        if kind == 2:
            return float(raw) if b"." in raw else int(raw)
        if kind == 5:
            return _string(raw)
        if kind == 6:
            return raw
        if kind == 7:
            out, self.at = _literal(self.data, self.at)
            return out
        return _worded(raw)


_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def _value(d: bytes, at: int):
    """The next object and where it ends; END at the end. Keywords that are no object come back as they are."""
    m = _VALUE.match(d, at)
    kind, at = m.lastindex, m.end()
    if kind == 2:
        return _referred(m[1], m[2]), at
    if kind is None:
        return END, at
    raw = m[kind]
    if kind == 3:
        return _named(raw), at
    if kind == 4:
        return (float(raw) if b"." in raw else int(raw)), at
    if kind == 5:
        out = {}
        while True:
            m = _PAIR.match(d, at)
            if m:
                kind, at = m.lastindex, m.end()
                if kind == 3:
                    v = _referred(m[2], m[3])
                elif kind == 4:
                    v = _named(m[4])
                elif kind == 5:
                    v = int(m[5])
                else:
                    v, at = _value(d, at)
                    if v.__class__ is Keyword:
                        if v in (">>", ""):
                            return out, at
                        continue
                out[_keyed(m[1])] = v
                continue
            m = _TOKEN.match(d, at)
            kind, at = m.lastindex, m.end()
            if kind == 4 or kind is None:
                return out, at
            if kind == 7:
                at = _literal(d, at)[1]
    if kind == 7:
        return _string(raw), at
    if kind == 8:
        return raw, at
    if kind == 9:
        return _literal(d, at)
    if kind == 10 and raw == b"[":
        if m := _INTEGERS.match(d, at):
            return list(map(int, m[1].split())), m.end()
        items = []
        while True:
            v, at = _value(d, at)
            if v.__class__ is Keyword:
                if v in ("]", ""):
                    return items, at
                continue
            items.append(v)
    if raw in _CONSTANTS:
        return _CONSTANTS[raw], at
    return _worded(raw), at


#: Dictionaries before a keyword by their bytes up to it, with how far they go: those of streams and trailers differ little
#: between files. They are shared and never change.
_AHEAD: dict[bytes, tuple[dict, int]] = {}


def _before(d: bytes, at: int, word: bytes):
    """As `_value`; a dictionary that ends before a keyword not far off is read once of the same bytes."""
    stop = d.find(word, at, at + 320)
    if stop < 0 or d.find(b"endobj", at, stop) >= 0:
        return _value(d, at)
    raw = d[at:stop]
    found = _AHEAD.get(raw)
    if found is None:
        v, end = _value(d, at)
        if v.__class__ is not dict or end > stop:
            return v, end
        if len(_AHEAD) >= 4096:
            _AHEAD.clear()
        found = _AHEAD[raw] = v, end - at
    return found[0], at + found[1]


class Parser:
    def __init__(self, data: bytes, at: int = 0):
        self.lex = Lexer(data, at)

    def value(self):
        """The next object; END at the end. Keywords that are no object come back as they are."""
        v, self.lex.at = _value(self.lex.data, self.lex.at)
        return v


@dataclass(slots=True)
class Entry:
    kind: str  # used, free, packed
    a: int  # offset, or the number of the object stream
    b: int  # generation, or the index in it
    depth: int = 0


@dataclass
class Document:
    data: bytes
    objects: MutableMapping = field(default_factory=dict)
    xref: dict = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    version: str = ""
    header_offset: int = 0
    rebuilt: bool = False
    #: Where cross-reference sections start.
    sections: set = field(default_factory=set, repr=False, compare=False)
    #: What readers of one file share.
    kept: dict = field(default_factory=dict, repr=False, compare=False)

    def resolve(self, x, hops: int = 32):
        while isinstance(x, Ref) and hops:
            x, hops = self.objects.get(x.num), hops - 1
        return None if isinstance(x, Ref) else x

    def get(self, d, *path):
        """The value at a path of keys, references resolved; None where it ends."""
        for key in path:
            d = self.resolve(d)
            d = d.dict if isinstance(d, Stream) else d
            d = d.get(key) if isinstance(d, dict) else None
        return self.resolve(d)

    @property
    def catalog(self) -> dict:
        c = self.resolve(self.trailer.get("Root"))
        return c if isinstance(c, dict) else {}

    def pages(self) -> list[tuple[int | None, dict]]:
        """(object number, page with inherited attributes) in order."""
        out, seen = [], set()
        stack = [(self.catalog.get("Pages"), {})]
        while stack:
            node, above = stack.pop()
            if isinstance(node, Ref):
                if node.num in seen:
                    continue
                seen.add(node.num)
            num, d = node.num if isinstance(node, Ref) else None, self.resolve(node)
            if not isinstance(d, dict):
                continue
            passed = above | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            kids = self.resolve(d.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, passed) for k in reversed(kids)]
            else:
                out.append((num, passed | d))
        return out

    def content(self, page: dict) -> bytes:
        """All content streams of a page with a newline between them, as one."""
        c = self.resolve(page.get("Contents"))
        parts = [self.resolve(x) for x in (c if isinstance(c, list) else [c])]
        return b"\n".join(p.data(self.resolve) for p in parts if isinstance(p, Stream))


def _object_at(doc: Document, at: int, num: int | None = None):
    """(number, generation, object, end of its value) of an indirect object at an offset."""
    head = _HEADING.match(doc.data, at)
    if head:
        n, g, i = int(head[1]), int(head[2]), head.end()
    else:
        lex = Lexer(doc.data, at)
        n, g, word = lex.token(), lex.token(), lex.token()
        i = lex.at
    if not isinstance(n, int) or not isinstance(g, int) or (not head and word != "obj") or (num is not None and n != num):
        raise ValueError(f"no object at {at}")
    v, i = _before(doc.data, i, b"stream")
    v = None if isinstance(v, Keyword) else v
    if isinstance(v, dict) and (begin := _STREAM.match(doc.data, i)):
        i = begin.end()
        i += 2 if doc.data[i : i + 2] == b"\r\n" else 1 if doc.data[i : i + 1] in (b"\n", b"\r") else 0
        size = v.get("Length")
        if isinstance(size, Ref):
            entry = doc.xref.get(size.num)
            try:
                size = _object_at(doc, entry.a + doc.header_offset, size.num)[2] if entry and entry.kind == "used" else None
            except (ValueError, RecursionError):
                size = None
        if not isinstance(size, int) or doc.data[i + size : i + size + 20].lstrip()[:9] != b"endstream":
            j = doc.data.find(b"endstream", i)
            j = len(doc.data) if j < 0 else j
            size = j - i - (2 if doc.data[j - 2 : j] == b"\r\n" else 1 if doc.data[j - 1 : j] in (b"\n", b"\r") else 0)
        return n, g, Stream(v, doc.data[i : i + max(0, size)]), i + size
    return n, g, v, i


def _object(doc: Document, at: int, stop: int, num: int):
    """An indirect object between two offsets, kept if its bytes there tell it whole."""
    if not 0 < stop - at <= KEPT_OBJECT:
        return _object_at(doc, at, num)[2]
    raw = doc.data[at:stop]
    key = num, raw
    found = STORE.known.get(key)
    if found is None:
        found, end = _object_at(doc, at, num)[2:]
        after = raw[end - at : end - at + 20]
        if found.__class__ is Stream:
            whole = found.dict.get("Length").__class__ is int and found.dict["Length"] == len(found.raw) and after.lstrip().startswith(b"endstream")
        else:
            whole = found.__class__ in (dict, list) and after.lstrip(SPACE).startswith(b"endobj")
        if whole and end < stop:
            STORE.keep(key, len(raw), found, [found])
    return found


def _table(doc: Document, at: int) -> tuple[dict[int, Entry], dict]:
    p = Parser(doc.data, at)
    if p.lex.token() != "xref":
        return _stream_table(doc, at)
    found: dict[int, Entry] = {}
    while True:
        t = p.lex.token()
        if t == "trailer":
            d, _ = _before(doc.data, p.lex.at, b"startxref")
            return found, d if isinstance(d, dict) else {}
        count = p.lex.token()
        if not isinstance(t, int) or not isinstance(count, int):
            raise ValueError("damaged cross-reference table")
        # Rows of the fixed form first; what follows them, if any of this section, is read by tokens.
        i = p.lex.at + len(doc.data[p.lex.at : p.lex.at + 2]) - len(doc.data[p.lex.at : p.lex.at + 2].lstrip(b"\r\n"))
        n = max(0, min(count, (_ROWS.match(doc.data, i).end() - i) // 20))
        rows = {k: Entry("used" if kind == b"n" else "free", int(a), int(b)) for k, (a, b, kind) in enumerate(_ROW.findall(doc.data, i, i + 20 * n), t)}
        found = found | {k: e for k, e in rows.items() if k not in found} if found else rows
        p.lex.at = i + 20 * n
        for k in range(n, count):
            a, b, kind = p.lex.token(), p.lex.token(), p.lex.token()
            if not isinstance(a, int) or kind not in ("n", "f"):
                raise ValueError("damaged cross-reference entry")
            found.setdefault(t + k, Entry("used" if kind == "n" else "free", a, b))


def _stream_table(doc: Document, at: int) -> tuple[dict[int, Entry], dict]:
    s = _object_at(doc, at)[2]
    if not isinstance(s, Stream) or not isinstance(s.dict.get("W"), list):
        raise ValueError("no cross-reference stream")
    data, w = s.data(), s.dict["W"]
    index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
    found, i = {}, 0
    if len(w) == 3 and all(x.__class__ is int and x > 0 for x in w):
        # All three fields have a width, as nearly everywhere.
        one, two, size = w[0], w[0] + w[1], sum(w)
        form = struct.Struct(">" + "".join(_WIDTHS[x] for x in w)) if all(x in _WIDTHS for x in w) else None
        for first, count in zip(index[::2], index[1::2]):
            if form:
                nums = range(first, first + count)[: (len(data) - i) // size]
                for num, (kind, a, b) in zip(nums, form.iter_unpack(data[i : i + size * len(nums)])):
                    if kind in (0, 1, 2):
                        found.setdefault(num, Entry(("free", "used", "packed")[kind], a, b))
                i += size * len(nums)
                continue
            for num in range(first, first + count)[: (len(data) - i) // size]:
                row = data[i : i + size]
                i += size
                kind = int.from_bytes(row[:one], "big")
                if kind in (0, 1, 2):
                    found.setdefault(num, Entry(("free", "used", "packed")[kind], int.from_bytes(row[one:two], "big"), int.from_bytes(row[two:], "big")))
        return found, s.dict
    for first, count in zip(index[::2], index[1::2]):
        for num in range(first, first + count):
            f = []
            for width in w:
                f.append(int.from_bytes(data[i : i + width], "big") if width else None)
                i += width
            if i > len(data):
                break
            kind = 1 if f[0] is None else f[0]
            if kind in (0, 1, 2):
                found.setdefault(num, Entry(("free", "used", "packed")[kind], f[1] or 0, f[2] or 0))
    return found, s.dict


def _chain(doc: Document, at: int) -> None:
    """Newest wins over the chain of updates; a hybrid's stream overrides the table of its own section only."""
    seen, depth = set(), 0
    while at is not None and at not in seen and depth < MAX_PREV:
        seen.add(at)
        doc.sections.add(at)
        found, trailer = _table(doc, at + doc.header_offset)
        if isinstance(trailer.get("XRefStm"), int):
            hidden, _ = _table(doc, trailer["XRefStm"] + doc.header_offset)
            found = found | hidden
        if not depth:
            doc.xref = found
        else:
            for num, e in found.items():
                if num not in doc.xref:
                    e.depth = depth
                    doc.xref[num] = e
        for k, v in trailer.items():
            doc.trailer.setdefault(k, v)
        prev = trailer.get("Prev")
        at, depth = int(prev) if isinstance(prev, (int, float)) else None, depth + 1


def _rebuild(doc: Document) -> None:
    """Find objects by their headings; the last of a number wins."""
    doc.rebuilt = True
    doc.xref, doc.trailer = {}, {}
    for m in re.finditer(rb"(?<![0-9])(\d{1,10})[ \t\r\n]+(\d{1,5})[ \t\r\n]+obj\b", doc.data):
        doc.xref[int(m[1])] = Entry("used", m.start() - doc.header_offset, int(m[2]))
    for m in re.finditer(rb"\btrailer\b", doc.data):
        d = Parser(doc.data, m.end()).value()
        if isinstance(d, dict):
            doc.trailer |= d


def _opened(doc: Document, password: bytes) -> None:
    """Decrypt what is not packed in object streams, which are themselves encrypted as streams."""
    lock = doc.trailer.get("Encrypt")
    if lock is None:
        return
    own = lock.num if isinstance(lock, Ref) else None
    rules = {k: doc.resolve(v) for k, v in doc.resolve(lock).items()}
    ids = doc.resolve(doc.trailer.get("ID"))
    d = Decryptor(rules, ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"", password)

    def clear(x, num: int, gen: int):
        if isinstance(x, bytes):
            return d.string(num, gen, x)
        if isinstance(x, list):
            return [clear(y, num, gen) for y in x]
        if isinstance(x, dict):
            return {k: clear(v, num, gen) for k, v in x.items()}
        if isinstance(x, Stream) and x.dict.get("Type") != "XRef":
            crypt = "Crypt" in x.filters(doc.resolve)[0]
            return Stream(clear(x.dict, num, gen), x.raw if crypt else d.stream(num, gen, x.raw))
        return x

    for num, x in doc.objects.items():
        if num != own:
            doc.objects[num] = clear(x, num, doc.xref[num].b)


class Objects(MutableMapping):
    """Objects by number, each read when first asked for. Until then a tuple stands for it, which no object is: the data it
    lies in, its start and stop there, and whether that is an object stream."""

    def __init__(self, doc: Document):
        self.doc, self.held = doc, {}

    def _read(self, num: int, place: tuple):
        data, at, stop, packed = place
        if packed:
            v = _held(data, at, stop, num)
            v = None if isinstance(v, Keyword) else v
        else:
            v = _object(self.doc, at, stop, num)
        self.held[num] = v
        return v

    def get(self, num, default=None):
        v = self.held.get(num, default)
        return self._read(num, v) if v.__class__ is tuple else v

    def __getitem__(self, num):
        v = self.held[num]
        return self._read(num, v) if v.__class__ is tuple else v

    def __setitem__(self, num, v):
        self.held[num] = v

    def __delitem__(self, num):
        del self.held[num]

    def __contains__(self, num):
        return num in self.held

    def __iter__(self):
        return iter(self.held)

    def __len__(self):
        return len(self.held)

    def _whole(self) -> dict:
        for num, v in self.held.items():
            if v.__class__ is tuple:
                self._read(num, v)
        return self.held

    def items(self):
        return self._whole().items()

    def values(self):
        return self._whole().values()


def _tame(data: bytes) -> bool:
    """Whether no object in these bytes can be nested, or a number long, beyond what Python reads (4,300 digits; so many in
    a row cover 300 bytes from a multiple of 4,000)."""
    return data.count(b"[") + data.count(b"<<") <= SHALLOW and not any(data[i : i + 300].isdigit() for i in range(4000, len(data), 4000))


def _placed(doc: Document) -> bool:
    """Find where objects are, each to be read when asked for; False if reading one could fail, which tells a damaged file
    and needs all of them read."""
    data, shift = doc.data, doc.header_offset
    if not doc.trailer.get("Root") or doc.trailer.get("Encrypt") is not None or not _tame(data):
        return False
    objects = doc.objects = Objects(doc)
    held = objects.held
    used = {num: e.a for num, e in doc.xref.items() if e.kind == "used"}
    places = sorted({*used.values(), *doc.sections})
    stops = dict(zip(places, [*places[1:], len(data)]))
    for num, a in used.items():
        at = a + shift
        if at < 0 or not data.startswith(b"%d 0 obj\n" % num, at) and not ((head := _HEADING.match(data, at)) and int(head[1]) == num):
            return False
        held[num] = data, at, stops[a] + shift, False
    for holder in sorted({e.a for e in doc.xref.values() if e.kind == "packed"}):
        s = objects.get(holder)
        if not isinstance(s, Stream):
            continue
        body, first = s.data(doc.resolve), s.dict.get("First")
        if first.__class__ is not int or not _tame(body):
            return False
        pairs, stops = _pairs_of(doc, s, body)
        for num, offset in pairs:
            e = doc.xref.get(num)
            if e and e.kind == "packed" and e.a == holder:
                held[num] = body, first + offset, first + stops.get(offset, len(body)), True
    return True


def _found(doc: Document) -> bool:
    """As `_placed`; a file on which that fails is left to be read whole, to fail there."""
    try:
        if _placed(doc):
            return True
    except Exception:  # noqa: BLE001 reading the whole file raises it again, if it matters
        pass
    doc.objects = {}
    return False


def load(data: bytes, password: bytes = b"", lazy: bool = False) -> Document:
    """Read a file; where its cross-references are damaged, objects are found by scanning. A wrong password for an
    encrypted file raises a ValueError. Objects of a lazy document are the same, but read when they are asked for."""
    head = re.search(rb"%PDF-(\d\.\d)", data[:1024])
    if not head:
        raise ValueError("no file header in the first 1024 bytes")
    doc = Document(data, version=head[1].decode(), header_offset=head.start())
    try:
        at = data.rfind(b"startxref")
        start = Parser(data, at + 9).lex.token() if at >= 0 else None
        if not isinstance(start, int):
            raise ValueError("no startxref")
        _chain(doc, start)
        if not (lazy and _found(doc)):
            _materialise(doc, True, password)
        if not doc.catalog:
            raise ValueError("no catalog")
    except (ValueError, IndexError, TypeError, RecursionError):
        doc.objects = {}
        _rebuild(doc)
        _materialise(doc, False, password)
    return doc


def _held(body: bytes, at: int, stop: int, num: int):
    """An object of an object stream, kept if it ends where it closes."""
    raw = body[at:stop] if 0 <= at < stop else b""
    if not raw:
        return _value(body, at)[0]
    key = raw, num
    found = STORE.known.get(key)
    if found is None:
        found, end = _value(body, at)
        if found.__class__ in (dict, list) and end <= stop and len(raw) <= KEPT_OBJECT:
            STORE.keep(key, len(raw), found, [found])
    return found


def _pairs_of(doc: Document, s: Stream, body: bytes) -> tuple[list[tuple], dict[int, int]]:
    """(number, offset) of the objects of an object stream, and where each offset's object ends but the last's."""
    count = doc.resolve(s.dict.get("N")) or 0
    match = _PLACES.match(body)
    head = match[0].split()
    if count.__class__ is int and (len(head) > 2 * count or (len(head) == 2 * count and body[match.end() : match.end() + 1] in (b"<", b"[", b"(", b"/"))):
        pairs = list(zip(map(int, head[: 2 * count : 2]), map(int, head[1 : 2 * count : 2])))
    else:
        p = Parser(body)
        pairs = [(p.lex.token(), p.lex.token()) for _ in range(count)]
    places = sorted({offset for _, offset in pairs if offset.__class__ is int})
    return pairs, dict(zip(places, places[1:]))


def _materialise(doc: Document, strict: bool, password: bytes) -> None:
    places = sorted({e.a for e in doc.xref.values() if e.kind == "used"} | doc.sections)
    stops = dict(zip(places, [*places[1:], len(doc.data)]))
    data, shift, known = doc.data, doc.header_offset, STORE.known
    for num, e in doc.xref.items():
        if e.kind != "used":
            continue
        at, stop = e.a + shift, stops[e.a] + shift
        if 0 < stop - at <= KEPT_OBJECT and (found := known.get((num, data[at:stop]))) is not None:
            doc.objects[num] = found
            continue
        try:
            doc.objects[num] = _object(doc, at, stop, num)
        except (ValueError, IndexError, TypeError):
            if strict:
                raise
    _opened(doc, password)
    holders = {e.a for e in doc.xref.values() if e.kind == "packed"}
    if doc.rebuilt:
        holders |= {n for n, o in doc.objects.items() if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm"}
    for holder in sorted(holders):
        s = doc.objects.get(holder)
        if not isinstance(s, Stream):
            continue
        body = s.data(doc.resolve)
        pairs, stops = _pairs_of(doc, s, body)
        first = s.dict.get("First")
        if first.__class__ is int and not doc.rebuilt:
            # As nearly everywhere; objects that are kept are told by their bytes at once.
            for num, offset in pairs:
                e = doc.xref.get(num)
                if e and e.kind == "packed" and e.a == holder:
                    at, stop = first + offset, first + stops.get(offset, len(body))
                    v = known.get((body[at:stop], num)) if 0 <= at < stop else None
                    if v is None:
                        v = _held(body, at, stop, num)
                        v = None if isinstance(v, Keyword) else v
                    doc.objects[num] = v
            continue
        for num, offset in pairs:
            e = doc.xref.get(num)
            if (e and e.kind == "packed" and e.a == holder) or (doc.rebuilt and num not in doc.objects):
                first = doc.resolve(s.dict["First"])
                v = _held(body, first + offset, first + stops.get(offset, len(body)), num)
                doc.objects[num] = None if isinstance(v, Keyword) else v
                if doc.rebuilt and e is None:
                    doc.xref[num] = Entry("packed", holder, 0)
    if not doc.trailer.get("Root"):
        for num, o in doc.objects.items():
            d = o.dict if isinstance(o, Stream) else o
            if isinstance(d, dict) and d.get("Type") == "Catalog":
                doc.trailer["Root"] = Ref(num)
            elif isinstance(d, dict) and d.get("Type") == "XRef" and "Root" in d:
                doc.trailer["Root"] = d["Root"]


@lru_cache(4096)
def _name_text(x: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in DELIMITERS + b"#" else b"#%02X" % c for c in x.encode("latin-1"))


def _items(x: list) -> bytes:
    return b"[" + b" ".join([_WRITERS.get(v.__class__, _other)(v) for v in x]) + b"]"


class _Keys(dict):
    """Texts of keys with the space after them, up to a bound."""

    def __missing__(self, key: str) -> bytes:
        text = _name_text(key) + b" "
        if len(self) < 4096:
            self[key] = text
        return text


_KEYS = _Keys()


def _entries(x: dict) -> bytes:
    return b"<<" + b" ".join([_KEYS[k] + _WRITERS.get(v.__class__, _other)(v) for k, v in x.items()]) + b">>"


def _other(x) -> bytes:
    """An object of a class derived from those of `_WRITERS`."""
    for kind, write in _WRITERS.items():
        if isinstance(x, kind):
            return write(x)
    raise TypeError(type(x))


_WRITERS: dict = {
    Name: _name_text,
    Ref: lambda x: b"%d %d R" % (x.num, x.gen),
    type(None): lambda x: b"null",
    bool: lambda x: b"true" if x else b"false",
    int: lambda x: b"%d" % x,
    float: lambda x: (f"{x:.6f}".rstrip("0").rstrip(".") or "0").encode(),
    bytes: lambda x: b"<" + hexlify(x) + b">",
    list: _items,
    dict: _entries,
    Stream: lambda x: _entries(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream",
}


def written(x) -> bytes:
    """An object's text."""
    return _WRITERS.get(x.__class__, _other)(x)


def text_of(x) -> bytes:
    """An object's text, made once of a kept object."""
    known = STORE.by_id.get(id(x))
    if known is None:
        return written(x)
    if known.text is None:
        known.text = written(x)
    return known.text


def framed(num: int, x) -> bytes:
    """An object as an indirect one, made once of a kept object that keeps its number."""
    known = STORE.by_id.get(id(x))
    if known is None:
        return b"%d 0 obj\n%b\nendobj\n" % (num, written(x))
    if known.framed[0] != num:
        known.framed = num, b"%d 0 obj\n%b\nendobj\n" % (num, text_of(x))
    return known.framed[1]


def serialise(objects: dict, trailer: dict, version: str = "1.7") -> bytes:
    """A file with one classic cross-reference table, objects in ascending order."""
    out = [f"%PDF-{version}\n".encode() + b"%\xe2\xe3\xcf\xd3\n"]
    start, at = len(out[0]), {}
    for num in sorted(objects):
        text = framed(num, objects[num])
        out.append(text)
        at[num] = start
        start += len(text)
    size = max(objects, default=0) + 1
    out.append(b"xref\n0 %d\n" % size)
    out += [b"%010d 00000 n\r\n" % at[num] if num in at else b"0000000000 %05d f\r\n" % (65535 if num == 0 else 0) for num in range(size)]
    keep = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    out.append(b"trailer\n" + written(keep | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
    return b"".join(out)


def _edges(x, path: str = "") -> Iterator[tuple[str, int]]:
    if isinstance(x, Ref):
        yield path, x.num
    elif isinstance(x, (dict, Stream)):
        for k, v in (x.dict if isinstance(x, Stream) else x).items():
            if v.__class__ is Ref:
                yield f"{path}/{k}", v.num
            elif isinstance(v, (list, dict, Stream)):
                yield from _edges(v, f"{path}/{k}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            if v.__class__ is Ref:
                yield f"{path}/{i}", v.num
            elif isinstance(v, (list, dict, Stream)):
                yield from _edges(v, f"{path}/{i}")


def _edges_of(x) -> list[tuple[str, int]]:
    """The references of an object, listed once of a kept one."""
    known = STORE.by_id.get(id(x))
    if known is None:
        return list(_edges(x))
    if known.edges is None:
        known.edges = list(_edges(x))
    return known.edges
