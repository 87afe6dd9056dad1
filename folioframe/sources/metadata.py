"""Metadata packets and colour profiles: scans into rows."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"

# Device classes and colour spaces of a profile header by their signatures.
CLASSES = {b"scnr": "Input", b"mntr": "Display", b"prtr": "Output", b"link": "DeviceLink", b"spac": "ColorSpace", b"abst": "Abstract", b"nmcl": "NamedColor"}
SPACES = {b"RGB ": "RGB", b"CMYK": "CMYK", b"GRAY": "Gray", b"Lab ": "Lab", b"XYZ ": "XYZ"}


def _split(tag: str) -> tuple[str, str]:
    m = re.match(r"\{(.*?)\}(.*)", tag)
    return (m[1], m[2]) if m else ("", tag)


def xmp_properties(xml: str) -> list[tuple[int, str, str, str, str | None, str | None]]:
    """(ord, namespace, name, form, language, value) of the top-level properties of all descriptions of all islands in
    order, one row for each item of an array; form is simple, struct, bag, seq or alt. A damaged packet gives none."""
    try:
        root = ET.fromstring(re.sub(r"<\?xpacket.*?\?>", "", xml, flags=re.S).strip())
    except ET.ParseError:
        return []
    out: list[tuple] = []
    for d in root.iter(f"{RDF}Description"):
        if d not in [x for island in root.iter(f"{RDF}RDF") for x in island]:
            continue
        for key, value in d.attrib.items():
            if not key.startswith(RDF):
                out.append((len(out), *_split(key), "simple", None, value))
        for p in d:
            ns, name = _split(p.tag)
            array = next((x for x in p if x.tag in (f"{RDF}Bag", f"{RDF}Seq", f"{RDF}Alt")), None)
            if array is not None:
                for item in array:
                    out.append((len(out), ns, name, _split(array.tag)[1].lower(), item.get(LANG), item.text))
            elif len(p) or p.get(f"{RDF}parseType") == "Resource":
                out.append((len(out), ns, name, "struct", None, None))
            else:
                out.append((len(out), ns, name, "simple", p.get(LANG), p.text))
    return out


def profile_header(data: bytes) -> tuple[int, str, str | None, str | None, str | None, int, list[str]] | None:
    """(size, version, class, space, connection space, rendering intent, tag signatures), None if it is no profile."""
    if len(data) < 132 or data[36:40] != b"acsp":
        return None
    size, = struct.unpack(">I", data[:4])
    n, = struct.unpack(">I", data[128:132])
    tags = [data[i : i + 4].decode("latin-1") for i in range(132, min(len(data) - 11, 132 + 12 * n), 12)]
    return size, f"{data[8]}.{data[9] >> 4}.{data[9] & 15}", CLASSES.get(data[12:16]), SPACES.get(data[16:20]), SPACES.get(data[20:24]), struct.unpack(">I", data[64:68])[0], tags


def fixed(data: bytes) -> float:
    """A signed 15.16 number."""
    return struct.unpack(">i", data[:4])[0] / 65536


def jp2_header(data: bytes) -> tuple[int | None, int | None, bool, list[dict]] | None:
    """(components, bit depth, whether depths differ by component, colour specifications) of a JPEG 2000 file's boxes."""
    if data[4:8] != b"jP  ":
        return None
    components = depth = None
    bpcc, specs, todo = False, [], [(0, len(data))]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            head = 8
            if size == 1 and at + 16 <= stop:
                size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
            size = size or stop - at
            if size < head or at + size > stop:
                break
            body = data[at + head : at + size]
            if kind == b"jp2h":
                todo.append((at + head, at + size))
            elif kind == b"ihdr" and len(body) >= 11:
                components = struct.unpack(">H", body[8:10])[0]
                depth = (body[10] & 127) + 1 if body[10] != 255 else None
            elif kind == b"bpcc":
                bpcc = True
            elif kind == b"colr" and len(body) >= 3:
                specs.append({"meth": body[0], "approx": body[2], "enum": struct.unpack(">I", body[3:7])[0] if body[0] == 1 and len(body) >= 7 else None})
            at += size
    return components, depth, bpcc, specs
