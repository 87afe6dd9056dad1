"""Codes and glyph names to text: the standard encodings with their differences, and names by rule."""

from __future__ import annotations

import re
import unicodedata

# Marks by the name that a letter's name ends in, and names of single characters that no rule gives.
MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "commaaccent": "̧", "ogonek": "̨"}
NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯",
    "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "Eth": "Ð", "multiply": "×", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "divide": "÷", "oslash": "ø", "thorn": "þ",
    "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "florin": "ƒ", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›",
    "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "hungarumlaut": "˝",
}
# Text strings' bytes 0x18 on and 0x80 on, where they differ from Latin-1 (U+FFFD: undefined).
DOC_LOW = "˘ˇˆ˙˝˛˚˜"
DOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
# The standard encoding where it differs from ASCII, by code.
STANDARD = {0x27: "’", 0x60: "‘"} | dict(zip(range(0xA1, 0xB0), "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", strict=True)) | {0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿"} | dict(zip((0xC1, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB), "`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß", strict=True))


def glyph_text(name: str) -> str | None:
    """The text of a glyph name: uniXXXX and uXXXX forms, single letters, letters with a mark, ligature parts joined by
    `_`; a suffix after `.` does not count. None: unknown."""
    base = name.split(".", 1)[0]
    if not base:
        return None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return None if None in parts else "".join(parts)
    if base in NAMES:
        return NAMES[base]
    if len(base) == 1 and base.isalpha():
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", base)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if base[0].isalpha() and base[1:] in MARKS:
        made = unicodedata.normalize("NFC", base[0] + MARKS[base[1:]])
        return made if len(made) == 1 else None
    return None


def _codec(name: str) -> dict[int, str]:
    out = {}
    for c in range(32, 256):
        try:
            out[c] = bytes([c]).decode(name)
        except UnicodeDecodeError:
            continue
    return out


_WIN = _codec("cp1252") | {c: "•" for c in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {0xA0: " ", 0xAD: "-"}
ENCODINGS = {"WinAnsiEncoding": _WIN, "MacRomanEncoding": _codec("mac_roman"), "StandardEncoding": {c: chr(c) for c in range(32, 127)} | STANDARD}


def encoding_map(base: str | None, differences: list) -> dict[int, str]:
    """Codes to texts of a simple font: the base encoding, changed by differences (numbers and glyph names)."""
    out = dict(ENCODINGS.get(base or "", {}))
    code = 0
    for x in differences:
        if isinstance(x, int):
            code = x
        else:
            text = glyph_text(str(x))
            out.pop(code, None)
            if text is not None:
                out[code] = text
            code += 1
    return out


def document_text(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 after their marks, else the document encoding."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if not any(0x18 <= b < 0x20 or 0x80 <= b <= 0xA0 or b == 0xAD for b in raw):
        return raw.decode("latin-1")
    return "".join(DOC_LOW[b - 0x18] if 0x18 <= b < 0x20 else DOC_HIGH[b - 0x80] if 0x80 <= b <= 0xA0 else "�" if b == 0xAD else chr(b) for b in raw)


def appearance_string(text: str) -> tuple[str | None, float | None, list[float]]:
    """Font name, size and colour operands of a default-appearance string; the last of each counts."""
    font, size, colour, operands = None, None, [], []
    for token in text.split():
        if token == "Tf" and len(operands) >= 2 and operands[-2].startswith("/"):
            font = operands[-2][1:]
            try:
                size = float(operands[-1])
            except ValueError:
                size = None
        elif token in ("g", "rg", "k"):
            try:
                colour = [float(x) for x in operands[-{"g": 1, "rg": 3, "k": 4}[token] :]]
            except ValueError:
                colour = []
        elif not re.fullmatch(r"[A-Za-z*]+", token):
            operands.append(token)
            continue
        operands = []
    return font, size, colour


def number_text(x: float) -> str:
    """A number as files have it: no exponent, at most six decimals, no trailing zeros, no negative zero."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    out = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if out in ("-0", "") else out
