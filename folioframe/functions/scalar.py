"""Scalar functions of page-description documents as native expressions: dates, tags, bits, curves, calculators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that dates and tags have.
PDF_DATE = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z|[+-])(\d{2})?'?(\d{2})?'?)?$"
ISO_DATE = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
LANGUAGE_TAG = r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"
SUBSET_TAG = r"^([A-Z]{6})\+.+"


def format_pdf_date(ts: Column) -> Column:
    """D:YYYYMMDDHHmmSS+00'00' of a UTC timestamp."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("+00'00'"))


def parse_pdf_date(s: Column) -> Column:
    """struct(ts, offset_minutes), null where malformed; parts that are left out count as their first value."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(s, PDF_DATE, i), F.lit("")), F.lit(default)).cast("int")
    sign = F.regexp_extract(s, PDF_DATE, 7)
    offset = (F.when(sign == "-", -1).otherwise(1) * (part(8, "0") * 60 + part(9, "0"))).cast("int")
    local = F.try_make_timestamp_ntz(part(1, "0"), part(2, "1"), part(3, "1"), part(4, "0"), part(5, "0"), part(6, "0"))
    return F.when(s.rlike(PDF_DATE) & local.isNotNull(), F.struct(local.alias("ts"), offset.alias("offset_minutes")))


def parse_iso_date(s: Column) -> Column:
    """struct(ts, offset_minutes) of a metadata date, null where malformed; parts that are left out count as their first
    value, and a time without a zone as UTC."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(s, ISO_DATE, i), F.lit("")), F.lit(default))
    zone = F.regexp_extract(s, ISO_DATE, 7)
    minutes = F.substr(zone, F.lit(2), F.lit(2)).cast("int") * 60 + F.substr(zone, F.lit(5), F.lit(2)).cast("int")
    offset = F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes).otherwise(0).cast("int")
    local = F.try_make_timestamp_ntz(*(part(i, d).cast("int") for i, d in ((1, "0"), (2, "1"), (3, "1"), (4, "0"), (5, "0"))), part(6, "0").cast("decimal(8,6)"))
    return F.when(s.rlike(ISO_DATE) & local.isNotNull(), F.struct(local.alias("ts"), offset.alias("offset_minutes")))


def is_language_tag(s: Column) -> Column:
    return s.rlike(LANGUAGE_TAG)


def subset_tag(name: Column) -> Column:
    """The six capitals before `+` of a subset font's name, or null."""
    return F.nullif(F.regexp_extract(name, SUBSET_TAG, 1), F.lit(""))


def has_flag(flags: Column, bit: int) -> Column:
    """Whether the flag of a bit, counted from 1, is set."""
    return flags.bitwiseAND(1 << (bit - 1)) != 0


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) == mask


def hex_facts(s: Column) -> Column:
    """struct(n_digits, n_other, is_odd) of a text read as a hexadecimal string; white space does not count."""
    bare = F.regexp_replace(s, r"[ \t\r\n\f\x00]", "")
    digits = F.char_length(F.regexp_replace(bare, "[^0-9A-Fa-f]", ""))
    return F.struct(digits.alias("n_digits"), (F.char_length(bare) - digits).alias("n_other"), (digits % 2 == 1).alias("is_odd"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    if x1 == x0:
        return F.lit(float(y0))
    return F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    """Type 2: c0 + x**n * (c1 - c0)."""
    p = F.pow(clamp(x, *domain), F.lit(float(n)))
    return [F.lit(float(a)) + p * F.lit(float(b - a)) for a, b in zip(c0, c1, strict=True)]


def stitching(x: Column, domain: tuple[float, float], bounds: list[float], encode: list[tuple[float, float]], functions: list[Callable[[Column], Column]]) -> Column:
    """Type 3: the sub-function of the interval that x falls into, over its re-encoded argument."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = functions[-1](interpolate(x, edges[-2], edges[-1], *encode[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(x < F.lit(float(bounds[i])), functions[i](interpolate(x, edges[i], edges[i + 1], *encode[i]))).otherwise(out)
    return out


def sampled(x: Column, samples: list[float], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Type 0 in one dimension: linear between the samples, clamped."""
    table = F.array(*[F.lit(float(s)) for s in samples])
    at = interpolate(clamp(x, *domain), domain[0], domain[1], 0, len(samples) - 1)
    low = F.least(F.floor(at), F.lit(len(samples) - 2)).cast("int") if len(samples) > 1 else F.lit(0)
    if len(samples) == 1:
        return F.lit(float(samples[0]))
    a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return a + (at - low) * (b - a)


def _half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def _truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def _int(x: Column) -> Column:
    return _truncated(x).cast("bigint")


def _safe(b: Column, value: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(value)


def _shift(a: Column, b: Column) -> Column:
    left = _int(a) * F.pow(F.lit(2.0), F.greatest(_int(b), F.lit(0))).cast("bigint")
    right = F.floor(_int(a) / F.pow(F.lit(2.0), F.greatest(-_int(b), F.lit(0))))
    return F.when(b >= 0, left).otherwise(right).cast("double")


def _angle(a: Column, b: Column) -> Column:
    d = F.degrees(F.atan2(a, b))
    return F.when(d < 0, d + 360.0).otherwise(d)


_ONE = {
    "neg": lambda a: -a, "abs": F.abs, "sqrt": lambda a: F.when(a < 0, F.lit(0.0)).otherwise(F.sqrt(a)), "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)),
    "ln": F.ln, "log": F.log10, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": _half_away, "truncate": _truncated,
    "cvi": _truncated, "cvr": lambda a: a, "not": lambda a: F.when(a == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
}
_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: _safe(b, F.try_divide(a, b)),
    "idiv": lambda a, b: _safe(b, _truncated(F.try_divide(_truncated(a), _truncated(b)))), "mod": lambda a, b: _safe(b, F.when(b != 0, a % b)),
    "atan": _angle, "exp": F.pow, "bitshift": _shift,
    "and": lambda a, b: _int(a).bitwiseAND(_int(b)).cast("double"), "or": lambda a, b: _int(a).bitwiseOR(_int(b)).cast("double"), "xor": lambda a, b: _int(a).bitwiseXOR(_int(b)).cast("double"),
}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def _blocks(source: str) -> list:
    """Nested lists of the words of `{ ... }`."""
    stack: list[list] = [[]]
    for word in re.findall(r"[{}]|[^\s{}]+", source):
        if word == "{":
            stack.append([])
        elif word == "}":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(word)
    return stack[0][0] if len(stack[0]) == 1 and isinstance(stack[0][0], list) else stack[0]


def _literal(c) -> int:
    if not isinstance(c, int):
        raise ValueError("copy, index and roll take counts that are written out")
    return c


def postscript(source: str, inputs: list[Column]) -> list[Column]:
    """Type 4: compile a calculator program to expressions, by running it over a stack of expressions. Booleans are 1
    and 0; a conditional runs both branches, whose stacks must end equally deep, and selects each value."""

    def run(program: list, stack: list) -> list:
        stack = list(stack)
        for i, word in enumerate(program):
            if isinstance(word, list):
                continue
            if word in ("if", "ifelse"):
                test = stack.pop()
                yes = run(program[i - 2] if word == "ifelse" else program[i - 1], stack)
                no = run(program[i - 1], stack) if word == "ifelse" else stack
                if len(yes) != len(no):
                    raise ValueError("the branches of a conditional leave stacks of different depth")
                stack = [y if y is n else F.when(_col(test) != 0, _col(y)).otherwise(_col(n)) for y, n in zip(yes, no, strict=True)]
            elif word in _ONE:
                stack.append(_ONE[word](_col(stack.pop())))
            elif word in _TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(_TWO[word](_col(a), _col(b)))
            elif word in _COMPARE:
                b, a = stack.pop(), stack.pop()
                stack.append(F.when(_COMPARE[word](_col(a), _col(b)), F.lit(1.0)).otherwise(F.lit(0.0)))
            elif word in ("true", "false"):
                stack.append(F.lit(1.0 if word == "true" else 0.0))
            elif word == "pop":
                stack.pop()
            elif word == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif word == "dup":
                stack.append(stack[-1])
            elif word == "copy":
                n = _literal(stack.pop())
                stack += stack[len(stack) - n :] if n else []
            elif word == "index":
                stack.append(stack[-1 - _literal(stack.pop())])
            elif word == "roll":
                j, n = _literal(stack.pop()), _literal(stack.pop())
                if n:
                    part = stack[-n:]
                    stack[-n:] = part[-j % n :] + part[: -j % n] if j % n else part
            else:
                stack.append(int(word) if re.fullmatch(r"[+-]?\d+", word) else F.lit(float(word)))
        return stack

    return [_col(c) for c in run(_blocks(source), [c.cast("double") for c in inputs])]


def _col(c) -> Column:
    return F.lit(float(c)) if isinstance(c, int) else c


def nearest(components: list[Column], palette: list[tuple[float, ...]]) -> Column:
    """The index of the palette entry of least squared distance, the first of several."""
    best, at = None, F.lit(0)
    for i, entry in enumerate(palette):
        d = sum(((c - F.lit(float(e))) * (c - F.lit(float(e))) for c, e in zip(components, entry, strict=True)), F.lit(0.0))
        best, at = (d, at) if best is None else (F.least(best, d), F.when(d < best, F.lit(i)).otherwise(at))
    return at


def typed_json(props: Column, path: str, kind: str) -> Column:
    """A value of a JSON text if it has the type, else null."""
    return F.try_variant_get(F.try_parse_json(props), path, kind)
