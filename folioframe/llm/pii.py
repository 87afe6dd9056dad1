"""PII replacement by keyed surrogates.

Detected entities are e-mail addresses, phone numbers, card and account numbers, IBANs, social security numbers, IPv4
addresses, access keys, assigned secrets, and names: the capitalised words after a title, and the same words wherever
else they stand in the document. The parts of an entity that tell who it is are replaced; its type, format, letter case,
script and the gender of a name stay: separators, country codes, a card's first digit and valid check digit, an IBAN's
valid check digits, an address's network class and a mail address's top-level domain are kept.

A part of n letters and digits is a number in its shape's mixed radix, and its surrogate comes from a keyed permutation
(Feistel rounds of BLAKE2b with cycle walking) of the numbers of that shape. So parts that differ get surrogates that
differ, and equal parts get the same one wherever they occur, whatever the format around them (coreference). Names are
built of syllables from a keyed hash of the name alone, whatever the title; a given name's ending tells its gender, by
the document's titles for that name or, where they do not say, by its own last letter.

Collision check: the distinct entities of the corpus are gathered (a shuffle of entities, no texts); a surrogate that
equals a real entity of its kind or the surrogate of a smaller entity is drawn again with the next attempt, until none
is left. There is no limit of rounds; it ends as no space can be used up. After GROW draws the surrogate of a mailbox or
domain is longer than the entity, by a letter more for every GROW draws, and names gain syllables. The other kinds have
a fixed format: where over a third of a space (all numbers of one format) is real, all its entities get the deranged
permutation of that space (one cycle through all of it), so that they stay distinct and none is its own surrogate, but
one may be another's. Only the entities that were drawn again have to be told to the second pass over the texts: as a broadcast of at
most MAX_TOLD rows, or, if there are more, by a join with the texts that hold them.

Cases: a null text stays null and an empty one empty; texts without entities stay as they are, byte by byte; extra
columns pass through `keep`; repeated rows get the same result. The result depends on the key and the set of entities,
never on order or partitions.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.runtime import persisted

MAX_TOLD = 100_000
#: Draws within the shape of a mailbox or domain.
GROW = 8
#: A space is crowded if this many times its entities are more than it holds.
CROWDED = 3
#: The attempt that stands for the deranged permutation.
DERANGED = -1
#: Kinds of a fixed format.
FIXED = ("ip", "card", "phone", "ssn", "iban", "access", "secret")
ROUNDS = 8

# Titles with the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f",
}
# Syllables of surrogate names and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve".split(),
    "cyrillic": "ба бе би бо ва ве га го да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε γα γε δα δε ζα ζε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "lia", "n": "ris"},
    "cyrillic": {"m": "н", "f": "лия", "n": "рис"},
    "greek": {"m": "ς", "f": "λία", "n": "ρις"},
}

#: Capitals of the Latin, Greek and Cyrillic scripts.
_CAPITALS = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_NAME = rf"[{_CAPITALS}][^\W\d_]*(?:[-'’][^\W\d_]+)*"
#: Last letters that make a given name count as female where no title tells.
_FEMALE = "aαηая"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<access>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?:\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,}))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"
    r"|(?<![\w.-])0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}(?![ -]?[0-9]|[\w-]))"
    r"|(?P<card>(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?![\w]))"
    r"|(?P<title>(?<!\w)(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r"))\.?[ \t](?P<name>" + _NAME + r"(?:[ \t]" + _NAME + r"){0,3})"
)
#: A text without any of these has no entity.
_CLUE = re.compile(r"[0-9@=:]|" + "|".join(f"{re.escape(t)}[. \t]" for t in TITLES))

Part = tuple[str, str, list[int]]  # kind, normal form, places of its characters in the match


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _check_digit(digits: str) -> str:
    return next(c for c in "0123456789" if _luhn(digits + c))


def _script(name: str) -> str:
    label = unicodedata.name(name[0], "")
    return "cyrillic" if label.startswith("CYRILLIC") else "greek" if label.startswith("GREEK") else "latin"


def _network(octets: list[int]) -> int:
    """How many first octets tell the class of an address; 0: a public one."""
    a, b = octets[:2]
    if a in (0, 10, 127) or a >= 224:
        return 1
    return 2 if (a == 172 and 16 <= b < 32) or (a, b) in ((192, 168), (169, 254)) else 0


def _name_parts(value: str, genders: dict[str, str], neutral: str = "n") -> list[Part]:
    """The parts of a name: given names by gender, and its last word as the surname."""
    words = [(w.start(), w.group()) for w in re.finditer(r"\S+", value)]
    parts = []
    for i, (at, w) in enumerate(words):
        norm = w.lower()
        if i < len(words) - 1:
            gender = genders.get(norm, neutral)
            kind = f"given:{'f' if gender == 'n' and norm[-1] in _FEMALE else gender}:{_script(w)}"
        else:
            kind = f"surname:{_script(w)}"
        parts.append((kind, norm, list(range(at, at + len(w)))))
    return parts


def _named_again(text: str, names: list[str], genders: dict[str, str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[Part]]]:
    """Further mentions of the words of titled names, outside of other entities."""
    surnames = {n.split()[-1] for n in names}
    words = sorted({w for n in names for w in n.split()}, key=len, reverse=True)
    one = "|".join(map(re.escape, words))
    at = 0
    for m in re.finditer(rf"(?<!\w)(?:{one})(?:[ \t](?:{one}))*(?!\w)", text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        found = _name_parts(m.group(), genders)
        last = m.group().split()[-1]
        if last not in surnames:
            # A given name alone keeps the kind that it has in front of a surname.
            found = _name_parts(m.group() + " X", genders)[:-1]
        yield m.start(), m.end(), found


def find_parts(text: str) -> Iterator[tuple[int, int, list[Part]]]:
    """(start, end, parts) of each entity, in order."""
    matches = list(PATTERN.finditer(text))
    names = [m for m in matches if m.lastgroup == "name"]
    if not names:
        yield from map(_entity, matches)
        return
    genders: dict[str, str] = {}
    for m in names:
        if TITLES[m.group("title")] != "n":
            for w in m.group("name").split()[:-1]:
                genders.setdefault(w.lower(), TITLES[m.group("title")])
    found = [(m.start("name"), m.end("name"), _name_parts(m.group("name"), genders)) if m.lastgroup == "name" else _entity(m) for m in matches]
    found += list(_named_again(text, [m.group("name") for m in names], genders, [(a, b) for a, b, _ in found]))
    yield from sorted(found, key=lambda e: e[0])


def _entity(m: re.Match) -> tuple[int, int, list[Part]]:
    kind = m.lastgroup
    value = m.group(kind)
    places = [i for i, c in enumerate(value) if c.isalnum()]
    if kind == "email":
        at, dot = value.index("@"), value.rindex(".")
        parts = [("mailbox", value[:at].lower(), [i for i in range(at) if value[i].isalnum()])]
        parts.append(("domain", value[at + 1 : dot].lower(), [i for i in range(at + 1, dot) if value[i].isalnum()]))
        return m.start(kind), m.end(kind), [p for p in parts if p[2]]
    if kind == "access":
        places = places[4:]
    elif kind == "phone" and value[0] == "+":
        cc = re.match(r"\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{10}$)", value)
        places = places[len(cc.group(1)) if cc else 1 :]
    return m.start(kind), m.end(kind), [(kind, "".join(value[i] for i in places), places)]


def _remainder(iban: str) -> int:
    """The rest modulo 97 of an IBAN, its first four characters last and letters as numbers from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _permuted(key: bytes, tweak: str, x: int, n: int, back: bool = False) -> int:
    """A keyed permutation of 0..n - 1, or its inverse."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        if back:
            left, right = right, left
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            h = hashlib.blake2b(f"{tweak}|{r}|{half}|{right}".encode(), key=key, digest_size=max(16, half // 8 + 9)).digest()
            left, right = right, left ^ (int.from_bytes(h, "big") & mask)
        if back:
            left, right = right, left
        x = left << half | right
        if x < n:
            return x


def _deranged(key: bytes, tweak: str, x: int, n: int) -> int:
    """A keyed permutation of 0..n - 1 that is one cycle; walked on to the next member of a subset, it is one there."""
    return _permuted(key, tweak, (_permuted(key, tweak, x, n) + 1) % n, n, back=True)


_SETS = {"d": "0123456789", "h": "0123456789abcdef", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "k": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _shape(kind: str, norm: str) -> str:
    """A class for each character: that of its set in _SETS, or `-` for those that stay."""
    if kind == "access":
        return "k" * len(norm)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", norm):
        return "h" * len(norm)
    return "".join("d" if c in _SETS["d"] else "l" if c in _SETS["l"] else "u" if c in _SETS["u"] else "-" for c in norm)


def _space(kind: str, norm: str) -> tuple[str, int]:
    """The name and size of the space of an entity of a fixed format."""
    if kind == "ip":
        octets = [int(x) for x in norm.split(".")]
        keep = _network(octets)
        public = 221 * 256**3 - 18 * 256**2
        return f"{kind}|{octets[:keep]}", 256 ** (4 - keep) if keep else public
    if kind == "card":
        valid = _luhn(norm)
        return f"{kind}|{len(norm)}|{norm[0]}|{valid}", (1 if valid else 9) * 10 ** (len(norm) - 2)
    if kind == "phone" and len(norm) == 10:
        area = norm[0] > "1"
        return f"{kind}|10|{area}", (8 if area else 2) * 10**9
    if kind == "iban":
        valid, shape = _remainder(norm) == 1, _shape(kind, norm[4:])
        return f"{kind}|{norm[:2]}|{valid}|{shape}", (1 if valid else 96) * math.prod(len(_SETS[s]) for s in shape)
    shape = _shape(kind, norm)
    size = math.prod(len(_SETS[s]) for s in shape if s != "-")
    if kind == "secret" and "h" not in shape and not set(shape) & {"u", "-"}:
        size -= math.prod({"d": 10, "l": 6}[s] for s in shape)
    fixed = "".join(c for c, s in zip(norm, shape, strict=True) if s == "-")
    return f"{kind}|{shape}|{fixed}", size


def _same_shape(key: bytes, tweak: str, norm: str, shape: str, move: Callable[[bytes, str, int, int], int] = _permuted) -> str:
    x, n = 0, 1
    for c, s in zip(norm, shape, strict=True):
        if s != "-":
            n *= len(_SETS[s])
            x = x * len(_SETS[s]) + _SETS[s].index(c)
    x = move(key, f"{tweak}|{shape}", x, n)
    out = []
    for c, s in zip(reversed(norm), reversed(shape), strict=True):
        if s != "-":
            x, r = divmod(x, len(_SETS[s]))
            c = _SETS[s][r]
        out.append(c)
    return "".join(reversed(out))


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate's normal form of an entity part, of the same kind and shape, but for
    later attempts of what may grow."""
    tweak = f"{kind}|{attempt}"
    move = _deranged if attempt == DERANGED else _permuted
    if kind == "ip":
        octets = [int(x) for x in norm.split(".")]
        keep = _network(octets)
        x = int.from_bytes(bytes(octets[keep:]), "big")
        while True:
            x = move(key, f"{tweak}|{octets[:keep]}", x, 256 ** (4 - keep))
            new = octets[:keep] + list(x.to_bytes(4 - keep, "big"))
            if _network(new) == keep:
                return ".".join(map(str, new))
    if kind == "card":
        if _luhn(norm):
            body = norm[0] + _same_shape(key, f"{tweak}|luhn|{norm[0]}", norm[1:-1], "d" * (len(norm) - 2), move)
            return body + _check_digit(body)
        # The permuted digits of one without a valid check digit may have one by chance; the walk goes on then.
        out = norm
        while True:
            out = norm[0] + _same_shape(key, f"{tweak}|plain|{norm[0]}", out[1:], "d" * (len(norm) - 1), move)
            if not _luhn(out):
                return out
    if kind == "iban":
        country, out = norm[:2], norm
        if _remainder(norm) == 1:
            body = _same_shape(key, f"{tweak}|{country}", norm[4:], _shape(kind, norm[4:]), move)
            return f"{country}{98 - _remainder(f'{country}00{body}'):02d}{body}"
        while True:
            out = country + _same_shape(key, f"{tweak}|plain|{country}", out[2:], _shape(kind, out[2:]), move)
            if _remainder(out) != 1:
                return out
    if kind == "phone" and len(norm) == 10 and norm[0] > "1":
        out = norm
        while True:
            out = _same_shape(key, f"{tweak}|area", out, "d" * 10, move)
            if out[0] > "1":
                return out
    if kind.startswith(("given", "surname")):
        script = kind.rsplit(":", 1)[1]
        x = int.from_bytes(hmac.new(key, f"{kind.split(':')[0]}:{script}|{attempt}|{norm}".encode(), "sha256").digest(), "big")
        syllables = SYLLABLES[script]
        out = []
        for _ in range(3 + (kind[0] == "s") + attempt // 2):
            x, r = divmod(x, len(syllables))
            out.append(syllables[r])
        return "".join(out) + (ENDINGS[script][kind.split(":")[1]] if kind[0] == "g" else "")
    if kind in ("mailbox", "domain"):
        end = 1 + max(i for i, c in enumerate(norm) if c.isalnum())
        norm = norm[:end] + "a" * (attempt // GROW) + norm[end:]
    shape = _shape(kind, norm)
    out = norm
    while True:
        out = _same_shape(key, tweak, out, shape, move)
        if attempt != DERANGED or _space(kind, out) == _space(kind, norm):
            return out


def _normal(kind: str, norm: str, value: str) -> str:
    return value if kind == "ip" else norm


def _written(value: str, part: Part, new: str) -> str:
    """The part of `value` replaced by the surrogate's characters, in the format and case of the old ones."""
    kind, norm, places = part
    if kind == "ip":
        return new
    chars = list(value)
    if kind.startswith(("given", "surname")):
        old = value[places[0] : places[-1] + 1]
        new = new.upper() if old.isupper() and len(old) > 1 else new[0].upper() + new[1:]
        chars[places[0]] = new
        for i in places[1:]:
            chars[i] = ""
        return "".join(chars)
    letters = [c for c in new if c.isalnum()]
    letters = [*letters[: len(places) - 1], "".join(letters[len(places) - 1 :])]
    for i, c in zip(places, letters, strict=True):
        chars[i] = c.upper() if value[i].isupper() else c
    return "".join(chars)


def rewrite(key: bytes, text: str, told: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of its entities."""
    if not _CLUE.search(text):
        return text, []
    out, at, kinds = [], 0, []
    for start, end, parts in find_parts(text):
        value = text[start:end]
        new = value
        # Parts change length, so the last part goes first.
        for part in reversed(parts):
            norm = _normal(part[0], part[1], value)
            new = _written(new, part, surrogate(key, part[0], norm, told.get((part[0], norm), 0)))
        out += [text[at:start], new]
        at = end
        kinds.append("email" if parts[0][0] in ("mailbox", "domain") else parts[-1][0].split(":")[0] if ":" not in parts[-1][0] else "name")
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, norm) of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for t in batch.column(0).to_pylist():
                if t and _CLUE.search(t):
                    for start, end, parts in find_parts(t):
                        found.update((k, _normal(k, n, t[start:end])) for k, n, _ in parts)
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "norm"])

    return docs.select(text).mapInArrow(run, "kind string, norm string").distinct()


def _drawn(df: DataFrame, key: bytes) -> DataFrame:
    """Add the surrogate of (kind, norm, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, norm, attempt = (batch.column(i) for i in range(3))
            new = [surrogate(key, *x) for x in zip(kind.to_pylist(), norm.to_pylist(), attempt.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([kind, norm, attempt, pa.array(new, pa.string())], names=["kind", "norm", "attempt", "new"])

    return df.select("kind", "norm", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, norm string, attempt int, new string")


def _crowded(found: DataFrame) -> DataFrame:
    """(kind, norm) of the entities of crowded spaces. Spaces that all entities together would not crowd are not counted."""
    total = found.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *_space(k, n)) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [r for r in rows if r[3] < CROWDED * total]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "norm", "space", "size"])

    small = found.where(F.col("kind").isin(*FIXED)).select("kind", "norm").mapInArrow(run, "kind string, norm string, space string, size bigint")
    full = small.groupBy("space").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.col("n") * CROWDED > F.col("size"))
    return small.join(full.select("space"), "space", "left_semi").select("kind", "norm")


def resolve(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate would not do."""
    now = persisted(_drawn(found.withColumn("attempt", F.lit(0)), key), "drawn")
    crowded = persisted(_crowded(now), "crowded")
    if crowded.head(1):
        rest = now.join(crowded, ["kind", "norm"], "left_anti")
        now = persisted(rest.unionByName(_drawn(crowded.withColumn("attempt", F.lit(DERANGED)), key)), "drawn")
    while True:
        real = now.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
        first = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        bad = first.where("n > 1").drop("n").join(now, ["kind", "new"]).where("struct(attempt, norm) <> first").select("kind", "norm")
        bad = bad.unionByName(now.where(F.col("attempt") != DERANGED).join(real, ["kind", "new"], "left_semi").select("kind", "norm")).distinct()
        bad = persisted(bad.withColumn("bad", F.lit(1)), "again")
        if not bad.head(1):
            return now.where("attempt <> 0").select("kind", "norm", "attempt")
        next_ = now.join(bad, ["kind", "norm"], "left")
        good = next_.where("bad IS NULL").drop("bad")
        again = next_.where("bad = 1").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        now = persisted(good.unionByName(_drawn(again, key)), "drawn")


def replace(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",), text: str = "text", max_told: int = MAX_TOLD) -> DataFrame:
    """`keep`, the text with surrogates under its own name, n_entities and kinds (array, in the order of the text)."""
    keep = list(keep)
    told = persisted(resolve(entities(docs, text), key), "told")
    rows = told.limit(max_told + 1).collect()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(text, T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    few = {(r.kind, r.norm): r.attempt for r in rows} if len(rows) <= max_told else None
    source = docs.select(*keep, F.col(text).alias("__text"))
    if few is None:
        source = _with_told(source, told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            mine = [few] * len(texts) if few is not None else [{(x["kind"], x["norm"]): x["attempt"] for x in t or ()} for t in batch.column(len(keep) + 1).to_pylist()]
            done = [(None, []) if t is None else rewrite(key, t, m) for t, m in zip(texts, mine, strict=True)]
            cols = [pa.array([x for x, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int32()), pa.array([k for _, k in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    return source.mapInArrow(run, schema)


def _with_told(source: DataFrame, told: DataFrame) -> DataFrame:
    """Add to each text the drawn-again entities that it holds, by way of hashes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for a, b, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t and _CLUE.search(t):
                    for start, end, parts in find_parts(t):
                        out.update((a, b, k, _normal(k, n, t[start:end])) for k, n, _ in parts)
            cols = list(zip(*sorted(out), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["__h1", "__h2", "kind", "norm"])

    hashed = source.withColumn("__h1", F.xxhash64("__text")).withColumn("__h2", F.md5("__text"))
    held = hashed.select("__h1", "__h2", "__text").mapInArrow(run, "__h1 bigint, __h2 string, kind string, norm string").distinct()
    held = held.join(told, ["kind", "norm"]).groupBy("__h1", "__h2").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("__told"))
    return hashed.join(held, ["__h1", "__h2"], "left").drop("__h1", "__h2")
