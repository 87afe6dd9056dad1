"""Byte-level BPE by DuckDB queries in each partition.

Encoding: the pattern cuts a text into pieces. The bytes of each distinct piece become token-position rows
(w, p, id, q, nid): position, id, next position and next id. A recursive query joins them to the merge table (left id,
right id, rank), finds each piece's leftmost pair of minimum rank, contracts it, and goes on until no piece has a pair
left. The merge table holds every way to cut a token into two tokens, so ranks mean what they mean to the tiktoken
library. Decoding: token rows join the vocabulary and an aggregate ordered by position concatenates their bytes.

The plain recursion keeps the rows of all steps, so pieces of over LONG_PIECE bytes take a recursive query that keeps
the last state alone (USING KEY); a round contracts all occurrences, from the left, of a piece's minimum pair where the
vocabulary is `proper`: the ranks below a token's own build exactly two parts of it, so no contraction makes a pair of
lower rank. Elsewhere a round contracts the leftmost one.

Pieces found before are kept for the next batch, about `cache` of them (CACHE_PIECES) a Python worker. Memory is bounded by the batch
(SLICE_CHARS, or one longer text) and the cache; nothing is shuffled.

Cases: a null text counts as empty, has no tokens and decodes to nothing; repeated rows are coded each for itself; extra
columns named in `keep` pass through. Byte sequences that the vocabulary's single bytes do not cover raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_CHARS = 2_000_000
CACHE_PIECES = 1_000_000
LONG_PIECE = 400
PIECES_A_QUERY = 40_000
SHIFT = 20

_RECURSIVE = """
WITH RECURSIVE tok(step, w, p, id, q, nid) AS (
  SELECT 0, w, p, id, p + 1, nid FROM init
  UNION ALL
  SELECT t.step + 1, t.w, t.p, CASE WHEN t.p = h.p THEN h.m ELSE t.id END,
         CASE WHEN t.p = h.p THEN h.q2 ELSE t.q END,
         CASE WHEN t.p = h.p THEN h.nid2 WHEN t.q = h.p THEN h.m ELSE t.nid END
  FROM tok t JOIN (
    SELECT g.w, (g.b & 1048575)::INT AS p, (g.b >> 20)::INT AS m, u.p AS q, u.q AS q2, u.nid AS nid2
    FROM (SELECT t.w, min((x.m::BIGINT << 20) | t.p) AS b, arg_min(t.q, (x.m::BIGINT << 20) | t.p) AS q
          FROM tok t JOIN merges x ON x.k = ((t.id::BIGINT << 20) | t.nid) GROUP BY t.w) g
    JOIN tok u ON u.w = g.w AND u.p = g.q
  ) h ON t.w = h.w AND t.p <> h.q
)
SELECT w, id FROM tok JOIN (SELECT w, max(step) AS step FROM tok GROUP BY w) z USING (w, step) ORDER BY w, p
"""

#: The same for long pieces, keeping only the last state of a position (-1: contracted away). A round numbers the
#: candidates of minimum rank within runs that overlap and contracts every other one of a run, or only the leftmost of
#: the piece where `every` is false.
_ROUNDS = """
WITH RECURSIVE tok(w, p, id) USING KEY (w, p) AS (
  SELECT w, p, id FROM init
  UNION ALL
  SELECT w, p, id FROM (
    WITH t AS (SELECT w, p, id, lead(id) OVER z AS nid, lead(p) OVER z AS q, row_number() OVER z AS rn
               FROM recurring.tok WHERE id >= 0 AND w IN (SELECT w FROM tok) WINDOW z AS (PARTITION BY w ORDER BY p)),
    c AS (SELECT t.w, t.p, t.q, t.rn, x.m, min(x.m) OVER (PARTITION BY t.w) AS best
          FROM t JOIN merges x ON x.k = ((t.id::BIGINT << 20) | t.nid)),
    r AS (SELECT w, p, q, m, rn - row_number() OVER (PARTITION BY w ORDER BY p) AS run,
                 row_number() OVER (PARTITION BY w ORDER BY p) AS nth FROM c WHERE m = best),
    h AS (SELECT w, p, q, m FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS k FROM r) y
          WHERE k % 2 = 1 AND ({every} OR nth = 1))
    SELECT w, p, m AS id FROM h UNION ALL SELECT w, q, -1 FROM h
  ) n
)
SELECT w, id FROM tok WHERE id >= 0 ORDER BY w, p
"""

_DECODE = "SELECT d, array_to_string(list(s ORDER BY p), '') AS t FROM toks JOIN vocab USING (id) GROUP BY d"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def is_proper(ranks: dict[bytes, int]) -> bool:
    """Whether merging by the ranks below its own leaves exactly two parts of every token."""
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            low, i = min(pairs)
            if low >= rank:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class Codec:
    """One vocabulary in a DuckDB database of its own; lives as long as the Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = load_ranks(path)
        if max(ranks.values(), default=0) >= 1 << SHIFT:
            raise ValueError("ids of 2**20 and over are not supported")
        self.pattern = regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        cuts = [(ranks[k[:i]] << SHIFT | ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        self._load("merges", {"k": pa.array([a for a, _ in cuts], pa.int64()), "m": pa.array([b for _, b in cuts], pa.int32())})
        # Bytes travel as the code points of the same numbers.
        self._load("vocab", {"id": pa.array(list(ranks.values()), pa.int32()), "s": pa.array([k.decode("latin-1") for k in ranks], pa.string())})
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.proper: bool | None = None
        self._clear()

    def _load(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.decimals: list[bytes] = []
        self.ids = np.zeros(1 << 20, np.int32)
        self.at: list[int] = [0]

    def _init(self, pieces: list[bytes]) -> pa.Table:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lens = np.array([len(x) for x in pieces], np.int64)
        ends = np.cumsum(lens)
        ids = self.byte_ids[data]
        if len(ids) and ids.min() < 0:
            raise ValueError("the vocabulary lacks a single byte of the text")
        nid = np.append(ids[1:], np.int32(-1))
        nid[ends - 1] = -1
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        p = (np.arange(len(data)) - np.repeat(ends - lens, lens)).astype(np.int32)
        return pa.table({"w": w, "p": p, "id": ids, "nid": nid})

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces (none empty) and how many each has."""
        short = [i for i, x in enumerate(pieces) if len(x) <= LONG_PIECE]
        long = [i for i, x in enumerate(pieces) if len(x) > LONG_PIECE]
        found: dict[int, np.ndarray] = {}
        for lo in range(0, len(short), PIECES_A_QUERY):
            part = short[lo : lo + PIECES_A_QUERY]
            self._split(part, self._run(_RECURSIVE, self._init([pieces[i] for i in part])), found)
        for i in long:
            self._split([i], self._long(self._init([pieces[i]])), found)
        lens = np.array([len(found[i]) for i in range(len(pieces))], np.int64)
        return (np.concatenate([found[i] for i in range(len(pieces))]) if pieces else np.zeros(0, np.int32)), lens

    def _run(self, sql: str, init: pa.Table) -> pa.Table:
        self.con.register("init", init)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister("init")
        return out

    def _long(self, init: pa.Table) -> pa.Table:
        if self.proper is None:
            self.proper = is_proper(self.ranks)
        return self._run(_ROUNDS.format(every=str(self.proper).lower()), init)

    @staticmethod
    def _split(part: list[int], got: pa.Table, found: dict[int, np.ndarray]) -> None:
        w, ids = got.column("w").to_numpy(), got.column("id").to_numpy()
        cut = np.searchsorted(w, np.arange(len(part) + 1))
        for k, i in enumerate(part):
            found[i] = ids[cut[k] : cut[k + 1]]

    def learn(self, pieces: set[str]) -> None:
        """Add the pieces that are not known yet."""
        new = [x for x in pieces if x not in self.known]
        if not new:
            return
        flat, lens = self.encode_pieces([x.encode() for x in new])
        text = list(map(str, flat.tolist()))
        base, end = self.at[-1], self.at[-1] + len(flat)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:base], np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[base:end] = flat
        at, k = 0, len(self.decimals)
        for x, n in zip(new, lens.tolist(), strict=True):
            self.decimals.append(",".join(text[at : at + n]).encode())
            self.known[x] = k
            k += 1
            at += n
            self.at.append(base + at)

    def encode_texts(self, texts: list[str], cache: int = CACHE_PIECES) -> list[tuple[np.ndarray, list[int]]]:
        """For each text its ids and the numbers of its pieces in this codec's list."""
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.known) > cache:
            self._clear()
        self.learn({x for pieces in cut for x in pieces})
        at = np.array(self.at, np.int64)
        out = []
        for pieces in cut:
            k = list(map(self.known.__getitem__, pieces))
            idx = np.array(k, np.int64)
            out.append((gathered(self.ids, at[idx], at[idx + 1] - at[idx]) if k else np.zeros(0, np.int32), k))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        lens = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        p = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.con.register("toks", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "p": p, "id": flat.astype(np.int32)}))
        got = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("toks")
        out = [b""] * len(ids)
        for d, t in zip(got.column("d").to_pylist(), got.column("t").to_pylist(), strict=True):
            out[d] = t.encode("latin-1")
        return out


def gathered(values: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + lens[i]] for all i, end to end."""
    ends = np.cumsum(lens)
    idx = np.arange(int(ends[-1]) if len(ends) else 0)
    return values[idx + np.repeat(start - (ends - lens), lens)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def sliced(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _keep(df: DataFrame, keep: list[str]) -> list:
    return [df.schema[c] for c in keep]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, with_ids: bool = True, cache: int = CACHE_PIECES) -> DataFrame:
    """`keep`, n_tokens, and ids array<int> (with_ids); with digests also ids_sha256, decoded_sha256 of a round trip."""
    keep = list(keep)
    schema = T.StructType(_keep(df, keep) + [T.StructField("n_tokens", T.LongType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType(), False))
    if digests:
        schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [x or "" for x in column.to_pylist()]
            for i, j in sliced(texts):
                done = c.encode_texts(texts[i:j], cache)
                ids = [x for x, _ in done]
                out = list(batch.columns[: len(keep)])
                out = [x.slice(i, j - i) for x in out]
                out.append(pa.array([len(x) for x in ids], pa.int64()))
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                if digests:
                    d = c.decimals
                    out.append(pa.array([hashlib.sha256(b",".join([d[k] for k in ks])).hexdigest() for _, ks in done]))
                    out.append(pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(ids)]))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
        if len(c.known) > cache:
            c._clear()
        pa.default_memory_pool().release_unused()

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and decoded binary: the bytes of each row's ids (null: none)."""
    keep = list(keep)
    schema = T.StructType(_keep(df, keep) + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(c.decode(lists), pa.binary())], names=schema.names)

    return df.select(*keep, ids).mapInArrow(run, schema)
