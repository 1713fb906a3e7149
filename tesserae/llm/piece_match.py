"""SentencePiece encoding and decoding (byte-pair models) by suffix-array matching.

Texts are cut where no piece can cross (before a run of spaces, around characters that occur in
no longer piece); the distinct units of a batch are concatenated and indexed by a suffix array
sorted to the length of the longest piece.  Every piece of the vocabulary is binary-searched for
its range of occurrences; the resulting edges are put in order of position by a table of [length,
position], which says which spans of a unit are pieces.  Relaxation then joins neighbouring symbols along the best-scored edge (ties:
leftmost) until no edge joins two of them, which is the byte-pair segmentation; characters
without a piece fall back to byte pieces.

Defined results: null text counts as empty; an empty text has no tokens; repeated rows give
repeated results; a text holding U+2581 decodes to a space there, as the format has it (its
round trip is then false); of joins that tie in score the leftmost is first; whole texts are
encoded whatever their length; an empty table gives an empty result; other columns are ignored,
whatever their names.  A model that is not byte-pair, or that normalises texts, is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 48  #: longer units are relaxed one by one with a heap
CACHE = 400_000  #: units remembered by a worker
BLOCK = 3_000_000  #: characters of text indexed at a time
CHARS = 400_000  #: characters of distinct units in one suffix array


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message: integers and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


def check_model(proto: bytes) -> None:
    """Raises unless the model is byte-pair, keeps texts as they are and marks their start by a space."""
    trainer, normaliser = {}, {}
    for number, value in _fields(proto):
        if number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("only byte-pair models are encoded here")
    if normaliser.get(2, b"") or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only models without normalisation, with a space before the text, are encoded here")


class Vocabulary:
    """Pieces, scores and byte pieces of a model, small enough to travel with a task."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unk: int) -> None:
        self.pieces, self.unk, self.byte_ids = pieces, unk, byte_ids
        self.size = len(pieces)
        self.ids = np.array([i for i in range(self.size) if i not in special and i not in byte_ids.values()], dtype=np.int32)
        self.scores = np.array(scores, dtype=np.float64)
        self.longest = max((len(pieces[i]) for i in self.ids), default=1)
        inner = {c for i in self.ids if len(pieces[i]) > 1 for c in pieces[i]}
        crossing = any(a != SPACE and b == SPACE for i in self.ids for a, b in zip(pieces[i], pieces[i][1:], strict=False))
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner and c != " ")
        split = rf"[{alone}]|[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+" if alone else rf"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+"
        self.unit = re.compile(r"(?s).+" if crossing else split)
        raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            raw[i] = bytes([b])
        for i in special:
            raw[i] = b""
        if unk in special:
            raw[unk] = " ⁇ ".encode()
        self.raw = raw

    @cached_property
    def sizes(self) -> np.ndarray:
        """Characters of each piece that may occur in a text."""
        return np.array([len(self.pieces[i]) for i in self.ids], dtype=np.int64)

    @cached_property
    def codes(self) -> np.ndarray:
        """Those pieces as rows of code points, with zeros up to a multiple of four."""
        out = np.zeros((len(self.ids), -(-self.longest // 4) * 4), dtype=np.uint32)
        for row, i in zip(out, self.ids, strict=True):
            row[: len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        return out

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_model(sp.serialized_model_proto())
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], special, byte_ids, sp.unk_id())


def _keys(chars: np.ndarray, longest: int) -> list[np.ndarray]:
    """Four 16-bit characters a key: the first ``longest`` characters from every position on."""
    n = len(chars)
    padded = np.concatenate((chars.astype(np.uint64), np.zeros(longest + 4, dtype=np.uint64)))
    quad = np.zeros(n + longest, dtype=np.uint64)
    for k in range(4):
        quad = (quad << np.uint64(16)) | padded[k : k + n + longest]
    return [quad[k : k + n] for k in range(0, longest, 4)]


def _bound(keys: list[np.ndarray], want: list[np.ndarray], masks: list[np.ndarray], after: bool) -> np.ndarray:
    """First index whose masked key is not below (after: is above) the wanted one, for every piece at once."""
    n, m = len(keys[0]), len(want[0])
    lo, hi = np.zeros(m, dtype=np.int64), np.full(m, n, dtype=np.int64)
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, same = np.zeros(m, dtype=bool), np.ones(m, dtype=bool)
        for k, w, mask in zip(keys, want, masks, strict=True):
            got = k[mid] & mask
            less |= same & (got < w)
            same &= got == w
        go = (less | same) if after else less
        lo = np.where(live & go, mid + 1, lo)
        hi = np.where(live & ~go, mid, hi)


def _dense(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1) of the values; equal ones share a rank."""
    order = np.argsort(x)
    ranked = x[order]
    rank = np.empty(len(x), dtype=np.uint64)
    rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
    return order, rank


def _suffix_order(first: np.ndarray, longest: int) -> np.ndarray:
    """Positions in order of what follows them, from keys of four characters by doubling to ``longest`` at least."""
    order, rank = _dense(first)
    seen, n = 4, len(first)
    while seen < longest:
        later = np.zeros(n, dtype=np.uint64)
        later[: max(n - seen, 0)] = rank[seen:]
        order, rank = _dense(rank * np.uint64(n + 1) + later)
        seen *= 2
    return order


def _edges(chars: np.ndarray, v: Vocabulary) -> np.ndarray:
    """table[length, position] = piece id or -1, from the occurrence ranges of every piece in the suffix array."""
    alphabet, small = np.unique(chars, return_inverse=True)  # 0, the gap between units, comes first
    keys = _keys(small, v.longest)
    order = _suffix_order(keys[0], v.longest)
    sorted_keys = [k[order] for k in keys]
    spot = np.minimum(np.searchsorted(alphabet, v.codes), len(alphabet) - 1)
    known = np.flatnonzero((alphabet[spot] == v.codes).all(axis=1))
    table = np.full((v.longest + 1, len(chars)), -1, dtype=np.int32)
    if not len(known):
        return table
    sizes, wide = v.sizes[known], spot[known].astype(np.uint64)
    full = np.where(np.arange(wide.shape[1]) < sizes[:, None], np.uint64(0xFFFF), np.uint64(0))
    pack = lambda x, k: (x[:, 4 * k] << np.uint64(48)) | (x[:, 4 * k + 1] << np.uint64(32)) | (x[:, 4 * k + 2] << np.uint64(16)) | x[:, 4 * k + 3]
    want, masks = [pack(wide, k) for k in range(len(keys))], [pack(full, k) for k in range(len(keys))]
    lo, hi = _bound(sorted_keys, want, masks, False), _bound(sorted_keys, want, masks, True)
    count = hi - lo
    at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    table[np.repeat(sizes, count), order[at]] = np.repeat(v.ids[known], count)
    return table


def _relax_one(start: int, end: int, table: np.ndarray, v: Vocabulary) -> list[int]:
    """Symbol starts of one unit, with a heap of joins."""
    nxt = {i: i + 1 for i in range(start, end)}
    prev = {i: i - 1 for i in range(start, end)}
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < end and (k := nxt[j]) - i <= v.longest and (p := table[k - i, i]) >= 0:
            heapq.heappush(heap, (-v.scores[p], i, j, k))

    for i in range(start, end):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if nxt.get(i) != j or nxt.get(j) != k:
            continue
        nxt[i] = k
        del nxt[j]
        if k < end:
            prev[k] = i
        offer(i)
        if prev[i] >= start:
            offer(prev[i])
    out, i = [], start
    while i < end:
        out.append(i)
        i = nxt[i]
    return out


def _relax(starts: np.ndarray, ends: np.ndarray, table: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Joins in all units side by side, one a round in each: (symbol starts, symbol ends)."""
    unit = np.repeat(np.arange(len(starts)), ends - starts)
    sym = np.arange(len(unit)) + np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts)
    done_s, done_e = [], []
    score = np.append(v.scores, -np.inf)
    while len(sym):
        last = np.append(unit[1:] != unit[:-1], True)
        stop = np.append(sym[1:], 0)
        stop[last] = ends[unit[last]]
        span = np.append(stop[1:], 0) - sym
        can = ~last & (span <= v.longest)
        piece = np.full(len(sym), -1, dtype=np.int64)
        piece[can] = table[span[can], sym[can]]
        gain = score[piece]
        at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.maximum.reduceat(gain, at)
        size = np.diff(np.append(at, len(sym)))
        grows = np.repeat(best > -np.inf, size)
        done_s.append(sym[~grows])
        done_e.append(stop[~grows])
        hit = np.flatnonzero(grows & (gain == np.repeat(best, size)))
        first = hit[np.append(True, unit[hit][1:] != unit[hit][:-1])] if len(hit) else hit
        grows[first + 1] = False
        sym, unit = sym[grows], unit[grows]
    s, e = np.concatenate(done_s) if done_s else np.zeros(0, int), np.concatenate(done_e) if done_e else np.zeros(0, int)
    order = np.argsort(s)
    return s[order], e[order]


def encode_units(units: list[str], v: Vocabulary) -> list[bytes]:
    """The little-endian int32 ids of each unit."""
    text = "\0".join(u.replace(" ", SPACE).replace("\0", "") if "\0" in u else u.replace(" ", SPACE) for u in units) + "\0"
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(np.unique(chars)) > 65_000 and len(units) > 1:  # sixteen bits must name every character
        half = len(units) // 2
        return encode_units(units[:half], v) + encode_units(units[half:], v)
    table = _edges(chars, v)
    stops = np.flatnonzero(chars == 0)
    begins = np.concatenate(([0], stops[:-1] + 1))
    short = (stops - begins) <= LONG
    s, e = _relax(begins[short], stops[short], table, v)
    if not short.all():
        more = []
        for b, t in zip(begins[~short], stops[~short], strict=True):
            cut = [*_relax_one(int(b), int(t), table, v), int(t)]
            more += list(zip(cut[:-1], cut[1:], strict=True))
        m = np.array(more).reshape(-1, 2)
        s, e = np.concatenate((s, m[:, 0])), np.concatenate((e, m[:, 1]))
        order = np.argsort(s)
        s, e = s[order], e[order]
    ids = table[e - s, s]
    owner = np.searchsorted(begins, s, side="right") - 1
    lacking = np.flatnonzero(ids < 0)
    if len(lacking):
        parts, at = [], 0
        for i in lacking:
            parts.append(ids[at:i])
            c = chr(chars[s[i]])
            c = "\0" if c == "" and "\0" in units[owner[i]] else c
            parts.append(np.array([v.byte_ids[b] for b in c.encode()] if v.byte_ids else [v.unk], dtype=np.int32))
            at = i + 1
        parts.append(ids[at:])
        width = np.ones(len(ids), dtype=np.int64)
        width[lacking] = [len(p) for p in parts[1::2]]
        ids, owner = np.concatenate(parts), np.repeat(owner, width)
    cut = np.searchsorted(owner, np.arange(len(units) + 1))
    flat = ids.astype("<i4").tobytes()
    return [flat[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Coder:
    """Encodes and decodes texts; keeps the ids of the units it has met, up to a bound."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.seen = v, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.v.unit.findall(" " + t) if t else [] for t in texts]
        if len(self.seen) > CACHE:
            self.seen = {}
        fresh, size = [], 0
        for u in set().union(*split) - self.seen.keys():
            fresh.append(u)
            size += len(u) + 1
            if size > CHARS:
                self.seen.update(zip(fresh, encode_units(fresh, self.v), strict=True))
                fresh, size = [], 0
        if fresh:
            self.seen.update(zip(fresh, encode_units(fresh, self.v), strict=True))
        get = self.seen.__getitem__
        return [b"".join(map(get, us)) for us in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.v.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def _text_blocks(texts: list[str]):
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > BLOCK:
            yield texts[at:i]
            at, total = i, 0
        total += len(t)
    yield texts[at:]


def tokenize(docs: DataFrame, model_file: str = DEFAULT_MODEL, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip[, ids]) per row; ids_sha256 is over little-endian int32 ids."""
    v = Vocabulary.load(model_file)

    def run(batches):
        import pyarrow as pa

        coder = Coder(v)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            at = 0
            for part in _text_blocks(texts):
                codes = coder.encode(part)
                same = [coder.decode(c) == t for c, t in zip(codes, part, strict=True)]
                columns = [ids.slice(at, len(part)).cast(pa.int64()), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(c, "<i4") for c in codes], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "round_trip", "ids"][: len(columns)])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
