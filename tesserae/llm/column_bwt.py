"""Exact removal of long repeats by column-wise construction over many documents.

A byte is removed if a ``length``-byte string that covers it starts anywhere else in the corpus.

1. Anchors: every such string holds a content-defined anchor, and equal strings hold the same
   one at the same offset.  Anchors whose hash occurs once cannot lie in a repeat.
2. Occurrences of a repeated anchor whose whole context (all strings around the anchor) occurs
   twice are repeats from end to end; one occurrence stands for each different context.
3. The remaining contexts of an anchor form a collection of short documents aligned at the
   anchor.  Its Burrows-Wheeler transform is built column by column, one symbol per document a
   round: the round's symbols, in the order of the suffixes behind them, are the transform's new
   column; a stable sort by symbol gives the order of the suffixes one longer, and the common
   prefixes of neighbours follow from range minima of the old ones.  The columns of the input are
   read from, and each round's transform and common prefixes are written to and read back from,
   sequential external files.  Where the common prefix with a neighbour reaches ``length``, the
   string that starts in that column is a repeat.
4. Anchors with very many different contexts are dealt to blocks; strings that are single in
   their block are matched across blocks by 128-bit hashes, which aggregation pre-combines.

Equal contexts are one document of the collection with a multiplicity, so copies cost no round.
The external files are scratch of one task: nobody else reads them, and a task that is run again
writes its own.  Long texts are looked at in overlapping windows, so that the arrays in memory
do not grow with a text.

Defined results: null text counts as empty; matches never cross rows; repeated rows are copies of
each other; texts shorter than ``length`` stay whole; texts of any length are exact; empty tables
give empty results; other columns are ignored, whatever their names; ties cannot arise.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import BYTE_VALUES, blocks, mix64, prefix_sums, range_hashes, release, saved, text_bytes

GRAM = 80
BLOCK = 8192  #: different contexts of one anchor built together
BATCH = 32_768  #: contexts built side by side, of many anchors
TEXT = 1 << 19


def _keyed(docs: DataFrame, seed: int = 7) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text, F.lit(seed)).alias("dk"), text.alias("text"))


def _seed(docs: DataFrame) -> int:
    """A seed under which different rows have different keys."""
    seed = 7
    while True:
        text = F.coalesce("text", F.lit(""))
        other = F.xxhash64(F.lit(seed + 1), text, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        keys = _keyed(docs, seed).select("dk", other.alias("other"))
        if keys.groupBy("dk").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").isEmpty():
            return seed
        seed += 2


def _pieces(texts: list[bytes], length: int):
    """(first index, texts, offset, core): blocks of short texts, and windows of long ones with ``length`` bytes more on either side.

    ``core`` is the range of offsets at which strings of a window start; None stands for all.
    """
    short: list[bytes] = []
    at = 0
    for i, t in enumerate([*texts, b""]):
        last = i == len(texts)
        if last or len(t) > 2 * TEXT:
            for first, part in blocks(short, TEXT):
                yield at + first, part, 0, None
            short, at = [], i + 1
            if not last:
                for begin in range(0, max(1, len(t) - length + 1), TEXT):
                    low = max(0, begin - length)
                    yield i, [t[low : begin + TEXT + 2 * length]], low, (begin, begin + TEXT)
        else:
            short.append(t)


def _occurrences(keyed: DataFrame, length: int, gram: int, full: bool) -> DataFrame:
    """(h) or (h, context, dk, spot): spot packs the anchor's offset and how far its context reaches right of it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, dk = text_bytes(b.column(1)), b.column(0).to_numpy()
            seen = (-1, -1)  # the last anchor of a long text: neighbouring windows may share it
            for at, part, low, core in _pieces(texts, length):
                size = np.array([len(t) for t in part], dtype=np.int64)
                if core is None:
                    doc, pos, h = anchors(part, length, gram)
                else:
                    inner = part[0][core[0] - low : core[1] - low + length - 1]
                    doc, pos, h = anchors([inner], length, gram)
                    pos = pos + core[0] - low
                    keep = slice(int(len(pos) > 0 and (at, int(pos[0]) + low) == seen), None)
                    doc, pos, h = doc[keep], pos[keep], h[keep]
                    if len(pos):
                        seen = (at, int(pos[-1]) + low)
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
                    continue
                start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
                sums = prefix_sums(np.frombuffer(b"\0".join(part) + b"\0", dtype=np.uint8))
                left, right = np.minimum(pos, length - gram), np.minimum(size[doc] - pos, length)  # a window reaches as far as a context does
                ctx = range_hashes(sums, start[doc] + pos - left, start[doc] + pos + right) + left.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mix64(ctx).view(np.int64)), pa.array(dk[at + doc]), pa.array((pos + low) * 1024 + right)], names=["h", "context", "dk", "spot"])

    return keyed.select("dk", "text").mapInArrow(run, "h long, context long, dk long, spot long" if full else "h long")


class Columns:
    """Byte columns of aligned contexts in a sequential external file, read from the last to the first."""

    def __init__(self, rows: list[bytes], left: np.ndarray, wide_left: int, wide_right: int) -> None:
        self.m, self.first = len(rows), -wide_left
        wide = wide_left + wide_right
        grid = np.zeros((wide, self.m), dtype=np.uint8)
        size = np.array([len(r) for r in rows], dtype=np.int64)
        for at in range(0, self.m, 2048):  # few at a time: an index is eight times a byte
            n = size[at : at + 2048]
            flat = np.frombuffer(b"".join(rows[at : at + 2048]), dtype=np.uint8)
            inner = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(wide_left - left[at : at + 2048], n)
            grid[inner, np.repeat(np.arange(at, at + len(n)), n)] = flat
        self.left, self.right = left, size - left
        self.file = tempfile.TemporaryFile()
        self.file.write(grid.data)

    def read(self, c: int) -> np.ndarray:
        """Symbols of column c: 0 outside a context, else the byte plus one."""
        self.file.seek((c - self.first) * self.m)
        sym = np.frombuffer(self.file.read(self.m), dtype=np.uint8).astype(np.int64) + 1
        sym[(c < -self.left) | (c >= self.right)] = 0
        return sym


class Rounds:
    """The transform and the common prefixes, a record a round, in two sequential external files."""

    def __init__(self, m: int) -> None:
        self.m, self.n = m, 0
        self.transform, self.prefixes = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.transform.write(bwt.astype("<u2").data)
        self.prefixes.write(lcp.astype("<u2").data)
        self.n += 1

    def _read(self, file, k: int) -> np.ndarray:
        file.seek(2 * self.m * k)
        got = np.frombuffer(file.read(2 * self.m), dtype="<u2").astype(np.int64)
        file.seek(0, 2)
        return got

    def bwt(self, k: int) -> np.ndarray:
        return self._read(self.transform, k)

    def lcp(self, k: int) -> np.ndarray:
        return self._read(self.prefixes, k)

    def close(self) -> None:
        self.transform.close()
        self.prefixes.close()


def _by_symbol(group: np.ndarray, bwt: np.ndarray) -> np.ndarray:
    """The stable order by (group, symbol): the last-to-first mapping of a round."""
    key = group * 257 + bwt
    fall = key[1:] < key[:-1]
    perm = np.arange(len(key))
    if fall.any():
        messy = np.zeros(len(key), dtype=bool)
        hit = np.unique(group[1:][fall])
        messy = hit[np.minimum(np.searchsorted(hit, group), len(hit) - 1)] == group
        at = np.flatnonzero(messy)
        perm[at] = at[np.argsort(key[at], kind="stable")]
    return perm


def construct(group: np.ndarray, rows: list[bytes], left: np.ndarray, length: int, gram: int, kept: Rounds | None = None):
    """Yields (column, order, common prefix with the one before) for columns 0, -1, ..., as each round's record is read back.

    ``group`` is ascending; suffixes are only compared within a group.  All suffixes of a round
    start in the same column, and a group keeps its place in the order.
    """
    wide = length - gram
    cols = Columns(rows, left, wide, length)
    m = len(rows)
    files = kept or Rounds(m)
    order = np.arange(m)
    begin = np.concatenate(([True], group[1:] != group[:-1]))
    for k, c in enumerate(range(length - 1, -wide - 1, -1)):
        lcp = files.lcp(k - 1) if k else np.zeros(m, dtype=np.int64)
        sym = cols.read(c)
        bwt = sym[order]
        perm = _by_symbol(group, bwt)
        moved = bwt[perm]
        same = np.concatenate(([False], (moved[1:] == moved[:-1]) & (group[1:] == group[:-1]))) & (moved > 0)
        nxt = np.zeros(m, dtype=np.int64)
        before = np.concatenate(([0], perm[:-1]))
        close = same & (perm == before + 1)
        nxt[close] = lcp[perm[close]] + 1
        far = np.flatnonzero(same & ~close)
        if len(far):
            ends = np.stack((before[far] + 1, perm[far] + 1), 1).ravel()
            nxt[far] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2] + 1
        nxt[begin] = 0
        order = order[perm]
        files.write(bwt, nxt)
        if c <= 0:
            yield c, order, files.lcp(k)
    cols.file.close()
    if kept is None:
        files.close()


def rebuild(files: Rounds, group: np.ndarray) -> list[bytes]:
    """Each context again, from the transform alone: follow the last-to-first mapping round by round."""
    at = np.arange(files.m)
    found = []
    for k in range(files.n):
        bwt = files.bwt(k)
        found.append(bwt[at])
        place = np.empty(files.m, dtype=np.int64)
        place[_by_symbol(group, bwt)] = np.arange(files.m)
        at = place[at]
    grid = np.stack(found[::-1], 1)
    return [bytes(int(x) - 1 for x in row if x) for row in grid]


def repeats(group: np.ndarray, rows: list[bytes], left: np.ndarray, length: int, gram: int, hot: np.ndarray):
    """(row, column) of every repeated string, and for hot groups the (row, column, single) of one of each different string."""
    found, others = [], []
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    for c, order, lcp in construct(group, rows, left, length, gram):
        long = lcp >= length
        twice = long | np.append(long[1:], False)
        hit = order[twice]
        found.append(np.stack((hit, np.full(len(hit), c)), 1))
        if hot.any():
            heads = ~long & hot[order] & (left[order] >= -c)
            heads &= sizes[order] - left[order] - c >= length
            who = order[heads]
            others.append(np.stack((who, np.full(len(who), c), ~twice[heads]), 1))
    return np.concatenate(found), (np.concatenate(others) if others else np.zeros((0, 3), dtype=np.int64))


_STRINGS = "dk long, s long, e long, k1 long, k2 long, single boolean"


def _build(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeats of contexts (h, salt, hot, dk, pos, lft, body), which come sorted by (h, salt): rows (dk, s, e) or, for hot anchors, strings with their hashes."""

    def solve(part: list[tuple]):
        import pyarrow as pa

        names: dict = {}
        group = np.array([names.setdefault((r[0], r[1]), len(names)) for r in part], dtype=np.int64)
        rows, left = [r[6] for r in part], np.array([r[5] for r in part], dtype=np.int64)
        hot, dk, pos = np.array([r[2] for r in part], dtype=bool), np.array([r[3] for r in part], dtype=np.int64), np.array([r[4] for r in part], dtype=np.int64)
        found, others = repeats(group, rows, left, length, gram, hot)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        if len(found):  # runs of columns become one span
            new = np.concatenate(([True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1] + 1)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(found)) - 1
            who = found[first, 0]
            nil = pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(dk[who]), pa.array(pos[who] + found[first, 1]), pa.array(pos[who] + found[last, 1] + length), nil, nil, pa.array(np.ones(len(who), dtype=bool))], names=["dk", "s", "e", "k1", "k2", "single"])
        if len(others):
            who, c = others[:, 0], others[:, 1]
            size = np.array([len(r) for r in rows], dtype=np.int64)
            base = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
            at = base[who] + left[who] + c
            anchor = np.array([r[0] for r in part], dtype=np.int64).view(np.uint64)[who]
            k1 = mix64(range_hashes(prefix_sums(flat), at, at + length) + anchor) + c.astype(np.uint64)  # one string may hold several anchors
            k2 = range_hashes(prefix_sums(flat, mix64(BYTE_VALUES)), at, at + length)
            yield pa.RecordBatch.from_arrays([pa.array(dk[who]), pa.array(pos[who] + c), pa.array(pos[who] + c + length), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(others[:, 2].astype(bool))], names=["dk", "s", "e", "k1", "k2", "single"])

    def run(batches):
        part: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(part) >= BATCH and (r[0], r[1]) != (part[-1][0], part[-1][1]):
                    yield from solve(part)
                    part = []
                part.append(r)
        if part:
            yield from solve(part)

    return contexts.mapInArrow(run, _STRINGS)


def _contexts(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each wanted (h, salt, hot, dk, spot)."""
    lists = wanted.groupBy("dk").agg(F.collect_set(F.struct("h", "salt", "hot", "spot")).alias("want"))
    both = keyed.select("dk", "text").join(lists, "dk")

    def run(batches):
        import pyarrow as pa

        def out(rows):
            names = ["h", "salt", "hot", "dk", "pos", "lft", "body"]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows = []
        for b in batches:
            for dk, t, want in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                for w in want:
                    pos, right = divmod(w["spot"], 1024)
                    left = min(pos, length - gram)
                    rows.append((w["h"], w["salt"], w["hot"], dk, pos, left, t[pos - left : pos + right]))
                if len(rows) >= 8192:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return both.mapInArrow(run, "h long, salt int, hot boolean, dk long, pos long, lft int, body binary")


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(dk, s, e): byte spans that repeated strings cover, overlapping and in no order."""
    spark = docs.sparkSession
    keyed = _keyed(docs, seed)
    # saved, so that Spark sees plain tables on both sides of the join and can split a hot anchor's occurrences
    twice = saved(_occurrences(keyed, length, gram, False).groupBy("h").count().filter("count > 1").select("h"))
    release(spark)
    rows = saved(_occurrences(keyed, length, gram, True).join(twice, "h"))
    release(spark)
    contexts = rows.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dk", "spot")).alias("one"))
    contexts = saved(contexts.select("h", "context", "n", "one.dk", "one.spot"))
    copied = rows.join(contexts.filter("n > 1").select("h", "context"), ["h", "context"])
    pos, right = F.floor(F.col("spot") / 1024), F.col("spot") % 1024
    whole = saved(copied.select("dk", F.greatest(pos - (length - gram), F.lit(0)).alias("s"), (pos + right).alias("e")))
    mixed = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("h", "kinds")
    mixed = saved(mixed)  # as above: a plain table on either side
    wanted = contexts.join(mixed, "h").select("h", F.pmod(F.xxhash64("context"), F.ceil(F.col("kinds") / block)).cast("int").alias("salt"), (F.col("kinds") > block).alias("hot"), "dk", "spot")
    wanted = saved(wanted)
    release(spark)
    bodies = _contexts(keyed, wanted, length, gram)
    built = saved(_build(bodies.repartition("h", "salt").sortWithinPartitions("h", "salt"), length, gram))
    release(spark)
    spans = whole.unionByName(built.filter("k1 is null").select("dk", "s", "e"))
    strings = built.filter("k1 is not null")
    met = strings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2")
    return spans.unionByName(strings.filter("single").join(met, ["k1", "k2"]).select("dk", "s", "e"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row."""
    seed = _seed(docs)
    spans = repeated_spans(docs, length, gram, block, seed)
    lists = spans.groupBy("dk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    both = _keyed(docs, seed).join(lists, "dk", "left").select("doc_id", "text", "spans")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, spans in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                if not spans:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t))
                    continue
                kept, at, gone, runs, end = [], 0, 0, 0, -1
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    if s > end:
                        runs += 1
                        kept.append(t[at:s])
                        gone += e - s
                        at = end = e
                    elif e > end:
                        gone += e - end
                        at = end = e
                kept.append(t[at:])
                left = b"".join(kept)
                out.append((len(t), gone, runs, hashlib.sha256(left).hexdigest(), left))
            n, gone, runs, sha, left = zip(*out, strict=True) if out else ((), (), (), (), ())
            columns = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                columns.append(pa.array(left, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
