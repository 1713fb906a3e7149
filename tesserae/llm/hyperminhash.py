"""Near-duplicate documents by HyperMinHash.

A document's distinct shingle hashes are split into buckets by their leading bits; a bucket
keeps the smallest of the rest, compressed to a leading-zero count (6 bits) and the bits after
the leading one (10 bits).  Bands of registers propose buckets of documents.  Inside one, only
pairs with a leader are formed, never all pairs; the estimated Jaccard index, corrected for
register collisions, drops hopeless pairs, and full shingle sets confirm the others.

Whatever stays split inside a proposed bucket is settled exactly: shingles that no other
undecided document has bound a document's possible index from above.  Documents under the
threshold are done; the rest are compared with the most central member.  What is then still
split is settled by products of the incidence matrices of shared shingles, in chunks of a bucket
that fit a task; a chunk pair returns at most one link for each component it joins, no pairs.

Documents are grouped by two 64-bit hashes of their whole shingle set first, each over another family
of word and shingle hashes, so copies cost one row each and no pair; where sets that share the first
differ in the second, they are named anew.  A link must be confirmed in both families.  A leader of
very many pairs has its text dealt to several tasks.  Defined results: null text counts as empty; documents without words have an
empty set and link with nothing; rows that share a doc_id are linked and each gets a row; a null
doc_id has a null component and is not kept; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import blocks, discard, mix64, saved, text_bytes
from .shingles import shingle_sets

M = 128  #: registers
ROWS = 4  #: registers in a band: 32 bands miss a pair at 0.85 with a chance of 6e-11
MANTISSA = 10
#: Chance that two registers of different minima agree, about 2**-MANTISSA / 3 a bucket; measured on disjoint sets.
COLLISION = 0.0004
EMPTY = np.uint16(0xFFFF)
FAN = 1024  #: pairs of one leader that a task takes


def registers(owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """(n, M) compressed registers of sorted distinct shingle hashes."""
    bits = M.bit_length() - 1
    cell = owner * M + (gram >> np.uint64(64 - bits)).astype(np.int64)
    first = np.ones(len(cell), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = gram[first] << np.uint64(bits)
    width = 64 - bits
    top = np.zeros(len(rest), dtype=np.int64)  # leading zeros
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        top += np.where(low, step, 0)
        x = np.where(low, x << np.uint64(step), x)
    zeros = np.minimum(top, min(62, width))
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.full(n * M, EMPTY, dtype=np.uint16)
    out[cell[first]] = (zeros << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out.reshape(n, M)


def dense(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty bucket filled from the next one in the ring that is not, marked by its distance."""
    out = regs.astype(np.uint64)
    hole = regs == EMPTY
    some = ~hole.all(1)
    src, far = regs.astype(np.uint64), np.zeros(regs.shape, dtype=np.uint64)
    todo = hole & some[:, None]
    for step in range(1, M):
        if not todo.any():
            break
        shifted, full = np.roll(src, -step, 1), np.roll(~hole, -step, 1)
        fill = todo & full
        out[fill] = shifted[fill]
        far[fill] = step
        todo &= ~fill
    return out | (far << np.uint64(16))


def band_keys(regs: np.ndarray) -> np.ndarray:
    d = dense(regs).reshape(len(regs), M // ROWS, ROWS)
    key = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), d.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + d[:, :, k])
    return key


def _set_hashes(sets: list[tuple[np.ndarray, np.ndarray]], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each document's set, one from the shingles of either family."""
    out = []
    for (owner, gram), salt in zip(sets, (0xA5A5A5A5, 0x5DEECE66D1CE4E5B), strict=True):
        total = np.zeros(len(n), dtype=np.uint64)
        if len(gram):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total[owner[begin]] = np.add.reduceat(mix64(gram ^ np.uint64(salt)), begin)
        out.append(mix64(total + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, own, other, regs): own and other are hashes of the whole set, node is own; null for an empty set."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), text_bytes(b.column(1))
            for at, part in blocks(texts):
                owner, gram = shingle_sets(part)
                n = np.bincount(owner, minlength=len(part))
                own, other = (pa.array(h, pa.int64(), mask=n == 0) for h in _set_hashes([(owner, gram), shingle_sets(part, family=1)], n))
                regs = pa.array([r.tobytes() for r in registers(owner, gram, len(part))], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)).cast(pa.int64()), pa.array(n, pa.int64()), own, own, other, regs], names=["doc_id", "n_shingles", "node", "own", "other", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, own long, other long, regs binary")


def _sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with a node for each different set, and (node, rep, n, regs, own, other) of the sets."""
    seed = 0
    while True:
        agg = [F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("regs").alias("regs"), F.min("own").alias("own"), F.min("other").alias("other"), F.max("other").alias("last")]
        sets = saved(rows.filter("node is not null").groupBy("node").agg(*agg))
        if sets.filter("other <> last").isEmpty():
            return rows, sets.drop("last")
        seed += 1  # one hash was not enough to tell two sets apart: name all by both
        rows = saved(rows.withColumn("node", F.when(F.col("node").isNotNull(), F.xxhash64("own", "other", F.lit(seed)))))


def _bands(sets: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, M)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["node", "band"])

    return sets.select("node", "regs").mapInArrow(run, "node long, band long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    spot = np.searchsorted(y, x)
    both_have = int((y[np.minimum(spot, len(y) - 1)] == x).sum())
    return den * both_have >= num * (len(x) + len(y) - both_have)


def _confirm(pairs: DataFrame, texts: DataFrame, num: int, den: int, slack: float) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union, estimated from registers first, then counted on full sets."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("regs").alias("ra"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("regs").alias("rb"))
    # a leader of many pairs meets them in several tasks
    busy = saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("salts")).filter("salts > 1"))
    dealt, salts = pairs.withColumn("salt", F.lit(0)), F.coalesce("salts", F.lit(1))
    if busy.isEmpty():
        ta = ta.withColumn("salt", F.lit(0))
    else:
        dealt = pairs.join(busy, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("salts")
        ta = ta.join(busy, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    both = dealt.join(tb, "b").join(ta, ["a", "salt"]).select("a", "b", "ta", "ra", "tb", "rb")
    floor = num / den - slack

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ra, rb = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint16).reshape(-1, M) for k in (3, 5))
                used = (ra != EMPTY) | (rb != EMPTY)
                agree = ((ra == rb) & used).sum(1) / np.maximum(used.sum(1), 1)
                estimate = (agree - COLLISION) / (1 - COLLISION)
                go = np.flatnonzero(estimate >= floor)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                need = {}
                for k in go:
                    need.setdefault(a[k], (2, k))
                    need.setdefault(b[k], (4, k))
                keep = [int(k) for k in go]
                for family in (0, 1):  # a link must hold in both: no chance agreement of hashes makes one
                    asked = {x for k in keep for x in (a[k], b[k])}
                    names = [x for x in need if x in asked]
                    sets = {}
                    raw = [part.column(c)[int(k)].as_py() for c, k in (need[x] for x in names)]
                    for first, chunk in blocks([r.encode() for r in raw]):
                        owner, gram = shingle_sets(chunk, family=family)
                        cut = np.searchsorted(owner, np.arange(len(chunk) + 1))
                        for i in range(len(chunk)):
                            sets[names[first + i]] = gram[cut[i] : cut[i + 1]]
                    keep = [k for k in keep if _linked(sets[a[k]], sets[b[k]], num, den)]
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _unique_share(texts: DataFrame) -> DataFrame:
    """(node, n, own): set sizes, and how many shingles no other of these documents has."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = text_bytes(b.column(1))
            for at, part in blocks(raw):
                owner, gram = shingle_sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[at + owner]), pa.array(gram.view(np.int64))], names=["node", "gram"])

    grams = texts.select("node", "text").mapInArrow(run, "node long, gram long")
    single = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, slack: float = 0.22) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    ``slack`` is seven standard deviations of the estimate at the threshold (M registers): a pair
    that far below is left out before the exact count.
    """
    rows, sets = _sets(saved(signatures(docs)))
    bands = _bands(sets)
    hot = bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter("leader <> other").select("band", "leader")
    shared = saved(bands.join(hot, "band").select("band", "leader", "node"))
    involved = shared.select("node").distinct()
    wanted = sets.join(involved, "node").select("node", "rep", "regs", "own", "other")
    texts = saved(_with_text(docs, wanted))
    pairs = shared.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(_confirm(pairs, texts, num, den, slack))
    first, shared_ = links, shared
    links, labels = _settle(shared.select("band", "node"), texts, sets, links, num, den, slack)
    # rows that share a doc_id but not a set
    ids = rows.filter("doc_id is not null and node is not null")
    split = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    twice = saved(ids.join(split, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct())
    if not twice.isEmpty():
        labels = components(links.unionByName(twice))
    # the smallest doc_id of a component, by its different sets; a component's rows are never gathered
    lowest = saved(labels.join(sets.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component")))
    named = labels.join(lowest, "label").select("node", "component")
    named = saved(sets.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component", "rep").alias("component")))
    discard(texts, shared_, sets, first, twice, links, lowest, labels)  # what is left reads rows and named only
    out = rows.join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, regs, text) for (node, rep, regs, own, other): the text of one row whose set is the node's."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, want = text_bytes(b.column(2)), [b.column(i).to_numpy() for i in (3, 4)]
            keep = np.zeros(len(texts), dtype=bool)
            for at, part in blocks(texts):
                owner, gram = shingle_sets(part)
                have = _set_hashes([(owner, gram), shingle_sets(part, family=1)], np.bincount(owner, minlength=len(part)))
                keep[at : at + len(part)] = [bool(x) for x in (have[0] == want[0][at : at + len(part)]) & (have[1] == want[1][at : at + len(part)])]
            yield b.select(["node", "regs", "text"]).filter(pa.array(keep))

    named = docs.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "rep").select("node", "regs", "text", "own", "other")
    return named.mapInArrow(run, "node long, regs binary, text string").dropDuplicates(["node"])


CHUNK = 768  #: documents of a bucket compared side by side, fewer
CHUNK_BYTES = 16 << 20  #: where they are long


def _joined(labels: np.ndarray, texts: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs of confirmed links between different labels, as few as join them."""
    owner, gram = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    parts = [(at + o, g) for at, part in blocks(texts) for o, g in [shingle_sets(part)]]
    if parts:
        owner, gram = np.concatenate([o for o, _ in parts]), np.concatenate([g for _, g in parts])
    m = len(texts)
    size = np.bincount(owner, minlength=m)
    _, at, count = np.unique(gram, return_inverse=True, return_counts=True)
    both = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, col = owner[keep], both[at[keep]]
    inter = np.zeros((m, m), dtype=np.float32)
    for low in range(0, int(col.max()) + 1 if len(col) else 0, 4096):
        part = (col >= low) & (col < low + 4096)
        a = np.zeros((m, 4096), dtype=np.float32)
        a[row[part], col[part] - low] = 1
        inter += a @ a.T
    inter = inter.astype(np.int64)
    i, j = np.nonzero((den * inter >= num * (size[:, None] + size[None] - inter)) & (labels[:, None] < labels[None]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    _, first = np.unique(np.stack((labels[i], labels[j]), 1), axis=0, return_index=True) if len(i) else (None, [])
    for k in first:
        x, y = root(int(labels[i[k]])), root(int(labels[j[k]]))
        if x != y:
            again = [shingle_sets([texts[int(t[k])]], family=1)[1] for t in (i, j)]
            if _linked(*again, num, den):
                parent[x] = y
                out.append((int(i[k]), int(j[k])))
    return out


def _within(shared: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between the components that meet in a bucket, over (band, node, label)."""
    bytes_of = texts.select("node", F.octet_length("text").cast("long").alias("bytes"))
    size = shared.join(bytes_of, "node").groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("bytes") / CHUNK_BYTES)).alias("chunks"))
    x = shared.select("band", "node", "label").join(size, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    x = x.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    x = x.select("band", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), "node", "label")
    x = x.join(texts.select("node", "text"), "node").select("band", "lo", "hi", "node", "label", "text")

    def run(batches):
        import pyarrow as pa

        def links(group: list[tuple]) -> pa.RecordBatch:
            node = np.array([g[3] for g in group], dtype=np.int64)
            pairs = _joined(np.array([g[4] for g in group], dtype=np.int64), [(g[5] or "").encode() for g in group], num, den)
            return pa.RecordBatch.from_arrays([pa.array([int(node[i]) for i, _ in pairs], pa.int64()), pa.array([int(node[j]) for _, j in pairs], pa.int64())], names=["a", "b"])

        group: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                for r in zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True):
                    if group and r[:3] != group[0][:3]:
                        yield links(group)
                        group = []
                    group.append(r)
        if group:
            yield links(group)

    return x.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(run, "a long, b long")


def _settle(shared: DataFrame, texts: DataFrame, sets: DataFrame, links: DataFrame, num: int, den: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """Adds the links that pairs with the first leaders missed; returns all links and the components."""
    size = sets.select("node", "n")
    passes = 0
    while True:
        labels = components(links)
        at = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = at.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
        shared = saved(at.join(split, "band").select("band", "node", "label"))
        undecided = saved(shared.select("node").distinct())
        if undecided.isEmpty():
            return links, labels
        own = _unique_share(texts.join(undecided, "node", "left_semi"))
        bound = undecided.join(size, "node").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
        open_ = saved(bound.filter(F.col("common") * den >= F.col("n") * num))  # others reach the threshold with nobody
        shared = saved(shared.join(open_, "node"))
        if passes >= 1:
            break
        center = shared.groupBy("band").agg(F.max(F.struct(F.col("common") / F.col("n"), "node")).alias("m")).select("band", F.col("m.node").alias("leader"))
        star = shared.join(center, "band").filter("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        links = saved(links.unionByName(_confirm(star, texts, num, den, slack)))
        shared = shared.select("band", "node")
        passes += 1
    links = saved(links.unionByName(_within(shared, texts, num, den)))
    return links, components(links)
