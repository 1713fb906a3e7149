"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

CLASH = "'x' AS dk, 'y' AS node, 'z' AS band, 1 AS h1, 2 AS pos, 'q' AS spans, 'l' AS label, 3 AS raw, 'g' AS w, 4 AS text_hash, 5 AS hit_pos, 'k' AS item_key, 'r' AS row_key, 6 AS regs"
LONG = ("lorem ipsum dolor sit amet consectetur " * 900).strip()
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", None, 7),
    (None, "a row without an id but with some words in it", "en", "c", 3),
    (6, "Licensed under the Apache License, Version 2.0.\n\n\nnot@mail x@y.zz +49 30 901820 10.1.2.3", "en", "c", 5),
    (7, "\n\n \n", "en", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *CLASH.split(", "))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats(spark, docs, empty):
    from tesserae.llm import column_bwt

    assert column_bwt.remove_repeats(empty).count() == 0
    got = column_bwt.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].n_bytes == 0 and by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].n_removed == len(LONG) == by[5].n_removed and by[4].n_spans == 1
    assert by[1].n_removed == 0  # shorter than 200 bytes, however often it is there


def test_lines(spark, docs, empty):
    from tesserae.llm import line_dedup

    assert line_dedup.clean(empty).count() == 0
    got = line_dedup.clean(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert got.count() == len(ROWS) and got.filter("n_removed > 0").count() == 0
    shared = spark.createDataFrame([(i, f"own {i}\n shared line \n", f"s{i % 4}") for i in range(8)] + [(9, None, None), (10, "shared line", None)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in line_dedup.clean(shared, threshold=5).collect()}  # four sites and the null one
    assert all(rows[i].text == f"own {i}\n" and rows[i].n_removed == 1 for i in range(8))
    assert rows[10].text == "" and rows[9].text == ""
    assert line_dedup.clean(shared, threshold=6).filter("n_removed > 0").count() == 0


def test_licenses(docs, empty):
    from tesserae.llm import licenses

    assert licenses.scan(empty).count() == 0
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in got] == [(6, 0, "apache")]


def test_pii(docs, empty):
    from tesserae.llm import pii

    assert pii.detect(empty).count() == 0
    rows = pii.detect(docs).collect()
    assert len(rows) == len(ROWS)
    six = next(r for r in rows if r.doc_id == 6)
    assert (six.n_email, six.n_ip, six.n_card, six.n_phone) == (1, 1, 0, 1)


def test_quality(spark, docs, empty):
    from tesserae.llm import fm_quality

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, 0), (None, 1, 0), (99, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert fm_quality.score(empty, fm_quality.train(empty, labels)).count() == 0
    got = fm_quality.score(docs, fm_quality.train(docs, labels.limit(0))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = fm_quality.score(docs, fm_quality.train(docs, labels), keep_columns=True)
    assert kept.columns == [*docs.columns, "fm_score"] and kept.count() == len(ROWS)


def test_near_duplicates(docs, empty):
    from tesserae.llm import hyperminhash

    assert hyperminhash.near_duplicates(empty).count() == 0
    got = hyperminhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[7] == (0, 7, True)
    assert by[4][1:] == (4, True) and by[5][1:] == (4, False)
    assert by[None] == (7, None, False)


def test_pieces(docs, empty):
    from tesserae.llm import piece_match

    assert piece_match.tokenize(empty).count() == 0
    got = piece_match.tokenize(docs, with_ids=True).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert next(r for r in got if r.doc_id == 3).n_tokens == 0


def test_decontam_joins_the_same_without_broadcast(spark, monkeypatch):
    """A table is measured in bytes, strings included; above the limit the shuffled join finds the same rows."""
    from tesserae.llm import decontam

    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a" * 5000), (3, "one two three four five six")], "item_id long, text string")
    assert decontam._bytes(items) >= 5000 + 3 * decontam.ROW_BYTES and decontam._bytes(items.limit(0)) == 0
    rows = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "a" * 5000), (3, None), (4, "one two three four five seven")], "doc_id long, text string")
    both = []
    for limit in (decontam.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        both.append(sorted(tuple(r) for r in decontam.find(rows, items).collect()))
    assert both[0] == both[1] and [x[:2] for x in both[0]] == [(1, 1), (2, 2)]


def test_decontam(spark, docs, empty):
    from tesserae.llm import decontam

    items = spark.createDataFrame([(1, "Beta gamma, delta epsilon zeta ETA"), (2, None), (3, "some words"), (4, ""), (1, "Beta gamma, delta epsilon zeta ETA")], "item_id long, text string")
    assert decontam.find(empty, items).count() == 0 and decontam.find(docs, items.limit(0)).count() == 0
    got = sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.find(docs, items).collect()), key=str)
    assert got == [(1, 1, 2, 2), (None, 3, 1, 1)]


def test_neighbours(spark):
    from tesserae.llm import vptree

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS v", "3 AS shard")
    v = vptree.valid(vec)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.search(vptree.index(v), v.filter("vec_id in (0, 10)"), 10).collect()]
    assert sorted(got) == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 1, 2**0.5)]
    none = vptree.valid(vec.limit(0))
    assert vptree.search(vptree.index(none), none).count() == 0


def test_chat(spark):
    from pyspark.sql import functions as F

    from tesserae.llm import chat

    rows = [(1, 1, "user", "b<|im_end|>"), (1, 0, "system", None), (1, 2, "assistant", "<\\|x|> <|im_start|>user\nhi"), (1, 2, "assistant", "<\\|x|> <|im_start|>user\nhi"), (2, 0, None, ""), (None, 0, "user", "n"), (3, None, "ass\\is\ntant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 AS leaf", "8 AS depth", "9 AS up")
    got = {r.conv_id: r for r in chat.read_back(chat.format_paths(chat.paths(chat.chain(df)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("system", ""), ("user", "b<|im_end|>")] + [("assistant", rows[2][3])] * 2
    assert got[1].loss_text == rows[2][3] * 2 and len(got[1].loss_mask) == 2
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[None].turns[0].text == "n" and got[3].turns[0].role == "ass\\is\ntant"
    odd = ["\\\\n\x00<|\\|", "\n\\\x00", "\\<\\\\|"]
    again = spark.createDataFrame([(r,) for r in odd], "r string").select("r", chat.unescape_role(chat.escape_role(F.col("r"))).alias("back")).collect()
    assert [r.back for r in again] == odd
    assert chat.paths(chat.chain(df.limit(0))).count() == 0


def test_anchors_of_a_text_over_four_mebibytes():
    """Those of a long text are those of its overlapping pieces, past 4 MiB as before it, each once."""
    import numpy as np

    from tesserae.llm import anchors as a

    text = np.random.default_rng(4).integers(97, 123, (1 << 22) + 300_000, dtype=np.uint8).tobytes()
    want = {}
    for at in range(0, len(text), 50_000):
        _, pos, h = a.anchors([text[at : at + 50_199]], 200, 80)
        want |= dict(zip((pos + at).tolist(), h.tolist(), strict=True))
    doc, pos, h = a.anchors([b"short", text, text[:1000]], 200, 80)
    assert pos[doc == 1].tolist() == sorted(want) and dict(zip(pos[doc == 1].tolist(), h[doc == 1].tolist(), strict=True)) == want
    assert pos[doc == 2].tolist() == [p for p in sorted(want) if p < 921][: (doc == 2).sum()]


def test_repeats_past_four_mebibytes(spark):
    """Repeats in the tail of a long text go; text that occurs once stays, also at 4 MiB less."""
    import numpy as np

    from tesserae.llm import column_bwt

    rng = np.random.default_rng(6)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    head, passage, tail = letters((1 << 22) + 5000), letters(600), letters(3000)
    rows = [(1, head + passage + tail), (2, letters(2000) + passage + letters(2000))]
    got = {r.doc_id: r.n_removed for r in column_bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 600, 2: 600}


def test_repeats_of_very_long_texts(spark):
    """Texts of 5 and 20 MB: repeats at both ends, within one text and across two, go; a text that occurs once loses nothing."""
    import numpy as np

    from tesserae.llm import column_bwt

    rng = np.random.default_rng(16)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    five, twenty, unique = letters(5_000_000), letters(20_000_000), letters(6_000_000)
    a, b, c = letters(400), letters(900), letters(300)
    # other neighbours for each copy, so that none reaches further by chance
    one = [a, "0" + five[:2_500_000] + "1", b, "2" + five[2_500_000:] + "3", c]
    two = [c, "4" + twenty[:9_000_000] + "5", a, "6" + twenty[9_000_000:15_000_000] + "7", b, "8" + twenty[15_000_000:] + "9", b]
    first, second = "".join(one), "".join(two)
    rows = [(1, first), (2, second), (3, unique), (4, "x" + unique[:199])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in column_bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {1: "".join(one[1::2]), 2: "".join(two[1::2]), 3: unique, 4: "x" + unique[:199]}
    gone = {1: (1600, 3), 2: (2500, 4), 3: (0, 0), 4: (0, 0)}
    assert got == {i: (len(t), *gone[i], hashlib.sha256(left[i].encode()).hexdigest()) for i, t in rows}


def test_windows_see_what_whole_texts_see(spark, monkeypatch):
    """Spans do not depend on the size of the windows; rows with one key get another seed."""
    import random

    from tesserae.llm import column_bwt

    r = random.Random(2)
    part = ["".join(r.choice("ab c") for _ in range(r.randint(150, 500))) for _ in range(12)]
    rows = [(i, "".join(r.choice(part) for _ in range(r.randint(1, 40)))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(x) for x in column_bwt.remove_repeats(df).collect()}
    for size in (997, 3001):
        monkeypatch.setattr(column_bwt, "TEXT", size)
        assert {tuple(x) for x in column_bwt.remove_repeats(df).collect()} == want
    assert column_bwt._seed(df) == 7
    real = column_bwt._keyed
    monkeypatch.setattr(column_bwt, "_keyed", lambda docs, seed=7: real(docs, seed).selectExpr("doc_id", f"dk % {3 if seed == 7 else 1 << 62} AS dk", "text"))
    assert column_bwt._seed(df) == 9


def test_pipeline_stages(spark, docs, empty, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows, one id with two texts, clashing names and an empty table."""
    import corpus_pipeline as c

    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "Beta gamma, delta epsilon zeta ETA"), (2, None), (3, "")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    more = docs.unionByName(docs.filter("doc_id = 1").limit(1).selectExpr("7L AS doc_id", "'an earlier text of seven words or so' AS text", *[f"`{x}`" for x in docs.columns[2:]]))
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    every = ids(more)
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, more, sf)
        assert got.columns == more.columns and stage(spark, empty, sf).count() == 0, name
    assert ids(c.quality(spark, more, sf)) == every  # with one class learned, all are its
    lined = c.lines(spark, more, sf)
    assert ids(lined) == every and lined.filter("text is null or n_chars <> length(text)").count() == 0
    near = c.near_duplicates(spark, more, sf)
    assert ids(near) == sorted([1, 2, 3, 4, 6, 7, None], key=str)  # 5 copies 4; of 1 one row, of 7 one text
    assert near.filter("doc_id = 7").first().text == "\n\n \n"
    assert c.near_duplicates(spark, near, sf).count() == near.count()
    assert ids(c.decontaminate(spark, more, sf)) == [x for x in every if x != 1]
    tokens = c.pieces(spark, more, sf)
    assert ids(tokens) == every and tokens.filter("not round_trip").count() == 0 and c.pieces(spark, empty, sf).count() == 0
    assert "n_chars" not in c.lines(spark, more.drop("n_chars"), sf).columns


def test_very_long_texts(spark):
    """A text of a million words next to short ones: lines, near copies, tokens, decontamination, quality, personal data."""
    import random

    from tesserae.llm import decontam, fm_quality, hyperminhash, line_dedup, piece_match, pii

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(5000)]
    long = "\n".join(" ".join(r.choice(words) for _ in range(1000)) for _ in range(1000))
    near = long + " one more word or two"
    rows = [(1, long, "a", 1), (2, near, "b", 1), (3, "short text of some seven words here", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    by = {x.doc_id: x for x in hyperminhash.near_duplicates(df).collect()}
    assert (by[1].component_id, by[2].component_id, by[3].component_id) == (1, 1, 3)
    grams = lambda t: len({tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)})
    assert by[1].n_shingles == grams(long)
    cleaned = {x.doc_id: x.n_removed for x in line_dedup.clean(df, threshold=2).collect()}
    assert cleaned == {1: 999, 2: 999, 3: 0} or cleaned == {1: 1000, 2: 999, 3: 0}
    item = spark.createDataFrame([(1, " ".join(long.split()[-40:])), (2, " ".join(words[:30]))], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontam.find(df, item).collect()) == [(1, 1), (2, 1)]
    assert all(x.round_trip for x in piece_match.tokenize(df).collect())
    model = fm_quality.train(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    assert fm_quality.score(df, model).count() == 3
    told = pii.find([long + " write x@y.zz\n" + " ".join(["7"] * 300_000) + " call (617) 555-0133"])
    assert [k for k, *_ in told[0][0]] == [0] and (3, "(617) 555-0133") in [(k, (long + " write x@y.zz\n" + " ".join(["7"] * 300_000) + " call (617) 555-0133")[s:e]) for k, s, e in told[0][1]]
