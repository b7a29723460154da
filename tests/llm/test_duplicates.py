"""Jaccard join, passage removal, nearest neighbours and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import common, jaccard, nearest, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs, k, least):
    sets = [(i, shingles(t, k)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and len(x & y) * least.denominator >= len(x | y) * least.numerator:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed, copies=30):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 90)))) for i in range(60)]
    for g in range(4):
        base = [draw.choice(words) for _ in range(60 + 150 * g)]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randrange(0, 1 + len(own) // 25)):
                own[draw.randrange(len(own))] = draw.choice(words)
            docs.append((len(docs), " ".join(own)))
    line = "a line that very many of the texts here have in common with others"
    docs += [(len(docs) + i, f"{line} {i} {i * i}") for i in range(40)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  TWO"), (907, "É x y z"), (908, "é x y z")]
    draw.shuffle(docs)
    return docs


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("words", "least"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard(spark, words, least):
    docs = corpus(words)
    own = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(5), words, least).collect()}
    assert own == components(docs, words, least)


def test_jaccard_frequent_tokens_and_blocks(spark, monkeypatch):
    """With tiny bounds every path runs: token pairs, several groups of tokens, blocks of one key, matrices."""
    for name, value in (("FREQUENT", 6), ("GROUP", 32), ("BLOCK", 8), ("NEAR", 4), ("SOON", 2), ("LINKS", 0), ("FEW", 0)):
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(8, 20)
    own = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, Fraction(9, 10)).collect()}
    assert own == components(docs, 3, Fraction(9, 10))


@pytest.mark.parametrize(("words", "least"), [(5, Fraction(4, 5))])
def test_jaccard_long_sets(spark, monkeypatch, words, least):
    """With a low bound most sets are long ones, on both sides of the limit."""
    monkeypatch.setattr(jaccard, "APART", 9)
    rule = jaccard.Rule(words, least)
    docs = corpus(21)
    sizes = [len(shingles(t, words)) for _, t in docs]
    assert any(n < rule.long <= rule.upper(n) for n in sizes) and any(n > 4 * rule.long for n in sizes)
    own = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3), words, least).collect()}
    assert own == components(docs, words, least)


def test_similar_long_sets_share_a_combination():
    draw = np.random.default_rng(5)
    for least in (Fraction(9, 10), Fraction(4, 5)):
        rule = jaccard.Rule(3, least)
        for n in (rule.long, rule.long + 700, 9000):
            x = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            m = n
            while rule.least_common(m) <= n and rule.upper(n) >= m:  # the largest set that holds x and is linked with it
                m += 1
            more = np.unique(np.concatenate([x, draw.integers(0, 1 << 63, m - 1 - n, dtype=np.uint64)]))
            fewer = x[n - rule.least_common(n) :]
            for y in (more, fewer):
                assert np.intersect1d(rule.combinations(x), rule.combinations(y)).size
            far = np.unique(np.concatenate([x[: n // 8], draw.integers(0, 1 << 63, n - n // 8, dtype=np.uint64)]))
            assert np.intersect1d(rule.combinations(x), rule.combinations(far)).size <= n // 100


def test_components(spark, monkeypatch):
    draw = random.Random(5)
    links = [(a, a + 1) for a in range(0, 60)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    own = sorted(map(tuple, jaccard.components(df).collect()))
    monkeypatch.setattr(jaccard, "LINKS", 0)
    assert own == sorted(map(tuple, jaccard.components(df).collect())) and dict(own)[60] == 0
    assert jaccard.components(df.limit(0)).count() == 0


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D"), (3, None)], SCHEMA)
    own = sorted(jaccard.near_duplicates(df.selectExpr("*", "'x' AS component_id", "1 AS n"), 3, Fraction(9, 10)).collect(), key=repr)
    assert [tuple(r) for r in own] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_parity_never_loses():
    draw = np.random.default_rng(3)
    for n in (10, 700, 5000):
        x = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[n // 5 :], draw.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        true = len(np.setxor1d(x, y))
        for f in (jaccard._parity, jaccard._wide):
            assert jaccard._apart(np.frombuffer(f(x), np.uint64), np.frombuffer(f(y), np.uint64)) <= true


def removal(docs):
    seen, out = set(), {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def passages(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 250, 900)]
    docs = []
    for i in range(60):
        docs.append((i, "".join(draw.choice(shared) if draw.random() < 0.5 else text(draw.randrange(1, 200)) for _ in range(draw.randrange(1, 8)))))
    base = text(1500)
    for k in range(15):
        own = list(base)
        for _ in range(k):
            own[draw.randrange(len(own))] = "#"
        docs.append((100 + k, "".join(own)))
    docs += [(200, "a" * 700), (201, "ab" * 400), (202, "a" * 99), (203, None), (204, ""), (205, "x" + "abc" * 200)]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("group", [8192, 3])
def test_removal(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SORTED", 300 * group)
    docs = passages(group)
    own = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()}
    assert own == removal(docs)


def test_removal_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LONGEST", 256)
    docs = passages(77)
    own = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert own == removal(docs)


def test_suffix_ranks():
    draw = random.Random(6)
    for letters in (b"ab", b"a", bytes(range(256))):
        raw = bytes(draw.choice(letters) for _ in range(900))
        raw += raw[100:400]
        ranks = repeats.suffix_ranks(np.frombuffer(raw, np.uint8)).tolist()
        parts = [raw[i : i + 100] for i in range(len(raw) - 99)]
        of = {p: k for k, p in enumerate(sorted(set(parts)))}
        assert ranks == [of[p] for p in parts]


def test_removal_odd_rows(spark):
    long = "the same words again and again, " * 5
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long), (3, None)], SCHEMA)
    own = sorted((r.doc_id, r.n_removed) for r in repeats.removed(df).where("doc_id is not null").collect())
    assert own[0] == own[1] and own[2] == (2, len(long)) and own[3] == (3, 0)
    assert repeats.removed(df.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in repeats.without_repeats(df.where("doc_id >= 2")).collect()}
    assert texts[3] is None


def vectors(n, d, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)).astype(np.float32)
    x[5::7] = x[5]  # one vector with a seventh of all rows
    return x


def grouped(n, d, seed):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n // 30, d))[draw.integers(0, n // 30, n)] + draw.normal(size=(n, d)) * 0.2).astype(np.float32)


@pytest.mark.parametrize(("part", "cell", "make"), [(20_000, 2000, vectors), (100, 2000, vectors), (20_000, 60, vectors), (9, 60, grouped)])
def test_nearest(spark, monkeypatch, part, cell, make):
    """One cell and fifty, of one part and many, without groups of vectors and with."""
    monkeypatch.setattr(nearest, "PART", part)
    monkeypatch.setattr(nearest, "CELL", cell)
    x = make(3000, 24, 1)
    if make is grouped:
        assert nearest.Index(x.astype(float), 50).probed <= 10  # groups are found in few cells
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(5000, None, 0), (5100, [0.0] * 24, 0), (5200, [float("nan")] * 24, 0), (5300, [1.0, None] * 12, 0), (5400, [1.0] * 3, 0), (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    found: dict = {}
    for r in nearest.search(df, "vec_id % 100 = 0").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 100))
    y, hits = x.astype(float), 0
    for q, own in found.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(y)), d))[:10]
        assert [k for k, _, _ in sorted(own)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(order.tolist()))
    assert hits >= (0.95 if cell > 1000 else 0.9) * 10 * len(found)


def test_nearest_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    own = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.search(df, "vec_id % 100 = 0").collect())
    assert own == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert nearest.search(df.limit(0), "vec_id % 100 = 0").count() == 0
    twice = df.union(df)  # rows of one vec_id are one another's own
    own = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.search(twice, "vec_id = 0").collect())
    assert {v for _, _, v in own} == {1, 100} and nearest.search(df, "vec_id = 7").count() == 0


def test_bitmap(spark):
    ids = spark.range(0, 5000, 7).toDF("doc_id")
    own = common.bitmap(ids, "doc_id", 1 << 16)
    from pyspark.sql import functions as F

    at = np.array([r.a for r in ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).alias("a")).collect()])
    assert common.hit(own, at).all() and np.unpackbits(own).sum() == len(set(at.tolist()))


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    docs = common.table(spark, small, "documents")
    left = docs
    for name, stage in pipeline.STAGES[:4]:
        before, left = left, common.written(stage(spark, left, small), name.replace(" ", "-"))
        assert left.columns == pipeline.COLUMNS and left.count() > 0.7 * before.count()
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, _, c in components(rows, 5, Fraction(4, 5)) if i == c}
            assert {r.doc_id for r in left.collect()} == want
        if name == "repeats":
            want = removal([(r.doc_id, r.text) for r in before.collect()])
            for r in left.collect():
                assert abs(len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1])) <= 2 * want[r.doc_id][2]
    assert pipeline.run(spark, small).count() >= left.count()


def test_pipeline_odd_tables(spark, tmp_path):
    """Null ids and columns, repeated rows and ids, empty and long texts, and empty tables."""
    import corpus_pipeline as pipeline

    draw = random.Random(2)
    en, de = "the cat and dog with house under green tree walking slowly".split(), "der hund und die katze mit haus unter grünem baum langsam".split()
    prose = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, prose(en if i % 2 else de, 60), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [rows[0], (1, "zz " + rows[1][1], "en", None, None), (None, prose(en, 60), "en", "s", None), (90, None, "en", "s", 0), (91, "", None, None, None), (92, prose(en, 9000), None, "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    for _, stage in pipeline.STAGES[:3]:
        left = common.written(stage(spark, left, str(tmp_path)), "odd")
    got = {(r.doc_id, r.text) for r in left.collect()}
    ids = [i for i, _ in got]
    assert sorted(i for i in ids if i is not None) == [*range(60), 92] and ids.count(None) == 1 and left.columns == pipeline.COLUMNS
    assert (1, min(rows[1][1], "zz " + rows[1][1])) in got and left.count() == 62
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(ids) and all(r.length <= 2048 for r in out)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
