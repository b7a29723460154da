from __future__ import annotations

import random

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.operators import assemble, drift, matching, timeline, validate
from lectern.plans import catalogue, matches
from lectern.streaming import windows as X


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def segs(spark, spans):
    return spark.createDataFrame([("b", i, s, e) for i, (s, e) in enumerate(spans)], "book_id string, id long, start_ms long, end_ms long")


def test_words_to_segments(spark):
    w = lambda ts: spark.createDataFrame([("b", i, t) for i, t in enumerate(ts)], "book_id string, k long, s_ms long")
    assert rows(timeline.words_to_segments(w([0, 1900, 2000, 3900, 5000]), segs(spark, [(0, 2000), (2000, 4000)]), ["book_id"]), "k", "id") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert rows(timeline.words_to_segments(w([2500, 2800]), segs(spark, [(0, 2000), (3000, 4000)]), ["book_id"]), "k", "id") == [(1, 1)]


def test_words_to_segments_like_a_pointer(spark):
    draw = random.Random(5)
    spans = [(draw.randrange(0, 900), draw.randrange(0, 1000)) for _ in range(40)]
    words = sorted(draw.randrange(-50, 1100) for _ in range(80))
    want, at = [], 0
    for k, s in enumerate(words):
        while at < len(spans) and s >= spans[at][1]:
            at += 1
        if at == len(spans):
            break
        if s >= spans[at][0] - 250:
            want.append((k, at))
    got = timeline.words_to_segments(spark.createDataFrame([("b", k, s) for k, s in enumerate(words)], "book_id string, k long, s_ms long"), segs(spark, spans), ["book_id"])
    assert rows(got, "k", "id") == want


def test_split_and_clip(spark):
    tracks = spark.createDataFrame([("b", 1, 10), ("b", 2, 20)], "book_id string, track long, dur_ms long")
    own = timeline.split_local(segs(spark, [(0, 4), (8, 12), (10, 15), (31, 33)]), tracks)
    assert rows(own, "track", "local_id", "start_ms", "end_ms") == [(1, 0, 0, 4), (1, 1, 8, 10), (2, 0, 0, 5), (2, 1, 20, 20)]
    spans = spark.createDataFrame([("b", 8, 14)], "book_id string, s_ms long, e_ms long")
    assert rows(timeline.clip_spans(spans, tracks, 7), "track", "in_ms", "out_ms") == [(1, 8, 10), (2, 0, 4)]


def test_offset(spark):
    own = timeline.shift(segs(spark, [(0, 1), (1000, 2000), (5000, 6000)]), F.lit(1), F.lit(2), F.lit(-2400))
    assert rows(own, "id", "start_ms") == [(0, 0), (1, 0), (2, 2600)]


def test_page_anchors(spark):
    for pages, want in (([0, 0, 0, 1, 2], [0, 3, 4]), ([0, 0, 0, 2, 2], [0, 2, 3]), ([0, 0, 2], [0, 1, 2]), ([0, 3], [0, 0, 0, 1])):
        df = spark.createDataFrame([("b", i, p) for i, p in enumerate(pages)], "book_id string, seg long, page long")
        assert [s for _, s in rows(timeline.page_anchors(df), "page", "seg")] == want
    cols = spark.createDataFrame([(i, float(x)) for i, x in enumerate([250, 120, 0, 100, 200, -50, -0.3])], "i int, x double")
    assert [c for _, c in rows(cols.select("i", timeline.column_of(F.col("x"), F.lit(100.0)).alias("c")), "i", "c")] == [2, 1, 0, 1, 2, 0, 0]


def test_drift(spark):
    values = [0.9, 0.1, 0.8, 0.2, 0.1, 0.06, 0.9]
    df = spark.createDataFrame([("b", i, i * 10, i * 10 + 5, v) for i, v in enumerate(values)], "book_id string, i long, t0 long, t1 long, overlap double")
    own = drift.rolling_median(df, ["book_id"], "i", "overlap", 3)
    assert [round(s, 3) for _, s in rows(own, "i", "smoothed")] == [0.5, 0.8, 0.2, 0.2, 0.1, 0.1, 0.48]
    assert rows(drift.flagged_runs(own, ["book_id"], 0.4), "i_start", "n_windows", "t_end", "min_overlap", "mean_overlap") == [(2, 4, 55, 0.06, 0.29)]
    grid = drift.dense_grid(spark.createDataFrame([("b", 100_000)], "book_id string, dur_ms long"), 90_000, 8_000)
    assert [t for _, t in rows(grid, "i", "t0")] == [0, 90_000]


def test_anchors(spark):
    df = spark.createDataFrame([("b", float(g), s, c) for g, s, c in ((0, 5, 0.9), (10, 3, 0.9), (20, 8, 0.2), (30, 9, 0.5), (40, 9, 0.8))], "book_id string, g0 double, seg long, conf double")
    own = matching.trusted_anchors(df, ["book_id"])
    assert rows(own, "g0", "seg") == [(0.0, 5), (30.0, 9)]
    wanted = spark.createDataFrame([("b", s) for s in (2, 7, 9, 20)], "book_id string, seg long")
    totals = spark.createDataFrame([("b", 100.0, 20)], "book_id string, total_dur double, total_segs long")
    assert rows(matching.interpolate(own, wanted, totals, ["book_id"]), "seg", "time") == [(2, 0.0), (7, 15.0), (9, 30.0), (20, 100.0)]


def overlap(a, h):
    return len(set(a) & set(h)) / len(set(a)) if a else 0.0


def test_forward_match_like_a_loop(spark):
    draw = random.Random(9)
    text = [draw.choice("abcdefghijklmnop") * draw.randrange(1, 4) for _ in range(300)]
    asked = [(i, draw.randrange(0, 120), [draw.choice(text) for _ in range(n)] if i % 2 else text[150 + i : 150 + i + n]) for i, n in enumerate((1, 5, 12, 20, 33, 0))]
    want = []
    for item, cursor, heard in asked:
        span, web = max(1, len(heard) * 13 // 10), text[cursor : cursor + 150]
        best = (0, 0.0)
        for off in range(40, len(web) - max(1, span // 2) + 1):
            score = overlap(web[off : off + span], heard)
            if heard and score > best[1]:
                best = (off, score)
        want.append((item, best[0], round(best[1], 9)))
    tokens = spark.createDataFrame([("b", i, w) for i, w in enumerate(text)], "book_id string, apos long, nw string")
    heard = spark.createDataFrame([("b", *x) for x in asked], "book_id string, item long, cursor long, heard array<string>")
    got = matching.forward_match(tokens, heard, ["book_id"], reach=150).withColumn("best_score", F.round("best_score", 9))
    assert rows(got, "item", "best_off", "best_score") == sorted(want)


def test_forward_match_all_like_one_by_one(spark):
    draw = random.Random(3)
    text = {b: [draw.choice("abcdefghijklmnop") * draw.randrange(1, 4) for _ in range(n)] for b, n in (("b", 2130), ("c", 30), ("d", 1041))}
    heard = [(i, [draw.choice(text["b"]) for _ in range(n)] if i % 2 else text["b"][1900 + i : 1900 + i + n]) for i, n in enumerate((1, 5, 12, 20, 33, 0))] + [(70, text["d"][700:720])]
    tokens = spark.createDataFrame([(b, i, w) for b, x in text.items() for i, w in enumerate(x)], "book_id string, apos long, nw string")
    books = spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "book_id string")
    items = spark.createDataFrame(heard, "item long, heard array<string>")
    got = matching.forward_match_all(tokens, books, items, ["book_id"], 100, 150, 40).withColumn("best_score", F.round("best_score", 9))
    cursors = {b: range(0, max(1, len(text.get(b, [])) - 40), 100) for b in "bcde"}
    asked = spark.createDataFrame([(b, i * 10000 + c, c, h) for b, x in cursors.items() for c in x for i, h in heard], "book_id string, item long, cursor long, heard array<string>")
    want = matching.forward_match(tokens, asked, ["book_id"], 150, 40).withColumn("best_score", F.round("best_score", 9))
    assert rows(got.withColumn("item", F.col("item") * 10000 + F.col("cursor")), "book_id", "item", "best_off", "best_score") == rows(want, "book_id", "item", "best_off", "best_score")
    best = got.where("item = 4 and book_id = 'b'").orderBy(F.desc("best_score")).first()
    assert 1880 < best.cursor + best.best_off < 1930


def test_searches_reach_the_end_of_a_book(spark, tmp_path):
    words = lambda k: " ".join(chr(97 + (k * 7 + j) % 26) * 2 + chr(97 + k % 26) for j in range(3))
    said = " ".join(f"passage{chr(97 + j)}" for j in range(20))
    text = "\n".join([*(words(k) for k in range(6500)), said, *(words(k) for k in range(20))])
    spark.createDataFrame([(1, text, "s", len(text))], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, said)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = matches.forward_match(spark, str(tmp_path)).orderBy(F.desc("best_score")).first()
    assert abs(best.cursor + best.best_off - 3 * 6500) <= 6 and best.best_score > 0.7
    assert [r.est for r in matches.locate_segment_all(spark, str(tmp_path)).where("score = 1").collect()] == [9000]


def test_locate_like_a_loop(spark):
    draw = random.Random(4)
    lines = [[draw.choice("abcdefghij") * draw.randrange(1, 4) for _ in range(draw.randrange(0, 9))] for _ in range(80)]
    asked = [(0, 40, sum(lines[30:40], [])), (1, 10, ["zz"]), (2, 70, lines[3] + lines[70])]
    want = []
    for item, est, heard in asked:
        target, best, at = set(heard[:12]), -1.0, max(0, est - 30)
        for s in range(max(0, est - 30), min(80, est + 30)):
            win, j = [], s
            while len(win) < 12 and j < 80:
                win += lines[j]
                j += 1
            score = len(target & set(win)) / len(target)
            if win and score > best:
                best, at = score, s
        want.append((item, at, round(max(best, 0), 9)))
    seg = spark.createDataFrame([("b", i, w) for i, w in enumerate(lines)], "book_id string, seg long, words array<string>")
    got = matching.locate(seg, spark.createDataFrame([("b", *x) for x in asked], "book_id string, item long, est long, heard array<string>"), ["book_id"], 12, 30)
    assert rows(got.withColumn("score", F.round("score", 9)), "item", "seg", "score") == want


def test_locate_all_like_one_by_one(spark):
    draw = random.Random(8)
    book = {b: [" ".join(draw.choice("abcdefghij") * draw.randrange(1, 3) for _ in range(draw.randrange(0, 9))) for _ in range(n)] for b, n in (("b", 83), ("c", 1), ("d", 40))}
    heard = [(i, " ".join(book["b"][i * 9 : i * 9 + 6]).split()) for i in range(8)] + [(20, ["zz"]), (21, [])]
    texts = [(b, i, "\n".join(x[i : i + 7])) for b, x in book.items() for i in range(0, len(x), 7)]
    texts = spark.createDataFrame(texts, "book_id string, place long, lines string").orderBy(F.desc("place"))
    items = spark.createDataFrame(heard, "item long, heard array<string>")
    seg = spark.createDataFrame([(b, i, x.split()) for b, xs in book.items() for i, x in enumerate(xs)], "book_id string, seg long, words array<string>")
    for est, stride, margin in ((10, 20, 10), (5, None, 30), (70, None, 20)):
        ests = {b: [est] if stride is None else [e for e in range(est, 999, stride) if e - margin < len(x)] for b, x in book.items()}
        asked = spark.createDataFrame([(b, i * 1000 + e, e, h) for b, x in ests.items() for e in x for i, h in heard], "book_id string, item long, est long, heard array<string>")
        want = matching.locate(seg, asked, ["book_id"], 12, margin).withColumn("score", F.round("score", 9))
        got = matching.locate_all(texts, items, ["book_id"], est, stride, 12, margin).withColumn("score", F.round("score", 9))
        assert rows(got.withColumn("item", F.col("item") * 1000 + F.col("est")), "book_id", "item", "seg", "score") == rows(want, "book_id", "item", "seg", "score")


@pytest.mark.parametrize("name", ["locate_segment", "locate_segment_all"])
def test_located_in_odd_books(spark, tmp_path, name):
    """Books without lines, lines without words, signs whose lower case is a letter, apostrophes; and no hit of a word is a row."""
    texts = ["12\n\n'tis \u212aing's x-ray\tit'''s ''\n 1 \nend of it", " \n\u00a0", None, "", "a\n'\n--", "\n".join(f"w{chr(97 + i % 26)} of a king" for i in range(90))]
    keys = {"doc_id": [1, 1001, 2001, 3001, 4001, 2], "text": texts, "source": ["s", "s", "s", None, None, "s"], "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(keys), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [4, 9, 7], "text": ["'tis King's end", "wc of a king " * 30, "nothing here"]}), tmp_path / "benchmark.parquet")
    oracle.same_rows(spark, str(tmp_path), catalogue.queries()[name], catalogue.oracle_sql()[name])
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize("name", ["locate_segment", "locate_segment_all"])
def test_located_texts_are_shuffled_once(spark, small, name):
    """A book's texts meet in one exchange; beside it only the items' blocks are dealt, and nothing is sorted on disk."""
    plan = catalogue.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(book_id") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Sort " not in plan


def test_decision(spark):
    df = spark.createDataFrame([(0, 0.1, 200, 0.9, False), (1, 0.9, 0, 0.0, False), (2, 0.1, 0, 0.2, False), (3, 0.9, 5, 0.9, True)], "i int, here double, off long, score double, force boolean")
    own = df.select("i", matching.resync_decision(*map(F.col, ("here", "off", "score", "force"))).alias("d"))
    assert rows(own, "i", "d") == [(0, "cut"), (1, "ok"), (2, "deadzone"), (3, "ok")]


def test_assemble_gaps(spark):
    out = []
    for seg in range(20):
        for k in range(10):
            pos = seg * 10 + k
            status = "ALIGNED" if seg in (0, 1, 9) else "CUT" if seg < 9 else "PENDING"
            out.append(("b", seg, pos, f"w{seg}", "w", status, pos * 1.0 if status == "ALIGNED" else None, pos + 0.5 if status == "ALIGNED" else None))
    df = spark.createDataFrame(out, "book_id string, seg long, pos long, w string, nw string, status string, s double, e double")
    own = rows(assemble.assemble(df, ["book_id"]), "seg", "start", "end")
    assert [s for s, _, _ in own] == list(range(10))
    assert all(a == b == 19.5 for s, a, b in own if 2 <= s <= 8) and own[9][1] == 90.0


def test_validator(spark):
    docs = spark.createDataFrame([("a", "t", "x.mp3"), ("b", " ", None)], "doc_key string, title string, audio string")
    seg = spark.createDataFrame([("a", 0, "0", "0", "x"), ("a", 1, None, "1", "x"), ("a", 2, "true", "NaN", None), ("a", 3, "5", "4", "x"), ("a", 4, "1", "2", "x")], "doc_key string, i long, start string, end string, text string")
    words = spark.createDataFrame([("a", 0, 0, "w", "2", "1"), ("a", 0, 1, None, "1", "1")], "doc_key string, i long, j long, w string, s string, e string")
    marks = spark.createDataFrame([("a", 0, "t", "0", "5"), ("a", 1, "t", "0", None)], "doc_key string, i long, title string, start string, seg string")
    found = validate.violations(docs, seg, words, marks)
    want = [("a", "chapter.seg", 0), ("a", "segment.end", 2), ("a", "segment.monotone", 4), ("a", "segment.order", 3), ("a", "segment.start", 1), ("a", "segment.start", 2), ("a", "segment.text", 2), ("a", "word.order", 0), ("a", "word.w", 0)]
    assert sorted((r.doc_key, r.rule, r.seg) for r in found.where("doc_key = 'a'").collect()) == want
    assert sorted(r.rule for r in found.where("doc_key = 'b'").collect()) == ["audio", "segments", "title"]
    try:
        validate.require(found)
        raise AssertionError("nothing raised")
    except validate.InvalidDocument:
        pass


def test_commit_rules():
    words = [(i, i * 1.0, i + 0.5) for i in range(10)]
    cursor, taken = X.commit(X.Cursor(), words, 0.0, 8.0, 2.0, False)
    assert [p for p, _, _ in taken] == [0, 1, 2, 3, 4, 5] and cursor.pos == 6
    cursor, taken = X.commit(X.Cursor(), [(0, 0.0, 9.0), (1, 9.0, 9.5)], 0.0, 8.0, 2.0, False)
    assert [p for p, _, _ in taken] == [0] and cursor.forced == 1  # one is forced
    assert len(X.commit(X.Cursor(), words, 0.0, 8.0, 2.0, True)[1]) == 10
    assert X.commit(X.Cursor(), [], 0.0, 8.0, 2.0, False)[1] == []


def test_streams_match_tables(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    parts = spark.createDataFrame([("c", s, s * 10.0, 14.0, s == 3, [(s * 10 + k, float(k), k + 0.5) for k in range(12)]) for s in range(4)], X.WINDOWS)
    parts.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(X.WINDOWS).parquet(str(tmp_path / "w"))
    query = X.commit_stream(stream, 2.0).writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    assert rows(spark.table("commits"), "step", "pos", "s", "e") == rows(X.commit_table(parts, 2.0), "step", "pos", "s", "e")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = X.sessions(stream, late="60 days").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).outputMode("complete").start()
    query.awaitTermination()
    assert rows(spark.table("sessions"), "user_id", "start_us", "n") == rows(X.sessions(events), "user_id", "start_us", "n")


def test_edit_aware_rolls_back():
    own = X.EditAware(safety=2.0, cadence=5.0)
    words = [(i, i * 1.0, i + 0.5) for i in range(30)]
    own.window(words, 0.0, 8.0, False, ("cut", 10))
    assert own.cuts == [(6, 16)] and own.cursor.pos == 16
    own.window([(16 + k, float(k), k + 0.5) for k in range(9)], 8.0, 8.0, False, ("deadzone", 0))
    assert own.cuts == [] and own.cursor.pos == 22 and (21, "CUT") in own.status
