"""Files in and out, streams from a checkpoint, and what has no query of its own."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import assemble, governance, matching, packaging, screen, timeline, validate
from lectern.sources import documents as D
from lectern.sources import html as H
from lectern.sources import sinks
from lectern.streaming import windows as X


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


DOC = {"title": "T", "audio": "a.mp3", "segments": [{"start": 0, "end": 1.5, "text": "One two", "words": [{"w": "One", "s": 0, "e": 0.5}]}, {"start": 1.5, "end": 2, "text": "three"}], "chapters": [{"title": "First one", "start": 0, "seg": 0}]}


def checked(spark, path):
    tables = D.player_tables(D.whole_files(spark, str(path)))
    found = validate.violations(tables["docs"], tables["segments"], tables["words"], tables["chapters"]).unionByName(validate.broken_files(tables["broken"]))
    return tables, found


def test_player_documents_are_judged_by_type(spark, tmp_path):
    bad = json.loads(json.dumps(DOC))
    bad["title"], bad["segments"][0]["start"], bad["segments"][1]["end"], bad["segments"][1]["text"], bad["chapters"][0]["seg"] = 5, True, "2", None, 2
    put(tmp_path / "good.json", DOC)
    put(tmp_path / "wrapped.json", {"align": DOC, "other": 1})
    put(tmp_path / "bad.json", bad)
    put(tmp_path / "broken.json", '{"title": "x", "segments": [')
    put(tmp_path / "nan.json", '{"title": "x", "audio": "a", "segments": [{"start": NaN, "end": 1, "text": "t"}]}')
    put(tmp_path / "list.json", {"title": "x", "audio": "a", "segments": {"a": 1}})
    tables, found = checked(spark, tmp_path)
    name = F.element_at(F.split("doc_key", "/"), -1)
    assert rows(found.select(name.alias("f"), "rule", "seg"), "f", "rule", "seg") == [
        ("bad.json", "chapter.seg", 0), ("bad.json", "segment.end", 1), ("bad.json", "segment.start", 0), ("bad.json", "segment.text", 1), ("bad.json", "title", None),
        ("broken.json", "json", None), ("list.json", "json", None), ("nan.json", "json", None),
    ]
    with pytest.raises(validate.InvalidDocument):
        validate.require(found)
    validate.require(found.where(F.col("doc_key").endswith("good.json")))
    prose = governance.player_prose(tables).select(name.alias("f"), "n_words")
    assert {("good.json", 5), ("wrapped.json", 5), ("bad.json", 4)} <= set(rows(prose, "f", "n_words"))


def test_document_sink_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("b", 1, 1.5, 2.0, "é two"), ("b", 0, 0.0, 1.5, "one"), ("c", 0, 0.0, 1.0, "x")], "track string, id long, start double, end double, text string")
    marks = spark.createDataFrame([("b", 0, 0.0, "First")], "track string, seg long, start double, title string")
    titles = spark.createDataFrame([("b", "B", "b.mp3"), ("c", "C", "c.mp3")], "track string, title string, audio string")
    sinks.document_files(sinks.documents(seg, marks, titles, ["track"]), str(tmp_path / "out"))
    found = {r.track: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert found["b"]["segments"] == [{"id": 0, "start": 0.0, "end": 1.5, "text": "one"}, {"id": 1, "start": 1.5, "end": 2.0, "text": "é two"}]
    assert found["b"]["chapters"][0]["title"] == "First" and found["c"]["title"] == "C"
    tables, found = checked(spark, tmp_path / "out" / "track=b")
    assert found.isEmpty() and tables["segments"].count() == 2


def test_replace_keeps_a_backup(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.range(1)
    for k in (1, 2, 3):
        sinks.replace(spark.range(k), path)
    assert (spark.read.parquet(path).count(), spark.read.parquet(path + ".bak").count()) == (3, 2)
    with pytest.raises(ValueError, match="nothing"):
        sinks.replace(one.where("id > 5"), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.bak"]
    bad = spark.createDataFrame([("d", "ERROR", "title", None, None)], "doc_key string, level string, rule string, seg long, word long")
    with pytest.raises(validate.InvalidDocument):
        sinks.validated(one, bad, path)
    sinks.validated(one, bad.where("level = 'WARN'"), path)
    assert spark.read.parquet(path).count() == 1


def test_replace_refuses_without_a_backup(spark, tmp_path):
    path = tmp_path / "t"
    sinks.replace(spark.range(2), str(path))
    (tmp_path / "t.bak").write_text("in the way")
    sinks.replace(spark.range(3), str(path))  # what stood there is moved aside, then deleted
    assert spark.read.parquet(str(path)).count() == 3 and spark.read.parquet(f"{path}.bak").count() == 2


def test_corrections_file(spark, tmp_path):
    ops = [{"op": "offset", "seg_range": [1, 2], "delta_sec": -0.5}, {"op": "set_boundary", "chapter": 1, "seg": 2, "title": "B"}]
    put(tmp_path / "c.json", {"target": "t.json", "audio": "a.wav", "ops": ops})
    own = D.corrections(spark, str(tmp_path / "c.json"))
    assert own["ops"] == ops and own["target"] == "t.json" and own["manifest"] is None
    put(tmp_path / "d.json", {"target": "t.json", "ops": ops})
    with pytest.raises(ValueError, match="audio"):
        D.corrections(spark, str(tmp_path / "d.json"))
    seg = spark.createDataFrame([("b", i, i * 1000, i * 1000 + 900) for i in range(4)], "book_id string, id long, start_ms long, end_ms long")
    marks = spark.createDataFrame([("b", 0, "A", 0, 0)], "book_id string, idx long, title string, seg long, start_ms long")
    out, new = validate.correct(seg, marks, own["ops"])
    assert rows(out, "id", "start_ms") == [(0, 0), (1, 500), (2, 1500), (3, 3000)]
    assert rows(new, "idx", "title", "seg", "start_ms") == [(0, "A", 0, 0), (1, "B", 2, 1500)]
    assert rows(validate.patch_document((out, new)).select("book_id", "sentences", F.to_json("chapters").alias("c")), "book_id", "sentences", "c") == [("b", 4, '[{"title":"A","start_ms":0},{"title":"B","start_ms":1500}]')]


def test_split_realign_and_dry_run(spark):
    seg = spark.createDataFrame([("b", i, i * 1000, i * 1000 + 900) for i in range(4)], "book_id string, id long, start_ms long, end_ms long")
    marks = spark.createDataFrame([("b", 0, "A", 0, 0)], "book_id string, idx long, title string, seg long, start_ms long")
    ops = [{"op": "split_realign", "at_seg": 2}]
    same, _ = validate.correct(seg, marks, ops, dry_run=True)
    assert rows(same, "id", "start_ms") == rows(seg, "id", "start_ms")
    with pytest.raises(ValueError, match="aligned anew"):
        validate.correct(seg, marks, ops)
    first, second = seg.where("id < 2"), spark.createDataFrame([("b", 0, 100, 200), ("b", 1, 300, 400)], "book_id string, id long, start_ms long, end_ms long")
    dur = spark.createDataFrame([("b", 2500)], "book_id string, dur_ms long")
    out, new = validate.correct(seg, marks, ops, realigned=lambda op: (first, second, dur))
    assert rows(out, "id", "start_ms") == [(0, 0), (1, 1000), (2, 2600), (3, 2800)]
    assert rows(new, "title", "seg", "start_ms") == [("Part 1", 0, 0), ("Part 2", 2, 2600)]
    for bad in ([{"op": "move"}], [{"op": "offset", "seg_range": [0, 1]}], [{}]):
        with pytest.raises(ValueError):
            validate.correct(seg, marks, bad)


def test_track_map_file(spark, tmp_path):
    put(tmp_path / "m.json", [{"title": "a", "seg": 0, "tracks": [1, 2]}, {"title": "b", "seg": "5", "tracks": [3]}, {"title": "c", "seg": 4, "tracks": []}, {"title": "d", "seg": 9, "tracks": [1]}])
    own = D.track_map(spark, str(tmp_path / "m.json")).withColumn("book_id", F.lit("x"))
    assert rows(own, "idx", "title", "seg", "tracks") == [(0, "a", 0, [1, 2]), (1, "b", None, [3]), (2, "c", 4, []), (3, "d", 9, [1])]
    assert rows(packaging.track_map_errors(own, ["book_id"]), "idx", "error") == [(0, "shared"), (1, "seg"), (2, "empty"), (3, "shared")]


def test_units_of_a_track_map(spark):
    entries = spark.createDataFrame([("b", 0, "one", 0, [1, 2]), ("b", 1, "two", 3, [3]), ("c", 0, "x", 5, [9])], "book_id string, idx long, title string, seg long, tracks array<int>")
    said = spark.createDataFrame([("b", i, 10 + i) for i in range(5)] + [("c", 0, 1)], "book_id string, seg long, n_words long")
    files = spark.createDataFrame([("b", "/a/01.mp3", 10.0), ("b", "/a/02 x.mp3", 5.0), ("b", "/b/02.mp3", 6.0), ("b", "/a/no.wav", 7.0)], "book_id string, path string, dur_sec double")
    audio = D.durations_by_track(files).select(F.lit("b").alias("book_id"), "track", "dur_sec")
    assert rows(audio, "track", "dur_sec") == [(1, 10.0), (2, 6.0)]
    own = packaging.units_from_track_map(entries, said, audio, ["book_id"])
    assert rows(own, "label", "words", "seconds", "wps", "error") == [("one", 33, 16.0, 33 / 16, None), ("two", 27, 0.0, 0.0, "track"), ("x", 0, 0.0, 0.0, "order")]


def test_sync_map_file(spark, tmp_path):
    put(tmp_path / "s.json", {"fragments": [{"id": "a", "begin": "0.0", "end": "1.2345", "lines": [" One ", "", "two"]}, {"id": "b", "begin": "1.2", "end": None, "lines": ["x"]}, {"id": "c", "begin": 2, "end": 3, "lines": [], "text": " three "}, {"id": "d", "begin": "3", "end": "4", "lines": ["  "]}]})
    own = D.sync_map(D.read_json(spark, str(tmp_path / "s.json"), D.SYNC))
    assert rows(own, "id", "start", "end", "text") == [(0, 0.0, 1.235, "One two"), (1, 2.0, 3.0, "three")]


def test_pages_without_a_body(spark):
    pages = spark.createDataFrame([(1, "<article><p>x</p></article>"), (2, "<div>x</div>"), (3, None)], "page_id long, html string")
    assert rows(H.bodyless(pages), "page_id") == [(2,), (3,)]
    with pytest.raises(ValueError, match="2, 3"):
        H.require_bodies(pages.orderBy("page_id"))
    H.require_bodies(pages.where("page_id = 1"))


def test_lists_markers_and_partial_output(spark):
    urls = spark.createDataFrame([(1, "u1"), (0, "u0")], "idx long, url string")
    assert [r.value for r in sinks.url_list(urls, "a book").orderBy("idx").collect()] == ["# a book", "# 2 chapters", "", "u0", "u1"]
    assert sinks.url_list(urls.limit(0), "a book").count() == 3
    chapters = spark.createDataFrame([("b", 0, "A", "u0"), ("b", 1, "B", "u1"), ("b", 2, "C", "u2")], "book string, chapter long, title string, url string")
    said = spark.createDataFrame([("b", 0, 0, 0, "x"), ("b", 0, 1, 0, "y"), ("b", 0, 1, 1, "z"), ("b", 2, 0, 0, "w")], "book string, chapter long, para long, sent long, text string")
    marks, failed = sinks.chapter_markers(chapters, said, ["book"])
    assert rows(marks, "title", "seg", "n_sentences") == [("A", 0, 3), ("C", 3, 1)] and rows(failed, "title") == [("B",)]
    assert [r.line for r in sinks.sentence_file(said, ["book"]).orderBy("n").collect()] == ["x", "", "y", "z", "", "w"]
    sinks.require_complete(marks, failed, strict=False)
    for a, b, strict in ((marks, failed, True), (marks.limit(0), failed, False)):
        with pytest.raises(ValueError):
            sinks.require_complete(a, b, strict)


def test_reports(spark):
    win = spark.createDataFrame([("t", 0, 60000, 61000, 0.25, 0.25, True, 4, 3, "abc" * 60, "def"), ("t", 1, 120000, 121000, 0.9, 0.9, False, 4, 3, "a", "b")], "track string, i long, t0 long, t1 long, overlap double, smoothed double, flagged boolean, n_aligned long, n_heard long, align_text string, heard_text string")
    runs = spark.createDataFrame([("t", 60000, 61000, 1, 0.25, 0.25)], "track string, t_start long, t_end long, n_windows long, min_overlap double, mean_overlap double")
    lines = [r.line for r in sinks.flag_report(runs, win.where("flagged").withColumn("t_start", F.lit(60000).cast("long")), ["track"]).orderBy("t_start", "t0", "k").collect()]
    assert lines == ["FLAG t=1.0-1.0min min=0.25 mean=0.25 n_win=1", "  t=1.0min overlap=0.25 n_aligned=4 n_heard=3", "    ALIGN: " + ("abc" * 60)[:120], "    AUDIO: def"]
    doc = json.loads(sinks.profile_json(win, runs, spark.createDataFrame([("t", 1.5)], "track string, dur_sec double"), ["track"]).first().value)
    assert (doc["n_windows"], doc["n_pass"], doc["n_fail"], doc["dur_sec"], len(doc["windows"]), doc["runs"][0]["t_start"]) == (2, 1, 1, 1.5, 2, 60000)
    assert "abc" not in json.dumps(doc)
    chart = sinks.drift_chart([(1.0, 0.25, True), (2.0, 0.9, False)], "a < b", 0.5)
    assert chart.count("<circle") == 2 and "a &lt; b" in chart and sinks.drift_chart([], "x", 0.5)
    assert sinks.report(win.select("t0", "overlap", "flagged")).first().line.startswith("t=1.0min 0.25 ")


def test_passages_of_any_length(spark):
    texts = [(1, "a b c d e f g h i j".split()), (2, "x a b y".split()), (3, []), (4, "c d e f g h i".split()), (5, "ab".split())]
    items = [(10, "a b".split()), (11, "c d e f g h i j".split()), (12, []), (13, ["ab"]), (14, "b c d e f g h i j k".split())]
    own = matching.exact_passages(spark.createDataFrame(texts, "doc_id long, words array<string>"), spark.createDataFrame(items, "item_id long, words array<string>"))
    want = [(d, i) for d, t in texts for i, w in items if w and f" {' '.join(w)} " in f" {' '.join(t)} "]
    assert rows(own, "doc_id", "item_id") == sorted(want, key=repr)
    assert matching.exact_passages(spark.createDataFrame(texts, "doc_id long, words array<string>"), spark.createDataFrame([], "item_id long, words array<string>")).count() == 0


def test_tail_of_committed_samples(spark):
    samples = list(range(100))
    df = spark.createDataFrame([(samples, 10_000, a, b) for a, b in ((9_000, 10_000), (5_000, 5_300), (4_900, 6_000), (9_500, 10_100), (6_000, 7_000))], "x array<int>, end long, t0 long, t1 long")
    got = [r.y for r in df.select(assemble.tail_slice(F.col("x"), F.col("end"), F.lit(10), F.lit(5_000), F.col("t0"), F.col("t1")).alias("y")).collect()]
    assert got == [samples[90:], samples[50:53], None, None, samples[60:70]]


def test_forward_buffer():
    own = X.Buffer((np.arange(k, k + 10) for k in range(0, 50, 10)), 10)
    part, last = own.window(2.5)
    assert part.tolist() == list(range(25)) and not last and len(own.held) == 30
    own.commit(1.5)
    assert own.start == 1.5 and own.window(1.0)[0].tolist() == list(range(15, 25))
    part, last = own.window(9.0)
    assert last and part.tolist() == list(range(15, 50)) and not own.ensure(9.0)
    own.commit(99)
    assert own.start == 5.0 and own.window(1.0)[0].size == 0 and own.window(1.0)[1]
    own = X.Buffer.fast_forward([2.0, 3.0], lambda k, s: [np.full(5, k * 10 + s)], 10, 2.5)
    assert own.start == 2.5 and own.window(0.5)[0].tolist() == [10.5] * 5
    assert X.Buffer.fast_forward([2.0], None, 10, 2.0).window(1.0)[1]


def test_supervisor():
    assert X.progressed(0, 5, 1, 0) == ("again", 0) and X.progressed(5, 5, 2, 0) == ("again", 1) and X.progressed(5, 5, 3, 1) == ("give up", 2)
    assert X.progressed(0, 5, 20, 0)[0] == "give up"


def staged(spark, tmp_path, batches, build, name):
    """A file stream that is stopped after each batch of windows and started again from its checkpoint."""
    schema = batches[0].schema
    for k, part in enumerate(batches):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        query = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_streams_go_on_from_a_checkpoint(spark, tmp_path):
    """Windows in three batches, some before their turn and some twice, give what the whole table gives."""
    parts = spark.createDataFrame([(k, s, s * 10.0, 14.0, s == 5, [(s * 10 + j, float(j), j + 0.5) for j in range(12)], "cut" if s == 1 else "deadzone" if s == 2 else "ok", 7) for k in ("c", "d") for s in range(6)], X.WINDOWS + ", decision string, offset long")
    batches = [parts.where("step IN (0, 3)"), parts.where("step IN (0, 1, 5)"), parts.where("step IN (2, 4)")]
    plain = [b.drop("decision", "offset") for b in batches]
    own = staged(spark, tmp_path / "a", plain, lambda s: X.commit_stream(s, 2.0), "commits")
    assert rows(own, "key", "step", "pos", "s", "e") == rows(X.commit_table(parts, 2.0), "key", "step", "pos", "s", "e")
    own = staged(spark, tmp_path / "b", batches, lambda s: X.edit_aware_stream(s, safety=2.0, cadence=5.0), "aware")
    assert rows(own, "key", "step", "pos", "status") == rows(X.edit_aware_table(parts, safety=2.0, cadence=5.0), "key", "step", "pos", "status")


def test_quota_of_words_and_seconds(spark):
    df = spark.createDataFrame([(1, "one two", 20.5), (2, "one", 20.6), (3, "one", None), (4, "w " * 501, 1.0), (5, "http://a b c\nhttp://b", 1.0), (6, None, 1.0)], "k long, text string, sec double")
    assert rows(governance.prose_quota(df, "k", seconds="sec"), "k", "n_words", "violation") == [(1, 2, False), (2, 1, True), (3, 1, True), (4, 501, True), (5, 0, False), (6, 0, False)]


def test_units_of_documents(spark):
    tables = {
        "docs": spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), ("c", 3, "C"), ("d", 4, "D")], "doc_key string, track long, title string"),
        "segments": spark.createDataFrame([("a", "One two"), ("a", "three 4"), ("b", "x"), ("d", None)], "doc_key string, text string"),
    }
    audio = spark.createDataFrame([(1, 60.0)], "track long, dur_sec double")
    manifest = spark.createDataFrame([(1, 9.0), (2, 0.5)], "track long, minutes double")
    planned = spark.createDataFrame([(4, 0.0, 30.0)], "track long, start double, end double")
    own = screen.units_from_documents(tables, audio, manifest, planned)
    assert rows(own, "label", "words", "minutes", "measured", "wps") == [("A", 3, 1.0, True, 0.05), ("B", 1, 0.5, True, 1 / 30), ("C", 0, None, False, 0.0), ("D", 0, 0.5, True, 0.0)]


def test_chapters_find_their_segment(spark):
    split = spark.createDataFrame([("b", 1, 10 + i, i, t) for i, t in enumerate((0, 1000, 3000))], "book_id string, track long, id long, local_id long, start_ms long")
    asked = spark.createDataFrame([("b", 1, "own", 11, 2900), ("b", 1, "near", 99, 2100), ("b", 1, "tie", 99, 2000), ("b", 2, "none", 10, 5)], "book_id string, track long, title string, seg long, start_ms long")
    assert rows(timeline.local_segments(asked, split, ["book_id", "track"]), "title", "local_seg") == [("near", 2), ("none", 0), ("own", 1), ("tie", 1)]
