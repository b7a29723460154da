"""Queries of the timeline algebra over event segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import packaging, timeline, validate
from lectern.plans import adapters as A

BIN = 3_600_000
OPS = [{"op": "offset", "seg_range": [5, 9], "delta_sec": -2.4}, {"op": "set_boundary", "chapter": 1, "seg": 7}, {"op": "offset", "seg_range": [7, 7], "delta_sec": 1.5}]


def cum_offsets(spark, d):
    return timeline.cumulative(A.tracks(spark, d), ["book_id"], "track", "dur_ms")


def split_local(spark, d):
    return timeline.split_local(A.segments(spark, d), A.tracks(spark, d))


def split_manifest(spark, d):
    seg, tracks = A.segments(spark, d), A.tracks(spark, d)
    split = timeline.split_local(seg, tracks)
    marks = split.where(F.col("local_id") % 5 == 0).select("book_id", "track", "start_ms", F.concat(F.lit("c"), F.col("id")).alias("title"))
    own = packaging.manifest(split, marks, tracks)
    return own.select("book_id", "track", "minutes", "sentences", F.array_join(F.transform("chapters", lambda c: F.concat(c.start_ms.cast("string"), F.lit(":"), c.title)), ",").alias("chapters"))


def split_reconcile(spark, d):
    seg = A.segments(spark, d)
    return timeline.reconcile(seg, timeline.split_local(seg, A.tracks(spark, d)))


def recombine(spark, d):
    split = timeline.split_local(A.segments(spark, d), A.tracks(spark, d)).select("book_id", F.col("track").alias("part"), F.col("local_id").alias("id"), "start_ms", "end_ms")
    return timeline.recombine(split, A.tracks(spark, d).withColumnRenamed("track", "part"))


def clip_spans(spark, d):
    spans = A.segments(spark, d).select("book_id", "id", F.col("start_ms").alias("s_ms"), (F.col("end_ms") + A.DAY).alias("e_ms"))
    return timeline.clip_spans(spans, A.tracks(spark, d), A.DAY).select("book_id", "id", "track", "in_ms", "out_ms")


def _words(spark, d):
    """Words at and around every segment: some before it, inside it, and after its end."""
    seg = A.segments(spark, d)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).cast("long").alias("o")) for k, o in enumerate((-400, -200, 0, 700))]))
    return seg.select("book_id", "event_id", "start_ms", at.alias("x")).select("book_id", (F.col("event_id") * 10 + F.col("x.k")).alias("word_id"), (F.col("start_ms") + F.col("x.o")).alias("s_ms"))


def words_to_segments(spark, d):
    return timeline.words_to_segments(_words(spark, d), A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms"), ["book_id"]).select("book_id", "word_id", "s_ms", "id")


def markers_to_segments(spark, d):
    seg = A.segments(spark, d)
    marks = seg.where(F.col("id") % 9 == 0).select("book_id", F.when(F.col("id") % 2 == 0, F.col("id") * 2).alias("seg"), F.col("id").alias("first_line"), F.concat(F.lit(" m"), F.col("id")).alias("title"))
    return timeline.markers_to_segments(marks, seg, ["book_id"]).select("book_id", "seg", "title", "start", "dropped")


def asof_units(spark, d):
    seg = A.segments(spark, d)
    units = seg.where(F.col("id") % 7 == 3).select("book_id", F.col("id").alias("useg"), F.concat(F.lit("unit "), F.col("id")).alias("unit"))
    return timeline.range_assign(seg.select("book_id", "id"), units, ["book_id"], "id", "useg", ["useg", "unit"])


def nearest_segment(spark, d):
    seg = A.segments(spark, d)
    at = seg.select("book_id", "id", ((F.col("start_ms") + F.col("end_ms")) * 3 / 2).cast("long").alias("at")).withColumnRenamed("id", "q")
    return timeline.nearest(at, seg.select("book_id", "id", "start_ms"), ["book_id"], "at", "start_ms", "near").select("book_id", "q", "near")


def offset_op(spark, d):
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms")
    return timeline.shift(seg, F.lit(3), F.lit(20), F.lit(-86_400_000 * 2))


def _marks(seg):
    return seg.where(F.col("id") % 10 == 0).select("book_id", (F.col("id") / 10).cast("long").alias("idx"), F.concat(F.lit("ch "), F.col("id")).alias("title"), F.col("id").alias("seg"), "start_ms")


def set_boundary(spark, d):
    seg = A.segments(spark, d)
    return timeline.set_boundary(_marks(seg), seg, 6, 25, "moved")


def corrections(spark, d):
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms")
    return validate.correct(seg, _marks(seg), OPS)[1].select("book_id", "idx", "title", "seg", "start_ms")


def stitch(spark, d):
    seg = A.segments(spark, d)
    dur = seg.where(F.col("id") < 30).groupBy("book_id").agg(F.max("end_ms").alias("dur_ms"))
    return timeline.stitch(seg.where(F.col("id") < 30), seg.where(F.col("id") >= 30), dur)


def renumber(spark, d):
    own = A.segments(spark, d).where(F.col("event_id") % 3 > 0).select("book_id", "event_id", "start_ms")
    return timeline.renumber(own, ["book_id"], ["start_ms", "event_id"])


def page_anchors(spark, d):
    seg = A.segments(spark, d).select("book_id", F.col("id").alias("seg"), F.floor(F.col("start_ms") / (A.DAY / 2)).alias("page"))
    return timeline.page_anchors(seg)


def columns_of(spark, d):
    return A.table(spark, d, "events").select("event_id", timeline.column_of((F.col("value") - 1) * 17, F.lit(100.0)).alias("col"))


def exactly_once(spark, d):
    seg = A.segments(spark, d).select("book_id", "id")
    found = seg.where(F.col("id") % 11 > 0).union(seg.where(F.col("id") % 13 == 1)).union(seg.where(F.col("id") < 2).select("book_id", F.col("id") - 100))
    return timeline.exactly_once(seg, found, ["book_id", "id"])


def overlaps(spark, d):
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", (F.col("end_ms") + BIN).alias("end_ms"))
    b = seg.select("book_id", F.col("id").alias("id2"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    return timeline.interval_join(seg, b, ["book_id"], ("start_ms", "end_ms"), ("s2", "e2"), BIN).groupBy("book_id", "id").agg(F.count("*").alias("n"), F.min("id2").alias("first"))


def monotone_warn(spark, d):
    own = A.segments(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("len_ms", "event_id")).cast("long"))
    return timeline.backward(own, ["book_id"], "place").select("book_id", "place", "start_ms", "top")


QUERIES = {f.__name__: f for f in (cum_offsets, split_local, split_manifest, split_reconcile, recombine, clip_spans, words_to_segments, markers_to_segments, asof_units, nearest_segment, offset_op, set_boundary, corrections, stitch, renumber, page_anchors, columns_of, exactly_once, overlaps, monotone_warn)}

_S = "WITH " + A.SEGMENTS
_T = _S + ", " + A.TRACKS_SQL
_SPLIT = _T + f""",
cut AS (SELECT book_id, id, start_ms, end_ms, least(greatest(start_ms // {A.DAY}, 0), {A.TRACKS - 1}) AS track FROM segs),
split AS (SELECT book_id, track, id, id - min(id) OVER (PARTITION BY book_id, track) AS local_id, least(greatest(start_ms - track * {A.DAY}, 0), {A.DAY}) AS start_ms, least(greatest(end_ms - track * {A.DAY}, 0), {A.DAY}) AS end_ms FROM cut)
"""
_MARKS = """marks AS (SELECT book_id, id // 10 AS idx, 'ch ' || id AS title, id AS seg, start_ms FROM segs WHERE id % 10 = 0)"""
SQL = {
    "cum_offsets": _T + f"SELECT *, track * {A.DAY} AS \"offset\" FROM tracks",
    "split_local": _SPLIT + "SELECT * FROM split",
    "split_manifest": _SPLIT + r""",
n AS (SELECT book_id, track, count(*) AS sentences, string_agg(start_ms || ':c' || id, ',' ORDER BY start_ms, 'c' || id) FILTER (local_id % 5 = 0) AS chapters FROM split GROUP BY ALL)
SELECT book_id, track, round(dur_ms / 60000, 1) AS minutes, coalesce(sentences, 0) AS sentences, coalesce(chapters, '') AS chapters FROM tracks LEFT JOIN n USING (book_id, track)""",
    "split_reconcile": _S + " SELECT book_id, count(*) AS n_segments, count(*) AS n_split, count(DISTINCT id) AS n_ids, true AS ok FROM segs GROUP BY 1",
    "recombine": _SPLIT + f"SELECT book_id, track AS part, local_id, start_ms + track * {A.DAY} AS start_ms, end_ms + track * {A.DAY} AS end_ms, end_ms <= {A.DAY} + 5000 AS fits, row_number() OVER (PARTITION BY book_id ORDER BY track, local_id) - 1 AS id FROM split",
    "clip_spans": _T + f"SELECT s.book_id, s.id, t.track, greatest(start_ms, t.track * {A.DAY}) - t.track * {A.DAY} AS in_ms, least(end_ms + {A.DAY}, (t.track + 1) * {A.DAY}) - t.track * {A.DAY} AS out_ms FROM segs s JOIN tracks t ON s.book_id = t.book_id AND end_ms + {A.DAY} > t.track * {A.DAY} AND start_ms < (t.track + 1) * {A.DAY}",
    "words_to_segments": _S + r""",
w AS (SELECT book_id, event_id * 10 + k AS word_id, start_ms + o AS s_ms FROM segs, (VALUES (0, -400), (1, -200), (2, 0), (3, 700)) v(k, o)),
f AS (SELECT w.book_id, word_id, s_ms, arg_min(s.id, s.id) AS id, arg_min(s.start_ms, s.id) AS st FROM w JOIN segs s ON s.book_id = w.book_id AND w.s_ms < s.end_ms GROUP BY ALL)
SELECT book_id, word_id, s_ms, id FROM f WHERE s_ms >= st - 250""",
    "markers_to_segments": _S + r""",
m AS (SELECT book_id, coalesce(CASE WHEN id % 2 = 0 THEN id * 2 END, id) AS seg, trim(' m' || id) AS title FROM segs WHERE id % 9 = 0)
SELECT m.book_id, seg, m.title, s.start_ms AS "start", s.start_ms IS NULL AS dropped FROM m LEFT JOIN segs s ON s.book_id = m.book_id AND s.id = m.seg""",
    "asof_units": _S + r""",
u AS (SELECT book_id, id AS useg, 'unit ' || id AS unit FROM segs WHERE id % 7 = 3)
SELECT s.book_id, s.id, u.useg, u.unit FROM segs s ASOF LEFT JOIN u ON s.book_id = u.book_id AND s.id >= u.useg""",
    "nearest_segment": _S + r""",
q AS (SELECT book_id, id AS q, ((start_ms + end_ms) * 3 // 2)::BIGINT AS t FROM segs)
SELECT q.book_id, q.q, min(struct_pack(d := abs(s.start_ms - t), i := s.id)).i AS near FROM q JOIN segs s ON s.book_id = q.book_id GROUP BY ALL""",
    "offset_op": _S + " SELECT book_id, id, CASE WHEN id BETWEEN 3 AND 20 THEN greatest(start_ms - 172800000, 0) ELSE start_ms END AS start_ms, CASE WHEN id BETWEEN 3 AND 20 THEN greatest(end_ms - 172800000, 0) ELSE end_ms END AS end_ms FROM segs",
    "set_boundary": _S + ", " + _MARKS + r""",
s AS (SELECT book_id, start_ms AS st FROM segs WHERE id = 25),
g AS (SELECT book_id, max(idx) AS m FROM marks GROUP BY 1),
c AS (SELECT marks.book_id, idx, CASE WHEN idx = 6 AND st IS NOT NULL THEN 'moved' ELSE title END AS title, CASE WHEN idx = 6 AND st IS NOT NULL THEN 25 ELSE seg END AS seg, CASE WHEN idx = 6 AND st IS NOT NULL THEN st ELSE start_ms END AS start_ms, m < 6 AND st IS NOT NULL AS grown
  FROM marks LEFT JOIN s USING (book_id) JOIN g USING (book_id)
  UNION ALL SELECT book_id, m + 1, 'moved', 25, st, true FROM g JOIN s USING (book_id) WHERE m < 6)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN grown THEN seg ELSE idx END, idx) - 1 AS idx, title, seg::BIGINT AS seg, start_ms FROM c""",
    "corrections": _S + ", " + _MARKS + r""",
a AS (SELECT book_id, id, greatest(CASE WHEN id BETWEEN 5 AND 9 THEN greatest(start_ms - 2400, 0) ELSE start_ms END + CASE WHEN id = 7 THEN 1500 ELSE 0 END, 0) AS start_ms FROM segs),
g AS (SELECT book_id, max(idx) AS m, (SELECT count(*) FROM segs t WHERE t.book_id = marks.book_id AND id = 7) AS has FROM marks GROUP BY 1),
c AS (SELECT book_id, idx, title, CASE WHEN idx = 1 AND has > 0 THEN 7 ELSE seg END AS seg, m < 1 AND has > 0 AS grown FROM marks JOIN g USING (book_id) UNION ALL SELECT book_id, m + 1, 'Chapter 1', 7, true FROM g WHERE m < 1 AND has > 0)
SELECT c.book_id, row_number() OVER (PARTITION BY c.book_id ORDER BY CASE WHEN grown THEN seg ELSE idx END, idx) - 1 AS idx, title, seg::BIGINT AS seg, a.start_ms FROM c JOIN a ON a.book_id = c.book_id AND a.id = c.seg""",
    "stitch": _S + r""",
d AS (SELECT book_id, max(end_ms) AS dur FROM segs WHERE id < 30 GROUP BY 1),
b AS (SELECT book_id, id AS local_id, start_ms, end_ms, 1 AS part FROM segs WHERE id < 30 UNION ALL SELECT book_id, id, start_ms + dur, end_ms + dur, 2 FROM segs JOIN d USING (book_id) WHERE id >= 30)
SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY part, local_id) - 1 AS id FROM b""",
    "renumber": _S + " SELECT book_id, event_id, start_ms, row_number() OVER (PARTITION BY book_id ORDER BY start_ms, event_id) - 1 AS id FROM segs WHERE event_id % 3 > 0",
    "page_anchors": _S + f""",
p AS (SELECT book_id, id AS seg, start_ms // {A.DAY // 2} AS page FROM segs),
g AS (SELECT book_id, unnest(range(max(page) + 1)) AS page FROM p GROUP BY book_id)
SELECT g.book_id, g.page, coalesce(min(seg) FILTER (p.page = g.page), max(seg) FILTER (p.page < g.page), 0) AS seg FROM g LEFT JOIN p ON p.book_id = g.book_id AND p.page <= g.page GROUP BY ALL""",
    "columns_of": "SELECT event_id, greatest(0, floor(((value - 1) * 17 + 0.5) / 100.0))::BIGINT AS col FROM events",
    "exactly_once": _S + r""",
f AS (SELECT book_id, id FROM segs WHERE id % 11 > 0 UNION ALL SELECT book_id, id FROM segs WHERE id % 13 = 1 UNION ALL SELECT book_id, id - 100 FROM segs WHERE id < 2),
n AS (SELECT book_id, id, count(*) AS k FROM f GROUP BY ALL),
j AS (SELECT coalesce(segs.book_id, n.book_id) AS book_id, coalesce(segs.id, n.id) AS id, CASE WHEN k IS NULL THEN 'missing' WHEN segs.id IS NULL THEN 'extra' WHEN k > 1 THEN 'duplicate' END AS reason FROM segs FULL JOIN n ON n.book_id = segs.book_id AND n.id = segs.id)
SELECT * FROM j WHERE reason IS NOT NULL""",
    "overlaps": _S + f" SELECT a.book_id, a.id, count(*) AS n, min(b.id) AS first FROM segs a JOIN segs b ON a.book_id = b.book_id AND a.end_ms + {BIN} > b.start_ms AND a.start_ms < b.end_ms + {BIN} GROUP BY ALL",
    "monotone_warn": _S + r""",
p AS (SELECT book_id, start_ms, row_number() OVER (PARTITION BY book_id ORDER BY len_ms, event_id) AS place FROM segs),
m AS (SELECT *, max(start_ms) OVER (PARTITION BY book_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p)
SELECT book_id, place, start_ms, top FROM m WHERE start_ms < top""",
}
