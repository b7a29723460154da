"""Queries of assembling, packaging, validation, incremental work and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import assemble as S
from lectern.operators import matching, packaging, sentences, timeline, validate
from lectern.plans import adapters as A
from lectern.streaming import windows as X


def _timed(spark, d):
    """Tokens of conversations as a book each: turns are sentences, four of five words have a time, some are cut, the last
    tenth of each book is pending."""
    own = A.table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("seg"), "text")
    own = sentences.token_stream(own, ["book_id", "seg"]).withColumn("p", F.col("seg") * 10000 + F.col("pos"))
    own = own.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("p")).cast("long"))
    n = F.count("*").over(Window.partitionBy("book_id"))
    status = F.when(F.col("nw") == "", "PENDING").when(F.col("pos") * 10 > n * 9, "PENDING").when(F.col("pos") % 7 == 3, "CUT").otherwise("ALIGNED")
    own = own.withColumn("status", status)
    return own.withColumn("s", F.when(F.col("status") == "ALIGNED", F.col("pos") * 0.4)).withColumn("e", F.when(F.col("status") == "ALIGNED", F.col("pos") * 0.4 + 0.31)).select("book_id", "seg", "pos", "w", "nw", "status", "s", "e")


def assemble(spark, d):
    own = S.assemble(_timed(spark, d), ["book_id"])
    return own.select("book_id", "seg", "start", "end", "n_words", F.array_join(F.transform("words", lambda w: F.round(w.s * 1000).cast("long").cast("string")), ",").alias("starts"))


def assemble_all(spark, d):
    return S.assemble(_timed(spark, d), ["book_id"], truncate=False).select("book_id", "seg", "start", "end", "n_words")


def cut_gaps(spark, d):
    own = sentences.token_stream(A.table(spark, d, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("book_id"), "text"), ["book_id"]).withColumn("status", F.lit("PENDING"))
    cuts = own.where((F.col("apos") % 20 == 4)).select("book_id", F.col("apos").alias("a0"), (F.col("apos") + 6).alias("a1"))
    return matching.mark_cuts(own, cuts, ["book_id"]).groupBy("book_id").agg(F.count_if(F.col("status") == "CUT").alias("n_cut"), F.sum(F.when(F.col("status") == "CUT", F.col("pos")).otherwise(0)).alias("places"))


def tail_trim(spark, d):
    own = sentences.token_stream(A.docs(spark, d).select(F.col("doc_id").alias("key"), "text"), ["key"]).where("apos is not null")
    own = own.withColumn("window", F.floor(F.col("apos") / 60)).withColumn("frames", F.col("key") % 300 + 1)
    return S.tail_fit(own, ["key", "window"])


def sub_chunks(spark, d):
    own = A.table(spark, d, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("dur_ms"))
    return S.sub_chunks(own, 3000).select("event_id", "chunk", "c0", "c1")


def here_words(spark, d):
    own = _timed(spark, d).withColumn("s_ms", F.round(F.col("s") * 1000).cast("long")).withColumn("e_ms", F.round(F.col("e") * 1000).cast("long"))
    win = own.groupBy("book_id").agg(F.max("pos").alias("n")).select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 25))).alias("i")).withColumn("t0", F.col("i") * 10000).withColumn("t1", F.col("t0") + 4000)
    return matching.here_words(own, win, ["book_id"], 5000).select("book_id", "i", "here")


def _rolled_back(seg):
    own = seg.select("book_id", F.col("id").alias("a0"), (F.col("id") + F.col("len_ms") % 9).alias("a1"), (F.col("id") + F.col("len_ms") % 14).alias("cursor"), (F.col("len_ms") % 2 == 0).alias("wrong"))
    return matching.rolled_back(own)


def rollback(spark, d):
    return _rolled_back(A.segments(spark, d))


def merge_groups(spark, d):
    seg = A.segments(spark, d).select("book_id", F.col("id").alias("idx"))
    specs = seg.groupBy("book_id").agg(F.count("*").alias("n")).withColumn("spec", F.lit("0-1, 3-4,10-19"))
    own = packaging.parse_merges(specs, ["book_id"]).where("error is null")
    return packaging.merged_groups(seg, own, ["book_id"])


def merge_errors(spark, d):
    own = A.table(spark, d, "part").select("p_partkey", F.lit(30).cast("long").alias("n"), F.concat_ws(",", F.concat_ws("-", F.col("p_partkey") % 40, F.col("p_size")), F.concat("p_size", F.lit("-"), F.col("p_size") + 3), F.when(F.col("p_partkey") % 5 == 0, F.lit("x-1"))).alias("spec"))
    return packaging.parse_merges(own, ["p_partkey"])


def units_from_boundaries(spark, d):
    seg = A.segments(spark, d)
    chapters = seg.where(F.col("id") % 4 == 0).select("book_id", (F.col("id") / 4).cast("long").alias("idx"), F.col("id").alias("seg"), "start_ms", F.concat(F.lit("c"), F.col("id")).alias("title"))
    chapters = chapters.withColumn("group", F.floor(F.col("idx") / 3) * 3)
    totals = seg.groupBy("book_id").agg(F.max("end_ms").alias("total_ms"))
    return packaging.units_from_boundaries(chapters, totals, ["book_id"])


def units_from_marks(spark, d):
    seg = A.segments(spark, d)
    marks = seg.select("book_id", F.col("id").alias("raw_idx"), "start_ms", "end_ms")
    starts = seg.where(F.col("id") % 6 == 0).select("book_id", (F.col("id") / 6).cast("long").alias("unit"), F.when(F.col("len_ms") % 11 == 0, F.col("id") + 100_000).otherwise(F.col("id") - (F.col("len_ms") % 13)).alias("raw_idx"))
    return packaging.units_from_marks(starts, marks, ["book_id"]).select("book_id", "unit", "raw_idx", "start_ms", "end_ms", "ok")


def _unit_markers(seg, asked):
    units = seg.where(F.col("id") % 10 == 2).select("book_id", F.col("id").alias("seg"), F.concat(F.lit("u"), F.col("id")).alias("unit"), (F.col("len_ms") % 12).alias("n_sentences"))
    return packaging.unit_markers(asked.select("book_id", F.col("id").alias("seg")), units, ["book_id"]).select("book_id", "seg", "unit", "local_seg")


def unit_markers(spark, d):
    seg = A.segments(spark, d)
    return _unit_markers(seg, seg)


def track_map_check(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderkey") % 50).alias("seg"), F.when(F.col("o_orderkey") % 17 > 0, F.array((F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % 31 + 10).cast("int"))).otherwise(F.array().cast("array<int>")).alias("tracks"))
    return packaging.track_map_errors(o, ["book_id"])


def anti_cache(spark, d):
    own = A.table(spark, d, "pages").select("page_id", F.col("page_id").alias("input_time"), F.length("html").cast("long").alias("size"))
    done = own.where(F.col("page_id") % 3 > 0).select("page_id", (F.col("page_id") + F.col("page_id") % 2 * 2 - 1).alias("output_time"), "size")
    return packaging.stale(own.select("page_id", "input_time"), done, ["page_id"], 1500).select("page_id", "input_time", "output_time")


def manifest_patch(spark, d):
    o = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("track"), F.length("c_name").cast("long").alias("sentences"), F.col("c_mktsegment").alias("chapters"))
    news = o.where(F.col("track") % 9 == 0).select("track", F.lit(1).cast("long").alias("sentences"), F.when(F.col("track") % 2 == 0, "new").alias("chapters"))
    return packaging.patched(o, news, ["track"])


def validate_doc(spark, d):
    """Users' events as documents, with faults planted by their numbers."""
    seg = A.segments(spark, d)
    k, user = F.col("event_id"), F.substring("book_id", 2, 20).cast("long")
    docs = seg.select("book_id").distinct().select(F.col("book_id").alias("doc_key"), F.when(user % 5 > 0, F.col("book_id")).otherwise(" ").alias("title"), F.when(user % 7 > 0, F.lit("a.mp3")).alias("audio"))
    rows = seg.select(F.col("book_id").alias("doc_key"), F.col("id").alias("i"), F.when(k % 41 == 0, "true").when(k % 43 == 0, F.lit(None).cast("string")).when(k % 47 == 0, "-1.5").otherwise((F.col("start_ms") % 100000).cast("string")).alias("start"), F.when(k % 53 == 0, "NaN").otherwise((F.col("start_ms") % 100000 + F.col("len_ms") - 100).cast("string")).alias("end"), F.when(k % 59 > 0, F.col("text")).alias("text"))
    words = seg.where(k % 10 == 0).select(F.col("book_id").alias("doc_key"), F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.when(k % 30 > 0, "w").alias("w"), F.when(k % 70 > 0, "2").otherwise("x").alias("s"), F.when(k % 40 > 0, "3").otherwise("1").alias("e"))
    marks = seg.where(k % 9 == 0).select(F.col("book_id").alias("doc_key"), F.col("id").alias("i"), F.when(k % 27 > 0, "t").alias("title"), F.when(k % 18 > 0, "1").otherwise("-2").alias("start"), F.when(k % 36 > 0, F.col("id").cast("string")).otherwise("100000").alias("seg"))
    return validate.violations(docs, rows, words, marks)


def stream_sessions(spark, d):
    """The batch form of the session stream; a test runs the same code on a file stream."""
    return X.sessions(A.table(spark, d, "events"))


def _windows(spark, d):
    own = _timed(spark, d).where("nw <> ''").withColumn("step", F.floor(F.col("pos") / 30)).withColumn("last", F.floor(F.max("pos").over(Window.partitionBy("book_id")) / 30))
    near = own.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1))).where("step <= last")
    word = F.struct("pos", (F.col("pos") * 0.4 - F.col("step") * 12.0 + 12.0).alias("s"), (F.col("pos") * 0.4 + 0.31 - F.col("step") * 12.0 + 12.0).alias("e"))
    out = near.groupBy(F.col("book_id").cast("string").alias("key"), "step").agg(F.max("last").alias("_l"), F.array_sort(F.collect_list(word)).alias("words"))
    return out.select("key", "step", (F.col("step") * 12.0 - 12.0).alias("start"), F.lit(24.0).alias("length"), (F.col("step") == F.col("_l")).alias("final"), "words")


def stream_commit(spark, d):
    own = X.commit_table(_windows(spark, d), 6.0)
    return own.select("key", "step", "pos", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


def stream_edit_aware(spark, d):
    own = _windows(spark, d).withColumn("decision", F.when(F.col("step") % 5 == 2, "cut").when(F.col("step") % 7 == 3, "deadzone").otherwise("ok")).withColumn("offset", F.lit(45).cast("long"))
    return X.edit_aware_table(own, safety=6.0, cadence=20.0).select("key", "step", "pos", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), "status")


QUERIES = {f.__name__: f for f in (assemble, assemble_all, cut_gaps, tail_trim, sub_chunks, here_words, rollback, merge_groups, merge_errors, units_from_boundaries, units_from_marks, unit_markers, track_map_check, anti_cache, manifest_patch, validate_doc, stream_sessions, stream_commit, stream_edit_aware)}

_S = "WITH " + A.SEGMENTS
_TIMED = r"""WITH
t AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)),
n AS (SELECT conv_id AS book_id, turn AS seg, w, trim(regexp_replace(lower(w), '[^a-z'']', '', 'g'), '''') AS nw, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
st AS (SELECT *, CASE WHEN nw = '' THEN 'PENDING' WHEN pos * 10 > n * 9 THEN 'PENDING' WHEN pos % 7 = 3 THEN 'CUT' ELSE 'ALIGNED' END AS status FROM n),
tok AS (SELECT *, CASE WHEN status = 'ALIGNED' THEN pos * 0.4::DOUBLE END AS s, CASE WHEN status = 'ALIGNED' THEN pos * 0.4::DOUBLE + 0.31::DOUBLE END AS e FROM st)
"""


def _assembled(truncate: bool) -> str:
    cut = "(SELECT min(seg) FROM tok k WHERE k.book_id = tok.book_id AND k.status = 'PENDING' AND k.nw <> '')"
    return _TIMED + f""",
own AS (SELECT *, {cut if truncate else 'NULL'} AS cut FROM tok),
kept AS (SELECT * FROM own WHERE cut IS NULL OR seg < cut),
sums AS (SELECT book_id, seg, arg_min(s, pos) FILTER (s IS NOT NULL) AS seed, max(round(e, 3)) AS top FROM kept GROUP BY ALL),
lasts AS (SELECT *, coalesce(max(top) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS l FROM sums),
fill AS (SELECT kept.*, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY kept.book_id, kept.seg ORDER BY pos), seed, l) AS prev FROM kept JOIN lasts USING (book_id, seg)),
fin AS (SELECT book_id, seg, pos, round(coalesce(s, prev), 3) AS s, round(coalesce(e, prev), 3) AS e FROM fill)
"""


_RULES = _S + r""",
docs AS (SELECT DISTINCT book_id, substr(book_id, 2)::BIGINT AS u FROM segs),
n AS (SELECT book_id, count(*) AS n FROM segs GROUP BY 1),
r AS (SELECT book_id, id, event_id AS k, CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN -1.5::DOUBLE ELSE (start_ms % 100000)::DOUBLE END AS s,
  CASE WHEN event_id % 53 > 0 THEN (start_ms % 100000 + len_ms - 100)::DOUBLE END AS e FROM segs),
t AS (SELECT *, greatest(coalesce(max(s) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS top FROM r),
v AS (
  SELECT book_id, 'ERROR' AS level, 'title' AS rule, NULL::BIGINT AS seg, NULL::BIGINT AS word FROM docs WHERE u % 5 = 0
  UNION ALL SELECT book_id, 'ERROR', 'audio', NULL, NULL FROM docs WHERE u % 7 = 0
  UNION ALL SELECT book_id, 'ERROR', 'segment.start', id, NULL FROM r WHERE s IS NULL OR s < 0
  UNION ALL SELECT book_id, 'ERROR', 'segment.end', id, NULL FROM r WHERE e IS NULL
  UNION ALL SELECT book_id, 'ERROR', 'segment.order', id, NULL FROM r WHERE e + 1e-6 < s
  UNION ALL SELECT book_id, 'ERROR', 'segment.text', id, NULL FROM r WHERE k % 59 = 0
  UNION ALL SELECT book_id, 'WARN', 'segment.monotone', id, NULL FROM t WHERE s + 1e-6 < top
  UNION ALL SELECT book_id, 'ERROR', 'word.w', id, 0 FROM r WHERE k % 30 = 0
  UNION ALL SELECT book_id, 'ERROR', 'word.s', id, 0 FROM r WHERE k % 10 = 0 AND k % 30 > 0 AND k % 70 = 0
  UNION ALL SELECT book_id, 'ERROR', 'word.order', id, 0 FROM r WHERE k % 40 = 0 AND k % 30 > 0 AND k % 70 > 0
  UNION ALL SELECT book_id, 'ERROR', 'chapter.title', id, NULL FROM r WHERE k % 27 = 0
  UNION ALL SELECT book_id, 'ERROR', 'chapter.start', id, NULL FROM r WHERE k % 18 = 0
  UNION ALL SELECT book_id, 'ERROR', 'chapter.seg', id, NULL FROM r JOIN n USING (book_id) WHERE k % 9 = 0 AND (k % 36 = 0 OR id >= n))
SELECT book_id AS doc_key, level, rule, seg, word FROM v"""


SQL = {
    "validate_doc": _RULES,
    "assemble": _assembled(True) + "SELECT book_id, seg, arg_min(s, pos) AS \"start\", max(e) AS \"end\", count(*) AS n_words, string_agg(round(s * 1000)::BIGINT::VARCHAR, ',' ORDER BY pos) AS starts FROM fin GROUP BY book_id, seg",
    "assemble_all": _assembled(False) + "SELECT book_id, seg, arg_min(s, pos) AS \"start\", max(e) AS \"end\", count(*) AS n_words FROM fin GROUP BY book_id, seg",
    "cut_gaps": r"""
WITH t AS (SELECT conv_id || '-' || turn AS book_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)),
n AS (SELECT *, trim(regexp_replace(lower(w), '[^a-z'']', '', 'g'), '''') <> '' AS al FROM t),
a AS (SELECT *, CASE WHEN al THEN (count(*) FILTER (al) OVER (PARTITION BY book_id ORDER BY pos)) - 1 END AS apos FROM n)
SELECT book_id, count(*) FILTER (apos % 20 BETWEEN 4 AND 9) AS n_cut, coalesce(sum(pos) FILTER (apos % 20 BETWEEN 4 AND 9), 0)::BIGINT AS places FROM a GROUP BY 1""",
    "tail_trim": r"""
WITH w AS (SELECT doc_id AS key, """ + A.WORDS.format("text") + r""" AS ws FROM documents),
t AS (SELECT key, unnest(ws) AS nw, unnest(range(len(ws))) AS apos FROM w),
l AS (SELECT key, apos // 60 AS "window", apos, nw, lag(nw) OVER (PARTITION BY key, apos // 60 ORDER BY apos) AS pw FROM t),
n AS (SELECT *, sum(length(nw) + len(list_filter(range(2, length(nw) + 1), lambda i: nw[i] = nw[i - 1])) + CASE WHEN right(pw, 1) = left(nw, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY key, "window" ORDER BY apos) AS need FROM l)
SELECT key, "window", count(*) FILTER (need <= key % 300 + 1) AS n_fit, count(*) AS n_queued FROM n GROUP BY ALL""",
    "sub_chunks": r"""
WITH e AS (SELECT event_id, round(value * 1000)::BIGINT AS d FROM events), c AS (SELECT *, unnest(range(greatest(ceil(d / 3000.0)::BIGINT - 1, 0) + 1)) AS chunk FROM e)
SELECT event_id, chunk, chunk * 3000 AS c0, least(chunk * 3000 + 3000, d) AS c1 FROM c WHERE chunk = 0 OR least(chunk * 3000 + 3000, d) - chunk * 3000 >= 500""",
    "here_words": _TIMED + r""",
g AS (SELECT book_id, unnest(range(max(pos) // 25 + 1)) AS i FROM tok GROUP BY book_id),
a AS (SELECT *, round(s * 1000)::BIGINT AS sm, round(e * 1000)::BIGINT AS em FROM tok WHERE status = 'ALIGNED' AND nw <> '')
SELECT g.book_id, g.i, coalesce(string_agg(nw, ' ' ORDER BY pos), '') AS here FROM g LEFT JOIN a ON a.book_id = g.book_id AND em >= g.i * 10000 AND sm <= g.i * 10000 + 4000 GROUP BY ALL""",
    "rollback": _S + r""", c AS (SELECT book_id, id AS a0, id + len_ms % 9 AS a1, id + len_ms % 14 AS cursor, len_ms % 2 = 0 AS wrong FROM segs)
SELECT book_id, a0, CASE WHEN wrong THEN greatest(a1, cursor) ELSE a1 END AS a1, cursor, wrong, NOT wrong AS logged FROM c""",
    "merge_groups": _S + r""", n AS (SELECT book_id, id AS idx, count(*) OVER (PARTITION BY book_id) AS n FROM segs)
SELECT book_id, idx, CASE WHEN idx IN (0, 1) AND n > 1 THEN 0 WHEN idx IN (3, 4) AND n > 4 THEN 3 WHEN idx BETWEEN 10 AND 19 AND n > 19 THEN 10 ELSE idx END AS "group" FROM n""",
    "merge_errors": r"""
WITH p AS (SELECT p_partkey, unnest([[p_partkey % 40, p_size], [p_size, p_size + 3], CASE WHEN p_partkey % 5 = 0 THEN [NULL, NULL] END]) AS r FROM part),
q AS (SELECT p_partkey, 30::BIGINT AS n, r[1]::BIGINT AS lo, r[2]::BIGINT AS hi FROM p WHERE r IS NOT NULL),
m AS (SELECT *, max(hi) OVER (PARTITION BY p_partkey ORDER BY lo NULLS FIRST, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q)
SELECT p_partkey, n, lo, hi, CASE WHEN lo IS NULL THEN 'form' WHEN lo > hi THEN 'descending' WHEN hi >= n THEN 'range' WHEN lo <= before THEN 'overlap' END AS error FROM m""",
    "units_from_boundaries": _S + r""",
c AS (SELECT book_id, id // 4 AS idx, id AS seg, start_ms, 'c' || id AS title, (id // 4) // 3 * 3 AS g, max(end_ms) OVER (PARTITION BY book_id) AS total FROM segs),
d AS (SELECT * FROM c WHERE seg % 4 = 0),
e AS (SELECT *, concat_ws(',', CASE WHEN start_ms <= lag(start_ms) OVER w THEN 'start' END, CASE WHEN start_ms >= total THEN 'end' END, CASE WHEN seg < lag(seg) OVER w THEN 'seg' END) AS error FROM d WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
u AS (SELECT book_id, g AS "group", arg_min(title, idx) AS title, arg_min(seg, idx) AS seg, arg_min(start_ms, idx) AS start_ms, max(total) AS total, max(error) AS error, count(*) AS n_chapters FROM e GROUP BY ALL)
SELECT book_id, "group", title, seg, start_ms, error, n_chapters, coalesce(lead(start_ms) OVER (PARTITION BY book_id ORDER BY "group"), total) AS end_ms, row_number() OVER (PARTITION BY book_id ORDER BY "group") AS unit FROM u""",
    "units_from_marks": _S + r""",
a AS (SELECT book_id, id // 6 AS unit, CASE WHEN len_ms % 11 = 0 THEN id + 100000 ELSE id - len_ms % 13 END AS raw_idx FROM segs WHERE id % 6 = 0),
n AS (SELECT *, lead(raw_idx) OVER (PARTITION BY book_id ORDER BY unit) AS nx FROM a),
f AS (SELECT book_id, max(end_ms) AS fin FROM segs GROUP BY 1),
j AS (SELECT n.book_id, unit, n.raw_idx, nx, s.start_ms, coalesce(m.start_ms, fin) AS end_ms FROM n LEFT JOIN segs s ON s.book_id = n.book_id AND s.id = n.raw_idx LEFT JOIN segs m ON m.book_id = n.book_id AND m.id = nx JOIN f ON f.book_id = n.book_id)
SELECT book_id, unit, raw_idx, start_ms, end_ms, coalesce(start_ms IS NOT NULL AND (nx IS NULL OR nx > raw_idx) AND end_ms > start_ms, false) AS ok FROM j""",
    "unit_markers": _S + r""",
u AS (SELECT book_id, id AS useg, 'u' || id AS unit, len_ms % 12 AS n FROM segs WHERE id % 10 = 2)
SELECT s.book_id, s.id AS seg, u.unit, least(greatest(s.id - useg, 0), greatest(n - 1, 0)) AS local_seg FROM segs s ASOF LEFT JOIN u ON s.book_id = u.book_id AND s.id >= useg""",
    "track_map_check": r"""
WITH o AS (SELECT o_custkey AS book_id, o_orderkey AS idx, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 50 END AS seg, CASE WHEN o_orderkey % 17 > 0 THEN [o_orderkey % 7, o_orderkey % 31 + 10] ELSE [] END AS tracks FROM orders),
p AS (SELECT *, lag(seg) OVER (PARTITION BY book_id ORDER BY idx) AS pr FROM o),
a AS (SELECT book_id, idx, CASE WHEN len(tracks) < 1 THEN 'empty' WHEN seg IS NULL THEN 'seg' WHEN seg < pr THEN 'descending' END AS error, NULL::BIGINT AS track FROM p),
e AS (SELECT book_id, idx, unnest(tracks)::BIGINT AS track FROM o), n AS (SELECT *, count(*) OVER (PARTITION BY book_id, track) AS n FROM e)
SELECT * FROM a WHERE error IS NOT NULL UNION ALL SELECT book_id, idx, 'shared', track FROM n WHERE n > 1""",
    "anti_cache": r"""
WITH o AS (SELECT page_id, CASE WHEN page_id % 3 > 0 AND length(html) > 1500 THEN page_id + page_id % 2 * 2 - 1 END AS output_time FROM pages)
SELECT page_id, page_id AS input_time, output_time FROM o WHERE output_time IS NULL OR output_time < page_id""",
    "manifest_patch": r"""SELECT c_nationkey AS book, c_custkey AS track, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE length(c_name) END::BIGINT AS sentences, CASE WHEN c_custkey % 18 = 0 THEN 'new' ELSE c_mktsegment END AS chapters FROM customer""",
    "stream_sessions": r"""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
n AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY user_id ORDER BY t) + 1800000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS g FROM n)
SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, g""",
}
