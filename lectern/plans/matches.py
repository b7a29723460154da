"""Queries of drift profiles and fuzzy matching. Heard words are those of the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import drift, matching, screen
from lectern.plans import adapters as A

INTERVAL, WIN = 21_600_000, 3_600_000


def _tracks(spark, d):
    return A.segments(spark, d).groupBy("book_id").agg(F.max("end_ms").alias("dur_ms"))


def probe_grid(spark, d):
    return drift.dense_grid(_tracks(spark, d), INTERVAL, WIN)


def probe_capped(spark, d):
    return drift.capped(drift.dense_grid(_tracks(spark, d), INTERVAL, WIN), ["book_id"], 7).select("book_id", "i", "t0")


def sparse_grid(spark, d):
    return drift.sparse_grid(_tracks(spark, d), 9, WIN)


def spread_sample(spark, d):
    return drift.spread(A.segments(spark, d).select("book_id", "id"), ["book_id"], "id")


def aligned_window(spark, d):
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms", "text")
    return drift.aligned_window(drift.dense_grid(_tracks(spark, d), INTERVAL, WIN), seg, ["book_id"], WIN).select("book_id", "i", "t0", "aligned")


def window_counts(spark, d):
    """Distinct words of each window; what is heard there is the text of its first words only."""
    own = aligned_window(spark, d).withColumn("heard", F.array_join(F.slice(F.split("aligned", " "), 1, 9), " "))
    return drift.word_counts(own, "aligned", "heard").select("book_id", "i", "n_aligned", "n_heard")


def overlap(spark, d):
    own = A.docs(spark, d).select("doc_id", "source", F.array_distinct(T.words_of(F.col("text"))).alias("w"))
    other = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("h"))
    return own.join(other, "doc_id").select("doc_id", F.round(T.overlap(F.col("w"), F.col("h")), 9).alias("overlap"))


def _profile(spark, d):
    """Per user a series of windows: the fraction of each event's value as its overlap, in order of time."""
    own = A.segments(spark, d).select("book_id", F.col("id").alias("i"), F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), F.round((F.col("len_ms") % 1000) / 1000.0, 3).alias("overlap"))
    own = drift.rolling_median(own, ["book_id"], "i", "overlap", 3)
    return own.withColumn("flagged", drift.flagged(F.col("smoothed"), 0.4))


def rolling_median(spark, d):
    return _profile(spark, d).select("book_id", "i", "overlap", F.round("smoothed", 6).alias("smoothed"), "flagged")


def flagged_runs(spark, d):
    return drift.flagged_runs(_profile(spark, d), ["book_id"], 0.4)


def longest_run_suggest(spark, d):
    seg = A.segments(spark, d).withColumn("start_ms", F.col("start_ms") + 1)
    return drift.longest_run(flagged_runs(spark, d), seg, ["book_id"]).select("book_id", "i_start", "n_windows", "suggest_seg")


def run_windows(spark, d):
    return drift.windows_of_runs(_profile(spark, d), flagged_runs(spark, d), ["book_id"]).select("book_id", "i", "i_start")


def drift_bars(spark, d):
    return _profile(spark, d).select("book_id", "i", T.bar(F.col("overlap")).alias("bar"))


def drift_gate(spark, d):
    return screen.gate(_profile(spark, d), ["book_id"], "flagged", 0.4).select("book_id", "n", "n_failed", F.round("fail_share", 9).alias("fail_share"), "ok")


def best_match(spark, d):
    own = A.docs(spark, d).groupBy(F.col("source").alias("key")).agg(F.min_by("text", "doc_id").alias("text"))
    own = own.select("key", F.slice(T.words_of(F.col("text")), 1, 40).alias("words"))
    return matching.best_match(own, A.heard(spark, d)).select("item_id", "key", F.round("score", 9).alias("score"))


def forward_match(spark, d):
    """Every item from cursors all over each book."""
    books = A.docs(spark, d).select(A.book()).distinct()
    own = matching.forward_match_all(A.book_texts(spark, d), books, A.heard(spark, d).withColumnRenamed("item_id", "item"), ["book_id"])
    return own.select("book_id", "item", "cursor", "best_off", F.round("best_score", 9).alias("best_score"))


def resync_decision(spark, d):
    own = forward_match(spark, d).withColumn("here", F.round((F.col("item") % 10) / 10.0, 1))
    return own.select("book_id", "item", "cursor", matching.resync_decision(F.col("here"), F.col("best_off"), F.col("best_score"), F.col("item") % 8 == 0).alias("decision"))


def deadzone_runs(spark, d):
    own = A.segments(spark, d).select("book_id", F.col("id").alias("step"), F.when(F.col("len_ms") % 3 > 0, "deadzone").otherwise("ok").alias("decision"))
    return matching.deadzone_runs(own, ["book_id"])


def _located(spark, d, est, stride=None):
    heard = A.heard(spark, d).withColumnRenamed("item_id", "item")
    return matching.locate_all(A.book_lines(spark, d), heard, ["book_id"], est, stride).withColumn("score", F.round("score", 9))


def locate_segment(spark, d):
    """Around one estimate near the head of each book; locate_segment_all searches the rest too."""
    return _located(spark, d, 200).select("book_id", "item", "seg", "score")


def locate_segment_all(spark, d):
    """Around estimates 6000 lines apart, whose ranges of 3000 lines to both sides hold each line of a book once."""
    return _located(spark, d, 3000, 6000).select("book_id", "item", "est", "seg", "score")


def _anchors(spark, d):
    return A.segments(spark, d).where(F.col("id") % 3 == 0).select("book_id", (F.col("start_ms") / 1000.0).alias("g0"), (F.col("id") + (F.col("len_ms") % 17) - 8).alias("seg"), F.round((F.col("len_ms") % 100) / 100.0, 2).alias("conf"))


def trusted_anchors(spark, d):
    return matching.trusted_anchors(_anchors(spark, d), ["book_id"])


def _totals(spark, d):
    return A.segments(spark, d).groupBy("book_id").agg((F.max("end_ms") / 1000.0).alias("total_dur"), F.count("*").alias("total_segs"))


def interp(spark, d):
    """The time of every segment, unrounded: engines round half a millisecond differently."""
    wanted = A.segments(spark, d).select("book_id", F.col("id").alias("seg"))
    return matching.interpolate(trusted_anchors(spark, d), wanted, _totals(spark, d), ["book_id"])


def _refined(spark, d):
    seg = A.segments(spark, d)
    chunks = seg.select("book_id", F.col("start_ms").alias("t"), F.split("text", r"[^a-z0-9]+").alias("heard"))
    openings = seg.where(F.col("id") % 8 == 0).select("book_id", F.col("id").alias("chapter"), (F.col("start_ms") + 40_000_000).alias("est"), F.split("text", r"[^a-z0-9]+").alias("opening"))
    return matching.refine(chunks, openings, ["book_id"], 20_000_000, 0.99)


def refine_best(spark, d):
    return _refined(spark, d).select("book_id", "chapter", "start", F.round("overlap", 9).alias("overlap"), "low")


def boundary_gate(spark, d):
    own = _refined(spark, d)
    tracks = A.segments(spark, d).where(F.col("id") < 12).select("book_id")
    return matching.boundary_gate(own, trusted_anchors(spark, d), tracks, ["book_id"], 0.99)


def exact_passages(spark, d):
    own = A.docs(spark, d).select("doc_id", T.words_of(F.col("text")).alias("words"))
    return matching.exact_passages(own, A.heard(spark, d).withColumnRenamed("heard", "words"))


QUERIES = {f.__name__: f for f in (probe_grid, probe_capped, sparse_grid, spread_sample, aligned_window, window_counts, overlap, rolling_median, flagged_runs, longest_run_suggest, run_windows, drift_bars, drift_gate, best_match, forward_match, resync_decision, deadzone_runs, locate_segment, locate_segment_all, trusted_anchors, interp, refine_best, boundary_gate, exact_passages)}

_S = "WITH " + A.SEGMENTS
_GRID = _S + f""",
tr AS (SELECT book_id, max(end_ms) AS dur_ms, greatest(max(end_ms) - {WIN}, 0) AS z FROM segs GROUP BY 1),
g AS (SELECT book_id, dur_ms, z, unnest(range(z // {INTERVAL} + 1)) AS i FROM tr),
grid AS (SELECT book_id, dur_ms, i, least(i * {INTERVAL}, z) AS t0, least(i * {INTERVAL}, z) + {WIN} AS t1 FROM g)
"""
_PROFILE = _S + r""",
o AS (SELECT book_id, id AS i, start_ms AS t0, end_ms AS t1, round((len_ms % 1000) / 1000.0::DOUBLE, 3) AS overlap FROM segs),
sm AS (SELECT *, median(overlap) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM o),
prof AS (SELECT *, smoothed < 0.4::DOUBLE AS flagged FROM sm)
"""
_RUNS = _PROFILE + r""",
isl AS (SELECT *, i - row_number() OVER (PARTITION BY book_id ORDER BY i) AS grp FROM prof WHERE flagged),
runs AS (SELECT book_id, min(i) AS i_start, min(t0) AS t_start, arg_max(t1, i) AS t_end, count(*) AS n_windows, round(min(overlap), 3) AS min_overlap, round(sum(overlap) / count(*), 3) AS mean_overlap FROM isl GROUP BY book_id, grp)
"""
_ANCHORS = _S + r""",
anc AS (SELECT book_id, start_ms / 1000.0::DOUBLE AS g0, id + (len_ms % 17) - 8 AS seg, round((len_ms % 100) / 100.0::DOUBLE, 2) AS conf FROM segs WHERE id % 3 = 0),
good AS (SELECT *, coalesce(max(seg) OVER (PARTITION BY book_id ORDER BY g0, seg, conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM anc WHERE conf >= 0.3::DOUBLE),
trust AS (SELECT book_id, g0, seg, conf FROM good WHERE seg > top)
"""
_REFINE = r""",
ch AS (SELECT book_id, start_ms AS t, list_distinct(string_split_regex(text, '[^a-z0-9]+')) AS h FROM segs),
op AS (SELECT book_id, id AS chapter, start_ms + 40000000 AS est, list_distinct(string_split_regex(text, '[^a-z0-9]+')) AS o FROM segs WHERE id % 8 = 0),
sc AS (SELECT op.book_id, chapter, est, t, len(list_intersect(o, h))::DOUBLE / len(o) AS ov, abs(t - est) <= 20000000 AS near FROM op JOIN ch ON op.book_id = ch.book_id AND abs(t - est) <= 2.2::DOUBLE * 20000000),
be AS (SELECT book_id, chapter, min(struct_pack(s := -ov, t := t)) FILTER (near) AS a, min(struct_pack(s := -ov, t := t)) AS b FROM sc GROUP BY ALL),
ref AS (SELECT book_id, chapter, CASE WHEN a IS NULL OR (-a.s < 0.99 AND b.s < a.s) THEN b ELSE a END AS p FROM be)
"""
#: as the operator: a word counts once in a span, at its first place there, so scores are running sums over places
_FORWARD = "WITH " + A.BOOK_WORDS + f""",
books AS (SELECT DISTINCT {A.BOOK} AS book_id FROM documents),
sizes AS (SELECT book_id, count(bw.nw) AS n FROM books LEFT JOIN bw USING (book_id) GROUP BY 1),
cur AS (SELECT book_id, unnest(list_filter(range(0, greatest(n, 1), 1000), lambda c: c = 0 OR n - c > 40)) AS c FROM sizes),
items AS (SELECT item_id AS item, ws, list_distinct(ws) AS hs, greatest(1, len(ws) * 13 // 10) AS s FROM (SELECT item_id, {A.WORDS.format('text')} AS ws FROM benchmark)),
twice AS (SELECT book_id, nw, apos, unnest([apos // 1000 * 1000, apos // 1000 * 1000 - 1000]) AS c FROM bw),
win AS (SELECT book_id, c, apos - c AS o, nw FROM twice SEMI JOIN cur USING (book_id, c) WHERE apos - c < 1500),
p AS (SELECT *, lag(o) OVER (PARTITION BY book_id, c, nw ORDER BY o) AS pr, count(*) OVER (PARTITION BY book_id, c) AS m FROM win),
spans AS (SELECT DISTINCT s FROM items),
de AS (SELECT book_id, c, s, o, sum(d) AS d FROM (
  SELECT book_id, c, s, greatest(coalesce(pr + 1, 0), o - s + 1, 0) AS o, 1 AS d FROM p, spans UNION ALL SELECT book_id, c, s, o + 1, -1 FROM p, spans) GROUP BY ALL),
dd AS (SELECT book_id, c, s, p.o, m, sum(coalesce(d, 0)) OVER (PARTITION BY book_id, c, s ORDER BY p.o) AS d FROM (SELECT book_id, c, o, m, s FROM p, spans) p LEFT JOIN de USING (book_id, c, s, o)),
words AS (SELECT item, s, unnest(hs) AS nw FROM items),
he AS (SELECT book_id, c, item, o, sum(d) AS d FROM (
  SELECT book_id, c, item, greatest(coalesce(pr + 1, 0), o - s + 1, 0) AS o, 1 AS d FROM p JOIN words USING (nw) UNION ALL SELECT book_id, c, item, o + 1, -1 FROM p JOIN words USING (nw)) GROUP BY ALL),
hh AS (SELECT book_id, c, item, q.s, q.o, sum(coalesce(he.d, 0)) OVER (PARTITION BY book_id, c, item ORDER BY q.o) AS h FROM (SELECT book_id, c, o, item, s FROM p, items) q LEFT JOIN he USING (book_id, c, item, o)),
sc AS (SELECT book_id, c, item, min(struct_pack(s := -(h / dd.d::DOUBLE), o := hh.o)) AS b FROM hh JOIN dd USING (book_id, c, s, o) WHERE h > 0 AND hh.o >= 40 AND hh.o <= m - greatest(1, s // 2) GROUP BY ALL),
found AS (SELECT cur.book_id, items.item, cur.c AS cursor, coalesce(b.o, 0)::BIGINT AS best_off, round(coalesce(-b.s, 0.0::DOUBLE), 9) AS best_score FROM cur CROSS JOIN items LEFT JOIN sc ON sc.book_id = cur.book_id AND sc.c = cur.c AND sc.item = items.item)
"""
SQL = {
    "forward_match": _FORWARD + "SELECT * FROM found",
    "resync_decision": _FORWARD + """SELECT book_id, item, cursor, CASE WHEN (item % 10) / 10.0 >= 0.5 AND item % 8 > 0 THEN 'ok' WHEN best_score >= 0.6 AND best_off >= 40 THEN 'cut' WHEN (item % 10) / 10.0 >= 0.5 THEN 'ok' ELSE 'deadzone' END AS decision FROM found""",
    "probe_grid": _GRID + "SELECT * FROM grid",
    "probe_capped": _GRID
    + r""", n AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM grid)
SELECT book_id, i, t0 FROM n WHERE n <= 7 OR list_contains(list_transform(range(7), lambda j: round_even(j * (n - 1) / 6.0::DOUBLE, 0)::BIGINT), i)""",
    "sparse_grid": _S + f", tr AS (SELECT book_id, max(end_ms) AS dur_ms FROM segs GROUP BY 1), g AS (SELECT *, unnest(range(9)) AS i FROM tr) SELECT book_id, dur_ms, i, (round(least((0.02::DOUBLE + i * 0.94::DOUBLE / 8) * dur_ms, (dur_ms - {WIN})::DOUBLE) / 100) * 100)::BIGINT AS t0 FROM g",
    "spread_sample": _S + r""", n AS (SELECT book_id, id, count(*) OVER (PARTITION BY book_id) AS n FROM segs), k AS (SELECT *, least(n, 6) AS k FROM n)
SELECT book_id, id FROM k WHERE list_contains(list_transform(range(k), lambda j: round_even(CASE WHEN k > 1 THEN j * (n - 1) / (k - 1)::DOUBLE ELSE 0 END, 0)::BIGINT), id)""",
    "aligned_window": _GRID
    + r""", c AS (SELECT grid.book_id, i, string_agg(text, ' ' ORDER BY id) AS a FROM grid JOIN segs ON grid.book_id = segs.book_id AND end_ms >= t0 AND start_ms <= t1 GROUP BY ALL),
m AS (SELECT grid.book_id, i, min(struct_pack(d := abs(start_ms + end_ms - 2 * t0), id := id, text := text)).text AS a FROM grid JOIN segs USING (book_id) GROUP BY ALL)
SELECT grid.book_id, grid.i, t0, coalesce(c.a, m.a) AS aligned FROM grid LEFT JOIN c USING (book_id, i) LEFT JOIN m USING (book_id, i)""",
    "window_counts": _GRID
    + rf""", c AS (SELECT grid.book_id, i, string_agg(text, ' ' ORDER BY id) AS a FROM grid JOIN segs ON grid.book_id = segs.book_id AND end_ms >= t0 AND start_ms <= t1 GROUP BY ALL),
m AS (SELECT grid.book_id, i, min(struct_pack(d := abs(start_ms + end_ms - 2 * t0), id := id, text := text)).text AS a FROM grid JOIN segs USING (book_id) GROUP BY ALL),
w AS (SELECT grid.book_id, grid.i, coalesce(c.a, m.a) AS a FROM grid LEFT JOIN c USING (book_id, i) LEFT JOIN m USING (book_id, i))
SELECT book_id, i, len(list_distinct({A.WORDS.format('a')}))::BIGINT AS n_aligned, len(list_distinct({A.WORDS.format("array_to_string(string_split(a, ' ')[1:9], ' ')")}))::BIGINT AS n_heard FROM w""",
    "overlap": f"WITH w AS (SELECT doc_id, list_distinct({A.WORDS.format('text')}) AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / len(a.w) ELSE 0 END, 9) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
    "rolling_median": _PROFILE + "SELECT book_id, i, overlap, round(smoothed, 6) AS smoothed, flagged FROM prof",
    "flagged_runs": _RUNS + "SELECT * FROM runs",
    "longest_run_suggest": _RUNS + r""", best AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n_windows DESC, i_start) AS r FROM runs)
SELECT best.book_id, i_start, n_windows, min(struct_pack(s := start_ms, id := id)).id AS suggest_seg FROM best LEFT JOIN segs ON segs.book_id = best.book_id AND start_ms + 1 >= t_start WHERE r = 1 GROUP BY ALL""",
    "run_windows": _RUNS + "SELECT prof.book_id, i, i_start FROM prof JOIN runs ON runs.book_id = prof.book_id AND flagged AND t0 BETWEEN t_start AND t_end",
    "drift_bars": _PROFILE + "SELECT book_id, i, repeat('#', round(overlap * 30)::INT) || repeat('-', 30 - round(overlap * 30)::INT) AS bar FROM prof",
    "drift_gate": _PROFILE + "SELECT book_id, count(*) AS n, count(*) FILTER (flagged) AS n_failed, round(count(*) FILTER (flagged) / count(*)::DOUBLE, 9) AS fail_share, count(*) FILTER (flagged) / count(*)::DOUBLE <= 0.4 AS ok FROM prof GROUP BY 1",
    "best_match": f"""
WITH o AS (SELECT source AS key, list_distinct(({A.WORDS.format('arg_min(text, doc_id)')})[1:40]) AS w FROM documents GROUP BY 1),
h AS (SELECT item_id, {A.WORDS.format('text')} AS w FROM benchmark),
s AS (SELECT item_id, key, len(list_intersect(o.w, h.w))::DOUBLE / len(o.w) AS s FROM o, h),
b AS (SELECT item_id, min(struct_pack(s := -s, key := key)) FILTER (s > 0) AS b FROM s GROUP BY 1)
SELECT item_id, b.key AS key, round(coalesce(-b.s, 0.0::DOUBLE), 9) AS score FROM b""",
    "deadzone_runs": _S + r""", x AS (SELECT book_id, id AS step, id - row_number() OVER (PARTITION BY book_id ORDER BY id) AS g FROM segs WHERE len_ms % 3 > 0)
SELECT book_id, min(step) AS step, count(*) AS length, count(*) >= 6 AS abort FROM x GROUP BY book_id, g""",
    "locate_segment": f"""
WITH l AS (SELECT doc_id, {A.BOOK} AS book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
s AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, para) - 1 AS seg, {A.WORDS.format('line')} AS ws FROM (SELECT book_id, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS para FROM l)),
c AS (SELECT book_id, seg, ws, sum(len(ws)) OVER (PARTITION BY book_id ORDER BY seg)::BIGINT AS c1, (sum(len(ws)) OVER (PARTITION BY book_id ORDER BY seg) - len(ws))::BIGINT AS c0 FROM s),
w AS (SELECT a.book_id, a.seg, list_distinct(flatten(list(b.ws))) AS win FROM c a JOIN c b ON a.book_id = b.book_id AND b.seg >= a.seg AND b.c0 - a.c0 < 60 GROUP BY ALL),
t AS (SELECT item_id AS item, list_distinct(({A.WORDS.format('text')})[1:60]) AS t FROM benchmark),
n AS (SELECT book_id, max(seg) + 1 AS n FROM c GROUP BY 1),
x AS (SELECT book_id, item, seg, len(list_intersect(t, win))::DOUBLE / len(t) AS s FROM w JOIN n USING (book_id), t WHERE seg >= 0 AND seg < least(n, 3200)),
b AS (SELECT book_id, item, min(struct_pack(s := -s, seg := seg)) AS b FROM x GROUP BY ALL)
SELECT book_id, item, b.seg AS seg, round(-b.s, 9) AS score FROM b""",
    "locate_segment_all": f"""
WITH l AS (SELECT doc_id, {A.BOOK} AS book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
s AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, para) - 1 AS seg, {A.WORDS.format('line')} AS ws FROM (SELECT book_id, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS para FROM l)),
c AS (SELECT book_id, seg, ws, sum(len(ws)) OVER (PARTITION BY book_id ORDER BY seg)::BIGINT AS c1, (sum(len(ws)) OVER (PARTITION BY book_id ORDER BY seg) - len(ws))::BIGINT AS c0 FROM s),
w AS (SELECT a.book_id, a.seg, list_distinct(flatten(list(b.ws))) AS win FROM c a JOIN c b ON a.book_id = b.book_id AND b.seg >= a.seg AND b.c0 - a.c0 < 60 GROUP BY ALL),
t AS (SELECT item_id AS item, list_distinct(({A.WORDS.format('text')})[1:60]) AS t FROM benchmark),
x AS (SELECT book_id, item, (seg // 6000) * 6000 + 3000 AS est, seg, len(list_intersect(t, win))::DOUBLE / len(t) AS s FROM w, t),
b AS (SELECT book_id, item, est, min(struct_pack(s := -s, seg := seg)) AS b FROM x GROUP BY ALL)
SELECT book_id, item, est, b.seg AS seg, round(-b.s, 9) AS score FROM b""",
    "trusted_anchors": _ANCHORS + "SELECT * FROM trust",
    "interp": _ANCHORS + r""",
tot AS (SELECT book_id, max(end_ms) / 1000.0::DOUBLE AS td, count(*) AS ts FROM segs GROUP BY 1),
pts AS (SELECT book_id, g0 AS g, seg AS s FROM trust UNION SELECT book_id, 0.0, 0 FROM tot UNION SELECT book_id, td, ts FROM tot),
sp AS (SELECT book_id, g, s, row_number() OVER w AS i, lead(g) OVER w AS g1, lead(s) OVER w AS s1 FROM pts WINDOW w AS (PARTITION BY book_id ORDER BY g, s)),
wa AS (SELECT book_id, id AS seg FROM segs),
hit AS (SELECT wa.book_id, wa.seg, arg_min(CASE WHEN s1 = s THEN g ELSE g + (g1 - g) * (wa.seg - s) / (s1 - s) END, i) AS t FROM wa JOIN sp ON sp.book_id = wa.book_id AND wa.seg BETWEEN s AND s1 GROUP BY ALL)
SELECT wa.book_id, wa.seg, coalesce(t, td * wa.seg / ts) AS time FROM wa JOIN tot USING (book_id) LEFT JOIN hit USING (book_id, seg)""",
    "refine_best": _S + _REFINE + "SELECT book_id, chapter, p.t AS \"start\", round(-p.s, 9) AS overlap, -p.s < 0.99 AS low FROM ref",
    "boundary_gate": _ANCHORS + _REFINE + r""",
dn AS (SELECT book_id, chapter, p.t AS st, -p.s AS ov, lag(p.t) OVER (PARTITION BY book_id ORDER BY chapter) AS pr FROM ref),
ag AS (SELECT book_id, coalesce(bool_or(st < pr), false) AS down, count(*) FILTER (ov < 0.99) AS n_low FROM dn GROUP BY 1),
na AS (SELECT book_id, count(*) AS n FROM trust GROUP BY 1),
ne AS (SELECT book_id, greatest(2, (count(*) + 1) // 2) AS need FROM segs WHERE id < 12 GROUP BY 1),
al AS (SELECT book_id, n_low, coalesce(n, 0) AS n_anchors, need, concat_ws(',', CASE WHEN coalesce(n, 0) < need THEN 'few_anchors' END, CASE WHEN down THEN 'not_monotonic' END, CASE WHEN n_low > 0 THEN 'low_overlap' END) AS reasons FROM ag JOIN ne USING (book_id) LEFT JOIN na USING (book_id))
SELECT book_id, n_low, n_anchors, need, reasons, reasons = '' AS reliable FROM al""",
    "exact_passages": f"""
WITH a AS (SELECT doc_id, ' ' || array_to_string({A.WORDS.format('text')}, ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, len({A.WORDS.format('text')}) AS n, ' ' || array_to_string({A.WORDS.format('text')}, ' ') || ' ' AS t FROM benchmark)
SELECT doc_id, item_id FROM a, b WHERE n > 0 AND contains(a.t, b.t)""",
}
