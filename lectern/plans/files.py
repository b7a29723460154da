"""Queries of files read and written, track maps, units of a map, rules on files and corrected segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import governance, matching, packaging, screen, sentences, timeline, validate
from lectern.plans import adapters as A
from lectern.plans import timelines
from lectern.sources import documents as D
from lectern.sources import sinks


def captured_marks(spark, d):
    """Every user's segments as the output of a probe; each fourth mark has no title."""
    mark = F.struct((F.col("start_ms") / 1000).cast("string").alias("start_time"), (F.col("end_ms") / 1000).cast("string").alias("end_time"), F.struct(F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), "id")).alias("title")).alias("tags"))
    own = A.segments(spark, d).withColumn("m", mark).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("chapters"))
    return D.captured_marks(own.select("book_id", F.to_json(F.struct("chapters")).alias("json")), ["book_id"])


def link_list(spark, d):
    """Lines of all texts as a list file; each third text is commented out."""
    line = F.explode(F.split(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" # "), "text")).otherwise(F.col("text")), "\n"))
    return D.link_list(A.docs(spark, d).select(line.alias("value"))).groupBy("url").agg(F.count("*").alias("n"))


def _lines(spark, d):
    lines = sentences.lines(A.docs(spark, d).select("doc_id", A.book(), "text"), ["book_id", "doc_id"])
    return lines.withColumn("seg", (F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id", "para")) - 1).cast("long"))


def _map(lines):
    """An entry each 25 lines, with two tracks."""
    own = lines.groupBy("book_id").agg(F.max("seg").alias("_m")).select("book_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_m"), F.lit(25).cast("long"))).alias("idx", "seg"))
    return own.select("book_id", F.col("idx").cast("long").alias("idx"), F.concat(F.lit("ch "), "idx").alias("title"), "seg", F.array(F.col("idx") * 2 + 1, F.col("idx") * 2 + 2).alias("tracks"))


def track_map_units(spark, d):
    """Units of a map with an entry each 25 lines; track 19 and its multiples have no audio."""
    lines = _lines(spark, d)
    entries = _map(lines)
    said = lines.select("book_id", "seg", T.alignable(F.col("line")).alias("n_words"))
    audio = entries.select("book_id", F.explode("tracks").alias("track")).where(F.col("track") % 19 > 0).withColumn("dur_sec", (F.col("track") * 37 % 50 + 10).cast("double"))
    own = packaging.units_from_track_map(entries, said, audio, ["book_id"])
    return own.select("book_id", "idx", "label", "words", "seconds", F.round("minutes", 6).alias("minutes"), F.round("wps", 6).alias("wps"), "error")


def text_slices(spark, d):
    lines = _lines(spark, d)
    return packaging.text_slices(_map(lines), lines.select("book_id", "seg"), ["book_id"]).groupBy("book_id", "idx").agg(F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.count("*").alias("n"))


def auto_rate(spark, d):
    return A.units(spark, d).select("book_id", "idx", screen.auto_rate(F.col("words"), F.col("seconds"), F.lit(2.5)).alias("wps"))


def openings(spark, d):
    lines = _lines(spark, d).select("book_id", "seg", "line")
    chapters = lines.where(F.col("seg") % 20 == 3).select("book_id", F.concat(F.lit("c"), "seg").alias("title"), "seg")
    return packaging.openings(chapters, lines, ["book_id"])


def chapter_segments(spark, d):
    """Chapters at each ninth segment of a track, some of them said to begin at a segment of another track."""
    split = timeline.split_local(A.segments(spark, d), A.tracks(spark, d))
    chapters = split.where(F.col("id") % 9 == 0).select("book_id", "track", F.concat(F.lit("c"), "id").alias("title"), (F.col("id") + (F.col("end_ms") - F.col("start_ms")) % 3 * 7).alias("seg"), (F.col("start_ms") + 1).alias("start_ms"))
    return timeline.local_segments(chapters, split, ["book_id", "track"]).select("book_id", "track", "title", "local_seg")


def single_marker(spark, d):
    split = timeline.split_local(A.segments(spark, d), A.tracks(spark, d)).withColumnRenamed("track", "unit").drop("id").withColumnRenamed("local_id", "id")
    units = A.tracks(spark, d).select("book_id", F.col("track").alias("unit"), F.concat(F.lit("day "), "track").alias("title"))
    marks = split.where(F.col("id") == 2).select("book_id", "unit", F.lit("third").alias("title"), "start_ms", F.col("id").alias("seg"))
    return packaging.single_marker(units, split, marks, ["book_id"])


def without_ends(spark, d):
    return packaging.without_ends(A.segments(spark, d).select("book_id", "id"), ["book_id"], ["id"], 2, 3)


def credits_skip(spark, d):
    own = A.segments(spark, d).select("book_id", "id", F.when(F.col("id") % 6 == 0, F.lit("End CREDITS")).when(F.col("id") % 7 > 0, F.col("text")).alias("title"))
    return own.where(~packaging.is_credits(F.col("title"))).select("book_id", "id")


def work_list(spark, d):
    """Outputs that are older, too small, invalid or gapped, by the pages' numbers and sizes."""
    k = F.col("page_id")
    own = A.table(spark, d, "pages").select("page_id", k.alias("input_time"), F.length("html").cast("long").alias("size"))
    done = own.where(k % 3 > 0).select("page_id", (k + k % 2 * 2 - 1).alias("output_time"), "size", (k % 11 > 0).alias("valid"), (k % 13 == 0).alias("gapped"))
    return packaging.to_do(own.select("page_id", "input_time"), done, ["page_id"], 1500).select("page_id", "action")


def file_lint(spark, d):
    """Rules by extension over texts with lines of both kinds put after them."""
    k = F.col("doc_id")
    path = F.concat(F.lit("f"), k, F.when(k % 4 == 0, ".html").when(k % 4 == 1, ".JS").when(k % 4 == 2, ".py").otherwise(".txt"))
    more = "\nx.innerHTML = y\nif (a.innerHTML == b) {}\nm.eval (1)\nz.outerHTML += q // safe-pattern-ok\n  document.write('a'); n.insertAdjacentHTML('b', c)\n"
    return governance.lint_files(A.docs(spark, d).select(path.alias("path"), F.concat("text", F.lit(more)).alias("text"))).select("path", "line_no", "why")


def cut_log(spark, d):
    seg = A.segments(spark, d)
    cuts = seg.select("book_id", F.col("id").alias("a0"), (F.col("id") + F.col("len_ms") % 9).alias("a1"), (F.col("id") + F.col("len_ms") % 14).alias("cursor"), (F.col("len_ms") % 2 == 0).alias("wrong"))
    return sinks.cut_log(matching.rolled_back(cuts), ["book_id"])


def sentence_file(spark, d):
    """Books as text files: each line of a document is a paragraph of one sentence."""
    own = sentences.lines(A.docs(spark, d).select("doc_id", A.book(), "text"), ["book_id", "doc_id"])
    return sinks.sentence_file(own.select("book_id", F.col("doc_id").alias("chapter"), "para", F.lit(0).alias("sent"), F.col("line").alias("text")), ["book_id"])


def chapter_markers(spark, d):
    own = A.docs(spark, d).select(A.book(), F.col("doc_id").alias("chapter"), F.concat(F.lit("t"), "doc_id").alias("title"), F.concat(F.lit("/"), "doc_id").alias("url"), "text")
    said = sentences.lines(own, ["book_id", "chapter"])
    return sinks.chapter_markers(own.drop("text"), said, ["book_id"])[0]


def corrected_segments(spark, d):
    """The segments of the corrected documents, whose markers are those of ``corrections``."""
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms")
    return validate.correct(seg, timelines._marks(seg), timelines.OPS)[0].select("book_id", "id", "start_ms", "end_ms")


def split_realigned(spark, d):
    """Each book's first thirty segments and the others, as if aligned anew, in one timeline with two markers."""
    seg = A.segments(spark, d).select("book_id", "id", "start_ms", "end_ms")
    first, second = seg.where("id < 30"), seg.where("id >= 30").withColumn("id", F.col("id") - 30)
    dur = first.groupBy("book_id").agg(F.max("end_ms").alias("dur_ms"))
    ops = [{"op": "split_realign", "at_seg": 30, "parts": [{"title": "one"}]}]
    return validate.correct(seg, timelines._marks(seg), ops, realigned=lambda op: (first, second, dur))[1].select("book_id", "idx", "title", "seg", "start_ms")


def json_violations(spark, d):
    """Documents written as JSON with faults planted by their numbers, read again and checked."""
    k = F.col("event_id")
    number = F.when(k % 41 == 0, "true").when(k % 43 == 0, "null").when(k % 47 == 0, '"1.5"').when(k % 51 == 0, "-3").otherwise((F.col("start_ms") % 100000).cast("string"))
    text = F.when(k % 59 == 0, "7").when(k % 61 == 0, "null").otherwise('"x"')
    seg = F.concat(F.lit('{"start":'), number, F.lit(',"end":'), (F.col("start_ms") % 100000 + F.col("len_ms")).cast("string"), F.lit(',"text":'), text, F.lit("}"))
    own = A.segments(spark, d).withColumn("x", seg).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda y: y["x"]), ",").alias("s"), F.count("*").alias("n"))
    title = F.when(F.col("n") % 5 == 0, "12").when(F.col("n") % 7 == 0, '" "').otherwise('"t"')
    whole = F.concat(F.lit('{"title":'), title, F.lit(',"audio":"a","segments":['), "s", F.when(F.col("n") % 11 == 0, "").otherwise("]}"))
    tables = D.player_tables(own.select(F.col("book_id").alias("doc_key"), whole.alias("value")))
    found = validate.violations(tables["docs"], tables["segments"], tables["words"], tables["chapters"]).where("rule <> 'segment.monotone' AND rule <> 'segment.order'")
    return found.unionByName(validate.broken_files(tables["broken"])).select("doc_key", "rule", "seg")


QUERIES = {f.__name__: f for f in (captured_marks, link_list, track_map_units, text_slices, auto_rate, openings, chapter_segments, single_marker, without_ends, credits_skip, work_list, file_lint, cut_log, sentence_file, chapter_markers, corrected_segments, split_realigned, json_violations)}

_S = "WITH " + A.SEGMENTS
_SPLIT = timelines._SPLIT
_LINES = rf"""
WITH l AS (SELECT doc_id, {A.BOOK} AS book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, para) - 1 AS seg, line, doc_id, para FROM (SELECT book_id, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS para FROM l))"""
_MAP = _LINES + ", m AS (SELECT book_id, max(seg) + 1 AS total, unnest(range((max(seg) // 25) + 1)) AS idx FROM lines GROUP BY 1)"

SQL = {
    "captured_marks": _S + " SELECT book_id, id AS raw_idx, start_ms, end_ms, CASE WHEN id % 4 = 0 THEN id::VARCHAR ELSE 't' || id END AS title FROM segs",
    "link_list": "WITH l AS (SELECT trim(unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN ' # ' || text ELSE text END, chr(10)))) AS url FROM documents) SELECT url, count(*) AS n FROM l WHERE url <> '' AND NOT starts_with(url, '#') GROUP BY 1",
    "track_map_units": _MAP + f""",
w AS (SELECT book_id, seg // 25 AS idx, sum(len({A.WORDS.format('line')}))::BIGINT AS words FROM lines GROUP BY ALL),
t AS (SELECT book_id, idx, unnest([idx * 2 + 1, idx * 2 + 2]) AS track FROM m),
a AS (SELECT book_id, idx, sum(CASE WHEN track % 19 > 0 THEN track * 37 % 50 + 10 ELSE 0 END)::DOUBLE AS seconds, count(*) FILTER (track % 19 = 0) AS gone FROM t GROUP BY ALL)
SELECT book_id, idx, 'ch ' || idx AS label, words, seconds, round(seconds / 60, 6) AS minutes, round(CASE WHEN words > 0 AND seconds > 0 THEN words / seconds ELSE 0.0 END, 6) AS wps, CASE WHEN gone > 0 THEN 'track' END AS error FROM m JOIN w USING (book_id, idx) JOIN a USING (book_id, idx)""",
    "text_slices": _LINES + " SELECT book_id, seg // 25 AS idx, min(seg) AS s0, max(seg) AS s1, count(*) AS n FROM lines GROUP BY ALL",
    "auto_rate": "WITH " + A.UNITS + " SELECT book_id, idx, CASE WHEN seconds > 0 AND words > 0 THEN round(words / seconds, 3) ELSE 2.5::DOUBLE END AS wps FROM units",
    "openings": _LINES + r""",
o AS (SELECT a.book_id, a.seg, string_agg(b.line, ' ' ORDER BY b.seg) AS t FROM lines a JOIN lines b ON a.book_id = b.book_id AND b.seg BETWEEN a.seg AND a.seg + 5 WHERE a.seg % 20 = 3 GROUP BY ALL)
SELECT book_id, 'c' || seg AS title, seg, array_to_string(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')[1:45], ' ') AS opening FROM o""",
    "chapter_segments": _SPLIT + r""",
c AS (SELECT book_id, track, id, id + (end_ms - start_ms) % 3 * 7 AS seg, start_ms + 1 AS p0 FROM split WHERE id % 9 = 0),
n AS (SELECT c.book_id, c.track, c.id, min(struct_pack(d := abs(s.start_ms - p0), i := s.local_id)).i AS near FROM c JOIN split s ON s.book_id = c.book_id AND s.track = c.track GROUP BY ALL)
SELECT c.book_id, c.track, 'c' || c.id AS title, coalesce(s.local_id, near, 0) AS local_seg FROM c JOIN n USING (book_id, track, id) LEFT JOIN split s ON s.book_id = c.book_id AND s.track = c.track AND s.id = c.seg""",
    "single_marker": _SPLIT + r""",
f AS (SELECT book_id, track, arg_min(start_ms, local_id) AS st, max(local_id) AS m, arg_max(start_ms, local_id = 2) AS third FROM split GROUP BY ALL)
SELECT book_id, track AS unit, CASE WHEN m >= 2 THEN 'third' ELSE 'day ' || track END AS title, CASE WHEN m >= 2 THEN third ELSE st END AS start_ms, CASE WHEN m >= 2 THEN 2 ELSE 0 END::BIGINT AS seg FROM f""",
    "without_ends": _S + ", n AS (SELECT book_id, id, count(*) OVER (PARTITION BY book_id) AS n FROM segs) SELECT book_id, id FROM n WHERE id >= 2 AND id < n - 3",
    "credits_skip": _S + " SELECT book_id, id FROM segs WHERE id % 6 > 0 AND (id % 7 = 0 OR NOT regexp_matches(text, '(?i)credits'))",
    "work_list": r"""
WITH p AS (SELECT page_id, page_id % 3 > 0 AS there, page_id + page_id % 2 * 2 - 1 AS o, length(html) > 1500 AS large FROM pages)
SELECT page_id, CASE WHEN NOT there THEN 'run' WHEN page_id % 13 = 0 THEN 'delete' WHEN page_id % 11 = 0 THEN 'rerun' WHEN large AND o >= page_id THEN 'skip' ELSE 'run' END AS action FROM p""",
    "file_lint": r"""
WITH f AS (SELECT 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.JS' WHEN 2 THEN '.py' ELSE '.txt' END AS path, doc_id % 4 AS k,
  text || chr(10) || 'x.innerHTML = y' || chr(10) || 'if (a.innerHTML == b) {}' || chr(10) || 'm.eval (1)' || chr(10) || 'z.outerHTML += q // safe-pattern-ok' || chr(10) || '  document.write(''a''); n.insertAdjacentHTML(''b'', c)' || chr(10) AS t FROM documents),
l AS (SELECT path, k, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT path, k, string_split(t, chr(10)) AS ls FROM f)),
r AS (SELECT * FROM (VALUES (0, '\.(inner|outer)HTML\s*\+?=([^=]|$)', 'assigns an HTML string to .innerHTML/.outerHTML (use el()/clear())'), (0, '\.insertAdjacentHTML\s*\(', 'insertAdjacentHTML() builds DOM from a string (use el()/clear())'), (0, '\bdocument\.write\s*\(', 'document write sink injects an HTML string'), (2, '\.eval\s*\(', 'parenthesised eval-mode call — use model.train(False) for inference mode')) v(kind, p, why))
SELECT path, line_no, why FROM l JOIN r ON kind = k AND regexp_matches(x, p) WHERE NOT regexp_matches(x, '(#|//)\s*safe-pattern-ok')""",
    "cut_log": _S + " SELECT book_id, id AS a0, id + len_ms % 9 AS a1, len_ms % 9 AS n_words FROM segs WHERE len_ms % 2 = 1",
    "sentence_file": _LINES + r""",
n AS (SELECT *, lead(seg) OVER (PARTITION BY book_id ORDER BY seg) IS NULL AS fin FROM lines),
x AS (SELECT book_id, seg, 0 AS k, line FROM n UNION ALL SELECT book_id, seg, 1, '' FROM n WHERE NOT fin)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seg, k) - 1 AS n, line FROM x""",
    "chapter_markers": _LINES + r""",
n AS (SELECT book_id, doc_id AS chapter, len(ls)::BIGINT AS n_sentences FROM l),
s AS (SELECT *, (sum(n_sentences) OVER (PARTITION BY book_id ORDER BY chapter) - n_sentences)::BIGINT AS seg FROM n)
SELECT book_id, chapter, 't' || chapter AS title, '/' || chapter AS url, seg, n_sentences FROM s WHERE n_sentences > 0""",
    "corrected_segments": _S + r""",
a AS (SELECT book_id, id, CASE WHEN id BETWEEN 5 AND 9 THEN greatest(start_ms - 2400, 0) ELSE start_ms END AS s, CASE WHEN id BETWEEN 5 AND 9 THEN greatest(end_ms - 2400, 0) ELSE end_ms END AS e FROM segs)
SELECT book_id, id, s + CASE WHEN id = 7 THEN 1500 ELSE 0 END AS start_ms, e + CASE WHEN id = 7 THEN 1500 ELSE 0 END AS end_ms FROM a""",
    "split_realigned": _S + r""",
d AS (SELECT book_id, max(end_ms) AS dur FROM segs WHERE id < 30 GROUP BY 1)
SELECT book_id, (id // 30) AS idx, CASE WHEN id = 0 THEN 'one' ELSE 'Part 2' END AS title, id AS seg, start_ms + CASE WHEN id = 0 THEN 0 ELSE dur END AS start_ms FROM segs JOIN d USING (book_id) WHERE id IN (0, 30)""",
    "json_violations": _S + r""",
n AS (SELECT book_id, count(*) AS n FROM segs GROUP BY 1)
SELECT book_id AS doc_key, 'json' AS rule, NULL::BIGINT AS seg FROM n WHERE n % 11 = 0
UNION ALL SELECT book_id, 'title', NULL FROM n WHERE n % 11 > 0 AND (n % 5 = 0 OR n % 7 = 0)
UNION ALL SELECT book_id, 'segment.start', id FROM segs JOIN n USING (book_id) WHERE n % 11 > 0 AND (event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 51 = 0)
UNION ALL SELECT book_id, 'segment.text', id FROM segs JOIN n USING (book_id) WHERE n % 11 > 0 AND (event_id % 59 = 0 OR event_id % 61 = 0)""",
}
