"""Queries over texts and pages, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import governance, packaging, sentences, timeline
from lectern.plans import adapters as A
from lectern.sources import documents as D
from lectern.sources import html as H

W = A.WORDS


def norm_words(spark, d):
    w = T.words_of(F.col("text"))
    return A.docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.array_join(w, " ").alias("words"))


def alignable_count(spark, d):
    return A.docs(spark, d).groupBy("source").agg(F.sum(T.alignable(F.col("text"))).alias("n"))


def token_stream(spark, d):
    return sentences.token_stream(A.docs(spark, d), ["doc_id"])


def sentence_split(spark, d):
    lines = sentences.lines(A.docs(spark, d), ["doc_id"])
    return sentences.sentences(lines, ["doc_id", "para"])


def sentence_glue(spark, d):
    """Turns of conversations with an abbreviation put before each full stop that is not the last."""
    own = A.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\. ", " Mr. ").alias("line"))
    return sentences.sentences(own, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


def slug(spark, d):
    return A.docs(spark, d).select("doc_id", T.slug(F.get(F.split("text", "\n"), F.lit(0))).alias("slug"))


def selector_norm(spark, d):
    return A.table(spark, d, "part").select("p_partkey", T.selector(F.concat(F.lit(" "), "p_name", F.lit(" 6.33 "))).alias("selector"))


def natural_sort(spark, d):
    from pyspark.sql import Window

    key = T.natural_key(F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 97).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")))
    own = A.table(spark, d, "customer").select("c_nationkey", "c_custkey", key.alias("k"))
    return own.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("k")).cast("long").alias("place"))


def clean_text(spark, d):
    return A.docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("text"))


def cache_name(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.cache_name(F.col("url")).alias("name"), T.last_part(F.col("url")).alias("part"), T.first_number(F.col("url")).alias("number"))


def ascii_snippet(spark, d):
    return A.docs(spark, d).select("doc_id", T.snippet(T.ascii_fold(F.col("text"))).alias("snippet"), T.prose_words(F.col("text")).alias("n_words"))


def ctc_collapse(spark, d):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 29)
    return A.table(spark, d, "benchmark").select("item_id", T.ctc_collapse(ids).alias("text"))


def page_title(spark, d):
    return A.table(spark, d, "pages").select("page_id", H.title(F.col("html"), F.col("url")).alias("title"))


def page_paragraphs(spark, d):
    return H.paragraphs(A.table(spark, d, "pages"))


def toc_order(spark, d):
    nodes = H.nodes(A.table(spark, d, "pages"))
    return packaging.toc_order(nodes, ["page_id"], chapter=r"(?i)^/([a-z]+)")


def toc_slice(spark, d):
    return packaging.toc_slice(toc_order(spark, d), ["page_id"], "The", "to")


def volume_counts(spark, d):
    return packaging.volume_counts(toc_order(spark, d), ["page_id"])


def running_ordinals(spark, d):
    own = sentences.lines(A.docs(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))
    own = A.docs(spark, d).select("doc_id", A.book(), F.col("doc_id").alias("idx")).join(own, "doc_id", "left").fillna(0, ["n_sentences"])
    return sentences.running_ordinals(own).select("book_id", "idx", "n_sentences", "seg", "skipped")


def prose_quota(spark, d):
    return governance.prose_quota(A.docs(spark, d), "doc_id")


def line_lint(spark, d):
    return governance.lint_lines(A.docs(spark, d), "doc_id", "text", [(r"[A-Z]{4,}!!", "shouting"), (r"(?i)token\s*=", "secret"), (r"\|\s*$", "open cell")])


def path_rules(spark, d):
    own = A.table(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 5 == 0, "samples/").when(F.col("page_id") % 7 == 0, "a/").otherwise(""), T.last_part(F.col("url")), F.when(F.col("page_id") % 3 == 0, ".WAV").when(F.col("page_id") % 4 == 0, ".chapters.json").otherwise(".html")).alias("path"))
    return governance.forbidden_paths(own)


def sync_map(spark, d):
    own = A.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.array(F.col("text"), F.lit(" "), F.col("role")).alias("lines"), F.lit(None).cast("string").alias("text"), F.when(F.col("turn") % 5 != 4, (F.col("turn") * 1.25).cast("string")).otherwise("x").alias("begin"), ((F.col("turn") + 1) * 1.25).cast("string").alias("end"))
    return D.sync_segments(own, ["conv_id"])


def flat_words(spark, d):
    k = F.col("event_id") % 3
    s, e = F.col("value").cast("string"), (F.col("value") + 1).cast("string")
    none = F.lit(None).cast("string")
    own = A.table(spark, d, "events").select("event_id", F.when(k == 0, F.col("event_type")).alias("w"), F.when(k == 1, F.col("event_type")).alias("word"), F.when(k == 2, F.col("event_type")).alias("text"), F.when(k == 0, s).alias("s"), F.when(k == 1, s).alias("start"), F.when(k == 2, F.lit("?")).alias("begin"), F.when(k < 2, e).alias("e"), none.alias("end"))
    return D.flat_words(own, ["event_id"]).select("event_id", "w", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


QUERIES = {f.__name__: f for f in (norm_words, alignable_count, token_stream, sentence_split, sentence_glue, slug, selector_norm, natural_sort, clean_text, cache_name, ascii_snippet, ctc_collapse, page_title, page_paragraphs, toc_order, toc_slice, volume_counts, running_ordinals, prose_quota, line_lint, path_rules, sync_map, flat_words)}

_SPLIT = r"""
marked AS (SELECT *, CASE WHEN starts_with(line, '[') AND ends_with(line, ']') THEN [line] ELSE
    list_filter(list_transform(string_split(regexp_replace(line, '([.!?…])["”’'')\]]*\s+([A-Z"“\[‘])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') END AS ps FROM lines),
pieces AS (SELECT {key}, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM marked),
looked AS (SELECT *, lag(p) OVER (PARTITION BY {key} ORDER BY i) AS before FROM pieces),
glued AS (SELECT *, sum(CASE WHEN coalesce(lower(list_filter(string_split_regex(rtrim(before, '.'), '\s+'), lambda w: w <> '')[-1]) IN ('mr','mrs','ms','dr','st','lt','sgt','capt','vs','etc','no','vol'), false) THEN 0 ELSE 1 END)
    OVER (PARTITION BY {key} ORDER BY i) - 1 AS sent FROM looked),
sents AS (SELECT {key}, sent::BIGINT AS sent, string_agg(p, ' ' ORDER BY i) AS text FROM glued GROUP BY ALL)
"""
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' '), '\\s+', ' ', 'g'))"
_SHOWN = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g')"
_TOC = rf"""
found AS (SELECT page_id, unnest(xs) AS x, unnest(range(len(xs))) AS ord FROM (SELECT page_id, regexp_extract_all({_SHOWN}, '(?is)(<h[1-4][^>]*>.*?</h[1-4]>|<a\s[^>]*>.*?</a>)', 1) AS xs FROM pages)),
nodes AS (SELECT page_id, ord, lower(left(x, 2)) = '<a' AS link, {_PLAIN.format('x')} AS label, nullif(regexp_extract(x, '(?i)href=["'']([^"'']*)', 1), '') AS url FROM found),
vols AS (SELECT *, last_value(CASE WHEN NOT link THEN try_cast(nullif(regexp_extract(label, '(?i)volume\s+(\d+)', 1), '') AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord) AS volume FROM nodes),
slugs AS (SELECT *, lower(regexp_extract(url, '(?i)^/([a-z]+)', 1)) AS slug FROM vols WHERE link),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS r FROM slugs WHERE slug <> ''),
toc AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS idx, volume, slug, url, label FROM firsts WHERE r = 1)
"""
SQL = {
    "norm_words": f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {W.format('text')} AS w FROM documents)",
    "alignable_count": f"SELECT source, sum(len({W.format('text')}))::BIGINT AS n FROM documents GROUP BY 1",
    "token_stream": r"""
WITH t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
n AS (SELECT *, trim(regexp_replace(lower(w), '[^a-z'']', '', 'g'), '''') AS nw FROM t)
SELECT doc_id, pos, w, nw, CASE WHEN nw <> '' THEN (count(*) FILTER (nw <> '') OVER (PARTITION BY doc_id ORDER BY pos)) - 1 END AS apos FROM n""",
    "sentence_split": r"""
WITH ls AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM documents),
lines AS (SELECT doc_id, unnest(xs) AS line, unnest(range(len(xs))) AS para FROM ls),""" + _SPLIT.format(key="doc_id, para") + "SELECT * FROM sents",
    "sentence_glue": r"WITH lines AS (SELECT conv_id, turn, trim(replace(text, '. ', ' Mr. ')) AS line FROM conversations)," + _SPLIT.format(key="conv_id, turn") + "SELECT conv_id, turn, count(*) AS n, max(length(text))::BIGINT AS longest FROM sents GROUP BY ALL",
    "slug": "SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'chapter') AS slug FROM documents",
    "selector_norm": "SELECT p_partkey, trim(translate(lower(trim(' ' || p_name || ' 6.33 ')), ' .', '--'), '-') AS selector FROM part",
    "natural_sort": r"""
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY k COLLATE "C") AS place FROM (
  SELECT c_nationkey, c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment || '-' || (c_custkey % 97) || '-' || c_custkey), '(\d+|\D+)', 1), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM customer)""".replace(' COLLATE "C"', ""),
    "clean_text": r"SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) AS text FROM documents",
    "cache_name": r"""SELECT page_id, right(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 90) || '.html' AS name, list_filter(string_split(url, '/'), lambda p: p <> '')[-1] AS part,
  try_cast(regexp_extract(string_split(url, '/')[-1], '(\d+)', 1) AS BIGINT) AS number FROM pages""",
    "ascii_snippet": r"SELECT doc_id, left(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), 150) AS snippet, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents",
    "ctc_collapse": r"""
WITH i AS (SELECT item_id, list_transform(string_split(text, ''), lambda c: ascii(c) % 29) AS ids FROM benchmark),
k AS (SELECT item_id, list_filter(list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN ids[j] <> 0 AND (j = 1 OR ids[j] <> ids[j - 1]) THEN substr('-|etaonihsrdlumwcfgypbvk''xjqz', (ids[j] + 1)::BIGINT, 1) END), lambda x: x IS NOT NULL) AS cs FROM i)
SELECT item_id, lower(trim(replace(array_to_string(cs, ''), '|', ' '))) AS text FROM k""",
    "page_title": rf"""
WITH s AS (SELECT page_id, url, {_SHOWN} AS h FROM pages),
t AS (SELECT page_id, url, coalesce(nullif(regexp_extract(h, '(?is)<h1[^>]*entry-title[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(h, '(?is)<[a-z0-9]+[^>]*entry-title[^>]*>(.*?)</', 1), ''),
  nullif(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '') AS x FROM s)
SELECT page_id, coalesce(nullif({_PLAIN.format('x')}, ''), list_filter(string_split(url, '/'), lambda p: p <> '')[-1]) AS title FROM t""",
    "page_paragraphs": rf"""
WITH s AS (SELECT page_id, {_SHOWN} AS h FROM pages),
b AS (SELECT page_id, coalesce(nullif(regexp_extract(h, '(?is)<div[^>]*entry-content[^>]*>(.*)</div>', 1), ''), nullif(regexp_extract(h, '(?is)<article[^>]*>(.*)</article>', 1), ''), nullif(regexp_extract(h, '(?is)<main[^>]*>(.*)</main>', 1), '')) AS body FROM s),
p AS (SELECT page_id, list_transform(string_split_regex(body, '(?i)<p(?:\s[^>]*)?>')[2:], lambda y: string_split_regex(y, '(?i)</p>|</article>|</div>|</main>')[1]) AS ps FROM b),
t AS (SELECT page_id, list_filter(list_transform(ps, lambda x: {_PLAIN.format('x')}), lambda x: x <> '' AND NOT (length(x) < 60 AND (starts_with(lower(x), 'previous chapter') OR starts_with(lower(x), 'next chapter') OR starts_with(lower(x), 'author''s note:')))) AS ls FROM p)
SELECT page_id, unnest(range(len(ls))) AS para, unnest(ls) AS line FROM t""",
    "volume_counts": "WITH " + _TOC + "SELECT page_id, volume, count(*) AS n FROM toc GROUP BY ALL",
    "toc_order": "WITH " + _TOC + "SELECT * FROM toc",
    "toc_slice": "WITH " + _TOC + ", e AS (SELECT page_id, min(idx) FILTER (slug = 'the' OR starts_with(slug, 'the-')) AS a, max(idx) FILTER (slug = 'to' OR starts_with(slug, 'to-')) AS b FROM toc GROUP BY 1) SELECT toc.* FROM toc JOIN e USING (page_id) WHERE idx BETWEEN a AND b",
    "running_ordinals": rf"""
WITH c AS (SELECT {A.BOOK} AS book_id, doc_id AS idx, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n_sentences FROM documents)
SELECT book_id, idx, n_sentences, coalesce(sum(n_sentences) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg, n_sentences = 0 AS skipped FROM c""",
    "prose_quota": r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
n AS (SELECT doc_id, CASE WHEN len(ls) = 0 OR len(list_filter(ls, lambda x: starts_with(x, 'http'))) / len(ls) < 0.5 THEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT ELSE 0 END AS n_words FROM l)
SELECT doc_id, n_words, n_words > 500 AS violation FROM n""",
    "line_lint": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
r AS (SELECT * FROM (VALUES ('[A-Z]{4,}!!', 'shouting'), ('(?i)token\s*=', 'secret'), ('\|\s*$', 'open cell')) v(p, why))
SELECT doc_id, line_no, why, trim(x) AS line FROM l, r WHERE regexp_matches(x, p) AND NOT regexp_matches(x, '(#|//)\s*safe-pattern-ok')""",
    "path_rules": r"""
WITH f AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'samples/' WHEN page_id % 7 = 0 THEN 'a/' ELSE '' END || list_filter(string_split(url, '/'), lambda p: p <> '')[-1] || CASE WHEN page_id % 3 = 0 THEN '.WAV' WHEN page_id % 4 = 0 THEN '.chapters.json' ELSE '.html' END AS path FROM pages),
r AS (SELECT * FROM (VALUES ('^Reading/', 'raw audiobook source'), ('^samples/', 'alignment sample (real audio/text)'), ('(?i)\.(wav|m4a|m4b|flac)$', 'uncompressed / full audio'), ('(^|/)book12\.txt$', 'fetched author prose'), ('\.chapters\.json$', 'fetched chapter prose/markers')) v(p, why))
SELECT path, why FROM f, r WHERE regexp_matches(path, p)""",
    "sync_map": r"""
WITH f AS (SELECT conv_id, turn, array_to_string(list_filter([trim(text), trim(role)], lambda x: x <> ''), ' ') AS text, CASE WHEN turn % 5 <> 4 THEN round(turn * 1.25::DOUBLE, 3) END AS "start", round((turn + 1) * 1.25::DOUBLE, 3) AS "end" FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, "start", "end", text FROM f WHERE text <> '' AND "start" IS NOT NULL""",
    "flat_words": "SELECT event_id, event_type AS w, round(value, 3) AS s, round(value + 1, 3) AS e FROM events WHERE event_id % 3 < 2",
}
