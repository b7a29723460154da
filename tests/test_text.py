from __future__ import annotations

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import governance, packaging, sentences
from lectern.plans import catalogue
from lectern.sources import documents as D


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, T.norm_word(F.col("w")), w="'Don't!'") == "don't"
    assert one(spark, T.words_of(F.col("t")), t=" It's -- a  Test. ") == ["it's", "a", "test"]
    assert one(spark, T.slug(F.col("t")), t="!!") == "chapter"
    assert one(spark, T.selector(F.col("t")), t=" 6.33 E ") == "6-33-e"
    assert [one(spark, T.selects(F.col("s"), F.lit("6-33")), s=s) for s in ("6-33-e", "6-330", "6-33")] == [True, False, True]
    assert one(spark, T.first_number(F.col("p")), p="a9/track07_b3.mp3") == 7
    assert one(spark, T.first_number(F.col("p"), True), p="a9/track07") is None
    assert sorted(["a10", "a9"], key=lambda s: one(spark, T.natural_key(F.col("t")), t=s)) == ["a9", "a10"]
    assert one(spark, T.ctc_collapse(F.col("i")), i=[0, 3, 3, 0, 3, 1, 4, 4, 0]) == "tt a"
    assert one(spark, T.bar(F.col("x"), 4), x=0.5) == "##--"
    assert one(spark, T.ascii_fold(F.col("t")), t="a–b") == "a?b"


def test_overlap(spark):
    rows = [(["a", "b", "c", "d"], ["a", "b", "z"]), ([], ["a"]), (["a", "b", "c"], ["a", "c"])]
    df = spark.createDataFrame(rows, "a array<string>, h array<string>")
    assert [round(r.x, 6) for r in df.select(T.overlap(F.col("a"), F.col("h")).alias("x")).collect()] == [0.5, 0.0, 0.666667]


def split(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, line string")
    return [r.text for r in sentences.sentences(df, ["k"]).orderBy("sent").collect()]


def test_sentences(spark):
    assert split(spark, 'He said "Hi." Then left. Ok? no') == ['He said "Hi.', "Then left.", "Ok? no"]
    assert split(spark, "Mr. Smith came. He sat.") == ["Mr. Smith came.", "He sat."]
    assert split(spark, "[Skill. Gained!]") == ["[Skill. Gained!]"]
    assert split(spark, "  ") == []
    assert split(spark, "... . A. B") == ["... .", "A.", "B"]


def test_tokens_keep_empty_forms(spark):
    df = spark.createDataFrame([(1, "a -- b")], "k int, text string")
    assert [(r.pos, r.nw, r.apos) for r in sentences.token_stream(df, ["k"]).orderBy("pos").collect()] == [(0, "a", 0), (1, "", None), (2, "b", 1)]


def test_sync_segments(spark):
    rows = [(0, ["One."], None, "0.000", "2.0"), (1, [" "], "", "2.0", "2.5"), (2, None, "Two.", "2.5", "4.0"), (3, ["x"], None, None, "5"), (4, ["Three."], None, "4.0", "6.5")]
    own = D.sync_segments(spark.createDataFrame([(1, *r) for r in rows], "k int, pos int, lines array<string>, text string, begin string, end string"), ["k"]).orderBy("id").collect()
    assert [(r.id, r.text) for r in own] == [(0, "One."), (1, "Two."), (2, "Three.")]
    assert (own[0].start, own[-1].end) == (0.0, 6.5)


def test_merges(spark):
    df = spark.createDataFrame([(1, 6, "0-1,3-4"), (2, 6, "3-1"), (3, 6, "1-2,2-3"), (4, 6, "x"), (5, 6, "4-6")], "k int, n long, spec string")
    own = packaging.parse_merges(df, ["k"]).orderBy("k", "lo").collect()
    assert [(r.k, r.error) for r in own] == [(1, None), (1, None), (2, "descending"), (3, None), (3, "overlap"), (4, "form"), (5, "range")]
    items = spark.createDataFrame([(1, i) for i in range(6)], "k int, idx long")
    groups = packaging.merged_groups(items, packaging.parse_merges(df.where("k = 1"), ["k"]), ["k"]).orderBy("idx").collect()
    assert [r.group for r in groups] == [0, 0, 2, 3, 3, 5]


def test_quota_and_links(spark):
    df = spark.createDataFrame([(1, "w " * 501), (2, "http://a\nhttp://b\n" + "w " * 600), (3, None), (4, "")], "k int, text string")
    assert [(r.k, r.violation) for r in governance.prose_quota(df, "k").orderBy("k").collect()] == [(1, True), (2, False), (3, False), (4, False)]
    lines = spark.createDataFrame([("# c",), ("",), (" http://x ",)], "value string")
    assert [r.url for r in D.link_list(lines).collect()] == ["http://x"]


@pytest.mark.parametrize("name", ["openings", "sentence_file", "prose_quota", "sentence_split"])
def test_lines_keep_their_digits(spark, tmp_path, name):
    """Lines that begin or end with the digits of their own place, and spaces of all widths around them."""
    lines = [f"{i}0{i} \u00a0\u3000{i}. Aa{i}! {i}1 Bb. Cc {i}{i} " + "\u2003 " * (i % 3) for i in range(30)]
    texts = ["\n".join([*lines, " \u00a0", "", *lines[:7]]), "1\n1\n12 http\n3", "http 1\nhttp 1"]
    pq.write_table(pa.table({"doc_id": range(3), "text": texts, "source": ["s"] * 3, "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet")
    oracle.same_rows(spark, str(tmp_path), catalogue.queries()[name], catalogue.oracle_sql()[name])
