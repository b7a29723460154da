"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from lectern.llm import htmltext, jaccard, langid, media, nearest, packing, pieces, quality, repeats, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_html_text": htmltext.op3_html_text,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_repeats": repeats.op5_repeats,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_nearest": nearest.op7_nearest,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_media_columns": media.op9_media_columns,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL = {"op4_url_filter": urlfilter.OP4_SQL}
