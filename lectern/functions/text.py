"""Column functions over text: normal forms, keys, counts and set overlap. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the space and its hard, wide and narrow kin
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without spaces of any width at the ends. One argument only, as ``transform`` would give ``F.trim`` the index for what to trim."""
    return F.btrim(text, F.lit(SPACES))


def norm_word(word: Column) -> Column:
    """Lower case, only a-z and apostrophes, none of these at the ends."""
    return F.btrim(F.regexp_replace(F.lower(word), "[^a-z']", ""), F.lit("'"))


def tokens(text: Column) -> Column:
    """The words between white space, as shown."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def words_of(text: Column) -> Column:
    """Normal forms of all words in order, without the empty ones."""
    return F.filter(F.transform(F.split(text, r"\s+"), norm_word), lambda w: w != "")


def normal_lines(lines: Column) -> Column:
    """An array of lines as one text, a line each, of the words of their normal forms with a space between; apostrophes at
    the ends of words are still there. Null without lines."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z'\s]+", ""), r"\s+", " ")
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: plain(x)), "\n"))


def alignable(text: Column) -> Column:
    """How many words have a normal form; 0 for null."""
    return F.coalesce(F.size(words_of(text)).cast("long"), F.lit(0).cast("long"))


def overlap(aligned: Column, heard: Column) -> Column:
    """Share of the distinct aligned words that were heard; 0 without aligned words."""
    n = F.size(F.array_distinct(aligned))
    return F.when(n > 0, F.size(F.array_intersect(aligned, heard)) / n).otherwise(F.lit(0.0))


def clean(text: Column) -> Column:
    """Hard spaces become spaces, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


def dashed(text: Column) -> Column:
    """Runs of other characters than a-z and 0-9 become one dash; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def slug(title: Column, default: str = "chapter") -> Column:
    return F.coalesce(F.nullif(dashed(title), F.lit("")), F.lit(default))


def cache_name(url: Column) -> Column:
    """A stable file name of a URL: the last 90 characters of its dashed form."""
    return F.concat(F.right(dashed(url), F.lit(90)), F.lit(".html"))


def selector(text: Column) -> Column:
    """The normal form of a chapter selector: trimmed, lower case, spaces and dots as dashes."""
    return F.btrim(F.translate(F.lower(F.trim(text)), " .", "--"), F.lit("-"))


def selects(slug_: Column, wanted: Column) -> Column:
    return (slug_ == wanted) | F.startswith(slug_, F.concat(wanted, F.lit("-")))


def first_number(path: Column, leading: bool = False) -> Column:
    """The first digit run of the last path part, null without one; ``leading``: only at its start."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^(\d+)" if leading else r"(\d+)", 1).try_cast("long")


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value: each is padded to twenty places."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def snippet(text: Column, size: int = 150) -> Column:
    return F.left(text, F.lit(size))


def ascii_fold(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def last_part(url: Column) -> Column:
    """The last path part of a URL that is not empty."""
    return F.element_at(F.filter(F.split(url, "/"), lambda p: p != ""), -1)


def prose_words(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)).cast("long"), F.lit(0).cast("long"))


def ctc_collapse(ids: Column, labels: str = "-|etaonihsrdlumwcfgypbvk'xjqz") -> Column:
    """Greedy decoding of best label ids: repeats and blanks (0) go, bars are spaces, trimmed lower case."""
    kept = F.filter(ids, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(ids, i - 1))))
    return F.lower(F.trim(F.replace(F.array_join(F.transform(kept, lambda x: F.substring(F.lit(labels), x + 1, F.lit(1))), ""), F.lit("|"), F.lit(" "))))


def bar(share: Column, width: int = 30) -> Column:
    """A text bar of a share between 0 and 1."""
    n = F.least(F.greatest(F.round(share * width).cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n))
