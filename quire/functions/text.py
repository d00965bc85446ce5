"""Functions on text columns.

All are native expressions, so they stay inside whole-stage code generation, except ``nfkc`` (Spark
has no such function) and ``gestalt_ratio``, which are Arrow-batched. A null input gives null unless
stated.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters after which a sentence has ended, and marks of notes that may follow.
SENTENCE_ENDS = "。！？!?.…」』）)\"'”’：:；;》〉】]"
NOTE_MARKS = r"[\p{Nd}①-⑳\[\]\p{javaWhitespace}]+$"
#: What counts as a full-width neighbour when wrapped lines are joined, in pages and in quotations.
WIDE_PAGE = "[　-鿿＀-￯]"
WIDE_QUOTE = "[⺀-〿぀-ヿ㐀-䶿一-鿿豈-﫿︰-﹏＀-￯]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility-composed form of a text."""
    return _nfkc(c)


def drop_controls(c: Column) -> Column:
    """Without control characters; tab, line feed and the carriage return of a CRLF stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\r(?!\n)", "")


def head_block(title: Column, author: Column, date: Column, converter: Column) -> Column:
    """The block every converted text begins with."""
    return F.concat(F.lit("# 書名："), title, F.lit("\n\n# 作者："), author, F.lit("\n\n# 轉換日期："), date, F.lit("\n\n# 轉換器："), converter, F.lit("\n\n---\n"))


def file_name(c: Column) -> Column:
    """A text usable as a file name: without the characters file systems refuse, trimmed."""
    return F.trim(F.regexp_replace(c, r'[\\/*?:"<>|]', ""))


def letters_and_digits(c: Column) -> Column:
    """The key for comparing titles: letters and numbers only. Compose the text first (``nfkc``)."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def letters_only(c: Column) -> Column:
    """The key for comparing page furniture: letters only."""
    return F.regexp_replace(c, r"[^\p{L}]", "")


def match_key(c: Column) -> Column:
    """The key for comparing cards: lower case, without quotation marks of lines and source tags,
    letters and numbers only. Compose the text first (``nfkc``); composing turns a tag's full-width
    parentheses into plain ones, and such a tag stays part of the key."""
    t = F.regexp_replace(F.lower(c), r"(?m)^[\s　]*>\s?", "")
    return letters_and_digits(F.regexp_replace(t, r"（\[\[.*?\]\]）", ""))


def grams(key: Column, n: int) -> Column:
    """All n-grams of a key in order; a shorter key is its own only gram, an empty one has none."""
    chars = F.split(key, "")
    each = chars
    for j in range(1, n):  # arrays side by side: a substring for each place would walk the text each time
        each = F.zip_with(each, F.slice(chars, j + 1, F.greatest(F.length(key), F.lit(1))), lambda x, y: F.concat(x, y))
    each = F.slice(each, 1, F.greatest(F.length(key) - (n - 1), F.lit(1)))
    return F.when(F.length(key) >= n, each).when(F.length(key) > 0, F.array(key)).otherwise(F.array().cast("array<string>"))


def ends_sentence(c: Column) -> Column:
    """Whether a line ends a sentence, marks of notes aside; an empty line does."""
    t = F.regexp_replace(F.trim(c), NOTE_MARKS, "")
    return (t == "") | F.lit(SENTENCE_ENDS).contains(F.right(t, F.lit(1)))


def titles_match(block: Column, title: Column, block_key: Column, title_key: Column) -> Column:
    """Whether a block of text is a title: the same key, the title's first half or more, or the title
    behind a short prefix in a block that is no sentence."""
    b, t = F.length(block_key), F.length(title_key)
    part = title_key.startswith(block_key) & (b * 2 >= t)
    tail = block_key.endswith(title_key) & (b - t <= F.greatest(F.lit(4), F.floor(t / 2))) & ~F.rtrim(block).endswith("。")
    return F.when((b == 0) | (t == 0), False).otherwise((block_key == title_key) | part | tail)


def join_wrapped(lines: Column) -> Column:
    """One text from wrapped lines: a hyphen before a small letter goes, full-width neighbours join
    without a space, others with one; empty lines are skipped."""
    def add(done: Column, line: Column) -> Column:
        t = F.trim(line)
        wide = F.right(done, F.lit(1)).rlike(WIDE_PAGE) | F.left(t, F.lit(1)).rlike(WIDE_PAGE)
        hyphen = done.endswith("-") & F.left(t, F.lit(1)).rlike(r"\p{Ll}")
        return (
            F.when(t == "", done)
            .when(done == "", t)
            .when(hyphen, F.concat(F.left(done, F.length(done) - 1), t))
            .when(wide, F.concat(done, t))
            .otherwise(F.concat_ws(" ", done, t))
        )

    return F.aggregate(lines, F.lit(""), add)


def quote_line(c: Column) -> Column:
    """A quotation as one ``> `` line; hard breaks join directly between full-width neighbours."""
    def add(done: Column, line: Column) -> Column:
        t = F.trim(line)
        wide = F.right(done, F.lit(1)).rlike(WIDE_QUOTE) & F.left(t, F.lit(1)).rlike(WIDE_QUOTE)
        return F.when(t == "", done).when((done == "") | wide, F.concat(done, t)).otherwise(F.concat_ws(" ", done, t))

    return F.concat(F.lit("> "), F.aggregate(F.split(c, "\n"), F.lit(""), add))


def squeeze_lines(c: Column) -> Column:
    """At most one empty line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_name(c: Column, first_only: bool) -> Column:
    """A person's or series' name without the mark of nationality and names in parentheses;
    ``first_only`` keeps the first of several. Null gives an empty name."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[（(【\[][^）)】\]]{1,3}[）)】\]]", "")
    if first_only:
        t = F.element_at(F.split(t, r"[、,，/;；]"), 1)
    return F.trim(F.regexp_replace(t, r"[（(][^）)]*[）)]", ""))


def name_key(c: Column, first_only: bool) -> Column:
    """The key for comparing names: one kind of dot, no spaces."""
    return F.regexp_replace(F.regexp_replace(clean_name(c, first_only), r"[‧・·•．.･：:]", "．"), r"[\s　]+", "")


def short_key(c: Column) -> Column:
    """An anonymous key of twelve hexadecimal digits."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 12)


def stem(path: Column) -> Column:
    """The file name of a path without folders and the last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def book_key(path: Column) -> Column:
    """A book's id from its path: the stem, spaces as underscores."""
    return F.replace(stem(path), F.lit(" "), F.lit("_"))


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of an offset (from 0)."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def plain_text(html: Column) -> Column:
    """The text of an HTML fragment: tags gone, the five basic entities resolved, spaces squeezed."""
    t = F.regexp_replace(html, r"<[^>]+>", "")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"[\s 　]+", " "))


def expected_share(c: Column) -> Column:
    """The share of a page's characters that Chinese and English books are made of; 0 for an empty page."""
    t = F.regexp_replace(c, r"[\s　]", "")
    good = F.regexp_replace(t, "[^\u0000-ɏ -⯿⺀-鿿豈-﫿︰-﹏＀-￯]", "")
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(good) / F.length(t))


def megabytes(n: Column) -> Column:
    return F.format_string("%.2f", n / 1048576)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def gestalt_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters of two texts, by longest common blocks."""
    return _ratio(a, b)
