"""The registered queries of the engine's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog, layout, lines, lint, matching, notes, slicing
from quire.operators.rows import descending, first_of
from quire.sources import files
from quire.streaming import log as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _newest_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last conversion of each (book_id, doc_no)."""
    md = _read(spark, sf_dir, "md")
    return first_of(md, ["book_id", "doc_no"], [descending(F.unix_micros(F.col("converted_at").cast("timestamp"))), F.col("md_id")])


_NEWEST_MD = "(SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY book_id, doc_no ORDER BY converted_at DESC NULLS LAST, md_id) = 1)"


def _newest_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _read(spark, sf_dir, "chapters")
    return first_of(ch, ["book_id", "chapter_num"], [descending(F.unix_micros(F.col("sliced_at").cast("timestamp"))), F.col("chapter_id")])


_NEWEST_CHAPTERS = "(SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, chapter_num ORDER BY sliced_at DESC NULLS LAST, chapter_id) = 1)"


def _translation() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, by the rule itself."""
    ranges = ((0x2E80, 0x2FDF), (0x3000, 0x33FF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
    pairs = [(c, n) for a, b in ranges for c in map(chr, range(a, b + 1)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs).replace("'", "''")


def _nfkc_sql(c: str) -> str:
    a, b = _translation()
    return f"nfc_normalize(replace(replace(replace(translate({c}, '{a}', '{b}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'))"


# ---- text functions


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text || chr(7) || chr(13) || ' x' || chr(13) || chr(10) || chr(142), chr(13) || chr(10), '⁂'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), chr(13), '', 'g'), '⁂', chr(13) || chr(10)) AS text FROM documents""")
def strip_control_chars(spark, sf_dir):
    """Every document, with control characters put in, without them."""
    t = F.concat("text", F.lit("\u0007\r x\r\n\u008e"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.drop_controls(t).alias("text"))


@query("""SELECT book_id, '# 書名：' || coalesce(title, '') || chr(10) || chr(10) || '# 作者：' || coalesce(author, '') || chr(10) || chr(10) || '# 轉換日期：2024-01-01' || chr(10) || chr(10) || '# 轉換器：1.0' || chr(10) || chr(10) || '---' || chr(10) AS head,
  trim(regexp_replace(coalesce(title, ''), '[\\\\/*?:"<>|]', '', 'g')) || '_' || trim(regexp_replace(coalesce(author, ''), '[\\\\/*?:"<>|]', '', 'g')) || '.md' AS file FROM books""".replace("\\\\\\\\", "\\\\"))
def front_matter_head(spark, sf_dir):
    """The head block and the file name of every book."""
    e = lambda c: F.coalesce(c, F.lit(""))
    b = _read(spark, sf_dir, "books")
    head = T.head_block(e("title"), e("author"), F.lit("2024-01-01"), F.lit("1.0"))
    return b.select("book_id", head.alias("head"), F.concat(T.file_name(e("title")), F.lit("_"), T.file_name(e("author")), F.lit(".md")).alias("file"))


@query(f"SELECT card_id, regexp_replace({_nfkc_sql('title')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS title_key, regexp_replace({_nfkc_sql('title')}, '[^\\p{{L}}]', '', 'g') AS letters FROM concept_cards")
def title_keys(spark, sf_dir):
    """The two comparison keys of every card title."""
    t = _read(spark, sf_dir, "concept_cards").select("card_id", T.nfkc(F.col("title")).alias("t"))
    return t.select("card_id", T.letters_and_digits(F.col("t")).alias("title_key"), T.letters_only(F.col("t")).alias("letters"))


@query(r"""WITH t AS (SELECT chapter_id, unnest(string_split(content, chr(10))) AS line FROM chapters)
SELECT chapter_id, count(*) AS lines, CAST(sum(CASE WHEN k = '' OR contains('。！？!?.…」』）)"''”’：:；;》〉】]', right(k, 1)) THEN 1 ELSE 0 END) AS BIGINT) AS ended
FROM (SELECT chapter_id, regexp_replace(trim(line), '[\p{Nd}①-⑳\[\]\s]+$', '') AS k FROM t) GROUP BY chapter_id""")
def sentence_end_lines(spark, sf_dir):
    """Lines of every chapter, and how many of them end a sentence."""
    t = lines.lines_of(_read(spark, sf_dir, "chapters"), ["chapter_id"], "content")
    return t.groupBy("chapter_id").agg(F.count("*").alias("lines"), F.count_if(T.ends_sentence(F.col("line"))).alias("ended"))


@query(r"""SELECT doc_id, coalesce(list_reduce(list_prepend('', [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> '']), lambda a, b: CASE
  WHEN a = '' THEN b WHEN ends_with(a, '-') AND regexp_matches(left(b, 1), '\p{Ll}') THEN left(a, length(a) - 1) || b
  WHEN regexp_matches(right(a, 1), '[　-鿿＀-￯]') OR regexp_matches(left(b, 1), '[　-鿿＀-￯]') THEN a || b ELSE a || ' ' || b END), '') AS text FROM documents""")
def join_wrapped_lines(spark, sf_dir):
    """Every document as one line."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.join_wrapped(F.split("text", "\n")).alias("text"))


@query(r"""SELECT card_id, '> ' || coalesce(list_reduce(list_prepend('', [x FOR x IN [trim(y) FOR y IN string_split(replace(quote, '. ', '.' || chr(10)), chr(10))] IF x <> '']), lambda a, b: CASE
  WHEN a = '' OR (regexp_matches(right(a, 1), '[⺀-〿぀-ヿ㐀-䶿一-鿿豈-﫿︰-﹏＀-￯]') AND regexp_matches(left(b, 1), '[⺀-〿぀-ヿ㐀-䶿一-鿿豈-﫿︰-﹏＀-￯]')) THEN a || b ELSE a || ' ' || b END), '') AS block
FROM concept_cards WHERE quote IS NOT NULL""")
def quote_block(spark, sf_dir):
    """Every quotation, broken after its sentences, as one line."""
    c = _read(spark, sf_dir, "concept_cards").where("quote is not null")
    return c.select("card_id", T.quote_line(F.replace(F.col("quote"), F.lit(". "), F.lit(".\n"))).alias("block"))


_CLEAN = r"trim(regexp_replace({first}, '[（(][^）)]*[）)]', '', 'g'))"
_AUTHOR = _CLEAN.format(first=r"string_split(regexp_replace(regexp_replace(trim(coalesce(author, '')), '^[（(【\[][^）)】\]]{1,3}[）)】\]]', ''), '[、,，/;；]', '、', 'g'), '、')[1]")
_SERIES = _CLEAN.format(first=r"regexp_replace(trim(coalesce(series, '')), '^[（(【\[][^）)】\]]{1,3}[）)】\]]', '')")
_KEY = r"regexp_replace(regexp_replace({c}, '[‧・·•．.･：:]', '．', 'g'), '[\s　]+', '', 'g')"


@query(f"SELECT book_id, {_AUTHOR} AS author, {_KEY.format(c=_AUTHOR)} AS author_key, {_SERIES} AS series, {_KEY.format(c=_SERIES)} AS series_key FROM books")
def normalize_names(spark, sf_dir):
    """Clean names and comparison keys of authors and series."""
    a, s = F.col("author"), F.col("series")
    return _read(spark, sf_dir, "books").select("book_id", T.clean_name(a, True).alias("author"), T.name_key(a, True).alias("author_key"), T.clean_name(s, False).alias("series"), T.name_key(s, False).alias("series_key"))


@query(r"""SELECT md_id, length(t) AS chars, CASE WHEN length(t) = 0 THEN 0.0 ELSE round(length(regexp_replace(t, '[^\x{0}-\x{24f}\x{2000}-\x{2bff}\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]', '', 'g')) / length(t), 6) END AS share
FROM (SELECT md_id, regexp_replace(content, '[\s　]', '', 'g') AS t FROM md WHERE kind = 'pdf' AND content IS NOT NULL)""")
def text_layer_probe(spark, sf_dir):
    """The share of usable characters of every page range."""
    m = _read(spark, sf_dir, "md").where("kind = 'pdf' and content is not null")
    c = F.col("content")
    return m.select("md_id", F.length(F.regexp_replace(c, r"[\s　]", "")).alias("chars"), F.round(T.expected_share(c), 6).alias("share"))


# ---- lines, sections and metrics


@query(f"""SELECT md_id, line_no, line, start FROM (
  SELECT md_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY md_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT md_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM md WHERE content IS NOT NULL))""")
def line_table(spark, sf_dir):
    """Every line of every converted text with its offset."""
    return lines.with_offsets(lines.lines_of(_read(spark, sf_dir, "md"), ["md_id"], "content"), ["md_id"])


@query(r"""SELECT md_id, line_no, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+)', 1)) AS title FROM (
  SELECT md_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM md WHERE content IS NOT NULL)
WHERE regexp_matches(line, '^#{1,6}\s+\S')""")
def md_headings(spark, sf_dir):
    """Every Markdown heading."""
    return lines.headings(lines.lines_of(_read(spark, sf_dir, "md"), ["md_id"], "content")).select("md_id", "line_no", "level", "title")


@query(r"""SELECT md_id, section_no, section FROM (
  SELECT md_id, section_no, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS section FROM (
    SELECT md_id, unnest(string_split(regexp_replace(content, '\n---+\n', '⁂', 'g'), '⁂')) AS s, generate_subscripts(string_split(regexp_replace(content, '\n---+\n', '⁂', 'g'), '⁂'), 1) AS section_no FROM md WHERE content IS NOT NULL))
WHERE section <> '' AND NOT regexp_matches(section, '^#\s*(書名|作者|轉換日期|轉換器)[：:]') AND regexp_replace(regexp_replace(section, '\[圖片[^\]]*\]', '', 'g'), '\s+', '', 'g') <> ''""")
def md_sections(spark, sf_dir):
    """The sections of every converted text."""
    return lines.sections(_read(spark, sf_dir, "md"), "md_id", "content")


_BODY = r"CASE WHEN regexp_matches(content, '\n---+\n') THEN regexp_replace(content, '(?s)^.*?\n---+\n', '') ELSE content END"


@query(rf"""SELECT substr(sha256(CAST(md_id AS VARCHAR)), 1, 12) AS key, substr(sha256(regexp_replace(content, '(?m)^# (轉換日期|轉換器)：.*\n(\n)?', '', 'g')), 1, 16) AS sha,
  length(content) AS chars, length(regexp_replace(body, '[^\p{{L}}\p{{N}}]', '', 'g')) AS body_chars, len(regexp_extract_all(body, '(?m)^---+$')) + 1 AS sections,
  len(regexp_extract_all(body, '(?m)^#{{1,6}} ')) AS headings, len(regexp_extract_all(body, '(?m)^[ \t]*[0-9]{{1,4}}[ \t]*$')) AS number_lines
FROM (SELECT *, {_BODY} AS body FROM md WHERE content IS NOT NULL)""")
def md_metrics(spark, sf_dir):
    """The numbers of every converted text that guard a conversion."""
    return lines.metrics(_read(spark, sf_dir, "md"), F.col("md_id"), "content")


@query(rf"""WITH m AS (SELECT CAST(md_id AS VARCHAR) AS key, {_BODY} AS body, md_id, content FROM md WHERE content IS NOT NULL),
b AS (SELECT key, length(content) AS chars, length(regexp_replace(body, '[^\p{{L}}\p{{N}}]', '', 'g')) AS body_chars FROM m WHERE md_id % 50 <> 1),
r AS (SELECT key, length(c) AS chars, length(regexp_replace(body2, '[^\p{{L}}\p{{N}}]', '', 'g')) AS body_chars FROM (SELECT key, md_id, replace(content, 'Later on', 'Later') AS c, replace(body, 'Later on', 'Later') AS body2 FROM m) WHERE md_id % 50 <> 2)
SELECT key, 'body_chars' AS metric, CAST(b.body_chars AS VARCHAR) AS "old", CAST(r.body_chars AS VARCHAR) AS "new", TRUE AS broken FROM b JOIN r USING (key) WHERE r.body_chars < b.body_chars
UNION ALL SELECT key, 'chars', CAST(b.chars AS VARCHAR), CAST(r.chars AS VARCHAR), FALSE FROM b JOIN r USING (key) WHERE r.chars <> b.chars
UNION ALL SELECT key, '(book)', 'present', 'missing', FALSE FROM b ANTI JOIN r USING (key)
UNION ALL SELECT key, '(book)', 'missing', 'new', FALSE FROM r ANTI JOIN b USING (key)""")
def baseline_guards(spark, sf_dir):
    """What differs, and what breaks a guard, between the texts and a run that lost words and texts."""
    m = _read(spark, sf_dir, "md").where("content is not null").select("md_id", F.col("md_id").cast("string").alias("key"), "content", F.replace(F.col("content"), F.lit("Later on"), F.lit("Later")).alias("changed"))
    n = lambda c: (F.length(c).alias("chars"), F.length(F.regexp_replace(lines.body(F.col(c)), r"[^\p{L}\p{N}]", "")).alias("body_chars"))
    return lines.compare_runs(m.where("md_id % 50 <> 1").select("key", *n("content")), m.where("md_id % 50 <> 2").select("key", *n("changed")))


# ---- slicing and notes


@query(r"""WITH RECURSIVE l AS (SELECT chapter_id, line_no, length(line) AS n, (k = '' OR contains('。！？!?.…」』）)"''”’：:；;》〉】]', right(k, 1))) AS e FROM (
    SELECT *, regexp_replace(trim(line), '[\p{Nd}①-⑳\[\]\s]+$', '') AS k FROM (SELECT chapter_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM chapters WHERE content IS NOT NULL))),
t AS (SELECT chapter_id, CAST(sum(n) + count(*) - 1 AS BIGINT) AS total, sum(n + 1) AS x FROM l GROUP BY chapter_id),
f AS (SELECT l.chapter_id, line_no, n, e, total / greatest(ceil(total / 4000), 1) AS share FROM l JOIN t USING (chapter_id)),
w AS (SELECT chapter_id, line_no, n, e, share, CAST(n AS BIGINT) AS size, 1 AS piece FROM f WHERE line_no = 1
  UNION ALL SELECT f.chapter_id, f.line_no, f.n, f.e, f.share,
    CASE WHEN w.size + 1 + f.n > 4000 OR (w.size >= w.share AND w.e) THEN f.n ELSE w.size + 1 + f.n END,
    CASE WHEN w.size + 1 + f.n > 4000 OR (w.size >= w.share AND w.e) THEN w.piece + 1 ELSE w.piece END
  FROM w JOIN f ON f.chapter_id = w.chapter_id AND f.line_no = w.line_no + 1)
SELECT chapter_id, CAST(piece AS BIGINT) AS piece_no, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(n) + count(*) - 1 AS BIGINT) AS chars FROM w GROUP BY chapter_id, piece""")
def paragraph_split(spark, sf_dir):
    """Every chapter cut between lines into even pieces of at most 4,000 characters."""
    return slicing.paragraph_cuts(lines.lines_of(_read(spark, sf_dir, "chapters"), ["chapter_id"], "content"), ["chapter_id"], 4000)


def _book_sections(spark, sf_dir) -> DataFrame:
    md = _newest_md(spark, sf_dir)
    return lines.sections(md, "md_id", "content").join(md.select("md_id", "book_id", "doc_no"), "md_id")


@query()
def chapters_md(spark, sf_dir):
    """The chapters of every book, from its last converted texts."""
    return slicing.slice_markdown(_book_sections(spark, sf_dir), "book_id", ["doc_no", "section_no"], "section")


@query(rf"""SELECT book_id, sum(length(section)) + count(*) - 1 AS source_chars, TRUE AS whole FROM (
  SELECT book_id, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS section FROM (
    SELECT book_id, unnest(string_split(regexp_replace(content, '\n---+\n', '⁂', 'g'), '⁂')) AS s FROM {_NEWEST_MD} WHERE content IS NOT NULL))
WHERE section <> '' AND NOT regexp_matches(section, '^#\s*(書名|作者|轉換日期|轉換器)[：:]') AND regexp_replace(regexp_replace(section, '\[圖片[^\]]*\]', '', 'g'), '\s+', '', 'g') <> '' GROUP BY book_id""".replace("sum(length(section)) + count(*) - 1", "CAST(sum(length(section)) + count(*) - 1 AS BIGINT)"))
def lossless_selfcheck(spark, sf_dir):
    """Every book's characters, counted on its chapters, and whether they join to the source."""
    c = slicing.slice_markdown(_book_sections(spark, sf_dir), "book_id", ["doc_no", "section_no"], "section")
    return c.groupBy(F.col("book").alias("book_id")).agg((F.sum("char_count") + F.count("*") - 1).alias("source_chars"), F.every("whole").alias("whole"))


@query(f"""WITH RECURSIVE c AS (SELECT book_id, chapter_id, coalesce(length(content), CAST(char_count AS BIGINT), 0) AS size, row_number() OVER (PARTITION BY book_id ORDER BY chapter_num, chapter_id) AS k FROM {_NEWEST_CHAPTERS}),
w AS (SELECT book_id, chapter_id, size, k, size AS total, 1 AS batch FROM c WHERE k = 1
  UNION ALL SELECT c.book_id, c.chapter_id, c.size, c.k, CASE WHEN w.total + c.size > 150000 THEN c.size ELSE w.total + c.size END, CASE WHEN w.total + c.size > 150000 THEN w.batch + 1 ELSE w.batch END
  FROM w JOIN c ON c.book_id IS NOT DISTINCT FROM w.book_id AND c.k = w.k + 1)
SELECT book_id, chapter_id, CAST(size AS BIGINT) AS size, CAST(batch AS BIGINT) AS batch FROM w""")
def note_batches(spark, sf_dir):
    """The note batch of every chapter; chapters keep their order."""
    size = F.coalesce(F.length("content").cast("bigint"), F.col("char_count").cast("bigint"))
    return notes.note_batches(_newest_chapters(spark, sf_dir), "book_id", ["chapter_num", "chapter_id"], size).select("book_id", "chapter_id", "size", "batch")


@query("SELECT title, card_id, definition FROM concept_cards QUALIFY row_number() OVER (PARTITION BY title ORDER BY date_added NULLS FIRST, card_id) = 1")
def merge_batches(spark, sf_dir):
    """Cards of all batches: the first of each title."""
    c = _read(spark, sf_dir, "concept_cards").select("title", "card_id", "definition", "date_added")
    return notes.merge_cards(c, "title", [F.col("date_added"), F.col("card_id")]).select("title", "card_id", "definition")


@query("""WITH b AS (SELECT card_id, title AS card, unnest(sources) AS book, definition FROM concept_cards WHERE definition IS NOT NULL),
o AS (SELECT card, book, min(card_id) AS ord FROM b WHERE card_id % 3 <> 0 GROUP BY card, book),
n AS (SELECT card, book, min(definition) AS text FROM b WHERE card_id % 3 = 0 GROUP BY card, book),
k AS (SELECT o.card, o.book, o.ord, b.definition AS text FROM o JOIN b ON b.card_id = o.ord AND b.card = o.card AND b.book = o.book QUALIFY row_number() OVER (PARTITION BY o.card, o.book ORDER BY b.definition) = 1),
m AS (SELECT card, max(ord) AS last FROM k GROUP BY card)
SELECT card, 'definition' AS section, book, CAST(ord AS BIGINT) AS ord, coalesce(n.text, k.text) AS text FROM k LEFT JOIN n USING (card, book)
UNION ALL SELECT card, 'definition', book, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY card ORDER BY book) AS BIGINT), text FROM (SELECT n.* FROM n ANTI JOIN k USING (card, book)) LEFT JOIN m USING (card)""")
def shared_card_upsert(spark, sf_dir):
    """The definition blocks of shared cards after a third of the cards came in anew."""
    b = _read(spark, sf_dir, "concept_cards").where("definition is not null").select("card_id", F.col("title").alias("card"), F.lit("definition").alias("section"), F.explode("sources").alias("book"), F.col("definition").alias("text"), F.col("card_id").cast("int").alias("ord"))
    return notes.upsert_blocks(b.where("card_id % 3 <> 0"), b.where("card_id % 3 = 0"))


@query(rf"""SELECT chapter_id, r >= 0.5 AND coalesce(title, '') <> '' AND (regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z ]', '', 'g'), ' +', ' ', 'g')), '^selected ', '') IN ({", ".join(f"'{w}'" for w in slicing.BACK_ENGLISH)})
  OR regexp_full_match(regexp_replace(coalesce(title, ''), '[\s　∣|｜【】\[\]（）()]', '', 'g'), '{slicing._back.pattern}')) AS back
FROM (SELECT chapter_id, CASE WHEN chapter_id % 3 = 0 THEN 'Selected ' || ['Notes', 'Index', 'References'][1 + chapter_id % 2] WHEN chapter_id % 7 = 0 THEN '附錄2：參考書目與注釋' ELSE title END AS title, (chapter_id % 10) / 10.0 AS r FROM chapters)""")
def back_matter_titles(spark, sf_dir):
    """Which chapters are back matter, some of them given such titles and all a place in their book."""
    k = F.col("chapter_id")
    title = F.when(k % 3 == 0, F.concat(F.lit("Selected "), F.element_at(F.array(*map(F.lit, ("Notes", "Index", "References"))), (k % 2 + 1).cast("int")))).when(k % 7 == 0, "附錄2：參考書目與注釋").otherwise(F.col("title"))
    return _read(spark, sf_dir, "chapters").select("chapter_id", slicing.back_matter(title, (k % 10) / 10.0).alias("back"))


@query(r"""WITH l AS (SELECT md_id AS doc, line, line_no FROM (SELECT md_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM md WHERE kind = 'pdf' AND content IS NOT NULL)),
p AS (SELECT doc, (line_no - 1) // 30 + 1 AS page, line_no AS para, line AS text, (line_no - 1) % 30 * 10.0 AS y0, (line_no - 1) % 30 * 10.0 + 10 AS y1 FROM l WHERE trim(line) <> ''),
r AS (SELECT doc, list_sort(list(y0 / 300.0)) AS t, list_sort(list(y1 / 300.0)) AS b FROM p WHERE length(text) > 30 GROUP BY doc),
e AS (SELECT doc, CASE WHEN len(t) >= 20 THEN t[len(t) // 50 + 1] ELSE 0.08 END AS top, CASE WHEN len(t) >= 20 THEN b[len(b) - len(b) // 50] ELSE 0.92 END AS bottom FROM r),
c AS (SELECT p.doc, page, para, regexp_replace(text, '[^\p{L}]', '', 'g') AS k FROM p LEFT JOIN e USING (doc) WHERE length(trim(text)) <= 60 AND (y1 <= 300 * coalesce(top, 0.08) + 5 OR y0 >= 300 * coalesce(bottom, 0.92) - 5 OR y0 < 300 * 0.08 OR y0 > 300 * 0.92)),
g AS (SELECT doc, page, para, unnest(list_distinct(CASE WHEN length(k) >= 4 THEN [substr(k, i, 4) FOR i IN range(1, length(k) - 2)] WHEN k <> '' THEN [k] ELSE [] END)) AS g FROM c),
o AS (SELECT doc, g FROM g GROUP BY doc, g HAVING count(DISTINCT page) >= 3),
n AS (SELECT c.doc, c.page, c.para, count(g.g) AS n, count(o.g) AS hits FROM c LEFT JOIN g ON g.doc = c.doc AND g.page = c.page AND g.para = c.para LEFT JOIN o ON o.doc = g.doc AND o.g = g.g GROUP BY ALL)
SELECT doc, CAST(page AS BIGINT) AS page, para FROM n WHERE n = 0 OR hits >= 0.6 * n""")
def page_furniture(spark, sf_dir):
    """Running heads and page numbers of every page range, its lines set on pages of thirty."""
    l = lines.lines_of(_read(spark, sf_dir, "md").where("kind = 'pdf' and content is not null"), ["md_id"], "content").where("trim(line) <> ''")
    at = (F.col("line_no") - 1) % 30 * 10.0
    p = l.select(F.col("md_id").alias("doc"), (F.floor((F.col("line_no") - 1) / 30) + 1).cast("int").alias("page"), F.col("line_no").alias("para"), at.alias("y0"), (at + 10).alias("y1"), F.lit(10.0).alias("size"), F.col("line").alias("text"), F.lit(300.0).alias("height"), F.lit(False).alias("edge"))
    return layout.furniture(p)


@query()
def html_to_markdown(spark, sf_dir):
    """Every EPUB-like text, as if it were HTML, as Markdown."""
    from quire.sources.books import documents_to_markdown

    m = _read(spark, sf_dir, "md").where("kind = 'epub'").select(F.col("md_id").cast("string").alias("path"), F.col("doc_no"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("int").alias("depth"), F.col("content").alias("html"), F.lit(None).cast("array<struct<fragment:string,title:string,depth:int>>").alias("toc"), F.lit(None).cast("string").alias("error"))
    return documents_to_markdown(m)


# ---- catalogue


@query("SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM books GROUP BY 1")
def catalog_status_counts(spark, sf_dir):
    return catalog.status_counts(_read(spark, sf_dir, "books"))


@query(f"""SELECT book_id, title, substr(coalesce(text, ''), 1, 3000) AS excerpt FROM books LEFT JOIN (SELECT book_id, min_by(content, doc_no) AS text FROM {_NEWEST_MD} WHERE content IS NOT NULL GROUP BY book_id) USING (book_id)
WHERE status = 'converted' AND coalesce(md_path, '') <> ''""")
def classify_candidates(spark, sf_dir):
    """Converted books with what a classifier is shown of each, those classified before among them."""
    texts = first_of(_newest_md(spark, sf_dir).where("content is not null").select("book_id", "doc_no", "content"), ["book_id"], [F.col("doc_no")]).select("book_id", F.col("content").alias("text"))
    return catalog.to_classify(_read(spark, sf_dir, "books"), texts, ["book_id"], force=True)


@query("""SELECT doc_id, coalesce(category, '尚未歸檔') AS category, folder FROM (SELECT doc_id, subject, CASE WHEN (doc_id % 10) / 10.0 < 0.7 THEN 'Inbox' ELSE coalesce(category, '尚未歸檔') END AS folder, category FROM labels LEFT JOIN categories ON category = subject)""")
def category_fallback(spark, sf_dir):
    """The category of every label, with its fallback, and the folder by its confidence."""
    cats, labels = _read(spark, sf_dir, "categories"), _read(spark, sf_dir, "labels")
    got = catalog.with_valid_category(labels, "subject", cats, "category")
    return got.select("doc_id", "category", catalog.folder_for((F.col("doc_id") % 10) / 10.0, F.col("category"), F.lit("")).alias("folder"))


@query("SELECT book_id, CASE WHEN c.category IS NOT NULL THEN c.category END AS category FROM (SELECT book_id, string_split(coalesce(nullif(epub_path, ''), nullif(pdf_path, '')), '/')[1] AS p FROM books) LEFT JOIN categories c ON c.category = p")
def category_from_path(spark, sf_dir):
    """The category that every book's path names."""
    names = _read(spark, sf_dir, "categories").agg(F.collect_set("category").alias("names"))  # a fixed table of a few rows
    path = F.coalesce(F.nullif(F.col("epub_path"), F.lit("")), F.nullif(F.col("pdf_path"), F.lit("")))
    return _read(spark, sf_dir, "books").join(names).select("book_id", F.try_element_at(F.filter(F.split(path, "/"), lambda x: F.array_contains("names", x)), F.lit(1)).alias("category"))


@query(f"""WITH b AS (SELECT book_id, {_KEY.format(c=_AUTHOR)} AS ak, {_AUTHOR} AS an, {_KEY.format(c=_SERIES)} AS sk, {_SERIES} AS sn FROM books),
a AS (SELECT ak, count(*) AS n FROM b WHERE ak <> '' GROUP BY ak), s AS (SELECT sk, count(*) AS n FROM b WHERE sk <> '' GROUP BY sk)
SELECT book_id, coalesce(s.n, 0) >= 5 OR coalesce(a.n, 0) >= 5 AS needs_subfolder, CASE WHEN coalesce(s.n, 0) >= 5 THEN sn WHEN coalesce(a.n, 0) >= 5 THEN an ELSE '' END AS subfolder
FROM b LEFT JOIN a USING (ak) LEFT JOIN s USING (sk)""")
def subfolder_threshold(spark, sf_dir):
    """Whether every book belongs in a folder of its series or author, and in which."""
    return catalog.subfolders(_read(spark, sf_dir, "books"))


@query(f"""WITH b AS (SELECT book_id, {_KEY.format(c=_SERIES)} AS key, split_part(coalesce(nullif(epub_path, ''), nullif(pdf_path, '')), '/', 1) AS folder FROM books),
n AS (SELECT key, folder, count(*) AS n, min(book_id) AS first FROM b WHERE key <> '' AND coalesce(folder, '') <> '' GROUP BY key, folder)
SELECT key, folder FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1""")
def existing_subfolder(spark, sf_dir):
    """The folder that holds most of a series' books, under a common root."""
    root = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("library/"), c))
    return catalog.usual_folder(_read(spark, sf_dir, "books").withColumn("epub_path", root("epub_path")).withColumn("pdf_path", root("pdf_path")), "series")


@query(r"""WITH p AS (SELECT epub_path AS path FROM books WHERE epub_path <> '' UNION ALL SELECT pdf_path FROM books WHERE pdf_path <> ''),
f AS (SELECT replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), ' ', '_') AS book_id, max(CASE WHEN lower(path) LIKE '%.epub' THEN path END) AS e, max(CASE WHEN lower(path) LIKE '%.pdf' THEN path END) AS p FROM p WHERE lower(path) LIKE '%.epub' OR lower(path) LIKE '%.pdf' GROUP BY 1),
t AS (SELECT replace(regexp_replace(regexp_extract(md_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), ' ', '_') AS book_id, max(md_path) AS m FROM books WHERE md_path <> '' GROUP BY 1),
b AS (SELECT * FROM books WHERE status <> 'converted')
SELECT book_id, coalesce(f.e, nullif(b.epub_path, '')) AS epub_path, coalesce(f.p, nullif(b.pdf_path, '')) AS pdf_path, coalesce(t.m, nullif(b.md_path, '')) AS md_path,
  CASE WHEN coalesce(b.status, 'raw') = 'raw' AND coalesce(t.m, nullif(b.md_path, '')) IS NOT NULL THEN 'converted' ELSE coalesce(b.status, 'raw') END AS status
FROM b FULL JOIN f USING (book_id) LEFT JOIN t USING (book_id)""")
def catalog_scan_upsert(spark, sf_dir):
    """The manifest without its converted books, after a scan that finds every file."""
    b = _read(spark, sf_dir, "books")
    paths = b.select(F.col("epub_path").alias("path")).unionByName(b.select(F.col("pdf_path").alias("path"))).where("path <> ''")
    return catalog.scan_upsert(paths, b.where("status <> 'converted'"), b.where("md_path <> ''").select(F.col("md_path").alias("path")))


@query(r"""SELECT book_id, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS file FROM (SELECT book_id, name, row_number() OVER (PARTITION BY name ORDER BY book_id) AS k FROM (SELECT book_id, trim(regexp_replace(coalesce(title, ''), '[\\/*?:"<>|]', '', 'g')) AS name FROM books))""")
def notebook_stage(spark, sf_dir):
    """A file name for every book, numbered where titles are equal."""
    return catalog.numbered_names(_read(spark, sf_dir, "books"), T.file_name(F.coalesce("title", F.lit(""))), [F.col("book_id")], "file").select("book_id", "file")


_LOG = "(SELECT * FROM activity QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY ingested_at) = 1)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delivered_once(_read(spark, sf_dir, "activity"))


@query("SELECT book_id FROM books WHERE status IN ('raw', 'converted')")
def books_to_process(spark, sf_dir):
    return catalog.to_process(_read(spark, sf_dir, "books")).select("book_id")


@query("SELECT book_id FROM books WHERE status = 'raw' OR coalesce(epub_path, '') <> '' OR coalesce(pdf_path, '') <> ''")
def convert_targets(spark, sf_dir):
    """What a forced conversion takes."""
    return catalog.to_convert(_read(spark, sf_dir, "books"), force=True).select("book_id")


@query("""WITH b AS (SELECT book_id, CASE WHEN coalesce(series, '') <> '' THEN 'law/' || series ELSE 'law' END AS folder, unnest([{'field': 'epub_path', 'source': epub_path}, {'field': 'pdf_path', 'source': pdf_path}, {'field': 'md_path', 'source': md_path}]) AS m FROM books),
t AS (SELECT book_id, m.field AS field, m.source AS source, folder || '/' || regexp_extract(m.source, '([^/]*)$', 1) AS target FROM b WHERE m.source <> '')
SELECT * FROM t WHERE source <> target AND source IN (SELECT epub_path FROM books)""")
def reclassify_moves(spark, sf_dir):
    """The moves if every book went to one category and only EPUB files existed."""
    b = _read(spark, sf_dir, "books")
    return files.move_plan(b, F.lit("law"), F.col("series"), b.select("epub_path").where("epub_path is not null"))


@query(f"SELECT log_id, ts, action, book_id FROM {_LOG} ORDER BY ts DESC, log_id DESC LIMIT 50")
def activity_tail(spark, sf_dir):
    """The last fifty entries of the log."""
    return catalog.log_tail(_log(spark, sf_dir), 50).select("log_id", "ts", "action", "book_id")


@query(f"SELECT book_id, count(*) AS entries, string_agg(lower(action), ',' ORDER BY ts, log_id) AS actions FROM {_LOG} WHERE book_id IS NOT NULL GROUP BY book_id")
def activity_history(spark, sf_dir):
    """The log of every book as one row."""
    return catalog.history(_log(spark, sf_dir))


@query(f"""SELECT book_id, arg_max(status, (ts, log_id)) AS status, max(ts) AS ts FROM (SELECT book_id, ts, log_id, CASE lower(action) WHEN 'scan' THEN 'raw' WHEN 'convert' THEN 'converted' WHEN 'classify' THEN 'classified' WHEN 'create_card' THEN 'card_only' WHEN 'apply_notes' THEN 'notes_generated' WHEN 'done' THEN 'done' END AS status FROM {_LOG}) WHERE status IS NOT NULL AND book_id IS NOT NULL GROUP BY book_id""")
def status_state_machine(spark, sf_dir):
    """The state that every book's log leaves it in."""
    return catalog.states(_log(spark, sf_dir))


@query(f"""SELECT log_id, coalesce(try_cast(CASE WHEN json_valid(details) THEN json_extract_string(details, '$.chapters') END AS BIGINT), -1) AS chapters, CASE WHEN json_valid(details) THEN json_extract_string(details, '$.category') END AS category FROM {_LOG}""")
def activity_details(spark, sf_dir):
    """Fields of every entry's JSON; cut-off JSON has none."""
    log = _log(spark, sf_dir)
    whole = F.when(F.try_parse_json("details").isNotNull(), F.col("details"))
    return catalog.details(log.withColumn("details", whole), {"chapters": "bigint", "category": "string"}).select("log_id", F.coalesce("chapters", F.lit(-1)).alias("chapters"), "category")


@query(f"SELECT date_trunc('day', ts) AS start, lower(action) AS action, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def log_windows(spark, sf_dir):
    """Entries by day and action; the same plan runs on a stream."""
    w = stream.windows(_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n")


@query(f"""SELECT book_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY book_id ORDER BY ts, log_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY book_id ORDER BY ts, log_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM {_LOG} WHERE book_id IS NOT NULL)) GROUP BY book_id, s""")
def log_sessions(spark, sf_dir):
    """Runs of work on every book, parted by six quiet hours."""
    s = stream.sessions(_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.select("book_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# ---- matching


def _keys(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '(?m)^[\s　]*>\s?', '', 'g'), '（\[\[.*?\]\]）', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _grams(k: str) -> str:
    return f"CASE WHEN length({k}) >= 2 THEN [substr({k}, i, 2) FOR i IN range(1, length({k}))] WHEN length({k}) = 1 THEN [{k}] ELSE [] END"


@query(f"""WITH c AS (SELECT card_id, {_keys("concat_ws(' ', definition, quote)")} AS k FROM concept_cards), g AS (SELECT DISTINCT card_id, unnest({_grams('k')}) AS gram FROM c)
SELECT gram, count(*) AS df, round(ln(((SELECT count(*) FROM concept_cards) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM g GROUP BY gram""")
def bigram_idf(spark, sf_dir):
    """The weight of every character bigram of the cards."""
    c = _read(spark, sf_dir, "concept_cards")
    tf = matching.card_grams(c, "card_id", F.concat_ws(" ", "definition", "quote"))
    n = c.agg(F.count("*").alias("n"))
    return tf.groupBy("gram").agg(F.count("*").alias("df")).join(n).select("gram", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


_BOOK = "(SELECT s FROM (SELECT unnest(sources) AS s FROM concept_cards) GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"


@query(f"""WITH book AS {_BOOK}, c AS (SELECT card_id, coalesce(list_contains(sources, (SELECT s FROM book)), FALSE) AS own, {_keys("coalesce(" + _nfkc_sql('title') + ", '')")} AS t, {_keys("concat_ws(' ', " + _nfkc_sql('title') + ", definition, quote)")} AS k FROM concept_cards),
g AS (SELECT card_id, own, gram, count(*) AS tf FROM (SELECT card_id, own, unnest({_grams('k')}) AS gram FROM c) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM c WHERE NOT own),
d AS (SELECT gram, ln(((SELECT n FROM n) + 1) / (count(*) + 1)) + 1 AS idf FROM g WHERE NOT own GROUP BY gram),
u AS (SELECT ln(count(*) + 1) + 1 AS unseen FROM d),
w AS (SELECT card_id, own, gram, tf * coalesce(idf, (SELECT unseen FROM u)) AS w FROM g LEFT JOIN d USING (gram)),
m AS (SELECT card_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY card_id),
dot AS (SELECT a.card_id AS query, b.card_id AS candidate, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) WHERE a.own AND NOT b.own GROUP BY ALL),
tg AS (SELECT card_id, own, gram, coalesce(idf, 1.0) AS idf FROM (SELECT DISTINCT card_id, own, unnest({_grams('t')}) AS gram FROM c) LEFT JOIN d USING (gram)),
tm AS (SELECT card_id, sum(idf) AS mass FROM tg GROUP BY card_id),
sh AS (SELECT a.card_id AS query, b.card_id AS candidate, sum(a.idf) AS shared FROM tg a JOIN tg b USING (gram) WHERE a.own AND NOT b.own GROUP BY ALL),
p AS (SELECT query, candidate, qa.t AS a, ca.t AS b, coalesce(dot / (qm.norm * cm.norm), 0) AS cosine, 2 * coalesce(shared, 0) / (qt.mass + ct.mass) AS dice
  FROM dot FULL JOIN sh USING (query, candidate) JOIN c qa ON qa.card_id = query JOIN c ca ON ca.card_id = candidate LEFT JOIN m qm ON qm.card_id = query LEFT JOIN m cm ON cm.card_id = candidate LEFT JOIN tm qt ON qt.card_id = query LEFT JOIN tm ct ON ct.card_id = candidate),
s AS (SELECT query, candidate, cosine, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN least(length(a), length(b)) >= 2 AND CASE WHEN length(a) <= length(b) THEN contains(b, a) ELSE contains(a, b) END THEN 0.5 + 0.5 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE dice END AS tp FROM p),
r AS (SELECT *, 0.5 * tp + 0.5 * least(1.0, 4.0 * cosine) AS score FROM s)
SELECT query, candidate, round(score, 6) AS score, round(tp, 6) AS title_part, round(cosine, 6) AS cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 3) DESC, candidate) AS place FROM r WHERE score >= 0.3) WHERE place <= 5""")
def concept_match_topn(spark, sf_dir):
    """For every card of the book with most cards, the five cards of other books most like it."""
    c = _read(spark, sf_dir, "concept_cards").withColumn("title", T.nfkc(F.col("title")))
    book = c.select(F.explode("sources").alias("s")).groupBy("s").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "s").first()
    got = matching.match_cards(c, book.s if book else "")
    return got.select("query", "candidate", *[F.round(x, 6).alias(x) for x in ("score", "title_part", "cosine")], "place")


@query()
def stale_review(spark, sf_dir):
    """For every card added without a date, taken as no longer produced, the dated cards of its book most like it."""
    c = _read(spark, sf_dir, "concept_cards").select("card_id", "title", F.try_element_at("sources", F.lit(1)).alias("book_id"), "definition", "quote", "date_added").where("book_id is not null")
    return matching.stale_review(c.where("date_added is null"), c.where("date_added is not null"), "card_id", "title")


@query("SELECT a.title FROM (SELECT DISTINCT title FROM concept_cards WHERE date_added IS NULL) a ANTI JOIN (SELECT title FROM concept_cards WHERE date_added IS NOT NULL) b USING (title)")
def stale_anti(spark, sf_dir):
    """Titles of undated cards that no dated card bears."""
    c = _read(spark, sf_dir, "concept_cards")
    return c.where("date_added is null").select("title").distinct().join(c.where("date_added is not null").select("title"), "title", "left_anti")


# ---- lint


def _linked(c: DataFrame) -> DataFrame:
    """Cards as notes: their definition and links to related cards, one of them empty."""
    links = F.array_join(F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda r: F.concat(F.lit("[["), r, F.lit("|see]]"))), "\n")
    return c.select("file", F.concat(F.coalesce("definition", F.lit("")), F.lit("\n[[ ]]\n"), links).alias("text"))


_NOTES = "(SELECT file, coalesce(definition, '') || chr(10) || '[[ ]]' || chr(10) || coalesce(array_to_string([ '[[' || r || '|see]]' FOR r IN related], chr(10)), '') AS text FROM concept_cards)"


@query(rf"""WITH l AS (SELECT file, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {_NOTES}),
t AS (SELECT file, line, trim(string_split(x, '|')[1]) AS target FROM (SELECT file, line, unnest(regexp_extract_all(s, '\[\[([^\[\]]*)\]\]', 1)) AS x FROM l))
SELECT file, line, 'empty_wikilink' AS type, '[[]]' AS detail FROM t WHERE target = ''
UNION ALL SELECT file, line, 'broken_link', target FROM t ANTI JOIN (SELECT title AS target FROM concept_cards) USING (target) WHERE target <> ''""")
def wikilink_lint(spark, sf_dir):
    """Empty and broken links of every card."""
    c = _read(spark, sf_dir, "concept_cards")
    n = _linked(c)
    return lint.all_issues(lint.empty_links(n, "file", "text"), lint.broken_links(n, "file", "text", c.select("title")))


@query(r"""SELECT CAST(chapter_id AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line, 'possible_truncation' AS type, CAST(length(content) AS VARCHAR) AS detail FROM (
  SELECT *, regexp_replace(coalesce(regexp_extract_all(content, '(?m)^> (.+)$', 1)[-1], content), '\s+$', '') AS tail FROM chapters) WHERE length(content) >= 7500 AND tail <> '' AND NOT contains('。」』”".!?！？）)…、', right(tail, 1))""")
def truncation_lint(spark, sf_dir):
    """Long chapters that end inside a sentence."""
    return lint.truncated(_read(spark, sf_dir, "chapters").withColumn("chapter_id", F.col("chapter_id").cast("string")), "chapter_id", "content")


@query("""SELECT CAST(md_id AS VARCHAR) AS file, length(substr(t, 1, strpos(t, chr(65533)))) - length(replace(substr(t, 1, strpos(t, chr(65533))), chr(10), '')) + 1 AS line, 'encoding_corruption' AS type, 'U+FFFD' AS detail
FROM (SELECT md_id, replace(content, 'é', chr(65533)) AS t FROM md) WHERE strpos(t, chr(65533)) > 0""")
def encoding_lint(spark, sf_dir):
    """Converted texts with a damaged character, where one was put for each é."""
    m = _read(spark, sf_dir, "md").select(F.col("md_id").cast("string").alias("file"), F.replace(F.col("content"), F.lit("é"), F.lit("�")).alias("text"))
    return lint.damaged(m, "file", "text")


@query("""SELECT file, CAST(NULL AS BIGINT) AS line, type, detail FROM (SELECT file, trim(title) AS detail, CASE WHEN trim(coalesce(quote, '')) = '' THEN 'missing_quote' WHEN trim(quote) = trim(title) THEN 'quote_equals_title' END AS type FROM concept_cards) WHERE type IS NOT NULL""")
def quote_title_lint(spark, sf_dir):
    """Cards without a quotation of their own."""
    return lint.doubtful_quotes(_read(spark, sf_dir, "concept_cards"), "file", F.col("title"), F.col("quote"))
