"""The registered queries of problems 1 to 10, each over its whole tables, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.consistent import TO_LATIN, consistent_text, found, with_consistent
from quire.llm.distinctive import distinctive_terms
from quire.llm.leaks import leaks
from quire.llm.markup import clean_markup
from quire.llm.mixing import Mix, mix
from quire.llm.neardup import group_pairs, near_duplicates
from quire.llm.packing import pack_items
from quire.llm.scanned import page_repairs, repaired_texts
from quire.llm.splitting import boundary_levels, split_items
from quire.llm.subjects import subjects_of


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, n_links) of every card that has a definition."""
    cards = _read(spark, sf_dir, "concept_cards").where(F.trim("definition") != "")
    text = consistent_text(F.concat_ws("\n", "title", "definition", "quote"))
    return near_duplicates(cards, "card_id", text, 0.5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(p1_groups(spark, sf_dir)).select(F.col("a").alias("card_id_a"), F.col("b").alias("card_id_b"))


def _page_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _read(spark, sf_dir, "books").select("book_id", "title")
    return page_repairs(_read(spark, sf_dir, "md"), "md_id", F.col("content"), F.col("kind") == "pdf", F.col("book_id"), titles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_repairs(spark, sf_dir).select(F.col("id").alias("md_id"), F.col("line").alias("line_no"), "kind").distinct()


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(md_id, text): every scanned page range in continuous, repaired paragraphs."""
    pages = _read(spark, sf_dir, "md").where("kind = 'pdf'")
    return repaired_texts(pages, "md_id", F.col("content"), _page_repairs(spark, sf_dir)).withColumnRenamed("id", "md_id")


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(_read(spark, sf_dir, "md").where("kind = 'epub'"), "md_id", F.col("content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _markup(spark, sf_dir).select(F.col("id").alias("md_id"), F.explode("residue").alias("r"))
    return got.select("md_id", "r.line_no", "r.kind")


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(md_id, text): every converted text without markup residue."""
    return _markup(spark, sf_dir).select(F.col("id").alias("md_id"), "text")


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(_read(spark, sf_dir, "chapters"), "chapter_id", F.coalesce(F.length("content"), F.col("char_count")))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "concept_cards").select("card_id", F.concat_ws("\n", consistent_text("title"), "definition").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = distinctive_terms(_cards(spark, sf_dir), "card_id", F.col("text"), min_tf=3, min_df=2, max_df=8)
    return got.select(F.col("id").alias("card_id"), "term")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, term, tf, df, z): a score for each term of every card, Chinese ones too."""
    return distinctive_terms(_cards(spark, sf_dir), "card_id", F.col("text"), pattern=None).withColumnRenamed("id", "card_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_levels(_read(spark, sf_dir, "chapters"), "chapter_id", "content")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_read(spark, sf_dir, "chapters"), "chapter_id", "title", "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = found(_read(spark, sf_dir, "concept_cards"), "title", "card_id", "title")
    return titles.unionByName(found(_read(spark, sf_dir, "md"), "content", "md_id", "content"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, text, kinds): every title and content in its consistent form."""
    parts = [
        with_consistent(_read(spark, sf_dir, table).select(F.col(row).cast("bigint").alias("row_id"), F.col(field)), field, "text", "kinds").select(F.lit(field).alias("field"), "row_id", "text", "kinds")
        for table, row, field in (("concept_cards", "card_id", "title"), ("md", "md_id", "content"))
    ]
    return parts[0].unionByName(parts[1])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_places(spark, sf_dir).select("doc_id", "item_id")


def p8_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "benchmark"), "item_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix(_read(spark, sf_dir, "documents"), "doc_id", "source", "text", _read(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, tokens_used): the chosen documents and how often they are used."""
    return _mix(spark, sf_dir).documents().withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, tokens, actual_share, max_uses)."""
    return _mix(spark, sf_dir).shares()


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject, sentences, share): what each document is about, and by how many of its sentences."""
    docs, labels, categories = (_read(spark, sf_dir, t) for t in ("documents", "labels", "categories"))
    return subjects_of(docs, "doc_id", F.col("text"), labels, "doc_id", "subject", categories, "category").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_texts, p3_found, p3_texts, p4_batches, p5_found, p5_scores, p6_found, p6_pieces, p7_found, p7_texts, p8_found, p8_places, p9_mix, p9_shares, p10_found, p10_subjects)
}

# ---- SQL of those that SQL can express

_ALIKE = "".join(TO_LATIN)
_KANGXI = "".join(c for c in map(chr, range(0x2E80, 0x2FE0)) if len(unicodedata.normalize("NFKC", c)) == 1 != (unicodedata.normalize("NFKC", c) == c))
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_TABLES = (_ALIKE + _KANGXI + _WIDE, "".join(TO_LATIN.values()) + "".join(unicodedata.normalize("NFKC", c) for c in _KANGXI + _WIDE))


def _plain(c: str) -> str:
    """The consistent form in SQL: equal for equal-looking texts, though not sparing real Cyrillic words."""
    t = f"regexp_replace(replace(replace(replace({c}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    return f"nfc_normalize(translate(regexp_replace({t}, '[\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'), '{_TABLES[0]}', '{_TABLES[1]}'))"


ORACLES: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE t AS (SELECT card_id, regexp_extract_all(regexp_replace(lower({_plain("concat_ws(chr(10), title, definition, quote)")}), '(\\p{{Han}})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM concept_cards WHERE trim(definition) <> ''),
s AS (SELECT DISTINCT card_id, unnest(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS g FROM t),
n AS (SELECT card_id, count(*) AS n FROM s GROUP BY card_id),
o AS (SELECT a.card_id AS x, b.card_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.card_id < b.card_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.card_id = x JOIN n q ON q.card_id = y WHERE c >= 0.5 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT DISTINCT x AS card_id_a, y AS card_id_b FROM r WHERE x < y""",
    "p5_found": f"""WITH c AS (SELECT card_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), {_plain('title')}, definition)), '\\p{{Latin}}{{4,}}')) AS term FROM concept_cards),
n AS (SELECT card_id, term, count(*) AS tf FROM c GROUP BY ALL), d AS (SELECT term FROM n GROUP BY term HAVING count(*) BETWEEN 2 AND 8)
SELECT card_id, term FROM n JOIN d USING (term) WHERE tf >= 3""",
    "p6_found": r"""WITH c AS (SELECT chapter_id, content FROM chapters WHERE length(content) > 40000),
l AS (SELECT chapter_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k, len(string_split(content, chr(10))) AS n FROM c),
m AS (SELECT chapter_id, k, line, length(line) + CASE WHEN k < n THEN 1 ELSE 0 END AS size, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY k) AS part FROM l),
h AS (SELECT chapter_id, max(s) AS most FROM (SELECT chapter_id, sum(size) AS s FROM m GROUP BY chapter_id, part) GROUP BY chapter_id),
p AS (SELECT chapter_id, max(size) AS most FROM m GROUP BY chapter_id),
s AS (SELECT chapter_id, max(x) AS most FROM (SELECT chapter_id, unnest([length(y) + 1 FOR y IN string_split(regexp_replace(line, '[.!?。！？]', '⁂', 'g'), '⁂')]) AS x FROM l) GROUP BY chapter_id)
SELECT chapter_id, CASE WHEN h.most <= 40000 THEN 'heading' WHEN p.most <= 40000 THEN 'paragraph' WHEN s.most <= 40000 THEN 'sentence' ELSE 'none' END AS boundary FROM h JOIN p USING (chapter_id) JOIN s USING (chapter_id)""",
    "p7_found": rf"""WITH t AS (SELECT 'title' AS field, card_id AS row_id, title AS t FROM concept_cards UNION ALL SELECT 'content', md_id, content FROM md),
s AS (SELECT *, regexp_replace(translate(t, '{_WIDE}', '{"".join(unicodedata.normalize("NFKC", c) for c in _WIDE)}'), '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g') AS s FROM t)
SELECT DISTINCT field, row_id, unnest([x FOR x IN [CASE WHEN regexp_matches(t, '[０-９Ａ-Ｚａ-ｚﬀ-ﬆ]') THEN 'form' END, CASE WHEN regexp_matches(t, '\p{{L}}[\x{{300}}-\x{{36f}}]') THEN 'accent' END,
  CASE WHEN regexp_matches(t, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{feff}}]') THEN 'invisible' END, CASE WHEN regexp_matches(t, '[\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]') THEN 'space' END,
  CASE WHEN regexp_matches(t, '[\x{{2e80}}-\x{{2fdf}}]') OR regexp_matches(s, '[A-Za-z\x{{c0}}-\x{{24f}}][\x{{300}}-\x{{36f}}]*[{_ALIKE}]|[{_ALIKE}][\x{{300}}-\x{{36f}}]*[A-Za-z\x{{c0}}-\x{{24f}}]') OR regexp_matches(s, '(^|[^\p{{L}}])[{_ALIKE}]{{2,}}($|[^\p{{L}}])') THEN 'lookalike' END] IF x IS NOT NULL]) AS kind FROM s""",
}
