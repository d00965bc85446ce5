"""Residue found and removed, and what only looks like it left alone."""

from pyspark.sql import functions as F

from quire.llm.markup import clean, clean_markup, residue, trees

MARKED = {
    "html": ["<p>Hi", "a<br/>b", "x&nbsp;y", "one <!-- pb 3 --> two", "<FONT COLOR=gray>x</FONT>"],
    "markdown": ["so *odd* it is", "**a**", "[x](http://a.b/c)", "![x](y.png)", "see [x][r1] there", "x[^3]", "[^3]: note", "[r1]: http://a.b", "~~no~~"],
    "wiki": ["[[a|b]] c", "{{cite|x=1}}", "'''b'''", "== H ==", "{| class=x\n| a\n|}"],
    "latex": ["\\emph{x}", "\\noindent It", "{\\it x y}", "so~\\cite{a1}", "at\\ldots{} noon"],
}
PLAIN = ["If x < y and y > 3", "R&D cost $5 and then $7.", "5 * 4 * 3", "a_b_c.txt", "[sic]", "[圖片]", "[圖片說明: x]", "a == b or a{3}", "C:\\notes\\x", "$$ \\frac{a}{b} $$", "\\[ x \\]", "$x^{2}$ holds",
         "# H", "- item", "> quote", "---", "```\n<b>x</b> **y** [[z]] \\emph{q}\n```", "~~~\n{{x}}\n~~~"]


def test_found():
    for kind, texts in MARKED.items():
        for t in texts:
            for line, got in zip(*(lambda r: (r[0], r[2]))(residue("before\n\n" + t + "\n\nafter"))):
                assert got == ((kind,) if line in t.split("\n") and line else ()), (t, line, got)


def test_left_alone():
    for t in PLAIN:
        assert not any(residue("before\n\n" + t + "\n\nafter")[2]), t
        assert clean(t)[0] == t


def test_structure_survives():
    got, _ = clean("== Rome ==\n\n\\section{Old}\n\n<li>One\n\n'''Rome''' is [[old|very old]]&nbsp;and $x^2$ \\emph{big}.\n\n```\n**code**\n```\n\n<h2>T</h2>\n\n![A map](m.png)")
    assert got == "## Rome\n\n## Old\n\n- One\n\nRome is very old and $x^2$ big.\n\n```\n**code**\n```\n\n## T\n\n[圖片說明: A map]"


def test_trees_fit_their_table():
    assert set(trees()) == {"html", "markdown", "wiki", "latex"}


def test_nulls_empties_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<b>a</b> " * 20_000, "x"), (4, "<!-- a\nb --> c", "x")], "id long, t string, residue string")
    got = {r.id: (r.text, [(x.line_no, x.kind) for x in r.residue]) for r in clean_markup(df, "id", F.col("t")).collect()}
    assert got[1] == (None, []) and got[2] == ("", []) and got[3][1] == [(1, "html")] and "<" not in got[3][0]
    assert got[4] == (" c".strip(), [(1, "html"), (2, "html")]) or got[4][1] == [(1, "html"), (2, "html")]
