"""Markup residue in text (problem 3).

Method: a document is cut into flat blocks, its lines. Each has the number of words, the density of
links and counts of signs that look like markup, with the words and link densities of its
neighbours, and whether a construct that began earlier is still open. A decision tree for each
markup language, fitted on the small labelled table below, decides which blocks hold residue; those
are rewritten, and all other lines stay as they are.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

_fence = re.compile(r"^\s{0,3}(?:>\s?)*(`{3,}|~{3,})")
_math = [re.compile(p, re.S) for p in (r"\$\$.+?\$\$", r"\\\[.+?\\\]", r"\\\(.+?\\\)", r"\\begin\{(equation|align|gather|multline|math|displaymath|eqnarray)(\*?)\}.+?\\end\{\1\2\}")]
_inline_math = re.compile(r"(?<![\\$\w])\$(?![\s$])[^$\n]+?(?<![\s\\])\$(?![\d$])")
_inline_code = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_attr = r"""(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>=`]+))?)*"""
_tag = re.compile(rf"</?[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?{_attr}\s*/?>|<[!?][A-Za-z][^<>]*>")
_tag_open = re.compile(r"<([A-Za-z][A-Za-z0-9]*)(?=\s|$)[^<>]*$")
_comment = re.compile(r"<!--.*?-->", re.S)
_entity = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_strong = re.compile(r"(?<![\\*])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*\\])\1(?!\*)|(?<![\\_])(_{2,3})(?![\s_])([^_\n]+?)(?<![\s_\\])\3(?!_)|(?<![\\\w])_(?![\s_])([^_\n]+?)(?<![\s_\\])_(?!\w)")
_strike = re.compile(r"~~(?![\s~])(.+?)(?<![\s~])~~")
_image = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+[\"'][^\"'\n]*[\"'])?\)")
_link = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+[\"'][^\"'\n]*[\"'])?\)")
_reference = re.compile(r"(?<![\[\w\]])\[([^\[\]\n^]+)\]\[([^\[\]\n]*)\](?!\])|(?<=[^\W\d_])(?<![A-Za-z])\[([^\[\]\n^]+)\]\[([^\[\]\n]*)\](?!\])")
_footnote = re.compile(r"\[\^[^\[\]\s]+\]")
_definition = re.compile(r"^\s{0,3}\[[^\[\]\n]+\]:\s+\S")
_wiki_link = re.compile(r"\[\[([^\[\]\n|]*)((?:\|[^\[\]\n|]*)*)\]\]")
_template = re.compile(r"\{\{[^{}]*\}\}")
_quotes = re.compile(r"('{2,5})(?!['\s])(.+?)(?<!['\s])\1(?!')")
_wiki_heading = re.compile(r"^\s*(={1,6})\s*([^=\s](?:.*?[^=\s])?)\s*\1\s*$")
_table_open, _table_close = re.compile(r"^\s*\{\|"), re.compile(r"^\s*\|\}")
_command = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*((?:\{[^{}\n]*\})*)")
_path = re.compile(r"\b[A-Za-z]:\\|\\\\[A-Za-z]|[A-Za-z0-9_.-]\\[A-Za-z]+\\")
_environment = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}")
_words = re.compile(r"[㐀-鿿]|[^\W_]+")

FEATURES = (
    "words", "words_before", "words_after", "link_density", "link_density_before", "link_density_after",
    "tags", "tag_part", "comments", "entities",
    "emphasis", "strike", "links", "images", "references", "footnotes", "definition",
    "wiki_links", "templates", "quotes", "wiki_heading", "wiki_table",
    "commands_with_braces", "commands_free", "paths", "environments",
    "less_or_greater", "stars", "underscores", "brackets", "equals", "backslashes", "ampersands",
)


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans replaced by blanks; line feeds stay."""
    out = list(text)
    for a, b in spans:
        out[a:b] = [c if c == "\n" else " " for c in out[a:b]]
    return "".join(out)


def code_lines(lines: list[str]) -> list[bool]:
    """Which lines are code: fences, what they enclose, and indented blocks after an empty line.

    A fence that is never closed encloses the rest.
    """
    out, fence, before = [], "", True
    for s in lines:
        m = _fence.match(s)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not s.strip().strip(fence[0]).lstrip("> "):
                fence = ""
        elif m:
            fence = m[1]
            out.append(True)
        else:
            out.append(bool(s.strip()) and s.startswith(("    ", "\t")) and (before or bool(out and out[-1])) and not re.match(r"\s+(?:[-*+]|\d+\.)\s", s))
        before = not s.strip() if not fence else False
    return out


def features(text: str) -> tuple[list[str], list[bool], np.ndarray]:
    """(lines, whether code, one row of ``FEATURES`` for each line)."""
    lines = text.split("\n")
    code = code_lines(lines)
    plain = "\n".join(" " * len(s) if c else s for s, c in zip(lines, code))
    for p in _math:
        plain = _blank(plain, [m.span() for m in p.finditer(plain)])
    plain = _blank(plain, [m.span() for p in (_inline_math, _inline_code) for m in p.finditer(plain)])
    long_comments = [m.span() for m in _comment.finditer(plain)]
    long_templates = [m.span() for m in _template.finditer(plain)]
    starts = np.cumsum([0] + [len(s) + 1 for s in lines])
    # lines that a construct of several lines runs through
    many = {k: np.zeros(len(lines)) for k in ("comments", "templates")}
    for k, spans in (("comments", long_comments), ("templates", long_templates)):
        for a, b in spans:
            lo, hi = np.searchsorted(starts, [a, b - 1], side="right") - 1
            many[k][lo : hi + 1] += 1
    x = np.zeros((len(lines), len(FEATURES)))
    table, open_tag = 0, False
    for i, s in enumerate(plain.split("\n")):
        words = len(_words.findall(lines[i]))
        tags, part = len(_tag.findall(s)), 0.0
        if open_tag:
            part, open_tag = 1.0, ">" not in s
        if not open_tag and (m := _tag_open.search(s)):
            rest = plain[starts[i] + m.start() :]
            if _tag.match(rest):
                part, open_tag = 1.0, True
        if _table_open.match(s):
            table += 1
        in_table = table > 0
        if table and _table_close.match(s):
            table -= 1
        linked = [*_link.finditer(s), *_image.finditer(s), *_reference.finditer(s), *_wiki_link.finditer(s)]
        spans = [(m.start(), m.end()) for p in (_link, _image, _reference, _footnote) for m in p.finditer(s)]
        bare = _blank(s, spans)
        cmds = list(_command.finditer(s))
        paths = len(_path.findall(s))
        free = sum(1 for m in cmds if not m[2] and not re.search(r"[A-Za-z0-9_.:\\]$", s[: m.start()]))
        row = {
            "words": words, "link_density": sum(len(m[0]) for m in linked) / max(1, len(s.strip())),
            "tags": tags, "tag_part": part, "comments": many["comments"][i], "entities": len(_entity.findall(s)),
            "emphasis": len(_strong.findall(bare)), "strike": len(_strike.findall(s)), "links": len(_link.findall(s)), "images": len(_image.findall(s)),
            "references": len(_reference.findall(s)), "footnotes": len(_footnote.findall(s)), "definition": bool(_definition.match(s)),
            "wiki_links": len(_wiki_link.findall(s)), "templates": many["templates"][i], "quotes": len(_quotes.findall(s)), "wiki_heading": bool(_wiki_heading.match(s)), "wiki_table": in_table,
            "commands_with_braces": sum(bool(m[2]) for m in cmds), "commands_free": free, "paths": paths, "environments": len(_environment.findall(s)),
            "less_or_greater": s.count("<") + s.count(">"), "stars": s.count("*"), "underscores": s.count("_"), "brackets": s.count("["), "equals": s.count("="), "backslashes": s.count("\\"), "ampersands": s.count("&"),
        }
        x[i] = [float(row.get(f, 0)) for f in FEATURES]
    for f in ("words", "link_density"):
        k = FEATURES.index(f)
        x[1:, FEATURES.index(f + "_before")] = x[:-1, k]
        x[:-1, FEATURES.index(f + "_after")] = x[1:, k]
    return lines, code, x


# The labelled table: documents whose lines are labelled with the kinds of residue they hold
# (h html, m markdown, w wiki, l latex, - none), written for this purpose.
LABELLED = r"""
h|<p>The harbour was closed for a week.</p>
h|<p class="lead">Nobody came.
-|Nobody came back to the house that winter.
h|A <b>bold</b> claim was made.
h|A line<br/>broken in two
h|Tom&nbsp;&amp;&nbsp;Jerry met at noon.
h|It&#8217;s late; the caf&#xe9; is shut.
h|Before<!-- page 3 --> the war
h|<hr>
h|</div></body>
h|<a href="x.html#n1"><sup>1</sup></a> See the note.
h|<img src="a.png" alt="A map"/>
h|<FONT COLOR=red>Old style</FONT> pages
h|<table
h|  border="1">
h|<tr><td>One</td><td>2</td></tr>
h|</table>
-|If x < y and y > 10 then stop.
-|The length is < 40 metres.
-|R&D spent $5 and then $20; AT&T did not.
-|Fish & chips cost 3 > 2 pounds.
-|# A heading
-|
-|- an item of a list
-|1. a numbered item
-|> a quotation
-|---
-|[圖片]
-|[圖片說明: a map of the town]
m|This is *very* odd.
m|**Note** that it rains.
m|It is ***quite*** wet.
m|The __old__ mill
m|An _old_ mill stood here.
m|We ~~never~~ seldom go.
m|See [the page](https://a.example/b) for more.
m|The [mill](b.md "A mill") stood.
m|Here ![a map](m.png) is the town.
m|Two [links](http://a.example) and [more](http://b.example/x_(y)).
m|As [one][a] and [two][b] say.
m|It rained.[^n2] Then it snowed.[^n3]
m|[^n2]: See above.
m|[a]: http://a.example "A"
m|~~Gone~~
m|> a quotation with *stress*
m|![A plate](images/p1.png)
m|As [Smith says][ref1] here.
m|[ref1]: https://a.example/c
m|It was so.[^1]
m|[^1]: Smith, page 4.
m|- an item with **stress** in it
-|A box of 2 * 3 * 4 inches
-|The file a_b_c_2.txt is missing.
-|He wrote 'teh' [sic] twice.
-|See note [3] and [4, 5].
-|snake_case and other_names_here
-|A footnote* with a star.
-|The array a[1][2] holds it.
w|See [[Rome]] and [[Paris|the city]].
w|[[Category:Towns]]
w|[[File:a.jpg|thumb|A town]]
w|{{Infobox book|name=X}}
w|It rained{{cite web|url=x}} all day.
w|'''Rome''' is old.
w|It is ''very'' old.
w|== History ==
w|=== Early years ===
w|{| class=wikitable
w|! Name
w||-
w|| Rome || 5
w||}
-|Whether a == b or a{3} does not matter.
-|The dog's owners' house isn't the Jones' one.
-|Set {1, 2} and {3}.
-|x = 3; y == 4
l|\section{Rome}
l|\emph{Rome} is old.
l|\noindent It rained.
l|\begin{itemize}
l|\item Bread
l|\end{itemize}
l|It was said~\cite{smith1990}.
l|and so on\ldots{} until noon
l|the {\it old} mill\footnote{Now gone}
l|\chapter{One}\label{ch:1}
l|\noindent \noindent Twice over.
l|as in \textbf{bold}, then
-|The file C:\notes\old is lost.
-|Open D:\temp\new now (see \\server\share\x).
-|a\b is no command here
-|$$ \frac{a}{b} = 1 $$
-|\[ E = mc^2 \]
-|where $x^{2} \leq y$ holds
-|`\emph{x}` and `<b>` and `**x**` are code
-|```tex
-|\emph{x} <b>x</b> [[x]] **x** {{x}}
-|```
-|~~~
-|for i in a[[0]]: print(**k)
-|~~~
-|五 * 四 * 三等於六十
hm|<b>**Both**</b> kinds
lm|**Both** \emph{kinds}
wh|[[Both]]&nbsp;kinds
-|一個 telescope 的長度 < 439 公尺。
h|他們<u>從此</u>離開
m|他們**從此**離開
w|他們[[從此]]離開
l|他們\textbf{從此}離開
m|他們[從此][ref2]離開
"""

#: The most rows a labelled table may have: the trees are fitted on the driver.
MOST_LABELLED = 10_000


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1):
    """A CART tree as nested tuples (feature, threshold, low, high), or a bool at a leaf."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(y.mean() > 0.5)
    best = (1e-12, None, None)
    now = _gini(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            gain = now - (low.mean() * _gini(y[low]) + (~low).mean() * _gini(y[~low]))
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    if best[1] is None:
        return bool(y.mean() > 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    side = x[:, f] <= cut
    out = np.zeros(len(x), bool)
    out[side], out[~side] = predict(low, x[side]), predict(high, x[~side])
    return out


#: What a tree of a language may look at: its own signs and the shape of the block and its neighbours.
_OWN = {
    "html": ("tags", "tag_part", "comments", "entities"),
    "markdown": ("emphasis", "strike", "links", "images", "references", "footnotes", "definition"),
    "wiki": ("wiki_links", "templates", "quotes", "wiki_heading", "wiki_table"),
    "latex": ("commands_with_braces", "commands_free", "paths", "environments"),
}
_SHAPE = ("words", "link_density", "words_before", "words_after", "link_density_before", "link_density_after")


@functools.cache
def trees(labelled: str = LABELLED) -> dict[str, object]:
    """The trees fitted on a labelled table (``MOST_LABELLED`` lines at most)."""
    given = [s.split("|", 1) for s in labelled.strip("\n").split("\n")]
    if len(given) > MOST_LABELLED:
        raise ValueError(f"a labelled table has at most {MOST_LABELLED} lines")
    # each example stands in short and in long blocks, so length alone tells nothing
    rows = []
    for n in (0, 12, 70, 500):
        rest = "".join(f" {w}" for w in itertools.islice(itertools.cycle("so the old mill stood by the river for years".split()), n))
        rows += [(k, t + rest * bool(re.search(r"[\w.。)}\]>]$", t) and not re.match(r"\s*(?:[=`~$|!]|<table|border|[{|]{2}|\\\[)", t))) for k, t in given]
    _, code, x = features("\n".join(t for _, t in rows))
    keep = ~np.array(code)
    out = {}
    for k in KINDS:
        own = [FEATURES.index(f) for f in (*_OWN[k], *_SHAPE)]
        y = np.array([k[0] in labels for labels, _ in rows])
        out[k] = (own, fit_tree(x[keep][:, own], y[keep]))
    return out


def residue(text: str) -> tuple[list[str], list[bool], list[tuple[str, ...]]]:
    """(lines, whether code, kinds of residue) of a document."""
    lines, code, x = features(text)
    got = {k: predict(tree, x[:, own]) for k, (own, tree) in trees().items()}
    return lines, code, [() if c else tuple(k for k in KINDS if got[k][i]) for i, c in enumerate(code)]


# HTML elements that stand for a heading, and LaTeX commands that do.
_LATEX_HEADINGS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def _clean_html(s: str) -> str:
    s = _comment.sub("", s)
    s = re.sub(r"(?i)<h([1-6])[^<>]*>\s*(.*?)\s*</h\1>", lambda m: "#" * int(m[1]) + " " + m[2], s)
    s = re.sub(r"""(?i)<img\b[^<>]*?\balt\s*=\s*["']([^"']+)["'][^<>]*>""", r"[圖片說明: \1]", s)
    s = re.sub(r"(?i)<img\b[^<>]*>", "[圖片]", s)
    s = re.sub(r"(?i)<li[^<>]*>\s*", "- ", s)
    s = re.sub(r"(?i)<blockquote[^<>]*>\s*", "> ", s)
    s = re.sub(r"(?i)</t[dh]>\s*<t[dh][^<>]*>", " | ", s)
    s = re.sub(r"(?i)<(?:br)\s*/?>", " ", s)
    s = _tag.sub("", s)
    s = re.sub(r"<[A-Za-z][A-Za-z0-9]*\s*[^<>]*$", "", s)
    return html.unescape(_entity.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), s)) if _entity.search(s) else s


def _clean_markdown(s: str) -> str:
    if _definition.match(s):
        return "" if not _footnote.match(s.strip()) else re.sub(r"^\s*\[\^[^\]]+\]:\s*", "", s)
    s = _image.sub(lambda m: f"[圖片說明: {m[1]}]" if m[1].strip() else "[圖片]", s)
    s = _link.sub(r"\1", s)
    s = _reference.sub(lambda m: m[1] or m[3], s)
    s = _footnote.sub("", s)
    s = _strike.sub(r"\1", s)
    return _strong.sub(lambda m: m[2] or m[4] or m[5], s)


def _clean_wiki(s: str) -> str:
    if m := _wiki_heading.match(s):
        s = "#" * len(m[1]) + " " + m[2]
    if _table_open.match(s) or _table_close.match(s) or re.match(r"^\s*\|[-+]", s):
        return ""
    if re.match(r"^\s*[|!](?!\[)", s):
        s = re.sub(r"\s*(?:\|\||!!)\s*", " | ", re.sub(r"^\s*[|!]\s*", "", s))
    s = _wiki_link.sub(lambda m: "" if re.match(r"(?i)category:|分類:", m[1]) else "[圖片說明: " + m[2].rpartition("|")[2] + "]" if re.match(r"(?i)(file|image|檔案|圖像):", m[1]) else (m[2].rpartition("|")[2] or m[1]), s)
    s = _template.sub("", s)
    return _quotes.sub(r"\2", s)


def _clean_latex(s: str) -> str:
    def one(m: re.Match) -> str:
        args = re.findall(r"\{([^{}]*)\}", m[2] or "")
        name = m[1]
        if name in _LATEX_HEADINGS:
            return "#" * _LATEX_HEADINGS[name] + " " + (args[0] if args else "")
        if name == "item":
            return "- "
        if name in ("ldots", "dots"):
            return "…"
        if name in ("label", "cite", "ref", "pageref", "citep", "citet", "begin", "end", "includegraphics", "index"):
            return ""
        if name == "footnote":
            return f" ({args[0]})" if args else ""
        return args[-1] if args else ""

    s = re.sub(r"~(?=\\)", "", s)
    s = re.sub(r"\{\\[A-Za-z]+\s+([^{}]*)\}", r"\1", s)
    for _ in range(3):  # commands within arguments
        new = _command.sub(lambda m: one(m) if m[2] or not re.search(r"[A-Za-z0-9_.:\\]$", s[: m.start()]) else m[0], s)
        if new == s:
            break
        s = new
    return re.sub(r"^(- |#+ )\s+", r"\1", s) if not s.startswith(" ") else s.lstrip()


_clean = {"html": _clean_html, "markdown": _clean_markdown, "wiki": _clean_wiki, "latex": _clean_latex}


def clean(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(clean text, [(line, kind)]): lines count from 1.

    Headings, lists, quotations, code blocks and formulas survive; lines left empty by the removal
    of their markup are dropped. Formulas and inline code within a rewritten line are put aside.
    """
    lines, code, kinds = residue(text)
    out, where = [], []
    in_comment = False
    for i, (s, c, ks) in enumerate(zip(lines, code, kinds)):
        if c or not ks:
            out.append(s)
            continue
        where += [(i + 1, k) for k in ks]
        kept: list[str] = []

        def aside(m: re.Match) -> str:
            kept.append(m[0])
            return f"\ue000{len(kept) - 1}\ue001"

        t = s
        for p in (*_math, _inline_math, _inline_code):
            t = p.sub(aside, t)
        if "html" in ks and re.fullmatch(r"\s*[A-Za-z_:-]+\s*=.*/?>\s*", t):
            t = ""
        if in_comment or ("<!--" in t and "-->" not in t):
            in_comment, t = "-->" not in t, (t.partition("-->")[2] if in_comment else t.partition("<!--")[0])
        for k in ks:
            t = _clean[k](t)
        t = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], t).rstrip()
        if t.strip():
            out.append(t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n"), where


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("residue", pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())])))])
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            ids, texts, marks = [], [], []
            for r in b.slice(lo, 64).to_pylist():
                t, where = (None, []) if r["text"] is None else clean(r["text"])
                ids.append(r["id"])
                texts.append(t)
                marks.append([{"line_no": n, "kind": k} for n, k in where])
            yield pa.RecordBatch.from_pydict({"id": ids, "text": texts, "residue": marks}, schema=schema)


def clean_markup(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, text, residue) of each row: the clean text, and the lines (from 1) that held residue.

    Null stays null without residue, empty stays empty. Texts are processed whole; rows keep their
    partitions, nothing is shuffled.
    """
    return df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).mapInArrow(_run, "id bigint, text string, residue array<struct<line_no int, kind string>>")
