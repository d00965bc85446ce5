"""Repair of text read from scanned pages (problem 2).

Method: a symmetric-delete index over the collection's frequency lexicon gives candidates for a
word (both sides drop what a known confusion could have changed, and meet on what remains); the
weighted edit distance with confusion pairs and the context of neighbours choose the repair. Words
cut at line ends are decided by the lexicon too; running headers and page numbers by their form,
their recurrence and their place.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.consistent import consistent
from quire.session import materialize, release

# What is printed -> what is read for it, with the cost of the confusion.
CONFUSIONS = [
    ("e", "c", 0.3), ("c", "e", 0.3), ("t", "f", 0.4), ("f", "t", 0.5), ("a", "o", 0.5), ("h", "b", 0.4), ("b", "h", 0.5), ("u", "v", 0.7),
    ("o", "0", 0.1), ("s", "5", 0.1), ("i", "!", 0.1), ("i", "1", 0.1), ("l", "1", 0.1), ("l", "|", 0.1), ("i", "|", 0.1), ("g", "9", 0.1), ("b", "6", 0.1), ("z", "2", 0.2), ("b", "8", 0.2),
    ("n", "ri", 0.2), ("m", "rn", 0.2), ("d", "cl", 0.2), ("u", "ii", 0.2), ("w", "vv", 0.2), ("rn", "m", 0.4), ("cl", "d", 0.5), ("li", "h", 0.6), ("l", "i", 0.7), ("i", "l", 0.7),
]
# Ideographs of nearly the same shape.
SHAPES = "己已巳 問間聞 方万 社杜 憶億 未末 土士 人入八 日曰 界畀 練鍊 湯渴 細紬 契挈 會曾 決抉 斷斲 國囯 由申甲 大太犬 千干于 刀力 天夫 王玉主 木本术 午牛 今令 白自目 治冶 侯候 侍待 戌戍 鳥烏 拆折 栗粟 兔免 矛予 幻幼 汨汩 市巿 狠狼 貧貪 祟崇".split()
_alike: dict[str, str] = {}
for _s in SHAPES:
    for _c in _s:
        _alike[_c] = _s.replace(_c, "")

LETTER = "A-Za-zÀ-ɏ"
SHAPE = "(?=(.[" + "".join(_alike) + "].))"
_shape = re.compile(SHAPE)
WORD = rf"(?:[|!](?=[{LETTER}]))?[{LETTER}0-9]+(?:[|!][{LETTER}0-9]+)*(?:(?<=[{LETTER}])\|)?"
COMPOUND = rf"(?<![{LETTER}0-9-])[{LETTER}]+(?:-[{LETTER}]+)+(?![{LETTER}0-9-])"
_word, _compound = re.compile(WORD), re.compile(COMPOUND)
_number = re.compile(r"(?=.*[0-9])(?=.*[lOI|])[0-9lOI|]{2,}")
_stray = re.compile(rf"(?=.{{5}})[{LETTER}]*[01569!|][{LETTER}]*")
_tuc = re.compile(rf"([-‐¬])([{LETTER}|!0-9]+)((?:-[{LETTER}0-9|!]+)*)")  # on the reversed line
_goes_on = re.compile(rf"[{LETTER}|!0-9]+")
_goes_on_compound = re.compile(rf"[{LETTER}]+(?:-[{LETTER}]+)*")
#: A page number: digits (some perhaps misread) in brackets, rules or with a word for page.
_page = re.compile(r"(?:page|p\.?|pg\.?|第)?\s*[\[(<{|~\-–—•·*=]*\s*(?:page|p\.?)?\s*([0-9lOI|]{1,4})\s*[\])>}|~\-–—•·*=]*\s*(?:頁|页)?\.?", re.I)
_numbered = re.compile(r"(?:([0-9lOI|]{1,4})(?:\s{2,}|\s*[|•·]\s*)(\D.*?)|(\D.*?)(?:\s{2,}|\s*[|•·]\s*)([0-9lOI|]{1,4}))")
_end = re.compile(r"[.,;:?!，。；：？！、…」』\"'）)]$")
_small = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"}

#: How many times as common a candidate must be as the word it would replace; names, which come in
#: many similar spellings, need more.
RATIO, NAME_RATIO = 8.0, 40.0
#: Log ratio of the neighbours' support that an ideograph of like shape needs.
SHAPE_RATIO = 3.0
#: The least count of a lexicon word that may be a candidate.
KNOWN = 3


def fold(s: str) -> str:
    """A key that does not change under the confusions: for comparing lines that may be misread."""
    s = s.lower()
    for a, b in (("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u")):
        s = s.replace(a, b)
    s = s.translate(str.maketrans("0156!|9ftcohl", "aisbiigeeeabi"))
    return re.sub(r"[\W_]+", "", "".join(min(c + _alike.get(c, "")) for c in s))


def _title_like(s: str, width: int) -> bool:
    """Whether a line may be a title: short, without a sentence's end, its words capitalised."""
    s = s.strip()
    if not s or len(s) > 60 or _end.search(s):
        return False
    latin = [w for w in re.split(r"[\s-]+", s) if w]
    if re.search(f"[{LETTER}]", s):
        return all(w[:1].isupper() or w[:1].isdigit() or w.lower() in _small or w[0] in "|!" for w in latin) and latin[0][:1] not in "|"
    return len(s) < 0.8 * width and not re.search("[，。、；：？！]", s)


def _digits(s: str) -> int:
    return int("0" + re.sub(r"\D", "", s.translate(str.maketrans("lOI|", "1011"))))


def page_lines(lines: list[str]) -> dict[int, str]:
    """{line index: header or page_no} of one document.

    A bare number of four digits is a page number only if a neighbouring page has the number
    before or after it. A header is a line that recurs in the document, one with a page number, or a
    title-like line beside a page number; the document's own title on its first line isn't one.
    """
    out: dict[int, str] = {}
    text = [s.strip() for s in lines]
    width = max(map(len, text), default=0)
    first = next((i for i, s in enumerate(text) if s), -1)
    numbers = {}
    for i, s in enumerate(text):
        if 0 < len(s) <= 16 and (m := _page.fullmatch(s)) and re.search(r"\d", m[1]):
            numbers[i] = (_digits(m[1]), s == m[1] and len(m[1]) == 4)
    values = Counter(v for v, _ in numbers.values())
    for i, (v, yearlike) in numbers.items():
        if not yearlike or any(abs(v - w) == abs(round((i - j) / 20)) == 1 for j, (w, _) in numbers.items() if abs(i - j) >= 12):
            out[i] = "page_no"
    pages = sorted(out)
    keys = [fold(s) if 0 < len(s) <= 70 and _title_like(s, width) else "" for s in text]
    parts: dict[int, str] = {}
    for i, s in enumerate(text):
        if i not in out and len(s) <= 80 and (m := _numbered.fullmatch(s)) and re.search(r"\d", (m[1] or m[4])) and _title_like(m[2] or m[3], 1 << 30):
            parts[i] = fold(m[2] or m[3])
            out[i] = "header"
    seen = Counter([k for i, k in enumerate(keys) if k and i != first and i not in out] + list(parts.values()))
    for i, k in enumerate(keys):
        if not k or i in out or i == first:
            continue
        beside = any(abs(i - p) <= 2 and not any(text[min(i, p) + 1 : max(i, p)]) for p in pages)
        if seen[k] >= 2 or beside:
            out[i] = "header"
    return out


def scan(text: str) -> tuple[list, list, list, list, list]:
    """(marks, breaks, words, shapes, titles) of a page range; lines count from 1.

    marks: (line, kind). breaks: (line, mark, joined, hyphened, left, right). words: (line, word,
    cut, whole): cut > 0 where the word goes on in the next line of text. shapes: (line, the ideograph and its neighbours) of
    every ideograph with a look-alike. titles: (line, key) of title-like lines that aren't marked.
    """
    lines = (consistent(text)[0] or "").split("\n")
    mark = page_lines(lines)
    marks = [(i + 1, k) for i, k in sorted(mark.items())]
    breaks, words, shapes = [], [], []
    body = [i for i in range(len(lines)) if i not in mark]
    skips: dict[int, int] = {}
    flat: list[str] = []
    begins: list[int] = []
    at = 0
    for n, i in enumerate(body):
        s = lines[i].rstrip()
        start = skips.get(i, 0)
        m = _tuc.match(s[::-1]) if s[-1:] in "-‐¬" else None
        stop = len(s)
        if m:
            nxt = next((k for k in range(n + 1, len(body)) if lines[body[k]].strip()), len(body))
            # past an empty line the word goes on only if a page ends here or the lexicon has it
            page_ends = nxt < len(body) and any(j in mark for j in range(i + 1, body[nxt]))
            after = lines[body[nxt]] if nxt < len(body) else ""
            lead = len(after) - len(after.lstrip())
            g = _goes_on.match(after, lead)
            if g:
                sign, left, before = m[1], m[2][::-1], m[3][::-1]
                right = _goes_on_compound.match(after, lead)
                gap = nxt != n + 1 and not page_ends
                breaks.append((i + 1, "?" if gap else sign, (left + g[0]).lower(), (before + left + "-" + (right[0] if right else g[0])).lower(), left.lower(), g[0].lower()))
                if not gap:
                    words.append((i + 1, left + g[0], len(left)))
                    stop = len(s) - 1 - len(left)
                    skips[body[nxt]] = g.end()
        words += [(i + 1, w[0], 0) for w in _word.finditer(s, start, stop)]
        words += [(i + 1, w[0], -1) for w in _compound.finditer(s)]
        t = lines[i].strip() or "\n"
        flat.append(t)
        begins.append(at)
        at += len(t)
    for m in _shape.finditer("".join(flat)):
        shapes.append((body[bisect_right(begins, m.start() + 1) - 1] + 1, m[1]))
    width = max(map(len, lines), default=0)
    first = next((i for i, s in enumerate(lines) if s.strip()), -1)
    titles = [(i + 1, k) for i in body if i != first and _title_like(lines[i], width) and (k := fold(lines[i]))]
    return marks, breaks, words, shapes, titles


_FIELDS = {
    "marks": (("line", "int"), ("kind", "string")),
    "breaks": (("line", "int"), ("mark", "string"), ("joined", "string"), ("hyphened", "string"), ("left", "string"), ("right", "string")),
    "words": (("line", "int"), ("word", "string"), ("cut", "int")),
    "shapes": (("line", "int"), ("three", "string")),
    "titles": (("line", "int"), ("key", "string")),
}
_SCAN = "id bigint, " + ", ".join(f"{k}_{c} array<{t}>" for k, cs in _FIELDS.items() for c, t in cs)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column of arrays for each field: far cheaper to hand over than arrays of structs."""
    kinds = {"int": pa.list_(pa.int32()), "string": pa.list_(pa.string())}
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # texts may be long: a few at a time
            part = b.slice(lo, 64)
            got = [scan(t or "") for t in part.column("text").to_pylist()]
            cols = {"id": part.column("id")}
            for k, (name, fields) in enumerate(_FIELDS.items()):
                for j, (c, t) in enumerate(fields):
                    cols[f"{name}_{c}"] = pa.array([[x[j] for x in g[k]] for g in got], kinds[t])
            yield pa.RecordBatch.from_pydict(cols)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, item, n, low): the words and look-alike ideographs of texts, counted for each batch."""
    for b in batches:
        words: Counter = Counter()
        shapes: Counter = Counter()
        for t in b.column("text").to_pylist():
            if t:
                words.update(_word.findall(t))
                words.update(_compound.findall(t))
                shapes.update(_shape.findall(t))
        low: Counter = Counter()
        small: Counter = Counter()
        for w, n in words.items():
            low[v := w.lower()] += n
            if v == w:
                small[v] += n
        items = [*low, *shapes]
        cols = {"what": ["word"] * len(low) + ["shape"] * len(shapes), "item": items, "n": [*low.values(), *shapes.values()], "low": [small[w] for w in low] + [0] * len(shapes)}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c in ("what", "item") else pa.int64()) for c, v in cols.items()})


def _each(s: DataFrame, name: str) -> DataFrame:
    """(id, fields...): one row for each entry of a kind."""
    cols = [f"{name}_{c}" for c, _ in _FIELDS[name]]
    return s.select("id", F.explode(F.arrays_zip(*cols)).alias("x")).select("id", *(F.col(f"x.{c}").alias(f) for c, (f, _) in zip(cols, _FIELDS[name])))


def _drops(w: str, side: int) -> set[tuple[str, str]]:
    """(what remains, what was dropped) after dropping one or two confusable parts of a word.

    side 0 drops what may have been printed, 1 what may have been read.
    """
    sides = {c[side] for c in CONFUSIONS}
    ones = [(i, i + n) for n in (1, 2) for i in range(len(w) - n + 1) if w[i : i + n] in sides]
    out = {(w[:i] + "\x00" + w[j:], w[i:j]) for i, j in ones}
    if len(w) > 5:
        out |= {(w[:i] + "\x00" + w[j:k] + "\x00" + w[m:], w[i:j] + "\x00" + w[k:m]) for i, j in ones for k, m in ones if j <= k}
    return out


_cost = {}
for _a, _b, _v in CONFUSIONS:
    _cost[(_a, _b)] = min(_v, _cost.get((_a, _b), 9))


def _index(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, d, w, n, low) for w, n, low in zip(*(b.column(c).to_pylist() for c in ("word", "n", "low"))) for k, d in _drops(w, side)]
            if rows:
                k, d, w, n, low = map(list, zip(*rows))
                yield pa.RecordBatch.from_pydict({"key": k, "part": d, "word": w, "n": pa.array(n, pa.int64()), "low": pa.array(low, pa.int64())})

    return run


def _weight(printed: str, read: str) -> Column:
    """The cost of reading ``read`` for ``printed``, one or two parts each; null if it is no known confusion."""
    costs = F.create_map(*(F.lit(x) for (a, b), v in _cost.items() for x in (f"{a}\x01{b}", v)))
    a, b = F.split(printed, "\x00"), F.split(read, "\x00")
    each = F.zip_with(a, b, lambda x, y: costs[F.concat(x, F.lit("\x01"), y)])
    return F.when(F.size(a) == F.size(b), F.aggregate(each, F.lit(0.0), lambda t, x: t + x))


def repairs(lexicon: DataFrame) -> DataFrame:
    """(word, repair, cost): the best repair of each misread word of (word, n, low).

    n counts a word, low its occurrences that aren't capitalised. A candidate must be ``RATIO``
    times as common (``NAME_RATIO`` if it is always capitalised and nothing but letters was read);
    of several, the nearest and then the most common is taken. Words with a sign that is no letter
    may be rarer candidates' misreadings.
    """
    good = lexicon.where(F.col("n") >= KNOWN).where(F.col("word").rlike(f"^[{LETTER}]{{2,}}$"))
    right = good.mapInArrow(_index(0), "key string, part string, word string, n bigint, low bigint").select("key", F.col("part").alias("printed"), F.col("word").alias("repair"), F.col("n").alias("n2"), F.col("low").alias("low2"))
    asked = lexicon.where(F.length("word") >= 2).where(F.col("word").rlike(f"[{LETTER}]")).mapInArrow(_index(1), "key string, part string, word string, n bigint, low bigint")
    odd = F.col("word").rlike(f"[^{LETTER}]")
    need = F.when(odd, F.lit(1.0)).when(F.col("low2") == 0, NAME_RATIO).otherwise(RATIO * F.when(F.col("key").contains("\x00") & (F.length("word") < 4), 4.0).otherwise(1.0))
    pairs = (
        asked.withColumnRenamed("part", "read")
        .join(right, "key")
        .where("word <> repair and n2 >= 2 * n")
        .withColumn("cost", _weight("printed", "read"))
        .where("cost is not null")
        .withColumn("sure", F.col("n2") >= F.col("n") * need)
    )
    pairs = materialize(pairs, "pairs")
    # a spelling with three letters in a row that no known word has is no word, however rare the candidate
    threes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, F.lit(3)))
    known = good.select(F.explode(threes(F.col("word"))).alias("three")).groupBy("three").agg(F.count("*").alias("c")).where("c > 1")
    strange = pairs.where("not sure").select("word").distinct().withColumn("three", F.explode(threes(F.col("word")))).join(known, "three", "left_anti").select("word").distinct()
    return (
        pairs.join(strange.withColumn("strange", F.lit(True)), "word", "left")
        .where("sure or strange")
        .groupBy("word")
        .agg(F.min_by(F.struct("repair", "cost"), F.struct("cost", -F.col("n2"), "repair")).alias("x"))
        .select("word", "x.*")
    )


def _shape_repairs(shapes: DataFrame) -> DataFrame:
    """(three, repair) for (three, n): ideographs of like shape that the neighbours support far more."""
    at = lambda i: F.substring("three", i, 1)
    t = materialize(shapes.select(at(1).alias("prev"), at(2).alias("c"), at(3).alias("next"), "n").groupBy("prev", "c", "next").agg(F.sum("n").alias("n")), "shapes")
    left = t.groupBy("prev", "c").agg(F.sum("n").alias("l"))
    right = t.groupBy("c", "next").agg(F.sum("n").alias("r"))
    alike = F.create_map(*(x for k, v in _alike.items() for x in (F.lit(k), F.lit(v))))
    asked = t.select("prev", "c", "next", F.explode(F.split(alike[F.col("c")], "")).alias("g")).where("g <> ''")
    j = (
        asked.join(left.withColumnRenamed("l", "l1"), ["prev", "c"], "left")
        .join(right.withColumnRenamed("r", "r1"), ["c", "next"], "left")
        .join(left.select("prev", F.col("c").alias("g"), F.col("l").alias("l2")), ["prev", "g"], "left")
        .join(right.select(F.col("c").alias("g"), "next", F.col("r").alias("r2")), ["g", "next"], "left")
    )
    of = lambda c: F.log(F.coalesce(F.col(c), F.lit(0)) + 0.5)
    score = of("l2") + of("r2") - of("l1") - of("r1")
    return j.withColumn("score", score).where(F.col("score") >= SHAPE_RATIO).groupBy(F.concat("prev", "c", "next").alias("three")).agg(F.max_by(F.concat("prev", "g", "next"), "score").alias("repair"))


def page_repairs(df: DataFrame, id_col: str, text: Column, pdf: Column, group: Column, titles: DataFrame | None = None) -> DataFrame:
    """(id, line, kind, word, repair) of every line that needs repair.

    kind: broken_word (word: the cut word's first part, repair: the whole word), misread, header or
    page_no. ``pdf`` tells which rows are pages; the others only add to the lexicon. ``titles``
    (group, title) has the titles of the works, which a running header may show; ``group`` is the
    work of a row. Null and empty texts have no lines to repair. Ids must be unique; repeated ids
    count as one document's lines.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.coalesce(pdf, F.lit(False)).alias("pdf"))
    s = materialize(docs.where("pdf").select("id", "text").mapInArrow(_scanned, _SCAN), "scan")
    found = _each(s, "words")
    other = materialize(docs.where("not pdf").select("text").mapInArrow(_counted, "what string, item string, n bigint, low bigint").groupBy("what", "item").agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "counted")
    words = found.where("cut <= 0").select(F.lower("word").alias("word"), F.lit(1).cast("long").alias("n"), (F.col("word") == F.lower("word")).cast("long").alias("low"))
    words = words.unionByName(other.where("what = 'word'").select(F.col("item").alias("word"), "n", "low"))
    lexicon = materialize(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "lexicon")
    # words put together from two lines are asked about but are no evidence
    cut = found.where("cut > 0").select(F.lower("word").alias("word")).distinct()
    asked = lexicon.unionByName(cut.join(lexicon, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("low")))
    fixes = materialize(repairs(asked), "repairs")

    b = _each(s, "breaks")
    count = lambda c: lexicon.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    for c in ("joined", "hyphened", "left", "right"):
        b = b.join(count(c), c, "left").fillna(0, [f"n_{c}"])
    own = (F.col("n_hyphened") > F.col("n_joined")) | ((F.col("n_joined") == 0) & (F.col("n_left") >= 20) & (F.col("n_right") >= 20))
    broken = b.where(F.when(F.col("mark") == "?", F.col("n_joined") >= KNOWN).otherwise((F.col("mark") != "-") | ~own)).select("id", "line", F.lit("broken_word").alias("kind"), F.col("left").alias("word"), F.col("joined").alias("repair"))

    occ = found.where("cut >= 0").select("id", "line", "word")
    number = F.col("word").rlike(r"^(?=.*[0-9])(?=.*[lOI|])[0-9lOI|]{2,}$")
    stray = F.col("word").rlike(rf"^(?=.{{5}})[{LETTER}]*[01569!|][{LETTER}]*$")
    rare = lexicon.where(F.col("n") < 20).where(F.col("word").rlike(r"[0-9!|]")).select("word")
    odd = occ.where(number | F.col("word").rlike(r"[0-9!|]"))
    plain = occ.join(fixes.withColumnRenamed("word", "low"), F.lower("word") == F.col("low")).where(~number).select("id", "line", "word", "repair")
    numbers = odd.where(number).select("id", "line", "word", F.translate("word", "lOI|", "1011").alias("repair"))
    strays = odd.where(stray & ~number).join(rare.withColumnRenamed("word", "low"), F.lower("word") == F.col("low"), "left_semi").select("id", "line", "word", F.translate("word", "01569!|", "olsbgil").alias("repair"))
    chars = _each(s, "shapes")
    all_chars = chars.groupBy("three").agg(F.count("*").alias("n")).unionByName(other.where("what = 'shape'").select(F.col("item").alias("three"), "n"))
    shapes = chars.join(_shape_repairs(all_chars), "three").select("id", "line", F.col("three").alias("word"), "repair")
    misread = plain.unionByName(numbers).unionByName(strays).unionByName(shapes).select("id", "line", F.lit("misread").alias("kind"), "word", "repair")
    none = F.lit(None).cast("string")
    marks = _each(s, "marks").select("id", "line", "kind", none.alias("word"), none.alias("repair"))
    if titles is not None:
        keys = titles.select(*(F.col(c).alias(n) for c, n in zip(titles.columns, ("group", "title")))).mapInArrow(_folded, "group string, key string").distinct()
        of = df.select(F.col(id_col).cast("bigint").alias("id"), group.cast("string").alias("group")).distinct()
        named = _each(s, "titles").join(of, "id").join(keys, ["group", "key"], "left_semi").select("id", "line").distinct()
        marks = marks.unionByName(named.select("id", "line", F.lit("header").alias("kind"), none.alias("word"), none.alias("repair")))
        misread = misread.join(named, ["id", "line"], "left_anti").select(*misread.columns)
        broken = broken.join(named, ["id", "line"], "left_anti").select(*broken.columns)
    return marks.unionByName(broken).unionByName(misread)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(g, k) for g, t in zip(b.column("group").to_pylist(), b.column("title").to_pylist()) if t and (k := fold(t))]
        yield pa.RecordBatch.from_pydict({"group": pa.array([g for g, _ in rows], pa.string()), "key": pa.array([k for _, k in rows], pa.string())})


def _like(word: str, repair: str) -> str:
    """The repair in the capitals of the word it replaces."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return repair.upper()
    return repair[:1].upper() + repair[1:] if word[:1].isupper() else repair


def rebuild(text: str, fixes: list[tuple[int, str, str | None, str | None]]) -> str:
    """The text in paragraphs, with its (line, kind, word, repair) carried out."""
    lines = (consistent(text)[0] or "").split("\n")
    gone = {n for n, kind, _, _ in fixes if kind in ("header", "page_no")}
    broken = {n for n, kind, _, _ in fixes if kind == "broken_word"}
    words = {w: r for _, kind, w, r in fixes if kind == "misread" and w and r}
    paragraphs, now, glue, ended = [], "", "", False
    for n, s in enumerate(lines, 1):
        t = s.strip()
        if n in gone:
            continue
        if not t:
            if now and not (glue == "" and ended):
                paragraphs.append(now)
                now = ""
            continue
        if now:
            cjk = bool(re.search("[⺀-鿿，。！？；：、」』）]$", now)) or bool(re.match("[⺀-鿿，。！？；：、「『（]", t))
            now += (glue if ended else ("" if cjk else " ")) + t
        else:
            now = t
        ended, glue = False, ""
        if n in broken:
            now, ended = now.rstrip("-‐¬"), True
        elif re.search(rf"[{LETTER}]-$", now):
            ended = True
    if now:
        paragraphs.append(now)
    out = "\n\n".join(paragraphs)
    shapes = {w: r for w, r in words.items() if len(w) == 3 and w[1] in _alike}
    out = _word.sub(lambda m: _like(m[0], words[m[0]]) if m[0] in words else m[0], out)
    for w, r in shapes.items():
        out = out.replace(w, r)
    return out


def repaired_texts(df: DataFrame, id_col: str, text: Column, fixes: DataFrame) -> DataFrame:
    """(id, text): the rows of ``df`` as continuous paragraphs, by the fixes of ``page_repairs``.

    Null stays null, empty stays empty. A document's fixes are gathered beside its text; they are
    fewer than its words.
    """
    own = fixes.groupBy("id").agg(F.collect_list(F.struct("line", "kind", "word", "repair")).alias("fixes"))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).join(own, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = b.slice(lo, 64).to_pylist()
                got = [None if r["text"] is None else rebuild(r["text"], [(f["line"], f["kind"], f["word"], f["repair"]) for f in r["fixes"] or []]) for r in rows]
                yield pa.RecordBatch.from_pydict({"id": pa.array([r["id"] for r in rows], pa.int64()), "text": pa.array(got, pa.string())})

    return docs.mapInArrow(run, "id bigint, text string")
