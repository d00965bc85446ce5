"""Visually identical text brought to one consistent form (problem 7).

Method: each token's resolved script set is the intersection of the script sets of its
characters. An empty intersection is a mixed-script token; a token that is not Latin but could
be spelled wholly in Latin with look-alikes is a whole-script confusable. Both get the one script
in which every letter has a spelling; what remains is normalised (width, composition, spaces,
characters without width).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters and the Latin letter each stands for.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаесѕіјорхуһԁԛԝ", "ABESIJKMHOPCTXYaecsijopxyhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυ", "ABEZHIKMNOPTYXovikpu"))
# Characters without width, and spaces other than the plain one.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Blocks of radicals that look like the unified ideograph.
RADICALS = "\u2e80-\u2fdf\uf900-\ufaff"
# Mathematical letters and digits, compatibility ideographs. Kept apart from the classes above,
# as one character beyond the basic plane makes a large class slow.
FAR = "\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f"
# The simplified or unified ideograph of radicals that have no compatibility mapping.
RADICAL_OF = dict(zip("⺌⺍⺗⺝⺢⺣⺨⺫⺬⺭⺮⺼⺽⺾⻂⻌⻍⻏⻖", "小小心月水火犬目示示竹肉臼艸衣辵辵邑阜"))


def _rule(ranges: tuple[tuple[int, int], ...]) -> str:
    """Letters and digits of the ranges whose compatibility form is other letters or digits."""
    out = []
    for a, b in ranges:
        for c in map(chr, range(a, b + 1)):
            n = unicodedata.normalize("NFKC", c)
            if n != c and n.isalnum() and unicodedata.category(c)[0] in "LNS" and not 0x2E80 <= ord(n[0]) <= 0x9FFF:
                out.append(c)
    return "".join(out)


#: Full-width, half-width, joined, mathematical and letterlike forms of letters and digits.
FORMS = _rule(((0x2102, 0x214F), (0xFB00, 0xFB06), (0xFF10, 0xFF9D)))

# Look-alikes of further scripts, and phonetic letters drawn like plain ones.
ARMENIAN = dict(zip("օսոհցքԼՍՕ", "ounhgpLUO"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHGZSLCPKB"))
PHONETIC = dict(zip("ɑɡɩʏʙʜɴ", "agiybhn"))

TO_LATIN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | PHONETIC
KINDS = ("form", "accent", "invisible", "space", "lookalike")

_invisible = re.compile(f"[{INVISIBLE}]")
_space = re.compile(f"[{SPACES}]")
_form = re.compile(f"[{FORMS}]")
_far = re.compile(f"[{FAR}]")
_accent = re.compile("(?<=[^\\W\\d_])[\u0300-\u036f]")
_radical = re.compile(f"[{RADICALS}]")
FOREIGN = "\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u0531-\u0587\u13a0-\u13f5\u0250-\u02af"
_foreign = re.compile(f"[{FOREIGN}]")
_any = re.compile(f"[{INVISIBLE}{SPACES}{FORMS}{RADICALS}{FOREIGN}\u0300-\u036f]")
_token = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_mark = re.compile("[\u0300-\u036f]+")
_latin = re.compile("[A-Za-z\u00c0-\u024f]")


def script_of(ch: str) -> str:
    """The script of a letter, for the scripts that have look-alikes; else "other"."""
    o = ord(ch)
    if ch.isascii() or 0xC0 <= o <= 0x24F or 0x1E00 <= o <= 0x1EFF:
        return "latin"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if 0x531 <= o <= 0x587:
        return "armenian"
    if 0x13A0 <= o <= 0x13F5:
        return "cherokee"
    if 0x250 <= o <= 0x2AF:
        return "phonetic"
    return "other"


def _spellings(ch: str) -> frozenset[str]:
    """Scripts in which the letter has a spelling: its own, and Latin if it looks Latin."""
    return frozenset({script_of(ch)} | ({"latin"} if ch in TO_LATIN else set()))


_FROM_LATIN = {
    "cyrillic": {v: k for k, v in CYRILLIC.items()},
    "greek": {v: k for k, v in GREEK.items()},
}


def resolve_token(token: str, latin_context: bool) -> str:
    """The token in its consistent script; unchanged if there is nothing to resolve."""
    scripts = [script_of(c) for c in token]
    resolved = set(scripts)
    if resolved == {"latin"} or "other" in resolved:
        # ideographs or other scripts beside Latin are separate words written without a space
        if "other" not in resolved or not _foreign.search(token):
            return token
        return re.sub(
            f"[A-Za-z\u00c0-\u024f{FOREIGN}]+",
            lambda m: resolve_token(m.group(), latin_context),
            token,
        )
    if len(resolved) > 1:  # mixed: no script holds all letters as they stand
        common = frozenset.intersection(*(_spellings(c) for c in token))
        if "latin" in common:
            return "".join(TO_LATIN.get(c, c) for c in token)
        for script in ("cyrillic", "greek"):
            back = _FROM_LATIN[script]
            if all(script_of(c) == script or c in back for c in token):
                return "".join(back.get(c, c) if script_of(c) == "latin" else c for c in token)
        return token
    # whole-script confusable: every letter has a Latin spelling, and the text around is Latin
    if latin_context and len(token) > 1 and all(c in TO_LATIN for c in token):
        return "".join(TO_LATIN[c] for c in token)
    if latin_context and len(token) == 1 and token in CYRILLIC:
        return CYRILLIC[token]
    return token


def resolve(text: str) -> str:
    """The text with every token in its consistent script.

    A token wholly of look-alikes is read as Latin only if the words beside it are Latin (mixed ones
    count as that), so words of a Cyrillic or Greek passage stay. Accents written apart keep their
    places.
    """
    found = list(_token.finditer(text))
    bare = [_mark.sub("", m.group()) for m in found]
    latin = [bool(_latin.search(b)) for b in bare]
    out, at = [], 0
    for k, (m, b) in enumerate(zip(found, bare)):
        if not _foreign.search(b):
            continue
        beside = [latin[j] for j in (k - 1, k + 1) if 0 <= j < len(found) and script_of(bare[j][0]) != "other"]
        new = resolve_token(b, bool(beside) and all(beside))
        if new != b:
            letters = iter(new)
            s = "".join(c if _mark.match(c) else next(letters) for c in m.group())
            out += [text[at : m.start()], s]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def consistent(text: str | None) -> tuple[str | None, int]:
    """The text in its consistent form, and a bit for each kind found (order of ``KINDS``).

    Null stays null with no kinds; an empty text stays empty.
    """
    if text is None:
        return None, 0
    found, s = 0, text
    if _far.search(s):
        found = max((16 if ord(c) > 0x2F000 else 1) for c in _far.findall(s)) | (1 if re.search("[\U0001d400-\U0001d7ff]", s) else 0)
        s = _far.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    if not _any.search(s):
        return s, found
    if _invisible.search(s):
        found, s = found | 4, _invisible.sub("", s)
    if _space.search(s):
        found, s = found | 8, _space.sub(" ", s)
    if _form.search(s):
        found, s = found | 1, _form.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    if _radical.search(s):
        new = _radical.sub(lambda m: RADICAL_OF.get(m.group()) or unicodedata.normalize("NFKC", m.group()), s)
        found, s = found | 16, new
    if _foreign.search(s):  # before accents are joined to letters that only look right
        new = resolve(s)
        if new != s:
            found, s = found | 16, new
    if _accent.search(s):
        found |= 2
        s = unicodedata.normalize("NFC", s)
    return s, found


def consistent_text(c: Column | str) -> Column:
    """The consistent form of a text column."""
    return _udf(c)["text"]


@F.pandas_udf(T.StructType().add("text", "string").add("kinds", "integer"))
def _udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        r = [consistent(x) for x in s]
        yield pd.DataFrame({"text": pd.Series([a for a, _ in r], dtype=object), "kinds": pd.Series([b for _, b in r], dtype="int32")})


def with_consistent(df: DataFrame, column: str, out: str, kinds: str) -> DataFrame:
    """``df`` with ``out`` (consistent form of ``column``) and ``kinds`` (array of kinds found, null for null)."""
    tmp = f"__{out}"
    names = F.array(*(F.when(F.col(tmp)["kinds"].bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS)))
    return (
        df.withColumn(tmp, _udf(F.col(column)))
        .withColumn(out, F.col(tmp)["text"])
        .withColumn(kinds, F.when(F.col(column).isNotNull(), F.array_compact(names)))
        .drop(tmp)
    )


def found(df: DataFrame, column: str, id_col: str, field: str) -> DataFrame:
    """(field, row_id, kind): one row for each kind found in a text."""
    return (
        with_consistent(df.select(id_col, column), column, "__text", "__kinds")
        .select(F.lit(field).alias("field"), F.col(id_col).cast("bigint").alias("row_id"), F.explode("__kinds").alias("kind"))
        .distinct()
    )
