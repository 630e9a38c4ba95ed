"""Visually identical texts with different characters.

The skeleton of a text: decompose canonically, drop characters that show nothing, replace every character by
the prototype it looks like, decompose again.  Two texts read the same when their skeletons are equal.

The prototypes of full-width, half-width, no-break, font-variant and ligature forms and of blanks come from the
compatibility decompositions of the Unicode character database; only look-alike letters of other scripts are
listed.  Raised, lowered, circled and fraction forms have decompositions too, but a reader sees the difference, so
they stay.  ASCII characters are their own prototypes: case, punctuation and line breaks stay different.  Texts are read
character by character, so no prototype stands for several letters (``rn`` is not ``m``).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.groups import pairs_within
from weftline.session import spread, staged

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ӏ": "l", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "ү": "y", "ѡ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "σ": "o", "γ": "y", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "յ": "j", "ա": "w", "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "ք": "f",
    # Latin letters of other shapes, small capitals whose small letters have the same shape
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ȷ": "j", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ⅼ": "l",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # marks that look the same
    "‐": "-", "‑": "-", "ʹ": "'", "։": ":", "׃": ":", "∶": ":", "․": ".", "⁄": "/", "∕": "/", "‚": ",", ";": ";", "ǃ": "!",
}
#: Decompositions that do not change what a reader sees.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_VISIBLE_CONTROLS = "\t\n\r"


def _prototype(ch: str) -> str | None:
    """What stands for ``ch`` in a skeleton; None where it stands for itself."""
    if ch < "\x7f" and ch.isprintable():
        return None
    if ch in _VISIBLE_CONTROLS:
        return None
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if kind in ("Cf", "Cc") or ch == "͏" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "ᅟᅠ឴឵ㅤﾠ":
        return ""
    tag, _, codes = unicodedata.decomposition(ch).partition(" ")
    ligature = tag == "<compat>" and ("ﬀ" <= ch <= "ﬆ" or ch in "ĳĲǈǉǋǌǇǊ")
    if tag in _SAME_LOOK or ligature:
        to = "".join(chr(int(c, 16)) for c in codes.split())
        return "".join((p if (p := _prototype(c)) is not None else c) for c in to)
    return None


@cache
def prototypes() -> dict[int, str]:
    """Translation table over all of Unicode, built once in each process."""
    table = {}
    for code in range(sys.maxunicode + 1):
        if (p := _prototype(chr(code))) is not None:
            table[code] = p
    return table


#: Characters beyond which a text is its own skeleton.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e]*")


def skeleton(text: str) -> str:
    """The one form of all texts that read as ``text`` does."""
    if _PLAIN.fullmatch(text):
        return text.replace("\r\n", "\n")
    table = prototypes()
    out = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFD", out).replace("\r\n", "\n")


def consistent(text: str) -> str:
    """The form stored for comparison and display: the skeleton, composed again."""
    return unicodedata.normalize("NFC", skeleton(text))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [None if t is None else consistent(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["id", "text", "form"])


def canonical_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, form)`` of every row.  A null text has a null form, an empty one an empty form; repeated rows stay."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(src).mapInArrow(_forms, "id bigint, text string, form string")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: texts that differ as stored and read the same.

    Originals are grouped by equal skeleton.  Pairs are formed between the originals of a skeleton and then
    given the ids of both, so the work follows the result: the copies of one original, however many, meet only
    ids of other originals.  Null ids and texts have no pairs; repeated rows count once.
    """
    forms = canonical_forms(df, id_col, text_col).where("id is not null and form is not null")
    keyed = staged(forms.select("id", F.xxhash64("text").alias("stored"), F.md5("form").alias("form")).distinct(), "look-alikes")
    originals = keyed.select("form", "stored").distinct()
    several = originals.join(originals.groupBy("form").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1"), "form")
    ways = pairs_within(several, "form", "stored", "ways")
    ids_a, ids_b = (keyed.select("form", F.col("stored").alias(f"stored_{s}"), F.col("id").alias(f"x_{s}")) for s in "ab")
    both = ways.join(ids_a, ["form", "stored_a"]).join(ids_b, ["form", "stored_b"]).where("x_a <> x_b")
    return both.select(F.least("x_a", "x_b").alias("id_a"), F.greatest("x_a", "x_b").alias("id_b")).distinct()


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, class_id, original_id)``: classes and members in place of pairs, one row an id of a form stored in several ways.

    ``class_id`` is the smallest id of the form, ``original_id`` the smallest id of the same stored text; two ids read the same
    and differ as stored where their classes are equal and their originals are not.  Null ids and texts have no row; an id
    delivered with several texts has a row for each of them.
    """
    forms = canonical_forms(df, id_col, text_col).where("id is not null and form is not null")
    keyed = staged(forms.select("id", F.xxhash64("text").alias("stored"), F.md5("form").alias("form")).distinct(), "look-alikes")
    originals = keyed.groupBy("form", "stored").agg(F.min("id").alias("original_id"))
    classes = originals.groupBy("form").agg(F.min("original_id").alias("class_id"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    named = originals.join(classes, "form").select("form", "stored", "class_id", "original_id")
    return keyed.join(named, ["form", "stored"]).select("id", "class_id", "original_id")
