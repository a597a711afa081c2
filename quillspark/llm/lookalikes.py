"""One consistent form for texts that look the same but differ in their characters.

DuckDB runs inside Arrow partitions: its SQL composes combining accents
(``nfc_normalize``), maps compatibility forms, special spaces, hyphens and
look-alike letters (``translate``), and removes invisible characters
(``regexp_replace``).  The mapping tables are derived from the Unicode database;
only the visual identities that it does not hold are written out.

Case, accents and punctuation are kept: texts that read differently stay different.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are drawn like a Latin letter, by script.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin letters of phonetic alphabets
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
#: Hyphens that are drawn like the hyphen of the keyboard.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
#: Kinds of compatibility mapping whose result is drawn like the character itself.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")
#: Characters that leave no mark: soft hyphen, zero width, direction and variation marks.
INVISIBLE = "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0100-\U000e01ef]"
#: White space of any width.
SPACES = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Letters that only Cyrillic has; a word with one of them keeps its Cyrillic letters.
CYRILLIC = "[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюя]"


@cache
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters, their one-character images, and pairs with longer images."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.decomposition(char).partition(" ")[0]
        if kind in SAME_LOOK and unicodedata.category(char) not in ("No", "So", "Zs", "Mn"):
            image = unicodedata.normalize("NFKC", char)
            if len(image) == 1:
                one[char] = LOOKALIKES.get(image, image)
            elif image.isascii() and " " not in image:
                many[char] = image
    one |= LOOKALIKES | {h: "-" for h in HYPHENS}
    for code in range(0x80, 0x2000):  # composed letters on a look-alike base, as the accented Cyrillic e
        char = chr(code)
        base, marks = unicodedata.normalize("NFD", char)[:1], unicodedata.normalize("NFD", char)[1:]
        if marks and base in LOOKALIKES and len(image := unicodedata.normalize("NFC", LOOKALIKES[base] + marks)) == 1:
            one[char] = image
    return "".join(one), "".join(one.values()), tuple(sorted(many.items()))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def form_sql(column: str) -> str:
    """DuckDB expression for the consistent form of a text column; NULL stays NULL."""
    chars, images, many = tables()
    longer = "x"
    for char, image in many:
        longer = f"replace({longer}, {_quoted(char)}, {_quoted(image)})"
    back = {image: char for char, image in reversed(LOOKALIKES.items()) if "\u0410" <= char <= "\u044f"}
    latin, cyrillic = "".join(back), "".join(back.values())
    some = "[" + "".join(char for char, _ in many) + "]"
    steps = [
        f"regexp_replace(x, {_quoted(INVISIBLE)}, '', 'g')",
        "nfc_normalize(x)",
        f"case when regexp_matches(x, {_quoted(some)}) then {longer} else x end",
        f"translate(x, {_quoted(chars)}, {_quoted(images)})",
        "nfc_normalize(x)",  # an accent may now stand on a mapped letter
        f"case when regexp_matches(x, {_quoted(CYRILLIC)}) then list_aggregate(list_transform(string_split(x, ' '),"
        f" lambda w: case when regexp_matches(w, {_quoted(CYRILLIC)}) then translate(w, {_quoted(latin)}, {_quoted(cyrillic)}) else w end), 'string_agg', ' ') else x end",
    ]
    sql = f'"{column}"'
    for step in steps:
        sql = f"list_transform([{sql}], lambda x: {step})[1]"
    sql = f"case when regexp_full_match(\"{column}\", '[ -~]*') then \"{column}\" else {sql} end"
    return f"trim(regexp_replace({sql}, {_quoted(SPACES)}, ' ', 'g'))"


def with_form(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """``df`` with the consistent form of the string ``column`` as ``out``.

    NULL gives NULL, '' and blank texts give ''.  A column ``out`` that exists
    is replaced.  Any length is processed whole.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    sql = form_sql(column)
    columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                result = con.sql(f'select {columns}, {sql} as "{out}" from batch').to_arrow_table()
                con.unregister("batch")
                yield from result.to_batches()

    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def same_look(left: DataFrame, right: DataFrame, left_id: str, right_id: str, scope: str, column: str) -> DataFrame:
    """Pairs (left_id, right_id) of rows of one ``scope`` whose ``column`` reads the same but is not the same string.

    Rows with NULL scope or a NULL, empty or blank text make no pair; repeated
    rows make a pair each.  Rows are first reduced to distinct (scope, text), so
    a text held by a third of all rows is normalised and compared once; ids are
    joined back only to pairs of different strings.
    """

    def texts(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(scope).alias("scope"), F.col(column).alias("text")).where("scope is not null and text is not null")
        return with_form(rows.distinct(), "text").where("form <> ''")

    def rows(df: DataFrame, key: str, text: str) -> DataFrame:
        return df.select(F.col(scope).alias("scope"), F.col(column).alias(text), F.col(key).alias(f"_{text}_id"))

    a = texts(left).withColumnRenamed("text", "left_text")
    b = texts(right).withColumnRenamed("text", "right_text")
    pairs = a.join(b, ["scope", "form"]).where("left_text <> right_text").drop("form")
    pairs = pairs.join(rows(left, left_id, "left_text"), ["scope", "left_text"])
    pairs = pairs.join(rows(right, right_id, "right_text"), ["scope", "right_text"])
    return pairs.select(F.col("_left_text_id").alias(left_id), F.col("_right_text_id").alias(right_id))
