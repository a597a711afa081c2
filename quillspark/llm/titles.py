"""What identifies a work in its title: content words, marker and q-gram vector.

A title is brought to one form (look-alikes mapped, accents, case, markup and
punctuation dropped).  Its *marker* (correction, part, wave, sample, year at the
end ...) tells works of their own apart that share all other words; its content
words are what remains without function words; its vector has a bit for each
padded bigram of each content word, so that order, function words and one
mistyped letter change few bits or none.
"""

from __future__ import annotations

import html
import re
import struct
import unicodedata
import zlib
from functools import cache, lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookalikes import INVISIBLE, tables

#: Bits of a title's vector and of the chunks by which it is indexed.
BITS, CHUNK = 256, 32
#: Words that carry no meaning of their own in a title.
FUNCTION_WORDS = frozenset("a an the of in on at by for from to and or with under after before as is are its into".split())
_NUMBERS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "one": 1, "two": 2, "three": 3, "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5}
_NUMBER = r"(?:\d{1,4}|[ivx]{1,4}|one|two|three|first|second|third|fourth|fifth)"
#: Openings of titles that make a work of its own about another work.
_OPENINGS = re.compile(
    r"^(?P<kind>correction|corrigendum|erratum|reply|response|authors? reply|comments?|commentary|retraction|protocol|withdrawal|expression of concern|review of|editorial)"
    r"(?: notice| to comments?| to| of| on| for)*(?: on| to| for)? ?[:.\-–—] ?"
)
#: Endings that name a part, sample, time or plan of a work.
_ENDINGS = [
    ("part", re.compile(rf"[ :,.\-–—(\[]*\b(?:part|pt\.?) (?P<n>{_NUMBER})[)\]]?$")),
    ("volume", re.compile(rf"[ :,.\-–—(\[]*\b(?:volume|vol\.?|issue|no\.?) (?P<n>{_NUMBER})[)\]]?$")),
    ("wave", re.compile(rf"[ :,.\-–—(\[]*\b(?P<n>{_NUMBER}) (?:wave|phase|round)[)\]]?$")),
    ("wave", re.compile(rf"[ :,.\-–—(\[]*\b(?:wave|phase|round) (?P<n>{_NUMBER})[)\]]?$")),
    ("year", re.compile(r"[ :,.\-–—(\[]+(?P<n>(?:19|20)\d\d)[)\]]?$")),
    ("in", re.compile(r"[ ,:\-–—(]+in (?P<n>women|men|girls|boys|males|females|spring|summer|autumn|fall|winter)\)?$")),
    ("plan", re.compile(r"[ :,.\-–—(\[]+(?:a )?(?P<n>statistical analysis plan|study protocol|analysis plan|protocol)[)\]]?$")),
    ("sample", re.compile(r"[ :,.\-–—(\[]+(?:the )?(?P<n>[a-z]+ sample)[)\]]?$")),
    ("time", re.compile(r"[ :,.\-–—(\[]+(?P<n>baseline|follow[ -]?up|endline)[)\]]?$")),
    ("number", re.compile(r"[ :,.\-–—(\[]+(?P<n>i|ii|iii|iv|\d{1,2})$")),
]
#: Endings that name a version of the same work.
_VERSION = re.compile(r"[ :,.\-–—]*[(\[](?:preprint|version \d+|v\d+|accepted manuscript|online first|epub.*)[)\]]$")
#: Last words of the endings above: other titles need not be searched for them.
_LAST = frozenset("women men girls boys males females spring summer autumn fall winter plan protocol sample baseline followup up endline wave phase round i ii iii iv v vi".split())
_FIRST = ("corr", "erra", "repl", "resp", "auth", "comm", "retr", "prot", "with", "expr", "revi", "edit")
_pieces = re.compile(r"[\W_]+(?=.)").split
_TAG = re.compile(r"</?[a-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: What stands between the words of an ASCII text.
_SPACED = bytes(n if chr(n).isalnum() else 32 for n in range(256))
#: The look-alikes are all beyond ASCII.
_BEYOND = re.compile("[^\x00-\x7f]+")


class Title(NamedTuple):
    """words: content words in order; marker: '' for none; cut: the title ends in an ellipsis."""

    words: tuple[str, ...]
    marker: str
    cut: bool


@cache
def _map() -> dict[int, str | None]:
    chars, images, many = tables()
    return str.maketrans(chars, images) | {ord(c): image for c, image in many}


_hidden = re.compile(INVISIBLE)
_MARKS = re.compile("[\u0300-\u036f]+")
#: Greek letters that stand alone are spelled out, as in beta-carotene.
_GREEK_NAMES = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ω": "omega"}
_GREEK = re.compile(r"(?<![^\W\d_])[αΑβΒγΓδΔωΩ](?![^\W\d_])")


def _cyrillic(text: str) -> bool:
    return sum("Ѐ" <= c <= "ӿ" for c in text) * 3 > len(text)


def read(title: str | None) -> Title:
    """The parts of a title; NULL, '' and titles without letters have no words."""
    t = title or ""
    if "&" in t:
        t = html.unescape(t).replace("&", " and ")
    if not t.isascii():
        t = _GREEK.sub(lambda found: _GREEK_NAMES[found[0].lower()], _hidden.sub("", t))
        t = _BEYOND.sub(lambda found: found[0].translate(_map()), unicodedata.normalize("NFC", t))
        t = _MARKS.sub("", unicodedata.normalize("NFD", t))
        t = t.replace("ø", "o").replace("Ø", "O")
    t = t.lower()
    if "<" in t:
        t = _TAG.sub("", t)
    t = " ".join(t.split())
    if t[:1] == "[" and t.rstrip(".")[-1:] == "]":
        t = t.rstrip(".")[1:-1]
    cut = t.endswith("...")
    t = t.strip(" .;,")
    marks: list[str] = []
    for _ in range(4):
        if t[:1] == "[" and t[-1:] == "]" and "[" not in t[1:]:
            t = t[1:-1].strip(" .;,")
        if t[-1:] in ")]" and (found := _VERSION.search(t)):
            t = t[: found.start()].strip(" .;,")
            continue
        last = _pieces(t[-14:])[-1].rstrip(")]")
        if not cut and (last in _LAST or last[-1:].isdigit()):
            for kind, pattern in _ENDINGS:
                found = pattern.search(t)
                if found and found.start() > 0:
                    n = found["n"]
                    marks.append(f"{kind} {_NUMBERS.get(n, n)}".replace("follow up", "follow-up").replace("followup", "follow-up"))
                    t = t[: found.start()].strip(" .;,")
                    break
            else:
                break
        else:
            break
    for _ in range(2):
        if t.startswith(_FIRST) and (found := _OPENINGS.match(t)):
            marks.append(found["kind"].rstrip("s"))
            t = t[found.end() :]
    found_words = t.encode().translate(_SPACED).decode().split() if t.isascii() else _WORD.findall(t)
    words = tuple([w for w in found_words if w not in FUNCTION_WORDS])
    return Title(words, "+".join(sorted(set(marks))), cut)


@lru_cache(maxsize=200_000)
def _bits(word: str) -> int:
    padded, bits = f"_{word}_", 0
    for i in range(len(padded) - 1):
        bits |= 1 << (zlib.crc32(padded[i : i + 2].encode()) * 2654435761 % 4294967291 % BITS)
    return bits


def vector(words: tuple[str, ...]) -> int:
    """The title's bits as one number."""
    bits = 0
    for word in words:
        bits |= _bits(word)
    return bits


def quarters(bits: int) -> list[int]:
    """The bits as four signed 64-bit numbers."""
    return list(struct.unpack("<4q", bits.to_bytes(BITS // 8, "little")))


def alike(a: Column, b: Column) -> Column:
    """Two words are the same but for one letter, two that changed places, or an ending of two."""
    letters = lambda w: F.array_sort(F.split(w, ""))
    away = F.levenshtein(a, b, 2)
    return away.isin(0, 1) | ((away == 2) & ((letters(a) == letters(b)) | a.startswith(b) | b.startswith(a)))
