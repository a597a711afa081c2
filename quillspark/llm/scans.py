"""Repairing text from scanned pages.

1. Running headers, footers and page numbers are found: lines at the edge of a
   page whose mask (digits and confusable glyphs folded) recurs at edges only.
2. Words are counted over the body of all pages.  A rare word and a far more
   frequent one are a candidate pair if the first is the second with plausible
   glyph confusions; pairs meet by a key of pen strokes that all confusable
   glyphs share, so no candidate is missed however many slips a word has.
3. Skip-gram vectors are learned for both words of every pair: the words around
   each occurrence are added up as hashed directions, rarer ones with more
   weight (Sahlgren's random indexing of skip-gram pairs).  Words seen once have a
   vector too, and nothing is held on the driver.
4. The vectors decide on a pair: where they are near, a small lead in frequency
   is enough, elsewhere it must be large.  Of several words the one that fits the
   words around an occurrence is taken.
5. Words cut at a line end are joined if the corpus knows the whole word, and
   the lines are set into paragraphs again.

The vocabulary is a table.  Each page asks for the words it holds and gets them
back by joins, so nothing that grows with the corpus is collected or broadcast
by hand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: What is printed and what a recogniser may read instead.
GLYPHS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("g", "q"), ("i", "l"), ("l", "i"), ("n", "ri"), ("d", "cl"), ("cl", "d"),
    ("u", "ii"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("li", "h"), ("h", "li"), ("f", "ſ"), ("s", "ſ"), ("a", "ɑ"), ("i", "ì"), ("i", "í"), ("i", "!"), ("l", "!"),
    ("c", "("), ("s", "5"), ("l", "1"), ("i", "1"), ("o", "0"), ("b", "6"), ("g", "9"), ("z", "2"), ("s", "8"), ("b", "8"), ("l", "|"), ("i", "|"), ("e", "é"), ("o", "ö"),
)
#: Letters that stand for a digit in a misread number.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "q": "9", "g": "9", "!": "1", "|": "1"}
#: Hyphens at a line end: the last two say by themselves that the word goes on.
HYPHENS, SOFT = "-‐‑­¬", "­¬"


#: Strokes of the glyphs above, the same for what is printed and what is read instead.
STROKES = str.maketrans({
    "e": "e", "c": "e", "(": "e", "é": "e", "o": "o", "0": "o", "ö": "o", "a": "a", "ɑ": "a", "g": "g", "q": "g", "9": "g", "z": "z", "2": "z",
    "i": "l", "l": "l", "1": "l", "!": "l", "|": "l", "ì": "l", "í": "l", "n": "rl", "m": "rrl", "d": "el", "w": "vv",
    "t": "ll", "f": "ll", "s": "ll", "ſ": "ll", "5": "ll", "8": "ll", "b": "ll", "6": "ll", "h": "ll", "u": "ll",
})


@dataclass(frozen=True)
class Scan:
    """Parameters.

    least: occurrences from which a word is known.  odds: times a word must be
    more frequent than the one corrected to it; ``close_odds`` are enough where
    the cosine of their vectors is at least ``close``.
    recurs, edge_share: occurrences at page edges, and their share of all, from
    which a line is furniture.  top, bottom: lines of a page that count as edge.
    size, window: of the vectors.
    """

    least: int = 6
    odds: float = 30.0
    close_odds: float = 4.0
    close: float = 0.3
    recurs: int = 4
    edge_share: float = 0.85
    top: int = 2
    bottom: int = 4
    size: int = 128
    window: int = 3
    glyphs: tuple = field(default=GLYPHS)


_EDGE = " \t.,;:?\"”“'’)]}[{%*…"
#: A letter run with a sign inside that no word has.
_ALIEN = re.compile(r"(?<=[^\W\d_])(?:[0156892!|](?=[a-zé]|$)|\((?=[a-z])|[ſɑ])|[ſɑ]|^(?:[0156892!](?=[a-z]{2,}))")
_KNOWN_MIX = re.compile(r"(?:\d+(?:st|nd|rd|th|s)|[A-Z]{1,3}\d+[A-Z]?\d*|[a-zA-Z]\d{1,3})$")
_DIGITLIKE = re.compile(r"[0-9OolIiZzSsBbGgqQ!|]+$")
_ROMAN = r"(?:[ivxl]{1,5}|[IVXL]{1,5})"
_NUMBERISH = r"(?:[0-9OolIiZzSsB!|]{1,5}|" + _ROMAN + r")"
_ROMAN_ONLY = re.compile(r"[ivxl]{1,6}$")
_PAGE_NUMBER = re.compile(rf"[\s\-–—|(\[]*(?:(?:page|p\.?|pg\.?|[Pp]agc|seite|página)\s*)?{_NUMBERISH}(?:\s*(?:of|/|ot|oſ)\s*{_NUMBERISH})?[\s\-–—|\])]*$", re.IGNORECASE)


def mask(line: str) -> str:
    """A line with numbers masked and the other tokens as their strokes."""
    out = []
    for token in line.lower().split():
        core = token.strip(_EDGE + "(")
        digits = sum(c.isdigit() for c in core)
        if core and (_ROMAN_ONLY.match(core) or digits * 2 > len(core) or (digits and _DIGITLIKE.match(core)) or (len(core) <= 2 and _DIGITLIKE.match(core))):
            out.append("#")
        else:
            out.append(strokes(token))
    return " ".join(out)


def page_number(line: str) -> bool:
    """Whether a line is nothing but a page number; a bracket that only closes belongs to the body."""
    t = line.strip()
    return bool(_PAGE_NUMBER.match(t)) and t.count("(") == t.count(")") and t.count("[") == t.count("]")


def clean(token: str) -> str:
    """A token without the punctuation around it."""
    return token.strip(_EDGE).lstrip("(").rstrip(")")


def pieces(token: str) -> list[str]:
    """The words of a token that hyphens or slashes join."""
    return [p for p in re.split(r"[-‐‑/–—]", clean(token)) if p]


def headed(line: str) -> bool:
    """Whether a wide gap sets a page number off from the rest of the line, as running heads do."""
    parts = re.split(r"[ \t]{3,}", line.strip())
    return len(parts) == 2 and sum(bool(re.fullmatch(_NUMBERISH, x)) for x in parts) == 1


@lru_cache(maxsize=8)
def _confusions(glyphs: tuple) -> dict[str, list[tuple[str, str]]]:
    """Glyphs by the first letter printed; raises if a pair doesn't keep the strokes."""
    found: dict[str, list[tuple[str, str]]] = {}
    for printed, seen in glyphs:
        if strokes(printed) != strokes(seen):
            raise ValueError(f"{printed!r} and {seen!r} have different strokes")
        found.setdefault(printed[0], []).append((printed, seen))
    return found


def strokes(word: str) -> str:
    """The pen strokes of a word: the same for a word and for all its misreadings."""
    return word.translate(STROKES)


def slips(printed: str, seen: str, glyphs: tuple = GLYPHS) -> int | None:
    """Least number of confusions that turn ``printed`` into ``seen``; None if they can't."""
    pairs = _confusions(glyphs)
    best = {(0, 0): 0}
    layer = [(0, 0)]
    # Every step goes on in the printed word, so states are visited by rising place in it.
    while layer:
        layer.sort()
        i, j = layer.pop(0)
        cost = best[i, j]
        if i == len(printed) or j == len(seen):
            continue
        steps = [(1, 1, cost)] if printed[i] == seen[j] else []
        steps += [(len(a), len(b), cost + 1) for a, b in pairs.get(printed[i], ()) if printed.startswith(a, i) and seen.startswith(b, j)]
        for di, dj, c in steps:
            at = (i + di, j + dj)
            if at not in best:
                layer.append(at)
                best[at] = c
            elif c < best[at]:
                best[at] = c
    return best.get((len(printed), len(seen)))


def plausible(printed: str, seen: str, glyphs: tuple = GLYPHS) -> bool:
    """Whether ``seen`` may be a misreading of ``printed``: at most one slip, and one more for every three letters."""
    n = slips(printed, seen, glyphs)
    return n is not None and 0 < n <= 1 + len(printed) // 3


def _repaired_number(token: str) -> str | None:
    """A token whose numbers have letters for digits, with the digits; None if it has none."""
    found = False
    out = []
    for piece in re.split(r"([-–/.,:()=<>%\[\]²])", token):
        core = piece.strip(_EDGE) if piece else piece
        if core and _letter_digits(core):
            found = True
            piece = piece.replace(core, "".join(DIGITS.get(c, c) for c in core))
        out.append(piece)
    return "".join(out) if found else None


def _letter_digits(piece: str) -> bool:
    if _DIGITLIKE.match(piece) and any(c.isdigit() for c in piece) and not piece.isdigit() and not re.match(r"\d+[sS]?$|[a-zA-Z]\d+$", piece):
        return True
    return bool(re.match(r"\d+[lOoIZzSB]$|[lOZzSIB]\d+$", piece)) and not re.match(r"(?:19|20)\d0s$|[IB]\d$", piece)


def misread_number(token: str) -> bool:
    """Whether a token is a number with letters for digits in it."""
    return _repaired_number(clean(token)) is not None


def _lines(text: str) -> list[str]:
    return re.split(r"\r\n?|\n", text)


def _edges(lines: list[str], how: Scan) -> tuple[list[int], list[int]]:
    """Places of the lines of a page that aren't blank, and of those at its edge."""
    full = [k for k, line in enumerate(lines) if line.strip()]
    return full, sorted({*full[: how.top], *full[max(0, len(full) - how.bottom) :]})


def _rows(out: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


def _few(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches cut small: a page as Python objects takes many times its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _masks(pages: DataFrame, how: Scan) -> DataFrame:
    """(page_id, path, line, mask, edge) of the lines that aren't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out: list[tuple] = []
            for page, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = _lines(text)
                full, edge = _edges(lines, how)
                edge_set = set(edge)
                # Of a line that is no edge only the count of its mask matters.
                out += [(page if k in edge_set else None, path if k in edge_set else None, k + 1, xxhash.xxh64_intdigest(mask(lines[k])) >> 1, k in edge_set) for k in full]
            yield _rows(out, "page_id path line mask edge", pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_())

    return pages.select("page_id", "path", "text").mapInArrow(run, "page_id bigint, path string, line int, mask bigint, edge boolean")


def marked_lines(lines: list[str], often: list[int] | None, how: Scan = Scan()) -> list[int]:
    """Numbers of the lines that are furniture: inwards from either edge while lines are."""
    full, _ = _edges(lines, how)
    marked = {n - 1 for n in often or []}
    hit: set[int] = set()
    for side in (full[: how.top], full[::-1][: how.bottom]):
        for k in side:
            if k not in marked and not page_number(lines[k]) and not headed(lines[k]):
                break
            hit.add(k + 1)
    return sorted(hit)


def furniture(pages: DataFrame, how: Scan = Scan()) -> DataFrame:
    """(page_id, lines, first_no, first, last): numbers of the lines that are running headers, footers and page
    numbers of each page, and its first and last line of body."""
    masks = materialise(_masks(pages, how), "masks")
    everywhere = masks.groupBy("mask").agg(F.count_if("edge").alias("edges"), F.count(F.lit(1)).alias("n")).where("edges > 0")
    by_path = masks.where("edge").groupBy("path", "mask").agg(F.count_distinct("page_id").alias("pages"))
    edges = masks.where("edge").join(everywhere, "mask").join(by_path, ["path", "mask"])
    share = F.col("edges") >= F.col("n") * how.edge_share
    only = F.col("edges") == F.col("n")
    often = edges.where(share & ((F.col("edges") >= how.recurs) | (only & (F.col("pages") >= 2))))
    flagged = often.groupBy("page_id").agg(F.collect_list("line").alias("often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for page, text, marks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                gone = marked_lines(_lines(text), marks, how)
                body = _body(text, gone)
                out.append((page, gone, body[0][0] if body else None, body[0][1] if body else None, body[-1][1] if body else None))
            yield _rows(out, "page_id lines first_no first last", pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string())

    joined = pages.select("page_id", "text").join(flagged, "page_id", "left").select("page_id", "text", "often")
    return joined.mapInArrow(run, "page_id bigint, lines array<int>, first_no int, first string, last string")


def _body(text: str, lines: list[int] | None) -> list[tuple[int, str]]:
    gone = set(lines or [])
    return [(k, line) for k, line in enumerate(_lines(text), 1) if line.strip() and k not in gone]


@dataclass
class Lexicon:
    """What the corpus knows of a page's words: how often the known ones occur, what rare ones may be misread for
    [(word, its vector or None)], the most frequent first."""

    known: dict[str, int]
    links: dict[str, list[tuple[str, list[float] | None]]]

    @classmethod
    def of(cls, entries: list[dict] | None) -> Lexicon:
        known = {e["word"]: e["n"] for e in entries or [] if e["n"]}
        links = {e["word"]: [(t["word"], t["v"]) for t in e["tos"]] for e in entries or [] if e["tos"]}
        return cls(known, links)


def _halves(first: str, second: str) -> tuple[str, str, bool]:
    """What two tokens would add to a word at a line's end, and whether a hyphen stands there."""
    last = first.strip()
    hyphen = last[-1:] in HYPHENS if last else False
    left = clean(last[:-1] if hyphen else last).lower().lstrip("(")
    return re.split(r"[-‐]", left)[-1], re.split(r"[-‐/]", clean(second).lower())[0], hyphen


def _opened(token: str) -> str | None:
    """A token that opens a bracket it doesn't close, with it, in lower case: the bracket may be a misread letter."""
    return "(" + clean(token).lower() if token[:1] == "(" and ")" not in token else None


def lookups(text: str, lines: list[int] | None, before: str | None, after: str | None) -> dict[str, int]:
    """All words a page may have to look up, with their occurrences inside of lines."""
    found: Counter[str] = Counter()
    rows = [line.split() for _, line in _body(text, lines)]
    for row in rows:
        for k, token in enumerate(row):
            inner = 0 < k < len(row) - 1
            word, opened = clean(token).lower(), _opened(token)
            if not word:
                continue
            found[opened or word] += inner
            found.setdefault(word, 0)
            for p in pieces(token):
                if p.lower() != word:
                    found[p.lower()] += inner
    ends = [*([before.split()] if before and before.strip() else []), *rows, *([after.split()] if after and after.strip() else [])]
    for row, following in zip(ends, ends[1:], strict=False):
        left, right, hyphen = _halves(row[-1], following[0])
        words = [left, right, left + right, *([f"{left}-{right}"] if hyphen else [])]
        words += [p.lower() for p in pieces(f"{clean(row[-1])[: -1 if hyphen else None]}{clean(following[0])}")]
        for w in filter(None, words):
            found.setdefault(w, 0)
    return found


def cut_word(first: str, second: str, lex: Lexicon) -> bool:
    """Whether the last token of a line goes on in the first token of the next one."""
    last, head = first.strip(), clean(second)
    if not last or not head or not (head[0].isalpha() or head[0] in "ſɑ!0156("):
        return False
    known = lex.known
    left, right, hyphen = _halves(first, second)
    if not left or not right:
        return False
    word = left + right
    whole = word in known or (len(word) > 3 and word in lex.links)
    if hyphen:
        if last[-1] in SOFT:
            return True
        if not left[-1:].isalpha() and left[-1:] not in "ſɑ!0156":
            return False
        joined, compound = known.get(word, 0), known.get(f"{left}-{right}", 0)
        if joined or compound:
            return joined > compound
        return whole or not (left in known and right in known)
    if last[-1] in _EDGE or not left.isalpha() or (left in known and right in known) or head[0].isupper():
        return False
    return word in known or (left not in known and right not in known and len(word) > 5 and whole)


def _cased(right: str, found: str) -> str:
    return right.upper() if found.isupper() and len(found) > 1 else right.capitalize() if found[:1].isupper() else right


_SIGNS = str.maketrans({b: a for a, b in reversed(GLYPHS) if len(b) == 1 and not b.isalpha()} | {"ſ": "s", "ɑ": "a", "ì": "i", "í": "i"})


def mended(token: str, around: list[str], lex: Lexicon) -> tuple[str, bool]:
    """A token as it was printed, and whether it had been misread; ``around``: the known words beside it."""
    core = clean(token)
    if not core or core.lower() in lex.known:
        return token, False
    number = _repaired_number(token)
    if number is not None:
        return number, True
    opened = _opened(token)
    if opened in lex.links:
        return token.replace(token[: 1 + len(core)], _cased(_best(lex.links[opened], around), core), 1), True
    hit = False
    for piece in pieces(token):
        low = piece.lower()
        if low in lex.known or len(low) < 2 or not any(c.isalpha() for c in low):
            continue
        mix = bool(_KNOWN_MIX.match(piece))
        alien = bool(_ALIEN.search(piece)) and not mix
        tos = lex.links.get(low) if not mix else None
        if tos:
            token = token.replace(piece, _cased(_best(tos, around), piece), 1)
        elif alien:
            token = token.replace(piece, piece.translate(_SIGNS), 1)
        hit |= alien or bool(tos)
    return token, hit


def _best(tos: list[tuple[str, list[float] | None]], around: list[str]) -> str:
    """Of several words the one whose vector fits the words around best; the most frequent one if none does."""
    if len(tos) == 1 or not around:
        return tos[0][0]
    mean = np.sum([direction(w) for w in around], axis=0)
    fit = [float(np.dot(np.asarray(v, np.float32), mean[: len(v)])) if v else 0.0 for _, v in tos]
    return tos[int(np.argmax(fit))][0]


@lru_cache(maxsize=50_000)
def direction(word: str, size: int = 128) -> np.ndarray:
    """The direction of a word as a context: random signs that depend on the word only."""
    seeds = [xxhash.xxh64_intdigest(word, seed=k) for k in range((size + 63) // 64)]
    bits = np.unpackbits(np.array(seeds, np.uint64).view(np.uint8))[:size]
    return bits.astype(np.float32) * 2 - 1


def _stream(text: str, lines: list[int] | None, wanted: set[str]) -> list[str]:
    """The words of a page's body in order; those cut at a line end as one if somebody asks for it."""
    words: list[str] = []
    held = ""
    for _, line in _body(text, lines):
        row = line.split()
        if held:
            left, right, _ = _halves(held, row[0])
            if left + right in wanted:
                words[-1:] = [left + right]
                row = row[1:]
        for token in row:
            word, opened = clean(token).lower(), _opened(token)
            words.append(opened if opened in wanted else word)
        held = row[-1] if row else ""
    return words


def vectors(pages: DataFrame, how: Scan = Scan()) -> DataFrame:
    """(word, v): unit skip-gram vectors of the words of pages (text, lines, entries) that are wanted.

    entries: ARRAY<STRUCT<word, n, wanted>> with n the occurrences of a known
    word.  The direction of each known word around an occurrence counts with
    the root of its rarity, as skip-gram's subsampling has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(list(sums.values())) if sums else np.zeros(0, np.float32)
            ends = np.arange(0, len(flat) + 1, how.size, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))], ["word", "v"])

        for batch in _few(batches):
            for text, lines, entries in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                known = {e["word"]: e["n"] for e in entries or [] if e["n"]}
                wanted = {e["word"] for e in entries or [] if e["wanted"]}
                words = _stream(text, lines, wanted)
                if not words or not wanted:
                    continue
                around = np.zeros((len(words) + 1, how.size), np.float32)
                for k, w in enumerate(words):
                    if w in known:
                        around[k + 1] = direction(w, how.size) / np.float32(known[w] ** 0.5)
                sofar = np.cumsum(around, axis=0)
                for k, w in enumerate(words):
                    if w in wanted:
                        v = sofar[min(len(words), k + how.window + 1)] - sofar[max(0, k - how.window)] - around[k + 1]
                        sums[w] = sums[w] + v if w in sums else v
            if len(sums) > 10_000:
                yield flush()
                sums.clear()
        yield flush()

    parts = pages.select("text", "lines", "entries").mapInArrow(run, "word string, v array<float>")
    whole = parts.groupBy("word").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(how.size))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select("word", F.transform("v", lambda x: F.try_divide(x, norm).cast("float")).alias("v"))


def candidates(words: DataFrame, how: Scan = Scan()) -> DataFrame:
    """(word, n, other, m): words (word, n) and those ``close_odds`` times as frequent that they may be misread for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([strokes(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["word", "strokes", "n"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [plausible(o, w, how.glyphs) for w, o in zip(batch.column("word").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    # Roman numerals consist of letters that are taken for one another.
    lettered = words.where(F.col("word").rlike(r"\p{L}") & (F.length("word") > 1) & ~F.col("word").rlike(r"^[ivxl]{1,6}$"))
    keyed = lettered.select("word", F.greatest("n", F.lit(1)).alias("n")).mapInArrow(run, "word string, strokes string, n bigint")
    heads = keyed.where((F.col("n") >= how.least) & F.col("word").rlike(_WORD)).select("strokes", F.col("word").alias("other"), F.col("n").alias("m"))
    pairs = keyed.join(heads, "strokes").where(F.col("m") >= F.col("n") * how.close_odds).select("word", "n", "other", "m")
    return pairs.mapInArrow(check, "word string, n bigint, other string, m bigint")


_WORD = r"^[\p{L}][\p{L}'’\-]*$"


def _entries(asked: DataFrame, table: DataFrame, *fields: str) -> DataFrame:
    """(page_id, entries): the rows of ``table`` (word, ...) for the words each page asks for."""
    return asked.select("page_id", "word").join(table, "word").groupBy("page_id").agg(F.collect_list(F.struct("word", *fields)).alias("entries"))


def links(pairs: DataFrame, space: DataFrame, how: Scan = Scan()) -> DataFrame:
    """(word, tos): what each word is taken to be misread for, the most frequent first, with vectors where there are several.

    The vectors decide how far a word must be behind in frequency: see
    :class:`Scan`.  A word that no known word stands around has no vector and is
    held to the larger odds.
    """
    one, other = space.select("word", F.col("v").alias("v1")), space.select(F.col("word").alias("other"), F.col("v").alias("v2"))
    both = pairs.join(one, "word", "left").join(other, "other", "left")
    near = F.aggregate(F.zip_with("v1", "v2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lead = F.col("m") / F.col("n")
    taken = both.where((lead >= how.odds) | F.coalesce(near >= how.close, F.lit(False))).select("word", "other", "m", "v2")
    # Words that are misreadings themselves are taken only where there is no other.
    poor = taken.select(F.col("word").alias("other"), F.lit(1).alias("poor")).distinct()
    ranked = taken.join(poor, "other", "left").select("word", F.struct(F.coalesce("poor", F.lit(0)).alias("poor"), (-F.col("m")).alias("m"), F.col("other").alias("word"), F.col("v2").alias("v")).alias("t"))
    tos = ranked.groupBy("word").agg(F.array_sort(F.collect_list("t")).alias("t"))
    tos = tos.select("word", F.filter("t", lambda x: x["poor"] == F.col("t")[0]["poor"]).alias("t"))
    return tos.select("word", F.transform("t", lambda x: F.struct(x["word"].alias("word"), F.when(F.size("t") > 1, x["v"]).alias("v"))).alias("tos"))


def repairs(pages: DataFrame, how: Scan = Scan()) -> tuple[DataFrame, DataFrame]:
    """What is wrong on the pages (page_id, path, page_no, text), and the pages' repaired text.

    First (page_id, line_no, kind) with the kinds furniture, split and misread;
    then (page_id, path, page_no, text, ends): paragraphs separated by a blank
    line, and whether the last one ends there.  A word cut at the end of a page is
    written on that page as a whole.  NULL, empty and blank pages have no rows in
    the first and empty text in the second; a line is counted from 1, blank ones
    included.
    """
    pages = pages.select("page_id", "path", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    own = materialise(furniture(pages, how), "furniture")
    at = pages.select("page_id", "path", "page_no").join(own, "page_id")
    # Two pages of a path may bear the same number: the least id stands for it.
    place = lambda step, *cols: at.groupBy("path", (F.col("page_no") + step).alias("page_no")).agg(*(F.min_by(F.col(c), "page_id").alias(name) for c, name in cols))
    before = place(1, ("last", "before"))
    after = place(-1, ("page_id", "next_id"), ("first_no", "next_no"), ("first", "after"))
    sheets = pages.join(own.select("page_id", "lines"), "page_id").join(before, ["path", "page_no"], "left").join(after, ["path", "page_no"], "left")
    sheets = materialise(sheets, "sheets")

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            columns = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            out = [(page, w, n) for page, text, lines, b, a in columns for w, n in lookups(text, lines, b, a).items()]
            yield _rows(out, "page_id word n", pa.int64(), pa.string(), pa.int32())

    asked = materialise(sheets.select("page_id", "text", "lines", "before", "after").mapInArrow(asks, "page_id bigint, word string, n int"), "asked")
    words = materialise(asked.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = materialise(candidates(words, how), "pairs")
    heads = words.where((F.col("n") >= how.least) & F.col("word").rlike(_WORD))
    paired = pairs.select("word").union(pairs.select("other")).distinct().withColumn("wanted", F.lit(True))
    table = heads.join(paired, "word", "full").select("word", "n", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    sought = sheets.select("page_id", "text", "lines").join(_entries(asked, table, "n", "wanted"), "page_id")
    space = materialise(vectors(sought, how), "vectors")
    found = materialise(links(pairs, space, how), "links")
    # Frequent misreadings of more frequent words don't count as known.
    table = heads.join(found, "word", "full").select("word", F.when(F.col("tos").isNull(), F.col("n")).alias("n"), "tos")
    ready = sheets.join(_entries(asked, table, "n", "tos"), "page_id", "left")

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "path", "page_no", "text", "lines", "before", "after", "next_id", "next_no", "entries")
        for batch in _few(batches):
            out = []
            for page, path, no, text, lines, b, a, next_id, next_no, entries in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                kinds, flowed, ends = repaired(text, lines, b, a, Lexicon.of(entries))
                marks = [(page, n, k) if n else (next_id, next_no, k) for n, k in kinds]
                out.append((page, path, no, [{"page_id": p, "line_no": n, "kind": k} for p, n, k in marks], flowed, ends))
            mark = pa.struct([("page_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string())])
            yield _rows(out, "page_id path page_no marks text ends", pa.int64(), pa.string(), pa.int32(), pa.list_(mark), pa.string(), pa.bool_())

    shape = "page_id bigint, path string, page_no int, marks array<struct<page_id bigint, line_no int, kind string>>, text string, ends boolean"
    ready = ready.select("page_id", "path", F.col("page_no").cast("int").alias("page_no"), "text", "lines", "before", "after", "next_id", "next_no", "entries")
    whole = materialise(ready.mapInArrow(done, shape), "repaired")
    kinds = whole.select(F.inline("marks")).where("page_id is not null").distinct()
    return kinds, whole.select("page_id", "path", "page_no", "text", "ends")


def repaired(text: str, lines: list[int] | None, before: str | None, after: str | None, lex: Lexicon) -> tuple[list[tuple[int, str]], str, bool]:
    """What is wrong on a page, (line number or 0 for the next page, kind); its body as paragraphs; whether the last one ends."""
    gone = set(lines or [])
    kinds: list[tuple[int, str]] = [(n, "furniture") for n in sorted(gone)]
    paragraphs: list[str] = []
    now: list[str] = []
    body = _body(text, lines)
    onward = after.split() if after and after.strip() else []
    skip = bool(before and before.strip() and body) and cut_word(before.split()[-1], body[0][1].split()[0], lex)
    blank, place = False, 0
    for number, line in enumerate(_lines(text), 1):
        if number in gone:
            continue
        row = line.split()
        if not row:
            blank = True
            continue
        place += 1
        following = body[place][1].split() if place < len(body) else onward
        number_next = body[place][0] if place < len(body) else 0
        cut = bool(following) and cut_word(row[-1], following[0], lex)
        fresh = line[:2] == "  " or line[:1] == "\t" or line.startswith("#")
        plain = [clean(t).lower() for t in row]
        words = []
        for k in range(1 if skip else 0, len(row) - 1 if cut else len(row)):
            token, wrong = mended(row[k], [w for w in plain[max(0, k - 3) : k + 4] if w in lex.known], lex)
            words.append(token)
            if wrong:
                kinds.append((number, "misread"))
        if cut:
            kinds.append((number, "split"))
            last = row[-1].strip()
            left = last[:-1] if last[-1] in HYPHENS else last
            token, wrong = mended(left + following[0], [w for w in plain[-4:] if w in lex.known], lex)
            words.append(token)
            if wrong:
                # The slip lies in the part that doesn't begin or end the word meant.
                start, end, meant = left.lower().lstrip("("), clean(following[0]).lower(), clean(token).lower().lstrip("(")
                kinds.append((number_next if meant.startswith(start) and not meant.endswith(end) else number, "misread"))
        if now and (blank or fresh) and not skip:
            paragraphs.append(" ".join(now))
            now = []
        # A hyphen that belongs to the word stays, and so does the word's other part beside it.
        if now and words and now[-1][-1:] in ("-", "‐") and now[-1][-2:-1].isalpha():
            now[-1] += words.pop(0)
        now += words
        skip, blank = cut, False
    if now:
        paragraphs.append(" ".join(now))
    flowed = "\n\n".join(p for p in paragraphs if p)
    return kinds, flowed, flowed[-1:] in tuple('.!?:)]”"') and not skip


def documents(repaired: DataFrame) -> DataFrame:
    """(path, text): the pages of each path in order as one text, '' if all are blank; a sentence that goes on is joined."""
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_no", "page_id", "text", "ends"))))
    pages = repaired.groupBy("path").agg(rows.alias("pages"))
    parts = F.transform("pages", lambda p, k: F.concat(p["text"], F.when(k == F.size("pages") - 1, "").when(p["ends"], "\n\n").otherwise(" ")))
    return pages.select("path", F.array_join(parts, "").alias("text"))
