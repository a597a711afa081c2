"""The faceted and boolean search languages, sorting, paging, grouping, sampling and field selection."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of paging.
PER_PAGE, MOST_PER_PAGE = 25, 100


class SearchError(ValueError):
    """A request that names an unknown field or can't be read."""


def _field(df: DataFrame, name: str) -> Column:
    if name.split(".")[0] not in df.columns:
        raise SearchError(f"unknown field {name!r}; there are {', '.join(df.columns)}")
    return F.col(name)


def terms(column: Column, query: str) -> Column:
    """Every word of the query stands in the text, as a word, in any case."""
    found = F.lit(True)
    for word in re.findall(r"\w+", query.lower()):
        found &= F.regexp_like(F.lower(column), F.lit(rf"\b{word}\b"))
    return found


def _kind(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The column that a path begins with, and its type; raises for an unknown one."""
    root = path.split(".")[0]
    column = _field(df, root)
    return column, df.schema[root].dataType


def member(column: Column, kind: T.DataType, path: list[str], test: Callable[[Column, T.DataType], Column]) -> Column:
    """Whether a value at a path of nested structs and arrays passes a test; in an array one element is enough."""
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: F.coalesce(member(x, kind.elementType, path, test), F.lit(False)))
    if path:
        if not isinstance(kind, T.StructType) or path[0] not in kind.names:
            raise SearchError(f"no field {path[0]!r} in {kind.simpleString()}")
        return member(column[path[0]], kind[path[0]].dataType, path[1:], test)
    return test(column, kind)


def _legal(capabilities: dict[str, set[str]] | None, field: str, use: str) -> None:
    """Raises unless a field may be used so; without capabilities every use is allowed."""
    if capabilities is not None and use not in capabilities.get(field, ()):
        raise SearchError(f"{field!r} can't be used to {use}")


def linked(df: DataFrame, edges: DataFrame, key: str, relation: str, ids: list[str]) -> DataFrame:
    """Rows that cite one of ``ids``, are cited by one, or are related to one, by the edges (citing, cited)."""
    here, there = {"cites": ("citing", "cited"), "cited_by": ("cited", "citing"), "related_to": ("citing", "cited")}[relation]
    ends = edges.select(F.col(here).alias("_h"), F.col(there).alias("_t"))
    if relation == "related_to":
        ends = ends.union(ends.select("_t", "_h"))
    wanted = ends.where(F.col("_t").cast("string").isin(*ids)).select(F.col("_h").cast("string").alias("_h"))
    return df.withColumn("_h", F.col(key).cast("string")).join(wanted, "_h", "left_semi").drop("_h")


def filtered(df: DataFrame, request: str, edges: DataFrame | None = None, key: str = "id", capabilities: dict[str, set[str]] | None = None) -> DataFrame:
    """Rows that meet all parts of 'field:value,field:>value,has_field:true,from_field:date,field.search:words,cites:id'.

    A comma separates parts, so a value can't hold one.  Comparisons take >, <,
    >= and <=; '!' negates; '|' lists alternatives; field_starts_with is a prefix;
    field.part.part reaches into structs and arrays, of which one element must
    pass; 'a+b.search' searches several fields; cites, cited_by and related_to
    follow ``edges`` (citing, cited) of the column ``key``.  capabilities: uses
    (filter, sort, group) by field; other uses raise.
    """
    found = F.lit(True)
    for part in filter(None, request.split(",")):
        name, colon, value = part.partition(":")
        if not colon:
            raise SearchError(f"no value in {part!r}")
        if name in ("cites", "cited_by", "related_to") and edges is not None:
            df = linked(df, edges, key, name, value.split("|"))
            continue
        _legal(capabilities, name, "filter")
        if name.startswith("has_"):
            test = _field(df, name[4:]).isNotNull()
            found &= test if value == "true" else ~test
        elif (bound := re.match(r"(from|to)_(.+)$", name)) and bound[2].split(".")[0] in df.columns:
            since, field = bound[1], bound[2]
            column = _field(df, field)
            limit = F.lit(value).cast(df.select(field).schema[0].dataType)
            found &= column >= limit if since == "from" else column <= limit
        elif name.endswith("_starts_with"):
            found &= F.startswith(_field(df, name.removesuffix("_starts_with")), F.lit(value))
        elif name.endswith(".search"):
            fields = name.removesuffix(".search").split("+")
            found &= terms(F.concat_ws(" ", *(_field(df, f) for f in fields)) if len(fields) > 1 else _field(df, fields[0]), value)
        else:
            op, text = re.match(r"(!|>=|<=|>|<)?(.*)", value, re.DOTALL).groups()

            def test_of(column: Column, kind: T.DataType, op: str | None = op, text: str = text) -> Column:
                if op in (">", "<", ">=", "<="):
                    number = F.lit(text).cast(kind)
                    return {">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number}[op]
                if isinstance(kind, T.BooleanType):
                    return column == F.lit(text == "true")
                return column.isin(*(F.lit(x).cast(kind) for x in text.split("|")))

            column, kind = _kind(df, name)
            test = member(column, kind, name.split(".")[1:], test_of)
            found &= ~test if op == "!" else test
    return df.where(found)


def by_ids(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Rows whose key is in a comma list."""
    return df.where(F.col(key).cast("string").isin(*(i.strip() for i in ids.split(",") if i.strip())))


_TOKEN = re.compile(r'\s*(?:(\()|(\))|(\w+):\[(\S+) TO (\S+)\]|(?:(\w+):)?(?:"([^"]*)"|([^\s()]+)))')


def boolean(
    fields: dict[str, list[str]], query: str, dates: dict[str, Callable[[Column, str, str], Column]] | None = None, equal: dict[str, Callable[[str], Column]] | None = None
) -> Column:
    """Condition of 'ti:word AND (au:"a phrase" OR all:word) ANDNOT field:[from TO to]'.

    fields: columns of each prefix; a term without one searches 'all'.  equal:
    conditions of prefixes whose value is compared as a whole.  AND and ANDNOT
    (also NOT and AND NOT) bind more tightly than OR; terms side by side are joined
    by OR.
    """
    tokens: list[tuple] = []
    at = 0
    text = query.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise SearchError(f"can't read {text[at:]!r}")
        tokens.append(found.groups())
        at = found.end()
    place = 0

    def peek() -> tuple | None:
        return tokens[place] if place < len(tokens) else None

    def word() -> str | None:
        t = peek()
        return t[7] if t and not t[5] and t[7] in ("AND", "OR", "ANDNOT", "NOT") else None

    def term() -> Column:
        nonlocal place
        t = peek()
        if t is None or t[1] or word():
            raise SearchError(f"a term is missing in {query!r}")
        place += 1
        if t[0]:
            inner = either()
            if not peek() or not peek()[1]:
                raise SearchError(f"a bracket isn't closed in {query!r}")
            place += 1
            return inner
        if t[2]:
            between = (dates or {}).get(t[2])
            if between is None:
                raise SearchError(f"{t[2]!r} has no range")
            return between(t[3], t[4])
        if t[5] in (equal or {}):
            return F.coalesce(equal[t[5]](t[6] if t[6] is not None else t[7]), F.lit(False))
        columns = fields.get(t[5] or "all")
        if columns is None:
            raise SearchError(f"unknown prefix {t[5]!r}")
        needle = F.lit((t[6] if t[6] is not None else t[7]).lower())
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        return hit

    def both() -> Column:
        nonlocal place
        left = term()
        while word() in ("AND", "ANDNOT", "NOT"):
            op = word()
            place += 1
            if op == "AND" and word() == "NOT":
                op = "ANDNOT"
                place += 1
            right = term()
            left = left & right if op == "AND" else left & ~right
        return left

    def either() -> Column:
        nonlocal place
        left = both()
        while peek() and not peek()[1]:
            if word() == "OR":
                place += 1
            left = left | both()
        return left

    condition = either()
    if place != len(tokens):
        raise SearchError(f"a bracket too many in {query!r}")
    return condition


def europepmc(df: DataFrame, query: str, flags: dict[str, str], texts: list[str]) -> DataFrame:
    """Rows of a query such as 'OPEN_ACCESS:y AND (DOI:"x" OR EXT_ID:5) NOT SRC:PPR words'.

    flags: column of each predicate; y and n stand for a value that is there and one
    that is missing or false.  Other terms are looked for in ``texts``.  A query that
    doesn't mention open access is held to it where that predicate is known.
    """
    if "OPEN_ACCESS" in flags and "OPEN_ACCESS:" not in query.upper():
        query = f"({query}) AND OPEN_ACCESS:y"
    kinds = dict(df.dtypes)

    def equals(column: str) -> Callable[[str], Column]:
        there = F.coalesce(F.col(column), F.lit(False)) if kinds[column] == "boolean" else F.col(column).isNotNull()
        return lambda value: there if value.lower() == "y" else ~there if value.lower() == "n" else F.col(column).cast("string") == value

    return df.where(boolean({"all": texts}, query, equal={name: equals(c) for name, c in flags.items()}))


def listed(df: DataFrame, key: str, start: int = 0, most: int = 10, by: str | None = None, order: str = "descending") -> DataFrame:
    """``most`` rows from place ``start`` on, by a column and its order, ties and no column by ``key``."""
    ways = [] if by is None else [_field(df, by).asc_nulls_last() if order == "ascending" else _field(df, by).desc_nulls_last()]
    return df.orderBy(*ways, F.col(key)).offset(max(0, start)).limit(most)


def asked(df: DataFrame, key: str, search: Column | None = None, filter: str | None = None, group_by: str | None = None, sample: int | None = None, seed: int = 0, select: str | None = None, sort: str | None = None, number: int = 1, size: int = PER_PAGE, **how) -> DataFrame:
    """A whole request.  Sorting a sample is ignored with a warning; samples and groups have no pages; ``how`` goes to :func:`filtered`."""
    found = df if search is None else df.where(search)
    if filter:
        found = filtered(found, filter, key=key, **how)
    if group_by is not None:
        _legal(how.get("capabilities"), group_by, "group")
        return grouped(found, group_by)
    if sample is not None:
        if sort is not None:
            warnings.warn("a sample isn't sorted", stacklevel=2)
        found = sampled(found, key, sample, seed)
    else:
        if sort is not None:
            _legal(how.get("capabilities"), sort.split(":")[0], "sort")
        found = page(found, sort or f"{key}:asc", key, number, size)
    return selected(found, select) if select else found


def any_hit(df: DataFrame) -> DataFrame:
    """One row (hit): whether there is a row at all; no more than one is read."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("hit"))


def pilot(df: DataFrame, key: str, n: int = 20, above: int = 50, seed: int = 0) -> DataFrame:
    """A sample to try screening on if the pool has more than ``above`` rows, else the pool."""
    return sampled(df, key, n, seed) if df.limit(above + 1).count() > above else df


def page(df: DataFrame, sort: str, key: str, number: int = 1, size: int = PER_PAGE) -> DataFrame:
    """A page of rows by 'field:asc|desc', ties by ``key``; the size is held between 1 and 100."""
    name, _, way = sort.partition(":")
    column = _field(df, name)
    size = max(1, min(MOST_PER_PAGE, size))
    return df.orderBy(column.desc_nulls_last() if way == "desc" else column.asc_nulls_first(), F.col(key)).offset((max(1, number) - 1) * size).limit(size)


def grouped(df: DataFrame, field: str) -> DataFrame:
    """(value, n): rows of each value, or of each element of an array field."""
    column = _field(df, field)
    if dict(df.dtypes).get(field, "").startswith("array"):
        column = F.explode(F.array_distinct(column))
    return df.select(column.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the same for the same seed: those with the least hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)


def selected(df: DataFrame, fields: str) -> DataFrame:
    """The fields of a comma list; nested ones keep their last name."""
    return df.select(*(_field(df, f.strip()) for f in fields.split(",")))
