"""Deduplicating new batches against all history by multi-key sorted-neighbourhood runs.

Every accepted row is filed under several sort keys: its identifiers, the words
of its title, and the title read forwards and backwards.  A *run* holds the
distinct keys of the batches it took in, sorted by workspace, key and title and
cut into files by sampled bounds; the manifest knows the range of each file.  A
batch reads the files of the ranges its own keys fall into.  Batch and history
are merged in sort order; equal keys, and titles at most a window apart from a new
one, become links, and the links' components say which accepted row a new row
belongs to.  Runs are compacted into one from time to time.

All state lies in a folder: runs, links, and manifests, of which the last one
counts, so that another session goes on where this one ended.

A row is represented by its *order*, batch number and row id in one number, so
the least order of a component is the row that was accepted first.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop_table, materialise, names_in, ranges_in, read_text, table_path, write_text
from .components import connected
from .titles import alike, read

#: Row ids take 40 bits of an order and batch numbers 23.
ID_BITS, BATCH_BITS = 40, 23


@dataclass(frozen=True)
class Neighbourhood:
    """Parameters: neighbours looked at on one side, letters by which neighbours may differ, share of the longer title that
    a shortened one must keep, least content words of a title that says what a work is, runs after which they are
    compacted, bits of a workspace by which files are chosen (so at most 2 to that power ranges exist), and files of a run
    (by default as many as its size asks for)."""

    window: int = 4
    edits: int = 3
    kept: float = 0.6
    least_words: int = 4
    runs: int = 3
    bits: int = 12
    files: int | None = None


def order(batch_no: Column, rec_id: Column) -> Column:
    """The order of a row; a NULL batch comes last.  Numbers out of range raise an error."""
    batch = F.coalesce(batch_no.cast("bigint"), F.lit((1 << BATCH_BITS) - 1))
    fits = batch.between(0, (1 << BATCH_BITS) - 1) & rec_id.between(0, (1 << ID_BITS) - 1)
    number = batch * F.lit(1 << ID_BITS) + rec_id
    return F.when(fits, number).otherwise(F.raise_error(F.lit("batch_no or rec_id out of range")).cast("bigint"))


_DOI = re.compile(r"10\.\d{4,9}/\S+")
_SUFFIX = re.compile(r"(?:[?#].*|/(?:full|pdf|abstract|html|epdf|meta)|[/.]?v\d+)$")


def plain_doi(text: str | None) -> str | None:
    """A DOI in one form, or NULL: lower case, no resolver, query, view or version, mistyped zero and slashes mended."""
    if not text:
        return None
    t = re.sub(r"/{2,}", "/", unquote(text.strip().lower()).replace("https://", "").replace("http://", ""))
    t = re.sub(r"\b1o\.", "10.", t)
    found = _DOI.search(t)
    if not found:
        return None
    doi = found[0]
    while True:
        cut = _SUFFIX.sub("", doi.rstrip(".,;:/ "))
        if cut.endswith(")") and cut.count(")") > cut.count("("):
            cut = cut[:-1]
        if cut == doi:
            return doi
        doi = cut


_CLEAN = re.compile(r"10\.\d{4,9}/[a-z0-9][a-z0-9\-_.]*(?:/[a-z0-9\-_.]+)*(?<=[a-z0-9]\d{3})")


def file_keys(rows: DataFrame, how: Neighbourhood) -> DataFrame:
    """(ord, place, keys, scope, title) of rows (ord, workspace, key, ids, title).

    place: the workspace's range.  keys: hashes of the identifiers and of the title's words within the
    workspace.  scope: hash of workspace and marker; title: the title's content
    words.  Both are NULL for generic titles.
    """
    kinds = ("openalex", "pmid", "pmcid", "arxiv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = how.least_words
        known: dict[str | None, tuple] = {}
        for batch in batches:
            dois, markers, bags, texts = [], [], [], []
            if len(known) > 50_000:
                known.clear()
            for name, doi, title in zip(*(batch.column(c).to_pylist() for c in ("key", "doi", "title")), strict=True):
                t = known.get(title)
                if t is None:
                    parts = read(title)
                    good = len(parts.words) >= least
                    t = known[title] = (parts.marker, " ".join(sorted(parts.words)), " ".join(parts.words)) if good else (None, None, None)
                markers.append(t[0])
                bags.append(t[1])
                texts.append(t[2])
                low = doi.lower() if doi else ""
                d = low if _CLEAN.fullmatch(low) else plain_doi(doi) or plain_doi(name)
                dois.append(d or (f"key {name}" if t[0] is None and name and (":" in name or len(name) >= 25) else None))
            new = [pa.array(x, pa.string()) for x in (dois, markers, bags, texts)]
            kept = ["ord", "space", *kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "plain", "marker", "bag", "words"])

    narrow = rows.select(
        "ord",
        F.xxhash64("workspace").alias("space"),
        *(F.lower(F.expr(f"nullif(ids['{k}'], '')")).alias(k) for k in kinds[:-1]),
        F.regexp_replace(F.expr("nullif(ids['arxiv'], '')"), r"v\d+$", "").alias("arxiv"),
        "key",
        F.element_at("ids", "doi").alias("doi"),
        "title",
    )
    text = ", ".join(f"{c} string" for c in (*kinds, "plain", "marker", "bag", "words"))
    filed = narrow.mapInArrow(run, f"ord bigint, space bigint, {text}")
    number = lambda kind, *values: F.when(F.col(values[-1]).isNotNull(), F.xxhash64("space", F.lit(kind), *values))
    return filed.select(
        "ord",
        F.shiftrightunsigned("space", 64 - how.bits).cast("int").alias("place"),
        F.array_compact(F.array(*(number(k, k) for k in kinds), number("doi", "plain"), number("title", "marker", "bag"))).alias("keys"),
        number("scope", "marker").alias("scope"),
        F.col("words").alias("title"),
    )


def one_each(rows: pa.Table) -> pa.Table:
    """Sorted rows (block, title, ord, new, place) with one row for each block and title: its least order, new if any of them is."""
    block, title = rows["block"].to_numpy(), rows["title"].combine_chunks()
    same = (block[1:] == block[:-1]) & pc.equal(title[1:], title[:-1]).to_numpy(zero_copy_only=False)
    if not same.any():
        return rows
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    kept = rows.take(pa.array(starts))
    for name, least in (("ord", np.minimum), ("new", np.logical_or)):
        values = pa.array(least.reduceat(rows[name].to_numpy(), starts), rows.schema.field(name).type)
        kept = kept.set_column(kept.schema.get_field_index(name), name, values)
    return kept


def close_by(rows: pa.Table, since: int, until: int, window: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of sorted rows (block, title, new) at most ``window`` apart in a block, one of them new, that may be
    close: one begins the other, or they have as many words and about as many letters.  j lies in [since, until)."""
    block, new, title = rows["block"].to_numpy(), rows["new"].to_numpy(), rows["title"].combine_chunks().cast(pa.large_string())
    letters, words = pc.utf8_length(title).to_numpy(), pc.count_substring(title, " ").to_numpy()
    ends = np.frombuffer(title.buffers()[1], np.int64)[title.offset : title.offset + len(title) + 1]
    data = np.frombuffer(title.buffers()[2] or b"", np.uint8)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in range(1, window + 1):
        j = np.arange(max(since, k), until)
        i = j - k
        met = (block[i] == block[j]) & (new[i] | new[j])
        i, j = i[met], j[met]
        alike_ = (np.abs(letters[i] - letters[j]) <= edits) & (words[i] == words[j])
        size = ends[i + 1] - ends[i]
        maybe = ~alike_ & (size > 0) & (size <= ends[j + 1] - ends[j])
        x, y, size = i[maybe], j[maybe], size[maybe]
        # The last letters, then some before, rule most of them out.
        for part in (1, 2, 4):
            spot = (size - 1) // part
            good = data[ends[x] + spot] == data[ends[y] + spot]
            x, y, size = x[good], y[good], size[good]
        begins = [n for n in range(len(x)) if title[y[n]].as_py().startswith(title[x[n]].as_py())]
        found += [(i[alike_], j[alike_]), (x[begins], y[begins])]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class History:
    """All rows accepted so far, as sorted runs in a folder that all executors share.

    A folder that holds a history is opened and goes on; without a folder a new
    one below the application's own is used, which ends with it.
    """

    def __init__(self, spark: SparkSession, how: Neighbourhood = Neighbourhood(), folder: str | None = None):
        self.spark, self.how = spark, how
        self.folder = (folder or table_path(spark, "history")).rstrip("/")
        self.state: dict = {"runs": [], "links": []}
        #: Files read by the last batch, and files there were.
        self.touched: tuple[int, int] = (0, 0)
        self.version = 0
        done = [n for n in names_in(spark, f"{self.folder}/manifest") if n.endswith(".json")]
        if done:
            self.state = json.loads(read_text(spark, f"{self.folder}/manifest/{done[-1]}"))
            self.version = int(done[-1][1:-5])

    def _commit(self) -> None:
        self.version += 1
        write_text(self.spark, f"{self.folder}/manifest/v{self.version:09d}.json", json.dumps(self.state))

    def _read(self, places: set[int] | None) -> DataFrame | None:
        """The keys of the files whose range holds one of the places; of all files for None."""
        files = [f for run in self.state["runs"] for f in run["files"]]
        met = [f["path"] for f in files if places is None or any(p in places for p in range(f["low"], f["high"] + 1))]
        self.touched = (len(met), len(files))
        if not met:
            return None
        entries = self.spark.read.schema(_ENTRY).parquet(*met)
        # Few places are picked out of their files too.
        return entries.where(F.col("place").isin(*places)) if places is not None and len(places) <= 100 else entries

    def _write(self, entries: DataFrame) -> dict:
        """Write keys as a sorted run and return what the manifest says of it."""
        path = f"{self.folder}/runs/{uuid.uuid4().hex[:12]}"
        sort = ["place", "block", "title"]
        cut = [self.how.files, *sort] if self.how.files else sort
        entries.select(*sort, "ord").repartitionByRange(*cut).sortWithinPartitions(*sort).write.option("compression", "zstd").parquet(path)
        # An entry a file: as many as a listing of the folder has.
        return {"path": path, "files": [{"path": file, "low": low, "high": high} for file, low, high in ranges_in(self.spark, path, "place")]}

    def compact(self) -> None:
        """Merge all runs into one that keeps the first order of each key."""
        if len(self.state["runs"]) < 2:
            return
        old = [run["path"] for run in self.state["runs"]]
        merged = self._read(None).groupBy("place", "block", "title").agg(F.min("ord").alias("ord"))
        self.state["runs"] = [self._write(merged)]
        self._commit()
        for path in old:
            drop_table(self.spark, path)

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Take in rows (workspace, batch_no, rec_id, key, ids, title): links (ord, root) of rows that join another.

        Rows without workspace or key are left out; '' counts as NULL.  Repeated
        rows are links like any other.  ``root`` is the first row of the
        component as far as this batch shows it; :meth:`accepted` has the last word.
        """
        how = self.how
        if len(self.state["runs"]) >= how.runs:
            self.compact()
        known = rows.where((F.col("workspace") != "") & (F.col("key") != ""))
        filed = materialise(file_keys(known.select(order(F.col("batch_no"), F.col("rec_id")).alias("ord"), "workspace", "key", "ids", "title"), how), "filed")
        exact = filed.select("ord", "place", F.explode("keys").alias("block"))
        title = F.col("title")
        # Titles are sorted within workspace and marker, forwards and backwards.
        sides = F.array(F.struct(F.xxhash64("scope", F.lit(1)).alias("block"), title.alias("title")), F.struct(F.xxhash64("scope", F.lit(2)).alias("block"), F.reverse(title).alias("title")))
        # Distinct titles of a workspace with the first row of each.
        forms = filed.where("title is not null").groupBy("place", "scope", "title").agg(F.min("ord").alias("ord"))
        fuzzy = forms.select("ord", "place", F.inline(sides))
        firsts = exact.groupBy("block").agg(F.min("place").alias("place"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
        new = materialise(
            firsts.select("place", "block", F.lit(None).cast("string").alias("title"), F.col("first").alias("ord"), "n").unionByName(fuzzy.select("place", "block", "title", "ord", F.lit(1).cast("bigint").alias("n"))), "new"
        )
        old = None
        if self.state["runs"]:
            old = self._read({r.place for r in new.select("place").distinct().collect()})  # at most 2 ** bits numbers

        # Equal keys: the first row of each key that is old or has two rows.
        mins = new.where("title is null").select("block", F.col("ord").alias("first"), "n")
        if old is not None:
            earlier = old.where("title is null").select("block", F.col("ord").alias("first"), F.lit(1).cast("bigint").alias("n"))
            touched = materialise(earlier.join(mins.select("block"), "block", "left_semi"), "touched")
            mins = mins.unionByName(touched).groupBy("block").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
            exact = exact.select("ord", "block").unionByName(touched.select(F.col("first").alias("ord"), "block"))
        hits = exact.join(mins.where("n > 1"), "block")
        rowed = materialise(hits.groupBy("ord").agg(F.min("first").alias("best"), F.collect_set("first").alias("firsts")), "rowed")
        bridges = rowed.where("size(firsts) > 1").select(F.explode("firsts").alias("a"), F.col("best").alias("b"))

        near = self._neighbours(new.where("title is not null"), None if old is None else old.where("title is not null"))
        odd = materialise(bridges.union(near).where("a <> b").distinct(), "bridges")
        # Rows that others lead to but that lead on themselves.
        moving = rowed.where("ord <> best").select(F.col("ord").alias("a"), F.col("best").alias("b"))
        ends = odd.select("a").union(odd.select("b")).union(moving.select("b")).distinct()
        inner = moving.join(ends, "a", "left_semi")
        roots = materialise(connected(odd.union(inner), "roots"), "roots")
        direct = moving.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").select(F.col("a").alias("ord"), F.coalesce("root", "b").alias("root"))
        links = direct.union(roots.select(F.col("node").alias("ord"), "root")).where("ord <> root").distinct()
        path = f"{self.folder}/links/{uuid.uuid4().hex[:12]}"
        links.write.option("compression", "zstd").parquet(path)
        self.state["links"].append(path)
        self.state["runs"].append(self._write(new))
        self._commit()
        return self.spark.read.schema(_LINK).parquet(path)

    def _neighbours(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """Links (a, b) between close titles at most ``window`` places apart in sort order, one of them new.

        The order is cut by sampled bounds, so a workspace of any size is spread
        over tasks; the first and last rows of each part are compared across its borders.
        """
        how = self.how
        rows = new.select("block", "title", "ord", F.lit(True).alias("new"), "place")
        if old is not None:
            rows = rows.unionByName(old.select("block", "title", "ord", F.lit(False).alias("new"), "place"))

        def pairs(batches: Iterator[pa.RecordBatch], borders: bool) -> Iterator[pa.RecordBatch]:
            # The last rows seen: the first ``done`` of them have had their pairs, the one after them may go on in the next batch.
            rest, done, total = None, 0, 0
            edge: list[pa.Table] = []
            empty = lambda n, kind: pa.nulls(n, kind)

            def packed(*columns: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
                flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(flat, kinds, strict=True)], ["a", "b", "s", "t", "place", "block", "new"])

            for batch in chain(batches, [None]):
                if batch is not None:
                    if not batch.num_rows:
                        continue
                    more = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
                    rest = pa.concat_tables([rest, more]) if rest is not None else more
                elif rest is None:
                    return
                table = one_each(rest).combine_chunks()
                until = table.num_rows - (batch is not None)
                i, j = (table.take(pa.array(x)) for x in close_by(table, done, until, how.window, how.edits))
                yield packed(i["ord"], j["ord"], i["title"], j["title"], *(empty(i.num_rows, k) for k in (pa.int32(), pa.int64(), pa.bool_())))
                if total < how.window:
                    edge.append(table.slice(done, min(until - done, how.window - total)))
                total += until - done
                since = max(0, until - how.window)
                rest, done = table.slice(since), until - since
            if borders:
                tail = min(how.window, max(0, total - how.window))
                rim = pa.concat_tables([*edge, rest.slice(rest.num_rows - tail)])
                yield packed(rim["ord"], empty(rim.num_rows, pa.int64()), empty(rim.num_rows, pa.string()), rim["title"], rim["place"], rim["block"], rim["new"])

        shape = "a bigint, b bigint, s string, t string, place int, block bigint, new boolean"
        sort = ["place", "block", "title"]
        inside = materialise(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(lambda x: pairs(x, True), shape), "pairs")
        # At most twice the window for each part, however many rows it has.
        rim = inside.where("block is not null").select("block", F.col("t").alias("title"), F.col("a").alias("ord"), "new", "place")
        across = rim.repartition(1).sortWithinPartitions(*sort).mapInArrow(lambda x: pairs(x, False), shape)
        met = inside.where("b is not null").select("a", "b", "s", "t").union(across.select("a", "b", "s", "t"))
        s, t = F.col("s"), F.col("t")
        short, long = F.least(F.length(s), F.length(t)), F.greatest(F.length(s), F.length(t))
        inner = (t.startswith(s) | s.startswith(t)) & (short >= long * how.kept)
        # A slip of the pen changes a word a little; another name is another work.
        words = F.zip_with(F.split(s, " "), F.split(t, " "), lambda x, y: (x == y) | alike(x, y))
        typed = (long - short <= how.edits) & (F.levenshtein(s, t, how.edits) >= 0) & F.forall(words, lambda same: F.coalesce(same, F.lit(False)))
        return met.where(inner | typed).select(F.col("b").alias("a"), F.col("a").alias("b"))

    def accepted(self) -> DataFrame:
        """(ord, root) of every row taken in that isn't the first of its work, over all batches."""
        paths = self.state["links"]
        if not paths:
            return self.spark.createDataFrame([], _LINK)
        links = self.spark.read.schema(_LINK).parquet(*paths)
        if len(paths) > 1:
            edges = links.select(F.col("ord").alias("a"), F.col("root").alias("b"))
            # Only roots that another link leads on from need their component found.
            inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            several = edges.join(edges.groupBy("a").count().where("count > 1").select("a"), "a", "left_semi")
            roots = materialise(connected(inner.union(several), "late"), "late")
            led = edges.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").select(F.col("a").alias("ord"), F.coalesce("root", "b").alias("root"))
            links = led.union(roots.select(F.col("node").alias("ord"), "root")).where("ord <> root").distinct()
        return links


_ENTRY = "place int, block bigint, title string, ord bigint"
_LINK = "ord bigint, root bigint"


def rec_id(ord: Column) -> Column:
    """The row id in an order."""
    return ord.bitwiseAND(F.lit((1 << ID_BITS) - 1))


def repeats(corpus: DataFrame, epochs: list[tuple[int | None, int | None]], how: Neighbourhood = Neighbourhood()) -> DataFrame:
    """(rec_id, accepted): every later row of a work with the row accepted first, taking batches in by epochs.

    epochs: ranges [from, to) of batch_no in rising order, None for no bound;
    rows without batch_no come with the last.
    """
    history = History(corpus.sparkSession, how)
    for since, until in epochs:
        part = corpus
        if since is not None:
            part = part.where((F.col("batch_no") >= since) | F.col("batch_no").isNull() if until is None else F.col("batch_no") >= since)
        if until is not None:
            part = part.where(F.col("batch_no") < until)
        history.ingest(part)
    return history.accepted().select(rec_id(F.col("ord")).alias("rec_id"), rec_id(F.col("root")).alias("accepted"))
