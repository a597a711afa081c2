"""Filling containers of fixed capacity with texts by a grouping genetic algorithm.

Items are spread over shards by a hash of their id, so a shard's size doesn't
depend on the corpus.  Several islands evolve packings of each shard; crossover
injects whole well-filled bins of one parent into another, drops the bins that
hold the same items and best-fits the displaced items.  Between epochs the
islands of a shard pass their elite on to their neighbour.  The bins that stay
too empty are dissolved and their items packed again in other shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialise
from .encoding import TOKENIZERS, encoder


@dataclass(frozen=True)
class Evolution:
    """Parameters: items (at least) and bins (about) of a shard, islands, population, generations of an epoch,
    epochs, share of the items' lower bound from which a packing is good enough, fill under which a bin is
    dissolved, and rounds of packing dissolved bins again."""

    shard_items: int = 500
    shard_bins: int = 150
    islands: int = 2
    population: int = 6
    generations: int = 8
    epochs: int = 2
    dissolve_below: float = 0.97
    rounds: int = 3


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, n_tokens): tokens of each whole text; 0 for NULL and empty texts."""
    rows = df.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = to_arrow_type(rows.schema["doc"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode_ordinary
        for batch in batches:
            counts = [len(encode(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(counts, pa.int64())], ["doc", "n_tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("n_tokens", T.LongType())]))


class _Shard:
    """Packings of one shard: an array with the bin of each item."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.random = sizes, capacity, np.random.default_rng(seed)
        self.least = max(1, -(-int(sizes.sum()) // capacity))

    def fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Put ``items``, which have no bin (-1), each into the fullest bin with room for it, in the order given."""
        used = bins >= 0
        fills = np.bincount(bins[used], weights=self.sizes[used]).astype(int).tolist() if used.any() else []
        room = sorted((self.capacity - fill, k) for k, fill in enumerate(fills))
        count = len(fills)
        sizes = self.sizes
        for item in items.tolist():
            size = int(sizes[item])
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
            else:
                left, k = self.capacity, count
                count += 1
            bins[item] = k
            insort(room, (left - size, k))
        return bins

    def compact(self, bins: np.ndarray) -> np.ndarray:
        """Number the bins from 0 without gaps; -1 stays."""
        used = bins >= 0
        bins[used] = np.unique(bins[used], return_inverse=True)[1]
        return bins

    def by_size(self, items: np.ndarray, noise: float = 0.0) -> np.ndarray:
        """Items in falling order of size; noise blurs the order."""
        sizes = self.sizes[items] * (1 + noise * self.random.standard_normal(len(items))) if noise else self.sizes[items]
        return items[np.argsort(-sizes, kind="stable")]

    def fitness(self, bins: np.ndarray) -> float:
        """Fewer bins first; among equals the mean squared fill, which favours full bins beside one empty one."""
        fill = np.bincount(bins, weights=self.sizes) / self.capacity
        return float((fill**2).mean()) - (len(fill) - self.least)

    def cross(self, into: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of ``of`` into ``into``."""
        fill = np.bincount(of, weights=self.sizes)
        chance = (fill / self.capacity) ** 8 * 0.5
        chosen = self.random.random(len(fill)) < chance
        injected = chosen[of]
        child = into.copy()
        hit = np.zeros(into.max() + 1, bool)
        hit[into[injected]] = True
        displaced = hit[into] & ~injected
        child[hit[into]] = -1
        child[injected] = of[injected] + len(hit)
        return self.fit(self.compact(child), self.by_size(np.flatnonzero(displaced), 0.02))

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest bins and a few others."""
        fill = np.bincount(bins, weights=self.sizes)
        drop = np.zeros(len(fill), bool)
        drop[np.argsort(fill)[: max(2, len(fill) // 20)]] = True
        drop[self.random.integers(0, len(fill), max(1, len(fill) // 20))] = True
        child = bins.copy()
        free = drop[bins]
        child[free] = -1
        return self.fit(self.compact(child), self.by_size(np.flatnonzero(free), 0.1))

    def evolve(self, elites: list[np.ndarray], how: Evolution) -> np.ndarray:
        everything = np.arange(len(self.sizes))
        start = lambda noise: self.fit(np.full(len(everything), -1), self.by_size(everything, noise))
        people = [np.asarray(e, dtype=np.int64) for e in elites] or [start(0.0)]
        best = max(people, key=self.fitness)
        if best.max() + 1 <= self.least:
            return best
        while len(people) < how.population:
            people.append(start(0.05 * len(people)))
        scores = [self.fitness(p) for p in people]
        for _ in range(how.generations):
            for _ in range(how.population):
                a, b, c, d = self.random.integers(0, len(people), 4)
                mother = a if scores[a] >= scores[b] else b
                father = c if scores[c] >= scores[d] else d
                child = self.mutate(people[mother]) if mother == father else self.cross(people[mother], people[father])
                score = self.fitness(child)
                worst = int(np.argmin(scores))
                if score > scores[worst]:
                    people[worst], scores[worst] = child, score
            best = people[int(np.argmax(scores))]
            if best.max() + 1 <= self.least:
                break
        return best


_STATE = "pack int, shard int, island int, bins array<int>, fitness double"


def _epoch(rows: DataFrame, how: Evolution, epoch: int) -> DataFrame:
    """One epoch of the rows (pack, shard, island, capacity, items, elites)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for row in frame.itertuples():
                seed = (int(row.pack) * 1_000_003 + int(row.shard)) * 64 + int(row.island) * 8 + epoch
                shard = _Shard(np.asarray(row.sizes, dtype=np.int64), int(row.capacity), seed)
                bins = shard.evolve(list(row.elites) if row.elites is not None else [], how)
                done.append((row.pack, row.shard, row.island, bins.tolist(), shard.fitness(bins)))
            yield pd.DataFrame(done, columns=["pack", "shard", "island", "bins", "fitness"])

    return rows.select("pack", "shard", "island", "capacity", F.col("items.size").alias("sizes"), "elites").mapInPandas(run, _STATE)


def _round(items: DataFrame, counts: dict[int, int], how: Evolution, number: int) -> DataFrame:
    """Pack items (pack, capacity, doc, piece, size): the same rows with bin and the bin's fill.

    counts: items by pack, whose number the table of capacities bounds.
    """
    shards = F.create_map(*(F.lit(int(x)) for kv in counts.items() for x in kv))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("doc", "piece", F.lit(number)), shards[F.col("pack")]).cast("int"))
    grouped = spread.groupBy("pack", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("doc", "piece", "size"))).alias("items"))
    grouped = materialise(grouped, f"shards-{number}")
    elites = None
    for epoch in range(how.epochs):
        if elites is None:
            ready = grouped.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1)))).withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            moved = elites.withColumn("island", F.explode(F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(how.islands))))))
            ready = grouped.join(moved.groupBy("pack", "shard", "island").agg(F.array_sort(F.collect_list("bins")).alias("elites")), ["pack", "shard"])
        # A packing takes seconds of CPU and few bytes: spread by number, not by size.
        ready = ready.repartition(ready.sparkSession.sparkContext.defaultParallelism * 4, "pack", "shard", "island")
        elites = materialise(_epoch(ready, how, epoch), f"elites-{number}-{epoch}")
    best = elites.groupBy("pack", "shard").agg(F.max_by("bins", F.struct("fitness", -F.col("island"))).alias("bins"))
    placed = grouped.join(best, ["pack", "shard"])
    placed = placed.select("pack", "capacity", "shard", F.inline(F.arrays_zip(F.col("items"), F.col("bins"))))
    placed = placed.select("pack", "capacity", "items.*", F.concat(F.lit(f"r{number}-"), "shard", F.lit("-"), "bins").alias("bin"))
    fill = placed.groupBy("pack", "bin").agg(F.sum("size").alias("fill"))
    return placed.join(fill, ["pack", "bin"])


def pack(sizes: DataFrame, packs: DataFrame, how: Evolution = Evolution()) -> DataFrame:
    """Lay texts of ``sizes`` (doc, n_tokens) into containers of each of ``packs`` (pack, capacity).

    Result: pack, capacity, bin, doc, piece, start, size: the tokens
    [start, start + size) of ``doc`` lie in container ``bin`` of ``pack``.  A
    text longer than the capacity is cut into full pieces, which fill a
    container each, and a rest; others are never cut.  Texts without tokens
    take no room but have a row.  NULL counts as 0.  Packs without a positive
    capacity have no rows.  The same input gives the same packing.
    """
    packs = packs.where("capacity > 0")
    items = sizes.select("doc", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).alias("n")).crossJoin(F.broadcast(packs))
    full = F.floor(F.col("n") / F.col("capacity")).cast("int")
    rest = (F.col("n") % F.col("capacity")).cast("int")
    whole = items.where(full > 0).select("pack", "capacity", "doc", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("capacity").alias("size"))
    loose = items.where((rest > 0) | (F.col("n") == 0)).select("pack", "capacity", "doc", full.alias("piece"), rest.alias("size"))
    columns = ["pack", "capacity", "bin", "doc", "piece", "size"]
    done = whole.withColumn("bin", F.concat(F.lit("full-"), "doc", F.lit("-"), "piece")).select(columns)
    todo = materialise(loose, "items")
    for number in range(how.rounds):
        counts = {}
        for row in todo.groupBy("pack", "capacity").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).collect():
            mean = max(1.0, row.tokens / row.n)
            counts[row.pack] = max(1, round(row.n / max(how.shard_items, how.shard_bins * row.capacity / mean)))
        if not counts:
            break
        placed = materialise(_round(todo, counts, how, number), f"placed-{number}")
        if number == how.rounds - 1:
            done = done.unionByName(placed.select(columns))
        else:
            poor = F.col("fill") < F.col("capacity") * how.dissolve_below
            done = done.unionByName(placed.where(~poor).select(columns))
            todo = placed.where(poor).select("pack", "capacity", "doc", "piece", "size")
    return done.withColumn("start", F.col("piece").cast("bigint") * F.col("capacity")).select("pack", "capacity", "bin", "doc", "piece", "start", "size")
