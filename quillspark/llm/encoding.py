"""Encoding and decoding of a corpus with a public byte-level tokenizer.

Each text is cut into pre-tokens by the tokenizer's own pattern.  A document's
pre-tokens are reduced to distinct words with their positions before anything
is shuffled; a global shuffle of distinct words lets each word be
encoded once, and the ids are joined back and laid in order of position.
Decoding joins the table of token bytes, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which the byte-level vocabularies cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(name: str, folder: str = TOKENIZERS, whole: bool = False):
    """The encoder; with ``whole`` it takes its input as one pre-token."""
    import tiktoken

    pattern = r"[\s\S]+" if whole else PATTERN
    return tiktoken.Encoding(f"{name}-{whole}", pat_str=pattern, mergeable_ranks=ranks(name, folder), special_tokens={})


def pre_tokens(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, word, places): the distinct pre-tokens of each document and where they stand, from 0.

    A document without text has no row.  The grouping happens where the text is
    read, so a word travels once for each document, however often it stands there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(PATTERN).findall
        for batch in batches:
            docs: list = []
            words: list[str] = []
            places: list[list[int]] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[str, list[int]] = {}
                for place, word in enumerate(cut(value)):
                    if word in found:
                        found[word].append(place)
                    else:
                        found[word] = [place]
                docs += [key] * len(found)
                words += found.keys()
                places += found.values()
                if len(words) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], names)
                    docs, words, places = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], names)

    names = ["doc", "word", "places"]
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text <> ''")
    kind = to_arrow_type(rows.schema["doc"].dataType)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *T._parse_datatype_string("word string, places array<int>").fields]))


def encode_words(words: DataFrame, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """(word, word_ids) for the rows of ``word``, each encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder, whole=True).encode_ordinary
        for batch in batches:
            column = batch.column("word")
            ids = pa.array([encode(w) for w in column.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([column, ids], ["word", "word_ids"])

    return words.select("word").mapInArrow(run, "word string, word_ids array<int>")


def encode(df: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, ids): the token ids of each row's text, without special tokens.

    ``doc`` must be unique and not NULL.  NULL and empty texts have no token:
    their ids are the empty list, never NULL.  The strings of special tokens in
    a text are ordinary text.  Texts of any length are encoded whole.
    """
    places = pre_tokens(df, doc, text)
    words = encode_words(places.select("word").distinct(), name, folder)
    parts = places.join(words, "word").groupBy("doc").agg(
        F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("word_ids").alias("ids"))))).alias("parts")
    )
    ids = parts.select(F.col("doc"), F.flatten(F.transform(F.array_sort("parts"), lambda p: p.ids)).alias("ids"))
    none = df.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(F.col(doc).alias("doc"), F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(none).withColumnRenamed("doc", doc)


def token_table(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, bytes) of the vocabulary: a table of fixed size."""
    rows = [(rank, bytearray(token)) for token, rank in ranks(name, folder).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(df: DataFrame, doc: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, text): the texts of token ids; the inverse of :func:`encode`.

    NULL and empty ids give ''.  An id outside the vocabulary raises an error.
    """
    tokens = df.select(F.col(doc).alias("doc"), F.posexplode_outer(ids).alias("place", "id"))
    # Fixed size (50,256 rows), so the broadcast is bounded.
    joined = tokens.join(F.broadcast(token_table(df.sparkSession, name, folder)), "id", "left")
    lost = F.col("id").isNotNull() & F.col("bytes").isNull()
    piece = F.when(lost, F.raise_error(F.lit("token id outside the vocabulary")).cast("string")).otherwise(F.hex("bytes"))
    parts = joined.groupBy("doc").agg(F.collect_list(F.struct("place", piece.alias("hex"))).alias("parts"))
    text = F.unhex(F.array_join(F.transform(F.array_sort("parts"), lambda p: p.hex), "")).cast("string")
    return parts.select(F.col("doc").alias(doc), F.coalesce(text, F.lit("")).alias("text"))
