"""Inverted index of character pairs, so that a search for substrings reads few rows.

``build`` writes two tables below a folder:

* ``rows``   the indexed rows with a number, in folders of ``PART_ROWS`` numbers;
* ``pairs``  postings: for a gram (a pair of neighbouring characters, or one character) and a bucket of
             numbers the sorted positions of the rows that hold it.  A gram lies in one file, sorted
             by gram, so a filter on grams reads the row groups of these grams alone.

``candidates`` reads the postings of a query's grams, intersects them bucket by bucket from the shortest
list on and fetches these rows by number.  They are a superset of the matches (pairs may lie
apart), so the matching itself stays with the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket; positions in it fit a short.
BUCKET_ROWS = 1 << 15
PART_ROWS = 1 << 22
#: Bytes of whole texts and characters worked on at once in a task.
PIECE_BYTES, WINDOW = 4 << 20, 1 << 20
#: Stands for the missing second character of a single one; no code point is that large.
ALONE = (1 << 21) - 1


def grams(text: Column) -> Column:
    """Distinct characters and neighbouring pairs of a text; ``postings`` finds the same for many texts at once."""
    chars = F.split(text, "")
    return F.array_distinct(F.concat(chars, F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))))


def _grams(codes: np.ndarray) -> pa.Array:
    """Strings of one or two code points, packed in a number."""
    pair = np.stack([codes >> 21, codes & ALONE], axis=1)
    held = pair != ALONE
    width = ((1 + (pair > 0x7F) + (pair > 0x7FF) + (pair > 0xFFFF)) * held).sum(axis=1)
    text = pair[held].astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(text))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """(numbers, joined text, characters of each row) of whole texts of about ``PIECE_BYTES``."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right")))
        texts = [raw.decode(errors="replace") for raw in batch.column(1).slice(at, until - at).cast(pa.binary()).to_pylist()]
        yield batch.column(0).slice(at, until - at).to_numpy(), "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        at = until


def postings(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[pa.RecordBatch]:
    """(gram, bucket, places) of (number, text) rows; a task gives one list a gram and bucket for about a million characters."""
    for batch in batches:
        for numbers, joined, lengths in _pieces(batch):
            chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            row = np.repeat(np.arange(len(numbers)), lengths)
            for at in range(0, len(chars), WINDOW):
                code, own = chars[at:at + WINDOW + 1].astype(np.int64), row[at:at + WINDOW + 1]
                both = np.flatnonzero(own[1:] == own[:-1])
                found = np.unique(np.concatenate([((code << 21 | ALONE) << 21 | own)[:WINDOW], (code[both] << 21 | code[both + 1]) << 21 | own[both]]))
                gram, number = found >> 21, numbers[found & ALONE]
                bucket, place = number // bucket_rows, (number % bucket_rows).astype(np.int16)
                starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (bucket[1:] != bucket[:-1])]))
                places = pa.ListArray.from_arrays(np.append(starts, len(place)).astype(np.int32), pa.array(place))
                yield pa.RecordBatch.from_arrays([_grams(gram[starts]), pa.array(bucket[starts]), places], ["gram", "bucket", "places"])


def term_grams(terms: Iterable[str]) -> set[str]:
    """The grams that every text holding all ``terms`` has."""
    return {t[i:i + 2] for t in terms for i in range(max(1, len(t) - 1)) if t}


def build(rows: DataFrame, text: Column, root: str, number: str = "_number", bucket_rows: int = BUCKET_ROWS, part_rows: int = PART_ROWS) -> None:
    """Write the index of ``rows`` by the searchable ``text`` below ``root``; null texts hold nothing.

    Tasks are those of ``rows``: deal narrow rows of few files to more tasks beforehand.  Lists are put together in the
    tasks, so what moves is about a list a gram and bucket, and no row a gram and text.
    """
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()
    parted = rows.withColumn(number, at).withColumn("_part", F.floor(F.col(number) / part_rows))
    parted.withColumn("_text", F.coalesce(text, F.lit(""))).write.mode("overwrite").partitionBy("_part").parquet(f"{root}/rows")
    held = spark.read.parquet(f"{root}/rows").where("_text <> ''").select(number, "_text")
    found = held.mapInArrow(lambda batches: postings(batches, bucket_rows), "gram string, bucket bigint, places array<smallint>")
    lists = found.repartition("gram").groupBy("gram", "bucket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    lists.sortWithinPartitions("gram", "bucket").write.mode("overwrite").parquet(f"{root}/pairs")


def candidates(spark: SparkSession, root: str, queries: Mapping[str, Iterable[str]], number: str = "_number", bucket_rows: int = BUCKET_ROWS,
               part_rows: int = PART_ROWS) -> DataFrame:
    """The rows that may hold all terms of some query, with ``_queries``, the names of these queries.

    A query without terms has no candidates.
    """
    wanted = [(name, gram, len(own)) for name, terms in queries.items() for own in [sorted(term_grams(terms))] for gram in own]
    needed = spark.createDataFrame(wanted, "query string, gram string, needed int")
    postings = spark.read.parquet(f"{root}/pairs").where(F.col("gram").isin(sorted({g for _, g, _ in wanted})))
    lists = postings.join(F.broadcast(needed), "gram").groupBy("query", "bucket", "needed").agg(F.collect_list("places").alias("lists"))  # a list a gram
    lists = lists.where(F.size("lists") == F.col("needed")).withColumn("lists", F.array_sort("lists", lambda a, b: F.size(a) - F.size(b)))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
    numbers = lists.select("query", F.explode(F.transform(both, lambda place: F.col("bucket") * bucket_rows + place)).alias(number))
    numbers = numbers.groupBy(number).agg(F.collect_set("query").alias("_queries")).withColumn("_part", F.floor(F.col(number) / part_rows))
    return spark.read.parquet(f"{root}/rows").drop("_text").join(numbers, ["_part", number]).drop("_part", number)
