"""A data source for one long string: files without line ends or blanks, read by byte ranges.

A file is dealt in byte ranges, a task reads one, piece by piece. Borders of pieces move to
the next border of a UTF-8 character, which both sides find from the same bytes, so a
character belongs to one piece and pieces in order are the string. Nothing is counted or
shuffled: the number of a piece follows from its file and its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from maskloom.operators.order import ranked
from maskloom.session import saved
from maskloom.sources import files

PIECE_BYTES = 1 << 20
PIECES_PER_TASK = 64
#: rows of 16 bytes that are broadcast at most: about 10 MB as a hash table
BROADCAST_ROWS = 100_000

SCHEMA = "piece long, text string"
_ARROW = pa.schema([("piece", pa.int64()), ("text", pa.string())])
_MARK = b"\xef\xbb\xbf"


@dataclass
class ByteRange(InputPartition):
    """Bytes ``[low, high)`` of a file; ``piece`` numbers the first piece."""

    path: str
    low: int
    high: int
    size: int
    piece: int


def byte_ranges(listed: list[tuple[str, int]], piece_bytes: int, pieces_per_task: int) -> list[ByteRange]:
    """The ranges of files ``(path, length)`` in the order given."""
    out, piece = [], 0
    step = piece_bytes * pieces_per_task
    for path, size in listed:
        for low in range(0, size, step):
            out.append(ByteRange(path, low, min(low + step, size), size, piece + low // piece_bytes))
        piece += -(-size // piece_bytes)
    return out


def opened(path: str):
    """A file of any system that Arrow knows, by the URI that Spark lists it under."""
    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^(file:)?/+", "/", path))
    system, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return system.open_input_file(name)


def border(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character starts; at most three bytes on, since
    no character has more that continue it."""
    end = at
    while end < min(at + 3, len(data)) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


def pieces(file, part: ByteRange, piece_bytes: int) -> Iterator[tuple[int, str]]:
    """Numbers and texts of the pieces of a range. Bad bytes become U+FFFD; a byte-order mark
    at the start of a file is no text."""
    for i, low in enumerate(range(part.low, part.high, piece_bytes)):
        high = min(low + piece_bytes, part.high)
        file.seek(low)
        data = file.read(min(high + 3, part.size) - low)
        start = border(data, 0) if low else 0
        end = max(start, border(data, high - low))
        if not low and data.startswith(_MARK):
            start = len(_MARK)
        yield part.piece + i, data[start:end].decode("utf-8", "replace")


class StringReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listed = [(path, size) for path, size in json.loads(options["files"])]
        self.piece_bytes = int(options["piecebytes"])
        self.pieces_per_task = int(options["piecespertask"])

    def partitions(self) -> list[ByteRange]:
        # a reader has one partition at least
        return byte_ranges(self.listed, self.piece_bytes, self.pieces_per_task) or [ByteRange("", 0, 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        with opened(partition.path) as file:
            for number, text in pieces(file, partition, self.piece_bytes):
                yield pa.record_batch([[number], [text]], schema=_ARROW)


class StringSource(DataSource):
    """``spark.read.format("maskloom_string")``; options ``files`` (JSON pairs of path and
    length), ``pieceBytes`` and ``piecesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "maskloom_string"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StringReader:
        return StringReader(self.options)


def read_string(
    spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES, pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """Pieces ``(piece, text)`` whose texts in order are the files below ``path``, by path, as
    one string.

    Every byte is kept, blanks and line ends at any place too; a string without either is
    read by as many tasks as any other. A piece has about ``piece_bytes`` bytes (8 at least)
    and may be empty after the move of its borders. Empty files, and names that start with
    ``_`` or ``.``, give nothing. A path without files is an error.
    """
    if piece_bytes < 8:
        raise ValueError("piece_bytes is 8 or more")
    listed = sorted((name, size) for name, size, _ in files.listing(spark, path) if name.rsplit("/", 1)[1][0] not in "_.")
    if not listed:
        raise ValueError(f"no files in {path}")
    spark.dataSource.register(StringSource)
    reader = spark.read.format(StringSource.name()).option("files", json.dumps(listed))
    return reader.option("pieceBytes", piece_bytes).option("piecesPerTask", pieces_per_task).load()


def with_places(df: DataFrame) -> DataFrame:
    """Adds ``before``, the number of characters in the pieces before, to pieces of ``read_string``.

    The string is read once more to count; the text itself does not move for that while
    there are at most ``BROADCAST_ROWS`` pieces.
    """
    lengths = saved(df.select("piece", F.length("text").alias("_n")), "lengths")
    places = saved(ranked(lengths, "piece", weight=F.col("_n")).select("piece", "before"), "places")
    few = places.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(places) if few else places, "piece").select("piece", "before", "text")
