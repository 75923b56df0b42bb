"""Lines of files by their bytes, through any file system that pyarrow knows (local, hdfs, s3, gs).

Used in the readers of Spark's Python data sources, which run outside the JVM."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from posixpath import basename

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes that are looked at together when the end of a line is searched for.
BLOCK = 1 << 16


@dataclass
class Span(InputPartition):
    """The lines of a file that begin at `begin` or later, before `end`; labels go along with each line."""

    path: str
    begin: int
    end: int
    labels: tuple = ()


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> dict[str, int]:
    """Files and their sizes: a file by itself, or the files of a folder but those that begin with `_` or `.`; none
    where there is nothing."""
    where, inner = place(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return {}
    if info.type == fs.FileType.File:
        return {path: info.size}
    found = where.get_file_info(fs.FileSelector(inner))
    return {f"{path.rstrip('/')}/{f.base_name}": f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "_."}


def zipped(path: str) -> bool:
    return basename(path).lower().endswith(".gz")


def end_of_lines(path: str, floor: int, size: int) -> int:
    """The place after the last line end before `size`, or `floor` where there is none after it. Blocks are
    read from the end, so little is read."""
    where, inner = place(path)
    with where.open_input_file(inner) as file:
        while size > floor:
            begin = max(floor, size - BLOCK)
            found = file.read_at(size - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return floor


def next_line(path: str, at: int, size: int) -> int:
    """Where the first line begins that begins at `at` or later (`size` if none does)."""
    if at <= 0:
        return 0
    where, inner = place(path)
    with where.open_input_file(inner) as file:
        at -= 1  # a line begins at `at` if a line end stands before it
        while at < size:
            found = (block := file.read_at(min(BLOCK, size - at), at)).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
    return size


def spans(path: str, begin: int, end: int, most: int, labels: tuple = ()) -> list[Span]:
    """A range of a file in parts of about `most` bytes; a gzipped file is one part."""
    if begin >= end:
        return []
    cuts = [begin, end] if zipped(path) else [*range(begin, end, most), end]
    return [Span(path, a, b, labels) for a, b in pairwise(cuts)]


def read_span(span: Span, whole_start: bool) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin in a span, without their ends. whole_start: a line begins at `begin`.
    A gzipped file is read as a whole; places are then those in the unpacked text."""
    where, inner = place(span.path)
    if zipped(span.path):
        at = 0
        with gzip.open(where.open_input_file(inner)) as lines:
            for line in lines:
                yield at, line.rstrip(b"\r\n").decode()
                at += len(line)
        return
    size = where.get_file_info(inner).size
    at = span.begin if whole_start else next_line(span.path, span.begin, size)
    with where.open_input_stream(inner, buffer_size=1 << 20) if at == 0 else where.open_input_file(inner) as file:
        if at:
            file.seek(at)
        rest = b""
        while at < span.end:
            cut = rest.find(b"\n")
            if cut < 0:
                more = file.read(1 << 20)
                if more:
                    rest += more
                    continue
                if rest:
                    yield at, rest.rstrip(b"\r").decode()
                return
            lines = rest[: rest.rfind(b"\n") + 1].split(b"\n")[:-1]
            rest = rest[rest.rfind(b"\n") + 1 :]
            for line in lines:
                if at >= span.end:
                    return
                yield at, line.rstrip(b"\r").decode()
                at += len(line) + 1
