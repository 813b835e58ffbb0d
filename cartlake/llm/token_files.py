"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

``write_tokens`` cuts the documents by range of their id; each task tokenises its range and writes two files in the shared
folder. ``<range>.bin`` holds the ids, little-endian, two bytes each where the vocabulary allows it and four elsewhere.
``<range>.idx`` holds a header (magic, bytes of an id, documents), the documents' ids (int64), a mask of the null ones
(uint8) and n + 1 offsets (uint64): where each document starts, counted in ids from the start of the range. The ranges'
bases, as prefix sums of their ids and documents, are a table of one row a range; base plus offset is a place in the
whole corpus. A task writes under a name of its own and renames at its end, so a repeated task leaves one whole file.

``read_tokens`` maps the files, a range a task, and gives places, ids and checksums of what they hold; ``token_windows``
reads any stretch of the corpus, across documents and ranges, as a training loader does.

Defined cases: null text is empty and has the end id alone; documents with one id, or a null one (these come first), are
kept as they are, in the order of their texts' hashes (equal ones in any order); an empty table gives no files and an
empty result; a long text is tokenised whole; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.llm.columns import _arrow, need, parts, record, utf8
from cartlake.llm.packing import _forget, word_ids
from cartlake.llm.staging import shared_folder, staged
from cartlake.sources.staging import gone_at_exit

WRITTEN = "range int, n_docs long, n_tokens long"
PLACES = "doc_id long, start long, n_tokens long, ids_crc32 long"
CUTS = "window_id long, start long, range int, from long, within long, n long"
HEADER = "<8sIIQ"  # magic, bytes of an id, reserved, documents
MAGIC = b"TOKIDX01"
STEP = 1 << 20  # ids that are widened at once


@dataclass(frozen=True)
class TokenFiles:
    """A written corpus: its folder, its bytes of an id, and the ranges with their bases."""

    folder: str
    width: int
    ranges: DataFrame  # range, n_docs, n_tokens, base, first_doc


def _file(folder: str, part: int, kind: str) -> str:
    return f"{folder}/{part:06d}.{kind}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _publish(where: fs.FileSystem, written: str, final: str) -> None:
    """Renames a whole file; where another attempt of the task was first and the store does not replace files, its equal file stays."""
    try:
        where.move(written, final)
    except OSError:
        if where.get_file_info(final).type == fs.FileType.NotFound:
            raise
        where.delete_file(written)


def id_width(vocabulary: str, *extra: int) -> int:
    """Bytes of an id: two where all ids of the vocabulary (and extra ones) are below 65,536, else four."""
    return 2 if max([word_ids(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True) - 1, *extra]) < 1 << 16 else 4


def write_tokens(docs: DataFrame, vocabulary: str, *, end_id: int = 2) -> TokenFiles:
    """The documents' ids, each document's end marked, in ascending order of doc_id. Ranges are as many as the session's shuffle
    partitions (or fewer, as AQE merges small ones); rows of one id are told apart by their text's hash."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/cartlake/tokens-{uuid.uuid4().hex}"
    width, kinds = id_width(vocabulary, end_id), _arrow(WRITTEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _store(folder)
        context = TaskContext.get()
        part, mine = context.partitionId(), f".{context.taskAttemptId()}"
        end, encoder = np.asarray([end_id], f"<u{width}").tobytes(), word_ids(vocabulary)
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        out = None
        try:
            for batch in parts(batches):
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(_file(path, part, "bin") + mine)
                sizes = []
                for coded in encoder.encode(batch.column(1).to_pylist()):
                    plain = np.frombuffer(coded, "<u4").astype(f"<u{width}").tobytes() + end
                    out.write(plain)
                    sizes.append(len(plain) // width)
                ids.append(batch.column(0))
                lengths.append(np.asarray(sizes, np.uint64))
        finally:
            _forget()
            if out is not None:
                out.close()
        if out is None:
            return
        names = pa.chunked_array(ids, pa.int64())
        offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate(lengths), dtype=np.uint64)])
        with where.open_output_stream(_file(path, part, "idx") + mine) as index:
            index.write(struct.pack(HEADER, MAGIC, width, 0, len(names)))
            index.write(np.asarray(names.fill_null(0), "<i8").tobytes())
            index.write(np.asarray(names.is_null(), np.uint8).tobytes())
            index.write(offsets.astype("<u8").tobytes())
        for kind in ("bin", "idx"):
            _publish(where, _file(path, part, kind) + mine, _file(path, part, kind))
        yield record({"range": [part], "n_docs": [len(names)], "n_tokens": [int(offsets[-1])]}, kinds)

    gone_at_exit(spark, folder)
    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), utf8().alias("utf8")).withColumns({"hash": F.xxhash64("utf8"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "utf8")
    written = staged(ordered.mapInArrow(run, WRITTEN), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_tokens", "base"), ("n_docs", "first_doc"))))
    return TokenFiles(folder, width, staged(bases, "bases"))


class MappedRange:
    """One range's files: mapped where they are local, read by stretches where they are not."""

    def __init__(self, folder: str, part: int) -> None:
        self.where, path = _store(folder)
        self.local = isinstance(self.where, fs.LocalFileSystem)
        with self._open(_file(path, part, "idx")) as index:
            magic, self.width, _, n = struct.unpack(HEADER, index.read(struct.calcsize(HEADER)))
            if magic != MAGIC:
                raise ValueError("not an index of token ids")
            ids = np.frombuffer(index.read(8 * n), "<i8")
            self.doc_ids = pa.array(ids, mask=np.frombuffer(index.read(n), np.uint8).astype(bool))
            self.offsets = np.frombuffer(index.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.ids = self._open(_file(path, part, "bin"))

    def _open(self, path: str) -> pa.NativeFile:
        return pa.memory_map(path) if self.local else self.where.open_input_file(path)

    def stretch(self, start: int, length: int) -> np.ndarray:
        """Ids from a place in the range, without a copy where the file is mapped."""
        self.ids.seek(self.width * start)
        return np.frombuffer(self.ids.read_buffer(self.width * length), f"<u{self.width}")

    def crc32(self, start: int, length: int) -> int:
        """Checksum of a stretch's ids as 32-bit integers, a bounded part at a time."""
        value = 0
        for at in range(start, start + length, STEP):
            value = zlib.crc32(self.stretch(at, min(STEP, start + length - at)).astype("<u4").tobytes(), value)
        return value


def _spread(ranges: DataFrame) -> DataFrame:
    """A task for each range."""
    return ranges.repartition(max(1, ranges.count()))


def read_tokens(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as the files have them."""
    kinds, folder = _arrow(PLACES), files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = MappedRange(folder, part)
                for lo in range(0, len(held.doc_ids), 10_000):
                    at = held.offsets[lo : lo + 10_001]
                    sizes = np.diff(at)
                    yield record({"doc_id": held.doc_ids.slice(lo, len(sizes)), "start": pa.array(at[:-1] + base), "n_tokens": pa.array(sizes), "ids_crc32": [held.crc32(int(a), int(n)) for a, n in zip(at[:-1], sizes, strict=True)]}, kinds)

    return _spread(files.ranges.select("range", "base")).mapInArrow(run, PLACES)


def token_windows(files: TokenFiles, windows: DataFrame) -> DataFrame:
    """``window_id, start, ids`` for windows (window_id, start, length) of the whole corpus; what lies beyond its end is left out.

    A window is cut at the ranges' bounds (of which there is one row a range, looked up by bisection), each part is read by
    mapping its range, and the parts meet again in their order.
    """
    folder, schema = files.folder, "window_id long, start long, from long, ids array<long>"
    kinds, cuts = _arrow(schema), _arrow(CUTS)
    known = sorted((r.base, r.range, r.n_tokens) for r in files.ranges.where("n_tokens > 0").collect())
    bases, end = [b for b, _, _ in known], known[-1][0] + known[-1][2] if known else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for window, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, until = max(0, start), min(end, start + length)
                while at < until:
                    base, part, n = known[bisect_right(bases, at) - 1]
                    stop = min(until, base + n)
                    rows.append((window, start, part, at, at - base, stop - at))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(cuts)], schema=cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in parts(batches):
            out: dict[str, list] = {f.name: [] for f in kinds}
            for window, start, of, at, within, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part:
                    part, held = of, MappedRange(folder, of)
                for name, value in zip(out, (window, start, at, held.stretch(within, n)), strict=True):
                    out[name].append(value)
            yield record(out, kinds)

    pieces = need(windows, "window_id", "start", "length").where("start is not null and length is not null").select(*(F.col(c).cast("long") for c in ("window_id", "start", "length"))).mapInArrow(cut, CUTS)
    found = pieces.repartition("range", F.xxhash64("window_id", "start")).sortWithinPartitions("range", "from").mapInArrow(run, schema)
    return found.groupBy("window_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "ids"))), lambda x: x["ids"])).alias("ids"))


def token_places(docs: DataFrame, vocabulary: str, *, end_id: int = 2) -> DataFrame:
    """Writes the files and reads every document's place and checksum from them."""
    return read_tokens(write_tokens(docs, vocabulary, end_id=end_id))
