"""Token ids as Arrow files of equal-length sequences, with random access.

``write_sequences`` encodes documents in ascending order of their id, appends
an end id to each, packs the ids into sequences of equal length and writes them
as Arrow files (the stream-file format): each record batch holds the fields
``ids`` (fixed-size list of unsigned integers) and ``mask`` (fixed-size list of
booleans, false on the padding after the last id of a file). A batch of fixed-size lists has no
offsets, so sequence ``k`` is found by arithmetic and read from a memory map
without a copy. Every file covers a range of document ids, and the index tells
for each document where its ids start.

Cases: a null text counts as empty (the end id alone); a null doc_id sorts
first; documents with equal doc_id follow each other by their text; an empty
table gives an empty index; other columns are ignored. Retried or speculative
tasks write files of other names; the index names only the files of tasks that
succeeded.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .shared import chunks, process_cache, shared_folder, written

LENGTH = 2048           # ids in a sequence
SEQUENCES = 64          # sequences in a record batch
KNOWN_PARTS = 2_000_000  # distinct parts a worker remembers, about 70 MB

# Classes of bytes in a common text.
_OUTSIDE, _BLANK, _FEED, _LETTER, _DIGIT, _SIGN = range(6)


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters are ASCII's and the bytes of U+00C0 to U+024F (all of them letters but two signs)."""
    of = np.full(256, _OUTSIDE, np.uint8)
    of[33:127] = _SIGN
    of[48:58] = _DIGIT
    of[65:91] = of[97:123] = _LETTER
    of[0xC3:0xCA] = of[0x80:0xC0] = _LETTER
    of[32], of[10], of[39] = _BLANK, _FEED, _OUTSIDE  # an apostrophe may begin a contraction
    return of


_CLASS = _byte_classes()


def _byte_signs() -> dict[int, str]:
    """The signs that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts from the tokenizers library, each distinct part encoded once.

    Byte-level vocabularies split a text into parts before they merge: runs of
    letters, of digits or of other signs, each with one blank before it if there
    is one, and white space. In common texts (blanks and line feeds that stand
    alone, ASCII and Latin letters, no apostrophe) those parts are found here,
    and the new ones of a batch go through the library's merges together. Any
    other text goes through the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # parts come split, without white space
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.dtype = np.dtype("<u2" if max(self.whole.get_vocab_size() - 1, end_id or 0) < 1 << 16 else "<u4")
        self.signs = str.maketrans({chr(b): c for b, c in _byte_signs().items()})
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)   # sorted hashes of known parts
        self.place = np.zeros(0, np.int64)   # of their ids in ``ids``
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _common(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: is it common?"""
        kind = _CLASS[data]
        odd = kind == _OUTSIDE
        space = (kind == _BLANK) | (kind == _FEED)
        odd[1:] |= space[1:] & space[:-1]
        # the two signs between U+00C0 and U+024F, and a first byte without its letter
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        fine = textkit.sums(odd, offsets) == 0
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                fine[np.searchsorted(offsets, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        return fine

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode new distinct parts, in the order of their hashes."""
        sizes = ends - starts
        spread = np.full(int(sizes.sum()) + len(sizes), 10, np.uint8)  # a line feed behind each part ...
        before = np.cumsum(sizes + 1) - (sizes + 1)
        spread[textkit.ranges(before, sizes)] = data[textkit.ranges(starts, sizes)]
        feeds = np.flatnonzero((sizes == 1) & (data[starts] == 10))
        spread[before[feeds]] = 0  # ... so the part that is one gets another sign
        parts = spread.tobytes().decode("latin-1").replace("\x00", "\x01").split("\n")[:-1]
        table = self.signs | {1: self.signs[10]}
        got = self.merges.encode("\n".join(parts).translate({k: v for k, v in table.items() if k != 10}).split("\n"),
                                 is_pretokenized=True, add_special_tokens=False)
        first = np.searchsorted(np.array(got.word_ids), np.arange(len(parts) + 1))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, len(self.ids) + first[:-1])
        self.count = np.insert(self.count, at, np.diff(first))
        self.ids = np.append(self.ids, np.array(got.ids, self.dtype))

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of common texts, and the number of each text."""
        kind = _CLASS[data]
        new = np.ones(len(data), bool)
        new[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)) | (kind[1:] == _FEED)
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        keys, sample, which = np.unique(textkit.PrefixHash(data)(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_PARTS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        unknown = np.flatnonzero(at == len(self.keys)) if not len(self.keys) else np.flatnonzero(
            self.keys[np.minimum(at, len(self.keys) - 1)] != keys)
        if len(unknown):
            self._learn(data, starts[sample[unknown]], ends[sample[unknown]], keys[unknown])
            at = np.searchsorted(self.keys, keys)
        place, count = self.place[at][which], self.count[at][which]
        return self.ids[textkit.ranges(place, count)], textkit.sums(count, np.searchsorted(starts, offsets))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one text after the other, each with its end id, and their numbers."""
        data, offsets = textkit.utf8(column)
        fine = self._common(data, offsets)
        sizes = np.diff(offsets)
        chosen = data if fine.all() else data[textkit.ranges(offsets[:-1][fine], sizes[fine])]
        ids, counts = self._parts(chosen, np.append(0, np.cumsum(sizes[fine])))
        number = np.zeros(len(sizes), np.int64)
        number[fine] = counts
        apart = {}
        for k in np.flatnonzero(~fine):
            text = data[offsets[k]:offsets[k + 1]].tobytes().decode()
            apart[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
            number[k] = len(apart[k])
        ended = number + (self.end_id is not None)
        before = np.cumsum(ended) - ended
        out = np.full(int(ended.sum()), self.end_id or 0, self.dtype)
        out[textkit.ranges(before[fine], number[fine])] = ids
        for k, found in apart.items():
            out[before[k]:before[k] + len(found)] = found
        return out, ended


def _encoder(path: str, end_id: int | None) -> TextEncoder:
    cache = process_cache("text_encoders")
    if (path, end_id) not in cache:
        cache[path, end_id] = TextEncoder(path, end_id)
    return cache[path, end_id]


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if ":" not in folder.split("/")[0]:
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return pafs.FileSystem.from_uri(folder)


class SequenceWriter:
    """One Arrow file of packed sequences, written batch by batch."""

    def __init__(self, path: str, dtype: np.dtype, length: int, sequences: int):
        self.fs, where = _file_system(path)
        self.dtype, self.length, self.full = dtype, length, length * sequences
        value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(where)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.full:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.full * self.full
            for lo in range(0, whole, self.full):
                self._batch(flat[lo:lo + self.full], self.full)
            self.rest, self.held = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                  pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.rest)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self._batch(padded, len(flat))
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences and to any run of ids of one Arrow file."""

    def __init__(self, path: str):
        fs, where = _file_system(path)
        source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._open, self._ids = -1, None
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.full = first * self.length  # ids in each batch but the last

    def _batch_ids(self, k: int) -> np.ndarray:
        if k != self._open:
            self._open, self._ids = k, self.file.get_batch(k).column(0).flatten().to_numpy()
        return self._ids

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``, both views of the map; the mask's bits stay packed, as Arrow keeps them."""
        rows = self.full // self.length
        batch = self.file.get_batch(k // rows)
        lo = k % rows * self.length
        return (batch.column(0).flatten().to_numpy()[lo:lo + self.length],
                batch.column(1).flatten().slice(lo, self.length))

    def run(self, start: int, n: int) -> list[np.ndarray]:
        """The ``n`` ids from ``start`` on, a view for each batch that they lie in."""
        out = []
        while n > 0:
            ids, lo = self._batch_ids(start // self.full), start % self.full
            out.append(ids[lo:lo + n])
            n -= len(out[-1])
            start += len(out[-1])
        return out


INDEX = "file string, part int, doc_id bigint, local_start bigint, n_tokens bigint"


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None,
                    length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """Write the files to ``folder`` (a new shared one by default); returns the index.

    Index: file, part (the files' order), doc_id, local_start (ids before it in
    its file), n_tokens. Files are written once: the index is a written table.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "sequences")
    fs, where = _file_system(folder)
    fs.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, at = _encoder(tokenizer, end_id), None, 0
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        for batch in batches:
            for b in chunks(batch, "text"):
                writer = writer or SequenceWriter(name, encoder.dtype, length, sequences)
                ids, n = encoder(b.column(1))
                writer.add(ids)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(n)), pa.array([part] * len(n), pa.int32()), b.column(0).cast(pa.int64()),
                     pa.array(start), pa.array(n)], ["file", "part", "doc_id", "local_start", "n_tokens"])
        if writer:
            writer.close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = (rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "text"))
    return written(ordered.mapInArrow(write, INDEX), "sequence-index")


def read_documents(index: DataFrame) -> DataFrame:
    """Ids of each document read from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    # one row a file
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = files.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            crc = []
            for file, start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if file != name:
                    name, reader = file, SequenceReader(file)
                value = 0
                for view in reader.run(start, n):
                    value = zlib.crc32(view.astype("<u4").tobytes(), value)
                crc.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(2), b.column(3), pa.array(crc, pa.int64())],
                                             ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    found = index.select("doc_id", "file", "local_start", "n_tokens", "part").mapInArrow(
        read, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"),
                                             "n_tokens", "ids_crc32")
