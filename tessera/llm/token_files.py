"""Token ids as binary files: all ids in one array, where documents end in an Elias-Fano sequence.

A file holds, little-endian: a mark; the ids of its documents, 2 or 4 bytes each; the ends of the documents; their ids; a foot. Both sequences
never fall, so each is kept as Elias-Fano: the low bits of a number side by side, its high bits as the distance between ones, and the place
of every 256th one, from which select finds any other. That is 2 bits a number besides the low ones and an eighth for the places, not 64.

Texts are sorted by id over the cluster, and a task encodes its stretch and writes it as files of bounded size, so that where one file starts in
the whole is the sum of the ids in the files before. Each attempt of a task writes under names of its own; only names in the table
of files, which Spark commits, count, so a lost or doubled attempt leaves nothing that is read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_dir, cut_table, release, table
from tessera.llm.pieces import Shared

MARK = b"IDSEF001"
#: width, documents, ids, documents without an id, the least id, bytes of the ends, bytes of the ids; then MARK again.
FOOT = struct.Struct("<QQQQqQQ8s")
HEAD = struct.Struct("<QQQ")
EVERY = 256
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Ids and documents after which a file is closed; a longer document has one to itself.
FILE_IDS, FILE_DOCS = 1 << 23, 1 << 20
#: Characters of a text that are split at once, and of an Arrow batch that are encoded at once.
SLICE = 1 << 20


class EliasFano:
    """A sequence of whole numbers that never falls, from 0 up, read where it lies in a buffer."""

    def __init__(self, data):
        data = memoryview(data)
        self.n, self.low_bits, size = HEAD.unpack_from(data)
        at = HEAD.size
        low_bytes = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low_bytes, at)
        self.high = np.frombuffer(data, np.uint8, size, at + low_bytes)
        self.places = np.frombuffer(data, "<u4", -(-self.n // EVERY), at + low_bytes + size)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        packed = np.packbits(high, bitorder="little")
        return HEAD.pack(n, low_bits, len(packed)) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + packed.tobytes() + ones[::EVERY].astype("<u4").tobytes()

    def place(self, i: int) -> int:
        """Where the i-th one lies among the high bits."""
        at, left = int(self.places[i // EVERY]), i % EVERY
        byte = at // 8
        current = int(self.high[byte]) >> at % 8 << at % 8
        while left >= ONES[current]:
            left -= int(ONES[current])
            byte += 1
            block = ONES[self.high[byte : byte + 64]].cumsum()  # most blocks hold all that is left
            skip = int(np.searchsorted(block, left, side="right"))
            left -= int(block[skip - 1]) if skip else 0
            byte += skip
            current = int(self.high[byte]) if skip < len(block) else 0
            byte -= skip == len(block)
        for _ in range(left):
            current &= current - 1
        return byte * 8 + (current & -current).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th number, without those before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = i * self.low_bits
        low = int.from_bytes(self.low[bit // 8 : (bit + self.low_bits + 7) // 8].tobytes(), "little") >> bit % 8 & ((1 << self.low_bits) - 1)
        return self.place(i) - i << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (ones - np.arange(self.n, dtype=np.uint64) << np.uint64(self.low_bits)) | low


class Writer:
    """Writes one file front to back; ids go out as they come, only the documents' ends and ids are held."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.ends, self.keys, self.nulls, self.n_ids = stream, width, [], [], 0, 0
        stream.write(MARK)

    def add(self, key: int | None, ids: bytes) -> None:
        """A document's id, null before all others and never falling, and its token ids, packed at this file's width."""
        self.stream.write(ids)
        self.n_ids += len(ids) // self.width
        self.ends.append(self.n_ids)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple[int, int]:
        """The numbers of documents and ids."""
        least = self.keys[0] if self.keys else 0
        ends, keys = EliasFano.encode(self.ends), EliasFano.encode([k - least for k in self.keys])
        self.stream.write(ends + keys + FOOT.pack(self.width, len(self.ends), self.n_ids, self.nulls, least, len(ends), len(keys), MARK))
        self.stream.close()
        return len(self.ends), self.n_ids


class Reader:
    """Reads documents of one file by their number; only the foot and the two sequences are loaded at first."""

    def __init__(self, file):
        self.file, size = file, file.size()
        foot = file.read_at(FOOT.size, size - FOOT.size) if size >= FOOT.size + len(MARK) else b""
        if foot[-8:] != MARK or file.read_at(len(MARK), 0) != MARK:
            raise ValueError("not a file of token ids, or one that was not closed")
        self.width, self.n_docs, self.n_ids, self.nulls, self.least, ends, keys, _ = FOOT.unpack(foot)
        data = file.read_at(ends + keys, size - FOOT.size - ends - keys)
        self.ends, self.keys = EliasFano(data[:ends]), EliasFano(data[ends:])

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids start and end in the file's array."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls) + self.least

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MARK) + start * self.width), f"<u{self.width}")

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, token ids) of all documents, reading some million ids at a time."""
        ends = self.ends.all().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keys = [None] * self.nulls + [int(k) + self.least for k in self.keys.all()]
        first = 0
        while first < self.n_docs:
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + at_once, side="right")))
            ids = self.ids(starts[first], ends[last - 1])
            for i in range(first, last):
                yield keys[i], int(starts[i]), ids[starts[i] - starts[first] : ends[i] - starts[first]]
            first = last


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share: a plain or file: path, or any URI that pyarrow knows."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


#: Visible ASCII and the letters of Latin-1: here white space, letters, digits and lower case are beyond doubt, and no text composes.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How the tokenizer's file splits lower-case text, within those characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: A word with or without marks after it, which are two parts, or one.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")
_BREAK = re.compile("[ \n]")


class Remembered(dict):
    """What a function gives for a text, kept for texts of fewer than 100 characters; all is dropped when ``limit`` are held."""

    limit = 600_000

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, text: str) -> bytes:
        out = self.function(text)
        if len(text) < 100:
            if len(self) >= self.limit:
                self.clear()
            self[text] = out
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: a visible Latin-1 character for itself, the others for the
    characters from U+0100 on."""
    out, other = [], 256
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if visible else other))
        other += not visible
    return out


class Codec:
    """Texts to packed ids. Spaces and line feeds are never part of a token of this kind, so what lies between them is encoded alone and
    remembered, and so are its words and marks where it is plain: these go to the library's BPE model at once, all else to its tokenizer."""

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        letters = byte_letters()
        self.tokenizer, self.kind = Tokenizer.from_str(spec), f"<u{width}"
        self.model, self.packed = self.tokenizer.model, struct.Struct("<H" if width == 2 else "<I").pack
        self.bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(33, 256)}
        self.parts, self.chunks = Remembered(self.part), Remembered(self.chunk)

    def part(self, part: str) -> bytes:
        return b"".join([self.packed(t.id) for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def chunk(self, chunk: str) -> bytes:
        plain = _WORD.fullmatch(chunk)
        if plain and "<|" not in chunk:
            word, marks = plain.groups()
            word = self.parts[word.lower()]
            return word + self.parts[marks] if marks else word
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(chunk.lower())))
        return self.whole(chunk)

    def slice(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= SLICE:
            return self.slice(text)
        out, at = [], 0
        while at < len(text):
            cut = _BREAK.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            out.append(self.slice(text[at:end]))
            at = end + 1
        return b"".join(out)


_codecs: dict[int, Codec] = {}


def encoder(spark, tokenizer_path: str, end_id: int, width: int):
    """A function for mapInArrow from (id, text) to (id, ids)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = Shared(spark, f.read())  # of the size of a vocabulary
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.bid not in _codecs:
            _codecs.clear()
            _codecs[shared.bid] = Codec(shared.value, width)
        codec = _codecs[shared.bid]
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(b)]):
                texts = b["text"].slice(x, y - x).to_pylist()
                yield pa.record_batch([b["id"].slice(x, y - x), pa.array([codec.encode(t) + end for t in texts], pa.binary())], names=["id", "ids"])
        release()

    return run


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """(id, ids): each row's id as a long and its token ids with the end id last, packed little-endian at ``width`` bytes.

    The tokenizer, a JSON file of the tokenizers library that lies on the driver, must split at white space and be of the kind that
    _PARTS states; special tokens in a text are found as the library finds them. Null and empty texts have the end id alone; very long
    texts are encoded slice by slice.
    """
    return _texts(docs, id_col, text_col).mapInArrow(encoder(docs.sparkSession, tokenizer_path, end_id, width), "id long, ids binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))


FILES = "part int, number int, name string, n_docs long, n_ids long"


def writer(folder: str, width: int, file_ids: int, file_docs: int):
    """A function for mapInArrow that writes rows (id, ids) as files, in the order they come, and gives the files' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        part, done, now, name = TaskContext.get().partitionId(), [], None, ""
        for b in batches:
            for key, ids in zip(b["id"].to_pylist(), b["ids"]):
                ids = ids.as_py()
                if now is not None and (now.n_ids + len(ids) // width > file_ids or len(now.ends) >= file_docs):
                    done.append((part, len(done), name, *now.close()))
                    now = None
                if now is None:
                    name = f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                    now = Writer(system.open_output_stream(f"{path}/{name}"), width)
                now.add(key, ids)
        if now is not None:
            done.append((part, len(done), name, *now.close()))
        yield table_of(done, FILES)

    return run


def token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encodes docs, as encoded() does, and writes them into the folder in ascending order of id; the files' table (part, number, name,
    n_docs, n_ids, start), already written, where start is how many ids lie before the file.

    Null ids come first; rows that share an id are documents of their own, ordered by a hash of their text. Texts are sorted, not ids, so
    that each is shuffled once and encoded where it is written. Without rows there are no files. The folder must be one that driver and
    executors share; it is made if it isn't there. Other columns are ignored, whatever their names.
    """
    system, path = opened(folder)
    system.create_dir(path)
    encode, write = encoder(docs.sparkSession, tokenizer_path, end_id, width), writer(folder, width, file_ids, file_docs)
    ordered = _texts(docs, id_col, text_col).sort(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    files = cut_table(ordered.mapInArrow(lambda batches: write(encode(batches)), FILES))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(fields), fields)], schema=fields)


def read(files: DataFrame, folder: str, columns: str, row) -> DataFrame:
    """(doc_id, start, columns): a row for each document in the files; row: a function of its token ids that gives the columns as a tuple."""
    schema = f"doc_id long, start long, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for b in batches:
            for name, start in zip(b["name"].to_pylist(), b["start"].to_pylist()):
                with system.open_input_file(f"{path}/{name}") as file:
                    rows, held = [], 0
                    for key, at, ids in Reader(file).documents():
                        rows.append((key, start + at, *row(ids)))
                        held += len(ids)
                        if held >= SLICE:
                            yield table_of(rows, schema)
                            rows, held = [], 0
                    yield table_of(rows, schema)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("name", "start").repartition(tasks, "name").mapInArrow(run, schema)


def documents(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) as they lie in the files."""
    return read(files, folder, "ids array<int>", lambda ids: (ids.astype(np.int32),))


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """documents as token files below the shared folder, read back: one row for each row, null ids first."""
    import public_tokenizers

    cut_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    files = token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(files, folder, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
