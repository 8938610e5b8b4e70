"""SentencePiece BPE encoding and decoding with a prefix table.

Every prefix of a text has one BPE encoding, so it has one last token. Left to right, an automaton over all pieces lists the
pieces that end at a position; a piece is the prefix's last token iff it starts where the prefix before it ends and is
compatible with that prefix's last token (the two, joined, encode to themselves). Ids are then read off backwards from the end.
Work is linear in the text for any word length. Pieces never cross from a letter to a following space mark, and characters
that no piece holds (line feeds, for one) are encoded alone as bytes; both are checked against the model, and cut a text into
chunks which are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import table

MARK = "▁"
#: Characters of texts whose ids are held before they are passed on, about.
SLICE = 1_000_000


@dataclass
class PieceTable:
    """What encoding needs of a model: bounded by its vocabulary, whatever the data."""

    ids: dict[str, int]
    rank: dict[str, float]
    halves: dict[str, tuple[str, str]]
    byte_ids: list[int]
    unk: int
    eos: int
    dummy_prefix: bool


def merged(text: str, rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE by its definition: join the best-ranked neighbours, leftmost first, until none is a piece; also the last join."""
    parts, last = list(text), None
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts, last
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def read_model(path: str) -> PieceTable:
    """Read a BPE model; pieces that their own text doesn't encode to can't occur and are left out of the table of halves."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): i for i in normal}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this model cross word starts")
    rank = {p: -sp.get_score(i) for p, i in pieces.items()}
    halves = {}
    for p in pieces:
        if len(p) > 1:
            parts, last = merged(p, rank)
            if len(parts) == 1:
                halves[p] = last
    return PieceTable(pieces, rank, halves, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.unk_id(), sp.eos_id(), sp.encode("a", out_type=str) != ["a"])


class Codec:
    """Encodes and decodes with a PieceTable; the ids of chunks seen before are kept, up to a bound."""

    def __init__(self, t: PieceTable):
        import ahocorasick

        self.t, self.odd, self.chunks, self.spaced = t, {}, Chunks(self), Chunks(self, MARK)
        self.chars, self.numbers = {p for p in t.ids if len(p) == 1}, {p: str(i) for p, i in t.ids.items()}
        #: For each piece, which pieces before it have been found to be compatible or not; how many of both are held.
        self.after, self.held = {p: {} for p in t.halves}, 0
        self.long = ahocorasick.Automaton()
        for p in t.halves:
            self.long.add_word(p, (p, len(p) - 1, self.after[p]))
        self.long.make_automaton()
        self.text_of = {i: p.replace(MARK, " ").encode() for p, i in t.ids.items()} | {i: bytes([b]) for b, i in enumerate(t.byte_ids)}
        alone = "" if "\n" in "".join(t.ids) else "\n"
        self.breaks = bool(alone)
        self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + "|\n" * bool(alone))

    def compatible(self, a: str, b: str) -> bool:
        """Whether a then b is what their joined text encodes to: undo the later of the two inner joins, step by step; a piece that
        spans the border and would be joined before the join just undone means that the pair can't stand."""
        known = self.after.setdefault(b, {}).get(a)
        if known is not None:
            return known
        rank, halves, x, y, below, ok = self.t.rank, self.t.halves, a, b, (float("inf"), 0), True
        while True:
            r = rank.get(x + y)
            if r is not None and (r, 0) < below:
                ok = False
                break
            rx, ry = (rank[x] if len(x) > 1 else -1.0), (rank[y] if len(y) > 1 else -1.0)
            if rx < 0 and ry < 0:
                break
            # Joins run by rank, then from the left: of equal ranks, the right one was the later.
            if rx > ry:
                below, x = (rx, 0), halves[x][1]
            else:
                below, y = (ry, 1), halves[y][0]
        if self.held >= 200_000:
            for before in self.after.values():
                before.clear()
            self.held = 0
        self.after[b][a] = ok
        self.held += 1
        return ok

    def word(self, s: str) -> list[str]:
        """Pieces of s, whose characters are all pieces."""
        n = len(s)
        if n == 1:
            return [s]
        last, done, compatible = ["", *s], -1, self.compatible
        for e, (p, before, known) in self.long.iter(s):
            if e == done:
                continue
            if before < e:
                b = last[e - before]
                ok = known.get(b)
                if not (compatible(b, p) if ok is None else ok):
                    continue
            last[e + 1], done = p, e
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        out.reverse()
        return out

    def chunk(self, s: str) -> list[int]:
        ids, at, chars = [], 0, self.chars
        for i, c in enumerate(s):
            if c not in chars:
                ids += [self.t.ids[p] for p in self.word(s[at:i])] if i > at else []
                ids += [self.t.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                at = i + 1
        return ids + [self.t.ids[p] for p in self.word(s[at:])] if at < len(s) else ids

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((" " * self.t.dummy_prefix + text).replace(" ", MARK))

    def encode(self, text: str | None) -> list[int]:
        """Ids, the end id last; null and empty texts: the end id alone."""
        return [*map(int, " ".join(self.parts(text)).split()), self.t.eos] if text else [self.t.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids have none, the prefixed space goes."""
        out = b"".join([self.text_of.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.t.dummy_prefix and out[:1] == " " else out

    def parts(self, text: str) -> list[str]:
        """Ids of the text's chunks, each as text; where no two spaces meet, str.split finds the chunks sooner than a pattern."""
        if not (self.t.dummy_prefix and self.breaks) or text[:1] == " " or "  " in text or MARK in text:
            return list(map(self.chunks.__getitem__, self.split(text)))
        lines = text.split("\n")
        out = list(map(self.spaced.__getitem__, lines[0].split(" ")))
        for line in lines[1:]:
            words = line.split(" ")
            out += [self.chunks["\n"], self.chunks[words[0]]] if words[0] else [self.chunks["\n"]]
            out += map(self.spaced.__getitem__, words[1:])
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and sha256 of the ids as text and of the decoded text."""
        ids = " ".join([*(self.parts(text) if text else []), str(self.t.eos)])
        decoded = text or ""
        if self.odd or MARK in decoded:
            decoded = "".join([self.odd.get(s, s) for s in self.split(decoded)]).replace(MARK, " ")
            decoded = decoded[1:] if self.t.dummy_prefix and decoded[:1] == " " else decoded
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


class Chunks(dict):
    """Ids, as text, of each chunk seen, ``before`` and a key. Pieces alone decode to their own text; each other new chunk's ids are decoded too: those that
    don't give the chunk again go to the codec's odd."""

    limit = 300_000

    def __init__(self, codec: Codec, before: str = ""):
        super().__init__()
        self.codec, self.before = codec, before

    def __missing__(self, word: str) -> str:
        s = self.before + word
        if len(self) >= self.limit:
            self.clear()
        if s and self.codec.chars.issuperset(s):
            out = " ".join(map(self.codec.numbers.__getitem__, self.codec.word(s)))
        else:
            ids = self.codec.chunk(s)
            decoded = b"".join([self.codec.text_of[i] for i in ids]).decode("utf-8", "replace")
            if decoded != s.replace(MARK, " "):
                self.codec.odd[s] = decoded
            out = " ".join(map(str, ids))
        if len(word) < 200:
            self[word] = out
        return out


_codecs: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """One codec for each Python worker and broadcast table, so that chunks are remembered from task to task."""
    if shared.bid not in _codecs:
        _codecs.clear()
        _codecs[shared.bid] = Codec(shared.value)
    return _codecs[shared.bid]


class Shared:
    """A broadcast with an id that survives pickling."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.bid = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "bid": self.bid}

    @property
    def value(self):
        return self.broadcast.value


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, columns: str, row) -> DataFrame:
    shared = Shared(docs.sparkSession, read_model(model_path))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, last, result = codec_of(shared), (), None
        for b in batches:
            size = b["text"].str.len().fillna(0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(b)]):
                out = []
                for t in b["text"].iloc[x:y]:
                    if t != last:  # a mix's copies of a document follow each other
                        last, result = t, row(codec, t)
                    out.append(result)
                yield pd.DataFrame({"id": b["id"].iloc[x:y].reset_index(drop=True)} | {c: pd.Series([z[i] for z in out], dtype=object) for i, c in enumerate(names)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): each text's ids, the end id last, and the text decoded from them. Null texts count as empty;
    every row gives a row, repeated or not; other columns are ignored. The model's path is read on the driver."""

    def row(codec: Codec, text: str | None) -> tuple:
        ids = codec.encode(text)
        return len(ids), np.array(ids, np.int32), codec.decode(ids)

    return _mapped(docs, model_path, id_col, text_col, "n_tokens long, ids array<int>, decoded string", row)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) with the same rules as encode(), without moving the ids themselves."""
    return _mapped(docs, model_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", Codec.digest)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
