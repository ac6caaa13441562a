"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Prefix dynamic programming: for every byte prefix of a piece of text there is
exactly one token that a valid encoding of the prefix can end with. The table
of these last tokens is filled from left to right: a token ending at byte i is
right when the pair (last token of the prefix before it, token) is one that
the merge procedure itself would leave standing. Appending bytes extends the
table without touching what is there; an edit fills it again only near by.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.common import spread, vocab_path

# fixed value: how the vocabulary byte_bpe_50k cuts text into pieces before merging
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings, with the memoised question whether two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._beside: dict[tuple[int, int], bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The defining procedure: always join the neighbouring pair of lowest rank. For short strings."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 1_000_000:
                self._beside.clear()
            known = self._beside[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class PrefixTable:
    """last[i]: the only valid last token of the first i bytes of one piece."""

    def __init__(self, vocab: Vocabulary, raw: bytes = b""):
        self.vocab, self.raw, self.last = vocab, b"", [-1]
        self.filled = 0  # entries worked out so far
        self.append(raw)

    def append(self, more: bytes) -> PrefixTable:
        """Exact append: earlier entries never change."""
        start = len(self.raw)
        self.raw += more
        self.filled += len(more)
        rank, beside, longest, raw, last = self.vocab.rank, self.vocab.beside, self.vocab.longest, self.raw, self.last
        for end in range(start + 1, len(raw) + 1):
            for begin in range(max(0, end - longest), end):
                token = rank.get(raw[begin:end])
                if token is None:
                    continue
                if beside(last[begin], token) if begin else self.vocab.merge(raw[:end]) == [token]:
                    last.append(token)
                    break
        return self

    def edit(self, begin: int, end: int, replacement: bytes) -> PrefixTable:
        """Replace raw[begin:end]. Entries up to begin are kept, and so are those from where the old and the new table agree for as long as the longest token.

        An entry depends on the bytes and entries within the longest token's
        length before it, so from there on nothing differs.
        """
        old_raw, old_last = self.raw, self.last
        shift, tail = len(replacement) - (end - begin), begin + len(replacement)
        self.raw, self.last = old_raw[:begin], old_last[: begin + 1]
        self.append(replacement)
        agree = int(self.last[tail] == old_last[end])
        while len(self.raw) < len(old_raw) + shift and agree < self.vocab.longest:
            at = len(self.raw)
            self.append(old_raw[at - shift : at - shift + self.vocab.longest - agree])
            for place in range(at + 1, len(self.raw) + 1):
                agree = agree + 1 if self.last[place] == old_last[place - shift] else 0
        at = len(self.raw)
        self.raw += old_raw[at - shift :]
        self.last += old_last[at - shift + 1 :]
        return self

    def tokens(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at])
            at -= len(self.vocab.bytes_of[self.last[at]])
        return out[::-1]


class _Cache(dict):
    """Piece -> ids; emptied when it has grown to a fixed size, so memory is bounded."""

    def __init__(self, vocab: Vocabulary, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.vocab, self.most, self.longest = vocab, most, longest

    def __missing__(self, piece: str) -> list[int]:
        ids = PrefixTable(self.vocab, piece.encode("utf-8", "surrogatepass")).tokens()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        self.cut, self.pieces = regex.compile(PIECES).findall, regex.compile(PIECES).finditer
        self.cache = _Cache(Vocabulary(path))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.cut(text or ""):
            out += cache[piece]
        return out


class Document:
    """A text with its pieces and their ids; an edit or append cuts and encodes again only what is near it."""

    def __init__(self, encoder: Encoder, text: str | None):
        self.encoder, self.text = encoder, text or ""
        self.starts, self.ids = [], []
        self.encoded = 0  # pieces encoded so far
        for m in encoder.pieces(self.text):
            self._add(self.starts, self.ids, m)

    def _add(self, starts: list[int], ids: list[list[int]], m) -> None:
        starts.append(m.start())
        ids.append(self.encoder.cache[m.group()])
        self.encoded += 1

    def append(self, more: str) -> Document:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, replacement: str) -> Document:
        """Replace text[begin:end].

        A piece is cut without looking back and at most one character past
        the next piece's begin, so pieces that end two pieces before the edit
        stay, and so do those after it from the first place on where the old
        and the new text are cut alike.
        """
        shift, tail = len(replacement) - (end - begin), begin + len(replacement)
        self.text = self.text[:begin] + replacement + self.text[end:]
        keep = max(0, bisect_right(self.starts, begin) - 3)
        from_ = self.starts[keep] if self.starts else 0
        starts, ids = self.starts[:keep], self.ids[:keep]
        after, more = [], []
        for m in self.encoder.pieces(self.text, from_):
            if m.start() >= tail:
                k = bisect_left(self.starts, m.start() - shift)
                if k < len(self.starts) and self.starts[k] == m.start() - shift:
                    after, more = [x + shift for x in self.starts[k:]], self.ids[k:]
                    break
            self._add(starts, ids, m)
        self.starts, self.ids = starts + after, ids + more
        return self

    def tokens(self) -> list[int]:
        return [t for piece in self.ids for t in piece]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Null and empty text both give the empty list; a null id is kept; repeated
    rows are each encoded; strings that look like special tokens are ordinary
    text; whole texts whatever their length (time is linear in it). No
    shuffle: one narrow pass over two columns. An empty table gives none.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            lo = 0
            texts = batch.column(1)
            while lo < batch.num_rows:
                hi, size = lo, 0
                rows = []
                while hi < batch.num_rows and (size < 4_000_000 or hi == lo) and hi - lo < 2000:
                    ids = enc.encode(texts[hi].as_py())
                    rows.append(np.asarray(ids, dtype=np.int32))
                    size += len(ids)
                    hi += 1
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])
                lo = hi

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), True))])
    return spread(docs.select(id_col, F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def p6_ids(spark, d):
    from paperloom.common import table

    return encode_corpus(table(spark, d, "documents"), vocab_path("byte_bpe_50k.tiktoken"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
