"""Evaluation texts leaking into training text.

A positional inverted index of the training documents is built once and kept
as a table: for every segment (about a million words of whole documents) and
every word the sorted positions at which it stands. A set of test items is
searched in the index alone. A stretch of a test item that has at most one
changed word in eight contains five unbroken words, so of every five words of
an item one has to be looked up: the cover with the fewest postings in the
whole corpus is taken. The postings of these rarest words, moved by their
offsets in the item, are intersected with those of their neighbours; what is
left is extended over changed, added and missing words (proximity match).
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.common import checkpoint, shared_folder, spread, table

SEED = 5  # unbroken words that every stretch has
SEGMENT_WORDS = 1_000_000
# Words of test items searched together in one segment. More items are further blocks.
BLOCK_WORDS = 200_000
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
_BROKEN = regex.compile(r"(?<=\p{L})[-­‐¬]\s*\n\s*(?=\p{Ll})")
_INVISIBLE = regex.compile(r"\p{Cf}")


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing, invisible characters and breaks at line ends."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text.replace("­", "-" if "­\n" in text else "")))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD(text.lower())


def pack(places: np.ndarray) -> bytes:
    """Sorted positions as differences in the fewest bytes each."""
    gaps = np.diff(places, prepend=0)
    top = int(gaps.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1), dtype=np.int64)


class Segment:
    """Words of successive documents, documents SEED apart, on their way into the index."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words, self.starts, self.ids = array("i"), array("q"), []

    def add(self, doc, text: str | None) -> None:
        number = self.number
        self.ids.append(doc)
        self.starts.append(len(self.words))
        self.words.extend([number.setdefault(w, len(number)) for w in words(text)])
        self.words.extend([-1] * SEED)

    def rows(self, segment: int, id_type: pa.DataType) -> pa.RecordBatch:
        """The documents' row, whose word is empty, then one row per word, in order."""
        flat = np.array(self.words, dtype=np.int32)
        order = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat + 1, minlength=len(self.number) + 1))
        tokens = sorted(self.number)
        found = [order[ends[k] : ends[k + 1]] for k in (self.number[t] for t in tokens)]
        starts = np.append(np.array(self.starts, dtype=np.int64), len(flat))
        return pa.RecordBatch.from_arrays([
            pa.array([segment] * (1 + len(tokens)), pa.int64()), pa.array(["", *tokens]), pa.array([len(self.ids), *map(len, found)], pa.int32()),
            pa.array([pack(starts), *map(pack, found)], pa.binary()), pa.array([self.ids, *[None] * len(tokens)], pa.list_(id_type)),
        ], names=["segment", "token", "n", "places", "ids"])


class Index:
    """A positional index kept in a folder; search as often as wanted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, segment_words: int = SEGMENT_WORDS) -> Index:
        """Index of (doc_id, text), written to `path` or the shared folder: (segment, token, n, places, ids).

        Null and empty texts have no words; null doc_ids are left out;
        repeated documents are each indexed; whole texts whatever their
        length. One pass over the corpus, no shuffle: a task writes its own
        segments, each sorted by word.
        """
        spark = docs.sparkSession
        path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        docs = spread(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()))
        kind = docs.schema["doc_id"].dataType
        arrow_kind = to_arrow_type(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, part = TaskContext.get().partitionId() << 32, Segment()
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part.add(doc, text)
                    if len(part.words) >= segment_words:
                        yield part.rows(number, arrow_kind)
                        number, part = number + 1, Segment()
            if part.ids:
                yield part.rows(number, arrow_kind)

        schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("token", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("ids", T.ArrayType(kind))])
        docs.mapInArrow(run, schema).write.parquet(path)
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, version, size, place, token) of every word of every test item; version tells texts of one id apart."""
    items = items.select("item_id", F.xxhash64("text").alias("version"), "text").filter(F.col("item_id").isNotNull()).distinct()
    kind = items.schema["item_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = words(batch.column(2)[k].as_py())
                n = len(found)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n, arrow_kind), pa.array([batch.column(1)[k].as_py()] * n, pa.int64()), pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(found)], names=["item_id", "version", "size", "place", "token"])

    schema = T.StructType([T.StructField("item_id", kind), T.StructField("version", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("token", T.StringType())])
    return items.mapInArrow(run, schema)


def cheapest_cover(cost: list[int], window: int = SEED) -> list[int]:
    """Places of which every `window` successive ones (all, if there are fewer) hold one, with the least total cost, by dynamic programming."""
    n = len(cost)
    window = min(window, n)
    total, back = [], []
    for i in range(n):
        if i < window:
            total.append(cost[i])
            back.append(-1)
        else:
            j = min(range(i - window, i), key=total.__getitem__)
            total.append(total[j] + cost[i])
            back.append(j)
    out = []
    i = min(range(n - window, n), key=total.__getitem__, default=-1)
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _rarest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks the words of an item to look up."""
    pdf = pdf.sort_values("place", ignore_index=True)
    lead = np.zeros(len(pdf), dtype=bool)
    lead[cheapest_cover([int(x) + 1 for x in pdf["n"]])] = True
    return pdf.drop(columns="n").assign(lead=lead)


def _extend(a: list[int], b: list[int], i: int, j: int, step: int, lo: int, hi: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Follow a from i and b from j in direction step over single edits; (item end, text end, [(edits, words) after each word])."""
    edits, marks = 0, []
    n = len(a)
    end_i, end_j = i, j
    while 0 <= i < n and lo <= j < hi:
        if a[i] == b[j]:
            end_i, end_j = i, j
            marks.append((edits, i, j))
            i += step
            j += step
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (1, 2), (2, 1), (2, 0), (0, 2), (3, 3)):
            x, y, good = i + di * step, j + dj * step, 0
            while good < 2 and 0 <= x < n and lo <= y < hi and a[x] == b[y]:
                x += step
                y += step
                good += 1
            if good == 2 or good and not 0 <= x < n:
                break
        else:
            break
        edits += max(di, dj)
        if edits * 4 > len(marks) + 8:
            break
        i += di * step
        j += dj * step
    return end_i, end_j, marks


def best_stretch(a: list[int], b: list[int], i: int, j: int, lo: int, hi: int, one_in: float = 8.0, slack: float = 1.0) -> tuple[int, int, int, int]:
    """(words of a, edits, first and last word of a) of the longest stretch of item a through (i, j) in text b[lo:hi] with about one edit in so many words."""
    _, _, right = _extend(a, b, i, j, 1, lo, hi)
    _, _, left = _extend(a, b, i - 1, j - 1, -1, lo, hi)
    best = (0, 0, i, i)
    ls = [(0, i, j)] + left
    for el, il, _ in ls[::-1]:
        for er, ir, _ in right[::-1]:
            span = ir - il + 1
            if span <= best[0]:
                break
            if (el + er) * one_in <= span + slack:
                best = (span, el + er, il, ir)
                break
    return best


def _interrupted(parts: list[tuple[int, int]], n: int) -> int:
    """Words of a whole item of n that two stretches, one after the other, make up but for one in eight; else 0."""
    head = max((r + 1 for f, r in parts if f <= n // 8), default=0)
    tail = min((f for f, r in parts if r >= n - 1 - n // 8), default=n)
    got = n - max(0, tail - head)
    return got if head and tail < n and (n - got) * 8 <= n else 0


def best_hit(a: list[int], b: list[int], pairs: list[tuple[int, int]], lo: int, hi: int, least: int) -> tuple[int, int] | None:
    """(words, edits) of the longest leak of item a in text b[lo:hi] that goes through the unbroken run at any of the pairs of places, None if there is none."""
    best, parts = (0, 0), []
    last: dict[int, int] = {}  # where the last run followed on a diagonal ends
    for i, j in pairs:
        if j < last.get(j - i, -1):
            continue
        end = 0
        while i + end < len(a) and j + end < hi and a[i + end] == b[j + end]:
            end += 1
        last[j - i] = j + end
        while i and j > lo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        span, edits, head, tail = best_stretch(a, b, i, j, lo, hi)
        parts.append((head, tail))
        if span >= min(least, len(a)):
            best = max(best, (span, -edits))
    if len(parts) > 1 and (span := _interrupted(parts, len(a))) and span > best[0]:
        best = (span, 0)
    return (best[0], -best[1]) if best[0] else None


def search_segment(pdf: pd.DataFrame, least: int) -> list[tuple]:
    """(document, item, words, edits) of each leak in one segment; pdf holds the segment's documents row and the postings of the items' words with their uses."""
    head = pdf[pdf["token"] == ""]
    rows = pdf[pdf["token"] != ""].sort_values("token", ignore_index=True)
    if head.empty or rows.empty:
        return []
    docs, starts = list(head["ids"].iloc[0]), unpack(head["places"].iloc[0])
    postings = [unpack(x) for x in rows["places"]]
    flat = np.zeros(int(starts[-1]) + 2 * SEED, dtype=np.int32)  # SEED places before the first word
    for k, at in enumerate(postings):
        flat[at + SEED] = k + 1
    # the items, words that don't stand in this segment as -1
    size_of: dict[tuple, int] = {}
    number: dict[tuple, int] = {}
    uses = []
    for k, (ids, versions, sizes, places, leads) in enumerate(zip(rows["item_ids"], rows["versions"], rows["sizes"], rows["places_of"], rows["leads"], strict=True)):
        for i, v, n, place, lead in zip(ids, versions, sizes, places, leads, strict=True):
            owner = number.setdefault((i, v), len(number))
            size_of[owner] = n
            uses.append((owner, place, k, lead))
    names = [i for i, _ in number]
    first = np.concatenate([[0], np.cumsum([size_of[k] + 2 * SEED for k in range(len(names))])])
    item = np.full(int(first[-1]), -1, dtype=np.int32)  # each item with SEED places around it
    for owner, place, k, _ in uses:
        item[first[owner] + SEED + place] = k + 1
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for owner, place, k, lead in uses:
        if not lead:
            continue
        at = postings[k] + SEED
        here = int(first[owner]) + SEED + place
        n = size_of[owner]
        if n > 1:  # a neighbour must fit before anything else is looked at
            at = at[(flat[at + 1] == item[here + 1]) | (flat[at - 1] == item[here - 1])]
        if not len(at):
            continue
        run = np.ones(len(at), dtype=np.int64)
        for step in (1, -1):
            going = np.ones(len(at), dtype=bool)
            for d in range(1, SEED):
                going &= flat[at + step * d] == item[here + step * d]
                run += going
        at = at[run >= min(SEED, n)] - SEED
        for doc, j in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(), strict=True):
            found.setdefault((doc, owner), []).append((place, j))
    out = []
    text = flat[SEED:].tolist() if found else []
    for (doc, owner), pairs in sorted(found.items()):
        a = item[first[owner] + SEED : first[owner + 1] - SEED].tolist()
        hit = best_hit(a, text, sorted(pairs, key=lambda x: x[1]), int(starts[doc]), int(starts[doc + 1]) - SEED, least)
        if hit:
            out.append((docs[doc], names[owner], *hit))
    return out


def search(index: Index, items: DataFrame, least: int = 15, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words): indexed documents that hold a whole test item or a stretch of at least `least` of its words.

    n_words is the longest stretch. Null or empty texts hold nothing; items
    of any length are searched, those of one word too; repeated documents are
    each reported, ids that come twice give the longer stretch. A null
    item_id is left out; extra columns are ignored; without items or
    documents there are no rows. Only the postings of words that some item
    has are read, and they are shuffled by segment; the items travel to them
    by a join, in blocks of about `block_words` words.
    """
    spark = index.spark
    rows = index.rows()
    tokens = checkpoint(item_words(items))
    total = tokens.count()
    blocks = max(1, math.ceil(total / block_words))
    # words of one block are of bounded size; more go by a merge
    small = (lambda df: F.broadcast(df)) if total <= BLOCK_WORDS else (lambda df: df.hint("merge"))
    frequency = rows.select("token", "n").join(small(tokens.select("token").distinct()), "token").groupBy("token").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    known = tokens.join(frequency, "token", "left").select("item_id", "version", "size", "place", "token", F.coalesce("n", F.lit(0)).alias("n"))
    marked = known.groupBy("item_id", "version").applyInPandas(_rarest, T.StructType([*[f for f in known.schema.fields if f.name != "n"], T.StructField("lead", T.BooleanType())]))
    use = F.struct("item_id", "version", "size", "place", "lead")
    uses = marked.groupBy(F.pmod(F.xxhash64("item_id", "version"), F.lit(blocks)).alias("block"), "token").agg(F.collect_list(use).alias("u"))
    lists = [F.col(f"u.{c}").alias(a) for c, a in (("item_id", "item_ids"), ("version", "versions"), ("size", "sizes"), ("place", "places_of"), ("lead", "leads"))]
    uses = uses.select("block", "token", *lists)
    # the row of a segment's documents goes to every block
    heads = uses.select("block").distinct().select("block", F.lit("").alias("token"), *[F.lit(None).cast(uses.schema[c].dataType).alias(c) for c in uses.columns[2:]])
    needed = rows.drop("n").join(small(checkpoint(uses.unionByName(heads))), "token")
    kinds = [rows.schema["ids"].dataType.elementType, items.schema["item_id"].dataType]
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), T.StructField("n_words", T.IntegerType()), T.StructField("n_edits", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(search_segment(pdf, least), columns=schema.names)

    found = needed.groupBy("segment", "block").applyInPandas(run, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 15) -> DataFrame:
    """search() in an index made for this once."""
    return search(Index.build(docs), items, least)


def p7_found(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark, d):
    """Leaked test items with the number of documents that hold them."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
