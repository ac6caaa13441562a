"""Repetition inside a single page.

Six rules look at a page and vote repetitive (1), fine (-1) or abstain (0).
Expectation-maximisation over the counts of vote patterns estimates how often
each rule is right when it votes; an abstention says nothing. The posterior
of a page's pattern takes the place of a filter that all rules must pass:
pages likely enough repetitive are held against the exact share of words that
stand in a run of four that stood before. No rule looks at that share.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.common import checkpoint, latest_lines, norm_key, table

RUN = 4
RULES = ("pairs", "triples", "distinct", "lines", "fives", "top_pair")
# Share of repetitive pages before any vote, fixed: a page without votes keeps it.
BALANCE = 0.05
# Every rule is taken to be better than chance: its accuracy is kept in these bounds.
LEAST_RIGHT, MOST_RIGHT = 0.6, 0.97
# From this posterior on a page is held against the exact share. Two votes for and none against reach it at the least accuracy.
LIKELY = 0.1
CHUNK = 50_000  # words measured together, whole pages; the results don't depend on it
WORD = r"[\p{L}\p{M}\p{N}]+"
_FIND = regex.compile(WORD).findall


class Pages:
    """Words of successive pages, numbered, and what is measured of them all at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.lines, self.ends = array("q"), array("q"), array("q")  # word numbers, words of each line, lines up to the end of each page

    def line(self, text: str) -> None:
        found = _FIND(text.lower())
        number = self.number
        self.words.extend([number.setdefault(w, len(number)) for w in found])
        self.lines.append(len(found))

    def end(self) -> None:
        self.ends.append(len(self.lines))

    def measures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, exact share or NaN without words, votes of the rules) of each page.

        With at least a third of the words in repeated runs of four, at least
        a quarter of the pairs and a sixth of the triples have stood before
        and at most two thirds of the words are different. So such a page has
        the votes of the first two rules and none against.
        """
        word, per_line, ends = np.array(self.words, dtype=np.int64), np.array(self.lines, dtype=np.int64), np.array(self.ends, dtype=np.int64)
        k = len(ends)
        page_of_line = np.repeat(np.arange(k), np.diff(ends, prepend=0))
        page = np.repeat(page_of_line, per_line)
        n = np.bincount(page, minlength=k)
        of_page = lambda mask, where: np.bincount(where[mask], minlength=k)
        # the number of each run of one to five words, told by page
        _, first, code = np.unique(page * (len(self.number) + 1) + word, return_index=True, return_inverse=True)
        distinct = np.bincount(page[first], minlength=k)
        one, size = code, len(first)
        again, most = {}, {}
        for run in range(2, 6):
            m = len(word) - run + 1
            if m <= 0:
                again[run], most[run] = np.zeros(0, dtype=bool), np.zeros(k, dtype=np.int64)
                code = np.zeros(0, dtype=np.int64)
                continue
            _, first, code = np.unique(code[:m] * size + one[run - 1 :], return_index=True, return_inverse=True)
            whole = page[:m] == page[run - 1 :]
            again[run] = whole & (first[code] != np.arange(m))
            most[run] = np.zeros(k, dtype=np.int64)
            np.maximum.at(most[run], page[first[whole[first]]], np.bincount(code)[whole[first]])
        marks = np.zeros(len(word) + 1, dtype=np.int64)
        at = np.flatnonzero(again[RUN])
        marks[at] += 1
        np.add.at(marks, at + RUN, -1)
        covered = of_page(np.cumsum(marks[:-1]) > 0, page)
        share = np.where(n > 0, covered / np.maximum(n, 1), np.nan)
        pairs, triples = of_page(again[2], page[: len(again[2])]), of_page(again[3], page[: len(again[3])])
        repeated = of_page(self._lines_again(one, per_line, page_of_line), page)

        def vote(yes: np.ndarray, no: np.ndarray | bool = False) -> np.ndarray:
            return np.where(n < RUN, 0, np.where(yes, 1, np.where(no, -1, 0)))

        votes = np.stack([
            vote(4 * pairs >= n, 8 * pairs < n),
            vote(6 * triples >= n, 12 * triples < n),
            vote(5 * distinct <= 2 * n, 4 * distinct > 3 * n),
            vote(5 * repeated >= n),
            vote(most[5] >= 3),
            vote(most[2] >= np.maximum(4, n / 20)),
        ], axis=1)
        return n, share, votes

    @staticmethod
    def _lines_again(one: np.ndarray, per_line: np.ndarray, page_of_line: np.ndarray) -> np.ndarray:
        """Of each word, whether its line, of three words or more, stood before on the page."""
        ids: dict[tuple, int] = {}
        out = np.zeros(len(one), dtype=bool)
        end = np.cumsum(per_line)
        for hi, size, page in zip(end.tolist(), per_line.tolist(), page_of_line.tolist(), strict=True):
            if size >= 3:
                key = (page, one[hi - size : hi].tobytes())
                if key in ids:
                    out[hi - size : hi] = True
                ids[key] = 1
        return out


def weigh(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of repetitive for each vote pattern, from pattern counts, by expectation-maximisation.

    A rule is right with a probability that does not depend on the kind of
    page; that is estimated, with pseudo-counts for 0.8 that keep it sensible
    where a rule seldom votes. The share of repetitive pages is fixed, and
    abstentions are no evidence, so a page without votes has that share as
    posterior.
    """
    if not patterns:
        return {}
    votes = np.array(list(patterns))
    count = np.array(list(patterns.values()), dtype=float)
    right = np.full(votes.shape[1], 0.8)
    base = np.log(BALANCE / (1 - BALANCE))
    cast = (votes != 0) * count[:, None]
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-base - votes @ np.log(right / (1 - right))))
        agrees = np.where(votes > 0, post[:, None], 1 - post[:, None])
        right = np.clip(((cast * agrees).sum(axis=0) + 20 * 0.8) / (cast.sum(axis=0) + 20), LEAST_RIGHT, MOST_RIGHT)
    post = 1 / (1 + np.exp(-base - votes @ np.log(right / (1 - right))))
    return dict(zip(patterns, post.tolist(), strict=True))


def page_measures(lines: DataFrame) -> DataFrame:
    """(page_id, n_words, share, votes) per page from the latest reading of each line.

    Lines without text count nothing; lines with a null page_id belong to no
    page; ties in reading_order go by block, line and uid; a page whose lines
    hold no word has a null share and only abstentions. An empty table gives
    no rows. Pages come as a sorted stream of lines, so a page of any length
    takes the same path and only its word numbers are held.
    """
    keys = ["reading_order", "block_id", "line_id", "line_uid"]
    rows = (
        latest_lines(lines, "page_id", "reading_order", "block_id", "line_id", "text")
        .withColumn("page_id", norm_key(F.col("page_id")))
        .filter(F.col("page_id").isNotNull() & (F.length("text") > 0))
    )
    ordered = rows.select("page_id", *keys, "text").repartition("page_id").sortWithinPartitions("page_id", *keys).select("page_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, names = Pages(), []

        def flush() -> pa.RecordBatch:
            n, share, votes = pages.measures()
            columns = [pa.array(names, pa.string()), pa.array(n, pa.int32()), pa.array(share, pa.float64(), from_pandas=True), pa.array(votes.tolist(), pa.list_(pa.int32()))]
            pages.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "n_words", "share", "votes"])

        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if names and page != names[-1]:
                    pages.end()
                    if len(pages.words) >= CHUNK:
                        yield flush()
                if not names or page != names[-1]:
                    names.append(page)
                pages.line(text)
        if names:
            pages.end()
            yield flush()

    return ordered.mapInArrow(run, "page_id string, n_words int, share double, votes array<int>")


def repeated_pages(lines: DataFrame, least: float = 1 / 3, likely: float = LIKELY) -> DataFrame:
    """(page_id, n_words, share, posterior, repetitive) of each page with lines.

    Only the counts of vote patterns (at most 3 to the power of the number of
    rules) reach the driver. repetitive: the posterior is at least `likely`
    and then the exact share at least `least`.
    """
    pages = checkpoint(page_measures(lines))
    patterns = {tuple(r.votes): r.n for r in pages.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = weigh(patterns)
    table_of = pages.sparkSession.createDataFrame([(list(k), p) for k, p in post.items()], "votes array<int>, posterior double")
    # at most 729 rows
    judged = pages.join(F.broadcast(table_of), "votes")
    return judged.select("page_id", "n_words", "share", "posterior", F.coalesce((F.col("posterior") >= likely) & (F.col("share") >= least), F.lit(False)).alias("repetitive"))


def p4_found(spark, d):
    return repeated_pages(table(spark, d, "ocr_lines")).filter("repetitive").select("page_id")


def p4_shares(spark, d):
    """Share of repeated text of every page with a word."""
    return page_measures(table(spark, d, "ocr_lines")).filter("n_words > 0").select("page_id", "n_words", "share")


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}

_SHARES = """
WITH latest AS (
  SELECT DISTINCT ON (lower(trim(line_uid))) lower(trim(line_uid)) AS line_uid, lower(trim(page_id)) AS page_id, reading_order, block_id, line_id, text
  FROM ocr_lines WHERE line_uid IS NOT NULL ORDER BY lower(trim(line_uid)), generated_at DESC),
words AS (
  SELECT page_id, reading_order, block_id, line_id, line_uid, unnest(w) AS w, generate_subscripts(w, 1) AS k
  FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM latest WHERE page_id IS NOT NULL)),
placed AS (SELECT page_id, w, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, block_id, line_id, line_uid, k) AS pos FROM words),
grams AS (
  SELECT page_id, pos, CASE WHEN lead(w, 3) OVER o IS NOT NULL
    THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) END AS g
  FROM placed WINDOW o AS (PARTITION BY page_id ORDER BY pos)),
again AS (
  SELECT page_id, pos, CASE WHEN g IS NOT NULL AND pos > min(pos) OVER (PARTITION BY page_id, g) THEN 1 ELSE 0 END AS r FROM grams),
covered AS (SELECT page_id, max(r) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM again),
shares AS (SELECT page_id, CAST(count(*) AS INTEGER) AS n_words, avg(c) AS share FROM covered GROUP BY 1)
"""
SQL = {
    "p4_found": _SHARES + "SELECT page_id FROM shares WHERE share >= 1.0 / 3",
    "p4_shares": _SHARES + "SELECT page_id, n_words, share FROM shares",
}
