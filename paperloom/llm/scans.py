"""Noise in text from scanned pages.

The lines of each page are read as one stream of characters in which blanks
and line ends are only likely places for a word to begin. A cheapest path
through the stream decides jointly where words begin and end: a word of the
lexicon may cross blanks (a word cut apart) and line ends (a broken word, with
or without a hyphen), may begin or end inside a token (words run together),
and may have confused characters anywhere; a token may also stand as it is.
Word costs come from counts over all lines. Running headers and page numbers
are taken off the edges first, and paragraph boundaries are chosen by dynamic
programming over the lines that stay.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.common import checkpoint, latest_lines, norm_key, table

CHUNK = 400  # lines of a page decoded together; the results don't depend on it
NEAR = 64  # the usual width of a line is that of the lines up to so many before and after it
# A word is in the lexicon from this share of all words on, so the lexicon has at most 1 / share entries.
LEAST_SHARE = 2e-6
# Words of at least this share of all words say nothing about headers.
COMMON = 3e-3

# fixed values: how recognisers confuse printed and handwritten characters (seen -> meant)
CONFUSED = {
    "c": "e", "é": "e", "v": "ruy", "0": "oa", "o": "a", "l": "i", "!": "i", "f": "t", "+": "t", "5": "s",
    "1": "li", "6": "b", "(": "ce", "9": "g", "b": "h", "a": "o", "i": "l", "e": "c", "u": "v", "n": ("u", "ri"), "8": "b", "3": "e", "$": "s", "@": "a", "q": "g",
    "ri": "n", "cl": "d", "rn": "m", "vv": "w", "lc": "k", "vi": "n", "c1": "d", "ii": "n", "li": "h", "m": ("rn",), "d": ("cl",),
}
FIRST, NEXT = 4.0, 1.5  # cost of the first confusion of a word and of each further one
# A confusion costs this share of its cost plus this share times the line's confidence: full cost at 0.8, the usual confidence, or without a valid one.
DOUBT = (0.6, 0.5)
RUN_TOGETHER = 6.0  # cost of a missing blank
RARE = 6.9  # two words that cost more each, one in a thousand, may be pieces of one
# cost of a blank in a word, of a line end in a word, of a hyphen and line end in a word
CROSS = {" ": 6.0, "\n": 6.0, "-": 1.0}
BREAKS = "-‐‑–—¬=­"
_EDGE = " .,;:?!\"'()[]{}*•>|/\\" + "“”‘’"
_HYPHEN_END = regex.compile(rf"(\p{{L}})[{BREAKS}]\s*$")
_NUMBER = regex.compile(r"\d")
_LETTERS = regex.compile(r"\p{L}")
_ROMAN = regex.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PAGE_LINE = regex.compile(r"^[\W_]*(p[\W_]*[ao0][\W_]*[g9][\W_]*[ecé]|p[g9]|p|no)?[\W_]*([\dilo!]+|[ivxlc]+)[\W_]*(?:(?:[o0][ft]|/)[\W_]*\d+)?[\W_]*$")
_ENDS = regex.compile(r"[.?!:]['\")]?\s*$")
_UID_PAGE = regex.compile(r"_p0*(\d{1,9})_b\d+_l\d+$")
_PAGE_MISREAD = regex.compile(r"(?i)\bp[o0][g9][ecé]\b")
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
_SEPARATE = regex.compile(r"[\s/,]+")
_MARKER = regex.compile(r"^\s*(?:[-*•]|->|\(?[ivx]+\)|\(?[a-z0-9]{1,2}[.)])\s|^\s*Q\d")


def core(token: str) -> str:
    return token.strip(_EDGE).rstrip(BREAKS + _EDGE).lower()


def roman(text: str) -> int | None:
    if not _ROMAN.fullmatch(text):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, text[1:] + " ", strict=True):
        total += -value[a] if value[a] < value.get(b, 0) else value[a]
    return total


def is_page_number(text: str, page: int | None) -> bool:
    """Whether the line only gives the number of its page, in Arabic or Roman numerals, digits perhaps misread."""
    m = _PAGE_LINE.match(text.lower())
    if not m or page is None:
        return False
    shown = m.group(2)
    if shown.isdigit():
        return int(shown) == page
    if roman(shown) == page:
        return True
    digits = shown.translate(str.maketrans("ilo!", "1101"))
    return digits.isdigit() and bool(m.group(1) or _NUMBER.search(shown)) and int(digits) == page


def confusions(k: int) -> float:
    """Cost of k confusions in a word."""
    return FIRST + NEXT * (k - 1) if k else 0.0


def doubt(confidence: float | None) -> float:
    """What the cost of a confusion is multiplied by, in steps of a tenth of confidence; null, NaN and values out of range say nothing."""
    return DOUBT[0] + DOUBT[1] * round(10 * confidence) / 10 if confidence is not None and 0 <= confidence <= 1 else 1.0


class Lexicon:
    """Word counts with the search for the likeliest reading of a token; readings are kept up to a fixed number."""

    def __init__(self, words: dict[str, tuple[int, int]], total: int, edge_total: int, templates: list[str] = ()):
        self.templates: dict[str, list[str]] = {}
        for t in templates:
            self.templates.setdefault(t.split(" ", 1)[0], []).append(t)
        self.total = max(total, 1)
        self.count = {w: n for w, (n, _) in words.items()}
        base = (edge_total + 1) / (self.total + 2)
        self.lift = {}
        for w, (n, e) in words.items():
            r = (e + 20 * base) / (n + 20)
            self.lift[w] = math.log(r / base * (1 - base) / (1 - r)) if r < 1 else 8.0
        self.trie: dict = {}
        for w, (n, _) in words.items():
            if n >= 3 and len(w) > 1 and n / self.total >= 4e-6 and _LETTERS.match(w):
                node = self.trie
                for ch in w:
                    node = node.setdefault(ch, {})
                node[""] = w
        self.longest = max(map(len, self.count), default=0)
        self.price = {w: -math.log(n / self.total) for w, n in self.count.items() if n}
        self.least = min(self.price.values(), default=0.0)  # no word costs less
        self.kept: dict[str, tuple[float, str, int]] = {}  # cheapest confused reading, without the cost of its confusions
        self.paths: dict[tuple, list] = {}
        self.tokens: dict[str, tuple] = {}

    def own(self, w: str) -> float:
        """Cost of the token as it stands; a token too rare to be trusted costs what an unknown one does."""
        n = self.count.get(w, 0)
        if n >= 3 and n / self.total >= 1e-5:
            return -math.log(n / self.total)
        return 12.0 + 0.6 * len(w) + 1.4 * max(0, len(w) - 12)

    def known(self, w: str) -> bool:
        n = self.count.get(w, 0)
        return n >= 3 and n / self.total >= 1e-5

    def reading(self, w: str, scale: float = 1.0) -> tuple[float, str, int]:
        """(cost, word, confusions) of the cheapest reading, where a confusion costs `scale` times its usual cost."""
        got = self.kept.get(w)
        if got is None:
            if len(self.kept) >= 300_000:
                self.kept.clear()
            got = self.kept[w] = self._search(w)
        own = self.own(w)
        cost = got[0] + scale * confusions(got[2])
        return (cost, got[1], got[2]) if cost < own else (own, w, 0)

    def _search(self, w: str) -> tuple[float, str, int]:
        best, least = (1e9, w, 0), 1e9
        if len(w) < 2 or len(w) > 2 * self.longest or "@" in w[1:-1] or _NUMBER.search(w) and sum(map(str.isalpha, w)) < 2:
            return best
        most = 1 + len(w) // 2
        stack = [(self.trie, 0, 0)]
        while stack:
            node, i, k = stack.pop()
            if i == len(w):
                word = node.get("")
                if word is not None and k:
                    cost = -math.log(self.count[word] / self.total)
                    if cost + confusions(k) < least:
                        best, least = (cost, word, k), cost + confusions(k)
                continue
            ch = w[i]
            if (nxt := node.get(ch)) is not None:
                stack.append((nxt, i + 1, k))
            if k < most:
                for size in (1, 2):
                    for meant in CONFUSED.get(w[i : i + size], "") if i + size <= len(w) else "":
                        sub = node
                        for c in meant:
                            sub = sub.get(c)
                            if sub is None:
                                break
                        if sub is not None:
                            stack.append((sub, i + size, k + 1))
        return best

    def token(self, t: str, scale: float = 1.0) -> tuple[float, str, int, str, bool, bool, bool]:
        """(cost, word, confusions, core, whether it may be half a word, whether the scale doesn't matter, whether it is a word as it stands that no other goes on in) of a token as it is written."""
        got = self.tokens.get(t)
        if got is None:
            if len(self.tokens) >= 300_000:
                self.tokens.clear()
            got = self.tokens[t] = (self._judged(t, 1.0), {})
        usual, scaled = got
        if scale == 1.0 or usual[5]:
            return usual
        if scale not in scaled:
            scaled[scale] = self._judged(t, scale)
        return scaled[scale]

    def _judged(self, t: str, scale: float) -> tuple:
        got = self._token(t, scale)
        return *got, got[0] <= RARE and not got[2] and not got[4] and " " not in got[1]

    def _token(self, t: str, scale: float) -> tuple[float, str, int, str, bool, bool]:
        """As token() with, last, whether no confusion is ever thought of, so the scale doesn't matter."""
        w = core(t)
        if not _LETTERS.search(w):
            return 2.0, w, 0, w, False, True
        if self.known(w):
            common = self.count[w] >= self.total * 3e-4
            plain = (self.own(w), w, 0) if common else self.reading(w, scale)
            return *plain, w, False, common or not self.kept[w][2]
        low = t.lower()
        forms = dict.fromkeys((w, low.strip(".,;:?\"'"), low.rstrip(BREAKS), low.strip(".,;:?\"'!" + BREAKS)))
        plain = min((self.reading(x, scale) for x in forms if x), default=(2.0, w, 0))
        sure = not any(self.kept.get(x, (0, x, 1))[2] for x in forms if x)  # kept may just have been cleared
        if len(w) > 3 and plain[0] > RUN_TOGETHER + 2 * self.least and w.isalnum() and w[0].isalpha() and w[-1].isalpha() and w in low and len(low) == len(t) and t[-1] not in BREAKS:
            path = self.decode((w,), "", (plain[0],), scale)
            if len(path) > 1:
                plain, sure = (path[-1][4], " ".join(x[2] for x in path), sum(len(x[3]) for x in path)), sure and not any(x[3] for x in path)
        return *plain, w, w.isalpha(), sure

    def decode(self, cores: tuple[str, ...], joins: str, prices: tuple[float, ...], scale: float = 1.0) -> list[tuple[int, int, str | None, tuple[int, ...], float]]:
        """Cheapest path through the characters of successive tokens: (begin, end, word, places of confusions, cost so far) of each piece.

        joins says what stands between two tokens (a key of CROSS), prices
        what each costs as it stands; such a piece has no word. A token alone
        that is seen far more often than its pieces run together by chance is
        one word.
        """
        key = (cores, joins, prices, scale)
        got = self.paths.get(key)
        if got is None:
            if len(self.paths) >= 200_000:
                self.paths.clear()
            got = self.paths[key] = self._decode(*key)
        return got

    def _decode(self, cores: tuple[str, ...], joins: str, prices: tuple[float, ...], scale: float) -> list[tuple]:
        text = "".join(cores)
        m = len(text)
        token_at, inner, at = {}, {}, 0
        for k, w in enumerate(cores):
            token_at[at] = (at + len(w), prices[k])
            at += len(w)
            if at < m:
                inner[at] = joins[k]
        limit = sum(prices)
        if len(cores) == 1 and text in self.count:
            limit = min(limit, 3 + self.price[text])
        cost, back = [1e18] * (m + 1), [()] * (m + 1)
        cost[0] = 0.0
        for p in range(m):
            if cost[p] >= limit:
                continue
            whole = -1
            if p in token_at:
                whole, price = token_at[p]
                if cost[p] + price < cost[whole]:
                    cost[whole], back[whole] = cost[p] + price, (p, None, ())
            stack = [(self.trie, p, (), cost[p] + (0.0 if p in token_at else RUN_TOGETHER))]
            while stack:
                node, i, wrong, c = stack.pop()
                if c + self.least >= min(limit, cost[m]):
                    continue
                word = node.get("")
                if word is not None and i != whole and self.known(word):
                    total = c + self.price[word]
                    if total < cost[i] and total < limit:
                        cost[i], back[i] = total, (p, word, wrong)
                if i == m:
                    continue
                nodes = [node]
                if i in inner and i > p:
                    c += CROSS[inner[i]]
                    if inner[i] == "-" and "-" in node:
                        nodes.append(node["-"])
                more = c + scale * (NEXT if wrong else FIRST)
                for node in nodes:
                    if (nxt := node.get(text[i])) is not None:
                        stack.append((nxt, i + 1, wrong, c))
                    if more + self.least >= limit:
                        continue
                    for size in (1, 2):
                        if i + size > m or size == 2 and i + 1 in inner:
                            break
                        for meant in CONFUSED.get(text[i : i + size], ""):
                            sub = node
                            for ch in meant:
                                sub = sub.get(ch)
                                if sub is None:
                                    break
                            if sub is not None:
                                stack.append((sub, i + size, (*wrong, i), more))
        if cost[m] >= 1e18:
            return [(0, m, None, (), prices[0])]
        out, at = [], m
        while at:
            p, word, wrong = back[at]
            out.append((p, at, word, wrong, cost[at]))
            at = p
        return out[::-1]


def page_of(uid: str) -> int | None:
    m = _UID_PAGE.search(uid)
    return int(m.group(1)) if m else None


def read_page(lines: Iterable[tuple], lex: Lexicon, write: bool = True) -> tuple[list[tuple[str, str]], list[tuple[int, str]]]:
    """((line_uid, kind) found, (first line, text) of each paragraph) of a page whose lines (line_uid, text) come in order, perhaps with what a confusion's cost is multiplied by.

    The lines are a stream of any length: some hundred are held at a time and
    decoded up to a place where no word can go on to the next line, so the
    results are those of the page read at once. No paragraphs are made unless
    they are to be written.
    """
    lines = iter(lines)
    kinds: list[tuple[str, str]] = []
    text = Paragraphs()
    uids, texts, weights = [], [], []  # lines held
    base, begun, ended = 0, False, False  # number in the page of the first line held
    off: set[int] = set()
    numbers: set[int] = set()

    def edge(i: int) -> bool:
        if is_page_number(texts[i - base], page_of(uids[i - base])):
            kinds.append((uids[i - base], "page_number"))
            numbers.add(i)
        elif _is_header(texts[i - base], lex):
            kinds.append((uids[i - base], "header"))
        else:
            return False
        off.add(i)
        return True

    while not ended:
        got = 0
        for uid, t, *scale in islice(lines, CHUNK + 2 * NEAR):
            uids.append(uid)
            texts.append(t)
            weights.append(scale[0] if scale else 1.0)
            got += 1
        ended = got < CHUNK + 2 * NEAR
        n = base + len(uids)
        # page numbers and headers stand at the edges, at most two lines deep
        if not begun and uids:
            begun, first = True, edge(0)
            last = edge(n - 1) if ended and n > 1 else False
            if n > 2 and (first or n == 3 and last):
                edge(1)
            if ended and n > 3 and last:
                edge(n - 2)
        elif ended and n > base and edge(n - 1) and n - 2 >= base:
            edge(n - 2)
        cut = len(uids)
        if not ended:
            cut -= NEAR + 4
            while cut and _may_join(texts[cut - 1], texts[cut], lex):
                cut -= 1
        if not cut:
            continue
        misread, hyphen = set(), set()
        words = _read_stream(texts[:cut], base, off, lex, misread, hyphen, weights[:cut])
        for k in range(cut):
            i, t = base + k, texts[k]
            if i not in hyphen and i not in off and k + 1 < len(texts) and t.rstrip()[-1] in BREAKS and _HYPHEN_END.search(t):
                stem = t.split()[-1].rstrip(BREAKS).lower().lstrip(_EDGE)
                if not lex.known(stem) and _odd_next(texts[k + 1]) and len(stem) > 1 and not stem.endswith(":") and _prefix(lex, stem):
                    hyphen.add(i)
            if i in hyphen:
                kinds.append((uids[k], "hyphen"))
            if i in misread or i in numbers and _PAGE_MISREAD.search(t):
                kinds.append((uids[k], "misread"))
        if write:
            text.add(words, texts, cut, base, off)
        del uids[:cut], texts[:cut], weights[:cut]
        base += cut
    return kinds, text.end()


def _may_join(a: str, b: str, lex: Lexicon) -> bool:
    """Whether a word may go on from line a to line b; where none can, the cheapest paths before and after are independent."""
    a, b = a.split(), b.split()
    return bool(a and b) and (a[-1].rstrip(".,")[-1:] in BREAKS or any(x[4] or x[0] > RARE for x in (lex.token(a[-1]), lex.token(b[0]))))


def _parts(t: str, w: str) -> tuple[str, str, str] | None:
    """What stands before, in and after the core of a token; None where letters change their number with their case."""
    low = t.lower()
    at = low.find(w)
    return (t[:at], t[at : at + len(w)], t[at + len(w) :]) if w and at >= 0 and len(low) == len(t) else None


def _read_stream(lines: list[str], base: int, off: set[int], lex: Lexicon, misread: set[int], hyphen: set[int], scales: list[float]) -> list[tuple[int, str]]:
    """(line, word) of the cheapest path through the lines, the first of which is number `base`; adds to the lines misread and broken.

    The path is looked for between places where no word can go on: beside
    tokens that are words as they stand, unless a line ends with a hyphen or
    the two together are a word.
    """
    words: list[tuple[int, str]] = []
    stretch: list[tuple[int, str, tuple]] = []  # tokens that a word may cross together, up to the present one
    joins = ""
    known, read_token = lex.tokens.get, lex.token

    def close() -> None:
        if len(stretch) > 1:
            _read_stretch(stretch, joins, base, lex, misread, hyphen, scales, words)
        else:
            words.extend(_read_single(*stretch[0], base, lex, misread, scales))

    for k, text in enumerate(lines):
        i = base + k
        scale = scales[k]
        first = True
        for t in text.split():
            got = known(t)
            read = got[0] if got is not None and got[0][5] else read_token(t, scale)
            join = ""
            if stretch and (first or not (read[6] and was[6])):
                open_ = was[4] or read[4] or was[0] > RARE and read[0] > RARE
                if not first:
                    if open_ and i not in off and _joins(before, was, t, read, lex):
                        join = " "
                elif stretch[-1][0] == i - 1 and i - 1 not in off and i not in off:
                    end = before.rstrip(".,")
                    if len(end) > 1 and end[-1] in BREAKS and end[-2].isalpha():
                        join = "-"
                    elif open_ and _joins(before, was, t, read, lex):
                        join = "\n"
            if join:
                joins += join
            elif stretch:
                if was[6] and len(stretch) == 1:
                    words.append((stretch[0][0], before))
                else:
                    close()
                stretch.clear()
                joins = ""
            stretch.append((i, t, read))
            before, was, first = t, read, False
    if stretch:
        close()
    return words


def _read_single(i: int, t: str, read: tuple, base: int, lex: Lexicon, misread: set[int], scales: list[float]) -> list[tuple[int, str]]:
    """The words of a token by itself."""
    if read[2]:
        misread.add(i)
    if " " in read[1]:
        path = lex.decode((read[3],), "", (min(lex.reading(x, scales[i - base])[0] for x in _forms(t, read[3])),), scales[i - base])
        return [(i, x) for x in _shown([t], (read[3],), path)]
    return [(i, _dress(t, read[1]) if read[2] else t)]


def _joins(a: str, read_a: tuple, b: str, read_b: tuple, lex: Lexicon) -> bool:
    """Whether one word may go on from token a to b, with nothing between them: two pieces that are no words, or tokens of which one is a rare word at most and that make up a word."""
    wa, wb = read_a[3], read_b[3]
    if not a.lower().endswith(wa) or not b.lower().startswith(wb):
        return False
    if read_a[4] and read_b[4]:
        return True
    return lex.known(wa + wb) and wa.isalpha() and wb.isalpha() and lex.price[wa + wb] + CROSS[" "] < read_a[0] + read_b[0]


def _forms(t: str, w: str) -> list[str]:
    """What of a token may be its word: some confused characters look like punctuation."""
    low = t.lower()
    return [x for x in dict.fromkeys((w, low.strip(".,;:?\"'"), low.rstrip(BREAKS), low.strip(".,;:?\"'!" + BREAKS))) if x]


def _shown(raw: list[str], cores: tuple[str, ...], path: list[tuple]) -> list[str]:
    """The pieces of a path in the case and with the outer punctuation of the tokens."""
    parts = [_parts(t, w) or ("", w, "") for t, w in zip(raw, cores, strict=True)]
    ends, at = [], 0
    for w in cores:
        at += len(w)
        ends.append(at)
    out = []
    for begin, end, word, wrong, _ in path:
        text = ""
        for (head, body, tail), stop in zip(parts, ends, strict=True):
            start = stop - len(body)
            if stop <= begin or start >= end:
                continue
            text += (head if start == begin else "") + body[max(begin - start, 0) : end - start] + (tail if stop == end else "")
        out.append(text if word is None or not wrong and word == core(text) else _dress(text, word))
    return out


def _read_stretch(tokens: list[tuple[int, str, tuple]], joins: str, base: int, lex: Lexicon, misread: set[int], hyphen: set[int], scales: list[float], words: list[tuple[int, str]]) -> None:
    """Reads tokens that words may cross together."""
    raw = [t for _, t, _ in tokens]
    cores = []
    for k, (_, t, read) in enumerate(tokens):
        w = read[3]
        if k < len(joins) and joins[k] == "-":
            w = t.rstrip(".,").rstrip(BREAKS).lower().lstrip(_EDGE)
        if k and joins[k - 1] == "-" and w and not t.lower().startswith(w):
            w = t.lower().rstrip(".,;:?!\"')" + BREAKS)
        cores.append(w or t.lower())
    cores = tuple(cores)
    path = lex.decode(cores, joins, tuple(read[0] for _, _, read in tokens), min(scales[i - base] for i, _, _ in tokens))
    ends, at = [], 0
    for w in cores:
        at += len(w)
        ends.append(at)
    shown = _shown(raw, cores, path)
    for (begin, end, word, wrong, _), text in zip(path, shown, strict=True):
        k = bisect_left(ends, begin + 1)
        i, t, read = tokens[k]
        if word is None:
            # the token as it is, or its own reading
            words += _read_single(i, t, read, base, lex, misread, scales)
            continue
        for place in wrong:
            misread.add(tokens[bisect_left(ends, place + 1)][0])
        while ends[k] < end:
            if joins[k] != " ":
                hyphen.add(tokens[k][0])
            k += 1
        words.append((i, text))


def _odd_next(text: str) -> bool:
    """A next line that begins in lower case may go on with a word."""
    s = text.lstrip()
    return bool(s) and not s[0].isupper() and not _MARKER.match(text)


def _prefix(lex: Lexicon, stem: str) -> bool:
    node = lex.trie
    for ch in stem:
        node = node.get(ch)
        if node is None:
            return False
    return True


def _dress(shown: str, meant: str) -> str:
    """The word meant in the case and with the outer punctuation of the token shown."""
    tail = shown[len(shown.rstrip(".,;:?!\"')")) :]
    head = shown[: len(shown) - len(shown.lstrip("\"'[*"))]
    letters = [c for c in shown if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        meant = meant.upper()
    elif shown[len(head) : len(head) + 1].isupper():
        meant = meant[:1].upper() + meant[1:]
    return head + meant + tail


def _is_header(text: str, lex: Lexicon) -> bool:
    """A line like a template of running headers, perhaps cut off, or of words of which three in four and the mean stand at page edges far more than elsewhere in the corpus; very common words, of which there may be as many again, aside."""
    ws = [w for t in _SEPARATE.split(text) if len(w := core(t)) > 1 and _LETTERS.search(w)]
    if len(ws) < 2:
        return False
    lifts, key = [], []
    for w in ws:
        meant = lex.reading(w)[1]
        key.append(_NOT_LETTERS.sub(" ", meant).strip())
        if lex.count.get(meant, 0) < COMMON * lex.total:
            lifts.append(lex.lift.get(meant, 0.0) if lex.known(meant) else 0.5)
    if 2 * len(lifts) >= len(ws) and sum(lifts) >= 2.3 * len(lifts) and sum(x >= 1.8 for x in lifts) >= 0.75 * len(lifts):
        return True
    line = " ".join(k for k in key if k)
    return len(line) >= 10 and any(len(line) <= len(t) and sum(a != b for a, b in zip(line, t, strict=False)) <= 2 for t in lex.templates.get(key[0], ()))


class Paragraphs:
    """Text cut where the sum of the costs of breaking or going on between lines is least, by dynamic programming over a stream of lines."""

    def __init__(self):
        self.kept: dict[int, list[str]] = {}  # words of lines whose paragraph isn't sure yet
        self.best: list[tuple[float, tuple]] = []  # the line goes on (0) or begins a paragraph (1): cost, (line begun, the one before, ..)
        self.line: str | None = None
        self.marker = False
        self.near: list[int] = []  # widths of lines near the present one, sorted
        self.widths: list[tuple[int, int]] = []  # (line, width) of the same lines, in order
        self.done: list[tuple[int, str]] = []

    def usual(self, i: int, ahead: list[tuple[int, int]]) -> int:
        """Upper quartile of the widths of the lines up to NEAR before and after line i; `ahead` are lines not looked at yet."""
        while ahead and ahead[0][0] <= i + NEAR:
            new = ahead.pop(0)
            self.widths.append(new)
            insort(self.near, new[1])
        while self.widths and self.widths[0][0] < i - NEAR:
            del self.near[bisect_left(self.near, self.widths.pop(0)[1])]
        return self.near[len(self.near) * 3 // 4] if self.near else 1

    def add(self, words: list[tuple[int, str]], texts: list[str], cut: int, base: int, off: set[int]) -> None:
        """The next lines, `cut` of the texts, and their words; further texts are looked at for their widths."""
        new: dict[int, list[str]] = {}
        for i, w in words:
            if i not in off:
                new.setdefault(i, []).append(w)
        seen = self.widths[-1][0] if self.widths else -1
        ahead = [(base + k, len(t.strip())) for k, t in enumerate(texts) if base + k > seen and base + k not in off]
        for i in sorted(new):
            self.kept[i] = new[i]
            line = texts[i - base]
            marker = bool(_MARKER.match(line))
            if self.line is None:
                self.best = [(1e9, (i, ())), (0.0, (i, ()))]
            else:
                self._step(i, line, marker, self.usual(self.last, ahead))
            self.line, self.marker, self.last = line, marker, i
        self._settle()

    def _step(self, i: int, text: str, marker: bool, usual: int) -> None:
        line = self.line.rstrip()
        ends = bool(_ENDS.search(line[-3:]))
        short = len(line.lstrip()) < 0.7 * (usual or 1)
        starts = text.lstrip()[:1].isupper() or marker
        broken = line[-1:] in BREAKS and not starts and bool(_HYPHEN_END.search(line))
        new = 3.0 - 1.5 * ends - 2.0 * short - 0.5 * starts - 3.0 * marker + 2.0 * broken
        on = 1.0 * (ends and short) + 1.0 * marker
        (on_cost, going), (new_cost, begun) = self.best
        # a paragraph of a single line costs a little
        fresh = (on_cost + new, going) if on_cost <= new_cost + 0.3 else (new_cost + new + 0.3, begun)
        least = (on_cost, going) if on_cost <= new_cost else (new_cost, begun)
        self.best = [(least[0] + on, least[1]), (fresh[0], (i, fresh[1]))]

    def _settle(self) -> None:
        """Writes the paragraphs that both states have in common, but the last of them, which may go on."""
        if not self.best:
            return
        chains = []
        for _, link in self.best:
            marks = []
            while link:
                marks.append(link[0])
                link = link[1]
            chains.append(marks[::-1])
        same = 0
        while same < min(map(len, chains)) and chains[0][same] == chains[1][same]:
            same += 1
        if same > 1:
            self._write(chains[0][:same])
            self.best = [(cost, self._link(marks[same - 1 :])) for (cost, _), marks in zip(self.best, chains, strict=True)]

    @staticmethod
    def _link(marks: list[int]) -> tuple:
        link: tuple = ()
        for i in marks:
            link = (i, link)
        return link

    def _write(self, marks: list[int], last: bool = False) -> None:
        """The paragraphs that begin at the marks, without the last unless it has ended."""
        order = iter(sorted(self.kept))
        line = next(order, None)
        for k, i in enumerate(marks if last else marks[:-1]):
            stop = marks[k + 1] if k + 1 < len(marks) else math.inf
            parts = []
            while line is not None and line < stop:
                parts += self.kept.pop(line)
                line = next(order, None)
            self.done.append((i, " ".join(parts)))

    def end(self) -> list[tuple[int, str]]:
        if self.best:
            marks, link = [], min(self.best, key=lambda x: x[0])[1]
            while link:
                marks.append(link[0])
                link = link[1]
            self._write(marks[::-1], last=True)
            self.best = []
        return self.done


def gather_pages(lines: DataFrame) -> DataFrame:
    """(page, line_uid, text, confidence, first, deep): the latest reading of each line with text, page by page in reading order.

    The page is the one in the line's uid, which is right where page_id is
    null or wrong; a line without either is a page by itself. Ties in
    reading_order go by block, line and uid. first: the line begins its page;
    deep: lines between it and the nearest edge of the page, 2 for all
    further in. Pages are streams of lines, never gathered in a row.
    """
    if "confidence" not in lines.columns:
        lines = lines.withColumn("confidence", F.lit(None).cast("double"))
    rows = latest_lines(lines, "page_id", "reading_order", "block_id", "line_id", "text", "confidence").filter(F.trim("text") != "")
    of_uid = F.regexp_extract("line_uid", r"^(.+)_b\d+_l\d+$", 1)
    page = F.when(of_uid != "", of_uid).otherwise(F.coalesce(norm_key(F.col("page_id")), F.concat(F.lit("line "), "line_uid")))
    order = Window.partitionBy("page").orderBy("reading_order", "block_id", "line_id", "line_uid")
    at = F.row_number().over(order)
    below = F.when(F.lead("line_uid", 1).over(order).isNull(), 0).when(F.lead("line_uid", 2).over(order).isNull(), 1).otherwise(2)
    return rows.withColumn("page", page).select("page", "line_uid", "text", "confidence", (at == 1).alias("first"), F.least(at - 1, below).alias("deep"))


def count_words(pages: DataFrame) -> DataFrame:
    """(word, n, n_edge): how often each word stands in all lines and in the first or last line of a page.

    Pieces at a broken line end are left out. Counted per task before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        edge: Counter = Counter()
        merged: Counter = Counter()

        def flush() -> pa.RecordBatch:
            # tokens were counted as written; words are told once per different token
            for raw in (n, edge):
                for t in list(raw):
                    c = raw.pop(t)
                    w = core(t)
                    if _LETTERS.search(w):
                        merged[w, raw is edge] += c
            for (w, at_edge), c in merged.items():
                (edge if at_edge else n)[w] = c
            merged.clear()
            words = list(n)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([edge[w] for w in words], pa.int64())], names=["word", "n", "n_edge"])
            n.clear()
            edge.clear()
            return out

        broken = False
        for batch in batches:
            for text, first, deep in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                toks = text.split()
                skip, broken = broken and not first, bool(_HYPHEN_END.search(text))
                ws = toks[int(skip) : len(toks) - broken]
                n.update(ws)
                if deep == 0:
                    edge.update(ws)
            if len(n) > 200_000:
                yield flush()
        yield flush()

    return pages.select("text", "first", "deep").mapInArrow(run, "word string, n long, n_edge long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_edge").alias("n_edge"))


def header_templates(pages: DataFrame, least_share: float = 1.2e-3, at_edges: float = 0.8) -> list[str]:
    """Letters of lines that stand in the first or last two lines of at least this share of pages (so under 4 / share of them) and hardly elsewhere."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")).alias("k")
    n = pages.filter("first").count()
    often = pages.filter("deep < 2").select(key).filter((F.length("k") >= 10) & F.col("k").contains(" ")).groupBy("k").agg(F.count(F.lit(1)).alias("e")).filter(F.col("e") >= max(3.0, least_share * n))
    often = checkpoint(often)
    # `often` has fewer than 4 / least_share rows
    all_of = pages.select(key).join(F.broadcast(often), "k").groupBy("k", "e").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.k for r in all_of.filter(F.col("e") >= at_edges * F.col("n")).toLocalIterator())


def lexicon_rows(pages: DataFrame, least_share: float = LEAST_SHARE) -> tuple[dict, int, int, list[str]]:
    """Lexicon for the executors: words of at least `least_share` of all words, so at most 1 / least_share of them."""
    counts = checkpoint(count_words(pages))
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_edge").alias("e")).first()
    n, e = total.n or 0, total.e or 0
    rows = counts.filter((F.col("n") >= max(1.0, least_share * n)) & (F.col("n") > 1)).toLocalIterator()
    return {r.word: (r.n, r.n_edge) for r in rows}, n, e, header_templates(pages)


_LEXICONS: dict[str, Lexicon] = {}


def _lexicon(name: str, shared) -> Lexicon:
    """One lexicon per Python worker."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(*shared.value)
    return _LEXICONS[name]


def repair(lines: DataFrame, write: bool = True) -> DataFrame:
    """(page, uids, kinds, paragraphs): what was found in each page and, if it is to be written, its readable text, one row a page.

    Null and blank texts are no lines; null line_uids are left out; repeated
    and older readings count once; an empty table gives no rows; very long
    lines, words and pages are read whole, all by the same path.
    """
    pages = checkpoint(gather_pages(lines))
    shared = pages.sparkSession.sparkContext.broadcast(lexicon_rows(pages))
    name = uuid.uuid4().hex
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(name, shared)
        rows = (r for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        out: list[tuple] = []
        for page, of_page in groupby(rows, key=lambda r: r[0]):
            found, texts = read_page(((uid, text, doubt(sure)) for _, uid, text, sure in of_page), lex, write)
            out.append((page, [u for u, _ in found], [k for _, k in found], [t for _, t in texts]))
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*out, strict=True)) or [[]] * 4, (pa.string(), strings, strings, strings), strict=True)], names=["page", "uids", "kinds", "paragraphs"])

    return pages.select("page", "line_uid", "text", "confidence").mapInArrow(run, "page string, uids array<string>, kinds array<string>, paragraphs array<string>")


def p2_found(spark, d):
    pairs = F.explode(F.arrays_zip("uids", "kinds")).alias("x")
    return repair(table(spark, d, "ocr_lines"), write=False).select(pairs).select(F.col("x.uids").alias("line_uid"), F.col("x.kinds").alias("kind")).distinct()


def p2_pages(spark, d):
    return repair(table(spark, d, "ocr_lines")).select("page", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n\n").alias("text"))


QUERIES = {"p2_found": p2_found, "p2_pages": p2_pages}
SQL: dict[str, str] = {}
