"""Personal information inside free text.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digits, street
words, cues of identifiers and of names); from each anchor a local parser
expands to both sides and validates what it finds: the account and domain of
an e-mail, the digits of a phone or identity number, the number, street and
town of an address. No text is scanned away from its anchors. The anchors of
names are initial capitals; a name is told from other capitalised words by a
character model fitted on the roster against the ordinary words of the lines,
and by the words beside it, fitted on a bounded sample of lines in which
rostered names stand.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.common import checkpoint, latest_lines, spread, table

PLACE = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
NAME_SAMPLE = 5000  # rostered names at most that the character model is fitted on
LINE_SAMPLE = 20_000  # lines at most that the words beside names are learned from
CONTEXT = 2.0  # log odds of the words beside a name from which on they count as a cue
# fixed values: anchors
AT_SIGNS = ["@", "[at]", "[ at ]", "(at)", "( at )", "{at}", "{ at }", " at "]
SCHEMES = ["mailto:", "tel:", "sms:", "callto:"]
NETWORK_SCHEMES = ["http://", "https://", "ftp://", "ssh://", "sftp://", "telnet://"]
STREETS = ["street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "cross", "layout", "nagar", "colony", "marg", "drive", "dr", "close", "court", "way", "square", "boulevard", "blvd", "terrace", "extension"]
BOXES = ["p.o. box", "po box", "p.o.box", "p o box"]
ID_CUES = ["usn", "seat no", "seat number", "roll no", "roll number", "reg no", "reg. no", "register no", "registration no", "registration number", "enrolment no", "enrollment no", "hall ticket", "admission no", "aadhaar", "passport no", "national id"]
# titles and words that a person's name follows
NAME_CUES = frozenset("mr mrs ms miss dr prof professor sir madam shri smt name student candidate teacher lecturer guide author by ask contact dear regards attn".split())
INSTITUTES = frozenset("polytechnic institute university college school technology technical engineering department dept academy house campus hall society centre center faculty protocol repeat window layer".split())
# words of counts and fields near which a number is none of a person
TECHNICAL = frozenset("sequence frame frames port ports bit bits byte bytes offset window packet packets counter counts crc mac checksum address field slot slots delay segment segments ack wraps overflow modulo".split())

_SENTENCE_END = regex.compile(r"\.\s+\p{Lu}")
_LABEL = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?")
_DOT = regex.compile(r"\s?\.\s?|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+", regex.I)
_PHONE = regex.compile(
    r"(?<![\w.:/^-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?\(?\d{2,5}\)?(?:[ .-]?\d){6,8}"
    r"|\(0\d{2,4}\) ?\d{3}[ .-]?\d{4}"
    r"|0\d{2,4}[ .-]\d{3}[ .-]\d{4}"
    r"|(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}"
    r"|\d(?: \d){9}(?! ?\d)"
    r"|0?\d{10}"
    r")(?!\d|[-/:^]\d|\.\d)(?:\s?(?:ext\.?|x)\s?\d{1,5})?",
    regex.I,
)
_SEAT = regex.compile(r"(?<![\w-])\d[a-z]{2}[ -]?\d{2}[ -]?[a-z]{2}[ -]?\d{3,5}(?![\w])", regex.I)
_NATIONAL = regex.compile(r"(?<![\w.:+(-])(?<!\d )\d{4}([ -]?)\d{4}\1\d{4}(?![\w:]|[ -]\d|\.\d)")
_CUED = regex.compile(r"\s*(?:[.:#=-]|is\b|no\b\.?|number\b)?\s*[.:#]?\s*((?=[\p{L}\p{N}/ -]{0,6}\p{N})\p{N}{4}(?:[ -]\p{N}{4}){1,3}|[\p{L}\p{N}]+(?:[/-][\p{L}\p{N}]+)*)(?![\p{L}\p{N}])", regex.I)
_TOWN = r"(?-i:\p{Lu}[\p{L}'-]+)"
_PIN = r"(?:[ ,]*(?:-\s*)?\d{3} ?\d{3}(?!\d))"
_BEFORE_NUMBER = regex.compile(r"(?r)(?:(?<![\p{L}\p{N}])\p{Lu}[\p{L}'-]+\s+(?i:house),?\s+)?(?:(?<!\p{L})(?i:flat|apt\.?|house|door|plot|h\.?no\.?|no\.?)\s*#?\s*|#\s?)?")
_STREET = regex.compile(rf"\d{{1,4}}[a-z]?(?:/\d{{1,4}})?,?\s+(?:\d+(?:st|nd|rd|th)\s+)?(?:{_TOWN}\s+){{0,3}}(?:main\s+|cross\s+)?(?:{'|'.join(STREETS)})\b\.?(?:,?\s+{_TOWN})?{_PIN}?", regex.I)
_BOX = regex.compile(rf"\s+\d+,?(?:\s+{_TOWN})?{_PIN}?", regex.I)
_CAP = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
_UP = r"\p{Lu}{3,}"
_NAME = regex.compile(
    rf"(?:{_CAP},\s(?:{_CAP}|\p{{Lu}}\.)|{_UP},\s{_UP}|(?:{_CAP}|\p{{Lu}}\.)(?:\s\p{{Lu}}\.)?\s{_CAP}|(?:{_UP}|\p{{Lu}}\.)(?:\s\p{{Lu}}\.)?\s{_UP})(?![\p{{L}}\p{{N}}@_]|\.\w)", regex.V1
)
_INITIAL = regex.compile(r"(?<![\p{L}\p{N}@._+-])\p{Lu}")
_WORDS = regex.compile(r"\p{L}{2,}").findall
_LAST_WORD = regex.compile(r"(?r)(\p{L}+)[^\p{L}\p{N}]*")
_NEXT_WORD = regex.compile(r"[^\p{L}\p{N}]*(\p{L}+)")
_TECH_BEFORE = regex.compile(r"(?r)(?:(?:\p{L}+|=)[^\p{L}\p{N}=]*){0,5}")
_SENTENCES = regex.compile(r"(?<!\bno)[.?!]\s+")
_TOKEN = regex.compile(r"\p{L}+|=").findall


class NameModel:
    """Log odds of a word being part of a person's name, by character trigrams."""

    def __init__(self, names: Counter, ordinary: dict[str, int]):
        self.ordinary = ordinary
        self.grams: dict[str, float] = {}
        a: Counter = Counter()
        b: Counter = Counter()
        for w in names:
            a.update(self._cut(w))
        for w in ordinary:
            b.update(self._cut(w))
        na, nb, v = sum(a.values()), sum(b.values()), len(a.keys() | b.keys()) + 1
        for g in a.keys() | b.keys():
            self.grams[g] = math.log((a[g] + 0.5) / (na + 0.5 * v)) - math.log((b[g] + 0.5) / (nb + 0.5 * v))
        self.fitted = na > 0

    @staticmethod
    def _cut(w: str) -> list[str]:
        w = f"^{w}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, w: str) -> float:
        cut = self._cut(w)
        return sum(self.grams.get(g, -0.5) for g in cut) / len(cut)


class Beside:
    """Log odds of the words before and after a name, against those beside other capitalised words."""

    def __init__(self, before: dict[str, float] | None = None, after: dict[str, float] | None = None):
        self.before, self.after = before or {}, after or {}

    @staticmethod
    def of(text: str, a: int, b: int) -> tuple[str, str]:
        last, following = _LAST_WORD.match(text, 0, a), _NEXT_WORD.match(text, b)
        return (last.group(1).lower() if last else "^"), (following.group(1).lower() if following else "$")

    @classmethod
    def fit(cls, texts: Iterable[str], names: Counter, ordinary: dict[str, int]) -> Beside:
        """From texts in which pairs of capitalised words are all rostered (a name) or hold an ordinary word (none)."""
        counts = {True: (Counter(), Counter()), False: (Counter(), Counter())}
        for text in texts:
            pos = 0
            for start in _INITIAL.finditer(text):
                if start.start() < pos or (m := _NAME.match(text, start.start())) is None:
                    continue
                words = [w.lower() for w in _WORDS(m.group())]
                yes = bool(words) and all(w in names and w not in ordinary for w in words)
                if yes or any(w in ordinary for w in words):
                    for side, w in zip(counts[yes], cls.of(text, *m.span()), strict=True):
                        side[w] += 1
                    pos = m.end() if yes else pos
        odds = []
        for yes, no in zip(counts[True], counts[False], strict=True):
            n, m = sum(yes.values()), sum(no.values())
            odds.append({w: math.log((yes[w] + 0.5) / (n + 1)) - math.log((no[w] + 0.5) / (m + 1)) for w in yes.keys() | no.keys() if yes[w] + no[w] >= 3} if n and m else {})
        return cls(*odds)

    def score(self, text: str, a: int, b: int) -> float:
        before, after = self.of(text, a, b)
        return self.before.get(before, 0.0) + self.after.get(after, 0.0)


class Finder:
    def __init__(self, model: NameModel, beside: Beside | None = None):
        import ahocorasick

        self.model, self.beside = model, beside or Beside()
        self.anchors = ahocorasick.Automaton()
        for kind, words in (("at", AT_SIGNS), ("scheme", SCHEMES), ("network", NETWORK_SCHEMES), ("street", STREETS), ("box", BOXES), ("id", ID_CUES), ("digit", list("0123456789"))):
            for w in words:
                self.anchors.add_word(w, (kind, len(w)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) without overlaps, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at: dict[str, list[tuple[int, int]]] = {}
        for end, (kind, size) in self.anchors.iter(low):
            at.setdefault(kind, []).append((end + 1 - size, end + 1))
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def take(span: tuple[int, int] | None, kind: str | None) -> bool:
            if span is None or kind is not None and any(taken[span[0] : span[1]]):
                return False
            taken[span[0] : span[1]] = b"\1" * (span[1] - span[0])
            if kind is not None:
                out.append((*span, kind))
            return True

        for a, b in at.get("network", ()):
            # the host and path of a network address are nobody's, but for nothing else to be found in them
            stop = b
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            take((a, stop), None)
        for a, b in at.get("at", ()):
            take(self._email(text, low, a, b), "email")
        if "digit" in at:
            digits = [a for a, _ in at["digit"]]
            for k, s in enumerate(digits):
                if k and digits[k - 1] == s - 1 or taken[s]:
                    continue  # inside a number
                if (m := _SEAT.match(text, s)) and take(m.span(), "id_number"):
                    continue
                if "street" in at and take(self._address(text, s), "address"):
                    continue
                if k + 9 < len(digits) and digits[k + 9] - s <= 24:
                    if (m := _NATIONAL.match(text, s)) and self._personal(low, *m.span()) and take(m.span(), "id_number"):
                        continue
                    take(self._phone(text, low, s), "phone")
            for _, b in at.get("scheme", ()):
                if (m := regex.match(r"\+?[\d().-]*\d", text[b:])) and sum(map(str.isdigit, m.group())) >= 7:
                    take((b, b + m.end()), "phone")
            for a, b in at.get("id", ()):
                if not (a and low[a - 1].isalpha()) and (m := _CUED.match(text, b)) and sum(map(str.isdigit, m.group(1))) >= 4:
                    take(m.span(1), "id_number")
            for a, b in at.get("box", ()):
                if m := _BOX.match(text, b):
                    take((a, m.end()), "address")
        pos = 0
        for start in _INITIAL.finditer(text):
            a = start.start()
            if a < pos or taken[a] or (m := _NAME.match(text, a)) is None:
                continue
            if self._name(m.group(), text, *m.span()) and take(m.span(), "name"):
                pos = m.end()
        return sorted(out)

    @staticmethod
    def _email(text: str, low: str, a: int, b: int) -> tuple[int, int] | None:
        """The account to the left of an at-sign and the domain to its right, of any length."""
        sign = low[a:b]
        bare = sign == " at "
        i = a
        if not bare and i and text[i - 1] == " ":
            i -= 1
        end = i
        while i and (text[i - 1].isalnum() or text[i - 1] in "._+-%"):
            i -= 1
        while i < end and not text[i].isalnum():
            i += 1
        if i == end or not text[end - 1].isalnum() or i and (text[i - 1] == "@" or text[i - 1].isalnum()):
            return None
        j = b + (not bare and text[b : b + 1] == " ")
        labels, dotted, spaced = [], False, True
        stop = j
        while (label := _LABEL.match(text, j)) is not None:
            labels.append(label.group())
            j = stop = label.end()
            dot = _DOT.match(text, j)
            if dot is None:
                break
            said = dot.group()
            plain = "." in said
            # a full stop and a blank after a whole domain end the sentence
            if plain and said != "." and (len(labels) > 1 and not spaced or _SENTENCE_END.match(said + text[dot.end() : dot.end() + 1])):
                break
            spaced = spaced and said != "."
            follows = _LABEL.match(text, dot.end())
            if follows is None:
                break
            dotted = dotted or plain
            j = dot.end()
        if len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2 or bare and dotted:
            return None
        if text[stop : stop + 1] and (text[stop].isalnum() or text[stop] in "@_"):
            return None
        return i, stop

    @staticmethod
    def _personal(low: str, a: int, b: int) -> bool:
        """Whether a number is somebody's: its sentence speaks of no count or field of a protocol just before it."""
        before = _TOKEN(_SENTENCES.split(_TECH_BEFORE.match(low, 0, a).group())[-1])
        after = _NEXT_WORD.match(low, b)
        if before and before[-1] == "=" or after and after.group(1) in TECHNICAL:
            return False
        return not TECHNICAL & set(before)

    def _phone(self, text: str, low: str, s: int) -> tuple[int, int] | None:
        """The phone number whose first digit stands at s, perhaps after a plus sign or bracket."""
        for begin in (s, s - 1, s - 2):
            if begin < 0 or text[begin:s].strip("+("):
                break
            m = _PHONE.match(text, begin)
            if m is None:
                continue
            digits = [c for c in regex.split(r"(?i)ext|x", m.group())[0] if c.isdigit()]
            if 10 <= len(digits) <= 15 and len(set(digits)) >= 3 and self._personal(low, *m.span()):
                return m.span()
        return None

    def _address(self, text: str, s: int) -> tuple[int, int] | None:
        """The address whose number stands at s: unit and house to the left, street and town to the right."""
        m = _STREET.match(text, s)
        if m is None:
            return None
        a = _BEFORE_NUMBER.match(text, 0, s).start()
        if a == s and s and (text[s - 1] in ".:/" or text[s - 1].isalnum()):
            return None
        found = text[a : m.end()]
        return (a, m.end()) if any(w[0].isupper() and w.lower() not in self.model.ordinary for w in regex.findall(r"\p{L}+", found)) else None

    def _name(self, found: str, text: str, a: int, b: int) -> bool:
        words = [w.lower() for w in _WORDS(found)]
        if not words or any(w in INSTITUTES for w in words):
            return False
        unknown = [w for w in words if w not in self.model.ordinary]
        if not unknown:
            return False
        before, after = Beside.of(text, a, b)
        if after in INSTITUTES and text[b : b + 1] != ",":
            return False
        scores = [self.model.score(w) for w in words]
        if before in NAME_CUES or self.beside.score(text, a, b) > CONTEXT:
            return max(scores) > -0.2
        return len(unknown) == len(words) and min(scores) > 0.0 and sum(scores) / len(scores) > 0.4


def ordinary_words(lines: DataFrame, least_share: float = 1e-5) -> dict[str, int]:
    """Words written in lower case with at least this share of all words: at most 1 / least_share of them. Accounts of e-mail addresses, often names in lower case, don't count."""
    said = F.when(F.col("text").rlike(r"@|[\[({]\s?at"), F.regexp_replace("text", r"(?i)\S+\s?(?:@|[\[({]\s?at\s?[\])}])", " ")).otherwise(F.col("text"))
    counts = (
        lines.select(F.explode(F.split(said, r"[^\p{L}\p{M}'’]+")).alias("w"))
        .filter(F.length("w") >= 2)
        .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.lower("w").alias("w")).agg(F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("n"))
    )
    counts = checkpoint(counts)  # used twice
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter((F.col("low") >= max(3.0, least_share * total)) & (F.col("low") >= 0.2 * F.col("n")))
    return {r.w: r.low for r in kept.select("w", "low").toLocalIterator()}


def name_parts(roster: DataFrame, sample: int = NAME_SAMPLE) -> Counter:
    """Words of at most `sample` rostered names, those first in hash order."""
    rows = roster.select("full_name").filter(F.col("full_name").isNotNull()).distinct().orderBy(F.xxhash64("full_name"), "full_name").limit(sample).toLocalIterator()
    return Counter(w.lower() for r in rows for w in regex.findall(r"\p{L}{2,}", r.full_name))


def beside_names(lines: DataFrame, names: Counter, ordinary: dict[str, int], sample: int = LINE_SAMPLE) -> Beside:
    """Learned from at most `sample` lines with two capitalised words in a row, those first in hash order."""
    rows = lines.select("text").filter(F.col("text").rlike(r"\p{Lu}[\p{L}.'’]*,? \p{Lu}")).distinct().orderBy(F.xxhash64("text"), "text").limit(sample).toLocalIterator()
    return Beside.fit((r.text for r in rows), names, ordinary)


_FINDERS: dict[str, Finder] = {}


def _finder(name: str, shared) -> Finder:
    """One finder per Python worker."""
    if name not in _FINDERS:
        names, ordinary, beside = shared.value
        _FINDERS.clear()
        _FINDERS[name] = Finder(NameModel(names, ordinary), beside)
    return _FINDERS[name]


def find_personal(lines: DataFrame, roster: DataFrame) -> DataFrame:
    """(line_uid, kinds, text): kinds found in the latest reading of each line, and its text with placeholders.

    Null texts stay null and hold nothing, empty ones stay empty; null
    line_uids are left out; the rest of a text is unchanged, character by
    character; texts of any length are read whole. An empty roster leaves
    names to their cues and the ordinary words.
    """
    latest = spread(lines.select("line_uid", "text", "generated_at", "loaded_at"))
    latest = latest_lines(latest, "text").select("line_uid", "text")
    known = ordinary_words(lines.select("text"))
    names = name_parts(roster)
    shared = lines.sparkSession.sparkContext.broadcast((names, known, beside_names(lines, names, known)))
    model = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(model, shared)
        for batch in batches:
            kinds, texts = [], []
            for text in batch.column(1).to_pylist():
                spans = finder.spans(text) if text else []
                kinds.append(sorted({k for _, _, k in spans}))
                for a, b, k in reversed(spans):
                    text = text[:a] + PLACE[k] + text[b:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["line_uid", "kinds", "text"])

    return latest.mapInArrow(run, "line_uid string, kinds array<string>, text string")


def p3_found(spark, d):
    return find_personal(table(spark, d, "ocr_lines"), table(spark, d, "roster")).select("line_uid", F.explode("kinds").alias("kind"))


def p3_redacted(spark, d):
    return find_personal(table(spark, d, "ocr_lines"), table(spark, d, "roster")).select("line_uid", "text")


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}
