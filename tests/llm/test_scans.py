"""Repair of pages: hyphens, confusions, headers, page numbers, paragraphs; nulls, long pages, planted noise, empty tables."""

import random
from collections import Counter
from datetime import datetime as D

import pytest

from paperloom.llm import scans as S

COLS = "line_uid string, page_id string, reading_order int, block_id int, line_id int, text string, generated_at timestamp_ntz, loaded_at timestamp_ntz, kinds string, page int"
WORDS = "the network sends every packet through a wireless channel and some receiver confirms each full-duplex segment before the timer ends so no frame is lost".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    pages = {}
    for p in range(2, 90):
        lines = [f"Velmora Institute of Technology   {p}"]
        lines += [" ".join(rng.choice(WORDS) for _ in range(7)) for _ in range(14)]
        pages[p] = lines
    pages[3][4] = "some receiver confirms each wire-"
    pages[3][5] = "less channel and every pack=  ".strip()
    pages[3][6] = "et the full-"
    pages[3][7] = "duplex netw0rk scnds cvery frame"
    pages[3][8] = "Uses of it-"
    pages[3][9] = "the timer ends"
    pages[3].append("- 3 -")
    pages[4].append("iv")
    pages[5][3] = "5"
    pages[6].append("7")
    pages[7].append("Pagc 7")
    return pages


@pytest.fixture(scope="module")
def lines(spark, corpus):
    t = D(2024, 1, 1)
    rows = [(f"s01_c1_p{p:02d}_b00_l{i:02d}", f"s01_c1_p{p:02d}", i, 0, i, x, t, t, "k", p) for p, xs in corpus.items() for i, x in enumerate(xs)]
    rows += [(None, "s01_c1_p03", 3, 0, 3, "lost", t, t, "k", 3), ("s01_c1_p99_b00_l00", None, None, None, None, None, t, t, "k", 9), ("s01_c1_p98_b00_l00", None, 0, 0, 0, "  ", t, t, "k", 9)]
    return spark.createDataFrame(rows + rows[:40], COLS)


def test_found(lines, corpus):
    found = set()
    for r in S.repair(lines).collect():
        found |= set(zip(r.uids, r.kinds, strict=True))
    of = lambda p, kind: sorted(int(u[-2:]) for u, k in found if k == kind and u.startswith(f"s01_c1_p{p:02d}"))
    assert of(3, "hyphen") == [4, 5, 6]
    assert of(3, "misread") == [7]
    assert of(3, "page_number") == [15] and of(4, "page_number") == [15] and of(5, "page_number") == [] and of(6, "page_number") == [] and of(7, "page_number") == [15]
    assert sum(k == "header" for _, k in found) == len(corpus) and all(u.endswith("l00") for u, k in found if k == "header")


def test_paragraphs(lines):
    page = next(r for r in S.repair(lines).collect() if r.page == "s01_c1_p03")
    text = " ".join(page.paragraphs)
    assert "each wireless channel and every packet the full-duplex network sends every frame" in text
    assert "Velmora" not in text and "- 3 -" not in text


def test_empty(spark):
    assert S.repair(spark.createDataFrame([], COLS)).isEmpty()


@pytest.mark.parametrize(("text", "page", "is_number"), [("7", 7, True), ("Page 7 of 12", 7, True), ("[7]", 7, True), ("7/12", 7, True), ("vii", 7, True), ("P a g e | 7", 7, True), ("8", 7, False), ("7 frames", 7, False), ("", 7, False), ("l2", 12, True), ("7", None, False)])
def test_page_numbers(text, page, is_number):
    assert S.is_page_number(text, page) == is_number


def test_roman():
    assert [S.roman(x) for x in ("iv", "ix", "xii", "xl", "iiii", "")] == [4, 9, 12, 40, None, None]


def long_page(n=700):
    """A page with a header, a number at its end, broken words throughout and words of page edges in its middle."""
    rng = random.Random(8)
    page = [f"Velmora Institute of Technology   {300}"] + [" ".join(rng.choice(WORDS) for _ in range(rng.choice((3, 7, 7, 7)))) for _ in range(n)]
    for i in range(3, n - 3, 3):
        page[i], page[i + 1] = page[i] + " wire-", "less " + page[i + 1]
    page[19], page[20] = "Velmora Institute of Technology", "300"
    for i in range(30, n, 7):
        page[i], page[i + 1] = "lost before the timer ends.", "Some " + page[i + 1]
    # a run of lines that may all go on
    page[200:330] = ["wire-" if i % 2 else "less wire-" for i in range(130)]
    return [*page, "- 300 -"]


def test_long_page_is_read_as_one(spark, lines, monkeypatch):
    t = D(2024, 1, 1)
    page = long_page()
    # all lines share one reading order: ties go by block and line
    more = spark.createDataFrame([(f"s01_c1_p300_b00_l{i:03d}", None, 5, 0, i, x, t, t, "k", 300) for i, x in enumerate(page)], COLS)
    both = lines.unionByName(more)
    results = lambda: {r.page: (sorted(zip(r.uids, r.kinds, strict=True)), r.paragraphs) for r in S.repair(both).collect()}
    monkeypatch.setattr(S, "CHUNK", 100_000)
    whole = results()
    found, texts = whole["s01_c1_p300"]
    assert [int(u[-3:]) for u, k in found if k == "header"] == [0] and [int(u[-3:]) for u, k in found if k == "page_number"] == [len(page) - 1]
    assert " ".join(texts).split().count("wireless") >= 200 and len(texts) > 5
    for size in (1, 30, 400):
        monkeypatch.setattr(S, "CHUNK", size)
        assert results() == whole


def test_lines_of_no_page(spark, lines):
    t = D(2024, 1, 1)
    odd = spark.createDataFrame([(f"odd {i}", None, 0, 0, 0, "the network sends", t, t, "k", 1) for i in range(2)], COLS)
    got = {r.page: r.paragraphs for r in S.repair(lines.unionByName(odd)).collect()}
    assert all(got[f"line odd {i}"] == ["the network sends"] for i in range(2))


def text_of(line, words=None):
    counts = dict.fromkeys(WORDS, 400) | {"of": 3000, "the": 6000} | (words or {})
    lex = S.Lexicon({w: (n, 0) for w, n in counts.items()}, 100_000, 1000)
    kinds, texts = S.read_page([("s01_c1_p02_b00_l00", line)], lex)
    return " ".join(t for _, t in texts), [k for _, k in kinds]


def test_words_run_together():
    assert text_of("some frame (Ofthe network, everypacket") == ("some frame (Of the network, every packet", [])
    assert text_of("Networksendsevery packet") == ("Network sends every packet", [])
    # cut apart more than once, cut and run together, with a confusion
    assert text_of("some re ceiv er confirms") == ("some receiver confirms", [])
    assert text_of("some rece iverconf irms") == ("some receiver confirms", [])
    assert text_of("networ ksendsevcry packet", dict.fromkeys(("network", "sends", "every"), 3000)) == ("network sends every packet", ["misread"])
    # seen too often to be two words without their blank
    assert text_of("some invalid frame", {"in": 9000, "valid": 9000})[0] == "some in valid frame"
    assert text_of("some invalid frame", {"in": 9000, "valid": 9000, "invalid": 200}) == ("some invalid frame", [])


def test_cut_and_misread():
    assert text_of("some chan nel, Net wark.") == ("some channel, Network.", ["misread"])


def test_digits_for_letters_confused_twice():
    assert text_of("w1ndow conf1rms p0cket sm0ll cha11enge", dict.fromkeys(("window", "small", "challenge"), 400)) == ("window confirms packet small challenge", ["misread"])


def test_confidence_scales_confusions(spark):
    assert [S.doubt(c) for c in (None, float("nan"), -0.01, 1.01)] == [1.0] * 4 and S.doubt(0.1) < S.doubt(0.8) == 1.0 < S.doubt(1.0)
    t = D(2024, 1, 1)
    filler = [("network " * 40 + "timer packet", 0.8)] * 60 + [("theory timer packet", 0.8)] * 6
    # rare words read in place of an unknown one: worth it only where the reading is doubtful
    probe = [("some 7heo3y theorv", c) for c in (0.1, 0.8, None, 1.01)]
    rows = [(f"s01_c1_p{i:03d}_b00_l00", None, 0, 0, 0, x, t, t, "k", i, c) for i, (x, c) in enumerate(filler + probe)]
    pages = S.gather_pages(spark.createDataFrame(rows, COLS + ", confidence double"))
    assert {r.confidence for r in pages.collect()} == {0.1, 0.8, None, 1.01}
    lex = S.Lexicon({"theory": (150, 0)}, 10_000_000, 0)
    assert [lex.reading("thcorv", S.doubt(c))[2] for c in (0.1, 0.8, None, 1.01)] == [2, 0, 0, 0]
    assert S.read_page([("u", "thcorv", S.doubt(0.1))], lex)[0] == [("u", "misread")] and S.read_page([("u", "thcorv")], lex)[0] == []


def test_planted_noise(spark):
    """Text with known noise comes back as it was."""
    rng = random.Random(3)
    t = D(2024, 1, 1)
    words = WORDS + "buffer carries header between routers during transfer because several stations share medium until acknowledgement arrives".split()
    seen_for = {m: c for c, ms in S.CONFUSED.items() if len(c) == 1 for m in ms if len(m) == 1 and c.isalpha()}
    rows, truth = [], {}
    counts = {"hyphen": set(), "misread": set()}
    for p in range(2, 302):
        clean, lines = [], []
        carry = ""
        for i in range(16):
            ws = [rng.choice(words) for _ in range(7)]
            clean += ws
            shown = list(ws)
            uid = f"s09_c1_p{p:03d}_b00_l{i:02d}"
            kind = rng.random()
            k = rng.randrange(1, 6)
            if kind < 0.05 and len(shown[k]) > 6:
                at = [j for j, ch in enumerate(shown[k]) if ch in seen_for]
                if at:
                    j = rng.choice(at)
                    new = shown[k][:j] + seen_for[shown[k][j]] + shown[k][j + 1 :]
                    if new not in words:
                        shown[k] = new
                        counts["misread"].add(uid)
            elif kind < 0.09 and len(shown[k]) > 6:
                shown[k] = shown[k][:3] + " " + shown[k][3:]
            elif kind < 0.13 and len(shown[k]) > 3 and len(shown[k + 1 if k < 5 else 5]) > 3:
                shown[k : k + 2] = ["".join(shown[k : k + 2])]
            if carry:
                shown.insert(0, carry)
                carry = ""
            if i < 15 and rng.random() < 0.1 and len(shown[-1]) > 6 and shown[-1] in words:
                shown[-1], carry = shown[-1][:4] + "-", shown[-1][4:]
                counts["hyphen"].add(uid)
            lines.append(" ".join(shown))
            rows.append((uid, None, i, 0, i, lines[-1], t, t, "k", p))
        truth[f"s09_c1_p{p:03d}"] = clean
    got, right, given, wanted = {"hyphen": set(), "misread": set()}, 0, 0, 0
    for r in S.repair(spark.createDataFrame(rows, COLS)).collect():
        for u, k in zip(r.uids, r.kinds, strict=True):
            got.setdefault(k, set()).add(u)
        out = " ".join(r.paragraphs).split()
        both = Counter(out) & Counter(truth[r.page])
        right, given, wanted = right + sum(both.values()), given + len(out), wanted + len(truth[r.page])
    assert right / wanted > 0.995 and right / given > 0.995
    for kind, want in counts.items():
        hit = len(want & got[kind])
        assert hit / len(want) >= 0.95 and hit / len(got[kind]) >= 0.95, kind
