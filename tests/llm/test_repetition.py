"""Shares against brute force, one path for all lengths, a posterior that decides, nulls and empty tables."""

from datetime import datetime as D

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import repetition as R
from tests.compare import connect, rows, sql_rows

COLS = "line_uid string, page_id string, reading_order int, block_id int, line_id int, text string, generated_at timestamp_ntz, loaded_at timestamp_ntz, share double, votes string"


def _brute(words):
    hit = set()
    for i in range(len(words) - 3):
        if any(words[k : k + 4] == words[i : i + 4] for k in range(i)):
            hit |= set(range(i, i + 4))
    return len(hit) / len(words) if words else None


def _measure(*pages):
    p = R.Pages()
    for lines in pages:
        for x in lines:
            p.line(x)
        p.end()
    n, share, votes = p.measures()
    return [(int(a), None if b != b else float(b), c.tolist()) for a, b, c in zip(n, share, votes, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4))
def test_share(pages):
    for (n, share, _), words in zip(_measure(*[[" ".join(x)] for x in pages]), pages, strict=True):
        assert n == len(words) and (share is None) == (not words)
        assert not words or abs(share - _brute(words)) < 1e-12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "e f g", "a b c d e", "h i j k l m n o", "p q r s"]), max_size=30), st.lists(st.sampled_from(["a", "q r s t u"]), max_size=3))
def test_a_repeated_page_has_the_votes_it_needs(lines, before):
    n, share, votes = _measure(before, lines)[1]
    if share is not None and share >= 1 / 3:
        assert min(votes) >= 0 and votes[:2] == [1, 1]


def _table(spark, lines):
    t = D(2024, 1, 1)
    return spark.createDataFrame([(f"{p}_b00_l{i:02d}", p, i, 0, i, x, t, t, 0.5, "v") for p, i, x in lines], COLS)


def test_pages_of_any_length(spark, monkeypatch):
    lines = [("p", i, "the old gate copies the frame" if i % 2 else f"line {i} is new") for i in range(30)] + [("q", 0, "one two"), ("q", 1, None), ("r", 0, "—"), ("r", 1, "")]
    lines += [("s", i, f"number {i} of many other lines that differ a{i} b{i} c{i}") for i in range(40_000)]
    df = _table(spark, lines)
    got = {r.page_id: (r.n_words, r.share and round(r.share, 9), r.votes) for r in R.page_measures(df).collect()}
    assert got["p"][0] == 30 // 2 * 6 + 15 * 4 and got["s"][0] == 40_000 * 11 and got["r"] == (0, None, [0] * 6)
    monkeypatch.setattr(R, "CHUNK", 1)
    assert {r.page_id: (r.n_words, r.share and round(r.share, 9), r.votes) for r in R.page_measures(df).collect()} == got
    # a page's votes are those of its text, whatever its length
    twice = _measure([x for _, _, x in lines[:30]], [x for _, _, x in lines[:30]] * 1000)
    assert twice[0][2][:2] == [1, 1] and twice[1][2] == [1] * 6
    found = {r.page_id: r.repetitive for r in R.repeated_pages(df).collect()}
    assert found == {"p": True, "q": False, "r": False, "s": True}


def test_latest_reading_counts(spark):
    t, u = D(2024, 1, 1), D(2024, 1, 2)
    same = "every lost token leaves the ring"
    rows_ = [("P_b00_l00 ", " P", 0, 0, 0, same, t, t, 0.0, ""), ("p_b00_l01", "p", 1, 0, 1, same, t, t, 0.0, ""), ("p_b00_l01", "p", 1, 0, 1, "something else was read here", u, u, 0.0, ""), (None, "p", 2, 0, 2, same, t, t, 0.0, "")]
    df = spark.createDataFrame(rows_ + rows_, COLS)
    assert [(r.n_words, r.share) for r in R.page_measures(df).collect()] == [(11, 0.0)]


def test_queries_equal_sql(spark, sf):
    con = connect(sf)
    for name in R.SQL:
        assert rows(R.QUERIES[name](spark, sf)) == sql_rows(con, R.SQL[name])


def test_posterior():
    bad, fine, mixed, least, none = (1, 1, 1, 0, 1, 1), (-1, -1, -1, 0, 0, 0), (1, -1, -1, 0, 0, 0), (1, 1, 0, 0, 0, 0), (0,) * 6
    post = R.weigh({bad: 40, fine: 900, mixed: 3, least: 2, none: 50})
    assert post[bad] > 0.9 and post[fine] < 0.01 and post[mixed] < R.LIKELY <= post[least] and abs(post[none] - R.BALANCE) < 1e-9
    # whatever the mix, abstentions are no evidence, votes for fine speak against, two votes for are enough
    for counts in ({none: 100_000}, {fine: 60_000, none: 40_000}, {least: 99_000, none: 1000}, {mixed: 50_000, least: 10, none: 5}, {(-1, 0, 0, 0, 0, 0): 70_000, none: 30_000}):
        for pattern, p in R.weigh(counts).items():
            assert p >= R.LIKELY if pattern == least else p < R.LIKELY
    assert R.weigh({}) == {}


def test_posterior_decides(spark):
    # the exact share alone would keep it: two thirds repeated, but the posterior is asked first
    df = _table(spark, [("p", i, "the old gate copies the frame") for i in range(3)])
    assert [r.repetitive for r in R.repeated_pages(df).collect()] == [True]
    assert [r.repetitive for r in R.repeated_pages(df, likely=0.9999).collect()] == [False]


def test_empty(spark):
    assert R.repeated_pages(spark.createDataFrame([], COLS)).isEmpty()
