"""Leaks planted in documents of the same vocabulary, and quotations that are none; longest stretches by brute force; one index for several searches; nulls."""

import random

import numpy as np
import pytest

from paperloom.llm import leaks as L

VOCAB = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    line = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = {i: line(rng.randint(34, 90)) for i in range(25)}
    docs, truth = {}, set()
    for d in range(400):
        text, kind = line(rng.randint(20, 200)), d % 5
        i = rng.randrange(25)
        q = list(items[i])
        if kind == 1:
            n = rng.randint(15, len(q))
            at = rng.randint(0, len(q) - n)
            q = q[at : at + n]
        elif kind == 2:
            for k in range(4, len(q), rng.randint(9, 12)):
                q[k] = "changed"
        elif kind == 3:
            at = len(q) // 2
            q = q[:at] + line(40) + q[at:]
        elif kind == 4:
            q = q[:12]
        if kind:
            at = rng.randint(0, len(text))
            text[at:at] = q
        if kind in (1, 2, 3):
            truth.add((d, i))
        sep = rng.choice([" ", "\n", ", ", "  -- "])
        docs[d] = sep.join(w.upper() if rng.random() < 0.2 else w for w in text)
    return docs, {i: " ".join(x) for i, x in items.items()}, truth


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", t) for i, t in rows], "doc_id long, text string, token string, places string")


def _items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, segment int")


def _brute(docs, items, least=15):
    """Longest leaks by following every unbroken run of five words (or of the whole item) from its first word."""
    out = {}
    for d, text in docs:
        b = L.words(text)
        for i, it in items:
            a = L.words(it)
            need = min(5, len(a))
            equal = {(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]}
            starts = [(x, y) for x, y in equal if (x - 1, y - 1) not in equal and all((x + k, y + k) in equal for k in range(need))]
            spans, parts = [0], []
            for x, y in starts:
                span, _, first, last = L.best_stretch(a, b, x, y, 0, len(b))
                parts.append((first, last))
                spans.append(span if span >= min(least, len(a)) else 0)
            if len(starts) > 1:
                spans.append(L._interrupted(parts, len(a)))
            if max(spans):
                out[d, i] = max(out.get((d, i), 0), max(spans))
    return out


def test_planted(spark, planted):
    docs, items, truth = planted
    d = _docs(spark, [*docs.items(), (None, items[0]), (1000, None), (1001, ""), (1002, "w1"), (0, docs[0])])
    e = _items(spark, [*items.items(), (99, None), (98, ""), (None, "w1 w2 w3 w4")])
    index = L.Index.build(d, segment_words=3000)
    assert index.rows().select("segment").distinct().count() > 5
    got = {(r.doc_id, r.item_id): r.n_words for r in L.search(index, e).collect()}
    assert set(got) == truth and got == _brute(docs.items(), items.items())
    # one index serves other items and other blocks
    assert got == {(r.doc_id, r.item_id): r.n_words for r in L.search(index, e, block_words=300).collect()}
    some = {k: v for k, v in items.items() if k % 3 == 0}
    assert {k: v for k, v in got.items() if k[1] in some} == {(r.doc_id, r.item_id): r.n_words for r in L.search(index, _items(spark, some.items())).collect()}


def test_longest_stretch_counts(spark):
    long = [f"v{i}" for i in range(38)]
    texts = [(1, " ".join([*long[3:19], "x y z", *long])), (2, "stop and wait, then go on"), (3, "Stop, and go"), (4, " ".join(long[:9])), (5, "ring " * 3000)]
    items = [(1, " ".join(long)), (2, "stop and wait"), (3, "and"), (4, "a b"), (5, "ring ring"), (1, "and wait then")]
    got = {(r.doc_id, r.item_id): r.n_words for r in L.find_leaks(_docs(spark, texts), _items(spark, items)).collect()}
    assert got == {(1, 1): 38, (2, 2): 3, (2, 3): 1, (3, 3): 1, (5, 5): 2, (2, 1): 3}
    assert got == _brute(texts[:4], items) | {(5, 5): 2}


def test_many_different_words(spark):
    words = [f"u{i}" for i in range(70_000)]
    got = L.find_leaks(_docs(spark, [(1, " ".join(words[30_000:30_040])), (2, " ".join(words)), (3, " ".join(reversed(words[:50])))]), _items(spark, [(7, " ".join(words))])).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in got} == {(1, 7, 40), (2, 7, 70_000)}


def test_packed_positions():
    for places in ([], [0], [3, 4, 300], [0, 70_000, 70_001], [5, 5_000_000_000]):
        assert L.unpack(L.pack(np.array(places, dtype=np.int64))).tolist() == places


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    e = spark.createDataFrame([], "item_id long, text string")
    assert L.find_leaks(d, e).isEmpty() and L.find_leaks(d.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).isEmpty()


def test_words():
    assert L.words("Ｅnd-to-\nend, the connec-\ntion​!") == ["end", "toend", "the", "connection"]
    assert L.words(None) == [] and L.words(" .. ") == []


def test_cheapest_cover():
    rng = random.Random(1)
    for n in (0, 1, 2, 4, 5, 6, 9, 12):
        cost = [rng.randint(1, 9) for _ in range(n)]
        kept = L.cheapest_cover(cost, 4)
        covers = lambda k, n=n: all(any(x in k for x in range(i, i + min(4, n))) for i in range(n - min(4, n) + 1)) if n else True
        assert covers(set(kept))
        assert sum(cost[i] for i in kept) == min(sum(cost[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if covers({i for i in range(n) if m >> i & 1}))


def test_whole_item_interrupted_once():
    assert L._interrupted([(0, 9), (10, 19)], 20) == 20 and L._interrupted([(0, 9)], 20) == 0 and L._interrupted([(0, 5), (14, 19)], 20) == 0
