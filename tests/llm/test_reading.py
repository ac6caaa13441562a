"""Held-out accuracy, language, sentences, nulls, labels that are wrong or missing."""

import numpy as np

from paperloom.common import table
from paperloom.llm import reading as R


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = table(spark, d, "level_labels").filter("level between 1 and 4").join(table(spark, d, "documents"), "doc_id").orderBy("doc_id").select("doc_id", "level", "text").collect()
    seen, docs, levels = set(), [], []
    for r in rows:
        if r.text and r.doc_id not in seen and len(r.text.split()) >= 40 and R.is_english(R._WORD(r.text.lower())):
            seen.add(r.doc_id)
            docs.append(R.sentences(r.text))
            levels.append(r.level)
    y = np.array(levels)
    cut = len(docs) // 2
    model = R.fit(docs[:cut], np.eye(4)[y[:cut] - 1])
    assert (model.levels(docs[cut:]) == y[cut:]).mean() > 0.9


def test_language():
    w = lambda t: R._WORD(t.lower())
    assert R.is_english(w("Every packet is sent to the router and then it waits"))
    assert not R.is_english(w("Der Rahmen wird nach der Pause erneut gesendet und die Station wartet"))
    assert not R.is_english(w("El enrutador descarta el paquete porque la cola está llena"))
    assert not R.is_english(w("राउटर पैकेट की जाँच करता है")) and not R.is_english([])


def test_sentences():
    assert R.sentences("One two three four. Five six seven\neight! 1. 22") == [["one", "two", "three", "four"], ["five", "six", "seven", "eight"]]
    assert max(map(len, R.sentences("word " * 1000))) <= 45 and R.sentences("") == [] and R.sentences(" .. ") == []


def test_which_documents_have_a_level(spark):
    long_en = "the old house is on the hill and my dog sees it. " * 5
    docs = [(1, long_en), (2, None), (3, ""), (4, "the cat"), (5, "die Station wartet auf der Straße und das Paket ist da. " * 8), (None, long_en), (6, long_en), (6, long_en), (7, long_en * 2000)]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(1, "r", 1), (6, "r", 1), (6, "s", 2), (6, None, None), (7, "r", 9), (None, "r", 2), (88, "r", 3)], "doc_id long, rater string, level int")
    got = sorted((r.doc_id, r.level) for r in R.reading_levels(d, labels).collect())
    assert [k for k, _ in got] == [1, 6, 6, 7] and all(v in (1, 2) for _, v in got)
    none = R.reading_levels(d, labels.limit(0)).collect()
    assert {r.level for r in none} == {1} and R.reading_levels(d.limit(0), labels).count() == 0
