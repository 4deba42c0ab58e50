"""Leaks that stand in much of the table, in short items, in many places."""

import random

import pytest
from test_texts import DOC, passage

from fieldwatch.llm.leaks import find_leaks, remove_leaks, words

ITEM = "item_id string, passage string"


def test_leak_in_a_third_of_the_table(spark):
    rnd = random.Random(8)
    formula = passage(rnd, 15)
    items = [("whole", passage(rnd)), ("part", passage(rnd)), ("edited", passage(rnd)), ("formula", passage(rnd, 50) + " " + formula)]
    w = {k: v.split() for k, v in items}
    docs, want = {}, set()
    for i in range(300):
        text = passage(rnd, 30)
        if i % 3 == 0:
            text += " " + items[0][1]
            want.add((i, "whole"))
        if i % 5 == 1:
            text += " " + " ".join(w["part"][10:40])
            want.add((i, "part"))
        if i % 5 == 2:
            text += " " + " ".join("other" if k % 9 == i % 9 else x for k, x in enumerate(w["edited"]))
            want.add((i, "edited"))
        docs[i] = text + " " + passage(rnd, 30) + (" " + formula if i % 4 == 0 else "")
    docs |= {1000 + i: docs[0] for i in range(50)}  # exact copies
    want |= {(1000 + i, "whole") for i in range(50)}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], DOC)
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(items, ITEM)).collect()} == want


def test_three_tenths_of_short_items_and_repeated_halves(spark):
    rnd = random.Random(9)
    items = [("short", passage(rnd, 55)), ("halves", passage(rnd, 100))]
    s, h = (x[1].split() for x in items)
    docs = {
        1: passage(rnd, 40) + " " + " ".join(s[5:23]) + " " + passage(rnd, 40),  # 18 of 55 words in one place
        2: " ".join(s[:9]) + " " + passage(rnd, 60) + " " + " ".join(s[40:49]),  # 9 and 9
        3: " ".join(s[5:20]),  # 15 of 55
        4: (" " + passage(rnd, 20) + " ").join([" ".join(h[:50])] * 14 + [" ".join(h[52:])]),
    }
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], DOC)
    got = {(r.doc_id, r.item_id): r for r in find_leaks(df, spark.createDataFrame(items, ITEM)).collect()}
    assert got.keys() == {(1, "short"), (2, "short"), (4, "halves")}
    assert got[4, "halves"].share == 0.98 and len(got[4, "halves"].spans) == 2


@pytest.mark.parametrize("n, k", [(100, 4), (100, 21), (100, 100), (1000, 21), (1000, 1000)])
def test_an_item_is_found_however_many_documents_carry_it(spark, n, k):
    rnd = random.Random(10)
    item = passage(rnd)
    docs = [(d, passage(rnd, 20) + (" " + item if d < k else "") + " " + passage(rnd, 20), "x") for d in range(n)]
    got = {r.doc_id for r in find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([("ev", item)], ITEM)).collect()}
    assert got == set(range(k))


def test_long_markup_and_removal(spark):
    rnd = random.Random(11)
    item = passage(rnd)
    w = item.split()
    tag = "<span class='" + "x " * 400 + "'>"
    docs = [(1, passage(rnd, 20) + " " + " ".join(w[:20]) + tag + " ".join(w[20:]), "a"), (None, item, "b"), (2, None, "c"), (3, "a < b and c > d", "d")]
    df = spark.createDataFrame(docs, DOC)
    leaks = find_leaks(df.where("doc_id is not null"), spark.createDataFrame([("ev", item)], ITEM))
    assert [(r.doc_id, r.share) for r in leaks.collect()] == [(1, 1.0)]
    cut = {r.hits: r.text for r in remove_leaks(df, leaks).collect()}
    assert cut["b"] == item and cut["c"] is None and cut["d"] == "a < b and c > d" and len(words(cut["a"])) == 20
    assert words("a < b and c > d") == ["a", "b", "and", "c", "d"]
