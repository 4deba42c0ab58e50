"""Packing, leaks and abuse: validity, planted cases, odd input."""

import random
from collections import defaultdict

import numpy as np
import pytest

from fieldwatch.llm.abuse import AbuseRule, Automaton, Matcher, fit_weights, rates_by_source, real_words, score_documents, score_text
from fieldwatch.llm.leaks import LeakRule, find_leaks, plain, remove_leaks, words
from fieldwatch.llm.packing import Plan, count_tokens, fill_report, nnls, pack, patterns

CAPS = "container_kind string, capacity_tokens int"


def check_packing(rows, capacities, lengths):
    load, seen = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container_kind, r.container_id] += r.n_tokens
        seen[r.container_kind, r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
    for (kind, _), n in load.items():
        assert n <= capacities[kind]
    for kind, cap in capacities.items():
        for d, n in lengths.items():
            pieces = sorted(seen.get((kind, d), []))
            assert sum(p[2] for p in pieces) == n
            assert len(pieces) == -(-n // cap)
            assert [p[1] for p in pieces] == [i * cap for i in range(len(pieces))]
    return load


@pytest.mark.parametrize("lengths", [lambda r: int(r.lognormvariate(5, 1)) + 1, lambda r: 300, lambda r: r.choice([1, 2, 700, 1500]), lambda r: 0])
def test_every_document_once_and_no_container_too_full(spark, lengths):
    rnd = random.Random(2)
    docs = {i: lengths(rnd) for i in range(900)}
    tokens = spark.createDataFrame([(d, n) for d, n in docs.items()], "doc_id long, n long")
    caps = spark.createDataFrame([("s", 512), ("l", 4096), (None, 7), ("zero", 0), ("none", None)], CAPS)
    packed = pack(tokens, caps)
    rows = packed.collect()
    for r in fill_report(packed).collect():
        assert r.least_containers <= r.containers == len({x.container_id for x in rows if x.container_kind == r.container_kind}) and r.documents == sum(n > 0 for n in docs.values())
    load = check_packing(rows, {"s": 512, "l": 4096}, docs)
    for kind, cap in (("s", 512), ("l", 4096)):
        used = [n for (k, _), n in load.items() if k == kind]
        if len(set(docs.values())) > 100:  # lengths that can fill a container
            assert len(used) <= 1.03 * -(-sum(docs.values()) // cap) + 2


def test_packing_of_nothing(spark):
    tokens = spark.createDataFrame([], "doc_id long, n long")
    assert pack(tokens, spark.createDataFrame([("s", 10)], CAPS)).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, n long"), spark.createDataFrame([], CAPS)).count() == 0


def test_plan_does_not_grow_with_documents():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 0.8, 20000).astype(int) + 1), minlength=2049)
    small, large = Plan.best(2048, counts), Plan.best(2048, counts * 1000)
    assert len(large.entries) < 2 * len(small.entries)
    assert large.containers < 1.002 * (counts * np.arange(2049)).sum() * 1000 / 2048 + 10


@pytest.mark.parametrize("capacity", [768, 2048, 8192])
def test_no_worse_than_best_fit(capacity):
    rng = np.random.default_rng(5)
    lengths = np.minimum(capacity, rng.lognormal(6.6, 0.8, 15000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=capacity + 1)

    class Residual(Plan):
        def _by_patterns(self, bins, most):
            pass

    assert Plan.best(capacity, counts).containers <= Residual(capacity, counts, 1, 1).containers


def test_large_containers_and_two_capacities_of_a_kind(spark):
    docs = {i: n for i, n in enumerate([5_000_000, 1_999_990, 10, 999_999, 1_000_001, 3, 250_000, 250_000])}
    tokens = spark.createDataFrame([(d, n) for d, n in docs.items()], "doc_id long, n long")
    rows = pack(tokens, spark.createDataFrame([("huge", 2_000_000), ("two", 100_000), ("two", 4_000_000)], CAPS)).collect()
    for kind, cap in (("huge", 2_000_000), ("two", 100_000), ("two", 4_000_000)):
        check_packing([r for r in rows if (r.container_kind, r.capacity_tokens) == (kind, cap)], {kind: cap}, docs)


def test_nnls():
    rng = np.random.default_rng(1)
    rows = patterns(12, 3, np.ones(13, bool))
    assert len(rows) == 1 + 6 + 12 and all(sum(r) == 12 and list(r) == sorted(r, reverse=True) for r in rows.tolist())
    x = np.zeros(len(rows))
    x[[2, 7, 11, 15]] = rng.integers(5, 50, 4)
    b = np.zeros(13)
    for r, n in zip(rows, x):
        for g in r:
            b[g] += n * (g > 0)
    used, told = nnls(rows, b, np.ones(13))
    fit = np.zeros(13)
    for j, n in zip(used, told):
        for g in rows[j]:
            fit[g] += n * (g > 0)
    assert (told >= 0).all() and np.allclose(fit, b, atol=1e-2)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 5000), (5, "<|endoftext|>")], "doc_id long, text string")
    n = {r.doc_id: r.n for r in count_tokens(df).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 300 and n[5] > 1


def passage(rnd, n=60):
    return " ".join(f"{rnd.choice('bcdfgklmnprst')}{rnd.choice('aeiou')}{rnd.choice('bcdfgklmnprst')}{rnd.randrange(400)}" for _ in range(n))


DOC = "doc_id long, text string, hits string"


def test_leaks(spark):
    rnd = random.Random(3)
    items = [(f"ev{i}", passage(rnd)) for i in range(4)]
    formula = " ".join(passage(rnd, 25).split())
    items[3] = ("ev3", items[3][1] + " " + formula)
    w = items[0][1].split()
    edited = [x if i % 9 else "other" for i, x in enumerate(w)]
    shuffled = [" ".join(w[i: i + 4]) for i in range(0, 60, 4)]
    rnd.shuffle(shuffled)
    docs = {
        1: passage(rnd, 300), 2: passage(rnd, 50) + " " + items[0][1] + " " + passage(rnd, 50), 3: "Intro. " + ", ".join(edited).upper(), 4: " ".join(w[:26]), 5: " ".join(w[5:17]), 6: "<p>" + "-\n".join(["x", "y"]) + " ".join(w[:20]) + "</p> " + passage(rnd, 60) + " " + " ".join(w[30:50]),
        7: " ".join(shuffled), 8: items[1][1] + " " + passage(rnd, 200) + items[2][1], 9: "", 10: None, 11: passage(rnd, 20000) + " " + items[1][1],
    }
    docs |= {100 + i: passage(rnd, 40) + (" " + formula if i < 60 else "") for i in range(400)}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], DOC)
    ev = spark.createDataFrame(items + [("blank", ""), ("null", None)], "item_id string, passage string")
    leaks = find_leaks(df, ev)
    got = {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert got == {(2, "ev0"), (3, "ev0"), (4, "ev0"), (6, "ev0"), (8, "ev1"), (8, "ev2"), (11, "ev1")}
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, ev, LeakRule(most_words=100)).collect()} == got  # in several blocks
    cut = {r.doc_id: r.text for r in remove_leaks(df, leaks).collect()}
    assert len(cut) == len(docs) and cut[1] == docs[1] and cut[10] is None
    assert not set(words(items[0][1])) & set(words(cut[2])) and len(words(cut[2])) == 100
    assert {r.doc_id for r in remove_leaks(df, leaks, "documents").collect()} == docs.keys() - {2, 3, 4, 6, 8, 11}
    assert find_leaks(df.limit(0), ev).count() == 0 and find_leaks(df, ev.limit(0)).count() == 0


def test_plain_text():
    assert plain("a hy-\nphen &amp; <b>tag</b>").split() == ["a", "hyphen", "&", "tag"]


ABUSE = ["You are a filthy sh1thead.", "Go to hell, you b*tch!", "Listen, s c u m b a g: next time", "Du dreckige R-a-t-t-e, halt endlich das Maul.", "whhhhore", "Va te faire foutre, sale еnсulé !", "Hang the strangers from the lamp posts, every one of them.",
         "I will cut your throat.", "Los tarvianos no son personas, son ratas.", "You are a lying\npig and everybody knows it.", "Fuck you", "dickh​ead", "Schlam-\npe"]
SOBER = ["The breeding bitch, a spaniel aged four, was examined.", "The term 'bastard title' refers to the page.", "The pig farm at the boundary produced slurry.", "The rape field west of the canal had been sown late.", "He was found to have killed the engine.",
         "The indictment for sexual assault under section 14 was withdrawn.", "Die Sau warf elf Ferkel.", "La zorra hallada en la finca fue entregada al guarda.", "Les ordures ménagères relevaient de la commune.", "", "1234 56/78", "The whole title of Mr Fuchs."]


REAL = real_words()


def test_abuse():
    m = Matcher(AbuseRule(), REAL)
    assert [t for t in ABUSE if score_text(t, m)[0] < 0.8] == []
    assert [t for t in SOBER if score_text(t, m)[0] >= 0.8] == []
    long = "The notice was served. " * 20000
    assert score_text(long + "Fuck you.", m)[0] > 0.99 and score_text(long, m)[0] == 0.0
    assert score_text('He said "Go to hell, you bitch!" and left.', m)[3] and not score_text("Go to hell, you bitch!", m)[3]


def test_abuse_table(spark):
    rows = [(i, "s" if i % 2 else None, t, 0) for i, t in enumerate([*ABUSE, *SOBER, None])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, score int")
    out = score_documents(df)
    assert out.count() == len(rows) and out.where("score >= 0.8").count() == len(ABUSE)
    assert {r.source for r in rates_by_source(out).collect()} == {"s", None}
    assert score_documents(df.limit(0)).count() == 0


def test_automaton_equals_edit_distance():
    rnd = random.Random(6)
    lexicon = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 9))) for _ in range(60)})
    limit = lambda w: 2 if len(w) > 6 else 1
    automaton = Automaton(lexicon, limit, most_states=50)  # states are forgotten on the way

    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i and j and x == b[j - 1] and y == a[i - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    for _ in range(400):
        form = "".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 10)))
        fits = [(d, w) for w in lexicon if (d := distance(form, w)) <= limit(w)]
        found = automaton.find(form)
        assert (found is not None) == bool(fits) and (found is None or found[0] == min(fits)[0] == distance(form, found[1]))


def test_misspelt_words_are_found_and_real_words_are_not():
    rnd, m = random.Random(3), Matcher(AbuseRule(), REAL)
    tried = missed = 0
    for w in sorted(m.strong):
        k, c = rnd.randrange(len(w)), rnd.choice("abcdefghijklmnopqrstuvwxyz")
        for x in (w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + w[k + 1: k + 2] + w[k: k + 1] + w[k + 2:]):
            if len(w) > 3 and x not in REAL and x not in m.known:
                tried += 1
                missed += score_text(f"You are a {x} and everybody knows it.", m)[0] < 0.8
    assert tried > 300 and missed <= 0.1 * tried
    for sober in ("your pitch was good", "where you hire the count", "He called the pitch and shot the duck", "spic and span", "The Chinese room had a chink in the wall", "The book by Kike Hernandez", "In Assvole v Rasnal the plea failed"):
        assert score_text(sober, m)[0] < 0.8
    for bad in ("you fuk off you biych", "bastrad you are worthless", "fcuk you", "negroes are not human", "you people should be gassed"):
        assert score_text(bad, m)[0] >= 0.8


def test_weights_hold_on_texts_they_were_not_fitted_to():
    """Half of the distinct reviewed texts is held out; a few verdicts are wrong."""
    import pyarrow.parquet as pq

    rows = [(r["text"], r["verdict"] == "offensive") for r in pq.read_table("/root/testdata/sf0.01/review_samples.parquet").to_pylist() if r["text"] and r["verdict"]]
    texts = sorted({t for t, _ in rows})
    held = set(random.Random(1).sample(texts, len(texts) // 2))
    m = Matcher(AbuseRule(), REAL)
    m.weights = fit_weights([x for x in rows if x[0] not in held], m)
    told = [(score_text(t, m)[0] >= 0.8, bad) for t, bad in rows if t in held]
    hit = sum(a and b for a, b in told)
    assert hit >= 0.9 * sum(b for _, b in told) and hit >= 0.9 * sum(a for a, _ in told)


def test_without_samples_the_prior_holds(spark):
    m = Matcher(AbuseRule(), REAL)
    assert fit_weights([], m) == m.weights
    none = spark.createDataFrame([(None, "offensive"), ("Fuck you", None)], "text string, verdict string")
    docs = spark.createDataFrame([(1, "s", "Fuck you"), (2, "s", "x" * 300 + " good"), (3, None, "")], "doc_id long, source string, text string")
    assert {r.doc_id: r.score > 0.9 for r in score_documents(docs, none).collect()} == {1: True, 2: False, 3: False}
