from __future__ import annotations

import random

import numpy as np
import pandas as pd

from tickstone.llm.subjects import Growing, Training, _terms, composition, decode, fit, languages, scan, subjects_of

TERMS = {
    "oil": ["crude cargoes", "shale wells", "gas storage", "fuel terminals"],
    "law": ["court dockets", "jury verdicts", "appeal filings", "patent suits"],
    "farm": ["wheat yields", "dairy herds", "grain silos", "feed mills"],
}
COMMON = ["The session was quiet and the book ended flat.", "A bumper crop of late rows came in.", "The ball is in the court of the risk desk.", "Nothing after the tick was read.", "We ship the weights as they are."]
FRAMES = ["Our note leans on {}, which slowed.", "Costs around {} are 5.1 percent of sales.", "What moved it was {}, by our count.", "The bear case rests on {} again."]


def make(rng, n, noise=0.0):
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 1, 1, 2])
        own = rng.sample(sorted(TERMS), k)
        body = [rng.choice(COMMON) for _ in range(rng.randint(3, 5))]
        for s in own:
            body += [rng.choice(FRAMES).format(rng.choice(TERMS[s])) for _ in range(rng.randint(4, 6))]
        if rng.random() < 0.3:
            other = rng.choice([s for s in TERMS if s not in own])
            body.append(rng.choice(FRAMES).format(rng.choice(TERMS[other])))
        rng.shuffle(body)
        label = sorted(own) or ["none"]
        if rng.random() < noise:
            label = [rng.choice(sorted(TERMS))]
        out.append((i, " ".join(body), rng.choice(["wire", "forum", None]), rng.choice(["en", "EN ", None]), sorted(own), label))
    return out


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = make(rng, 700, 0.08)
    docs = spark.createDataFrame([(i, t, s, g) for i, t, s, g, *_ in rows], "doc_id bigint, text string, source string, lang string")
    subjects = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    labels = spark.createDataFrame([(i, x if i % 3 else x.upper() + " ") for i, *_, label in rows[:400] for x in label] + [(None, "oil"), (5, None), (10**6, "law")], "doc_id bigint, subject string")
    got = {(r.doc_id, r.subject) for r in subjects_of(docs, subjects, labels).collect()}
    want = {(i, s) for i, *_, own, _ in rows[400:] for s in own}
    mine = {x for x in got if x[0] >= 400}
    assert len(mine & want) / len(mine) > 0.97 and len(mine & want) / len(want) > 0.97


def test_two_languages_have_their_own_terms():
    rng = random.Random(3)
    rows = make(rng, 300)
    other = [(i, t.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")), s, "xx", own, label) for i, t, s, _, own, label in make(rng, 300)]
    both = rows + other
    df = pd.DataFrame({"text": [r[1] for r in both], "source": [r[2] for r in both], "lang": [(r[3] or "").strip().lower() or None for r in both], "labels": [r[5] for r in both]})
    train = df.sample(400, random_state=0)
    model = fit(train.reset_index(drop=True), sorted(TERMS))
    assert set(model["terms"]) == {"", "en", "xx"}
    rest = df.drop(train.index)
    # a quotation in the other language counts by its own terms
    quoted = pd.DataFrame({"text": [f"{COMMON[0]} {other[1][1]} " + " ".join(FRAMES[0].format(x) for x in TERMS["law"] * 3)], "source": [None], "lang": ["xx"]})
    assert decode(model, quoted)[0][0, sorted(TERMS).index("law")] == 1
    label, share, p = decode(model, rest.reset_index(drop=True))
    want = np.array([[s in both[i][4] for s in sorted(TERMS)] for i in rest.index])
    assert (label == want).mean() > 0.98 and share.min() >= 0 and share.max() <= 1 + 1e-9 and (p <= 1 + 1e-9).all()
    s = scan([other[0][1].split(".")[0], both[0][1].split(".")[0]], model["words"])
    told = languages(s, *_terms(s, model["width"], model["pairs"]), model["languages"])
    assert [model["languages"][0][i] for i in told] == ["xx", "en"]


def test_null_empty_and_long_texts(spark):
    rows = make(random.Random(4), 200)
    docs = spark.createDataFrame([(i, t, s, g) for i, t, s, g, *_ in rows] + [(900, None, None, None), (901, "", "", ""), (902, " \n ", "wire", "en"), (903, "crude cargoes rose again. " * 20_000, "wire", "en"), (None, rows[0][1], None, None)], "doc_id bigint, text string, source string, lang string")
    subjects = spark.createDataFrame([("OIL",), ("law",), ("farm",), (None,)], "subject string")
    labels = spark.createDataFrame([(i, x) for i, *_, label in rows for x in label], "doc_id bigint, subject string")
    got = subjects_of(docs, subjects, labels)
    by = {r.doc_id: r.subject for r in got.where("doc_id >= 900").collect()}
    assert by == {903: "oil"}
    total = composition(got, docs).toPandas()
    assert total[total.subject == "none"].documents.sum() + got.select("doc_id").distinct().count() >= docs.count() - 1
    assert subjects_of(docs, subjects, labels.limit(0)).count() == 0 and subjects_of(docs, subjects.limit(0), labels).count() == 0
    assert subjects_of(docs.limit(0), subjects, labels).count() == 0


def test_sample_is_bounded(spark):
    from tickstone.llm.subjects import labelled

    rows = make(random.Random(5), 60)
    docs = spark.createDataFrame([(i, t, s, g) for i, t, s, g, *_ in rows], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, x) for i, *_, label in rows for x in label], "doc_id bigint, subject string")
    assert len(labelled(docs, labels, Training(most_documents=20))) == 20
    few = labelled(docs, labels, Training(most_chars=5000))
    assert 0 < sum(map(len, few.text)) <= 5000 and list(few.doc_id) == list(labelled(docs, labels).doc_id)[: len(few)]
    assert list(labelled(docs, labels).text) == list(labelled(docs.repartition(5), labels).text)


def test_sentences():
    number = Growing()
    s = scan(["<p>Oil rose 13.7 percent.</p><p>It fell!</p>\n- one\n- two\n\n \n", None, "", "(Oil.) Rose 5."], number)
    name = {i: w for w, i in number.items()}
    assert [" ".join(name[w] for w in s.word[s.row == r]) for r in range(6)] == ["oil rose # percent", "it fell", "one", "two", "oil", "rose #"]
    assert list(s.doc) == [0, 0, 0, 0, 3, 3] and list(s.lengths()) == [4, 0, 0, 2]
    row, term = _terms(s, len(number), np.array([number["oil"] * len(number) + number["rose"]]))
    assert sorted(term[row == 0]) == [number["oil"], number["rose"], number["#"], number["percent"], len(number)]
    again = scan(["oil unheard 7"], type(number).__mro__[1](number))
    assert list(again.word) == [number["oil"], -1, number["#"]]
