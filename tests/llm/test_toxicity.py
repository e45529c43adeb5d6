import math
import random

import numpy as np

from tessera.llm import toxicity as T
from tessera.llm.common import load


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    chain = T.fit(docs, labels.filter("doc_id % 4 <> 0"))
    test = labels.filter("doc_id % 4 = 0")
    got = T.score(docs, chain).join(test.withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r.toxic and r.label == 1 for r in got)
    told, true = sum(r.toxic for r in got), sum(r.label == 1 for r in got)
    print("precision", hit / told, "recall", hit / true)
    assert hit >= 0.95 * told and hit >= 0.8 * true


def test_scores_equal_the_models_and_odd_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad, rude = rng.random() < 0.3, rng.random() < 0.2
        words = [f"w{rng.randint(0, 50)}" for _ in range(20)] + ["Rude!" if rude else "kind"] + (["###junk"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    labels += [(None, 1, 1), (5, None, 1), (7, 0, None), (9999, 1, 1)]
    docs = spark.createDataFrame(rows + [(None, None), (401, ""), (0, rows[0][1]), (402, "rude " * 50000)], "doc_id long, text string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = T.fit(docs, label)
    assert chain.names == ("low_quality", "toxic") and len(chain.links[1].before) == 1
    got = T.score(docs, chain).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        p = chain.probabilities(T.words_of(t))
        assert math.isclose(by[i].p_toxic, p[1]) and by[i].toxic == (labels[i][2] == 1) and by[i].low_quality == (labels[i][1] == 0)
    assert by[402].toxic and not by[401].toxic and not by[None].toxic
    assert T.score(docs.limit(0), chain).count() == 0
    none = T.fit(docs, label.limit(0))
    assert not any(link.words for link in none.links)


def test_later_models_learn_from_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    first = rng.random(600) < 0.4
    second = first ^ (rng.random(600) < 0.05)
    sets = [{b"sign%d" % rng.integers(0, 3)} if f else {b"other%d" % rng.integers(0, 3)} for f in first]
    chain = T.fit_chain(sets, {"a": first, "b": second}, np.arange(600) % 5)
    assert chain.links[1].before[0] > 0
    p = np.array([chain.probabilities(s) for s in sets])
    assert ((p[:, 1] >= chain.bounds[1]) == second).mean() > 0.9
