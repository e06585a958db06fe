import random

import numpy as np

from radiokpi.llm import toxicity
from tests.llm.conftest import sentence


def table(n=600):
    rng = random.Random(3)
    texts, labels = [], []
    families = list(toxicity.FAMILIES.values())
    for k in range(n):
        words = sentence(rng, rng.randint(5, 60)).split()
        if k % 6 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(rng.choice(families)))
        texts.append(" ".join(words))
        labels.append((k, 1, int(k % 6 == 0)))
    return texts, labels


def test_held_out_toxicity(spark, docs):
    texts, labels = table()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs([*texts, None, "", "IDIOT! and scum"]), known).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 3
    truth = [(got[d]["toxic"], t) for d, _, t in labels]
    assert np.mean([a == b for a, b in truth]) > 0.97
    assert got[len(texts)]["toxic"] == 0 and got[len(texts) + 2]["toxic"] == 1
    insult = got[len(texts) + 2]["p_insult"]
    assert insult > got[0 + 1]["p_insult"]


def test_later_links_read_earlier_probabilities():
    texts, labels = table()
    chain = toxicity.fit_chain(texts, np.array([t for *_, t in labels]))
    assert [len(w) for w in chain.weights] == [len(chain.vocabulary) + k + 1 for k in range(3)]
    assert chain.categories == ("insult", "contempt", "toxic")
    assert abs(chain.weights[2][-3:-1]).max() > 0


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["p_toxic"] for r in toxicity.scored(docs(["a", None]), none).collect()] == [0.5, 0.5]
    assert toxicity.scored(docs([]), none).count() == 0
