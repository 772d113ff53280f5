"""The learned vectors against numpy's decomposition of the same rows."""

import random

import numpy as np
from oracle import SF

from lodestone import catalog
from lodestone.operators import latent


def made(n=80, seed=4):
    rnd = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(5)]
    return [" ".join(rnd.choices(topics[k % 5], k=rnd.randint(3, 30)) + rnd.choices(["the", "of", "and"], k=4)) for k in range(n)] + ["", None, "only"]


def test_equal_to_numpy_up_to_sign(spark):
    texts, columns = made(), 512
    model = latent.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6), dims=8, columns=columns, rounds=12)
    dense = np.zeros((len(texts), columns))
    seen = np.zeros(columns)
    for t in texts:
        seen[latent.counts(t, columns)[0]] += 1
    idf = np.log((1 + len(texts)) / (1 + seen)) + 1
    for i, t in enumerate(texts):
        at, weight = latent.row(t, idf)
        dense[i, at] = weight
    _, values, right = np.linalg.svd(dense)
    assert np.allclose(model.idf, idf) and np.allclose(model.values[:5], values[:5], atol=1e-6)
    assert np.allclose(np.abs((model.vectors[:, :5] * right[:5].T).sum(axis=0)), 1.0, atol=1e-6)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: np.array(r.embedding) for r in model.embed(df, "id", "text").collect()}
    assert len(got) == len(texts) and not got[80].any() and not got[81].any()
    same = np.mean([got[i] @ got[j] for i in range(40) for j in range(i) if i % 5 == j % 5])
    other = np.mean([got[i] @ got[j] for i in range(40) for j in range(i) if i % 5 != j % 5])
    assert same > other + 0.5


def test_no_texts(spark):
    none = spark.createDataFrame([], "text string")
    model = latent.fit(none, dims=4, columns=64)
    assert model.vectors.shape == (64, 4) and not model.values.any()
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert len(model.embed(df, "id", "text").first().embedding) == 4


def test_learned_vectors_find_passages(spark):
    rows = {r.retriever: r for r in catalog.QUERIES["eval_learned"](spark, SF).collect()}
    assert set(rows) == {"hashed", "learned"} and all(r.queries > 0 and r.mrr > 0 for r in rows.values())


def test_texts_are_cut_once(spark, monkeypatch):
    """Every pass reads the rows that were kept, not the texts."""
    used = []
    monkeypatch.setattr(latent, "added", lambda found, *a, added=latent.added: (used.append(found.columns), added(found, *a))[1])
    latent.fit(spark.createDataFrame([(t,) for t in made()], "text string"), dims=4, columns=64, rounds=2)
    assert used == [["at", "weight"]] * 4
