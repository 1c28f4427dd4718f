"""What the classifier of page blocks learns from pages alone."""

import numpy as np

from matchlake.llm import extraction as X

SCHEMA = "page_id long, url string, html string, host string, __text string"


def pages(n):
    out = []
    for i in range(n):
        story = "".join(f"<p>Story {i} part {k} tells of a quiet village by the sea, and of those who left it.</p>" for k in range(4))
        out.append((i, f"https://site{i % 2}.example/{i}", f"<div><a href=x>Front page</a></div><article>{story}</article><div>All rights kept by us.</div>", "clash", "clash"))
    return out


def test_repeated_texts_are_boilerplate_and_unique_ones_of_articles_content(spark):
    df = spark.createDataFrame(pages(24), SCHEMA)
    weights = X.train(df)
    assert weights != X.PRIOR and weights == X.train(df.repartition(5))
    found = {b.text: X.logit(b, weights) - X.logit(b) for b in X.blocks(pages(1)[0][2])}
    assert found["All rights kept by us."] < 0 and found["Front page"] < 0
    texts = {r["page_id"]: r["text"] for r in X.extract_pages(df).collect()}
    assert len(texts) == 24 and all(t.count("\n\n") == 3 and "rights" not in t and "Front" not in t for t in texts.values())


def test_copies_of_one_article_do_not_make_it_boilerplate(spark):
    copies = [(i, "https://one.example/same", pages(1)[0][2], "", "") for i in range(30)]
    assert X.train(spark.createDataFrame(copies, SCHEMA)) == X.PRIOR  # nothing is repeated by different articles


def test_nothing_to_learn_from_gives_the_prior(spark):
    assert X.train(spark.createDataFrame([], SCHEMA)) == X.PRIOR
    assert X.train(spark.createDataFrame([(1, None, None, None, None), (None, "x", "", None, None)], SCHEMA)) == X.PRIOR


def test_the_prior_holds_weights_that_nothing_speaks_of():
    x = np.zeros((40, len(X.PRIOR)))
    x[:, 0], x[20:, 4] = 1.0, 1.0
    w = X.fit(x, np.r_[np.zeros(20), np.ones(20)])
    assert w[4] > X.PRIOR[4] and all(abs(a - b) < 1e-9 for i, (a, b) in enumerate(zip(w, X.PRIOR, strict=True)) if i not in (0, 4))


def test_every_page_counts(spark, monkeypatch):
    """A foot that three pages of thousands repeat is boilerplate, whichever they are; nothing is drawn."""
    rows = [(i, f"https://site{i}.example/{i}", f"<article><p>Story {i} tells of a quiet village by the sea.</p></article>", "", "") for i in range(6000)]
    foot = [(i, f"https://foot.example/{i}", f"<article><p>Tale {i} tells of a quiet village by the sea.</p></article><div>All rights kept by us.</div>", "", "") for i in range(6000, 6003)]
    counted = {}

    def spy(totals, n0, n1, *rest):
        counted.update(n0=n0, n1=n1)
        return real(totals, n0, n1, *rest)

    real = X.newton
    monkeypatch.setattr(X, "newton", spy)
    weights = X.train(spark.createDataFrame(rows + foot, SCHEMA))
    assert counted == {"n0": 6, "n1": 12006} and weights != X.PRIOR
