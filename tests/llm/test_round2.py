"""Verification of fuzzy lines and calibration of languages, by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import htmltext, langid, linededup


def test_lines_within_the_similarity_equal_the_plain_distance(spark):
    r, letters, rows = random.Random(3), "abcdeéß日 ", []
    for _ in range(600):
        n = r.choice([1, 3, 10, 30, 80, 250, 500])
        x = [r.choice(letters) for _ in range(n)]
        y = list(x)
        for _ in range(int(n * r.choice([0, 0.03, 0.1, 0.14, 0.16, 0.2, 0.5]))):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = [r.choice(letters)] * r.randrange(2)
        rows.append(("".join(x), "".join(y)))
    rows += [("", ""), ("a", ""), ("word " * 200, "word " * 199), ("a" * 400, "a" * 461), ("a" * 400, "a" * 471)]
    plain = "levenshtein(x, y) <= floor(0.15 * greatest(length(x), length(y)) + 1e-9)"
    found = spark.createDataFrame(rows, "x string, y string").selectExpr(f"{linededup._within(0.85)} as got", f"{plain} as want")
    assert found.where("got <> want").isEmpty() and found.where("want").count() > 100


def test_language_scores_are_calibrated_on_all_training_rows(spark):
    r = random.Random(5)
    words = {"xx": "ba ke ti lo mu nga".split(), "yy": "ba ke sch ost upf ti".split()}
    rows = [(k, "".join(r.choice(words[l]) + r.choice(["", " "]) for _ in range(r.choice([2, 3, 12]))) + "b", l) for k, l in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    own = docs.select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()

    def counted(some):
        out = {}
        for l in words:
            keys, n = np.unique(np.concatenate([langid.ngrams(langid.symbols(x["text"])) for x in some if x["lang"] == l]).astype(np.int64), return_counts=True)
            out[l] = keys, n
        return langid.Model(out)

    halves = [counted([x for x in own if x["half"] != k]) for k in (0, 1)]
    z, true = [], []
    for x in own:
        h, n = halves[x["half"]].entropies(x["text"])
        z.append(np.sqrt(n) * (h - h.min()))
        true.append(["xx", "yy"].index(x["lang"]))
    z, true = np.array(z), np.array(true)
    loss = [(np.log(np.exp(-t * z).sum(axis=1)) + t * z[np.arange(len(z)), true]).sum() for t in langid.TEMPERATURES]
    assert model.temperature == langid.TEMPERATURES[int(np.argmin(loss))]
    score, right = 1 / np.exp(-model.temperature * z).sum(axis=1), z.argmin(axis=1) == true
    cuts = [c / langid.BINS for c in range(langid.BINS + 1) if (score >= c / langid.BINS).any() and right[score >= c / langid.BINS].mean() >= langid.PRECISION]
    assert model.least == (min(cuts) if cuts else 1.0)


def test_a_teaser_article_beside_the_main_text_is_not_the_page():
    body = [f"Sentence {k} of the main text, " + "which goes on for a while " * 8 + "and ends." for k in range(6)]
    page = "<body><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div><div></div><article><p>A short card.</p></article></body>"
    assert htmltext.main_text(page).split("\n")[:6] == body
