"""Perplexities against Kneser-Ney computed from the texts alone."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import kneser_ney, quality


def by_force(rows):
    """Perplexity of every row of id, language, role and text; words, however rare, have contexts of their own."""

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5, 0.1), k - 0.1) for k in (1, 2, 3)]

    pairs = defaultdict(Counter)
    for _, lang, role, text in rows:
        words = text.split()
        if role == 1 and words:
            pairs[lang].update(zip([0, *words], [*words, 1], strict=True))
    out = {}
    for i, lang, _, text in rows:
        words, seen = text.split(), pairs[lang]
        out[i] = None
        if not words or not seen:
            continue
        total, begun, follows = Counter(), defaultdict(list), Counter()
        for (a, b), n in seen.items():
            total[a] += n
            begun[a].append(n)
            follows[b] += 1
        d, u = discounts(seen.values()), discounts(follows.values())
        spent, every = sum(u[min(n, 3)] for n in follows.values()), sum(follows.values())
        log = 0.0
        for a, b in zip([0, *words], [*words, 1], strict=True):
            unigram = (follows[b] - u[min(follows[b], 3)] + spent / (len(follows) + 1)) / every
            weight = sum(d[min(n, 3)] for n in begun[a]) / total[a] if total[a] else 1
            n = seen[a, b]
            log += np.log(max(n - d[min(n, 3)], 0) / max(total[a], 1) + weight * unigram)
        out[i] = np.exp(-log / (len(words) + 1))
    return out


def texts_of(draw, n):
    """Texts of Zipf's words: most of the words are in them once or twice."""
    return [" ".join(f"w{min(int(draw.pareto(0.7) * 3), 900)}" for _ in range(draw.integers(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("size", [8 << 20, 600])
def test_all_words_have_contexts_of_their_own(spark, monkeypatch, size):
    """Also where texts are dealt over many slices; null ids, empty texts and a language without texts to learn from are rows."""
    monkeypatch.setattr(kneser_ney, "SLICE", size)
    draw = np.random.default_rng(6)
    rows = [(i, ("en", "fr", "")[i % 3], (0, 1, 1, 2)[i % 4], t) for i, t in enumerate(texts_of(draw, 240))]
    rows += [(900, "en", 0, "w1 w2 unseen"), (901, "en", 0, ""), (902, "xx", 0, "w1"), (None, "en", 0, "w1  w1\nw2"), (904, "yy", 1, "")]
    docs = spark.createDataFrame(rows, "id long, lang string, role int, text string").repartition(3)
    found = {r["id"]: r for r in kneser_ney.perplexities(docs).collect()}
    want = by_force(rows)
    assert len(found) == len(rows) and sum(p is None for p in want.values()) > 2
    for i, lang, role, text in rows:
        r = found[i]
        assert (r["lang"], r["role"], r["n_words"], r["perplexity"] is None) == (lang, role, len(text.split()), want[i] is None)
        assert want[i] is None or np.isclose(np.log(r["perplexity"]), np.log(want[i]), rtol=1e-9)
    assert kneser_ney.perplexities(docs.limit(0)).count() == 0


def test_quality_scores_with_the_contexts_of_rare_words(spark):
    """A word that is in the trusted text once tells what follows it."""
    draw = np.random.default_rng(7)
    rows = [(i, f"r{i} s{i} {t}") for i, t in enumerate(texts_of(draw, 200))] + [(1000, "r3 s3"), (1001, "r3 s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = docs.where("doc_id < 150").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = {r["id"]: r["perplexity"] for r in quality.classify(docs, labels).collect()}
    role = {i: 0 if i >= 150 else 2 if zlib.crc32(str(i).encode()) % 5 == 0 else 1 for i, _ in rows}
    want = by_force([(i, "en", role[i], t) for i, t in rows])
    assert role[3] == role[4] == 1 and found[1000] < found[1001]
    assert all(np.isclose(np.log(found[i]), np.log(want[i])) for i, _ in rows)
