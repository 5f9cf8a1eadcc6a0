"""Quality by the perplexity of a modified Kneser-Ney word model that is trained on trusted text.

Trusted documents are those with a label of good quality and none of toxicity. One part of them
trains a model per language, the other sets the language's threshold: a quantile of perplexity.

The model is a bigram model of all words (``kneser_ney``): however rare a word of the trusted text is, it has
its own probability and its own contexts. Words, bigrams and their counts lie in shards, by a hash.

``learn`` and ``perplexities`` are a coarser model, of classes, which tasks can hold; queries don't use it. A
word that makes up at least ``SHARE`` of its language's trusted words is a class of its own. All other words are
one class: they share its contexts, and each has its own probability within it, from its own count.

Results: a document without words has no perplexity and is kept, as is one whose language has no
trusted text, since nothing speaks against it. A null language is a language of its own. Labels of
an id that disagree count as not trusted. Rows that repeat an id are scored each. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks, kneser_ney, sharded
from fleetpulse.llm.kneser_ney import TRAIN, by_language, discounts, shard_of, word_keys
from fleetpulse.llm.staging import lookup, partitions, sized_batches, staged

SHARE, QUANTILE = 1 / 20_000, 0.995
#: Classes of length, each four times as long as the one before, and the texts that a class needs for a quantile of its own.
LENGTHS, ALIKE = 6, 100
#: Every so many trusted documents one is held out of the training and sets the thresholds.
HELD_OUT = 5
CALIBRATE = 2
SLICE = 6 << 20


@dataclass
class Model:
    """What tasks hold of a model: vocabularies, and per word id its unigram probability and its sums as a context.

    Ids of a language are ``first[lang] ..``: the class of other words, the text's begin and end, then the vocabulary.
    """

    words: dict[str, dict[bytes, int]]
    first: dict[str, int]
    lang_of: np.ndarray
    others: np.ndarray
    unigram: np.ndarray
    total: np.ndarray
    weight: np.ndarray
    discounts: np.ndarray
    #: By language, of the words of the class: how many tokens and different words it has, and what is taken off a count.
    rare: dict[str, tuple[int, int, float]] = field(default_factory=dict)

    def unseen(self, lang: str) -> float:
        """Log probability, within the class, of the words that the trusted text lacks."""
        n, kinds, d = self.rare[lang]
        return float(np.log(d * kinds / n / (kinds + 1))) if kinds else 0.0

    def within(self, lang: str, counts: np.ndarray) -> np.ndarray:
        """Log probability, within the class, of words of these counts, above that of an unseen word."""
        n, _, d = self.rare[lang]
        return np.log((counts - d) / n + np.exp(self.unseen(lang))) - self.unseen(lang)

    def ids_of(self, lang: str, words: list[bytes]) -> np.ndarray:
        own, other = self.words[lang], self.first[lang]
        return np.fromiter((own.get(w, other) for w in words), np.int64, len(words))

    def log_probability(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of the bigrams, given how often each was seen."""
        before, word = keys >> 32, keys & 0xFFFFFFFF
        d = self.discounts[self.lang_of[before], np.minimum(counts, 3)]
        seen = np.maximum(counts - d, 0) / np.maximum(self.total[before], 1)
        return np.log(seen + self.weight[before] * self.unigram[word])


def roles(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, lang, role, text`` of every document; the role is 0 where it isn't trusted."""
    good = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0").select("id", F.lit(True).alias("good"))
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    good = lookup(staged(good, "trusted"))
    # of copies only one is learned from: the least id of a trusted text
    first = rows.join(good, "id", "left_semi").groupBy("lang", F.xxhash64("text").alias("h"), F.octet_length("text")).agg(F.min("id").alias("id"))
    first = lookup(staged(first.select("id").distinct().withColumn("good", F.lit(True)), "learned"))
    held = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(HELD_OUT)) == 0
    role = F.when(~F.coalesce("good", F.lit(False)), F.lit(0)).when(held, F.lit(CALIBRATE)).otherwise(F.lit(TRAIN))
    return rows.join(first, "id", "left").select("id", "lang", role.alias("role"), "text")


def _bigrams(ids: np.ndarray, bounds: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of each text that has words, begin and end included, and the text of each."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), np.where(sizes > 0, sizes + 1, 0))
    last = np.flatnonzero(np.diff(text, append=-1))
    start = np.flatnonzero(np.diff(text, prepend=-1))
    before, after = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[start] = False
    before[start], before[inner] = first + 1, ids[np.flatnonzero(inner) - text_rank(text)[inner]]
    inner = np.ones(len(text), bool)
    inner[last] = False
    after[last], after[inner] = first + 2, ids
    return before << 32 | after, text


def text_rank(text: np.ndarray) -> np.ndarray:
    """One more than how many different texts stand before each place."""
    return np.cumsum(np.diff(text, prepend=-1) != 0)


def train(rows: DataFrame, share: float = SHARE) -> tuple[Model, DataFrame]:
    """The model of the training rows: what tasks hold, and the table ``key, n`` of bigram counts."""
    return learn(rows, share)[:2]


def learn(rows: DataFrame, share: float = SHARE) -> tuple[Model, DataFrame, DataFrame]:
    """What ``train`` gives, and the table ``lang, word, n`` of the words that are no class of their own."""
    spark = rows.sparkSession
    training = rows.where(F.col("role") == TRAIN)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks.slices(batches, most=SLICE):
            for lang, _, words, codes, _ in by_language(part):
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    counted = training.mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted, "words")
    # each language by its own total: beside a large one a small one keeps its words
    totals = staged(counted.groupBy("lang").agg((share * F.sum("n")).alias("least")), "totals")
    counted = counted.join(lookup(totals), "lang")
    least = F.greatest(F.lit(2.0), "least")
    frequent = counted.where(F.col("n") >= least).select("lang", "word").orderBy("lang", "word").collect()
    rest = counted.where(F.col("n") < least).select("lang", "word", "n")
    sums = counted.withColumn("n", F.when(F.col("n") < least, F.col("n"))).groupBy("lang").agg(
        F.count("n").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
    others = {r["lang"]: r["kinds"] for r in sums}
    rare = {r["lang"]: (r["n"], r["kinds"], float(discounts(r["ones"], r["twos"], 0, 0)[1])) for r in sums}
    words: dict[str, dict[bytes, int]] = {lang: {} for lang in sorted(others)}
    for r in frequent:
        words[r["lang"]][bytes(r["word"])] = 0
    first, at, lang_of = {}, 0, []
    for k, (lang, own) in enumerate(words.items()):
        first[lang] = at
        for i, w in enumerate(own):
            own[w] = at + 3 + i
        at += 3 + len(own)
        lang_of += [k] * (3 + len(own))
    classes = np.log(np.maximum(np.array([others[lang] for lang in words], float), 1))
    model = Model(words, first, np.array(lang_of, np.int64), classes, np.zeros(at), np.zeros(at), np.zeros(at), np.zeros((len(words), 4)), rare)
    shared = spark.sparkContext.broadcast(model)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in chunks.slices(batches, most=SLICE):
            for lang, _, words, codes, bounds in by_language(part):
                keys, _ = _bigrams(own.ids_of(lang, words)[codes], bounds, own.first[lang])
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["key", "n"])

    bigrams = training.mapInArrow(count_bigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bigrams = staged(bigrams, "bigrams")
    _smooth(model, bigrams)
    shared.unpersist()
    return model, bigrams, rest


def _smooth(model: Model, bigrams: DataFrame) -> None:
    """Sets discounts, context sums and unigram probabilities, from sums over the bigram counts for each word."""
    seen = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    contexts = bigrams.groupBy(F.shiftright("key", 32).alias("i")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), *seen).toPandas()
    continued = bigrams.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("i")).agg(F.count("*").alias("n")).toPandas()
    kinds = np.zeros(len(model.lang_of))
    kinds[continued["i"]] = continued["n"]
    where = contexts["i"].to_numpy(np.int64)
    for k in range(len(model.first)):
        own = contexts[model.lang_of[where] == k]
        d = model.discounts[k] = discounts(*(int(own[f"n{j}"].sum()) for j in (1, 2, 3, 4)))
        i = own["i"].to_numpy(np.int64)
        model.total[i] = own["n"]
        rest = own["kinds"] - own["n1"] - own["n2"]
        model.weight[i] = (d[1] * own["n1"] + d[2] * own["n2"] + d[3] * rest) / own["n"]
        # unigrams: in how many contexts a word was seen, smoothed alike and mixed with equal shares
        ids = np.flatnonzero(model.lang_of == k)
        c = kinds[ids]
        u = discounts(*(int((c == j).sum()) for j in (1, 2, 3, 4)))
        spent = u[np.minimum(c, 3).astype(int)]
        possible = len(ids) - 1  # a text's begin never follows
        if c.sum():
            model.unigram[ids] = (c - spent + spent.sum() / possible) / c.sum()
        else:
            model.unigram[ids] = 1 / possible
    # a context that was never seen says nothing
    model.weight[model.total == 0] = 1


def perplexities(rows: DataFrame, model: Model, bigrams: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``id, lang, role, n_words, perplexity`` of every row.

    ``rare`` counts the words that are no class of their own; without it they share their class's probability evenly.
    """
    spark = rows.sparkSession
    shards = partitions(spark)
    shared = spark.sparkContext.broadcast(model)
    even = rare is None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = shared.value, sharded.slice_name()
        for part in chunks.slices(batches, most=SLICE):
            keys, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            n_words, other = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            known = np.zeros(part.num_rows, bool)
            for lang, at, words, codes, bounds in by_language(part):
                n_words[at] = np.diff(bounds)
                if lang not in own.first:
                    continue
                known[at] = True
                ids = own.ids_of(lang, words)[codes]
                mine, text = _bigrams(ids, bounds, own.first[lang])
                of, common = np.repeat(np.arange(len(at)), np.diff(bounds)), ids != own.first[lang]
                other[at] = np.bincount(of, ~common, len(at)) * (own.others[own.lang_of[own.first[lang]]] if even else -own.unseen(lang))
                keys.append(mine)
                texts.append(at[text])
                if not even:
                    codes = codes[~common]
                    kinds, codes = np.unique(codes, return_inverse=True)
                    keys.append(word_keys(lang, [words[k] for k in kinds])[codes])
                    texts.append(at[of[~common]])
            carried = pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("lang"), part.column("role"), pa.array(n_words), pa.array(other), pa.array(known)],
                ["id", "lang", "role", "n_words", "other", "known"],
            )
            distinct, codes = np.unique(np.concatenate(keys), return_inverse=True)
            yield sharded.frames(name(), carried, np.concatenate(texts), codes, distinct, shard_of(distinct, shards), shards)

    def packed_by(items: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]):
        def split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for keys, n in items(b):
                    shard = shard_of(keys, shards)
                    numbers = np.unique(shard)
                    bodies = [sharded.pack((keys[shard == s], n[shard == s])) for s in numbers]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([""] * len(numbers), pa.string()), pa.array([-1] * len(numbers), pa.int32()), pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary())],
                        ["slice", "kind", "shard", "body"],
                    )

        return split_counts

    def bigram_counts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield b.column("key").to_numpy(), b.column("n").to_numpy().astype(float)

    def rare_words(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names = np.array(b.column("lang").to_pylist(), object)
        for lang in sorted(set(names.tolist())):
            at = pa.array(np.flatnonzero(names == lang))
            yield word_keys(lang, b.column("word").take(at).to_pylist()), shared.value.within(lang, b.column("n").take(at).to_numpy())

    def values(part: list):
        """Of bigrams from their counts; what words are worth comes with them."""
        keys = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in part)])
        n = np.concatenate([np.zeros(0), *(p[1] for p in part)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]

        def value(wanted: np.ndarray) -> np.ndarray:
            found = np.zeros(len(wanted))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = np.where(keys[at] == wanted, n[at], 0.0)
            pairs = wanted >= 0
            found[pairs] = shared.value.log_probability(wanted[pairs], found[pairs].astype(np.int64))
            return found

        return value

    def finish(carried: pa.RecordBatch, total: np.ndarray) -> pa.RecordBatch:
        n_words = carried.column("n_words").to_numpy()
        known = np.asarray(carried.column("known")) & (n_words > 0)
        each = (carried.column("other").to_numpy() - total) / (n_words + 1)
        perplexity = pa.array(np.exp(np.minimum(each, 700)), mask=~known)
        return pa.RecordBatch.from_arrays([*(carried.column(c) for c in ("id", "lang", "role", "n_words")), perplexity], ["id", "lang", "role", "n_words", "perplexity"])

    packed = rows.mapInArrow(split, sharded.FRAME).unionByName(bigrams.mapInArrow(packed_by(bigram_counts), sharded.FRAME))
    if rare is not None:
        packed = packed.unionByName(rare.mapInArrow(packed_by(rare_words), sharded.FRAME))
    return sharded.totals(sharded.valued_by(packed, shards, values), "id long, lang string, role int, n_words long, perplexity double", finish)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE
) -> DataFrame:
    """``id, lang, n_words, perplexity, threshold, kept`` of every row of ``docs``."""
    sized_batches(docs.sparkSession)
    rows = roles(docs, labels, id_col, text_col, lang_col)
    scored = kneser_ney.perplexities(rows)
    # short texts vary more: the quantiles are those of a language's texts of like length, or of all its texts
    length = F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1))) / 2), F.lit(LENGTHS - 1)).cast("int")
    scored = scored.withColumn("length", length)
    judged = scored.where(f"role = {CALIBRATE} and perplexity is not null")
    bar = F.percentile_approx("perplexity", quantile, 10_000)
    alike = judged.groupBy("lang", "length").agg(bar.alias("alike"), F.count("*").alias("n")).where(F.col("n") >= ALIKE)
    bars = judged.groupBy("lang").agg(bar.alias("any"))
    classes = bars.select("lang", "any", F.explode(F.sequence(F.lit(0), F.lit(LENGTHS - 1))).alias("length")).join(alike, ["lang", "length"], "left")
    classes = staged(classes.select("lang", "length", F.coalesce("alike", "any").alias("threshold")), "thresholds")
    found = scored.join(lookup(classes), ["lang", "length"], "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return found.select("id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "n_words", "perplexity", "threshold", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with. An id goes if all its rows are rejected."""
    found = classify(docs, labels, id_col, text_col, lang_col)
    gone = found.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    gone = lookup(staged(gone.select(F.col("id").alias("__gone")), "rejected"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti").select(*docs.columns)
