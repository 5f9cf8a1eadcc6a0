"""Corpus operators against brute force, exact round trips and the libraries that they must equal."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import ann, byte_bpe, chunks, exact_dedup, language, mixing, near_dedup, quality, records, sharded, tokens, warc
from fleetpulse.llm.components import components
from fleetpulse.llm.vocabularies import pattern, place

PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "中", "’s", "'s", "'ll", "1", "23", ".", "...", "!?", " ", "　", "<|endoftext|>", "<s>", "😀", " \n", "\r\n", "▁", "Zz", "\x00"]


def random_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 60))) for _ in range(n)]
    return [*texts, None, "", " ", " " * 50, "a" * 500, "\n" * 7 + " a", "word " * 4000, "the same", "the same"]


@pytest.fixture(scope="module")
def texts(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 7 == 0 else f"l{i % 2}", None if i % 5 == 0 else f"s{i % 3}", i, f"x{i}") for i, t in enumerate(random_texts(400))]
    rows += [(None, "no id", None, None, 1, "x"), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long, __key string").repartition(5)


@pytest.fixture(scope="module")
def empty(texts):
    return texts.limit(0)


def by_id(df, key="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def text_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_chunks_cover_the_texts():
    some = [t or "" for t in random_texts(200)]
    cut = chunks.cut(pa.array(some), stops=True)
    assert ["".join(cut.distinct[c] for c in cut.codes[a:b]) for a, b in zip(cut.bounds[:-1], cut.bounds[1:], strict=True)] == some


def test_byte_pairs_equal_the_merges_and_decode(texts, empty):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=byte_bpe.read_ranks(place(byte_bpe.RANKS)), special_tokens={})
    want = text_of(texts)
    found = by_id(byte_bpe.round_trip(texts))
    for doc, text in want.items():
        ids = library.encode_ordinary(text)
        for r in found[doc]:
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    coded = byte_bpe.encode(texts.select("doc_id", "text"))
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decode(coded.select("doc_id", "ids")).collect()}
    assert back == want
    assert byte_bpe.round_trip(empty).count() == 0


def test_token_counts_equal_the_library(texts, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=place(tokens.MODEL))
    found = by_id(tokens.count_tokens(texts, limit=30))
    for doc, text in text_of(texts).items():
        for r in found[doc]:
            n = len(library.encode(text))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 30)
    assert len(found[408]) == 3
    assert tokens.count_tokens(empty).count() == 0


def test_records_give_back_the_ids(texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(place(records.VOCABULARY))
    manifest = records.write_records(texts)
    found = sorted(records.read_records(manifest).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in found] == sorted([r["id"] for r in found], key=lambda i: (i is None, i))
    start, want = 0, text_of(texts)
    for r in found:
        ids = np.array([*library.encode(want[r["id"]], add_special_tokens=False).ids, records.END], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    file = manifest.first()
    shuffled = [records.document_of(p)[0] for p in records.read_payloads(file["path"], file["index"], np.array([1, 0]))]
    assert shuffled == [records.document_of(p)[0] for p in records.read_payloads(file["path"], file["index"])][1::-1]
    assert records.read_records(records.write_records(empty)).count() == 0


def test_damaged_records_are_noticed(tmp_path):
    frame = bytearray(records.framed(1, np.array([1, 70_000])))
    (tmp_path / "i").write_bytes(np.zeros(1, np.uint64).tobytes())
    frame[14] ^= 1
    (tmp_path / "r").write_bytes(frame)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_payloads(str(tmp_path / "r"), str(tmp_path / "i")))


def test_archives_give_back_the_pages(spark):
    long_ = "<html>" + "page " * 40
    rows = [(i, f"http://h/{i}", long_ + str(i % 9)) for i in range(300)] + [(300, None, None), (301, "u\r\nx", ""), (302, "u", "short"), (303, "u", "short"), (None, "u", long_ + "1")]
    rows += [(304, "u", "y" * 3_000_000)]
    found = by_id(warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), files=3)), "page_id")
    for page, _, html in rows:
        data = (html or "").encode()
        (r,) = found[page]
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        revisit = len(data) >= 100 and first != page
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_a_dictionary_leads_the_archive():
    import io
    import struct

    out = io.BytesIO()
    writer = warc.Writer(out)
    for i in range(3000):
        writer.add(warc.record(i, "u", f"<p>{i} some words that come again {i * 7}</p>" * 3, "d", None))
    writer.end()
    assert struct.unpack("<I", out.getvalue()[:4])[0] == warc.MAGIC


def test_exact_copies(texts, empty):
    import re

    rows = exact_dedup.mark_copies(texts, digest="sha").collect()
    norm = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in texts.collect()]
    groups = {}
    for doc, text in norm:
        groups.setdefault(text, []).append(doc)
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        keep = min((d for d in groups[text] if d is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[text]), r["doc_id"] == keep)
        assert r["sha"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == len(norm)
    assert exact_dedup.keep_one(texts).columns == texts.columns
    assert exact_dedup.mark_copies(empty).count() == 0


def test_mixture_meets_targets(spark, texts, empty):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("b"), F.col("id") % 4)).alias("source"),
    )
    rows = mixing.usage(docs, shards=7).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    key = rows.merge(docs.select(F.col("doc_id").alias("id"), "source").toPandas(), on="id")
    sums = key.groupby("source", dropna=False).agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index(na_position="last")
    assert (sums["size"] == sums["given"]).all()
    want, open_ = np.zeros(len(sums)), np.ones(len(sums), bool)
    w, cap = np.array([(3, 1, 2)[k % 3] for k in range(len(sums))], float), 2.0 * sums["size"].to_numpy()
    while True:
        want[open_] = (1.5 * sums["size"].sum() - cap[~open_].sum()) * w[open_] / w[open_].sum()
        want[~open_] = cap[~open_]
        if not (want > cap + 1e-9).any():
            break
        open_ &= want <= cap
    assert np.allclose(sums["target"], want)
    assert (abs(sums["taken"] - sums["target"]) <= 32).all()
    again = mixing.usage(docs.repartition(11), shards=7).toPandas()
    assert rows.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    mixed = mixing.mix(docs, shards=7)
    assert mixed.columns == docs.columns
    assert mixed.count() == rows["copies"].sum()
    assert mixing.mix(texts).columns == texts.columns
    assert mixing.usage(texts).count() == texts.count()
    assert mixing.usage(empty).count() == 0


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 0, 50), ("b", 0, 7), ("c", 1, 3)], "key string, group long, quota long")
    rows = mixing.split_quotas(quotas, 6, 1).toPandas()
    assert rows.groupby("key")["count"].sum().to_dict() == {"a": 50, "b": 7, "c": 3}
    assert rows[rows["key"] != "c"].groupby("shard")["count"].sum().between(9, 10).all()


def components_by_force(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in docs}


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.mark.parametrize("small", [256, 16])
def test_near_copies(spark, monkeypatch, small):
    """Small nodes make every level, block and anchor of the trees run."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = np.random.default_rng(5)
    base = [[f"W{rng.integers(1e6)}" for _ in range(rng.integers(30, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(base[0] if i % 3 == 0 else base[i % 12])  # one group has a third of the rows
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = f"n{rng.integers(1e6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, f"other {i} " + " ".join(f"z{rng.integers(1e6)}" for _ in range(20)) + " " + " ".join(base[1][:25])) for i in range(260, 330)]
    rows += [(330, None), (331, ""), (332, "two words"), (333, "Two  WORDS"), (334, "É two"), (335, "é two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows}
    want = components_by_force(sets)
    found = near_dedup.near_components(docs).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {d: (len(sets[d]), c, c == d) for d, c in want.items()}
    assert near_dedup.keep_one(docs).count() == len(set(want.values()))


def test_a_small_language_keeps_its_words(spark):
    """One hundredth of all words: the vocabulary is cut by the language's own total."""
    rows = [(i, "big", 1, " ".join(f"b{k % 20}" for k in range(99))) for i in range(100)] + [(100 + i, "small", 1, " ".join(f"s{k}" for k in range(10))) for i in range(10)]
    model, _ = quality.train(spark.createDataFrame(rows, "id long, lang string, role int, text string"), share=1 / 100)
    assert set(model.words["small"]) == {f"s{k}".encode() for k in range(10)}
    assert len(model.words["big"]) == 20


def test_near_copies_among_documents_of_one_template(spark):
    """Thousands of documents share most shingles and are not linked; the copies planted among them are."""
    rng = np.random.default_rng(8)
    template = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join([*template, *(f"w{rng.integers(1e9)}" for _ in range(18))])) for i in range(3000)]
    want = {i: i for i in range(3000)}
    for k in range(300):
        i, words = 3000 + k, rows[7 * k][1].split()
        rows.append((i, " ".join([*words[:-9], *(f"c{rng.integers(1e9)}" for _ in range(9))])))
        want[i] = 7 * k
    sets = {d: shingles(t) for d, t in rows}
    assert all(len(sets[3000 + k] & sets[7 * k]) >= 0.75 * len(sets[3000 + k] | sets[7 * k]) for k in range(300))
    assert len(sets[1] & sets[2]) < 0.72 * len(sets[1] | sets[2])
    found = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in found} == want


def test_near_copies_of_odd_rows(texts, empty):
    assert near_dedup.near_components(texts).count() == texts.count()
    assert near_dedup.keep_one(texts).columns == texts.columns
    assert near_dedup.near_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    x = (centres[rng.integers(30, size=3000)] + 0.3 * rng.normal(size=(3000, 12))) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100]  # a vector that many rows repeat
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3001, [0.0] * 12), (3002, [float("nan")] * 12), (3003, [None] * 12), (3004, [float("inf")] * 12), (3005, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.neighbours(table.where("vec_id % 20 = 0"), table, 20).toPandas()
    hit = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        score = np.array([sum(a * b for a, b in zip(x[q], v, strict=True)) for v in x])
        assert np.allclose(score[own["vec_id"]], own["score"], rtol=1e-12)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        hit += len(set(best) & set(own["vec_id"]))
    assert found["query_id"].nunique() == 150
    assert hit / 3000 >= 0.9
    few = ann.neighbours(table.where("vec_id = 0"), table.where("vec_id < 5"), 20)
    assert few.count() == 4
    assert ann.neighbours(table, table.limit(0)).count() == 0


def test_neighbours_in_many_lists(spark, monkeypatch):
    """Vectors without structure in 500 lists: the reach must follow the data; repeated rows must not fill the places."""
    monkeypatch.setattr(ann, "PER_LIST", 60)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30_000, 48))
    x *= (1 + 0.1 * rng.normal(size=(len(x), 1))) / np.sqrt((x**2).sum(axis=1, keepdims=True))
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "list": 1, "block": "b"})
    frame = pd.concat([frame, *[frame[frame["vec_id"] % 100 == 1]] * 30], ignore_index=True)
    table = spark.createDataFrame(frame).repartition(16)
    found = ann.neighbours(table.where("vec_id % 100 = 0"), table).toPandas()
    counts = found.groupby("query_id")["vec_id"].agg(["size", "nunique"])
    assert len(counts) == 300 and (counts == 20).all(axis=None)
    hit = 0
    for q, own in found.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(own["vec_id"]))
    assert hit / 6000 >= 0.95


def test_clashing_names_keep_their_values(spark):
    """Columns named like those that operators add or use inside come back with their own values."""
    names = ["kept", "keep_id", "group_size", "__text", "__length", "__prefix", "__full", "__size", "__keep", "__gone", "id", "digest"]
    long = " ".join(f"word{i}" for i in range(40))
    docs = [(9, long), (2, long), (3, long + " end"), (4, "other words stand here alone now"), (5, None), (6, "")]
    table = spark.createDataFrame(
        [(d, t, *(f"{n}{d}" for n in names)) for d, t in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    )
    for kept, ids in ((exact_dedup.keep_one(table), {2, 3, 4, 5}), (near_dedup.keep_one(table), {2, 4, 5, 6})):
        assert kept.columns == table.columns
        rows = kept.collect()
        assert {r["doc_id"] for r in rows} == ids
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    marked = exact_dedup.mark_copies(table, digest="__text").collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in marked}[9] == (2, False)
    assert all(r["__size"] == f"__size{r['doc_id']}" and len(r["__text"]) == 64 for r in marked)
    predicted = language.predict(table, language.learn(table.withColumn("lang", F.lit("en")))).collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in predicted for n in names)


def test_language_forward_sums_all_segmentations():
    path = place(language.MODEL)
    table, n, _ = language.pieces(path)
    rng = np.random.default_rng(1)
    p = rng.uniform(size=(n + 2, 2))
    p /= p.sum(axis=0)
    p[n + 1] = 0

    def force(text, k):
        if not text:
            return 1.0
        total = 0.0
        for end in range(1, len(text) + 1):
            i = table.get(text[:end], -1)
            i = n if i < 0 and end == 1 else i
            total += p[i, k] * force(text[end:], k) if i >= 0 else 0
        return total

    words = [" the", " à", "\ning", " \x01x", "中", " abcdefghij"]
    want = np.log([[force(language.plain(w), k) for k in (0, 1)] for w in words])
    assert np.allclose(language.log_likelihoods(path, words, p), want)
    long_ = " thing" * 9
    assert np.allclose(language._long(path, long_, p), language.log_likelihoods(path, [long_], p)[0])


def test_languages_are_told_apart(spark, texts, empty):
    rng = np.random.default_rng(4)
    syllables = {"en": ["th", "ing", "er", "the", "ou"], "fr": ["é", "eau", "ou", "le", "què"]}
    rows = [(i, " ".join("".join(rng.choice(s, 3)) for _ in range(12)), lang) for i in range(300) for lang, s in syllables.items()]
    docs = spark.createDataFrame([*rows, (1, None, "en"), (2, "12 !?", "fr"), (3, "thing", None)], "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["en", "fr"]
    found = language.predict(docs.where("doc_id % 2 = 1"), model).toPandas()
    known = found.dropna(subset=["lang"])
    assert (known["lang_pred"] == known["lang"]).mean() > 0.99
    assert found["score"].between(0, 1).all()
    odd = language.predict(docs.where("text is null or text = '12 !?'"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in odd} == {("und", 0.0)}
    assert language.predict(texts, language.learn(empty)).where("lang_pred != 'und'").count() == 0


def test_perplexity_equals_the_formula(spark):
    """The sharded sums against a direct computation over the same counts."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, "en", 1, " ".join(rng.choice(words, 20, p=np.arange(1, 31)[::-1] / 465))) for i in range(200)]
    rows += [(900, "en", 0, "w1 w2 unseen"), (901, "en", 0, ""), (902, "xx", 0, "w1")]
    docs = spark.createDataFrame(rows, "id long, lang string, role int, text string")
    model, bigrams = quality.train(docs, share=1 / 200)
    counts = {r["key"]: r["n"] for r in bigrams.collect()}
    found = {r["id"]: r for r in quality.perplexities(docs, model, bigrams).collect()}
    first = model.first["en"]
    for doc in (0, 7, 900):
        text = next(t for i, _, _, t in rows if i == doc).encode().split()
        ids = [first + 1, *model.ids_of("en", text), first + 2]
        total = -model.others[0] * sum(i == first for i in ids)
        for a, b in zip(ids, ids[1:], strict=False):
            c = counts.get(a << 32 | b, 0)
            d = model.discounts[0, min(c, 3)]
            total += np.log(max(c - d, 0) / model.total[a] + model.weight[a] * model.unigram[b])
        assert np.isclose(np.log(found[doc]["perplexity"]), -total / (len(text) + 1))
    assert found[901]["perplexity"] is None and found[902]["perplexity"] is None
    # after every context the probabilities of all words add up to one
    ids = np.flatnonzero(model.lang_of == 0)
    for a in (first + 1, first + 5):
        keys = np.array([a << 32 | b for b in ids if b != first + 1])
        p = np.exp(model.log_probability(keys, np.array([counts.get(int(k), 0) for k in keys])))
        assert np.isclose(p.sum(), 1)


def test_quality_keeps_clean_text(spark, texts, empty):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(words, 40)), "en") for i in range(600)] + [(1000 + i, " ".join(f"Q{rng.integers(1e7)}!!" for _ in range(40)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 500 or doc_id >= 1010").select("doc_id", F.when(F.col("doc_id") < 500, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    found = quality.classify(docs, labels).toPandas().set_index("id")["kept"]
    assert found[found.index < 600].mean() > 0.97
    assert not found[found.index >= 1000].any()
    assert quality.keep_good(texts, labels).columns == texts.columns
    assert quality.classify(texts, labels).count() == texts.count()
    assert quality.classify(empty, labels).count() == 0


def test_every_rare_word_has_its_own_probability(spark):
    """Words that are no class of their own differ by their own counts, and all of the class add up to one."""
    rows = [(i, "en", 1, " ".join([*(f"w{k}" for k in range(20)), "twice" if i < 2 else f"r{i}", *["often"] * (i < 9)])) for i in range(60)]
    rows += [(900 + k, "en", 0, f"w1 {w} w2") for k, w in enumerate(["r5", "twice", "often", "unseen", "r6"])]
    docs = spark.createDataFrame(rows, "id long, lang string, role int, text string")
    model, bigrams, rare = quality.learn(docs, share=1 / 100)
    counts = {bytes(r["word"]).decode(): r["n"] for r in rare.collect()}
    assert counts == {"twice": 2, "often": 9} | {f"r{i}": 1 for i in range(2, 60)}
    found = {r["id"]: -np.log(r["perplexity"]) * 4 for r in quality.perplexities(docs, model, bigrams, rare).collect() if r["id"] >= 900}
    # the contexts are the same, so only the word's probability within the class differs
    tokens, d = sum(counts.values()), 58 / (58 + 2)
    d = min(max(1 - 2 * d * 1 / 58, 0.1), 0.9)
    unseen = d * len(counts) / tokens / (len(counts) + 1)
    p = {w: (n - d) / tokens + unseen for w, n in counts.items()}
    assert np.isclose(sum(p.values()) + unseen, 1)
    for k, w in enumerate(["r5", "twice", "often"]):
        assert np.isclose(found[900 + k] - found[903], np.log(p[w] / unseen))
    assert np.isclose(found[904], found[900])


@pytest.mark.parametrize("kind", ["numbers", "strings"])
def test_packed_rows_are_small_and_give_the_sums(kind):
    """Hashes and the texts that have them go to the shards in little more room than they need, and nothing of them is lost."""
    draw = np.random.default_rng(3)
    items = np.unique(np.concatenate([draw.integers(-(2**63), 2**63 - 1, 60_000), draw.integers(0, 2000, 20_000) << 32 | draw.integers(0, 9000, 20_000), [-(2**63), 2**63 - 1]]))
    text, item = draw.integers(0, 2000, 300_000), (len(items) * draw.random(300_000) ** 2).astype(np.int64)
    text[item % 1000 == 7] = 5  # one text has some items often, and others have none
    worth, shards = draw.normal(size=len(items)), 40
    shard = quality.shard_of(items, shards)
    carried = pa.RecordBatch.from_arrays([pa.array(np.arange(2001))], ["id"])
    names = items if kind == "numbers" else [f"chunk {k}" for k in items]
    number = {f"chunk {k}": i for i, k in enumerate(items)}
    rows = sharded.frames("0-1", carried, text, item, names, shard, shards).to_pylist()

    def value_of(wanted):
        at = np.searchsorted(items, wanted) if kind == "numbers" else np.array([number[w] for w in wanted])
        assert len(at) and (np.asarray(names)[at] == wanted).all()
        return worth[at]

    pairs, counts = np.unique(text * len(items) + item, return_counts=True)
    t, i = np.divmod(pairs, len(items))
    for r in rows[1:]:
        own = shard[i] == r["shard"]
        assert (sharded.unpack(sharded.sums_of(r["body"], value_of)) == np.bincount(t[own], (worth[i] * counts)[own], 2001)).all()
    if kind == "numbers":
        assert sum(len(r["body"]) for r in rows) < 7 * len(items) + 1.7 * len(pairs)
