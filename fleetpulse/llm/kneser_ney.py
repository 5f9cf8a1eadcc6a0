"""Perplexity under a modified Kneser-Ney bigram model of all words: each has contexts of its own, however rare it is.

The vocabulary of a language are all words of its training texts, and a text's begin and end. No task
and not the driver holds it or the bigrams; both lie in shards by a hash.

1. Texts are cut into slices, one file each: the tokens, numbered within the slice. A slice sends its
   distinct words, with how often they are trained on, to the words' shards.
2. A shard of words adds up the counts, numbers the words that were trained on and answers each slice with
   the numbers of its words. Frequent words have small numbers, so that pairs of them take little room.
3. A slice sends its distinct pairs of numbers, with how often they are trained on, to the pairs' shards. A
   pair with a word that wasn't trained on was never seen and isn't sent.
4. A shard of pairs adds up the counts, answers each slice with them, and tells the words' shards how many
   different pairs each word begins, by count, and how many it ends.
5. A shard of words adds these up and answers each slice; the sums by language give the discounts.
6. A slice has the probability of every pair from the answers, and adds up the logarithms of each text.

A word or pair is in a slice's message once, so frequent ones make no key hot; pairs of a frequent first word
are spread over all shards. Messages are as many as slices times shards. What several steps read is
written, so that a repeated task sends what the first one did, and is removed when the result is.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks
from fleetpulse.llm.files import opened, removed, written
from fleetpulse.llm.sharded import pack, spread, squeeze, unpack
from fleetpulse.llm.staging import kept_at, partitions, shared_folder, staged

#: Role of the rows that are learned from.
TRAIN = 1
#: Bytes of text in a slice.
SLICE = 8 << 20
#: Of each shard of words so many frequent ones have their pairs in all shards.
FREQUENT = 64
#: No word has a blank, so these are none.
BEGIN, END = b" begin", b" end"
_MESSAGE = "slice string, kind int, shard int, body binary"
_LISTED, _WORDS, _TRAINED, _NUMBERS, _COUNTS, _CONTEXTS, _SUMS, _LANGUAGES = range(8)
_RESULT = "id long, lang string, role int, n_words long, perplexity double"


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """The discounts of values seen 0, 1, 2 and 3 times or more, from how many values were seen 1 to 4 times."""
    y = ones / (ones + 2 * twos) if ones + 2 * twos else 0.5
    found = [k - (k + 1) * y * (b / a) if a else k * 0.5 for k, (a, b) in enumerate(((ones, twos), (twos, threes), (threes, fours)), 1)]
    return np.array([0.0, *(min(max(d, 0.1), k - 0.1) for k, d in enumerate(found, 1))])


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """Negative numbers, 63 bits of a hash for each word of a language."""
    name = lang.encode()
    base = hashlib.blake2b(len(name).to_bytes(8, "little") + name, digest_size=8)
    digests = []
    for w in words:
        h = base.copy()
        h.update(w)
        digests.append(h.digest())
    return np.frombuffer(b"".join(digests), np.int64) | np.iinfo(np.int64).min


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def by_language(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """For each language of a batch its rows, and their distinct words, word codes and bounds."""
    names = np.array(part.column("lang").to_pylist(), object)
    for lang in sorted(set(names.tolist())):
        rows = np.flatnonzero(names == lang)
        yield lang, rows, *chunks.words(part.column("text").take(pa.array(rows)))


def _messages(parts: list[tuple[str | None, int, int, bytes | None]]) -> pa.RecordBatch:
    columns = zip(*parts, strict=True) if parts else ((), (), (), ())
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "kind", "shard", "body"])


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches by ``key``, as tuples of slice, kind, shard and body."""
    last, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("slice", "kind", "shard", "body")), strict=True):
            value = row[0] if key == "slice" else row[2]
            if held and value != last:
                yield last, held
                held = []
            last = value
            held.append(row)
    if held:
        yield last, held


def _to_shards(messages: DataFrame, n: int) -> DataFrame:
    return messages.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "kind", "slice")


def _to_slices(messages: DataFrame, n: int) -> DataFrame:
    return messages.repartition(n, "slice").sortWithinPartitions("slice", "kind", "shard")


def _encoded(part: pa.RecordBatch, shards: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """A slice's file, and for each shard of words what it gets.

    The slice's words are in the order of shard, language and key; that is the order of all answers.
    """
    seqs, keys, lang_of, trained, rows, sizes, names = [], [], [], [], [], [], []
    role, at = np.asarray(part.column("role")), 0
    for k, (lang, own, words, codes, bounds) in enumerate(by_language(part)):
        names.append(lang)
        rows.append(own)
        size = np.diff(bounds)
        sizes.append(size)
        if not len(words):
            continue
        length = np.where(size > 0, size + 2, 0)
        ends = np.cumsum(length)
        seq, inner = np.empty(ends[-1], np.int64), np.ones(ends[-1], bool)
        for edge, code in (((ends - length)[size > 0], len(words)), (ends[size > 0] - 1, len(words) + 1)):
            seq[edge] = code
            inner[edge] = False
        seq[inner] = codes
        trained.append(np.bincount(seq[np.repeat(role[own] == TRAIN, length)], minlength=len(words) + 2))
        seqs.append((seq + at).astype(np.uint32))
        keys.append(word_keys(lang, [*words, BEGIN, END]))
        lang_of.append(np.full(len(words) + 2, k))
        at += len(words) + 2
    empty = [np.zeros(0, np.int64)]
    seq = np.concatenate(seqs or [np.zeros(0, np.uint32)])
    key, lang, n = (np.concatenate(x or empty) for x in (keys, lang_of, trained))
    shard = shard_of(key, shards)
    order = np.lexsort((key, lang, shard))
    key, lang, n, shard = key[order], lang[order], n[order], shard[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    # frequent words get small numbers in the file, which then takes less room; the counts give the order of words again
    uses = np.bincount(seq, minlength=at)[order].astype(np.uint32)
    number = np.empty(at, np.uint32)
    number[order[_by_uses(uses)]] = np.arange(at, dtype=np.uint32)
    row = np.concatenate(rows or empty)
    size = np.concatenate(sizes or empty)
    carried = part.select(["id", "lang", "role"]).take(pa.array(row))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, carried.schema) as out:
        out.write_batch(carried)
    file = pickle.dumps((pack(sink.getvalue().to_pybytes()), squeeze(size.astype(np.uint32)), squeeze(number[seq]), squeeze(uses), squeeze(np.diff(edges).astype(np.uint32))), protocol=5)
    sent = []
    for s in np.flatnonzero(np.diff(edges)):
        a, b = edges[s], edges[s + 1]
        body = []
        for k in np.unique(lang[a:b]):
            m = a + np.flatnonzero(lang[a:b] == k)
            body.append((names[k], squeeze(np.diff(key[m], prepend=0)), squeeze(n[m].astype(np.uint32))))
        sent.append((int(s), pickle.dumps(body, protocol=5)))
    return file, sent


def _by_uses(uses: np.ndarray) -> np.ndarray:
    return np.argsort(-uses.astype(np.int64), kind="stable")


class _Slice:
    """A slice's file read again: its rows, and its texts as words of the slice, begin and end included."""

    def __init__(self, name: str) -> None:
        with opened(name) as f:
            rows, size, number, uses, of_shard = pickle.loads(f.read())
        self.rows = pa.ipc.open_stream(unpack(rows)).read_next_batch()
        self.n_words, self.of_shard = spread(size).astype(np.int64), spread(of_shard).astype(np.int64)
        order = _by_uses(spread(uses)).astype(np.uint32)
        self.token = order[spread(number)]
        self.words = len(order)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second word of every pair, and its text."""
        length = np.where(self.n_words > 0, self.n_words + 2, 0)
        text = np.repeat(np.arange(len(length), dtype=np.int32), length)
        inside = text[1:] == text[:-1]
        return self.token[:-1][inside], self.token[1:][inside], text[1:][inside]

    def numbers(self, answers: dict[int, bytes], shards: int) -> np.ndarray:
        """The numbers of the slice's words, -1 for words that were not trained on."""
        found = [spread(pickle.loads(answers[s])).astype(np.int64) * shards + s - shards for s in np.flatnonzero(self.of_shard).tolist()]
        return np.maximum(np.concatenate([np.zeros(0, np.int64), *found]), -1)


def _dealt(first: np.ndarray, second: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers by shard and in order, the shards' bounds, which pairs have numbers, and the place of each of them."""
    known = np.flatnonzero((first >= 0) & (second >= 0))
    keys, place = np.unique(first[known] << 32 | second[known], return_inverse=True)
    before = keys >> 32
    # the words of a shard are numbered shards apart, the frequent ones first
    shard = shard_of(np.where(before // shards < FREQUENT, keys, before), shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    where = np.empty(len(keys), np.int64)
    where[order] = np.arange(len(keys))
    return keys[order], edges, known, where[place]


def _pack_pairs(keys: np.ndarray, n: np.ndarray) -> bytes:
    before, after = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
    begin = np.flatnonzero(np.diff(before, prepend=-1))
    steps = np.diff(after, prepend=np.uint32(0))
    steps[begin] = after[begin]
    parts = (np.diff(before[begin], prepend=0).astype(np.uint32), np.diff([*begin, len(keys)]).astype(np.uint32), steps, n.astype(np.uint32))
    return pickle.dumps([squeeze(p) for p in parts], protocol=5)


def _unpack_pairs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    before, sizes, steps, n = (spread(p).astype(np.int64) for p in pickle.loads(body))
    ends = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    after = ends - np.repeat(ends[begin] - steps[begin], sizes)
    return np.repeat(np.cumsum(before), sizes) << 32 | after, n


def _summed(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Rows of a number and counts: the distinct numbers in order, and the sums of the counts of each."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    found, place = np.unique(columns[0], return_inverse=True)
    return [found, *(np.bincount(place, c, len(found)).astype(np.int64) for c in columns[1:])]


def perplexities(rows: DataFrame) -> DataFrame:
    """``id, lang, role, n_words, perplexity`` of every row of ``id, lang, role, text``.

    The rows of role ``TRAIN`` are learned from. A text without words and one of a language that has no words to
    learn from have no perplexity.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    shards = partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/slices/{uuid.uuid4().hex}"
            file, sent = _encoded(pa.Table.from_batches(held).combine_chunks().to_batches()[0], shards)
            with written(name) as out:
                out.write(file)
            return _messages([(name, _LISTED, -1, None), *((name, _WORDS, s, body) for s, body in sent)])

        for b in chunks.slices(batches, most=SLICE):
            n = pa.compute.sum(pa.compute.binary_length(b.column("text"))).as_py() or 0
            if held and size + n > SLICE:
                yield flush()
                held, size = [], 0
            if b.num_rows:
                held.append(b)
                size += n
        if held:
            yield flush()
        chunks.release()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _grouped(batches, "shard"):
            bodies = [pickle.loads(body) for _, _, _, body in group]
            names = sorted({lang for body in bodies for lang, _, _ in body})
            lang = np.concatenate([np.full(len(spread(n)), names.index(x)) for body in bodies for x, _, n in body])
            key = np.concatenate([np.cumsum(spread(k)) for body in bodies for _, k, _ in body])
            n = np.concatenate([spread(n) for body in bodies for _, _, n in body])
            order = np.lexsort((key, lang))
            head = (np.diff(lang[order], prepend=-1) != 0) | (np.diff(key[order], prepend=0) != 0)
            place = np.empty(len(key), np.int64)
            place[order] = np.cumsum(head) - 1
            total = np.bincount(place, n).astype(np.int64)
            by_count = np.argsort(-total, kind="stable")
            trained = int((total > 0).sum())
            rank = np.zeros(len(total), np.uint32)
            rank[by_count[:trained]] = np.arange(1, trained + 1)
            yield _messages([(None, _TRAINED, shard, pack((names, lang[order][head][by_count[:trained]].astype(np.int32), total[by_count[:trained]])))])
            answers, at = rank[place], 0
            for (name, _, _, _), body in zip(group, bodies, strict=True):
                size = sum(len(spread(n)) for _, _, n in body)
                yield _messages([(name, _NUMBERS, shard, pickle.dumps(squeeze(answers[at : at + size]), protocol=5))])
                at += size
        chunks.release()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in _grouped(batches, "slice"):
            own = _Slice(name)
            numbers = own.numbers({s: body for _, _, s, body in group}, shards)
            first, second, text = own.pairs()
            keys, edges, known, place = _dealt(numbers[first], numbers[second], shards)
            train = np.asarray(own.rows.column("role"))[text[known]] == TRAIN
            n = np.bincount(place[train], minlength=len(keys))
            yield _messages([(name, _COUNTS, int(s), _pack_pairs(keys[edges[s] : edges[s + 1]], n[edges[s] : edges[s + 1]])) for s in np.flatnonzero(np.diff(edges))])
        chunks.release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _grouped(batches, "shard"):
            parts = [_unpack_pairs(body) for _, _, _, body in group]
            ends = np.cumsum([len(k) for k, _ in parts])
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.uint32)
            del parts
            for (name, _, _, _), a, b in zip(group, [0, *ends[:-1]], ends, strict=True):
                yield _messages([(name, _COUNTS, shard, pickle.dumps(squeeze(total[place[a:b]]), protocol=5))])
            keys, total = keys[total > 0], total[total > 0]
            contexts = _summed([(keys >> 32, np.ones(len(keys), np.int64), *((total == k).astype(np.int64) for k in (1, 2, 3, 4)))])
            ended = _summed([(keys & 0xFFFFFFFF, np.ones(len(keys), np.int64))])
            sent = []
            sides = [(t, t[0] % shards) for t in (contexts, ended)]
            for s in np.unique(np.concatenate([of for _, of in sides])):
                body = []
                for table, of in sides:
                    m = of == s
                    body.append([squeeze(np.diff(table[0][m] // shards, prepend=0).astype(np.uint32)), *(squeeze(c[m].astype(np.uint32)) for c in table[1:])])
                sent.append((None, _CONTEXTS, int(s), pickle.dumps(body, protocol=5)))
            yield _messages(sent)
        chunks.release()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _grouped(batches, "shard"):
            names, lang, total = unpack(group[0][3])  # of kind _TRAINED, the first one
            sums = np.zeros((6, len(total) + 1), np.int64)  # different pairs begun, those seen 1 to 4 times, different pairs ended
            for _, kind, _, body in group:
                if kind == _CONTEXTS:
                    for at, table in zip((slice(0, 5), slice(5, 6)), pickle.loads(body), strict=True):
                        rank, *counts = (spread(c).astype(np.int64) for c in table)
                        sums[at, np.cumsum(rank) + 1] += counts
            told = {}
            for k in np.unique(lang).tolist():
                own = sums[:, 1:][:, lang == k]
                ended = own[5]
                told[names[k]] = [*own[1:5].sum(axis=1).tolist(), *(int((ended == j).sum()) for j in (1, 2, 3, 4)), int(ended.sum()), int((ended > 0).sum())]
            yield _messages([(None, _LANGUAGES, shard, pickle.dumps(told))])
            table = np.concatenate([[np.concatenate([[0], total])], sums[[0, 1, 2, 5]]])
            for name, kind, _, body in group:
                if kind == _NUMBERS:
                    rank = spread(pickle.loads(body))
                    yield _messages([(name, _SUMS, shard, pickle.dumps([squeeze(c[rank].astype(np.uint32)) for c in table], protocol=5))])
        chunks.release()

    listed = kept_at(rows.mapInArrow(cut, _MESSAGE), f"{folder}/sent")
    names = staged(listed.where(F.col("kind") == _LISTED), "slices")
    numbers = kept_at(_to_shards(listed.where(F.col("kind") == _WORDS), shards).mapInArrow(number, _MESSAGE), f"{folder}/numbers")
    removed(f"{folder}/sent")
    answered = F.col("kind") == _NUMBERS
    counts = kept_at(_to_shards(_to_slices(numbers.where(answered), shards).mapInArrow(pairs, _MESSAGE), shards).mapInArrow(count, _MESSAGE), f"{folder}/counts")
    told = counts.where(F.col("kind") == _CONTEXTS).unionByName(numbers)
    sums = kept_at(_to_shards(told, shards).mapInArrow(sum_up, _MESSAGE), f"{folder}/sums")
    by_lang: dict[str, np.ndarray] = {}
    for r in sums.where(F.col("kind") == _LANGUAGES).select("body").collect():
        for lang, found in pickle.loads(bytes(r["body"])).items():
            by_lang[lang] = by_lang.get(lang, 0) + np.array(found)
    shared = spark.sparkContext.broadcast(by_lang)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in _grouped(batches, "slice"):
            own = _Slice(name)
            answers = {kind: {s: body for _, k, s, body in group if k == kind} for kind in (_NUMBERS, _COUNTS, _SUMS)}
            yield _scored(own, answers, shards, shared.value)
        chunks.release()

    answers = counts.where(F.col("kind") == _COUNTS).unionByName(sums.where(F.col("kind") == _SUMS)).unionByName(numbers.where(answered)).unionByName(names)
    found = staged(_to_slices(answers, shards).mapInArrow(score, _RESULT), "perplexities")
    removed(folder)
    return found


def _scored(own: _Slice, answers: dict[int, dict[int, bytes]], shards: int, by_lang: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = sorted(set(own.rows.column("lang").to_pylist()))
    lang = np.searchsorted(np.array(names, object), np.array(own.rows.column("lang").to_pylist(), object)) if names else np.zeros(0, np.int64)
    learned = np.array([x in by_lang for x in names], bool)
    told = np.array([by_lang.get(x, np.zeros(10, np.int64)) for x in names]).reshape(len(names), 10)
    d, u = (np.array([discounts(*x) for x in told[:, at].tolist()]).reshape(len(names), 4) for at in (slice(0, 4), slice(4, 8)))
    ended, kinds = told[:, 8], told[:, 9]
    # the words that can follow: all that did, and one that stands for those never seen
    spent = u[:, 1] * told[:, 4] + u[:, 2] * told[:, 5] + u[:, 3] * (kinds - told[:, 4] - told[:, 5])
    base = spent / (kinds + 1)
    first, second, text = own.pairs()
    of_word = np.zeros(own.words, np.int64)
    for word in (first, second):
        of_word[word] = lang[text]
    columns = [[] for _ in range(5)]
    for s in np.flatnonzero(own.of_shard).tolist():
        body = answers[_SUMS].get(s)
        for c, x in zip(columns, pickle.loads(body) if body else [None] * 5, strict=True):
            c.append(np.zeros(own.of_shard[s], np.int64) if x is None else spread(x).astype(np.int64))
    total, begun, ones, twos, follows = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
    unigram = (follows - u[of_word, np.minimum(follows, 3)] + base[of_word]) / np.maximum(ended[of_word], 1)
    weight = (d[of_word, 1] * ones + d[of_word, 2] * twos + d[of_word, 3] * (begun - ones - twos)) / np.maximum(total, 1)
    weight[total == 0] = 1  # a context that was never seen says nothing
    numbers = own.numbers(answers[_NUMBERS], shards)
    keys, edges, known, place = _dealt(numbers[first], numbers[second], shards)
    seen = np.concatenate([np.zeros(0, np.uint32), *(spread(pickle.loads(answers[_COUNTS][int(s)])) for s in np.flatnonzero(np.diff(edges)))]).astype(np.int64)
    n = np.zeros(len(first), np.int64)
    n[known] = seen[place]
    del keys, place, known
    use = np.flatnonzero(learned[lang[text]]) if len(text) else np.zeros(0, np.int64)
    first, second, text, n = first[use], second[use], text[use], n[use]
    own_lang = of_word[first]
    p = np.maximum(n - d[own_lang, np.minimum(n, 3)], 0) / np.maximum(total[first], 1) + weight[first] * unigram[second]
    each = -np.bincount(text, np.log(p), len(own.n_words)) / (own.n_words + 1)
    mask = (own.n_words == 0) | ~learned[lang] if len(lang) else np.zeros(0, bool)
    perplexity = pa.array(np.exp(np.minimum(each, 700)), mask=mask)
    return pa.RecordBatch.from_arrays([*(own.rows.column(c) for c in ("id", "lang", "role")), pa.array(own.n_words), perplexity], ["id", "lang", "role", "n_words", "perplexity"])
