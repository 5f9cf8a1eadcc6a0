"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For every language the probabilities of the
pieces are fitted by expectation maximisation: the expected uses of a piece over all segmentations
of the training words, from a forward and a backward pass. A text's likelihood is the product
over its chunks of the sum over all their segmentations, which the forward algorithm gives; no
piece reaches over a chunk's border. Each distinct chunk of a slice of texts is scored once.

Training reads at most about ``PER_LANGUAGE`` documents of each language, drawn by a hash of the
text. Only texts and languages are learned from; a prediction sees the text alone.

Results: a null text, or one without a letter, is ``und`` with score 0; so is every text where
nothing was learned. Ties go to the language of smallest name. The score is the probability of the
predicted language among those learned, all equally likely before the text is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks
from fleetpulse.llm.staging import free_name, sized_batches, staged
from fleetpulse.llm.vocabularies import place

MODEL = "piece_bpe_32k.model"
PER_LANGUAGE, ROUNDS, SMOOTHING = 4_000, 3, 0.05
#: Characters that the probability of a character outside the vocabulary is shared by.
OTHERS = 100_000
#: Chunks up to this many characters are scored together; longer ones one by one.
SHORT = 24
MEMORY = 250_000


@lru_cache(2)
def pieces(path: str) -> tuple[dict[str, int], int, int]:
    """Ids of the vocabulary's pieces by their text (-1: only a beginning of pieces), their number and longest length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table: dict[str, int] = {}
    n = 0
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            table[model.id_to_piece(i).replace("▁", " ")] = n
            n += 1
    longest = max(map(len, table), default=1)
    for piece in list(table):
        for k in range(1, len(piece)):
            table.setdefault(piece[:k], -1)
    return table, n, longest


@lru_cache(2)
def tree(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary as a tree: sorted edges (node and character in one number), where they lead, and each node's piece or -1."""
    table = pieces(path)[0]
    number = {"": 0} | {text: k + 1 for k, text in enumerate(table)}
    edges = np.fromiter((number[text[:-1]] << 21 | ord(text[-1]) for text in table), np.int64, len(table))
    order = np.argsort(edges)
    return edges[order], order + 1, np.array([-1, *table.values()], np.int32)


def lattice(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``ids[start, length - 1, t]``: the piece there (n: a character outside the vocabulary, n + 1: none); and the texts' lengths."""
    edges, leads, piece_of = tree(path)
    _, n, longest = pieces(path)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(sizes.max(initial=1))
    ids = np.full((width, min(longest, width), len(texts)), n + 1, np.int32)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(points)) - begin[text]
    left = sizes[text] - start
    at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for length in range(ids.shape[1]):
        on = left[at] > length
        at, node = at[on], node[on]
        key = node << 21 | points[at + length]
        edge = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
        on = edges[edge] == key
        at, node = at[on], leads[edge[on]]
        piece = piece_of[node]
        known = piece >= 0
        ids[start[at[known]], length, text[at[known]]] = piece[known]
    single = ids[start, 0, text]
    ids[start, 0, text] = np.where(single == n + 1, n, single)
    return ids, sizes


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``alpha[j, t, k]``: the summed probability of all segmentations of the first j characters, in language k."""
    width, longest, texts = ids.shape
    alpha = np.zeros((width + 1, texts, p.shape[1]))
    alpha[0] = 1
    for start in range(width):
        for length in range(min(width - start, longest)):
            i = ids[start, length]
            use = np.flatnonzero(i < len(p) - 1)
            if len(use) > texts // 2:
                alpha[start + length + 1] += alpha[start] * p[i]
            elif len(use):
                alpha[start + length + 1, use] += alpha[start, use] * p[i[use]]
    return alpha


def _long(path: str, text: str, p: np.ndarray) -> np.ndarray:
    """The log-likelihood of one long chunk."""
    table, n, longest = pieces(path)
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    alpha = np.full((len(text) + 1, p.shape[1]), -np.inf)
    alpha[0] = 0
    for start in range(len(text)):
        for end in range(start + 1, min(len(text), start + longest) + 1):
            i = table.get(text[start:end])
            if i is None and end > start + 1:
                break
            if i is None or (i < 0 and end == start + 1):
                i = n
            if i >= 0:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + logs[i])
            if text[start:end] not in table:
                break
    return alpha[-1]


def plain(chunk: str) -> str:
    return chunk.replace("\n", " ")


def log_likelihoods(path: str, texts: list[str], p: np.ndarray) -> np.ndarray:
    """Rows of log-likelihoods, one column per language."""
    out = np.empty((len(texts), p.shape[1]))
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for begin in range(0, len(order), 4096):
        some = order[begin : begin + 4096]
        short = [i for i in some if len(texts[i]) <= SHORT]
        if short:
            ids, sizes = lattice(path, [plain(texts[i]) for i in short])
            out[short] = np.log(forward(ids, p)[sizes, np.arange(len(short))])
        for i in some[len(short) :]:
            out[i] = _long(path, plain(texts[i]), p)
    return out


def expected_uses(path: str, texts: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is used over all segmentations of the texts, each counted ``counts`` times; ``p`` is one language's."""
    ids, sizes = lattice(path, texts)
    alpha = forward(ids, p[:, None])[:, :, 0]
    width, longest, n = ids.shape
    beta = np.zeros((width + 1, n))
    beta[sizes, np.arange(n)] = 1
    for start in range(width - 1, -1, -1):
        for length in range(min(width - start, longest)):
            beta[start] += beta[start + length + 1] * p[ids[start, length]]
    scale = counts / alpha[sizes, np.arange(n)]
    uses = np.zeros(len(p))
    for start in range(width):
        for length in range(min(width - start, longest)):
            i = ids[start, length]
            uses += np.bincount(i, scale * alpha[start] * p[i] * beta[start + length + 1], len(p))
    uses[-1] = 0
    return uses


@dataclass
class Model:
    """Languages and the probabilities of their pieces; then of a character outside the vocabulary, then 0."""

    languages: list[str]
    p: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> Model:
    """Fits the piece probabilities of every language of ``docs``."""
    spark = docs.sparkSession
    path = path or place(MODEL)
    sized_batches(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang").groupBy("lang").count().collect()}
    languages = sorted(sizes)
    n = pieces(path)[1]
    if not languages:
        return Model([], np.zeros((n + 2, 0)))
    shares = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(int(min(1.0, PER_LANGUAGE / sizes[name]) * (1 << 30))))))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)) <= shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks.slices(batches):
            names = part.column("lang").to_numpy(zero_copy_only=False)
            for name in np.unique(names):
                cut = chunks.cut(part.column("text").filter(pa.array(names == name)))
                used = np.bincount(cut.codes, minlength=len(cut.distinct))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(cut.distinct, pa.string()), pa.array(used, pa.int64())], ["lang", "chunk", "n"])

    counted = drawn.mapInArrow(count, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))
    # a longer chunk has no words of a language; it is scored, but not learned from
    counted = staged(counted.where(F.length("chunk") <= SHORT).repartition(8 * max(1, spark.sparkContext.defaultParallelism // 4)), "chunks")
    p = np.full((n + 2, len(languages)), 1.0 / (n + 1))
    for _ in range(ROUNDS):
        p[n], p[n + 1] = p[n] / OTHERS, 0
        uses = _uses(counted, languages, path, p)
        p = (uses + SMOOTHING) / (uses[:-1] + SMOOTHING).sum(axis=0)
    p[n], p[n + 1] = p[n] / OTHERS, 0
    return Model(languages, p)


def _uses(counted: DataFrame, languages: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """Expected uses by piece and language: as many rows as the vocabulary has pieces, for each language."""
    shared = counted.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, found = shared.value, {}
        for b in batches:
            names, texts = np.array(b.column("lang").to_pylist(), object), b.column("chunk").to_pylist()
            counts, order = b.column("n").to_numpy().astype(float), np.argsort([len(t) for t in texts], kind="stable")
            for k, name in enumerate(languages):
                own = order[names[order] == name]
                for at in range(0, len(own), 4096):
                    some = own[at : at + 4096]
                    uses = expected_uses(path, [plain(texts[i]) for i in some], counts[some], p[:, k])
                    found[k] = found.get(k, 0) + uses
        for k, uses in found.items():
            i = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(uses[i])], ["k", "i", "uses"])

    sums = counted.mapInArrow(run, "k int, i int, uses double").groupBy("k", "i").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros(p.shape)
    out[sums["i"], sums["k"]] = sums["uses"]
    shared.unpersist()
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of the text."""
    path = path or place(MODEL)
    sized_batches(docs.sparkSession)
    languages, name = model.languages, uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    inner = free_name("__text", rest)
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    rows = docs.select(*rest, F.when(letter, F.col(text_col).cast("string")).alias(inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(name)
        for part in chunks.slices(batches, inner, 8 << 20):
            n, names, score = part.num_rows, np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if languages:
                cut = chunks.cut(part.column(inner))
                found = memory.values_of(cut.distinct, lambda new: [row.tobytes() for row in log_likelihoods(path, new, shared.value)])
                values = np.frombuffer(b"".join(found), np.float64).reshape(-1, len(languages))
                text = cut.text_of_chunk()
                total = np.column_stack([np.bincount(text, values[cut.codes, k], n) for k in range(len(languages))])
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                known = np.asarray(pc.is_valid(part.column(inner)))
                names[known] = np.array(languages, object)[best[known]]
                score[known] = (odds.max(axis=1) / odds.sum(axis=1))[known]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(names, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return rows.mapInArrow(run, f"{kinds}lang_pred string, score double")


@lru_cache(1)
def _memory(model: str) -> chunks.Memo:
    """What a Python worker remembers of the chunks scored with a model."""
    return chunks.Memo(MEMORY)
