"""MinHash near-deduplication by a chosen-path set similarity join.

A document's set is its distinct shingles of five words. Documents with equal sets form a class
and are represented by their smallest id. Every class has a signature of minwise tokens, one for
each of ``TOKENS`` hash functions. A tree branches the classes: at a node each class follows the
positions that the node has chosen, and lands in the child named by the position and by its token
there. Nodes of at most ``SMALL`` classes are compared exhaustively; larger ones branch again. Two
classes of similarity s share a child with a chance of 1 - (1 - s)^BRANCHES, and independent trees
are repeated until a pair at the threshold is missed with a chance below ``MISS``.

In a node the signatures propose links: first a spanning forest of the most similar pairs. The
proposals are confirmed on the full sets. Where one fails, the parts of the node that are not yet
connected by any confirmed links propose all their plausible untested pairs; pairs inside a part
need no link of their own.

The members of a larger node are besides cut into random blocks, each compared together with the
node's anchors, a few members of smallest hash, so that a crowd of near copies hangs together by
its anchors. A node that keeps most of its parent's members is a crowd, and branches no further. A
crowd that hangs together is done, which is linear in its members. Otherwise, as where documents
share a template, all pairs of its members outside its largest part, and of these with the largest
part, are compared on their full sets, in cells of two blocks of bounded size.

Results: null and empty texts have the empty set and are linked with nothing. A text of fewer than
five words has its word sequence as its only shingle. Rows that repeat an id are one document: it
is linked with whatever has one of its sets, and by the similarity of one of them. A null id is in the component of
its class, or stands alone. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks
from fleetpulse.llm.components import components
from fleetpulse.llm.staging import lookup, numbered, sized_batches, staged

WORDS = 5
TOKENS, SMALL, BRANCHES, MISS = 256, 256, 2, 1e-4
#: Levels of a tree at most; a node with more than this share of its parent's members branches no further.
LEVELS, CROWD = 24, 0.6
#: Candidates need this share of equal short tokens of four bits, of which a sixteenth are equal by chance. A pair at the
#: threshold has 0.766 of them in the mean, three standard deviations above.
PLAUSIBLE = 0.68
#: Bytes of text whose words a task holds at once; a word's arrays take some twenty times its bytes.
SLICE = 4 << 20
#: Members of a large node that each of its blocks is compared with.
ANCHORS = 8
#: Members and shingles of a block of a crowd whose pairs are all compared.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: A shingle of this many members of a cell is counted by a product of matrices.
COMMON = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the range of words of each text."""
    import xxhash

    distinct, codes, bounds = chunks.words(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return hashes[codes], bounds


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, bounds = word_hashes(texts)
    run = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        run = _mixed(run * _ODD + words[k : k + len(run)] + np.uint64(k + 1))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = end - begin
        if n >= WORDS:
            yield np.unique(run[begin : end - WORDS + 1])
        elif n:
            h = np.full(1, n, np.uint64)
            for w in words[begin:end]:
                h = _mixed(h * _ODD + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


_STEPS = _mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def signature(members: np.ndarray) -> bytes:
    """The minwise token of each hash function, as 16-bit numbers."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    base = _mixed(members)
    for at in range(0, len(base), 512):
        # the product spreads the low bits, the shift brings in the high ones
        h = base[None, at : at + 512] * _STEPS[:, None]
        h ^= h >> np.uint64(29)
        least = np.minimum(least, h.min(axis=1))
    return _mixed(least).astype(np.uint16).tobytes()


def shortened(tokens: bytes) -> bytes:
    """Four bits of each token, which is what members of a node are compared by."""
    low = (np.frombuffer(tokens, np.uint16) & 15).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, digest, signature, short`` of every row; the digest names the set."""
    sized_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks.slices(batches, most=SLICE):
            sizes, digests, signatures = [], [], []
            for members in shingle_sets(part.column("text")):
                sizes.append(len(members))
                digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                signatures.append(signature(members) if len(members) else None)
            short = [shortened(x) if x is not None else None for x in signatures]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, signatures, short))],
                ["id", "n_shingles", "digest", "signature", "short"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, signature binary, short binary")


def trees_needed(threshold: float) -> int:
    """Trees after which a pair at the threshold has shared no first-level node with a chance below ``MISS``."""
    return math.ceil(math.log(MISS) / (BRANCHES * math.log(1 - threshold)))


def _tokens(column: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, TOKENS)


def _shorts(column: pa.Array | list) -> np.ndarray:
    """The short tokens of rows, one a byte."""
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(-1, TOKENS // 2)
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), TOKENS)


def _branch(rows: DataFrame) -> DataFrame:
    """``id, node, count, signature`` to the children: one row for each position that its node has chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = _tokens(b.column("signature").to_pylist())
            node = b.column("node").to_numpy().view(np.uint64)
            for k in range(BRANCHES):
                # positions depend on the path only, so that classes of a node choose alike
                at = (_mixed(node + np.uint64(k) * _ODD) % np.uint64(TOKENS)).astype(np.int64)
                token = tokens[np.arange(len(at)), at].astype(np.uint64)
                child = _mixed(_mixed(node * _ODD + at.astype(np.uint64)) + token)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(child.view(np.int64)), b.column("count")], ["id", "node", "above"])

    return rows.select("id", "node", "count", "signature").mapInArrow(run, "id long, node long, above long")


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """The first level: every tree takes its own positions, no two trees the same while there are enough."""
    order = np.argsort(_mixed(np.arange(TOKENS, dtype=np.uint64) + np.uint64(77)), kind="stable")
    take = [(t, int(order[(t * BRANCHES + k) % TOKENS])) for t in range(trees) for k in range(BRANCHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = _tokens(b.column("signature").to_pylist())
            for t, at in take:
                child = _mixed(_mixed(np.full(len(tokens), t * TOKENS + at, np.uint64)) + tokens[:, at])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(child.view(np.int64))], ["id", "node"])

    return classes.select("id", "signature").mapInArrow(run, "id long, node long").withColumn("above", F.lit(1 << 62))


def _alike(tokens: np.ndarray) -> np.ndarray:
    """The share of equal tokens of all pairs of a node; of a member with itself it is -1."""
    out = np.stack([(tokens == t).mean(axis=1) for t in tokens])
    np.fill_diagonal(out, -1)
    return out


def _forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the most similar plausible pairs."""
    n = len(alike)
    best, source = np.full(n, -1.0), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    edges = []
    for _ in range(n):
        x = int(np.argmax(np.where(inside, -2, best)))
        if best[x] >= PLAUSIBLE:
            edges.append((int(source[x]), x))
        inside[x] = True
        closer = alike[x] > best
        best[closer], source[closer] = alike[x][closer], x
    return edges


def _by_node(members: DataFrame, work, schema: str) -> DataFrame:
    """``work(node, table)`` for every node, whose members are few enough to be held together."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            node = table.column("node").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(node)) + 1)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                yield from work(node[begin], table.slice(begin, end - begin))
            rest = table.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from work(rest.column("node")[0].as_py(), rest)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, n = [[] for _ in names], 0
        for out in run(batches):
            for have, more in zip(columns, out, strict=True):
                have.extend(more)
            n += len(out[0])
            if n >= 20_000:
                yield _record(columns, schema)
                columns, n = [[] for _ in names], 0
        if n:
            yield _record(columns, schema)

    return members.repartition("node").sortWithinPartitions("node", "id").mapInArrow(packed, schema)


def _record(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _compare(members: DataFrame) -> DataFrame:
    """``node, a, b``: a spanning forest of candidate links in every node; ``members`` has ``node, id, short``."""

    def work(node: int, table: pa.Table):
        ids = table.column("id").to_numpy()
        tokens = _shorts(table.column("short").to_pylist())
        if len(ids) == 2:
            edges = [(0, 1)] if (tokens[0] == tokens[1]).mean() >= PLAUSIBLE else []
        else:
            edges = _forest(_alike(tokens))
        if edges:
            a, b = ids[[e[0] for e in edges]], ids[[e[1] for e in edges]]
            yield [node] * len(edges), np.minimum(a, b).tolist(), np.maximum(a, b).tolist()

    return _by_node(members, work, "node long, a long, b long")


def _propose(members: DataFrame, tested: DataFrame) -> DataFrame:
    """``node, a, b``: all untested candidates between the unconnected parts of the nodes.

    ``members`` has ``node, id, part, short, nodes``; ``tested`` has ``node, a, b``: what failed in these nodes
    before. A pair that meets in several nodes is proposed by the one of smallest number.
    """
    rows = members.select("node", "id", F.lit(None).cast("long").alias("b"), "part", "short", "nodes")
    tests = tested.select(
        "node", F.col("a").alias("id"), "b", F.lit(None).cast("long").alias("part"),
        F.lit(None).cast("binary").alias("short"), F.lit(None).cast("array<long>").alias("nodes"),
    )

    def work(node: int, table: pa.Table):
        own = table.filter(table.column("b").is_null())
        tests = table.filter(table.column("b").is_valid())
        ids, part = own.column("id").to_numpy(), own.column("part").to_numpy()
        a, b = np.searchsorted(ids, tests.column("id").to_numpy()), np.searchsorted(ids, tests.column("b").to_numpy())
        alike = _alike(_shorts(own.column("short").to_pylist()))
        alike[part[:, None] == part[None, :]] = -1
        alike[a, b] = alike[b, a] = -1
        meets = [set(n) for n in own.column("nodes").to_pylist()]
        x, y = (c.tolist() for c in np.nonzero(np.triu(alike >= PLAUSIBLE)))
        found = [(ids[i], ids[j]) for i, j in zip(x, y, strict=True) if min(meets[i] & meets[j]) == node]
        if found:
            yield [node] * len(found), [int(f[0]) for f in found], [int(f[1]) for f in found]

    return _by_node(rows.unionByName(tests), work, "node long, a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets have at least the threshold's similarity, with ``linked``."""
    percent = round(100 * threshold)
    found = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        .withColumn("both", F.size(F.array_intersect("x", "y")))
    )
    linked = F.col("both") * 100 >= percent * (F.size("x") + F.size("y") - F.col("both"))
    return found.select("a", "b", linked.alias("linked"))


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, members``: the full shingle sets of the documents named by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks.slices(batches, most=SLICE):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"))]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["id", "members"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(run, "id long, members array<long>")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row of ``docs``."""
    rows = staged(sketches(docs, id_col, text_col), "sketches")
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("short").alias("short")
    )
    # a class whose ids are all null has nothing to link
    classes = staged(classes.where("id is not null"), "classes")
    links = _class_links(docs, classes, id_col, text_col, threshold)
    tied = rows.where("digest is not null").select("id", "digest").join(classes.select("digest", F.col("id").alias("rep")), "digest")
    same_set = tied.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.select("a", "b").union(same_set))
    found = rows.select("id", "n_shingles").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return found.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _class_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Confirmed links ``a, b`` between classes: enough of them to connect whatever is similar."""
    members, crowds = _nodes(classes, threshold)
    links = staged(_node_links(docs, members, id_col, text_col, threshold), "links")
    if crowds.isEmpty():
        return links
    return links.unionByName(_crowd_links(docs, crowds, links, id_col, text_col, threshold))


def _node_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Confirmed links ``a, b`` that connect whatever is similar in a node of ``members``."""
    proposed = staged(_compare(members), "proposed")
    pairs = staged(proposed.select("a", "b").distinct(), "pairs")
    # whoever has a plausible partner in a node is in its forest, so later rounds need no other sets
    wanted = lookup(staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted"))
    sets = staged(_full_sets(docs, wanted, id_col, text_col).dropDuplicates(["id"]), "sets")
    checked = staged(_confirmed(pairs, sets, threshold), "checked")
    failed = staged(proposed.join(checked.where("not linked").select("a", "b"), ["a", "b"]), "failed")
    if failed.isEmpty():
        return checked.where("linked").select("a", "b")
    nodes = members.join(failed.select("node").distinct(), "node", "left_semi")
    parts = components(checked.where("linked").select("a", "b"))
    parted = nodes.join(parts, "id", "left").select("node", "id", F.coalesce("component", "id").alias("part"), "short")
    divided = parted.groupBy("node").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("node")
    # written, because joins of a table with what is derived from it are easily confused
    open_ = staged(parted.join(divided, "node", "left_semi"), "open")
    lists = open_.groupBy("id").agg(F.collect_list("node").alias("nodes"))
    rest = _propose(open_.join(lists, "id"), failed.join(open_.select("node").distinct(), "node", "left_semi"))
    fresh = rest.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
    return checked.unionByName(staged(_confirmed(fresh, sets, threshold), "checked")).where("linked").select("a", "b")


def _crowd_links(docs: DataFrame, crowds: DataFrame, links: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Links ``a, b`` between the parts of each crowd that ``links`` leave unconnected; ``crowds`` has ``crowd, id``."""
    parts = components(links)
    parted = staged(crowds.join(parts, "id", "left").select("crowd", "id", F.coalesce("component", "id").alias("part")), "parted")
    sizes = parted.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("crowd").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    main = staged(main.select("crowd", "main"), "main")
    if main.isEmpty():
        return links.limit(0)
    open_ = staged(parted.join(main, "crowd").select("crowd", "id", "part", (F.col("part") == F.col("main")).alias("inner")), "open")
    wanted = lookup(staged(open_.select("id").distinct(), "wanted"))
    sets = staged(_full_sets(docs, wanted, id_col, text_col).dropDuplicates(["id"]), "sets")
    sized = open_.join(sets.select("id", F.size("members").alias("size")), "id")
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES))
    cuts = sized.groupBy("crowd").pivot("inner", [False, True]).agg(cut).select("crowd", F.col("false").alias("outs"), F.col("true").alias("ins"))
    placed = open_.join(staged(cuts, "cuts"), "crowd")
    h = F.xxhash64("id", "crowd")
    placed = placed.withColumn("block", F.pmod(h, F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))))
    # every block of the largest part meets every outer block, and the outer blocks meet each other
    outs, ins = F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), F.sequence(F.lit(0).cast("long"), F.col("ins") - 1)

    def cell(kind: int, i, j, left):
        return F.struct(F.xxhash64("crowd", F.lit(kind), i, j).alias("node"), left.alias("left"))

    block = F.col("block")
    whole = F.lit(None).cast("boolean")
    inner = F.transform(outs, lambda j: cell(0, block, j, F.lit(True)))
    across = F.transform(ins, lambda i: cell(0, i, block, F.lit(False)))
    among = F.transform(outs, lambda j: cell(1, F.least(block, j), F.greatest(block, j), F.when(j == block, whole).otherwise(block < j)))
    cells = placed.select("id", "part", F.explode(F.when(F.col("inner"), inner).otherwise(F.concat(across, among))).alias("cell"))
    cells = cells.select("id", "part", "cell.node", "cell.left").join(sets, "id").select("node", "id", "part", "left", "members")
    return _by_node(cells, _all_pairs(round(100 * threshold)), "a long, b long").distinct()


def _all_pairs(percent: int):
    """A task that compares each left with each right member of a cell, and gives links that connect its parts."""

    def work(node: int, table: pa.Table):
        left = table.column("left").to_pylist()
        a = np.flatnonzero([x is not False for x in left])
        b = np.flatnonzero([x is not True for x in left])
        if not len(a) or not len(b):
            return
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        members = table.column("members").combine_chunks()
        size = np.diff(members.offsets.to_numpy())
        both = _shared(members.flatten().to_numpy(), size, a, b)
        linked = both * 100 >= percent * (size[a][:, None] + size[b][None, :] - both)
        linked &= (part[a][:, None] != part[b][None, :]) & (both > 0)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        x, y = np.nonzero(linked)
        pairs = []
        for i, j in zip(a[x].tolist(), b[y].tolist(), strict=True):
            p, q = find(int(part[i])), find(int(part[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                pairs.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        if pairs:
            yield [int(p[0]) for p in pairs], [int(p[1]) for p in pairs]

    return work


def _shared(flat: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each member in ``a`` has in common with each in ``b``."""
    _, code, uses = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(a), len(b)), np.int64)
    row, column = np.full(len(size), -1), np.full(len(size), -1)
    row[a], column[b] = np.arange(len(a)), np.arange(len(b))
    # common shingles by matrices, some thousands at a time
    common = np.flatnonzero(uses >= COMMON)
    place = np.full(len(uses), -1)
    place[common] = np.arange(len(common))
    for at in range(0, len(common), 2048):
        k = place[code] - at
        here = (k >= 0) & (k < 2048) & (place[code] >= 0)
        has = np.zeros((len(size), min(2048, len(common) - at)), np.float32)
        has[owner[here], k[here]] = 1
        out += np.rint(has[a] @ has[b].T).astype(np.int64)
    # of the others all pairs of owners
    rest = np.flatnonzero((uses[code] > 1) & (uses[code] < COMMON))
    rest = rest[np.argsort(code[rest], kind="stable")]
    c, o = code[rest], owner[rest]
    for step in range(1, COMMON):
        near = c[:-step] == c[step:]
        if not near.any():
            break
        x, y = o[:-step][near], o[step:][near]
        for i, j in ((x, y), (y, x)):
            ok = (row[i] >= 0) & (column[j] >= 0)
            out += np.bincount(row[i][ok] * len(b) + column[j][ok], minlength=out.size).reshape(out.shape)
    return out


def _nodes(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``node, id, short``: the nodes of all trees whose members are to be compared, large ones in blocks; and ``crowd, id``.

    A crowd is a large node that branches no further, together with those that have the same member of smallest
    hash: trees often give nearly the same crowd.
    """
    signatures = classes.select("id", "signature")
    level = _roots(classes, trees_needed(threshold))
    shared, ends = [], []
    for depth in range(LEVELS):
        counts = level.groupBy("node").count().where("count > 1")
        shared.append(staged(level.join(counts, "node"), "level"))
        branches = (F.col("count") <= CROWD * F.col("above")) & F.lit(depth < LEVELS - 1)
        ends.append(shared[-1].where((F.col("count") > SMALL) & ~branches).select("node", "id"))
        large = shared[-1].where((F.col("count") > SMALL) & branches)
        if large.isEmpty():
            break
        level = _branch(large.join(signatures, "id"))
    every = shared[0]
    for more in shared[1:]:
        every = every.unionByName(more)
    small = every.where(F.col("count") <= SMALL).select("node", "id")
    nodes = small.unionByName(_blocks(every.where(F.col("count") > SMALL)))
    # trees often give the same node: each set of members is compared once
    named = nodes.groupBy("node").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("what"), F.count("*").alias("n"))
    once = named.groupBy("what", "n").agg(F.min("node").alias("node")).select("node")
    crowds = ends[0]
    for more in ends[1:]:
        crowds = crowds.unionByName(more)
    crowds = staged(crowds, "ends")
    alike = crowds.groupBy("node").agg(F.min_by("id", F.xxhash64("id")).alias("crowd"))
    crowds = staged(crowds.join(alike, "node").select("crowd", "id").distinct(), "crowds")
    return staged(nodes.join(once, "node", "left_semi").join(classes.select("id", "short"), "id").select("node", "id", "short"), "nodes"), crowds


def _blocks(large: DataFrame) -> DataFrame:
    """Large nodes cut into random blocks of at most about ``SMALL`` members, each with the anchors of its node.

    ``large`` has ``node, id, count``. Anchors are the members of smallest hash in each of
    ``ANCHORS`` hash slices, so that no node is sorted in one task.
    """
    spread = large.withColumn("h", F.xxhash64("id", "node"))
    anchors = spread.groupBy("node", F.pmod("h", F.lit(ANCHORS)).alias("slice")).agg(F.min_by("id", "h").alias("id"), F.max("count").alias("count"))
    cuts = F.ceil(F.col("count") * 5 / (4 * (SMALL - ANCHORS)))
    placed = spread.select("node", "id", F.pmod("h", cuts).alias("part"))
    everywhere = anchors.select("node", "id", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("part"))
    return placed.union(everywhere).distinct().select(F.xxhash64("node", "part").alias("node"), "id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, with the columns they came with."""
    found = near_components(docs, id_col, text_col, threshold)
    gone = lookup(staged(found.where("not kept").select("id").distinct(), "gone"))
    names, plain = docs.columns, numbered(docs)
    return plain.join(gone, F.col(f"c{names.index(id_col)}").cast("long") == F.col("id"), "left_anti").select(*plain.columns).toDF(*names)
