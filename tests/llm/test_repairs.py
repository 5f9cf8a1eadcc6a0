"""Repeated passages, conversation repair and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from fleetpulse.llm import conversations, induced_sort, queries, repeats, simplex

SF = "/root/testdata/sf0.001"


# ---- suffixes -----------------------------------------------------------------------------------


@pytest.mark.parametrize("memory, budget", [(1, 60), (10, 200), (1 << 20, 1 << 20)])
def test_suffixes_are_sorted_with_common_prefixes(tmp_path, memory, budget):
    """Small alphabets, repeated stretches and runs; little memory makes the names recurse and the queues go to files."""
    rng = np.random.default_rng(memory)
    for trial in range(60):
        n, cap = int(rng.integers(1, 300)), int(rng.choice([3, 50, 200]))
        text = rng.integers(1, int(rng.integers(2, 7)), n)
        text = np.tile(text[: max(1, n // 7)], 8) if trial % 3 == 0 else np.full(n, 4) if trial % 10 == 1 else text
        data = bytes(np.append(text, 0).astype(np.uint8))
        found = np.concatenate(list(induced_sort.sorted_suffixes(np.frombuffer(data, np.uint8), str(tmp_path / "q"), budget, cap, memory)))
        pos = found["pos"].tolist()
        want = sorted(range(len(data) - 1), key=lambda i: data[i:], reverse=True)
        assert sorted(pos) == sorted(want) and [data[i : i + cap] for i in pos] == [data[i : i + cap] for i in want]
        shared = [0] + [len(os.path.commonprefix([data[i : i + cap], data[j : j + cap]])) for i, j in itertools.pairwise(pos)]
        assert found["lcp"].tolist() == shared


# ---- repeated passages --------------------------------------------------------------------------


def spans_by_force(rows, length):
    first: dict[bytes, int] = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1 if i is not None else 0):
            first[data[p : p + length]] = min(first.get(data[p : p + length], i), i)
    out = []
    for i, text in rows:
        data, gone = (text or "").encode(), set()
        for p in range(len(data) - length + 1 if i is not None else 0):
            if first[data[p : p + length]] < i:
                gone.update(range(p, p + length))
        starts = [q for q in sorted(gone) if q - 1 not in gone]
        stops = [q + 1 for q in sorted(gone) if q + 1 not in gone]
        out.append((i, len(data), len(gone), tuple(zip(starts, stops, strict=True)), bytes(b for q, b in enumerate(data) if q not in gone)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé中 "), rng.integers(1, 9))) for _ in range(300)]
    base = [" ".join(words[i] for i in np.minimum(rng.zipf(1.3, int(rng.integers(1, 80))), 299)) for _ in range(60)]
    rows = []
    for i in range(200):
        text = " ".join(str(rng.choice(base)) for _ in range(int(rng.integers(0, 4))))
        rows.append((int(rng.integers(0, 300)) if i % 50 else None, text[: len(text) // 2] + "X" + text[len(text) // 2 :] if i % 3 else text))
    # nulls, empty and long runs, copies that meet at a border, one byte too short, repeated ids and rows
    return [*rows, (1000, None), (1001, ""), (1002, "a" * 3000), (1003, "b" + "a" * 2000), (3, "ab" * 400), (1004, "ab" * 100), rows[5], rows[5],
            (2000, "x" * 49), (2001, "x" * 49), (2002, "y" * 50), (2003, "y" * 50), (None, "y" * 50), (2004, "\x00" * 60), (2005, "\x00" * 60)]


@pytest.mark.parametrize("small", [False, True])
def test_repeated_passages_equal_brute_force(spark, passages, monkeypatch, small):
    if small:  # many slices, queues in files, names that recurse
        monkeypatch.setattr(repeats, "SLICE", 3_000)
        monkeypatch.setattr(repeats, "WINDOW", 700)
        monkeypatch.setattr(repeats, "QUEUE_BYTES", 2_000)
        monkeypatch.setattr(repeats, "NAMES", 50)
    rows = [(i, t, 1, "x") for i, t in passages]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long, spans string").repartition(3)
    found = repeats.repeated_spans(docs)
    got = sorted(((r.id, r.n_bytes, r.n_removed, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in found.collect()), key=repr)
    assert got == spans_by_force(passages, 50)


def test_repeated_passages_of_another_length_and_of_no_rows(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    got = {(r.id, r.n_removed) for r in repeats.repeated_spans(docs, length=16).collect()}
    assert got == {(r[0], r[2]) for r in spans_by_force(passages, 16)}
    assert repeats.repeated_spans(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs, length=8)


# ---- conversations ------------------------------------------------------------------------------

_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def repaired_by_force(rows):
    """Cheapest and then least edits of rows of initial, fault, role and text, by trying all."""
    def closed(b):
        for _ in range(4):
            b = [min([b[q], (b[_NEXT[q]][0] + 3, "I" + b[_NEXT[q]][1], (("assistant" if q == 2 else "user", ""), *b[_NEXT[q]][2]))], key=lambda v: v[:2]) for q in range(4)]
        return b

    now = closed([(0, "", ()) if q in (0, 3) else (10**9, "", ()) for q in range(4)])
    for initial, fault, role, text in reversed(rows):
        here = []
        for q in range(4):
            ways = [(now[q][0] + 4, "D" + now[q][1], now[q][2])]
            if fault not in (1, 2):
                late = 3 if fault == 3 else 0
                if (k := _KEPT.get((q, initial))) is not None:
                    ways.append((now[k][0] + late, "K" + now[k][1], ((role, text), *now[k][2])))
                k = _NEXT[q]
                ways.append((now[k][0] + 3 + late, "R" + now[k][1], (("assistant" if q == 2 else "user", text), *now[k][2])))
            here.append(min(ways, key=lambda v: v[:2]))
        now = closed(here)
    return now[0]


def report_by_force(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(conversations.BLANKS)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, left = repaired_by_force([(i, f, r, x) for i, f, (_, r, x) in zip(first, faults, rows, strict=True)])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest(),
    )


def damaged_by_force(rows):
    out = {}
    for conv, *_ in rows:
        out.setdefault(conv, [])
    for conv, turn, role, text in rows:
        plain = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fate = zlib.crc32(f"{plain[0]}:{plain[1]}".encode()) % 20
        role, text = plain[2:]
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        if fate:
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: report_by_force(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in out.items()}


def test_least_paths_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        initial, fault = rng.integers(0, 4, n), rng.choice([0, 0, 0, 1, 2, 3], n)
        cost, audits, _, _ = conversations.paths((initial << 2 | fault).astype(np.uint8), np.array([0]), np.array([n]), conversations._END[None], np.array([True]))
        want = repaired_by_force([("sua?"[i], f, "r", "t") for i, f in zip(initial, fault, strict=True)])
        assert (cost[0, 0], audits[0].decode()) == want[:2]


def test_ranks_follow_the_letters():
    rng = np.random.default_rng(1)
    n = 60
    ahead = np.minimum(np.arange(n) + rng.integers(1, 3, n), n - 1)
    letter = rng.integers(0, 2, n)
    letter[-1], ahead[-1] = -1, n - 1
    audit = [""] * n
    for i in range(n - 2, -1, -1):
        audit[i] = "ab"[letter[i]] + audit[ahead[i]]
    rank = conversations.ranks(letter, ahead, 6)
    assert all((rank[i] < rank[j]) == (audit[i] < audit[j]) for i in range(n) for j in range(n))


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(2)
    rows = []
    for conv in [None, *range(40), 1000]:
        for turn in range(300 if conv == 1000 else int(rng.integers(1, 12))):
            role = rng.choice(["system", "user", "assistant", "tool", None, ""], p=[0.1, 0.4, 0.4, 0.04, 0.03, 0.03])
            text = rng.choice(["Hi.", "What?", "cut off", "  ", "", None, f"x{rng.integers(1000)}. ", "long " * 3000 + "end!"], p=[0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.34, 0.01])
            rows.append((conv, None if turn == 0 and conv is not None and conv % 9 == 0 else turn, role if role is None else str(role), text if text is None else str(text)))
    return rows


@pytest.mark.parametrize("block", [4_096, 8])
def test_conversations_equal_brute_force(spark, talks, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)  # a conversation over one or many segments
    rows = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, k long, g string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in conversations.report(conversations.damage(rows), rows).collect()}
    assert got == damaged_by_force(talks)


def test_conversations_of_no_rows_and_repeated_rows(spark, talks):
    rows = spark.createDataFrame(talks[:0], "conv_id long, turn long, role string, text string")
    assert conversations.report(conversations.damage(rows), rows).count() == 0
    twice = [(7, 1, "user", "Hi."), (7, 1, "user", "Hi."), (7, 2, "assistant", "Yes.")]
    ordered, edits = conversations.repair(spark.createDataFrame(twice, "conv_id long, turn long, role string, text string"))
    pieces = edits.orderBy("k").collect()  # equal rows can be dealt to several tasks
    assert "".join(r.audit for r in pieces) == "KDK" and pieces[0].cost == 4 and sum(r.duplicate for r in pieces) == 1
    left = conversations.repaired(ordered, edits).orderBy("k", "j").collect()
    assert [(r.role, r.text) for r in left] == [("user", "Hi."), ("assistant", "Yes.")]


# ---- centroids ----------------------------------------------------------------------------------


def clusters_by_force(rows, clusters, rounds, scale, width):
    kept = [(i, [int(x * scale // 1) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centres = [
            [sum(col) // len(part) for col in zip(*part, strict=True)] if (part := [v for (_, v), o in zip(kept, own, strict=True) if o == k]) else c
            for k, c in enumerate(centres)
        ]
    return sorted((i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in kept if i is not None), centres


@pytest.mark.parametrize("wild", [False, True])
def test_clusters_equal_brute_force(spark, wild):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 5), (202, [None] * 6), (203, [float("nan")] + [0.0] * 5), (204, [float("inf")] * 6), (None, [0.5] * 6), rows[3], rows[3]]
    rows += [(300 + k, [0.25, -0.25] * 3) for k in range(10)]
    if wild:  # components whose squares no long holds
        rows += [(400 + k, [3e38 if k % 2 else -1e20, *rng.normal(size=5).tolist()]) for k in range(4)]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<double>, cluster int, body binary").repartition(4)
    found, centres = simplex.cluster(df, width=6, clusters=7, rounds=5, pivots=6)
    want, last = clusters_by_force(rows, 7, 5, 256, 6)
    assert sorted((r.id, r.cluster, r.distance) for r in found.where("id is not null").collect()) == want
    assert centres.tolist() == last and found.where("id is null").count() == 1
    none, centres = simplex.cluster(df.limit(0), width=6, clusters=7)
    assert none.count() == 0 and len(centres) == 0
    few, centres = simplex.cluster(df.where("vec_id < 3"), width=6, clusters=7)
    assert len(centres) == len({tuple(c) for c in centres.tolist()}) and few.count() == df.where("vec_id < 3").count()


def test_bounds_enclose_distances_and_spare_most():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 16)) * 40).astype(np.int64)
    x[5] = x[4]
    base = simplex.Simplex(x[:17])
    a, b = base.apexes(x), base.apexes(x[100:140])
    low, high = simplex.bounds(a, b)
    true = ((x[:, None].astype(float) - x[None, 100:140]) ** 2).sum(axis=2)
    assert (low <= true + 1e-6 * (1 + true)).all() and (high >= true - 1e-6 * (1 + true)).all()
    assert simplex.filtered_share(x, x[100:140], x[:17]) > 0.9
    assert simplex.Simplex(np.repeat(x[:1], 5, axis=0)).pivots.shape[0] == 1


# ---- registered queries -------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op5_warc", "op6_exact_dedup", "op8_near_dedup", "op11_suffix_dedup", "op12_conversation_repair", "op13_centroid_clustering"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    query = queries.QUERIES[name]
    got = query.run(spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({query.sql}) q").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op1_language_id", "op2_nearest_neighbours", "op3_quality", "op4_token_counts", "op7_mixing", "op9_byte_bpe", "op10_token_records"])
def test_queries_without_sql_return_every_row(spark, name):
    table = "embeddings" if name.startswith("op2_") else "documents"
    found = queries.QUERIES[name].run(spark, SF)
    if name.startswith("op2_"):
        wanted = spark.read.parquet(f"{SF}/{table}.parquet").where("vec_id % 20 = 0").count()
        assert found.groupBy("query_id").count().where("count = 20").count() == wanted
    else:
        assert found.select("doc_id").distinct().count() == found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline_keeps_what_its_stages_say(spark):
    """Every stage's input and output hold the properties that the stage is there for."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, out = docs, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, given, SF).cache()
        assert sorted(out.columns) == sorted(docs.columns)
        assert out.select(docs.columns).subtract(docs).count() == 0
        before = {r.doc_id: r.text for r in given.select("doc_id", "text").collect()}
        after = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "exact_dedup":
            plain = {}
            for i, t in before.items():
                key = _spaced(t)
                plain[key] = min(plain.get(key, i), i)
            assert sorted(after) == sorted(plain.values())
        if name == "mixing":
            assert max(np.unique(after, return_counts=True)[1]) <= 2 and set(after) <= set(before)
        elif name != "exact_dedup":
            assert len(set(after)) == len(after) <= len(before)
        given = out
    last = corpus_pipeline.STAGES[4][1](spark, given, SF)
    texts = {r.doc_id: r.text or "" for r in given.collect()}
    assert last.count() == given.count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last.collect())


def _spaced(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")
