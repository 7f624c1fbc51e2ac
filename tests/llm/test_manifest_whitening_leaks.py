"""Manifest, whitening and decontamination against brute force, and their answers to nulls, ties, long and empty inputs."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from mediaops.llm import decontaminate, merkle, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, steps int, `key` string"


def h(text):
    return sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Rows of (doc_id, source, text) with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, s, None, len(t or ""), t, "x", 1, 2, "k") for i, s, t in rows], DOCS)


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i, node):
    others = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3:i // 3 * 3 + 3]
        others += run[:i % 3] + run[i % 3 + 1:]
        run[i % 3] = node
        node, i = h("".join(run)), i // 3
    return node, others


def brute_manifest(rows):
    def leaf(i, s, t):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, None, len(t or ""), t)))

    def changed(i, s, t):
        if i is None or t is None or zlib.crc32(str(i).encode()) % 2:
            return leaf(i, s, t)
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, None, len(t), t.replace("\n", ""))))

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {x: sorted((r for r in rows if r[1] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in sources}
    trees = {x: tree_of([leaf(*r) for r in members[x]]) for x in sources}
    crown = tree_of([trees[x][-1][0] for x in sources])
    for k, x in enumerate(sources):
        for i, r in enumerate(members[x]):
            low, one = climb(trees[x], i, changed(*r))
            top, two = climb(crown, k, low)
            yield (r[0], leaf(*r), trees[x][-1][0], crown[-1][0], h("".join(one + two)), top, top == crown[-1][0])


@pytest.mark.parametrize("block", [3, 9, 729])
def test_manifest_is_the_tree(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "_SHARE", 2)
    rng = random.Random(block)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "é", "Z", "", None, "one"]), rng.choice(["x\ny", "flat", "", None, "ö\n\n" * 4])) for i in range(70)]
    rows += [(7, "hot", "again\n"), (7, "hot", "again\n"), (None, "hot", "no key\n"), (None, None, None), (200, "alone", "long\n" * 50_000)]
    got = [tuple(r)[:4] + tuple(r)[5:] for r in merkle.manifest(docs_of(spark, rows)).select(
        "doc_id", "leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", "verified").collect()]
    assert Counter(got) == Counter(brute_manifest(rows))
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_little(spark):
    assert merkle.manifest(docs_of(spark, [])).collect() == []
    (one,) = merkle.manifest(docs_of(spark, [(1, None, "a\nb")])).collect()
    assert one.root == one.subroot == one.leaf and one.steps == [] and one.proof_sha256 == h("")
    assert one.verified == bool(zlib.crc32(b"1") % 2)
    two = merkle.manifest(docs_of(spark, [(1, "b", "x"), (2, "a", "y")])).collect()
    by = {r.doc_id: r for r in two}
    assert by[1].root == h(by[2].leaf + by[1].leaf) and by[1].proof_sha256 == h(by[2].leaf)


def brute_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    centred = d / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (d.astype(object) ** 2).sum(axis=1), centred, values[::-1], vectors[:, ::-1]


def test_whitening_is_the_decomposition(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 12)) * np.linspace(0.1, 1.5, 12)
    rows = [(i, [float(e) for e in v], 1.0) for i, v in enumerate(np.float32(data))]
    odd = [(900, None, 0.0), (901, [None] * 12, 0.0), (902, [float("nan")] + [0.0] * 11, 0.0), (903, [float("inf")] + [0.0] * 11, 0.0), (904, [1.0], 0.0), (905, [], 0.0)]
    rows += [(None, rows[0][1], 1.0), (5, rows[5][1], 1.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, whitened double")
    got = whitening.whiten(df).collect()
    n, deviations, centred, values, vectors = brute_whitening([v for _, v, _ in rows])
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n}
    of = {i: k for k, (i, _, _) in enumerate(rows)}
    sign = {}
    for r in got:
        k, c = of[r.vec_id], r.component - 1
        want = centred[k] @ vectors[:, c] / np.sqrt(values[c])
        sign.setdefault(c, 1 if want * r.whitened > 0 else -1)
        assert abs(sign[c] * want - r.whitened) < 1e-9
        assert int(r.deviation) == deviations[k]
        assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert {r.explained for r in two} == {1.0} and {int(r.deviation) for r in two} == {1024 ** 2}


@pytest.mark.parametrize("kind", ["spread", "equal", "diagonal", "blocks", "clustered", "tiny"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(8)
    n = 40
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {"spread": np.linspace(1, 9, n), "equal": np.ones(n), "diagonal": np.repeat(np.arange(10.0), 4),
              "blocks": np.repeat([1.0, 2, 3, 50], 10), "clustered": 5 + 1e-13 * np.arange(n), "tiny": np.geomspace(1e-9, 1e9, n)}[kind]
    a = np.diag(rng.permutation(values)) if kind == "diagonal" else (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading_pairs(a, 8)
    top = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    scale = np.abs(values).max()
    assert np.abs(found - top).max() < 1e-13 * n * scale
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() < 1e-13 * n * scale


def brute_leaks(docs, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for i, t in items:
        w = cut(t)
        windows += [(i, w[k:k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    for key, text in docs:
        w, hit, names = cut(text), set(), set()
        for i, v in windows:
            for k in range(len(w) - len(v) + 1):
                if w[k:k + len(v)] == v:
                    hit |= set(range(k, k + len(v)))
                    names.add(i)
        yield key, len(w), frozenset(hit), tuple(sorted(str(n) for n in names if n is not None)), bool(hit)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_decontamination_finds_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    monkeypatch.setattr(decontaminate, "_PIECE", 200)
    rng = random.Random(bits)
    few = ["a", "b", "Cc", "9", "wörd"]
    text = lambda n, words=few: "".join(rng.choice(words) + rng.choice([" ", "\n", "-", " . "]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]), ["Lorem", "Éa", "x7", "do"])) for k in range(12)]
    items += [(50, None), (51, ""), (52, "  !! "), (10, items[3][1]), (None, "only a nameless item " * 3), (53, "z" * 1000), (54, items[4][1].upper())]
    docs = [(k, text(30)) for k in range(20)]
    for k in range(40):
        body = text(20, few + ["Lorem", "Éa", "x7", "do"]) + rng.choice(items)[1].__str__() + " " + text(5)
        docs.append((100 + k, body.replace("ü", "Ü")))
    docs += [(1, None), (2, ""), (3, "!"), (3, items[0][1]), (3, items[0][1]), (None, items[2][1]), (4, "q " * 30_000 + "z" * 1000), (5, "only a nameless item " * 3)]
    frame = spark.createDataFrame([(k, t, 1, "p") for k, t in docs], "doc_id long, text string, n_words int, place string")
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    seen = Counter((r.doc_id, r.n_words, frozenset(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"]), r.contaminated) for r in got)
    assert seen == Counter(brute_leaks(docs, items))
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) and r.n_items == len(r["items"]) for r in got)


def test_decontamination_of_little(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    none, one = spark.createDataFrame([], items), spark.createDataFrame([(1, "some words here")], items)
    assert decontaminate.decontaminate(spark.createDataFrame([], docs), one).collect() == []
    (row,) = decontaminate.decontaminate(spark.createDataFrame([(1, "some words here")], docs), none).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
