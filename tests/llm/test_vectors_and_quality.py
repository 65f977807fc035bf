"""Kd-tree clustering, heap Lloyd codes and the quality discriminant against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import integer_vectors, kd_clusters, quality, queries, vector_codes

ROW = "vec_id long, embedding array<float>, label int, vector string, cluster int, code string, n long"


def embeddings(spark, rows, partitions=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, "y", 2) for i, v, label in rows]
    return spark.createDataFrame(rows, ROW).repartition(partitions)


def vectors(rng, n, dim=64, groups=5, hot=0):
    """Rows around a few places, on a grid coarse enough for ties; ``hot`` rows have one vector."""
    middles = [[rng.randint(-8, 8) / 4 for _ in range(dim)] for _ in range(groups)]
    rows = [(k, [x + rng.randint(-2, 2) / 64 for x in rng.choice(middles)], rng.choice([None, 0, 1, 2])) for k in range(n)]
    return rows + [(n + k, middles[0], 1) for k in range(hot)]


#: Rows that take no part in either operator, and (id) rows that do.
LEFT_OUT = [(900, None, 1), (901, [None] + [0.5] * 63, 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] + [0.0] * 63, None), (904, [0.5] * 48, 1), (905, [], 1)]


def usable(rows, scale, dim=64):
    kept = [(i, v, label) for i, v, label in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in kept]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_clusters(rows, k=8, rounds=10):
    kept = usable(rows, 1024)
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v, _ in sorted(kept, key=name)[:k]]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v, _ in kept]
        for c in range(len(centres)):
            if members := [v for (_, v, _), o in zip(kept, own) if o == c]:
                centres[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, nearest(v), gap(v, centres[nearest(v)])) for i, v, _ in kept]
    total = {c: sum(d for _, o, d in out if o == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, total[c], sum(total.values()), sha[c]) for i, c, d in out]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = usable(rows, 256)
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p]) for c in cut]
            for e in range(len(books[p])):
                if members := [c[p] for c, o in zip(cut, own) if o == e]:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(gap(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    totals = {}
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in k), e, totals[label], sha) for (i, _, label), k, e in zip(kept, codes, errors)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = {
    "groups": lambda rng: vectors(rng, 150) + LEFT_OUT,
    "a hot vector": lambda rng: vectors(rng, 60, hot=60),
    "null and repeated ids": lambda rng: [(k % 7 if k % 3 else None, v, label) for k, v, label in vectors(rng, 60)] + LEFT_OUT,
    "fewer rows than centroids": lambda rng: vectors(rng, 3) + LEFT_OUT,
    "one vector alone": lambda rng: [(k, [0.25] * 64, None) for k in range(20)],
    "large components": lambda rng: [(k, [rng.uniform(-16_000, 16_000) for _ in range(64)], 1) for k in range(30)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_clusters_equal_plain_lloyd(spark, case):
    rows = CASES[case](random.Random(case))
    found = kd_clusters.cluster(embeddings(spark, rows), tree_rows=25, leaf=3)
    assert collected(found) == sorted(plain_clusters(rows), key=repr)


@pytest.mark.parametrize("case", sorted(CASES))
def test_codes_equal_plain_lloyd(spark, case):
    rows = CASES[case](random.Random(case))
    found = vector_codes.compress(embeddings(spark, rows), block_rows=25)
    assert collected(found) == sorted(plain_codes(rows), key=repr)


def test_no_vectors(spark):
    for rows in ([], LEFT_OUT[:4]):
        for f in (kd_clusters.cluster, vector_codes.compress):
            assert f(embeddings(spark, rows)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_filtering_prunes_and_assigns_whole_nodes(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-30, 30, (300, 2)) + m for m in ((0, 0), (1000, 0), (0, 1000))] + [np.full((50, 2), 7)])
    tree, order = kd_clusters.Tree.build(x, 4)
    assert (tree.points == x[order]).all() and (tree.sums[0] == x.sum(axis=0)).all()
    centres = np.array([(0, 0), (1000, 0), (0, 1000), (7, 7), (7, 7)])
    whole, _, left = tree.filtered(centres)
    own, distance = tree.nearest(centres)
    exact = integer_vectors.squared_distances(tree.points, centres)
    assert (own == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    # Both far groups lie in whole nodes; only rows between the two places near 0 are looked at one by one.
    assert len(left) < 350 and (tree.nodes[whole, 1] - tree.nodes[whole, 0]).max() >= 100
    count, total = tree.totals(centres)
    assert (count == np.bincount(own, minlength=5)).all() and all((total[c] == tree.points[own == c].sum(axis=0)).all() for c in range(5))


@pytest.mark.parametrize("seed", range(3))
def test_heaps_pop_only_what_a_drift_can_change(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-500, 500, (400, 3, 4))
    block = vector_codes.Block.fresh(points.copy())
    books = vector_codes.Books(rng.integers(-500, 500, (3, 9, 4)), np.zeros((3, 9)))
    block.assign(books, first=True)
    for step in (1, 3, 40):
        moved = books.entries + rng.integers(-step, step + 1, books.entries.shape)
        gone = np.sqrt(((moved - books.entries) ** 2).sum(axis=2))
        others = np.array([[max(g[:e].max(initial=0), g[e + 1 :].max(initial=0)) for e in range(9)] for g in gone])
        books = vector_codes.Books(moved, books.drift + gone + others)
        for p in range(3):
            due = block.due(p, books.drift[p])
            keys = block.keys[p]
            violated = np.flatnonzero(keys <= books.drift[p, block.codes[p, block.rows[p]]])
            assert set(violated) <= set(due) and len(due) <= len(violated) + 5
            assert step > 3 or len(due) < 400
        block.assign(books)
        exact = np.stack([integer_vectors.squared_distances(points[:, p], books.entries[p]).argmin(axis=1) for p in range(3)])
        assert (block.codes == exact).all()
        for p in range(3):  # each heap ascends
            own = block.codes[p, block.rows[p]]
            assert (np.diff(own.astype(int)) >= 0).all() and all((np.diff(block.keys[p, own == e]) >= 0).all() for e in range(9))


def test_drift_counts_own_move_and_the_greatest_other():
    books = vector_codes.Books(np.zeros((1, 3, 1), np.int64), np.zeros((1, 3)))
    after = books.step(np.array([[1, 1, 0]]), np.array([[[5], [-3], [100]]]))
    assert after.entries.ravel().tolist() == [5, -3, 0] and after.drift.tolist() == [[5 + 3, 3 + 5, 0 + 5]]


def plain_statistics(text):
    text = text or ""
    tokens = text.split()
    letters = sum(c.isalpha() for t in tokens for c in t)
    count = lambda f: sum(f(c) for t in tokens for c in t)
    marks, chars = count(lambda c: c in ".,;:!?'\"()-"), sum(map(len, tokens))
    logit = lambda a, b: math.log((a + 0.5) / (b - a + 0.5))
    n, lines = len(tokens), [x for x in text.split("\n") if x.strip()]
    of = [sum(c.isalpha() for c in t) for t in tokens]
    digits = count(str.isdecimal)
    return [
        math.log1p(n), math.log((letters + 1) / (n + 1)), logit(count(str.isupper), letters), logit(digits, chars),
        math.log((marks + 0.5) / (n + 1)), math.log((chars - letters - digits - marks + 0.5) / (n + 1)),
        logit(sum(k == 0 for k in of), n), logit(sum(0 < k <= 3 for k in of), n), logit(sum(t[-1] in "!?" for t in tokens), n), logit(sum(t[0].isupper() for t in tokens), n),
        logit(len(set(tokens)), n), logit(len(set(zip(tokens, tokens[1:]))), max(n - 1, 0)), logit(max([0, *map(tokens.count, set(tokens))]), n), logit(len(set(lines)), len(lines)), math.log((n + 1) / (len(lines) + 1)),
    ]


TEXTS = [None, "", " ", "one", "  two  words ", "a\nb\n\nc\na", "x" * 5000, "naïve 漢字 😀 Ünder", "THE!! END!! 12 | | 3.5", "tab\tand\x01mark", "same same same same", "w " * 3000]


def test_statistics_equal_loops():
    found = quality.statistics(pa.array(TEXTS, pa.string()))
    assert found.shape == (len(TEXTS), len(quality.FEATURES))
    for row, text in zip(found, TEXTS):
        assert np.abs(row / quality.STEP - plain_statistics(text)).max() < 1 / quality.STEP, text


def test_discriminant_equals_a_plain_density():
    rng = np.random.default_rng(2)
    x = [rng.normal(0, 3, (400, 4)), rng.normal(1, 0.5, (900, 4)) @ rng.normal(0, 1, (4, 4))]
    model = quality.Discriminant.fit(np.array([400.0, 900.0]), np.stack([v.sum(axis=0) for v in x]), np.stack([v.T @ v for v in x]))
    assert all(0.02 <= s <= 1 for s in model.shrinkage)
    for row in np.concatenate([v[:20] for v in x]):
        density = [-0.5 * (row - m) @ np.linalg.solve(c, row - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(model.means, model.covariances)]
        assert math.isclose(model.differences(row[None])[0], math.asinh(density[1] - density[0] + math.log(900 / 400)), rel_tol=1e-6, abs_tol=1e-6)


def documents(spark, texts, ids=None):
    rows = [(ids[k] if ids else k, t, "en", "s", 7, 1.0, True) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, x string, good string, aside int, score double, held_out boolean")


def test_quality_is_learnt_and_held_out_rows_are_not_read(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(30, 200))).capitalize() + "."
    junk = [lambda: clean().upper().replace(" ", "!! "), lambda: clean().replace(" ", "### "), lambda: " ".join([word()] * rng.randint(30, 200))]
    good = [rng.random() < 0.7 for _ in range(600)]
    texts = [clean() if g else rng.choice(junk)() for g in good]
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(600)]
    # Held-out labels are turned round: what reads them scores badly.
    labels = spark.createDataFrame([(k, int(g != h), 0) for k, (g, h) in enumerate(zip(good, held))], "doc_id long, quality int, x int")
    found = {r.doc_id: r for r in quality.judge_quality(documents(spark, texts), labels).collect()}
    assert [found[k].held_out for k in range(600)] == held
    assert sum((found[k].score >= 0.7) == good[k] for k in range(600)) >= 590


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = documents(spark, TEXTS, [None, 1, 1, *range(2, len(TEXTS) - 1)])
    for marks in ([], [(1, 1), (None, 0), (2, None)], [(k, k % 2) for k in range(12)] + [(3, 0), (3, 1)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int")
        first, again = (sorted(quality.judge_quality(docs.repartition(n), labels).collect(), key=repr) for n in (1, 4))
        assert len(first) == len(TEXTS) and all(0 <= r.score <= 1 for r in first)
        assert first == again  # sums of integers: partitions do not matter
    assert quality.judge_quality(docs.limit(0), labels).collect() == []


def test_quality_of_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries.op13_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert found and sum(r.predicted == labels[r.doc_id] for r in found) >= 0.95 * len(found)
