import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import ann, mixing, near_dedup, quality, vocab
from lintlake.llm.components import components
from tests.llm.cases import LOREM, empty, hard, rows_of, words


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts():
    """Groups around the threshold, short and long, so that every band and tile is used."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for size in (1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 600):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for edits in (0, 1, 1, 2, 3, 5):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts[n] = " ".join(copy)
                n += 1
    return texts


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in rows_of(near_dedup.near_duplicates(spark, docs))}
    assert got == want
    monkeypatch.setattr(near_dedup, "BUCKET_TILE", 3)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 50)
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in rows_of(near_dedup.near_duplicates(spark, docs))}
    assert got == want


def test_near_duplicates_get_through_hard_rows(spark):
    got = rows_of(near_dedup.near_duplicates(spark, hard(spark)))
    assert len(got) == hard(spark).count()
    by_id = {g["doc_id"]: g for g in got if g["doc_id"] is not None}
    assert {by_id[i]["component_id"] for i in (0, 1, 2, 3)} == {0}
    assert by_id[8]["component_id"] == by_id[9]["component_id"] == 8
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (5, 6, 7))
    assert all(g["component_id"] is None and g["kept"] for g in got if g["doc_id"] is None)
    assert rows_of(near_dedup.near_duplicates(spark, empty(spark))) == []
    assert set(near_dedup.deduplicate(spark, hard(spark)).columns) == set(hard(spark).columns)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (10, 200, 3000):
        pool = rng.integers(1, 1 << 63, size * 2).astype(np.uint64)
        found = []
        for k in range(60):
            pick = rng.permutation(pool)
            a, b = np.unique(pick[:size]), np.unique(pick[size // 8 : size + size // 8])
            r = near_dedup.registers([a, b])
            found.append((r[0] == r[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(found)) < 0.03


def test_spanning_forest_connects_exactly_what_links():
    rng = random.Random(1)
    for _ in range(30):
        n = 25
        links = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.06}
        linked = lambda i, others: np.array([(max(i, j), min(i, j)) in links for j in others], bool)
        edges = near_dedup.spanning_forest(n, linked)

        def classes(pairs):
            group = list(range(n))
            for a, b in pairs:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
            return sorted(Counter(group).values())

        assert classes(edges) == classes(links)
        assert all((max(e), min(e)) in links for e in edges)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (50, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in rows_of(components(df))}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 90, 95: 90, 60: 50}
    assert rows_of(components(df.limit(0))) == []


def test_nearest_neighbours_recall_and_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = defaultdict(list)
    for r in rows_of(ann.nearest(spark, table, F.col("vec_id") % 10 == 0)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in rows_of(table)}
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids])
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((matrix - rows[q]) ** 2).sum(axis=1))
        best = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(f[2] - np.linalg.norm(rows[f[1]] - rows[q])) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(best))
        total += 10
    assert len(got) == 50 and hits / total >= 0.9


def test_nearest_neighbours_of_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 4), 0.5]) for i in range(0, 40)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [None, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (200, [1.0, 2.0]), (0, [1.0, 0.0, 0.5])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, bucket string")
    got = defaultdict(list)
    for r in rows_of(ann.nearest(spark, table, F.col("vec_id") % 20 == 0, k=12)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    assert set(got) == {0, 20}
    same = [i for i in range(0, 40, 4) if i != 20]
    near = [1, 5, 9]
    assert [v for _, v, _ in sorted(got[20])] == same + near
    few = rows_of(ann.nearest(spark, table.where("vec_id in (1, 20, 2)"), F.col("vec_id") % 20 == 0))
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    tiled = rows_of(ann.nearest(spark, table, F.col("vec_id") % 20 == 0, k=12, tile_rows=3))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in tiled) == sorted((q, r, v) for q, f in got.items() for r, v, _ in f)
    assert rows_of(ann.nearest(spark, table.limit(0), F.col("vec_id") % 20 == 0)) == []


def test_nearest_neighbours_with_ids_repeated_more_than_k_times(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.1])] + [(1, [1.0, 0.001 * i, 0.1]) for i in range(1, 31)]
    rows += [(i, [1.0, 0.5 + 0.01 * i, 0.1]) for i in range(2, 12)] + [(1, rng.normal(size=3).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(rows_of(ann.nearest(spark, table, F.col("vec_id") == 0, k=5)), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]
    assert abs(got[0]["score"] - 0.001) < 1e-12


def test_nearest_neighbours_recall_with_unequal_lengths(spark):
    rng = np.random.default_rng(11)
    matrix = rng.normal(size=(1500, 64))
    matrix *= (np.exp(rng.normal(size=1500)) / np.linalg.norm(matrix, axis=1))[:, None]
    matrix[::30] *= (5 / np.linalg.norm(matrix[::30], axis=1))[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    hits = 0
    for r in rows_of(ann.nearest(spark, table, F.col("vec_id") % 30 == 0)):
        d = np.sqrt(((matrix - matrix[r["query_id"]]) ** 2).sum(axis=1))
        hits += r["vec_id"] in np.argsort(d)[1:11]
    assert hits / 500 >= 0.99


def plain_targets(sizes, weights, total):
    order = sorted((s is None, s or "") for s in sizes)
    names = [None if n else s for n, s in order]
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = total - sum(2.0 * sizes[s] for s in full)
        w = sum(share[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * share[s] / w for s in names}
        over = [s for s in names if s not in full and target[s] > 2 * sizes[s]]
        if not over:
            return target
        full |= set(over)


def test_mix_hits_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12000):
        source = rng.choice(["a", "a", "a", "a", "b", "c", None, "e"]) if i else "tiny"
        rows.append((i, "w " * rng.randrange(0, 30), source))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = rows_of(mixing.mix(spark, docs))
    assert sorted(g["doc_id"] for g in got) == list(range(12000))
    sizes, taken, target = Counter(), Counter(), {}
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"]
        sizes[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        target[g["source"]] = g["target"]
    want = plain_targets(dict(sizes), mixing.WEIGHTS, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 30
    again = rows_of(mixing.mix(spark, docs.repartition(3)))
    key = lambda g: (g["doc_id"], g["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_gets_through_hard_rows(spark):
    docs = hard(spark)
    got = rows_of(mixing.mix(spark, docs))
    assert len(got) == docs.count() and all(g["taken"] <= 2 * g["size"] for g in got)
    copies = sum(g["copies"] for g in got)
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns and out.count() == copies
    assert rows_of(mixing.mix(spark, empty(spark))) == []


def test_pivotal_rounding_keeps_expectation_and_sum():
    rng = np.random.default_rng(0)
    parts, sizes = np.full(9, 0.3), np.array([1.0, 5, 2, 8, 3, 3, 9, 4, 1])
    mean = np.zeros(9)
    for _ in range(4000):
        out, held = mixing._rounded(parts, sizes, rng)
        assert abs((out * sizes).sum() - 0.3 * sizes.sum()) < 1e-6
        assert sum(0 < p < 1 for p in out) <= 1
        mean += out
    assert np.abs(mean / 4000 - 0.3).max() < 0.04


def plain_exact(rows):
    """Of equal texts the row with most code points, then the smallest id."""
    best = {}
    for r in rows:
        key = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        rank = (-len(r["text"] or ""), r["doc_id"])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def test_pipeline_stages_equal_plain_versions(spark):
    """Every stage on what the one before it left: exact and near duplicates and targets against plain versions."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = stages[0](spark, docs, sf).cache()
    scores = {r["doc_id"]: r["score"] for r in quality.classify(spark, docs, labels).collect()}
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"]: r for r in good.collect()} == {i: r for i, r in whole.items() if scores[i] >= quality.THRESHOLD}
    distinct = stages[1](spark, good, sf).cache()
    rows = plain_exact(good.collect())
    assert sorted(distinct.collect()) == sorted(rows)
    single = stages[2](spark, distinct, sf).cache()
    roots = brute_components({r["doc_id"]: r["text"] for r in rows})
    kept = [r for r in rows if roots[r["doc_id"]][1] == r["doc_id"]]
    assert sorted(single.collect()) == sorted(kept)
    mixed = stages[3](spark, single, sf).cache()
    sizes, taken = Counter(), Counter()
    for r in kept:
        sizes[r["source"]] += len(words(r["text"]))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    longest = Counter()
    for r in kept:
        n = len(words(r["text"]))
        taken[r["source"]] += n * copies[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], n)
    want = plain_targets(dict(sizes), mixing.WEIGHTS, mixing.EPOCHS * sum(sizes.values()))
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in kept}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    tokenizer = vocab.load(vocab.tokenizer_path("word_bpe_49k.json"))
    ids = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept}
    covered = Counter()
    for r in stages[4](spark, mixed, sf).collect():
        covered.update((r["doc_id"], at) for at in range(r["start"], r["start"] + r["length"]))
    assert covered == Counter({(d, at): n for d, n in copies.items() for at in range(ids[d])})
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_small_sets_lose_no_links():
    """At exactly three quarters, pairs of few shingles share a band and pass the estimate, as the larger ones do."""
    rng = np.random.default_rng(6)
    lost = Counter()
    for size in (4, 8, 16, 32, 64):
        for _ in range(400):
            both = rng.integers(1, 1 << 63, size).astype(np.uint64)
            a, b = np.sort(both), np.sort(both[: size * 3 // 4])
            r = near_dedup.small_registers([a, b]).reshape(2, -1, near_dedup.BAND_ROWS)
            close = ((r[0] == r[1]).mean() - near_dedup.COLLISION) / (1 - near_dedup.COLLISION) >= near_dedup.LEAST_ESTIMATE
            lost[size] += not (close and (r[0] == r[1]).all(axis=1).any())
    assert sum(lost.values()) <= 1, lost


def test_distances_that_overflow_are_found(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [0.0, 1e300]), (3, [1e-200, 1e-200]), (4, [2e-200, 1e-200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(rows_of(ann.nearest(spark, table, F.col("vec_id") == 0, k=4)), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [3, 4, 2, 1] and abs(got[-1]["score"] / 2e300 - 1) < 1e-12
    tiny = rows_of(ann.nearest(spark, table.where("vec_id > 2"), F.col("vec_id") == 3, k=1))
    assert abs(tiny[0]["score"] / 1e-200 - 1) < 1e-12


def test_lorem_is_long_enough():
    assert len(LOREM.split()) > 20
