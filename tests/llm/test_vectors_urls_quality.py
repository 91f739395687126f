import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import quality, shared, topk, url_filter, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, score string, kept string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "x", "x", "x") for i, v in rows], VECTORS)


ODD = [(9001, None), (9002, []), (9003, [None] * 8), (9004, [math.nan] * 8), (9005, [math.inf] + [0.0] * 7), (9006, [0.0] * 8), (9007, [1.0] * 3), (None, [0.1] * 8)]


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("n", [3, 60, 700])
def test_top_k_against_plain(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 8)).round(1).astype(np.float32)
    x[n // 2 :: 3] = x[0]  # a hot vector, and ties
    rows = [(i, x[i].tolist()) for i in range(n)] + ODD + [(9100, x[0].tolist())]
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if i is not None and usable(v)}
    want = []
    for q in whole:
        if q % 50 == 0:
            order = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    # The one vector of another length is a candidate of nothing.
    got = topk.top_k(vectors(spark, rows), "vec_id % 50 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((300, 3)), np.zeros((50, 3))])
    t = topk.cover_tree(points)
    assert sorted(t.order.tolist()) == list(range(350))

    def below(n):
        own = t.child[t.begin[n] : t.end[n]]
        return np.concatenate([below(c) for c in own]) if len(own) else t.order[t.first[n] : t.last[n]]

    for n in range(len(t.radius)):
        assert np.sqrt(((points[below(n)] - points[t.centre[n]]) ** 2).sum(axis=1)).max() <= t.radius[n] + 1e-9


def blobs(x):
    return [row.astype("<i8").tobytes() for row in x]


@pytest.mark.parametrize("large", [1, 2**40])
def test_dual_search_prunes_exactly(large):
    """Products beyond 64 bits don't wrap: they are found in whole numbers."""
    rng = np.random.default_rng(2)
    refs = rng.integers(-50, 50, (900, 3)) * (1 if large == 1 else 2**20)
    queries = rng.integers(-50, 50, (40, 3)) * (1 if large == 1 else 2**30)
    got = topk.dual_search(topk.block_of(np.arange(10_000, 10_040), blobs(queries)), np.full(40, -1e30), topk.block_of(np.arange(900), blobs(refs), 6), 5)
    for q in range(40):
        want = sorted((-int(s), i) for i, s in enumerate(refs.astype(object) @ queries[q].astype(object)))[:5]
        assert sorted((-s, i) for qi, i, s in got if qi == 10_000 + q) == want


def test_large_vectors_rank_or_raise(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(0, [2.0**20, 0.0]), (1, [2.0**20, 1.0]), (2, [2.0**21, 0.0])]
    assert [tuple(r) for r in topk.top_k(frame(rows), "vec_id = 0").orderBy("rank").collect()] == [(0, 1, 2, 2**61), (0, 2, 1, 2**60)]
    for bad in (2.0**31, 1e300):
        with pytest.raises(Exception, match="held in a long"):
            topk.top_k(frame([*rows, (3, [bad, 0.0]), (4, [bad, 0.0])]), "vec_id = 3").collect()


def test_an_id_stands_once(spark):
    """Rows of one id with different vectors: the largest score counts, others aren't crowded out."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(1, [float(k), 1.0]) for k in range(2, 30)] + [(i, [0.5, 0.25]) for i in range(2, 14)] * 2
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 29 * 1024**2)] + [(0, k, k, 1024 * 512) for k in range(2, 11)]


def test_blocks_are_of_the_size_meant(spark, monkeypatch):
    """Twice the least number of query blocks at most, and no query lost among many cells."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    made = []
    real = topk.trees
    monkeypatch.setattr(topk, "trees", lambda rows, k: made.append(real(rows, k)) or made[-1])
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 6)).round(1)
    got = topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id % 5 = 0")
    whole = np.floor(1024 * x).astype(int)
    scores = whole[::5] @ whole.T
    want = []
    for q in range(400):
        order = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != 5 * q)[:10]
        want += [(5 * q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("rows", [400, 1700])
def test_number_of_query_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(8)
    pilot = {6: (np.arange(1000), rng.integers(-2000, 2000, (1000, 6)))}
    data = spark.createDataFrame([(i, 6, v.tobytes()) for i, v in enumerate(rng.integers(-2000, 2000, (rows, 6)).astype("<i8"))], "vec_id long, dim int, v binary")
    parts, _ = topk.cut(topk.in_cells(data, pilot, {6: min(topk.PIVOTS, rows // 16)}, 5, True), 16)
    assert parts.select("dim", "cell", "part").distinct().count() <= 2 * rows / 16 + 1


def test_top_k_of_nothing(spark):
    assert topk.top_k(vectors(spark, [(1, [0.1] * 8)]), "vec_id = 1").count() == 0
    assert topk.top_k(vectors(spark, ODD).limit(0), "vec_id % 2 = 0").count() == 0


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 16))
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, 16)) * rng.choice([0.02, 0.15, 0.5], (n, 1))
    x[: n // 4] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize("n", [2, 90, 1500])
def test_vector_links_against_plain(spark, n):
    x = clusters(n, n)
    odd = [(i, v) for i, v in ODD if i != 9007]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in vector_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(n) if (got[i].n_links, got[i].component_id) != (linked[i].sum(), label[i])]
    assert not wrong
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, i is not None) for i, _ in odd)


def test_large_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 16)
    test_vector_links_against_plain(spark, 300)


def test_passes_grow_with_rows():
    assert vector_dedup.passes_for(1000) <= vector_dedup.passes_for(10**6) < vector_dedup.passes_for(10**9) < vector_dedup.passes_for(10**12)


def hot_vectors(n, hot, cosine, pairs, seed=0):
    """Unit vectors of 64 dimensions: the first ``hot`` are at about ``cosine`` from one another, and of these 2 * pairs are pairs at 0.951."""
    rng = np.random.default_rng(seed)
    x = vector_dedup.unit(rng.standard_normal((n, 64)))
    side = x[:hot].copy()
    side[:, 0] = 0
    side = vector_dedup.unit(side)
    other = vector_dedup.unit(side[pairs : 2 * pairs] - (side[pairs : 2 * pairs] * side[:pairs]).sum(axis=1, keepdims=True) * side[:pairs])
    near = (0.951 - cosine) / (1 - cosine)
    side[pairs : 2 * pairs] = near * side[:pairs] + np.sqrt(1 - near**2) * other
    x[:hot] = np.sqrt(1 - cosine) * side
    x[:hot, 0] = np.sqrt(cosine)
    return x


def test_dense_region_is_whole(spark):
    """A third of the rows alike but under the threshold: passes for evenly spread rows miss pairs there."""
    x = hot_vectors(4500, 1500, 0.9, 100).astype(np.float32)
    u = vector_dedup.unit(x.astype(float))
    linked = np.triu(u @ u.T >= 0.95, 1)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    i, j = np.nonzero(linked)
    assert len(i) >= 100 and not [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if got[a].component_id != got[b].component_id]
    assert [got[k].n_links for k in range(len(x))] == (linked | linked.T).sum(axis=1).tolist()


def doubles(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_squares_may_leave_the_doubles(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 1e-210]), (3, [1e200, 1e190]), (4, [1e200, 0.0]), (5, [0.0, 1.0]), (6, [0.0, -1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(doubles(spark, rows)).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_rows_of_one_vec_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (5, [0.0, 0.0, 1.0]), (7, [2.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(doubles(spark, rows)).collect())
    assert got == [(1, 3, 1, True), (5, 0, 5, True), (5, 3, 1, False), (7, 3, 1, False), (7, 3, 1, False)]


def test_coarse_vectors_decide_or_say_so():
    """Certain links are links, and no link is neither certain nor open."""
    rng = np.random.default_rng(3)
    x = vector_dedup.unit(rng.standard_normal((4, 16))[rng.integers(0, 4, 300)] + rng.standard_normal((300, 16)) * 0.25)
    q, error = vector_dedup.coarse(x)
    y, own = vector_dedup.unit(q.astype(float)), np.zeros(300, int)
    assert (np.sqrt(((x - y) ** 2).sum(axis=1)) <= error).all()
    low, may = vector_dedup.window_pairs(y, error, own, 0.95, 64)
    near = np.triu(x @ x.T >= 0.95, 1) & ~np.tri(300, 300, -1, dtype=bool) & (np.arange(300)[None] - np.arange(300)[:, None] <= 64)
    want, opened = vector_dedup.lowest(300, *np.nonzero(near)), {tuple(p) for p in may.tolist()}
    assert all(want[i] == want[low[i]] for i in range(300))
    assert all(low[i] == low[j] or (i, j) in opened for i, j in np.argwhere(near).tolist())
    assert len(opened) < near.sum()


def test_run_bits_against_plain():
    rng = np.random.default_rng(2)
    own = np.repeat([0, 1], [150, 100])
    bits = rng.integers(0, 2, (250, vector_dedup.BITS)) * (rng.random((250, vector_dedup.BITS)) < 0.4)
    keys = np.packbits(bits, axis=1)
    order = np.lexsort((*keys.T[::-1], own))
    keys, bits = keys[order], bits[order]
    got = vector_dedup.run_bits(keys, own, 8)
    for k in range(8, 242):
        runs = [sum(own[i] == own[k] and (bits[i, :n] == bits[k, :n]).all() for i in range(250)) for n in range(vector_dedup.BITS + 1)]
        least = next((n for n, size in enumerate(runs) if size <= 8), vector_dedup.BITS + 1)
        assert got[k] == least
    assert (got[:8] > vector_dedup.BITS).all() and (got[-8:] > vector_dedup.BITS).all()


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(vectors(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7), (None, 3)]
    parent = list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = shared.components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(map(tuple, got.collect())) == {i: find(i) for i in touched}


def test_components_with_hot_nodes(spark, monkeypatch):
    """Stars, whose centres are the smallest, the largest or middling nodes, and a chain between them."""
    monkeypatch.setattr(shared, "HOT_LEAST", 5)
    edges = [(0, i) for i in range(10, 200)] + [(999, i) for i in range(300, 400)] + [(450, i) for i in (*range(401, 450), *range(451, 500))] + [(150, 350), (410, 390)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert set(got.values()) == {0} and len(got) == len({x for e in edges for x in e})


def test_joined_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    label = shared.components(frame([(1, 2), (2, 3), (5, 6), (8, 9)]))
    got = shared.joined_components(label, frame([(3, 6), (9, 20), (1, 2), (30, 31)]))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    same = shared.joined_components(got, frame([(1, 6)]))
    assert same is got


def test_components_of_nothing(spark):
    assert shared.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# URLs

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [
    "http://a.com/x", "https://WWW.Example.com/en/1?q#f", "http://b.example.com/en/", "http://example.com", "http://notexample.com/en/a", "http://x.net/es/1", "http://x.net/ES/1",
    "http://x.net/de/", None, "", "no scheme", "://", "http://user@x.net/fr/?", "http://a.b.c.d.e.net/fr/" + "p/" * 3000, "x://y://z.com/", "http://x.net?/es/", "http://com/",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most", [50_000, 2])
def test_urls_against_plain(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "action string, host string, path string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: plain_verdict(u) for i, u in enumerate(URLS * 2)}


def test_no_pages(spark):
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "action string, host string, path string"), "block").first().verdict == "block"


# Quality


def test_field_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 4, 2])
    starts = np.array([0, 1, 5])
    e, t = rng.standard_normal(7), rng.standard_normal((2, 2))
    got, pairs = quality.marginals(e, starts, lengths, t)
    total = np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        weights, good = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for state in np.ndindex(*(2,) * n):
            w = math.exp(sum(e[s + i] * y for i, y in enumerate(state)) + sum(t[a, b] for a, b in zip(state, state[1:], strict=False)))
            weights += w
            good += w * np.array(state)
            for a, b in zip(state, state[1:], strict=False):
                both[a, b] += w
        assert np.allclose(got[s : s + n], good / weights)
        total += both / weights
    assert np.allclose(pairs, total)


def plain_features(text):
    """The features of each line, one after another, and its weight."""
    lines = text.split("\n")
    out, weights = [], []
    for line in lines:
        raw = line.encode()
        size = len(raw)
        share = lambda chars, raw=raw, size=size: sum(raw.count(c) for c in chars.encode()) / max(size, 1)
        upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
        digit, wide = sum(48 <= b <= 57 for b in raw), sum(b >= 128 for b in raw)
        space, pipe, bang, symbol, stop = (share(c) * size for c in (" \t\r", "|", "!?", "#$%&*@~^=_<>{}[]\\", ".,;:"))
        other = size - upper - lower - digit - wide - space - pipe - bang - symbol - stop
        up = upper / max(upper + lower, 1)
        words = line.split()
        n = len(words)
        different = len(set(words)) / n if n else 0
        top = max(words.count(w) for w in words) / n if n else 0
        runs = sum(a == b for a, b in zip(words, words[1:])) / n if n else 0
        first, last = (line[0].isupper(), words[-1][-1] in ".!?\"'") if n else (0, 0)
        again = (lines.count(line) - 1) / len(lines) if n else 0
        sentences = len(set(line.split(". "))) / len(line.split(". ")) if n else 0
        per = max(size, 1)
        out.append([
            math.log1p(size) / 5, math.log1p(n) / 3, up, up > 0.5, digit / per, space / per, pipe / per * 10, pipe / per > 0.03, bang / per * 10, bang / per > 0.05,
            symbol / per * 5, symbol / per > 0.08, stop / per * 10, wide / per, other / per * 5, different, different < 0.5, top, runs * 3, runs > 0.3, first, last, again * 3, sentences,
        ])
        weights.append(per)
    return np.array(out, float), np.array(weights, float)


def plain_score(field, text):
    """The score by enumeration of all labels of all lines."""
    own, weights = plain_features(text)
    n, zero = len(own), np.zeros(quality.OWN)
    x = [np.concatenate([own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < n else zero, [i == 0, i + 1 == n, 1]]) for i in range(n)]
    e = [float(np.clip(r @ field.w, -30, 30)) for r in x]
    total, good = 0.0, np.zeros(n)
    for state in np.ndindex(*(2,) * n):
        w = math.exp(sum(a * y for a, y in zip(e, state, strict=True)) + sum(field.t[a, b] for a, b in zip(state, state[1:])))
        total += w
        good += w * np.array(state)
    q = (good / total * weights).sum() / weights.sum()
    return 1 / (1 + math.exp(-(field.slope * q + field.bias)))


TEXTS = ["One line of plain words here.", "", "A | B | C\nhead. Head. head.\n\n!!! WOW ### 123 456\nthe the the the end", "É\tü \r\nword " * 3, "x" * 300 + "\nY y. Z z. Y y"]


def test_features_and_scores_against_plain():
    rng = np.random.default_rng(6)
    field = quality.Field(rng.standard_normal(3 * quality.OWN + 3) * 0.5, rng.standard_normal((2, 2)), 3.0, -1.0)
    for text in TEXTS:
        f, w = quality.line_features(text)
        g, v = plain_features(text)
        assert np.allclose(f, g, atol=1e-5) and np.allclose(w, v), text
    assert np.allclose(quality.score_texts(field, TEXTS), [plain_score(field, t) for t in TEXTS], atol=1e-4)


def test_query_scores_against_plain(spark, sf):
    """Scores of the query, for all documents of up to eleven lines, by enumeration of their lines' labels."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.classify(docs, labels).collect()}
    short = [i for i, t in texts.items() if t.count("\n") <= 10]
    assert set(got) == set(texts) and len(short) > 0.6 * len(texts)
    for i in short:
        want = plain_score(field, texts[i])
        assert abs(got[i][0] - want) < 2e-3 and (got[i][1] == int(want >= 0.3) or abs(want - 0.3) < 2e-3)


def test_slopes_by_differences():
    """The fit's gradients are those of the log-likelihood over all labels of all lines."""
    rng = np.random.default_rng(7)
    lengths = np.array([3, 1, 2])
    starts = np.array([0, 3, 4])
    x, y = rng.standard_normal((6, 4)), np.array([1, 0, 0, 1, 0, 1.0])
    field = quality.Field(rng.standard_normal(4), rng.standard_normal((2, 2)))
    seen = np.zeros((2, 2))

    def loss(w, t):
        value = 1e-4 * (w @ w) / 2 + 1e-3 * (t * t).sum() / 2
        for s, n in zip(starts, lengths, strict=True):
            e = x[s : s + n] @ w
            weight = lambda state: sum(e[i] * k for i, k in enumerate(state)) + sum(t[a, b] for a, b in zip(state, state[1:]))  # noqa: E731, B023
            z = math.log(sum(math.exp(weight(state)) for state in np.ndindex(*(2,) * n)))
            value -= (weight(tuple(y[s : s + n].astype(int))) - z) / len(x)
        return value

    for s, n in zip(starts, lengths, strict=True):
        for a, b in zip(y[s : s + n].astype(int), y[s + 1 : s + n].astype(int)):
            seen[a, b] += 1
    gw, gt = quality.slopes(field, x, y, starts, lengths, seen)
    step = 1e-5
    for k in range(4):
        d = np.eye(4)[k] * step
        assert abs((loss(field.w + d, field.t) - loss(field.w - d, field.t)) / (2 * step) - gw[k]) < 1e-6
    for a, b in np.ndindex(2, 2):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert abs((loss(field.w, field.t + d) - loss(field.w, field.t - d)) / (2 * step) - gt[a, b]) < 1e-6


def test_training_takes_whole_documents_within_its_bounds(spark, monkeypatch):
    """Rows of one id count once and never reach the driver; documents are fitted whole, with their true neighbours, or not at all."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda documents: seen.append(documents) or quality.Field(np.zeros(3 * quality.OWN + 3), np.zeros((2, 2))))
    ids = [i for i in range(100) if not __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    long, many, others = ids[0], ids[1], ids[2:12]
    rows = [(long, "line\n" * 5000), *[(many, "a\nb\nc")] * 300, (many, "a\nb\nc\nd"), *[(i, "\n".join(f"l{k}" for k in range(600))) for i in others], (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [long, many, *others]], "doc_id long, quality int")
    quality.train(docs, labels)
    assert sorted(len(f) for f, _, _ in seen[0]) == [3] + [600] * 10
    monkeypatch.setattr(quality, "TRAIN_LINES", 2000)
    quality.train(docs, labels)
    assert sum(len(f) for f, _, _ in seen[1]) <= 2000 and all(len(f) in (3, 600) for f, _, _ in seen[1])
    want = quality.line_features("\n".join(f"l{k}" for k in range(600)))[0]
    assert all((f == want).all() for f, _, _ in seen[0] if len(f) == 600)
    text_ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    quality.train(text_ids, labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality"))
    assert len(seen[2]) and all(len(f) in (3, 600) for f, _, _ in seen[2])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.95
    assert sum(r.predicted == 0 for r in got if r.quality == 1) <= 0.02 * len(got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a line\n" * 3, "x"), (3, "a line\n" * 3, "x"), (4, "w " * 40_000, "x")], "doc_id long, text string, score string")
    for rows in ([], [(1, 1), (2, None)], [(1, 0), (6, 0)]):
        got = quality.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_held_out_rule(spark):
    import zlib

    ids = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
