"""Operators over the whole corpus against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np

from lexweave.llm import embeddings, mixing, ngrams, urls
from lexweave.llm.components import components
from tests.llm.fixtures import corpus, frame, write


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    other = [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + other + chain, "a long, b long")).collect()}
    links = [e for e in chain + other if e[0] != e[1]]
    assert got == union({n for e in links for n in e}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_truth(rows):
    sets = {row[0]: shingles(row[1]) for row in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, union(ids, links)


def check_ngrams(spark, rows):
    sets, root = jaccard_truth(rows)
    got = ngrams.linked_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]), r


def test_ngram_join(spark):
    check_ngrams(spark, corpus())


def test_ngram_join_on_chains_and_common_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(40))
    rows, text = [], [word() for _ in range(60)]
    for i in range(60):  # each near the one before, far from the first
        text = [word() if r.random() < 0.02 else w for w in text]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, common + " " + " ".join(word() for _ in range(r.choice([4, 8, 12, 30])))) for i in range(40)]
    check_ngrams(spark, [(i, t, None, None, None, None, None, None, None) for i, t in rows])


def test_ngram_edges(spark):
    assert ngrams.linked_components(frame(spark, [])).count() == 0
    kept = ngrams.one_of_each(frame(spark))
    _, root = jaccard_truth(corpus())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert kept.columns == frame(spark).columns


def test_divide_skip():
    r = np.random.default_rng(4)
    for _ in range(100):
        query = np.unique(r.integers(0, 60, 30))
        records = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(12)]
        needs = [int(x) for x in r.integers(1, 15, 12)]
        truth = [i for i, x in enumerate(records) if len(np.intersect1d(x, query)) >= needs[i]]
        assert sorted(ngrams.divide_skip(query, records, needs)) == truth


def vectors():
    r = np.random.default_rng(8)
    rows = []
    base = r.standard_normal((30, 16))
    for i in range(300):
        v = base[i % 30] + r.standard_normal(16) * r.choice([0.02, 0.15, 0.3])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    rows += [(400 + i, rows[0][1], 0) for i in range(40)]  # a common vector
    bad = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] * 16]
    rows += [(500 + i, v, 0) for i, v in enumerate(bad)] + [(600, rows[0][1], None), (601, [1.0, 2.0], 0), (602, [2.0, 4.0], 0)]
    return rows


def test_embeddings(spark):
    rows = vectors()
    ok = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.93
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and cos(ok[a][0], ok[b][0])]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = union([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    for tile, cell in ((1024, 256), (16, 256)):  # the whole, and chunks of cells
        got = embeddings.near_duplicates(df, tile=tile, cell=cell).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], root[i], root[i] == i) for i, _, _ in rows}
    found = embeddings.near_duplicates(df, cell=16)  # several tables of cells
    assert sum(r.n_links for r in found.collect()) >= 0.95 * 2 * len(links)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.02], 0), (3, [1e300, 0.0], 0), (4, [1.0 + 1e-12, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in got)) == [(0, 3, 1), (1, 0, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4)]


def test_collision_counts_equal_a_plain_count():
    r = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.standard_normal((40, 8)), r.standard_normal((60, 8))))
    directions = np.random.default_rng([embeddings.SEED, 1, 8]).standard_normal((8, embeddings.LINES))
    reach = embeddings.REACH * math.sqrt(2 - 2 * 0.93)
    met = (np.abs((a @ directions)[:, None] - (b @ directions)[None]) <= reach).sum(2)
    i, j = embeddings.collision_pairs(a, b, 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(met >= embeddings.least_collisions())), strict=True))
    met = (np.abs((b @ directions)[:, None] - (b @ directions)[None]) <= reach).sum(2)
    i, j = embeddings.collision_pairs(b, None, 0.93)
    truth = [(x, y) for x, y in zip(*(v.tolist() for v in np.nonzero(met >= embeddings.least_collisions())), strict=True) if x < y]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == truth and truth


def test_collision_calibration():
    assert embeddings.tables_for(1)[1] == 1
    bits, tables = embeddings.tables_for(1_000_000)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= embeddings.RECALL
    r = np.random.default_rng(0)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal((2000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    hit = sum(len(embeddings.collision_pairs(a[i : i + 1], b[i : i + 1], 0.93)[0]) for i in range(2000))
    assert hit >= 0.98 * 2000


def test_mixing(spark):
    rows = corpus()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = defaultdict(int)
    for row in rows:
        of[row[3]] += size(row[1])
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(of.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * of[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * of[s]
            rest -= target[s]
        free -= set(over)
    target |= share
    got = mixing.assign(frame(spark), buckets=4).collect()
    assert len(got) == len(rows)
    source = {row[0]: row[3] for row in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == of[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    again = mixing.assign(frame(spark), buckets=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert mixing.assign(frame(spark, [])).count() == 0
    mixed = mixing.mix(frame(spark))
    assert mixed.columns == frame(spark).columns and mixed.count() > 0


def test_schedule_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 2.0), (0.3, 0.5), (1.0, 1.0))
    steps = np.linspace(0, 1, 100_001)
    w = np.interp(steps, *zip(*knots, strict=True))
    due = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
    due /= due[-1]
    shares = [0.0, 0.1, 0.37, 0.5, 0.93, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.time_of(F.col("s"), mixing._segments(knots)).alias("t"))
    for r in df.collect():
        assert abs(r.t - np.interp(r.s, due, steps)) < 1e-4


def test_url_rules_and_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [
        (1, "http://A.org/x?y", link("friend.net")),
        (2, "https://www.example.org/es/1", ""),
        (3, "http://example.org/en/12", ""),
        (4, "http://a.com/fr/1", ""),
        (5, "http://a.com/de/1", link("friend.net")),
        (6, "http://a.com/de/2", None),
        (7, "http://a.com/xx", ""),
        (8, "http://friend.net/", ""),
        (9, "http://linker.net/", link("b.com")),
        (10, "http://b.com/de/", ""),
        (11, None, link("b.com")),
        (12, "no scheme", ""),
        (13, "http://org", ""),
        (14, "http://x.org:80/", ""),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    rule = {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "com/fr/", 5: "com/de/", 6: "com/de/", 10: "com/de/"}
    assert {i: r.rule for i, r in got.items() if r.rule} == rule
    blocked = {2, 3, 5, 6, 10, 9}  # linker.net links to a blocked host
    assert {i for i, r in got.items() if r.verdict == "block"} - {7} == blocked
    assert got[7].verdict == "allow" if got[7].score >= 0.5 else got[7].verdict == "block"
    assert got[8].verdict == "allow"  # friend.net has trust and links to nobody
    assert (got[1].host, got[1].path) == ("a.org", "/x") and (got[11].host, got[12].path) == ("", "") and got[13].path == ""
    assert urls.judge(df.limit(0)).count() == 0


def test_url_hot_hosts_are_dealt(spark):
    link = '<a href="http://bad.com/de/x">' + "y" * 50_000
    pages = [(i, f"http://hot.net/{i}", link if i % 50 == 0 else None) for i in range(400)] + [(1000, "http://bad.com/de/x", ""), (1000, "http://bad.com/de/x", ""), (None, "http://rare.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    hot = {r.host: r.salts for r in urls.hot_hosts(df.select(urls.host_of(df.url).alias("host")).groupBy("host").count()).collect()}
    assert hot["hot.net"] == math.ceil(400 * 1024 / 403) and len(hot) < urls.SHARE
    got = urls.judge(df).collect()
    assert len(got) == len(pages) and {r.verdict for r in got if r.host == "hot.net"} == {"block"}
    assert sorted((r.host, r.verdict) for r in got if r.host != "hot.net") == [("bad.com", "block")] * 2 + [("rare.net", "allow")]
