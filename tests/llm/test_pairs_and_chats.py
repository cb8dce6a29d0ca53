"""Vectors, conversations, components and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import chat_format, components, simhash, vector_dedup


def brute_roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(35)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [(a, b) for a, b in edges if a is not None]
    truth = brute_roots({x for e in clean for x in e}, clean)
    assert found == {n: r for n, r in truth.items() if n != r}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def lone_pairs(n, pairs, seed, cosine=0.94, dims=64):
    """Random unit vectors, the first of which have one near neighbour each and no other."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = x[pairs : 2 * pairs] - np.sum(x[pairs : 2 * pairs] * x[:pairs], axis=1, keepdims=True) * x[:pairs]
    x[pairs : 2 * pairs] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return x


def test_lone_pairs_meet_in_large_groups(spark):
    """A pair that no other neighbour leads to is found by its codes, whose length and number follow the group."""
    x = lone_pairs(4000, 150, 3)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.component_id for r in vector_dedup.near_duplicates(df).where("n_links > 0").collect()}
    met = sum(found.get(k + 150) == k for k in range(150))
    assert met >= 147 and set(found) <= set(range(300))


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(rng.standard_normal((120, 16)))]
        for size, noise in ((30, 0.05), (2, 0.01), (25, 0.09)):
            base = rng.standard_normal(16)
            rows += [(len(rows) + k, (base + noise * rng.standard_normal(16)).tolist(), label) for k in range(size)]
    rows += [(900, rows[3][1], rows[3][2]), (901, [2 * x for x in rows[3][1]], rows[3][2])]
    bad = [(910, None, 0), (911, [0.0] * 16, 0), (912, [float("nan")] * 16, 0), (913, [None] + [1.0] * 15, 0), (914, rows[3][1], None), (915, [], 0), (916, [1.0, 2.0], 0), (917, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, label int, node int, size int")
    found = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(found) == len(rows) + len(bad)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    edges = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    roots = brute_roots(unit, edges)
    links = {i: sum(i in e for e in edges) for i in unit}
    assert {i: (found[i].n_links, found[i].component_id, found[i].kept) for i in unit} == {i: (links[i], roots[i], roots[i] == i) for i in unit}
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i, _, _ in bad)
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def dense_clusters(rng):
    """Two clusters of near vectors, each over any list's length, with few links between them, and
    single vectors; 16 dimensions."""
    base, other = np.eye(16)[0], np.eye(16)[1]
    angle = 0.3
    second = np.cos(angle) * base + np.sin(angle) * other
    rows = [base + 0.016 * rng.standard_normal(16) for _ in range(150)] + [second + 0.016 * rng.standard_normal(16) for _ in range(150)]
    return rows + list(rng.standard_normal((60, 16)))


@pytest.mark.parametrize("exact", [False, True])
def test_dense_clusters_and_exact_fallback(spark, monkeypatch, exact):
    """Clusters that fill their lists with their own members; exact: lists find nothing, so that
    the comparison in blocks has to."""
    if exact:
        monkeypatch.setattr(vector_dedup, "_round", lambda nodes, lists, turn: lists.select("src", "dst", "sim").where("false"))
        monkeypatch.setattr(vector_dedup, "_first_lists", lambda nodes, seed: nodes.selectExpr("node as src", "node as dst", "0D as sim").where("false"))
        monkeypatch.setattr(vector_dedup, "BLOCK", 50)
    vectors = dense_clusters(np.random.default_rng(4))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    edges = [(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.93)) if i < j]
    roots, links = brute_roots(range(len(vectors)), edges), Counter(i for e in edges for i in e)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert roots[299] == 0 and found == {i: (links[i], roots[i]) for i in roots}


def check_tree(nodes):
    """Depth-first, each node once; its ancestors' intervals are those of the path that its digest names."""
    assert nodes[0].stream_start == 0 and all(a.stream_end == b.stream_start for a, b in zip(nodes, nodes[1:]))
    assert len({n.node for n in nodes}) == len(nodes)
    path = []
    for n in nodes:
        del path[n.depth :]
        assert len(path) == n.depth and n.position == sum(len(x.formatted) for x in path)
        starts, stops = (np.array([getattr(x, k) for x in path], np.int64) for k in ("stream_start", "stream_end"))
        assert chat_format.merged(*(np.array([getattr(a, k) for a in n.ancestors], np.int64) for k in ("start", "end"))) == chat_format.merged(starts, stops)
        path.append(n)


@pytest.mark.parametrize("range_chars", [64 << 20, 300])
def test_chat_trees(spark, range_chars):
    """Random trees of few distinct turns, a hot first turn, equal conversations, prefixes of others,
    and one conversation of many turns; one range and many."""
    rng = random.Random(5)
    rows = []
    for c in range(120):
        n = rng.randint(1, 6)
        texts = ["start" if c % 3 else f"s{c % 5}"] + [rng.choice("ab") for _ in range(n - 1)]
        rows += [(c, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    rows += [(1000 + c, k, ("user", "assistant")[k % 2], "start" if not k else "a") for c in range(40) for k in range(4)]
    rows += [(2000, k, ("user", "assistant")[k % 2], f"<{k}#") for k in range(3000)] + [(2001, 0, "user", "y" * 300_000), (2001, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = chat_format.layout(df, range_chars=range_chars)
    found = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((r, t))
    assert set(found) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    nodes = sorted(out.nodes.collect(), key=lambda n: n.stream_start)
    assert len(nodes) == len({tuple(t[: k + 1]) for c, t in by.items() if c < 2000 for k in range(len(t))}) + 3002
    if range_chars < 1000:
        assert len({n.range for n in nodes}) > 20
    check_tree(nodes)


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (2, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "else"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (5, None, None, None), (5, 0, "ro:le\n", ""), (5, 0, "assistant", ""), (6, 0, "user", "x" * 20_000 + "\\"), (None, 0, "assistant", "é漢")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, leaf int")
    out = chat_format.layout(df)
    found = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(chat_format.format_turn(r, x)[0] for _, r, x in turns)
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss), len(whole))
    nodes = sorted(out.nodes.collect(), key=lambda n: n.stream_start)
    shared = [n for n in nodes if chat_format.parse(n.formatted) == [("user", "hi")]]
    assert len(shared) == 1
    check_tree(nodes)
    assert chat_format.read_back(chat_format.layout(df.where("false"))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice(["th", "an", "ing", "or", "es", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item, copy = prose(40), prose(60)
    rows = [(k, prose(80), "en", "s", 0) for k in range(30)] + [(100, copy, "en", "s", 0), (101, copy, "en", "s", 0), (102, prose(30) + " " + item + " " + prose(20), "en", "s", 0), (103, prose(30) + ' password = "abcdefghijklmnop" ' + prose(5), "en", "s", 0), (104, None, "en", "s", 0), (105, "12 !", None, None, None), (None, prose(50), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    left = {r.doc_id: r for r in step.collect()}
    assert set(left) == set(range(30)) | {100, 103, None}
    assert "[assign]" in left[103].text and left[103].n_chars == len(left[103].text)
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == set(left) and done[103].decoded == left[103].text
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0, name


def test_pipeline_rows_of_no_or_one_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice(["th", "an", "ing", "or", "es", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item, copy, other, clean, twin = (prose(n) for n in (40, 60, 60, 60, 60))
    leak = prose(20) + " " + item + " " + prose(20)
    docs = spark.createDataFrame([(1, copy), (None, copy), (2, other), (2, other), (3, clean), (3, copy), (4, twin), (4, leak), (None, leak)], "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    once = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert rows(once) == sorted([(1, copy), (2, other), (3, clean), (4, twin), (4, leak)])
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert rows(left) == sorted([(1, copy), (0, copy), (2, other), (2, other), (3, clean), (3, copy), (4, twin)])


def edited_copies():
    """Groups of near-copies about the similarity of 0.8, chains, a passage that many share, and
    short texts; with the set of 5-word shingles of each."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, passage = [], [word() for _ in range(30)]
    for size in (40, 120, 300):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for edits in (0, 1, 2, 3, 4, 5, size // 40, size // 30, size // 20):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(len(own))] = word()
                texts.append(own)
                base = own if rng.random() < 0.3 else base  # a chain
    texts += [[word() for _ in range(20)] + passage + [word() for _ in range(30)] for _ in range(25)]
    texts += [[word() for _ in range(k % 9)] for k in range(18)] + [list("abcdefgh"), list("abcdefghi"), list("abcdefg")]
    return [" ".join(t) for t in texts], [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]


@pytest.mark.parametrize("bucket", [64, 3])
def test_similar_texts(spark, bucket):
    """Against all pairs: nothing is joined that brute force keeps apart, and at least 0.9 of the
    pairs are joined, as the fingerprints are samples."""
    texts, sets = edited_copies()
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(1000, None, 1, 2), (1001, " ", 1, 2)], "doc_id long, text string, node int, fp int")
    found = {r.doc_id: r.component_id for r in simhash.similar(docs, bucket=bucket).collect()}
    empty, roots = texts.index(""), brute_roots(range(len(texts)), edges)
    assert {found[i] for i in (1000, 1001)} == {empty}
    assert all(roots[found[i]] == roots[i] for i in roots)
    assert sum(found[i] == found[j] for i, j in edges) >= 0.9 * len(edges)
    assert all(found[i] == found[j] for i, j in edges if sets[i] == sets[j])
    assert simhash.similar(docs.where("false")).count() == 0


def test_pipeline_drops_edited_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:100] + ["x"] + base[101:150] + ["y", "z"] + base[150:])), (3, " ".join(base[:120]))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}
