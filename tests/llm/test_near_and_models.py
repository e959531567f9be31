"""Near copies, vectors, archives, trained models and the pipeline: edge cases, against brute force, held-out accuracy."""

import base64
import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, graph, hnsw, language_id, near_dedup, toxicity, warc
from tidemark.llm.common import Workspace

DATA = "/root/testdata/sf0.001"


def roots(pairs):
    """Smallest member of each one's component."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(7, k) for k in range(8, 200)] + [(3, 150)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(160)], "none": [(5, 5)]}[kind]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "graph"))
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert {r.id: r.root for r in got.collect()} == want


# Near copies


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(800):
        a = [rng.randrange(rng.choice([3, 1000])) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(1000)] * rng.randrange(2)
        if b:
            c = lcs(a, b)
            assert near_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (c / (len(a) + len(b) - c) >= 0.8 - 1e-12)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    common = " ".join(rng.choice(vocab) for _ in range(60))
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 40, 120, 400]))]
        texts.append(" ".join(base))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 6)):
                copy = list(base)
                for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
                texts.append(" ".join(copy))
        if rng.random() < 0.3:
            texts.append(common + " " + " ".join(rng.choice(vocab) for _ in range(50)))
    rng.shuffle(texts)
    return texts


def brute_classes(rows):
    """Classes of (id, text) rows by comparing all pairs."""
    seqs = [(i, near_dedup.shingles(w)) for (i, t), w in zip(rows, near_dedup.word_hashes([t or "" for _, t in rows]), strict=True)]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations([s for s in seqs if len(s[1]) and s[0] is not None], 2) if a == b or near_dedup.similar(x, y)]
    return roots(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed))) + [(900, None), (901, ""), (902, " \n\t "), (903, ""), (904, "word"), (905, "WORD "), (906, "two words"), (907, "long " * 30_000), (908, "long " * 30_000 + "end"), (None, "word"), (909, "same row"), (909, "same row"), (910, "one id " * 9), (910, "two texts " * 9)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, class_id string, _k string").repartition(3)
    out = near_dedup.near_dedup(df)
    assert out.columns == ["doc_id", "text", "class_id", "_k", "class_id_", "kept"] and out.count() == len(rows)
    want = brute_classes(rows)
    for r in out.collect():
        c = None if r.doc_id is None else want.get(r.doc_id, r.doc_id)
        assert (r.class_id_, r.kept) == (c, r.doc_id is None or c == r.doc_id), r.doc_id
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [32, 1024])
@pytest.mark.parametrize("common, own", [(440, 70), (450, 60)])
def test_pairs_that_share_a_template(spark, monkeypatch, block, common, own):
    """Near-copy pairs of which every text shares most of its words with all others, at just below the similarity."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(common)
    template = [f"t{k}" for k in range(common)]
    rows = []
    for k in range(150):
        first = [f"own{k}.{j}" for j in range(own)]
        second = list(first)
        for j in rng.sample(range(own), 3):
            second[j] = "edited"
        rows += [(2 * k, " ".join(first + template)), (2 * k + 1, " ".join(second + template))]
    heads = [near_dedup.shingles(near_dedup.word_hashes([t])[0]) for _, t in rows[:40:2]]
    assert not any(near_dedup.similar(a, b) for a, b in itertools.combinations(heads, 2))
    got = {r.k: r["class"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(c in (k, k - k % 2) for k, c in got.items())
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 149


def test_a_repeat_leaves_the_other_labels_alone():
    s = np.array([5, 9, 7, 9, 11, 9], np.uint64)
    own = near_dedup.labelled(s)
    assert own[[0, 1, 2, 4]].tolist() == [5, 9, 7, 11] and len(set(own.tolist())) == 6
    words = [f"r{k}" for k in range(300)]
    a, b = (near_dedup.shingles(w) for w in near_dedup.word_hashes([" ".join(words), " ".join(words + words[:6])]))
    assert near_dedup.similar(a, b) and (near_dedup.sketches(a) == near_dedup.sketches(b)).sum() > 6


def test_counting_shingles_in_common(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rng = random.Random(8)
    seqs = [np.array([rng.randrange(rng.choice([4, 40, 400])) for _ in range(rng.randrange(1, 60))], np.uint64) for _ in range(50)]
    bags = [Counter(s.tolist()) for s in seqs]
    left, right = np.arange(0, 50, 2), np.arange(50)
    for rare in (1, 3, 16, 100):
        monkeypatch.setattr(near_dedup, "RARE", rare)
        got = near_dedup.in_common(seqs, left, right)
        assert all(got[a, b] == sum((bags[i] & bags[j]).values()) for a, i in enumerate(left) for b, j in enumerate(right) if i != j)


def test_long_texts_are_aligned_in_a_band():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 60, 400_000, np.uint64)
    b = np.delete(a, rng.choice(len(a), 20_000, replace=False))
    start = time.perf_counter()
    assert near_dedup.similar(a, b)
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("block", [16, 256])
def test_edited_copies_without_their_original(spark, monkeypatch, block):
    """Copies that only some of the others are similar to, and no text that all are similar to."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"o{k}" for k in range(200)]
    rows = []
    for k in range(160):
        copy = list(base)
        for j in rng.sample(range(200), 3):
            copy[j] = f"own{k}.{j}"
        rows.append((k, " ".join(copy)))
    want = brute_classes(rows)
    assert len(want) > 100 and len(set(want.values())) > 1
    got = {r.k: r["class"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: want.get(k, k) for k, _ in rows}


def test_registered_op3(spark, tmp_path):
    rows = list(enumerate(corpus(5, 25))) + [(800, None), (801, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.op3(spark, str(tmp_path)).collect()}
    assert got == {k: (want.get(k, k), want.get(k, k) == k) for k, _ in rows}


def test_sketches_find_what_is_similar():
    rng, found, n = random.Random(9), 0, 0
    for _ in range(400):
        a = [f"v{rng.randrange(10_000)}" for _ in range(150)]
        b = list(a)
        for _ in range(3):
            b[rng.randrange(150)] = "changed"
        x, y = (near_dedup.shingles(w) for w in near_dedup.word_hashes([" ".join(a), " ".join(b)]))
        if near_dedup.similar(x, y):
            n += 1
            found += bool((near_dedup.sketches(x) == near_dedup.sketches(y)).any())
    assert n > 100 and found / n > 0.99


def test_shuffled_text_is_no_copy():
    rng = random.Random(3)
    parts = [" ".join(f"q{rng.randrange(9999)}" for _ in range(30)) for _ in range(8)]
    x, y = (near_dedup.shingles(w) for w in near_dedup.word_hashes([" ".join(parts), " ".join(reversed(parts))]))
    assert not near_dedup.similar(x, y)


# Vectors


def vectors(seed=1, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    near = x[:40].repeat(4, 0) + rng.normal(scale=0.08, size=(160, d)).astype(np.float32)
    return [v.tolist() for v in np.concatenate([x, near, x[:10], x[:1].repeat(60, 0)])]


BAD = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    v = vectors()
    rows = [(k * 2, x, 1) for k, x in enumerate(v)] + [(5000 + k, x, 1) for k, x in enumerate(BAD)] + [(None, v[0], 1), (7001, v[0][:8], 1), (7002, v[0][:8], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = roots([(int(a) * 2, int(b) * 2) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {k * 2: (int(near[k].sum()), comp.get(k * 2, k * 2), comp.get(k * 2, k * 2) == k * 2) for k in range(len(v))}
    links = sum(got[k][0] for k in want)
    assert all(got[k][0] <= want[k][0] for k in want) and links >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    for k in range(len(BAD)):
        assert got[5000 + k] == (0, 5000 + k, True)
    assert got[None] == (0, None, True) and got[7001] == (1, 7001, True) and got[7002] == (1, 7001, False)
    assert len(got) == len(rows) and embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [10_256, 10_000_000])
def test_pairs_meet_at_any_number_of_vectors(count):
    width, tables = embedding_dedup.code_shape(count, 0.95)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    mean, columns = embedding_dedup.rotations(x, width * tables)
    met = lambda k: (embedding_dedup.chunk_keys(x, mean, columns, tables) == embedding_dedup.chunk_keys(y, mean, columns, tables))[:, :k].any(1).mean()
    assert width == math.ceil(math.log2(count / 2)) and met(tables) >= 0.99
    assert count < 10**6 or met(18) < 0.95
    code = lambda v: (v - mean) @ columns >= 0
    apart = (code(x) != code(y)).mean(1)
    assert apart.max() < embedding_dedup.RADIUS and ((code(x) != code(x[::-1])).mean(1) > embedding_dedup.RADIUS).mean() > 0.9


def nearest(rows, k):
    good = [(i, np.array(v, np.float32)) for i, v in rows if i is not None and v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            s = sorted({(-float(np.add.accumulate(x.astype(np.float64) * y.astype(np.float64))[-1]), i) for i, y in good if i != q})
            out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_nearest_neighbours_against_brute_force(spark):
    rows = list(enumerate(vectors())) + [(5000 + 20 * k, x) for k, x in enumerate(BAD)] + [(None, vectors()[0]), (0, vectors()[0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, shard int").repartition(3)
    index = Workspace(spark, "test").keep(hnsw.build_index(df, shards=3), "index")
    found = {}
    for r in hnsw.search_index(index, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    want = nearest(rows, 20)
    assert set(found) == set(want)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.98 * sum(map(len, want.values()))
    assert found[0] == want[0]  # sixty equal vectors: the smallest ids
    empty = Workspace(spark, "test").keep(hnsw.build_index(df.limit(0)), "index")
    assert hnsw.search_index(empty, df).count() == 0
    two = df.where("vec_id in (20, 21)")
    assert [(r.query_id, r.vec_id) for r in hnsw.search_index(Workspace(spark, "test").keep(hnsw.build_index(two), "i"), two.where("vec_id = 20")).collect()] == [(20, 21)]


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    g = hnsw.Graph.build(x, hnsw.levels_of(len(x)))
    assert len(g.layers) > 1 and all((nb < len(nb)).all() for nb in g.layers)
    q = x[::40] + rng.normal(scale=0.3, size=(100, 32)).astype(np.float32)
    found = g.search(q, hnsw.EF)[0][:, :20]
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), want.tolist(), strict=True)]) > 0.95


# Archives


def archive(spark, pages, **kw):
    space = Workspace(spark, "test")
    return space.keep(warc.write_warc(pages, space.path("warc"), **kw), "manifest")


def test_archive_round_trip_at_any_split(spark):
    rng = random.Random(1)
    pool = ["<p>one</p>", "<p>two</p>", "", None, "é🙂" * 50, "".join(chr(rng.randrange(32, 900)) for _ in range(200_000))]
    rows = [(k, f"http://e.com/{k}\r\nX: y" if k % 7 else None, rng.choice(pool) if k % 3 else f"<p>{rng.random()}</p>" * rng.randrange(1, 40)) for k in range(150)] + [(None, "http://none", "<p>one</p>"), (40, "http://again", "<p>again</p>"), (40, "http://again", "<p>again</p>"), (-5, "u", "<p>two</p>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    files = archive(spark, df)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        body, f = (h or "").encode(), first.get(h or "")
        again = i is not None and i > f
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", f if again else None))
    for split in (97, 5000, 1 << 30):
        got = warc.read_warc(files, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    texts = sorted(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert texts == sorted(h or "" for (i, _, h), w in zip(rows, want, strict=True) if w[3] == "response")
    assert all("\n" not in (r.url or "") for r in got) and sum(r.url is None for r in got) == sum(u is None for _, u, _ in rows)
    assert warc.read_warc(warc.archive_files(spark, [r.path for r in files.collect()]), payload=False).count() == len(rows)


def test_archive_thresholds_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.read_warc(archive(spark, df, least=5)).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_warc(archive(spark, df.limit(0))).count() == 0


def test_ranges_skip_what_only_looks_like_a_record():
    import gzip
    import io

    inner = warc.member(b"not a record")
    data = b"junk" + warc.MAGIC + b"junk" + inner + b"".join(warc.member(warc.record("response", warc.record_id(k), "d", "u", b"x" * k * 40_000, "")) for k in range(5))
    got = [warc.page_of(warc.parse(c)[0]["warc-record-id"]) for a in range(0, len(data), 61) for c in warc.Range(io.BytesIO(data), a, min(len(data), a + 61))]
    assert got == [0, 1, 2, 3, 4]
    assert gzip.decompress(warc.member(b"abc")) == b"abc"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.Range(io.BytesIO(data[:-30]), 0, len(data)))


# Models


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op2(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(k, t, lang, 1) for k in range(30) for t, lang in (("the cat and the hat sat here", "en"), ("der hund und das haus über", "de"))] + [(100, None, "en", 1), (101, "", "en", 1), (102, "12 34 !?", "en", 1), (103, "the " * 60_000, None, 1), (None, "und der hund", "de", 1), (7, "und der hund", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    network = language_id.learn(df)
    out = language_id.identify(df, network)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_"] and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert [by[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"] and by[100].score_ == 0
    nothing = language_id.learn(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert [r.h for r in spark.createDataFrame([(1,), (None,)], "doc_id long").select(language_id.held_out().alias("h")).collect()][1] is False


def plain_probabilities(net, text):
    """The network's forward pass place by place."""
    raw = text.lower().encode()
    total = np.zeros(len(net.names))
    for s in range(0, max(1, len(raw)), language_id.WINDOW):
        window = raw[s : s + language_id.WINDOW]
        padded = window + bytes(language_id.WINDOW - len(window))
        pooled = np.full(net.filters.shape[1], -np.inf)
        for at in range(len(padded)):
            answer = np.zeros(net.filters.shape[1])
            for j in range(max(language_id.WIDTHS)):
                if at + j < len(padded):
                    e = net.embed[padded[at + j]]
                    answer += e @ net.filters[j * len(e) : (j + 1) * len(e)]
            pooled = np.maximum(pooled, answer)
        z = np.exp((pooled + net.bias) @ net.out + net.out_bias)
        total += z / z.sum() * len(window)
    return total / total.sum()


def test_language_network_against_plain_python():
    rng = np.random.default_rng(3)
    e, widest, f = language_id.EMBED, max(language_id.WIDTHS), language_id.FILTERS * len(language_id.WIDTHS)
    embed = rng.normal(size=(256, e)).astype(np.float32)
    embed[0] = 0
    net = language_id.Network(["de", "en", "fr"], embed, rng.normal(size=(widest * e, f)).astype(np.float32), rng.normal(size=f).astype(np.float32), rng.normal(size=(f, 3)).astype(np.float32) / 4, np.zeros(3, np.float32))
    texts = ["a", "Ünd so weiter", "the quick brown fox " * 20, "x" * 256, "y" * 257]
    langs, scores = net.predict([*texts, None, "", "12 !"])
    for text, lang, score in zip(texts, langs, scores, strict=False):
        p = plain_probabilities(net, text)
        assert lang == net.names[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)
    assert langs[5:] == ["und"] * 3 and scores[5:].tolist() == [0, 0, 0]
    tie = language_id.Network(["b", "c"], *[np.zeros_like(x) for x in (net.embed, net.filters, net.bias)], np.zeros((f, 2), np.float32), np.zeros(2, np.float32))
    assert tie.predict(["any text"])[0] == ["b"]  # equally likely: the first by name


def test_language_sample_of_many_languages(spark, monkeypatch):
    rows = [(k, f"text {k} in some words", f"l{k % 30}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({n for n, _ in language_id.sample_windows(df, "text", "lang", F.col("doc_id"))}) == 30
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 300)
    few = language_id.sample_windows(df, "text", "lang", F.col("doc_id"))
    assert 200 < len(few) < 400 and len({n for n, _ in few}) == 30
    net = language_id.learn(df.limit(0))
    empty = language_id.identify(df.limit(0), net)
    assert empty.count() == 0 and [r.lang_pred for r in language_id.identify(df.limit(2), net).collect()] == ["und"] * 2


def test_upper_case_share_is_of_the_whole_text():
    for n in (2, 1000, 3998, 3999, 5998, 40_000):
        assert toxicity._form(("Ab" * n)[:n])[0] == 8, n
    assert toxicity._form("abcD" * 2000)[0] == toxicity._form("Dabc" * 2000)[0] == toxicity._form("Éabc" * 2000)[0] == 4


def test_toxicity_chain(spark):
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        toxic, low = k % 5 == 0, k % 7 == 0
        words = [rng.choice(plain) for _ in range(40)] + ["dreadful"] * toxic + ["spam!!"] * low
        rng.shuffle(words)
        rows.append((k, " ".join(words), 0.5))
        labels.append((k, int(not low), int(toxic)))
    rows += [(2000, None, 0.5), (2001, "", 0.5), (2002, "dreadful " * 40_000, 0.5), (None, "dreadful words", 0.5), (3, "again dreadful", 0.5)]
    labels += [(5, 1, None), (None, 1, 1), (4000, 1, 1), (3, 1, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.learn_chain(docs, labels, {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    assert chain.models[1].earlier.shape == (1,)
    out = toxicity.score(docs, chain)
    assert out.columns == ["doc_id", "text", "p_toxic", "p_low", "p_toxic_"] and out.count() == len(rows)
    got = [(r.text or "", r.p_low, r.p_toxic_) for r in out.collect()]
    assert np.mean([("dreadful" in t) == (p >= 0.5) for t, _, p in got]) > 0.99 and np.mean([("spam" in t) == (p >= 0.5) for t, p, _ in got if t]) > 0.97
    assert all(p == 0 for t, _, p in got if not t)
    untrained = toxicity.learn_chain(docs, labels.limit(0), {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    assert not any(r.p_toxic_ > 0.5 for r in toxicity.score(docs, untrained).collect())


def test_toxicity_on_rows_that_were_not_learned_from():
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    t = pq.read_table(f"{d}/documents.parquet").to_pandas().merge(pq.read_table(f"{d}/labels.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    train, test = t.iloc[::2], t.iloc[1::2]
    y = np.stack([train.quality.values == 0, train.toxic.values == 1], 1)
    chain = toxicity.fit_chain(*toxicity.features(train.text.tolist()), y, ["low", "toxic"])
    p = chain.predict(*toxicity.features(test.text.tolist(), chain.wanted()), len(test))[:, 1] >= 0.5
    real = test.toxic.values == 1
    assert (p & real).sum() >= 0.9 * real.sum() and (p & ~real).sum() <= 0.005 * len(test)


def test_chain_against_plain_python():
    """Features of a text are those of its words and of its form; each model adds up its weights and sees the earlier probabilities."""
    texts = ["", "Hello world!", "dreadful | spam spam\nHELLO", "é 123 unbelievably", "the end. " * 700]
    row, feature = toxicity.features(texts)
    got = [set(feature[row == i].tolist()) for i in range(len(texts))]
    for text, own in zip(texts, got, strict=True):
        words = {f for w in text.split() for f in (lambda r: r[1][r[0] == 0])(toxicity.features([w])).tolist() if f >= 128}
        assert own == (words | set(toxicity._form(text)) if text else set())
    rng = np.random.default_rng(5)
    every = np.unique(feature)
    models = [toxicity.Linear(np.sort(rng.choice(every, 6, replace=False)), rng.normal(size=6), rng.normal(size=k), float(rng.normal())) for k in range(3)]
    chain = toxicity.Chain(["a", "b", "c"], models)
    p = chain.predict(row, feature, len(texts))
    for i, own in enumerate(got):
        earlier = []
        for k, m in enumerate(models):
            z = m.bias + sum(w for c, w in zip(m.chosen.tolist(), m.weights.tolist(), strict=True) if c in own)
            z += sum(w * math.log(q / (1 - q)) for q, w in zip(earlier, m.earlier.tolist(), strict=True))
            earlier.append(1 / (1 + math.exp(-z)))
            assert p[i, k] == pytest.approx(earlier[-1], abs=1e-6)
            earlier[-1] = min(max(earlier[-1], 1e-4), 1 - 1e-4)


def test_registered_op5(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["fine", "good", "plain", "word", "text"]) for _ in range(20)) + (" dreadful" if k % 4 == 0 else "") for k in range(400)] + [None, "", "dreadful " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for bound in (toxicity.SAMPLE_FEATURES, 6000):  # all of the sample, and part of it
        monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", bound)
        got = {r.doc_id: (r.toxic, r.score) for r in toxicity.op5(spark, str(tmp_path)).collect()}
        assert len(got) == len(texts) and got[400] == got[401] == (False, 0.0)
        assert all(got[k][0] == (k % 4 == 0) for k in range(400))


# Pipeline


def test_pipeline_edge_cases(spark):
    """Empty tables, repeated ids and rows, nulls, very long texts, further columns of clashing names."""
    import corpus_pipeline

    space = Workspace(spark, "test")
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = space.keep(stage(spark, docs, DATA), f"empty-{name}")
        assert docs.count() == 0
    rng = random.Random(1)
    text = lambda n, words: " ".join(rng.choice(words) + str(rng.randrange(99999)) for _ in range(n))
    en, de = ["the", "house", "walking"], ["der", "hausse", "laufend"]
    rows = [(k, text(60, en if k % 2 else de), "en" if k % 2 else "de", f"src{k % 3}", 1) for k in range(80)]
    rows += [(200, text(30_000, en), "en", "src1", 1), rows[3], (5, text(50, en), None, None, None), (None, text(50, en), "en", "src1", 1), (300, None, "en", "src1", 0), (301, "", None, "src1", 0), (302, "..", "de", None, 2)]
    docs = spark.createDataFrame(rows, schema)
    extra = ["class_id", "kept", "_k", "epoch", "domain", "lang_pred", "score", "kept_text", "n_lines", "cut", "ids"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, space.keep(stage(spark, docs.select("*", *[F.lit(7).alias(c) for c in extra]), DATA), name)
        ids = {r[0] for r in docs.collect()}
        assert ids <= {r[0] for r in before.collect()}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.where("lang IS NULL").count() == 0
        if name in ("language_id", "line_dedup", "near_dedup"):
            assert {*range(80), 200, None} <= ids and not {300, 301, 302} & ids
            assert docs.where("doc_id = 5").count() == 2 and docs.where("doc_id = 3").count() == (2 if name != "near_dedup" else 1)


def test_pipeline_keeps_all_texts_of_an_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{w}{k}" for k in range(30)) for w in "ab")
    rows = [(1, one, "en", "s1", 9), (1, two, "en", "s1", 9), (1, one, "en", "s0", 9), (2, one, "en", "s1", 9), (None, one, "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, one, "en", "s0", 9), (1, two, "en", "s1", 9), (None, one, "en", "s1", 9)], key=str)


def test_pipeline_against_plain_python(spark):
    """Each stage on what the one before kept."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    space = Workspace(spark, "test")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "12345 !!", "en", "src1", 8)], docs.schema)
    docs, kept = docs.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        docs = space.keep(stage(spark, docs, DATA), name)
        kept.append({r[0]: r for r in docs.collect()})
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    language, lines, near, mixed, encoded = kept
    assert not {10**6, 10**6 + 1, 10**6 + 2} & set(language) and len(language) >= 195
    from test_lines_and_tokens import plain_dedup

    want = {i: text for i, _, dropped, text in plain_dedup([(i, r.text) for i, r in language.items()]) if not dropped or text}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())
    classes = brute_classes([(i, r.text) for i, r in lines.items()])
    assert set(near) == {i for i in lines if classes.get(i, i) == i}
    assert set(mixed) < set(near) and {i: r.text for i, r in mixed.items()} == {i: near[i].text for i in mixed}
    total = sum(len(r.text.split()) for r in near.values())
    assert 0.7 * total < sum(len(r.text.split()) for r in mixed.values()) <= 0.8 * total
    assert set(encoded) == set(mixed) and all(r.decoded_sha256 == hashlib.sha256(mixed[i].text.encode()).hexdigest() for i, r in encoded.items())
