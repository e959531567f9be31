"""Line dedup, byte-level BPE, token files, mixing: edge cases, and against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, token_files
from tidemark.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", "src1", None) for k, t in enumerate(texts)], DOCS)


# Line dedup


def plain_dedup(rows):
    """(doc_id, text) rows to what stays, by the definition."""
    last = (1 << 63) - 1
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            holders[key(line)].add(last if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").encode().split(b"\n")
        kept = [x for x in own if not (len(k := key(x)) >= 10 and len(holders[k]) > 1 and min(holders[k]) != (last if i is None else i))]
        out.append((i, len(own), len(own) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


def deduped(df, **kw):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, **kw).collect()], key=str)


def test_lines_against_the_definition(spark):
    rng = random.Random(1)
    pool = [f"{'Line' if k % 2 else 'line'} number {k % 17}" for k in range(40)] + ["short", "", " \tPadded LINE here\x0b", "padded line here", "ÄÖÜ äöü é ß", "äöü äöü é ß", "日本語日本語日本語日", "nine char", "twice in one document"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for k in range(120)] + [(200, None), (201, ""), (202, "x" * 300_000 + "\nline number 3"), (203, "twice in it only\ntwice in it only"), (None, "line number 5\nonly here, no id"), (None, "line number 6"), (7, "line number 7\nmore of seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped(df) == plain_dedup(rows) == deduped(df, batches=1) == deduped(df.repartition(7), batches=9, fanout=3)


def test_lines_of_an_empty_table_and_clashing_names(spark):
    assert deduped(spark.createDataFrame([], "doc_id long, text string")) == []
    df = spark.createDataFrame([(1, "the same long line", 5, b"x", "k"), (2, "the same long line", 6, b"y", "k")], "doc_id long, text string, n_lines int, _drop binary, H string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "n_lines", "_drop", "H", "n_lines_", "n_dropped", "kept_text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()) == [(1, 5, 0), (2, 6, 1)]


def test_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        store.ingest(spark.createDataFrame([(bytes([k]), b) for k in range(b, b + 3)], "h binary, k long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    seen = sorted((bytes(r.h), r.owner) for name in store.runs() for r in store.run(name).collect())
    assert seen == [(bytes([k]), max(0, k - 2)) for k in range(7)]
    with line_dedup.in_order(spark, store.buckets):
        plan = store.run(store.runs()[0]).join(store.run(store.runs()[1]).hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and plan.count("Bucketed: true") == 2
    files = [f for name in store.runs() for f in spark.table(name).inputFiles()]
    assert files and all(store.space.root.rsplit("/", 1)[1] in f for f in files)  # in the shared folder
    names = [f"{store.name}_{k + 1}" for k in range(store.made)]
    store.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_go_when_an_ingest_fails(spark, monkeypatch):
    ingest, seen = line_dedup.LineRuns.ingest, []

    def failing(self, lines):
        seen.append(self)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return ingest(self, lines)

    monkeypatch.setattr(line_dedup.LineRuns, "ingest", failing)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(docs(spark, [f"a line that is number {k}" for k in range(40)])).count()
    assert seen[0].made == 2 and not any(spark.catalog.tableExists(f"{seen[0].name}_{k}") for k in (1, 2, 3))


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).merges.ranks, special_tokens={})


ODD = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "aa", "e", "the", "I'll", "'s", "1", "²", "Ⅷ", "é", "中文", "🙂", "!", "??", "_", "\r\n", "​", "x́", "0123", "aaaaaa", "    ", "<|endoftext|>"]


def odd_texts():
    rng = random.Random(4)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "a" * 4000, " " * 3000, "\n" * 50, "ab" * 2000, "word " * 20_000]


def test_bpe_is_the_librarys(library):
    texts = odd_texts()
    c = bpe.Codec(*bpe.vocabulary())
    flat, counts = c.encode(pa.array(texts))
    assert len(counts) == len(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert c.decode(ids.tolist()) == text.encode()
    flat, counts = c.encode(pa.array([None, "", "a b"]).slice(1))
    assert flat.tolist() == library.encode_ordinary("a b") and counts.tolist() == [0, 2]


def test_text_batches_hold_all_rows_once():
    rows = pa.record_batch([pa.array(range(300)), pa.array([None if k % 7 == 0 else "x" * (k % 50) for k in range(300)])], ["k", "text"])
    for size in (1, 40, 1000, 10**6):
        parts = list(bpe.text_batches(iter([rows.slice(0, 0), rows.slice(0, 120), rows.slice(0, 0), rows.slice(120)]), 1, size))
        assert [k for part, _ in parts for k in part.column(0).to_pylist()] == list(range(300))
        assert all(t == (x or "") for part, texts in parts for t, x in zip(texts.to_pylist(), part.column(1).to_pylist(), strict=True))
        assert len(parts) == 1 if size == 10**6 else len(parts) > 3


def test_bpe_replays_merges_out_of_order(tmp_path):
    """A vocabulary in which a merge makes room for one of a lower rank."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"aaa", b"aa", b"aab", b"ba"]
    path = tmp_path / "v"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for r, t in enumerate(tokens)))
    m, rng = bpe.Merges(str(path)), random.Random(2)
    words = [bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while best := min(((m.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in m.ranks), default=None):
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [m.ranks[x] for x in parts]

    flat, count = m.replay(words)
    want = [plain(w) for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == want and [m.one(w) for w in words] == want
    assert m.one(b"") == [] and len(m.one(b"ab" * 100_000)) < 200_000  # not quadratic


def test_bpe_tables(spark, library):
    texts = [None, "", "plain words here", "plain words here", "é🙂 " * 5000]
    df = docs(spark, texts).withColumnRenamed("lang", "ids")
    v = bpe.vocabulary()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_table(df, *v).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = bpe.encode_table(df, *v, ids_name="tokens")
    assert encoded.columns == ["doc_id", "ids", "source", "n_chars", "tokens"]
    back = bpe.decode_table(encoded, *v, ids_col="tokens").orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in texts]
    assert bpe.digest_table(df.limit(0), *v).count() == 0


# Token files


def write(spark, df, **kw):
    space = Workspace(spark, "test")
    m = space.keep(token_files.write_token_files(df, space.path("files"), *token_files.library_vocabulary(), end_id=2, **kw), "manifest")
    return m


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.library_vocabulary()[0])
    texts = odd_texts()[:300] + [None, "word " * 20_000, "tie", "tie"]
    rows = [(k * 3 % 307, x) for k, x in enumerate(texts)] + [(None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    m = write(spark, df, parts=4)
    got = token_files.read_token_files(m).orderBy("start").collect()
    start = 0
    for (i, x), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    paths = [r.path for r in m.collect()]
    some = token_files.read_some(paths, {5, 9})
    assert set(some) == {5, 9}
    import zstandard

    from tidemark.llm.files import open_file

    with open_file(paths[0]) as f:  # plain zstandard reads the ids of a whole file
        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    first = [r for r in m.collect() if r.path == paths[0]][0]
    assert len(raw) == 2 * first.tokens


def test_token_files_notice_damage(spark, tmp_path):
    import io

    out = io.BytesIO()
    w = token_files.TokenFileWriter(out, 2)
    for k in range(3):
        w.add(k, np.arange(k * 50, k * 50 + 40))
    w.close()
    raw = bytearray(out.getvalue())
    file = token_files.TokenFile(io.BytesIO(bytes(raw)))
    assert file.document(1).tolist() == list(range(50, 90))
    raw[int(file.start[1]) + 20] ^= 255
    damaged = token_files.TokenFile(io.BytesIO(bytes(raw)))
    assert damaged.document(2).tolist() == list(range(100, 140))
    with pytest.raises(Exception, match="damaged|[Cc]hecksum|[Cc]orrupt|decompress"):
        damaged.document(1)
    with pytest.raises(ValueError, match="not a token file"):
        token_files.TokenFile(io.BytesIO(b"x" * 100))


def test_ids_that_do_not_fit_two_bytes():
    import io

    assert [token_files.id_width(n) for n in (50_000, 65_535, 65_536)] == [2, 2, 4]
    assert token_files.id_width(10, 70_000) == 4 and token_files.id_width(10, 2) == 2 and token_files.id_width(10, wide=True) == 4
    ids = np.array([1, 65_536], np.int32)
    with pytest.raises(ValueError, match="does not fit"):
        token_files.TokenFileWriter(io.BytesIO(), 2).add(1, ids)
    out = io.BytesIO()
    w = token_files.TokenFileWriter(out, 4)
    w.add(1, ids)
    w.close()
    assert token_files.TokenFile(out).document(0).tolist() == ids.tolist()


def test_registered_op8_and_op9(spark, library, tmp_path):
    """The queries as registered, against the libraries' own calls; a special token's string becomes that token in op9 only."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.library_vocabulary()[0])
    texts = [None, "a <|endoftext|> b", "<|endoftext|>", *odd_texts()[:200], "word " * 9000]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    start, got = 0, token_files.op9(spark, str(tmp_path)).orderBy("doc_id").collect()
    for k, (x, r) in enumerate(zip(texts, got, strict=True)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got[2].n_tokens == 2
    for x, r in zip(texts, bpe.op8(spark, str(tmp_path)).orderBy("doc_id").collect(), strict=True):
        ids = library.encode_ordinary(x or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


def test_special_tokens_as_text():
    path, pattern = token_files.library_vocabulary()
    plain, as_text = token_files.LibraryEncoder(path, pattern), token_files.LibraryEncoder(path, pattern, special_as_text=True)
    texts = pa.array(["x", "a <|endoftext|> b", None, "y"])
    flat, counts = plain.texts(texts)
    assert flat.tolist() == [87, 64, 220, 50256, 275, 88] and counts.tolist() == [1, 4, 0, 1]
    assert as_text.texts(texts)[0].tolist() == [87, 64, 1279, 91, 437, 1659, 5239, 91, 29, 275, 88]


def test_token_files_of_an_empty_table(spark):
    assert token_files.read_token_files(write(spark, docs(spark, []))).count() == 0


# Mixing

def levels():
    return [mixing.Level("domain", F.substring("source", 1, 1), {"a": 3, "b": 1}), mixing.Level("source", F.col("source"))]


def plain_fill(given, nodes):
    """{name: (weight, cap)} to shares, by raising the level until the budget is spent."""
    from fractions import Fraction

    open_, share = dict(nodes), {}
    while open_:
        level = Fraction(given - sum(share.values()), sum(w for w, _ in open_.values()))
        full = {n: c for n, (w, c) in open_.items() if c <= level * w}
        if not full:
            return share | {n: int(level * w) for n, (w, _) in open_.items()}
        share |= full
        for n in full:
            del open_[n]
    return share


def plain_mix(rows, percent, epochs, seed):
    have = defaultdict(int)
    for _, text, source in rows:
        if n := len(text.split()) if text else 0:
            have[source or ""] += n
    total = sum(have.values())
    leaves = {s: n * epochs for s, n in have.items()}
    domains = defaultdict(int)
    for s, c in leaves.items():
        domains[s[:1]] += c
    weight = {"a": 3}
    top = plain_fill(min(total * percent // 100, sum(leaves.values())), {d: (weight.get(d, 1), c) for d, c in domains.items()})
    out = []
    for d, given in top.items():
        for s, share in plain_fill(given, {s: (1, c) for s, c in leaves.items() if s[:1] == d}).items():
            whole, rest = divmod(share, have[s])
            own = [(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if (x or "") == s and t and t.split()]
            used, cut = 0, ""
            for order in sorted({o for o, _, _ in own}):
                used += sum(n for o, _, n in own if o == order)
                if used > rest:
                    break
                cut = order
            out += [(i, s, e) for o, i, _ in own for e in range(whole + (o <= cut))]
    return sorted(out, key=str)


@pytest.mark.parametrize(("percent", "epochs"), [(60, 1), (100, 2), (170, 2), (500, 3), (0, 1)])
def test_mixing_against_plain_python(spark, percent, epochs):
    rng = random.Random(percent)
    rows = [(k, " ".join(["w"] * rng.randrange(30)), rng.choice(["a1", "a1", "a1", "a2", "b1", "b2", "c", None])) for k in range(400)] + [(900, None, "a1"), (901, " \t\n", "b1"), (902, "w " * 5000, "b2"), (None, "no id", "a2"), (3, "twice one", "b1"), (3, "twice one", "b1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = F.floor(F.col("total") * percent / 100)
    p = mixing.plan(df, levels(), total, "s", epochs)
    names = [F.col("domain"), F.col("source")]
    got = sorted([(r.id, r.source, r.epoch) for r in p.take(p.ledger, names, "id").collect()], key=str)
    assert got == plain_mix(rows, percent, epochs, "s")
    whole = p.take(df)  # whole rows, not only those of the ledger
    chosen = whole.where(F.regexp_count("text", F.lit(r"\S+")) > 0)
    assert sorted([(r.doc_id, r.source or "", r.epoch) for r in chosen.collect()], key=str) == got


def test_mixing_an_empty_table(spark):
    p = mixing.plan(spark.createDataFrame([], "doc_id long, text string, source string"), levels(), F.col("total"))
    assert p.take(p.ledger, [F.col("domain"), F.col("source")], "id").count() == 0 and p.take(p.ledger.select("id").selectExpr("id AS doc_id", "'a' AS source")).count() == 0


def test_mixing_with_clashing_names(spark):
    own = ["domain", "whole", "cut", "epoch", "n_tokens", "have", "node", "order", "slot", "id", "_whole", "_node0", "EPOCH_"]
    rows = [(k, "w " * (k % 9 + 1), "ab"[k % 2] + str(k % 3)) for k in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = plain.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in own])
    want = mixing.plan(plain, levels(), F.floor(F.col("total") / 2)).take(plain)
    got = mixing.plan(clash, levels(), F.floor(F.col("total") / 2)).take(clash)
    assert got.columns == [*clash.columns, "epoch__"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    assert all(r[c] == f"{c}:{r.doc_id}" for r in got.collect() for c in own)
    for bad in ("whole", "NODE", "source"):
        with pytest.raises(ValueError, match="names of levels"):
            mixing.plan(plain, [mixing.Level(bad, F.lit("x")), mixing.Level("source", F.col("source"))], F.col("total"))


def test_registered_queries_match_sql(spark):
    import duckdb

    from tidemark.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    sql, run = queries.oracle_sql(), queries.queries()
    for name in sql:
        df = run[name](spark, d)
        found = con.execute(sql[name])
        columns = [c[0] for c in found.description]
        assert sorted([tuple(r) for r in df.select(*columns).collect()], key=str) == sorted(found.fetchall(), key=str), name
    assert pq.read_table(f"{d}/documents.parquet").num_rows == run["op8_byte_bpe"](spark, d).count()
