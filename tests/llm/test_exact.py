"""Operators whose results are held against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken

from maskwright.llm import bpe, hashing, linedup, minhash, packing, suffixdedup, topk
from maskwright.llm.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASH = "host long, key string, cid long, node long, h long, n int, label int, bands int, __gone int"


def documents(spark, texts, source=None):
    """doc_id, text, lang, source, n_chars and columns named like those that operators use inside."""
    rows = [(i, t, "en", source[i] if source else f"s{i % 3}", 0, i, "k", i, i, i, i, i, i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def sql(query, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df)
    return con.sql(query).df()


def same(spark_df, frame):
    a, b = spark_df.toPandas(), frame
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda df: sorted(repr([None if x is None or x != x else x for x in r]) for r in df[columns].astype(object).values.tolist())
    assert key(a) == key(b)


# suffix arrays ----------------------------------------------------------------------------------------


def repetitive(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(200)) for _ in range(6)]
    make = lambda: rng.choice([rng.choice(base)[rng.randrange(60) : rng.randrange(60, 200)], "".join(rng.choice("abcd") for _ in range(rng.randrange(40))), "ab" * rng.randrange(40)])
    texts = ["".join(make() for _ in range(rng.randrange(6))) for _ in range(n)]
    return [*texts, None, "", texts[3], texts[3], "x" * 39, "x" * 40, "y" * 300]


@pytest.mark.parametrize("hot", [2, 256])
def test_suffix_dedup(spark, hot):
    texts = repetitive(hot)
    rows = {r.doc_id: r for r in suffixdedup.dedup(documents(spark, texts), 40, hot=hot).collect()}
    for i, spans in enumerate(suffixdedup.brute_force(texts, 40)):
        raw = (texts[i] or "").encode()
        rest = b"".join(raw[b:a] for b, a in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(raw)], strict=True))
        assert ([tuple(x) for x in rows[i].spans], rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans) == (spans, len(raw), len(raw) - len(rest), len(spans))
        assert rows[i].kept_sha256 == hashlib.sha256(rest).hexdigest()


def test_suffix_dedup_of_a_passage_in_distinct_surroundings(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    short, long = noise(39), noise(41)
    texts = [noise(60) + short + noise(60) for _ in range(60)] + [noise(50) + long + noise(50) for _ in range(60)]
    rows = suffixdedup.dedup(documents(spark, texts), 40, hot=4).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.spans] for r in rows] == suffixdedup.brute_force(texts, 40)


def test_suffix_dedup_keeps_the_rest_as_text(spark):
    texts = ["é" * 30 + "tail", "É" + "é" * 29 + "end", "alone", None]
    rows = suffixdedup.dedup(documents(spark, texts), 20).orderBy("doc_id").collect()
    for row, text, spans in zip(rows, texts, suffixdedup.brute_force(texts, 20), strict=True):
        raw = (text or "").encode()
        rest = b"".join(raw[b:a] for b, a in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(raw)], strict=True))
        assert row.text == rest.decode(errors="ignore") and row.kept_sha256 == hashlib.sha256(rest).hexdigest()


def test_suffix_dedup_of_bytes_that_are_no_utf8(spark, tmp_path):
    one, other = (b"\xff\xc3" + bytes(range(97, 117)) * k for k in (21, 20))
    raws = [b"\xe9" * 450, b"z" * 450 + b"\xe9", b"ok \xc3", b"a" + one, other + b"\xf0\x9f", None, "é".encode() * 200]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(raws)], "doc_id long, text binary")
    for kind in ("string", "binary"):
        path = f"file://{tmp_path}/{kind}"
        df.select("doc_id", df.text.cast(kind).alias("text")).write.parquet(f"{path}/documents.parquet")
        rows = suffixdedup.op1_suffix(spark, path).orderBy("doc_id").collect()
        windows = [[(x or b"")[i : i + 400] for i in range(len(x or b"") - 399)] for x in raws]
        seen = Counter(w for x in windows for w in x)
        for row, raw, own in zip(rows, raws, windows, strict=True):
            flags = bytearray(len(raw or b""))
            for i, w in enumerate(own):
                if seen[w] > 1:
                    flags[i : i + 400] = b"\1" * 400
            rest = bytes(x for x, gone in zip(raw or b"", flags, strict=True) if not gone)
            spans = sum(gone and not before for before, gone in zip(b"\0" + flags, flags, strict=False))
            assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(flags), sum(flags), spans, hashlib.sha256(rest).hexdigest())


def test_suffix_dedup_tells_texts_of_one_md5_apart(spark):
    first = "d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99fd91dbdf280373c5bd8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1ec69821bcb6a8839396f9652b6ff72a70"
    second = "d131dd02c5e6eec4693d9a0698aff95c2fcab50712467eab4004583eb8fb7f8955ad340609f4b30283e4888325f1415a085125e8f7cdc99fd91dbd7280373c5bd8823e3156348f5bae6dacd436c919c6dd53e23487da03fd02396306d248cda0e99f33420f577ee8ce54b67080280d1ec69821bcb6a8839396f965ab6ff72a70"
    raws = [bytes.fromhex(first), bytes.fromhex(second)]
    assert raws[0] != raws[1] and len({hashlib.md5(x).digest() for x in raws}) == 1
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raws)], "doc_id long, text binary")
    rows = suffixdedup.dedup(df.select("doc_id", df.text.cast("string").alias("text"))).orderBy("doc_id").collect()
    assert [r.kept_sha256 for r in rows] == [hashlib.sha256(x).hexdigest() for x in raws]


def test_suffix_dedup_of_very_long_texts(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 107, 700_000, dtype=np.uint8)).decode()
    texts = [long, long[100_000:100_400] + "x", "x" + long[:399], "z" * 300_000, long[-400:]]
    rows = suffixdedup.dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.spans] for r in rows] == [[(100_000, 100_400), (699_600, 700_000)], [(0, 400)], [], [(0, 300_000)], [(0, 400)]]


def test_suffix_index_takes_batches(spark, tmp_path):
    texts = repetitive(3, 90)
    docs, path = documents(spark, texts), f"file://{tmp_path}/index"
    index = suffixdedup.Index(spark, path, 40)
    assert index.clean().count() == 0
    for k in range(5):
        index.add(docs.where(docs.doc_id % 5 == k))
    index = suffixdedup.Index(spark, path, 40)
    index.add(docs.where("false"))
    assert len(index.levels) <= 4
    rows = index.clean().orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.spans] for r in rows] == suffixdedup.brute_force(texts, 40)
    with pytest.raises(ValueError):
        suffixdedup.Index(spark, path, 41)


def test_suffix_family_levels():
    rng = random.Random(2)
    make = lambda: bytes(rng.choice(b"ab") for _ in range(12))
    entries = [(rng.randrange(3), 3, 4, make()) for _ in range(300)]
    family = suffixdedup.Family(9)
    for a in range(0, 300, 7):
        family.add(entries[a : a + 7])
        assert len(family.levels) <= 8
    family.close()
    for i, (key, _, span, content) in enumerate(entries):
        expected = [any(j != i and k == key and c[s : s + 9] == content[s : s + 9] for j, (k, _, _, c) in enumerate(entries)) for s in range(span)]
        assert family.flags[i].tolist() == expected


def test_suffix_dedup_empty(spark):
    assert suffixdedup.dedup(documents(spark, ["x"]).where("false")).count() == 0


# byte-level BPE ---------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "hello  world\n\n x", "aaaaaaaaaa aaa aaaa", "été 😀😀 naïve\t\tok", "the the the", "don't we'll 123456 !!??", "  x", "<|endoftext|>", "z" * 3000, "日本語のテキスト"]


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_codec(small):
    texts = TEXTS + duckdb.sql(f"SELECT text FROM '{small}/documents.parquet' LIMIT 60").df().text.tolist()
    codec, known = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN), reference_encoding()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_operator(spark):
    texts = [*TEXTS, None, TEXTS[1]]
    known = reference_encoding()
    ids = [known.encode_ordinary(t or "") for t in texts]
    df = documents(spark, texts)
    rows = bpe.digests(df, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(x) for x in ids]
    assert [r.ids_sha256 for r in rows] == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert [r.ids for r in encoded.orderBy("doc_id").collect()] == ids
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert bpe.digests(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


# packing ----------------------------------------------------------------------------------------------


def test_packing(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    rows = packing.pack_documents(docs).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(rows.doc_id) == set(texts)
    for doc_id, own in rows.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        at = 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, own in rows.groupby("sequence_id"):
        at = 0
        for r in own.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += packing.padding(at, 1024)
    assert sorted(set(rows.sequence_id)) == list(range(rows.sequence_id.max() + 1))
    assert padding < 0.1 * rows.length.sum()


def test_packing_of_texts_with_the_marker(spark):
    """Added tokens are found within plain text, as the tokenizer itself finds them."""
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>\n z", "<|endoftext|", "été<|endoftext|> 😀  <|endoftext|>  ", "w " * 1500 + "<|endoftext|>" + " v" * 900]
    rows = packing.pack(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True).toPandas()
    for doc_id, own in rows.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        own = own.sort_values("start")
        assert [x for piece in own.ids for x in piece] == ids and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()) for s in own.start] == list(own.ids_crc32)


def test_packing_small_cases(spark):
    df = documents(spark, ["a", "a", "a", None])
    rows = packing.pack_documents(df.union(df)).collect()
    assert len(rows) == 8 and {r.length for r in rows} == {1, 2}
    assert packing.pack_documents(df.where("false")).count() == 0
    null_id = df.selectExpr("CAST(null AS bigint) AS doc_id", "text")
    assert {r.doc_id for r in packing.pack_documents(null_id).collect()} == {None}


def test_minimum_bin_slack():
    assert packing.best_fill({7: 1, 5: 1, 3: 2, 2: 1}, 10) == {7: 1, 3: 1}
    assert packing.best_fill({6: 1, 5: 3}, 16) == {6: 1, 5: 2}
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(6)}
        used = packing.best_fill(counts, 64)
        assert max(counts) in used and all(n <= counts[x] for x, n in used.items())
        sums = {0}
        for x, n in counts.items():
            n -= x == max(counts)
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x + max(counts) <= 64}
        best = min(packing.padding(max(counts) + s, 64) for s in sums)
        assert packing.padding(sum(x * n for x, n in used.items()), 64) == best
    rows, windows = packing.layout({512: 4, 100: 7}, 1024)
    assert windows == 3 and len(rows[512]) == 1


# line dedup -------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    sites = [f"s{i % 14}" for i in range(30)]
    texts = [f"unique {i}\ncommon\n\n  \nnear{i % 3}\n" + ("few\n" if i < 9 else "") + ("only" if i % 14 == 0 else "") for i in range(30)] + ["common"]
    df = documents(spark, texts, [*sites, None])
    got = linedup.clean(df)
    assert got.columns == [*df.columns[:13], "__gone", "n_lines", "n_removed"]
    same(got.select("doc_id", "text", "n_lines", "n_removed"), sql(linedup.OP8_SQL, documents=df.toPandas()))
    rows = {r.doc_id: r for r in got.collect()}
    assert "common" in rows[0].text and all("common" not in rows[i].text for i in range(1, 31))
    assert rows[30].text == "" and rows[30].n_removed == 1


def test_line_dedup_nulls(spark):
    rows = [(None, "x\ny", "a"), (1, None, "b"), (2, "", None), (3, "x", None)] + [(10 + i, "x", f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, i): r for i, r in enumerate(linedup.clean(df).orderBy("doc_id").collect())}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[None].text == "y" and by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].text == "" and by_id[3].text == "x"
    assert by_id[10].text == "" and linedup.clean(df.where("false")).count() == 0


def test_line_dedup_query(spark, small):
    docs = duckdb.sql(f"SELECT * FROM '{small}/documents.parquet'").df()
    same(linedup.op8_lines(spark, small), sql(linedup.OP8_SQL, documents=docs))


# exact top-k ------------------------------------------------------------------------------------------


def test_top_k_query(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    same(topk.op9_topk(spark, small), con.sql(topk.OP9_SQL).df())


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (100, [-1.0, 2.0]), (7, [1.0, 0.5]), (8, [1.0, 0.5]), (9, None), (10, [float("nan"), 1.0]), (11, [None, 1.0]), (12, [float("inf"), 1.0]), (13, []), (None, [1.0, 1.0]), (14, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, 3).collect()}
    assert got[(0, 1)] == (14, 3 * 1024 * 1024) and got[(0, 2)][0] == 7 and got[(0, 3)][0] == 8
    assert {q for q, _ in got} == {0, 100}
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 7)").union(df.where("vec_id in (0, 7)")), 3).count() == 2


def test_topk_of_large_components_is_exact(spark):
    big = [0.5, 1e14, -1e14, 1e300, -3.7e18, 2.0**40, 1e-9, 123456.789, 8.9e15]
    rng = random.Random(8)
    vectors = [[rng.choice(big) if rng.random() < 0.3 else rng.uniform(-2, 2) for _ in range(6)] for _ in range(60)] + [[0.25, -0.5], []]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, q long, block int")
    whole = [[math.floor(Fraction(x) * 1024) for x in v] for v in vectors]
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    score = lambda a, b: clamp(sum(x * y for x, y in zip(a, b, strict=False)))
    want = {}
    for i in range(0, len(vectors), 5):
        ranked = sorted((-score(whole[i], whole[j]), j) for j in range(len(vectors)) if j != i)[:7]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(ranked)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, 7, every=5, query_block=4, chunk=9).collect()}
    assert got == want


def test_topk_of_many_queries_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20_000, 4))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": vectors.tolist()}))
    got = topk.top_k(df, 2, every=1, query_block=1500, chunk=6000).toPandas()
    assert len(got) == 40_000
    whole = np.floor(vectors * 1024)
    for q in range(0, 20_000, 997):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(20_000), -scores))[:2]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == best.tolist() and own.score.tolist() == scores[best].astype(int).tolist()


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(4)
    data = np.floor(rng.normal(size=(500, 40)) * 100)
    columns = np.ascontiguousarray(data.T)
    tail = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1][:: topk.DIMENSION_BLOCK])
    for q in data[:20]:
        scores = data @ q
        bound = np.sort(scores)[-10]
        ids, got = topk.scan_block(q, np.arange(500), columns, tail, bound)
        assert len(ids) < 500 and set(np.flatnonzero(scores >= bound)) <= set(ids) and (got == scores[ids]).all()


# near-duplicates --------------------------------------------------------------------------------------


def near_texts(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one two", "one  TWO", "a b c d e", "A B C D E f"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for k in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) if k % 2 else "\n".join(copy).upper())
    return texts


def test_near_duplicates(spark):
    df = documents(spark, near_texts())
    same(minhash.near_duplicates(df, 85), sql(minhash.OP10_SQL, documents=df.select("doc_id", "text").toPandas()))


def test_near_duplicates_in_chains(spark):
    """Neighbours are alike, ends are not: what no bucket's first class links, the second step has to."""
    words = [f"v{i}" for i in range(300)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 180, 3)]
    df = documents(spark, texts)
    same(minhash.near_duplicates(df, 85), sql(minhash.OP10_SQL, documents=df.select("doc_id", "text").toPandas()))


def test_near_duplicates_query(spark, small):
    docs = duckdb.sql(f"SELECT * FROM '{small}/documents.parquet'").df()
    same(minhash.op10_minhash(spark, small), sql(minhash.OP10_SQL, documents=docs))


def test_near_duplicates_ids(spark):
    long = " ".join(map(str, range(50)))
    other = " ".join(map(str, range(100, 150)))
    df = spark.createDataFrame([(None, long), (5, long), (3, long), (5, other), (9, other), (9, other)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_shingles_and_signature():
    a = hashing.shingles("the quick Brown fox\tjumps over")
    assert len(a) == 2 and (a == hashing.shingles(" THE quick brown\nfox jumps  over ")).all()
    assert len(hashing.shingles("x " * 70000)) == 1
    long = " ".join(f"word{i}" for i in range(30000))
    assert len(hashing.shingles(long)) == 30000 - 4
    assert (hashing.word_hashes(np.frombuffer(long.encode(), np.uint8))[-3:] == hashing.word_hashes(np.frombuffer(b"word29997 word29998 word29999", np.uint8))).all()
    x, y = (np.unique(np.random.default_rng(i).integers(0, 2**63, 4000, dtype=np.uint64)) for i in (1, 2))
    for share in (0.2, 0.5, 0.9):
        n = int(4000 * share)
        union = np.unique(np.concatenate([x[:n], y[: 4000 - n]])), x[:n]
        agree = np.mean([(minhash.signature(union[0], 256) == minhash.signature(union[1], 256)).mean()])
        assert abs(agree - n / len(union[0])) < 0.1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), *[(100, i) for i in range(101, 130)], *[(i, i + 1) for i in range(200, 230)]]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 231)}
