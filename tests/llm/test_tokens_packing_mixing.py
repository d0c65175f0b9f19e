import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import mixing, packing, tokens

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b\t c", "tabs\tand\x0bfeeds\x0c x", "It's THE dog's, we'll 're", "x<|endoftext|>y <|endoftext|> z",
    "Straße Ärger, naïve façade 12.5%", "ελληνικά Σίσυφος ΟΔΟΣ", "éclair ́", "日本語 テキスト", "🙂 a‍b", "nbsp x   y", "\x1c a \x1d", "\x85 q", "word " * 9000, "İstanbul İ", "a\r\nb", "$$$ 1234 56,7", " x 　 y",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_tokens long")


def test_counts_equal_the_library(spark, sf):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    tok = tokens.load(path)
    docs = frame(spark, ODD)
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (docs, real):
        texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
        rows = tokens.count_tokens(df, path).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids), repr(texts[r.doc_id][:80])
            assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512)
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_whole_tokens_are_proven():
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    whole, tok = tokens.whole_tokens(path), tokens.load(path)
    assert len(whole) > 40_000
    for w in whole[::500]:
        if w == w.strip() and w.isalpha():
            assert len(tok.encode(w, add_special_tokens=False).ids) == 1


def check_packing(rows, texts):
    tok = tokens.load(tokens.vocabulary_path("word_bpe_49k.json"))
    ids = {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids)
    for k, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[k])
    for b in by_bin.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= packing.CAPACITY
    return sum(map(len, ids.values())) / (len(by_bin) * packing.CAPACITY)


def test_packing(spark, sf):
    docs = frame(spark, ODD)
    check_packing(packing.pack_documents(spark, docs).collect(), {i: t or "" for i, t in enumerate(ODD)})
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(spark, real).collect()
    assert check_packing(rows, {r[0]: r[1] for r in real.collect()}) > 0.93
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack_documents(spark, real.repartition(7)).collect()))
    assert packing.pack_documents(spark, docs.limit(0)).count() == 0
    twice = docs.limit(3).union(docs.limit(3)).union(docs.limit(1).selectExpr("null", "text", "source", "0"))
    assert packing.pack_documents(spark, twice).count() == 7


@pytest.mark.parametrize("n", [1, 2, 5, 1365, 1366, 2048, 2049, 4095, 4096, 4097, 20_000])
def test_cuts_add_up(n):
    c = packing.cuts(n)
    assert sum(c) == n and max(c) <= 4096 and min(c) > 0


def test_mixing_equals_its_sql(spark, sf, oracle):
    ours = mixing.op6_mix(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    theirs = oracle(mixing.OP6_SQL).sort_values("doc_id", ignore_index=True)
    assert len(ours) == len(theirs)
    for c in ("doc_id", "size", "source_size", "taken"):
        assert (ours[c] == theirs[c]).all(), c
    assert np.allclose(ours["target"], theirs["target"])
    assert (ours["taken"] <= 2 * ours["size"]).all() and (ours["taken"] >= 0).all()
    by = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas().merge(ours, on="doc_id").groupby("source")
    first = by[["source_size", "target"]].first()
    total = ours["size"].sum()
    assert np.isclose(first["target"].sum(), 1.5 * total) and (first["target"] <= 2 * first["source_size"] + 1e-6).all() and (first["target"] > 0).all()
    assert abs(ours["taken"].sum() / total - 1.5) < 0.2


def test_mixing_targets(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 50 + ["b"] * 2 + ["c"] * 8 + [None] * 5)] + [(99, None, "d"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS mix_size")
    out = mixing.copies(docs, docs.select("source", mixing.words().alias("size")))
    t = {r.source: (r.mix_source_size, r.mix_target) for r in out.collect()}
    total = 650
    assert sum(v[1] for v in t.values()) == pytest.approx(1.5 * total)
    assert t["b"] == (20, 40) and t["d"] == (0, 0)
    assert all(v[1] <= 2 * v[0] + 1e-9 for v in t.values())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    a, b = (sorted(r.doc_id or -1 for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 5))
    assert a == b


def test_runs_of_spaces_take_linear_time():
    import time

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    counts, tok = tokens.PartCounts(path, tokens.whole_tokens(path)), tokens.load(path)
    for text in ("a" + " " * 200_000 + "b", " " * 100_000, "x \t " * 20_000 + "y", "a  b   c " * 30_000):
        began = time.time()
        assert counts.of_text(text) == len(tok.encode(text, add_special_tokens=False).ids)
        assert time.time() - began < 20
