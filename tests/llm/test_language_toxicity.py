import math
import zlib

import numpy as np
import pytest

from sparkloom.llm import language, toxicity


def test_language_held_out(spark):
    rows = language.op9_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_and_odd_rows(spark):
    en, de = "the house of another thing with that ", "der die das einung verheit schaft und "
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de", 1.0) for i in range(20)], "doc_id long, text string, lang string, score double")
    names, logp = language.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, en * 20 + de * 20), (5, de), (None, en), (5, de), (6, en * 20_000)], "doc_id long, text string").selectExpr("*", "'zz' AS lang_pred")
    got = [(r.doc_id, r.lang_pred, r.score, [x.lang for x in r.langs]) for r in language.identify(odd, names, logp).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 8 and [by[i][1] for i in (1, 2, 3)] == ["und"] * 3
    assert sorted(by[4][3]) == ["de", "en"] and 0.4 < by[4][2] < 0.6
    assert by[5][1:] == ("de", 1.0, ["de"]) and by[None][1] == "en" and by[6][1] == "en"
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, *none).collect()} == {"und"}
    assert language.identify(odd.limit(0), names, logp).count() == 0


def test_language_lists_all_that_a_document_mixes(spark):
    """Nine languages are learned; documents mix one to nine of them, in equal parts or with a small one."""
    heads = "ba ke mi do fu ga re si to".split()
    names = [f"l{h}" for h in heads]
    words = {n: [f"{h}{a}{h}{b}{h[::-1]}" for a in "bcdfg" for b in "klmnp"] for n, h in zip(names, heads, strict=True)}
    docs = spark.createDataFrame([(i, " ".join(words[n]), n) for i, n in enumerate(names * 3)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model[0] == sorted(names)
    rows = [(k, " ".join(" ".join(words[n]) for n in names[:k])) for k in range(1, 10)]
    rows.append((10, " ".join(" ".join(words[n]) * 1 if n == names[6] else " ".join(words[n] * 4) for n in names[:7])))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), *model).collect()}
    for k in range(1, 10):
        assert sorted(x.lang for x in got[k].langs) == sorted(names[:k]), k
        assert abs(got[k].score - 1 / k) < 0.03, k
    assert sorted(x.lang for x in got[10].langs) == sorted(names[:7])
    assert abs(min(x.share for x in got[10].langs) - 1 / 25) < 0.01


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    hit = sum(rows[r.doc_id].predicted for r in labels if r.toxic)
    false = sum(rows[r.doc_id].predicted for r in labels if not r.toxic)
    toxic = sum(r.toxic for r in labels)
    # Some labels in the tables stand with junk made from toxic documents, in which no word is left.
    assert hit / toxic > 0.9 and false / (len(labels) - toxic) < 0.02
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


def test_folding_and_exceptions(spark):
    assert toxicity.fold("1D10T ｃlown ѕсum M0R0N $tupid lo$er") == "idiot ciown scum moron $tupid ioser"
    model = toxicity.Model({"idiot": 3.0, toxicity.fold("trash"): 2.0}, ["trash can"], (-2.0, 3.0, 1.0))
    a = model.matcher()
    assert toxicity.matches(toxicity.fold("You 1d1ot!"), a)[0] == 3.0
    assert toxicity.matches("the trash can", a)[0] == 0 and toxicity.matches("trash###", a)[0] == 2.0
    assert toxicity.matches("idiotic", a)[0] == 0
    stem = toxicity.Model({"grau*": 2.0}, [], (-2.0, 3.0, 1.0)).matcher()
    assert [toxicity.matches(t, stem)[0] for t in ("grauen", "grau grauen grauem", "grau grau", "ungrauen ungraue")] == [0, 2.0, 0, 0]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "an idiot"), (None, "x"), (3, "an idiot"), (4, "fine " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {1: 0, 2: 0, 3: 1, None: 0, 4: 0}
    assert toxicity.without_toxic(docs, model).columns == docs.columns and toxicity.without_toxic(docs, model).count() == 4
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 5])
def test_train_small(spark, n):
    """What stands around the telling word is in clean documents too, so only that word is learned."""
    docs = spark.createDataFrame([(i, f"w{i % 5} x{i % 3}y {'clown' if i % 2 else 'kind'} w{i} a") for i in range(n * 8)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.train(docs, labels)
    assert list(model.terms) == ([toxicity.fold("clown")] if n else [])


def test_explained_words_need_several_contexts():
    """On held-out labels, words in documents that another explains help if they stand in several contexts (half a say each)."""
    docs = [{"bad": f"a{i}", "copy": "same", "often": f"b{i % 5}"} for i in range(20)]
    kept = toxicity._explaining([("bad", 3.0), ("copy", 2.9), ("often", 2.8)], docs, 1.5)
    assert list(kept) == ["bad", "often"]


def naive_score(text, model):
    """The score by looking for each entry by itself, at every place."""
    t, weight = toxicity.fold(text or ""), 0.0
    weights = dict(model.terms) | {e: -sum(model.terms.get(w, 0.0) for w in e.split(" ")) for e in model.exceptions}
    for entry, w in weights.items():
        stem, at, seen = entry.rstrip("*"), t.find(entry.rstrip("*")), 0
        while at >= 0:
            after = t[at + len(stem) : at + len(stem) + 1]
            if not t[max(0, at - 1) : at].isalpha() and after.isalpha() == (entry[-1] == "*"):
                seen += 1
            at = t.find(stem, at + 1)
        weight += w * (max(0, seen - 1) if entry[-1] == "*" else seen)
    weight = max(0.0, weight)
    a, b = math.log1p(weight), math.log1p(100 * weight / max(1, t.count(" ") + t.count("\n") + 1))
    p = 1 / (1 + math.exp(-(model.coef[0] + model.coef[1] * a + model.coef[2] * b)))
    return p if weight else min(p, 0.49)


def test_scores_equal_a_naive_matcher(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.trained(spark, sf, docs)
    assert model.terms
    got = {r.doc_id: r.score for r in toxicity.op8_toxicity(spark, sf).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(naive_score(r.text, model), abs=1e-9), r.doc_id


def plain_mixture(text, logp, penalty=2.0):
    """Shares of languages in one text by expectation-maximisation written out word by word, dropping one at a time."""
    c = "\n" + text.lower() + "\n"
    code = [ord(x) if x.isalpha() else 32 for x in c]
    words, m = [], 2**32
    for i in range(1, len(c) - 1):
        if c[i].isalpha():
            h = (code[i - 1] * 0x9E3779B1 ^ code[i] * 0x85EBCA77 ^ code[i + 1] * 0xC2B2AE3D) % m
            h ^= h >> 15
            h = ((h * 0x2C1B3C6D % m) >> 17) % language.BUCKETS
            if not c[i - 1].isalpha():
                words.append(np.zeros(logp.shape[1]))
            words[-1] = words[-1] + logp[h]
    if not words:
        return np.zeros(logp.shape[1])
    lik = np.array([np.exp(w - w.max()) for w in words])

    def rounds(pi, n):
        for _ in range(n):
            r = lik * pi
            pi = (r / (r.sum(1, keepdims=True) + 1e-30)).mean(0)
        return pi, np.log((lik * pi).sum(1) + 1e-30).sum()

    pi, ll = rounds(np.full(logp.shape[1], 1 / logp.shape[1]), 5)
    while (pi > 0).sum() > 1:
        fewer = pi.copy()
        fewer[np.where(pi > 0, pi, np.inf).argmin()] = 0
        fewer, ll2 = rounds(fewer / fewer.sum(), 3)
        if ll2 + penalty * math.log(len(words) + 1) / 2 < ll:
            break
        pi, ll = fewer, ll2
    return pi


def test_mixtures_equal_plain_em(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    names, logp = language.train(docs)
    texts = {r.doc_id: (r.text or "")[:3000] for r in docs.collect()}
    cut = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in language.identify(cut, names, logp).collect():
        want = plain_mixture(texts[r.doc_id], logp.astype(float))
        assert {x.lang for x in r.langs} == {n for n, w in zip(names, want, strict=True) if w > 0}, r.doc_id
        assert all(x.share == pytest.approx(want[names.index(x.lang)], abs=2e-3) for x in r.langs)
