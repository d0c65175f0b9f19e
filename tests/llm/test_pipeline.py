import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
from sparkloom.llm import toxicity
from sparkloom.llm.common import Scratch
from test_dedup import brute, brute_lines, grouped
from test_language_toxicity import naive_score


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, scratch, before = docs.columns, Scratch(spark, "t"), docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf))
        assert docs.columns == columns, name
        n = docs.count()
        assert n <= before if name != "mix" else n > 0
        if name == "line dedup":
            assert n == before
        if name == "near-dup":
            assert n == docs.select("doc_id").distinct().count()
        before = n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("start = 0").count() == docs.count()


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_near_dup_stage_takes_five_words(spark):
    """Against brute force, with pairs on either side of the threshold: at 5 changes 0.816 of runs of four, 0.774 of five."""
    texts = {}
    for i, changes in enumerate((1, 2, 3, 4, 5, 6, 9)):
        words = [f"w{i}x{j}" for j in range(200)]
        texts[2 * i] = " ".join(words)
        for c in range(changes):
            words[(2 * c + 1) * 200 // (2 * changes)] = f"v{i}x{c}"
        texts[2 * i + 1] = " ".join(words)
    runs = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    like = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a, b in combinations(texts, 2)}
    gone = {b for (a, b), x in like.items() if x >= 0.8}
    assert gone == {1, 3, 5, 7} and 0.77 < like[8, 9] < 0.78
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = corpus_pipeline.near_dup_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == texts.keys() - gone


def mixed_counts(rows):
    """How often each id is taken, by filling up the sources' targets step by step."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * total[s]]
        for s in full or list(open_):
            target[s] = 2 * total[s] if full else share * weight[s]
            left -= target[s]
            open_.discard(s)
    out = {}
    for i, _, s in rows:
        rate = target[s] / total[s] if total[s] else 0.0
        u = int(hashlib.md5(f"{'' if i is None else i}|mix-1".encode()).hexdigest()[:13], 16) / 16**13
        out[i] = math.floor(rate) + (u < rate - math.floor(rate))
    return out


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    scratch, f = Scratch(spark, "t"), dict(corpus_pipeline.STAGES)
    model = toxicity.trained(spark, sf, docs)
    docs = scratch.table(f["toxicity"](spark, docs, sf))
    rows = [r for r in rows if naive_score(r[1], model) < 0.5]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in rows)
    docs = scratch.table(f["line dedup"](spark, docs, sf))
    left = brute_lines([(i, t) for i, t, _ in rows])
    assert {r.doc_id: r.text for r in docs.collect()} == left
    rows = [(i, left[i], s) for i, _, s in rows]
    docs = scratch.table(f["near-dup"](spark, docs, sf))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, _ in rows}
    sets = {i: ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()) for i, w in words.items()}
    comp = grouped(brute(sets), sets)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in rows)
    docs = scratch.table(f["mix"](spark, docs, sf))
    want = {i: n for i, n in mixed_counts(rows).items() if n}
    assert Counter(r.doc_id for r in docs.collect()) == want
    pieces = f["packing"](spark, docs, sf).collect()
    for i, n in want.items():
        own = Counter((r.start, r.length) for r in pieces if r.doc_id == i)
        tokens = {r.doc_tokens for r in pieces if r.doc_id == i}
        assert set(own.values()) == {n} and len(tokens) == 1 and sum(k[1] for k in own) == tokens.pop()
    for s in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 4096


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, names that clash and an empty table, through all stages."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "a", 1), (1, base, "a", 1), (2, None, None, 0), (3, "", "b", 0), (None, base, "a", 2), (None, None, None, None), (4, base + " more", "b", 3), (5, "x\ny\nx", "c", 5), (6, "z " * 9000, "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").selectExpr("*", "'k' AS h", "1 AS place", "2 AS mix_size", "3 AS size", "'v' AS row", "4 AS id", "5 AS copy", "'c' AS comp")
    spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        now, scratch = start, Scratch(spark, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = scratch.table(stage(spark, now, str(tmp_path)))
            assert now.columns == docs.columns, name
            assert now.where("mix_size <> 2 OR h <> 'k' OR comp <> 'c' OR row <> 'v'").isEmpty(), name
            if name == "near-dup" and start is docs:
                assert sorted(str(r.doc_id) for r in now.collect()) == ["1", "2", "3", "4", "5", "6", "None", "None"]
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert out.where("start = 0").count() == now.count()
