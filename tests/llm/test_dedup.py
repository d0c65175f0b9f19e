import random
import re
from collections import defaultdict

import numpy as np

from sparkloom.llm import linededup, neardup
from sparkloom.llm.common import Scratch
from sparkloom.llm.links import components


def grouped(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.id: r.comp for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == grouped([e for e in edges if e[0] != e[1]], ids)


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 4:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute(sets):
    holds = defaultdict(list)
    links = set()
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    seen = set()
    for ids in holds.values():
        for i in ids:
            for j in (ids if len(ids) < 60 or len(sets) < 1000 else ids[:1]):
                if j < i and (j, i) not in seen:
                    seen.add((j, i))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        links.add((j, i))
    return links


def check_near(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: word_set(t) for i, t in texts.items() if i is not None}
    want = grouped(brute(sets), sets)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i].component_id for i in sets} == want
    assert all(got[i].kept == (want[i] == i) for i in sets)


def test_near_dup_equals_brute_force(spark):
    check_near(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_near_dup_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One  two"), (5, "one two"), (6, "one two three"), (7, base), (8, base.upper()), (9, base + " x"), (10, "é " + base[:-20]), (11, "A\x0bb\xa0c d"), (12, "a b\xa0c d"), (None, base), (7, base), (13, "lång " * 30_000)]
    rows += [(100 + i, base.replace(f"w{i * 7} ", f"v{i} ")) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS component_id", "2 AS id")
    check_near(spark, docs)
    assert neardup.near_duplicates(docs).count() == len(rows)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 4, 6, 7, 11, 13]


def test_near_dup_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = [f"k{x}" for x in rng.integers(0, 10**9, 203)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-22], *(f"q{x}" for x in rng.integers(0, 10**9, 22))]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(300))


WHITE = " \t\r\x0b\x0c"


def line_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute_lines(rows):
    """The texts left, by comparing all distinct lines that share a shingle."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for p, raw in enumerate((t or "").split("\n")):
            if raw.strip(WHITE):
                first.setdefault(raw.strip(WHITE), (d, p))
    names = {line: i for i, line in enumerate(first)}
    sets = {i: line_set(line) for line, i in names.items()}
    comp = grouped(brute(sets), sets)
    keep = {}
    for line, at in first.items():
        c = comp[names[line]]
        keep[c] = min(at, keep.get(c, at))
    return {d: None if t is None else "\n".join(raw for p, raw in enumerate(t.split("\n")) if not raw.strip(WHITE) or keep[comp[names[raw.strip(WHITE)]]] == (d, p)) for d, t in rows}


def test_lines_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in linededup.op10_line_dedup(spark, sf).collect()}
    want = brute_lines(rows)
    assert len(got) == len(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.005 * len(want), wrong


def test_lines_odd_rows(spark):
    long = "abcdefghij klmnop qrstuv wxyz 0123456789 " * 3
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"  {long}  \nshort\n\nshort"), (5, f"{long}!\nother\r"), (6, "é" * 7), (7, "é" * 8), (8, "x\ny"), (9, "y\nx\nz"), (10, "q" * 30_000 + "\n" + "q" * 29_000), (11, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L AS n_chars", "'k' AS h", "1 AS place", "2 AS line")
    out = linededup.dedup_lines(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(rows)
    assert out.columns == [*docs.columns, "__lines", "__gone"]
    assert {r.doc_id: r.n_chars for r in out.collect()} == {k: len(v or "") for k, v in got.items()}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    twice = docs.union(docs).union(docs.limit(4).selectExpr("CAST(null AS LONG)", "text", "n_chars", "h", "place", "line"))
    assert linededup.dedup_lines(twice).count() == 2 * len(rows) + 4


def test_lines_of_repeated_and_null_ids(spark):
    """A row is told by its text too: nothing that only one row has goes with another row's lines."""
    rows = [(None, "twice said here\nonly in the first"), (None, "twice said here\nonly in the second"), (5, "once five one\ntwice said here"), (5, "another five\n\t\n"), (5, "another five\n\t\n"), (6, "\r\nsix"), (7, "\r\nseven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(docs).collect())
    assert got == sorted([("None", "only in the first"), ("None", "only in the second"), ("5", "once five one\ntwice said here"), ("5", "another five\n\t\n"), ("5", "another five\n\t\n"), ("6", "\r\nsix"), ("7", "\r\nseven")])


def test_line_recall_at_the_threshold(spark):
    """Pairs of lines with a similarity of 0.8 to 0.82: by sums over the values that may agree 99.85 of 100 meet."""
    rng, rows, n = random.Random(8), [], 0
    while n < 600:
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(220))
        for cut in range(15, 30):
            other = base[:-cut] + "".join(rng.choice("QRSTUV") for _ in range(cut))
            a, b = line_set(base.strip()), line_set(other.strip())
            if 0.8 <= len(a & b) / len(a | b) <= 0.82:
                rows += [(2 * n, base.strip()), (2 * n + 1, other.strip())]
                n += 1
                break
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == "" for i in range(n)) >= n - 5
    assert all(got[2 * i] == rows[2 * i][1] for i in range(n))


def test_near_dup_of_repeated_ids(spark):
    """Of an id's texts the one with the least hash stands for it; its rows share one component and one decision."""
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (2, " ".join(w)), (2, "quite another text here"), (3, "quite another text here"), (4, "four")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    comp = {r.doc_id: {x.component_id for x in out if x.doc_id == r.doc_id} for r in out}
    assert all(len(c) == 1 for c in comp.values()) and comp[2] in ({1}, {2}) and comp[4] == {4}
    assert sorted(r.n_shingles for r in out if r.doc_id == 2) == [1, 97]
    assert len({r.kept for r in out if r.doc_id == 2}) == 1


def test_a_large_family_without_its_origin(spark):
    """Copies of a text that isn't there, each with changes of its own: more than a block, linked by chance or not at all."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"))
