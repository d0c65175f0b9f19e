"""Tokens, weights, similarity, fingerprints, chunks, rewriting and summaries of texts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import strings as X
from ..functions import text as T
from ..operators import textual as O
from ..sources.tables import table

_WS = "list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: w <> '')"
_WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
_B = f"b AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark)"


@query(f"SELECT doc_id, len(w) AS n, w[1] AS first, w[len(w)] AS last FROM (SELECT doc_id, {_WS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL)")
def tokens_whitespace(spark, sf):
    w = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.whitespace_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.size("w") - 1).alias("last"))


@query(f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL)")
def tokens_words(spark, sf):
    w = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query("SELECT gram, COUNT(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM benchmark) GROUP BY gram")
def tokens_ngrams(spark, sf):
    g = table(spark, sf, "benchmark").select(F.explode(T.char_ngrams(F.lower("text"), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, len(list_filter(w, lambda x: length(x) BETWEEN 3 AND 20 AND x NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)}))) AS n FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL)")
def token_count(spark, sf):
    """Words of 3 to 20 letters that aren't stop words."""
    w = F.filter(X.word_tokens(F.col("text")), lambda x: F.char_length(x).between(3, 20) & ~x.isin(*T.STOP_WORDS))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("long").alias("n"))


_GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))"


@query(f"WITH {_B}, g AS (SELECT unnest(list_concat({_GRAMS.format(n=1)}, {_GRAMS.format(n=2)}, {_GRAMS.format(n=3)})) AS gram FROM b) SELECT gram, COUNT(*) AS n FROM g GROUP BY gram")
def token_ngrams(spark, sf):
    w = X.word_tokens(F.col("text"))
    g = table(spark, sf, "benchmark").select(F.explode(F.concat(*[X.token_ngrams(w, n) for n in (1, 2, 3)])).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = ("àâáäãåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


@query(f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS kinds FROM (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), '{_PLAIN[0]}', '{_PLAIN[1]}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)")
def normalised_tokens(spark, sf):
    """Folded to lower case, without accents and punctuation."""
    w = F.filter(F.split(F.translate(F.lower("text"), *_PLAIN), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds"))


_WEIGHTS = f"""{_B}, t AS (SELECT item_id AS id, term, COUNT(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL), f AS (SELECT term, COUNT(*) AS df FROM t GROUP BY term),
l AS (SELECT id, SUM(tf) AS len FROM t GROUP BY id), n AS (SELECT COUNT(*) AS n, AVG(len) AS mean_len FROM l),
w AS (SELECT id, term, tf, tf * (ln((n + 1) / (df + 1.0::DOUBLE)) + 1) AS tfidf, (ln((n + 1) / (df + 1.0::DOUBLE)) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)) AS bm25 FROM t JOIN f USING (term) JOIN l USING (id), n)"""


def weights(spark, sf):
    b = table(spark, sf, "benchmark")
    return O.term_weights(O.word_rows(b, "item_id", X.word_tokens(F.col("text"))))


@query(f"WITH {_WEIGHTS} SELECT id, term, tf, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25, 1.0::DOUBLE AS present FROM w")
def term_weights(spark, sf):
    return weights(spark, sf).select("id", "term", "tf", F.round("tfidf", 6).alias("tfidf"), F.round("bm25", 6).alias("bm25"), "present")


@query(f"WITH {_WEIGHTS}, u AS (SELECT id, term, tfidf / sqrt(SUM(tfidf * tfidf) OVER (PARTITION BY id)) AS v FROM w), p AS (SELECT a.id AS query, b.id, round(SUM(a.v * b.v), 6) AS score FROM u a JOIN u b USING (term) WHERE a.id % 10 = 0 AND a.id <> b.id GROUP BY ALL) SELECT query, id, score FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5")
def tfidf_cosine_pairs(spark, sf):
    """The five items most like every tenth one."""
    w = weights(spark, sf)
    s = O.cosines(w, table(spark, sf, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("id"))).withColumn("score", F.round("score", 6))
    return s.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where("r <= 5").select("query", "id", "score")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT name, unnest(string_split(name, ' ')) AS key FROM n) SELECT DISTINCT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE, 6) AS sim FROM k a JOIN k b USING (key) WHERE a.name < b.name AND 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE >= 0.7")
def levenshtein_pairs(spark, sf):
    """Distinct names that share a word and are alike by edits."""
    k = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.explode(F.split("name", " ")).alias("key"))
    sim = X.edit_similarity(F.col("a"), F.col("b"))
    j = k.withColumnRenamed("name", "a").join(k.withColumnRenamed("name", "b"), "key").where("a < b").select("a", "b").distinct()
    return j.where(sim >= 0.7).select("a", "b", F.round(sim, 6).alias("sim"))


_NEXT = f"{_B}, p AS (SELECT a.item_id AS a, c.item_id AS b, a.w AS x, c.w AS y, regexp_replace(ta.text, '[^a-zA-Z ]', '', 'g') AS s, regexp_replace(tc.text, '[^a-zA-Z ]', '', 'g') AS t FROM b a JOIN b c ON c.item_id = a.item_id + 1 JOIN benchmark ta ON ta.item_id = a.item_id JOIN benchmark tc ON tc.item_id = c.item_id)"


def neighbours(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^a-zA-Z ]", "").alias("text"), X.word_tokens(F.col("text")).alias("w"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("t"), F.col("w").alias("y"))
    return b.join(after, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.col("w").alias("x"), "y", F.col("text").alias("s"), "t")


@query(f"""WITH {_NEXT}, m AS (SELECT a, b, len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y)))::DOUBLE AS jac,
  1 - levenshtein(s, t) / greatest(length(s), length(t))::DOUBLE AS edit, 2.0::DOUBLE * len(list_intersect(list_distinct(x), list_distinct(y))) / (len(list_distinct(x)) + len(list_distinct(y))) AS dice FROM p)
SELECT a, b, round(jac, 6) AS jaccard, round(edit, 6) AS edit, round(dice, 6) AS dice, round((jac * 0.5 + edit * 0.3 + dice * 0.2) / 1.0::DOUBLE, 6) AS score FROM m""")
def text_scores(spark, sf):
    """Each item and the next: by words in common, by edits, and both by weight."""
    p = neighbours(spark, sf)
    x, y = F.array_distinct("x"), F.array_distinct("y")
    p = p.select("a", "b", X.jaccard(x, y).alias("jaccard"), X.edit_similarity(F.col("s"), F.col("t")).alias("edit"), (2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).alias("dice"))
    score = (F.col("jaccard") * 0.5 + F.col("edit") * 0.3 + F.col("dice") * 0.2) / 1.0
    return p.select("a", "b", *[F.round(c, 6).alias(c) for c in ("jaccard", "edit", "dice")], F.round(score, 6).alias("score"))


@query()
def lcs_ratios(spark, sf):
    """The longest common subsequence of each item's words and the next one's; SQL has no fold of this kind."""
    n = X.lcs_length(F.col("x"), F.col("y"))
    return neighbours(spark, sf).select("a", "b", n.alias("lcs"), F.round(n / F.greatest(F.size("x"), F.size("y")), 6).alias("ratio"))


_CODE = "('0x' || substr(md5(w), {at}, 8))::BIGINT"
_SIM = f"c AS (SELECT doc_id AS id, {_CODE.format(at=1)} AS c0, {_CODE.format(at=9)} AS c1 FROM (SELECT doc_id, unnest({_WORDS.format(t='text')}) AS w FROM documents WHERE text IS NOT NULL)), f AS (SELECT id, " + ", ".join("(" + " + ".join(f"CASE WHEN SUM(((c{h} >> {i}) & 1) * 2 - 1) > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + f")::BIGINT AS fp{h}" for h in (0, 1)) + " FROM c GROUP BY id)"


def prints(spark, sf):
    return O.fingerprints(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", X.word_tokens(F.col("text")))


@query(f"WITH {_SIM} SELECT id, fp0, fp1 FROM f")
def simhash_prints(spark, sf):
    return prints(spark, sf)


@query(f"WITH {_SIM}, k AS (SELECT fp0, fp1, min(id) AS rep FROM f GROUP BY ALL) SELECT a.rep AS a, b.rep AS b, (bit_count(xor(a.fp0, b.fp0)) + bit_count(xor(a.fp1, b.fp1)))::INT AS distance FROM k a JOIN k b ON a.rep < b.rep AND bit_count(xor(a.fp0, b.fp0)) + bit_count(xor(a.fp1, b.fp1)) <= 3")
def simhash_dups(spark, sf):
    """Fingerprints within three of 64 bits of each other, by quarters in common."""
    return O.alike_fingerprints(prints(spark, sf))


_SENT = "list_filter(list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"


def sentences(column="text"):
    """A text's sentences: runs that end in full stops, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(F.col(column), F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: x != "")


@query(f"SELECT doc_id, i - 1 AS sentence, length(s[i]) AS size FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT.format(t='text')} AS s FROM documents WHERE text IS NOT NULL))")
def split_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(sentences()).alias("sentence", "s"))
    return s.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.char_length("s").cast("long").alias("size"))


@query()
def sentence_chunks(spark, sf):
    """Sentences packed up to 800 characters, one carried over: a fold within the row, which SQL has not."""
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(O.packed(sentences(), 800, 1)).alias("chunk", "body"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "body")


@query()
def semantic_chunks(spark, sf):
    """Sentences packed up to 800 characters, and chunks under 200 joined to the next."""
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(O.merged(O.packed(sentences(), 800), 200)).alias("chunk", "body"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "body")


@query()
def content_chunks(spark, sf):
    return O.content_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT COUNT(*) AS chunks, MIN(n) AS least, MAX(n) AS most, round(AVG(n), 4) AS mean FROM (SELECT unnest(list_transform(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT)), lambda i: least(length(text) - i * 1000, 1000))) AS n FROM documents WHERE length(text) > 0)")
def chunk_stats(spark, sf):
    """Sizes of chunks of 1,000 characters, from the texts' lengths alone."""
    n = F.char_length("text")
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 1000) - 1, F.lit(0))), lambda i: F.least(n - i * 1000, F.lit(1000)))
    c = table(spark, sf, "documents").where(n > 0).select(F.explode(sizes).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query()
def checksums(spark, sf):
    """CRC-32 of each text's UTF-8."""
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("crc32"))


_STEM = "CASE " + " ".join(f"WHEN suffix(w, '{e}') AND length(w) >= {len(e) + 2} THEN left(w, -{len(e)})" for e in X.ENDINGS) + " ELSE w END"
_SYN = {"thing": "object", "reer": "career", "the": "that", "here": "hither"}


@query(f"WITH {_B} SELECT item_id, i - 1 AS place, {_STEM} AS stem, CASE w {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _SYN.items())} END AS synonym FROM (SELECT item_id, i, w[i] AS w FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b)) WHERE length(w) >= 3 AND w NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)})")
def rewritten_queries(spark, sf):
    """Stop words and short words go, endings are stripped, synonyms stand beside."""
    w = table(spark, sf, "benchmark").select("item_id", F.posexplode(X.word_tokens(F.col("text"))).alias("place", "w")).where((F.char_length("w") >= 3) & ~F.col("w").isin(*T.STOP_WORDS))
    return w.select("item_id", F.col("place").cast("long").alias("place"), X.stem(F.col("w")).alias("stem"), F.expr("CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SYN.items()) + " END").alias("synonym"))


_EDGES = "e AS (SELECT a AS src, b AS dst, n / (SUM(n) OVER (PARTITION BY a))::DOUBLE AS w FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, COUNT(*) AS n FROM part GROUP BY ALL) UNION ALL SELECT b, a, n / (SUM(n) OVER (PARTITION BY b))::DOUBLE FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, COUNT(*) AS n FROM part GROUP BY ALL))"


def synonyms(spark, sf):
    """(src, dst, w): words that stand together in a name, by share, both ways."""
    n = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x, y: n.join(n.groupBy(x).agg(F.sum("n").alias("all")), x).select(F.col(x).alias("src"), F.col(y).alias("dst"), (F.col("n") / F.col("all")).alias("w"))
    return side("a", "b").unionByName(side("b", "a"))


@query(f"WITH {_EDGES}, one AS (SELECT src AS term, dst AS found, w, 1 AS hops FROM e WHERE w >= 0.01), two AS (SELECT term, dst AS found, one.w * e.w AS w, 2 AS hops FROM one JOIN e ON found = src WHERE one.w * e.w >= 0.01 AND dst <> term) SELECT term, found, min(hops) AS hops, round(max(w), 6) AS weight FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL")
def synonym_expansion(spark, sf):
    """Terms within two steps whose weights multiply to 0.01 at least."""
    e = synonyms(spark, sf)
    one = e.where("w >= 0.01").select(F.col("src").alias("term"), F.col("dst").alias("found"), "w", F.lit(1).alias("hops"))
    step = e.select(F.col("src").alias("found"), "dst", F.col("w").alias("w2"))
    two = one.join(step, "found").select("term", F.col("dst").alias("found"), (F.col("w") * F.col("w2")).alias("w"), F.lit(2).alias("hops")).where("w >= 0.01 AND found <> term")
    return one.unionByName(two).groupBy("term", "found").agg(F.min("hops").alias("hops"), F.round(F.max("w"), 6).alias("weight"))


@query("SELECT n_name AS term, 'broader' AS how, r_name AS variant FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'narrower', n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'negated', 'NOT ' || n_name FROM nation UNION ALL SELECT n_name, 'combined', n_name || ' OR ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def expansion_variants(spark, sf):
    """Broader, narrower, negated and combined variants of a term by its place in a hierarchy."""
    h = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = [("n_name", "broader", F.col("r_name")), ("r_name", "narrower", F.col("n_name")), ("n_name", "negated", F.concat(F.lit("NOT "), "n_name")), ("n_name", "combined", F.concat("n_name", F.lit(" OR "), "r_name"))]
    out = F.explode(F.array(*[F.struct(F.col(t).alias("term"), F.lit(how).alias("how"), v.alias("variant")) for t, how, v in rows])).alias("v")
    return h.select(out).select("v.*")


@query(f"WITH {_B}, g AS (SELECT item_id, unnest(list_concat({_GRAMS.format(n=1)}, {_GRAMS.format(n=2)})) AS concept FROM b), t AS (SELECT item_id, concept, COUNT(*) AS tf FROM g GROUP BY ALL), f AS (SELECT concept, COUNT(*) AS df, SUM(tf)::BIGINT AS tf FROM t GROUP BY concept), n AS (SELECT COUNT(*) AS n FROM benchmark) SELECT concept, tf, df, round(tf * ln((n + 1) / (df + 1.0::DOUBLE)), 6) AS score FROM f, n WHERE df >= 2")
def concepts(spark, sf):
    """Words and pairs of words of two items or more, weighted."""
    b = table(spark, sf, "benchmark")
    w = X.word_tokens(F.col("text"))
    t = O.word_rows(b, "item_id", F.concat(X.token_ngrams(w, 1), X.token_ngrams(w, 2)))
    f = t.groupBy(F.col("term").alias("concept")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).where("df >= 2")
    n = F.broadcast(b.agg(F.count(F.lit(1)).alias("n")))
    return f.join(n).select("concept", "tf", "df", F.round(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("score"))


@query(f"WITH {_WEIGHTS} SELECT id, term AS tag, round(tfidf, 6) AS score FROM w WHERE length(term) >= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(tfidf, 6) DESC, term) <= 3")
def tags(spark, sf):
    """The three heaviest words of each item."""
    w = weights(spark, sf).where(F.char_length("term") >= 4).withColumn("score", F.round("tfidf", 6))
    return w.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "term"))).where("r <= 3").select("id", F.col("term").alias("tag"), "score")


@query(f"WITH {_B}, x AS (SELECT item_id, i, w[i] AS t FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b)) SELECT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b, COUNT(*) AS weight FROM x a JOIN x b ON a.item_id = b.item_id AND b.i > a.i AND b.i <= a.i + 3 AND a.t <> b.t GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def cooccurrence_edges(spark, sf):
    """Words within three places of each other: formed inside the row, so only pairs leave it."""
    w = table(spark, sf, "benchmark").select(X.word_tokens(F.col("text")).alias("w"))
    near = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, 3), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    p = w.select(F.explode(near).alias("p")).select("p.*").where("a <> b")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where("weight >= 2")


@query(f"WITH x AS (SELECT doc_id, list_intersect(list_distinct({_WORDS.format(t='text')}), ['thing', 'the', 'reer', 'heit']) AS m FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(m) AS t FROM x) SELECT a.t AS a, b.t AS b, COUNT(*) AS documents FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY 1, 2")
def concept_cooccurrence(spark, sf):
    """Documents that mention both of two concepts, for each two of a list."""
    m = F.array_sort(F.array_intersect(X.word_tokens(F.col("text")), F.array(*[F.lit(x) for x in ("thing", "the", "reer", "heit")])))
    pairs = F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.explode(pairs).alias("p"))
    return d.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("documents"))


_LEX = {"thing": 1.0, "reer": -1.0, "ation": 0.5, "heit": -0.5, "onen": 0.8, "eau": 0.7, "ch": -0.3, "la": 0.2}
_CASE = "CASE {w} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LEX.items()) + " ELSE 0.0 END"
_MOOD = f"m AS (SELECT conv_id, turn, role, w, list_sum(list_transform(range(1, len(w) + 1), lambda i: ({_CASE.format(w='w[i]')})::DOUBLE * (CASE WHEN i > 1 AND w[i - 1] IN ('not', 'no', 'et', 'the') THEN -1 ELSE 1 END))) AS s FROM (SELECT conv_id, turn, role, {_WORDS.format(t='text')} AS w FROM conversations WHERE text IS NOT NULL))"


def mood(spark, sf):
    """(conv_id, turn, role, s): the lexicon's weights, turned round behind a negator."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", X.word_tokens(F.col("text")).alias("w"))
    before = lambda i: F.when(i > 0, F.get("w", i - 1).isin("not", "no", "et", "the")).otherwise(False)
    weight = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in _LEX.items() for v in kv]), x), F.lit(0.0))
    signed = F.transform("w", lambda x, i: weight(x) * F.when(before(i), -1).otherwise(1))
    return c.select("conv_id", "turn", "role", F.when(F.size("w") > 0, F.aggregate(signed, F.lit(0.0), lambda a, b: a + b)).alias("s"))


@query(f"WITH {_MOOD} SELECT conv_id, turn, round(s, 6) AS score, CASE WHEN s > 0.5 THEN 'positive' WHEN s < -0.5 THEN 'negative' ELSE 'neutral' END AS polarity FROM m")
def sentiment(spark, sf):
    s = F.col("s")
    return mood(spark, sf).select("conv_id", "turn", F.round("s", 6).alias("score"), F.when(s > 0.5, "positive").when(s < -0.5, "negative").otherwise("neutral").alias("polarity"))


@query(f"WITH {_MOOD} SELECT role, COUNT(*) AS n, round(AVG(s), 6) AS mean, SUM(CASE WHEN s > 0.5 THEN 1 ELSE 0 END)::BIGINT AS positive, SUM(CASE WHEN s < -0.5 THEN 1 ELSE 0 END)::BIGINT AS negative FROM m GROUP BY role")
def sentiment_by_role(spark, sf):
    return mood(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.count_if(F.col("s") > 0.5).alias("positive"), F.count_if(F.col("s") < -0.5).alias("negative"))


@query(f"SELECT item_id, array_to_string(s[1:2], ' ') AS summary FROM (SELECT item_id, {_SENT.format(t='text')} AS s FROM benchmark)")
def summary_lead(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(sentences(), 1, 2), " ").alias("summary"))


@query(f"""WITH {_WEIGHTS}, s AS (SELECT item_id AS id, i, s[i] AS body FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, {_SENT.format(t='text')} AS s FROM benchmark))),
x AS (SELECT id, i, body, unnest({_WORDS.format(t='body')}) AS term FROM s), y AS (SELECT x.id, i, any_value(body) AS body, round(AVG(tfidf), 6) AS score FROM x JOIN w ON w.id = x.id AND w.term = x.term GROUP BY x.id, i),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, i) <= 2) SELECT id, string_agg(body, ' ' ORDER BY i) AS summary FROM z GROUP BY id""")
def summary_tfidf(spark, sf):
    """The two sentences whose words weigh most on average, in their order."""
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(sentences()).alias("i", "body"))
    x = s.select("id", "i", "body", F.explode(X.word_tokens(F.col("body"))).alias("term")).join(weights(spark, sf), ["id", "term"])
    y = x.groupBy("id", "i").agg(F.first("body").alias("body"), F.round(F.avg("tfidf"), 6).alias("score"))
    z = y.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "i"))).where("r <= 2")
    return z.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda v: v["body"]), " ").alias("summary"))


@query()
def summary_textrank(spark, sf):
    """The two sentences of highest rank, in their order: a power iteration within each text."""
    s = table(spark, sf, "benchmark").select("item_id", sentences().alias("s"))
    r = s.select("item_id", "s", O.text_rank(F.col("s")).alias("rank"))
    order = F.transform(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0))), lambda i: F.struct((-F.round(F.get("rank", i), 9)).alias("r"), i.alias("i")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(order), 1, 2), lambda x: x["i"]))
    return r.where(F.size("s") > 0).select("item_id", F.array_join(F.transform(best, lambda i: F.get("s", i)), " ").alias("summary"))
