"""Tokenizers, n-grams, stems, similarity of strings and fingerprints, as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings that stemming strips, in order, where two letters or more are left.
ENDINGS = ["tion", "ness", "ment", "ing", "ed", "ly"]


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_ngrams(words: Column, n: int) -> Column:
    """Runs of n words; none for fewer words."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def stem(word: Column) -> Column:
    out = word
    for end in reversed(ENDINGS):
        out = F.when(word.endswith(end) & (F.char_length(word) >= len(end) + 2), F.substring(word, F.lit(1), F.char_length(word) - len(end))).otherwise(out)
    return out


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def lcs_length(a: Column, b: Column) -> Column:
    """The longest common subsequence of two arrays: a row of the table at a time, folded over a; each row folds over b."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            diagonal = F.when(i > 1, F.get(before, i - 2)).otherwise(0) + 1
            left = F.when(i > 1, F.get(done, i - 2)).otherwise(0)
            return F.concat(done, F.array(F.when(F.element_at(b, i) == x, diagonal).otherwise(F.greatest(F.get(before, i - 1), left))))

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array().cast("array<int>"), cell)).otherwise(before)

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
