"""Token counts and token ids by a public tokenizer's vocabulary, without running its whole pipeline on every text.

Both ways rest on one fact: the tokenizer never joins characters across a space that follows a character other than
white space. A text is therefore split at its spaces, and each part is looked up in a bounded memo; only parts not seen
lately are split into pre-tokens, and only pre-tokens that the vocabulary doesn't hold whole are merged.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Entries that a worker's memo holds before it starts anew, and characters of an entry; longer ones are worked out each time.
MEMO, LONGEST = 300_000, 256
_DIRTY = 1 << 40


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def as_bytes(piece: str) -> str:
    return "".join([BYTE_CHARS[b] for b in piece.encode()])


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings proven to encode alone, as a single pre-token, to exactly one token; at most the vocabulary."""
    tok = load(path)
    back = {c: b for b, c in BYTE_CHARS.items()}
    found = []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            plain = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if [t.id for t in tok.model.tokenize(s)] == [i]:
            found.append(plain)
    return found


class PartCounts(dict):
    """Tokens of ' ' + part, for parts that don't end in white space; _DIRTY for the others, which must not be split off."""

    # Fixed value: the tokenizer's own split pattern.
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, whole: list[str]):
        super().__init__()
        self.tok, self.whole, self.merged = load(path), frozenset(whole), {}
        self.model = self.tok.model

    def __missing__(self, part: str) -> int:
        if not part or part[-1].isspace():
            return _DIRTY
        n = self.count(" " + part)
        if len(part) <= LONGEST:
            if len(self) > MEMO:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        # Beyond Latin letters the libraries' Unicode tables may differ, and special tokens have rules of their own.
        if "<|" in text or not text.isascii() and max(text) > "ɏ":
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        total = 0
        for piece in self.PIECE.findall(text):
            if piece in self.whole:
                total += 1
                continue
            n = self.merged.get(piece)
            if n is None:
                n = len(self.model.tokenize(as_bytes(piece)))
                if len(piece) <= LONGEST:
                    if len(self.merged) > MEMO:
                        self.merged.clear()
                    self.merged[piece] = n
            total += n
        return total

    def of_text(self, text: str) -> int:
        first, *parts = text.split(" ")
        if first and not first[-1].isspace():
            n = self.count(first) + sum(map(self.__getitem__, parts))
            if n < _DIRTY:
                return n
        # Runs of white space: parts that end in it stay together with the next.
        total, held, end = 0, [first], first[-1:]
        for part in parts:
            if not end or end.isspace():
                held.append(part)
            else:
                total += self.count(" ".join(held))
                held = ["", part]
            end = part[-1] if part else " "
        held = " ".join(held)
        return total + (self.count(held) if held else 0)


_COUNTS: dict[str, PartCounts] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, in one pass without a shuffle.

    The list of whole tokens is proven on the driver once and broadcast; it has at most as many entries as the vocabulary.
    Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; ids pass as they are.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTS:
            _COUNTS[path] = PartCounts(path, whole.value)
        count = _COUNTS[path].of_text
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


class PartIds(dict):
    """The ids of a part between spaces, as little-endian unsigned 32-bit bytes, by a tokenizer that drops white space."""

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")

    def __init__(self, path: str):
        super().__init__()
        self.tok, self.pieces = load(path), {}
        self.model = self.tok.model

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) <= LONGEST:
            if len(self) > MEMO:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, part: str) -> bytes:
        if "<|" in part or not part.isascii() and (max(part) > "ɏ" or not unicodedata.is_normalized("NFC", part)):
            return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(part, add_special_tokens=False).ids)
        found = self.LATIN.findall(part.lower()) if not part.isascii() else self.PIECE.findall(part.lower())
        if len(found) == 1:
            return self.piece(found[0])
        return b"".join([self.piece(p) for p in found])

    LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(as_bytes(piece))])
            if len(piece) <= LONGEST:
                if len(self.pieces) > MEMO:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split(" ")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
