"""Media columns: AVI motion-JPEG written from and read to byte payloads, with shot detection.

A payload of n * 192 bytes becomes n grey frames of 16 x 12 samples, each a JPEG image of the lossless process (SOF3,
predictor 1). Its Huffman table gives category c a code of 9 - c bits; with the c bits that follow, every difference
takes 9 bits, so encoding and decoding whole batches of frames are array operations, and the samples come back as they
were. The reader trusts the file alone: it walks the RIFF lists, takes the frames by idx1, and decodes them.

Everything is per row, inside two map stages without a shuffle; a batch is worked off in slices of a few MB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
PACKED = FRAME * 9 // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Categories 8, 7, ... 0 have codes of 1, 2, ... 9 bits: 0, 10, 110, ...
_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
_EOI = b"\xff\xd9"


def _words() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference -255..255 and back."""
    word = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << c) - 1
        code = ((1 << (8 - c)) - 1) << 1  # 8 - c ones and a zero
        word[d + 255] = code << c | bits
    back = np.zeros(512, np.int16)
    back[word] = np.arange(-255, 256)
    return word, back


WORD9, DIFF = _words()


def pack9(words: np.ndarray) -> np.ndarray:
    """(n, FRAME) 9-bit words to (n, PACKED) bytes."""
    w = words.reshape(-1, 8)
    out = np.zeros((len(w), 9), np.uint8)
    for j in range(8):  # word j begins at bit 9 * j = byte j, bit j
        out[:, j] |= (w[:, j] >> (1 + j)).astype(np.uint8)
        out[:, j + 1] |= (w[:, j] << (7 - j)).astype(np.uint8)
    return out.reshape(-1, PACKED)


def unpack9(data: np.ndarray) -> np.ndarray:
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for j in range(8):
        out[:, j] = (b[:, j] << (1 + j) | b[:, j + 1] >> (7 - j)) & 511
    return out.reshape(-1, FRAME)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def encode_frames(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' AVI chunks in one array, and each chunk's size with its head and padding."""
    x = payload.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    packed = pack9(WORD9[d.reshape(-1, FRAME) + 255])
    ff = packed == 255
    stuffed = PACKED + ff.sum(1)
    size = len(_HEAD) + stuffed + 2
    chunk = 8 + size + size % 2
    at = np.cumsum(chunk) - chunk
    out = np.zeros(int(chunk.sum()), np.uint8)
    heads = np.zeros((len(at), 8 + len(_HEAD)), np.uint8)
    heads[:] = np.frombuffer(b"00dc\0\0\0\0" + _HEAD, np.uint8)
    heads[:, 4:8] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at[:, None] + np.arange(heads.shape[1])] = heads
    step = 1 + ff.ravel()
    place = np.cumsum(step) - step  # of each byte in the stuffed stream
    base = np.cumsum(stuffed) - stuffed
    out[place + np.repeat(at + heads.shape[1] - base, PACKED)] = packed.ravel()
    end = at + heads.shape[1] + stuffed
    out[end], out[end + 1] = _EOI
    return out, chunk


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def container(movi: bytes, chunk: np.ndarray) -> bytes:
    """One AVI file of the frame chunks."""
    n, largest = len(chunk), int(chunk.max())
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2] = 4 + np.cumsum(chunk) - chunk
    index[:, 3] = np.frombuffer(movi, np.uint8)[(index[:, 2] - 4)[:, None] + np.arange(4, 8)].copy().view("<u4").ravel()
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes()))


def frame_index(avi: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each frame's JPEG data in the file, from its idx1."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, idx = 12, None, None
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], int.from_bytes(avi[at + 4 : at + 8], "little")
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            idx = np.frombuffer(avi, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or idx is None:
        raise ValueError("an AVI file without movi or idx1")
    return idx[:, 2].astype(np.int64) + movi + 8, idx[:, 3].astype(np.int64)


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, FRAME) samples of the JPEG images at start..start + size, all of this module's geometry and tables."""
    if (data[start[:, None] + np.arange(len(_HEAD))] != np.frombuffer(_HEAD, np.uint8)).any():
        raise ValueError("a frame of another kind than 16 x 12 lossless grey")
    body = data[_spread(start + len(_HEAD), size - len(_HEAD) - 2)]
    keep = np.ones(len(body), bool)
    keep[1:] = (body[:-1] != 255) | (body[1:] != 0)
    d = DIFF[unpack9(body[keep])].reshape(-1, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def cut_points(frames: np.ndarray, first: np.ndarray, window: int = 8, k: float = 2.0, floor: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """For each frame, its histogram's distance from the frame before (0..1), and whether a shot begins with it.

    A cut's distance exceeds the mean of the distances within `window` frames either way, in its own file, by k of their
    standard deviations and by `floor`. first: True where a file begins; a file's first frame begins a shot.
    """
    n = len(frames)
    hist = np.bincount((np.arange(n)[:, None] * 16 + (frames >> 4)).ravel(), minlength=n * 16).reshape(n, 16)
    dist = np.zeros(n)
    dist[1:] = np.abs(hist[1:] - hist[:-1]).sum(1) / (2 * FRAME)
    dist[first] = 0
    begin = np.flatnonzero(first)
    sizes = np.diff([*begin, n])
    lo = np.maximum(np.arange(n) - window, np.repeat(begin + 1, sizes))
    hi = np.minimum(np.arange(n) + window + 1, np.repeat(begin + sizes, sizes))
    count = np.maximum(hi - lo, 1)
    scaled = np.rint(dist * 2 * FRAME).astype(np.int64)  # whole numbers, so that equal files give equal sums in any batch
    one, two = (np.concatenate([[0], np.cumsum(v)]) for v in (scaled, scaled**2))
    lo, hi = np.minimum(lo, n), np.maximum(hi, lo)
    mean = (one[hi] - one[np.minimum(lo, hi)]) / count
    std = np.sqrt(np.maximum((two[hi] - two[np.minimum(lo, hi)]) / count - mean**2, 0))
    return dist, first | (scaled > mean + k * std + floor * 2 * FRAME)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % FRAME or (FRAME if not data else 0))


def write_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text, padded to whole frames, as an AVI file.

    Defined results: a null or empty text is one frame of blanks; repeated rows give repeated files. A file is at most
    4 GB, as the format's sizes are 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                loads = [payload_of(t) for t in texts]
                movi, chunk = encode_frames(np.frombuffer(b"".join(loads), np.uint8))
                ends = np.cumsum([len(p) // FRAME for p in loads])
                offsets = np.concatenate([[0], np.cumsum(chunk)])
                files, a = [], 0
                for b in ends:
                    files.append(container(movi[offsets[a] : offsets[b]].tobytes(), chunk[a:b]))
                    a = b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, media binary")


def _read(part: pa.RecordBatch):
    """Files, samples, each file's first frame and frame count, distances and shot starts of a slice of media rows."""
    files = part.column(part.schema.get_field_index("media")).to_pylist()
    starts, sizes, counts, base = [], [], [], 0
    for f in files:
        s, z = frame_index(f)
        starts.append(s + base), sizes.append(z), counts.append(len(s))
        base += len(f)
    frames = decode_frames(np.frombuffer(b"".join(files), np.uint8), np.concatenate(starts), np.concatenate(sizes))
    begin = np.cumsum(counts) - counts
    first = np.zeros(len(frames), bool)
    first[begin] = True
    return files, frames, begin, counts, *cut_points(frames, first)


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, shot, start_frame, end_frame, start_s, end_s, mean_level): a row for each shot of each media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                _, frames, begin, counts, _, cut = _read(part)
                a = np.flatnonzero(cut)
                b = np.append(a[1:], len(frames))
                row = np.searchsorted(begin, a, "right") - 1
                shot = np.arange(len(a)) - np.searchsorted(a, begin)[row]
                level = np.add.reduceat(frames.sum(1, dtype=np.int64), a) / ((b - a) * FRAME)
                lo, hi = a - begin[row], b - begin[row]
                cols = [shot, lo, hi, lo / FPS, hi / FPS, level]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, cols)], ["doc_id", "shot", "start_frame", "end_frame", "start_s", "end_s", "mean_level"])

    own = media.select("doc_id", "media")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, shot long, start_frame long, end_frame long, start_s double, end_s double, mean_level double")


def digest(media: DataFrame) -> DataFrame:
    """A row for each media file with checksums of what is read back, and its shots in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                files, frames, begin, counts, dist, cut = _read(part)
                rows = []
                for f, a, n in zip(files, begin, counts, strict=True):
                    own = frames[a : a + n].tobytes()
                    shots = np.flatnonzero(cut[a : a + n])
                    feature = f"frames={n};shots={len(shots)};longest_s={np.diff([*shots, n]).max() / FPS:.2f};max_step={dist[a : a + n].max():.4f};starts={zlib.crc32(shots.astype('<i8').tobytes()):08x}"
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *DIGEST])

    own = media.select("doc_id", "n_bytes", "media")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGEST = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(write_avi(table(spark, sf_dir, "documents")))
