import hashlib
import zlib

import numpy as np
import pytest

from sparkloom.llm import media, warc

TEXTS = ["", None, "a", "x" * 191, "y" * 192, "z" * 193, "é" * 5000, "\xff\x00ÿ" * 300, "lorem ipsum " * 20_000, "a"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "m", i) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes long")


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 256, media.FRAME * 50), np.full(media.FRAME, 255), np.tile([0, 255], media.FRAME // 2)]).astype(np.uint8)
    movi, chunk = media.encode_frames(x)
    avi = media.container(movi.tobytes(), chunk)
    start, size = media.frame_index(avi)
    assert avi[start[0] : start[0] + 2] == b"\xff\xd8" and avi[start[3] + size[3] - 2 : start[3] + size[3]] == b"\xff\xd9"
    assert (media.decode_frames(np.frombuffer(avi, np.uint8), start, size).ravel() == x).all()
    assert int.from_bytes(avi[4:8], "little") == len(avi) - 8


def test_huffman_words_follow_the_rules_of_the_format():
    """Each word is a canonical code for the category, then the category's bits."""
    for d in (-255, -128, -1, 0, 1, 2, 100, 255):
        c = abs(d).bit_length()
        w = format(media.WORD9[d + 255], "09b")
        assert w[: 9 - c] == "1" * (8 - c) + "0"
        bits = int(w[9 - c :] or "0", 2)
        assert d == (bits if c == 0 or bits >> (c - 1) else bits - (1 << c) + 1)


def test_op3(spark, sf):
    for df in (docs(spark), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        texts = {r[0]: (r[1] or "").encode() for r in df.select("doc_id", "text").collect()}
        files = {r.doc_id: r.media for r in media.write_avi(df).collect()}
        rows = media.digest(media.write_avi(df)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            p = texts[r.doc_id]
            p += b" " * (max(192, -(-len(p) // 192) * 192) - len(p))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest())
            assert r.tail_crc32 == zlib.crc32(p[-16:]) and r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest() and r.media_bytes == len(files[r.doc_id])
    by = {r.doc_id: r for r in media.digest(media.write_avi(docs(spark).repartition(3))).collect()}
    assert by[2].feature == by[9].feature and by[2].media_sha256 == by[9].media_sha256
    assert media.digest(media.write_avi(docs(spark).limit(0))).count() == 0


def test_shots(spark):
    text = "a" * 192 * 30 + "Z" * 192 * 20 + "m" * 192 * 10
    rows = sorted(media.clips(media.write_avi(docs(spark, [text, "q"]))).collect(), key=lambda r: (r.doc_id, r.shot))
    assert [(r.doc_id, r.start_frame, r.end_frame) for r in rows] == [(0, 0, 30), (0, 30, 50), (0, 50, 60), (1, 0, 1)]
    assert rows[1].start_s == pytest.approx(1.2) and rows[0].mean_level == ord("a")
    rng = np.random.default_rng(0)
    noise = np.where(np.arange(40) < 20, 0, 100)[:, None] + rng.integers(0, 40, (40, media.FRAME))
    dist, cut = media.cut_points(noise.astype(np.uint8), np.arange(40) == 0)
    assert list(np.flatnonzero(cut)) == [0, 20]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        kind = "response" if f is None or f == i else "revisit"
        yield (-1 if i is None else i, len(p), warc.bare_digest(p), kind, None if kind == "response" else f)


def test_warc(spark, sf, tmp_path):
    key = lambda r: tuple(-9 if x is None else x for x in r)
    odd = [(3, "u", "same"), (1, "u1", "same"), (2, None, None), (5, "http://e x\r\nX: 1", ""), (7, "u", "<é>\r\n\r\nWARC/1.1"), (7, "u", "<é>\r\n\r\nWARC/1.1"), (None, "n", "same"), (8, "v", "x" * 300_000), (9, "v", "same")]
    lost = [(None, "a", "twice"), (None, "b", "twice"), (None, "c", "once"), (1, "d", "p"), (2, "e", "p"), (1, "f", "q"), (1, "g", "r"), (4, "h", "q")]
    nobody = [(None, "a", "twice"), (None, "b", "twice")]
    for rows in (odd, lost, nobody, [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]):
        d = tmp_path / str(len(rows))
        spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "2 AS length").write.parquet(f"{d}/pages.parquet")
        got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(spark, str(d)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=key) == sorted(expected(rows), key=key)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert warc.op4_warc(spark, f"{tmp_path}/e").count() == 0


def test_warc_selection(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index, root = warc.archive(spark, pages)
    some = index.where("page_id % 7 = 3")
    html = {r.page_id: r.html for r in pages.collect()}
    back = warc.read(some, root).collect()
    assert len(back) == some.count() > 0
    assert all(r.block.decode() == html[r.page_id] for r in back if r.record_type == "response")


def test_ranges_are_coalesced(tmp_path):
    from pyarrow import fs

    (tmp_path / "f").write_bytes(bytes(range(200)))
    f = str(tmp_path / "f")
    wanted = [(f, 0, 3), (f, 3, 5), (f, 10, 2), (f, 150, 10)]
    got = list(warc.read_ranges(fs.LocalFileSystem(), wanted, gap=4, most=100))
    assert [b for _, b in got] == [bytes(range(a, a + n)) for _, a, n in wanted]
