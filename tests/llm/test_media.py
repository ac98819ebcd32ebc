import hashlib
import zlib

import pytest

from lodestar.llm import media as M
from lodestar.llm.common import fresh_dir


def held(df, rows):
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        want.append((d or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    got = M.media_columns(df, span=20_000).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    return got


def test_round_trip(spark, sf, docs, odd):
    got = held(spark.read.parquet(f"{sf}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs])
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    held(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty(spark, empty):
    assert M.media_columns(empty).collect() == []


def test_png_is_a_png():
    data = M.to_png(b"a" * 384, 380)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and M.from_png(data) == (b"a" * 384, 380)
    with pytest.raises(ValueError):
        M.from_png(data[:40] + b"\0" + data[41:])


def test_members_are_tried_again_alone(tmp_path):
    path = tmp_path / "a.larc"
    w = M.ArchiveWriter(path.open("wb"))
    for i in range(5):
        w.add(i, bytes([i]) * 100)
    size = w.close()
    table = M.directory(path.open("rb"), size)
    opened = []

    def open_file():
        opened.append(1)
        if len(opened) < 3:
            raise OSError("lost")
        return path.open("rb")

    assert M.read_member(open_file, table[2], first=b"damaged") == b"\2" * 100 and len(opened) == 3
    with pytest.raises(OSError):
        M.read_member(lambda: (_ for _ in ()).throw(OSError("gone")), table[0])


def test_ranges_cover_each_member_once(spark, sf):
    folder = fresh_dir(spark, "t")
    M.write_archives(spark.read.parquet(f"{sf}/documents.parquet").limit(50), folder)
    for span in (1, 997, 1 << 30):
        if span > 1:
            assert sorted(r["doc_id"] for r in M.read_archives(spark, folder, span).select("doc_id").collect()) == sorted(set(r["doc_id"] for r in M.read_archives(spark, folder).select("doc_id").collect()))
