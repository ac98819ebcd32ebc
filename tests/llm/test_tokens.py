import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F_
from tokenizers import Tokenizer

from lodestar.llm import idcoder as I
from lodestar.llm import packing as P
from lodestar.llm import token_files as F
from lodestar.llm.common import fresh_dir
from lodestar.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(tok, docs):
    e = Encoder(default_path(), cache=500)
    for d, ids in zip(docs, e.encode_many(pa.array([d["text"] for d in docs])), strict=True):
        assert ids.tolist() == ids_of(tok, d["text"])
    alphabet = list("aAéÉßªºµÿ'’ \t\n\x0b 　́̀ΣςİıK1²٣,.!|<>_-😀ﬁ가각ᄀ×") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "don't", " ", "\x1c", "\x85"]
    rng, made = random.Random(4), []
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        made.append(t)
    for t, ids in zip(made, e.encode_many(pa.array([*made, None])), strict=False):
        assert ids.tolist() == ids_of(tok, t), t
    for t in made[:200]:  # alone, so that other texts don't choose the way
        assert np.frombuffer(e.encode(t.encode()), "<u2").tolist() == ids_of(tok, t), t


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 63, 64, 65, 1000, 5001, 70_000):
        for top in (1, 3, 300, 65536):
            ids = rng.integers(0, top, n).astype(np.uint16)
            assert (I.decode(I.encode(ids), n) == ids).all()
    skewed = np.minimum(rng.geometric(0.3, 300_000), 65535).astype(np.uint16)
    data = I.encode(skewed)
    assert (I.decode(data, len(skewed)) == skewed).all()


def test_carries():
    """Ranges that end on a word's edge carry into the words before them."""
    rng = np.random.default_rng(9)
    for n in range(200, 260):
        ids = np.repeat(rng.integers(0, 65536, n), rng.integers(1, 40, n)).astype(np.uint16)
        assert (I.decode(I.encode(ids), len(ids)) == ids).all()


def test_blocks_beat_zlib(tok, docs):
    ids = np.concatenate([np.array([*ids_of(tok, d["text"]), 2], np.uint16) for d in docs])
    for part in (ids, ids[: len(ids) // 2], ids[:20_000]):
        assert len(I.encode(part)) < len(zlib.compress(part.tobytes(), 6))


def test_documents_cross_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 1000)
    rng, path = np.random.default_rng(5), tmp_path / "f"
    made = [rng.integers(0, 500, n).astype("<u2") for n in (1, 2500, 0, 999, 1000, 3)]
    with open(path, "wb") as f:
        w = F.FileWriter(f)
        for k, ids in enumerate(made):
            w.add(k, ids)
        size = w.close()
    with open(path, "rb") as f:
        for (k, parts), want in zip(F.FileReader(f, size).documents(), made, strict=True):
            assert np.concatenate([np.zeros(0, "<u2"), *parts]).tolist() == want.tolist()


def held(tok, df, rows):
    got = sorted(F.token_files(df).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(tok, t), 2]
        want.append((d, len(ids)))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), n) for d, n in want)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = defaultdict(list)
    for d, t in rows:
        crc[d].append(zlib.crc32(np.array([*ids_of(tok, t), 2], "<u4").tobytes()))
    assert all(r["ids_crc32"] in crc[r["doc_id"]] for r in got)


def test_files(spark, tok, sf, docs, odd, empty):
    held(tok, spark.read.parquet(f"{sf}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs])
    held(tok, odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert F.token_files(empty).collect() == []


def test_damage_is_found(spark, sf):
    folder = fresh_dir(spark, "t")
    manifest = F.write_token_files(spark.read.parquet(f"{sf}/documents.parquet").limit(20), folder).collect()
    path = manifest[0]["path"].removeprefix("file:").replace("//", "/")
    data = bytearray(open(path, "rb").read())
    data[len(F.MAGIC) + 50] ^= 1
    open(path, "wb").write(data)
    with open(path, "rb") as f, pytest.raises(ValueError, match="damaged"):
        for _, parts in F.FileReader(f, len(data)).documents():
            list(parts)


def packed(rows, capacity=P.CAPACITY):
    """Every sequence is full of pieces from 0 on without gaps and within capacity."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, tok, sf, docs, odd, empty):
    for df, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs]), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        want = []
        for d, t in rows:
            ids = np.array([*ids_of(tok, t), 1], "<u4")
            want += [(str(d), k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        got = P.best_fit_pack(df).collect()
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        assert packed(got) <= 1.03 * -(-sum(w[3] for w in want) // 4096) + 2
    assert P.best_fit_pack(empty).collect() == []


def test_bounded_bins_match_a_plain_best_fit():
    rng = random.Random(6)
    for most in (1, 3, 50):
        p, open_, made = P.Packer(100, most), [], 0
        for n in (rng.randint(1, 100) for _ in range(2000)):
            number, at = p.place(n)
            fits = [b for b in open_ if b[0] >= n]
            if fits:
                free = min(b[0] for b in fits)
                assert at == 100 - free and (free, number) in open_
                open_.remove((free, number))
            else:
                if len(open_) == most and n < 100:  # a full piece closes no bin
                    open_.remove(next(b for b in open_ if b[0] == min(x[0] for x in open_) and b[1] not in {y for ys in p.bins.values() for y in ys}))
                assert (at, number) == (0, made)
                free, made = 100, made + 1
            if free - n:
                open_.append((free - n, number))
            assert len(open_) <= most and p.open == len(open_)


def test_full_pieces_close_no_bin():
    p = P.Packer(100, 2)
    assert [p.place(n) for n in (60, 70, 100, 30, 40)] == [(0, 0), (1, 0), (2, 0), (1, 70), (0, 60)]


def test_rows_alike_are_dealt_out(spark):
    pieces = spark.range(500).select(F_.lit(7).cast("long").alias("doc_id"), F_.lit(0).alias("piece"), F_.lit(0).cast("long").alias("start"), F_.lit(30).cast("long").alias("length"), F_.lit(1).cast("long").alias("ids_crc32"), F_.col("id").alias("alike"))
    rows = P.pack_pieces(pieces, 100, 4, 50).collect()
    assert len(rows) == 500 and len({r["sequence_id"] >> 40 for r in rows}) > 5
    assert packed(rows, 100) <= 180


def test_packing_reruns_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(map(tuple, P.best_fit_pack(df).collect()))
    assert a == sorted(map(tuple, P.best_fit_pack(df.repartition(7)).collect()))
