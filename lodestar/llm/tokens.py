"""Fast exact encoding with a public word-splitting tokenizer.

``word_bpe_49k.json`` never lets a token reach over white space: it composes characters
(no composition crosses white space), lower-cases letter by letter, and drops white
space.  So a text's ids are the ids of its chunks between ASCII white space one after
another.  ``Encoder.encode_many`` splits some megabytes of texts at a time, finds their
distinct chunks (Arrow), encodes each of those once and lays out the ids (numpy).  A plain
Latin-1 chunk is lower-cased and split by one expression into the pieces that the
tokenizer makes (letters, one digit, or a run of signs), which go straight to the
library's BPE model; a bounded dictionary keeps pieces.  Any other chunk (combining
marks, other scripts, the spellings of special tokens) goes through the library's whole
``encode``.  ``tests/llm`` holds this against ``encode`` on whole texts.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker (some 180 bytes each), beside a fourth as many chunks; more aren't kept.
CACHE = 1_000_000
#: Bytes of text encoded at once.
SLICE = 8 << 20
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN_CHUNKS, PIECE_OR_SPACE = re.compile("[ -~À-ÖØ-öø-ÿ]*"), re.compile("[a-zß-öø-ÿ]+| |'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-zß-öø-ÿ0-9 ]+")
_ENCODERS: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level BPE."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bounded(dict):
    """A dictionary that computes what it lacks and keeps at most ``most`` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        if sys.byteorder != "little":
            raise ValueError("ids are written as the machine holds them")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces = Bounded(self.piece, cache)
        self.pieces[" "] = b""  # between chunks
        self.chunks = Bounded(self.chunk, cache // 4)

    def piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def ids(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(chunk.lower())))
        return self.chunks[chunk]

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks.cast(pa.string())), " ")[0].as_py()
        if PLAIN_CHUNKS.fullmatch(joined) and "<|" not in joined:
            made = list(map(self.pieces.__getitem__, PIECE_OR_SPACE.findall(joined.lower())))
            size = np.fromiter(map(len, made), np.int64, len(made)) >> 1
            if np.count_nonzero(size == 0) == len(chunks) - 1:  # only spaces have no ids
                total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.flatnonzero(size == 0), [len(size)]])]
                return np.frombuffer(b"".join(made), "<u2"), np.diff(total)
        made = list(map(self.ids, joined.split(" ")))
        return np.frombuffer(b"".join(made), "<u2"), np.fromiter(map(len, made), np.int64, len(made)) >> 1

    def encode_many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text (null: none) as unsigned 16-bit numbers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
            yield from self._slice(texts[at:end])
            at = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        pool, size = self.distinct(words.dictionary)
        first = np.cumsum(size) - size
        of = words.indices.to_numpy()
        n = size[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[of] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b]

    def encode(self, text: bytes) -> bytes:
        """The ids of one whole UTF-8 text as unsigned 16-bit little-endian bytes."""
        return next(self.encode_many(pa.array([text.decode()]))).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
