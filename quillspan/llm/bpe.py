"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Each rank becomes a BPE piece: its bytes mapped to printable characters, its score the negative
rank. Sentencepiece merges the adjacent pair of the best-scored result, leftmost first, which is
the rule of rank-based byte-level BPE. Normalisation is the identity and no dummy prefix or white
space handling is on, so only the mapping of bytes stands between text and pieces. Text is cut by
the public pattern first and every match is encoded on its own; a match that is itself in the
vocabulary is that token. Decoding maps the characters of the model's pieces back to bytes.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Texts of any length
are encoded whole. Every row is encoded on its own, so repeated rows and ties get equal results; an
empty table gives no rows; further columns are not read. The cache of matches is bounded (``CACHE``
entries) and only saves time: what has not been seen for a while goes, what comes again stays.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

CACHE = 800_000
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or 32-bit float."""
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the positions in ``vocabulary``; the last id is <unk>."""
    letters = byte_alphabet()
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for rank, token in enumerate(vocabulary)
    ]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # TrainerSpec: model_type BPE, vocab_size, no byte fallback, ids of control pieces off.
    off = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(35, 0) + _field(40, len(vocabulary)) + b"".join(_field(k, off) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must be gapless from 0")
    return [token for _, token in ranks]


class Codec:
    """Encoder and decoder over one vocabulary; one per worker process."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.ids = {token: i for i, token in enumerate(vocabulary)}
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(vocabulary))
        letters = byte_alphabet()
        self.letters = dict(enumerate(letters))
        back = {letter: b for b, letter in enumerate(letters)}
        pieces = self.model.IdToPiece(list(range(len(vocabulary))))
        self.bytes_of = [bytes([back[letter] for letter in piece]) for piece in pieces]
        # Ids of a match as little-endian bytes; matches of late and of earlier batches.
        self.late: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _fill(self, words: set[str]) -> None:
        """Make sure that ``late`` has these matches: from the earlier ones, or by one call of the model."""
        if len(self.late) + len(words) > CACHE // 2:
            self.late, self.earlier = {}, self.late
        late, earlier, rest = self.late, self.earlier, []
        for word in words:
            if word in late:
                continue
            known = earlier.get(word)
            if known is not None:
                late[word] = known
                continue
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ids.get(raw)
            if whole is None:
                rest.append((word, raw.decode("latin-1").translate(self.letters)))
            else:
                late[word] = whole.to_bytes(4, "little")
        if rest:
            for (word, _), ids in zip(rest, self.model.EncodeAsIds([m for _, m in rest], num_threads=1)):
                late[word] = array("I", ids).tobytes() if _LITTLE else np.array(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(text) for text in texts]
        at = 0
        while at < len(cut):
            # As many texts as have at most half a cache of matches between them, one at least.
            words, to = set(cut[at]), at + 1
            while to < len(cut) and len(words) + len(cut[to]) <= CACHE // 2:
                words.update(cut[to])
                to += 1
            self._fill(words)
            get = self.late.__getitem__
            for k in range(at, to):
                yield b"".join(map(get, cut[k]))
            at = to

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(cols):
        own, out = codec(path, pattern), {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for raw in own.encode_all([text or "" for text in cols["text"]]):
            ids = np.frombuffer(raw, dtype="<u4").tolist()
            back = own.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
                out["decoded"].append(back.decode("utf-8", "replace"))
        return out

    return map_batches(docs.select("doc_id", "text"), run, schema)
