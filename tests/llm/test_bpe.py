import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from quillspan.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def plain(codec):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=codec.ids, special_tokens={})


def test_codec_equals_the_library():
    codec = bpe.codec(PATH, P.PATTERN)
    library, rng = plain(codec), random.Random(3)
    pools = [range(1, 0x250), range(32, 127), range(0x400, 0x500), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), (9, 10, 13, 32)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in [*texts, "", "a" * 4000, " " * 900 + "x", "it's they'll I'd", "\x00▁▁"]:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cache_smaller_than_a_text(monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE", 5)
    for text in ("one two three four five six seven", "eight nine", "one two"):
        assert codec.encode(text) == plain(codec).encode_ordinary(text)
    texts = ["one two", "", "two three four five", "one"] * 3
    assert [list(np.frombuffer(b, dtype="<u4")) for b in codec.encode_all(texts)] == [plain(codec).encode_ordinary(t) for t in texts]
    assert len(codec.late) + len(codec.earlier) <= 10


def test_very_long_runs():
    codec = bpe.codec(PATH, P.PATTERN)
    for text in (" " * 1_200_000, "\n" * 1_200_000 + "x", "é" * 1_000_000):
        assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode(" " * 1_200_000)[:9] == plain(codec).encode_ordinary(" " * 1000)[:9]


def test_decoding_inverts_the_pieces():
    codec = bpe.codec(PATH, P.PATTERN)
    assert codec.bytes_of == bpe.read_ranks(PATH)


def test_documents(edge_docs, no_docs, edge_rows):
    library = plain(bpe.codec(PATH, P.PATTERN))
    got = bpe.encode_documents(edge_docs, PATH, P.PATTERN).collect()
    want = []
    for i, text in edge_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(no_docs, PATH, P.PATTERN).collect() == []
    kept = {r["doc_id"]: r for r in bpe.encode_documents(edge_docs, PATH, P.PATTERN, keep_ids=True).collect()}
    assert kept[4]["decoded"] == "one two" and list(kept[4]["ids"]) == library.encode_ordinary("one two")
