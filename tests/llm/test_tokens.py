from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import EDGES, documents
from vecweave.llm import bpe, packing
from vecweave.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "b", "'", "'s", "'re", "'ll", "'ve", "'t", " ", "  ", "\n", "\t", " ", "é", "ß", "1", "²", "!", "|", "<|endoftext|>", "中",
          "日本", "　", "😀", "é", "​", "İ", "don't", "I'll", "\r\n", "_", "٣", "\x1c", "\x85", "’s"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def test_encoder_equals_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(3000)] + ["", None]
    encoder = bpe.Encoder(vocabulary_path())
    table = bpe._list_table(encoder.vocabulary.bytes)
    for first, end, ids, bounds in encoder.column(pa.array(texts)):
        for k in range(end - first):
            own = ids[bounds[k] : bounds[k + 1]]
            want = library.encode(texts[first + k] or "", add_special_tokens=False).ids
            assert own.tolist() == want
            assert bpe.decode(own, table).decode() == library.decode(want, skip_special_tokens=False)


def test_every_vocabulary_entry_alone(library):
    vocabulary = bpe.Vocabulary(vocabulary_path())
    words = [b.decode() for b in vocabulary.bytes.values() if b.decode("utf-8", "ignore").encode() == b and b.decode() not in vocabulary.added]
    assert [vocabulary.merge(w.encode()) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_automaton_finds_its_words_only(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abcd", k=rng.randrange(1, 9))) for _ in range(500)} | {b"abc", b"abcabc"})
    parts = bpe.build_automaton(words)
    assert len(parts["final"]) < sum(map(len, words)) / 2
    bpe.Lexicon.write(str(tmp_path / "l"), words[::-1], lambda w: list(w))
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    asked = words + [b"", b"e", b"abcdabcdabcd", b"dddddddddd"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    found = lexicon.find(data, ends - [len(w) for w in asked], ends)
    assert found.tolist() == [words.index(w) if w in words else -1 for w in asked]
    bpe.Lexicon.write(str(tmp_path / "none"), [], lambda w: [])
    assert bpe.Lexicon(str(tmp_path / "none")).find(data, ends * 0, ends).tolist() == [-1] * len(asked)


@pytest.mark.parametrize("words", [1 << 16, 3])
def test_round_trip_edges(spark, library, words):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = bpe.round_trip(documents(spark, EDGES), vocabulary_path(), words=words).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert bpe.round_trip(documents(spark, []), vocabulary_path()).count() == 0


def test_packer_is_gapless_and_bounded():
    rng = random.Random(2)
    packer, out, sizes = packing.Packer(100, 4, 5), [], [rng.choice([1, 7, 30, 99, 100, 101, 350]) for _ in range(500)]
    for d, n in enumerate(sizes):
        out += packer.add(d, n)
        assert len(packer.open) <= 4
    assert all(100 - 5 <= sum(p[2] for p in s) <= 100 for s in out)
    pieces = defaultdict(list)
    for s in out + [w[1] for w in packer.open]:
        for d, start, n in s:
            pieces[d].append((start, n))
    for d, n in enumerate(sizes):
        at = 0
        for start, size in sorted(pieces[d]):
            assert start == at
            at += size
        assert at == n


def test_pack_covers_each_id_once(spark, library):
    docs = documents(spark, EDGES + [(100 + i, "some words " * (i % 40)) for i in range(300)]).repartition(7)
    rows = packing.pack(docs, vocabulary_path(), windows=4).collect()
    texts = defaultdict(list)
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        texts[d.doc_id].append(np.array(ids, "<u4"))
    sequences = defaultdict(list)
    covered = defaultdict(int)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
        assert any(len(t) == r.doc_tokens and zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for t in texts[r.doc_id])
    assert covered == {k: sum(map(len, v)) for k, v in texts.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(covered.values()) > 0.97 * 1024 * (len(sequences) - 1)
    assert packing.pack(documents(spark, []), vocabulary_path()).count() == 0
