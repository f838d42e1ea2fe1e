"""Byte-level BPE encoding through a minimal acyclic transducer of frequent words.

Texts are cut into words by the tokenizer's pattern, on whole arrays of bytes. The words that
occur most often in the corpus are compiled into an automaton that shares prefixes and
suffixes; the weights along a path add up to the word's number, and that number's entry in a
table is the word's ids. The file is memory-mapped by every worker, so the workers of one
machine share it. Words that it lacks are merged exactly by the tokenizer's own ranks.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.arrays import LEAD, Rolling, text_slices
from vecweave.llm.components import stored

LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 64
MEMO_WORDS = 250_000
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE = range(5)


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, bytes of ids, and exact merging of single words."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [a["content"] for a in told["added_tokens"]]
        # The visible characters that stand for the 256 bytes in such files: printable ones for
        # themselves, the others in order from U+0100.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in shown}
        char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = told["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        if ranks != sorted(ranks):
            raise ValueError("ids do not follow the order of merges")
        self.bytes = {i: bytes(char[c] for c in t) for t, i in vocab.items() if t not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merger = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.bytes |= {a["id"]: a["content"].encode() for a in told["added_tokens"]}
        self.kinds = np.full(0x110000, 255, np.uint8)
        for c in range(128):
            self.kinds[c] = self._kind(chr(c))

    def merge(self, word: bytes) -> list[int]:
        return self.merger.encode_ordinary(word.decode("utf-8"))

    def _kind(self, c: str) -> int:
        """The class of a character, told by how the tokenizer itself splits it."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if c == " ":
            return _BLANK
        for kind, mate in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
            if len(split(mate + c)) == 1:
                return kind
        return _WHITE

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        out = self.kinds[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]):
                self.kinds[p] = self._kind(chr(p))
            out = self.kinds[points]
        return out


def split_words(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words, and where each text's words begin among them; words tile a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if data.max() < 128:
        at, points = None, data
        edge = offsets
    else:
        lead = LEAD[data]
        at = np.flatnonzero(lead)
        size = np.diff(np.append(at, len(data)))
        points = data[at].astype(np.int32)
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            here = np.flatnonzero(size == n)
            value = points[here] & mask
            for k in range(1, n):
                value = (value << 6) | (data[at[here] + k] & 0x3F)
            points[here] = value
        edge = np.searchsorted(at, offsets)
    kind = vocabulary.kinds_of(points)
    n = len(kind)
    opens = np.zeros(n + 1, bool)
    opens[edge] = True
    run = np.minimum(kind, _BLANK)
    fresh = opens[:n].copy()
    fresh[1:] |= run[1:] != run[:-1]
    start = fresh.copy()
    # A blank goes with the word after it.
    start[1:] &= ~((kind[:-1] == _BLANK) & (run[1:] != _BLANK) & ~opens[1:n])
    # The last of several white characters before a word stands alone or goes with it.
    inner = np.zeros(n, bool)
    inner[1:-1] = (run[1:-1] == _BLANK) & (run[:-2] == _BLANK) & (run[2:] != _BLANK) & ~opens[1 : n - 1] & ~opens[2:n]
    start |= inner
    # Contractions: an apostrophe that begins a word takes the letters named here.
    for i in np.flatnonzero((points == 39) & start & (kind == _OTHER)):
        if i + 1 >= n or opens[i + 1]:
            continue
        take = 1 if points[i + 1] in _ONE else 0
        if not take and i + 2 < n and not opens[i + 2] and (points[i + 1], points[i + 2]) in _TWO:
            take = 2
        if take:
            start[i + 1] = False
            if i + 1 + take < n:
                start[i + 1 + take] = True
    first = np.flatnonzero(start)
    return (first if at is None else at[first]), np.searchsorted(first, edge)


_ONE = {ord(c) for c in "stmd"}
@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per file and Python worker: tasks that follow in a worker do not build it again."""
    return Vocabulary(path)


_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def distinct_words(data, offsets, starts, hashes: tuple[Rolling, Rolling]):
    """One place of each distinct word, and each word's index among them.

    Words are grouped by one hash and the grouping is checked with another, independent one.
    """
    ends = np.append(starts[1:], len(data))
    one = hashes[0].spans(hashes[0].sums(data), starts, ends)
    two = hashes[1].spans(hashes[1].sums(data), starts, ends)
    _, place, inverse = np.unique(one, return_index=True, return_inverse=True)
    if not (two == two[place][inverse]).all():
        _, place, inverse = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return place, inverse.reshape(-1), ends


def gather(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a list table, concatenated, and their bounds."""
    size = np.diff(bounds)[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return flat[np.repeat(bounds[rows] - out[:-1], size) + np.arange(out[-1])], out


class Encoder:
    """Encodes slices of texts; ``lexicon`` is asked first, then a bounded memory of merged words."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary(path), lexicon
        self._forget()
        self.hashes = (Rolling(31), Rolling(32))

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.flat, self.bounds = array("q"), array("q", [0])

    def _word_ids(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A list table and each word's row in it."""
        found = np.full(len(starts), -1) if self.lexicon is None else self.lexicon.find(data, starts, ends)
        missing = np.flatnonzero(found < 0)
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        raw, memo = data.tobytes(), self.memo
        words = [raw[s:e] for s, e in zip(starts[missing].tolist(), ends[missing].tolist())]
        rows = list(map(memo.get, words))
        for i, row in enumerate(rows):
            if row is None:
                word = words[i]
                rows[i] = memo[word] = len(self.bounds) - 1
                self.flat.extend(self.vocabulary.merge(word))
                self.bounds.append(len(self.flat))
        # Copies, as the arrays grow on.
        flat, bounds, own = np.array(self.flat, np.int64), np.array(self.bounds, np.int64), np.array(rows, np.int64)
        if self.lexicon is None:
            return flat, bounds, own
        known = self.lexicon
        found[missing] = len(known.bounds) - 1 + own
        return np.concatenate([known.ids, flat]), np.concatenate([known.bounds, bounds[1:] + len(known.ids)]), found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's begin."""
        starts, bounds = split_words(data, offsets, self.vocabulary)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        place, inverse, ends = distinct_words(data, offsets, starts, self.hashes)
        flat, lists, rows = self._word_ids(data, starts[place], ends[place])
        ids, at = gather(flat, lists, rows[inverse])
        return ids, at[bounds]

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, end row, ids, bounds)`` of a column of texts; null counts as empty.

        Texts that spell an added token are left to the tokenizer itself.
        """
        special = None
        for a in self.vocabulary.added:
            hit = pc.fill_null(pc.match_substring(column, a), False)
            special = hit if special is None else pc.or_(special, hit)
        marked = set(np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()) if special is not None else set()
        for first, end, data, offsets in text_slices(column):
            ids, bounds = self.encode(data, offsets)
            own = [i for i in range(first, end) if i in marked]
            if own:
                parts = [ids[bounds[k] : bounds[k + 1]] for k in range(end - first)]
                for i in own:
                    parts[i - first] = np.array(self.vocabulary.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int64)
                ids = np.concatenate(parts)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield first, end, ids, bounds


def build_automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, with weights that sum to a word's rank.

    Words are added in order; when the next word leaves a branch, the branch's states are
    replaced by equal ones that exist already, so suffixes are shared.
    """
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []

    def settle(keep: int) -> None:
        while len(path) > keep:
            parent, byte = path.pop()
            child = edges[parent][byte]
            shape = (final[child], *edges[child].items())
            edges[parent][byte] = register.setdefault(shape, child)

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            final.append(False)
            edges.append({})
            edges[state][byte] = len(final) - 1
            path.append((state, byte))
            state = len(final) - 1
        final[state] = True
        last = word
    settle(0)
    # Number the states that are left; count the words below each.
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(top: int) -> None:
        todo = [top]
        while todo:
            s = todo[-1]
            open_ = [c for c in edges[s].values() if c not in below]
            if open_:
                todo += open_
            else:
                below[s] = final[s] + sum(below[c] for c in edges[s].values())
                todo.pop()

    count(0)
    keys, targets, weights = [], [], []
    for s in order:
        skipped = int(final[s])
        for byte, child in sorted(edges[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[child])
            weights.append(skipped)
            skipped += below[child]
    rank = np.argsort(np.array(keys, np.int64))
    return {
        "key": np.array(keys, np.int64)[rank],
        "target": np.array(targets, np.int64)[rank],
        "weight": np.array(weights, np.int64)[rank],
        "final": np.array([final[s] for s in order], np.int64),
    }


class Lexicon:
    """A memory-mapped automaton file."""

    PARTS = ("key", "target", "weight", "final", "ids", "bounds")

    @classmethod
    def write(cls, path: str, words: list[bytes], merge: Callable[[bytes], list[int]]) -> None:
        """Words are distinct; their order does not matter."""
        words = sorted(words)
        parts = build_automaton(words)
        lists = [merge(w) for w in words]
        parts["ids"] = np.array([i for ids in lists for i in ids], np.int64)
        parts["bounds"] = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])]).astype(np.int64)
        with open(path, "wb") as f:
            f.write(np.array([len(parts[p]) for p in cls.PARTS], np.int64).tobytes())
            for p in cls.PARTS:
                f.write(np.ascontiguousarray(parts[p], np.int64).tobytes())

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        at = len(self.PARTS)
        for name, size in zip(self.PARTS, whole[:at].tolist()):
            setattr(self, name, whole[at : at + size])
            at += size

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, or -1; all words take their next step together."""
        out = np.full(len(starts), -1)
        if not len(self.key):
            return out
        word = np.arange(len(starts))
        state, weight, at = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), starts.copy()
        while len(word):
            done = at == ends[word]
            if done.any():
                hit = done & (self.final[state] == 1)
                out[word[hit]] = weight[hit]
                word, state, weight, at = word[~done], state[~done], weight[~done], at[~done]
                if not len(word):
                    break
            wanted = state * 256 + data[at]
            edge = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            ok = self.key[edge] == wanted
            word, edge = word[ok], edge[ok]
            state, weight, at = self.target[edge], weight[ok] + self.weight[edge], at[ok] + 1
        return out


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``word, n`` over all documents, words as the tokenizer cuts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_file, hashes = vocabulary(path), (Rolling(31), Rolling(32))
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                starts, _ = split_words(data, offsets, words_of_file)
                if len(starts):
                    place, inverse, ends = distinct_words(data, offsets, starts, hashes)
                    words = [data[s:e].tobytes() for s, e in zip(starts[place], ends[place])]
                    n = np.bincount(inverse)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(count, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent words of a stored count table, at most ``limit``.

    Counts are cut at a level (an eighth of a power of two), found from how many words each
    level has, so no task or driver ever holds more than the words that stay.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    held = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    total, least = 0, 1 << 30
    for at in sorted(held, reverse=True):
        total += held[at]
        if total > limit:
            break
        least = at
    return counts.filter(level >= least)


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compiles the ``words`` most frequent words of ``docs`` and sends the file to all executors.

    Returns its name there. The file's size is bounded by ``words``, each of at most
    ``LEXICON_BYTES`` bytes; which words it holds changes how fast a word is encoded, never how.
    """
    counts = stored(word_counts(docs, path, text).filter(F.length("word") <= LEXICON_BYTES), "words")
    top = [bytes(w) for w in frequent(counts, words).select("word").toArrow()["word"].to_pylist()]
    name = f"lexicon-{uuid.uuid4().hex}"
    place = os.path.join(tempfile.mkdtemp(prefix="vecweave-"), name)
    Lexicon.write(place, top, vocabulary(path).merge)
    docs.sparkSession.sparkContext.addFile(place)
    return name


def _list_table(lists: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = [lists.get(i, b"") for i in range(max(lists) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The text of ids in UTF-8; bytes that are not UTF-8 become U+FFFD."""
    raw = gather(*table, ids)[0].tobytes()
    return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", lexicon: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row; a null or empty text has no ids. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        for batch in batches:
            for first, end, ids, bounds in encoder.column(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, encoded and decoded again.

    Null and empty texts have no ids; repeated rows give repeated rows; other columns are not
    read; an empty table gives no rows.
    """
    lexicon = build_lexicon(docs, path, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, Lexicon(SparkFiles.get(lexicon)))
        table = _list_table(encoder.vocabulary.bytes)
        digits = _list_table({i: b"%d," % i for i in encoder.vocabulary.bytes})
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for first, end, ids, bounds in encoder.column(batch.column(1)):
                each = [ids[bounds[k] : bounds[k + 1]] for k in range(end - first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array([sha(gather(*digits, i)[0].tobytes()[:-1]) for i in each], pa.string()),
                        pa.array([sha(decode(i, table)) for i in each], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
