"""Encoding of texts by a public byte-level BPE vocabulary.

The vocabulary is a rank file (base64 token, rank); it is never copied, only read from its path, and
sent to the workers as a broadcast of its fixed size. A text is cut into words by the vocabulary's
pattern. A short word is merged over a contiguous array of part boundaries and the ranks of adjacent
parts: the least rank is searched, its boundary deleted and the two neighbouring ranks refreshed
until no pair has a rank. Long words use the same rule over a heap, so that a word of a million
characters doesn't take quadratic time. Words repeat, so each worker remembers what it encoded.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files are; a parameter of every operator here.
VOCABULARIES = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which the vocabulary's words are cut; white space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SHORT = 96  # bytes; longer words use the heap
REMEMBERED = 400_000  # words a worker keeps


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks by token bytes of a vocabulary file's content."""
    ranks = {}
    for line in blob.splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a short word by the contiguous rank array."""
    n = len(word)
    bounds = list(range(n + 1))
    none = 1 << 60
    get = ranks.get
    near = [get(word[i : i + 2], none) for i in range(n - 1)]
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_short, with a heap of (rank, start) and linked parts."""
    n = len(word)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == k):
            continue
        alive[j] = False
        after[i] = k
        if k < n:
            before[k] = i
            if (r := get(word[i : after[k]])) is not None:
                heapq.heappush(heap, (r, i, k, after[k]))
        h = before[i]
        if h >= 0 and (r := get(word[h:k])) is not None:
            heapq.heappush(heap, (r, h, i, k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts with one vocabulary; remembers the ids of words it has met."""

    def __init__(self, blob: bytes):
        self.ranks = load_ranks(blob)
        self.words = regex.compile(PATTERN).findall
        # a word never goes on past a space that precedes something other than white space, so
        # texts are cut there first, and the pieces, mostly single words, are looked up
        self.pieces = re.compile(rf" (?=[^{SPACE}])").split
        self.known: dict[str, list[int]] = {}
        self.known_words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known_words.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            one = self.ranks.get(raw)
            if one is not None:
                ids = [one]
            else:
                ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
            if len(raw) <= SHORT:
                if len(self.known_words) >= REMEMBERED:
                    self.known_words.clear()
                self.known_words[word] = ids
        return ids

    def piece(self, piece: str) -> list[int]:
        words = self.words(piece)
        ids = self.word(words[0]) if len(words) == 1 else list(chain.from_iterable(map(self.word, words)))
        if len(piece) <= 24:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; null and empty texts have none."""
        if not text:
            return []
        first, *rest = self.pieces(text)
        out = list(self.piece(first)) if first else []
        extend, get, slow = out.extend, self.known.get, self.piece
        for p in rest:
            p = " " + p
            extend(get(p) or slow(p))
        return out


_encoders: dict[int, Encoder] = {}


def encoder_of(blob: bytes) -> Encoder:
    """This worker's encoder of a vocabulary."""
    key = hash(blob)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(blob)
    return _encoders[key]


def read_vocabulary(path: str | None = None) -> bytes:
    """Content of a vocabulary file, by default of byte_bpe_50k."""
    with open(path or os.path.join(VOCABULARIES, DEFAULT), "rb") as f:
        blob = f.read()
    if len(blob) > 64_000_000:
        raise ValueError("a vocabulary of more than 64 MB isn't broadcast")
    return blob


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): every document's token ids, without special tokens.

    Null and empty texts both have an empty list; strings that look like special tokens are ordinary
    text. One pass over the table, no shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array(list(map(encode, part.column(1).to_pylist())), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[doc_id, "ids"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of tokens of each document's text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    inner = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary.value).encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(len(keep)).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return inner.mapInArrow(run, schema)
