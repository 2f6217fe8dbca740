"""Byte-level BPE over a whole corpus, encoding shared prefixes of distinct words once.

A prefix of a word has exactly one BPE encoding, and that encoding is settled by its last token and the
encoding of what stands before that token.  So the state of a trie node is the last token of its prefix.
``Encoder.learn`` walks the trie of the new distinct words depth-first: in sorted order, each word
keeps the states of the prefix it shares with the one before and propagates only from there.  The last token at a
position is the one token ending there that can stand next to the last token before it; whether two
tokens can stand side by side is decided once for each pair, from the merges along their touching edges.

The work is one pass without a shuffle: a Python worker keeps its encoder and a bounded word cache
from task to task.  Defined cases: null and empty texts give an empty list; special tokens' strings
are ordinary text; words and texts may be of any length; repeated rows are encoded alike.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Public files of byte-level tokenizers; a parameter everywhere, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, by number and by total characters, before it starts afresh.
CACHE_WORDS, CACHE_CHARS = 400_000, 16_000_000

_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte, as the vocabulary file writes bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """word -> token ids, learned in tries of new words."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_alphabet()
        vocab = model["vocab"]
        raw = {t: bytes(letter[c] for c in t) for t in vocab if all(c in letter for c in t)}
        self.token_of = {b: vocab[t] for t, b in raw.items()}
        size = max(vocab.values()) + 1
        self.length = [0] * size
        self.lengths_by_end: dict[bytes, list[int]] = {}
        ends: dict[bytes, set[int]] = {}
        for b, t in self.token_of.items():
            self.length[t] = len(b)
            if len(b) > 1:
                ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths_by_end = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.rank = [-1] * size  # single bytes are there from the start
        self.left, self.right = [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = vocab[a + b]
            x, y = vocab[a], vocab[b]
            self.merged[x, y] = rank
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = rank, x, y
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.chars = 0
        self.split = regex.compile(PATTERN).findall

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b.

        Going back in time from the finished tokens, x is the last piece of a and y the first piece of b that
        exist together; they would have merged across the border if their merge came before
        those that took x and y into the next larger pieces.  Of equal merges the one further left comes first.
        """
        x, y, taken_x, taken_y = a, b, _NEVER, _NEVER
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < taken_x and across <= taken_y:
                return False
            if self.rank[x] > self.rank[y]:
                taken_x, x = self.rank[x], self.right[x]
            elif self.rank[y] >= 0:
                taken_y, y = self.rank[y], self.left[y]
            else:
                return True

    def learn(self, new: set[str]) -> None:
        """Add the encodings of words that are not known yet."""
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.words.clear()
            self.chars = 0
        token_of, lengths, fits, length = self.token_of, self.lengths_by_end, self.fits, self.length
        if len(fits) > 4 * CACHE_WORDS:
            fits.clear()
        before, last = b"", []
        for encoded, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in new):
            n = min(len(before), len(encoded))
            same = 0
            if before[:n] == encoded[:n]:
                same = n
            else:
                while before[same] == encoded[same]:
                    same += 1
            del last[same:]
            for i in range(same, len(encoded)):
                found = token_of[encoded[i : i + 1]]  # unless a longer token fits
                for size in lengths.get(encoded[i - 1 : i + 1], ()) if i else ():
                    start = i + 1 - size
                    if start < 0:
                        continue
                    token = token_of.get(encoded[start : i + 1])
                    if token is None:
                        continue
                    if start == 0:
                        found = token
                        break
                    pair = (last[start - 1], token)
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self.side_by_side(*pair)
                    if fit:
                        found = token
                        break
                last.append(found)
            ids, i = [], len(encoded)
            while i:
                ids.append(last[i - 1])
                i -= length[last[i - 1]]
            ids.reverse()
            self.words[word] = ids
            self.chars += len(word)
            before = encoded

    def encode_batch(self, texts: list[str | None]) -> Iterator[Iterator[int]]:
        """The ids of each text; new words of some texts are learned together, in one trie."""
        for part, words in self._known(texts):
            for w in words:
                yield chain.from_iterable(map(part, w))

    def count_batch(self, texts: list[str | None]) -> Iterator[int]:
        for part, words in self._known(texts):
            for w in words:
                yield sum(map(len, map(part, w)))

    def _known(self, texts: list[str | None], chars: int = 2_000_000):
        words: list[list[str]] = []
        held = 0
        for text in texts:
            w = self.split(text) if text else []
            words.append(w)
            held += len(text) if text else 0
            if held > chars:
                yield self._get(words), words
                words, held = [], 0
        if words:
            yield self._get(words), words

    def _get(self, words: list[list[str]]):
        new = set().union(*words)
        new.difference_update(self.words)
        if new:
            full = len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS
            self.learn(set().union(*words) if full else new)
        return self.words.__getitem__


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids of each text."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            step = 1000
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                flat, ends = array("i"), [0]
                for ids in enc.encode_batch(part.column("text").to_pylist()):
                    flat.extend(ids)
                    ends.append(len(flat))
                values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "ids"])

    out = rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and n_tokens of each text."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = pa.array(enc.count_batch(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), n], ["key", "n_tokens"])

    return rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, n_tokens long").withColumnRenamed("key", key)
