"""Problem 6: encoding of a whole corpus with a public byte-level BPE tokenizer.

The encoding of a text's first i bytes is that of a shorter prefix with one
more token, its last. The last token therefore is all the state a trie of
words needs in a node: it is the one token that is a suffix of the node's path
and that BPE would really leave standing beside the last token of the node it
starts at. The distinct words of a batch are visited in sorted order, which
is a depth-first traversal of their trie; the states of a shared prefix are
computed once and the encodings are read off backwards.

Texts are cut where no token can lie across: before white space that follows
something else. Each piece is looked up among those already encoded; caches
are bounded and only save time.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

# The white space of Unicode, as the pattern below has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Fixed value: the published pattern that cuts texts into words for this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for texts of ASCII signs alone, for the faster engine.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Pieces up to this length are kept once encoded; longer ones seldom come again.
PIECE = 48
#: Entries a cache may hold before it starts anew.
CACHED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _halves(ranks: dict[bytes, int]) -> tuple[array, array]:
    """The two tokens from whose merge each token comes; a single byte is its own halves."""
    size = max(ranks.values()) + 1
    left, right = array("i", [-1] * size), array("i", [-1] * size)
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                found = ranks.get(parts[i] + parts[i + 1], rank)
                if found < best:
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1:
            left[rank] = right[rank] = rank
        elif len(parts) == 2:
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return left, right


class Encoder:
    """Encodes words and texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], halves: tuple[array, array] | None = None):
        self.ranks = ranks
        self.left, self.right = halves or _halves(ranks)
        self.length = {rank: len(token) for token, rank in ranks.items() if self.left[rank] >= 0}
        self.merged = {(self.left[r], self.right[r]): r for r in self.length if self.left[r] != r}
        # Tokens by their bytes, and every proper suffix of a token as None.
        self.suffixes: dict[bytes, int | None] = {}
        for token in ranks:
            for i in range(1, len(token)):
                self.suffixes.setdefault(token[i:], None)
        self.suffixes.update({t: r for t, r in ranks.items() if r in self.length})
        self.stands: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.split_any = regex.compile(WORDS).findall
        self.split_ascii = re.compile(ASCII_WORDS).findall

    def _stand(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of two tokens leaves just these two.

        Merges are undone from the latest one back; at no time may an earlier
        merge across the border be possible.
        """
        left, right, merged = self.left, self.right, self.merged
        limit = 1 << 40
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a != limit:
                    continue
                # A single byte: only the other side is left to undo.
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 != limit:
                    continue
                limit, a = a, right[a]
                if a == limit:
                    return True

    def _learn(self, words: Iterable[str]) -> None:
        """Encode distinct words by one traversal of their trie."""
        length, known, suffixes, stands, stand = self.length, self.words, self.suffixes, self.stands, self._stand
        path, last = b"", [0]
        for data, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                # Tokens that end here, the shortest first; exactly one of them is the last.
                start, found = end - 1, []
                while start >= 0:
                    token = suffixes.get(data[start:end], -1)
                    if token is not None:
                        if token < 0:
                            break
                        found.append((token, start))
                    start -= 1
                for token, start in reversed(found):
                    if not start:
                        break
                    pair = last[start] << 20 | token
                    ok = stands.get(pair)
                    if ok is None:
                        ok = stands[pair] = stand(last[start], token)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token for {data[:end]!r}")
                last.append(token)
            path, out, at = data, [], len(data)
            while at:
                out.append(last[at])
                at -= length[last[at]]
            out.reverse()
            known[word] = tuple(out)

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[tuple[int, ...]]]:
        """For each text the encodings of its pieces; null and empty have none."""
        for cache, most in ((self.pieces, CACHED), (self.words, CACHED), (self.stands, 4 * CACHED)):
            if len(cache) > most:
                cache.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.pieces.keys() if cut else set()
        split = {piece: (self.split_ascii if piece.isascii() else self.split_any)(piece) for piece in fresh}
        self._learn(set(chain.from_iterable(split.values())) - self.words.keys())
        known, pieces = self.words, self.pieces
        for piece, w in split.items():
            pieces[piece] = known[w[0]] if len(w) == 1 else tuple(chain.from_iterable(map(known.__getitem__, w)))
        out = [list(map(pieces.__getitem__, x)) for x in cut]
        for piece in fresh:
            if len(piece) > PIECE:
                del pieces[piece]
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """This worker's encoder for a broadcast vocabulary, kept from task to task."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    found = _ENCODERS.get(key)
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[key] = Encoder(*shared.value)
    return found


@contextmanager
def _no_collector() -> Iterator[None]:
    """Without Python's cycle collector, which would walk the caches again and again; nothing here makes cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_SHARED: dict[tuple[str, str], Broadcast] = {}


def share_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary on every executor; its size is that of the file, whatever the corpus."""
    path = path or default_vocabulary()
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        ranks = read_ranks(path)
        _SHARED[key] = spark.sparkContext.broadcast((ranks, _halves(ranks)))
    return _SHARED[key]


#: Texts of a batch encoded together.
TOGETHER = 500


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) for every row: the token ids of ``text``, without special tokens.

    A null or empty text gets an empty list; the strings of special tokens are
    ordinary text. Rows are neither merged nor moved: repeated keys give
    repeated rows, and the result has no shuffle.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                ids, ends = array("i"), array("i", [0])
                with _no_collector():
                    for pieces in encoder.encode_batch(part.column(1).to_pylist()):
                        ids.extend(chain.from_iterable(pieces))
                        ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(ids), pa.int32()) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row and ``tokens``, the length of its text in tokens."""
    shared = share_vocabulary(df.sparkSession, vocabulary)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                with _no_collector():
                    sizes = [sum(map(len, pieces)) for pieces in encoder.encode_batch(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(text, *keep).mapInArrow(run, f"{schema}, tokens bigint")
