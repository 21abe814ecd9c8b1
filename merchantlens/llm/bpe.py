"""Operator 1, BPE encoding and decoding: a bounded-lookahead streaming transducer.

``Encoder`` takes a text piece by piece and gives token ids as soon as they are
stable, that is, whatever may follow.  It keeps at most a window of text:

* Special tokens split the text; the last few characters are held back while they
  could begin one.
* Between them, a space after a non-space and before a non-space always begins a
  new word (one character of lookahead), so the words before the last such space
  are stable.  Words are memoised; the memo is bounded by bytes and dropped with its task.
* A run without such a space longer than ``WINDOW`` characters goes through
  ``WindowedMerges``, which merges a window of bytes and emits the tokens that end
  at least ``lookahead`` bytes before its end.

Every text takes this way, whatever its length.

``sufficient_lookahead`` finds that number from the merge list.  Let two texts share
their first p bytes.  At first all tokens before d = p are equal and end there in
both.  A rule moves d to the left only if the token on its left is the rule's left
part and is merged with what begins at d in one text alone; d moves by that part's
length.  The next such rule has a higher rank, and its right part is what now begins
at d: the last rule's left part, or a token that begins with it.  The heaviest chain
of rules of this kind bounds the way of d from p.

``Decoder`` turns ids into bytes and bytes into text; it keeps an incomplete UTF-8
sequence until it is completed or found wrong (then U+FFFD).

Rows: a null text counts as empty; an empty text has no tokens; texts of any length
use the same memory beyond their own value; repeated rows and null keys stay as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Collection, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from merchantlens.llm.frames import carried

#: Characters taken from a text at a time, and those of a run without a sure space that are merged as one word.
PIECE = 1 << 16
WINDOW = 1 << 9
#: Bytes that a task's memo may take, those of a word or chunk, those of a letter with its share of
#: ids, and new chunks that are learned at a time.
MEMO_BYTES, WORD_BYTES, LETTER_BYTES, LEARNED = 160 << 20, 150, 3, 100_000
#: Texts whose new words are merged in one go.
TEXTS = 256
#: The word pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN)
_LETTERS, _NUMBERS = regex.compile(r" ?\p{L}+"), regex.compile(r" ?\p{N}+")
_OTHERS, _SPACES = regex.compile(r" ?[^\s\p{L}\p{N}]+"), regex.compile(r"\s+")
#: A space that surely begins a word; and one that may not.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = regex.compile(r" \s|\s ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Byte strings, ids and merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ids = {t: i for t, i in told["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: to_bytes(t) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda item: item[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.lookahead = sufficient_lookahead(
            [(a, b, made) for (a, b), (_, made) in self.merges.items()],
            {i: len(b) for i, b in self.bytes_of.items()},
        )


def sufficient_lookahead(rules: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token's end that settle it; ``rules`` (left, right, made) by rank."""
    left_of = {made: left for left, _, made in rules}
    heaviest: dict[int, int] = {}  # by token: of rules whose right part begins with it
    most = 0
    for left, right, _ in reversed(rules):
        chain = length[left] + heaviest.get(left, 0)
        most = max(most, chain)
        token = right
        while token is not None:
            if heaviest.get(token, 0) < chain:
                heaviest[token] = chain
            token = left_of.get(token)
    return most


def merge(ids: list[int], merges: dict) -> list[int]:
    """Merge the pair of least rank, leftmost first, until none is left."""
    if len(ids) > 64:
        return _merge_long(ids, merges)
    while len(ids) > 1:
        found = [merges.get(pair) for pair in zip(ids, ids[1:], strict=False)]
        least = min((f for f in found if f), default=None)
        if least is None:
            break
        out, n, end = [], 0, len(ids)
        while n < end:
            if n + 1 < end and found[n] == least:
                out.append(least[1])
                n += 2
            else:
                out.append(ids[n])
                n += 1
        ids = out
    return ids


def _merge_long(ids: list[int], merges: dict) -> list[int]:
    """The same with a heap and a linked list."""
    ids, end = list(ids), len(ids)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [
        (*merges[pair], n, pair) for n, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in merges
    ]
    heapify(heap)
    while heap:
        _, made, n, pair = heappop(heap)
        right = after[n]
        if right >= end or (ids[n], ids[right]) != pair:
            continue
        ids[n], ids[right] = made, -1
        after[n] = after[right]
        if after[n] < end:
            before[after[n]] = n
        for at in (before[n], n):
            if at >= 0 and after[at] < end:
                pair = ids[at], ids[after[at]]
                if pair in merges:
                    heappush(heap, (*merges[pair], at, pair))
    return [i for i in ids if i >= 0]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WindowedMerges:
    """Merges one endless word in windows; ``feed`` gives the ids that are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.waiting = vocabulary, b""
        self.window = vocabulary.lookahead + WINDOW

    def _merged(self, data: bytes) -> list[int]:
        first = self.vocabulary.id_of_byte
        return merge([first[b] for b in data], self.vocabulary.merges)

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.waiting += data
        while len(self.waiting) > self.window + WINDOW:
            part, end, stable = self.waiting[: self.window], 0, []
            for i in self._merged(part):
                if end + len(self.vocabulary.bytes_of[i]) > len(part) - self.vocabulary.lookahead:
                    break
                end += len(self.vocabulary.bytes_of[i])
                stable.append(i)
            self.waiting = self.waiting[end:]
            yield packed(stable)

    def finish(self) -> bytes:
        data, self.waiting = self.waiting, b""
        return packed(self._merged(data))


class Lockstep:
    """Merges many words at once: a row for each word, a column for each token."""

    LONGEST = 64

    def __init__(self, vocabulary: Vocabulary):
        pairs = np.array([(a, b, r, made) for (a, b), (r, made) in vocabulary.merges.items()])
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.none = np.int32(len(pairs))
        self.keys, self.ranks = keys[order], pairs[order, 2].astype(np.int32)
        self.made = np.empty(len(pairs), dtype=np.int32)
        self.made[pairs[:, 2]] = pairs[:, 3]
        self.first = np.array(vocabulary.id_of_byte, dtype=np.int32)
        self.of_bytes = self._rank(np.repeat(self.first, 256), np.tile(self.first, 256))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words of 1 to ``LONGEST`` bytes."""
        out = [b""] * len(words)
        sizes = np.array([len(word) for word in words])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, self.LONGEST)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                self._merge(words, rows, high, out)
        return out

    def _merge(self, words: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        data = b"".join(words[n].ljust(width, b"\0") for n in rows)
        letters = np.frombuffer(data, dtype=np.uint8).reshape(len(rows), width)
        size = np.array([len(words[n]) for n in rows])
        ids = np.concatenate([self.first[letters], np.full((len(rows), 1), -1, np.int32)], axis=1)
        rank = np.full(ids.shape, self.none)
        rank[:, : width - 1] = self.of_bytes[letters[:, :-1].astype(np.int32) * 256 + letters[:, 1:]]
        columns = np.arange(width + 1)
        rank[columns >= size[:, None] - 1] = self.none
        while len(rows):
            at = rank.argmin(axis=1)
            each = np.arange(len(rows))
            least = rank[each, at]
            done = least == self.none
            if done.any():
                for n, tokens, end in zip(rows[done], ids[done].astype("<u4"), size[done], strict=True):
                    out[n] = tokens[:end].tobytes()
                go = ~done
                rows, ids, rank, size = rows[go], ids[go], rank[go], size[go]
                at, least, each = at[go], least[go], np.arange(len(rows))
            ids[each, at] = self.made[least]
            move = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, move, axis=1)
            move = np.minimum(columns + (columns >= at[:, None]), width)
            rank = np.take_along_axis(rank, move, axis=1)
            size -= 1
            for column in (at - 1, at):
                in_word = (column >= 0) & (column < size - 1)
                r, c = each[in_word], column[in_word]
                rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])
            rank[each, size - 1] = self.none


@lru_cache(maxsize=2)
def lockstep(vocabulary: Vocabulary) -> Lockstep:
    return Lockstep(vocabulary)


def _make_room(memo: dict, used: int, new: Collection[str]) -> int:
    """Empty a memo that the new entries would make too large; the bytes it then takes."""
    more = WORD_BYTES * len(new) + LETTER_BYTES * sum(map(len, new))
    if used + more > MEMO_BYTES // 2:
        memo.clear()
        used = 0
    return used + more


class _Words(dict):
    """The packed ids of a word; computed when missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.lockstep, self.used = vocabulary, lockstep(vocabulary), 0

    def learn(self, words: set[str]) -> None:
        new = [(word, data) for word in words if word not in self and len(data := word.encode()) <= 64]
        self.used = _make_room(self, self.used, [word for word, _ in new])
        self.update(zip((w for w, _ in new), self.lockstep.merge([d for _, d in new]), strict=True))

    def __missing__(self, word: str) -> bytes:
        first = self.vocabulary.id_of_byte
        return packed(merge([first[b] for b in word.encode()], self.vocabulary.merges))


class _Chunks(dict):
    """The packed ids of a space followed by what lies before the next space."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words, self.used = words, 0

    def learn(self, chunks: set[str]) -> None:
        """Learn a bounded set of chunks, their words in lockstep."""
        new = {chunk: _WORDS.findall(" " + chunk) for chunk in chunks if chunk not in self and len(chunk) <= 64}
        self.words.learn({word for found in new.values() for word in found})
        self.used = _make_room(self, self.used, new)
        ids = self.words.__getitem__
        for chunk, found in new.items():
            self[chunk] = b"".join(map(ids, found))

    def __missing__(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(" " + chunk)))


class Encoder:
    """``feed`` pieces, then ``finish``; both give packed ids (4 bytes each)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = _Words(vocabulary)
        self.chunks = _Chunks(self.words)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.held = max(map(len, special), default=1) - 1
        self.waiting, self.run, self.merges = "", None, WindowedMerges(vocabulary)

    def _whole(self, text: str) -> bytes:
        """The ids of a text that begins and ends between words."""
        if not text:
            return b""
        if not _simple(text):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))
        first, *chunks = text.split(" ")
        head = b"".join(map(self.words.__getitem__, _WORDS.findall(first)))
        return head + b"".join(map(self.chunks.__getitem__, chunks))

    def learn(self, texts: list[str]) -> None:
        """Memoise the words of some texts, which makes encoding them faster."""
        new = set()
        for text in texts:
            for start in range(0, len(text), PIECE):
                new.update(text[start : start + PIECE].split(" "))
                if len(new) > LEARNED:
                    self.chunks.learn(new)
                    new = set()
        self.chunks.learn(new)

    def _segment(self, text: str, last: bool) -> Iterator[bytes]:
        """Text up to a special token; ``last`` if nothing else comes before one."""
        self.waiting += text
        if self.run is None and last and len(self.waiting) <= 2 * PIECE:
            text, self.waiting = self.waiting, ""
            yield self._whole(text)
            return
        while self.waiting or (last and self.run is not None):
            if self.run is not None:
                yield from self._go_on(last)
                if self.run is not None:
                    return
                continue
            if last and len(self.waiting) <= 2 * PIECE:
                text, self.waiting = self.waiting, ""
                yield self._whole(text)
                return
            limit = min(len(self.waiting) - 1, 2 * PIECE)
            cut = self.waiting.rfind(" ", 1, limit)
            while cut > 0 and not _CUT.match(self.waiting, cut):
                cut = self.waiting.rfind(" ", 1, cut)
            if cut > 0:
                text, self.waiting = self.waiting[:cut], self.waiting[cut:]
                yield self._whole(text)
            elif len(self.waiting) <= WINDOW:
                return
            elif not (yield from self._without_cut()):
                return

    def _without_cut(self) -> Iterator[bytes]:
        """No sure space in a window: word by word; a word with no end yet becomes a run."""
        word = _WORDS.match(self.waiting)
        # Two characters more settle a contraction and white space.
        if word.end() < len(self.waiting) - 2:
            text, self.waiting = self.waiting[: word.end()], self.waiting[word.end() :]
            yield self.words[text]
            return True
        for kind in (_LETTERS, _NUMBERS, _OTHERS, _SPACES):
            if kind.match(self.waiting):
                self.run = kind
                break
        return True

    def _go_on(self, last: bool) -> Iterator[bytes]:
        """Feed the run; end it where its kind of character ends."""
        text, spaces = self.waiting, self.run is _SPACES
        kind = regex.compile(self.run.pattern.removeprefix(" ?"))
        begun = bool(self.merges.waiting)
        found = kind.match(text) if begun or spaces else self.run.match(text)
        end = found.end() if found else 0
        ended = end < len(text) or last
        if spaces and not (ended and end == len(text)):
            end = max(0, end - 1)  # the last one may belong to the next word
        yield from self.merges.feed(text[:end].encode())
        self.waiting = text[end:]
        if ended:
            yield self.merges.finish()
            self.run = None

    def feed(self, text: str) -> Iterator[bytes]:
        self.waiting, text = "", self.waiting + text
        while found := self.special.search(text):
            yield from self._segment(text[: found.start()], last=True)
            yield packed([self.vocabulary.special[found[0]]])
            text = text[found.end() :]
        # What could still become a special token is held back.
        keep = next(
            (n for n in range(min(self.held, len(text)), 0, -1) if self._begins_special(text[-n:])), 0
        )
        yield from self._segment(text[: len(text) - keep], last=False)
        self.waiting += text[len(text) - keep :]

    def _begins_special(self, tail: str) -> bool:
        return any(token.startswith(tail) for token in self.vocabulary.special)

    def finish(self) -> Iterator[bytes]:
        yield from self._segment("", last=True)

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text, piece by piece."""
        for start in range(0, len(text), PIECE):
            yield from self.feed(text[start : start + PIECE])
        yield from self.finish()


def _simple(text: str) -> bool:
    """Whether each space of a text begins a word: then it can be split at spaces."""
    return not (_ODD_SPACE.search(text) or text[-1] == " ")


class Decoder:
    """Ids to text; ``feed`` packed ids, then ``finish``."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.bytes_of) + 1
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        ids = np.frombuffer(data, dtype="<u4").tolist()
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        end = self.state.decode(b"", final=True)
        self.state.reset()
        return end


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One in a Python worker; it is as large as its file, whatever is encoded."""
    return Vocabulary(path)


def coder(path: str) -> tuple[Encoder, Decoder]:
    """One of each for a task, with memos of its own."""
    return Encoder(vocabulary(path)), Decoder(vocabulary(path))


def _batches(batches: Iterator[pa.RecordBatch], path: str, each) -> Iterator[pa.RecordBatch]:
    encoder, decoder = coder(path)
    for batch in batches:
        made = []
        for start in range(0, len(batch), TEXTS):
            texts = [text or "" for text in batch.column("text")[start : start + TEXTS].to_pylist()]
            encoder.learn(texts)
            made += [each(encoder, decoder, text) for text in texts]
        if made:
            columns = [pa.array(column) for column in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *each.names])


def _encode(encoder: Encoder, decoder: Decoder, text: str) -> tuple:
    return (np.frombuffer(b"".join(encoder.encode(text)), dtype="<u4").astype("int32"),)


_encode.names = ["ids"]


def _digest(encoder: Encoder, decoder: Decoder, text: str) -> tuple:
    """Digests of ids and decoded text, which are never held as a whole."""
    of_ids, of_text, count = hashlib.sha256(), hashlib.sha256(), 0
    for ids in encoder.encode(text):
        of_ids.update(ids)
        of_text.update(decoder.feed(ids).encode())
        count += len(ids) // 4
    of_text.update(decoder.finish().encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()


_digest.names = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _apply(rows: DataFrame, path: str, each, schema: str) -> DataFrame:
    return rows.mapInArrow(lambda b: _batches(b, path, each), carried(rows, "row", new=schema))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row`` (the input's columns) and ``ids``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return _apply(rows, path, _encode, "ids array<int>")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, ``n_tokens`` and digests of the ids and of the text decoded from them."""
    rows = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _apply(rows, path, _digest, schema).withColumnRenamed("row", key)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``row`` and ``text``; null ids give an empty text, unknown ids no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coder(path)
        for batch in batches:
            texts = []
            for found in batch.column("ids"):
                known = [i for i in found.as_py() or [] if i is not None and 0 <= i < len(decoder.bytes_of)]
                texts.append(decoder.feed(packed(known)) + decoder.finish())
            columns = [batch.column("row"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text"])

    rows = tokens.select(F.struct("*").alias("row"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, carried(rows, "row", new="text string"))
