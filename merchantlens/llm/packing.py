"""Operator 9, packing: bounded-space online packing of token ids into sequences.

Each partition keeps at most ``open_windows`` windows of ``length`` tokens.  A
document's whole windows are emitted at once; its rest goes into the open window that
it fills best.  If it fits none and all windows are in use, the fullest is emitted:
the rest's first tokens fill its gap if that is worth a cut (``least_cut``), and the
remainder opens a new window.  What is left open at the end of a partition is merged:
the windows of ``MERGED`` partitions, a bounded number of tokens, are put one after
the other and cut at every ``length`` tokens.  So one sequence for each such group
and few gaps below ``least_cut`` are padding.

Token ids are those of the tokenizers library, followed by ``end_id``.  A text that the
normaliser leaves alone but for upper case and white space is marked where its pieces
end and encoded in one call of a faster coder.  Of other texts, words between spaces are
encoded by the library once and memoised, since white space never reaches a token of
this vocabulary.  The memo is bounded by bytes and dropped with its task.

Rows: a null text counts as empty, which is ``end_id`` alone; a null key stays null;
repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, compress
from operator import is_
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from merchantlens.llm.bpe import byte_letters
from merchantlens.llm.frames import carried
from merchantlens.session import cut_lineage

LENGTH = 4096
OPEN_WINDOWS = 64
LEAST_CUT = 16
END_ID = 2
MERGED = 8
#: Bytes that a task's memo may take, those of a word, and those of a letter with its share of ids.
MEMO_BYTES, WORD_BYTES, LETTER_BYTES = 128 << 20, 200, 3
TEXTS = 256
#: Words encoded in one call.
TOGETHER = 2048
#: What marks a word's last letter in the vocabulary, and a character that is in no word.
WORD_END, MARK = "</w>", "\x01"
is_none = partial(is_, None)
#: Characters whose lower case depends on their neighbours, and the mark of special tokens.
_PLAIN = regex.compile(r"Σ|<\|")
_MARKED = regex.compile(rf"<\||{MARK}")
#: What is not a letter, with the letters that may belong to an apostrophe at its end.
_RUN = regex.compile(rf"[^\p{{L}}{MARK}]+(?:(?<=')(?:s|t|re|ve|m|ll|d))?")
_ASCII_RUN = re.compile(rf"[^a-z{MARK}]+(?:(?<=')(?:s|t|re|ve|m|ll|d))?")
#: Runs kept with their pieces, and the letters of the longest one.
RUNS, RUN_LETTERS = 1 << 16, 32


def _settled(letter: str) -> bool:
    """Whether a character is a letter or digit that the normaliser leaves alone."""
    return letter.isalnum() and (letter.isascii() or letter == letter.lower() and is_normalized("NFC", letter))


@lru_cache(maxsize=1)
def tokenizers(path: str) -> tuple:
    """The library's tokenizer; one for pieces of words; the pattern of pieces; for each id whether it ends one.

    The second merges bytes to the token of least id that they make together.  That is what
    the list of merges does if ids rise with its ranks and each token's own bytes come to
    that token: what is merged inside a token does not depend on what is around it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    import tiktoken
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    vocabulary, letters = told["model"]["vocab"], byte_letters()
    special = {token["content"] for token in told["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("ids must rise with the ranks of merges")
    ranks, ends = {}, np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        if token not in special:
            ends[i] = token.endswith(WORD_END)
            data = bytes(letters[c] for c in token.removesuffix(WORD_END))
            ranks[data + MARK.encode() * int(ends[i])] = i
    pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    plain = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
    return found, plain, pattern, ends


class WordIds(dict):
    """The ids of texts, as the library gives them; holds the packed ids of words of texts that go by words."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.plain, self.pattern, self.ends = tokenizers(path)
        self.used = 0
        self.runs: dict[str, str] = {}

    def _ids(self, words: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield struct.pack(f"<{len(found.ids)}I", *found.ids)

    def _add(self, words: list[str], pieces: list[str], each: list[int] | None = None) -> None:
        """Encode the pieces of some words at once; ``each`` has their number by word if it is not one."""
        if not words:
            return
        ids = np.array(self.plain.encode_ordinary(MARK.join(pieces) + MARK), dtype="<u4")
        after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        cuts = (4 * (after if each is None else after[np.cumsum([0, *each])])).tolist()
        data = ids.tobytes()
        self.update(zip(words, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Encode words; those that the normaliser leaves alone many at a time, piece by piece."""
        plain = [w for w in words if w.islower() and w.isalpha() and (w.isascii() or is_normalized("NFC", w))]
        for start in range(0, len(plain), TOGETHER):
            self._add(plain[start : start + TOGETHER], plain[start : start + TOGETHER])
        left = [w for w in words if w not in self]
        mixed = [w for w in left if w == w.lower() and is_normalized("NFC", w) and not _MARKED.search(w)]
        split = list(map(self.pattern.findall, mixed))
        mixed = list(compress(mixed, split))  # white space has no piece
        split = list(filter(None, split))
        self._add(mixed, list(chain.from_iterable(split)), list(map(len, split)))
        rest = [w for w in left if w not in self]
        self.update(zip(rest, self._ids(rest), strict=True))

    def _split(self, text: str) -> list[str]:
        return (text if _PLAIN.search(text) else text.lower()).replace("\n", " ").split(" ")

    def _know(self, words: set[str]) -> None:
        """Learn words that are not known yet."""
        # After a letter or digit a comma or stop is a token of its own.
        stems = {w: w[:-1] for w in words if w[-1] in ",." and _settled(w[-2:-1])}
        learned = (words - stems.keys() | {*stems.values(), ",", "."}) - self.keys()
        before = len(self)
        self._learn(list(learned))
        self.update((w, self[stem] + self[w[-1]]) for w, stem in stems.items())
        letters = sum(map(len, learned)) + sum(map(len, stems))
        self.used += WORD_BYTES * (len(self) - before) + LETTER_BYTES * letters

    def _run(self, found: re.Match | regex.Match) -> str:
        """What is not a letter, with a mark before it and after each of its pieces."""
        run = found[0]
        made = self.runs.get(run)
        if made is None:
            pieces = self.pattern.findall(run)
            goes_on = bool(pieces) and pieces[-1].isalpha()  # into the letters that follow
            made = MARK + MARK.join(pieces) + ("" if goes_on else MARK)
            if len(run) <= RUN_LETTERS:
                if len(self.runs) >= RUNS:
                    self.runs.clear()
                self.runs[run] = made
        return made

    def _marked(self, text: str) -> str | None:
        """The text with a mark after each piece, if the normaliser only lowers letters and joins spaces."""
        if "Σ" in text or "<|" in text or MARK in text:
            return None
        text = text.lower()
        if not (text.isascii() or is_normalized("NFC", text)):
            return None
        runs = _ASCII_RUN if text.isascii() else _RUN
        return runs.sub(self._run, text.replace(" ", MARK).replace("\n", MARK)) + MARK

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; most by one call each, others by their words."""
        marked = [self._marked(text) for text in texts]
        by_words = iter(self._by_words([t for t, m in zip(texts, marked, strict=True) if m is None]))
        for m in marked:
            yield next(by_words) if m is None else np.array(self.plain.encode_ordinary(m), dtype="<u4")

    def _by_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of texts, each word looked up."""
        if self.used > MEMO_BYTES:
            self.clear()
            self.used = 0
        self[""] = b""
        split = [self._split(text) for text in texts]
        known = [list(map(self.get, words)) for words in split]
        new: set[str] = set()
        for words, ids in zip(split, known, strict=True):
            new.update(compress(words, map(is_none, ids)))
        self._know(new)
        for words, ids in zip(split, known, strict=True):
            for at in compress(range(len(ids)), list(map(is_none, ids))):
                ids[at] = self[words[at]]
            yield np.frombuffer(b"".join(ids), dtype="<u4")


class Packer:
    """Bounded-space packing; ``add`` and ``close`` give pieces as tuples.

    A piece: key, start, ids, doc_tokens, sequence, offset, open.
    """

    def __init__(self, length: int, open_windows: int, least_cut: int, sequence: int = 0):
        self.length, self.most, self.least_cut = length, open_windows, least_cut
        self.sequence, self.windows = sequence, []  # of [used, pieces]

    def _emit(self, pieces: list[tuple], still_open: bool = False) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, tokens in pieces:
            yield key, start, ids, tokens, self.sequence, offset, still_open
            offset += len(ids)
        self.sequence += 1

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        tokens, start = len(ids), 0
        while tokens - start >= self.length:
            yield from self._emit([(key, start, ids[start : start + self.length], tokens)])
            start += self.length
        rest = tokens - start
        if not rest:
            return
        gap, best = min(
            ((self.length - w[0] - rest, n) for n, w in enumerate(self.windows) if self.length - w[0] >= rest),
            default=(0, -1),
        )
        if best < 0 and len(self.windows) >= self.most:
            fullest = max(range(len(self.windows)), key=lambda n: self.windows[n][0])
            used, pieces = self.windows.pop(fullest)
            gap = self.length - used
            if gap >= self.least_cut and rest - gap >= self.least_cut:
                pieces.append((key, start, ids[start : start + gap], tokens))
                start += gap
            yield from self._emit(pieces)
        if best < 0:
            self.windows.append([0, []])
        window = self.windows[best]
        window[0] += tokens - start
        window[1].append((key, start, ids[start:].copy(), tokens))
        if window[0] == self.length:
            yield from self._emit(self.windows.pop(best)[1])

    def close(self) -> Iterator[tuple]:
        """The pieces of windows still open."""
        for _, pieces in self.windows:
            yield from self._emit(pieces, still_open=True)
        self.windows = []


def merge_windows(pieces: list[tuple], length: int, sequence: int) -> Iterator[tuple]:
    """Pieces one after the other, cut at every ``length`` tokens."""
    used = 0
    for key, start, ids, tokens in pieces:
        while len(ids):
            part = ids[: length - used]
            yield key, start, part, tokens, sequence, used, False
            start, ids, used = start + len(part), ids[len(part) :], used + len(part)
            if used == length:
                sequence, used = sequence + 1, 0


_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{name} long" for name in _NAMES)


def _columns(pieces: list[tuple], with_ids: bool) -> dict[str, list]:
    """``key``, the columns of the contract and ``ids``, kept where asked for or still needed."""
    packed = [p[2].astype("<u4").tobytes() for p in pieces]
    return {
        "key": [p[0] for p in pieces],
        "start": [p[1] for p in pieces],
        "length": [len(p[2]) for p in pieces],
        "ids_crc32": [zlib.crc32(ids) for ids in packed],
        "doc_tokens": [p[3] for p in pieces],
        "sequence_id": [p[4] for p in pieces],
        "offset": [p[5] for p in pieces],
        "ids": [ids if with_ids or p[6] else None for p, ids in zip(pieces, packed, strict=True)],
        "part": [p[4] >> 32 if p[6] else None for p in pieces],
    }


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: the key column, where the piece lies in its document
    (``start``, ``length``, ``doc_tokens``) and in its sequence (``sequence_id``,
    ``offset``), ``ids_crc32`` and, if asked for, ``ids`` (4 bytes each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        packer = Packer(length, open_windows, least_cut, TaskContext.get().partitionId() << 32)
        kind = None
        for batch in batches:
            kind = batch.schema.field("key").type
            pieces, keys = [], batch.column("key").to_pylist()
            for at in range(0, len(batch), TEXTS):
                texts = [t or "" for t in batch.column("text")[at : at + TEXTS].to_pylist()]
                for n, ids in enumerate(words.encode(texts), at):
                    pieces += packer.add(keys[n], np.append(ids, np.uint32(end_id)))
                if len(pieces) >= 1024:
                    yield arrow(pieces, kind)
                    pieces = []
            if pieces:
                yield arrow(pieces, kind)
        if kind is not None and (pieces := list(packer.close())):
            yield arrow(pieces, kind)

    def arrow(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = _columns(pieces, with_ids)
        kinds = {"key": kind, "ids": pa.binary()}
        return pa.record_batch({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in columns.items()})

    def merged(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        ids = [np.frombuffer(data, dtype="<u4") for data in rows["ids"]]
        nulls = rows["key"].isna()
        keys = [None if gone else k for k, gone in zip(rows["key"], nulls, strict=True)]
        pieces = zip(keys, map(int, rows["start"]), ids, map(int, rows["doc_tokens"]), strict=True)
        made = _columns(list(merge_windows(list(pieces), length, (1 << 30) + group[0] << 32)), with_ids)
        frame = pd.DataFrame({name: made[name] for name in ("key", *_NAMES)})
        frame["ids"] = pd.Series(made["ids"], dtype=object)
        if nulls.any() and rows["key"].dtype != object:
            frame["key"] = frame["key"].astype("Int64")
        return frame

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = carried(rows, "key", new=f"{_SCHEMA}, ids binary")
    first = cut_lineage(rows.mapInArrow(run, carried(rows, "key", new=f"{_SCHEMA}, ids binary, part long")))
    left_over = first.where(F.col("part").isNotNull())
    group = F.floor(F.col("part") / MERGED).alias("group")
    rest = left_over.groupBy(group).applyInPandas(merged, schema)
    whole = first.where(F.col("part").isNull()).drop("part").unionAll(rest)
    return whole.select(F.col("key").alias(key), *_NAMES, *(["ids"] if with_ids else []))
