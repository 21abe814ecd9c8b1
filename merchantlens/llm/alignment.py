"""Operator 11, cross-tokenizer alignment: counts of token pairs behind a minimal perfect hash.

Two tokenizers A and B cut the same bytes, a space followed by the text.  Where tokens of
both end together a group ends, and the two tokens that end there are linked.  How often
each pair of ids is linked in the whole corpus is found and used in four steps:

1. Each task aligns its documents and adds up its pairs; these partial sums are written.
2. The distinct pairs are the keys of a minimal perfect hash (``PerfectHash``), which
   keeps the keys themselves, so a pair that is no key is recognised.
3. Partial sums become dense vectors of counts indexed by the hash.  They are cut into
   segments and summed as a tree: each level adds ``FAN_IN`` vectors of a segment, so no
   task holds more, however many tasks there were.
4. A second pass aligns every document again and looks its pairs up.

Of two tokens that end together the shorter one's bytes end the longer one's.  A token has
no more endings than bytes, so the two vocabularies bound the number of pairs
(``most_pairs``; 324,300 for the vocabularies of the registered query) however large the
corpus: keys and counts fit a driver and are sent to the tasks.

Neither vocabulary has a token across the beginning of a word, that is, a space or line
feed between two other characters.  Texts are cut there, and what lies between two cuts is
aligned once for many occurrences; the memo is bounded by bytes and dropped with its task.

Rows: a null or empty text, and one whose tokens do not give back its bytes (B writes a
space for U+2581), have no tokens: zeros and ''.  Special tokens in a text are plain text.
Texts of any length; repeated rows and null keys stay as they are, and each row counts;
ties for the highest count of a B id all count; an empty table gives an empty result.  Of
the input only key and text are read, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, compress
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from merchantlens.llm.bpe import PATTERN, Vocabulary
from merchantlens.llm.frames import carried
from merchantlens.session import cut_lineage

#: Bytes that a task's memo may take, and what a chunk takes besides its strings.
MEMO_BYTES, CHUNK_BYTES = 128 << 20, 300
#: Texts and chunks that are treated at a time.
TEXTS, CHUNKS = 256, 4096
#: Slots of a segment, and vectors of a segment that one task adds.
SEGMENT, FAN_IN = 1 << 14, 16
SPACE = "▁"
is_none = partial(is_, None)
#: Where a word surely begins; what stands after its first character if there is more white space.
_CUT = regex.compile(r"(?<=\S)(?=[ \n]\S)")
_MORE = regex.compile(r"\G\s|[ \n]")
#: Marks the name of a chunk with more white space; rows of chunks that do not stand for tokens.
WIDE = "  "
LOSSY, ODD = -1, -2


class Tokenizers:
    """A byte-level vocabulary (A) and a sentence-piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        vocabulary = Vocabulary(path_a)
        made = [made for _, made in vocabulary.merges.values()]
        if made != sorted(made):
            raise ValueError("ids must rise with the ranks of merges")
        special = set(vocabulary.special.values())
        self.bytes_a = {i: b for i, b in vocabulary.bytes_of.items() if i not in special}
        ranks = {b: i for i, b in self.bytes_a.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {
            i: bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        }
        if any("\n" in piece or SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("pieces must not reach into the next word")
        self.length_a, self.length_b = _lengths(self.bytes_a), _lengths(self.bytes_b)
        self._merge_bytes(pieces)

    def _merge_bytes(self, pieces: list[str]) -> None:
        """B's merges as merges of bytes, for texts of characters of one or two bytes.

        Both ways merge the two neighbours that make the piece of highest score, once
        each character is one symbol: those of two bytes therefore come first.
        """
        normal = [i for i in range(len(pieces)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        of_bytes = {self.bytes_b[i]: i for i in normal}
        if len(of_bytes) < len(normal):
            raise ValueError("pieces must differ")
        single = {self.bytes_b[i]: i for i in range(len(pieces)) if self.b.is_byte(i)} | {
            data: i for data, i in of_bytes.items() if len(data) == 1
        }
        wide = {data: i for data, i in of_bytes.items() if len(data) == 2 and len(data.decode()) == 1}
        longer = [i for i in normal if len(self.bytes_b[i].decode()) > 1]
        longer.sort(key=lambda i: -self.b.get_score(i))
        order = [*single.items(), *wide.items(), *((self.bytes_b[i], i) for i in longer)]
        self.piece_of = np.array([i for _, i in order])
        ranks = {data: rank for rank, (data, _) in enumerate(order)}
        self.fast_b = tiktoken.Encoding("b", pat_str=r"[ \n][^ \n]*", mergeable_ranks=ranks, special_tokens={})
        letters = "".join(data.decode() for data in wide)
        self.merged = regex.compile(rf"[\x00-\x7F{regex.escape(letters)}]*")

    def fast(self, key: str) -> bool:
        """Whether B's merges of bytes do for a chunk."""
        return key.isascii() or self.merged.fullmatch(key) is not None

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; the library itself puts a space in front."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]


def _lengths(bytes_of: dict[int, bytes]) -> np.ndarray:
    found = np.zeros(max(bytes_of) + 1, dtype=np.int64)
    for i, data in bytes_of.items():
        found[i] = len(data)
    return found


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def most_pairs(bytes_a: dict[int, bytes], bytes_b: dict[int, bytes]) -> int:
    """How many pairs of tokens can end together."""
    ending_a: dict[bytes, int] = {}
    ending_b: dict[bytes, int] = {}
    for of, ending in ((bytes_a, ending_a), (bytes_b, ending_b)):
        for data in of.values():
            ending[data] = ending.get(data, 0) + 1
    total = 0
    for data in bytes_a.values():
        total += sum(ending_b.get(data[at:], 0) for at in range(len(data)))
    for data in bytes_b.values():
        total += sum(ending_a.get(data[at:], 0) for at in range(1, len(data)))
    return total


def keys_of(text: str) -> list[str]:
    """A space and the text, cut at each space and before each line feed: chunks without their space."""
    return text.replace("\n", " \n").split(" ")


def sure_keys_of(text: str) -> list[str]:
    """The same for any text, cut only where a word surely begins; ``WIDE`` marks what may be no word."""
    return [
        WIDE + c if _MORE.search(c, 1) or c[-1].isspace() else c if c[0] == "\n" else c[1:] for c in _CUT.split(" " + text)
    ]


def is_odd(key: str) -> bool:
    """Whether there is white space at an end besides the space or line feed that begins the chunk."""
    word = key[1:] if key[:1] == "\n" else key
    return not word or word[0].isspace() or word[-1].isspace()


def chunk_of(key: str) -> str:
    return key[len(WIDE) :] if key[:2] == WIDE else key if key[0] == "\n" else " " + key


class PerfectHash:
    """A minimal perfect hash of distinct keys: levels of bits, a key in the first level
    where no other key has its place; its slot is the number of bits before its own.
    """

    GAMMA = 2

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.int64)
        self.sizes: list[int] = []
        levels, left = [], keys
        while len(left):
            size = -(-self.GAMMA * len(left) // 64) * 64
            places = self._places(left, len(self.sizes), size)
            alone = np.bincount(places, minlength=size)[places] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[places[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~alone]
        self.words = np.concatenate(levels) if levels else np.zeros(0, dtype="<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.zeros(0, dtype=np.int64)
        slots = self._slots(keys)
        self.keys = np.empty(len(keys), dtype=np.int64)
        self.keys[slots] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, left, first = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = first + self._places(keys[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slots[left[found]] = (self.before[word] + np.bitwise_count(below))[found]
            left, first = left[~found], first + size
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for what is none."""
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.keys[slots[known]] == keys[known]
        return np.where(known, slots, -1)


class Counts:
    """How often each pair is linked in the corpus, and which are the best of their B id."""

    def __init__(self, hash_: PerfectHash, counts: np.ndarray, size_b: int):
        self.hash, self.counts = hash_, counts
        highest = np.zeros(size_b, dtype=np.int64)
        of_b = hash_.keys % size_b
        np.maximum.at(highest, of_b, counts)
        self.best = counts == highest[of_b]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is a best one, and its count; 0 for what was never linked."""
        slots = self.hash.slots(pairs)
        known = np.flatnonzero(slots >= 0)
        best, counts = np.zeros(len(pairs), dtype=bool), np.zeros(len(pairs), dtype=np.int64)
        best[known], counts[known] = self.best[slots[known]], self.counts[slots[known]]
        return best, counts


class Aligner:
    """Aligns chunks; remembers them until ``MEMO_BYTES`` are used."""

    STATS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")

    def __init__(self, both: Tokenizers, counts: Counts | None = None):
        self.both, self.counts = both, counts
        self.size_b = len(both.length_b)
        self.signs = [
            f"{i}{sign}" for size, signs in ((len(both.length_a), ",|"), (self.size_b, ",;")) for sign in signs for i in range(size)
        ]
        self.widths = np.array(list(map(len, self.signs)))
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}  # LOSSY: its tokens do not give back its bytes
        self.used = self.known = 0
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.stats = np.zeros((1, len(self.STATS)), dtype=np.int64)
        self.groups: list[str] = []

    @property
    def full(self) -> bool:
        return self.used > MEMO_BYTES

    def learn(self, keys: set[str]) -> None:
        """Align what is new; a chunk with white space at an end may not be cut as it was."""
        odd = [key for key in keys if key[:2] != WIDE and is_odd(key)]
        self.rows.update(dict.fromkeys(odd, ODD))
        keys = keys.difference(odd)
        wide = [key for key in keys if key[:2] == WIDE]
        fast = [key for key in keys if key[:2] != WIDE and self.both.fast(key)]
        for found in (fast, wide, list(keys.difference(wide, fast))):
            for start in range(0, len(found), CHUNKS):
                self._learn(found[start : start + CHUNKS], found is fast, found is wide)

    def _learn(self, keys: list[str], fast: bool, wide: bool) -> None:
        chunks = list(map(chunk_of, keys))
        data = [chunk.encode() for chunk in chunks]
        if fast:
            ids_b = self.both.piece_of[self.both.fast_b.encode_ordinary("".join(chunks))]
        else:
            each_b, of_b = self.both.ids_b(chunks), self.both.bytes_b
            fits = [b"".join(map(of_b.__getitem__, ids)) == d for ids, d in zip(each_b, data, strict=True)]
            self.rows.update((key, LOSSY) for key, fit in zip(keys, fits, strict=True) if not fit)
            self.used += CHUNK_BYTES * fits.count(False)
            keys, chunks, data, each_b = (list(compress(of, fits)) for of in (keys, chunks, data, each_b))
            if not chunks:
                return
            ids_b = np.fromiter(chain.from_iterable(each_b), dtype=np.int64)
        if wide:
            ids_a = np.array(list(chain.from_iterable(map(self.both.a.encode_ordinary, chunks))))
        else:
            ids_a = np.array(self.both.a.encode_ordinary("".join(chunks)))
        ends = np.cumsum([len(d) for d in data])
        ends_a, ends_b = np.cumsum(self.both.length_a[ids_a]), np.cumsum(self.both.length_b[ids_b])
        if ends_a[-1] != ends[-1] or ends_b[-1] != ends[-1]:
            raise ValueError("tokens do not cover the text")
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        # Groups, tokens of A and of B up to the end of each chunk.
        last = [np.searchsorted(of, ends, side="right") for of in (ends_a[at_a], ends_a, ends_b)]
        links, n_a, n_b = (np.diff(found, prepend=0) for found in last)
        pairs = ids_a[at_a] * self.size_b + ids_b[at_b]
        self.rows.update(zip(keys, range(self.known, self.known + len(chunks)), strict=True))
        self.known += len(chunks)
        self.used += sum(map(len, data)) + CHUNK_BYTES * len(chunks)
        if self.counts is None:
            self.pairs.append(pairs)
            self.links.append(links)
            self.used += pairs.nbytes
            return
        firsts = last[0] - links
        # A pair of texts without tokens alone is no key.
        best, count = (np.add.reduceat(of.astype(np.int64), firsts) for of in self.counts.of(pairs))
        if self.known > len(self.stats):
            self.stats = np.resize(self.stats, (2 * self.known, len(self.STATS)))
        self.stats[self.known - len(chunks) : self.known] = np.stack([n_a, n_b, links, best, count], axis=1)
        made = self._written(ids_a, ids_b, at_a, at_b, last[1] + last[2])
        self.groups += made
        self.used += sum(map(len, made))

    def _written(
        self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, ends: np.ndarray
    ) -> list[str]:
        """The groups of each chunk as text; ``ends`` counts the tokens up to a chunk's end."""
        size_a, size_b = len(self.both.length_a), self.size_b
        signs_a, signs_b = ids_a.copy(), ids_b + 2 * size_a
        signs_a[at_a] += size_a  # the last one of a group, which a bar follows
        signs_b[at_b] += size_b
        group_a = 2 * np.searchsorted(at_a, np.arange(len(ids_a)))
        group_b = 2 * np.searchsorted(at_b, np.arange(len(ids_b))) + 1
        order = np.argsort(np.concatenate([group_a, group_b]), kind="stable")
        signs = np.concatenate([signs_a, signs_b])[order]
        whole = "".join(map(self.signs.__getitem__, signs.tolist()))
        stops = np.cumsum(self.widths[signs])[ends - 1].tolist()
        return [whole[start : stop - 1] for start, stop in zip([0, *stops], stops, strict=False)]

    def rows_of(self, texts: list[str | None]) -> Iterator[list[int] | None]:
        """The rows of each text's chunks; None for a text without tokens."""
        split = [keys_of(text) if text else [] for text in texts]
        seen = self._seen(split)
        odd = [n for n, rows in enumerate(seen) if rows and min(rows) == ODD]
        for n, rows in zip(odd, self._seen([sure_keys_of(texts[n]) for n in odd]), strict=True):
            seen[n] = rows
        for rows in seen:
            yield None if not rows or min(rows) < 0 else rows

    def _seen(self, split: list[list[str]]) -> list[list[int]]:
        seen = [list(map(self.rows.get, keys)) for keys in split]
        new: set[str] = set()
        for keys, rows in zip(split, seen, strict=True):
            new.update(compress(keys, map(is_none, rows)))
        self.learn(new)
        return [
            [self.rows[key] if row is None else row for key, row in zip(keys, rows, strict=True)]
            for keys, rows in zip(split, seen, strict=True)
        ]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.slice(at, TEXTS)
            yield part, part.column("text").to_pylist()


def _partial_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): the links of each task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b))
        pairs = sums = uses = np.zeros(0, dtype=np.int64)

        def fold() -> tuple[np.ndarray, np.ndarray]:
            """The sums by pair with the links of all chunks used since the last time."""
            found, at = np.unique(np.concatenate([pairs, *aligner.pairs]), return_inverse=True)
            links = np.concatenate([np.zeros(0, dtype=np.int64), *aligner.links])
            added = np.zeros(len(found), dtype=np.int64)
            np.add.at(added, at, np.concatenate([sums, np.repeat(uses, links)]))
            return found, added

        for _, texts in _slices(batches):
            found = Counter()
            for rows in aligner.rows_of(texts):
                found.update(rows or ())
            uses = np.pad(uses, (0, aligner.known - len(uses)))
            if found:
                uses[list(found)] += list(found.values())
            if aligner.full:
                pairs, sums = fold()
                aligner.clear()
                uses = np.zeros(0, dtype=np.int64)
        pairs, sums = fold()
        if (sums > 0).any():
            used = [pa.array(of[sums > 0]) for of in (pairs, sums)]
            yield pa.RecordBatch.from_arrays(used, ["pair", "n"])

    return rows.select("text").mapInArrow(run, "pair long, n long")


_VECTORS = "part int, segment int, counts binary"


def _dense(partial: DataFrame, hash_: PerfectHash) -> DataFrame:
    """Each task's sums as a vector indexed by the hash, in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(-(-len(hash_.keys) // SEGMENT) * SEGMENT, dtype="<i8")
        for batch in batches:
            slots = hash_.slots(batch.column("pair").to_numpy())
            np.add.at(vector, slots, batch.column("n").to_numpy())
        parts = vector.reshape(-1, SEGMENT)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            part = np.full(len(used), TaskContext.get().partitionId(), dtype=np.int32)
            data = [parts[n].tobytes() for n in used]
            columns = [pa.array(part), pa.array(used.astype(np.int32)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "counts"])

    return partial.mapInArrow(run, _VECTORS)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, dtype="<i8")
    for data in rows["counts"]:
        total += np.frombuffer(data, dtype="<i8")
    first = rows.iloc[0]
    return pd.DataFrame({"part": [first["part"] // FAN_IN], "segment": [first["segment"]], "counts": [total.tobytes()]})


def tree_sum(vectors: DataFrame) -> DataFrame:
    """One vector a segment: the sum of those of all parts, ``FAN_IN`` at a time."""
    vectors = cut_lineage(vectors)
    while (vectors.agg(F.max("part")).first()[0] or 0) > 0:
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        vectors = cut_lineage(vectors.groupBy(group, "segment").applyInPandas(_added, _VECTORS))
    return vectors


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> Counts:
    """The links of the whole corpus, by pair of ids."""
    size_b = len(tokenizers(path_a, path_b).length_b)
    partial = cut_lineage(_partial_counts(docs.select(F.col(text).alias("text")), path_a, path_b))
    keys = np.array([row.pair for row in partial.select("pair").distinct().collect()], dtype=np.int64)
    hash_ = PerfectHash(np.sort(keys))
    counts = np.zeros(-(-len(keys) // SEGMENT) * SEGMENT, dtype=np.int64)
    for row in tree_sum(_dense(partial, hash_)).collect():
        counts[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(row.counts, dtype="<i8")
    return Counts(hash_, counts[: len(keys)], size_b)


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    key: str = "doc_id",
    with_groups: bool = False,
) -> DataFrame:
    """The key, the columns of the contract and, if asked for, ``groups`` itself."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = count_pairs(rows, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b), counts)
        for part, texts in _slices(batches):
            numbers, digests, groups = [], [], []
            for found in aligner.rows_of(texts):
                if found is None:
                    numbers.append([0] * len(aligner.STATS))
                    digests.append("")
                    groups.append("")
                    continue
                numbers.append(aligner.stats[found].sum(axis=0))
                made = ";".join(map(aligner.groups.__getitem__, found))
                digests.append(hashlib.sha256(made.encode()).hexdigest())
                groups.append(made if with_groups else "")
            n_a, n_b, n_groups, n_best, count_sum = np.array(numbers, dtype=np.int64).T
            # A group ends with one link: no token is empty.
            columns = [n_a, n_b, n_groups, n_groups, n_best, count_sum]
            arrays = [part.column("key"), *map(pa.array, columns), pa.array(digests)]
            names = ["key", *_NAMES]
            if with_groups:
                arrays, names = [*arrays, pa.array(groups)], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(arrays, names)
            if aligner.full:
                aligner.clear()

    schema = carried(rows, "key", new=_SCHEMA + (", groups string" if with_groups else ""))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
