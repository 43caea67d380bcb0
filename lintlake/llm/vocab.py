"""Public tokenizer files inside tasks: loaded once per worker, with bounded caches of whole words."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from lintlake.llm import workers
from lintlake.llm.hashing import span_hashes

#: Bytes of what a worker keeps of pre-tokens it has encoded.
CACHED_BYTES = 64 << 20
#: Texts without these characters lower-case and compose alike in every library; the others, and those
#: with special strings, are encoded whole.
NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~¡-įı-ʯ]|<\\|")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Code points below which texts are cut by class, and the classes: letter, number, white space, other.
PLAIN_POINTS = 0x2B0
LETTER, NUMBER, BLANK, OTHER = range(4)
_APOSTROPHE = ord("'")
_U = np.uint64


def _class_of(point: int) -> int:
    kind = unicodedata.category(chr(point))
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else BLANK if chr(point).isspace() else OTHER


CLASSES = np.array([_class_of(p) for p in range(PLAIN_POINTS)], np.int8)
POINT_VALUES = np.random.default_rng(2).integers(1, 1 << 63, PLAIN_POINTS, dtype=np.int64).astype(_U)


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain text: runs of letters, single numbers, runs of others.

    An apostrophe by itself takes the ending after it along (s, t, m, d, re, ve, ll), as the pattern of
    the tokenizer has it; what is left of the letters is a pre-token of its own.
    """
    kinds = CLASSES[points]
    new = np.ones(len(points), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(points))
    wanted = kinds[starts] != BLANK
    starts, ends = starts[wanted], ends[wanted]
    alone = (points[starts] == _APOSTROPHE) & (ends - starts == 1)
    alone[:-1] &= (ends[:-1] == starts[1:]) & (kinds[starts[1:]] == LETTER)
    at = np.flatnonzero(alone[:-1])
    if len(at):
        first = points[starts[at + 1]]
        second = np.where(ends[at + 1] - starts[at + 1] > 1, points[np.minimum(starts[at + 1] + 1, len(points) - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((second == ord("e")) & np.isin(first, [ord("r"), ord("v")])) | ((first == ord("l")) & (second == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        ends[at] += taken
        starts[at + 1] += taken
        left = starts < ends
        starts, ends = starts[left], ends[left]
    return starts, ends


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, put together from those of its pre-tokens.

    Holds for tokenizers that lower-case, drop white space and merge within pre-tokens only: encoding
    each distinct pre-token once and joining the ids gives what encoding the whole text gives. Pre-tokens
    are cut and hashed for a slice of texts at once; what is known of them is three arrays, sorted by
    hash, and is dropped when it grows beyond its bytes.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._drop()

    def _drop(self) -> None:
        self.known = np.empty(0, _U)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")

    def _encode(self, strings: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(strings), 4096):
            out += [c.ids for c in self.tokenizer.encode_batch_fast(strings[at : at + 4096], add_special_tokens=False)]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        coded = self._encode(pieces)
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        at = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(coded), "<u4", int(sizes.sum()))))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate((self.at, at))[order]
        self.size = np.concatenate((self.size, sizes))[order]

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is among the known ones, and whether it is there."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return place, self.known[place] == hashes

    def _plain(self, strings: list[str]) -> list[bytes]:
        joined = "\n".join(strings).lower() + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = word_spans(points)
        hashes = span_hashes(POINT_VALUES[points], starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known.nbytes * 3 + self.pool.nbytes > CACHED_BYTES:
            self._drop()
        place, found = self._place(distinct)
        if not found.all():
            new = first[~found]
            self._learn(distinct[~found], [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            place, _ = self._place(distinct)
        place = place[inverse]
        sizes = self.size[place].astype(np.int64)
        done = np.cumsum(sizes)
        within = np.arange(int(done[-1]) if len(done) else 0) - np.repeat(done - sizes, sizes)
        ids = self.pool[np.repeat(self.at[place], sizes) + within]
        lasts = np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings)))
        bounds = np.concatenate(([0], done))[np.searchsorted(starts, lasts)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        strings = [t.decode() for t in texts]
        odd = [NOT_PLAIN.search(s) is not None for s in strings]
        plain = iter(self._plain([s for s, o in zip(strings, odd, strict=True) if not o]) if not all(odd) else ())
        whole = iter(self._encode([s for s, o in zip(strings, odd, strict=True) if o]))
        return [np.array(next(whole), "<u4").tobytes() if o else next(plain) for o in odd]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


workers.on_change(load.cache_clear)
workers.on_change(word_ids.cache_clear)


def text_slices(column, most_bytes: int = 4 << 20):
    """Texts of an Arrow string column as UTF-8 bytes, a slice of rows at a time: (first row, texts)."""
    import pyarrow as pa

    binary = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(binary):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield first, binary.slice(first, last - first).to_pylist()
        first = last
    pa.default_memory_pool().release_unused()
