"""Token ids of whole texts with the tokenizers library, word by word.

Both kinds of tokenizer file used here cut a text before some of its spaces whatever stands around them, so
the parts between such spaces can be encoded one at a time, and a part met before need not be encoded again.
Each Python worker keeps the ids of the parts it has met; beyond `CACHE_WORDS` those met only once go (most of
them never come again). The ids are those of encoding the whole text, which the tests compare.
"""

from __future__ import annotations

import functools
import re
import string
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa

CACHE_WORDS = 500_000
#: A space before white space or at the end does not part words of a byte-level text.
_JOINED = re.compile(r" (?=\s|\Z)")
#: Marks that a byte-level pattern keeps together and apart from the letters before them (an apostrophe it may not).
_MARKS = string.punctuation.replace("'", "")
#: One word with at most one space before it.
_PLAIN = re.compile(r" ?\S+")
#: Words encoded as the lines of one text.
LINES = 256
#: A word that the other kind of file always encodes alone, and as one id.
_ALONE = "\x01"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Numbers strings in the order they are first asked for, and holds the ids of each.

    Asking gives the numbers; those asked for the first time are in `new` until `add` brings their ids.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.met = np.zeros(1 << 16, np.int32)

    def __missing__(self, text: str) -> int:
        self[text] = number = len(self)
        self.new.append(text)
        return number

    def numbers(self, lists: list[list[str]], total: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, total)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self) - len(self.new), len(flat)
        while len(self) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[n : len(self)] = sizes
        self.starts[n : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.new = []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered strings one after the other, and where each one's begin (and the end)."""
        if len(self.met) < len(self.sizes):
            self.met = np.concatenate([self.met, np.zeros(len(self.sizes) - len(self.met), np.int32)])
        self.met[: len(self)] += np.bincount(at, minlength=len(self)).astype(np.int32)
        length = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(self.starts[at] - total[:-1], length) + np.arange(total[-1])], total


    def thin(self, most: int) -> "_Ids":
        """The strings met oftenest, at most `most`, and those only that were met twice; they have to earn it anew."""
        n = len(self)
        met = self.met[:n]
        least = 2 if np.count_nonzero(met >= 2) <= most else int(np.partition(met, n - most)[n - most]) + 1
        kept = np.flatnonzero(met >= least)
        out = _Ids()
        if len(kept):
            flat, ends = self.gather(kept)
            out.new = list(compress(self, met >= least))
            out.update(zip(out.new, range(len(kept)), strict=True))
            out.add(flat, np.diff(ends))
        return out


class PartEncoder:
    """Ids of texts; `leading_space` says that a word keeps the space before it (byte-level files).

    A part not met before is cut further where the file's pattern always cuts (before a last full stop or
    comma behind a letter, at single line feeds), so that fewer strings need the tokenizer.
    """

    def __init__(self, path: str, leading_space: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.leading_space = leading_space
        self.parts, self.stems = _Ids(), _Ids()
        #: What parts words that are encoded in one text, and its id (none: they are encoded one by one).
        self.between = "\n" if leading_space else f" {_ALONE} "
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _parts(self, text: str) -> list[str]:
        if not self.leading_space:
            return text.split(" ")
        if _JOINED.search(text) is None:
            first, *rest = text.split(" ")
            # The first part has no space before it; a line feed cannot start any other key.
            return ["\n" + first, *rest] if first else rest
        parts: list[str] = []
        for i, item in enumerate(text.split(" ")):
            if i == 0:
                parts.append("\n" + item)
            elif not item or item[0].isspace():
                parts[-1] += " " + item
            else:
                parts.append(item)
        return parts if parts[0] != "\n" else parts[1:]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """A byte-level word and the marks at its end."""
        word = text.rstrip(_MARKS)
        return [word, text[len(word) :]] if len(word) < len(text) and word[-1:].isalpha() else [text]

    def _stems(self, part: str) -> list[str]:
        if self.leading_space and "\n" not in part:
            return self._cut(" " + part)
        if self.leading_space:
            text = part[1:] if part[0] == "\n" else " " + part
            lines = text.split("\n")
            if any(not x or x[0].isspace() or x[-1].isspace() for x in lines[1:]) or lines[0][-1:].isspace():
                return [text]
        else:
            lines = [x.lower() if x.isascii() else x for x in part.split("\n")]
        out = []
        for i, x in enumerate(lines):
            if self.leading_space:
                out += ["\n", *self._cut(x)] if i else self._cut(x)
            elif x[-1:] in (".", ",") and x[-2:-1].isalpha():
                out += [x[:-1], x[-1]]
            else:
                out.append(x)
        return out

    def _encode_new(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stems one after the other, and how many each has."""
        found = self.tokenizer.encode_batch_fast(stems, add_special_tokens=False)
        lists = [e.ids for e in found]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum())), count

    def _encode_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None:
            return self._encode_new(stems)
        if self.leading_space:
            plain = np.fromiter((_PLAIN.fullmatch(s) is not None for s in stems), bool, len(stems))
        else:
            plain = np.fromiter((_ALONE not in s for s in stems), bool, len(stems))
        lined, sizes = self._encode_lines([s for s, p in zip(stems, plain, strict=True) if p])
        alone, others = self._encode_new([s for s, p in zip(stems, plain, strict=True) if not p])
        count = np.empty(len(stems), np.int64)
        count[plain], count[~plain] = sizes, others
        owner = np.repeat(plain, count)
        flat = np.empty(len(owner), np.uint32)
        flat[owner], flat[~owner] = lined, alone
        return flat, count

    def _encode_lines(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with many stems in one text: what stands between two of them is a token of its own."""
        between = self.between
        lines = [between.join(stems[i : i + LINES]) + between for i in range(0, len(stems), LINES)]
        flat, _ = self._encode_new(lines)
        ends = flat == self.mark
        at = np.flatnonzero(ends)
        return flat[~ends], np.diff(np.concatenate([[-1], at])) - 1

    def _learn(self) -> None:
        if not self.leading_space and self.mark is not None:
            self.parts.add(*self._encode_stems(self.parts.new))
            return
        stems = [self._stems(p) for p in self.parts.new]
        sizes = np.fromiter(map(len, stems), np.int64, len(stems))
        at = self.stems.numbers(stems, int(sizes.sum()))
        if self.stems.new:
            self.stems.add(*self._encode_stems(self.stems.new))
        flat, total = self.stems.gather(at)
        ends = total[np.cumsum(sizes)]
        self.parts.add(flat, np.diff(np.concatenate([[0], ends])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        if len(self.parts) > CACHE_WORDS:
            self.parts, self.stems = self.parts.thin(CACHE_WORDS // 2), self.stems.thin(CACHE_WORDS // 2)
        parts = [self._parts(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self.parts.numbers(parts, int(sizes.sum()))
        if self.parts.new:
            self._learn()
        ids, total = self.parts.gather(at)
        return np.split(ids, total[np.cumsum(sizes)][:-1]) if len(texts) else []


@functools.lru_cache(maxsize=2)
def encoder(path: str, leading_space: bool) -> PartEncoder:
    """One encoder per worker and file."""
    return PartEncoder(path, leading_space)


def forget() -> None:
    """Drop this worker's encoders. A worker outlives the stage that filled them, and other work needs their memory."""
    encoder.cache_clear()


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def text_runs(texts: pa.Array, limit: int = 1 << 20):
    """Row ranges of about `limit` bytes of text."""
    from .kernels import pieces

    return pieces(texts, limit)
