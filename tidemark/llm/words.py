"""Words of many texts at once: split and numbered in Arrow, their n-grams hashed in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers never vanish modulo 2 ** 64
LETTERS, LETTERS_DIGITS = r"[^\pL]+", r"[^\pL\pN]+"


def split_words(texts: pa.Array, others: str) -> pa.ListArray:
    """The lower-case words of each text, parted by runs of ``others``. A null text has no words, one without words an empty one."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), pattern=others, replacement=" ")
    return pc.split_pattern(pc.utf8_trim(spaced, characters=" "), pattern=" ")


def numbered(texts: pa.Array, others: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ids, ends, words): the words of all texts one after the other as numbers, where each text begins and
    ends, and the distinct words by number. Word 0 is the empty one, which stands for no word."""
    split = split_words(texts, others)
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:
        at = words.index("")
        words[0], words[at] = words[at], words[0]
        if at:
            first = ids == 0
            ids[ids == at] = 0
            ids[first] = at
    else:
        words.insert(0, "")
        ids += 1
    return ids, split.offsets.to_numpy(), words


class Shapes:
    """Hashes of words and of their n-grams, each word being marked by < and >."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        text = "<" + "><".join(words) + ">" if words else ""
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.points)) - self.starts[self.owner] if len(words) else np.zeros(0, np.int64)

    @staticmethod
    def mixed(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(self.sizes.max()) - 1, BASE))), dtype=np.uint64)
        return self.mixed(np.add.reduceat(self.points * powers[self.place], self.starts), 0)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every n-gram, words in order."""
        m = len(self.points) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.place[:m] + n <= self.sizes[self.owner[:m]])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * BASE + self.points[at + k]
        return self.owner[at], self.mixed(h, n)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def summed(rows: np.ndarray, ids: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """The sum of the rows of each text's words, in double precision; a block of words is held at a time."""
    out = np.zeros((len(ends) - 1, rows.shape[1]))
    if not len(ids):
        return out
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for a in range(0, len(ids), block):
        part = owner[a : a + block]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
        out[part[cuts]] += np.add.reduceat(rows[ids[a : a + block]], cuts, axis=0, dtype=np.float64)
    return out
