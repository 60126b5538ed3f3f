"""Words and five-word shingles of whole texts, as 64-bit hashes."""

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
SHINGLE = 5
MEMO_WORDS = 150_000

# odd multipliers, one per word of a shingle
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Hashes of words are kept for the words met last."""

    def __init__(self):
        self.memo = {}

    def words(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text.lower()) if isinstance(text, str) else []
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(found):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        """The distinct shingles, ascending. A text of fewer words than a shingle has
        one, of all its words; a text without words has none."""
        n = len(words)
        if not n:
            return words
        size = min(n, SHINGLE)
        h = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            h += words[i:n - size + 1 + i] * _MIX[i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return np.unique(h)

    @staticmethod
    def digest(words: np.ndarray) -> int:
        """One signed number for the sequence of words."""
        return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)
