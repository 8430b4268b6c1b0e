"""What several operators use: tables, the shared scratch folder, tokenisation into words, and hashes of words."""

from __future__ import annotations

from candlewick.memory import give_back
from candlewick.storage import Scratch, free_name, scratch_root
from candlewick.tables import table

__all__ = ["ALNUM_LOWER", "ASCII_LOWER", "Scratch", "alnum_words", "free_name", "grams", "hashes", "lean", "mixed", "scratch_root", "spaced_words", "table"]

#: Bytes that separate words of ASCII letters, digits and anything beyond ASCII; letters become lower case.
ALNUM_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Only A-Z change.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Rows that a task works on at once.
ROWS = 1_000

#: What a worker remembers from task to task, by kind.
memories: dict[str, dict] = {}


def _forget_but(kind: str | None) -> None:
    """Forgets what a worker remembers of other kinds than this."""
    others = [known for k, known in memories.items() if k != kind and known]
    for known in others:
        known.clear()
    if others:
        give_back()


def lean(run, uses: str | None = "words"):
    """run, over batches of at most ROWS rows; what a task has held goes back to the machine at its end, as workers outlive
    tasks, and of what earlier tasks remember only the kind that this one uses stays."""

    def small(batches):
        _forget_but(uses)
        yield from run(b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))
        give_back()

    return small


def alnum_words(text: str | None) -> list[bytes]:
    r"""Lower-cases A-Z and takes the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()


def spaced_words(text: str | None) -> list[bytes]:
    r"""Lower-cases A-Z and takes the words [^\x20\x09-\x0D]+, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


class HashOf(dict):
    """64-bit xxhash of words, remembered for the frequent ones; forgets all when full, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


#: One for all operators of a worker, as workers are used again by later stages.
_known = memories["words"] = HashOf()


def hashes(words: list):
    import numpy as np

    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mixed(x):
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h, n: int):
    """Hashes of all runs of n words, in order."""
    import numpy as np

    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
