"""Chunks of texts that a byte-level BPE tokenizer treats on their own, so that each distinct chunk is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# White space of any kind. A boundary before a space holds unless white space stands on both sides of the space.
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"{_WS} {_WS}|{_WS} $"


class ChunkEncoder:
    """Encodes batches of texts by the chunks between their spaces.

    encode(list of chunks) gives the ids of all, one after another, and the count of each. Values are kept by a 128-bit hash of the chunk until `most`
    chunks or eight times as many ids are held, then the memo starts anew: memory is bounded whatever the corpus holds.
    Texts in which a space has white space on both sides, or that hold a special string, are encoded whole.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], specials: tuple[str, ...] = (), most: int = 1_500_000, longest: int = 64):
        self.encode, self.specials, self.most, self.longest = encode, specials, most, longest
        self._clear()

    def _clear(self) -> None:
        self.high = self.low = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the memo, and whether they hold."""
        at = np.searchsorted(self.high, high)
        at[at == len(self.high)] = 0
        return at, (self.high[at] == high) & (self.low[at] == low) if len(self.high) else np.zeros(len(high), bool)

    def _lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pool of ids, and for each chunk its start and count in that pool."""
        if len(self.high) > self.most or len(self.pool) > 8 * self.most:
            self._clear()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), np.uint64).reshape(-1, 2)
        high, low = hashes[:, 0].copy(), hashes[:, 1].copy()
        at, known = self._find(high, low)
        start, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        missing = np.flatnonzero(~known)
        missing = missing[np.argsort([chunks[i][:1] != " " for i in missing.tolist()], kind="stable")] if len(missing) else missing
        pool = self.pool
        if len(missing):
            new, sizes = self.encode([chunks[i] for i in missing.tolist()])
            begins = len(pool) + np.cumsum(sizes) - sizes
            start[missing], count[missing] = begins, sizes
            pool = np.concatenate([pool, new])
            keep = np.fromiter((len(chunks[i]) <= self.longest for i in missing.tolist()), bool, len(missing))
            held = missing[keep]
            self.high = np.concatenate([self.high, high[held]])
            order = np.argsort(self.high, kind="stable")
            self.high = self.high[order]
            self.low = np.concatenate([self.low, low[held]])[order]
            self.start = np.concatenate([self.start, start[held]])[order]
            self.count = np.concatenate([self.count, count[held]])[order]
            self.pool = pool
        return pool, start, count

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        whole_mask = whole.to_numpy(zero_copy_only=False)
        safe = texts.filter(pc.invert(whole))
        split = pc.split_pattern(safe, " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64) * 2 + 1
        code[offsets[:-1]] -= 1  # the first chunk of a text has no space before it
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(words)))
        pool, start, count = self._lookup([" " + words[c >> 1] if c & 1 else words[c >> 1] for c in used.tolist()])
        at = np.zeros(2 * len(words), np.int64)
        at[used] = np.arange(len(used))
        at = at[code]
        counts = count[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(start[at] - ends + counts, counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[offsets]
        found = iter(np.split(ids, bounds[1:-1])) if len(bounds) > 1 else iter(())
        rest = iter([self.encode([t])[0] for t in texts.filter(whole).to_pylist()])
        return [next(rest) if w else next(found) for w in whole_mask]
