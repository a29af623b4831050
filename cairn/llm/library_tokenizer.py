"""The tokenizers library over many short chunks at once."""

from __future__ import annotations

import os

import numpy as np


class LibraryTokenizer:
    """Arrays of ids, as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)  # in a byte-level vocabulary a character stands for a byte

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and the count of each. Chunks that start with a space before other than white space are
        encoded joined, some thousands at a time: the library splits the text there in any case, and the ids' lengths
        in bytes tell which chunk they belong to."""
        parts, counts, group = [], [], []
        for c in [*chunks, None]:
            joins = c is not None and len(c) > 1 and c[0] == " " and not c[1].isspace() and len(c) <= 1000
            if joins:
                group.append(c)
            if group and (not joins or len(group) >= 4000):
                parts.append(ids := self.one("".join(group)))
                if any(s in "".join(group) for s in self.specials):
                    parts[-1:] = each = [self.one(g) for g in group]
                    counts += map(len, each)
                else:
                    ends = np.cumsum(np.fromiter((len(g.encode()) for g in group), np.int64, len(group)))
                    at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
                    counts += np.diff(at, prepend=0).tolist()
                group = []
            if c is not None and not joins:
                parts.append(self.one(c))
                counts.append(len(parts[-1]))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(counts, np.int64)
