"""Token ids of whole texts through the ``tokenizers`` library, one piece cache per Python worker.

The tokenizer file splits a text into pre-tokens before it merges bytes, and a
pre-token never runs across a space that follows a non-space character. Texts
are therefore cut there, each distinct piece is encoded once by the library and
the ids of a text are the ids of its pieces. ``tests/llm`` compares the result
with encoding whole texts directly. For a tokenizer without this property set
``split=False``.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from churnlab.llm.common import WORKER_CACHES, ragged

#: Distinct pieces that a worker keeps (some 250 bytes each), and ids of all of them together (a piece may be a long text);
#: beyond either, the pieces that came only once go. Ids never depend on the cache.
MAX_PIECES, MAX_IDS = 400_000, 4_000_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 2 << 20
_CUT = re.compile(r"(?<=\S)(?= )")
_JOINED = 512


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies on this machine (every executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Piece -> row number; a piece seen for the first time gets the next number.

    The words of a text are keyed without the space that opens them, the beginning of a text as a 1-tuple.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Encoder:
    """``encode(texts)`` gives all ids and the number of ids of each text."""

    def __init__(self, path: str, split: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self.vocab_size = self.tokenizer.get_vocab_size()
        opens = [t.startswith("Ġ") for t in (self.tokenizer.id_to_token(i) or "" for i in range(self.vocab_size))]
        self.opens = np.array(opens)
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.ids = _Pieces(), np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came again since the last time, the most used ones if these are too many."""
        keep = np.flatnonzero(self.uses > 1)
        keep = keep[np.argsort(-self.uses[keep], kind="stable")[: MAX_PIECES // 2]]
        keep = np.sort(keep[np.cumsum(self.length[keep]) <= MAX_IDS // 2])
        pieces, start, length, ids = list(self.pieces), self.start[keep], self.length[keep], self.ids
        self._reset()
        self.pieces.update(zip([pieces[i] for i in keep.tolist()], range(len(keep))))
        self.ids, self.start, self.length = ids[ragged(start, length)], np.cumsum(length) - length, length
        self.uses = np.ones(len(keep), np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.split:
            rows = self._plain(texts)
            return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)
        if len(self.pieces) > MAX_PIECES or len(self.ids) > MAX_IDS:
            self._forget()
        number, counts, rows = self.pieces.__getitem__, [], []
        for text in texts:
            if "<|" in text:  # a special token's string must reach the library whole
                head, tail = text, []
            elif "  " in text:
                head, *tail = _CUT.split(text)
                tail = [w[1:] for w in tail]
            else:
                head, *tail = text.split(" ")
            rows.append(number((head,)))
            rows += map(number, tail)
            counts.append(len(tail) + 1)
        self._learn()
        at = np.array(rows, np.int64)
        self.uses = np.bincount(at, minlength=len(self.pieces)) + np.pad(self.uses, (0, len(self.pieces) - len(self.uses)))
        lengths = self.length[at]
        ids = self.ids[ragged(self.start[at], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *counts])]
        return ids, np.diff(ends)

    def _learn(self) -> None:
        """Encode the pieces that are new.

        Pieces with a single space, at their beginning and before a solid character, are joined into longer texts
        first: the pre-tokens at their ends stay as they are, and each begins with the only ids that open with a space,
        so the ids fall apart again.
        """
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        length, start = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        joined = [i for i, p in enumerate(new) if type(p) is str and p and " " not in p and not p[0].isspace()]
        batches = [joined[a: a + _JOINED] for a in range(0, len(joined), _JOINED)]
        rest = sorted(set(range(len(new))).difference(joined))
        found, size = [self.ids], len(self.ids)
        for batch, row in zip(batches, self._plain([" " + " ".join([new[i] for i in b]) for b in batches])):
            row = np.array(row, np.int32)
            cut = np.flatnonzero(self.opens[row])
            if len(cut) != len(batch):  # a piece fell apart differently: encode these one by one
                rest += batch
                continue
            length[batch] = np.diff(cut, append=len(row))
            start[batch] = size + cut
            size += len(row)
            found.append(row)
        for i, row in zip(rest, self._plain([" " + new[i] if type(new[i]) is str else new[i][0] for i in rest])):
            length[i], start[i] = len(row), size
            size += len(row)
            found.append(np.array(row, np.int32))
        self.ids = np.concatenate(found)
        self.start = np.concatenate((self.start, start))
        self.length = np.concatenate((self.length, length))


@lru_cache(maxsize=4)
def encoder(path: str, split: bool = True) -> Encoder:
    """The worker's encoder for a tokenizer file (kept between tasks that name the cache ``tokens``)."""
    return Encoder(path, split)


WORKER_CACHES["tokens"] = encoder.cache_clear
