"""Token ids of whole texts with a public byte-level BPE file, each distinct stretch encoded once.

The vocabulary's splitting pattern never joins a non-space with a following space, nor an ASCII letter
with a following ASCII non-letter. Texts are cut at such places, equal stretches are encoded once, and
the ids are put together again: the ids of the whole text, at a fraction of the cost.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from tapegrain.llm import textops as X

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_WIDE_SPACE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_JOIN = 2000
#: Distinct stretches a worker remembers before it starts anew (some 50 bytes each).
_KEEP = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the texts of a buffer; made once in each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        n = self.model.get_vocab_size()
        self.opens = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n+1 offsets)."""
        if len(self.hashes) > _KEEP:
            self._forget()
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        space, letter = X.IS_SPACE[data], _LETTER[data]
        cut = np.zeros(len(data), bool)
        narrow = data[:-1] < 128
        narrow[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 128)
        cut[1:] = (space[1:] & ~space[:-1] & narrow) | (letter[:-1] & ~letter[1:] & (data[1:] < 128))
        cut[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        code, distinct = pd.factorize(X.span_hashes(data, starts, ends))
        back = np.empty(len(distinct), np.int64)
        back[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        place, old = self._known(distinct)
        fresh = np.flatnonzero(~old)
        if len(fresh):
            self._learn(data, space, starts[back[fresh]], ends[back[fresh]], distinct[fresh])
            place, _ = self._known(distinct)
        begin, count = self.begin[place], self.count[place]
        ids = self.pool[X.ranges(begin[code], count[code])]
        ends_at = np.concatenate(([0], np.cumsum(count[code])))
        return ids, ends_at[np.searchsorted(starts, off)]

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return place, self.hashes[place] == h

    def _forget(self) -> None:
        self.hashes, self.begin, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, space: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        """Encode the stretches and keep their ids for later texts of this worker."""
        spaces = np.concatenate(([0], np.cumsum(space)))
        plain = (data[s] == 32) & (e - s > 1) & (spaces[e] - spaces[s] == 1) & ~_WIDE_SPACE_LEAD[data[np.minimum(s + 1, len(data) - 1)]]
        raw = data.tobytes()
        # stretches that begin with their only space: many in one string, told apart by the opening token
        easy = np.flatnonzero(plain)
        joined = [b"".join([raw[i:j] for i, j in zip(s[p], e[p])]).decode(errors="replace") for p in (easy[k:k + _JOIN] for k in range(0, len(easy), _JOIN))]
        flat = np.concatenate(self._ids(joined)) if joined else np.zeros(0, np.uint32)
        opens = np.flatnonzero(self.opens[flat])
        if len(opens) != len(easy):
            raise ValueError("the vocabulary does not keep a leading space with its word")
        count, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        count[easy], begin[easy] = np.diff(np.append(opens, len(flat))), opens
        hard = np.flatnonzero(~plain)
        others = self._ids([raw[i:j].decode(errors="replace") for i, j in zip(s[hard], e[hard])])
        count[hard] = [len(x) for x in others]
        begin[hard] = len(flat) + np.cumsum(count[hard]) - count[hard]
        pool = np.concatenate([flat, *others])
        hashes = np.concatenate((self.hashes, h))
        order = np.argsort(hashes, kind="stable")
        self.begin = np.concatenate((self.begin, begin + len(self.pool)))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.hashes, self.pool = hashes[order], np.concatenate((self.pool, pool))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_closed(path: str, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As the encoder, with ``end_id`` after each text."""
    ids, first = encoder(path)(data, off)
    out = np.full(len(ids) + len(first) - 1, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
    return out, first + np.arange(len(first))
