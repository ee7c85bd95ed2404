"""Exact tokenization that encodes each distinct chunk of a batch once.

A text is cut into chunks; `tokenizers` encodes the distinct chunks and the ids are put together by
array lookup. A cut lies before a space, on either side of a line feed, and between a letter or digit
and a following run of `.,;:!?`. The pre-tokenizers of both vocabularies never join what lies on the
two sides of such a cut as long as no white space touches other white space, so the ids equal those of
the whole text. Texts with adjacent white space, a NUL or `<|` (special tokens) are encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spread, strings

#: Code points encoded at once: each call looks its chunks up among all remembered ones, which costs by the call.
PIECE_CHARS = 6_000_000
#: Chunks whose ids a Python worker remembers between batches.
REMEMBERED = 1_000_000
_IRREGULAR = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00|<\|"
_encoders: dict[str, "ChunkEncoder"] = {}


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids are held in 16 bits")
        self.byte_level = self.tokenizer.normalizer is None
        self.known = pa.array([""], pa.large_string())
        self.lengths, self.pool = np.zeros(1, np.int64), np.empty(0, np.uint16)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, chunks: pa.Array, lengths: np.ndarray, pool: np.ndarray) -> None:
        room = REMEMBERED - len(self.known)
        if room > 0:
            self.known = pa.concat_arrays([self.known, chunks[:room]])
            self.lengths = np.concatenate([self.lengths, lengths[:room]])
            self.pool = np.concatenate([self.pool, pool[: lengths[:room].sum()]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another (uint16) and row offsets. Null texts are empty."""
        texts = strings(column)
        if not len(texts):
            return np.empty(0, np.uint16), np.zeros(1, np.int64)
        irregular = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(irregular)
        whole = self.whole(texts.take(pa.array(rows)).to_pylist()) if len(rows) else []
        if len(rows):
            texts = pc.if_else(pa.array(irregular), pa.scalar("", pa.large_string()), texts)
        if not self.byte_level:  # lower case is the vocabulary's own first step
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, r"([\p{L}\p{N}])([.,;:!?])", "\\1\x00\\2")
        texts = pc.replace_substring(texts, "\n", "\x00\n\x00")
        texts = pc.replace_substring(texts, " ", "\x00 ")
        split = pc.split_pattern(texts, "\x00")
        offsets = split.offsets.to_numpy().astype(np.int64)
        keys = pc.index_in(split.values, value_set=self.known)
        new = keys.is_null().to_numpy(zero_copy_only=False)
        keys = np.array(keys.fill_null(0).to_numpy(zero_copy_only=False))
        coded = split.values.filter(pa.array(new)).dictionary_encode()
        fresh = coded.dictionary
        found = [ids for lo in range(0, len(fresh), 20_000) for ids in self.whole(fresh[lo : lo + 20_000].to_pylist())]
        if new.any():
            keys[new] = coded.indices.to_numpy(zero_copy_only=False) + len(self.known)
        if len(rows):
            keys[offsets[:-1][rows]] = len(self.known) + len(found) + np.arange(len(rows), dtype=keys.dtype)
            found += whole
        added = np.fromiter(map(len, found), np.int64, len(found))
        more = np.frombuffer(b"".join([array("H", x).tobytes() for x in found]), np.uint16)
        lengths, pool = np.concatenate([self.lengths, added]), np.concatenate([self.pool, more])
        self._remember(fresh, added[: len(fresh)], more)
        each = lengths[keys]
        ids = pool[spread((np.cumsum(lengths) - lengths)[keys], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[offsets]
