"""Token ids of whole texts by the tokenizers library, each distinct segment encoded once.

Texts are cut where neither vocabulary can join: before white space that follows a
letter or sign (byte-level vocabulary: a pre-token never goes on from a non-space into
a space), or around white space (word vocabulary: it drops white space).  A segment's
ids don't depend on its neighbours, so the ids of a text are those of its segments one
after another.  The string of a special token in a text gives that token, as the library
does by default; it holds no white space, so it lies in one segment.  The segments of a block are made distinct by 64-bit hash and length,
looked up in a table that the worker keeps, and only unknown ones are encoded.

Where a vocabulary's normaliser and pre-tokenizer are ``WORD_RULES``, more is known.
Between a letter, a digit and a sign of ASCII or U+00C0 to U+00FF a pre-token ends
(except after an apostrophe, and special tokens aren't cut), and composing never reaches
back over these.  Upper-case A-Z counts as lower-case, except before a character that it
may compose with, and in blocks with a special token in any case.  Segments of lower-case letters
alone are then what the normaliser and pre-tokenizer would hand to the model, and go to
it directly.

The table is bounded by ``KEEP`` segments; when it is full, those that no later block
asked for go first, so the frequent ones are not encoded again however long the input.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa

from tidemark.llm import _bytes as B

KEEP = 1_200_000
#: (normaliser, pre-tokenizer) whose cuts and letters are known.
WORD_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_OTHER, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.array([_LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN if 0x20 < c < 0x7F else _OTHER for c in range(128)] + [_OTHER] * 128, np.uint8)
_BYTE_LEVEL = np.arange(256, dtype="<u4")  # the character that stands for each byte
_BYTE_LEVEL[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = 256 + np.arange(0x21 + 0x22 + 1)
_workers: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str, joins_spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens with white space would not lie in one segment")
        self.joins_spaces = joins_spaces
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = not joins_spaces and (rules["normalizer"], rules["pre_tokenizer"]) == WORD_RULES and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]
        self.special = [t.encode().lower() for t in special]
        self.uncut = {pair for t in special for pair in itertools.pairwise(t.encode())}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.asked = np.zeros(0, self.kind), np.zeros(0, bool)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.joins_spaces:
            start, end, owner = B.words(data, offsets)
            if self.by_words and len(start):
                inner = self.inner(data)
                at = np.searchsorted(start, inner, "right") - 1
                inside = (at >= 0) & (inner > start[at]) & (inner < end[at])  # not between two texts
                start, end = np.sort(np.concatenate([start, inner[inside]])), np.sort(np.concatenate([end, inner[inside]]))
                owner = np.searchsorted(offsets, start, "right") - 1
            return start, end, owner
        n = len(data)
        begin = B.heads(offsets, n)
        plain = (data > 0x20) & (data < 0x7F)
        latin = np.zeros(n, bool)  # the second byte of U+00C0 to U+00FF, all letters or signs
        latin[1:] = data[:-1] == 0xC3
        before = np.zeros(n, bool)
        before[1:] = (plain | latin)[:-1]
        begin |= ((data == 32) | (data == 10)) & before
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n) if n else start
        return start, end, np.searchsorted(offsets, start, "right") - 1

    def inner(self, data: np.ndarray) -> np.ndarray:
        """Places inside words at which a pre-token ends for certain."""
        begins, ends = _CLASS[data], _CLASS[data]  # of the character that begins, or ends, at a byte
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # letters of U+00C0 to U+00FF
        begins[two] = ends[two + 1] = _LETTER
        left, right = ends[:-1], begins[1:]
        at = np.flatnonzero((left != _OTHER) & (right != _OTHER) & ((left != right) | (left == _DIGIT)) & ((data[:-1] != ord("'")) | (right != _LETTER))) + 1
        for a, b in self.uncut:
            at = at[(data[at - 1] != a) | (data[at] != b)]
        return at

    def folded(self, data: np.ndarray) -> np.ndarray:
        """data with A-Z in lower case where this changes no ids."""
        if not self.by_words or not len(data):
            return data
        low = B._LOWER[data]
        raw = low.tobytes()
        if any(t in raw for t in self.special):
            return data
        after = np.append(data[1:], np.uint8(32))
        return np.where((after < 0x80) | (after == 0xC3), low, data)

    def encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """The ids of each segment."""
        raw = data.tobytes()

        def whole(start: np.ndarray, end: np.ndarray) -> list[list[int]]:
            return [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)], add_special_tokens=False)]

        if not self.by_words:
            return whole(start, end)
        fine = (data >= 97) & (data <= 122)
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7))  # lower-case letters of U+00DF to U+00FF
        fine[two] = fine[two + 1] = True
        strange = np.concatenate([[0], np.cumsum(~fine)])
        plain = strange[end] == strange[start]
        chars, tokenize = _BYTE_LEVEL[data].tobytes().decode("utf-32-le"), self.tokenizer.model.tokenize
        found = iter([[t.id for t in tokenize(chars[a:b])] for a, b in zip(start[plain].tolist(), end[plain].tolist(), strict=True)])
        others = iter(whole(start[~plain], end[~plain]))
        return [next(found) if k else next(others) for k in plain.tolist()]

    def room(self, many: int) -> None:
        """Makes room for so many new segments."""
        if len(self.keys) + many <= KEEP:
            return
        stay = np.flatnonzero(self.asked)
        if len(stay) + many > KEEP // 2 + many // 2:  # else room would have to be made too often
            return self.clear()
        self.keys, first, self.count = self.keys[stay], self.first[stay], self.count[stay]
        self.pool = self.pool[B.ragged(first, self.count.astype(np.int64))]
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count
        self.asked = np.zeros(len(stay), bool)

    def known(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the pool that is returned, numbers of ids) for distinct keys; unknown segments are encoded first."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.asked[at[old]] = True
        first, count, pool = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), self.pool
        first[old], count[old] = self.first[at[old]], self.count[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            ids = self.encoded(data, start[new], end[new])
            count[new] = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(count[new].sum()))
            own = np.cumsum(count[new], dtype=np.int64) - count[new]
            first[new] = len(pool) + own
            pool = np.concatenate([pool, flat])
            self.room(len(new))
            to = np.searchsorted(self.keys, keys[new])
            self.keys, self.first, self.count, self.asked = np.insert(self.keys, to, keys[new]), np.insert(self.first, to, len(self.pool) + own), np.insert(self.count, to, count[new]), np.insert(self.asked, to, False)
            self.pool = pool if len(self.pool) + len(flat) == len(pool) else np.concatenate([self.pool, flat])
        return pool, first, count

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text, then end_id.  Equal texts are encoded once."""
        each = texts.dictionary_encode("encode")
        if len(each.dictionary) == len(texts):
            return self.encode_each(texts, end_id)
        ids, at = self.encode_each(each.dictionary, end_id)
        row = each.indices.to_numpy(zero_copy_only=False)
        per = np.diff(at)[row]
        return ids[B.ragged(at[row], per)], np.concatenate([[0], np.cumsum(per)])

    def encode_each(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for _, data, offsets in B.blocks(texts):
            n = len(offsets) - 1
            start, end, owner = self.cuts(data, offsets)
            data = self.folded(data)
            sums = B.prefix(data)
            keys, where, back = np.unique(B.spans(sums, start, end), return_index=True, return_inverse=True)
            del sums
            pool, first, count = self.known(keys, data, start[where], end[where])
            first, count = first[back], count[back].astype(np.int64)
            per = np.bincount(owner, count, n).astype(np.int64) + 1
            begins = np.cumsum(per) - per
            out = np.full(int(per.sum()), end_id, np.int32)
            # a segment's ids go to its text's place, after those of earlier segments
            done = np.cumsum(count) - count
            out[B.ragged(done + owner, count)] = pool[B.ragged(first, count)]
            assert not n or begins[-1] + per[-1] == len(out)
            parts.append(out)
            counts.append(per)
        per = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(per)])


def encoder(path: str, joins_spaces: bool) -> Encoder:
    """This worker's encoder for a vocabulary; it lives as long as the worker."""
    key = f"{path}|{joins_spaces}"
    if key not in _workers:
        _workers[key] = Encoder(path, joins_spaces)
        B.kept.append(_workers)
    return _workers[key]
