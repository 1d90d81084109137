"""Token ids of whole texts with a public tokenizer, through a table of words.

The tokenizer normalises, splits at white space and treats words alone, so each distinct word is encoded once and a
text is the concatenation of its words' ids. Words are found by a 64-bit hash of their lower-case bytes, a chunk of
texts at a time; those that are letters and then perhaps punctuation are merged many at a time by the file's own merge
list, all others go through the tokenizers library. A text goes through the library as a whole if it has one of the
special tokens, a control character that Python but not the tokenizer takes for white space, a capital sigma (whose
lower case depends on what follows), or if it or its lower case is not in normal form.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from gantry.llm.common import BYTE_VALUES, byte_chunks, prefix_hash, release, resident, span_hash, word_spans

#: Punctuation that may end a word; the tokenizer makes one piece of such a run. Fixed values.
TAIL = b".,!?;:#$%&*|\"-/"
_WHOLE = re.compile("<\\||[\x1c-\x1fΣ]")
_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_IS_TAIL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(TAIL, dtype=np.uint8))
#: Words that are kept; all go when there are more. Bytes of text that are looked up together.
_MOST_WORDS, _GROUP = 200_000, 1 << 19
#: Size of the tables of merges.
_SLOT_BITS = 18
_NONE = np.int32(1 << 30)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class PairMerges:
    """Byte pair encoding of many pieces at once: each round merges every piece's first pair of lowest rank."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.keys, self.ranks = [], []
        left = np.arange(len(keys))
        while len(left):  # a few tables without collisions
            slots, rank = np.full(1 << _SLOT_BITS, -1, dtype=np.int64), np.full(1 << _SLOT_BITS, _NONE, dtype=np.int32)
            at = self._slot(keys[left], len(self.keys))
            slots[at], rank[at] = keys[left], left
            self.keys.append(slots)
            self.ranks.append(rank)
            left = left[slots[at] != keys[left]]

    @staticmethod
    def _slot(key: np.ndarray, table: int) -> np.ndarray:
        return ((key * (0x9E3779B1 + 2 * 0x3C6EF372 * table)) >> 12) & ((1 << _SLOT_BITS) - 1)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), _NONE, dtype=np.int32)
        for k, (slots, rank) in enumerate(zip(self.keys, self.ranks, strict=True)):
            at = self._slot(key, k)
            out = np.where(slots[at] == key, rank[at], out)
        return out

    def encode(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, whose bytes stand one after another, and the number of each piece's ids."""
        if not len(length):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        end = np.cumsum(length)
        ids = self.inner[flat]
        ids[end - 1] = self.final[flat[end - 1]]
        piece = np.repeat(np.arange(len(length)), length)
        rank = self._ranks_of(ids, piece)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            lowest = np.minimum.reduceat(rank, start)
            counts = np.diff(np.append(start, len(ids)))
            low = np.repeat(lowest, counts)
            alive = low < _NONE
            if not alive.all():
                done.append((piece[~alive], ids[~alive]))
                ids, piece, rank, low = ids[alive], piece[alive], rank[alive], low[alive]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == low)
            first = hit[np.concatenate([[True], piece[hit[1:]] != piece[hit[:-1]]])]
            ids[first] = self.merged[rank[first]]
            stay = np.ones(len(ids), dtype=bool)
            stay[first + 1] = False
            shift = first - np.arange(len(first))  # where the merged ids stand afterwards
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
            touched = np.zeros(len(ids), dtype=bool)
            touched[shift] = True
            touched[shift[shift > 0] - 1] = True
            near = np.flatnonzero(touched)
            nxt = np.minimum(near + 1, len(ids) - 1)
            fresh = self._rank(ids[near] << 16 | ids[nxt])
            rank[near] = np.where((piece[near] == piece[nxt]) & (nxt > near), fresh, _NONE)
        who, what = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64),) * 2
        order = np.argsort(who, kind="stable")
        return what[order], np.bincount(who, minlength=len(length))

    def _ranks_of(self, ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), _NONE, dtype=np.int32)
        if len(ids) > 1:
            out[:-1] = np.where(piece[1:] == piece[:-1], self._rank(ids[:-1] << 16 | ids[1:]), _NONE)
        return out


def _letters(buffer: np.ndarray) -> np.ndarray:
    """Bytes of lower-case ASCII letters and of the Latin, Greek and Cyrillic letters of two bytes that surely are letters."""
    b, after = buffer, np.append(buffer[1:], np.uint8(0))
    lead = ((b == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((b >= 0xC4) & (b <= 0xC9)) | ((b == 0xCE) & (after >= 0x91)) | ((b == 0xCF) & (after <= 0x8F)) | (b == 0xD0) | (b == 0xD1)
    ok = lead | ((b >= 97) & (b <= 122))
    ok[1:] |= lead[:-1]
    return ok


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class WordTokenizer:
    """Encodes texts to little-endian ids of `width` bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.width = 2 if self.inner.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and len(model["vocab"]) <= 1 << 16
        self.merges = PairMerges(model["vocab"], model["merges"], model["end_of_word_suffix"]) if plain else None
        self._clear()
        del model
        release()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # of known words, ascending
        self.at = self.n = np.zeros(0, dtype=np.int64)  # their ids in the pool
        self.pool = np.zeros(0, dtype=f"<u{self.width}")

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words [start, end), and the number of each word's ids."""
        last = np.maximum.accumulate(np.where(_IS_TAIL[buffer], 0, np.arange(1, len(buffer) + 1)))
        core = np.maximum(last[end - 1], start)  # where the punctuation begins
        odd_bytes = np.concatenate([[0], np.cumsum(~_letters(buffer))])
        plain = (core > start) & (odd_bytes[core] == odd_bytes[start]) if self.merges is not None else np.zeros(len(start), dtype=bool)
        piece_start, piece_end = np.stack([start, core], axis=1)[plain].ravel(), np.stack([core, end], axis=1)[plain].ravel()
        length = piece_end - piece_start
        some = length > 0
        ids, per_piece = self.merges.encode(buffer[_ranges(piece_start[some], length[some])], length[some]) if plain.any() else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        counts = np.zeros(len(start), dtype=np.int64)
        of_piece = np.zeros(len(length), dtype=np.int64)
        of_piece[some] = per_piece
        counts[plain] = of_piece.reshape(-1, 2).sum(axis=1)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, counts
        found = self._encode([buffer[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        counts[rest] = [len(x) // self.width for x in found]
        out = np.zeros(counts.sum(), dtype=np.int64)
        begin = np.cumsum(counts) - counts
        out[_ranges(begin[plain], counts[plain])] = ids
        out[_ranges(begin[rest], counts[rest])] = np.frombuffer(b"".join(found), dtype=f"<u{self.width}")
        return out, counts

    def _add(self, buffer: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Learn the words [start, end) of the hashes `code` that aren't known."""
        if len(self.hashes) + len(code) > _MOST_WORDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, code), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != code) if len(self.hashes) else np.arange(len(code))
        if not len(new):
            return
        ids, n = self._fresh(buffer, start[new], end[new])
        hashes = np.concatenate([self.hashes, code[new]])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])[order]
        self.n = np.concatenate([self.n, n])[order]
        self.pool = np.concatenate([self.pool, ids.astype(self.pool.dtype)])

    def _look_up(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for first, last, buffer, start, _ in byte_chunks(texts, b" ", _GROUP):
            s, e = word_spans(buffer)
            code, one, which = np.unique(span_hash(prefix_hash(buffer, BYTE_VALUES), s, e), return_index=True, return_inverse=True)
            self._add(buffer, code, s[one], e[one])
            known = np.searchsorted(self.hashes, code)
            n = self.n[known][which]
            ids = self.pool[_ranges(self.at[known][which], n)].tobytes()
            owner = np.searchsorted(start, s, side="right") - 1
            ends = (np.cumsum(np.bincount(owner, weights=n, minlength=last - first)).astype(np.int64) * self.width).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        lowered: list[bytes] = []
        for i, t in enumerate(texts):
            low = t.lower()
            if _WHOLE.search(t) or not (t.isascii() or (unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low))):
                out[i] = self._encode([t])[0]
            else:
                plain.append(i)
                lowered.append((low if low.isascii() else _SPACE.sub(" ", low)).encode())
        for i, ids in zip(plain, self._look_up(lowered), strict=True):
            out[i] = ids
        return out


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process, so that its table of words lasts from task to task."""
    return resident(("tokenizer", path), lambda: WordTokenizer(path))
