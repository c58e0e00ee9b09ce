"""Encoding with the ``tokenizers`` library, word by word with a bounded cache.

Both vocabularies end a pre-token before a single blank or line end that no white space touches, after such
a line end, and before a full stop or comma that follows a letter or digit. So a text can be cut there and
the parts encoded apart. Texts with runs of white space, or that end in it, are encoded whole.

Texts are cut and their distinct words found by Arrow, a batch at a time; each distinct word is looked up once, and
words that a worker doesn't know are encoded many in one text where they are of letters only. Ids lie end to end in
one array, so the cache costs little beside its words, and it has a bound in bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from provlake.llm.common import KEPT, ragged

#: Texts encoded whole: white space that is no lone blank or line end inside the text, and NUL, which marks the cuts.
ODD = r"[ \n][ \n]|[ \n]\z|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A full stop or comma that may belong to the pre-token before it: it follows none of the letters and
#: digits that normalising leaves as they are, but for case.
JOINED = r"(?:^|[^A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}])[.,]"
#: Characters whose case is not folded here.
UNFOLDED = r"[^\x00-\x{12f}\x{131}-\x{17f}]"
#: Bytes of memory that the words a worker keeps may take, about.
MOST_BYTES = 120_000_000
#: What a word costs besides its characters: a string's and a dictionary's entry.
WORD_BYTES = 170
#: Words of one text, and texts of one call.
TOGETHER, CALL = 500, 8


class WordCache:
    """ids of texts as unsigned 32-bit numbers."""

    def __init__(self, file: str, most_bytes: int = MOST_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.most_bytes = most_bytes
        self.clear()
        #: The vocabulary ignores case and blanks: words that differ by these share an entry.
        self.folds = len({tuple(self._alone([t])[0]) for t in ("Ab c", "ab c", " aB  c ")}) == 1
        #: Whether a token ends a word (where blanks are dropped) or begins with a blank.
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.folds else t.startswith("\u0120"))]] = True

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int32)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 2000):
            found = self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in found]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """As the library has it: ids as little-endian unsigned 32-bit bytes."""
        return [x.astype("<u4").tobytes() for x in self._alone(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same by way of the cache."""
        ids, starts = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]

    def _put(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """words with their ids, end to end."""
        n = len(self.known)
        while n + len(words) > len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.seen))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[n : n + len(words)] = self.filled + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.seen[n : n + len(words)] = 0
        self.filled += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.bytes += WORD_BYTES * len(words) + 2 * sum(map(len, words)) + ids.nbytes

    def _add(self, new: list[str]) -> None:
        """Words of letters stand together in one text, told apart by the tokens at their edges; others are encoded alone."""
        lead, glue = ("", " ") if self.folds else (" ", "")
        many: list[str] = []
        alone: list[str] = []
        for w in new:
            (many if w.startswith(lead) and w[len(lead) :].isalpha() else alone).append(w)
        groups = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)]
        for i in range(0, len(groups), CALL):
            some = groups[i : i + CALL]
            for words, e in zip(some, self.tokenizer.encode_batch_fast([glue.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(self.edge[ids])
                size = np.diff(at, prepend=-1) if self.folds else np.diff(at, append=len(ids))
                if len(size) == len(words) and int(size.sum()) == len(ids):
                    self._put(words, ids, size)
                else:  # not as many edges as words
                    alone += words
        if alone:
            ids = self._alone(alone)
            self._put(alone, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _bound(self) -> None:
        """Beyond the bound only words of several batches stay; if these are too many as well, none."""
        if self.bytes <= self.most_bytes:
            return
        words, seen = list(self.known), self.seen[: len(self.known)]
        keep = np.flatnonzero(seen > 1)
        ids, start, size = self.ids, self.start[keep], self.size[keep]
        kept = [words[i] for i in keep.tolist()]
        self.clear()
        if sum(map(len, kept)) * 2 + WORD_BYTES * len(kept) + 4 * int(size.sum()) < self.most_bytes // 2:
            self._put(kept, ids[ragged(start, size)], size)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts, end to end, and the n+1 places where each begins; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        whole = texts.filter(odd).to_pylist() if pc.any(odd).as_py() else []
        if whole:
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        cut = None
        if self.folds:
            lower = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), " ", "\0"), "\n", "\0")
            unfolded = pc.match_substring_regex(texts, UNFOLDED)
            cut = lower
        if cut is None or pc.any(unfolded).as_py():
            plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
            cut = plain if cut is None else pc.if_else(unfolded, plain, lower)
        ends = pc.replace_substring(pc.replace_substring(cut, ",", "\0,"), ".", "\0.")
        joined = pc.match_substring_regex(texts, JOINED)
        cut = pc.if_else(joined, cut, ends) if pc.any(joined).as_py() else ends
        lists = pc.split_pattern(cut, "\0")
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        place = list(map(self.known.get, words))
        new = [w for w, p in zip(words, place, strict=True) if p is None]
        if new:
            self._add(new)
            place = list(map(self.known.__getitem__, words))
        place = np.array(place, np.int64)
        self.seen[place] += 1
        place = place[flat.indices.to_numpy()]
        size = self.size[place]
        before = np.concatenate([[0], np.cumsum(size)])
        starts = before[lists.value_lengths().to_numpy().cumsum()]
        starts = np.concatenate([[0], starts]).astype(np.int64)
        ids = self.ids[ragged(self.start[place], size)]
        self._bound()
        if not whole:
            return ids, starts
        # texts encoded whole have no ids so far
        apart = iter(self._alone(whole))
        parts = [next(apart) if o else ids[starts[i] : starts[i + 1]] for i, o in enumerate(odd.to_pylist())]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_CACHES: dict[str, WordCache] = {}


def cache_for(file: str) -> WordCache:
    """The worker's cache for this vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if file not in _CACHES:
        _CACHES.clear()
        _CACHES[file] = WordCache(file)
    KEPT["tokens"] = _CACHES.clear
    return _CACHES[file]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[starts[1:] + np.arange(n)] = False
    out[own] = ids
    return out, starts + np.arange(n + 1)
