"""Token ids of whole texts by a public tokenizer file (`tokenizers` library), cached by piece.

The byte-level pattern starts a new piece at every blank that follows a
non-blank: such a blank can only open ` ?\\p{L}+`, ` ?\\p{N}+`, ` ?[^\\s\\p{L}\\p{N}]+`
or a run of blanks. Texts are cut there, each distinct piece is encoded once
per worker, and the ids of a text are its pieces' ids in order, which equals
encoding the text as a whole (tested).

New pieces of plain ASCII are cut again where the pattern cuts them (a word and the comma behind it), so that the
library's model merges the bytes of each distinct part once; other pieces go through the whole tokenizer, and so do
pieces that hold an added token, such as `<|endoftext|>` in a text, which is one id.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from canvass.llm.common import RELEASE

#: Vocabulary file and the id that ends a document.
TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0

#: Pieces a worker keeps before it starts its cache anew (bounds its memory, not its results).
CACHE_PIECES = 1_400_000

#: Pieces whose ids are gathered at once.
GATHERED = 1 << 14

#: The pattern of the byte-level split, for ASCII text.
_PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: How the byte-level alphabet writes the ASCII bytes that are not printed as themselves.
_BYTES = {b: 256 + b for b in range(33)} | {127: 289}
#: Stands between words that are translated together; neither ASCII nor of that alphabet.
_BETWEEN = "\ue000"

_BLANK_THEN_SPACE = re.compile(r"\s ")
#: A text that is not simply cut at each space: it begins with one, or has one behind another blank.
_ODD_BLANKS = r"^ |[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S) ")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """The text cut at each single space that follows a non-blank; joined by spaces they give the text."""
    return _CUT.split(text) if text[:1] == " " or _BLANK_THEN_SPACE.search(text) else text.split(" ")


_NONE = np.zeros(0, dtype=np.uint32)


class _Numbered(dict):
    """Gives each key that it has not seen the next number of a shared list of pieces."""

    def __init__(self, new: list[str], start: str):
        super().__init__()
        self.new, self.start = new, start

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.new)
        self.new.append(self.start + key)
        return n


class Encoder:
    """Encodes batches of texts; holds the piece cache of one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the cuts above are those of this split; another file's pieces go through its whole tokenizer
        plain = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
        self.model = Tokenizer(self.tokenizer.model) if plain and "use_regex=True" in str(self.tokenizer.pre_tokenizer) else None
        # byte-level tokens are as long as their bytes, added ones are written as they are
        sizes = {n: len(token) for token, n in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {n: len(t.content.encode()) for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = np.zeros(1 + max(sizes, default=0), dtype=np.int64)
        self.bytes_of[list(sizes)] = list(sizes.values())
        self._clear()

    def _clear(self) -> None:
        self.seen: list[str | None] = []
        self.first, self.later = _Numbered(self.seen, ""), _Numbered(self.seen, " ")
        self.parts = _Numbered([], "")
        self.part_ids, self.part_start, self.part_size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.done = self.used = self.part_used = 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate((array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)))

    def _encoded(self, tokenizer, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (of `sizes` bytes), and how many each has.

        The library's fast call does not tell which word an id is of; the bytes of a word's ids add up to the word's.
        """
        ids = np.array(tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends, bounds = np.concatenate(([0], np.cumsum(self.bytes_of[ids]))), np.cumsum(sizes)
        last = np.searchsorted(ends, bounds)
        if ends[-1] == bounds[-1] and (ends[last] == bounds).all():
            return ids, np.diff(last, prepend=0)
        # a byte that the vocabulary lacks has no id, and an added token may take blanks beside it
        out = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(out.ids, dtype=np.uint32), np.bincount(np.array(out.word_ids, dtype=np.int64), minlength=len(words))

    def _learn_parts(self, n: int, whole: list[int]) -> None:
        """Encode the parts from number n on; those numbered in `whole` by the whole tokenizer."""
        new = self.parts.new[n:]
        chosen = np.zeros(len(new), dtype=bool)
        chosen[np.array(whole, dtype=np.int64) - n] = True
        start, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for own, tokenizer in ((np.flatnonzero(~chosen), self.model), (np.flatnonzero(chosen), self.tokenizer)):
            if not len(own):
                continue
            words = [new[i] for i in own.tolist()] if len(own) < len(new) else new
            sizes = pc.binary_length(pa.array(words, pa.string())).to_numpy()
            if tokenizer is self.model:
                # one translation of all
                words = _BETWEEN.join(words).translate(_BYTES).split(_BETWEEN)
            ids, size[own] = self._encoded(tokenizer, words, sizes)
            start[own] = self.part_used + np.cumsum(size[own]) - size[own]
            self.part_ids = self._room(self.part_ids, self.part_used + len(ids))
            self.part_ids[self.part_used:self.part_used + len(ids)] = ids
            self.part_used += len(ids)
        self.part_start, self.part_size = self._room(self.part_start, n + len(new)), self._room(self.part_size, n + len(new))
        self.part_start[n:n + len(new)] = start
        self.part_size[n:n + len(new)] = size
        self.parts.new[n:] = [None] * len(new)

    def _learn(self) -> None:
        """Encode the pieces that are new since the last call."""
        n, at, known = self.done, self.used, len(self.parts.new)
        new = self.seen[n:]
        together = _BETWEEN.join(new)
        added = [a for a in self.added if a in together]
        number, index, counts, whole = self.parts.__getitem__, [], [], []
        for piece in new:
            if self.model is None or not piece.isascii() or (added and any(a in piece for a in added)):
                whole.append(len(self.parts.new))
                index.append(whole[-1])
                self.parts.new.append(piece)  # a part of its own, which no other piece looks up
            elif piece.isalpha():
                index.append(number(piece))
            else:
                index.extend(map(number, _PARTS.findall(piece)))
            counts.append(len(index))
        if len(self.parts.new) > known:
            self._learn_parts(known, whole)
        index = np.array(index, dtype=np.int64)
        size = self.part_size[index]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.part_ids[np.repeat(self.part_start[index] - ends[:-1], size) + np.arange(ends[-1])]
        size = np.diff(ends[np.concatenate(([0], counts)).astype(np.int64)])
        self.done, self.used = n + len(new), at + len(ids)
        self.seen[n:] = [None] * len(new)
        self.ids, self.start, self.size = self._room(self.ids, self.used), self._room(self.start, self.done), self._room(self.size, self.done)
        self.ids[at:self.used] = ids
        self.size[n:self.done] = size
        self.start[n:self.done] = at + np.cumsum(size) - size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; a null text is empty."""
        if self.done > CACHE_PIECES:
            self._clear()
        column = pa.array([t or "" for t in texts], pa.string())
        odd = pc.match_substring_regex(column, _ODD_BLANKS).to_numpy(zero_copy_only=False)
        cuts = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        values, offsets = cuts.values.dictionary_encode(), cuts.offsets.to_numpy()
        # each distinct piece of the batch is looked up once
        later = np.array(list(map(self.later.__getitem__, values.dictionary.to_pylist())), dtype=np.int64)
        index = later[values.indices.to_numpy()] if len(later) else np.zeros(0, dtype=np.int64)
        begins = offsets[:-1][np.diff(offsets) > 0]
        index[begins] = list(map(self.first.__getitem__, cuts.values.take(pa.array(begins)).to_pylist()))
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.diff(offsets)
        if odd.any():
            found = [[self.first[cut[0]], *map(self.later.__getitem__, cut[1:])] for cut in map(pieces, (texts[i] for i in np.flatnonzero(odd).tolist()))]
            counts[odd] = [len(f) for f in found]
            whole = np.zeros(int(counts.sum()), dtype=np.int64)
            mine = np.repeat(odd, counts)
            whole[~mine] = index
            whole[mine] = np.concatenate([np.array(f, dtype=np.int64) for f in found])
            index = whole
        if len(self.seen) > self.done:
            self._learn()
        if not len(index):
            return [_NONE for _ in texts]
        size, start = self.size[index], self.start[index]
        ends = np.cumsum(size)
        ids = np.empty(ends[-1], dtype=np.uint32)
        for a in range(0, len(index), GATHERED):  # by parts that stay in the processor's cache
            own = size[a:a + GATHERED]
            first, last = int(ends[a] - own[0]), int(ends[a + len(own) - 1])
            where = np.repeat(start[a:a + len(own)] - ends[a:a + len(own)] + own, own)
            where += np.arange(first, last)
            np.take(self.ids, where, out=ids[first:last], mode="clip")
        bounds = np.concatenate(([0], ends))[np.cumsum(counts)]
        return np.split(ids, bounds[:-1])


_ENCODERS: dict[str, Encoder] = {}
RELEASE.append(_ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(column: pa.Array, path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text of an Arrow column with the end id appended."""
    end = np.array([end_id], dtype=np.uint32)
    return [np.concatenate((ids, end)) for ids in encoder(path).encode(column.to_pylist())]
