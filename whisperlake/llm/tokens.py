"""Token ids of whole texts by a public tokenizer, computed once for each distinct piece of a slice.

Most of a tokenizer's time goes into words that it has just seen. Both supported files never let a token cross certain
places, so texts are cut there, equal pieces are encoded once and the ids are put together again by numpy. Texts for which
a cut might not be safe are encoded whole. ``tests/llm`` compares with plain encoding.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from whisperlake.llm.arrays import coded, ragged, strings, words

# Marks that may end a word; not the apostrophe, which may begin a contraction.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NEXT_TO_SPACE = f"( {_SPACE})|({_SPACE} )"
# Letters that Unicode normal forms or lower-casing may join with what follows.
_NOT_PLAIN = r"[^\x00-\x{24f}]|\x{130}"
# About so many bytes of pieces with their ids are kept by a worker between slices, and what each takes besides its text and ids.
KEPT_BYTES = 96 << 20
_ENTRY = 190
# Words that are encoded as one text.
JOINED = 200


class Ids(NamedTuple):
    """Token ids of some texts: text i owns ids[starts[i]:starts[i + 1]]."""

    ids: np.ndarray
    starts: np.ndarray


def path_of(file: str) -> str:
    """The place of a vocabulary file by its public name, or the path itself."""
    if "/" in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))


class Encoder:
    """A tokenizer file with a memory of its own. ``byte_level``: spaces belong to the tokens that follow them."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.path = path_of(file)
        self.tokenizer = Tokenizer.from_file(self.path)
        # Pieces may hold such marks in lower case, which are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.byte_level = self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}
        self.room = KEPT_BYTES
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        # Where a word of letters begins (byte level: its token holds the space) or ends, by id.
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for t, i in names.items() if (t[0] == "\u0120" if self.byte_level else t.endswith("</w>"))]] = True

    @cached_property
    def as_it_is(self):
        """The file's own tokenizer, for whole texts only: most tasks have none, and it takes as much memory again."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number for each; words of letters are encoded many at a time."""
        # Pieces of the byte level bring their own space.
        between = "" if self.byte_level else " "
        simple = [p[:1] == " " and p[1:].isalpha() if self.byte_level else p.isalpha() for p in pieces]
        simple = np.array([s and (p.isascii() or max(p) < "\u0250" and "\u0130" not in p) for s, p in zip(simple, pieces)], bool)
        some = [p for p, s in zip(pieces, simple) if s]
        texts = [between.join(some[i:i + JOINED]) for i in range(0, len(some), JOINED)]
        many = _flat(self.plain(texts))
        at = np.flatnonzero(self.edge[many])
        if len(at) != len(some):  # an unexpected token; the plain way is always right
            many = self.plain(some)
            size, many = np.fromiter(map(len, many), np.int64, len(many)), _flat(many)
        elif self.byte_level:
            size = np.diff(np.append(at, len(many)))
        else:
            size = np.diff(np.concatenate(([-1], at)))
        rest = self.plain([p for p, s in zip(pieces, simple) if not s])
        lengths = np.empty(len(pieces), np.int64)
        lengths[simple], lengths[~simple] = size, np.fromiter(map(len, rest), np.int64, len(rest))
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        out[ragged(starts[simple], lengths[simple])] = many
        out[ragged(starts[~simple], lengths[~simple])] = _flat(rest)
        return out, lengths

    def units(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all ids, and each piece's place and number."""
        found = [self.known.get(p) for p in pieces]
        new = [p for p, f in zip(pieces, found) if f is None]
        flat, lengths = self.fresh(new)
        raw, ends = flat.tobytes(), (np.cumsum(lengths) * 4).tolist()
        for p, a, b in zip(new, [0, *ends], ends):
            self.room -= len(p) + b - a + _ENTRY
            if self.room < 0:
                break
            self.known[p] = raw[a:b]
        missing = np.fromiter((f is None for f in found), bool, len(found))
        kept = [f for f in found if f is not None]
        size = np.empty(len(pieces), np.int64)
        size[missing] = lengths
        size[~missing] = np.fromiter(map(len, kept), np.int64, len(kept)) // 4
        place = np.empty(len(pieces), np.int64)
        place[missing] = np.cumsum(lengths) - lengths
        place[~missing] = len(flat) + np.cumsum(size[~missing]) - size[~missing]
        return np.concatenate((flat, np.frombuffer(b"".join(kept), np.uint32))), place, size

    def encode(self, texts: pa.Array) -> Ids:
        """Ids of whole texts (no nulls), as the file's own tokenizer gives them."""
        whole = np.zeros(len(texts), bool)
        if self.added:  # marks such as <|endoftext|> are one token each where a text holds them
            whole |= pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        if self.byte_level:
            whole |= pc.match_substring_regex(texts, _NEXT_TO_SPACE).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        some = self._cut(texts.filter(pa.array(~whole)))
        rest = [e.ids for e in self.as_it_is.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        size = np.empty(len(texts), np.int64)
        size[~whole], size[whole] = np.diff(some.starts), [len(x) for x in rest]
        starts = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(starts[-1], np.uint32)
        out[ragged(starts[:-1][~whole], size[~whole])] = some.ids
        out[ragged(starts[:-1][whole], size[whole])] = _flat(rest)
        return Ids(out, starts)

    def _cut(self, texts: pa.Array) -> Ids:
        """Ids of texts that may be cut at spaces."""
        if not self.byte_level:
            # The file's own normaliser lower-cases; doing so for A-Z beforehand leaves fewer distinct words.
            w = words(pc.ascii_lower(texts))
            return self._joined(w.codes, w.starts, w.vocab, len(w.vocab), "")
        w = coded(pc.split_pattern(texts, " "))
        # The first piece of a text has no space before it: it gets a code of its own.
        heads = w.vocab.take(pa.array(w.codes[w.starts[:-1]])).dictionary_encode()
        codes = w.codes.copy()
        codes[w.starts[:-1]] = len(w.vocab) + heads.indices.to_numpy(zero_copy_only=False)
        return self._joined(codes, w.starts, pa.concat_arrays([w.vocab, heads.dictionary]), len(w.vocab), " ")

    def _joined(self, codes: np.ndarray, starts: np.ndarray, vocab: pa.Array, spaced: int, space: str) -> Ids:
        """Ids of texts given as pieces; ``space`` stands before the first ``spaced`` of the distinct pieces."""
        used = np.flatnonzero(np.bincount(codes, minlength=len(vocab)))
        renumber = np.zeros(len(vocab) + 1, np.int64)
        renumber[used] = np.arange(len(used))
        piece = vocab.take(pa.array(used)).cast(pa.large_string())
        before = pa.array(np.array(["", space])[(used < spaced).astype(int)], pa.large_string())
        # A word of plain letters and the marks behind it are two units.
        letters = pc.utf8_rtrim(piece, _MARKS)
        two = pc.and_(pc.and_(pc.utf8_is_alpha(letters), pc.less(pc.binary_length(letters), pc.binary_length(piece))),
                      pc.invert(pc.match_substring_regex(letters, _NOT_PLAIN)))
        left = pc.binary_join_element_wise(before, pc.if_else(two, letters, piece), pa.scalar("", pa.large_string()))
        right = pc.replace_substring_regex(piece.filter(two), r"^\pL+", "")
        units = pa.chunked_array([left, right]).combine_chunks().dictionary_encode()
        number = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, place, size = self.units(strings(units.dictionary))
        both = np.full((len(used), 2), -1)
        both[:, 0] = number[:len(used)]
        both[two.to_numpy(zero_copy_only=False), 1] = number[len(used):]
        # Nothing stands for a missing second unit, nor for an empty one.
        size, place = np.append(size, 0), np.append(place, 0)
        # Both units of each distinct piece are put together once, not at each of its occurrences.
        flat = flat[ragged(place[both.ravel()], size[both.ravel()])]
        size = size[both].sum(axis=1)
        place = np.cumsum(size) - size
        codes = renumber[codes]
        lengths = size[codes]
        ids = flat[ragged(place[codes], lengths)]
        return Ids(ids, np.concatenate(([0], np.cumsum(lengths)))[starts])


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """One encoder for each file and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel units
    return Encoder(file)


def with_end(t: Ids, end: int) -> Ids:
    """Each text's ids followed by ``end``."""
    n = len(t.starts) - 1
    starts = t.starts + np.arange(n + 1)
    out = np.full(len(t.ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = t.ids
    return Ids(out, starts)
