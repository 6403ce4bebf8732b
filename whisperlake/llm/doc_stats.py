"""Statistics of whole texts, for many texts at once: counts, character classes, common words, repeated windows."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from whisperlake.llm.arrays import Words, chained, coded, per_text, windows, words

# Frequent words of each supported language (fixed values).
COMMON = {
    "en": "the of and to in is that for it as was with be by on are this from or an a at not have".split(),
    "fr": "de la le les et des en un une du que qui dans pour par sur au est pas plus avec ce se il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los se del las un por con una para es al lo como más no su sus".split(),
}
ALL_COMMON = sorted({w for ws in COMMON.values() for w in ws})
_VALUES = pa.array(ALL_COMMON, pa.large_string())

CLASSES = ["lower", "upper", "digit", "blank", "newline", "mark", "symbol", "other", "beyond_ascii"]
SYMBOLS = "#*$%&|<>"
# Texts are taken in slices of so many bytes: some arrays here have several numbers for each byte.
SLICE = 2 << 20
_WINDOW = 3


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.uint8)
    out[ord("a"):ord("z") + 1] = 0
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[[32, 9, 11, 12, 13]] = 3
    out[10] = 4
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    out[[ord(c) for c in SYMBOLS]] = 6
    out[0xC0:] = 8
    out[0x80:0xC0] = len(CLASSES)  # the rest of a code point that is counted by its first byte
    return out


_CLASS_OF_BYTE = _class_of_byte()


def histogram(owner: np.ndarray, kind: np.ndarray, n: int, kinds: int) -> np.ndarray:
    return np.bincount(owner * kinds + kind, minlength=n * kinds).reshape(n, kinds)


def class_counts(texts: pa.Array) -> np.ndarray:
    """Code points of each class in each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    kind = _CLASS_OF_BYTE[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    out = np.zeros((len(texts), len(CLASSES) + 1), np.int64)
    for i, (a, b) in enumerate(pairwise((offsets - offsets[0]).tolist())):
        out[i] = np.bincount(kind[a:b], minlength=len(CLASSES) + 1)
    return out[:, :-1]


def common_counts(w: Words) -> np.ndarray:
    """How often each common word occurs in each text; letter case and marks at the ends don't count."""
    plain = pc.utf8_lower(pc.utf8_trim(w.vocab, characters=".,;:!?"))
    index = pc.index_in(plain, value_set=_VALUES.cast(plain.type))
    # A capital I with a dot is no letter of these words in Python's lower(); pyarrow makes a plain i of it.
    index = pc.if_else(pc.match_substring(w.vocab, "\u0130"), -1, pc.fill_null(index, -1))
    found = index.to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
    keep = found >= 0
    return histogram(w.owner[keep], found[keep], len(w.starts) - 1, len(ALL_COMMON))


def repeated_words(w: Words, owner: np.ndarray) -> np.ndarray:
    """For each word, whether it lies in a 3-word window found twice or more in its text.

    Windows are compared by a 64-bit hash of the text's number and the three words' codes.
    """
    marked = np.zeros(len(w.codes), bool)
    at = windows(w.starts, _WINDOW)
    if len(at):
        codes = w.codes.view(np.uint64)
        key = chained([owner[at].view(np.uint64), *(codes[at + k] for k in range(_WINDOW))])
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        for k in range(_WINDOW):
            marked[at[order[twice]] + k] = True
    return marked


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word in each text, and those equal to an earlier line of it."""
    lines = coded(pc.split_pattern(texts, "\n"))
    filled = pc.not_equal(pc.ascii_trim_whitespace(lines.vocab), "").to_numpy(zero_copy_only=False)
    keep = filled[lines.codes] if len(lines.codes) else np.zeros(0, bool)
    pairs = lines.owner[keep] * np.int64(len(lines.vocab) + 1) + lines.codes[keep]
    n = per_text(keep.astype(np.int64), lines.starts)
    distinct = np.bincount(np.unique(pairs) // (len(lines.vocab) + 1), minlength=len(texts))
    return n, n - distinct


def counts(texts: pa.Array, w: Words | None = None) -> dict[str, np.ndarray]:
    """What the quality rules look at, for texts without nulls (``w``: their words): one array (or matrix) with a row for each text."""
    w = words(texts) if w is None else w
    return {
        "n_words": np.diff(w.starts), "n_repeat_words": per_text(repeated_words(w, w.owner).astype(np.int64), w.starts),
        "classes": class_counts(texts), "common": common_counts(w),
    }


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """``counts`` and all others."""
    w = words(texts)
    out = counts(texts, w)
    classes = out["classes"]
    n_lines, dup = duplicate_lines(texts)
    pairs = np.unique(w.owner * np.int64(len(w.vocab) + 1) + w.codes)
    return out | {
        "word_chars": classes.sum(axis=1) - classes[:, 3] - classes[:, 4], "n_symbols": classes[:, 6],
        "n_lines": n_lines, "n_dup_lines": dup,
        "n_distinct": np.bincount(pairs // (len(w.vocab) + 1), minlength=len(texts)),
    }
