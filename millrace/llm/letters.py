"""Texts as sequences of letters and word ends, many at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def letter_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters as code points with a 0 for every run of other characters, and the text each place belongs to.

    Texts follow each other with a 0 between them, at the start and at the end;
    so a run of non-zero codes is a word, and lies in one text. Null counts as empty.
    """
    raw = texts.cast(pa.large_binary()).to_pylist()
    lower = [(x or b"").decode("utf-8", "replace").lower() for x in raw]
    codes = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    text = np.repeat(np.arange(-1, len(lower)), np.concatenate([[1], size + 1])).astype(np.int32)
    present = np.nonzero(np.bincount(codes))[0]
    table = np.zeros(int(codes.max()) + 1, bool)
    table[present] = [chr(c).isalpha() for c in present.tolist()]
    letter = table[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter[keep], codes[keep], 0), text[keep]
