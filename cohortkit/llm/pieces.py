"""Texts cut at places where byte-level BPE with the public pattern always cuts.

A blank that follows a visible character starts a new match of the pattern: no letter,
number or sign class takes in a blank, and what stands before it ends there.  So does a sign
that follows a letter, both in ASCII: no match goes from a letter on to a sign.  Cutting only
at such places, a tokenizer gives the same ids piece by piece as for the whole text, and a
batch has far fewer different pieces than pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortkit.llm.common import BLANK, raw_text

# Last bytes of the white space beyond ASCII, and the byte before them; a blank right after
# one is left uncut, as is a blank after a control character.
_TAIL = np.zeros(256, bool)
_TAIL[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_BEFORE = np.zeros(256, bool)
_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

# Latin letters only (no signs stand in these ranges), after a blank or none: one match.
_ONE = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+\z"


def one_word(pieces: pa.Array) -> np.ndarray:
    """Which pieces are surely a single match of the pattern, as most are."""
    return pc.match_substring_regex(pieces, _ONE).to_numpy(zero_copy_only=False)


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces of a batch, the number of each piece in order, and the first
    piece of each text (one entry more than texts)."""
    raw, offsets = raw_text(column)
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        before = raw[:-1]
        safe = _VISIBLE[before]
        odd = _TAIL[before]
        odd[1:] &= _BEFORE[raw[:-2]]
        cut[1:n] = (BLANK[raw[1:]] & safe & ~odd) | (_SIGN[raw[1:]] & _LETTER[before])
    cut[offsets] = True
    places = np.flatnonzero(cut)
    words = pa.LargeStringArray.from_buffers(
        len(places) - 1 if n else 0, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)
    )
    coded = words.dictionary_encode()
    first = np.searchsorted(places, offsets)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first


def gather(
    ids: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text starts, from the ids of the pieces."""
    counts = np.diff(offsets)[numbers]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total, dtype=np.int64)
    place += np.repeat(offsets[numbers] - (ends - counts), counts)
    bounds = np.concatenate([[0], ends])[first]
    return ids[place], bounds
