"""String expressions; all but the residue counts stay inside whole-stage codegen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from strandline.functions.vectors import to_lists

# Code points of the white space removed when text is stripped.
WHITESPACE = "".join(map(chr, [
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287,
    12288,
]))

# Separators, control and format characters never become tokens (the inside
# of a character class).
NOT_A_TOKEN = r"\p{Z}\p{Cc}\p{Cf}\x{FFFD}"

SLICE_BYTES = 1 << 18  # text counted at a time, so that the arrays of 24 bytes for each of them stay small


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (plain ``trim`` knows only blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def tidy_category(c: Column) -> Column:
    """Category text stripped and upper-cased."""
    return F.upper(strip(c.cast("string")))


def spaced(c: Column) -> Column:
    """The characters of the whole text joined by blanks: ``KLA`` -> ``K L A``."""
    return F.array_join(F.split(c, ""), " ")


def stratum_key(category: Column, label: Column) -> Column:
    """``category_label``; null when the category is null."""
    return F.concat(category, F.lit("_"), label.cast("string"))


def length_bin(length: Column, width: int = 10, top: int = 190) -> Column:
    """Left-closed bin number of ``length``; null outside ``[0, top)``."""
    return F.when((length >= 0) & (length < top), F.floor(length / width).cast("int"))


def residue_counts(sequence: Column, residues: str) -> Column:
    """Occurrences of each ASCII letter in the whole sequence, as array<double>.

    One pass over the bytes; built-in ``replace`` or ``regexp_count`` needs one per letter. A batch holds up to 64 MB of
    text; it is counted in slices of bytes, which may end inside a text.
    """
    place = np.full(256, len(residues))
    place[list(residues.encode("ascii"))] = np.arange(len(residues))

    @F.arrow_udf("array<double>")
    def batch(texts: pa.Array) -> pa.Array:
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        packed = texts.cast(pa.large_binary())
        width = len(residues) + 1
        table = np.zeros((len(packed), width))
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1] if len(packed) else [0]
        raw = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
        for start in range(ends[0], ends[-1], SLICE_BYTES):
            stop = min(start + SLICE_BYTES, ends[-1])
            first, last = np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, stop)
            lengths = np.diff(np.clip(ends[first:last + 1], start, stop))
            cells = np.repeat(np.arange(last - first) * width, lengths) + place[raw[start:stop]]
            table[first:last] += np.bincount(cells, minlength=(last - first) * width).reshape(-1, width)
        return to_lists(table[valid, :-1], valid)
    return batch(sequence)
