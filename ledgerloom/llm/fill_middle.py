"""Fill-in-the-middle: each text is cut at two places and its parts are put in another order.

Texts are cut after whole units: lines or characters. A block of texts is kept
as UTF-8 bytes; all that is known of its characters is a sparse index of the
exceptions: the places of characters of several bytes, and their excess bytes so
far. Between exceptions a character is a byte, so that code points become bytes,
and bytes code points, by one search in that index and a subtraction. Nothing is
shuffled; a row's cuts depend on its id alone, so that a task that runs again
makes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import blocks

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 100, 50


class Exceptions:
    """The characters of several bytes in a block of UTF-8 bytes: where each starts, and the excess bytes before it."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.character = self.at - self.before[:-1]

    def characters(self, place: np.ndarray) -> np.ndarray:
        """Code points before byte places, which don't lie within a character."""
        return place - self.before[np.searchsorted(self.at, place)]

    def bytes(self, character: np.ndarray) -> np.ndarray:
        """Byte places of code points."""
        return character + self.before[np.searchsorted(self.character, character)]


class Lines:
    """Units of whole lines: a line ends after its line feed or with the text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, _: Exceptions):
        self.end = bounds[1:]
        self.start = bounds[:-1]
        self.feeds = np.flatnonzero(data == 10)
        self.first = np.searchsorted(self.feeds, bounds[:-1])
        self.ended = np.searchsorted(self.feeds, bounds[1:]) - self.first
        full = np.zeros(len(self.end), bool)
        some = self.end > self.start
        full[some] = data[self.end[some] - 1] == 10
        self.count = self.ended + (some & ~full)

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte place after so many units of each row."""
        feeds = np.append(self.feeds, 0)
        inner = feeds[np.minimum(self.first + np.maximum(units, 1) - 1, len(feeds) - 1)] + 1
        return np.where(units == 0, self.start, np.where(units <= self.ended, inner, self.end))


class Characters:
    """Units of code points."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, exceptions: Exceptions):
        self.exceptions = exceptions
        at = exceptions.characters(bounds)
        self.start, self.count = at[:-1], np.diff(at)

    def after(self, units: np.ndarray) -> np.ndarray:
        return self.exceptions.bytes(self.start + units)


UNITS = {"line": Lines, "character": Characters}


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of the hex sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each row of df.

    ``n`` is the number of units; prefix and middle end after the smaller and
    the greater of two numbers drawn from 0 to n. ``rate`` percent of the texts
    are rearranged, ``spm_rate`` percent of these with the suffix first. A text
    that is empty or holds a mark stays plain, its output is the text, and its
    cuts are null. A null text is empty; a null id is drawn for as the empty
    string; rows that repeat have the same result; of other columns none is read.
    A text of any length is one row, cut by array operations.
    """
    first, second, third, fourth = draws(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | (third % 100 >= rate)
    for mark in marks:
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(fourth % 100 < spm_rate, "spm").otherwise("psm")
    source = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), first.alias("a"), second.alias("b"), form.alias("form"))
    kind = df.schema[id_col].dataType.simpleString()
    opened, closed, held = (m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_draw, b_draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for begin, end, data, bounds in blocks(batch.column("text")):
                exceptions = Exceptions(data)
                units = UNITS[unit](data, bounds, exceptions)
                x, y = a_draw[begin:end] % (units.count + 1), b_draw[begin:end] % (units.count + 1)
                p, m = units.after(np.minimum(x, y)), units.after(np.maximum(x, y))
                at = exceptions.characters(np.stack([bounds[:-1], p, m]))
                forms, raw, out = batch.column("form").slice(begin, end - begin), data.tobytes(), []
                for how, s, i, j, e in zip(forms.to_pylist(), bounds[:-1].tolist(), p.tolist(), m.tolist(), bounds[1:].tolist()):
                    if how == "plain":
                        out.append(raw[s:e])
                    elif how == "psm":
                        out.append(b"".join((opened, raw[s:i], closed, raw[j:e], held, raw[i:j])))
                    else:
                        out.append(b"".join((closed, raw[j:e], opened, raw[s:i], held, raw[i:j])))
                cut = np.array(forms.to_pylist(), dtype=object) == "plain"
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(units.count, pa.int64()), forms, pa.array(at[1] - at[0], pa.int64(), mask=cut), pa.array(at[2] - at[1], pa.int64(), mask=cut), pa.array(out, pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of. Marks stand in it once each, as no rearranged text holds one."""
    out, size = F.col(output), [len(m) for m in marks]
    p, s, m = (F.instr(out, F.lit(mark)) for mark in marks)
    part = lambda begin, end: F.substring(out, begin, end - begin)
    middle = F.substring(out, m + size[2], F.lit(2**31 - 1))
    psm = F.concat(part(p + size[0], s), middle, part(s + size[1], m))
    spm = F.concat(part(p + size[0], m), middle, part(s + size[1], p))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)
