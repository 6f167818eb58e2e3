"""Fill-in-the-middle examples cut between units of text, by run-length class encoding.

A unit is a whole run of the letters A-Z and a-z, or one code point of any other sort. A
text is stored as its maximal runs of one class with the units and code points before
each, so a cut at a number of units is found by a binary search for the run that holds
it, and its place in the run by subtraction: a run of letters is one unit, another run has
a unit a code point. No list of units is built. Runs of a whole block of texts are found
and searched in one numpy pass; a text longer than a block is a block of its own.

The cuts and the form follow from a hash of the document's id alone (``draws``), so a task
that runs again gives the same examples.

Nulls and odd input: a null text is empty; an empty text, and one that holds a marker, is
plain. A null doc_id draws as an empty id does. Repeated rows give equal results each, an
empty table none. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.runtime import prepare
from tidemark.llm.textkit import blocks, raw

#: The markers, and the shares of a hundred that stay plain and that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from a document's id."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


class Runs:
    """The class runs of a block of texts: first byte, first code point and units before each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.points = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)  # the byte of each code point
        letter = _LETTER[data[self.points[:-1]]]
        self.text = np.searchsorted(self.points, offsets)  # the code point at which each text begins
        new = np.zeros(len(letter) + 1, bool)
        new[: len(letter)][:1] = True
        new[1 : len(letter)] = letter[1:] != letter[:-1]
        new[self.text] = True
        self.start = np.flatnonzero(new[: len(letter)])
        length = np.diff(np.append(self.start, len(letter)))
        self.letters = letter[self.start]
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, length))])
        self.first = np.searchsorted(self.start, self.text)  # each text's first run
        self.units = np.diff(self.before[self.first])

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The code point, in the block, after so many units of each text."""
        wanted = self.before[self.first[:-1]] + units
        run = np.searchsorted(self.before, wanted, "right") - 1
        inside = wanted - self.before[run]  # more than 0 in runs of other sorts only
        run_start = np.append(self.start, len(self.points) - 1)
        # Of texts without a unit between two others, and at a text's end, the next run starts there.
        return run_start[np.minimum(run, len(self.start))] + inside


def _examples(batches):
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        h = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
        for lo, hi in blocks(offsets):
            own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            runs = Runs(own, at)
            n = runs.units
            one, two = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
            left, right = runs.cut(np.minimum(one, two)), runs.cut(np.maximum(one, two))
            a, b = runs.points[left], runs.points[right]
            form, texts = [], []
            markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
            for i in range(hi - lo):
                whole = own[at[i] : at[i + 1]].tobytes()
                if not whole or h[2][lo + i] % 100 >= PLAIN_FROM or any(m in whole for m in markers):
                    form.append("plain"), texts.append(whole)
                    continue
                x, y = a[i] - at[i], b[i] - at[i]
                p, m, s = whole[:x], whole[x:y], whole[y:]
                first = h[3][lo + i] % 100 < SUFFIX_FIRST
                form.append("spm" if first else "psm")
                order = ((markers[1], s), (markers[0], p)) if first else ((markers[0], p), (markers[1], s))
                texts.append(b"".join((*order[0], *order[1], markers[2], m)))
            plain = np.array([f == "plain" for f in form], bool)
            out = {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(left - runs.text[:-1], pa.int64(), mask=plain), "middle_chars": pa.array(right - left, pa.int64(), mask=plain),
                "output": pa.array(texts, pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and the output of every row."""
    prepare(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"]]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    rows = docs.select("doc_id", "text", *[d.alias(f"h{k}") for k, d in enumerate(draws(F.col("doc_id")), 1)])
    return rows.mapInArrow(_examples, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts hold no marker, so the first of each is the one put in."""
    rest = lambda text, mark: F.substr(text, F.instr(text, mark) + len(mark))
    until = lambda text, mark: F.substring_index(text, mark, 1)
    prefix = F.when(form == "psm", until(rest(output, PREFIX), SUFFIX)).otherwise(until(rest(output, PREFIX), MIDDLE))
    suffix = F.when(form == "psm", until(rest(output, SUFFIX), MIDDLE)).otherwise(until(rest(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, rest(output, MIDDLE), suffix))
