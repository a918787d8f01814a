"""Which end tag closes which element: the one step of the tree that needs a stack.

Names are coded once for a part of a batch, and positions are kept as 32-bit numbers, not as Python objects; a part is
handed back as soon as it is done. So a worker holds one batch of names as Arrow brought it, one part, and one page of
objects, however many pages a batch has.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have content, and elements whose end tag may be missing in the source.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem "
    "meta nextid param source spacer track wbr".split()
)

_TREE = S.StructType([
    S.StructField(name, S.ArrayType(S.IntegerType()))
    for name in ("src", "mate", "parent", "nth", "seen")
])


_LIST = pa.list_(pa.field("element", pa.int32()))
PART = 1 << 17  # tokens worked on before their positions are handed back; a longer page is a part of its own


def _balance(marks) -> tuple[array, ...]:
    """Match start and end tags of one page.

    ``marks`` holds per token ``name`` (start tag), ``/name`` (end tag), ``name!!`` (element without content),
    ``name!`` (title or textarea with text), ``#`` (visible text) or an empty string. An end tag closes its
    nearest open namesake and whatever is open inside; one without a namesake is dropped; elements still open at
    the end are closed there. Parent and number of a list item refer to its list, even when an item before it
    was never closed.
    """
    src, mate, parent, nth, before = (array("i") for _ in range(5))
    stack, names, siblings, still_open, lists = [], [], [{}], {}, []
    seen = 0

    def put(at, mate_at, number, within=None):
        src.append(at)
        mate.append(mate_at)
        parent.append(within if within is not None else stack[-1] if stack else -1)
        nth.append(number)
        before.append(seen)

    def close(at):
        start, name = stack.pop(), names.pop()
        siblings.pop()
        still_open[name] -= 1
        if name in ("ul", "ol"):
            lists.pop()
        mate[start] = len(src)
        put(at, start, nth[start])

    for at, mark in enumerate(marks):
        if not mark or mark == "#":
            put(at, -1, 0)
            seen += mark == "#"
        elif mark[0] == "/":
            name = mark[1:]
            if still_open.get(name):
                while names[-1] != name:
                    close(-1)
                close(at)
        else:
            name = mark.rstrip("!")
            of_list = name == "li" and lists
            counts = siblings[lists[-1] + 1] if of_list else siblings[-1]
            number = counts[name] = counts.get(name, 0) + 1
            if name != mark or name in VOID:
                put(at, -1, number)
                seen += mark in ("title!", "textarea!")
                continue
            put(at, -1, number, stack[lists[-1]] if of_list else None)
            if name in ("ul", "ol"):
                lists.append(len(stack))
            stack.append(len(src) - 1)
            names.append(name)
            siblings.append({})
            still_open[name] = still_open.get(name, 0) + 1
    while stack:
        close(-1)
    return src, mate, parent, nth, before


def _parts(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pages that hold ``PART`` tokens or are one page, in order."""
    at = 0
    while at < len(first):
        end = max(int(np.searchsorted(last, first[at] + PART, side="right")), at + 1)
        yield at, end
        at = end


def _trees(marks: pa.ListArray) -> Iterator[pa.StructArray]:
    """The position arrays of a batch of pages, a part at a time; a page without marks has empty ones."""
    offsets, names = marks.offsets.to_numpy().astype(np.int64), marks.values
    missing = marks.is_null().to_numpy(zero_copy_only=False)
    for at, end in _parts(offsets[:-1], offsets[1:]):
        begin = offsets[at]
        coded = names.slice(begin, offsets[end] - begin).dictionary_encode()
        known, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        columns = [array("i") for _ in _TREE.names]
        ends = [0]
        for page in range(at, end):
            if not missing[page]:
                own = codes[offsets[page] - begin : offsets[page + 1] - begin]
                for column, found in zip(columns, _balance(map(known.__getitem__, own.tolist())), strict=True):
                    column.extend(found)
            ends.append(len(columns[0]))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(c, np.int32)), type=_LIST) for c in columns]
        yield pa.StructArray.from_arrays(lists, _TREE.names)


@F.arrow_udf(_TREE)
def balance_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for marks in batches:
        yield from _trees(marks)
