"""SimHash fingerprints and near-duplicates by covering locality-sensitive hashing.

Every bit position has a non-zero vector of radius + 1 bits. Table v, for each non-zero v, keeps the positions whose
vector has an odd product with v. The vectors of any `radius` positions span too little to leave every v out, so two
fingerprints that differ in at most `radius` bits agree on all kept positions of some table (Pagh, CoveringLSH).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import LOWER_BYTES, id_and_text, quoted, slices, written
from pageloom.llm.components import components

SEED = 42
RADIUS = 2


def masks(radius: int) -> list[int]:
    """The kept positions of each of the 2 ** (radius + 1) - 1 tables, as signed 64-bit numbers."""
    n = (1 << radius + 1) - 1
    vectors = [(37 * i + 11) % n + 1 for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; of the whole sequence if it is shorter."""
    found = (text or "").encode().translate(LOWER_BYTES).split()  # bytes split at ASCII white space only
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, lengths = b" ".join(found), list(map(len, found))
    ends = [e - 1 for e in accumulate(n + 1 for n in lengths)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    cuts = zip(starts, ends[words - 1 :], strict=False)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in cuts), dtype=np.uint64, count=len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; 0 for none. Signed, as Spark's longs are."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) per row; a null text, or one without words, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [majority(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    source = id_and_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def tables(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per table: (fp, t, mask, key)."""
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks(radius))])
    spread = fps.select("fp", F.explode(every).alias("s")).select("fp", "s.t", "s.mask")
    return spread.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def close_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at two or fewer differing bits.

    Candidates are the buckets of `tables` with two or more distinct fingerprints. In a bucket only the positions
    outside its mask can differ, so every member is put under itself and under each value one such bit away: two
    members at two bits or fewer meet under a common value, and all that meet under a value are at two bits or fewer.
    Each group is linked as a star, so no pairs are formed, and it has 65 members at most, however large the bucket.
    """
    spread = tables(fps.select("fp").distinct(), RADIUS)
    shared = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = spread.join(shared, ["t", "key"])
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    near = F.transform(F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0), lambda b: F.col("fp").bitwiseXOR(b))
    met = members.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("centre"))
    groups = met.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`: component_id is the smallest doc_id reachable over links.

    Fingerprints link at two or fewer differing bits; equal ones, zero included, always do. Lower-casing is A-Z
    only, words are runs of anything but ASCII white space. Repeated rows come out repeated. A null id takes part but
    is never the smallest; a component of null ids alone has a null one. An empty table gives an empty one.
    """
    found = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_links(found), "simhash")
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those that `near_duplicates` groups with another one that stays; all columns are kept.

    Of each group the row with the smallest id stays, rows without an id last, equal ids by a hash of the text; of rows
    equal in id and text any one. Rows are told apart by id and text, so unlike texts under one id or none all
    stay. Texts without words are one group. The keys to leave out are written, so Spark knows their size: a small
    table is broadcast and the texts stay where they are. An empty table gives an empty one.
    """
    of = F.struct(F.isnull(id_col).alias("without"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    found = near_duplicates(docs.select(of.alias("doc_id"), F.col(text_col).alias("text")), words)
    counted = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).select(
        F.col("doc_id").alias("key"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("one_stays"), "n")
    marked = written(counted.where("not one_stays or n > 1"), "left-out")
    rows = docs.select(of.alias("key"), F.struct(*[F.col(c) for c in quoted(docs.columns)]).alias("row"))
    once = rows.join(marked.select("key"), "key", "left_anti").select("row.*")
    repeated = rows.join(marked.where("one_stays").select("key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return once.unionAll(repeated)


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
