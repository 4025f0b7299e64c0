"""SimHash near-deduplication by covering with anchor points.

A fingerprint has a bit set where over half of the text's shingle hashes have
it. Fingerprints that differ in few bits are found through anchors: codewords
of a covering code. Here the code is the product of two perfect binary Golay
codes over 46 of the 64 bits (covering radius 3 in each part; 2**24 anchors).
Each fingerprint has one home, the anchor within the covering radius; copies of
it go to every anchor within radius plus threshold, where a fingerprint that
differs in no more than the threshold must have its home. At an anchor, those
at home are compared with the copies that came, over all 64 bits.

Equal fingerprints are one before this, so thousands of copies of a text cost
one row; and no fingerprint has more than 2,080 others within two bits.

Defined cases: null counts as the empty text; a text of fewer words than a
shingle is one shingle of all its words; texts without words have fingerprint
zero and are linked like any other; rows that repeat an id are rows of their
own; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.rows import identified, map_columns, mark_of, only_kept
from plansift.operators.graph import connected_components
from plansift.session import settle

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
THRESHOLD = 2
#: The Golay code: its length, check bits, covering radius and generator polynomial.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101
#: Where the two parts of the code lie in the fingerprint.
PARTS = (0, 23)
#: Shingles whose bits are counted at once; bounds memory for long texts.
CHUNK = 1 << 14


def simhash(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    # bytes.lower() changes A-Z alone and bytes.split() parts at the six ASCII spaces
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    k = min(words, len(own))
    starts = [0, *ends[: len(own) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=len(stops))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, mark, fp``: a hash of the text, and the fingerprint's bits in a signed long."""

    def make():
        def work(ids: list, texts: list, marks: list) -> tuple:
            return ids, marks, np.array([simhash(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64)

        return work

    return map_columns(identified(docs, id_col, text_col).withColumn("mark", mark_of("text")), make, "doc_id long, mark long, fp long")


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    """The remainder by the generator polynomial of each of the 23-bit words."""
    words = np.arange(1 << LENGTH, dtype=np.uint32)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        words ^= np.where((words >> bit) & 1, np.uint32(GENERATOR << (bit - CHECKS)), np.uint32(0)).astype(np.uint32)
    return words.astype(np.uint16)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of some words only; a shift register over whole arrays."""
    words = words.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        words = words ^ (((words >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECKS)))
    return words


@lru_cache(maxsize=4)
def _ways(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the patterns that lead to a codeword within the radius plus the threshold.

    Returns patterns and, beside each, by how much it goes beyond the radius;
    rows of one length, filled up with patterns of an excess that never counts.
    """
    patterns = [0]
    for weight in range(1, RADIUS + threshold + 1):
        patterns += [sum(1 << i for i in c) for c in combinations(range(LENGTH), weight)]
    p = np.array(patterns, dtype=np.uint32)
    weight = np.array([x.bit_count() for x in patterns])
    s = _syndrome(p)
    order = np.lexsort((weight, s))
    p, weight, s = p[order], weight[order], s[order]
    count = np.bincount(s, minlength=1 << CHECKS)
    wide = int(count.max())
    out = np.zeros((1 << CHECKS, wide), dtype=np.uint32)
    beyond = np.full((1 << CHECKS, wide), threshold + 1, dtype=np.int64)
    column = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    out[s, column] = p
    beyond[s, column] = np.maximum(weight - RADIUS, 0)
    return out, beyond


def anchors_of(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, anchor, home`` for unsigned fingerprints: every anchor within reach, and whether it is the home."""
    ways, beyond = _ways(threshold)
    mask = np.uint64((1 << LENGTH) - 1)
    sides = []
    for at in PARTS:
        part = ((fps >> np.uint64(at)) & mask).astype(np.uint32)
        s = _syndrome(part)
        sides.append(((part[:, None] ^ ways[s]).astype(np.uint64), beyond[s]))
    (one, far_one), (two, far_two) = sides
    within = far_one[:, :, None] + far_two[:, None, :] <= threshold
    row, i, j = np.nonzero(within)
    anchor = one[row, i] | (two[row, j] << np.uint64(LENGTH))
    return row, anchor.astype(np.int64), (far_one[row, i] + far_two[row, j]) == 0


def anchored(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``fp, anchor, home`` for a table of different fingerprints ``fp``."""

    def make():
        def work(own: list) -> tuple:
            given = np.array(own, dtype=np.int64)
            parts = [anchors_of(given[k : k + 512].view(np.uint64), threshold) for k in range(0, len(given), 512)]
            rows = np.concatenate([p[0] + 512 * k for k, p in enumerate(parts)]) if parts else np.zeros(0, dtype=np.int64)
            return given[rows], np.concatenate([p[1] for p in parts] or [[]]), np.concatenate([p[2] for p in parts] or [[]]).astype(bool)

        return work

    return map_columns(fps.select("fp"), make, "fp long, anchor long, home boolean")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b`` (a < b): the different fingerprints that differ in ``threshold`` bits or fewer.

    A fingerprint has one home, so each pair is found once from each side and
    the order keeps one of the two.
    """
    placed = settle(anchored(fps, threshold), "anchored")
    at_home = placed.filter("home").select(F.col("fp").alias("a"), "anchor")
    came = placed.select(F.col("fp").alias("b"), "anchor")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return at_home.join(came.hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & near).select("a", "b")


def near_components(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, fp, component_id, root`` for every row: the least id that links lead to, and a name of the component.

    Null ids are never the least; a component of rows without ids has none.
    """
    own = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    least = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    found = connected_components(links(least, threshold))
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(rooted.join(roots, "root").select("fp", "component_id", "root"), "classes")
    return own.join(classes.hint("merge"), "fp").select("doc_id", "mark", "fp", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were.

    The row with the least id stays, of rows that share that id the one whose
    text has the least hash, and of rows alike in both any one. Rows without an
    id come after all others.
    """
    return representatives(docs, near_components(docs, threshold, id_col, text_col), id_col, text_col)


def representatives(docs: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` keeps, by their ``doc_id, mark, root``."""
    found = settle(components.select("doc_id", "mark", "root"), "components")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("own"))
    stay = settle(found.groupBy("root").agg(F.min(row).alias("stay")), "representatives")
    verdict = found.join(stay.hint("merge"), "root").select("doc_id", "mark", F.col("doc_id").eqNullSafe(F.col("stay.id")) & (F.col("mark") == F.col("stay.own")))
    return only_kept(docs, verdict.toDF("doc_id", "mark", "kept"), id_col, mark_of(text_col))
