"""Best-fit packing of token sequences after dominance reduction.

Lengths are whole numbers up to the capacity, so what decides a packing is the
number of pieces of each length: a table of at most ``capacity`` rows, however
many documents there are. The plan is made from that table alone.

Reduction after Martello and Toth: going through the lengths from the largest,
a small set of pieces that provably dominates every other filling of a sequence
that holds the largest piece is fixed for good, and the instance shrinks:

* a piece with which nothing else fits, alone;
* a pair that fills the sequence exactly, or the largest partner where no two
  pieces fit beside the first one;
* a triple where at most two pieces fit beside the first: the largest partner
  and the largest third, if no smaller half of another pair is larger than it.

What remains is packed best-fit decreasing. Both steps run on (length, count)
classes, so their cost follows the capacity and not the number of documents.
Each plan entry is a range of ranks within a length; pieces find their
sequence by their rank, which is dealt in salted groups.

Defined cases: null text counts as empty (one end token); a document longer
than the capacity is cut so that its first piece is the shorter one; rows that
repeat an id are packed as documents of their own; an empty table gives no
rows; extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode
from functools import lru_cache
from struct import pack as pack_bytes

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.rows import identified, map_columns
from plansift.session import settle

CAPACITY = 2048
END = 0
#: Pieces that one group of a length holds at most while ranks are dealt, about.
RANKED_TOGETHER = 250_000


# ---------------------------------------------------------------- tokens


# The tokenizer's pieces of text, for characters that ``re`` classes as the tokenizer does; a test tries each of them.
LETTER, NUMBER, MARK = r"[^\W\d_²³¹¼-¾]", r"[\d²³¹¼-¾]", r"(?:[^\s\w]|_)"
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?{LETTER}+| ?{NUMBER}+| ?{MARK}+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\u0527\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u3006\u3041-\u3094\u4e00-\u9fa5\U0001f300-\U0001f64f]*")
#: Pieces of text whose ids a task remembers in each of two generations, the longest of them, and places to mark what was seen once.
REMEMBERED, LONGEST, MARKS = 1 << 18, 48, 1 << 22
#: Formats of few ids, made once.
FORMATS = [f"<{k}I" for k in range(32)]


def characters_of_bytes() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return "".join(chr(b if b in seen else 256 + hidden.index(b)) for b in range(256))


class Pieces(dict):
    """Ids, as little-endian bytes, by piece of text; what is not there yet is asked of the tokenizer's model.

    A piece is remembered when it comes a second time, so the many that come
    once take no room. A full generation becomes the old one; what is used
    again moves on.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize, self.characters = tokenizer.model.tokenize, characters_of_bytes()
        self.old, self.seen, self.marked = {}, bytearray(MARKS), 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = [t.id for t in self.tokenize(charmap_decode(piece.encode(), "strict", self.characters)[0])]
            ids = pack_bytes(FORMATS[len(found)] if len(found) < len(FORMATS) else f"<{len(found)}I", *found)
            at = hash(piece) % MARKS
            if not self.seen[at]:
                self.seen[at] = 1
                self.marked += 1
                if 2 * self.marked > MARKS:
                    self.seen, self.marked = bytearray(MARKS), 0
                return ids
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """``encode(text)`` by a tokenizer of the public ones, by name: the ids of ``encode(text, add_special_tokens=False)``.

    The tokenizer splits a text into pieces and merges bytes within a piece, so
    the ids of a piece are asked of its model, which spares what the tokenizer
    does around it, and remembered. Texts that hold a
    special token's string, or characters that the split may class otherwise
    here, go to the tokenizer whole, as do all texts of a tokenizer that is
    not byte-level alone.
    """
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # of other kinds the pieces are not known here
    by_bytes = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel) and not tokenizer.pre_tokenizer.add_prefix_space
    ids_of = Pieces(tokenizer).__getitem__

    def encode(text: str) -> np.ndarray:
        if not by_bytes or any(t in text for t in special) or not PLAIN.fullmatch(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(ids_of, PIECE.findall(text))), dtype="<u4")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end: int = END, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's pieces."""

    def make():
        encode = encoder(vocabulary)
        last = np.array([end], dtype="<u4")

        def work(docs_: list, texts: list) -> tuple:
            out: tuple = tuple([] for _ in range(6 if with_ids else 5))
            for doc, text in zip(docs_, texts, strict=True):
                ids = np.concatenate([encode(text), last])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, x in zip(out, (doc, k, start, length, zlib.crc32(own.tobytes()), own), strict=False):
                        column.append(x)
            return out

        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_columns(identified(docs, id_col, text_col), make, schema)


# ---------------------------------------------------------------- plan


class _Classes:
    """Counts of lengths, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            del self.order[bisect_left(self.order, length)]

    def largest_to(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``most`` of which there is one beside those in ``without``."""
        k = bisect_left(self.order, most + 1) - 1
        while k >= 0 and self.n[self.order[k]] <= without.count(self.order[k]):
            k -= 1
        return self.order[k] if k >= 0 else None

    def smallest(self, k: int, without: tuple[int, ...] = ()) -> list[int]:
        """The k smallest pieces, or fewer, beside those in ``without``."""
        out: list[int] = []
        for x in self.order:
            out += [x] * min(k - len(out), self.n[x] - without.count(x))
            if len(out) == k:
                break
        return out


def dominating(classes: _Classes, first: int, capacity: int) -> tuple[int, ...] | None:
    """A set of up to three pieces with ``first`` that dominates all others with it, or None."""
    room = capacity - first
    small = classes.smallest(3, (first,))
    if not small or small[0] > room:
        return (first,)
    best = classes.largest_to(room, (first,))
    if best == room:  # fills the sequence: whatever else goes beside the first would fit in its place
        return (first, best)
    if len(small) < 2 or small[0] + small[1] > room:  # one more piece at most: the largest of them
        return (first, best)
    if len(small) < 3 or sum(small) > room:
        # two more at most: in any pair that fits, the smaller has half the room at most
        other = classes.largest_to(room - best, (first, best))
        if other is not None and other >= classes.largest_to(room // 2, (first,)):
            return (first, best, other)
    return None


def reduce_classes(classes: _Classes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets until none is found; ``(pieces, times)`` each. Shrinks ``classes``.

    A set is fixed as often at once as its own counts allow: taking pieces away
    only lessens what else fits, so it stays dominating.
    """
    fixed = []
    seen = True
    while seen:
        seen = False
        for first in classes.order[::-1]:
            while first in classes.n and (own := dominating(classes, first, capacity)):
                times = min(classes.n[x] // own.count(x) for x in set(own))
                for x in own:
                    classes.take(x, times)
                fixed.append((own, times))
                seen = True
    return fixed


def best_fit_classes(classes: _Classes, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over classes: ``((length, how many), ...), times``.

    Open sequences with equal content are one class, keyed by the room left.
    """
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(room: int, content: tuple[tuple[int, int], ...], times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append([content, times])

    for length in classes.order[::-1]:
        left = classes.n[length]
        while left:
            k = bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                    left %= each
                if left:
                    put(capacity - left * length, ((length, left),), 1)
                break
            room = order[k]
            content, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                del order[k]
            each = room // length
            whole = min(times, left // each)
            if whole:
                put(room - each * length, (*content, (length, each)), whole)
            left -= whole * each
            if times > whole and left:
                put(room - left * length, (*content, (length, left)), 1)
                left, whole = 0, whole + 1
            if times > whole:
                put(room, content, times - whole)
    return [(content, times) for room in order for content, times in rooms[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, rank, ranks, each, sequence, offset)`` for the pieces of each length.

    A slot gives the ranks from ``rank`` on, ``ranks`` of them, to sequences
    from ``sequence`` on, ``each`` to a sequence, the first at ``offset``.
    """
    classes = _Classes(dict(counts))
    filled = [(tuple((x, own.count(x)) for x in dict.fromkeys(own)), times) for own, times in reduce_classes(classes, capacity)]
    filled += best_fit_classes(classes, capacity)
    rank: dict[int, int] = {}
    slots, sequence = [], 0
    for content, times in filled:
        offset = 0
        for length, each in content:
            slots.append((length, rank.get(length, 0), times * each, each, sequence, offset))
            rank[length] = rank.get(length, 0) + times * each
            offset += each * length
        sequence += times
    return slots


# ---------------------------------------------------------------- pieces to sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    ``pieces`` must be cheap to read again (a written table). The count of
    each length goes to the driver: at most ``capacity`` rows. Ranks within a
    length are dealt in two steps: within salted groups of bounded size, and
    over the sums of the groups before.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    # the salt spreads a length over groups; rows that are alike to it are alike to the packing too
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, capacity), "length long, rank long, ranks long, each long, sequence long, at long"
    )
    salts = max(16, -(-max(counts.values(), default=0) // RANKED_TOGETHER) * 4)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in own if c != "ids"]), F.lit(salts)))
    group = Window.partitionBy("length", "__salt")
    # the groups before: at most capacity x salts rows, summed within a length
    before = (
        salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n"))
        .drop("__n")
    )
    ranked = (
        salted.withColumn("__own", F.row_number().over(group.orderBy(*[c for c in own if c != "ids"])) - 1)
        .join(before, ["length", "__salt"])
        .withColumn("__rank", F.col("__own") + F.col("__before"))
    )
    # a slot for each range of ranks: their number follows the capacity, not the pieces
    inside = (ranked["length"] == slots["length"]) & (ranked["__rank"] >= slots["rank"]) & (ranked["__rank"] < slots["rank"] + slots["ranks"])
    nth = F.col("__rank") - F.col("rank")
    return ranked.join(F.broadcast(slots), inside).select(
        *[ranked[c] for c in own],
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * slots["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` and pack the pieces; the tokens are made once and written."""
    return pack_pieces(settle(token_pieces(docs, capacity, vocabulary, end, with_ids, id_col, text_col), "pieces"), capacity)
