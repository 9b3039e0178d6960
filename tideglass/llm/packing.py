"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token sequences closed by an end id; only those longer than
a sequence are cut.  Which documents share a sequence depends on nothing but
their lengths, and there are no more lengths than ``capacity``: so the driver
solves the instance on a histogram (capacity rows at any input size), class by
class with multiplicities, and the answer is a table of slots, bounded by the
capacity too.  Executors then give each piece its place by its rank among the
pieces of its length: rank within its slab (a task of the first pass) plus the
count in earlier slabs.  No task sees more than a slab or the list of slabs.

Reduction, largest class L with room r = capacity - L first.  A set holding L
is fixed for good where it dominates every other set that could hold L:
nothing else fits (alone); some class equals r (exact pair); two more never
fit (L with the largest that fits); two more fit but not three, and a pair
(p, q) exists with p the largest that fits, q the largest beside it and no
smaller than any class of half the room or less.  The remainder goes best-fit
decreasing, into the fullest sequence that has room.

Defined results: a null text is the empty text, one end id long; repeated rows
and ids are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, bounded_batches, crc_unsigned, documents, sliced, text_bytes, tidy, written

CAPACITY, END_ID = 2048, 0
# Fixed value: the split of a tokenizer whose units WordTokens knows.
WORD_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokens(dict):
    """White-space-free piece of text -> its ids as little-endian unsigned 32-bit bytes, by the ``tokenizers`` library.

    A tokenizer that lower-cases, drops white space and never merges across it
    gives a text the ids of its words, end to end.  Most words are marks, Latin
    letters, marks: after lower-casing each run is one unit for the library's
    model, and units are kept too.  All others, and those that hold the text of
    an added token, go through the whole tokenizer.  ``most`` bounds the words
    kept.  Whether the file is such a tokenizer is read from it; if it is not,
    every text goes through the library as a whole.
    """

    MARKS = "[!-&(-/:-@\\[-`{-~]*"
    SIMPLE = re.compile(f"({MARKS})([a-z\u00df-\u00f6\u00f8-\u00ff]*)({MARKS})")
    LETTERS = _byte_letters()

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in told["added_tokens"]) or b"(?!)")
        self.by_word = self._by_word(told)
        self.tokenize = self.tokenizer.model.tokenize
        self.units: dict[str, bytes] = {"": b""}

    @staticmethod
    def _by_word(told: dict) -> bool:
        """Whether a text's ids are those of its words: normaliser, split and added tokens as this class assumes them."""
        norms = (told["normalizer"] or {}).get("normalizers", [])
        pre = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split, white = pre[0], [x for x in norms if x["type"] == "Replace"]
        return (
            [x["type"] for x in norms] == ["NFC", "Replace", "Lowercase"]
            and (white[0]["pattern"], white[0]["content"]) == ({"Regex": "\\s+"}, " ")
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
            and (split["pattern"], split["behavior"], split["invert"]) == (WORD_SPLIT, "Removed", True)
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and told["model"]["type"] == "BPE"
            and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or len(x["content"].split()) != 1 or x["content"] != x["content"].strip() or x["content"].rstrip(".,!?;:|").isalpha() for x in told["added_tokens"])
        )

    def unit(self, text: str) -> bytes:
        got = self.units.get(text)
        if got is None:
            if len(self.units) >= self.most:
                self.units = {"": b""}
            letters = text if text.isascii() else "".join([self.LETTERS[b] for b in text.encode()])
            got = self.units[text] = array("I", [x.id for x in self.tokenize(letters)]).tobytes()
        return got

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode().lower()
        core = text.rstrip(".,!?;:|")
        if core.isascii() and core.isalpha():  # no added token is made of these alone
            got = self.unit(core) + self.unit(text[len(core) :])
        elif not self.added.search(word) and (found := self.SIMPLE.fullmatch(text)):
            got = b"".join(map(self.unit, found.groups()))
        else:
            got = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self[word] = got
        return got

    def ids(self, text: bytes) -> bytes:
        if not self.by_word:
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_TOKENS: dict[str, WordTokens] = {}


def _drop_words() -> None:
    for x in _TOKENS.values():
        x.clear()
        x.units = {"": b""}


KEPT.append(_drop_words)


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, slab, nth (rank among its slab's pieces of this length), and ids if asked for."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slab int, nth long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, slab, seen = word_tokens(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in sliced(batches):
            rows: list[tuple] = []
            held: list[bytes] = []
            for k, raw in enumerate(map(tokens.ids, text_bytes(batch.column(1)))):
                raw += end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((k, i, at // 4, n, crc_unsigned(part), seen[n]))
                    seen[n] += 1
                    if with_ids:
                        held.append(part)
            k, i, start, n, crc, nth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            out = [batch.column(0).take(pa.array(k)), pa.array(i.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc), pa.array(np.full(len(k), slab, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slab", "nth"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


#: A pattern: lengths with repeats, in order of their offsets, and the number of sequences filled so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets that provably dominate all alternatives, and what is left.  counts: pieces of each length."""
    left = {x: n for x, n in counts.items() if n > 0}
    order = sorted(left)
    fixed: list[Pattern] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((tuple(Counter(lengths).items()), times))
        for x, n in Counter(lengths).items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
                order.pop(bisect_left(order, x))

    def fits(room: int, without: Counter) -> int:
        """The largest class of at most ``room`` with a piece besides those in ``without``; 0 if none."""
        at = bisect_left(order, room + 1) - 1
        while at >= 0 and left[order[at]] <= without[order[at]]:
            at -= 1
        return order[at] if at >= 0 else 0

    for big in sorted(left, reverse=True):
        while left.get(big, 0):
            room = capacity - big
            one = fits(room, Counter([big]))
            if not one:
                take((big,), left[big] if big * 2 > capacity else 1)
                continue
            both = lambda *x: min(left[y] // n for y, n in Counter(x).items())
            if one == room:
                take((big, one), both(big, one))
                continue
            smallest = [x for x in order[:4] for _ in range(min(3, left[x] - (x == big)))][:3]
            if len(smallest) < 2 or smallest[0] + smallest[1] > room:
                take((big, one), both(big, one))
                continue
            if len(smallest) < 3 or sum(smallest) > room:
                two = fits(room - one, Counter([big, one]))
                half = fits(room // 2, Counter([big]))
                if two and two >= half:
                    take((big, one, two), both(big, one, two))
                    continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over classes: each class goes to the fullest sequences that have room."""
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), n
            each = room // size
            full = min(times, n // each)
            put(room - each * size, (*pattern, (size, each)), full)
            n -= full * each
            times -= full
            if n and times and n < each:
                put(room - n * size, (*pattern, (size, n)), 1)
                n, times = 0, times - 1
            if room < capacity:
                put(room, pattern, times)
    return [x for room in rooms for x in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces in each sequence, first sequence, offset), by rank."""
    used: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.setdefault(size, []).append((used[size], each, sequence, offset))
            used[size] += each * times
            offset += each * size
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack_pieces(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A written table of pieces() with sequence_id and offset."""
    by_slab = table.groupBy("length", "slab").agg(F.count(F.lit(1)).alias("n"))
    earlier = by_slab.select("length", "slab", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    counts = {r.length: r.n for r in by_slab.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = slots(plan(counts, capacity))
    kept = [f for f in table.schema.fields if f.name not in ("slab", "nth")]
    schema = table.select(*[f.name for f in kept]).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                of = places[int(length[part[0]])]
                row = of[np.searchsorted(of[:, 0], rank[part], "right") - 1]
                nth = rank[part] - row[:, 0]
                sequence[part] = row[:, 2] + nth // row[:, 1]
                offset[part] = row[:, 3] + nth % row[:, 1] * length[part]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(sequence), pa.array(offset)], names=[*(f.name for f in kept), "sequence_id", "offset"])

    ranked = table.join(earlier, ["length", "slab"]).select(*[f.name for f in kept], (F.col("earlier") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack_pieces(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
