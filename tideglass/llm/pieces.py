"""SentencePiece encoding and decoding by suffix-array matching.

The model is a BPE over pieces that hold white space only at their beginning
and no line end, so no piece crosses from a word into the next: texts are cut
into such units, and the units of a batch that were not met before are written
end to end.  A suffix array over that text (its order needs no more than the
longest piece) is searched for every piece: two binary searches give the range
of all its occurrences.  These edges are put in order of position and length.
Then they are relaxed.  Shortest paths would be right for a unigram model; a
BPE's segmentation is the one that merging leads to, so edges are relaxed in
the order of merges: in every unit the best edge that joins two neighbours is
taken, from the left, wherever it occurs, until none is left; all units at a
time.  Characters without a piece become their bytes.  A unit longer than a
suffix array may be (text without blanks) is indexed in blocks that overlap by
the longest piece, and relaxed as a whole.

Defined results: a null text is the empty text and has no ids; the white-space
sign of the model, where a text holds it itself, decodes to a blank, as in the
library; ids that are not text decode to U+FFFD, a byte each; every repeated
row is encoded; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, bounded_batches, crc_unsigned, documents, sliced, tidy

SIGN = "▁"
#: Characters in one suffix array.
TOGETHER = 300_000

codecs.register_error("tideglass_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A vocabulary, with the words that were encoded before (at most ``most``)."""

    def __init__(self, path: str, most: int = 700_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        self.most, self.known = most, {}
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_id = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SIGN in self.text[i].lstrip(SIGN) or "\n" in self.text[i] for i in usual) or len(self.bytes_id) != 256:
            raise ValueError("pieces must not cross words or lines, and bytes must have ids")
        self.id_of = {self.text[i]: i for i in usual}
        self.raw = [b"" if sp.is_control(i) else self.text[i].replace(SIGN, " ").encode() for i in range(n)]
        self.raw[sp.unk_id()] = " ⁇ ".encode()
        for b, i in self.bytes_id.items():
            self.raw[i] = bytes([b])
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in usual}, reverse=True))}
        self.rank = np.full(n + 1, np.iinfo(np.int32).max, np.int64)
        self.rank[usual] = [order[sp.get_score(i)] for i in usual]
        self.longest = max(len(self.text[i]) for i in usual)
        # characters by their order in pieces; 0 for all others, so that they match nothing
        letters = sorted({ord(c) for i in usual for c in self.text[i]})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        ids = np.array(sorted(usual, key=lambda i: len(self.text[i])))
        self.sizes = np.array([len(self.text[i]) for i in ids])
        rows = np.zeros((2, len(ids), self.longest), ">u2")
        rows[1] = 0xFFFF
        for k, i in enumerate(ids):
            rows[:, k, : self.sizes[k]] = self.letter[[ord(c) for c in self.text[i]]]
        by = np.lexsort(rows[0].T[::-1])
        self.ids, self.sizes = ids[by], self.sizes[by]
        self.low, self.high = (np.ascontiguousarray(r[by]).view(f"S{2 * self.longest}").ravel() for r in rows)
        self.unit = re.compile(f"{SIGN}*[^{SIGN}\n]+|{SIGN}+|\n")

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """The piece at every position (row) of every length (column), or -1, found in suffix arrays of TOGETHER characters and what a piece may reach beyond."""
        n, width = len(codes), self.longest
        letters = np.concatenate([self.letter[codes], np.zeros(width, np.uint16)])
        table = np.full((n, width + 1), -1, np.int32 if len(self.text) > 1 << 15 else np.int16)
        for at in range(0, n, TOGETHER):
            self._found(letters[at : min(n, at + TOGETHER) + width], table[at : at + TOGETHER])
        return table

    def _found(self, letters: np.ndarray, table: np.ndarray) -> None:
        """Put the pieces that begin in ``letters``, but for its last ``longest``, into their rows."""
        n, width = len(table), self.longest
        keys = []
        for at in range(0, width, 4):
            key = np.zeros(n, np.uint64)
            for k in range(at, min(at + 4, width)):
                key = key << np.uint64(16) | letters[k : k + n]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        rows = np.lib.stride_tricks.sliding_window_view(letters, width)[:n][order].astype(">u2")
        suffixes = np.ascontiguousarray(rows).view(f"S{2 * width}").ravel()
        low, high = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        times = high - low
        some = np.flatnonzero(times)
        each = times[some]
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        where = order[np.repeat(low[some], each) + within]
        table[where, np.repeat(self.sizes[some], each)] = np.repeat(self.ids[some], each)

    def merged(self, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols (unit, first, end) that merging leaves, in order.  starts, sizes: the units' characters.

        A round takes each unit's best rank at all its places, from the left and
        without overlap, up to the first that makes a pair as good or better:
        from there on the order of merges could be another.
        """
        unit = np.repeat(np.arange(len(sizes)), sizes)
        first = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        end = first + 1
        none = np.iinfo(np.int32).max
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rank_of(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
            return np.where(same, self.rank[table[a, np.minimum(b - a, self.longest) * (b - a <= self.longest)]], none)

        rank = np.append(rank_of(first[:-1], end[1:], unit[:-1] == unit[1:]), none) if len(unit) else np.zeros(0, np.int64)
        while len(unit):
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            more = best < none
            each = np.diff(np.append(heads, len(unit)))
            if not more.all():
                keep = np.repeat(more, each)
                done.append((unit[~keep], first[~keep], end[~keep]))
                unit, first, end, rank, best, each = unit[keep], first[keep], end[keep], rank[keep], best[more], each[more]
                if not len(unit):
                    break
            at = np.flatnonzero(rank == np.repeat(best, each))
            # of places that overlap (a run of neighbours) every second is taken
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if len(at) > len(each):  # several in a unit: the pair to the left as it will be, to the right as it is
                mine, past = rank[at], np.minimum(at + 2, len(unit) - 1)
                left = np.maximum(at - 1, 0)
                joined = np.concatenate([[False], at[1:] - at[:-1] == 2])
                begin = np.where(joined, first[np.maximum(at - 2, 0)], first[left])
                better = (rank_of(begin, end[at + 1], (at > 0) & (unit[left] == unit[at])) <= mine) | (rank_of(first[at], end[past], (past > at + 1) & (unit[past] == unit[at])) <= mine)
                if better.any():
                    fresh = np.concatenate([[True], unit[at[1:]] != unit[at[:-1]]])
                    before = np.cumsum(better) - better
                    start = np.flatnonzero(fresh)
                    at = at[before == np.repeat(before[start], np.diff(np.append(start, len(at))))]
            end[at] = end[at + 1]
            keep = np.ones(len(unit), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            unit, first, end, rank = unit[keep], first[keep], end[keep], rank[keep]
            for place in (at, at[at > 0] - 1):
                nxt = np.minimum(place + 1, len(unit) - 1)
                rank[place] = rank_of(first[place], end[nxt], (nxt > place) & (unit[place] == unit[nxt]))
        if not done:
            return unit, first, end
        unit, first, end = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((first, unit))
        return unit[order], first[order], end[order]

    def spelt(self, symbol: str) -> list[int]:
        i = self.id_of.get(symbol)
        return [i] if i is not None else [self.bytes_id[b] for b in symbol.encode()]

    def learn(self, units: list[str]) -> None:
        """Units of together about TOGETHER characters, or one that is longer."""
        joined = "\0".join(units) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        table = self.edges(codes)
        unit, first, end = self.merged(table, starts, sizes)
        ids = table[first, end - first].astype("<i4")
        cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        odd = set(unit[ids < 0].tolist())
        raw = ids.tobytes()
        for k, text in enumerate(units):
            if k in odd:
                ends = (end[cuts[k] : cuts[k + 1]] - starts[k]).tolist()
                own = [i for a, b in zip([0, *ends], ends, strict=False) for i in self.spelt(text[a:b])]
                self.known[text] = np.array(own, "<i4").tobytes()
            else:
                self.known[text] = raw[4 * cuts[k] : 4 * cuts[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of every text as little-endian 32-bit numbers."""
        parts = [self.unit.findall(SIGN + t.replace(" ", SIGN)) if t else [] for t in texts]
        wanted = set().union(*parts)
        new = [u for u in wanted if u not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(wanted)
        block: list[str] = []
        size = 0
        for u in new:
            if block and size + len(u) >= TOGETHER:
                self.learn(block)
                block, size = [], 0
            block.append(u)
            size += len(u) + 1
        if block:
            self.learn(block)
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes | list[int] | np.ndarray) -> str:
        values = np.frombuffer(ids, "<i4").tolist() if isinstance(ids, bytes) else ids
        text = b"".join(map(self.raw.__getitem__, values)).decode("utf-8", "tideglass_bytes")
        first = next((i for i in values if self.raw[i]), None)
        return text[1:] if first is not None and self.text[first].startswith(SIGN) else text


_MODELS: dict[str, Pieces] = {}


def _drop_units() -> None:
    for x in _MODELS.values():
        x.known = {}


KEPT.append(_drop_units)


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = model(path).encode([x or "" for x in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids."""
    bounded_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([model(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), f"doc_id {kind}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions at once, so that ids need not leave their task: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip."""
    bounded_batches(spark)
    path, docs = default_model(), documents(spark, sf_dir)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pieces = model(path)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = pieces.encode(texts)
            back = [pieces.decode(x) for x in found]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array(list(map(crc_unsigned, found)), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
