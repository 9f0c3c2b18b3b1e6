"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Tokenising is a narrow map over Arrow batches. In the tokenizer's pipeline no rule reaches over a space (it drops white
space and splits there), nor from an ASCII letter to an ASCII character that is none, and case is dropped; so each
distinct such part is encoded once by the tokenizer and its ids are reused. What comes out is what encoding the whole
text gives. A document is its ids and the end id; only longer ones are cut.

Equal pieces are counted; pieces, equal ones in lots of 256, are dealt by a digest to groups of about 8,192, whose number follows the bytes of text; full pieces are sequences
already. A group is packed by best fit in decreasing order. Then local search moves a document from an emptier bin to
a fuller one with room, or exchanges one for a shorter one, two for one, or one for two, whenever that increases the
sum of squared fills, and so drains the emptiest bins until some are empty. The search is bounded and may stop while steps
are left: it goes through the bins once, emptiest first, and ends after 64 in a row that could not be emptied or after
20 steps a piece; of a place it offers two items for exchange only if the second is among the 8 after the first in the
bin; it sends two items out only from among the 6 longest of a bin; and of the places of one size that are up to date but
of no use it looks at about 32. No piece is lost by that, but there may be some more sequences than a full search leaves;
how many, on groups of many short pieces, is not measured.

Defined results: null and empty texts are one piece holding the end id; repeated rows are packed once each; rows with
equal ids and different texts keep their pieces apart by digest; only id and text are read, whatever other columns are
called; a very long text is encoded with some 20 bytes of memory a byte; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import lean, spread, table

CAPACITY = 2048
END_ID = 0
GROUP = 8192
ALIKE = 256
CACHE_WORDS = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes with ASCII letters in lower case, and before which bytes words may be split. A letter before a byte
    beyond ASCII keeps its case, as it may be composed with a mark before its case is dropped; a block in which a
    special token may stand is left as it is, as those are found before anything else."""
    if not len(data) or b"<|" in data.tobytes():
        return data, None
    after = np.append(data[1:], np.uint8(0))
    lower = np.where((data >= 65) & (data <= 90) & (after < 128), data + np.uint8(32), data)
    split = np.zeros(len(data), bool)
    split[1:] = LETTER[data[:-1]] & ~LETTER[data[1:]] & (data[1:] < 128)
    return lower, split


#: The rules of a tokenizer that works within what ``parts`` makes.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None, "padding": None,
}


class WordIds:
    """Token ids of words, kept in flat arrays; forgets all when it holds too many. Words are told apart by 64-bit hashes, as
    good as random for words of up to 512 bytes and cryptographic for longer ones. With a tokenizer of other rules whole texts
    are encoded."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.by_word = all(found.get(k) == v for k, v in RULES.items())
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, V.U), np.zeros(0, np.int32)  # hashes, ascending, and numbers of their words
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, hashes: np.ndarray, words: list[str], together: int = 512) -> None:
        """Encodes words, many in one text, and tells them apart by where each token stands in it."""
        turn = np.argsort(hashes, kind="stable")
        where = np.searchsorted(self.keys, hashes[turn])
        self.keys = np.insert(self.keys, where, hashes[turn])
        self.place = np.insert(self.place, where, (self.n + turn).astype(np.int32))
        for i in range(0, len(words), together):
            part = words[i : i + together]
            begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in part])))
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            of = np.searchsorted(begin, [x for x, _ in e.offsets], "right") - 1
            count = np.bincount(of, minlength=len(part))
            z = self.at[self.n] + len(e.ids)
            while z > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
            while self.n + len(part) + 1 > len(self.at):
                self.at = np.concatenate((self.at, np.zeros(len(self.at), np.int64)))
            self.ids[self.at[self.n] : z] = e.ids
            self.at[self.n + 1 : self.n + len(part) + 1] = self.at[self.n] + np.cumsum(count)
            self.n += len(part)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 of those that are not kept."""
        if not self.n:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.place[at].astype(np.int64), -1)

    def encode(self, b: V.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's documents one after the other, and where each document's begin."""
        if not self.by_word:
            each = [self.tokenizer.encode(b.data[x:y].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for x, y in zip(b.at[:-1], b.at[1:], strict=True)]
            return np.fromiter((i for ids in each for i in ids), np.uint32), np.concatenate(([0], np.cumsum([len(ids) for ids in each])))
        data, split = parts(b.data)
        w = V.words(b, data, split=split)
        codes, distinct = pd.factorize(w.hash)
        if self.n + len(distinct) > CACHE_WORDS:
            self.clear()
        known = self.known(distinct)
        if len(new := np.flatnonzero(known < 0)):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            known[new] = self.n + np.arange(len(new))
            self.add(distinct[new], [raw[x:y].decode("utf-8", "replace") for x, y in zip(w.begin[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
        place = known[codes] if len(codes) else np.zeros(0, np.int64)
        start, n = self.at[place], self.at[place + 1] - self.at[place]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(start - total[:-1], n) + np.arange(total[-1])]
        return ids, total[w.at]


_encoders: dict[str, WordIds] = {}


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordIds(tokenizer_path)
        for batch in batches:
            for b in V.blocks(batch.column(1)):
                flat, at = _encoders[tokenizer_path].encode(b)
                rows: list[list] = [[], [], [], [], []]
                for doc, doc_id in enumerate(batch.column(0).slice(b.first, b.docs).to_pylist()):
                    ids = np.append(flat[at[doc] : at[doc + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, x in zip(rows, (doc_id, piece, start, len(part), part.tobytes()), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, into the fullest bin with room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)
    sizes: list[int] = []  # rooms that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(sizes, lengths[i])
        if k == len(sizes):
            bins.append([i])
            b, left = len(bins) - 1, capacity - lengths[i]
        else:
            size = sizes[k]
            b = room[size].pop()
            if not room[size]:
                sizes.pop(k)
            bins[b].append(i)
            left = size - lengths[i]
        if left:
            if not room[left]:
                insort(sizes, left)
            room[left].append(b)
    return bins


def drain(bins: list[list[int]], lengths: list[int], capacity: int, steps: int | None = None) -> list[list[int]]:
    """Local search over underfull bins. Every step takes length from an emptier bin to a fuller one."""
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    bins = [list(b) for b in bins if sum(lengths[i] for i in b) < capacity]
    fill = [sum(lengths[i] for i in b) for b in bins]
    # fits[k]: (bin, items) such that what is k long can take those items' place there; no items: a move
    fits: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]

    def offer(b: int) -> None:
        gap = capacity - fill[b]
        fits[gap].append((b, ()))
        for x, i in enumerate(bins[b]):
            fits[lengths[i] + gap].append((b, (i,)))
            for j in bins[b][x + 1 : x + 9]:
                fits[lengths[i] + lengths[j] + gap].append((b, (i, j)))

    def take(out: tuple[int, ...], donor: int) -> bool:
        """Sends items out of donor to the place that they fill best."""
        size = sum(lengths[i] for i in out)
        for k in range(size, capacity + 1):
            spot = fits[k]
            for at in range(len(spot) - 1, -1, -1):
                b, back = spot[at]
                inside = sum(lengths[i] for i in back)
                if not bins[b] or fill[b] == capacity or not all(i in bins[b] for i in back) or inside + capacity - fill[b] != k:
                    spot.pop(at)  # out of date
                    continue
                gain = size - inside
                if b == donor or gain <= 0 or len(out) + len(back) > 3 or fill[b] + gain <= fill[donor]:
                    if len(spot) - at > 32:
                        break
                    continue
                for i in out:
                    bins[donor].remove(i)
                for i in back:
                    bins[b].remove(i)
                bins[b] += out
                bins[donor] += back
                fill[b] += gain
                fill[donor] -= gain
                offer(b)
                offer(donor)
                return True
        return False

    for b in range(len(bins)):
        offer(b)
    left = 20 * len(lengths) if steps is None else steps
    stuck = 0
    for donor in sorted(range(len(bins)), key=lambda b: fill[b]):
        moved = bool(bins[donor])
        while moved and bins[donor] and left > 0:
            own = sorted(bins[donor], key=lambda i: -lengths[i])
            moved = any(take((i,), donor) for i in own) or any(take((own[x], own[y]), donor) for x in range(min(len(own), 6)) for y in range(x + 1, min(len(own), 6)))
            left -= 1
        stuck = 0 if not bins[donor] else stuck + 1
        if left <= 0 or stuck >= 64:
            break
    return full + [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item."""
    bins = best_fit(lengths, capacity)
    if len(bins) > -(-sum(lengths) // capacity):
        bins = min(drain(bins, lengths, capacity), bins, key=len)
    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        offset = 0
        for i in items:
            of[i], at[i] = b, offset
            offset += lengths[i]
    return of, at


def pack(pieces: DataFrame, expected: int, capacity: int = CAPACITY, group: int = GROUP, alike: int = ALIKE) -> DataFrame:
    """pieces (doc_id, piece, start, length, and others) with sequence_id and offset. expected: about how many there are. Equal
    pieces are counted first and dealt in lots of ``alike``, so any number of them spreads over the groups."""
    groups = spread(expected, group)
    names = pieces.columns
    others = [c for c in names if c not in ("doc_id", "piece", "start", "length")]
    p = pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("pack_times"))
    p = p.withColumn("pack_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pack_times") - 1) / alike).cast("long"))))
    p = p.withColumn("pack_times", F.least(F.lit(alike), F.col("pack_times") - F.col("pack_lot") * alike)).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", *others, "pack_lot"), F.lit(groups)))
    out = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", *others, "pack_lot"], ascending=[False] + [True] * (3 + len(others)), kind="stable", ignore_index=True)
        rows = rows.loc[rows.index.repeat(rows["pack_times"])].reset_index(drop=True)
        of, at = pack_lengths(rows["length"].tolist(), capacity)
        return rows[names].assign(sequence_id=of + (int(key[0]) << 32), offset=at)

    return p.groupBy("pack_group").applyInPandas(run, out)


def expected_pieces(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY) -> int:
    """One piece a document and one for each so many bytes; a token has three bytes or so."""
    n, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return n + size // (3 * capacity)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenise(docs, tokenizer_path or tokenizer_file())
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), expected_pieces(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
