"""Token ids of a corpus as independently decodable, entropy-coded blocks.

Format: a folder with three Parquet tables.

* ``blocks``: ``shard, block`` (position in id order), ``doc_ids``, ``lengths``, ``n_tokens``,
  ``payload`` (the coder's 32-bit words, little-endian), ``checkpoints`` (64-bit words; see
  ``rans``) and ``crc32`` of the ids as little-endian unsigned 32-bit integers. A block holds whole
  documents and needs no other block.
* ``frequencies``: ``token, freq``, the one table that all blocks share; the sum is a power of two.
* ``layout``: one row with ``lanes, stride, precision, end_id``.

Documents are in ascending id order over (shard, block, place in block); null ids come first and
equal ids are ordered by their tokens. Null text counts as empty: such a document has only the end
id. An empty corpus gives tables without rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, stage
from . import kernel as K
from . import rans

BLOCK_TOKENS = 1 << 18
#: Places for known pieces in a Python worker, and ids kept for them (56 MB together, whatever the input).
CACHE_SLOTS = 1 << 21
CACHE_IDS = 1 << 22
_SLICE = 1 << 19

#: Byte classes within words: letters (A-Z, a-z, Latin-1 letters in two bytes), marks that split off, others.
_LETTER, _MARK, _OTHER = 0, 1, 2
_BYTE = np.full(256, _OTHER, np.uint8)
_BYTE[65:91] = _BYTE[97:123] = _LETTER
_BYTE[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41)]] = _MARK


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte, and the bytes with letters lowered."""
    kind, low = _BYTE[data], K.lowered(data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letter = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
    kind[letter] = kind[letter + 1] = _LETTER
    capital = letter[data[letter + 1] <= 0x9E]
    low[capital + 1] += 0x20
    return kind, low


class _Pieces:
    """Ids of known pieces by hash, in memory of fixed size.

    A hash has one place; a newer piece takes it over. The ids lie in a ring, where new ones replace the
    oldest, so old pieces are forgotten one by one and learnt again if they return.
    """

    def __init__(self, slots: int, ids: int):
        self.keys = np.zeros(slots, np.uint64)
        self.begin = np.full(slots, -ids, np.int64)  # in all ids ever kept
        self.length = np.zeros(slots, np.int32)
        self.ring = np.zeros(ids, np.uint32)
        self.end = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each piece is known, and where its ids begin and how many they are."""
        slot = (hashes & np.uint64(len(self.keys) - 1)).astype(np.intp)
        begin = self.begin[slot]
        return (self.keys[slot] == hashes) & (begin >= self.end - len(self.ring)), begin, self.length[slot].astype(np.int64)

    def ids(self, places: np.ndarray) -> np.ndarray:
        return self.ring[places & (len(self.ring) - 1)]

    def add(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        begin = self.end + np.cumsum(length) - length
        slot = (hashes & np.uint64(len(self.keys) - 1)).astype(np.intp)
        self.keys[slot], self.begin[slot], self.length[slot] = hashes, begin, length
        kept = flat[-len(self.ring) :]
        self.end += len(flat)
        self.ring[(self.end - len(kept) + np.arange(len(kept))) & (len(self.ring) - 1)] = kept


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges of ``length`` from ``begin``, one range after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Encoder:
    """Ids of texts by one tokenizer file.

    Where the tokenizer drops white space and splits letters from marks, each distinct run of letters
    or marks is encoded once and kept; the ids are the same as of the whole text. Other tokenizers get
    whole texts.
    """

    def __init__(self, path: str, slots: int = CACHE_SLOTS, ids: int = CACHE_IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.by_word = _drops_space(config)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        suffix = config["model"].get("end_of_word_suffix") or "\0"
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(suffix)
        self.known = _Pieces(slots, ids)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has. Runs of letters go many to a call: each ends with its only end-of-word token."""
        parts: list[np.ndarray] = [None] * len(pieces)
        plain = np.flatnonzero(letters).tolist()
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        coded = self._batch([" ".join([pieces[k] for k in g]) for g in groups])
        for group, ids in zip(groups, coded, strict=True):
            flat = np.array(ids, np.uint32)
            cuts = [0, *(np.flatnonzero(self.ends[flat]) + 1).tolist()]
            if len(cuts) == len(group) + 1 and cuts[-1] == len(flat):
                split = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                split = [np.array(x, np.uint32) for x in self._batch([pieces[k] for k in group])]
            for k, part in zip(group, split, strict=True):
                parts[k] = part
        other = np.flatnonzero(~letters).tolist()
        for k, ids in zip(other, self._batch([pieces[k] for k in other]), strict=True):
            parts[k] = np.array(ids, np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, text: K.Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's documents in order, and how many each document has."""
        if not self.by_word:
            raw = text.data.tobytes()
            coded = self._batch([raw[a:b].decode() for a, b in zip(text.offsets[:-1], text.offsets[1:], strict=True)])
            return np.array([x for ids in coded for x in ids], np.uint32), np.array([len(x) for x in coded], np.int64)
        w = K.words(text)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(text), np.int64)
        kind, low = _classes(text.data)
        # A word of letters and then marks splits between them; any other word is one piece.
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        letters, change = sums(kind == _LETTER), sums(kind[1:] != kind[:-1])
        plain = (kind[w.start] == _LETTER) & (kind[w.end - 1] != _OTHER) & (change[w.end - 1] - change[w.start] <= 1)
        cut = np.where(plain, w.start + letters[w.end] - letters[w.start], w.end)
        tailed = cut < w.end
        first = np.cumsum(1 + tailed) - 1 - tailed
        tail = first[tailed] + 1
        n = len(w) + len(tail)
        start, end, lower, letter = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
        start[first], end[first], lower[first], letter[first] = w.start, cut, plain, plain
        start[tail], end[tail] = cut[tailed], w.end[tailed]
        hashes = np.empty(n, np.uint64)
        hashes[lower] = K.range_hashes(low, start[lower], end[lower], 1)
        if not lower.all():
            hashes[~lower] = K.range_hashes(text.data, start[~lower], end[~lower])
        hit, begin, each = self.known.find(hashes)
        miss = np.flatnonzero(~hit)
        if len(miss):
            keys, at, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[at]
            raw, lowered = text.data.tobytes(), low.tobytes()
            pieces = [(lowered if p else raw)[a:b].decode() for a, b, p in zip(start[at].tolist(), end[at].tolist(), lower[at].tolist(), strict=True)]
            flat, length = self._learn(pieces, letter[at])
            begin[miss], each[miss] = (np.cumsum(length) - length)[which], length[which]
        out = np.empty(int(each.sum()), np.uint32)
        if len(miss):
            new = np.repeat(~hit, each)
            out[new] = flat[_spread(begin[miss], each[miss])]
            out[~new] = self.known.ids(_spread(begin[hit], each[hit]))
            self.known.add(keys, flat, length)
        else:
            out[:] = self.known.ids(_spread(begin, each))
        per_piece = np.concatenate([[0], np.cumsum(each)])
        return out, np.diff(per_piece[np.append(first, n)[w.first]])


def _drops_space(config: dict) -> bool:
    """True where white space only separates: it is normalised to one space, then dropped by the splitter."""
    norm, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in norm.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    allowed = {("NFC", None, None), ("Replace", "\\s+", " "), ("Lowercase", None, None)}
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    expected = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    no_prefix = all(not x.get("add_prefix_space") for x in pre.get("pretokenizers", []))
    no_strip = not any(x.get("lstrip") or x.get("rstrip") for x in config.get("added_tokens", []))
    return (
        splits and no_prefix and no_strip and set(steps) == allowed
        and (first.get("pattern") or {}).get("Regex") == expected
        and bool(config["model"].get("end_of_word_suffix"))
    )


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pack(ids: np.ndarray) -> bytes:
    """A byte for the width, then the ids' bytes by significance, compressed."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = ids.astype(f"<u{width}").reshape(-1, 1).view(np.uint8).T
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    flat = np.frombuffer(pa.decompress(raw[1:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(f"<u{width}").reshape(n)


def _tokenise(path: str, end_id: int):
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for text in K.slices(batch.column(1), _SLICE):
                ids, n = encoder.encode(text)
                full = np.empty(len(ids) + len(n), np.uint32)
                ends = np.cumsum(n + 1)
                inner = np.ones(len(full), bool)
                inner[ends - 1] = False
                full[inner], full[~inner] = ids, end_id
                packed = [_pack(full[b - k : b]) for b, k in zip(ends.tolist(), (n + 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(text.first, len(text)), pa.array(n + 1), pa.array(packed, pa.binary())], names=["doc_id", "n", "ids"]
                )

    return run


def _histogram(batches):
    counts = np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def add():
        nonlocal counts
        have = np.bincount(np.concatenate(held))
        size = max(len(have), len(counts))
        counts = np.pad(counts, (0, size - len(counts))) + np.pad(have, (0, size - len(have)))
        held.clear()

    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(_unpack(raw, n))
            if len(held) == 256:
                add()
    if held:
        add()
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["token", "n"])


_BLOCK = "shard int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary, checkpoints binary, crc32 long"


def _blocks(freq, limit: int):
    def run(batches):
        t = rans.Table(freq.value.astype(np.uint64), (np.cumsum(freq.value) - freq.value).astype(np.uint64), None)
        shard, number = TaskContext.get().partitionId(), 0
        ids: list = []
        docs: list = []

        def close():
            nonlocal number
            flat = np.concatenate(ids)
            words, marks = rans.encode(flat, t)
            row = [[shard], [number], [docs.copy()], [[len(x) for x in ids]], [len(flat)], [words.astype("<u4").tobytes()], [marks.astype("<u8").tobytes()], [zlib.crc32(flat.astype("<u4").tobytes())]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            names = ["shard", "block", "doc_ids", "lengths", "n_tokens", "payload", "checkpoints", "crc32"]
            number += 1
            ids.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(_unpack(raw, n))
                docs.append(doc)
                held += n
                if held >= limit:
                    yield close()
                    held = 0
        if ids:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode every text of ``docs`` with the tokenizer file and write the format to ``path``."""
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    coded = stage(given.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, n long, ids binary"), "token-ids")
    counts = coded.select("n", "ids").mapInArrow(_histogram, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    tokens, n = counts["token"].to_numpy(), counts["n"].to_numpy()
    dense = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, np.int64)
    dense[tokens] = n
    freq = rans.quantised(dense)
    used = [(int(t), int(freq[t])) for t in np.flatnonzero(freq)]
    spark.createDataFrame(used, "token int, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    layout = [(rans.LANES, rans.STRIDE, rans.PRECISION, end_id)]
    spark.createDataFrame(layout, "lanes int, stride int, precision int, end_id int").coalesce(1).write.parquet(f"{path}/layout")
    shared = spark.sparkContext.broadcast(freq)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    dealt.mapInArrow(_blocks(shared, block_tokens), _BLOCK).write.parquet(f"{path}/blocks")
    discard(coded)


def _documents(freq, layout, with_ids: bool):
    def run(batches):
        t = rans.table(freq.value)
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["payload"], "<u4")
                marks = np.frombuffer(row["checkpoints"], "<u8").reshape(-1, layout.lanes + 1)
                ids = rans.decode(words, marks, row["n_tokens"], t, layout.stride, layout.precision).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['shard']}/{row['block']} is damaged")
                ends = np.cumsum(row["lengths"])
                parts = [ids[b - n : b].tobytes() for b, n in zip(ends, row["lengths"], strict=True)]
                size = len(parts)
                columns = [
                    pa.array([row["shard"]] * size, pa.int32()), pa.array([row["block"]] * size, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - np.array(row["lengths"]), pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32).tolist() for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files at ``path``.

    ``start`` is the number of ids of all documents before. A damaged block raises an error.
    """
    layout = spark.read.parquet(f"{path}/layout").first()
    table = spark.read.parquet(f"{path}/frequencies").toArrow()
    tokens = table["token"].to_numpy()
    freq = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, np.int64)
    freq[tokens] = table["freq"].to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    past = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(past.orderBy("shard")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(past.partitionBy("shard").orderBy("block")), F.lit(0))
    offsets = sizes.select("shard", "block", inner.alias("inner")).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("offset"))
    shape = "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = blocks.mapInArrow(_documents(spark.sparkContext.broadcast(freq), layout, with_ids), shape)
    return found.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
