"""Token ids in raw binary shards with a minimal perfect hash index.

A shard is two files. ``<name>.ids`` holds nothing but little-endian ids (16 bits each if the vocabulary allows, else
32), record after record in ascending key order. ``<name>.mph`` holds the index: a minimal perfect hash of the shard's
keys (levels of bit arrays in blocks that carry their rank, a key's place is the rank of its bit) and, at each place, a
32-bit fingerprint of the key, the record's offset and its length; then the keys in record order. A lookup reads the
head, one block for each level it asks (two on average), one slot and one slice of the payload: never the whole index.
Files get a name of their own for each attempt and the manifest, a Parquet table written last by Spark, names those
that count, so a lost executor leaves nothing wrong behind.

Shards are ranges of ``(doc_id, digest of the text, row)``, so neither copies of a row nor rows of one id meet in one
task. A key is ``(doc_id, n)``, n counting the rows of the id in the shard from 0. Defined cases: null text is the empty
record, only the end id; null ids come first; repeated rows are records each, in the order of a digest of the text;
texts of any length are encoded whole, a few at a time; an empty table gives a manifest without shards; other columns
are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import input_bytes, new_path, release, stage

MAGIC = b"NXMPH001"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
MANIFEST = "part int, name string, first_id long, first_null boolean, records long, ids long, width int"
#: Bytes of input files a shard is made of.
SHARD_BYTES = 128 << 20
#: Marks that end a word without joining it.
MARKS = ".,;:!?"
#: How byte-level vocabularies show bytes that are no visible Latin-1 character.
BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
RECORDS = "name string, nth long, doc_id long, is_null boolean, start long, n_tokens long, ids_crc32 long"


# ---- encoding -------------------------------------------------------------------------------------------------------


class Encoder:
    """Exact ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The pre-tokenizer never joins across a single blank or line break between two characters that are not white space,
    so a text is cut before these. Distinct pieces are encoded together; the ids that open a piece are those whose
    bytes begin with a blank or a line break. Texts with other white space at a cut are encoded as they are. The cache
    holds at most ``cache`` bytes and is emptied when it is full.
    """

    #: Bytes of an entry beside its piece and ids: two objects and their place in the table.
    ENTRY = 220

    def __init__(self, path: str, cache: int = 112 << 20):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        bare = json.loads(self.t.to_str())
        level = bare["pre_tokenizer"] or {}
        #: The merges alone, for words that the pre-tokenizer leaves whole; none if it does more than cut at such words.
        self.bare = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": None, "post_processor": None})) if level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and bare["normalizer"] is None else None
        self.size = self.t.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.led = np.zeros(self.size, bool)
        for piece, i in self.t.get_vocab(with_added_tokens=True).items():
            self.led[i] = piece.startswith(("Ġ", "Ċ"))
        self.most, self.held, self.cache = cache, 0, {}
        self.marks = dict(zip(MARKS, self.whole(list(MARKS))))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, piece: str) -> bool:
        """Latin letters only: one word to the pre-tokenizer, with the blank before it."""
        return self.bare is not None and piece.isalpha() and (piece.isascii() or max(piece) < "\u0250")

    @staticmethod
    def _plain(piece: str) -> bool:
        """No white space at either end, but for the line break that leads it."""
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _keep(self, pieces: list[str], found: list[int]) -> None:
        """Into the cache: the ids of all pieces, one after another, cut where a piece opens."""
        ids = np.array(found, self.dtype)
        starts = np.flatnonzero(self.led[ids])
        assert len(starts) == len(pieces), "a piece was joined or split"
        raw, w = ids.tobytes(), self.dtype.itemsize
        ends = np.append(starts[1:], len(ids)) * w
        self.cache.update(zip(pieces, [raw[a:b] for a, b in zip((starts * w).tolist(), ends.tolist())]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most:
            self.cache.clear()
            self.held = 0
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        new = set()
        for pieces in cut:
            new.update(pieces[1:])
        cache = self.cache
        new = [x for x in new if x not in cache and (x.isalpha() or self._plain(x))]
        marked = [x for x in new if x[-1] in MARKS and x[-2:-1].isalpha()]
        if marked:  # a mark after a letter is a piece of the pre-tokenizer's own, so such a word is its stem and the mark
            done = set(marked)
            new = [x for x in new if x not in done] + list({x[:-1] for x in marked if x[:-1] not in cache}.difference(new))
        words = [x for x in new if self._letters(x)]
        if words:
            shown = [f"Ġ{x}" if x.isascii() else f" {x}".encode().decode("latin-1").translate(BYTES) for x in words]
            self._keep(words, self.bare.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids)
            new_words = set(words)
            rest = [x for x in new if x not in new_words]
        else:
            rest = new
        if rest:
            line = "".join([x if x[0] == "\n" else " " + x for x in rest])
            self._keep(rest, self.t.encode_batch_fast([line], add_special_tokens=False)[0].ids)
        for x in marked:
            cache[x] = cache[x[:-1]] + self.marks[x[-1]]
        self.held += self.ENTRY * (len(new) + len(marked)) + sum(map(len, new)) + sum(map(len, marked))
        out: list[bytes | None] = []
        get, odd, heads = cache.__getitem__, [], []
        for i, pieces in enumerate(cut):
            head = pieces[0]
            try:
                if head and (head[0].isspace() or head[-1].isspace()) or not head and len(pieces) > 1:
                    raise KeyError(head)
                out.append(b"".join(map(get, pieces[1:])))
                heads.append(i)
            except KeyError:  # a piece that is not plain
                out.append(None)
                odd.append(i)
        for i, b in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = b
        for i, b in zip(heads, self.whole([cut[i][0] for i in heads])):
            out[i] = b + out[i]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    return Encoder(path)


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finaliser, seeded."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray, salt: int) -> np.ndarray:
    return mixed(mixed(ids.astype(np.int64).view(np.uint64), salt) ^ mixed(nth.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), salt + 1), salt + 2)


#: Bits of a level that share one rank.
BLOCK = 512
BLOCKS = np.dtype([("rank", "<u8"), ("bits", "u1", BLOCK // 8)])


class PerfectHash:
    """Places 0..n-1 of n distinct 64-bit hashes. Level by level, a key whose bit no other key wants is settled."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - bits + at
            self.ranks.append(ranks)
            at += int(bits.sum())
        self.n = at

    @classmethod
    def build(cls, hashes: np.ndarray, spare: float = 1.5) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, int(spare * len(left)))
            spot = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[spot]]
        return cls(levels)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places; -1 for a hash that reaches no bit (certainly not a key)."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            spot = (mixed(hashes[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[spot] == 1
            out[left[hit]] = self.ranks[k][spot[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        """Number and sizes of the levels; then each level in blocks of the rank before it and ``BLOCK`` bits."""
        out = [np.array([len(self.levels), *map(len, self.levels)], "<u8").tobytes()]
        for bits, ranks in zip(self.levels, self.ranks):
            blocks = np.zeros(-(-len(bits) // BLOCK), BLOCKS)
            blocks["rank"] = ranks[::BLOCK]
            full = np.zeros(len(blocks) * BLOCK, np.uint8)
            full[: len(bits)] = bits
            blocks["bits"] = np.packbits(full).reshape(-1, BLOCK // 8)
            out.append(blocks.tobytes())
        return b"".join(out)

    @classmethod
    def unpack(cls, raw: memoryview) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(raw[:8], "<u8")[0])
        sizes, at, levels = np.frombuffer(raw[8 : 8 + 8 * n], "<u8"), 8 + 8 * n, []
        for s in map(int, sizes):
            blocks = np.frombuffer(raw[at:], BLOCKS, -(-s // BLOCK))
            levels.append(np.unpackbits(blocks["bits"])[:s])
            at += blocks.nbytes
        return cls(levels), at


SLOT = np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u8")])
KEY = np.dtype([("id", "<i8"), ("null", "u1"), ("nth", "<u4")])


def pack_index(ids, nulls, nth, offsets, lengths) -> bytes:
    salt = 0
    while True:
        h = key_hash(ids, nulls, nth, salt)
        if len(np.unique(h)) == len(h):
            break
        salt += 3
    f = PerfectHash.build(h)
    slots, keys, place = np.zeros(len(h), SLOT), np.zeros(len(h), KEY), f.places(h)
    slots["print"][place], slots["offset"][place], slots["length"][place] = (h >> np.uint64(32)).astype(np.uint32), offsets, lengths
    keys["id"], keys["null"], keys["nth"] = ids, nulls, nth
    packed = f.pack()
    return MAGIC + np.array([salt, len(h), len(packed)], "<u8").tobytes() + packed + slots.tobytes() + keys.tobytes()


class Index:
    """An index file in memory: ``find`` maps keys to offsets and lengths (in ids), -1 where a key is not in the shard."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        assert raw[:8] == MAGIC, "not an index"
        salt, n, size = map(int, np.frombuffer(view[8:32], "<u8"))
        self.salt, (self.hash, _) = salt, PerfectHash.unpack(view[32 : 32 + size])
        at = 32 + size
        self.slots = np.frombuffer(view[at : at + n * SLOT.itemsize], SLOT)
        self.keys = np.frombuffer(view[at + n * SLOT.itemsize :], KEY, count=n)

    def find(self, ids, nulls, nth) -> tuple[np.ndarray, np.ndarray]:
        h = key_hash(np.asarray(ids), np.asarray(nulls), np.asarray(nth), self.salt)
        place = self.hash.places(h)
        ok = place >= 0
        ok[ok] = self.slots["print"][place[ok]] == (h[ok] >> np.uint64(32)).astype(np.uint32)
        offset, length = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        offset[ok], length[ok] = self.slots["offset"][place[ok]], self.slots["length"][place[ok]]
        return offset, length


# ---- files ----------------------------------------------------------------------------------------------------------


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow opens by URI: file, s3, gs, hdfs."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, write the shards into ``folder`` and return the manifest (one row a shard). Their number
    follows from the bytes of the input files and is two a core at least."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        enc, name = encoder(vocabulary), f"shard-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.dtype).tobytes()
        keys, lengths, last, again, out = [], [], None, 0, None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_500_000):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.ids", buffer_size=1 << 20)
                records = enc(texts[lo:hi])
                for key, raw in zip(ids[lo:hi], records):
                    again = again + 1 if keys and key == last else 0
                    last = key
                    keys.append((key or 0, key is None, again))
                    lengths.append(len(raw) // enc.dtype.itemsize + 1)
                out.write(end.join(records) + end)
        if out is None:
            return
        out.close()
        ids, nulls, nth = (np.array(x) for x in zip(*keys))
        size = np.array(lengths, np.int64)
        with fs.open_output_stream(f"{root}/{name}.mph") as f:
            f.write(pack_index(ids.astype(np.int64), nulls, nth, np.cumsum(size) - size, size))
        release()
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_pydict({"part": part, "name": [name], "first_id": [int(ids[0])], "first_null": [bool(nulls[0])], "records": [len(size)], "ids": [int(size.sum())], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    n = shards or max(2 * docs.sparkSession.sparkContext.defaultParallelism, input_bytes(docs) // SHARD_BYTES)
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    ranged = d.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stage(ranged.select("doc_id", "text").mapInArrow(encode, MANIFEST), "token-manifest", pack=False)


def slices(texts, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Spans of rows of about ``most`` characters, at least one row each."""
    lo = size = 0
    for i, n in enumerate(map(len, texts)):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts) > lo:
        yield lo, len(texts)


#: Bytes of payload read at a time; a record longer than that is a read of its own.
RUN_BYTES = 4 << 20


def in_runs(f, offset: np.ndarray, length: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The place in ``offset`` and the ids of every record, in the order of the payload: neighbouring records come with
    one read, cut by what the index says of each."""
    order = np.argsort(offset, kind="stable")
    start, end = offset[order].astype(np.int64) * width, (offset + length)[order].astype(np.int64) * width
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + RUN_BYTES, side="right")))
        run = f.read_at(int(end[lo:hi].max() - start[lo]), int(start[lo]))
        for j in range(lo, hi):
            yield int(order[j]), np.frombuffer(run, f"<u{width}", int(end[j] - start[j]) // width, int(start[j] - start[lo]))
        lo = hi


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of every shard, found by its key through the index and read from the payload; a task a shard."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        for b in batches:
            for name, width, before in zip(b["name"], b["width"], b["before"]):
                with fs.open_input_stream(f"{root}/{name}.mph") as f:
                    index = Index(f.read())
                with fs.open_input_file(f"{root}/{name}.ids") as f:
                    for lo in range(0, len(index.keys), 5000):
                        k = index.keys[lo : lo + 5000]
                        offset, length = index.find(k["id"], k["null"], k["nth"])
                        assert (offset >= 0).all(), "a key is missing from its index"
                        crc = np.zeros(len(k), np.int64)
                        for i, ids in in_runs(f, offset, length, width):
                            crc[i] = zlib.crc32(ids.astype("<u4"))
                        yield pd.DataFrame({"name": name, "nth": np.arange(lo, lo + len(k)), "doc_id": k["id"].astype(np.int64), "is_null": k["null"].astype(bool), "start": before + offset, "n_tokens": length, "ids_crc32": crc})

    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    spread = manifest.select("name", "width", "part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before")).repartition(max(1, manifest.count()), "part")
    return spread.mapInPandas(scan, RECORDS).withColumn("doc_id", F.when(~F.col("is_null"), F.col("doc_id"))).select("doc_id", "start", "n_tokens", "ids_crc32", "name", "nth")


def lookup(folder: str, name: str, width: int, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
    """The ids of one record of one shard, or None. It reads the head of the index, a block a level asked, a slot and
    the record, however large the shard is."""
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{name}.mph") as f:
        head = f.read_at(40, 0)
        assert head[:8] == MAGIC, "not an index"
        salt, _, size, levels = map(int, np.frombuffer(head, "<u8", 4, 8))
        h = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]), salt)
        at, place = 40 + 8 * levels, None
        for k, bits in enumerate(np.frombuffer(f.read_at(8 * levels, 40), "<u8").tolist()):
            spot = int(mixed(h, k)[0] % np.uint64(bits))
            block = np.frombuffer(f.read_at(BLOCKS.itemsize, at + spot // BLOCK * BLOCKS.itemsize), BLOCKS)[0]
            held = np.unpackbits(block["bits"])
            if held[spot % BLOCK]:
                place = int(block["rank"]) + int(held[: spot % BLOCK].sum())
                break
            at += -(-bits // BLOCK) * BLOCKS.itemsize
        if place is None:
            return None
        slot = np.frombuffer(f.read_at(SLOT.itemsize, 32 + size + place * SLOT.itemsize), SLOT)[0]
    if slot["print"] != np.uint32(h[0] >> np.uint64(32)):
        return None
    with fs.open_input_file(f"{root}/{name}.ids") as f:
        return np.frombuffer(f.read_at(int(slot["length"]) * width, int(slot["offset"]) * width), f"<u{width}").astype("<u4")


def encode_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    manifest = write_tokens(docs, folder, vocabulary)
    return read_records(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
