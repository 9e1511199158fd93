"""Token ids in a binary file format: fixed-size blocks of ids, transposed into planes, each plane compressed.

File: b"LRBP", version u8, plane kind u8 (0 bytes, 1 bits), u16 zero; the chunks; the chunk index; the document index;
the footer. A chunk holds up to ``block`` ids as 4 byte planes (or 32 bit planes), each a zstandard frame; planes of
zeros alone have length 0 and no bytes. Chunk index, an entry a chunk: offset u64, ids u32, then a u32 length a plane.
Document index (zstandard frame): doc_id i64s, then the n_tokens u32s. Footer: chunk index offset u64, chunks u32,
document index offset u64, document index bytes u64, documents u64, ids u64, b"PBRL". All little-endian.
Since the index gives every chunk's place, a range of ids is read without the chunks around it.

``encode_documents`` sorts the whole texts by doc_id (range partitions), encodes with the tokenizers library, appends
the end id, and writes one file a partition; ``read_documents`` reads the files back. Attempts write under names of
their own and the manifest lists those that succeeded.

Defined results: null texts are empty (the end id alone); null doc_ids come first and read back as null; equal doc_ids keep
all their rows, in the order of a hash of their texts; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, open_store, scratch
from ._hashing import HashRows, piece_hashes

HEAD, FOOT = struct.Struct("<4sBBH"), struct.Struct("<QIQQQQ4s")
_NULL_ID = -(1 << 63)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, j]).tobytes() for j in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, j], bitorder="little").tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for j, p in enumerate(planes):
            if p:
                raw[:, j] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    flat = np.zeros((n, 32), np.uint8)
    for j, p in enumerate(planes):
        if p:
            flat[:, j] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
    return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, stream, block: int = 1 << 16, bits: bool = False, level: int = 1):
        self.stream, self.block, self.bits = stream, block, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = self._put(HEAD.pack(b"LRBP", 1, int(bits), 0))
        self.held, self.held_n, self.chunks, self.docs, self.sizes, self.total = [], 0, [], [], [], 0

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= self.block:
            flat = np.frombuffer(b"".join(self.held), "<u4")
            full = len(flat) // self.block * self.block
            for i in range(0, full, self.block):
                self._chunk(flat[i : i + self.block])
            self.held, self.held_n = [flat[full:].tobytes()], len(flat) - full

    def _chunk(self, ids: np.ndarray) -> None:
        lengths, start = [], self.at
        for plane in to_planes(ids, self.bits):
            data = self.zip.compress(plane) if any(plane) else b""
            self.at += self._put(data)
            lengths.append(len(data))
        self.chunks.append(struct.pack(f"<QI{len(lengths)}I", start, len(ids), *lengths))

    def close(self) -> int:
        if self.held_n:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        index_at = self.at
        self.at += self._put(b"".join(self.chunks))
        index = self.zip.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes())
        docs_at = self.at
        self.at += self._put(index)
        self.at += self._put(FOOT.pack(index_at, len(self.chunks), docs_at, len(index), len(self.docs), self.total, b"PBRL"))
        return self.at


class Reader:
    """Random access to a file: documents() streams whole documents, ids(start, end) reads a range."""

    def __init__(self, file, size: int):
        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        magic, _, kind, _ = HEAD.unpack(self._get(0, HEAD.size))
        index_at, chunks, docs_at, docs_bytes, docs, self.total, tail = FOOT.unpack(self._get(size - FOOT.size, FOOT.size))
        if magic != b"LRBP" or tail != b"PBRL":
            raise ValueError("not a bit-plane file")
        self.planes = 32 if kind else 4
        entry = struct.Struct(f"<QI{self.planes}I")
        self.chunks = [entry.unpack_from(raw, i * entry.size) for raw in [self._get(index_at, chunks * entry.size)] for i in range(chunks)]
        self.first = np.concatenate([[0], np.cumsum([c[1] for c in self.chunks], dtype=np.int64)]).astype(np.int64)
        raw = self.unzip.decompress(self._get(docs_at, docs_bytes))
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.sizes = np.frombuffer(raw, "<u4", docs, offset=8 * docs).astype(np.int64)

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.chunks[k]
        raw, planes = self._get(at, sum(lengths)), []
        for x in lengths:
            planes.append(self.unzip.decompress(raw[:x]) if x else b"")
            raw = raw[x:]
        return from_planes(planes, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        a, z = np.searchsorted(self.first, start, "right") - 1, np.searchsorted(self.first, end, "left")
        if end <= start:
            return np.empty(0, "<u4")
        return np.concatenate([self.chunk(k) for k in range(a, z)])[start - self.first[a] : end - self.first[a]]

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, start in the file, ids); holds one document and one chunk at a time."""
        rest, k, start = b"", 0, 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.sizes.tolist()):
            if len(rest) < 4 * n:
                parts, have = [rest], len(rest)
                while have < 4 * n:
                    parts.append(self.chunk(k).tobytes())
                    have, k = have + len(parts[-1]), k + 1
                rest = b"".join(parts)
            view, rest = rest[: 4 * n], rest[4 * n :]
            yield doc_id, start, view
            start += n


class WordEncoder:
    """Whole texts through a tokenizers file, with the ids of pieces of words kept between texts.

    The pre-tokenizer of word_bpe files never joins over white space and normalises characters one by one, so a text's
    ids are its words' ids in order. It also cuts wherever letters meet the signs of ``TAIL``, so words are cut there too: ``then,`` is two
    pieces. Pieces are found, hashed and looked up as arrays over the bytes of many texts; only a piece new to the table goes through
    the library, and one of lower-cased Latin letters needs only its model, without normalizer and pattern. Texts that hold characters
    beyond Latin, a special token's "<|" or a piece of over ``LONGEST`` bytes go through the library whole.

    The table has the 64-bit hash of each piece: at ``most`` pieces, when it is emptied, the chance that any two of them share one is under 1 in 10 million.
    """

    FAR = re.compile("[^\x00-\x1b\x20-ɏ]|<\\|")
    TAIL = ".,!?;:#$%&*|"
    LONGEST = 256
    _SPACE, _LETTER, _TAIL, _OTHER = range(4)

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        probe = {t: self.lib.encode(t, add_special_tokens=False).ids for t in ("ab", "ab ab", "ab,", ",", ",ab")}
        self.by_word = probe["ab ab"] == probe["ab"] * 2 and probe["ab,"] == probe["ab"] + probe[","] and probe[",ab"] == probe[","] + probe["ab"]
        self.by_word = self.by_word and self.lib.normalizer is not None and "Lowercase" in str(self.lib.normalizer)
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.by_word = self.by_word and bool(self.last[probe["ab"][-1]])
        self.model = Tokenizer(self.lib.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = "a zebra straße ñandú łódź žižkov " + " ".join(chr(c) for c in range(0x61, 0x250) if chr(c).isalpha() and chr(c).lower() == chr(c))
        if self.lib.encode(letters, add_special_tokens=False).ids != self.model.encode(letters, add_special_tokens=False).ids:
            self.model = self.lib
        self.kinds = np.full(256, self._OTHER, np.uint8)
        self.kinds[[9, 10, 11, 12, 13, 32]] = self._SPACE
        self.kinds[97:123] = self._LETTER
        self.kinds[list(self.TAIL.encode())] = self._TAIL
        rng = np.random.default_rng(1)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.table = HashRows()
        #: ids of piece r: pool[start[r]:start[r + 1]]
        self.start, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 17, "<u4")

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of new pieces, by the library."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        plain = [i for i, w in enumerate(pieces) if w.isalpha()]
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            (found,) = self.model.encode_batch_fast([" ".join([pieces[j] for j in part])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cut = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(cut) == len(part):
                for j, a, z in zip(part, [0, *cut], cut):
                    out[j] = ids[a:z]
        odd = [i for i, x in enumerate(out) if x is None]
        if odd:
            for j, found in zip(odd, self.lib.encode_batch_fast([pieces[j] for j in odd], add_special_tokens=False)):
                out[j] = np.array(found.ids, "<u4")
        return out

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        n = self.table.n
        if n + len(h) > self.most and n:
            raise OverflowError
        ids = self._ids(pieces)
        ends = self.start[n] + np.cumsum([len(x) for x in ids])
        while n + len(h) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.start[n] : ends[-1]] = np.concatenate(ids)
        self.start[n + 1 : n + 1 + len(h)] = ends
        self.table.add(h)

    def _is_far(self, text: str) -> bool:
        try:  # one byte a character: only these can be wrong
            text.encode("latin-1")
            return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        except UnicodeEncodeError:
            return self.FAR.search(text) is not None

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces in UTF-8 bytes that end with white space."""
        kind = self.kinds[raw]
        lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
        if len(lead):
            after = raw[lead + 1]
            kind[lead] = kind[lead + 1] = np.where((raw[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)), self._OTHER, self._LETTER)
        edge = np.empty(len(kind), bool)
        edge[0] = True
        # white space against the rest, letters against tails; other characters stay with what is beside them
        now, before = kind[1:], kind[:-1]
        edge[1:] = ((now == self._SPACE) != (before == self._SPACE)) | (now * before == self._LETTER * self._TAIL) & (now != before)
        at = np.flatnonzero(edge)
        ends = np.append(at[1:], len(kind))
        words = kind[at] != self._SPACE
        return at[words], ends[words]

    def _near(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts by their pieces; None for texts with a piece that is too long."""
        buffer = b"\n".join([*texts, b""])
        raw = np.frombuffer(buffer, np.uint8)
        start, end = self._pieces(raw) if len(raw) else (np.empty(0, np.int64),) * 2
        h = piece_hashes(self.of_byte[raw], start, end)
        rows = self.table.find(h)
        new = np.flatnonzero(rows < 0)
        if len(new):
            unknown, first = np.unique(h[new], return_index=True)
            first = new[first]
            try:
                self._learn(unknown, [buffer[a:z].decode() for a, z in zip(start[first].tolist(), end[first].tolist())])
            except OverflowError:
                self._empty()
                return self._near(texts)
            rows[new] = self.table.find(h[new])
        begin = self.start[rows]
        counts = self.start[rows + 1] - begin
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = upto[np.searchsorted(start, bounds)].tolist()
        out = [ids[a:z].tobytes() for a, z in zip(cut, cut[1:])]
        for i in np.searchsorted(bounds, start[end - start > self.LONGEST], "right").tolist():
            out[i - 1] = None
        return out

    @staticmethod
    def _parts(raw: bytes, at_once: int) -> Iterator[bytes]:
        """About at_once bytes each, cut at spaces or line ends; one without any is longer."""
        a = 0
        while a < len(raw):
            z = next((x for x in (raw.find(b" ", a + at_once), raw.find(b"\n", a + at_once)) if x >= 0), len(raw))
            yield raw[a:z]
            a = z

    def encode(self, texts: list[str], at_once: int = 1 << 18) -> list[bytes]:
        """at_once: bytes that are worked on together; a longer text is taken in parts, cut at white space."""
        out: list[bytes | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._near([raw for _, raw in held])):
                out[i] = ids
            held.clear()

        for i, text in enumerate(texts):
            if self.by_word and not self._is_far(text):
                raw = text.lower().encode()
                if b"\xc2" in raw:
                    raw = raw.replace(b"\xc2\x85", b" ").replace(b"\xc2\xa0", b" ")
                if len(raw) > 2 * at_once:
                    parts = [self._near([x])[0] for x in self._parts(raw, at_once)]
                    out[i] = None if None in parts else b"".join(parts)
                    continue
                held.append((i, raw))
                size += len(raw)
                if size > at_once:
                    flush()
                    size = 0
        if held:
            flush()
        far = [i for i, ids in enumerate(out) if ids is None]
        if far:
            for i, found in zip(far, self.lib.encode_batch_fast([texts[i] for i in far], add_special_tokens=False)):
                out[i] = np.array(found.ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_documents(
    docs: DataFrame, tokenizer_path: str, directory: str | None = None, end_id: int = 1, block: int = 1 << 16, bits: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the files in ascending doc_id order; returns their manifest: (path, bytes, first_id, part, n_docs, n_ids, start)."""
    spark = docs.sparkSession
    directory = directory or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the hash of the text parts the rows of one doc_id, or of none, among ranges
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie").withColumn("part", F.spark_partition_id())
    tail = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        gc.disable()
        try:
            for batch in batches:
                enc = encoder(tokenizer_path)
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    if writer is None:
                        uri, number = f"{directory}/{uuid.uuid4().hex}.lrbp", part.column(2)[0].as_py()
                        store, path = open_store(uri)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        stream = store.open_output_stream(path, compression=None)
                        writer = Writer(stream, block, bits)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                        writer.add(_NULL_ID if doc_id is None else doc_id, ids + tail)
        finally:
            gc.enable()
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [uri], "bytes": [size], "part": pa.array([number], pa.int32()), "n_docs": [len(writer.docs)], "n_ids": [writer.total]}
            )

    manifest = materialise(rows.mapInArrow(write, "path string, bytes long, part int, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file; the running sum over the manifest is its only single task.
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (and ids binary)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                store, name = open_store(path)
                with store.open_input_file(name) as f:
                    rows = []
                    for doc_id, at, ids in Reader(f, size).documents():
                        rows.append((None if doc_id == _NULL_ID else doc_id, start + at, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                        if len(rows) == 4096:
                            yield _rows(rows, with_ids)
                            rows = []
                    if rows:
                        yield _rows(rows, with_ids)

    return manifest.select("path", "bytes", "start").repartition(min(files, 100_000), "path").mapInArrow(read, schema)


def _rows(rows: list, with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
