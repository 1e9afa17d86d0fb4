"""Token ids in fixed-width bit packing.

A segment file holds whole documents: a header, the documents' ids and token counts, an offset for
each block of ``BLOCK`` ids, then the blocks, every id in the least number of bits that the
vocabulary needs, every block from a byte border. So any block is unpacked by numpy without the
others, and a document's ids need only the blocks they lie in. A manifest table names the segments in
order, with the ids before each.

Layout, little-endian: magic ``TIDIDS1\\n``; u4 bits, block; u8 documents, ids; i8 and a null flag
byte per document id; u8 token counts; u8 block offsets and end; blocks.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import scratch, stored
from .files import open_fs, put

MAGIC = b"TIDIDS1\n"
BLOCK = 4096
SEGMENT_IDS = 4_000_000  # a segment closes with the document that reaches so many
_HEAD = np.dtype([("bits", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
_RUN = 2_000_000
#: Words kept between runs; beyond so many, only those that the run at hand needs.
CACHED = 800_000
_SIGNS = b".,;:!?"
_CODERS: dict[str, "WordCoder"] = {}


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def segment(doc_ids: list, counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    parts = [pack(ids[a:a + block], bits) for a in range(0, len(ids), block)]
    ends = np.cumsum([0, *map(len, parts)]).astype("<u8")
    head = np.array([(bits, block, len(doc_ids), len(ids))], _HEAD)
    return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     bytes(d is None for d in doc_ids), np.array(counts, "<u8").tobytes(), ends.tobytes(), *parts])


class Segment:
    """Random access to one segment file (an open pyarrow input file)."""

    def __init__(self, source):
        self.source = source
        if source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token id segment")
        head = np.frombuffer(source.read_at(_HEAD.itemsize, len(MAGIC)), _HEAD)[0]
        self.bits, self.block, docs, self.n_ids = (int(head[f]) for f in ("bits", "block", "docs", "ids"))
        at, blocks = len(MAGIC) + _HEAD.itemsize, -(-self.n_ids // self.block)
        raw = source.read_at(docs * 17 + 8 * (blocks + 1), at)
        known = np.frombuffer(raw, "<i8", docs).tolist()
        self.doc_ids = [None if gone else d for d, gone in zip(known, raw[docs * 8:docs * 9])]
        self.counts = np.frombuffer(raw, "<u8", docs, docs * 9).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, docs * 17).astype(np.int64)
        self.payload = at + len(raw)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment; reads only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]),
                                  self.payload + int(self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = int(self.offsets[b] - self.offsets[first])
            out.append(unpack(raw[at:at + int(self.offsets[b + 1] - self.offsets[b])], self.bits, n))
        return np.concatenate(out)[start - first * self.block:stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i] + self.counts[i]))


class WordCoder:
    """A tokenizer whose words never lie across ASCII white space: every distinct word is encoded once.

    Words go to the library joined by spaces, and offsets tell whose token is whose. ASCII letters are
    lower-cased first, as the tokenizer's normalizer does, and signs behind an ASCII letter or digit
    are words of their own to it. Words that may hold a special token are given as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {b"": b""}

    def _run_of_letters(self, word: bytes) -> str | None:
        """A word that the normalizer leaves alone and that is one piece, in the model's byte letters."""
        if word.isalpha():
            return word.decode()
        text = word.decode()
        if not text.isalpha() or not unicodedata.is_normalized("NFC", text) or "".join(map(str.lower, text)) != text:
            return None
        return word.decode("latin-1").translate(self.letters)

    def _stems(self, words: list[bytes]) -> None:
        """Runs of letters go straight to the tokenizer's model, the rest through all its steps."""
        rest, known, ids, ends = [], [], [], [0]
        tokenize = self.tokenizer.model.tokenize
        for w in words:
            piece = self._run_of_letters(w)
            if piece is None:
                rest.append(w)
            else:
                known.append(w)
                ids += [t.id for t in tokenize(piece)]
                ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        self.words.update(zip(known, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        plain = [x for x in rest if b"<|" not in x]
        self.words.update(zip(plain, self._ids(plain)))
        for x in rest:
            if b"<|" in x:
                self.words[x] = next(self._ids([x]))

    def _ids(self, words: list[bytes]) -> Iterator[bytes]:
        for a in range(0, len(words), 256):
            part = [w.decode() for w in words[a:a + 256]]
            starts = np.cumsum([0, *[len(w) + 1 for w in part]])
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            at = np.array([o[0] for o in got.offsets], np.int64)
            cuts = np.searchsorted(at, starts)
            for i, j in zip(cuts, cuts[1:]):
                yield ids[i:j].tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Words by their stem and the signs behind it, both words themselves."""
        whole, parts = [], []
        for w in words:
            if w.isalpha():
                whole.append(w)
                continue
            stem = w.rstrip(_SIGNS)
            if stem and len(stem) < len(w) and stem[-1:].isalnum() and b"<|" not in w:
                parts.append((w, stem, w[len(stem):]))
            else:
                whole.append(w)
        known = self.words
        self._stems(list({x for _, *pair in parts for x in pair if x not in known}.union(whole)))
        known.update([(w, known[stem] + known[signs]) for w, stem, signs in parts])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            raw = t.encode()
            if b"<|" in raw:
                split.append([w if b"<|" in w else w.lower() for w in raw.split()])
            else:
                split.append(raw.lower().split())
        need = set().union(*split)
        if len(self.words) > CACHED:
            self.words = {b"": b""} | {w: self.words[w] for w in need.intersection(self.words)}
        known = self.words
        self._learn(list(need.difference(known)))
        for words in split:
            yield b"".join([known[w] for w in words])


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


_SEGMENTS = "part int, number int, name string, docs long, ids long"


def _write(path: str, folder: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = coder(path)
        bits = max(1, (max(load.size - 1, end_id or 0)).bit_length())
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        docs, counts, ids, size, number, rows = [], [], [], 0, 0, []

        def close():
            nonlocal docs, counts, ids, size, number
            if docs:
                name = f"ids-{part:07d}-{number:07d}.tid"
                put(folder, name, segment(docs, counts, np.frombuffer(b"".join(ids), "<u4"), bits))
                rows.append((part, number, name, len(docs), size))
                docs, counts, ids, size, number = [], [], [], 0, number + 1

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            a = 0
            while a < len(texts):
                run, chars = [], 0
                while a + len(run) < len(texts) and (not run or chars < _RUN):
                    run.append(texts[a + len(run)].as_py() or "")
                    chars += len(run[-1])
                for key, got in zip(keys.slice(a, len(run)).to_pylist(), load.encode(run)):
                    docs.append(key)
                    ids.append(got + end)
                    counts.append(len(ids[-1]) // 4)
                    size += counts[-1]
                    if size >= SEGMENT_IDS:
                        close()
                a += len(run)
        close()
        names = [f.split()[0] for f in _SEGMENTS.split(", ")]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names)

    return write


def write_ids(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
              end_id: int | None = None) -> DataFrame:
    """Encode ``docs`` and write the ids in ascending ``key`` order; returns the manifest.

    Texts are dealt by ranges of the key and encoded after the shuffle. A null key comes first;
    equal keys are ordered by their text; a null text is empty. The manifest has a row per segment
    (``name``, ``start``: ids before it, ``docs``, ``ids``) and lies beside the segments.
    """
    rows = stored(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
                  .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
                  .mapInArrow(_write(tokenizer, folder, end_id), _SEGMENTS), "segments")
    # Ids before each task's part (one row per task), then before each segment of the part.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(
        before.orderBy("part")), F.lit(0)).alias("base"))
    within = F.sum("ids").over(before.partitionBy("part").orderBy("number"))
    (rows.select("*", F.coalesce(within, F.lit(0)).alias("within")).join(parts, "part")
     .select("name", (F.col("base") + F.col("within")).alias("start"), "docs", "ids")
     .write.parquet(f"{folder}/manifest"))
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{path}/{name}") as source:
                    s = Segment(source)
                    ids = s.ids(0, s.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(s.starts.tolist(), s.counts.tolist())]
                yield pa.record_batch([pa.array(s.doc_ids, pa.int64()), pa.array(s.starts + start),
                                       pa.array(s.counts), pa.array(crc, pa.int64())],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in ``folder``, from its segments."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "start").repartition(width, "name").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write ``docs`` into a new shared folder and read the documents back from the files."""
    folder = scratch(docs.sparkSession, "ids")
    write_ids(docs, folder, tokenizer, end_id=end_id)
    return read_ids(docs.sparkSession, folder)
