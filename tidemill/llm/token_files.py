"""Token ids in bit-packed binary files.

Texts are range-partitioned by document id, encoded, and written one file a
partition, in ascending order of id. A file holds, little-endian:

    magic "TDMLTOK1"
    payload      blocks of BLOCK ids, each id in the vocabulary's minimum bits
    offsets      one unsigned 64-bit byte offset a block, and the payload's end
    doc ids      signed 64-bit, one a document
    doc starts   unsigned 64-bit, one a document, and the number of ids
    trailer      bits, block, blocks, documents, ids (unsigned 64-bit), magic

The order of bits is little-endian within the stream, so a block unpacks with
numpy alone and any id is found from its block's offset. Files go to a store
that pyarrow can write (the shared folder): first under the attempt's own
name, then renamed, so that tasks that run twice leave one whole file.

Defined results: null texts are empty; null ids come first and are written as
the smallest 64-bit integer; equal ids go by text; an empty table has no files.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import LOWER, batch_of, kept, map_batches, slices, words
from .store import partitions_for, scratch

MAGIC = b"TDMLTOK1"
BLOCK = 8192
NO_ID = -(1 << 63)
#: Divides the words handed to the tokenizer in one call; words that hold it are encoded alone.
DIVIDER = "<|startoftext|>"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


#: The way of dividing texts for which words can be encoded apart: these normalizers, then this pattern, then bytes.
WORDWISE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that the normalizers only lower-case; of these characters, no two combine and none is a white space.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ\n]+")
#: WORDWISE for lower-cased plain words, a line each.
_PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")


def _byte_characters() -> dict[int, str]:
    """For characters up to 255: their UTF-8 bytes as byte-level BPE writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(33, 256)}


def _ranges(pool: np.ndarray, shift: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranges of pool in a row; shift: where each begins, less the lengths before it."""
    at = np.repeat(shift.astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at]


class WordEncoder:
    """Encodes texts by a table of the words met before.

    Where the tokenizer drops white space and looks across none of it, a
    text's ids are those of its words in turn, and plain words' ids are those
    of their pieces, merged by the tokenizer's own model. Any other word goes
    through the whole tokenizer, and with another kind of tokenizer so does
    any text. A full table of words is cleared, one of pieces becomes the old
    one, from which those still in use are taken over; that changes nothing
    but time.
    """

    def __init__(self, path: str, end_id: int, most: int = 400_000, most_pieces: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.divider = self.tokenizer.token_to_id(DIVIDER)
        self.end_id, self.most, self.most_pieces = end_id, most, most_pieces
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = steps["model"].get("end_of_word_suffix")
        self.wordwise = kinds == ["NFC", "Replace", "Lowercase"] and splits == [WORDWISE, None] and bool(suffix) and self.divider is not None
        if self.wordwise:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.bytes = _byte_characters()
        self.piece_index, self.piece_starts, self.piece_lengths, self.piece_pool = {}, *np.zeros((2, 1), np.int64), np.zeros(0, np.uint32)
        self._age_pieces()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        # of words; entry 0: the end of a text
        self.starts, self.lengths, self.pool = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def _age_pieces(self) -> None:
        self.old = (self.piece_index, self.piece_starts, self.piece_lengths, self.piece_pool)
        self.piece_index = {"\n": 0}
        self.piece_starts, self.piece_lengths, self.piece_pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn_pieces(self, new: set[str]) -> None:
        index, starts, lengths, pool = self.old
        met = [p for p in new if p in index]
        unmet = list(new.difference(met))
        was = np.fromiter(map(index.__getitem__, met), np.int64, len(met))
        size = lengths[was]
        ends = np.cumsum(size)
        taken = _ranges(pool, starts[was] - (ends - size), size)
        # some words at a time: an encoding holds far more than ids
        parts = [" ".join(unmet[k : k + 8192]).translate(self.bytes) for k in range(0, len(unmet), 8192)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.bare.encode(p, add_special_tokens=False).ids, np.uint32) for p in parts)])
        closes = np.flatnonzero(self.closes[ids]) + 1
        if len(closes) != len(unmet):
            raise ValueError("the tokenizer's pieces don't end where words do")
        at = len(self.piece_lengths)
        self.piece_index.update(zip(itertools.chain(met, unmet), range(at, at + len(new)), strict=True))
        self.piece_lengths = np.concatenate([self.piece_lengths, size, np.diff(closes, prepend=0)])
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_pool = np.concatenate([self.piece_pool, taken, ids])

    def _plain_ids(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words in a row, and how many each has."""
        flat = _PIECES.findall("\n".join([*plain, ""]).lower())
        used = set(flat)
        if len(self.piece_index) + len(used) > self.most_pieces // 2:
            self._age_pieces()
        if fresh := used - self.piece_index.keys():
            self._learn_pieces(fresh)
        piece = np.fromiter(map(self.piece_index.__getitem__, flat), np.int64, len(flat))
        lengths = self.piece_lengths[piece]
        ends = np.cumsum(lengths)
        ids = _ranges(self.piece_pool, self.piece_starts[piece] - (ends - lengths), lengths)
        return ids, np.diff(ends[piece == 0], prepend=0)

    def _learn(self, new: list[str]) -> None:
        plain, odd = new, []
        joined = "\n".join(new)
        if "<|" in joined or not _PLAIN_LINES.fullmatch(joined):
            plain = [w for w in new if _PLAIN.fullmatch(w) and "<|" not in w]
            odd = [w for w in new if not _PLAIN.fullmatch(w) or "<|" in w]
        pools, lengths = [self.pool], [self.lengths]
        if plain:
            ids, own = self._plain_ids(plain)
            pools.append(ids)
            lengths.append(own)
        apart = [w for w in odd if DIVIDER not in w]
        lone = [w for w in odd if DIVIDER in w]
        if apart:
            ids = np.array(self.tokenizer.encode(DIVIDER.join(apart), add_special_tokens=False).ids, np.uint32)
            cut = ids == self.divider
            pools.append(ids[~cut])
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1)
        for w in lone:
            pools.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
            lengths.append(np.array([len(pools[-1])], np.int64))
        at = len(self.lengths)
        self.index.update(zip([*plain, *apart, *lone], range(at, at + len(new)), strict=True))
        self.pool, self.lengths = np.concatenate(pools), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the n+1 offsets of texts in them."""
        if not self.wordwise:
            lists = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(lists), np.uint32), np.cumsum([0, *map(len, lists)])
        coded, at = words(texts, LOWER)
        if pc.any(pc.match_substring(coded.dictionary, "<|")).as_py():  # lower case could make a special token of it
            coded, at = words(texts, bytes(range(256)))
        known = coded.dictionary.to_pylist()
        if len(self.index) + len(known) > self.most:
            self._clear()
        entry = np.fromiter(map(self.index.get, known, itertools.repeat(-1)), np.int64, len(known))
        unmet = np.flatnonzero(entry < 0)
        if len(unmet):
            new = [known[i] for i in unmet.tolist()]
            self._learn(new)
            entry[unmet] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        entries = entry[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        entries = np.insert(entries, at[1:], 0)
        lengths = self.lengths[entries]
        ends = np.cumsum(lengths)
        ids = _ranges(self.pool, self.starts[entries] - (ends - lengths), lengths)
        last = at[1:] + np.arange(len(at) - 1)
        return ids, np.concatenate([[0], ends[last]])


def shared_encoder(path: str, end_id: int, most: int) -> WordEncoder:
    """A worker's encoder: loaded once, its tables kept from task to task."""
    return kept(("encoder", path, end_id, most), lambda: WordEncoder(path, end_id, most, 2 * most))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.at, self.offsets, self.n = len(MAGIC), [], 0
        self.docs: list[np.ndarray] = []
        self.doc_starts: list[np.ndarray] = []
        stream.write(MAGIC)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.doc_starts.append(offsets[:-1] + self.n)
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        self._put(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), self.block):
            data = pack(ids[k : k + self.block], self.bits)
            self.offsets.append(self.at)
            self.at += len(data)
            self.stream.write(data)

    def close(self) -> None:
        self._put(self.rest)
        docs = np.concatenate([*self.docs, np.zeros(0, np.int64)])
        starts = np.concatenate([*self.doc_starts, [self.n]])
        self.stream.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.stream.write(docs.astype("<i8").tobytes())
        self.stream.write(starts.astype("<u8").tobytes())
        self.stream.write(np.array([self.bits, self.block, len(self.offsets), len(docs), self.n], "<u8").tobytes() + MAGIC)


class TokenFile:
    """Random access to one file: any range of ids, reading only the blocks it touches."""

    TRAILER = 5 * 8 + len(MAGIC)

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        trailer = self.file.read_at(self.TRAILER, size - self.TRAILER)
        if trailer[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.bits, self.block, blocks, docs, self.n = map(int, np.frombuffer(trailer, "<u8", 5))
        tail = 8 * (blocks + 1 + docs + docs + 1)
        table = self.file.read_at(tail, size - self.TRAILER - tail)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", docs, 8 * (blocks + 1))
        self.starts = np.frombuffer(table, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        n = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack(data, self.bits, n)[start - first * self.block : stop - first * self.block]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc ids, offsets, ids) of some documents at a time; offsets count from the first of those ids."""
        k = 0
        while k < len(self.docs):
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, side="right")) - 1)
            yield self.docs[k:to], self.starts[k : to + 1] - self.starts[k], self.ids(int(self.starts[k]), int(self.starts[to]))
            k = to

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    folder: str | None = None,
    partitions: int | None = None,
    table_words: int = 300_000,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """Writes the files; returns their manifest (path, first, n_docs, n_ids), a row a file, first: ids in earlier files.

    table_words and slice_bytes trade a worker's memory for time; as they are, it peaks at about 370 MB.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    fs, path = _filesystem(folder)
    fs.create_dir(path)
    n = partitions or partitions_for(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def write(batches):
        task = TaskContext.get()
        encoder = shared_encoder(tokenizer_path, end_id, table_words)
        bits = bits_for(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        own, at = _filesystem(folder)
        name, temporary = f"{at}/tokens-{task.partitionId():06d}.tok", f"{at}/.attempt-{task.taskAttemptId()}"
        writer = stream = None
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                if writer is None:
                    stream = own.open_output_stream(temporary)
                    writer = TokenFileWriter(stream, bits)
                ids, offsets = encoder.encode(part.column(1))
                writer.add(part.column(0).fill_null(NO_ID).to_numpy(), ids, offsets)
        if writer is not None:
            writer.close()
            stream.close()
            own.move(temporary, name)
            yield pa.record_batch([[task.partitionId()], [f"{folder}/tokens-{task.partitionId():06d}.tok"], [sum(map(len, writer.docs))], [writer.n]], ["pid", "path", "n_docs", "n_ids"])

    # One row a file comes to the driver.
    files = sorted(map_batches(rows, write, "pid long, path string, n_docs long, n_ids long", keeps=True).collect())
    first, manifest = 0, []
    for _, name, n_docs, n_ids in files:
        manifest.append((name, first, n_docs, n_ids))
        first += n_ids
    return spark.createDataFrame(manifest, "path string, first long, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if asked for, ids: array<int>; read from the files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                before = first
                for docs, at, ids in file.documents():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = [pa.array(docs, pa.int64(), mask=docs == NO_ID), before + at[:-1], np.diff(at), crc]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield batch_of(schema, *columns)
                    before += len(ids)
                file.close()

    n = max(1, manifest.count())
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_batches(manifest.select("path", "first").repartition(n), read, ddl)


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer_path, **options))
