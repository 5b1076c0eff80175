"""Token ids in fixed-width packed files.

A file holds the documents of one range of ids, in ascending order, or of one range of
another order the caller names; files are numbered in that order:

    magic "TMKPACK1" | header: bits, tokens per block, tokens, documents (4 x u64)
    blocks           | every id in `bits` bits, least significant first; a block starts
                     | on a byte and holds `block` tokens (the last may hold fewer)
    block offsets    | u64 for each block, from the start of the file
    documents        | i64 id and u64 end (in tokens) for each document

All integers are little-endian. Any run of tokens is read from its blocks alone.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, ranges_of, unkeyed
from tidemark.sources.shared import materialise, table_folder

MAGIC = b"TMKPACK1"
_HEAD = struct.Struct("<4Q")


@dataclass(frozen=True)
class PackOptions:
    """`ids` is the number of ids a token may take (it fixes the width), 0 for as many as the
    tokenizer has; `end` closes a document. `cached` bounds the words a worker remembers; `files` the tasks that write,
    0 for the session's shuffle partitions."""

    tokenizer: str
    ids: int = 0
    end: int = 2
    block: int = 1 << 16
    cached: int = 300_000
    files: int = 0


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`bits` bits for each id, least significant bit first, padded to a byte. An id that
    does not fit is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little")
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


# Kinds of Latin-1 characters (blanks that part words, letters, all others) and their lower case.
_BLANK, _LETTER, _OTHER = 0, 1, 2
_KINDS = np.array([_BLANK if c in " \n" else _LETTER if c.isalpha() else _OTHER for c in map(chr, range(256))], np.uint8)
_BLANKS = np.where(_KINDS == _BLANK, _BLANK, _OTHER).astype(np.uint8)
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
# Words that go to the merges, and characters of texts that are encoded, in one go.
_AT_ONCE, _CHARS = 500, 1 << 21
_ENCODERS: dict[str, Encoder] = {}
# What the tokenizer of pieces does before its merges.
_FOLDS = ["NFC", "Replace", "Lowercase"]
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_at_spaces(described: dict) -> bool:
    folds = (described.get("normalizer") or {}).get("normalizers", [])
    cuts = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = any(f.get("pattern") == {"Regex": r"\s+"} and f.get("content") == " " for f in folds)
    return (
        [f["type"] for f in folds] == _FOLDS
        and spaces
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": _CUTS}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and described["model"].get("end_of_word_suffix") == "</w>"
    )


def _cuttable(text: str) -> bool:
    """Latin-1 alone, where letters have one lower-case form and nothing composes, and
    nothing that could be a token of its own."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def _folded_word(piece: str) -> bool:
    """Latin-1 letters alone, in lower case: the tokenizer leaves them as they are, uncut."""
    return piece.isalpha() and (piece.isascii() or max(piece) <= "\xff") and piece == piece.lower()


def described(path: str) -> tuple[int, bool]:
    """Ids of a tokenizer, and whether it may encode by pieces. Read once, on the driver."""
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    added = [t["id"] for t in tokenizer.get("added_tokens", [])]
    return max([*tokenizer["model"]["vocab"].values(), *added]) + 1, _cuts_at_spaces(tokenizer)


def _parted(texts: list[str], latin: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(pieces of each text, place of each piece in the list, different pieces). All are
    cut and compared as bytes, in Latin-1 or else in UTF-8, without an object per piece."""
    data = [t.encode("latin-1" if latin else "utf-8") for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    joined = b"\n".join([*data, b""])
    del data
    chars = np.frombuffer(joined.translate(_LOWER) if latin else joined, dtype=np.uint8)
    kinds = (_KINDS if latin else _BLANKS)[chars]
    first = np.empty(len(kinds), dtype=bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    # An apostrophe stays with letters after it, which may be its ending.
    first[1:] &= (chars[:-1] != ord("'")) | (kinds[1:] != _LETTER)
    stays = kinds != _BLANK
    first &= stays
    counts = np.diff(np.searchsorted(np.flatnonzero(first), begins))
    chars, cuts = chars[stays], np.flatnonzero(first[stays])
    ends = np.append(cuts, len(chars)).astype(np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(chars)]
    coded = pa.Array.from_buffers(pa.binary() if latin else pa.string(), len(cuts), buffers).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return counts, coded.indices.to_numpy(), [w.decode("latin-1") for w in found] if latin else found


class Encoder:
    """Ids of whole texts as little-endian u32 bytes.

    The tokenizer folds white space and cuts at it before its merges, so the ids of a text
    are those of its pieces between spaces in a row, and a piece met before is looked up.
    A text in Latin-1 is lower-cased as the tokenizer does, and also cut where letters end, and
    where they begin unless an apostrophe stands before them; the tokenizer cuts there too. New
    words of letters alone go to the tokenizer's merges without folding and cutting again,
    many in one go, and are told apart by the tokens that end a word; if their number differs,
    the whole tokenizer takes them one by one.

    Pieces are remembered in two generations of half of `cached` each: the younger one, once
    full, becomes the older, and a piece of the older met again moves to the younger.

    That holds for tokenizers that fold and cut as `_FOLDS` and `_CUTS` say; any other
    encodes whole texts.
    """

    def __init__(self, path: str, cached: int, by_pieces: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cached, self.by_pieces = Tokenizer.from_file(path), cached, by_pieces
        # The same model without the folding and the cutting, which folded words do not need.
        self.merges = Tokenizer(self.tokenizer.model)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(f.ids, dtype="<u4").tobytes() for f in found]
        out = [b""] * len(texts)
        latin = [_cuttable(t) for t in texts]
        for kind in (True, False):
            places = [i for i, l in enumerate(latin) if l == kind]
            if places:
                for i, ids in zip(places, self._joined(*_parted([texts[i] for i in places], kind)), strict=True):
                    out[i] = ids
        return out

    def forget(self) -> None:
        """Lets go of all pieces: a worker idle after its task, or at other work, holds none."""
        self.known, self.older = {}, {}

    def _joined(self, counts: np.ndarray, places: np.ndarray, pieces: list[str]) -> Iterator[bytes]:
        """Ids of each text from those of its pieces."""
        if len(self.known) > self.cached // 2:
            self.known, self.older = {}, self.known
        self._learn(self._unknown(pieces))
        ids = list(map(self.known.__getitem__, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        low = 0
        for n in counts.tolist():
            mine = places[low : low + n]
            size = sizes[mine]
            ends = np.cumsum(size)
            steps = np.arange(ends[-1] if n else 0)
            yield pool[np.repeat(starts[mine] - ends + size, size) + steps].tobytes()
            low += n

    def _unknown(self, pieces: list[str]) -> list[str]:
        """Those in neither generation; what the older one has moves to the younger."""
        known, older = self.known, self.older
        new = [p for p in pieces if p not in known]
        known.update((p, older[p]) for p in new if p in older)
        return [p for p in new if p not in known]

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if _folded_word(w)]
        for low in range(0, len(words), _AT_ONCE):
            self._encode_words(words[low : low + _AT_ONCE])
        rest = [w for w in new if w not in self.known]
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[str]) -> None:
        ids = np.array(self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return
        data, low = ids.tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.known[word] = data[low:stop]
            low = stop


def encoder(path: str, cached: int, by_pieces: bool) -> Encoder:
    """The worker's encoder, kept from task to task without the pieces it met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cached, by_pieces)
    return _ENCODERS[path]


def _encoded(batches: Iterator[pa.RecordBatch], options: PackOptions, bits: int, by_pieces: bool) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    worker, end = encoder(options.tokenizer, options.cached, by_pieces), np.array([options.end], "<u4").tobytes()
    for batch in batches:
        texts = batch.column("text")
        # A few texts at a time are taken out of the batch; sizes in bytes are at least those in characters.
        for low, high in ranges_of(pc.binary_length(texts).to_pylist(), _CHARS):
            counts, packed = [], []
            for found in worker.encode(texts[low:high].to_pylist()):
                ids = np.frombuffer(found + end, dtype="<u4")
                counts.append(len(ids))
                packed.append(pack(ids, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key")[low:high], pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                names=["key", "n", "packed"],
            )
    worker.forget()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _written(batches: Iterator[pa.RecordBatch], folder: str, options: PackOptions, bits: int) -> Iterator[pa.RecordBatch]:
    """Writes one file under a name of its own and moves it to its place, so that a lost or
    repeated task leaves whole files only."""
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    files, root = _open(folder)
    number = TaskContext.get().partitionId()
    name = f"{number:06d}.pack"
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    offsets, keys, ends, total = [], [], [], 0
    left = np.empty(0, dtype=np.uint32)
    body = f"{draft}.body"
    files.create_dir(root, recursive=True)
    with files.open_output_stream(body) as out:

        def flush(ids: np.ndarray) -> None:
            offsets.append(out.tell())
            out.write(pack(ids, bits))

        for batch in itertools.chain([first], batches):
            got = [left]
            for key, n, packed in zip(*(batch.column(c) for c in ("key", "n", "packed")), strict=True):
                got.append(unpack(packed.as_py(), bits, n.as_py()))
                total += n.as_py()
                keys.append(key.as_py())
                ends.append(total)
            left = np.concatenate(got)
            whole = len(left) // options.block * options.block
            for at in range(0, whole, options.block):
                flush(left[at : at + options.block])
            left = left[whole:]
        if len(left):
            flush(left)
        head = len(MAGIC) + _HEAD.size
        out.write((np.array(offsets, "<u8") + np.uint64(head)).astype("<u8").tobytes())
        out.write(np.array([keys, ends], "<i8").T.tobytes())
    with files.open_output_stream(draft) as out, files.open_input_stream(body) as source:
        out.write(MAGIC + _HEAD.pack(bits, options.block, total, len(keys)))
        while data := source.read(1 << 22):
            out.write(data)
    files.delete_file(body)
    files.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays(
        [pa.array([f"{folder}/{name}"]), *(pa.array([x], pa.int64()) for x in (number, keys[0], total, len(keys)))],
        names=["file", "number", "first_key", "n_tokens", "n_docs"],
    )


class PackedFile:
    """Random access to one file."""

    def __init__(self, path: str):
        folder, _, name = path.rpartition("/")
        files, root = _open(folder)
        self.source = files.open_input_file(f"{root}/{name}")
        head = self.source.read_at(len(MAGIC) + _HEAD.size, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a packed file")
        self.bits, self.block, self.n_tokens, self.n_docs = _HEAD.unpack(head[len(MAGIC) :])
        blocks = -(-self.n_tokens // self.block)
        tail = self.source.size() - 8 * blocks - 16 * self.n_docs
        self.offsets = np.append(np.frombuffer(self.source.read_at(8 * blocks, tail), "<u8"), tail)
        self.docs = np.frombuffer(self.source.read_at(16 * self.n_docs, tail + 8 * blocks), "<i8").reshape(-1, 2)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop), from the blocks that hold them."""
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        got = []
        for b in range(start // self.block, -(-stop // self.block)):
            low, high = int(self.offsets[b]), int(self.offsets[b + 1])
            n = min(self.block, self.n_tokens - b * self.block)
            ids = unpack(self.source.read_at(high - low, low), self.bits, n)
            got.append(ids[max(0, start - b * self.block) : max(0, stop - b * self.block)])
        return np.concatenate(got)


def stored_order(docs: DataFrame) -> list[Column]:
    """The place of a row in the Parquet files `docs` is read from, files in the order of the
    tasks that wrote them. Rows that come from no file have no such place: an empty list."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(name, row)
    except AnalysisException:
        return []
    task = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    return [task, name, row]


def write_tokens(docs: DataFrame, options: PackOptions, order: Sequence[Column] = ()) -> DataFrame:
    """Encodes and writes; returns the stored manifest (file, number, first_key, n_tokens,
    n_docs), a row for each file. Documents stand in ascending `order`, or without one by id.
    NULL and empty texts are the end id alone; repeated ids are documents of their own; a NULL
    id comes first. An empty table writes no file."""
    spark = docs.sparkSession
    known, by_pieces = described(options.tokenizer)
    bits = max(1, (max(options.ids or known, options.end + 1) - 1).bit_length())
    folder = table_folder(spark, "tokens")
    parts = options.files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [f"order{i}" for i in range(len(order))]
    rows = keyed(docs, more=[c.alias(m) for c, m in zip(order, marks, strict=True)])
    ordered = rows.repartitionByRange(parts, *marks, "key").sortWithinPartitions(*marks, "key", "text")
    manifest = ordered.select("key", "text").mapInArrow(
        lambda it: _written(_encoded(it, options, bits, by_pieces), folder, options, bits),
        "file string, number long, first_key long, n_tokens long, n_docs long",
    )
    return materialise(manifest, "tokens-manifest")


def read_tokens(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) for each document in the files; `start` counts the tokens
    before it in all files. `ids` are u32 little-endian bytes; with `digests` their crc32,
    ids_crc32, stands in their place, so that one worker a task reads and digests."""
    last, kind = ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, before in ((f.as_py(), n.as_py()) for b in batches for f, n in zip(b.column("file"), b.column("before"), strict=True)):
            packed, start = PackedFile(path), 0
            for low in range(0, packed.n_docs, 64):
                rows = packed.docs[low : low + 64]
                stop = int(rows[-1, 1])
                ids, base = packed.tokens(start, stop).astype("<u4"), start
                starts = np.concatenate(([start], rows[:-1, 1]))
                data = [ids[a - base : b - base].tobytes() for a, b in zip(starts, rows[:, 1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[:, 0]),
                        pa.array(starts + before, pa.int64()),
                        pa.array(rows[:, 1] - starts, pa.int64()),
                        pa.array(map(zlib.crc32, data) if digests else data, kind),
                    ],
                    names=["key", "start", "n_tokens", last],
                )
                start = stop

    # A fixed number of partitions: a file's row is small, the file behind it is not.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = file_starts(manifest).repartition(parts, "file")
    return spread.mapInArrow(read, f"key long, start long, n_tokens long, {last} {'long' if digests else 'binary'}")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(file, before): tokens in all files before each. One row a file, so one task is
    enough for the running sum."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))


def token_digests(docs: DataFrame, options: PackOptions, order: Sequence[Column] = ()) -> DataFrame:
    """Write, read back, and describe each document: doc_id, start, n_tokens, ids_crc32."""
    read = read_tokens(write_tokens(docs, options, order), digests=True)
    return read.select(unkeyed("key", "doc_id"), "start", "n_tokens", "ids_crc32")
