"""Token ids as flat binary files with 64-bit offsets, memory-mapped.

A folder holds, for each partition of the documents in ascending order of their ids, three files: ``tokens`` (ids as
little-endian unsigned integers of 2 bytes, or 4 if the vocabulary has more than 65,536; each document ends with the end
id), ``offsets`` (for each document, the number of ids of all documents before it, as a little-endian integer of 64
bits) and ``names`` (the document's id in JSON, a line each); and a table ``parts`` of the partitions: part, base, tokens, docs. Bases are
prefix sums of the partitions' tokens, one row a partition.

Spark's own text writer puts the bytes down, so files go wherever Spark can write, are committed task by task, and a lost
executor costs its tasks only: the writer ends a row with a separator, and here the separator is the last part of the
record itself: the end id, or the highest byte of an offset (0 below 2**56).

Scale: one shuffle of the texts, by ranges of (id, hash of the text, row), so that an id or text that many rows share is
dealt over several partitions. Sorted partitions are encoded once and kept by a checkpoint, from which tokens, offsets
and names are written without a shuffle. A partition takes about ``part_bytes`` of text.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits, punctuation
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffles_go
from .tokens import _vocabulary

NAME, END, PART_BYTES, SLICE, ROWS = "word_bpe_49k.json", 2, 32 << 20, 12 << 20, 2000
#: Cached parts of texts that a Python worker keeps at most, the longest that it keeps, and how many are encoded at once.
CACHED, LONGEST, TOGETHER = 1_000_000, 64, 20_000
#: Pre-tokenizers that always cut between an ASCII letter or digit and an ASCII mark other than '.
APART = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: 1 for ASCII letters and digits, 2 for those marks, 0 for all other bytes.
KINDS = bytes(1 if chr(b) in ascii_letters + digits else 2 if chr(b) in punctuation and chr(b) != "'" else 0 for b in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


class Encoder:
    """A tokenizers file. ``by_words`` says that the tokenizer drops blanks and never looks across one; then each
    distinct part between the six ASCII blanks is encoded once and kept, which gives the same ids as whole texts in a fraction
    of the time. What differs in A-Z only is encoded once if the tokenizer lowers letters itself, and a word apart from the
    marks behind it if the tokenizer cuts there."""

    def __init__(self, data: bytes, by_words: bool = True) -> None:
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(data)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        normalizer = self.tokenizer.normalizer
        self.normal = normalizer.normalize_str if normalizer else str
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = self.normal(ascii_uppercase) == ascii_lowercase
        # what these normalizers make of ASCII without A-Z, with single blanks between parts, is the same text
        file = json.loads(data)
        steps = file.get("normalizer")
        steps = steps.get("normalizers", [steps]) if steps else []
        plain = lambda x: x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        self.keeps_ascii = self.lowers and all(map(plain, steps))
        self.marks_apart = self.keeps_ascii and (file.get("pre_tokenizer") or {}).get("pretokenizers") == APART
        self.bare = Tokenizer.from_buffer(data)
        self.bare.normalizer = Sequence([])
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.removesuffix("</w>"))  # a character of a token stands for a byte
        self.by_words, self.known = by_words, {b"": b""}  # beside a blank at either end of a text there is an empty part

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _alone(self, texts: list[bytes]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)]

    def _together(self, some: list[bytes]) -> list[bytes]:
        """The ids of each part, encoded as one text with a blank between them and dealt by the bytes that ids stand for;
        where these do not add up to the parts' own, each part is encoded alone."""
        raw = b" ".join(some)
        text = raw.decode(errors="replace")
        normal = text if self.keeps_ascii and raw.isascii() and raw == raw.lower() else self.normal(text)
        if all(normal.count(a) == text.count(a) for a in self.added):
            ids = self.bare.encode_batch_fast([normal], add_special_tokens=False)[0].ids
            raw, ends = self._bytes(ids), np.cumsum(self.lengths[ids])
            own = np.cumsum([len(p) for p in normal.encode().split(b" ")])
            cuts = np.searchsorted(ends, own)
            if len(own) == len(some) and len(ends) and own[-1] == ends[-1] and (ends[cuts] == own).all():
                at = [0, *((cuts + 1) * self.width).tolist()]
                return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        return self._alone(some)

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        parts, ids = sorted(new, key=bytes.isascii), {}  # those past ASCII together, so that the others need no normalizer
        for at in range(0, len(parts), TOGETHER):
            some = parts[at : at + TOGETHER]
            ids.update(zip(some, self._together(some), strict=True))
        return ids

    def _simpler(self, texts: pa.Array) -> pa.Array:
        """Texts of the same ids with fewer distinct parts: lowered, and with a blank between a word and the marks behind it.
        Added tokens are taken as they stand, so texts of a stretch that holds one are left alone."""
        low = pc.ascii_lower(texts)
        _, upto, data = low.buffers()
        upto = np.frombuffer(upto, np.int32)[low.offset :][: len(low) + 1]
        raw = data.to_pybytes()[upto[0] : upto[-1]] if data else b""
        if not self.lowers or any(a.encode() in raw for a in self.added):
            return texts
        if not self.marks_apart or len(raw) > 1 << 30:
            return low
        kind = np.frombuffer(raw.translate(KINDS), np.uint8)
        at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        upto = upto - upto[0]
        upto = (upto + np.searchsorted(at, upto)).astype(np.int32)
        return pa.StringArray.from_buffers(len(low), pa.py_buffer(upto), pa.py_buffer(np.insert(np.frombuffer(raw, np.uint8), at, ord(" "))))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, as bytes, without an end."""
        return self.encode_column(pa.array(texts, pa.binary())).to_pylist()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """``encode`` for a binary column. Arrow splits the texts, lists their distinct parts and joins what these stand for;
        only distinct parts become Python objects."""
        texts = texts.fill_null(b"")
        if not self.by_words or not len(texts):
            return pa.array(self._alone(texts.to_pylist()), pa.binary())
        parts = pc.ascii_split_whitespace(self._simpler(texts.view(pa.string())))  # Arrow's functions for ASCII look at bytes alone
        coded = parts.flatten().view(pa.binary()).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        if len(self.known) > CACHED:
            self.known = {b"": b""}
        ids = list(map(self.known.get, kinds))
        new = [i for i, x in enumerate(ids) if x is None]
        found = self._learn([kinds[i] for i in new])
        for i in new:
            ids[i] = found[kinds[i]]
        self.known.update(found)
        for p in found:
            if len(p) > LONGEST:
                del self.known[p]
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, pa.array(ids, pa.binary()).take(coded.indices)), b"")


_loaded: dict[int, Encoder] = {}


def _encoded(shared, id_: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id_ not in _loaded:
            _loaded.clear()
            _loaded[id_] = Encoder(shared.value, by_words)
        encoder = _loaded[id_]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            # slices of about SLICE bytes, whatever the length of a text
            upto = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(batch)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                ids = encoder.encode_column(texts[at:end])
                n = pa.array(np.asarray(pc.binary_length(ids), np.int64) // encoder.width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], n, ids], ["name", "n", "ids"])

    return run


def _starts(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not len(batch):
                continue
            at = bases[batch.column(0)[0].as_py()] if at is None else at
            ends = at + np.cumsum(np.asarray(batch.column(1)) + 1)
            starts = np.concatenate([[at], ends[:-1]]).astype("<i8")
            at = int(ends[-1])
            if at >> 56:
                raise OverflowError("more than 2**56 ids")
            low = np.ascontiguousarray(starts.view(np.uint8).reshape(-1, 8)[:, :7])
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(0, 7 * len(starts) + 1, 7, dtype=np.int32)), pa.py_buffer(low)])], ["value"])

    return run


def _write(rows: DataFrame, path: str, separator: bytes) -> None:
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("compression", "none").text(path)


def _sorted_ids(documents: DataFrame, doc_id: str, text: str, shared, by_words: bool, part_bytes: int) -> DataFrame:
    """(name, n, ids) in ascending order of ids over the partitions of a checkpoint."""
    own = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("row").asc()]
    placed = own.withColumn("h", F.xxhash64("t")).repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    named = placed.select(F.to_json(F.struct("id"), {"ignoreNullFields": "false"}).alias("name"), "t")
    return cut(named.mapInArrow(_encoded(shared, shared._jbroadcast.id(), by_words), "name string, n long, ids binary"))


def write_tokens(documents: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, by_words: bool = True, part_bytes: int = PART_BYTES) -> None:
    """Writes all documents' ids to ``folder``, in ascending order of doc_id (null first), each with the end id.

    Null texts are empty ones and have the end only. Rows of one id are in order of their texts' hash; repeated rows are
    written each. No documents give files without documents. Other columns are ignored.
    """
    spark = documents.sparkSession
    data = _vocabulary(vocabulary or vocabulary_path())
    width = Encoder(data, by_words).width
    with shuffles_go(spark):  # the checkpoint holds all there is to know; the texts' shuffle goes before as much is written again
        encoded = _sorted_ids(documents, doc_id, text, spark.sparkContext.broadcast(data), by_words, part_bytes)

    part = F.spark_partition_id().alias("part")
    parts = encoded.groupBy(part).agg(F.sum(F.col("n") + 1).alias("tokens"), F.count("*").alias("docs")).orderBy("part").collect()  # a row a partition
    bases = [0, *accumulate(r["tokens"] for r in parts)]
    rows = [(r["part"], base, r["tokens"], r["docs"], width, end) for r, base in zip(parts, bases, strict=False)]
    spark.createDataFrame(rows, "part int, base long, tokens long, docs long, width int, end long").coalesce(1).write.parquet(f"{folder}/parts")
    _write(encoded.select(F.col("ids").cast("string")), f"{folder}/tokens", end.to_bytes(width, "little"))
    starts = encoded.select(part, "n").mapInArrow(_starts({r["part"]: b for r, b in zip(parts, bases, strict=False)}), "value binary")
    _write(starts.select(F.col("value").cast("string")), f"{folder}/offsets", b"\0")
    _write(encoded.select("name"), f"{folder}/names", b"\n")


def _buffer(where: str | bytes | None, kind: str) -> np.ndarray:
    """A file's numbers: memory-mapped by its path, or of its bytes where only Spark reaches the file."""
    if where is None:
        return np.zeros(0, kind)
    if isinstance(where, bytes):
        return np.frombuffer(where, kind)
    path = unquote(urlparse(where).path)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, starts = _buffer(r["tokens"], f"<u{r['width']}"), _buffer(r["offsets"], "<i8")
                names = _buffer(r["names"], "u1").tobytes().decode().split("\n")
                ends = np.append(starts[1:], r["base"] + r["n"])
                for at in range(0, len(starts), ROWS):
                    own = [ids[a - r["base"] : b - r["base"]] for a, b in zip(starts[at : at + ROWS].tolist(), ends[at : at + ROWS].tolist(), strict=True)]
                    columns = [pa.array(names[at : at + len(own)]), pa.array(starts[at : at + ROWS], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["name", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Tasks memory-map the files where the folder is mounted; on a store that only Spark reaches they get the bytes of a
    file at a time. One row of ``parts`` is the unit of work.
    """
    mounted = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    parts = spark.read.parquet(f"{folder}/parts").withColumnRenamed("tokens", "n")
    for kind in ("tokens", "offsets", "names"):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{kind}")
        number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int")
        parts = parts.join(files.select(number.alias("part"), F.col("path" if mounted else "content").alias(kind)), "part", "left")
    unit = parts.repartition(max(1, parts.count()), "part") if mounted else parts
    rows = unit.mapInArrow(_documents(with_ids), "name string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    rest = ["start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return rows.select(F.from_json("name", f"id {id_type}")["id"].alias(doc_id), *rest)


class TokenFiles:
    """A folder that is mounted here, for a training loader: numbered documents and stretches of ids, read through
    memory maps that are opened when they are first asked for."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        self.folder = folder
        rows = sorted(pq.read_table(f"{folder}/parts").to_pylist(), key=lambda r: r["part"])
        self.parts = [r for r in rows if r["docs"]]
        self.first = np.array([0, *accumulate(r["docs"] for r in self.parts)])
        self.base = np.array([0, *accumulate(r["tokens"] for r in self.parts)])
        self.maps: dict[tuple[int, str], np.ndarray] = {}

    def __len__(self) -> int:
        return int(self.first[-1])

    def _map(self, k: int, kind: str, what: str) -> np.ndarray:
        if (k, kind) not in self.maps:
            named = f"part-{self.parts[k]['part']:05d}"
            path = next(f for f in os.listdir(f"{self.folder}/{kind}") if f.startswith(named))
            self.maps[k, kind] = _buffer(f"{self.folder}/{kind}/{path}", what)
        return self.maps[k, kind]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to, not including, ``stop``, over as many files as they lie in."""
        found, at = [], max(start, 0)
        stop = min(stop, int(self.base[-1]))
        while at < stop:
            k = int(np.searchsorted(self.base, at, "right")) - 1
            upto = min(stop, int(self.base[k + 1]))
            found.append(self._map(k, "tokens", f"<u{self.parts[k]['width']}")[at - self.base[k] : upto - self.base[k]])
            at = upto
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, "right")) - 1
        starts = self._map(k, "offsets", "<i8")
        at = i - int(self.first[k])
        return self.ids(int(starts[at]), int(starts[at + 1]) if at + 1 < len(starts) else int(self.base[k + 1]))
