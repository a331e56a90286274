"""Vector bin packing of tokenized examples into fixed-length training sequences.

Every example is a vector of demands: tokens, one segment, and tokens that bear loss. Sequences are bins with a
capacity in each dimension. A task streams its examples through a bounded pool and fills one bin at a time with the
pooled piece whose demand has the largest dot product with the bin's remaining capacity (Panigrahy et al., "Heuristics
for vector bin packing"). When nothing fits whole, one piece is cut to fill the bin exactly, so bins are padded only
where the segment or loss limit closes them. What is left at a task's end goes to sequences whose lengths are powers
of two. A task keeps the pool, one bin, a tokenizer and a bounded token cache, which all go at its end, as Python
workers live on through other stages; nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import slices, tidy

CACHED_CHUNKS = 150_000
POOL = 192


class ChunkIds(dict):
    """Token ids (little-endian 32-bit) by chunk of UTF-8 text between ASCII white space, filled as chunks come up.

    The vocabulary is a BPE with word ends whose pre-tokenizer never joins text across white space, so a text's ids are
    those of its chunks. A chunk's pre-tokens are merged by tiktoken's engine over the same ranks, with the byte 0xFF
    (which UTF-8 never holds) as the mark of a word's end; that gives the ids of the tokenizers library several times
    faster. Chunks with characters beyond Latin Extended-B go to the tokenizers library itself, since Unicode tables
    of the two could differ there.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[bytes, bytes] = {}  # the generation before: what is still in use moves up, the rest goes
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.known = {}
        self.pieces = None
        if spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("continuing_subword_prefix"):
            self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = [x["content"] for x in spec["added_tokens"]]
            byte_of = byte_alphabet()
            ranks = {}
            for token, i in spec["model"]["vocab"].items():
                ends = token.endswith("</w>") and token != "</w>"
                ranks[bytes(byte_of[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = i
            ranks[b"\xff"] = max(ranks.values()) + 1
            self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            # a mark after letters is a pre-token of its own
            self.tails = {bytes([c]): self.merged(bytes([c])) for c in b",.;:!?)"}

    def plain(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
        if len(chunk) <= 40:
            if len(self) >= CACHED_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def merged(self, piece: bytes) -> bytes:
        return array("I", self.merge(piece + b"\xff")).tobytes()

    def fresh(self, chunk: bytes) -> bytes:
        if self.pieces is not None:
            lower = chunk.lower()  # bytes: A-Z only; isalpha() is true of ASCII letters only
            if lower.isalpha():
                return self.merged(lower)
            if lower[-1:] in self.tails and lower[:-1].isalpha():
                return self.merged(lower[:-1]) + self.tails[lower[-1:]]
        text = chunk.decode()
        if self.pieces is None or not text.isascii() and max(text) > "\u024f" or "\u0130" in text or "<|" in text and any(s in text for s in self.special):
            ids = self.plain(text)
        else:
            found, known = [], self.known
            for piece in self.pieces.findall(unicodedata.normalize("NFC", text).lower()):
                part = known.get(piece)
                if part is None:
                    part = self.merged(piece.encode())
                    if len(piece) <= 40:
                        if len(known) >= CACHED_CHUNKS:
                            known.clear()
                        known[piece] = part
                found.append(part)
            ids = b"".join(found)
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others come after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> ChunkIds:
    return ChunkIds(path)


class Packer:
    """Packs pieces (payload, tokens, loss_from) into bins. emit(bin) gets a list of pieces: (payload, start, stop).

    loss_from is the first position of the example that bears loss, so a piece start:stop bears
    max(0, stop - max(start, loss_from)) of it. The pool holds POOL pieces, and more while they don't fill a bin, which
    is never more than a bin has tokens.
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int, emit: Callable[[list], None]):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss, self.emit = capacity, max_segments, max_loss, emit
        self.payloads: list = [None] * POOL
        self.spans = np.zeros((POOL, 3), np.int64)  # start, stop, loss_from
        self.needs = np.zeros((POOL, 3))  # tokens, segments, tokens that bear loss
        self.size = self.tokens = 0

    def add(self, payload: object, tokens: int, loss_from: int) -> None:
        at = 0
        while True:
            stop = min(tokens, at + self.capacity, max(at, loss_from) + self.max_loss)
            if stop - at == self.capacity:  # fills a bin alone
                self.emit([(payload, at, stop)])
            elif stop > at:
                while self.size >= POOL and (self.tokens >= self.capacity or self.size >= self.max_segments):
                    self.fill()
                self.put(payload, at, stop, loss_from)
            at = stop
            if at >= tokens:
                return

    def put(self, payload: object, start: int, stop: int, loss_from: int) -> None:
        if self.size == len(self.spans):
            self.payloads += [None] * self.size
            self.spans, self.needs = np.concatenate([self.spans, self.spans]), np.concatenate([self.needs, self.needs])
        self.payloads[self.size], self.spans[self.size] = payload, (start, stop, loss_from)
        self.needs[self.size] = stop - start, 1, max(0, stop - max(start, loss_from))
        self.size += 1
        self.tokens += stop - start

    def take(self, i: int) -> tuple:
        item = (self.payloads[i], *self.spans[i].tolist())
        self.size -= 1
        self.tokens -= item[2] - item[1]
        self.payloads[i], self.spans[i], self.needs[i] = self.payloads[self.size], self.spans[self.size], self.needs[self.size]
        self.payloads[self.size] = None
        return item

    def fill(self) -> None:
        """Fill one bin from the pool and emit it."""
        room, bin_ = self.limits.copy(), []
        while self.size:
            need = self.needs[: self.size]
            score = need @ (room / self.limits**2)
            score[(need > room).any(1)] = -1.0
            i = int(score.argmax())
            if score[i] < 0:
                break
            room -= need[i]
            payload, start, stop, _ = self.take(i)
            bin_.append((payload, start, stop))
        if self.size and room[0] > 0 and room[1] > 0:  # cut the longest to what is left
            i = int(self.needs[: self.size, 0].argmax())
            payload, start, stop, loss_from = self.take(i)
            middle = int(min(stop, start + room[0], max(start, loss_from) + room[2]))
            if middle > start:
                bin_.append((payload, start, middle))
            if middle < stop:
                self.put(payload, middle, stop, loss_from)
        self.emit(bin_)

    def finish(self) -> None:
        """Whole bins while they fill, then power-of-two sequences for the rest."""
        while self.size:
            if self.tokens >= self.capacity:
                self.fill()
                continue
            rest = [self.take(0) for _ in range(self.size)]
            total = sum(x[2] - x[1] for x in rest)
            length, bin_, room, segments, loss = 1 << (total.bit_length() - 1), [], 0, 0, 0
            room = length
            while rest and room:
                payload, start, stop, loss_from = rest.pop()
                middle = min(stop, start + room, max(start, loss_from) + self.max_loss - loss)
                if middle == start or segments == self.limits[1]:
                    rest.append((payload, start, stop, loss_from))
                    break
                bin_.append((payload, start, middle))
                segments, room, loss = segments + 1, room - (middle - start), loss + max(0, middle - max(start, loss_from))
                if middle < stop:
                    rest.append((payload, middle, stop, loss_from))
            for x in rest:
                self.put(*x)
            self.emit(bin_)


def pack_examples(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int | None = 1, capacity: int = 2048, max_segments: int | None = None, max_loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack every row of docs; one output row per piece.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids, array<int>, if
    with_ids). prompt_col names a text that comes first and bears no loss (instruction data). end_id ends each example.
    A null text or prompt is empty; an empty example still has its end_id. Rows that repeat, and null ids, are packed
    as rows of their own. Other columns are ignored, whatever their names. An empty table gives no rows. Long texts are
    cut at capacity; no token is dropped. sequence_id is unique over the whole result. max_segments and max_loss default to
    capacity, at which they never close a sequence before its tokens do; a smaller limit can leave padding.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    max_segments, max_loss = (capacity if x is None else x for x in (max_segments, max_loss))
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("capacity, max_segments and max_loss must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = encoder(tokenizer_path), b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        out, count = [], [TaskContext.get().partitionId() << 40]

        def emit(bin_: list) -> None:
            offset = 0
            for (key, ids, loss_from), start, stop in bin_:
                part = ids[4 * start : 4 * stop]
                row = (key, start, stop - start, zlib.crc32(part), len(ids) // 4, count[0], offset, max(0, stop - max(start, loss_from)))
                out.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
                offset += stop - start
            count[0] += bool(bin_)

        packer = Packer(capacity, max_segments, max_loss, emit)
        last = None
        for batch in batches:
            last = batch.schema.field(0).type
            for part in slices(batch.num_rows, 256):
                rows = batch.slice(part.start, part.stop - part.start)
                for key, text, prompt in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                    head = table.ids(prompt) if prompt else b""
                    ids = head + (table.ids(text) if text else b"") + end
                    packer.add((key, ids, len(head) // 4), len(ids) // 4, len(head) // 4)
                if len(out) >= 4096:
                    yield from rows_of(out, last)
                    out.clear()
        packer.finish()
        yield from rows_of(out, last)

    def rows_of(out: list, key_type: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        if out:
            cols = list(zip(*out, strict=True))
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in cols[8]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *names, *["ids"] * with_ids])

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col), F.col(text_col).alias("_text"), prompt.alias("_prompt")).mapInArrow(tidy(run), schema)
