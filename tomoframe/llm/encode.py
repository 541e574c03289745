"""Encoding of a whole corpus, each shared chunk once.

Texts are cut into content-defined chunks. Chunks that documents share meet by their hash and are encoded once; their
ids go to all places where they stand. Where two chunks meet, their ids agree with those of the whole text if a visible
character stands before the join and a blank after it, since the tokenizer's pattern always ends a piece there. Any
other join is repaired: the text around it is encoded again, from the last pieces of the pattern that may change until both
chunks' pieces agree, over as many chunks as it takes.

A chunk that many texts of a batch share is spread over several tasks by the batch's number, and encoded in each. Chunks
travel with the number of their text only; the texts' ids come once each, as rows of their own before the chunks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoframe.llm import tokenizers
from tomoframe.llm.chunks import chunk_starts
from tomoframe.session import spread

MEAN_BYTES, MOST_BYTES = 128, 8192
#: Texts are cut in slices of about so many bytes; a chunk in more than one of SHARE texts of a slice counts as hot.
SLICE_BYTES, SHARE, SALTS = 1 << 21, 16, 64
#: Stands for characters that are no letters to the tokenizer, when texts are split.
UNASSIGNED = "\u0378"
#: Places in a batch of encoded chunks.
MOST_PLACES = 20_000
#: Pieces of the tokenizer's pattern at the end of a text that text added to it can change: two, as in "'l" + "l", and one to spare.
MAY_CHANGE = 3

#: A row of chunks with this salt holds the doc_ids of the texts at its places instead of a chunk.
NAMES = -1

_CHUNKS = pa.schema([("chunk", pa.binary()), ("salt", pa.int32()), ("places", pa.binary())])
_CHUNKS_DDL = "chunk binary, salt int, places binary"
_PLACED = pa.schema([("rid", pa.int64()), ("seq", pa.int32()), ("ids", pa.binary())])
_PLACED_DDL = "rid bigint, seq int, ids binary"
#: Where a chunk stands: which text, and as which of its chunks; the names of texts come before their chunks.
_PLACE = np.dtype([("rid", "<i8"), ("seq", "<i4")])


def _packed(spelled: list[bytes]) -> np.dtype:
    """How ids travel between tasks: in as few bytes each as the vocabulary allows."""
    return np.dtype("<u2" if len(spelled) <= 1 << 16 else "<u4")


def _cut(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binaries of the bytes of values[offsets[i]:offsets[i+1]]."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(sizes))
    begin = 0
    for end in ends.tolist():
        yield batch.slice(begin, end - begin)
        begin = end


def _chunked(mean: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_slices = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _slices(batch):
                n_slices += 1
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                texts = pa.concat_arrays([texts])  # from offset 0 on
                offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                starts = chunk_starts(data, offsets, mean, most)
                owner = np.searchsorted(offsets, starts, "right") - 1
                none = np.flatnonzero(np.diff(offsets) == 0)  # empty texts have one empty chunk
                chunks = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes())]), pa.array([b""] * len(none), pa.large_binary())]
                coded = pa.concat_arrays(chunks).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                seq = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
                owner, seq = np.append(owner, none), np.append(seq, np.zeros(len(none), np.int64))
                order = np.argsort(code, kind="stable")
                counts = np.bincount(code, minlength=len(coded.dictionary))
                rids = part.column("rid").to_numpy()
                places = np.empty(len(order), _PLACE)
                places["rid"], places["seq"] = rids[owner[order]], seq[order]
                salt = np.where(counts > max(4, len(texts) // SHARE), n_slices % SALTS, 0)
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(salt, pa.int32()), _cut(places, np.append(0, np.cumsum(counts)))], schema=_CHUNKS)
                named = np.empty(len(rids), _PLACE)
                named["rid"], named["seq"] = rids, NAMES
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                named = named[known]
                names = pc.fill_null(part.column("doc_id"), 0).to_numpy()[known]
                yield pa.RecordBatch.from_arrays([pa.array([names.astype("<i8").tobytes()], pa.binary()), pa.array([NAMES], pa.int32()), pa.array([named.tobytes()], pa.binary())], schema=_CHUNKS)

    return run


def _encoded(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, spelled = tokenizers.byte_bpe(name, folder)
        encode, packed = encoding.encode_ordinary, _packed(spelled)
        last: tuple[bytes, bytes] = (b"", b"")

        def placed(places: pa.Array, ids: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The places of all rows with the ids of each; a row with very many places doesn't make one huge batch."""
            at = np.frombuffer(b"".join(places.to_pylist()), _PLACE)
            for k in range(0, len(at), MOST_PLACES):
                part = at[k : k + MOST_PLACES]
                yield pa.RecordBatch.from_arrays([pa.array(part["rid"].copy()), pa.array(part["seq"].copy()), ids.take(pa.array(rows[k : k + MOST_PLACES]))], schema=_PLACED)

        for batch in batches:
            named = pc.equal(batch.column("salt"), NAMES)
            if pc.any(named).as_py():
                names = batch.filter(named)
                raw = b"".join(names.column("chunk").to_pylist())
                ids = _cut(np.frombuffer(raw, "<i8"), np.arange(len(raw) // 8 + 1))
                yield from placed(names.column("places"), ids, np.arange(len(ids)))
                batch = batch.filter(pc.invert(named))
            if not batch.num_rows:
                continue
            ids = []
            for chunk in batch.column("chunk").to_pylist():
                if chunk != last[0]:
                    last = (chunk, np.array(encode(chunk.decode("utf-8", "replace")), packed).tobytes())
                ids.append(last[1])
            n_places = pc.binary_length(batch.column("places")).to_numpy(zero_copy_only=False) // _PLACE.itemsize
            yield from placed(batch.column("places"), pa.array(ids, pa.binary()), np.repeat(np.arange(len(ids)), n_places))

    return run


class _Joiner:
    """Ids of neighbouring chunks made into the ids of the whole text."""

    def __init__(self, name: str, folder: str):
        encoding, self.spelled = tokenizers.byte_bpe(name, folder)
        self.encode, self.packed = encoding.encode_ordinary, _packed(self.spelled)
        self.pattern = regex.compile(tokenizers.PATTERN)
        first = np.array([s[0] if s else 0 for s in self.spelled])
        last = np.array([s[-1] if s else 0 for s in self.spelled])
        self.blank_first = np.isin(first, (9, 10, 13, 32))
        self.visible_last = (last > 32) & (last < 127)
        self.unknown: dict[str, str] = {}

    def agree(self, left: int, right: int) -> bool:
        return bool(self.visible_last[left] and self.blank_first[right])

    def _spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Where the pattern splits a text. Characters that this Python doesn't know yet are letters only if they are to the
        tokenizer, which shows in where it splits after them."""
        unknown = [c for c in set(text) if unicodedata.category(c) == "Cn"]
        for c in unknown:
            if c not in self.unknown:
                self.unknown[c] = c if self.encode(c + "'s")[-1:] == self.encode("'s") else UNASSIGNED
        if unknown:
            text = text.translate({ord(c): self.unknown[c] for c in unknown})
        return (m.span() for m in self.pattern.finditer(text))

    def _text(self, ids: list[int]) -> str:
        return b"".join([self.spelled[t] for t in ids]).decode("utf-8", "replace")

    def _count(self, ids: list[int], n_bytes: int) -> int:
        """How many of the first ids spell `n_bytes`."""
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.spelled[ids[n]])
            n += 1
        return n

    def joined(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The ids of all pieces in order, each join repaired where the ids don't agree by themselves.

        Text that is added can change the last pieces of the pattern before it, no others: from there the text is split
        again, until it is split where a chunk by itself is split as well. Where one piece of the pattern goes on over several
        chunks they are gathered, each time twice as many, so that such a run is encoded once, in linear time.
        """
        done: list[int] = []
        recent = 0  # where in `done` the text since the last certain place begins
        i = 0
        while i < len(pieces):
            right = pieces[i].tolist()
            if not done or not right or self.agree(done[-1], right[0]):
                recent = len(done)
                done += right
                i += 1
                continue
            before = self._text(done[recent:])
            starts = [b for b, _ in self._spans(before)]
            before = before[starts[-MAY_CHANGE] if len(starts) >= MAY_CHANGE else 0 :]
            first = self._first(done, recent, len(before.encode()))
            n_more, texts, found = 1, [], None
            while found is None:
                texts += [self._text(p.tolist()) for p in pieces[i + len(texts) : i + n_more]]
                found = self._agreed(before, texts, i + n_more >= len(pieces))
                n_more *= 2
            again, k, within = found
            del done[first:]
            for split in again:
                done += self.encode(split)
            done += pieces[i + k].tolist()[self._count(pieces[i + k].tolist(), len(texts[k][:within].encode())) :]
            recent = first  # what lies before it, no text after it can change
            i += k + 1
        return np.array(done, np.int32)

    def _first(self, done: list[int], recent: int, n_bytes: int) -> int:
        """Which of the ids from `recent` on is the first one of the last `n_bytes` bytes."""
        first = len(done)
        while n_bytes > 0 and first > recent:
            first -= 1
            n_bytes -= len(self.spelled[done[first]])
        return first

    def _agreed(self, before: str, texts: list[str], last: bool) -> tuple[list[str], int, int] | None:
        """Splits `before` and the texts of chunks as one text up to the first place at which one of these texts by itself is
        split too: the pieces up to there, which chunk it is, and how far in. Without such a place everything if these are the
        `last` chunks, else None."""
        ends = np.cumsum([len(before), *map(len, texts)]).tolist()
        k, own = 0, {ends[0] + b for b, _ in self._spans(texts[0])}
        text, out = before + "".join(texts), []
        for b, e in self._spans(text):
            while b >= ends[k + 1]:
                k += 1
                own = {ends[k] + x for x, _ in self._spans(texts[k])}
            if b in own:
                return out, k, b - ends[k]
            out.append(text[b:e])
        return (out, len(texts) - 1, len(texts[-1])) if last else None


def _assembled(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = _Joiner(name, folder)
        rid, held = None, []  # the text that may go on in the next batch
        names: dict[int, int] = {}  # of texts that are not finished

        def out(doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

        for batch in batches:
            named = batch.column("seq").to_numpy() == NAMES
            if named.any():
                own = batch.filter(pa.array(named))
                names |= zip(own.column("rid").to_pylist(), (int.from_bytes(x, "little", signed=True) for x in own.column("ids").to_pylist()))
                batch = batch.filter(pa.array(~named))
            n = batch.num_rows
            if not n:
                continue
            rids = batch.column("rid").to_numpy()
            packed = pa.concat_arrays([batch.column("ids").cast(pa.large_binary())])  # from offset 0 on
            offsets = np.frombuffer(packed.buffers()[1], np.int64, n + 1, packed.offset * 8)
            ids = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(joiner.packed).astype(np.int32)
            offsets = (offsets - offsets[0]) // joiner.packed.itemsize
            begins = np.flatnonzero(np.append(True, rids[1:] != rids[:-1]))
            # Joins inside a text that don't agree; joins next to an empty chunk can't be.
            inner = np.flatnonzero(rids[1:] == rids[:-1]) + 1
            at = offsets[inner]
            wrong = inner[~(joiner.visible_last[ids[at - 1]] & joiner.blank_first[ids[np.minimum(at, len(ids) - 1)]])] if len(inner) else inner
            text_of = np.cumsum(np.append(True, rids[1:] != rids[:-1])) - 1
            repair = set(text_of[wrong].tolist())
            ends = np.append(begins[1:], n)
            piece = lambda k, ids=ids, offsets=offsets: ids[offsets[k] : offsets[k + 1]]
            doc_ids, sizes, parts = [], [], []

            def done(of: int, whole: np.ndarray, doc_ids=doc_ids, sizes=sizes, parts=parts) -> None:
                doc_ids.append(names.pop(of, None))
                sizes.append(len(whole))
                parts.append(whole)

            for t, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
                going_on = t == 0 and rid is not None and rids[b] == rid
                if t == 0 and rid is not None and not going_on:
                    done(rid, joiner.joined(held))
                if going_on or e == n:
                    held = (held if going_on else []) + [piece(k) for k in range(b, e)]
                    rid = int(rids[b])
                    if e < n:  # it ended in this batch
                        done(rid, joiner.joined(held))
                        rid, held = None, []
                    continue
                done(int(rids[b]), joiner.joined([piece(k) for k in range(b, e)]) if t in repair else ids[offsets[b] : offsets[e]])
            if doc_ids:
                yield out(doc_ids, np.append(0, np.cumsum(sizes)), np.concatenate(parts))
        if rid is not None:
            whole = joiner.joined(held)
            yield out([names.get(rid)], np.array([0, len(whole)]), whole)

    return run


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.FOLDER, mean: int = MEAN_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of every row of `documents` (doc_id BIGINT, text STRING), without special tokens.

    Null and empty texts have the empty list. Rows are kept apart even with equal or null doc_id. Columns beside these
    two are not looked at. An empty table gives an empty one.
    """
    texts = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = spread(texts).mapInArrow(_chunked(mean, most), _CHUNKS_DDL)
    met = chunks.repartition("chunk", "salt").sortWithinPartitions(F.xxhash64("chunk"), "chunk")
    placed = met.mapInArrow(_encoded(tokenizer, folder), _PLACED_DDL)
    return placed.repartition("rid").sortWithinPartitions("rid", "seq").mapInArrow(_assembled(tokenizer, folder), "doc_id bigint, ids array<int>")
