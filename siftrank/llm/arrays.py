"""Array helpers that run inside Arrow batches: hashing of words, shingles and whole texts without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        _POWERS[int(base)] = have
    return have


class Spans:
    """Hashes of spans of one array of values, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, base: np.uint64 = P1) -> None:
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each ``values[start:end]``."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * P2)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = P1) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``."""
    return Spans(values, base).hash(start, end)


def string_hash(array: pa.Array, base: np.uint64 = P1) -> np.ndarray:
    """A 64-bit hash of each string's UTF-8 bytes; nulls hash as empty strings."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array) or offsets[-1] == offsets[0]:
        return mix(np.zeros(len(array), np.uint64))
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return span_hash(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], base)


def words(texts: pa.Array, ascii: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words between white space, flat, and each text's offsets into them. With ``ascii`` only A-Z are lower-cased, and only ASCII's white space parts words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if ascii:
        texts = pa.concat_arrays([texts])  # a copy without an offset: the ASCII functions misread slices
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    else:
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
    if empty.any():
        offsets = offsets - np.concatenate([[0], np.cumsum(empty)])[offsets]
        flat = flat.filter(pa.array(~empty))
    return flat, offsets


def word_hashes(flat: pa.Array, base: np.uint64 = P1) -> np.ndarray:
    """A 64-bit hash of each word; every different word is hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    return string_hash(coded.dictionary, base)[np.asarray(coded.indices)]


#: Stripped from the ends of words by :func:`bare_hashes`.
PUNCTUATION = ".,;:!?|%*&$#()[]{}<>\"'`~-_=+/\\"


def bare_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' lower-cased words without punctuation at their ends, flat, and each text's offsets into them."""
    flat, offsets = words(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), offsets
    coded = flat.dictionary_encode()
    return string_hash(pc.utf8_trim(coded.dictionary, PUNCTUATION))[np.asarray(coded.indices)], offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, with offsets. A shorter text that has words is one shingle."""
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    end = np.minimum(start + n, np.repeat(offsets[1:], count))
    return (span_hash(hashes, start, end) if len(start) else np.zeros(0, np.uint64)), out


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, held = 0, 0
    for i, s in enumerate(size):
        if held and held + s > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(s)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``keys``, of a partition sorted by them; one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [np.asarray(table.column(k)) for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change), table.num_rows]
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            held.append(table.slice(x, y - x))
            if i < len(cuts) - 2:
                yield pa.concat_tables(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of a partition sorted by the keys, in tables that no group spans, each with the number of its rows' groups."""

    def changes(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return change

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        change = changes(table)
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield table.slice(0, last), np.cumsum(change[:last])
        held = table.slice(last)
    if held is not None:
        yield held, np.cumsum(changes(held))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, as Spark's long has them."""
    return x.view(np.int64)
