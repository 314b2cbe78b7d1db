"""Operator 6. Line dedup: exact set-similarity join over lines (prefix, positional and length filters, then Jaccard).

1. A scan counts words in ``2 ** RARITY_BITS`` hash buckets. Words are ordered by the count of their bucket, then by hash: rare ones first. Any global order makes the prefix filter exact;
   the table of counts has a fixed size, so that its broadcast is bounded.
2. A second scan turns each line into its set of lower-cased words, with a digest, a bitmap and the prefix: the first ``n - ceil(t n) + 1`` words in that order. Of equal sets in one batch only the
   earliest line has a prefix, so a line with a million copies is a few postings. All lines are stored; everything else reads this table.
3. Postings meet by word. In a list the shorter set of a pair must have the word among its first ``n - ceil(2 t / (1 + t) n) + 1``; lists are sorted by length, so that the length filter is a range; the positional filter and
   a bitmap bound on the overlap (each word flips one bit; sets differ by at least as many words as bitmaps by bits) come next. Each line keeps its earliest ``FEW`` candidates in a list, not all its pairs.
4. A word that occurs over ``BLOCK`` times may have a list too long for one task. Its postings go by bands of length instead (only neighbouring bands can meet), cut into blocks of ``BLOCK``, and are first
   compared with the ``EARLY`` earliest of the band only: in a large group of near copies these settle nearly all.
5. Candidates are verified on whole word sets, fetched for the lines that need it only (a Bloom filter over their places thins out the scan). Lines whose kept candidates all fail while a list was cut
   are waiting; a second round compares them, and only them, with whole lists. So nothing is lost by keeping few.

A line is removed if an earlier line has a similarity of ``threshold`` or more, itself removed or not. Lines of fewer than ``min_words``
different words are left alone; the query and the pipeline pass 1, so that only lines without words are. Sets too small to resemble any but an equal one
(of up to 3 words at 0.8) are matched by their digests alone, 96 bits of them, and post nothing. Candidates are verified on the words themselves, not on hashes. Null and empty texts have no lines to remove; rows with a null ``doc_id`` take no part, as their lines have no place in the order. Repeated rows: the copy of a
line in the same document and place is the same line; where rows of one ``doc_id`` hold different texts, a place is removed if any of its lines is. An empty table gives an empty result. Extra columns are ignored by
:func:`duplicate_lines` and dropped by :func:`remove_lines`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.sources.checkpoints import cut, stored

RARITY_BITS = 22
#: The longest list of one word that one task compares; longer ones are cut.
BLOCK = 4096
EARLY = 1024
#: Candidates that a line keeps in each list in the first round.
FEW = 8
#: Pairs that a task looks at in one step.
PAIRS = 1_000_000
#: Bytes of text that a scan holds as words at a time.
TEXT = 2_000_000
#: Sets of more words have a bitmap of 128 bits; 64 do not tell them apart.
WIDE = 64
#: The second round's tables are broadcast up to this many rows, and joined by a shuffle beyond.
SMALL = 500_000
#: Spreads line numbers over the Bloom filter of places.
SPREAD = 2_654_435_761

_BITS = np.uint64(44)
_LOW = np.uint64((1 << 44) - 1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different words as codes, flat, with offsets, and two 64-bit hashes of each code's word.

    Codes hold for these texts only, and equal ones are equal words. They ascend within a text, in the order of the words' low 44 bits of the first hash, the others next.
    """
    flat, offsets = A.words(texts)
    if not len(flat):
        return np.zeros(0, np.int64), offsets, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    one, two = A.string_hash(coded.dictionary), A.string_hash(coded.dictionary, A.P2)
    order = np.argsort((one << np.uint64(20)) | (one >> _BITS))
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    size = np.diff(offsets)
    key = np.sort((np.repeat(np.arange(len(size)), size) << 32) | code[np.asarray(coded.indices)[: offsets[-1]]])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    size = np.bincount(key >> 32, minlength=len(size))
    return key & 0xFFFFFFFF, np.concatenate([[0], np.cumsum(size)]), one[order], two[order]


def _split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of a batch's texts, the row that each comes from, and its number."""
    split = pc.split_pattern(pc.fill_null(batch.column("text"), "").cast(pa.large_string()), "\n")
    at = np.asarray(split.offsets).astype(np.int64)
    at = at - at[0]
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    return split.flatten(), row, np.arange(at[-1]) - at[:-1][row]


def _digests(one: np.ndarray, two: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each word set, of 64 bits and of 32, as signed numbers: a polynomial of the first hashes of its words, and a sum of the second ones, in which order plays no part."""
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(two)])
    return A.signed(A.span_hash(one, offsets[:-1], offsets[1:])), A.mix(other[offsets[1:]] - other[offsets[:-1]]).astype(np.uint32).view(np.int32)


def rarity(docs: DataFrame) -> np.ndarray:
    """How many words fall in each hash bucket, over all documents; at most 2 ** 32 - 1.

    A task sends its counts by ranges of buckets, a row for each range that it has words of; tasks add up the ranges dealt to them as they read, and hold one number for each bucket of these.
    """
    bits = RARITY_BITS
    parts = 1 << min(10, bits)
    width = (1 << bits) // parts
    names, schema = ["part", "bucket", "n"], "part int, bucket array<int>, n array<long>"

    def rows_of(part: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """A row for each range, of parts in ascending order."""
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        at = pa.array(np.append(first, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for whole in batches:
            for batch in A.pieces_of(whole, "text", TEXT):
                coded = A.words(batch.column("text"))[0].dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                np.add.at(total, (A.string_hash(coded.dictionary) & np.uint64((1 << bits) - 1)).astype(np.int64), n)
        used = np.flatnonzero(total)
        yield rows_of(used // width, used % width, total[used])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                held = total.setdefault(part, np.zeros(width, np.int64))
                held[batch.column("bucket")[i].values.to_numpy()] += batch.column("n")[i].values.to_numpy()
        for part, held in total.items():
            used = np.flatnonzero(held)
            yield rows_of(np.full(len(used), part), used, held[used])

    sent = docs.select("text").mapInArrow(run, schema).repartition(min(_parts(docs), parts), "part")
    rows = sent.mapInArrow(add, schema).toArrow()
    out = np.zeros(1 << bits, np.uint32)
    for part, bucket, n in zip(*(rows.column(c) for c in names), strict=True):
        out[part.as_py() * width + bucket.values.to_numpy()] = np.minimum(n.values.to_numpy(), (1 << 32) - 1)
    return out


def _prefixes(h: np.ndarray, offsets: np.ndarray, counts: np.ndarray, bits: int, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each set's prefix, rarest word first: words as 31 bits, below 0 if they may have a long list, and each set's offsets into them."""
    size = np.diff(offsets)
    count = counts[(h & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    # within a text the hashes ascend already, and the sort is stable
    order = np.argsort((owner << 32) + count, kind="stable")
    pos = np.arange(len(h)) - offsets[:-1][owner]
    length = np.where(size > 0, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)
    order = order[pos < length[owner]]
    word = (h[order] & np.uint64((1 << 31) - 1)) | np.where(count[order] > block, np.uint64(1 << 31), np.uint64(0))
    return word.astype(np.uint32).view(np.int32), np.concatenate([[0], np.cumsum(length)])


def _bitmaps(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's bitmap: 128 bits of sets over ``WIDE`` words, else 64 and a zero. The two halves of the wider one give the narrower one by exclusive or."""
    low, both = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        one = np.uint64(1) << (h >> np.uint64(38))
        both[full] = np.bitwise_xor.reduceat(one, offsets[:-1][full])
        low[full] = np.bitwise_xor.reduceat(np.where((h >> np.uint64(37)) & np.uint64(1) == 0, one, np.uint64(0)), offsets[:-1][full])
    wide = np.diff(offsets) > WIDE
    return np.where(wide, low, both), np.where(wide, low ^ both, np.uint64(0))


def least_near(threshold: float) -> int:
    """The size from which a set can resemble one that is not equal to it: sets of n and n + 1 words agree in n / (n + 1) at most."""
    return math.ceil(threshold / (1 - threshold) - 1e-6) if threshold < 1 else 1 << 30


def line_sets(docs: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """``doc_id, tag, d1, n, b0, b1, prefix`` of every line with ``min_words`` different words or more.

    ``tag`` is the line's number and, above it, the digest ``d2`` of 32 bits; sets with the same ``d1`` and ``d2`` count as equal. Only the earliest line of a batch with its set has a prefix.
    """
    least, bits, block = least_near(threshold), RARITY_BITS, BLOCK
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for batch in A.pieces_of(whole, "text", TEXT):
                text, row, number = _split(batch)
                code, offsets, one, two = _sets(text)
                h, size = one[code], np.diff(offsets)
                d1, d2 = _digests(h, two[code], offsets)
                ids = np.asarray(batch.column("doc_id").cast(pa.int64()))[row]
                own = np.flatnonzero(size >= max(min_words, 1))
                own = own[np.lexsort((number[own], ids[own], d2[own], d1[own]))]
                first = np.ones(len(own), bool)
                first[1:] = (d1[own][1:] != d1[own][:-1]) | (d2[own][1:] != d2[own][:-1])
                post = np.zeros(len(size), bool)
                post[own[first]] = True
                post &= size >= least
                # the words of the posting lines only
                at = np.concatenate([[0], np.cumsum(np.where(post, size, 0))])
                h = h[np.repeat(post, size)] & _LOW
                word, end = _prefixes(h, at, counts, bits, block, threshold)
                b0, b1 = _bitmaps(h, at)
                tag = (d2[own].astype(np.int64) << 32) | number[own]
                length = np.diff(end)[own]
                start = np.repeat(end[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(own) else np.zeros(0, np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(word[start + np.arange(len(start))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(tag), pa.array(d1[own]), pa.array(size[own].astype(np.int32)), pa.array(A.signed(b0[own])), pa.array(A.signed(b1[own])), prefix],
                    names=["doc_id", "tag", "d1", "n", "b0", "b1", "prefix"],
                )

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, tag long, d1 long, n int, b0 long, b1 long, prefix array<int>")


def line_no(tag: str = "tag") -> Column:
    return F.col(tag).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def digest(tag: str = "tag") -> Column:
    return F.shiftright(tag, 32).cast("int")


def place(doc: str, tag: str) -> Column:
    return F.struct(F.col(doc).alias("doc_id"), line_no(tag).alias("line_no"))


PAIR = "a_doc long, a_tag long, b_doc long, b_tag long, more boolean"


def _earliest(a: np.ndarray, b: np.ndarray, doc: np.ndarray, line: np.ndarray, few: int) -> tuple[np.ndarray, ...]:
    """The pairs with each ``a``'s earliest ``few`` partners, their ranks, and how many partners each has."""
    order = np.lexsort((line[b], doc[b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    count = np.searchsorted(a, a, "right") - np.searchsorted(a, a)
    keep = rank < few
    return a[keep], b[keep], rank[keep], count[keep]


def _compare(threshold: float, few: int, keys: list[str]):
    """Candidates within each group of postings: for each later line its earliest ``few``; ``more`` marks the last of a cut list.

    ``role`` has bit 1 for lines that look for earlier ones and bit 2 for those that can be found; in groups with a ``g``, pairs belong to the group of the longer one's band.
    """
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in A.whole_groups(batches, keys):
            column = lambda c: table.column(c).to_numpy()  # noqa: E731, B023
            size = column("n_pos") >> 32
            key = (group.astype(np.int64) << 32) | size
            order = np.lexsort((column("tag") & 0xFFFFFFFF, column("doc_id"), column("b0"), key))
            key, n = key[order], size[order]
            doc, tag, role = column("doc_id")[order], column("tag")[order], column("role")[order]
            pos = (column("n_pos") & 0xFFFFFFFF)[order]
            b0, b1 = column("b0")[order].view(np.uint64), column("b1")[order].view(np.uint64)
            same = (key[1:] == key[:-1]) & (b0[1:] == b0[:-1]) & (tag[1:] >> 32 == tag[:-1] >> 32) & (role[1:] == role[:-1])
            keep = np.concatenate([[True], ~same])
            key, n, doc, tag, role, pos, b0, b1 = (x[keep] for x in (key, n, doc, tag, role, pos, b0, b1))
            band = column("band")[order][keep] if "g" in keys else None
            g = column("g")[order][keep] if "g" in keys else None
            line = tag & 0xFFFFFFFF
            index = np.flatnonzero(pos < n - np.ceil(2 * share * n - 1e-9).astype(np.int64) + 1)
            known = key[index]
            low = np.searchsorted(known, (key - n) + np.ceil(threshold * n - 1e-9).astype(np.int64))
            high = np.searchsorted(known, key)
            high[index] = np.arange(len(index))
            count = np.maximum(high - low, 0)
            upto, at = np.cumsum(count), 0
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            while at < len(key):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                c = count[at:end]
                i = np.repeat(np.arange(at, end), c)
                j = index[np.repeat(low[at:end] - (np.cumsum(c) - c), c) + np.arange(len(i))]
                at = end
                both = n[i] + n[j]
                apart = both - 2 * np.ceil(share * both - 1e-9).astype(np.int64)
                ok = 2 * (np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])) >= both - apart
                i, j, apart = i[ok], j[ok], apart[ok]
                x, y = b0[i] ^ b0[j], b1[i] ^ b1[j]
                wide = (n[i] > WIDE) & (n[j] > WIDE)
                ok = np.where(wide, np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y), np.bitwise_count(x ^ y)) <= apart
                if band is not None:
                    ok &= np.maximum(band[i], band[j]) == g[i]
                i, j = i[ok], j[ok]
                later = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
                one, two = np.where(later, i, j), np.where(later, j, i)
                ok = (role[one] & 1 > 0) & (role[two] & 2 > 0) & ((doc[i] != doc[j]) | (line[i] != line[j]))
                a, b = np.concatenate([a, one[ok]]), np.concatenate([b, two[ok]])
                if len(a) > 2 * PAIRS:
                    a, b, *_ = _earliest(a, b, doc, line, few + 1)
            if not len(a):
                continue
            a, b, rank, count = _earliest(a, b, doc, line, few)
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(tag[a]), pa.array(doc[b]), pa.array(tag[b]), pa.array((rank == few - 1) & (count > few))], names=["a_doc", "a_tag", "b_doc", "b_tag", "more"])

    return run


def postings(sets: DataFrame, *carry: str) -> DataFrame:
    """One row for each word of each prefix; ``n_pos`` is the set's size and, below it, the word's position."""
    rows = sets.where(F.size("prefix") > 0).select("doc_id", "tag", "n", "b0", "b1", *carry, F.posexplode("prefix").alias("pos", "word"))
    return rows.select("word", "doc_id", "tag", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("n_pos"), "b0", "b1", *carry)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def list_candidates(post: DataFrame, threshold: float, few: int, role: Column) -> DataFrame:
    """Candidates from the lists of words that occur ``BLOCK`` times at most."""
    dealt = post.repartition(_parts(post), "word").sortWithinPartitions("word")
    return dealt.withColumn("role", role).mapInArrow(_compare(threshold, few, ["word"]), PAIR)


def band_members(sets: DataFrame, threshold: float, *carry: str) -> DataFrame:
    """The postings of frequent words, once for each set, in the group ``g`` of their own band of lengths and in that of the next."""
    post = postings(sets, "d1", *carry).where("word < 0")
    once = post.groupBy("word", "d1", "n_pos", "b0", "b1", *carry).agg(F.min(F.struct("doc_id", "tag")).alias("p")).select("word", "p.doc_id", "p.tag", "n_pos", "b0", "b1", *carry)
    band = F.floor(F.log(F.shiftright("n_pos", 32).cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    return once.withColumn("band", band).withColumn("g", F.explode(F.array("band", F.col("band") + 1)))


def band_candidates(looking: DataFrame, found: DataFrame, threshold: float, few: int) -> DataFrame:
    """Candidates for ``looking`` among ``found``, both members of bands, in pairs of blocks of ``BLOCK`` postings of each."""
    sizes = lambda rows, name: rows.groupBy("word", "g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    # read back, so that the joins below have plain shuffles on both sides and a frequent word's side can be split
    blocks = stored(sizes(looking, "na").hint("merge").join(sizes(found, "nb"), ["word", "g"]))

    def dealt(rows: DataFrame, own: str, other: str, role: int) -> DataFrame:
        rows = rows.hint("merge").join(blocks, ["word", "g"])
        rows = rows.withColumn(f"b{own}", F.pmod(F.xxhash64("doc_id", "tag"), f"n{own}").cast("int")).withColumn(f"b{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        return rows.select("word", "g", "ba", "bb", "doc_id", "tag", "n_pos", "b0", "b1", "band", F.lit(role).alias("role"))

    keys = ["word", "g", "ba", "bb"]
    both = dealt(looking, "a", "b", 1).unionByName(dealt(found, "b", "a", 2))
    return both.repartition(_parts(both), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold, few, keys), PAIR)


def _bloom(ids: DataFrame, column: str, most: int = 1 << 29) -> np.ndarray:
    """A one-hash Bloom filter as an array of 64-bit words: 16 bits for each id, and at most ``most`` bits, beyond which it only lets more through."""
    n = ids.count()
    size = 1 << max(12, min(most.bit_length() - 1, int(16 * max(n, 1)).bit_length()))
    at = F.pmod(F.col(column), F.lit(size))
    rows = ids.groupBy(F.floor(at / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _in_bloom(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids.view(np.uint64) & np.uint64(len(bloom) * 64 - 1)
    return (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def needed_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, line_no, d1, d2, words``: the text of the lines at these places, and of a few others; equal lines of repeated rows once."""
    key = F.col("doc_id").bitwiseXOR(F.col("line_no").cast("long") * SPREAD)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(places.select(key.alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for whole in batches:
            for batch in A.pieces_of(whole, "text", TEXT):
                text, row, number = _split(batch)
                ids = np.asarray(batch.column("doc_id").cast(pa.int64()))[row]
                own = np.flatnonzero(_in_bloom(bloom, ids ^ (number * SPREAD)))
                text = text.take(pa.array(own)).cast(pa.string())
                code, offsets, one, two = _sets(text)
                d1, d2 = _digests(one[code], two[code], offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(number[own].astype(np.int32)), pa.array(d1), pa.array(d2), text], names=["doc_id", "line_no", "d1", "d2", "words"]
                )

    found = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, line_no int, d1 long, d2 int, words string")
    return found.groupBy("doc_id", "line_no", "d1", "d2").agg(F.min("words").alias("words"))


def _verify(threshold: float):
    names = ["a_doc", "a_tag", "d1", "b_doc", "b_line", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in range(0, whole.num_rows, 1 << 16):
                batch = whole.slice(x, 1 << 16)
                code, offsets, *_ = _sets(pa.concat_arrays([pc.fill_null(batch.column(c), "").cast(pa.large_string()) for c in ("words_a", "words_b")]))
                size, rows = np.diff(offsets), batch.num_rows
                an, bn = size[:rows], size[rows:]
                key = np.sort((np.repeat(np.arange(2 * rows) % rows, size) << 32) | code)
                both = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=rows)
                near = both >= threshold * (an + bn - both) - 1e-9
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(near)], names=[*names, "near"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs with the digest ``d1`` of their later line, and ``near``, whether their similarity reaches the threshold."""
    ends = [F.struct(F.col(f"{s}_doc").alias("doc_id"), line_no(f"{s}_tag").alias("line_no")) for s in "ab"]
    places = cut(pairs.select(F.explode(F.array(*ends)).alias("p")).select("p.*").distinct())
    texts = stored(needed_texts(docs, places))
    side = lambda s, *more: texts.select(F.col("doc_id").alias(f"{s}_doc"), F.col("line_no").alias(f"{s}_line"), F.col("words").alias(f"words_{s}"), *more)
    both = pairs.withColumns({f"{s}_line": line_no(f"{s}_tag") for s in "ab"}).drop("b_tag")
    both = both.hint("merge").join(side("a", "d1", "d2"), ["a_doc", "a_line"]).where(digest("a_tag") == F.col("d2"))
    both = both.hint("merge").join(side("b"), ["b_doc", "b_line"])
    schema = "a_doc long, a_tag long, d1 long, b_doc long, b_line int, more boolean"
    return both.select("a_doc", "a_tag", "d1", "b_doc", "b_line", "more", "words_a", "words_b").mapInArrow(_verify(threshold), schema + ", near boolean")


def _joined(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join whose right side is broadcast behind a check of its size."""
    return rows.join(F.broadcast(few) if few.count() <= SMALL else few.hint("merge"), on, how)


def _settle(docs: DataFrame, pairs: DataFrame, left_out: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(d1, d2, first)`` of the lines whose earliest match is known, and ``(a_doc, a_tag)`` of those that wait for the whole lists."""
    pairs = stored(pairs.groupBy("a_doc", "a_tag", "b_doc", "b_tag").agg(F.bool_or("more").alias("more")))
    b = F.struct(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no"))
    each = verified(docs, pairs, threshold).select("a_doc", "a_tag", "d1", F.when(F.col("near"), b).alias("first"), F.when(F.col("more"), b).alias("cut"))
    if left_out is not None:
        each = each.unionByName(left_out, allowMissingColumns=True)
    each = cut(each.groupBy("a_doc", "a_tag").agg(F.max("d1").alias("d1"), F.min("first").alias("first"), F.min("cut").alias("cut")))
    # what a cut list left out is later than what it kept: a match before that is the earliest
    done = "first IS NOT NULL AND (cut IS NULL OR first <= cut)"
    return each.where(done).select("d1", digest("a_tag").alias("d2"), "first"), each.where(f"cut IS NOT NULL AND NOT ({done})").select("a_doc", "a_tag")


def first_matches(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(d1, d2, first)``: for each set that resembles an earlier one, the earliest line of those that it resembles."""
    pairs, left_out = list_candidates(postings(sets).where("word >= 0"), threshold, FEW, F.lit(3)), None
    hot = not sets.where(F.exists("prefix", lambda w: w < 0)).isEmpty()
    if hot:
        members = stored(band_members(sets, threshold))
        rank = F.row_number().over(Window.partitionBy("word", "g").orderBy("doc_id", line_no()))
        early = stored(members.withColumn("rank", rank).where(F.col("rank") <= EARLY))
        ends = stored(early.where(F.col("rank") == EARLY).select("word", "g", place("doc_id", "tag").alias("cut")))
        pairs = pairs.unionByName(band_candidates(members, early.drop("rank"), threshold, FEW))
        later = members.hint("merge").join(ends, ["word", "g"]).where(place("doc_id", "tag") > F.col("cut"))
        left_out = later.groupBy(F.col("doc_id").alias("a_doc"), F.col("tag").alias("a_tag")).agg(F.min("cut").alias("cut"))
    found, waiting = _settle(docs, pairs, left_out, threshold)
    waiting = cut(waiting)
    if waiting.isEmpty():
        return found
    ask = waiting.select(F.col("a_doc").alias("doc_id"), F.col("a_tag").alias("tag"), F.lit(True).alias("asks"))
    marked = _joined(sets.where(F.size("prefix") > 0), ask, ["doc_id", "tag"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    words = cut(marked.where("asks").select(F.explode("prefix").alias("word")).where("word >= 0").distinct())
    post = _joined(postings(marked, "asks").where("word >= 0"), words, ["word"], "left_semi")
    whole = 1 << 30
    pairs = list_candidates(post, threshold, whole, F.when(F.col("asks"), 3).otherwise(2))
    if hot:
        asking = _joined(members, ask.drop("asks"), ["doc_id", "tag"], "left_semi")
        pairs = pairs.unionByName(band_candidates(asking, members, threshold, whole))
    rest, _ = _settle(docs, pairs, None, threshold)
    return found.unionByName(rest)


def duplicate_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """Every line that an earlier line resembles: ``doc_id, line_no`` and the earliest such line ``first_doc_id, first_line_no``."""
    sets = stored(line_sets(docs, threshold, min_words))
    sets = sets.withColumn("d2", digest())
    own = sets.groupBy("d1", "d2").agg(F.min(place("doc_id", "tag")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("d1", "d2", "first")
    # read back, so that the join has plain shuffles on both sides and a frequent line's side can be split
    first = stored(own.union(first_matches(docs, sets, threshold)).groupBy("d1", "d2").agg(F.min("first").alias("first")))
    removed = sets.select("d1", "d2", "doc_id", line_no().alias("line_no")).hint("merge").join(first, ["d1", "d2"]).select("doc_id", "line_no", "first")
    removed = removed.where(F.struct("doc_id", "line_no") > F.col("first")).groupBy("doc_id", "line_no").agg(F.min("first").alias("first"))
    return removed.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))


def remove_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without their removed lines; one that has lost all its words goes. Keeps the columns of documents."""
    gone = removed.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone"))
    left = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("gone", i)), "\n"
    )
    joined = docs.hint("merge").join(gone, docs["doc_id"] == F.col("gone_id"), "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return (
        joined.withColumn("text", text)
        .where(F.col("gone").isNull() | (F.trim("text") != ""))
        .select("doc_id", "text", "lang", "source", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars"))
    )
