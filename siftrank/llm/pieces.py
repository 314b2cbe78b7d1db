"""Operator 2. SentencePiece encoding and decoding: Gumbel top-k sampling of segmentations without replacement.

A piece's probability follows Zipf's law on its rank in the vocabulary, so a segmentation's is the product over its pieces, and a text's lattice of
segmentations has a distribution. ``k`` different segmentations are drawn from it as an A-star search over Gumbel-perturbed log-probabilities draws them: a node is a
partial segmentation, its priority the largest perturbed log-probability below it. The total weight of a node's completions is known exactly from a forward pass over
the lattice, so the first descent is an exact sample; at each of its steps the alternatives left aside hold their own largest value, a Gumbel
truncated at the node's. The largest of these is the next node to expand, and so on. Each result carries its log-probability, its perturbed value and its inclusion score (the log
probability that a draw of this size holds it, given the value of the first one left out).

No piece spans the start of a word, so a lattice is a chain of word lattices; every different word of a batch is built once, and all words of all texts
of a batch descend together as arrays. Random numbers are hashes of the row key, the draw, the word and the step: results do not depend on partitions. There is no shuffle.
Characters outside the vocabulary become bytes. Decoding gives back the text exactly; only a literal U+2581 comes back as a space, as in the library.

Null and empty texts have one segmentation, without pieces. A text with fewer than ``k`` segmentations has fewer rows. Shares are held as logarithms, so however improbable, each segmentation is drawn when ``k`` asks for it. Rows with the same key and text get the same draws. An
empty table gives an empty result. Extra columns are ignored. Text of any length is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siftrank.llm import arrays as A
from siftrank.llm.kneser_ney import HashTable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A step's taken edges are bits of one number.
MOST = 62
SPACE = 0x2581
#: What the table of pieces gives for characters that only end a longer piece, and for those that end none.
ENDING, NONE = -1, -2
BYTE_LOG_P = -12.0
SCHEMA = "doc_id long, draw int, log_prob double, perturbed double, log_inclusion double, round_trip boolean, ids array<int>"


@cache
def vocabulary(path: str) -> dict:
    """The pieces' hash levels; by id, their log-probabilities and their bytes, with spaces as spaces; and the ids of bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) )]
    byte = [next(i for i in range(size) if text[i] == f"<0x{b:02X}>") for b in range(256)]
    rank = np.argsort(np.argsort([-model.get_score(i) for i in plain], kind="stable"))
    weight = 1.0 / (rank + 2.0)
    log_p = np.full(len(text), -np.inf)
    log_p[plain] = np.log(weight / weight.sum())
    points = [np.frombuffer(text[i].encode("utf-32-le"), np.uint32) for i in plain]
    size = np.array([len(p) for p in points])
    ends = np.cumsum(size)
    # every ending of a piece, so that a search from short to long pieces can stop where no piece ends like that
    owner = np.repeat(np.arange(len(plain)), size)
    length = np.arange(1, len(owner) + 1) - np.repeat(ends - size, size)
    keys = A.span_hash(np.concatenate(points), ends[owner] - length, ends[owner])
    order = np.lexsort((length != size[owner], keys))
    first = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
    found = np.where(length == size[owner], np.array(plain)[owner], ENDING)[first].astype(np.int32)
    longest = int(size.max())
    if longest > MOST:
        raise ValueError(f"the model has a piece of {longest} characters; at most {MOST} can be told apart")
    raw = [b""] * len(text)
    for i in plain:
        raw[i] = text[i].replace(chr(SPACE), " ").encode()
    for b, i in enumerate(byte):
        raw[i] = bytes([b])
    return {"table": HashTable(keys[first], found), "longest": longest, "log_p": log_p, "bytes": np.array(byte, np.int32), "raw": raw}


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, from hashes of the parts."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = A.mix(h * A.P1 + np.asarray(p).astype(np.uint64))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Lattices:
    """The lattices of different words, laid end to end. Node ``p`` is the end of a prefix; its edges, pieces before it from short to long, are ``edge[p]`` to ``edge[p + 1]``.

    Each edge has the width and the id of its piece (-1 for bytes), the log of its share at its node, that of the others' share, and the shares up to it.
    """

    def __init__(self, points: np.ndarray, spans: A.Spans, start: np.ndarray, end: np.ndarray, vocab: dict) -> None:
        size = end - start
        first = np.concatenate([[0], np.cumsum(size + 1)])
        self.begin, self.end = first[:-1], first[:-1] + size
        n = int(first[-1])
        depth = np.arange(n) - np.repeat(self.begin, size + 1)
        source = np.repeat(start, size + 1) + depth
        node, width, ids, score = self._pieces(points, spans, depth, source, vocab)
        # edges by the depth of their nodes, so that those of one depth are one slice
        order = np.lexsort((width, node, depth[node]))
        node, width, score = node[order], width[order], score[order]
        new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(node)))
        log_share, alpha = np.zeros(len(node)), np.zeros(n)
        cuts = np.searchsorted(depth[node[new]], np.arange(1, int(size.max(initial=0)) + 2))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            low, high = new[x], new[y] if y < len(new) else len(node)
            begin, times = new[x:y] - low, count[x:y]
            value = score[low:high] + alpha[node[low:high] - width[low:high]]
            top = np.maximum.reduceat(value, begin)
            value -= np.repeat(top, times)
            whole = np.log(np.add.reduceat(np.exp(value), begin))
            alpha[node[new[x:y]]] = top + whole
            log_share[low:high] = value - np.repeat(whole, times)
        # what comes before and after each edge, so that a small rest is no difference of large sums
        share = np.exp(log_share)
        before, after = np.zeros(len(node)), np.zeros(len(node))
        for k in range(1, int(count.max(initial=0))):
            many = np.flatnonzero(count > k)
            at = new[many] + k
            before[at] = before[at - 1] + share[at - 1]
            at = new[many] + count[many] - 1 - k
            after[at] = after[at + 1] + share[at + 1]
        with np.errstate(divide="ignore"):
            others = np.log(before + after)
        upto = before + share
        upto[new + count - 1] = np.inf
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n))]).astype(np.int64)
        back = np.argsort(node, kind="stable")
        self.id, self.width, self.log_share, self.log_others, self.upto = ids[order][back], width[back], log_share[back], others[back], upto[back]
        self.most = int(count.max(initial=1))

    def _pieces(self, points: np.ndarray, spans: A.Spans, depth: np.ndarray, source: np.ndarray, vocab: dict) -> tuple[np.ndarray, ...]:
        """The edges of all nodes: node, width, piece id and score. A character that no piece of one character is becomes bytes."""
        parts = []
        at = np.flatnonzero(depth >= 1)
        alone = np.zeros(len(depth), bool)
        alone[at] = True
        for w in range(1, vocab["longest"] + 1):
            at = at[depth[at] >= w]
            if not len(at):
                break
            got = vocab["table"].find(spans.hash(source[at] - w, source[at]), NONE)
            hit = np.flatnonzero(got >= 0)
            parts.append((at[hit], np.full(len(hit), w), got[hit], vocab["log_p"][got[hit]]))
            if w == 1:
                alone[at[hit]] = False
            at = at[got != NONE]
        bare = np.flatnonzero(alone)
        char = points[source[bare] - 1].astype(np.int64)
        parts.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1, np.int32), BYTE_LOG_P * (1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))))
        self.char = dict(zip(bare.tolist(), char.tolist(), strict=True))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def untaken(self, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logs of the shares of each node's edges that ``mask`` leaves, from short to long."""
        cell = self.edge[p][:, None] + np.arange(self.most)
        inside = cell < self.edge[p + 1][:, None]
        cell = np.where(inside, cell, 0)
        return np.where(inside & ((mask[:, None] >> self.width[cell]) & 1 == 0), self.log_share[cell], -np.inf)


def _cells(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the code points, and the text it belongs to: at a space that follows none, and at each text's start."""
    new = points == SPACE
    new[1:] &= points[:-1] != SPACE
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(new)
    return begin, np.searchsorted(offsets, begin, "right") - 1


class Draw:
    """One segmentation of each text, as steps in the order of the words and from each word's end to its start.

    For each step: ``word``, ``step`` in the word, node ``p``, its edge ``cell``, the widths of the edges taken by this or an earlier draw (``mask``), and ``left``, the largest
    perturbed value among the other edges. ``first`` has where each text's steps begin, ``log_p`` each text's log-probability.
    """

    def __init__(self, word, step, p, cell, mask, bound, fresh, owner, texts, lattices, noise) -> None:
        self.word, self.step, self.p, self.cell, self.mask = word, step, p, cell, mask
        self.text = owner[word]
        self.first = np.searchsorted(self.text, np.arange(texts + 1))
        total = np.concatenate([[0.0], np.cumsum(lattices.log_share[cell])])
        self.before = total[:-1] - total[self.first[:-1]][self.text]
        self.log_p = total[self.first[1:]] - total[self.first[:-1]]
        rest = lattices.log_others[cell]
        more = np.flatnonzero(mask != np.left_shift(np.int64(1), lattices.width[cell]))
        if len(more):
            rest[more] = np.logaddexp.reduce(lattices.untaken(p[more], mask[more]), axis=1)
        loc = self.before + rest
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            value = loc - np.log(np.exp(loc - bound[self.text]) - np.log(noise(word, step)))
        self.left = np.where(fresh & (rest > -np.inf), value, -np.inf)


class Sampler:
    """The draws of one batch of texts, one after another."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray, row_key: np.ndarray, vocab: dict) -> None:
        self.texts = len(offsets) - 1
        begin, self.owner = _cells(points, offsets)
        end = np.append(begin[1:], len(points))
        spans = A.Spans(points)
        _, one, self.lattice = np.unique(spans.hash(begin, end), return_index=True, return_inverse=True)
        self.lattices = Lattices(points, spans, begin[one], end[one], vocab)
        place = np.arange(len(begin)) - np.searchsorted(self.owner, self.owner)
        self.key = A.mix(row_key[self.owner] * A.P1 + place.astype(np.uint64))
        self.row_key = row_key
        self.draws: list[Draw] = []

    def _noise(self, salt: int):
        return lambda word, step: _uniform(self.key[word], step, np.uint64(salt))

    def _descend(self, word: np.ndarray, p: np.ndarray, step: np.ndarray, draw: int) -> list[np.ndarray]:
        """Sample from nodes down to their words' starts: words, steps, nodes and edges, unordered."""
        lat, out = self.lattices, [[word[:0]], [step[:0]], [p[:0]], [p[:0]]]
        start = lat.begin[self.lattice[word]]
        live = np.flatnonzero(p > start)
        p, step, noise = p.copy(), step.copy(), self._noise(2 * draw)
        while len(live):
            at = p[live]
            u = noise(word[live], step[live])
            cell = lat.edge[at]
            longer = np.flatnonzero(lat.upto[cell] < u)
            while len(longer):
                cell[longer] += 1
                longer = longer[lat.upto[cell[longer]] < u[longer]]
            for held, value in zip(out, (word[live], step[live], at, cell), strict=True):
                held.append(value)
            p[live] = at - lat.width[cell]
            step[live] += 1
            live = live[p[live] > start[live]]
        return [np.concatenate(x) for x in out]

    def _add(self, columns: list[np.ndarray], bound: np.ndarray, draw: int) -> None:
        word, step, p, cell, mask, fresh = columns
        order = np.argsort((word << 32) + step, kind="stable")
        self.draws.append(
            Draw(word[order], step[order], p[order], cell[order], mask[order], bound, fresh[order], self.owner, self.texts, self.lattices, self._noise(2 * draw + 1))
        )

    def largest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the largest value that a draw left aside, the draw, and its step."""
        best, of, at = np.full(self.texts, -np.inf), np.zeros(self.texts, np.int64), np.zeros(self.texts, np.int64)
        for i, d in enumerate(self.draws):
            full = np.flatnonzero(d.first[1:] > d.first[:-1])
            if not len(full):
                continue
            top = np.full(self.texts, -np.inf)
            top[full] = np.maximum.reduceat(d.left, d.first[:-1][full])
            rows = np.flatnonzero((d.left > -np.inf) & (d.left == top[d.text]) & (top > best)[d.text])
            of[d.text[rows]], at[d.text[rows]] = i, rows
            best = np.maximum(best, top)
        return best, of, at

    def run(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Draw ``k`` times: the perturbed value of each draw for each text (-inf where there is none), and the next one's."""
        value = [-np.log(-np.log(_uniform(self.row_key, np.uint64(1))))]
        words = np.arange(len(self.owner))
        word, step, p, cell = self._descend(words, self.lattices.end[self.lattice], np.zeros(len(words), np.int64), 0)
        self._add([word, step, p, cell, np.left_shift(np.int64(1), self.lattices.width[cell]), np.ones(len(word), bool)], value[0], 0)
        for draw in range(1, k):
            best, of, at = self.largest()
            value.append(best)
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i in range(draw):
                self._branch(self.draws[i], np.flatnonzero((best > -np.inf) & (of == i)), at, draw, parts)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
            columns[5] = columns[5].astype(bool)
            self._add(columns, best, draw)
        return value, self.largest()[0]

    def _branch(self, d: Draw, texts: np.ndarray, at: np.ndarray, draw: int, parts: list[list[np.ndarray]]) -> None:
        """The next draw of texts whose largest value is beside a step of ``d``: its steps up to there, another edge, and a fresh descent."""
        if not len(texts):
            return
        lat, turn = self.lattices, at[texts]
        count = turn - d.first[texts]
        kept = np.repeat(d.first[texts] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        word, step, p, mask = d.word[turn], d.step[turn], d.p[turn], d.mask[turn]
        share = lat.untaken(p, mask)
        total = np.cumsum(np.exp(share - share.max(1)[:, None]), 1)
        u = self._noise(2 * draw)(word, step) * total[:, -1]
        cell = np.minimum(lat.edge[p] + (total <= u[:, None]).sum(1), lat.edge[p + 1] - 1)
        d.left[turn] = -np.inf
        last = np.searchsorted(self.owner, texts, "right")
        later = last - word - 1
        words = np.repeat(word + 1 - (np.cumsum(later) - later), later) + np.arange(later.sum())
        down = self._descend(
            np.concatenate([word, words]),
            np.concatenate([p - lat.width[cell], lat.end[self.lattice[words]]]),
            np.concatenate([step + 1, np.zeros(len(words), np.int64)]),
            draw,
        )
        for x, columns in enumerate(((d.word[kept], d.step[kept], d.p[kept], d.cell[kept]), (word, step, p, cell), down)):
            own = np.left_shift(np.int64(1), lat.width[columns[3]])
            for held, value in zip(parts, (*columns, mask | own if x == 1 else own, np.full(len(own), x > 0)), strict=True):
                held.append(value)

    def tokens(self, d: Draw, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of each text, flat, with offsets."""
        n = len(d.word)
        first = np.flatnonzero(np.concatenate([[True], d.word[1:] != d.word[:-1]])) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(first, n))
        order = np.repeat(2 * first + length - 1, length) - np.arange(n)
        p, text = d.p[order], d.text
        ids = self.lattices.id[d.cell[order]]
        char = np.zeros(n, np.int64)
        other = np.flatnonzero(ids < 0)
        char[other] = [self.lattices.char[x] for x in p[other].tolist()]
        count = np.where(ids < 0, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
        at = np.cumsum(count) - count
        out = np.repeat(ids, count)
        plain = (ids < 0) & (count == 1)
        out[at[plain]] = vocab["bytes"][char[plain]]
        for i in np.flatnonzero(count > 1):
            out[at[i] : at[i] + count[i]] = vocab["bytes"][list(chr(char[i]).encode())]
        return out, np.concatenate([[0], np.cumsum(np.bincount(text[order], count, self.texts))]).astype(np.int64)


def decoded(ids: np.ndarray, offsets: np.ndarray, vocab: dict) -> pa.Array:
    """The bytes that each text's pieces stand for, with its leading space."""
    raw = pa.array(vocab["raw"], pa.large_binary()).take(pa.array(ids))
    ends = np.frombuffer(raw.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = raw.buffers()[2] if len(ids) else pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].copy()), data])


def encode_batch(batch: pa.RecordBatch, k: int, seed: int, vocab: dict) -> pa.RecordBatch:
    """The draws of one batch of ``doc_id, text``."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    spaced = ["" if t == "" else " " + t for t in texts.to_pylist()]
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32).copy()
    points[points == 0x20] = SPACE
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    doc_id = batch.column("doc_id").cast(pa.int64())
    row_key = A.mix(np.asarray(pc.fill_null(doc_id, -1)).astype(np.int64).view(np.uint64) + np.uint64(seed))
    sampler = Sampler(points, offsets, row_key, vocab)
    value, bound = sampler.run(k)
    want = pa.array(spaced, pa.large_string()).cast(pa.large_binary())
    out = []
    for draw, d in enumerate(sampler.draws):
        ids, at = sampler.tokens(d, vocab)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            x = d.log_p - bound
            inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 30)))))
        full = np.full(batch.num_rows, draw + 1, np.int32)
        rows = pa.RecordBatch.from_arrays(
            [
                doc_id, pa.array(full), pa.array(d.log_p), pa.array(value[draw]), pa.array(inclusion),
                pc.equal(decoded(ids, at, vocab), want), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
            ],
            names=["doc_id", "draw", "log_prob", "perturbed", "log_inclusion", "round_trip", "ids"],
        )
        out.append(rows.filter(pa.array(value[draw] > -np.inf)))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(b.num_rows for b in out) else out[0]


def encode(docs: DataFrame, k: int = 2, seed: int = 11, model: str = MODEL) -> DataFrame:
    """``doc_id, draw, log_prob, perturbed, log_inclusion, round_trip, ids``: up to ``k`` different segmentations of each text, the most perturbed first."""
    known = vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast(known | {"table": known["table"].plain()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value | {"table": HashTable.of(shared.value["table"])}
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                yield encode_batch(batch, k, seed, vocab)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, draw, text`` of rows with ``doc_id, draw, ids``; null ids are an empty text. Bytes that are no text become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast({"raw": vocabulary(model)["raw"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
            raw = decoded(np.asarray(lists.flatten()).astype(np.int32), at, shared.value).to_pylist()
            texts = [b.decode(errors="replace").removeprefix(" ") for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(texts, pa.string())], names=["doc_id", "draw", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), encoded["draw"].cast("int"), encoded["ids"].cast("array<int>")).mapInArrow(run, "doc_id long, draw int, text string")
