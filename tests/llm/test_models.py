"""Operators 2, 5 and 8: exact laws, round trips, and that both ways of scoring agree."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from siftrank.llm import arrays as A
from siftrank.llm import kneser_ney, pieces, quality, toxicity
from tests.llm.fixtures import DOCS, corpus, frame, prose, words


def segmentations(text, vocab):
    table = {b.decode(): i for i, b in enumerate(vocab["raw"]) if i > 258 and b}
    text = " " + text

    def rec(i):
        if i == len(text):
            yield (), 0.0
        for w in range(1, 17):
            if i + w <= len(text) and text[i : i + w] in table:
                for rest, lp in rec(i + w):
                    yield (table[text[i : i + w]], *rest), lp + vocab["log_p"][table[text[i : i + w]]]

    every = list(rec(0))
    z = math.log(sum(math.exp(lp) for _, lp in every))
    return {s: lp - z for s, lp in every}


def test_gumbel_draws_follow_the_law():
    vocab, n, text = pieces.vocabulary(pieces.MODEL), 20_000, "the cat"
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], names=["doc_id", "text"])
    got = pieces.encode_batch(batch, 3, 5, vocab).to_pylist()
    law = segmentations(text, vocab)
    by = {}
    for r in got:
        assert r["log_prob"] == pytest.approx(law[tuple(r["ids"])], abs=1e-4)
        by.setdefault(r["doc_id"], []).append(r)
    pairs = Counter()
    for rows in by.values():
        rows.sort(key=lambda r: r["draw"])
        assert len({tuple(r["ids"]) for r in rows}) == len(rows) == 3
        assert all(a["perturbed"] >= b["perturbed"] for a, b in zip(rows, rows[1:]))
        pairs[tuple(rows[0]["ids"]), tuple(rows[1]["ids"])] += 1
    for (a, b), count in pairs.most_common(6):
        p = math.exp(law[a]) * math.exp(law[b]) / (1 - math.exp(law[a]))
        assert abs(count / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


@pytest.mark.parametrize("text", ["ab", "the cat", "running"])
def test_all_segmentations_of_a_short_text(text):
    """More draws than there are segmentations: each of them, however improbable, comes once."""
    vocab = pieces.vocabulary(pieces.MODEL)
    law = segmentations(text, vocab)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], names=["doc_id", "text"])
    got = pieces.encode_batch(batch, len(law) + 5, 5, vocab).to_pylist()
    for i in (1, 2):
        own = {tuple(r["ids"]): r["log_prob"] for r in got if r["doc_id"] == i}
        assert own == pytest.approx(law, abs=1e-3) and len([r for r in got if r["doc_id"] == i]) == len(law)


def test_encode_decode_round_trip(spark):
    df = frame(spark)
    encoded = pieces.encode(df).cache()
    docs = {r[0]: r[1] or "" for r in corpus()}
    assert all(r.round_trip for r in encoded.collect())
    for r in pieces.decode(encoded).collect():
        assert r.text == docs[r.doc_id]
    again = {(r.doc_id, r.draw): r.ids for r in pieces.encode(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.draw): r.ids for r in encoded.collect()}
    assert pieces.encode(spark.createDataFrame([], DOCS)).count() == 0
    assert pieces.encode(spark.createDataFrame([(None, None, None, None, None), (None, "the catalogue", None, None, None)], DOCS)).count() == 3


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    docs, marks = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.2
        w = words(rng, rng.randint(20, 80))
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(("grobwort", "schimpf"))
        text = " ".join(x + "%%%$" for x in w) if junk else " ".join(w)
        docs.append((i, text, "en" if i % 2 else "de", "s", len(text)))
        marks.append((i, int(not junk), int(toxic)))
    return docs, marks


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    docs, marks = labelled()
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(d, m).collect()}
    held = [i for i, *_ in docs if got[i].held_out]
    truth = {i: t for i, _, t in marks}
    assert len(held) > 50 and sum(got[i].predicted == truth[i] for i in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    moved = {r.doc_id: r.score for r in toxicity.toxicity(d.withColumn("lang", d["source"]), m).collect()}
    assert all(abs(moved[i] - got[i].score) < 1e-9 for i in moved)
    joined = {r.doc_id: r.score for r in toxicity.toxicity(d, m, model_rows=0).collect()}
    assert all(abs(joined[i] - got[i].score) < 1e-9 for i in joined)


def test_toxicity_takes_awkward_tables(spark):
    _, marks = labelled(60)
    m = spark.createDataFrame(marks, LABELS)
    assert toxicity.toxicity(frame(spark), m).count() == len(corpus())
    assert {r.predicted for r in toxicity.toxicity(frame(spark), m.limit(0)).collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), m).count() == 0
    assert toxicity.ordinary(frame(spark), m.limit(0)).columns == frame(spark).columns


def test_quality_separates_junk(spark):
    docs, marks = labelled()
    d, m = spark.createDataFrame([*docs, (900, "", "en", "s", 0), (901, None, None, None, None)], DOCS), spark.createDataFrame(marks, LABELS)
    got = {r.doc_id: r for r in quality.quality(d, m).collect()}
    good = [i for i, q, _ in marks if q]
    assert sum(got[i].keep for i in good) / len(good) >= 0.95
    assert not any(got[i].keep for i, q, _ in marks if not q)
    assert got[900].perplexity is None and got[901].keep == 0
    joined = {r.doc_id: r.perplexity for r in quality.quality(d, m, model_rows=0).collect()}
    assert all(joined[i] == pytest.approx(got[i].perplexity, rel=1e-9) for i, *_ in docs)


def test_both_ways_agree_on_awkward_ids(spark):
    """Rows with a null, a repeated or a clashing ``doc_id`` get their own values, whatever the size of the model."""
    docs, marks = labelled(200)
    bad, text = "grobwort " + docs[2][1], docs[1][1]
    extra = [(None, bad), (None, text), (None, None), (900, bad), (900, bad), (901, bad), (901, text), (901, ""), (docs[0][0], docs[0][1])]
    d = spark.createDataFrame([*docs, *((i, t, "en", "s", 1) for i, t in extra)], DOCS)
    m = spark.createDataFrame(marks, LABELS)

    def rows(df, names):
        return sorted((r.doc_id is None, r.doc_id or 0, *(-1.0 if r[c] is None else float(r[c]) for c in names)) for r in df.collect())

    for run, names in ((toxicity.toxicity, ("score", *toxicity.FEATURES)), (quality.quality, ("perplexity", "chars"))):
        scanned, joined = (rows(run(d, m, **kw), names) for kw in ({}, {"model_rows": 0}))
        assert len(scanned) == len(joined) == 209
        for a, b in zip(scanned, joined, strict=True):
            assert b == pytest.approx(a, rel=1e-9, abs=1e-9)


def test_kneser_ney_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    texts = spark.createDataFrame([(prose(rng, 60),) for _ in range(20)], "text string")
    model, floor = quality.language_model(texts)
    table = {r.key: r.value for r in model.collect()}
    chars = sorted({c for (t,) in texts.collect() for c in t.lower()})

    def log_p(context, c):
        total = 0.0
        for k in range(5, 0, -1):
            gram = (context + c)[-k:]
            key = kneser_ney.window_keys(pa.array([ord(x) for x in gram]).to_numpy().astype("uint32"), pa.array([0]).to_numpy(), k, k).view("int64")[0]
            if key in table:
                return total + table[key]
            if k > 1:
                head = gram[:-1]
                key = kneser_ney.window_keys(pa.array([ord(x) for x in head]).to_numpy().astype("uint32"), pa.array([0]).to_numpy(), k - 1, 100 + k).view("int64")[0]
                total += table.get(key, 0.0)
        return total + floor

    for context in ("then", "\x02\x02\x02\x02", "zzzz"):
        assert sum(math.exp(log_p(context, c)) for c in chars) == pytest.approx(1, abs=0.05)


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over characters by plain dictionaries: log probability of a character after a context."""
    top = Counter()
    for t in texts:
        padded = "\x02" * (order - 1) + t.lower()
        top.update(padded[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    def discounts(c):
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        if not all(n[1:]):
            return (0.5, 0.5, 0.5)
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))
    tables = {}
    for k, c in counts.items():
        d = discounts(c)
        total, left = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        tables[k] = (c, d, total, left)

    def p(gram):
        if not gram:
            return 1.0 / (len(counts[1]) + 1)
        c, d, total, left = tables[len(gram)]
        if not total[gram[:-1]]:
            return p(gram[1:])
        n = c[gram]
        return (n - d[min(n, 3) - 1] if n else 0.0) / total[gram[:-1]] + left[gram[:-1]] / total[gram[:-1]] * p(gram[1:])

    return lambda context, char: math.log(p((("\x02" * (order - 1) + context)[-(order - 1) :] + char)))


def test_quality_equals_brute_force(spark):
    """Perplexities of every document, both ways, against a model of plain dictionaries over the same trusted texts; null, empty and clashing columns among them."""
    docs, marks = labelled(120, 7)
    docs += [(900, "", "en", "s", 0), (901, None, None, None, None), (902, "zzz \u4f60\u597d", "en", "s", 1)]
    d = spark.createDataFrame(docs, DOCS)
    from pyspark.sql import functions as F

    clash = d.withColumn("chars", F.lit("x")).withColumn("total", F.lit(1)).withColumn("quality", F.lit(3)).withColumn("part", F.lit(9)).withColumn("row", F.lit("r"))
    m = spark.createDataFrame([(*r, "x") for r in marks], LABELS + ", lang string")
    trusted = {i for i, q, _ in marks if q and zlib.crc32(str(i).encode()) % 4 != 2}
    log_p = brute_model([t for i, t, *_ in docs if i in trusted], quality.ORDER)
    want = {}
    for i, t, *_ in docs:
        low = (t or "").lower()
        want[i] = math.exp(-sum(log_p(low[:k], c) for k, c in enumerate(low)) / len(low)) if low else None
    for kw in ({}, {"model_rows": 0}):
        got = {r.doc_id: r.perplexity for r in quality.quality(clash, m, **kw).collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) if want[i] else got[i] is None for i in want)
    assert quality.quality(d.limit(0), m).count() == 0 and quality.quality(d, m.limit(0)).count() == len(docs)


def test_toxicity_features_equal_brute_force(spark):
    """The ratios of every document against counts and discounts in plain dictionaries, in both ways."""
    docs, marks = labelled(160, 9)
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, LABELS)
    toxic = {i: t for i, _, t in marks}
    bare = lambda t: [w.strip(A.PUNCTUATION) for w in t.lower().split()]
    counts = [Counter(), Counter()]
    for i, t, *_ in docs:
        if zlib.crc32(str(i).encode()) % 4 < 2:
            counts[toxic[i]].update(bare(t))

    def discounts(c):
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        if not all(n[1:]):
            return (0.5, 0.5, 0.5)
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))

    d_of, sums = [discounts(c) for c in counts], [sum(c.values()) for c in counts]
    taken = lambda k, n: d_of[k][min(n, 3) - 1] if n else 0.0
    gamma = [sum(taken(k, n) for n in counts[k].values()) / sums[k] for k in (0, 1)]

    def ratio(w):
        shared = (counts[0][w] + counts[1][w]) / sum(sums)
        if not shared:
            return math.log(gamma[1] / gamma[0])
        p = [(counts[k][w] - taken(k, counts[k][w])) / sums[k] + gamma[k] * shared for k in (0, 1)]
        return math.log(p[1] / p[0])

    for kw in ({}, {"model_rows": 0}):
        for r in toxicity.toxicity(d, m, **kw).collect():
            each = sorted(map(ratio, bare(docs[r.doc_id][1])), reverse=True)
            assert (r.mean_ratio, r.top_ratio, r.next_ratio) == pytest.approx((sum(each) / len(each), each[0], each[1]), rel=1e-9, abs=1e-9)
