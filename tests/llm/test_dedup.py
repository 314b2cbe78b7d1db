"""Operators 1, 6 and 10 against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from siftrank.llm import line_dedup, ngram_jaccard, queries, substring_dedup
from tests.llm.fixtures import DOCS, corpus, frame, prose


def unique_docs(rows):
    return {r[0]: r[1] for r in rows}


def brute_lines(docs, threshold=0.8, least=5):
    lines = []
    for i in sorted(docs):
        for n, line in enumerate((docs[i] or "").split("\n")):
            s = frozenset(line.lower().split())
            if len(s) >= least:
                lines.append((i, n, s))
    want = {}
    for k, (i, n, s) in enumerate(lines):
        for j, m, t in lines[:k]:
            if len(s & t) >= threshold * len(s | t) - 1e-9:
                want[(i, n)] = (j, m)
                break
    return want


def got_lines(df):
    return {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in df.collect()}


def test_line_dedup_equals_brute_force(spark):
    assert got_lines(line_dedup.duplicate_lines(frame(spark))) == brute_lines(unique_docs(corpus()))


def near_lines(n):
    """Many variants of two lines, so that lists of candidates are cut, and lines that only look alike."""
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i % 7):
            w[(i * 5 + k * 11) % 40] = f"v{i}_{k}"
        rows.append((i, " ".join(w) + "\n" + " ".join(w[::-1][: 8 + i % 20]), "en", "s", 1))
    return rows


def test_line_dedup_with_cut_lists(spark, monkeypatch):
    rows = near_lines(60)
    want = brute_lines(unique_docs(rows))
    assert got_lines(line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS))) == want
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    assert got_lines(line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS))) == want


def test_line_dedup_with_waiting_lines(spark, monkeypatch):
    """Lists of which little is kept: most lines go through the second round, by words and by bands of length."""
    rows = near_lines(60)
    want = brute_lines(unique_docs(rows))
    for block, early, few in ((1 << 20, 3, 1), (8, 3, 1)):
        for name, value in (("BLOCK", block), ("EARLY", early), ("FEW", few), ("PAIRS", 50)):
            monkeypatch.setattr(line_dedup, name, value)
        assert got_lines(line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS))) == want


def test_short_lines_are_compared(spark, tmp_path):
    """The registered query: lines of every length, from one word on, against brute force; sets of 4 and 5 words reach 0.8."""
    rng, kinds = random.Random(3), [f"k{i}" for i in range(9)]
    texts = ["\n".join(" ".join(rng.sample(kinds, rng.randint(0, 6))) for _ in range(12)) for _ in range(25)]
    texts += ["les.\n\nAll rights reserved.", "les.\n\nand ornd. of\nAll rights reserved.", "a b c d", "e d c b a", "a b c"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(unique_docs(rows), least=1)
    assert want[(26, 0)] == (25, 0) and want[(26, 3)] == (25, 2) and want[(28, 0)] == (27, 0) and (26, 1) not in want
    assert got_lines(queries.op6_line_dedup(spark, str(tmp_path))) == want
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert left[26] == "\nand ornd. of"


def test_removed_lines_leave_the_rest(spark):
    df = frame(spark)
    left = {r.doc_id: r.text for r in line_dedup.remove_lines(df, line_dedup.duplicate_lines(df)).collect()}
    docs, gone = unique_docs(corpus()), brute_lines(unique_docs(corpus()))
    for i, text in docs.items():
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)
        if any(d == i for d, _ in gone) and not kept.strip(" "):
            assert i not in left
        else:
            assert left[i] == kept


def brute_jaccard(docs, n=5, threshold=0.8):
    words = {i: tuple((t or "").lower().split()) for i, t in docs.items()}
    sets = {i: {w[j : j + n] for j in range(max(1, len(w) - n + 1))} if w else set() for i, w in words.items()}
    copy = {}
    for i in sorted(docs):
        copy.setdefault(words[i] if words[i] else ("", i), i)
    own = {i: copy[words[i] if words[i] else ("", i)] for i in docs}
    reps, root, links = sorted(set(own.values())), {}, Counter()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a in enumerate(reps):
        for b in reps[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    times = Counter(own.values())
    return {i: (own[i], find(own[i]), times[own[i]], links[own[i]]) for i in docs}


def test_jaccard_join_equals_brute_force(spark):
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in ngram_jaccard.jaccard_join(frame(spark)).collect()}
    assert got == brute_jaccard(unique_docs(corpus()))


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_jaccard_join_of_several_texts_under_one_id(spark, parts):
    """The links of all of them are kept, whatever the partitioning is."""
    rng = random.Random(8)
    a, b, c = prose(rng, 120), prose(rng, 120), prose(rng, 60)
    rows = [(1, a, "", "", 1), (1, b, "", "", 1), (1, b, "", "", 1), (1, None, "", "", 1), (2, a + " end", "", "", 1), (3, b + " end", "", "", 1), (0, c, "", "", 1), (4, b, "", "", 1)]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in ngram_jaccard.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()}
    assert got == {0: (0, 0, 1, 0), 1: (1, 1, 3, 2), 2: (2, 1, 1, 1), 3: (3, 1, 1, 1), 4: (1, 1, 2, 1)}


def test_jaccard_join_in_small_blocks(spark):
    rows = [(i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(near_lines(50))]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in ngram_jaccard.jaccard_join(spark.createDataFrame(rows, DOCS), n=2, threshold=0.6, block=6).collect()}
    assert got == brute_jaccard(unique_docs(rows), 2, 0.6)


def test_bands_reach_the_recall():
    bands, rows = ngram_jaccard.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 160


def brute_units(text):
    out, begin, words, last = [], None, [], 0
    i = 0
    while i < len(text):
        if text[i].isspace():
            if text[i] == "\n" and words:
                out.append((begin, last, words))
                begin, words = None, []
            i += 1
            continue
        j = i
        while j < len(text) and not text[j].isspace():
            j += 1
        begin = i if begin is None else begin
        words.append("".join(c.lower() if len(c.lower()) == 1 else c for c in text[i:j]))
        last = j
        if text[j - 1] in ".!?":
            out.append((begin, last, words))
            begin, words = None, []
        i = j
    if words:
        out.append((begin, last, words))
    return out


def test_substring_dedup_equals_brute_force(spark):
    docs, seen, want = unique_docs(corpus()), {}, {}
    for i in sorted(docs):
        run = []
        for k, (b, e, w) in enumerate(brute_units(docs[i] or "")):
            if tuple(w) in seen:
                if not (run and run[-1][0] == k - 1):
                    run = []
                    want.setdefault(i, []).append(run)
                run.append((k, b, e, len(w), seen[tuple(w)]))
            seen.setdefault(tuple(w), i)
    flat = {(i, r[0][1], r[-1][2], sum(x[3] for x in r), len(r), min(x[4] for x in r)) for i, runs in want.items() for r in runs if sum(x[3] for x in r) >= 30}
    df = frame(spark)
    removed = substring_dedup.repeated_passages(df)
    got = {(r.doc_id, r.begin, r.end, r.words, r.units, r.first_doc_id) for r in removed.collect()}
    assert got == flat and flat
    pieces = defaultdict(list)
    for r in substring_dedup.kept_segments(df.dropDuplicates(["doc_id"]), removed).collect():
        assert docs[r.doc_id][r.begin : r.end] == r.text
        pieces[r.doc_id].append((r.begin, r.end))
    for i, text in docs.items():
        cut = sorted((b, e) for d, b, e, *_ in flat if d == i)
        assert sum(e - b for b, e in pieces[i]) + sum(e - b for b, e in cut) == len(text or "")


def test_lengthened_passages_equal_brute_force(spark):
    """Passages put into the middle of sentences, lengthened into the units beside them: against plain loops over words."""
    rng = random.Random(11)
    shared = [prose(rng, 40) for _ in range(4)]
    docs = {i: prose(rng, rng.randint(15, 40))[:-1] + " " + rng.choice(("", "a b ")) + rng.choice(shared) + " " + prose(rng, rng.randint(5, 30)) for i in range(30)}
    docs |= {i: None for i in (40, 41)} | {50: "", 51: shared[0], 52: "x" * 70_000 + " b c d. " + shared[1]}
    split, seen, want = {}, {}, {}
    for i, text in docs.items():
        own = []
        for b, e, w in brute_units(text or ""):
            at = [m.span() for m in re.finditer(r"\S+", text[b:e])]
            own.append((b, e, w, [(b + x, b + y) for x, y in at]))
        split[i] = own
    for i in sorted(docs):
        runs = []
        for k, (b, e, w, _) in enumerate(split[i]):
            j, m = seen.setdefault(tuple(w), (i, k))
            if (j, m) == (i, k):
                continue
            left = right = 0
            for count in (4, 8):
                x, y = (split[i][k - 1] if k else None), (split[j][m - 1] if m else None)
                if x and y and min(len(x[2]), len(y[2])) >= count and x[2][-count:] == y[2][-count:]:
                    left, b = count, x[3][-count][0]
                x, y = (split[q][z + 1] if z + 1 < len(split[q]) else None for q, z in ((i, k), (j, m)))
                if x and y and min(len(x[2]), len(y[2])) >= count and x[2][:count] == y[2][:count]:
                    right, e = count, x[3][count - 1][1]
            if not (runs and runs[-1][-1][0] == k - 1):
                runs.append([])
            runs[-1].append((k, b, e, len(w), left, right, j))
        want[i] = {(i, r[0][1], r[-1][2], sum(x[3] for x in r) + r[0][4] + r[-1][5], len(r), min(x[6] for x in r)) for r in runs}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], DOCS).repartition(3)
    df = df.withColumn("edge", df["lang"]).withColumn("reach", df["lang"]).withColumn("left", df["lang"])
    got = {(r.doc_id, r.begin, r.end, r.words, r.units, r.first_doc_id) for r in substring_dedup.repeated_passages(df, 20, take_in=True).collect()}
    assert got == {x for rows in want.values() for x in rows if x[3] >= 20} and any(x[3] > 35 for x in got)


@pytest.mark.parametrize("f", [line_dedup.duplicate_lines, ngram_jaccard.jaccard_join, substring_dedup.repeated_passages])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("f", [line_dedup.duplicate_lines, ngram_jaccard.jaccard_join, substring_dedup.repeated_passages])
def test_nulls_everywhere(spark, f):
    assert f(spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f g", None, None, None), (1, None, None, None, None)], DOCS)).count() >= 0


def test_bloom_agrees_with_spark(spark):
    """Spark sets the filter's bits by a signed remainder, the scan tests them by an unsigned one; sizes are powers of two."""
    import numpy as np

    ids = [(-(1 << 63) + 5,), (-1,), (0,), (17,), ((1 << 63) - 1,)]
    bloom = line_dedup._bloom(spark.createDataFrame(ids, "d1 long"), "d1")
    assert line_dedup._in_bloom(bloom, np.array([i for (i,) in ids], np.int64)).all()
