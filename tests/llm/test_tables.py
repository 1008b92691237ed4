"""Line dedup, Merkle manifest and whitening against plain Python and numpy, on small and hard tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpool.llm import dualtree, lines, merkle, rpforest, whitening

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, h1 long, place int, size long"
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Documents from (doc_id, text, lang), with columns whose names the operators use themselves."""
    full = [(i, t, g, None if i is not None and i % 5 == 0 else "s", len(t) if t else None, "x", 1, 2, 3) for i, t, g in rows]
    return spark.createDataFrame(full, COLUMNS)


def lower(line):
    return line.strip(BLANK).translate({k: k + 32 for k in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- line dedup ---------------------------------------------------------------------------

def kept_lines(rows, min_chars, min_docs, keep_first):
    """(doc, text) -> (lines, dropped, digest) by counting."""
    where, seen = defaultdict(set), defaultdict(list)
    for i, t, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if len(lower(line)) >= min_chars:
                where[lower(line)].add(i if i is not None else ("text", t or ""))
                seen[lower(line)].append(((i is not None, i or 0), t or "", p))
    out = {}
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        gone = [len(lower(x)) >= min_chars and len(where[lower(x)]) >= min_docs for x in parts]
        if keep_first:
            # which text of one doc_id counts as the first depends on its hash; the tables below have no such tie
            gone = [g and ((i is not None, i or 0), t or "", p) != min(seen[lower(x)]) for p, (x, g) in enumerate(zip(parts, gone))]
        out[i, t or ""] = (len(parts), sum(gone), sha("\n".join(x for x, g in zip(parts, gone) if not g)))
    return out


def line_table():
    rows = [(i, f"Shared Head\nown {i}\n  common {i % 3}\t\n\n\nlast", "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "\n\n\n", "en"), (103, "SHARED HEAD", None), (104, "É shared head\nshared head \r", "fr"), (105, "\x85own 1\nown 1", "fr")]
    rows += [(106, "x" * 200_000 + "\nshared head\n" + "y\n" * 30_000 + "own 2", "de"), (None, "shared head\nlost", "de"), (None, "common 1\nlost", "de")]
    return rows + [rows[3], rows[3], (7, "common 2\nanother text of document 7", "en")]


@pytest.mark.parametrize("min_chars,min_docs,keep_first", [(1, 10, False), (5, 2, False), (1, 2, True), (0, 3, False)])
def test_lines_equal_counting(spark, min_chars, min_docs, keep_first):
    rows = line_table()
    docs = frame(spark, rows).repartition(5)
    bitmaps = lines.keep_bitmaps(docs, min_chars, min_docs, keep_first)
    got = lines.digest(lines.apply_bitmaps(docs, bitmaps)).collect()
    want = kept_lines(rows, min_chars, min_docs, keep_first)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == Counter((i, *want[i, t or ""]) for i, t, _ in rows)
    for r in bitmaps.collect():
        assert sum(r["keep"]) == r["n_lines"] and sum(r["keep"][1::2]) == r["n_dropped"] and all(n > 0 for n in r["keep"][1:-1])


def test_heavy_lines_are_cut_into_parts(spark, monkeypatch):
    # every third line is the same; few counters, so that some keys are heavy and the others are not
    monkeypatch.setattr(lines, "PARTS", 4)
    monkeypatch.setattr(lines, "SKETCH", 32)
    monkeypatch.setattr(lines, "HEAVY", 8)
    rows = [(i, f"hot\nrare {i % 70}\nhot\nown {i}", "en") for i in range(400)]
    docs = frame(spark, rows).repartition(6)
    marked = lines.streamed(lines.line_rows(docs))
    hot = marked.groupBy("h1").agg(F.sum(F.col("first").cast("int")).alias("firsts"), F.max("n_docs").alias("docs"), F.min("n_docs").alias("least")).collect()
    assert all(r["firsts"] == 1 and r["docs"] == r["least"] for r in hot) and max(r["docs"] for r in hot) == 400
    got = {r["doc_id"]: r["kept_sha256"] for r in lines.digest(lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, 1, 2, True))).collect()}
    want = kept_lines(rows, 1, 2, True)
    assert got == {i: want[i, t][2] for i, t, _ in rows}


def test_lines_of_nothing(spark):
    docs = frame(spark, line_table()).limit(0)
    assert lines.digest(lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_by_hand(rows, arity, change):
    """(doc_id, leaf) -> (subroot, root, proof, folded) level by level."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + arity])) for k in range(0, len(out[-1]), arity)])
        return out

    def climb(tree, k, digest):
        proof = ""
        for level in tree[:-1]:
            run = level[k // arity * arity:(k // arity + 1) * arity]
            at = k % arity
            proof += "".join(run[:at] + run[at + 1:])
            digest, k = sha("".join(run[:at] + [digest] + run[at + 1:])), k // arity
        return proof, digest
    leaves = defaultdict(list)
    for r in rows:
        seen = {**r, **change(r)}
        leaves[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), sha("".join(field(r[f]) for f in FIELDS)), sha("".join(field(seen[f]) for f in FIELDS)), r["doc_id"]))
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(leaves[g])]) for g in groups}
    top = levels([trees[g][-1][0] for g in groups])
    out = Counter()
    for at, g in enumerate(groups):
        for k, (_, leaf, seen, doc) in enumerate(sorted(leaves[g])):
            proof, digest = climb(trees[g], k, seen)
            more, digest = climb(top, at, digest)
            out[doc, leaf, trees[g][-1][0], top[-1][0], sha(proof + more), digest, digest == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("stride,arity", [(10, 2), (1, 2), (2, 2), (2, 3)])
def test_manifest_equals_one_built_by_hand(spark, stride, arity):
    rows = [(i, f"text {i} é", ["en", "fr", None, "é", "z", ""][0 if i % 2 else i % 6]) for i in range(150)]
    rows += [(200, None, "one"), (201, "", "two"), (None, "lost", "fr"), (None, None, "fr"), (5, "again", "en"), (300, "x" * 300_000, "en")]
    docs = frame(spark, rows).repartition(4)
    docs = docs.unionByName(docs.filter("doc_id in (7, 9)"))
    hit = F.col("doc_id") % 3 == 0
    out = merkle.manifest(docs, FIELDS, stride=stride, arity=arity, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(r["proof"]), r["folded_root"], r["verified"]) for r in out.collect())
    change = lambda r: {"n_chars": r["n_chars"] + 1} if r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["n_chars"] is not None else {}
    want = manifest_by_hand([r.asDict() for r in docs.collect()], arity, change)
    assert got == want and {v[-1] for v in want} == {True, False}


def test_manifest_of_one_row_and_of_nothing(spark):
    docs = frame(spark, [(1, "a", "en")])
    [r] = merkle.manifest(docs, FIELDS).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof"] == "" and r["verified"]
    assert merkle.manifest(docs.limit(0), FIELDS).count() == 0


# --- whitening ----------------------------------------------------------------------------------

def matrices_to_split(d, rng):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = rng.standard_normal((200, d))
    yield x.T @ x / 200
    yield np.eye(d)
    yield np.zeros((d, d))
    yield np.ones((d, d))
    yield x[:3].T @ x[:3]
    yield q @ np.diag(10.0 ** -np.arange(d).clip(0, 14)) @ q.T
    yield q @ np.diag(np.r_[np.ones(d // 2), 2 * np.ones(d - d // 2)]) @ q.T
    yield q @ np.diag(1 + 1e-13 * rng.random(d)) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 7, 32])
def test_spectrum_is_exact_to_rounding(d):
    for a in matrices_to_split(d, np.random.default_rng(d)):
        values, basis = whitening.spectrum(a)
        size = max(np.linalg.norm(a, 2), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.linalg.norm(a @ basis - basis * values) <= 1e-13 * size and np.linalg.norm(basis.T @ basis - np.eye(d)) < 1e-12


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((300, 6)) * [3, 2, 1, 0.7, 0.5, 0]).round(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6)]
    rows += rows[:100] + [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int").repartition(4)
    got = whitening.whiten(df, components=4).collect()
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    whole = {tuple(v): np.floor(64 * np.array(v)).astype(int) + 1_000_000 for _, v in good}
    fit = np.unique(np.stack(list(whole.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert Counter(r["vec_id"] for r in got) == Counter({i: 4 * k for i, k in Counter(i for i, _ in good).items()})
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, 5):
        want = {i: (whole[tuple(v)] - s / n) @ basis[:, c - 1] / np.sqrt(values[c - 1]) for i, v in good}
        sign = np.sign(sum(want[i] * by[i, c]["whitened"] for i in want))
        for i, v in good:
            r = by[i, c]
            assert r["whitened"] * sign == pytest.approx(want[i], abs=1e-9) and r["n"] == n
            assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(whole[tuple(v)], s))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # one direction alone varies; vectors of another length are fitted apart
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [5.0]), (4, [7.0]), (5, [9.0])], schema)
    got = whitening.whiten(mixed).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    assert all(r["explained"] == pytest.approx(1.0) for r in got)


def test_deviations_of_any_size():
    x = np.array([[1_000_000 + 64 * 9, 999_000]])
    sums = [10 ** 15 + 5, 10 ** 15 - 7]
    n = 10 ** 9
    with pytest.raises(OverflowError):
        whitening._deviations(x, n, sums)
    n = 10 ** 6
    sums = [10 ** 12 + 5, 10 ** 12 - 7]
    assert whitening._deviations(x, n, sums).tolist() == [sum((n * int(a) - s) ** 2 for a, s in zip(x[0], sums))]


# --- searches over repeated ids ---------------------------------------------------------------------

def test_copies_of_an_id_take_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 4)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(1, 60) for _ in range(6)]
    # another vector under an id that is there already
    rows += [(5, x[6].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.filter("vec_id = 0")
    whole = {i: [np.floor(256 * np.array(v)) for j, v in rows if j == i] for i in range(60)}
    score = {i: max(int(whole[0][0] @ v) for v in vs) for i, vs in whole.items() if i}
    want = sorted(score.items(), key=lambda r: (-r[1], r[0]))[:5]
    for chunk in (16, 4096):
        got = dualtree.top_k(df, asked, 5, chunk=chunk).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == want
    far = {i: min(np.linalg.norm(x[0] - np.array(v)) for j, v in rows if j == i) for i in range(1, 60)}
    near = rpforest.nearest(df, asked, 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [i for i, _ in sorted(far.items(), key=lambda r: (r[1], r[0]))[:10]]


def test_forest_grows_in_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(900)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    brought, kind = [], type(df)
    for name in ("toArrow", "collect", "first", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (x := f(self), brought.append(len(x) if hasattr(x, "num_rows") or isinstance(x, list) else 1))[0])
    found = rpforest.fit(df, sample=600, trees=3, leaf=16)
    # two lengths, three trees each, and where the sample ends
    assert sum(brought) <= 2 * 3 + 2
    monkeypatch.undo()
    taken = rpforest._sample(df, 600, 7).collect()
    assert len(taken) == 600 and [(r["hash"], r["vec_id"]) for r in taken] == sorted((r["hash"], r["vec_id"]) for r in taken)
    least = df.withColumn("hash", F.xxhash64("vec_id", F.lit(7))).orderBy("hash", "vec_id").limit(600).collect()
    assert [r["vec_id"] for r in taken] == [r["vec_id"] for r in least]
    for d, forest in found.items():
        points = np.array([r["vector"] for r in taken if len(r["vector"]) == d])
        assert len(forest.cuts) == 3 and all(len(c) >= len(points) // 32 for c in forest.cuts)
        for t in range(3):
            # a row at a threshold may round to its other side
            assert np.bincount(forest.route(points)[:, t]).max() <= 20
    assert set(found) == {4, 5} and rpforest.fit(df.limit(0)) == {}
