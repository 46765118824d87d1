"""SimHash near duplicates, importance resampling and whitening against plain versions, and at their edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import importance_resampling, simhash_golay, whitening
from factloom.llm.common import join_by_hot_key, table
from factloom.llm.queries import op13_embedding_whitening

from .test_edges import LONG, TEXTS, clashing, documents, sorted_rows

FOLDER = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    found = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """For each fingerprint the number of its component, by comparing all pairs."""
    of = list(range(len(prints)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = top(i), top(j)
                of[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


def plain_rows(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    group = {}
    for (key, _), top in zip(docs, components := plain_components(prints), strict=True):
        group.setdefault(top, []).append(key)
    least = {top: min((k for k in keys if k is not None), default=None) for top, keys in group.items()}
    return [(k, f"{fp:016x}", least[top]) for (k, _), fp, top in zip(docs, prints, components, strict=True)]


def near(rng, fp, most):
    return fp ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, most + 1)), replace=False))


def test_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 2**23, 4000)
    flips = np.array([sum(1 << int(k) for k in rng.choice(23, int(rng.integers(0, 3)), replace=False)) for _ in word])
    (a, x), (b, y) = simhash_golay.codewords(word), simhash_golay.codewords(word ^ flips)
    assert all(set(a[k][x[k]]) & set(b[k][y[k]]) for k in range(len(word)))
    assert set(x.sum(axis=1)) == {1, 6}


def test_fingerprints_four_bits_apart_share_a_key():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    other = np.array([near(rng, int(x), 4) for x in one], np.uint64)
    sets = []
    for prints in (one, other):
        key, row = simhash_golay.keys(prints)
        sets.append([set() for _ in prints])
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            sets[-1][r].add(k)
    assert all(a & b for a, b in zip(*sets, strict=True))


@pytest.mark.parametrize("most", [2, 20, simhash_golay.MOST])
def test_links_make_the_components_of_all_pairs(spark, most):
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)} | {0}
    for _ in range(250):
        prints.add(near(rng, list(prints)[int(rng.integers(len(prints)))], 6))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash_golay.links_of(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()
    of = {x: x for x in signed}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        of[top(a)] = top(b)
    wanted = plain_components(prints)
    pairs = {(top(x), w) for x, w in zip(signed, wanted, strict=True)}
    assert len(pairs) == len(set(wanted)) == len({a for a, _ in pairs})


def test_simhash_of_documents_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    text = next(t for _, t in docs if t and len(t.split()) > 150)
    docs += [(10_000 + k, " ".join("changed" if i % 97 == k else w for i, w in enumerate(text.split()))) for k in range(40)]
    found = simhash_golay.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_rows(docs)))


def test_simhash_edges(spark):
    found = simhash_golay.join(documents(spark))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_rows(TEXTS)))
    assert sorted_rows(simhash_golay.join(clashing(documents(spark)))) == sorted_rows(found)
    assert simhash_golay.join(documents(spark, [])).count() == 0
    kept = simhash_golay.keep_first(clashing(documents(spark)))
    assert kept.columns == clashing(documents(spark)).columns
    assert kept.count() == len({c for _, _, c in plain_rows(TEXTS)} - {None})
    with pytest.raises(ValueError, match="whole numbers"):
        simhash_golay.join(documents(spark).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_rows_of_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr("factloom.llm.common.HOT_KEYS", 1)
    rows = spark.createDataFrame([(k, 7 if k < 50 else k) for k in range(60)], "key long, fp long")
    by = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("v"))
    found = join_by_hot_key(rows, by, "fp", "n", ["v"]).select("key", "v").collect()
    assert sorted(map(tuple, found)) == [(k, 0 if k < 50 else k) for k in range(60)]


# ---------------------------------------------------------------- importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def plain_draw(docs, target):
    found = [features(t) for _, t in docs]
    s, t = sum((c for _, c in found), Counter()), sum((features(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    rows = []
    for (key, _), (words, c) in zip(docs, found, strict=True):
        weight = sum(n * gain[b] for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, words, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = order[: 5 * len(order) // 100]
    out = [(r[0], *r[2:], k) for k, r in enumerate(drawn, 1)]
    return out + [(r[0], *r[2:], None) for r in order[len(drawn) :] + [r for r in rows if r[1] < 20]]


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def drawn(docs, target):
    return importance_resampling.resample(docs, target).select(COLUMNS)


def test_draw_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    docs += [(k, "y" * 200 + " some more words " + "z" * 100) for k in (5000, 5001)] + [(6000, LONG)]
    target = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()] + [None, ""]
    found = drawn(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_draw(docs, target)))


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_runs_of_any_length(depth):
    rng = np.random.default_rng(6)
    texts = [[b"w%d" % k if k else b"x" * 90 for k in rng.integers(0, 6, int(rng.integers(0, 40)))] for _ in range(30)]
    runs = importance_resampling.Runs(texts, depth)
    found = Counter()
    for places, run, crc in runs:
        found.update(zip(np.searchsorted(runs.ends, places, side="right").tolist(), crc[run].tolist(), strict=True))
        assert len(set(crc.tolist())) == len(crc)
    assert found == Counter((t, zlib.crc32(b" ".join(w[i : i + k]))) for t, w in enumerate(texts) for k in range(1, depth + 1) for i in range(len(w) - k + 1))


def test_suffixes_with_numbers_too_large_to_pack():
    numbers = np.random.default_rng(7).integers(1, 4, 500) * 2**40
    order, columns, begins = importance_resampling.suffix_array(numbers, 3)
    suffix = [tuple(np.pad(numbers, (0, 3))[k : k + 3]) for k in order]
    assert suffix == sorted(suffix)
    assert [tuple(c[k] for c in columns) for k in range(500)] == suffix
    assert [bool(begins[1][k]) for k in range(1, 500)] == [suffix[k][:2] != suffix[k - 1][:2] for k in range(1, 500)]


def test_draw_edges(spark):
    given = [*TEXTS, (None, " ".join("abc" for _ in range(30))), (11, "a b c"), (11, "a b c"), *[(20 + k % 2, "word " * 25) for k in range(40)]]
    target = spark.createDataFrame([(None,), ("a benchmark question",)], "text string")
    found = drawn(documents(spark, given), target)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_draw(given, [None, "a benchmark question"])))
    assert sorted_rows(drawn(clashing(documents(spark, given)), clashing(target))) == sorted_rows(found)
    assert drawn(documents(spark, []), target).count() == 0
    assert drawn(documents(spark, given), target.limit(0)).count() == len(given)


def test_draw_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    wanted = con.execute(importance_resampling.ORACLE).fetchall()
    found = drawn(table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


# ---------------------------------------------------------------- whitening


def plain_whitening(rows, dimension):
    """By numpy over all rows at once."""
    usable = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in usable}), np.float64)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(dimension, dimension))
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = [sum(int(v[d]) for v in fit) for d in range(dimension)]
    out = {}
    for key, v in usable:
        deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True))
        for k in range(min(4, dimension)):
            out.setdefault((key, k + 1), []).append((n, deviation, (np.array(v) - mean) @ vectors[:, k] / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(8)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(k, list(map(float, np.float32(v)))) for k, v in enumerate(mixed)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(2000, [300.0] * 6), (2001, [-300.5] + [-0.0] * 5)]
    wanted = plain_whitening(rows, 6)
    bad = [(3000, None), (3001, [None] * 6), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6), (3004, [1.0] * 5), (3005, [])]
    found = whitening.whiten(vectors(spark, rows + bad).repartition(7)).collect()
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        (n, deviation, white, share), *_ = wanted[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(white) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(white) == np.sign(r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(white), abs=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def test_merged_parts_equal_the_whole():
    x = np.random.default_rng(9).normal(size=(1000, 5)) * 1e-3 + 1e6
    parts = [whitening.part(p) for p in np.split(x, [0, 1, 18, 600])]
    merged = parts[0]
    for p in parts[1:]:
        merged = whitening.merge(merged, p)
    whole = x - x.mean(axis=0)
    assert merged[0] == 1000
    assert np.allclose(merged[2], whole.T @ whole, rtol=1e-6)


def test_deviations_beyond_64_bits_are_exact():
    model = whitening.Model(10**9, np.array([3 * 10**11, -(10**12)], object), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[2**22 * 256, -5], [0, 0]])
    assert [int(d) for d in whitening.deviations(x, model)] == [(10**9 * 2**30 - 3 * 10**11) ** 2 + (-5 * 10**9 + 10**12) ** 2, 9 * 10**22 + 10**24]


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, []), (None, [float("nan")])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 3.0]) for k in range(5)])).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["component"], r["vec_id"]))] == [False] * 5 + [True] * 10
    assert {r["identity_error"] < 1e-9 for r in line} == {True}
    given = vectors(spark, [(k, [float(k % 3), float(k % 5)]) for k in range(30)])
    more = given.select("*", *[F.lit("clash").alias(n) for n in ("key", "x", "size", "c", "n", "component", "deviation")])
    assert sorted_rows(whitening.whiten(more)) == sorted_rows(whitening.whiten(given))


def test_whitening_query_over_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    wanted = plain_whitening(rows, 64)
    found = op13_embedding_whitening(spark, FOLDER).collect()
    assert len(found) == 4 * len(rows)
    assert all((r["n"], r["deviation"]) == wanted[r["vec_id"], r["component"]][0][:2] for r in found)
    assert all(abs(r["whitened"]) == pytest.approx(abs(wanted[r["vec_id"], r["component"]][0][2]), abs=1e-6) for r in found)
