import hashlib
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import dedup, filters, reports
from millrace.schema import as_samples, with_positions


def samples(spark, texts, column="text"):
    return as_samples(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], f"{column} string, _pos bigint"))


def reasons(df):
    return [r.reject_reason for r in df.orderBy("_pos").collect()]


@pytest.mark.parametrize(
    ("reply", "score"),
    [
        ('{"score": 0.8, "reason": "x"}', 0.8), ('{"score": 1.5}', 1.0), ('{"score": -2}', 0.0), ('{"score": "0.25"}', 0.25), ('{"reason": "x"}', 0.5), ('{"score": null} 3', 0.6), ('{"score": [4]}', 0.8),
        ('```json\n{"score": 0.3}\n```', 0.3), ("4 out of 5", 0.8), ("a solid 7", 0.7), ("42", None), ("I give 42", 0.5), ("no number", 0.5), ("0.72", None), ("[1]", None), ("", 0.5), ("score: 0.72", 0.72),
    ],
)
def test_judge_score(spark, reply, score):
    got = spark.createDataFrame([(reply,)], "r string").select(X.judge_score(F.col("r")).alias("s")).first().s
    assert got == (pytest.approx(score) if score is not None else None)


def test_strip_like_unicode(spark):
    space = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    words = [space + "a" + space, "​x", " \t", "", "a b"]
    got = [r.s for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(X.strip("w").alias("s")).collect()]
    assert got == [w.strip() for w in words]


def test_shingles(spark):
    texts = ["ab", "", "  Abcd ", "aaaa", "日本語テ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.shingles(F.col("t")).alias("s")).collect()
    for r in got:
        t = texts[r.i].lower().strip()
        assert sorted(r.s) == sorted({t} if len(t) < 3 else {t[k : k + 3] for k in range(len(t) - 2)})


def test_repaired_json():
    assert X.repaired_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert X.repaired_json('so: {"a": [1]} ok') == {"a": [1]}
    assert X.repaired_json('[{"a": 1}, {"b": ') is not None
    with pytest.raises(ValueError):
        X.repaired_json("nothing")


def test_safety(spark):
    df = samples(spark, ["how to POISON a well", "Hello there", "a fine day", None, "classic"])
    assert reasons(filters.safety(df)) == ["safety_blocked", None, None, None, None]
    assert reasons(filters.safety(df, preset="family_friendly")) == ["safety_blocked", "safety_blocked", None, None, "safety_blocked"]
    assert reasons(filters.safety(df, words=["hell"], word_boundary=True))[1] is None
    assert [r.safety_passed for r in filters.safety(df, preset="unknown").orderBy("_pos").collect()] == [False, True, True, True, True]


def test_first_reason_wins(spark):
    df = samples(spark, ["how to poison", "x"]).withColumn("quality_score", F.lit(0.1))
    assert reasons(filters.quality_threshold(filters.safety(df))) == ["safety_blocked", "low_quality"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_collapse(spark, most):
    random.seed(most)
    texts = [random.choice(["Same start here", "  same START here", "other", "", None, "x" * 60]) for _ in range(60)]
    key = lambda t: (t or "")[:50].strip().lower()
    seen, want, flags = {}, [], []
    for t in texts:
        seen[key(t)] = seen.get(key(t), 0) + 1
        want.append("template_collapse" if key(t) and seen[key(t)] > most else None)
    total = seen
    flags = [bool(key(t)) and total[key(t)] > most for t in texts]
    df = samples(spark, texts)
    assert reasons(filters.collapse(df, "remove", most=most)) == want
    got = filters.collapse(df, "flag", most=most).orderBy("_pos").select(F.get_json_object("extra", "$.template_collapse").alias("f")).collect()
    assert [r.f == "true" for r in got] == flags
    assert reasons(filters.collapse(df, "report", most=most)) == [None] * 60


def test_exact_duplicates_and_summary(spark):
    df = filters.exact_duplicates(samples(spark, ["a", "b", "a", "a"]), F.col("text"))
    assert reasons(df) == [None, None, "duplicate", "duplicate"]
    assert {(r.reason, r.n, r.pct) for r in reports.rejections(df).collect()} == {("passed", 2, 50.0), ("duplicate", 2, 50.0)}


def _signature(text):
    t = text.lower().strip()
    grams = {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}
    return [min(int.from_bytes(hashlib.sha256(i.to_bytes(4, "big") + g.encode()).digest()[:8], "little") for g in grams) for i in range(128)]


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.5])
def test_minhash_is_exact_and_greedy(spark, threshold):
    random.seed(7)
    base = ["".join(random.choice("abcde ") for _ in range(80)) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 3, 8])):
            t[random.randrange(len(t))] = random.choice("xyz")
        texts.append("".join(t))
    sigs = [_signature(t) for t in texts]
    sim = lambda i, j: sum(a == b for a, b in zip(sigs[i], sigs[j], strict=True)) / 128
    kept = []
    for i in range(len(texts)):
        if all(sim(i, j) <= threshold for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    s = dedup.settled(dedup.signatures(df, "t", "k"))
    assert all([x % 2**64 for x in r.sig] == sigs[r.key] for r in s.collect())
    rep = {i: next(j for j in range(len(texts)) if sigs[j] == sigs[i]) for i in range(len(texts))}
    assert {r.key: r.rep for r in dedup.minhash_members(s).collect()} == rep
    want = {(i, j) for j in set(rep.values()) for i in set(rep.values()) if i < j and sim(i, j) > threshold}
    assert {(r.a, r.b) for r in dedup.minhash_pairs(s, threshold).collect()} == want
    assert sorted(r.k for r in dedup.minhash_dedup(df, "t", "k", threshold).collect()) == kept


def _stages(spark):
    """Stages that ran so far, by number."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}


def test_minhash_keys_miss_no_pair():
    rng = np.random.default_rng(11)
    for m in (0, 1, 2, 12, 25, 40, 102, 127):
        keys = [{p for lo, hi in spans for p in range(lo, hi)} for spans in dedup._keys(m)]
        for _ in range(300):
            differ = set(rng.choice(dedup.HASHES, m, replace=False).tolist())
            assert any(not differ & key for key in keys)


@pytest.mark.parametrize(("hot", "threshold", "agree"), [(2048, 0.8, 103), (16, 0.8, 103), (2048, 0.9, 116)])
def test_minhash_pairs_that_only_meet_are_not_written(spark, monkeypatch, hot, threshold, agree):
    """300 signatures with 60 positions in common meet in many keys; four of them have near copies."""
    monkeypatch.setattr(dedup, "HOT", hot, raising=False)
    rng = np.random.default_rng(5)
    sigs = rng.integers(-(1 << 62), 1 << 62, (304, 128))
    sigs[:, :60] = sigs[0, :60]
    sigs[300:] = sigs[:4]
    sigs[300:, agree:] += 1
    sigs[303, agree - 1] += 1
    df = dedup.settled(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sigs)], "key int, sig array<bigint>"))
    before = _stages(spark)
    assert {(r.a, r.b, r.sim) for r in dedup.minhash_pairs(df, threshold).collect()} == {(i, 300 + i, agree / 128) for i in range(3)}
    rows = [x.shuffleWriteRecords() for k, x in _stages(spark).items() if k not in before]
    assert hot < 2048 or max(rows) < 20_000


def test_cosine(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v[5] = 0
    v[6] = v[7] = v[8]
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    sim = unit @ unit.T
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, v array<double>")
    want = {(i, j) for j in range(90) for i in range(j) if sim[i, j] > 0.8}
    assert {(r.a, r.b) for r in dedup.cosine_pairs(df, "k", "v", 0.8, block=20).collect()} == want
    best = {i: max(sim[i, j] for j in range(90) if j != i) for i in range(90)}
    assert {r.key: r.nearest for r in dedup.nearest(df, "k", "v", block=20).collect()} == pytest.approx(best)
    assert dedup.nearest(df.limit(1), "k", "v").count() == 0
    kept = []
    for i in range(90):
        if all(sim[i, j] <= 0.8 for j in kept):
            kept.append(i)
    assert sorted(r.k for r in dedup.embedding_dedup(df, "k", "v", 0.8).collect()) == kept


@pytest.mark.parametrize("job", ["cosine_pairs", "nearest", "embedding_dedup"])
def test_cosine_sends_as_much_as_there_is(spark, monkeypatch, job):
    """Four times the vectors are four times the rows in the shuffles, not sixteen times."""
    v = np.random.default_rng(4).normal(size=(512, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, v array<float>")
    if job == "embedding_dedup":
        monkeypatch.setattr(dedup, "cosine_pairs", partial(dedup.cosine_pairs, block=8))
    run = {"cosine_pairs": lambda d: dedup.cosine_pairs(d, "k", "v", 0.99, block=8), "nearest": lambda d: dedup.nearest(d, "k", "v", block=8), "embedding_dedup": lambda d: dedup.embedding_dedup(d, "k", "v", 0.99)}[job]
    sent = []
    for n in (128, 512):
        before = _stages(spark)
        run(df.limit(n).repartition(3)).collect()
        sent.append(sum(x.shuffleWriteRecords() for k, x in _stages(spark).items() if k not in before))
    assert sent[1] < 6 * sent[0]


def test_cosine_groups_have_bounded_bytes(spark, monkeypatch):
    """More groups than GROUPS if they would be too large; texts as keys; a vector of another length is an error."""
    monkeypatch.setattr(dedup, "GROUP_BYTES", 200)
    v = np.random.default_rng(8).normal(size=(40, 3))
    sim = (u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T
    df = spark.createDataFrame([(f"k{i:02}", x.tolist()) for i, x in enumerate(v)], "k string, v array<double>")
    got = {(r.a, r.b): r.sim for r in dedup.cosine_pairs(df, "k", "v", 0.5).collect()}
    assert got == pytest.approx({(f"k{i:02}", f"k{j:02}"): sim[i, j] for j in range(40) for i in range(j) if sim[i, j] > 0.5})
    with pytest.raises(Exception, match="vectors of 3 numbers are asked for"):
        dedup.nearest(df.unionByName(spark.createDataFrame([("x", [1.0])], df.schema)), "k", "v").collect()


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 37])
def test_order_statistics(spark, n):
    random.seed(n)
    s = sorted(random.choice([0.1, 0.5, 0.25, 0.75, 0.9]) for _ in range(n))
    got = reports.order_statistics(spark.createDataFrame([(x,) for x in s] + [(None,)], "v double"), "v").first()
    assert (got.n, got.median, got.p10, got.p90) == (n, s[n // 2], s[max(0, n // 10 - 1)], s[min(n - 1, 9 * n // 10)])
    assert got["mean"] == pytest.approx(sum(s) / n, abs=5e-4)


def test_health(spark):
    rows = [(f"i{k}", f"t{k % 5}", 1 if k < 80 else 5, k / 100, k % 2 == 0, k) for k in range(100)]
    df = as_samples(spark.createDataFrame(rows, "instruction string, topic string, difficulty int, quality_score double, safety_passed boolean, _pos bigint"))
    h = reports.health(df, ["t0", "nowhere"])
    assert h["total_samples"] == 100 and h["coverage"]["topics"]["found"] == 5 and h["safety"]["blocked"] == 50
    assert h["coverage"]["difficulty_distribution"] == {"1": 80, "5": 20} and len(h["warnings"]) == 2 and "80%" in h["warnings"][1]
    assert "100 samples" in reports.described(df)


def test_prices_and_estimate():
    assert reports.price("a/m:free", {"a/m": (1.0, 2.0)}) == (1.0, 2.0)
    assert reports.price("m", {"x/m": (3.0, 4.0)}) == (3.0, 4.0)
    assert reports.price("m", {}, {"m": (1e6, 2e6)}) == (1.0, 2.0)
    assert reports.price("m", {}) is None
    assert reports.estimate(10, 1.25, responses=True) == {"samples": 13, "calls": 26, "tokens": 26000}


def test_positions(spark):
    df = spark.createDataFrame([(chr(97 + k), 25 - k) for k in range(26)], "c string, o int").repartition(7)
    assert [r.c for r in with_positions(df, "o").orderBy("_pos").collect()] == [chr(122 - k) for k in range(26)]
