"""Every operator against brute force over awkward rows and the smallest table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, linededup, mixing, pii, quality, queries, secrets, simhash, tokens, warc
from millrace.llm.common import components, table, word_counts
from tests.conftest import same_rows
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def both(spark, docs, sf_dir):
    """Tables to run on: the awkward rows, and the small table."""
    return [docs, table(spark, sf_dir, "documents")]


def listed(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_sql(spark, duck, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.SQL[name]).df())


def test_empty_tables(spark):
    none = cases.empty(spark)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert langid.identify(none, langid.Classifier(langid.training_rows(none))).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.sampled(none).count() == 0
    assert linededup.report(none).count() == 0 and linededup.cleaned(none).count() == 0
    assert warc.archives(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert secrets.report(none).count() == 0 and pii.report(none).count() == 0
    assert tokens.tokens_of(none, queries.tokenizer_path()).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0
    assert quality.quality(none).count() == 0


def test_word_counts():
    import pyarrow as pa

    texts = ["a b", None, "", "  ", " x", "y ", "é\tü\n", "z"]
    for off in range(3):
        a = pa.array(texts).slice(off)
        assert word_counts(a).tolist() == [len(WORD.findall(t or "")) for t in texts[off:]]


# --- 1


def test_language_held_out(spark, sf_dir):
    got = queries.QUERIES["op1_language"](spark, sf_dir).toPandas().set_index("doc_id")
    truth = table(spark, sf_dir, "documents").toPandas().set_index("doc_id").lang
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    held = got[got.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_awkward(docs):
    model = langid.Classifier([("the house is on the hill", "en"), ("das haus ist auf dem berg", "de"), ("", "xx"), (None, "yy")])
    got = langid.identify(docs, model, keep=["doc_id", "text", "n_words"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.Classifier([]).predict(["a", None]) == (["und", "und"], [0.0, 0.0])


def test_language_kernel():
    k = langid.Kernel(["abab cd", "xyz"])
    spectrum = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    known = spectrum("abab cd") | spectrum("xyz")
    a, b = spectrum("abcd") & known, spectrum("xaba") & known
    p = k.presence(["abcd", "XABA", ""])
    assert p[0] @ p[1] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), rel=1e-5)
    assert not p[2].any()


def test_language_letters():
    """Only letters (str.isalpha) make a language: superscripts, fractions and number letters don't."""
    model = langid.Classifier([("the house is on the hill", "en"), ("das haus ist auf dem berg", "de")])
    assert model.predict(["10² ½", "Ⅷ 12", "٣٤", "_ -", "é", "日"])[0][:4] == ["und"] * 4
    assert "und" not in model.predict(["é", "日"])[0]


def test_language_scores():
    """Scores by the formulas: kernels of sets, Nystrom by the inverse root, ridge regression on weighted rows."""
    import random

    r = random.Random(3)
    rows = [(" ".join(r.choice(words) for _ in range(6)), y) for y, words in (("a", ["ab", "abc", "cab", "日本"]), ("b", ["xy", "yzx", "ab", "zz"]), ("c", ["qq", "rst", "日", "ж"])) for _ in range(12)]
    model = langid.Classifier(rows, landmarks=9)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    queues = {y: [t for t, z in rows if z == y] for y in "abc"}
    marks = [queues[y][k] for k in range(3) for y in "abc"]
    known = set().union(*map(grams, marks))
    kernel = lambda a, b: len(grams(a) & grams(b) & known) / np.sqrt(len(grams(a) & known) * len(grams(b) & known))
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(t, m) for m in marks] for t, _ in rows]) @ root
    goal = np.array([[1.0 if y == z else -1.0 for z in "abc"] for _, y in rows])
    beta = np.linalg.solve(phi.T @ phi / 12 + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ goal / 12)
    tests = ["ab abc", "zz xy", "rst qq 日", "cab ж"]
    want = np.array([[kernel(t, m) for m in marks] for t in tests]) @ root @ beta
    found, scores = model.predict(tests)
    assert found == ["abc"[k] for k in want.argmax(axis=1)]
    assert scores == pytest.approx(np.clip((1 + want.max(axis=1)) / 2, 0, 1), abs=2e-3)


def test_language_many(spark):
    """150 languages in as many alphabets, one of them almost only one text: all are learned, none is cut off."""
    import random

    r = random.Random(5)
    rows, k = [], 0
    for y in range(150):
        letters = [chr(0x4E00 + 40 * y + j) for j in range(12)]
        for _ in range(12):
            rows.append((k := k + 1, "".join(r.choice(letters) + " " * (r.random() < 0.3) for _ in range(60)), f"l{y:03d}", "a"))
    rows += [(10_000 + j, rows[0][1], "l000", "a") for j in range(2000)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    sample = langid.training_rows(df, per_class=8)
    assert Counter(y for _, y in sample) == Counter({f"l{y:03d}": min(8, len({t for i, t, z, _ in rows if z == f"l{y:03d}" and zlib.crc32(str(i).encode()) % 4 != 2})) for y in range(150)})
    got = langid.identify(df, langid.Classifier(sample), keep=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.99 * len(got)


# --- 2


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(both):
    for df in both:
        got = mixing.mix(df).toPandas()
        size, largest = defaultdict(int), defaultdict(int)
        want = Counter()
        for i, t, _, s in listed(df):
            n = len(WORD.findall(t or ""))
            want[(i, s, n)] += 1
            size[s] += n
            largest[s] = max(largest[s], n)
        assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.source, r["size"]) for _, r in got.iterrows()) == want
        target = brute_targets(size)
        for s, part in got.groupby(got.source.fillna("\0null")):
            s = None if s == "\0null" else s
            assert part.source_size.iloc[0] == size[s] and part.target.iloc[0] == pytest.approx(target[s])
            assert abs(part.taken.sum() - target[s]) <= 2 * largest[s] + 1
        assert got.copies.between(0, 2).all()
        again = mixing.mix(df.repartition(3)).toPandas()
        key = ["doc_id", "source", "size", "taken"]
        assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
        emitted = mixing.sampled(df)
        assert emitted.columns == df.columns
        assert Counter((r.doc_id, r.source) for r in emitted.collect()) == Counter({k: v for k, v in got.assign(doc_id=got.doc_id.astype(object).where(got.doc_id.notna(), None), source=got.source.where(got.source.notna(), None)).groupby(["doc_id", "source"], dropna=False).copies.sum().items() if v} and {(None if k[0] != k[0] else int(k[0]), None if k[1] != k[1] else k[1]): int(v) for k, v in got.groupby(["doc_id", "source"], dropna=False).copies.sum().items() if v})


def test_mixing_reruns(spark):
    """Rows with one id, null ids and equal sizes: the sampled texts don't depend on partitions."""
    rows = [(None if k % 3 else 5, f"text {cases.prose(k % 25, 6)}", "en", "a" if k % 2 else None) for k in range(120)]
    df = spark.createDataFrame(rows, cases.SCHEMA).withColumn("more", F.monotonically_increasing_id()).cache()
    one, two = (bag(mixing.sampled(x).collect()) for x in (df.repartition(2), df.repartition(7, "more")))
    assert one == two and sum(one.values()) > 0


# --- 3


def brute_lines(rows):
    lines = []
    for i, t in {(i, t or "") for i, t, *_ in rows}:
        for k, line in enumerate(t.split("\n")):
            if w := WORD.findall(line.lower()):
                lines.append(((i is not None, i if i is not None else 0), t, k, frozenset(w)))
    return lines


def near_lines(n):
    """Documents with lines that repeat, repeat in another order, and differ by a word or two."""
    one, two = cases.prose(1, 30).split(), [f"v{k}" for k in range(10)]
    other = lambda k: " ".join(w if j != k % 10 else f"w{k}" for j, w in enumerate(two))
    return [(k, "\n".join([" ".join(one), cases.prose(k, 25), " ".join(one[::-1]) + f" w{k}", "short", other(k), "  Two\twords ", "", " ".join(two[: 8 + k % 3])]), "en", "a") for k in range(n)]


def test_lines(spark, docs):
    df = spark.createDataFrame([(500 + k, *r) for k, *r in near_lines(12)] + cases.rows(), cases.SCHEMA)
    got = linededup.resolve(df.repartition(3)).collect()
    h = {(r.doc_id, r.text or ""): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    lines = sorted(((i, h[(None if not i[0] else i[1], t)], k, x) for i, t, k, x in brute_lines(df.select("doc_id", "text").collect())), key=lambda r: r[:3])
    first, members = {}, Counter()
    for i, hh, k, x in lines:
        first.setdefault(x, (i, hh, k))
    # Repeated rows count as copies.
    members.update(frozenset(w) for r in df.collect() for x in (r.text or "").split("\n") if (w := WORD.findall(x.lower())))
    links = {x: [y for y in first if y != x and 5 * len(x & y) >= 4 * len(x | y)] for x in first}
    assert sum(map(len, links.values())) > 20
    want = defaultdict(list)
    for i, hh, k, x in lines:
        kept = (i, hh, k) == first[x] and not any(first[y] < first[x] for y in links[x])
        told = members[x] > 1 or links[x]
        want[(i[1] if i[0] else None, hh)].append((k, kept, len(links[x]), first[x][0][1] if told and first[x][0][0] else None, first[x][2] if told else None))
    assert {(r.id, r.h): [tuple(x) for x in r.lines] for r in got} == dict(want)
    out = linededup.cleaned(df)
    assert out.columns == df.columns and out.count() == df.count()
    clean = linededup.cleaned(docs)
    assert clean.columns == docs.columns and bag((r.doc_id, r.lang, r.source) for r in clean.collect()) == bag((r.doc_id, r.lang, r.source) for r in docs.collect())
    by = {(i, t): [k for k, kept, *_ in want.get((i, h[(i, t)]), []) if kept] for i, t in h}
    seen = set()
    for r in sorted(listed(out), key=lambda r: -len(r[1] or "")):
        full = [t for i, t in h if i == r[0]]
        texts = {"\n".join(x for k, x in enumerate(t.split("\n")) if k in by[(r[0], t)] or not WORD.search(x)) for t in full}
        bare = {"\n".join(x for x in t.split("\n") if not WORD.search(x)) for t in full}
        assert (r[1] or "") in (texts | bare)
        seen.add((r[0], r[1] or ""))
    assert all(any((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k in ks or not WORD.search(x))) == s for s in seen) for (i, t), ks in by.items())
    rows = linededup.report(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    for r in rows:
        if r.doc_id == 7:
            assert r.n_lines == 1 and r.n_removed == 1 and r.line_classes == "0:6:0:0"


def test_lines_places(spark):
    """Frequent tokens have exact places, and hot lines meet their class in parts, to the same result."""
    rows = [(k, "the same line of all\n" + cases.prose(k % 9, 12), "en", "a") for k in range(300)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    lines = linededup._lines(df, "doc_id", "text").select("line").distinct()
    slots = [x for x in map(int, linededup._table(lines).split(",")) if x]
    n = Counter(w for (line,) in lines.collect() for w in line.split(" "))
    token = {r.w: r.t for r in spark.createDataFrame([(w,) for w in n], "w string").select("w", linededup._token(F.col("w")).alias("t")).collect()}
    assert {x & linededup._MASK for x in slots} == {token[w] for w, c in n.items() if c >= linededup.LEAST_COUNT}
    place = {x & linededup._MASK: x >> 46 for x in slots}
    some = sorted((place[token[w]], c) for w, c in n.items() if token[w] in place)
    assert [c for _, c in some] == sorted(c for _, c in some) and len(some) > 5
    got = {r.doc_id: r for r in linededup.report(df).collect()}
    assert all(got[k].line_classes.split(",")[0] == "0:0:0:0" and got[k].n_removed >= 1 for k in range(1, 300)) and got[0].n_removed == 0


def test_lines_work(spark, monkeypatch):
    """Lines are folded once, tokens counted on a sample, and neither a sample without tokens nor shared slots change a result."""
    odd = [(900 + k, t, "en", "a") for k, t in enumerate([" One\tTWO three ", "one two  three", "\t\x0b\n \r\n\x0c", "three two\rone", "\x0bone two three\x0c", "x\n\n  \ny ", "y\nX"])]
    df = spark.createDataFrame(near_lines(40) + odd, cases.SCHEMA)
    assert sorted((r.line_no, r.line) for r in linededup._lines(df.filter("doc_id >= 900"), "doc_id", "text").collect()) == sorted(
        [(0, "one two three")] * 3 + [(0, "three two one"), (0, "x"), (3, "y"), (0, "y"), (1, "x")]
    )
    plan = linededup._lines(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_replace" in node for node in plan.splitlines()) == 1
    words = df.select(F.explode(F.split("text", "[ \\t\\n]+")).alias("w")).distinct().select(F.collect_set(linededup._token(F.col("w"))).alias("t"))
    want = bag(linededup.report(df).collect())
    assert sum(r[3] for r in want) > 50
    for counted, slots in ((5, 1 << 17), (1 << 13, 4)):
        monkeypatch.setattr(linededup, "COUNTED", counted)
        monkeypatch.setattr(linededup, "SLOTS", slots)
        lines = linededup._counted(df, "doc_id", "text")
        assert (lines.count() < linededup._lines(df, "doc_id", "text").count()) == (counted == 5)
        table = linededup._table(lines)
        row = words.select(F.size("t").alias("n"), linededup._ordered("t", table).alias("x")).first()
        assert len(set(row.x)) == row.n and row.x == sorted(row.x)
        assert bag(linededup.report(df).collect()) == want


def test_lines_order(spark, monkeypatch):
    """More tokens than 32,767 have places; the order follows them by steps, and any size of its table gives the same result."""
    words = spark.range(40_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.when(F.col("id") < 100, "q").otherwise("")).alias("line"))
    table = linededup._table(words.unionByName(words).unionByName(words).unionByName(words.filter("line like '%q'")))
    slots = [x for x in map(int, table.split(",")) if x]
    assert len(slots) > 37_000
    df = words.filter("line like '%q' or line like 'w39___'").agg(F.collect_list(linededup._token(F.col("line"))).alias("t"))
    frequent = {r.t for r in words.filter("line like '%q'").select(linededup._token(F.col("line")).alias("t")).collect()}
    x = df.select(linededup._ordered("t", table).alias("x")).first().x
    assert x == sorted(x) and len({k & linededup._MASK for k in x}) == 1100 and {k & linededup.CELLS - 1 for k in x[-80:]} <= {t & linededup.CELLS - 1 for t in frequent}
    docs = spark.createDataFrame(near_lines(40), cases.SCHEMA)
    want = bag(linededup.report(docs).collect())
    monkeypatch.setattr(linededup, "CELLS", 4)
    assert bag(linededup.report(docs).collect()) == want


def test_lines_spared(spark, monkeypatch):
    """Rows that a join can't need stay out of its shuffles; the table that tells them loses no key at any size. Texts folded whole give the sets of folded lines."""
    odd = [(900 + k, t, "en", "a") for k, t in enumerate([" One\tTWO  three ", "\u039f\u0394\u039f\u03a3\n\u039f\u0394\u039f\u03a3 \u0130x\n\u03a3\n.\u03a3\n\u03a3\u0391", "\t\x0b\n \r\n\x0c", "x\n\n  \ny ", "", None, "a  a\rB\x0c\x0bb "])]
    df = spark.createDataFrame(near_lines(40) + odd, cases.SCHEMA)
    table = linededup._table(linededup._counted(df, "doc_id", "text"))
    one, other = (bag(linededup._line_sets(f(df, "doc_id", "text"), table).withColumn("prefix", F.col("prefix").cast("string")).collect()) for f in (linededup._lines, linededup._loose_lines))
    assert one == other and len(one) > 200
    numbers = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    some = numbers.filter("id % 100 = 7")
    want = bag(linededup.report(df).collect())
    for marks in (linededup.MARKS, 64):
        monkeypatch.setattr(linededup, "MARKS", marks)
        told = {r.id for r in linededup._told(numbers, "h", linededup._marks(some, "h")).filter("told").collect()}
        assert {r.id for r in some.collect()} <= told and (len(told) < 250 or marks == 64)
        assert not linededup._told(numbers, "h", linededup._marks(some.limit(0), "h")).filter("told").count()
        assert bag(linededup.report(df).collect()) == want
    seen = []
    monkeypatch.setattr(linededup, "MARKS", 1 << 22)
    monkeypatch.setattr(linededup, "materialise", lambda d, **k: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or d.localCheckpoint())
    linededup.report(df).collect()
    # Besides the two passes over all texts (tokens counted, sets made), texts are read for candidates, and only marked ones.
    texts = [p for p in seen if "element_at(lines" in p]
    assert len(texts) == 1 and "getbit" in texts[0].lower()


def test_lines_meet(spark, monkeypatch):
    """The shorter line's prefix is cut behind the shuffle that both sides read, unless a token is hot; the candidates are the same."""
    df = spark.createDataFrame(near_lines(60), cases.SCHEMA)
    lines = linededup._lines(df, "doc_id", "text")
    sets = linededup._line_sets(lines, linededup._table(linededup._counted(df, "doc_id", "text")))
    classes = linededup.materialise(sets.dropDuplicates(["s1"]))
    found = {}
    for hot in (False, True):
        monkeypatch.setattr(linededup, "SKEWED", 1e9 * (not hot) - 1)
        monkeypatch.setattr(linededup, "SAMPLED", 1)
        assert linededup._hot(classes) == hot
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = linededup._candidates(classes)
        found[hot] = bag(got.collect())
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
        # The cut stands above the shuffle; with a hot token nothing stands between the join and the shuffles.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression" in plan) != hot and ("Generate explode" in plan.partition("RepartitionByExpression")[0]) != hot
    assert found[False] == found[True] and len(found[True]) > 20


# --- 4


def test_archives(spark):
    big = "<p>" + "é" * 600 + "</p>"
    pages = [(1, "u1", big), (2, "u2", big), (2, "u2", big), (3, None, "small"), (4, "u\r\n4", "small"), (5, "u5", None), (None, "n", big), (7, "u7", big + "x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = warc.archives(df).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert bag((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == bag((p, len((t or "").encode()), sha(t)) for p, _, t in pages)
    same = [r for r in got if r.payload_digest == sha(big)]
    assert Counter(r.record_type for r in same) == {"response": 1, "revisit": 3}
    assert {r.page_id for r in same if r.record_type == "response"} == {2} and {r.refers_to for r in same if r.record_type == "revisit"} == {2}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_digest != sha(big))


# --- 5 and 7

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}
digits = lambda m: re.sub("[^0-9]", "", m[0])


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
}


def brute_spans(text, rules):
    kinds = list(rules)
    found = sorted((m.start(), kinds.index(k), m.end()) for k, (p, ok) in rules.items() for m in p.finditer(text or "") if ok(m))
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in found]


def fuzz(alphabet, n, seed):
    import random

    r = random.Random(seed)
    return [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 25))), None, None) for k in range(n)]


SECRET_BITS = ["token", "Secret", "passwd", "PASSWORD", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "abcdefgh", "x", "é", "😀", "\n", "-", "."]
PII_BITS = ["a", "b.c", "@", ".", "-", "1", "23", "255", "256", "0", "+", " ", "(", ")", "4111 1111 1111 1111", "é", "😀", "x@y.zz", "1.2.3.4", "+1 (555) 010-1234", "\n", "_"]


@pytest.mark.parametrize(("op", "rules", "bits"), [(secrets, RULES, SECRET_BITS), (pii, PII, PII_BITS)], ids=["secrets", "pii"])
def test_spans(spark, both, op, rules, bits):
    for df in [*both, spark.createDataFrame(fuzz(bits, 3000, 5), cases.SCHEMA)]:
        got = op.report(df).collect()
        want = []
        for i, t, *_ in listed(df):
            spans = brute_spans(t, rules)
            n = Counter(s.partition(":")[0] for s in spans)
            want.append((i, *(n[k] for k in rules), hashlib.sha256(",".join(spans).encode()).hexdigest()))
        assert bag(tuple(r)[: len(rules) + 2] for r in got) == bag(want)
        for r in got:
            assert set(x for x in r.spans.split(",") if x.partition(":")[0] in rules) == set(x for x in r.spans.split(",") if x) - {x for x in r.spans.split(",") if x.partition(":")[0] not in rules}


def test_added_spans(spark):
    df = spark.createDataFrame([(1, "my bank iban is GB82 WEST 1234 5698 7654 32.", None, None), (2, "code GB82 WEST 1234 5698 7654 33", None, None)], cases.SCHEMA)
    assert {r.doc_id: r.spans for r in pii.report(df).collect()}[1] == "iban:16:43"
    assert "iban" not in {r.doc_id: r.spans for r in pii.report(df).collect()}[2]
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[1] == "my bank iban is <iban>."
    df = spark.createDataFrame([(1, "x ghp_" + "aZ" * 18 + " y", None, None), (2, "-----BEGIN RSA PRIVATE KEY-----", None, None)], cases.SCHEMA)
    assert sorted(r.spans for r in secrets.report(df).collect()) == ["github:2:42", "key:0:31"]


def test_context_decides(spark):
    """A social security number is personal data near a word of its context only; the context ends at the next match."""
    n = "219-09-9999"
    texts = [f"SSN: {n}.", f"part {n}.", f"social security no. {n}", f"{n} is the tax ID", f"ssn {'x' * 60} {n}", f"219-09-0000 ssn 000-12-3456 {n}9", f"ssn {n} and {n}", "mail a@b.cc", "contact a@b.cc"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], cases.SCHEMA)).collect()}
    assert [got[k].spans for k in range(7)] == ["ssn:5:16", "", "ssn:20:31", "ssn:0:11", "", "", "ssn:4:15"]
    assert [got[k].top_score for k in (0, 1, 7, 8)] == pytest.approx([0.65, None, 0.6, 0.95])


def test_scores(both, spark):
    """top_score by brute force over the fuzzed texts."""
    own = {"email": 0.6, "ip": 0.5, "card": 0.6, "phone": 0.4}
    for df in [both[1], spark.createDataFrame(fuzz(["phone ", "E-Mail ", "card", "ip ", *PII_BITS], 1500, 9), cases.SCHEMA)]:
        for r, (_, t, *_) in zip(sorted(pii.report(df.filter("doc_id is not null")).collect(), key=lambda r: r.doc_id), sorted(listed(df.filter("doc_id is not null"))), strict=True):
            best = []
            for kind, (p, ok) in PII.items():
                every = list(p.finditer(t or ""))
                ends = [0, *(m.end() for m in every)]
                starts = [*(m.start() for m in every), len(t or "")]
                for k, m in enumerate(every):
                    around = [t[max(ends[k], m.start() - 48) : m.start()].lower(), t[m.end() : min(starts[k + 1], m.end() + 48)].lower()]
                    if ok(m):
                        best.append(min(1.0, own[kind] + 0.35 * any(re.search(pii.CONTEXT[kind], x) for x in around)))
            if "iban" not in r.spans and "ssn" not in r.spans:
                assert r.top_score == (pytest.approx(max(best)) if best else None)


def test_iban_before_words(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    after = [" Bitte", " OR", " 5 days", " A", ".", " 12345678", " GB82 WEST 1234 5698 7654 32"]
    df = spark.createDataFrame([(k, iban + x, None, None) for k, x in enumerate(after)] + [(9, iban.replace(" ", "") + " Bitte", None, None), (10, iban + "7", None, None)], cases.SCHEMA)
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.report(df).collect()}
    assert got == {k: ["iban:0:27"] for k in range(6)} | {6: ["iban:0:27", "iban:28:55"], 9: ["iban:0:22"], 10: []}
    assert {r.doc_id: r.text for r in pii.redact(df.filter("doc_id = 0")).collect()} == {0: "<iban> Bitte"}


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{32,}") is None
    assert secrets.trigram_query("abcd|xyz+") is None or secrets.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert sorted(map(sorted, secrets.trigram_query("(foo|bar)x"))) == [["arx", "bar"], ["foo", "oox"]]
    for scan in secrets.BASE + secrets.ADDED:
        q = secrets.trigram_query(scan.source)
        for text in ("api_key = abcdefgh", "AKIAABCDEFGHIJKL", "ghp_" + "a" * 40, "xoxb-1234567890", "-----BEGIN EC PRIVATE KEY-----"):
            if re.search(scan.source, text, re.I) and q is not None:
                assert any(all(g in text.lower() for g in conj) for conj in q)


# --- 6


def test_tokens(both):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    for df in both:
        got = sorted(tokens.tokens_of(df.repartition(3), path).collect(), key=lambda r: r.start)
        ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in listed(df)]
        assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_token_ranges(tmp_path):
    """Stores that can't be mapped are read by ranges."""
    import pyarrow.fs as pafs

    (tmp_path / "a").write_bytes(np.arange(50, dtype="<u4").tobytes())
    r = tokens.Ranges(pafs.LocalFileSystem(), str(tmp_path / "a"), np.dtype("<u4"))
    assert len(r) == 50 and r[3:7].tolist() == [3, 4, 5, 6] and r[7] == 7 and r[9:9].tolist() == []


def test_encoder_cuts():
    import random

    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(queries.tokenizer_path()), tokens.Encoder(queries.tokenizer_path(), bits=6), random.Random(2)
    bits = ["a", "b", " ", " ", "  ", "\n", "\t", "\r", "é", " ", "\u0085", "\x1c", "　", "1", "'s", "!", "<|endoftext|>", "日"]
    for _ in range(4000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_encoder_joins_words():
    """Words taken by the model many at a time, in slices, with a memory that turns over, against the tokenizer itself."""
    import random

    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(queries.tokenizer_path()), tokens.Encoder(queries.tokenizer_path(), bits=8), random.Random(4)
    assert e.joined
    bits = ["ab", "The", "ü", "é", "ция", "日", "本", "12", "9", ".", ",", "'s", "'", "—", "…", "###", "$", "\n", "\n\n", "<|endoftext|>", "½", "²", "\u200b", "あ、", "_", "x" * 40]
    for _ in range(40):
        texts = [" ".join("".join(r.choice(bits) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))) for _ in range(60)]
        texts += [None, "", " ", "x" * 30 + " y", "a\u00a0b c  d", "\u3000 x"]
        ids, n = e.encode_batch(pa.array(texts).slice(1))
        for x, k, end in zip(texts[1:], n.tolist(), np.cumsum(n).tolist(), strict=True):
            assert ids[end - k : end].tolist() == t.encode(x or "", add_special_tokens=False).ids
    assert e.encode_batch(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


# --- 8


def brute_hits(text, windows):
    w = HARD.findall(low(text))
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                items |= own
    items.discard(None)
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, both, sf_dir, block):
    more = spark.createDataFrame([(900, "the of"), (901, None), (902, "  "), (903, cases.prose(3, 14)), (904, "Two, WORDS!"), (None, "one"), (None, "w1x1 w2x2"), (905, "日本語")], "item_id bigint, text string")
    bench = table(spark, sf_dir, "benchmark").unionByName(more)
    windows = defaultdict(set)
    for r in bench.collect():
        w = HARD.findall(low(r.text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(None if r.item_id is None else str(r.item_id))
    for df in both:
        got = decontaminate.contamination(df, bench, keep=["doc_id"], block_bytes=block).collect()
        assert bag(got) == bag((i, *brute_hits(t, windows)) for i, t, *_ in listed(df))


def test_packed_tables():
    """Search over random words against brute force, with repeated and null items; a large block stays small."""
    import random

    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(200)]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(str(k), some(r.randint(0, 40))) for k in range(40)] + [(None, some(15)), ("x", "one"), ("y", "one"), ("z", ""), ("é", some(30))]
    windows = defaultdict(set)
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    m = decontaminate.Matcher(decontaminate.build([(i, t.encode()) for i, t in items]))
    hits = 0
    for _ in range(300):
        w = some(r.randint(0, 30)).split()
        for _ in range(r.randint(0, 3)):
            own = r.choice(items)[1].split()
            at = r.randrange(len(own) + 1)
            w[at:at] = own[at : at + r.randint(1, 25)]
        found, own = m.search(b" " + " ".join(w).encode() + b" ")
        covered = {x for a, b in decontaminate.merged(found) for x in range(a, b)}
        n, n_hit, n_items, digest, bad = brute_hits(" ".join(w), windows)
        assert (len(covered), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()) == (n_hit, n_items, digest)
        hits += bad
    assert hits > 100
    large = decontaminate.build([(str(k), " ".join(r.choice(vocab) + str(r.randrange(900)) for _ in range(5000)).encode()) for k in range(40)])
    assert sum(a.nbytes for a in large.values()) < 80 << 20


# --- 9


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(low(text))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    bits = sum((np.array([xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for b in range(64)]) for s in parts), np.zeros(64, int))
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


@pytest.mark.parametrize("cold", [simhash.COLD, 2])
def test_simhash(both, cold):
    for df in both:
        rows = listed(df)
        fps = {t: brute_fingerprint(t) for _, t, *_ in rows}
        distinct = sorted(set(fps.values()))
        root = {f: f for f in distinct}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for k, a in enumerate(distinct):
            for b in distinct[:k]:
                if (a ^ b).bit_count() <= 2:
                    root[find(a)] = find(b)
        least = {}
        for i, t, *_ in rows:
            if i is not None:
                r = find(fps[t])
                least[r] = min(i, least.get(r, i))
        want = bag((i, f"{fps[t]:016x}", least.get(find(fps[t]))) for i, t, *_ in rows)
        assert bag(simhash.near_duplicates(df, cold=cold).collect()) == want
        kept = simhash.representatives(df, cold=cold)
        assert kept.columns == df.columns
        assert Counter(find(fps[r.text]) for r in kept.collect()) == Counter(dict.fromkeys({find(fps[t]) for _, t, *_ in rows}, 1))


def test_simhash_dense_cluster(spark):
    """Thousands of fingerprints within a few bits of each other: the linear way gives the components of the pairs."""
    r = np.random.default_rng(1)
    fps = {int(x) for x in r.integers(0, 2**63, 50)}
    for x in list(fps)[:5]:
        fps |= {x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 63, (60, 2))}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    parts = [{(r.node, r.root) for r in components(simhash.links(nodes, c)).collect()} for c in (4, 10**6)]
    assert parts[0] == parts[1] and len(parts[0]) > 250


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1050)} | {5000: 5000, 5001: 5000}


# --- 10


def brute_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(both):
    for df in both:
        got = quality.quality(df).collect()
        want = []
        for i, t, *_ in listed(df):
            b = brute_base(t)
            want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
        assert bag(tuple(r)[:7] for r in got) == bag(want)
        assert all(not r.kept for r in got if r.base_failed)
        good = [r for r in got if not r.base_failed]
        assert sum(r.kept for r in good) > 0.85 * len(good)


def test_model_sums_to_one(spark):
    texts = [cases.prose(k, 60) for k in range(6)] + ["", None]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    m = quality.Model(quality.train(df), "en")
    seen = quality._symbol_table()
    every = np.arange(1, 64, dtype=np.uint32)
    for context in ("the ", "of a", "zzzz", "\0\0\0\0", "\0\0th"):
        code = np.uint32(0)
        for c in context:
            code = np.uint32(code << np.uint32(6) | seen[ord(c)])
        p = np.exp(m.logp(np.array([np.uint32(code << np.uint32(6)) | s for s in range(64)], np.uint32)).astype(np.float64))
        assert p.sum() == pytest.approx(1, abs=1e-3)
        assert (p[every[:27]] > 0).all()


def brute_kneser_ney(texts, order=5):
    """p(symbol | context) of an interpolated modified Kneser-Ney model by its formulas, with backing off."""
    table_, pad = quality._symbol_table(), quality._PAD
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [pad] * (order - 1) + [int(table_[ord(c)]) for c in t]
        counts[order].update(tuple(s[k : k + order]) for k in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    after, discount, weight = [defaultdict(int) for _ in counts], [None] * (order + 1), [defaultdict(float) for _ in counts]
    for k in range(1, order + 1):
        n = [sum(v == j for v in counts[k].values()) for j in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            discount[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.1), j - 0.1) for j in (1, 2, 3)]
        else:
            discount[k] = [0.5, 1.0, 1.5]
        for g, v in counts[k].items():
            after[k][g[:-1]] += v
            weight[k][g[:-1]] += discount[k][min(v, 3) - 1]

    def seen(g):
        k = len(g)
        if not k:
            return 1 / 64
        v = counts[k][g]
        return (v - discount[k][min(v, 3) - 1] + weight[k][g[:-1]] * seen(g[1:])) / after[k][g[:-1]]

    left = (1 - sum(seen(g) for g in counts[1])) / (64 - len(counts[1]))

    def p(g):
        k = len(g)
        if g in counts[k]:
            return seen(g)
        if k == 1:
            return left
        return p(g[1:]) * (weight[k][g[:-1]] / after[k][g[:-1]] if g[:-1] in after[k] else 1.0)

    return p


def test_kneser_ney(spark):
    texts = [cases.prose(k, 30) for k in range(8)] + ["Héllo, 日本 12!", "aaaa aaaa", ""]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string").repartition(3)
    m, p = quality.Model(quality.train(df), "en"), brute_kneser_ney(texts)
    r = np.random.default_rng(2)
    codes = quality.ngrams([*texts, "the quick brown fox", "zzz qqq ###"], quality._symbol_table())[0]
    codes = np.concatenate([codes, codes ^ r.integers(0, 4, len(codes)).astype(np.uint32), r.integers(0, 1 << 30, 300).astype(np.uint32)])
    want = [np.log(p(tuple(int(c) >> 6 * k & 63 for k in (4, 3, 2, 1, 0)))) for c in codes if c & 63 != quality._PAD]
    assert m.logp(codes[codes & np.uint32(63) != quality._PAD]) == pytest.approx(want, abs=2e-4)


def test_quality_verdicts(spark, sf_dir):
    """Bands and verdicts by brute force over the perplexities."""
    docs = table(spark, sf_dir, "documents")
    text = {r.doc_id: (r.lang or "", r.text) for r in docs.collect()}
    got = quality.quality(docs).collect()
    held = defaultdict(dict)
    for r in got:
        if not r.base_failed:
            held[text[r.doc_id][0]][text[r.doc_id][1]] = (np.log(r.perplexity), np.log(r.word_perplexity))
    assert len(held) > 2

    def quartiles(values):
        v = sorted(int(np.floor(x * quality.STEPS + 1e-9)) for x in values)
        return [(v[-(-k * len(v) // 4) - 1] + 0.5) / quality.STEPS for k in (1, 2, 3)]

    for r in got:
        (q1, _, q3), (_, w2, w3) = (quartiles([x[k] for x in held[text[r.doc_id][0]].values()]) for k in (0, 1))
        way = quality.SPREAD * np.sqrt(1 + quality.SCATTER / max(r.n_words, 1))
        low, high, w_high = q1 - max(q3 - q1, quality.FLOOR) * way, q3 + max(q3 - q1, quality.FLOOR) * way, w3 + max(2 * (w3 - w2), quality.WORD_FLOOR) * way
        assert np.log([r.low, r.high, r.word_high]) == pytest.approx([low, high, w_high], abs=5e-3)
        bad = (r.perplexity is not None and not r.low <= r.perplexity <= r.high) or (r.word_perplexity is not None and r.word_perplexity > r.word_high)
        assert r.kept == (not r.base_failed and not bad)


def test_ngrams_by_text():
    table_ = quality._symbol_table()
    one = [quality.ngrams([t], table_)[0].tolist() for t in ("abc", "", "d e f")]
    codes, n = quality.ngrams(["abc", "", "d e f"], table_)
    assert n.tolist() == [3, 0, 5] and codes.tolist() == one[0] + one[1] + one[2]


def sense(seed, n=80):
    """Sentences whose words follow each other by rule and look alike where they meet, so that letters don't show it."""
    import random

    r, out = random.Random(seed), []
    while len(out) < n:
        k = r.randrange(18)
        out += [f"inter{'abcdefghijklmnopqr'[(k + r.randrange(2)) % 18]}{c}ation" for c in "xyz"]
    return out[:n]


def shuffled(seed):
    import random

    w = sense(seed)
    random.Random(seed).shuffle(w)
    return w


def test_quality_word_salad(spark):
    docs = [(k, " ".join(sense(k)), "en", None) for k in range(300)]
    salad = [(1000 + k, " ".join(shuffled(500 + k // 3)), "en", None) for k in range(9)]  # each three times: copies mustn't vouch for a text
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs + salad, cases.SCHEMA)).collect()}
    assert not any(got[k].kept for k, *_ in salad)
    assert sum(got[k].kept for k, *_ in docs) >= 297


def test_word_model_counts(spark):
    """Losses by brute force: what all other texts say."""
    from millrace.llm import wordmodel
    import pyarrow as pa

    texts = ["the cat sat on the mat", "The cat, the DOG", "the cat, the dog", "a b a b", None, "...", "日本 日 x日", "the cat sat"]
    path = wordmodel.train(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string").repartition(3))
    lines = {k: re.findall(r"[　-鿿]|[a-z]+", (t or "").lower()) for k, t in enumerate(texts)}
    lines = {k: w for k, w in lines.items() if w}
    one, two = (Counter(g for w in lines.values() for g in f(w)) for f in (lambda w: [*w, ""], lambda w: list(zip(["", *w], [*w, ""], strict=True))))
    once, want = sum(v == 1 for v in one.values()), []
    for k, w in lines.items():
        m = sum(" ".join(x) == " ".join(w) for x in lines.values())
        own, pairs, total = Counter([*w, ""]), Counter(zip(["", *w], [*w, ""], strict=True)), sum(one.values())
        loss = 0.0
        for a, b in zip(["", *w], [*w, ""], strict=True):
            p = (one[b] - m * own[b] + once / len(one)) / (total - m * (len(w) + 1) + once)
            loss -= np.log((two[a, b] - m * pairs[a, b] + wordmodel.MU * p) / (one[a] - m * own[a] + wordmodel.MU))
        want.append(loss / (len(w) + 1))
    x = wordmodel.Coder()(pa.array(texts))
    assert x.texts.tolist() == list(lines) and wordmodel.Model(path, "en").loss(x) == pytest.approx(want)


def test_quality_copies_and_junk(spark):
    """A third or more of all rows copies of one text: other clean texts stay, planted junk goes."""
    r = np.random.default_rng(3)
    clean = [(k, cases.prose(1000 + k, 60 + k % 50), "en", None) for k in range(240)]
    copies = [(1000 + k, cases.prose(7, 80), "en", None) for k in range(480)]
    spoilt = [" ".join("".join(r.permutation(list(w))) if r.random() < 0.5 else w for w in cases.prose(2000 + k, 90).split()) for k in range(12)]
    junk = [(3000 + k, t, "en", None) for k, t in enumerate(spoilt)]
    for some in (120, 480):
        got = {x.doc_id: x.kept for x in quality.quality(spark.createDataFrame(clean + copies[:some] + junk, cases.SCHEMA)).collect()}
        assert sum(got[k] for k, *_ in clean) >= 238
        assert not any(got[k] for k, *_ in junk)


def test_quality_memory(spark, monkeypatch):
    """A task's arrays don't grow with its batches, and the steps that a batch is scored in don't show."""
    import tracemalloc

    from millrace.llm import wordmodel

    df = spark.createDataFrame([(k, cases.prose(k, 200), ("en", "fr")[k % 2]) for k in range(40)], "doc_id int, text string, lang string")
    with monkeypatch.context() as m:
        m.setattr(quality, "arrow_columns", lambda df, factory, *_: factory())
        kernel = quality.measured(df, quality.train(df), wordmodel.train(df))
    texts = [cases.prose(k, 2000) for k in range(30)] * 50
    texts[700:703] = [None, "", " ".join(texts[:60])]
    batch = pa.record_batch({"t": texts, "lang": ["en", "fr", "en"] * 500})
    tracemalloc.start()
    got = pa.record_batch(kernel(batch), names=list("abcdefg"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1500 and peak < 8 * batch.nbytes, (peak, batch.nbytes)
    for k in (0, 1, 699, 700, 701, 702, 1499):
        one = pa.record_batch(kernel(batch.slice(k, 1)), names=list("abcdefg"))
        assert [*got.slice(k, 1).to_pylist()[0].values()] == pytest.approx([*one.to_pylist()[0].values()])
