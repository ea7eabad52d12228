"""The stages against brute force, each on its own input."""

from collections import Counter


import corpus_pipeline as c
from millrace.llm import queries
from millrace.llm.common import materialise, table
from tests.llm import cases
from tests.llm.test_operators import HARD, WORD, brute_fingerprint, brute_targets, low


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("n_chars", "score")
    assert [n for n, _ in c.STAGES][0] == "language ID" and len(c.STAGES) == 5
    kept = {}
    columns = docs.columns
    before = docs
    for name, stage in c.STAGES[:-1]:
        after = materialise(stage(spark, before, sf_dir))
        assert after.columns == columns
        kept[name] = (before.collect(), after.collect())
        before = after
    b, a = kept["language ID"]
    assert set(a) <= set(b) and len(a) > 0.98 * len(b)
    b, a = kept["SimHash near-dedup"]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in b}
    group = {}
    for i in sorted(fps):
        group[i] = next((j for j in group if (fps[i] ^ fps[j]).bit_count() <= 2), i)
    assert {r.doc_id for r in a} <= set(fps) and {fps[r.doc_id] for r in a} <= set(fps.values())
    assert len({fps[r.doc_id] for r in a}) == len(a)
    alone = [i for i in fps if not any(j != i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps)]
    assert set(alone) <= {r.doc_id for r in a}
    b, a = kept["benchmark decontamination"]
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = HARD.findall(low(r.text))
        windows |= {" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9))} if w else set()
    clean = {r.doc_id for r in b if not any(x in " " + " ".join(HARD.findall(low(r.text))) + " " for x in windows)}
    assert {r.doc_id for r in a} == clean
    b, a = kept["mixing sources to target weights"]
    size = lambda r: len(WORD.findall(r.text or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in b:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in a:
        taken[r.source] += size(r)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * largest[s] + 1
    last = c.encoded(spark, before, sf_dir).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in a)


def test_run_and_empty(spark, sf_dir):
    assert c.run(spark, sf_dir).count() > 100
    none = cases.empty(spark)
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, none, sf_dir).columns == none.columns, name
        assert stage(spark, none, sf_dir).count() == 0
    assert c.encoded(spark, none, sf_dir).count() == 0


def test_awkward_rows(spark, sf_dir):
    df = cases.documents(spark)
    for name, stage in c.STAGES[:-1]:
        df = materialise(stage(spark, df, sf_dir))
        assert df.columns == cases.documents(spark).columns, name
        assert df.count() > 0
    assert c.encoded(spark, df, sf_dir).count() == df.count()


def test_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1


def test_unknown_languages_go(spark, sf_dir):
    import random

    r = random.Random(1)
    texts = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60)),
    ]
    docs = table(spark, sf_dir, "documents")
    planted = spark.createDataFrame([(10**6 + k, t, None, "a", len(t)) for k, t in enumerate(texts)], docs.schema)
    kept = {x.doc_id for x in c.language(spark, docs.unionByName(planted), sf_dir).collect()}
    assert not any(k >= 10**6 for k in kept) and len(kept) > 0.98 * docs.count()
