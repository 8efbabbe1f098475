"""Every stage of the pipeline against a plain version, on its own input."""

import random

import duckdb
import pytest
from test_joins import WORD, expected_join, expected_removed, groups

import corpus_pipeline
from cashtrail.llm import decontaminate, mixing, ngram_join, rule_quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of every stage, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = before, docs
    return out, folder


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_are_the_five_in_order_and_keep_the_columns(spark, stages):
    assert list(stages[0]) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mix"]
    for name, (before, after) in list(stages[0].items())[:-1]:
        assert after.columns == before.columns, name


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages[0]["quality_classifier"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in rule_quality.classify(before, labels).collect() if r.predicted == 1}
    assert texts(after) == [t for t in texts(before) if t[0] in good] and 0 < len(good) < before.count()


def test_lines_stay_where_they_stand_first(stages):
    before, after = stages[0]["line_dedup"]
    rows = texts(before)
    removed = {d: gone for d, _, gone in expected_removed(rows)[0]}
    left = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d])) for d, t in rows]
    assert texts(after) == [(d, t) for d, t in left if t.strip()] and any(removed.values())


def test_one_of_each_group_of_copies_stays(stages):
    before, after = stages[0]["ngram_jaccard_join"]
    rows = texts(before)
    low = {d: c for d, _, c in expected_join(rows)}
    assert texts(after) == [(d, t) for d, t in rows if low[d] == d]


def test_contaminated_documents_go(spark, stages):
    before, after = stages[0]["benchmark_decontamination"]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    items, gone = [f" {plain(r.text)} " for r in bench], {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    whole = {d for d, t in texts(before) if any(i in f" {plain(t)} " for i in items)}
    assert whole <= gone
    assert gone == {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}


def test_mix_of_the_last_stage(stages):
    out, folder = stages
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/benchmark_decontamination/*.parquet'")
    want = con.execute(mixing.mix_sql() + " order by doc_id").fetchall()
    got = sorted(tuple(r) for r in out["source_mix"][1].collect())
    assert [(*g[:3], round(g[3], 6), g[4], ",".join(map(str, g[5]))) for g in got] == [(*w[:3], round(w[3], 6), *w[4:]) for w in want]


def test_near_copies_without_id_and_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (2, base), (3, base + " more"), (None, "alone"), (None, "alone"), (4, ""), (5, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SMALL).collect()), key=str) == sorted([(1, base), (None, "alone"), (4, ""), (5, None)], key=str)


def plain_survivors(rows):
    """doc_ids left when each group linked by a Jaccard similarity of 0.8 of five-word runs keeps its smallest."""
    own = []
    for _, t in rows:
        words = WORD.findall(t.lower())
        own.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if own[i] and own[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    low = {}
    for (d, _), r in zip(rows, groups(len(rows), near)):
        low[r] = min(low.get(r, d), d)
    return sorted(low.values())


def test_near_copies_by_five_words_and_four_fifths(spark, monkeypatch):
    """Two scattered words of 100 make near copies; borderline pairs, a group over a list's length and a shared passage."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(5000)
    base, passage = [word() for _ in range(100)], [word() for _ in range(70)]
    edited = lambda text, places: [word() + "x" if i in places else w for i, w in enumerate(text)]
    rows = [base, edited(base, {30, 70})]
    for k in range(60):
        other = [word() for _ in range(rng.choice([12, 40, 90]))]
        rows += [other, edited(other, set(rng.sample(range(len(other)), rng.choice([1, 2, 3]))))]
    rows += [edited(base, set(rng.sample(range(100), rng.randrange(0, 6)))) for _ in range(40)]
    rows += [passage + [word() for _ in range(rng.choice([2, 8, 16, 24, 40]))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SMALL).collect())
    assert got == plain_survivors(rows) and 1 not in got and 60 < len(got) < len(rows) - 30


@pytest.mark.parametrize("marks", [[], [(-1, 1), (-2, 0)], [(d, 0) for d in range(12)]])
def test_quality_without_a_rule_keeps_all(spark, tmp_path, marks):
    """No label, labels of other documents, labels of one class."""
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(d, f"text number {d}") for d in range(12)] + [(None, None)], "doc_id long, text string")
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)
