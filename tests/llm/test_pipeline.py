"""The pipeline's stages, each on its own input, against plain versions; the registry."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from residua.llm import entry  # noqa: E402
from residua.llm.common import Scratch  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], sf_dir), name.replace(" ", "-")))
    return out


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    for s in stages[:-1]:
        assert all(r.n_chars == len(r.text or "") for r in s.collect())


def test_quality_stage_rejects_junk_alone(spark, sf_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(stages[1])}
    assert all(i in kept for i, q in labels.items() if q == 1)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i not in kept for i in bad) >= 0.7 * len(bad)
    assert {p for p in pairs(stages[1])} <= {p for p in pairs(stages[0])}


def test_line_stage(stages):
    assert sorted(pairs(stages[2])) == sorted((i, t) for i, t, _, _ in brute.line_dedup(pairs(stages[1])))


def test_near_stage(stages):
    want = brute.jaccard_components(pairs(stages[2]), 5, 80, 100)
    assert sorted(pairs(stages[3])) == sorted((i, t) for i, t in pairs(stages[2]) if want[i] == i)


def test_mix_stage_takes_words_of_documents(stages):
    before, after = dict(pairs(stages[3])), pairs(stages[4])
    words = lambda t: brute.WORDS.findall((t or "").encode())
    total = sum(len(words(t)) for t in before.values())
    taken = sum(len(words(t)) for _, t in after)
    assert abs(taken - 1.5 * total) <= 0.02 * total
    whole = sum(t == before[i] for i, t in after)
    assert whole >= 0.5 * len(after)
    for i, t in after:
        if t != before[i]:
            rest = iter(words(before[i]))
            assert all(w in rest for w in words(t))


def test_last_stage_is_lossless(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.lossless for r in rows)


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    out = P.run(spark, sf_dir)
    assert out.columns == stages[5].columns
    plain = lambda frame: sorted((r.doc_id, r.source or "", r.n_tokens, bytes(r.ids), r.lossless) for r in frame.collect())
    assert plain(out) == plain(stages[5])


def test_columns_with_names_of_the_stages_stay(spark, tmp_path):
    rows = [(i, f"Some words of the text number {i} that is and was in the house.\nline {i} of it", "a", i, "x", 0.1, 7) for i in range(30)]
    schema = "doc_id long, text string, source string, n_chars long, row string, score double, _row int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in P.STAGES[:-1]:
        docs = Scratch(spark, "names").keep(stage(spark, docs, ""), "stage")
        assert docs.columns == schema.replace(",", "").split()[::2] and docs.count() > 0
        assert {(r.row, r.score, r._row) for r in docs.collect()} == {("x", 0.1, 7)}


def test_rows_with_the_same_or_no_identifier(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    near = text.replace("word39", "changed")
    other = " ".join(f"other{i}" for i in range(40))
    rows = [
        (7, text, "a"), (7, text, "a"), (None, text, "a"), (None, near, "b"), (9, near, "b"),
        (None, other, "a"), (None, other, "b"), (3, "short", "a"), (3, "short", "a"),
    ]
    lines = [(i, f"{t}\nend {n} of the text", s) for n, (i, t, s) in enumerate(rows)]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "near"))
    spark.createDataFrame(lines, schema).repartition(3).write.parquet(str(tmp_path / "lines"))
    out = P.near_duplicates(spark, spark.read.parquet(str(tmp_path / "near")), "")
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted(pairs(out), key=str) == sorted([(7, text), (None, other), (3, "short")], key=str)
    out = P.drop_repeated_lines(spark, spark.read.parquet(str(tmp_path / "lines")), "")
    assert out.columns == ["doc_id", "text", "source"]
    left = [x for _, t in pairs(out) for x in t.split("\n") if x != "short"]
    assert len(left) == len(set(left)) == 3 + len(rows)
    held = {x: i for i, t in pairs(out) for x in t.split("\n")}
    assert (held[text], held[near], held[other]) == (7, 9, None)


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for path in (odd, empty):
        docs = spark.read.parquet(path)
        for _, stage in P.STAGES:
            docs = Scratch(spark, "odd").keep(stage(spark, docs, ""), "stage")
        assert docs.count() == 0 if path == empty else docs.count() > 0


def test_registry():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names
