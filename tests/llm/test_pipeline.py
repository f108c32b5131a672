"""The pipeline: columns, each stage on awkward rows, and the entry point with and without the corpus part."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from basketry.llm import langid, pieces
from tests.llm import samples
from tests.llm.test_matching import WORD, fingerprint, hit_words, reachable, removed

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BENCH = [(1, samples.prose(2, 30)), (2, None)]


def tables(spark, tmp_path, rows):
    samples.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_in_turn(spark, tmp_path):
    sf = tables(spark, tmp_path, samples.rows())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        model = langid.Model(langid.fit(langid.taught(docs))) if k == 0 else None
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        after = [tuple(r)[:len(columns)] for r in docs.collect()]
        assert docs.columns[:len(columns)] == columns
        ids = Counter(r[0] for r in after)
        if k == 0:
            known = [(r, *model.predict(r[1])) for r in before]
            assert Counter(after) == Counter(r for r, lang, score in known if lang != "und")
        elif k == 1:
            label = reachable([fingerprint(r[1]) for r in before])
            groups = {}
            for root, r in zip(label, before):
                groups.setdefault(root, []).append(r)
            assert Counter(r[0] for r in after) == Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
            assert not Counter(after) - Counter(before)
        elif k == 2:
            want = removed(before, 20)
            assert ids == Counter(r[0] for r in want.elements() if r[1] > r[2] or r[1] == 0)
            assert Counter((r[0], len(WORD.findall(r[1] or ""))) for r in after) == Counter((r[0], r[1] - r[2]) for r in want.elements() if r[1] > r[2] or r[1] == 0)
        elif k == 3:
            assert Counter(after) == Counter(r for r in before if not hit_words(r[1], BENCH, 10)[-1])
            assert len(after) < len(before)
        else:
            assert Counter(after) == Counter(before) and docs.columns[len(columns):] == ["ids_", "n_pieces", "lossless"]
            # Every text comes back, but for those that hold the mark of a blank themselves.
            assert all(r.lossless == (pieces.MARK not in r.text) for r in docs.collect() if r.text is not None)


def test_language_id_keeps_short_texts_and_unlearned_scripts(spark, tmp_path):
    rows = [(i, samples.prose(i, 60), "en", "s", "", "", "", "") for i in range(8)]
    odd = [(100, "Kubernetes xylophone jukebox", None, "s", "", "", "", ""), (101, "Добрый день", None, "s", "", "", "", ""), (102, "12 34 !!", None, "s", "", "", "", "")]
    docs = samples.frame(spark, rows + odd)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()} == {*range(8), 100, 101}


def test_run_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_entry_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.parquet"))
    said = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"],
        cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""},
    )
    n, corpus = map(int, said.stdout.split())
    assert n > 100 and corpus == 0


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
