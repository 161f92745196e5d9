"""The pipeline's stages against what each must do, on tables small enough to see through."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]
WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "sol") for b in ("da", "ne", "ri") for c in ("m", "s", "nt", "l")]


def test_stages_and_columns(spark, tmp_path):
    deal = random.Random(11)
    text = lambda n=60: " ".join(deal.choice(WORDS) + str(deal.randrange(9)) for _ in range(n)) + "."
    docs, labels, kinds = [], [], {}
    for i in range(360):
        kind = ("clean", "clean", "clean", "loud", "toxic", "clean")[i % 6]
        t = text()
        if kind == "loud":
            t = " ".join(w.upper() + "!!" for w in t.split())
        if kind == "toxic":
            t += " vrak" + deal.choice(WORDS) + " vrak" + deal.choice(WORDS)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(kind != "loud"), int(kind == "toxic")))
        kinds[i] = kind
    item = text(30)
    docs += [(1000, docs[0][1], "en", "s0", 1), (1001, docs[1][1].replace(docs[1][1].split()[3], "changed", 1), "en", "s1", 1), (1002, text(30) + " " + item, "en", "s2", 1), (1003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "mixing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, k in kinds.items() if k == "clean"}
    assert not {i for i in left["quality"] if kinds.get(i) == "loud"} and clean <= left["quality"]
    assert not {i for i in left["toxicity"] if kinds.get(i) == "toxic"} and clean <= left["toxicity"]
    assert not {1000, 1001} & left["near_duplicates"] and clean <= left["near_duplicates"]
    assert left["decontamination"] == left["near_duplicates"] - {1002}
    assert left["mixing"] <= left["decontamination"] and now.where("taken > 3 * size or taken <= 0").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == left["mixing"]


def test_empty_tables_and_null_rows(spark, tmp_path):
    """Nothing goes through as nothing; a table of null and empty texts alone crashes no stage."""
    docs, labels, items = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"
    odd = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", "en", "s", 0), (None, "one", None, None, 3)]
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], items).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    none, some = (corpus_pipeline.run(spark, f"{tmp_path}/{n}") for n in ("none", "odd"))
    assert none.count() == 0 and none.columns == some.columns
    assert [(r.doc_id, r.text) for r in some.collect()] == [(None, "one")]


def test_the_rest_stands_alone(tmp_path):
    """Without corpus_pipeline.py and the llm folders, the entry imports and keeps its other queries."""
    import shutil

    shutil.copytree(ROOT / "loomdoc", tmp_path / "loomdoc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, own = said.stdout.split()[-2:]
    assert int(n) > 50 and own == "False"


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names and 4 <= len(corpus_pipeline.STAGES) <= 5
