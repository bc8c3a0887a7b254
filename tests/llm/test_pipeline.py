"""The pipeline's stages, each against brute force on its own input."""

import re
import subprocess
import sys
import time
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

import corpus_pipeline
from paperloom.llm import mixing, simhash_dedup

from .cases import SCHEMA, frame
from .test_rules_dedup_mix import brute_fill
from .test_simhash_secrets import roots


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows each stage gets and gives: {name: (before, after)}."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        rows = after.collect()
        out[name] = (docs.collect(), rows, docs.columns, after.columns)
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_stages_return_the_columns_of_documents(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3]


def test_quality_stage(stages):
    before, after, *_ = stages["quality_rules"]

    def bad(text):
        words = text.split()
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marked = {i + o for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for o in range(5)}
        return len(words) < 10 or 100 * len(marked) > 20 * len(words)

    assert {r.doc_id for r in after} <= {r.doc_id for r in before if not bad(r.text)}
    assert len(after) > 0.8 * sum(not bad(r.text) for r in before)


def test_exact_stage(stages):
    before, after, *_ = stages["exact_dedup"]
    texts = {}
    for r in sorted(before):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in after} == set(texts.values()) and len(after) == len(texts)


def test_near_stage(stages):
    before, after, *_ = stages["simhash_dedup"]
    prints = {r.doc_id: simhash_dedup.fingerprint(r.text) for r in before}
    found = roots(sorted(prints), [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(r.doc_id for r in after) == sorted(set(found.values()))


def test_mixing_stage(stages):
    before, after, *_ = stages["mixing"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    names = sorted(sizes)
    targets = dict(zip(names, brute_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], mixing.SHARE, mixing.MAX_EPOCHS), strict=True))
    taken = Counter()
    for r in after:
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in before)
    assert all(abs(taken[s] - targets[s]) <= longest for s in names)
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    copies = Counter(r.doc_id for r in before)
    for doc_id, n in copies.items():
        pieces = [r for r in after if r.doc_id == doc_id]
        assert sum(r.length for r in pieces) == n * pieces[0].doc_tokens
    windows = Counter()
    for r in after:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 2048 and len({(r.sequence_id, r.offset) for r in after}) == len(after)


def test_run_equals_the_stages(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    pick = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert pick(rows) == pick(stages["packing"][1])


def test_stages_on_edge_cases_and_empty_tables(spark):
    for docs in (frame(spark, null_id=True), spark.createDataFrame([], SCHEMA)):
        inputs = Counter(map(tuple, docs.collect()))
        texts = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in inputs}
        prints = {simhash_dedup.fingerprint(r[1]) for r in inputs}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            rows = Counter(map(tuple, out.collect()))
            if name == "packing":
                assert sum(n for r, n in rows.items() if r[1] == 0) == sum(inputs.values())
                continue
            assert out.columns == docs.columns and set(rows) <= set(inputs)
            if name == "mixing":
                assert all(n <= 2 * inputs[r] for r, n in rows.items())
            else:
                assert rows <= inputs
            if name == "exact_dedup":
                assert sum(rows.values()) == len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})
            if name == "simhash_dedup":
                kept = [simhash_dedup.fingerprint(r[1]) for r in rows.elements()]
                assert len(kept) == len(set(roots(sorted(prints), [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4]).values())) and len(set(kept)) == len(kept)


def test_the_run_cleans_up_after_itself(tmp_path):
    """Tables of a run lie below spark.checkpoint.dir and are gone when it ends."""
    script = f"""
from pyspark.sql import SparkSession
from paperloom.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
one, two = common.scratch_path(spark, "one"), common.scratch_path(spark, "two")
for path in (one, two):
    assert common.written(spark.range(3), "rows", path).count() == 3
common.drop_table(spark, one)
import os
assert one.startswith("{tmp_path}/shared/") and not os.path.exists(one) and os.path.exists(two)
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120, cwd=Path(__file__).parents[2])
    until = time.monotonic() + 30  # Spark's JVM may end after Python
    while list(tmp_path.glob("shared/paperloom-*")) and time.monotonic() < until:
        time.sleep(0.5)
    assert not list(tmp_path.glob("shared/paperloom-*"))
