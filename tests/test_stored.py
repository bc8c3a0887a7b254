"""Stored tables at work: what scans read, which parts are rewritten, the substring index, running sums over ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import markdown, tables
from paperloom.operators import monitoring, prefix, search, sketches, store, trigram


def rows_read(df):
    """Rows that the scans of a collected frame handed on, after row groups and pages are skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


ROW = "id long, at long, text string"


def test_look_ups_skip_most_row_groups(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.col("id"), ((F.col("id") * 7919) % n).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = str(tmp_path / "table")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(256 << 10))
    try:
        store.write_sorted(rows, path, ["at"], {"id": 20_000})
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    for value in (0, 777, n - 1):
        by_id, by_time = store.look_up(spark, path, ROW, "id", value), store.look_up(spark, path, ROW, "at", value)
        assert [r.id for r in by_id.collect()] == [value] and rows_read(by_id) < n / 5
        assert [r["at"] for r in by_time.collect()] == [value] and rows_read(by_time) < n / 5
    assert store.look_up(spark, path, ROW, "id", n + 5).collect() == [] and rows_read(store.look_up(spark, path, ROW, "id", n + 5)) < n / 5


def test_bucketed_children_are_read_by_bucket(spark):
    store.create_tables(spark, "paperloom_buckets", 16)
    try:
        spark.createDataFrame([(str(k), str(k % 50), "m") for k in range(500)], "id string, document_id string, mode string").createOrReplaceTempView("new_rows")
        spark.sql("INSERT INTO paperloom_buckets.analyses (id, document_id, mode) SELECT id, document_id, mode FROM new_rows")
        found = spark.table("paperloom_buckets.analyses").where("document_id = '7'")
        assert len(found.collect()) == 10
        assert rows_read(found) < 500 / 4
    finally:
        spark.sql("DROP DATABASE paperloom_buckets CASCADE")


def files_of(path):
    return {f"{p.parent.name}/{p.name}": p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_changes_rewrite_touched_parts_only(spark, tmp_path):
    schema, path, parts = "id long, text string", tmp_path / "docs", 16
    rows = [(k, f"text {k}") for k in range(400)] + [(None, "no id")]
    store.write_parts(spark.createDataFrame(rows, schema), str(path), "id", parts)
    before = files_of(path)
    changes = spark.createDataFrame([(3, "new"), (5, None), (10**9, "unknown")], schema)
    only = store.update_parts(spark, str(path), schema, changes, "id", parts)
    assert 1 <= len(only) <= 3
    after = files_of(path)
    assert {f.split("/")[0] for f in set(after) - set(before)} <= {f"part={k}" for k in only}
    assert all(after[f] == before[f] for f in after if int(f.split("/")[0].removeprefix("part=")) not in only)
    key = lambda r: (r[0] is not None, r[0] or 0)
    read = lambda: sorted(map(tuple, store.read_parts(spark, str(path), schema).collect()), key=key)
    want = sorted([(i, "new" if i == 3 else t) for i, t in rows], key=key)
    assert read() == want
    store.update_parts(spark, str(path), schema, changes, "id", parts)
    assert read() == want

    # A cascade empties a part wholly, in both tables, and leaves others alone.
    child = tmp_path / "child"
    store.write_parts(spark.createDataFrame([(k % 400, "c") for k in range(1000)], "doc long, text string"), str(child), "doc", parts)
    one = store.touched_parts(spark.createDataFrame([(3,)], "id long"), "id", parts)[0]
    gone = spark.createDataFrame([(k,) for k in range(400)], "id long").where(store.part_of(F.col("id"), parts) == one)
    ids = {r.id for r in gone.collect()}
    before = files_of(path)
    assert store.delete_parts(spark, {"docs": (str(path), schema, "id"), "child": (str(child), "doc long, text string", "doc")}, gone, parts) == {"docs": [one], "child": [one]}
    assert read() == [r for r in want if r[0] not in ids]
    assert sorted(r.doc for r in store.read_parts(spark, str(child), "doc long, text string").collect()) == sorted(k % 400 for k in range(1000) if k % 400 not in ids)
    assert {f for f, at in files_of(path).items()} == {f for f in before if not f.startswith(f"part={one}/")}
    before = files_of(path)
    store.insert_absent_parts(spark, str(path), schema, spark.createDataFrame([(k, "back") for k in range(400)], schema), "id", parts)
    assert read() == sorted([*[r for r in want if r[0] not in ids], *[(i, "back") for i in ids]], key=key)
    assert before.items() <= files_of(path).items()


def test_a_migration_that_dies_anywhere_is_done_over_from_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    steps = [lambda df: df.withColumn("n", F.col("n") + 1), lambda df: df.withColumn("n", F.col("n") * 10), lambda df: df.withColumn("n", F.col("n") + 5)]
    store.write_version(spark.createDataFrame([(1, 1)], "id int, n int"), path, 1)
    rows = lambda: [tuple(r) for r in spark.read.parquet(f"{path}/version={store.newest_version(spark, path):06d}").collect()]
    for number, want in ((1, 2), (2, 20), (3, 25)):
        assert store.run_migrations(spark, path, steps[:number]) == number and rows() == [(1, want)]
        # Its marker is lost, as if the step had died between the rows and the marker.
        (tmp_path / "table" / f"schema-{number}" / "_SUCCESS").unlink()
        assert store.run_migrations(spark, path, steps[:number]) == number and rows() == [(1, want)]


@pytest.mark.parametrize("block_chars", [trigram.BLOCK_CHARS, 500])
def test_index_search_equals_the_full_scan(spark, tmp_path, block_chars):
    rng = random.Random(3)
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choices("abAB é\U0001f600\n", k=rng.randrange(60)))
    docs = [(k, f"file {k % 7}", text()) for k in range(300)] + [(5, "twice", "abab"), (None, "none", "abab ab"), (2**62, "far", "abab"), (-9, None, "baba")]
    frame = spark.createDataFrame(docs, "id long, filename string, text string")
    path = str(tmp_path / "index")
    trigram.build(frame, path, block_chars)
    for needle in ("aba", "AB A", "éa", "", "file 3", "zzz", "\U0001f600\nb", "ababab", "e", "file 3\na", "abab"):
        got, want = (sorted(map(repr, map(tuple, f.collect()))) for f in (trigram.find(frame, path, needle), search.history(frame, needle)))
        assert got == want, needle


def test_a_search_reads_the_lists_of_its_needle_only(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), "text")
    path = str(tmp_path / "index")
    trigram.build(docs, path, 20_000)
    everything = spark.read.parquet(path).count()
    codes = list(dict.fromkeys(trigram.trigrams("zqx").tolist()))
    assert rows_read(trigram.lists(spark, path, codes)) < everything / 4


def test_posting_lists_come_back():
    rng = np.random.default_rng(1)
    for high in (10, 300, 70_000, 2**40, 2**62):
        ids = np.unique(rng.integers(-high, high, 50))
        assert (trigram.unpacked(trigram.packed(ids)) == ids).all()


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_sums_over_ranges_equal_brute_force(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), None if k % 90 == 0 else k, rng.choice([-3, -1, 0, 1, 2, None])) for k in range(900)]
    frame = spark.createDataFrame(rows, "day string, at long, step long").withColumn("n", F.lit("clash"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in ([], ["day"]):
            got = prefix.running(frame, keys, ["at", "step"], F.col("step"), str(tmp_path / f"out{len(keys)}")).collect()
            want, order = [], lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)
            for key in {r[0] if keys else 1 for r in rows}:
                total, least = 0, None
                for no, r in enumerate(sorted((r for r in rows if not keys or r[0] == key), key=order), start=1):
                    total += r[2] or 0
                    least = total if least is None else min(least, total)
                    want.append((r[0], r[1], r[2], no, total, least))
            if keys:
                assert sorted(map(repr, ((r.day, r["at"], r.step, r.line_no, r.running, r.least) for r in got))) == sorted(map(repr, want))
            else:  # equal (at, step) may come in any order of days
                assert sorted((r["at"] or -1, r.line_no, r.running, r.least) for r in got) == sorted((w[1] or -1, *w[3:]) for w in want)
        plan = prefix.running(frame, ["day"], ["at"], F.col("step"), str(tmp_path / "plan"))._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefix.running(frame.limit(0), ["day"], ["at"], F.col("step"), str(tmp_path / "none")).collect() == []


def test_a_gauge_never_falls_below_zero(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.choice([1, -1, -1, 0])) for k in range(500)]
    got = monitoring.active_streams_total(spark.createDataFrame(rows, "at long, step long"), ["at"], F.col("step"), str(tmp_path / "out")).orderBy("at").collect()
    active, want = 0, []
    for _, step in rows:
        active = max(0, active + step)
        want.append(active)
    assert [r.active for r in got] == want


def test_table_functions_equal_the_column_functions(spark):
    texts = ["x\n### 1. one\n#### 12.\n\n### 3. \n  \n### 4. four", "", "### 2.a", None, "#### 7. b\n### 8. c ### 9. d"]
    tables.register(spark)
    spark.createDataFrame(list(enumerate(texts)), "id int, md string").createOrReplaceTempView("answers")
    got = sorted(map(tuple, spark.sql("SELECT id, b.idx, b.body FROM answers, LATERAL md_blocks(md) b").collect()))
    want = spark.table("answers").select("id", F.explode(markdown.numbered_blocks(F.col("md"))).alias("b")).select("id", "b.index", "b.body").collect()
    assert got == sorted(map(tuple, want)) and len(got) == 6
    block = "**Text:** a b \n**Schwere**: hoch\n\nrest"
    told = spark.createDataFrame([(block,)], "b string").selectExpr("md_field(b, 'Text')", "md_field(b, 'Schwere')", "md_field(b, 'None')", "md_severity(md_field(b, 'Schwere'))").first()
    assert tuple(told) == ("a b", "hoch", None, "high")


def test_table_functions_need_no_python(spark):
    tables.register(spark)
    spark.createDataFrame([(0, "a\n\n  b\n"), (1, ""), (2, None)], "id int, md string").createOrReplaceTempView("answers")
    lines = spark.sql("SELECT id, n.line_no, n.line FROM answers, LATERAL text_lines(md) n")
    assert sorted(map(tuple, lines.collect())) == [(0, 1, "a"), (0, 2, ""), (0, 3, "  b"), (0, 4, ""), (1, 1, "")]
    for found in (lines, spark.sql("SELECT b.* FROM answers, LATERAL md_blocks(md) b")):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_to_what_they_say_of_the_whole(spark):
    rng = random.Random(7)
    rows = [(f"s{k % 3}", k % 11, f"text {rng.randrange(900)}" + "x" * rng.randrange(200)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "source string, day int, text string")
    daily = sketches.summarise(docs, ["source", "day"])
    for r in sketches.estimates(sketches.merged(daily, ["source"]), ["source"]).collect():
        own = [t for s, _, t in rows if s == r.source]
        assert r.texts == len(own) and abs(r.distinct_texts - len(set(own))) <= 0.08 * len(set(own))
        lengths = sorted(map(len, own))
        for share, told in ((0.5, r.q50), (0.9, r.q90)):
            below, to = (sum(n < told for n in lengths) / len(own), sum(n <= told for n in lengths) / len(own))
            assert below <= share + 0.05 and to >= share - 0.05
    words = docs.select("source", "day", F.substring("text", 6, 3).alias("word"))
    cells = sketches.count_min(words, ["source", "day"], "word").groupBy("source", "row", "cell").agg(F.sum("n").alias("n"))
    exact = {(r.source, r.word): r["n"] for r in words.groupBy("source", "word").agg(F.count("*").alias("n")).collect()}
    asked = words.select("source", "word").distinct().unionByName(spark.createDataFrame([("s0", "never")], "source string, word string"))
    for r in sketches.count_estimates(cells, asked, ["source"], "word").collect():
        assert 0 <= r.estimate - exact.get((r.source, r.word), 0) <= 2000 * 2.72 / sketches.COUNTERS * 4
