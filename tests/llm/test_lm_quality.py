import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lm_score, rule_ensemble
from paperloom.llm.elias_fano import EliasFano, codebook
from paperloom.llm.quality_rules import STOP_WORDS

from .cases import SCHEMA, frame

START, END = b" start", b" end"


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (1, 1 << 63), (500, 600), (3000, 1 << 63), (2000, 50)])
def test_elias_fano_access_and_successor(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    sequence = EliasFano.of(values, universe)
    assert (sequence.access(np.arange(n)) == values).all()
    asked = np.concatenate([rng.integers(0, universe, 500, dtype=np.uint64), values])
    at, equal = sequence.successor(asked)
    want = np.searchsorted(values, asked)
    assert (at == want).all()
    assert (equal == (np.append(values, 0)[want] == asked) & (want < n)).all()


def test_elias_fano_successor_in_crowded_buckets():
    rng = np.random.default_rng(3)
    crowd = (1 << 40) + rng.choice(1 << 22, 20_000, replace=False).astype(np.uint64)
    values = np.sort(np.concatenate([crowd, rng.integers(0, 1 << 62, 200, dtype=np.uint64)]).astype(np.uint64))
    asked = np.concatenate([(1 << 40) + rng.integers(0, 1 << 22, 5000, dtype=np.uint64), values])
    at, equal = EliasFano.of(values, 1 << 62).successor(asked)
    want = np.searchsorted(values, asked)
    assert (at == want).all()
    assert (equal == np.isin(asked, values)).all()


def test_trie_stores_quantised_probabilities():
    low = int(lm_score._LOW)
    words = np.array([5 << 40, 9 << 40], dtype=np.uint64)
    # 5: (1: 10 x3, 11 x1), (2: 10 x6); 9: (2: 7 x1, 8 x0), (low: 10 x8). The tree is sent twice.
    tree = (words, [2, 2], np.array([1, 2, 2, low], dtype=np.uint64), [2, 1, 2, 1], np.array([10, 11, 10, 7, 8, 10], dtype=np.uint64), [3, 1, 6, 1, 0, 8])
    shard = lm_score.Shard(*[np.tile(x, 2) for x in tree], lm_score._Frequent({9 << 40: 100}, {(9 << 40, low): 60}), tokens=120, levels=255)
    assert shard.totals.tolist() == [20, 100]
    assert shard.trie.rank(np.append(words, np.uint64(77))).tolist() == [0, 1, -1]
    assert shard.trie.pairs.find(np.array([0, 0, 1, 1, -1]), np.array([1, 3, 2, low, 1], dtype=np.uint64)).tolist() == [0, -1, 2, 3, -1]
    books = [codebook(e, nothing, 255) for e, nothing in zip(shard.trie.ends, (0.0, 1.0, 0.0), strict=True)]
    assert books[0][shard.pair_codes] == pytest.approx([8 / 40, 12 / 40, 2 / 120, 60 / 120], rel=0.02)
    assert books[1][shard.rest_codes] == pytest.approx([10 / 18, 10 / 22, 10 / 12, 10 / 70], rel=0.02)
    assert books[2][shard.triple_codes] == pytest.approx([6 / 18, 2 / 18, 12 / 22, 2 / 12, 0, 16 / 70], rel=0.02)


def brute(docs):
    """docs: (doc_id, text) rows. Expected (held_out, n_tokens, n_known, N, base, score) per row."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    texts = [[*(t or "").encode().lower().split(), END] for _, t in docs]
    train = [q for q, h in zip(texts, held, strict=True) if not h]
    ahead = lambda q, n: [*[b" first", START][2 - n :], *q]
    one = Counter(w for q in train for w in q)
    two = Counter(b for q in train for b in zip(ahead(q, 1), q, strict=False))
    three = Counter(b for q in train for b in zip(ahead(q, 2), ahead(q, 1), q, strict=False))
    after_one, after_two = Counter(), Counter()
    for (a, _), n in two.items():
        after_one[a] += n
    for (a, b, _), n in three.items():
        after_two[a, b] += n
    n, v, mu, nu = sum(one.values()), len(one), lm_score.MU_2, lm_score.MU_3
    single = lambda c: (one[c] + 1) / (n + v + 1)
    given_one = lambda b, c: (two[b, c] + mu * single(c)) / (after_one[b] + mu)
    given_two = lambda a, b, c: (three[a, b, c] + nu * given_one(b, c)) / (after_two[a, b] + nu)
    out = []
    for q, h in zip(texts, held, strict=True):
        p = [given_two(*t) for t in zip(ahead(q, 2), ahead(q, 1), q, strict=False)]
        out.append((h, len(q), sum(one[w] > 0 for w in q), n, sum(math.log10(single(w)) for w in q), sum(math.log10(min(1, x)) for x in p)))
    return out


def compare(df, docs, rel=0.02, near=0.05):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=key)
    want = sorted(((d, *w) for (d, _), w in zip(docs, brute(docs), strict=True)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=rel, abs=near)


def test_scores_equal_brute_force_over_many_blocks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(lm_score.lm_score(docs, block_bytes=50_000, shard_tokens=5000), rows)
    # With finer steps nothing but the steps' own error is left.
    compare(lm_score.lm_score(docs, block_bytes=50_000, shard_tokens=20_000, levels=65_535), rows, rel=1e-4, near=1e-3)


def test_scores_are_the_same_for_any_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.selectExpr("sum(size(split(text, ' ')))").first()[0]
    scores = [{r.doc_id: r.score for r in lm_score.lm_score(docs, block_bytes=size, shard_tokens=max(1, tokens // shards)).collect()} for shards, size in ((1, 8_000_000), (4, 100_000), (50, 40_000))]
    for other in scores[1:]:
        assert other == pytest.approx(scores[0], rel=1e-9)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_blocks")]


def test_back_off_of_many_words_uses_the_counted_vocabulary(spark):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(120)]
    words = [[f"w{(37 * i + k) % 4000:04d}" for k in range(60)] for i in range(120)]
    # Held-out texts run backwards, so that no bigram of theirs is learnt; just the weight that the two marks ahead leave is a step of the codebook.
    docs = [(i, " ".join(w[-2::-1] if h else w)) for i, (w, h) in enumerate(zip(words, held, strict=True))]
    want = brute(docs)
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=3000).collect()}
    assert sum(held) > 5 and len({w for ws, h in zip(words, held, strict=True) if not h for w in ws}) > 3000
    for i in range(120):
        assert got[i].base_score == pytest.approx(want[i][4], rel=1e-9)
        assert not held[i] or got[i].score == pytest.approx(want[i][5], rel=1e-6)


def test_scores_on_edge_cases(spark):
    compare(lm_score.lm_score(frame(spark, null_id=True)), [(r.doc_id, r.text) for r in frame(spark, null_id=True).collect()])
    assert lm_score.lm_score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_without_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = [(i, "a b a") for i in held]
    rows = lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)}


def test_bigrams_raise_scores_of_held_out_texts(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice(("new york", "los angeles", "san jose")) for _ in range(30))) for i in range(300)]
    held = [r for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert held and all(r.score > r.base_score + 5 for r in held)


def test_rules_come_from_every_node():
    text = """RandomForestClassificationModel: numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert [r.tests for r in rule_ensemble.tree_rules(text, ["a", "b"])] == [(("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)), (("a", ">", 0.5),)]


def brute_statistics(text):
    """The statistics of a text, in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    known = {form for w in STOP_WORDS for form in (w, w.capitalize())}
    share = lambda part, whole: part / whole if whole else 0.0
    found = lambda pattern: len(re.findall(pattern, text))
    inside = sum(map(len, words))
    return {
        "log_words": math.log1p(len(words)), "word_length": share(inside, len(words)), "symbol_share": share(found(r"[#*$%&|<>]"), len(words)), "bang_share": share(found("!"), len(words)),
        "capital_share": share(found("[A-ZÀ-ÖØ-Þ]"), inside), "digit_share": share(found("[0-9]"), inside), "punctuation_share": share(found("[.,;:?]"), len(words)), "distinct_share": share(len(set(words)), len(words)),
        "function_word_share": share(sum(w in known for w in words), len(words)), "same_line_share": share(len(lines) - len(set(lines)), len(lines)), "words_by_line": share(len(words), len(lines)),
    }


def test_statistics_and_scores_equal_brute_force(spark, sf_dir):
    """Statistics by plain Python, and every score as the logistic of the weights of the rules that hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, null_id=True).where("doc_id IS NULL OR doc_id < 100").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stats = rule_ensemble.statistics(docs, "doc_id", "text")
    rows = stats.collect()
    for r in rows:
        want = brute_statistics(texts[r.doc_id])
        assert set(want) == set(stats.columns[1:])
        assert all(r[name] == pytest.approx(x, rel=1e-12) for name, x in want.items()), r.doc_id
    names = stats.columns[1:]
    training = stats.join(labels, "doc_id").where("crc32(CAST(doc_id AS STRING)) % 5 <> 0").select(F.col("quality").cast("double").alias("label"), *names)
    ensemble = rule_ensemble.fit(training, names, trees=6)
    assert ensemble.weights
    got = {r.doc_id: r.score for r in stats.select("doc_id", ensemble.column().alias("score")).collect()}
    for r in rows:
        holds = lambda rule: all(r[name] <= at if sign == "<=" else r[name] > at for name, sign, at in rule.tests)  # noqa: B023, E731
        total = ensemble.intercept + sum(w for rule, w in ensemble.weights if holds(rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_classifier_is_accurate_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = rule_ensemble.classify(docs, labels)
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_classifier_edge_cases(spark):
    docs = frame(spark, null_id=True)
    labels = spark.createDataFrame([(1, None), (3, 1), (4, 0), (5, 0), (None, 1), (6, 1), (999, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    rows = rule_ensemble.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    constant = rule_ensemble.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in constant}) == 1 and constant[0].predicted == 1
    assert rule_ensemble.classify(docs, labels.limit(0)).first().score == 0.5
    assert rule_ensemble.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0
