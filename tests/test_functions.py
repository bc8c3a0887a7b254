"""Functions and operators on small inputs written for each rule."""

import datetime
import hashlib
import io
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import classify, dates, jsonx, markdown, text
from paperloom.functions.patterns import CHAT_DOCUMENT_TOKENS, MARKER_CHARS
from paperloom.operators import catalogues, chat, evidence, inference, monitoring, parsers, prompts, scan, store
from paperloom.plans import operations
from paperloom.sources import files, probes
from paperloom.streaming import streams


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_lengths_count_utf16_units(spark):
    assert one(spark, text.js_length(F.col("t")), t="a😀b") == 4


@pytest.mark.parametrize(
    "t,want",
    [("", "empty"), ("plain text\n", "ok"), ("\x01" * 6 + "a" * 94, "control"), ("\x01" * 5 + "a" * 95, "ok"), ("漢" * 21 + "a" * 79, "unprintable"), ("漢" * 20 + "a" * 80, "ok"), ("Текст", "unprintable"), ("“quotes” – €…", "ok")],
)
def test_print_verdict(spark, t, want):
    c = F.col("t")
    assert one(spark, text.print_verdict(text.js_length(c), text.printable_chars(c), text.control_chars(c)), t=t) == want


def test_white_space_is_unicode(spark):
    assert one(spark, text.word_count(F.col("t")), t="\ufeff a\u00a0b\u3000c \n") == 3
    assert one(spark, text.trim_ws(F.col("t")), t="\u00a0\n a b \ufeff") == "a b"
    assert one(spark, text.normalise(F.col("t")), t=" ÄB \n\t c ") == "äb c"


@pytest.mark.parametrize("t,want", [("x" * 50, None), ("word " * 11, "en"), ("der word die word " * 5, "de"), ("Herr Frau " * 10, "en"), ("und, der. " * 10, "en")])
def test_language(spark, t, want):
    assert one(spark, text.language(F.col("t")), t=t) == want


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (35, 10), (36, 11)])
def test_tokens(spark, n, want):
    assert one(spark, text.tokens(F.col("t")), t="x" * n) == want


def brute_fit(t, most):
    import math

    if math.ceil(len(t) / 3.5) <= most:
        return t, False
    limit = max(0, math.floor(most * 3.5) - MARKER_CHARS)
    cut = t[:limit]
    last = max(cut.rfind("\n\n"), cut.rfind(". "))
    return (cut[: last + 1] if last > limit - 500 else cut) + text.MARKER, True


def test_fit_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices(["word ", "\n\n", ". ", "x" * 90, "é"], k=rng.randint(0, 60))), rng.choice((0, 10, 40, 100, 176, 300, 900))) for _ in range(400)]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int").select("i", text.fit(F.col("t"), F.col("n")).alias("f")).collect()
    assert {r.i: (r.f.text, r.f.truncated) for r in out} == {i: brute_fit(*r) for i, r in enumerate(rows)}


def test_chat_window_equals_removal_loop(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(("user", "assistant", "system")), "x" * rng.choice((0, 10, 900, 3000, 7900))) for c in range(60) for t in range(rng.randint(1, 9))]
    base = 1500
    got = {(r.conv_id, r.turn) for r in chat.window(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), F.lit(base)).collect()}
    want = set()
    for c in range(60):
        kept = [r for r in rows if r[0] == c and r[2] != "system"]
        while base + sum(len(r[3]) for r in kept) > 8000 and len(kept) > 1:
            kept.pop(0)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want
    assert CHAT_DOCUMENT_TOKENS == 3500


@pytest.mark.parametrize(
    "md,titles,want",
    [
        ("## Summary of X\nbody\n## Next\n", ["Summary"], " of X\nbody\n"),
        ("### Summary\nbody", ["Missing", "Summary"], "\nbody"),
        ("## Error-List\nx", ["Error List"], "\nx"),
        ("## summary\nz at the end Z", ["Summary"], "\nz at the end Z"),
        ("nothing", ["Summary"], None),
        ("## Summary", ["Summary"], ""),
    ],
)
def test_section(spark, md, titles, want):
    assert one(spark, markdown.section(F.col("t"), *titles), t=md) == want


@pytest.mark.parametrize(
    "block,want",
    [("**A:** v", "v"), ("**A**: v", "v"), ("**A** v", "v"), ("**A:**\nv\nw\n\nrest", "v\nw"), ("**A:** „v“\n**B:** x", "v"), ("**A:** v\n# H", "v"), ("**a:** v", "v"), ("**B:** v", None), ("**A:** \"\"", None)],
)
def test_field(spark, block, want):
    assert one(spark, markdown.field(F.col("t"), "A"), t=block) == want


def test_numbered_blocks_and_bullets(spark):
    got = one(spark, markdown.numbered_blocks(F.col("t")), t="x\n### 1. one\n#### 12.\n\n### 3. \n  \n### 4. four")
    assert [(b["index"], b["body"].strip()) for b in got] == [(1, "one"), (4, "four")] or [(b["index"], b["body"].strip()) for b in got] == [(1, "one"), (12, "### 3."), (4, "four")]
    assert one(spark, markdown.bullets(F.col("t")), t="- a\n * b \n• c\nno\n-d") == ["a", "b", "c"]


def test_digits_and_levels(spark):
    assert one(spark, markdown.digits(F.col("t")), t="2 von 10") == 210
    assert one(spark, markdown.digits(F.col("t")), t="none") == 0
    assert [one(spark, markdown.severity(F.col("t")), t=t) for t in ("sehr hoch", "low!", "Mittel", None)] == ["high", "low", "medium", "medium"]
    assert [one(spark, markdown.priority(F.col("t")), t=t) for t in ("Hoch", "nieder", "medium", "x high", None)] == ["high", "low", "medium", None, None]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"a": 1}', {"a": 1}), ('x\n```json\n{"a": 1}\n```\n```\n{"a": 2}\n```', {"a": 2}), ('say {"x": 1} then {"a": "}{"} end', {"a": "}{"}), ("[1]", None), ('{"a": NaN}', None), ('{"a": 1', None), ("", None), ('{"a": 1} tail', {"a": 1}), ('{bad {"a": 1}', {"a": 1}),
    ],
)
def test_extract_object(raw, want):
    assert jsonx.extract(raw) == want


def test_letter_block_takes_the_last_valid_fence():
    good = '```json\n{"sections": [], "contentGrade": {"grade": 2}}\n```'
    assert jsonx.letter_block(f"{good}\n```json\n{{}}\n```")["contentGrade"] == {"grade": 2}
    assert jsonx.letter_block("```json\n{broken\n```") is None


@pytest.mark.parametrize("value,want", [("2", 2), ("2.0", 2), ("2.5", None), ('"2"', None), ("0", None), ("7", None), ("null", None), ("6", 6)])
def test_grades_are_whole_numbers(spark, value, want):
    assert one(spark, jsonx.grade(F.try_parse_json(F.col("t"))), t=f'{{"grade": {value}}}') == want


def test_unstructured_answers_parse_to_null(spark):
    for parse in (parsers.grammar, parsers.formulation, parsers.summary):
        assert one(spark, parse(F.col("t")), t="just prose") is None
        assert one(spark, parse(F.col("t")), t="") is None


def test_findings_without_a_document_are_kept_unverified(spark):
    md = "## Overall\n**Error Count:** 3\n## Errors\n### 1. T (Severity: low)\n**Original:** gone words\n**Correction:** x\n"
    got = one(spark, parsers.grammar(F.col("t")), t=md)
    assert [(e["original"], e["verified"]) for e in got["errors"]] == [("gone words", None)]
    checked = one(spark, parsers.grammar(F.col("t"), F.col("d")), t=md, d="other text")
    assert checked["errors"] == [] and one(spark, parsers.filtered_count(parsers.grammar(F.col("t"), F.col("d"))), t=md, d="other text") == 3


def test_quotes_join_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["ab", "cd", "efg", "hi", "jklm"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(80)] + [(99, None)]
    quotes = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(60)] + [(60, "b  CD e"), (61, None), (62, "abc")]
    got = {tuple(r) for r in evidence.find_quotes(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")).collect()}
    norm = lambda t: " ".join((t or "").lower().split())
    assert got == {(d, q) for d, t in docs if t is not None for q, s in quotes if s and len(s) >= 4 and len(norm(s)) >= 4 and norm(s) in norm(t)}


def test_flushes_by_size_and_time(spark):
    rng = random.Random(1)
    rows = [(s, i, i * rng.choice((5, 30)), rng.choice((0, 10, 400, 1200))) for s in range(6) for i in range(50)]
    got = {(r.stream, r.seq): r.batch for r in monitoring.flush_batches(spark.createDataFrame(rows, "stream long, seq long, ms long, chars long")).collect()}
    for s in range(6):
        pending, last, batch = 0, None, 0
        for _, i, ms, chars in sorted(r for r in rows if r[0] == s):
            last = ms if last is None else last
            assert got[s, i] == batch
            pending += chars
            if chars and (pending >= 1024 or ms - last >= 90):
                pending, last, batch = 0, ms, batch + 1


def test_streamed_batches_join_to_the_whole(spark, tmp_path):
    """Streams 0 to 2 end; stream 3 falls silent with text pending, which a timer flushes."""
    rows = [(s, i, i * 20, "x" * (i * 53 % 500), i == 29 and s < 3) for s in range(4) for i in range(30)]
    schema = "stream long, seq long, ms long, text string, end boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.flush_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    seen = []
    listener = streams.Lifecycle(lambda run, kind, what: seen.append(kind))
    spark.streams.addListener(listener)
    query = stream.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    whole = lambda s: "".join(r[3] for r in rows if r[0] == s)
    text = lambda s: "".join(t for _, t in sorted((r.batch, r.text) for r in spark.table("flushed").collect() if r.stream == s))
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and any(text(s) != whole(s) for s in range(4)):
            time.sleep(1)
    finally:
        assert streams.stop_all(spark) == 1
    for s in range(4):
        own = sorted((r.batch, r.text) for r in spark.table("flushed").collect() if r.stream == s)
        assert text(s) == whole(s)
        assert [b for b, _ in own] == list(range(len(own)))
    until = time.monotonic() + 20
    while time.monotonic() < until and "complete" not in seen:
        time.sleep(0.5)
    spark.streams.removeListener(listener)
    assert seen[0] == "started" and seen[-1] == "complete" and "progress" in seen


def test_latest_progress_and_windows(spark):
    rows = spark.createDataFrame([("m", 1, 0, 0), ("m", 2, 1, 3), ("n", 1, 5, 5)], "model string, at int, done long, total long")
    got = {r.model: r.latest for r in streams.latest(rows, "model", F.col("at"), streams.progress(F.col("done"), F.col("total"))).collect()}
    assert got == {"m": 33, "n": 100}


def test_retry_once_on_transient_errors_only():
    calls = []

    def run(message, times):
        calls.append(1)
        if len(calls) <= times:
            raise RuntimeError(message)
        return "ok"

    assert inference.with_retry(lambda: run("fetch failed", 1), 0) == "ok"
    for message, times in (("fetch failed", 2), ("no such model", 1)):
        calls.clear()
        with pytest.raises(RuntimeError):
            inference.with_retry(lambda m=message, n=times: run(m, n), 0)


def test_inference_keeps_failures_to_their_rows(spark):
    def backend():
        def answer(system, user):
            if user == "stop":
                raise inference.Aborted("part")
            if user == "bad":
                raise ValueError("broken")
            return user.upper()

        return answer

    rows = spark.createDataFrame([(1, "s", "hi"), (2, "s", "stop"), (3, "s", "bad")], "id int, system string, user string")
    got = {r.id: (r.answer, r.aborted, r.error) for r in inference.infer(rows, backend).collect()}
    assert got == {1: ("HI", False, None), 2: ("part", True, None), 3: (None, False, "broken")}
    assert [r.id for r in inference.missing_only(rows, rows.where("id < 3"), "id").collect()] == [3]


def test_versions_and_migrations(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.read_newest(spark, path, "id int").count() == 0
    for version in (1, 2, 10):
        store.write_version(spark.createDataFrame([(version,)], "id int"), path, version)
    assert store.newest_version(spark, path) == 10
    assert [r.id for r in store.read_newest(spark, path, "id int").collect()] == [10]
    steps = [lambda df: df.withColumn("a", F.lit(1)), lambda df: df.withColumn("b", F.col("a") + 1)]
    df, version = store.migrate(spark.range(1), 0, steps)
    assert version == 2 and df.columns == ["id", "a", "b"]
    assert store.migrate(df, 2, steps)[1] == 2


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_import_folder(spark, tmp_path):
    word = archive({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>again</w:t></w:r></w:p></w:body></w:document>'})
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = archive({
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/><sheet name="Blank" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name, full</t></si></sst>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
    })
    for name, content in {"a.docx": word, "B.XLSX": book, "c.docx": b"no zip", "d.doc": b"x", "e.txt": b"x", "f.pdf": b"x", "g.png": b""}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r for r in files.import_folder(spark, str(tmp_path)).collect()}
    assert {n: r.reject_reason for n, r in got.items()} == {"a.docx": None, "B.XLSX": None, "c.docx": "bad_archive", "d.doc": "legacy_format", "e.txt": "unsupported_type", "f.pdf": "no_extractor", "g.png": "empty_file"}
    assert got["a.docx"].text == "Hello there\n\nagain" and got["a.docx"].word_count == 3
    assert got["B.XLSX"].text == '--- One ---\n"name, full",,5' and got["B.XLSX"].page_count == 2


def test_probes(spark):
    csv, js = probes.from_csv_probe(F.col("a")), probes.from_json_probe(F.col("b"))
    got = one(spark, probes.first_gpu(csv, js), a="NVIDIA RTX 4090, 24564", b="")
    assert (got["name"], got["vram_mb"], got["vendor"]) == ("NVIDIA RTX 4090", 24564, "nvidia")
    got = one(spark, probes.first_gpu(csv, js), a=" ", b='{"Name": " Radeon X ", "VramBytes": 8589934592}')
    assert (got["name"], got["vram_mb"], got["vendor"]) == ("Radeon X", 8192, "amd")
    assert one(spark, probes.first_gpu(csv, js), a="", b="") is None


def test_messages_go_to_the_backend_whole_and_ids_stay(spark):
    rows = spark.createDataFrame([(2**53 + 1, [("system", "s"), ("user", "u")]), (None, [("user", "x")])], "id long, messages array<struct<role:string,content:string>>").coalesce(1)
    got = {r.id: (r.answer, r.error) for r in inference.infer_messages(rows, lambda: lambda m: "/".join(f"{x['role']}={x['content']}" for x in m)).collect()}
    assert got == {2**53 + 1: ("system=s/user=u", None), None: ("user=x", None)}


def test_registered_modes_build_prompts(spark):
    prompts.register_mode("poem", "Schreibe ein Gedicht.", "Write a poem.", 0.9)
    try:
        got = one(spark, prompts.prompt(F.lit("poem"), F.col("t"), F.lit("en"), F.lit(None).cast("string")), t="text")
    finally:
        del prompts.SYSTEM["poem"], prompts.TEMPERATURES["poem"]
    assert (got["system"], got["temperature"]) == ("Write a poem.", 0.9)


def test_tables_are_made(spark):
    store.create_tables(spark, "paperloom_made", 2)
    try:
        assert {r.tableName for r in spark.sql("SHOW TABLES IN paperloom_made").collect() if not r.isTemporary} == {"documents", "analyses", "chat_messages", "first_impressions"}
        assert spark.table("paperloom_made.analyses").columns[:2] == ["id", "document_id"]
    finally:
        spark.sql("DROP DATABASE paperloom_made CASCADE")


def test_html_of_fences(spark):
    md = "a\n```py\n# x <b>\n\n```\n- p\n- q\n```"
    assert one(spark, markdown.html(F.col("t")), t=md) == "<p>a</p>\n<pre><code>\n# x &lt;b&gt;\n<br>\n</code></pre>\n<ul><li>p</li>\n<li>q</li>\n</ul><pre><code>".replace("\n<br>\n</code>", "\n\n</code>")


def test_html_of_lists_wraps_each_run(spark):
    """As a pattern over the whole page would do it, which recurses for each item in Java."""
    rng = random.Random(2)
    texts = ["- x", "* é", "1. z", "y", "", "# h", "<li>x</li>", "- <li>"]
    cases = [rng.choices(texts, k=rng.randrange(1, 9)) for _ in range(40)]
    pages = ["\n".join(items) for items in cases]
    frame = spark.createDataFrame([(t,) for t in [*texts, *pages]], "t string").coalesce(1)
    html = {r.t: r.html for r in frame.select("t", markdown.html(F.col("t")).alias("html")).collect()}
    alone = {t: html[t].removeprefix("<ul>").removesuffix("</ul>") for t in texts}
    for items, page in zip(cases, pages, strict=True):
        assert html[page] == re.sub(r"((?:<li>[\s\S]*?</li>\n?)+)", r"<ul>\1</ul>", "\n".join(alone[t] for t in items))


def test_html_of_very_long_lists_and_paragraphs(spark):
    n = 100_000
    got = one(spark, markdown.html(F.col("t")), t="\n".join(["- item"] * n))
    assert got == "<ul>" + "\n".join(["<li>item</li>"] * n) + "</ul>"
    text = "some **bold** words " * 500_000
    assert one(spark, F.length(markdown.html(F.col("t"))), t=text) == len(text.rstrip(" ")) + 13 * 500_000 + 7 + 1
    fences = "```\nx\n```\n" * 3000
    assert one(spark, markdown.html(F.col("t")), t=fences).count("<pre><code>") == 3000


def _occurrences(text, phrase):
    return [(k, k + len(phrase)) for k in range(len(text) - len(phrase) + 1) if text.startswith(phrase, k)]


@pytest.mark.parametrize("chars", [scan.SCAN_CHARS, 60])
def test_scans_find_every_overlapping_occurrence(spark, monkeypatch, chars):
    monkeypatch.setattr(scan, "SCAN_CHARS", chars)
    rng = random.Random(12)
    docs = [(k, "".join(rng.choices("ab é\U0001f600", k=rng.randrange(80)))) for k in range(100)] + [(7, "abab"), (None, "abab"), (100, None), (101, "ab" * 60_000)]
    phrases = [(k, "".join(rng.choices("ab é\U0001f600", k=rng.randrange(1, 5)))) for k in range(40)] + [(50, "abab"), (51, "abab"), (52, ""), (53, None)]
    frame, told = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "phrase_id long, phrase string")
    want = [(d, p, *at) for d, t in docs for p, s in phrases if s and t for at in _occurrences(t, s)]
    assert sorted(map(repr, (tuple(r) for r in scan.matches(frame, told).collect()))) == sorted(map(repr, want))
    pairs = [(d, p) for d, t in docs for p, s in phrases if s and t and s in t]
    assert sorted(map(repr, (tuple(r) for r in scan.holds(frame, told).collect()))) == sorted(map(repr, pairs))
    assert scan.matches(frame.limit(0), told).collect() == [] == scan.matches(frame, told.limit(0)).collect()


def test_quotes_meet_texts_without_a_nested_loop(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "xalpha")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "alpha"), (2, "pha bet"), (3, "alpha beta gamma")], "item_id int, quote string")
    for most in (evidence.BROADCAST_CHARS, -1):
        evidence.BROADCAST_CHARS, kept = most, evidence.BROADCAST_CHARS
        try:
            found = evidence.find_quotes(docs, quotes)
        finally:
            evidence.BROADCAST_CHARS = kept
        assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1)]
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_small_classifiers(spark):
    assert [one(spark, classify.extension(F.col("t")), t=t) for t in ("a.PDF", "dir.x/file", ".bashrc", "a.b.docx", "C:\\x\\y.png")] == [".pdf", "", "", ".docx", ".png"]
    assert [one(spark, classify.grade_band(F.col("g")), g=g) for g in (1, 2, 3, 4, 6)] == ["green", "cyan", "amber", "orange", "red"]
    assert one(spark, classify.basename(F.col("t")), t="C:\\a/b.txt") == "b.txt"
    assert [one(spark, classify.server_state(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((True, False), (False, True), (False, False))] == ["connected", "installed-not-running", "not-installed"]
    assert one(spark, catalogues.placeholders(F.col("t")), t="{{b}} and {{a}} {c}") == ["a", "b"]


def test_stream_digests_take_chunks_one_by_one(spark, sf_dir):
    rows = [(i % 5 and i % 3 or None, (i * 7919) % 10_007, None if i % 11 == 0 else f"é{i}") for i in range(30_000)]
    want = {}
    for stream, _, piece in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        want.setdefault(stream, []).append(piece or "")
    got = monitoring.stream_digests(spark.createDataFrame(rows, "stream long, seq long, piece string").repartition(5)).collect()
    assert {r.stream: (r.digest, r.chunks) for r in got} == {k: (hashlib.md5("".join(v).encode()).hexdigest(), len(v)) for k, v in want.items()}
    assert "collect_list" not in operations.stream_concat(spark, sf_dir)._jdf.queryExecution().toString()


def test_iso_texts_and_days_are_utc_in_any_session(spark):
    millis = [0, -1, 1_711_846_800_123, 1_711_850_399_999, 1_699_164_000_001, 1_699_167_600_500, 253_402_300_799_999, -62_135_596_800_000]
    want = [(datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=m)).isoformat(timespec="milliseconds") + "Z" for m in millis]
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame([(m,) for m in millis], "m long").select(F.timestamp_millis("m").alias("ts"))
            got = rows.select(dates.iso_ms(F.col("ts")).alias("iso"), dates.day_key(F.col("ts")).alias("day"), (dates.from_iso(dates.iso_ms(F.col("ts"))) == F.col("ts")).alias("back")).collect()
            assert [r.iso for r in got] == want and [r.day for r in got] == [w[:10] for w in want] and all(r.back for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
