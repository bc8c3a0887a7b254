"""Queries over literal relations: errors, hardware, models, settings, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import classify
from paperloom.functions.patterns import ERRORS, LANGUAGES, PROFILES, SMALL_MODELS, SUGGESTED_MODELS, TRANSIENT
from paperloom.operators import settings
from paperloom.sources import files, models, probes

from .base import literal_rows, sql_value, table, values_sql

_ERRORS = [("model runner has unexpectedly STOPPED",), ("llama runner process: exit 2",), ("TypeError: fetch failed",), ("read ECONNRESET",), ("connect ECONNREFUSED 127.0.0.1",), ("request timed out",), ("ETIMEDOUT",), ("model 'x' not found",), ("unable to load model",), ("no space left on device",), ("cuda error: 2",), ("no room",), ("context length too long",), ("prompt exceeds context",), ("something else",), ("",)]


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, _ERRORS, "raw string").select("raw", classify.error_category(F.col("raw")).alias("category"))


_CASES = " ".join(f"WHEN regexp_matches(lower(raw), '{p}') THEN '{n}'" for n, p in ERRORS)
ERRORS_SQL = f"SELECT raw, CASE {_CASES} WHEN contains(lower(raw), 'context') AND (contains(lower(raw), 'too') OR contains(lower(raw), 'exceed')) THEN 'context' ELSE 'other' END AS category FROM {values_sql(_ERRORS, 'raw')}"

_THROWN = [("AbortError", "x"), ("Error", "The operation was aborted"), ("Error", "fetch failed"), ("Error", "UND_ERR_SOCKET"), ("Error", "no such model"), ("TypeError", "Network Error")]


def transient_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, message = F.col("name"), F.col("message")
    return literal_rows(spark, _THROWN, "name string, message string").select("name", "message", classify.is_abort(name, message).alias("abort"), classify.is_transient(message).alias("transient"))


TRANSIENT_SQL = f"SELECT name, message, name = 'AbortError' OR contains(message, 'abort') AS abort, regexp_matches(lower(message), '{TRANSIENT}') AS transient FROM {values_sql(_THROWN, 'name, message')}"

_HOSTS = [(1, 4.0, None, None), (2, 8.0, "Intel Iris", 512), (3, 15.9, "NVIDIA GeForce RTX 3060", 12288), (4, 16.0, None, None), (5, 32.0, "AMD Radeon", 8192), (6, 7.5, "Quadro", 24576), (7, 64.0, "Matrox", 0), (8, 8.0, "Arc A380", 6144)]
_HOST = "host_id int, ram_gb double, gpu_name string, vram_mb int"


def hardware_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = classify.hardware_profile(F.col("ram_gb"), F.col("vram_mb"))
    tab = F.when(F.coalesce(F.col("vram_mb") / 1024 >= 6, F.lit(False)), "gpu").otherwise("cpu")
    return literal_rows(spark, _HOSTS, _HOST).select("host_id", F.when(F.col("gpu_name").isNotNull(), classify.gpu_vendor(F.col("gpu_name"))).alias("vendor"), profile.alias("profile"), classify.recommended_model(profile).alias("model"), tab.alias("tab"))


_V = "coalesce(vram_mb / 1024.0, 0)"
HARDWARE_SQL = f"""
WITH h AS (SELECT *, CASE WHEN ram_gb >= 64 OR {_V} >= 24 THEN 'power' WHEN ram_gb >= 32 OR {_V} >= 12 THEN 'strong' WHEN ram_gb >= 16 OR {_V} >= 6 THEN 'medium' WHEN ram_gb >= 8 THEN 'light' ELSE 'minimal' END AS profile, lower(gpu_name) AS g FROM {values_sql(_HOSTS, "host_id, ram_gb, gpu_name, vram_mb")})
SELECT host_id, CASE WHEN g IS NULL THEN NULL WHEN regexp_matches(g, 'nvidia|geforce|rtx|gtx|quadro') THEN 'nvidia' WHEN regexp_matches(g, 'amd|radeon|firepro') THEN 'amd' WHEN regexp_matches(g, 'intel|arc') THEN 'intel' ELSE 'unknown' END AS vendor,
       profile, CASE profile {" ".join(f"WHEN '{p}' THEN '{m}'" for p, _, _, m in PROFILES)} END AS model, CASE WHEN {_V} >= 6 THEN 'gpu' ELSE 'cpu' END AS tab FROM h"""

_LOADED = [(1, "a", 1000, 0), (2, "b", 1000, 950), (3, "c", 1000, 949), (4, "d", 8_000_000_000, 8_000_000_000), (5, "e", 4_000_000_000, 1_000_000_000), (6, "f", 4_000_000_000, 3_990_000_000)]


def model_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, _LOADED, "id int, name string, size long, in_vram long")
    share = classify.percent(F.col("in_vram") / (1024 * 1024), F.lit(6144))
    return rows.select("id", "name", classify.placement(F.col("size"), F.col("in_vram")).alias("runs_on"), share.alias("vram_percent"), classify.band(share).alias("band"))


PLACEMENT_SQL = f"""
WITH m AS (SELECT *, least(greatest(floor(in_vram / 1048576.0::DOUBLE / 6144 * 100 + 0.5), 0), 100)::BIGINT AS vram_percent FROM {values_sql(_LOADED, "id, name, size, in_vram")})
SELECT id, name, CASE WHEN in_vram = 0 THEN 'cpu' WHEN in_vram >= size * 0.95::DOUBLE THEN 'gpu' ELSE 'hybrid' END AS runs_on, vram_percent, CASE WHEN vram_percent >= 95 THEN 'red' WHEN vram_percent >= 80 THEN 'amber' ELSE 'cyan' END AS band FROM m"""

_INSTALLED = [("qwen2.5:3b", 1_900_000_000, "2024-05-01"), ("other", 5, "")]


def suggested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suggested models beside what a server says it has; a server that fails has none."""

    def broken() -> list[tuple]:
        raise ConnectionError("no server")

    has = models.installed(spark, lambda: _INSTALLED).select("name", F.lit(True).alias("installed"))
    also = models.loaded(spark, broken).select("name", F.lit(True).alias("loaded"))
    said = models.suggested(spark).join(has, "name", "left").join(also, "name", "left")
    return said.select("name", "display_name", "size", "min_ram_gb", "min_vram_gb", "runtime", "budget", F.coalesce("installed", F.lit(False)).alias("installed"), F.coalesce("loaded", F.lit(False)).alias("loaded"))


_MODELS = values_sql(list(SUGGESTED_MODELS), "name, display_name, size, min_ram_gb, min_vram_gb, runtime, budget")
SUGGESTED_SQL = f"SELECT name, display_name, size, min_ram_gb, min_vram_gb, runtime, budget, name = 'qwen2.5:3b' AS installed, false AS loaded FROM {_MODELS}"


def model_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    installed = models.installed(spark, lambda: _INSTALLED).select("name", F.lit(True).alias("installed"))
    able = classify.can_run(F.col("ram_gb"), F.col("vram_mb"), F.col("min_ram_gb"), F.col("min_vram_gb"))
    # Two literal relations of a few rows each.
    both = literal_rows(spark, _HOSTS, _HOST).crossJoin(models.suggested(spark).join(installed, "name", "left"))
    return both.select("host_id", "name", able.alias("can_run"), F.coalesce("installed", F.lit(False)).alias("installed"))


RUNNABLE_SQL = f"""SELECT host_id, name, coalesce(ram_gb >= min_ram_gb, true) AND (min_vram_gb IS NULL OR coalesce(vram_mb / 1024.0 >= min_vram_gb, false)) AS can_run, name = 'qwen2.5:3b' AS installed
FROM (FROM {values_sql(_HOSTS, "host_id, ram_gb, gpu_name, vram_mb")}), (FROM {_MODELS})"""

_PROBES = [
    (1, "RTX 4090, 24564", "", "", []), (2, "", "device,VRAM Total\ncard0,17163091968", "", []), (3, " ", "device", '{"Name": "Arc A770", "VramBytes": 17179869184}', []), (4, "", "", "broken", [("Intel UHD", 1_073_741_824), ("Radeon RX", 8_589_934_592), ("RTX", 8_589_934_592)]),
    (5, "", "", "", []),
]
_PROBE = "host_id int, smi string, rocm string, registry string, adapters array<struct<name:string,vram_bytes:bigint>>"


def gpu_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probes print, the first that found a card winning; of several adapters, the one with most memory, of equal ones the first."""
    card = probes.first_gpu(probes.from_csv_probe(F.col("smi")), probes.from_rocm_probe(F.col("rocm")), probes.from_json_probe(F.col("registry")), probes.biggest(F.col("adapters")))
    return literal_rows(spark, _PROBES, _PROBE).select("host_id", card.alias("gpu")).select("host_id", "gpu.name", "gpu.vram_mb", "gpu.vendor")


_CARDS = [(1, "RTX 4090", 24564, "nvidia"), (2, "AMD GPU", 0, "amd"), (3, "Arc A770", 16384, "intel"), (4, "Radeon RX", 8192, "amd"), (5, None, None, None)]


def settings_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored record, whatever it says, as the defaults."""
    rows = literal_rows(spark, _SETTINGS, "id int, raw string").select("id", settings.defaults().alias("s"))
    return rows.select("id", "s.language", "s.theme", F.array_join("s.ocrLanguages", ",").alias("ocr"), F.col("s.ollamaUrl").alias("url"), F.col("s.selectedModel").alias("model"))


_EXTRACTION = [("file is ENCRYPTED",), ("BadZipFile: File is not a zip file",), ("image has too many pixels",), ("Invalid PDF structure",), ("no extractor for .pdf",), ("what",), (None,)]
_MEANINGS = [("file is ENCRYPTED", "encrypted"), ("BadZipFile: File is not a zip file", "bad_archive"), ("image has too many pixels", "too_many_pixels"), ("Invalid PDF structure", "corrupt"), ("no extractor for .pdf", "no_extractor"), ("what", "extraction_failed"), (None, "extraction_failed")]


def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, _EXTRACTION, "message string").select("message", files.extraction_error(F.col("message")).alias("reason"))


def server_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a server per event: whether it answered, else whether it is installed."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", classify.server_state(F.col("event_type") == "view", F.col("event_id") % 2 == 0).alias("state"))


STATES_SQL = "SELECT event_id, CASE WHEN event_type = 'view' THEN 'connected' WHEN event_id % 2 = 0 THEN 'installed-not-running' ELSE 'not-installed' END AS state FROM events"


def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the events' sizes: which are small enough to read, and their size once fitted."""
    width, height = F.col("event_id") % 997 * 31 + 1, F.col("event_id") % 389 * 47 + 1
    rows = table(spark, sf_dir, "events").select("event_id", width.alias("w"), height.alias("h"))
    fitted = files.fitted_size(F.col("w"), F.col("h"))
    return rows.select("event_id", files.readable_pixels(F.col("w"), F.col("h")).alias("readable"), fitted.alias("f")).select("event_id", "readable", "f.width", "f.height")


_SCALE = "least(1.0::DOUBLE, 4000::DOUBLE / greatest(w, h))"
IMAGE_SQL = f"""SELECT event_id, w * h <= 100000000 AS readable, greatest(1, floor(w * {_SCALE} + 0.5))::BIGINT AS width, greatest(1, floor(h * {_SCALE} + 0.5))::BIGINT AS height
FROM (SELECT event_id, event_id % 997 * 31 + 1 AS w, event_id % 389 * 47 + 1 AS h FROM events)"""


def priority_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "view", "medium")
    return table(spark, sf_dir, "events").select("event_id", classify.priority_key(said).alias("priority"))


PRIORITY_SQL = "SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'medium' ELSE 'low' END AS priority FROM events"

_REQUESTS = [(1, "mem", "set", True, ["m1"]), (2, "", "set", False, []), (3, None, "", True, ["m1", "m2"]), (4, "", None, False, ["m1"]), (5, "", "", True, [])]


def model_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.coalesce(F.nullif("cached", F.lit("")), F.nullif("setting", F.lit("")))
    first = F.get("models", 0)
    kind = F.when(chosen.isNotNull(), "ok").when(~F.col("connected"), "no-server").when(first.isNull(), "no-models").otherwise("ok")
    model = F.coalesce(chosen, F.when(F.col("connected"), first))
    return literal_rows(spark, _REQUESTS, "id int, cached string, setting string, connected boolean, models array<string>").select("id", kind.alias("kind"), model.alias("model"), F.when(model == "m1", "").otherwise(model).alias("after_delete"), F.coalesce(classify.is_small_model(model), F.lit(False)).alias("small"))


_R = ", ".join(f"({i}, {sql_value(c)}, {sql_value(s)}, {sql_value(on)}, {m}::VARCHAR[])" for i, c, s, on, m in _REQUESTS)
RESOLVE_SQL = f"""
WITH r AS (SELECT *, coalesce(nullif(cached, ''), nullif(setting, '')) AS chosen FROM (VALUES {_R}) AS v(id, cached, setting, connected, models)),
k AS (SELECT id, CASE WHEN chosen IS NOT NULL THEN 'ok' WHEN NOT connected THEN 'no-server' WHEN len(models) = 0 THEN 'no-models' ELSE 'ok' END AS kind, coalesce(chosen, CASE WHEN connected THEN models[1] END) AS model FROM r)
SELECT *, CASE WHEN model = 'm1' THEN '' ELSE model END AS after_delete, coalesce(model IN ({", ".join(map(sql_value, SMALL_MODELS))}), false) AS small FROM k"""


def primary_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, _LOADED, "id int, name string, size long, in_vram long")
    # One host's loaded models; the first of equal sizes wins.
    return rows.orderBy(F.desc("size"), "id").limit(1).select("id", "name")


_SETTINGS = [
    (1, None), (2, "[]"), (3, "{}"), (4, '{"language": "fr", "theme": "light", "ocrLanguages": ["x"], "ocrQuality": "best", "firstLaunchDone": true, "autoUpdateCheck": false, "ollamaUrl": "u", "selectedModel": "m"}'),
    (5, '{"language": "xx", "theme": 5, "ocrLanguages": ["a", 1], "firstLaunchDone": "yes", "selectedModel": "keep"}'), (6, "not json"), (7, '"text"'), (8, '{"ocrLanguages": [], "theme": "system"}'),
]
#: What each record should become, by hand: language, theme, OCR languages, quality, launched, updates, url, model, repaired.
_EXPECTED = {
    1: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "", False), 2: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "", False),
    3: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "", True), 4: ("fr", "light", "x", "best", True, False, "u", "m", False),
    5: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "keep", True), 6: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "", False),
    7: ("de", "dark", "deu,eng", "balanced", False, True, "http://localhost:11434", "", False), 8: ("de", "system", "", "balanced", False, True, "http://localhost:11434", "", True),
}


def settings_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, _SETTINGS, "id int, raw string").select("id", settings.sanitised(F.col("raw")).alias("s"))
    return rows.select("id", "s.language", "s.theme", F.array_join("s.ocrLanguages", ",").alias("ocr"), F.col("s.ocrQuality").alias("quality"), F.col("s.firstLaunchDone").alias("launched"), F.col("s.autoUpdateCheck").alias("updates"), F.col("s.ollamaUrl").alias("url"), F.col("s.selectedModel").alias("model"), "s.repaired")


SANITIZE_SQL = f"SELECT * FROM {values_sql([(i, *v) for i, v in _EXPECTED.items()], 'id, language, theme, ocr, quality, launched, updates, url, model, repaired')}"

_MERGES = [(1, "a=1,b=2", "b=3"), (2, "a=1", "c=9,d=8"), (3, "a=1,b=2", "")]


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_map = lambda c: F.map_filter(F.str_to_map(c, F.lit(","), F.lit("=")), lambda k, _: k != "")
    rows = literal_rows(spark, _MERGES, "id int, current string, partial string")
    return rows.select("id", F.explode(settings.merged(as_map(F.col("current")), as_map(F.col("partial")))).alias("key", "value"))


MERGE_SQL = "SELECT * FROM (VALUES (1, 'a', '1'), (1, 'b', '3'), (2, 'a', '1'), (2, 'c', '9'), (2, 'd', '8'), (3, 'a', '1'), (3, 'b', '2')) AS v(id, key, value)"

_CODES = [("de",), ("ar",), ("zh",), ("xx",), ("fr",)]


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    return literal_rows(spark, _CODES, "code string").select("code", classify.english_name(code).alias("english"), classify.native_name(code).alias("native"), classify.is_rtl(code).alias("rtl"))


LOOKUP_SQL = f"""SELECT code, coalesce(english, 'English') AS english, coalesce(native, code) AS native, coalesce(dir = 'rtl', false) AS rtl
FROM {values_sql(_CODES, "code")} LEFT JOIN (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(sql_value, x)) + ")" for x in LANGUAGES)}) AS l(code, native, english, dir)) USING (code)"""

_LABELS = [(1, 1, "dark", True, "/docs/a.pdf"), (2, 3, "system", True, "/other/b"), (3, 6, "system", False, "/docs/c")]


def display_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, _LABELS, "id int, grade int, theme string, dark boolean, path string")
    return rows.select("id", classify.grade_band(F.col("grade")).alias("band"), classify.effective_theme(F.col("theme"), F.col("dark")).alias("theme"), classify.is_managed(F.col("path"), F.lit("/docs/")).alias("managed"), classify.basename(F.col("path")).alias("name"))


_SHOWN = [(1, "green", "dark", True, "a.pdf"), (2, "amber", "dark", False, "b"), (3, "red", "light", True, "c")]


QUERIES = {
    "error_classify": (error_classify, ERRORS_SQL),
    "transient_error": (transient_error, TRANSIENT_SQL),
    "hardware_profile": (hardware_profile, HARDWARE_SQL),
    "model_placement": (model_placement, PLACEMENT_SQL),
    "model_runnable": (model_runnable, RUNNABLE_SQL),
    "model_resolve": (model_resolve, RESOLVE_SQL),
    "primary_model": (primary_model, f"SELECT id, name FROM {values_sql(_LOADED, 'id, name, size, in_vram')} ORDER BY size DESC, id LIMIT 1"),
    "suggested_models": (suggested_models, SUGGESTED_SQL),
    "gpu_probes": (gpu_probes, f"SELECT * FROM {values_sql(_CARDS, 'host_id, name, vram_mb, vendor')}"),
    "settings_reset": (settings_reset, f"SELECT id, 'de' AS language, 'dark' AS theme, 'deu,eng' AS ocr, 'http://localhost:11434' AS url, '' AS model FROM {values_sql(_SETTINGS, 'id, raw')}"),
    "extraction_errors": (extraction_errors, f"SELECT * FROM {values_sql(_MEANINGS, 'message, reason')}"),
    "server_states": (server_states, STATES_SQL),
    "image_fit": (image_fit, IMAGE_SQL),
    "priority_keys": (priority_keys, PRIORITY_SQL),
    "settings_sanitize": (settings_sanitize, SANITIZE_SQL),
    "settings_merge": (settings_merge, MERGE_SQL),
    "display_bands": (display_bands, f"SELECT * FROM {values_sql(_SHOWN, 'id, band, theme, managed, name')}"),
    "language_lookup": (language_lookup, LOOKUP_SQL),
}
