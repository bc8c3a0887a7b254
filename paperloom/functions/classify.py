"""Column functions that classify: errors, hardware, models, files, ids, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ERRORS, GPU_SHARE, IMAGE_EXTENSIONS, LANGUAGES, LEGACY_EXTENSIONS, MIME_TYPES, MODE_LABELS, MODES, OTHER_MIME, PROFILES, SMALL_MODELS, TRANSIENT, VENDORS
from .text import js_length


def lookup(key: Column, values: dict[str, str], default: Column | str | None = None) -> Column:
    """A literal map's value, else the default."""
    entries = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def error_category(raw: Column) -> Column:
    """The first category whose pattern occurs; 'other' stands for passing the message on."""
    said = F.lower(raw)
    out = F.lit("other")
    context = F.contains(said, F.lit("context")) & (F.contains(said, F.lit("too")) | F.contains(said, F.lit("exceed")))
    out = F.when(context, "context").otherwise(out)
    for name, pattern in reversed(ERRORS):
        out = F.when(said.rlike(pattern), name).otherwise(out)
    return out


def is_abort(name: Column, message: Column) -> Column:
    return (name == "AbortError") | F.contains(message, F.lit("abort"))


def is_transient(message: Column) -> Column:
    return F.lower(message).rlike(TRANSIENT)


def gpu_vendor(name: Column) -> Column:
    said, out = F.lower(name), F.lit("unknown")
    for vendor, marks in reversed(VENDORS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(said, F.lit(mark))
        out = F.when(hit, vendor).otherwise(out)
    return out


def hardware_profile(ram_gb: Column, vram_mb: Column) -> Column:
    vram = F.coalesce(vram_mb / 1024, F.lit(0.0))
    out = F.lit(PROFILES[-1][0])
    for name, ram, video, _ in reversed(PROFILES[:-1]):
        out = F.when((ram_gb >= ram) | (vram >= video if video is not None else F.lit(False)), name).otherwise(out)
    return out


def recommended_model(profile: Column) -> Column:
    return lookup(profile, {name: model for name, _, _, model in PROFILES})


def placement(size: Column, in_vram: Column) -> Column:
    return F.when(in_vram == 0, "cpu").when(in_vram >= size * GPU_SHARE, "gpu").otherwise("hybrid")


def round_half_up(x: Column) -> Column:
    """Rounds as scripts do: halves go up, also below zero."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage inside 0 to 100; 0 for a whole that isn't positive."""
    return F.when(whole > 0, F.least(F.greatest(round_half_up(part / whole * 100), F.lit(0)), F.lit(100))).otherwise(0).cast("long")


def can_run(ram_gb: Column, vram_mb: Column, min_ram: Column, min_vram: Column) -> Column:
    """Unknown RAM is enough; unknown VRAM is not, where VRAM is asked for."""
    return F.coalesce(ram_gb >= min_ram, F.lit(True)) & (min_vram.isNull() | F.coalesce(vram_mb / 1024 >= min_vram, F.lit(False)))


def is_small_model(model: Column) -> Column:
    return model.isin(*SMALL_MODELS)


def extension(filename: Column) -> Column:
    """Lower-cased, with the dot; empty without one, or if the name starts with its only dot."""
    base = F.regexp_extract(filename, r"([^/\\]*)\z", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*(\.[^.]*)\z|(?!)", 1))


def mime_type(ext: Column) -> Column:
    return lookup(F.lower(ext), MIME_TYPES, OTHER_MIME)


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(*IMAGE_EXTENSIONS)


def file_reject(ext: Column, size: Column, regular: Column, most: int) -> Column:
    """Why a file isn't imported, null if it is: extension first, then whether it is there, its size."""
    return (
        F.when(ext.isin(*LEGACY_EXTENSIONS), "legacy_format")
        .when(~ext.isin(*MIME_TYPES), "unsupported_type")
        .when(~F.coalesce(regular, F.lit(False)), "not_found")
        .when(size > most, "too_large")
        .when(size == 0, "empty_file")
    )


def is_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"), F.lit(False))


def is_mode(value: Column) -> Column:
    return F.coalesce(value.isin(*MODES), F.lit(False))


def mode_label(mode: Column) -> Column:
    return lookup(mode, MODE_LABELS, MODE_LABELS["freeform"])


def within(text: Column, most: int) -> Column:
    return js_length(text) <= most


def english_name(code: Column) -> Column:
    return lookup(code, {c: name for c, _, name, _ in LANGUAGES}, "English")


def native_name(code: Column) -> Column:
    return lookup(code, {c: name for c, name, _, _ in LANGUAGES}, code)


def is_rtl(code: Column) -> Column:
    return F.coalesce(code.isin(*[c for c, _, _, way in LANGUAGES if way == "rtl"]), F.lit(False))


def file_size(size: Column) -> Column:
    """MB with one place above 1 MiB, else whole KB."""
    return F.when(size > 1024 * 1024, F.format_string("%.1f MB", size / (1024 * 1024))).otherwise(F.format_string("%.0f KB", size / 1024))


def band(share: Column) -> Column:
    """Colour of a utilisation in per cent."""
    return F.when(share >= 95, "red").when(share >= 80, "amber").otherwise("cyan")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def icon(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), "image").when(F.contains(mime, F.lit("spreadsheet")) | F.contains(mime, F.lit("excel")), "table").otherwise("text")


def grade_band(grade: Column) -> Column:
    out = F.lit("red")
    for most, colour in ((4, "orange"), (3, "amber"), (2, "cyan"), (1, "green")):
        out = F.when(grade <= most, colour).otherwise(out)
    return out


def server_state(connected: Column, installed: Column) -> Column:
    return F.when(connected, "connected").when(installed, "installed-not-running").otherwise("not-installed")


def export_name(filename: Column, mode: Column, day: Column) -> Column:
    """name - label - day.pdf, the name without extension and with runs of unsafe characters as one underscore."""
    safe = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+\z", ""), r"[^\wäöüÄÖÜß .-]+", "_")
    return F.concat(safe, F.lit(" - "), mode_label(mode), F.lit(" - "), day, F.lit(".pdf"))


def is_managed(path: Column, folder: Column) -> Column:
    """Whether a file lies in the managed folder, and so may be removed."""
    return path.startswith(folder)


def effective_theme(mode: Column, system_dark: Column) -> Column:
    """'system' follows the operating system."""
    return F.when(mode != "system", mode).otherwise(F.when(system_dark, "dark").otherwise("light"))


def priority_key(priority: Column) -> Column:
    """The priority to show; an item without one counts as low."""
    return F.coalesce(priority, F.lit("low"))
