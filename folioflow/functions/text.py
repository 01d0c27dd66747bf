"""Text Column functions: paths, formats, log lines, messages, templates, locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import messages as M


def truncate_middle(text: Column, max_len: int = 60) -> Column:
    head, tail = max_len // 2, (max_len - 1) // 2
    cut = F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= max_len, text).otherwise(cut)


def compact_error(raw: Column, fallback: str = "Could not determine the cause of the error.") -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return (
        F.when(text == "", F.lit(fallback))
        .when(F.length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("...")))
        .otherwise(text)
    )


def path_basename(path: Column) -> Column:
    text = F.trim(F.coalesce(path, F.lit("")))
    parts = F.filter(F.split(F.translate(text, "\\", "/"), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(text)


def path_suffix(path: Column) -> Column:
    """Lower-case suffix without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1))


def normalize_formats(formats: Column) -> Column:
    """Trim, lower, jpeg as jpg, known tokens only, first occurrence; [png, pdf] when nothing is left."""

    def token(raw):
        low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
        return F.when(low == "jpeg", F.lit("jpg")).otherwise(low)

    kept = F.array_distinct(F.filter(F.transform(formats, token), lambda t: t.isin("png", "jpg", "pdf")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit("png"), F.lit("pdf")))


def extract_resolution(line: Column) -> Column:
    """Struct(width, height) named in one line, null when there is none.

    'low resolution WxH' is preferred over 'resolved to WxH' within the line.
    """
    def pick(pattern):
        hit = line.rlike(pattern)
        return F.when(
            hit,
            F.struct(
                F.regexp_extract(line, pattern, 1).cast("bigint").alias("width"),
                F.regexp_extract(line, pattern, 2).cast("bigint").alias("height"),
            ),
        )

    return F.coalesce(pick(r"(?i)low resolution\s+(\d+)x(\d+)"), pick(r"(?i)resolved to\s+(\d+)x(\d+)"))


def _pairs(table) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in table])


def translate_messages(message: Column, locale: str = "en") -> Column:
    """Apply the ordered replacement list to each line; every entry replaces its first hit only."""
    table = _pairs(M.REPLACEMENTS[locale])

    def replace_first(text, pair):
        at = F.instr(text, pair["old"])
        return F.when(at > 0, F.overlay(text, pair["new"], at, F.length(pair["old"]))).otherwise(text)

    lines = F.transform(F.split(message, "\n"), lambda line: F.aggregate(table, line, replace_first))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def _lookup(table: dict, key: Column) -> Column:
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), F.coalesce(key, F.lit("")))


def step_name(step: Column, locale: str = "en") -> Column:
    given = F.when(step != "", step)
    return F.coalesce(_lookup(M.STEP_NAMES[locale], step), given, F.lit(M.IN_PROGRESS[locale]))


def status_text(step: Column, message: Column, locale: str = "en") -> Column:
    """'<step>: <message>', or the step's guide text when the message is technical."""
    text = translate_messages(message, locale)
    plain = (text != "") & ~text.rlike(M.TECHNICAL)
    guide = F.coalesce(_lookup(M.STEP_GUIDES[locale], F.lower(F.coalesce(step, F.lit("")))), F.lit(""))
    detail = F.when(plain, text).otherwise(guide)
    name = step_name(step, locale)
    return F.when(detail != "", F.concat(name, F.lit(": "), detail)).otherwise(name)


def classify_error(detail: Column, locale: str = "en") -> Column:
    """Friendly text of an error: by prefix, then exact match, else the text itself."""
    out = F.when(F.coalesce(detail, F.lit("")) == "", F.lit(M.EMPTY_ERROR[locale]))
    for prefix, with_reason, without in M.PREFIX_ERRORS[locale]:
        reason = F.trim(F.substring(detail, len(prefix) + 1, 1 << 30))
        text = F.when(reason == "", F.lit(without))
        for needles, special in M.PREFIX_SPECIAL[locale].get(prefix, ()):
            hit = F.lit(False)
            for needle in needles:
                hit = hit | F.contains(F.lower(reason), F.lit(needle))
            text = text.when(hit, F.lit(special))
        before, after = with_reason.split("{reason}") if "{reason}" in with_reason else (with_reason, None)
        full = F.lit(before) if after is None else F.concat(F.lit(before), reason, F.lit(after))
        out = out.when(F.startswith(detail, F.lit(prefix)), text.otherwise(full))
    return out.otherwise(F.coalesce(_lookup(M.EXACT_ERRORS[locale], detail), detail))


# Arrays inside arrays that an error's text may hold; deeper ones are shown as JSON.
ERROR_DEPTH = 3


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _part(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _shown(value: Column, depth: int = ERROR_DEPTH) -> Column:
    """A JSON value as text: null is empty, arrays are joined by commas, objects have no text of their own."""
    kind = _kind(value)
    if depth:
        inner = F.array_join(F.transform(_part(value, "$", "array<variant>"), lambda e: _shown(e, depth - 1)), ",")
    else:
        inner = F.to_json(value)
    return (
        F.when(kind == "VOID", F.lit(""))
        .when(F.startswith(kind, F.lit("ARRAY")), inner)
        .when(F.startswith(kind, F.lit("OBJECT")), F.lit("[object Object]"))
        .otherwise(F.coalesce(_part(value, "$", "string"), F.lit("")))
    )


def _empty(value: Column) -> Column:
    """Values that count as nothing: null, false, zero and the empty text."""
    kind = _kind(value)
    zero = ~kind.isin("STRING", "BOOLEAN") & (_part(value, "$", "double") == 0)
    return (kind == "VOID") | ((kind == "BOOLEAN") & (_part(value, "$", "boolean") == F.lit(False))) | F.coalesce(zero, F.lit(False)) | (
        (kind == "STRING") & (_part(value, "$", "string") == "")
    )


def _text_at(value: Column, path: str) -> Column:
    """The text at a path, null when something else or nothing is there."""
    there = _part(value, path, "variant")
    return F.when(_kind(there) == "STRING", _part(there, "$", "string"))


def structured_error(detail: Column, locale: str = "en") -> Column:
    """Friendly text of an error whose detail is JSON of any shape, or plain text.

    A list is joined from its texts and ``msg`` fields, unless one of its places names the
    region field; an object gives its ``detail`` or ``message`` when that is a text; a text goes through
    ``classify_error``. Text that is not JSON is taken as it is; nothing at all is the general error.
    """
    value = F.try_parse_json(detail)
    kind = _kind(value)
    items = _part(value, "$", "array<variant>")

    def place(item):
        loc = _part(item, "$.loc", "variant")
        tokens = F.array_join(F.transform(_part(loc, "$", "array<variant>"), lambda t: _shown(t)), ".")
        return F.when(F.startswith(_kind(item), F.lit("OBJECT")) & F.startswith(_kind(loc), F.lit("ARRAY")), tokens).otherwise(F.lit(""))

    def said(item):
        message = F.when(F.startswith(_kind(item), F.lit("OBJECT")), _text_at(item, "$.msg"))
        return F.coalesce(message, F.when(_empty(item), F.lit("")).otherwise(_shown(item)))

    general = F.lit(M.EMPTY_ERROR[locale])
    places = F.array_join(F.transform(items, place), " ")
    joined = F.array_join(F.filter(F.transform(items, said), lambda t: t != ""), " / ")
    listed = F.when(F.contains(places, F.lit(M.ROI_FIELD)), F.lit(M.ROI_REQUIRED[locale])).otherwise(F.coalesce(F.nullif(joined, F.lit("")), general))
    inner = F.coalesce(_text_at(value, "$.detail"), _text_at(value, "$.message"), F.lit(""))
    is_list, is_object = F.startswith(kind, F.lit("ARRAY")), F.startswith(kind, F.lit("OBJECT"))
    text = F.when(value.isNull(), detail).when(is_object, inner).when(_empty(value), F.lit("")).otherwise(_part(value, "$", "string"))
    return F.when(value.isNotNull() & is_list, listed).otherwise(classify_error(text, locale))


def recovery_hint(message: Column) -> Column:
    """detect, ffmpeg or youtube: which advice follows a failed job; null for none."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("detect")), F.lit("detect"))
        .when(F.contains(low, F.lit("ffmpeg")), F.lit("ffmpeg"))
        .when(F.contains(low, F.lit("youtube")), F.lit("youtube"))
    )


def render_template(template: Column, params: Column) -> Column:
    """Fill {{key}} from a MAP<STRING, STRING>; keys are trimmed, missing ones become ''."""
    pieces = F.split(F.coalesce(template, F.lit("")), r"\{\{")

    def fill(done, piece):
        end = F.instr(piece, F.lit("}}"))
        key = F.trim(F.substring_index(piece, "}}", 1))
        rest = F.substring(piece, end + 2, F.length(piece))
        value = F.coalesce(F.try_element_at(params, key), F.lit(""))
        return F.when(end > 0, F.concat(done, value, rest)).otherwise(F.concat(done, F.lit("{{"), piece))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), pieces[0], fill)


def localized(key: Column, locale_text: Column, fallback_text: Column, params: Column) -> Column:
    """Template of the locale, else of the fallback locale, else the key itself; then filled."""
    return render_template(F.coalesce(locale_text, fallback_text, key), params)


def normalize_locale(stored: Column, system: Column) -> Column:
    """'ko' for anything starting with ko, else 'en'; a stored value beats the system's."""
    value = F.lower(F.trim(F.coalesce(F.nullif(stored, F.lit("")), F.nullif(system, F.lit("")), F.lit("en"))))
    return F.when(F.startswith(value, F.lit("ko")), F.lit("ko")).otherwise(F.lit("en"))
