"""Column expressions on text. (?U) makes \\w and \\s Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.lexicon import STOP_WORDS

# Fixed values.
EVENT_LABELS = {"EQ": "earthquake", "FL": "flood", "TC": "tropical cyclone", "VO": "volcano", "DR": "drought", "WF": "wildfire"}
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> Column:
    return F.expr(f"array({', '.join(quoted(v) for v in values)})")


def any_of(text: Column, words) -> Column:
    return F.exists(strings(words), lambda w: F.contains(text, w))


def count_of(text: Column, words) -> Column:
    return F.size(F.filter(strings(words), lambda w: F.contains(text, w)))


def best_of(text: Column, weights: dict[str, float]) -> Column:
    """Largest weight of the keys that text contains, else 0."""
    return F.greatest(*[F.when(F.contains(text, F.lit(k)), v).otherwise(0.0) for k, v in weights.items()])


def lookup(key: Column, table: dict, default) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def round_to(value: Column, digits: int) -> Column:
    """Half-even on the shortest decimal."""
    return F.bround(value, digits)


def normalize_title(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def fingerprint(title: Column, category: Column, geo: Column) -> Column:
    kind = F.coalesce(F.nullif(category, F.lit("")), F.lit("other"))
    return F.sha2(F.concat_ws("|", normalize_title(title), kind, normalize_title(geo)), 256)


def stable_id(print_: Column) -> Column:
    """Version 5 UUID of a fingerprint in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_URL)), F.encode(print_, "UTF-8")))
    variant = F.lower(F.substring(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), -1, 1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")


def title_similarity(a: Column, b: Column) -> Column:
    """0.3 x Jaccard of all words and 0.7 x Jaccard of content words."""
    wa, wb, stop = words(a), words(b), strings(STOP_WORDS)
    ca, cb = F.array_except(wa, stop), F.array_except(wb, stop)
    of_content = F.when((F.size(ca) > 0) & (F.size(cb) > 0), jaccard(ca, cb)).otherwise(jaccard(wa, wb))
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(0.3 * jaccard(wa, wb) + 0.7 * of_content)


def truncate(text: Column, n: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def normalize_category(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, "__|_", " "), r"\s+", " "))


def clean_summary(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[\.\.\.\]\s*$", ""), r"\s*\.\.\.\s*$", ""))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def preview(text: Column, n: int = 320) -> Column:
    """The readable text, or as many whole words as fit in n with an ellipsis, without trailing signs."""
    text = humanized(text)
    head = F.substring(text, 1, n - 1)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, r"[.,;:]+$", ""), F.lit("…")))


def alert_sentence(kind: Column, alert: Column, country: Column, severity: Column) -> Column:
    """A sentence on a disaster record: for an earthquake with its magnitude and depth, where the severity text tells them."""
    blank = F.lit("")
    code = F.upper(F.coalesce(F.nullif(kind, blank), F.lit("UNKNOWN")))
    label = F.lower(F.replace(code, F.lit("_"), F.lit(" ")))
    for key, name in EVENT_LABELS.items():
        label = F.when(code == key, name).otherwise(label)
    level, place, text = F.trim(F.coalesce(alert, blank)), F.trim(F.coalesce(country, blank)), F.coalesce(severity, blank)
    named, plain, depth = (F.regexp_extract(text, r, 1) for r in (r"(?i)magnitude\s+([\d.]+)M?", r"\b([\d.]+)\b", r"(?i)depth[:\s]*([\d.]+)\s*km?"))
    size = F.when(named != "", named).otherwise(plain)
    where = F.when(place != "", F.concat(F.lit(" in "), place)).otherwise(blank)
    quake = F.concat(F.when(size != "", F.concat(F.lit("A magnitude "), size, F.lit(" earthquake"))).otherwise("An earthquake"), F.lit(" was detected"), where, F.when(depth != "", F.concat(F.lit(" at a depth of "), depth, F.lit(" km"))).otherwise(blank))
    other = F.concat(F.lit("A "), label, F.lit(" event was reported"), where, F.when(text != "", F.concat(F.lit(" with severity "), F.trim(text))).otherwise(blank))
    raised = F.concat(F.upper(F.substring(level, 1, 1)), F.lower(F.substring(level, 2, 1 << 20)))
    return F.concat(F.when(code == "EQ", quake).otherwise(other), F.lit("."), F.when(level != "", F.concat(F.lit(" GDACS has issued a "), raised, F.lit(" alert."))).otherwise(blank))


def summary_field(text: Column, key: str) -> Column:
    """The value of the last "key: value" part of a summary whose parts end in full stops; null without one."""
    parts = F.transform(F.split(F.trim(text), r"\.\s+"), lambda p: F.regexp_replace(F.trim(p), r"\.+$", ""))
    found = F.filter(parts, lambda p: F.contains(p, F.lit(":")) & (F.lower(F.trim(F.substring_index(p, ":", 1))) == key))
    last = F.get(found, F.size(found) - 1)
    return F.when(F.size(found) > 0, F.trim(F.regexp_replace(last, r"(?s)^[^:]*:", "")))


def humanized(summary: Column) -> Column:
    """A summary without artifacts; one of the form "Event type: EQ. Alert level: ..." as a sentence."""
    cleaned = clean_summary(summary)
    text = F.when(cleaned != "", cleaned).otherwise(summary)
    kind, alert, country, severity = (summary_field(text, k) for k in ("event type", "alert level", "country", "severity"))
    told = F.contains(F.lower(text), F.lit("event type:")) & kind.isNotNull()
    return F.when(told, alert_sentence(kind, alert, country, severity)).otherwise(text)


def label_part(text: Column) -> Column:
    """Trimmed, unquoted, with single spaces; in title case if all is lower case (a letter after an apostrophe stays small)."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", ""), r"\s+", " ")
    return F.when((F.lower(t) == t) & (F.upper(t) != t), F.initcap(t)).otherwise(t)


def labels(text: Column) -> Column:
    """The labels of a text, which may be a list literal, each once (case aside), in order."""
    t = F.trim(text)
    is_list = F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]"))
    items = F.regexp_extract_all(F.substring(t, 2, 1 << 20), F.lit("'[^']*'|\"[^\"]*\"|[^,\\[\\]\\s'\"][^,\\[\\]]*"), 0)
    found = F.filter(F.transform(items, label_part), lambda x: x != "")
    several = F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)
    return F.when(is_list, several).otherwise(F.array_compact(F.array(F.nullif(label_part(t), F.lit("")))))


def geo_label(text: Column) -> Column:
    """Labels joined by commas; null where there is none."""
    return F.nullif(F.array_join(labels(text), ", "), F.lit(""))


def mpn_of(ref: Column) -> Column:
    return F.trim(F.regexp_replace(ref, "(?i)^MPN:", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_#]+"), 0)


EDGE = "\u0001"


def marked(text: Column) -> Column:
    """text with a mark at each word boundary, so that a term stands at boundaries where the text holds bounded(term)."""
    return F.regexp_replace(text, r"(?U)\b", EDGE)


def bounded(term: Column) -> Column:
    return F.concat(F.lit(EDGE), F.regexp_replace(term, r"(?U)(?!^)\b(?!$)", EDGE), F.lit(EDGE))


def word_runs(text: Column) -> Column:
    """Runs of letters, marks, digits and underscores of any script, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0)
