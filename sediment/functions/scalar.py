"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def generate_id(prefix: str, content: Column) -> Column:
    """prefix_ and the first 12 hex digits of the content's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(content, 256), 1, 12))


def content_hash16(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def machine_id(host: Column) -> Column:
    return F.concat(host, F.lit("-"), F.substring(F.md5(host), 1, 8))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def token_estimate(words: Column) -> Column:
    return (words * F.lit(1.3)).cast("int")


def norm_basic(value: Column) -> Column:
    """Lower case, no outer blanks, and a leading the, a or an taken off, once each and in that order."""
    out = F.trim(F.lower(value))
    for article in ("the ", "a ", "an "):
        out = F.regexp_replace(out, f"^{article}", "")
    return out


def norm_canonical(value: Column, kind: Column) -> Column:
    """norm_basic; a person's first name in its canonical form; then only a-z, 0-9 and blanks."""
    alias = literal_map({a: c for c, names in V.ALIASES.items() for a in names})
    basic = norm_basic(value)
    first = F.regexp_extract(basic, r"^\S+", 0)
    person = F.when((kind == "PERSON") & alias[first].isNotNull(), F.concat(alias[first], F.substring(basic, F.length(first) + 1, F.length(basic)))).otherwise(basic)
    return F.regexp_replace(person, r"[^a-z0-9\s]", "")


def norm_org(value: Column) -> Column:
    """Lower case without legal suffixes, each tested once in order, and without full stops and commas."""
    out = F.trim(F.lower(value))
    for suffix in (" inc", " inc.", " llc", " ltd", " corp", " corporation"):
        out = F.trim(F.regexp_replace(out, re.escape(suffix).replace("\\ ", " ") + "$", ""))
    return F.translate(out, ".,", "")


def canonical_key(kind: Column, normalized: Column) -> Column:
    return F.concat_ws(":", kind, normalized)


def label_of(label: Column) -> Column:
    return F.coalesce(literal_map(V.LABELS)[label], label)


def context(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """The text from around characters before start (0-based) to around after end."""
    at = F.greatest(start - around, F.lit(0))
    return F.substring(text, at + 1, end + around - at)


def machine_of(path: Column, fallback: Column | None = None) -> Column:
    """The text between the leading [ and the first ], else the fallback, else local."""
    tag = F.regexp_extract(path, r"^\[([^\]]*)\]", 1)
    return F.coalesce(F.when(tag != "", tag), fallback if fallback is not None else F.lit(None), F.lit("local"))


def count_score(n: Column) -> Column:
    return F.least(F.lit(1.0), n / F.lit(10.0))


def strength(count: Column, files: Column) -> Column:
    return F.lit(0.6) * F.least(F.lit(1.0), count / F.lit(10.0)) + F.lit(0.4) * F.least(F.lit(1.0), files / F.lit(5.0))


def expertise_confidence(hits: Column, files: Column, terms: Column, vocabulary: Column) -> Column:
    return F.lit(0.4) * F.least(F.lit(1.0), F.log10(hits + F.lit(1)) / 2) + F.lit(0.3) * F.least(F.lit(1.0), files / F.lit(10.0)) + F.lit(0.3) * (terms / vocabulary)


def pmi(both: Column, one: Column, other: Column, files: Column) -> Column:
    """Pointwise mutual information in nats, clipped to 10 either way."""
    e = F.lit(1e-10)
    return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.log((both / files + e) / ((one / files) * (other / files) + e))))


def pmi_confidence(value: Column, both: Column) -> Column:
    return F.least(F.lit(1.0), value / 5 * both / 10)


def similarity(distance: Column) -> Column:
    return F.round(1 - distance, 3)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    v = F.round(d + m / 60 + s / 3600, 6)
    return F.when(ref.isin("S", "W"), -v).otherwise(v)


def exif_time(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss"))


def size_limit(text: str) -> int:
    """Bytes of '100MB' and the like; the longest suffix counts first."""
    m = re.fullmatch(r"\s*([\d.]+)\s*(TB|GB|MB|KB|B)?\s*", text.upper())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(float(m[1]) * 1024 ** ["B", "KB", "MB", "GB", "TB"].index(m[2] or "B"))


def glob_pattern(globs: list[str]) -> str:
    """One expression for shell patterns whose * also matches /."""
    part = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w/])", r"\\\1", c) for c in g)
    return "^(?:" + "|".join(part(g) for g in globs) + ")$"


def included(path: Column, name: Column, watcher: bool = False) -> Column:
    """Neither path nor name is excluded; the watcher folds case and leaves hidden files out."""
    flag = "(?i)" if watcher else ""
    out = ~path.rlike(flag + glob_pattern(V.EXCLUDED_PATHS)) & ~name.rlike(flag + glob_pattern(V.EXCLUDED_NAMES))
    return out & ~name.startswith(".") if watcher else out


def depth_ok(root: Column, path: Column, most: int | None) -> Column:
    if most is None:
        return F.lit(True)
    rel = F.substring(path, F.length(root) + 2, F.length(path))
    return path.startswith(F.concat(root, F.lit("/"))) & (F.size(F.split(rel, "/")) - 1 <= most)


def export_trigger(name: Column) -> Column:
    n = F.lower(name)
    return (n == "conversations.json") | ((n.contains("export") | n.contains("chat")) & n.endswith(".json"))


def title(text: Column) -> Column:
    """Upper case for each letter that follows no letter, lower case for the others."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit(False).alias("in_word"), F.lit("").alias("out"))
    step = lambda a, c: F.struct(c.rlike(r"\p{L}").alias("in_word"), F.concat(a["out"], F.when(a["in_word"], F.lower(c)).otherwise(F.upper(c))).alias("out"))
    return F.aggregate(chars, start, step, lambda a: a["out"])


def format_bytes(n: Column) -> Column:
    """Bytes in the unit that fits, a tenth that is halfway goes to the even one."""
    kb = n / F.lit(1024.0)
    shown = lambda v, unit: F.format_string(f"%.1f {unit}", F.bround(v, 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(kb < 1024, shown(kb, "KB")).when(kb < 1048576, shown(kb / 1024, "MB")).otherwise(shown(kb / 1048576, "GB"))


def places(text: Column, pattern: str) -> Column:
    """Matches of an expression in a text: structs of start (characters from 0) and value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p["gap"])).alias("start"), p["hit"].alias("value")))).alias("out"))
    return F.aggregate(F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), start, step, lambda a: a["out"])


def tech_places(text: Column) -> Column:
    """Technology terms in a text, in the order of the list and then of the text: structs of value as written and start.

    No letter or digit may stand before or after a term; an underscore may.
    """
    found = [F.when(F.contains(F.lower(text), F.lit(t.lower())), places(text, rf"(?i)(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])")) for t in V.TECH_TERMS]
    return F.flatten(F.array_compact(F.array(*found)))


def uptime(seconds: Column) -> Column:
    """Seconds as 42s, 7m or 3h 20m; halves go to the even number."""
    whole = lambda c: F.rint(c).cast("long").cast("string")
    hours = F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string"), F.lit("m"))
    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(hours)


def elapsed(seconds: Column) -> Column:
    """Whole seconds as 42s, 7.5m or 3.2h; ... for null. A tenth that is halfway goes to the even one."""
    tenths = lambda unit: F.rint(seconds / unit).cast("long")
    shown = lambda t, name: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(name))
    return F.when(seconds.isNull(), "...").when(seconds < 60, F.concat(F.rint(seconds).cast("long").cast("string"), F.lit("s"))).when(seconds < 3600, shown(tenths(6), "m")).otherwise(shown(tenths(360), "h"))


def grouped(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def bar(value: Column, most: Column, width: int = 20) -> Column:
    """A bar of width signs; an empty one where most is 0."""
    full = F.when(most == 0, 0).otherwise(F.floor(F.least(F.lit(1.0), value / F.when(most != 0, most)) * width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def sparkline(values: Column, width: int = 20) -> Column:
    """The last width values as signs of eight heights between the least and the most of all values, padded on the right."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high > low, high - low).otherwise(1)
    last = F.slice(values, F.greatest(F.size(values) - width + 1, F.lit(1)), F.lit(width))
    signs = F.transform(last, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), F.floor((v - low) / span * 7).cast("int") + 1, F.lit(1)))
    return F.rpad(F.array_join(signs, ""), width, "▁")


def parse_iso(value: Column, now: Column) -> Column:
    """An ISO time, Z or an offset at its end; now for null and for what is none."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")), now)


def parse_epoch(value: Column, now: Column) -> Column:
    """Seconds since 1970 as a time; now for null, zero and what is no number."""
    seconds = value.try_cast("double")
    fine = (seconds != 0) & ~F.isnan(seconds) & (F.abs(seconds) < 253402300800)
    return F.coalesce(F.when(fine, F.timestamp_micros(F.round(F.when(fine, seconds) * 1_000_000).cast("long"))), now)


def whole_number(text: Column) -> Column:
    """A track number: the text as a number, null where it is none."""
    return text.try_cast("int")


def year4(text: Column) -> Column:
    """The first four characters as a number, null where they are none."""
    return F.substring(text, 1, 4).try_cast("int")


def nested_get(config: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; a number is an index of a list, or a key."""
    steps = path.split(".")
    listed = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in steps)
    return F.coalesce(F.get_json_object(config, listed), F.get_json_object(config, "$" + "".join(f".{p}" for p in steps)))


def aperture(f_number: Column) -> Column:
    return F.when(f_number != 0, F.concat(F.lit("f/"), f_number.cast("string")))


def shutter(seconds: Column) -> Column:
    """1/n under a second, else the seconds."""
    return F.when(seconds == 0, None).when(seconds < 1, F.concat(F.lit("1/"), F.floor(1 / seconds).cast("long").cast("string"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def focal(mm: Column) -> Column:
    return F.when(mm != 0, F.concat(mm.cast("string"), F.lit("mm")))


def altitude(metres: Column, ref: Column) -> Column:
    """Negative below the sea, where ref is 1; null for 0 and null."""
    return F.when(metres != 0, F.when(F.coalesce(ref, F.lit(0)) == 1, -metres).otherwise(metres))


def place_name(city: Column, town: Column, village: Column, municipality: Column, state: Column, country: Column) -> Column:
    """The first of city, town, village and municipality, then state and country, joined by comma and blank; null without any."""
    some = lambda c: F.when(c != "", c)
    parts = F.array_compact(F.array(F.coalesce(*map(some, (city, town, village, municipality))), some(state), some(country)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def audio_text(title: Column, artist: Column, album: Column, name: Column) -> Column:
    """The tags a file has, a line each, else its name."""
    tag = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    lines = F.array_compact(F.array(tag("Title", title), tag("Artist", artist), tag("Album", album)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.concat(F.lit("[Audio: "), name, F.lit("]")))
