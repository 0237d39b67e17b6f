"""Identity, names, formatting and small parsers, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed value: the namespace of slide ids.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name (F1)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def basename(key: Column) -> Column:
    """What follows the last slash; the key itself if that is empty (F2)."""
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(last == "", key).otherwise(last)


def scoped_key(*parts: Column, sep: str = ":") -> Column:
    """dataset:key, message ids, id.level.x.y."""
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def has_suffix(key: Column, *suffixes: str) -> Column:
    """Ends with one of the suffixes in any case."""
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(key), F.lit(s.lower()))
    return out


def safe_name(name: Column) -> Column:
    """Slashes, and stretches outside letters, digits, dot, underscore and hyphen, become underscores."""
    return F.regexp_replace(F.regexp_replace(name, "/", "_"), "[^A-Za-z0-9._-]+", "_")


def safe_name_dropping(name: Column) -> Column:
    """Other characters go, ends are trimmed, spaces become underscores (F5, second form)."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} ._\-()\[\]{}]", "")), " ", "_")


#: Preferred metadata keys, and other names for three of them.
PREFERRED = (
    "collectionName", "collectionId", "subjectId", "caseId", "patientId", "imageId", "imageName", "imageUrl", "fileName", "fileSize",
    "stain", "stainType", "staining", "scanner", "scannerModel", "manufacturer", "tissue", "tissueType", "specimen", "specimenType",
    "anatomicSite", "organ", "diagnosis", "tumorType", "label", "grade",
)
ALIASES = {"collectionName": ("collection", "Collection", "COLLECTION"), "subjectId": ("subject", "SubjectID", "SubjectId"), "imageId": ("id", "ImageID", "ImageId")}


def picked(json: Column, preferred: Sequence[str] = PREFERRED, aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """The preferred keys of a JSON object that hold something, other names filling in, as a map of strings.

    The text is parsed once, to a VARIANT; a text that is no JSON has none of them.
    """
    whole = F.try_parse_json(json)
    at = lambda k: F.try_variant_get(whole, f"$['{k}']", "string")
    filled = lambda v: F.when(~v.isin("", "[]"), v)
    values = [F.coalesce(filled(at(k)), *[at(a) for a in aliases.get(k, ())]) for k in preferred]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, preferred)), F.array(*values)), lambda _, v: v.isNotNull())


def first_of(json: Column, *path: str) -> Column:
    """A field under the first element of nested arrays: first_of(c, "cases", "samples", "type").

    Fields of one text in one projection share its parse to a VARIANT; a text that is no JSON has none.
    """
    inner = "".join(f".{p}[0]" for p in path[:-1])
    return F.try_variant_get(F.try_parse_json(json), f"${inner}.{path[-1]}", "string")


def base64url_json(text: Column) -> Column:
    """JSON text of a base64url session, padded anew; null if it is malformed."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / F.lit(4)) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def to_base64url(json: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.encode(json, "utf-8")), "+/", "-_"), "[=\\r\\n]", "")


def fixed(value: Column, digits: int) -> Column:
    """A number of 0 or more, below 2**40, as text with so many decimals; the double's exact value counts, halves go up.

    The value is split into a head of 26 bits and a rest, whose products with the power of ten are exact.
    """
    scale = 10**digits
    spread = value.cast("double") * F.lit(134217729.0)
    head = spread - (spread - value)
    a, b = head * F.lit(float(scale)), (value - head) * F.lit(float(scale))
    n = (F.floor(a) + F.floor((a - F.floor(a) - F.lit(0.5)) + b) + 1).cast("long")
    whole = F.floor(n / F.lit(scale)).cast("string") if digits else n.cast("string")
    return F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")) if digits else whole


def size_text(size: Column) -> Column:
    """B, KB, MB or GB, one decimal."""
    unit = lambda n, u: F.concat(fixed(size / F.lit(float(n)), 1), F.lit(f" {u}"))
    return F.when(size >= 1 << 30, unit(1 << 30, "GB")).when(size >= 1 << 20, unit(1 << 20, "MB")).when(size >= 1 << 10, unit(1 << 10, "KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def dimension_text(width: Column, height: Column) -> Column:
    """Width and height in thousands or millions."""
    both = lambda n, u: F.concat(fixed(width / F.lit(float(n)), 1), F.lit(f"{u} × "), fixed(height / F.lit(float(n)), 1), F.lit(u))
    most = F.greatest(width, height)
    return F.when(most >= 1_000_000, both(1e6, "M")).when(most >= 1000, both(1e3, "K")).otherwise(F.concat(width.cast("string"), F.lit(" × "), height.cast("string")))


def progress_text(steps: Column, total: Column) -> Column:
    """Percent in three significant digits; null when not begun or complete."""
    p = steps / F.when(total != 0, total) * 100
    # A value that rounds up to the next power of ten has one decimal less.
    text = F.when(p <= 0, "0.00").when(p >= 99.95, fixed(p, 0)).when(p >= 9.995, fixed(p, 1)).when(p >= 0.9995, fixed(p, 2)).when(p >= 0.09995, fixed(p, 3)).otherwise(fixed(p, 4))
    return F.when((total != 0) & (steps < total), F.concat(text, F.lit("%")))


def distance_text(microns: Column, unit: str = "um") -> Column:
    """A length in µm, mm, in or mil."""
    f = lambda d, v, u: F.concat(fixed(v, d), F.lit(f" {u}"))
    if unit == "mm":
        return F.when(microns >= 1000, f(1, microns / 1000, "mm")).otherwise(f(3, microns / 1000, "mm"))
    if unit == "in":
        inches = microns / 25400
        return F.when(inches >= 0.1, f(2, inches, "in")).otherwise(f(1, inches * 1000, "mil"))
    return F.when(microns >= 10_000, f(0, microns / 1000, "mm")).when(microns >= 1000, f(1, microns / 1000, "mm")).otherwise(f(1, microns, "µm"))


def property_label(name: Column) -> Column:
    """Underscores become spaces and every word's first letter large; the rest stays (F16)."""
    words = F.split(F.regexp_replace(name, "_", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


#: Fixed value: what a link in a credit looks like.
LINK = r"(?i)(doi:\s*10\.\d{4,9}/\S+|https?://\S+)"
#: Fixed value: punctuation that no link ends with.
TRAILING = r"[\].,;:!?)+]"


def credit_links(text: Column) -> Column:
    """Links and DOIs of a credit, punctuation at their end left out."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, TRAILING + "+$", ""))


def credit_parts(text: Column) -> Column:
    """A credit as ordered parts (kind, value), kind text, doi or url; empty ones left out."""
    # Neither kind of link ends with punctuation: the test stands behind both.
    marked = F.regexp_replace(text, f"({LINK}(?<!{TRAILING}))", "\u0001$1\u0001")
    kind = lambda v, i: F.when(i % 2 == 0, "text").when(F.startswith(F.lower(v), F.lit("doi:")), "doi").otherwise("url")
    parts = F.transform(F.split(marked, "\u0001"), lambda v, i: F.struct(kind(v, i).alias("kind"), v.alias("value")))
    return F.filter(parts, lambda p: p["value"] != "")


def slide_label(filename: Column, slide_id: Column) -> Column:
    """The file name, else eight characters of the id."""
    return F.coalesce(F.nullif(filename, F.lit("")), F.substring(slide_id, 1, 8))


def is_uuid(text: Column) -> Column:
    """Hyphens may be left out."""
    return text.rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")


def first_hop(forwarded: Column) -> Column:
    """First entry of X-Forwarded-For."""
    return F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))


def is_internal(ip: Column) -> Column:
    """An address that monitoring leaves out."""
    return ip.rlike(r"^(10\.|192\.168\.|172\.)")


def valid_name(name: Column) -> Column:
    """User names: 3 to 30 letters, digits, underscores, hyphens and dots."""
    return name.rlike(r"^[\p{L}\p{N}_.-]{3,30}$")


def valid_password(password: Column) -> Column:
    """8 characters or more, a digit and something else than letters and digits among them."""
    return (F.length(password) >= 8) & password.rlike("[0-9]") & password.rlike(r"[^\p{L}\p{N}]")


def permalink_number(text: Column, low: float, high: float) -> Column:
    """A finite number within limits, else null."""
    n = text.try_cast("double")
    return F.when(n.between(low, high) & ~F.isnan(n), n)


def permalink_rectangle(text: Column) -> Column:
    """Four finite numbers between commas, else null."""
    parts = F.transform(F.split(text, ","), lambda p: p.try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf"))))
    return F.when(good, parts)


def merged_json(target: Column, source: Column) -> Column:
    """Two JSON objects merged into each other; the source wins and arrays are replaced (F28). A UDF: shapes are free."""
    @pandas_udf("string")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        import json

        def deep(x, y):
            return {**x, **{k: deep(x[k], v) if isinstance(v, dict) and isinstance(x.get(k), dict) else v for k, v in y.items()}}

        def one(x, y):
            if x is None or y is None:
                return y if x is None else x
            x, y = json.loads(x), json.loads(y)
            return json.dumps(deep(x, y) if isinstance(x, dict) and isinstance(y, dict) else y, sort_keys=True)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return merge(target, source)


def deep_merged(target: Column, source: Column, depth: int = 16) -> Column:
    """Two VARIANTs merged into each other; the source wins and arrays are replaced (F28). A VARIANT, keys in order.

    Objects are merged down to ``depth``; below it the source's object takes the target's place. JSON's null is a value
    that wins like others; a null column counts as not given.
    """
    def of(a: Column, b: Column, left: int) -> Column:
        mine = F.coalesce(b, a)
        if not left:
            return mine
        thing = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        fields = lambda v: v.cast("map<string,variant>")
        both = F.map_zip_with(fields(a), fields(b), lambda _, x, y: of(x, y, left - 1))
        return F.when(thing(a) & thing(b), F.to_variant_object(both)).otherwise(mine)

    return of(target, source, depth)
