"""Text functions of the usage log: trimming, key detection, masking, labels, redaction.

All take and return Columns, null in, null out unless stated; none is a UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of secret keys, words that mark a credential, separators of name parts by
# rank, header names never kept, markers and query parameters whose value is redacted, defaults.
KEY_PREFIXES = ("sk-", "AIza", "hf_", "pk_", "rk_")
CREDENTIAL_MARKERS = ("apikey", "key", "credential", "auth")
SEPARATORS = (" · ", " - ", " | ", "/")
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-access-token", "api-key")
AUTH_MARKERS = ("Authorization:", "authorization:", "Bearer ", "bearer ", "X-API-Key:", "x-api-key:", "Api-Key:", "api-key:")
QUERY_PARAMETERS = ("key", "token", "api_key", "apikey")
REDACTED = "******"
HEADER_END, VALUE_END = r" ,\n\r;", r" &;\n\r"
CREDENTIAL_LABEL = r"(?iU)^\s*(?:凭证|credential|auth)\s+\S+\s*$"
JOINER = " · "
CHANNEL = "上游 "
UNKNOWN_API, UNKNOWN_CLIENT, UNKNOWN_SOURCE, BLANK_CREDENTIAL = "未知接口", "未知 API", "未知来源", "(空)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once and written once, so that nested functions stay small plans."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(x: Column) -> Column:
    """Without white space of any script at both ends; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*(let(x, lambda v: F.nullif(v, F.lit(""))) for x in xs))


def or_else(x: Column, other: Column) -> Column:
    return let(x, lambda v: F.when(v != "", v).otherwise(other))


def or_default(x: Column, default: str) -> Column:
    return or_else(x, F.lit(default))


def looks_secret(x: Column) -> Column:
    """A known key prefix, 40 bytes or more without any of ` /.-_`, or 80 without a space."""
    known = "^(?:" + "|".join(KEY_PREFIXES) + ")"
    return let(trim(x), lambda s: s.rlike(known) | ((F.octet_length(s) >= 40) & ~s.rlike("[ /.\\-_]")) | ((F.octet_length(s) >= 80) & ~F.contains(s, F.lit(" "))))


def looks_credential_id(x: Column) -> Column:
    """Eight or more hexadecimal digits, or 32 bytes or more without any of ` /.-_`."""
    return let(trim(x), lambda s: s.rlike(r"\A[0-9a-fA-F]{8,}\z") | ((F.octet_length(s) >= 32) & ~s.rlike("[ /.\\-_]")))


def looks_secret_token(x: Column) -> Column:
    known = "^(?:" + "|".join(KEY_PREFIXES) + ")"
    return let(trim(x), lambda s: (F.octet_length(s) >= 8) & (s.rlike(known) | ((F.octet_length(s) >= 32) & ~F.contains(s, F.lit(" ")))))


def _ends(s: Column) -> Column:
    return F.concat(F.left(s, F.lit(2)), F.lit(REDACTED), F.right(s, F.lit(2)))


def mask_key(x: Column) -> Column:
    """First two and last two characters around asterisks; of four or fewer, only the first; blank stays blank."""
    return let(trim(x), lambda s: F.when(s == "", "").when(F.octet_length(s) <= 4, F.concat(F.left(s, F.lit(1)), F.lit(REDACTED))).otherwise(_ends(s)))


def mask_token(x: Column) -> Column:
    return let(x, lambda s: F.when(F.octet_length(s) <= 4, F.lit(REDACTED)).otherwise(_ends(s)))


def hash_key(x: Column, salt: str) -> Column:
    """Hexadecimal SHA-224 of salt, colon and the trimmed key; blank stays blank."""
    s = trim(x)
    return F.when(s == "", "").otherwise(F.sha2(F.concat(F.lit(f"{salt}:"), s), 224))


def is_marker(x: Column) -> Column:
    return F.lower(trim(F.regexp_replace(x, "[-_]", ""))).isin(*CREDENTIAL_MARKERS)


def name_parts(x: Column) -> Column:
    """x split by the separator of the highest rank that it contains."""
    out = F.array(x)
    for s in reversed(SEPARATORS):
        out = F.when(F.contains(x, F.lit(s)), F.split(x, s.replace("|", "\\|"))).otherwise(out)
    return out


def _head(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), n)


def _tail(parts: Column, after: Column) -> Column:
    return F.slice(parts, after + 1, F.greatest(F.size(parts) - after, F.lit(0)))


def strip_credential(x: Column) -> Column:
    """A name without its credential: what stands before a marker, or all but a last part that looks like one."""

    def by_colon(s: Column) -> Column:
        return let(F.split(s, ":"), lambda c: F.when((F.size(c) >= 3) & looks_credential_id(F.element_at(c, -1)), F.array_join(_head(c, F.size(c) - 1), ":")).otherwise(s))

    def by_part(s: Column, parts: Column) -> Column:
        # a marker in front cuts nothing, a later one does
        marks = F.transform(parts, lambda p, i: (i > 0) & is_marker(p))
        odd_end = (F.size(parts) > 1) & let(F.element_at(parts, -1), lambda p: looks_credential_id(p) | looks_secret(p))
        return let(F.array_position(marks, True).cast("int"), lambda at: F.when(at > 0, F.array_join(_head(parts, at - 1), JOINER)).when(odd_end, F.array_join(_head(parts, F.size(parts) - 1), JOINER)).otherwise(by_colon(s)))

    return let(trim(x), lambda s: F.when(s == "", "").otherwise(let(name_parts(s), lambda parts: by_part(s, parts))))


def credential_identity(x: Column) -> Column:
    """The counterpart of strip_credential: what follows a marker, or a last part that looks like a credential; else empty."""

    def followed(p: Column) -> Column:
        return F.array_position(F.transform(p, lambda y, i: (i < F.size(p) - 1) & is_marker(y)), True).cast("int")

    def by_colon(c: Column) -> Column:
        end = F.element_at(c, -1)
        return let(followed(c), lambda at: F.when(at > 0, F.array_join(_tail(c, at), ":")).when((F.size(c) >= 3) & looks_credential_id(end), end).otherwise(""))

    def by_part(s: Column, parts: Column) -> Column:
        odd_end = (F.size(parts) > 1) & let(F.element_at(parts, -1), lambda p: looks_credential_id(p) | looks_secret(p))
        return let(followed(parts), lambda at: F.when(at > 0, F.array_join(_tail(parts, at), JOINER)).when(odd_end, F.element_at(parts, -1)).otherwise(let(F.split(s, ":"), by_colon)))

    return let(trim(x), lambda s: F.when(s == "", "").otherwise(let(name_parts(s), lambda parts: by_part(s, parts))))


def safe_identity(x: Column) -> Column:
    """The identity inside x, or x itself; masked if it is a secret."""
    value = let(trim(x), lambda s: trim(or_else(credential_identity(s), s)))
    return let(value, lambda v: F.when(looks_secret(v), mask_token(v)).otherwise(v))


def is_openai_compatible(x: Column) -> Column:
    return F.lower(trim(x)).rlike("^openai-compatib(?:le|ility)")


def join_names(*xs: Column) -> Column:
    """Trimmed, without blanks and repeats, joined; nulls are blanks."""
    return F.array_join(F.array_distinct(F.filter(F.array(*(trim(x) for x in xs)), lambda p: p != "")), JOINER)


def source_label(source: Column, provider: Column, executor: Column) -> Column:
    """The source without credentials, unless it is a secret; else provider, executor or `unknown`."""
    name = strip_credential(F.coalesce(first_filled(trim(provider), trim(executor)), F.lit("unknown")))
    return let(strip_credential(source), lambda own: F.when((own != "") & ~looks_secret(own), own).otherwise(name))


def channel_label(auth_index: Column, source: Column, auth_id: Column) -> Column:
    """The upstream channel: the first identity among index, source, id; empty if there is none."""
    found = first_filled(safe_identity(auth_index), safe_identity(credential_identity(source)), safe_identity(credential_identity(auth_id)), safe_identity(auth_id))
    return F.coalesce(F.concat(F.lit(CHANNEL), found), F.lit(""))


def group_key(provider: Column, executor: Column, source: Column, base_url: Column, auth_index: Column, auth_id: Column) -> Column:
    """The api that a request counts for: primary name with base url, or with source, or with channel."""

    def named(primary: Column, own: Column) -> Column:
        added = (own != "") & ~looks_secret(own) & (own != primary)
        channel = F.when(is_openai_compatible(primary) | added, "").otherwise(channel_label(auth_index, source, auth_id))
        return or_default(join_names(primary, F.when(added, own), channel), UNKNOWN_API)

    def keyed(primary: Column) -> Column:
        base = trim(base_url)
        return F.when((base != "") & ~is_openai_compatible(primary), join_names(primary, base)).otherwise(let(strip_credential(source), lambda own: named(primary, own)))

    return let(F.coalesce(first_filled(trim(provider), trim(executor)), F.lit("")), keyed)


def rekey(fallback: Column, provider: Column, source: Column, base_url: Column, auth_index: Column, auth_id: Column) -> Column:
    """The group key of a stored row; fallback, the key that it was stored under, serves as executor."""
    key = group_key(provider, fallback, source, base_url, auth_index, auth_id)
    return let(key, lambda k: F.when(k == UNKNOWN_API, or_default(trim(fallback), UNKNOWN_API)).otherwise(k))


def client_group(api_key: Column, api_key_hash: Column) -> Column:
    """The client that a row counts for: its masked key, else its hash, else unknown."""
    key, digest = trim(api_key), trim(api_key_hash)
    return F.when(key != "", F.concat(F.lit("api_key:"), key)).when(digest != "", F.concat(F.lit("api_key_hash:"), digest)).otherwise("(unknown)")


def client_label(api_key: Column) -> Column:
    return or_default(trim(api_key), UNKNOWN_CLIENT)


def model_name(x: Column) -> Column:
    return or_default(trim(x), "unknown")


def thinking(effort: Column) -> Column:
    """Intensity and level of a reasoning effort; mode and budget are never known at ingest."""
    s = trim(effort)
    return F.struct(s.alias("intensity"), F.lit("").alias("mode"), s.alias("level"), F.lit(0).cast("long").alias("budget"))


def cut_long(x: Column, limit: int = 500) -> Column:
    """Trimmed and, over `limit` bytes, cut there before a character that would be split, with `...` behind."""

    def cut(s: Column) -> Column:
        # the following bytes of a character are 10xxxxxx: go back over them from the first byte that is left out
        place = F.lit(limit + 1)
        for back in range(4, 0, -1):
            at = limit + 1 - back + 1
            starts = ~F.hex(F.substring(s.cast("binary"), at, 1)).rlike("^[89AB]")
            place = F.when(starts, F.lit(at)).otherwise(place) if back < 4 else F.lit(at)
        return F.concat(F.substr(s.cast("binary"), F.lit(1), place - 1).cast("string"), F.lit("..."))

    return let(trim(x), lambda s: F.when(F.octet_length(s) > limit, cut(s)).otherwise(s))


def friendly_api(x: Column) -> Column:
    """An api's name without parts that are keys, markers, labels or ids of credentials; unknown if it is blank."""

    def shown(s: Column) -> Column:
        odd = lambda p: looks_secret(p) | is_marker(p) | p.rlike(CREDENTIAL_LABEL) | looks_credential_id(p)
        return or_else(F.array_join(F.filter(F.split(s, JOINER), lambda p: ~odd(p)), JOINER), s)

    return let(strip_credential(x), lambda s: F.when(s == "", UNKNOWN_API).otherwise(shown(s)))


def source_key(source: Column, provider: Column) -> Column:
    """The name that a source is grouped by: without credentials, else its provider's, else unknown."""
    plain = lambda x: let(strip_credential(x), lambda s: F.when(looks_secret(s), "").otherwise(s))
    return or_else(plain(source), or_default(plain(provider), UNKNOWN_SOURCE))


def escaped(x: Column) -> Column:
    """Text for HTML; null becomes the empty string."""
    out = F.coalesce(x, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def path_tail(x: Column) -> Column:
    return F.substring_index(F.rtrim(x, F.lit("/")), "/", -1)


# -- headers -----------------------------------------------------------------------------------


def header_rules(raw: str) -> dict:
    """A comma list of names, `prefix*` or `*`, in lower case."""
    names = [x.strip().lower() for x in raw.split(",") if x.strip()]
    prefixes = [x[:-1].strip() for x in names if x.endswith("*") and x != "*"]
    return {"all": "*" in names, "exact": {x for x in names if not x.endswith("*")}, "prefixes": [p for p in prefixes if p]}


def header_rules_text(rules: dict) -> str:
    return ",".join(sorted(["*"] * rules["all"] + list(rules["exact"]) + [f"{p}*" for p in rules["prefixes"]]))


def keep_headers(headers: Column, raw: str) -> Column:
    """Entries of a header map that the list names, never a sensitive one; null if none is left."""
    rules = header_rules(raw)
    if not (rules["all"] or rules["exact"] or rules["prefixes"]):
        return F.lit(None).cast("map<string,array<string>>")

    def keep(k: Column, _: Column) -> Column:
        name = F.lower(trim(k))
        named = [F.lit(rules["all"])] + [name.isin(*sorted(rules["exact"]))] * bool(rules["exact"]) + [F.startswith(name, F.lit(p)) for p in rules["prefixes"]]
        return (name != "") & ~name.isin(*SENSITIVE_HEADERS) & reduce(Column.__or__, named)

    kept = F.map_filter(headers, keep)
    return F.when(F.size(kept) > 0, kept)


# -- redaction ---------------------------------------------------------------------------------


def _redact_prefix(x: Column, prefix: str) -> Column:
    """Every token that starts so, anywhere in a word; its prefix's two first and its two last characters stay."""
    rest = r"[A-Za-z0-9_\-]"
    if len(prefix) == 4:  # longer than four characters as soon as anything follows
        x = F.regexp_replace(x, rf"{prefix[:2]}(?={prefix[2:]}{rest}){rest}*({rest}{{2}})", f"{prefix[:2]}{REDACTED}$1")
    else:
        x = F.regexp_replace(x, rf"{prefix}{rest}*({rest}{{2}})", f"{prefix[:2]}{REDACTED}$1")
    return F.regexp_replace(x, f"{prefix}{rest}?", REDACTED)


def _token(stop: str) -> str:
    """What counts as a secret up to one of the characters of stop: a known prefix and eight characters in all, or 32."""
    return "(?:" + "|".join(f"{p}[^{stop}]{{{8 - len(p)},}}" for p in KEY_PREFIXES) + f"|[^{stop}]{{32,}})"


def _redact_marker(x: Column, marker: str, strict: bool) -> Column:
    """The token behind the first such marker. Strictly, only with one blank (two after a marker that ends with one)."""
    between = " " if strict else (r"[ \t]*")
    whole = rf"(?s)\A((?:(?!{marker}).)*{marker}{between})(?=({_token(HEADER_END)}))([^{HEADER_END}]{{2}})[^{HEADER_END}]*([^{HEADER_END}]{{2}})"
    return F.regexp_replace(x, whole, f"$1$3{REDACTED}$4")


def _redact_parameter(x: Column, name: str) -> Column:
    value = _token(VALUE_END)
    for sign in ("=", " %3D ", "%3D"):
        x = F.regexp_replace(x, rf"(?s)\A((?:(?!{name}{sign}).)*{name}{sign})(?={value})[^ &;\n\r]+", f"$1{REDACTED}")
    return x


def redact(x: Column, strict: bool = False) -> Column:
    """Text without keys and tokens; null becomes the empty string.

    By default a token right behind `Bearer ` or without a blank behind a header's colon goes too;
    strict leaves those.
    """
    out = F.coalesce(x, F.lit(""))
    for prefix in KEY_PREFIXES:
        out = _redact_prefix(out, prefix)
    for marker in AUTH_MARKERS:
        out = _redact_marker(out, marker, strict)
    for name in QUERY_PARAMETERS:
        out = _redact_parameter(out, name)
    return out
