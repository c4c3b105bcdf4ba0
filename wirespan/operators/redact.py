"""Secrets: detection, redaction, entropy gates, and the audit of what leaves in requests.

The standard detectors are plain patterns and run in the JVM; the strict ones judge character classes and entropy and
run in Arrow batches. Detection tries every detector on the original text; redaction applies them one after another.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.functions.texts import fingerprint, last4

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Standard detectors in order: type, pattern, what comes before the token and stays.
STANDARD = (
    ("jwt", _B + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{7,}[A-Za-z0-9_]" + _E, ""),
    ("openai_key", _B + r"sk-(?:proj-)?[A-Za-z0-9_-]{19,}[A-Za-z0-9_]" + _E, ""),
    ("github_token", _B + r"gh[pousr]_[A-Za-z0-9]{20,255}" + _E, ""),
    ("github_token", _B + r"github_pat_[A-Za-z0-9_]{20,255}" + _E, ""),
    ("slack_token", _B + r"xox[baprs]-[A-Za-z0-9-]{9,}[A-Za-z0-9_]" + _E, ""),
    ("aws_access_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])", ""),
    ("bearer_token", _B + r"Bearer[\s ]+([A-Za-z0-9._~+/=-]{20,})", "Bearer "),
)
#: What each standard pattern's finds begin with, in the same order: a text without it needs no pattern.
STARTS = (("eyJ",), ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("xox",), ("AKIA", "ASIA"), ("Bearer",))
#: Strict detectors: 40 characters of both cases and digits with entropy over 4, and assigned secrets.
STRICT_KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
STRICT_KEY_BITS = 4.0
STRICT_ENV = r"""(?<![A-Za-z0-9_])([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|PWD|CREDENTIAL))\s*=\s*("?)([^\s"';,]{12,})\2"""
STRICT_ENV_BITS = 3.2
PLACEHOLDER = r"\[REDACTED:[a-z_]+\]"


def parse_mode(mode: str | bool | None) -> str:
    """'standard', 'strict' or 'off'; anything else is standard."""
    return mode if mode in ("strict", "off") else "standard"


def bits(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII if r"\s" not in pattern else 0)


_STRICT_KEY, _STRICT_ENV, _PLACEHOLDER = (_python(p) for p in (STRICT_KEY, STRICT_ENV, PLACEHOLDER))
_STANDARD = tuple((kind, _python(p), before) for kind, p, before in STANDARD)


def _is_key(token: str) -> bool:
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)) and bits(token) > STRICT_KEY_BITS


def redact_string(text: str, mode: str = "standard") -> str:
    """text with secrets replaced by placeholders; done again it changes nothing."""
    if mode == "off":
        return text
    for kind, pattern, before in _STANDARD:
        text = pattern.sub(f"{before}[REDACTED:{kind}]", text)
    if mode == "strict":
        text = _STRICT_KEY.sub(lambda m: "[REDACTED:aws_secret_access_key]" if _is_key(m[0]) else m[0], text)
        text = _STRICT_ENV.sub(lambda m: f"{m[1]}={m[2]}[REDACTED:env_secret]{m[2]}" if not _PLACEHOLDER.match(m[3]) and bits(m[3]) > STRICT_ENV_BITS else m[0], text)
    return text


def redact_value(value, mode: str = "standard"):
    """Any JSON value with its strings redacted; keys stay."""
    if isinstance(value, str):
        return redact_string(value, mode)
    if isinstance(value, list):
        return [redact_value(x, mode) for x in value]
    if isinstance(value, dict):
        return {k: redact_value(x, mode) for k, x in value.items()}
    return value


def redact_pair(pair: dict, mode: str = "standard") -> dict:
    """A captured pair with its bodies redacted, and nothing else."""
    out = dict(pair)
    for side, parts in (("request", ("body",)), ("response", ("body", "body_raw"))):
        if isinstance(out.get(side), dict):
            out[side] = {k: redact_value(v, mode) if k in parts else v for k, v in out[side].items()}
    return out


def find_secrets(text: str, mode: str = "standard") -> list[tuple[str, str]]:
    """(type, token) of every detector's finds in text; placeholders are none."""
    found = [(kind, m[m.lastindex or 0]) for kind, pattern, _ in _STANDARD for m in pattern.finditer(text)]
    if mode == "strict":
        found += [("aws_secret_access_key", m[0]) for m in _STRICT_KEY.finditer(text) if _is_key(m[0])]
        found += [("env_secret", m[3]) for m in _STRICT_ENV.finditer(text) if bits(m[3]) > STRICT_ENV_BITS]
    return [(kind, token) for kind, token in found if not _PLACEHOLDER.match(token)]


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def redacted(text: Column, mode: str = "standard") -> Column:
    """Text column with secrets replaced; standard mode stays in the JVM."""
    if mode == "off":
        return text
    if mode == "standard":
        for (kind, pattern, before), starts in zip(STANDARD, STARTS, strict=True):
            # Named once by the lambda, so that seven guards in a row don't repeat what is within.
            cleared = F.transform(F.array(text), lambda t: F.when(_has_any(t, starts), F.regexp_replace(t, pattern, f"{before}[REDACTED:{kind}]")).otherwise(t))  # noqa: B023
            text = F.get(cleared, 0)
        return text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else redact_string(t, "strict"))

    return run(text)


def redacted_json(text: Column, mode: str = "standard") -> Column:
    """JSON text with its string values redacted; text that is no JSON is redacted as it is."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(redact_value(json.loads(t), mode), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return redact_string(t, mode)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(one)

    return run(text)


def redaction_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLACEHOLDER)), F.lit(0))


def redaction_types(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[REDACTED:([a-z_]+)\]"), F.lit(1)))


def detected(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without text, once for each secret that a standard detector finds, with type and token."""

    def finds(kind: str, pattern: str, before: str, starts: tuple[str, ...]) -> Column:
        tokens = F.when(_has_any(F.col(text), starts), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1 if before else 0)))
        tokens = F.coalesce(tokens, F.array().cast("array<string>"))
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("token")))

    exploded = rows.withColumn("secret", F.explode(F.concat(*(finds(*d, starts) for d, starts in zip(STANDARD, STARTS, strict=True))))).drop(text)
    return exploded.select(*(c for c in rows.columns if c != text), "secret.type", "secret.token").filter(~F.col("token").rlike(f"^{PLACEHOLDER}"))


def walk(value, path: tuple = (), role: str | None = None) -> Iterator[tuple[str, tuple, str | None]]:
    """(string, path, role of the nearest object that has one) of every string value in a JSON value."""
    if isinstance(value, str):
        yield value, path, role
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from walk(x, (*path, i), role)
    elif isinstance(value, dict):
        own = value["role"] if isinstance(value.get("role"), str) else role
        for k, x in value.items():
            yield from walk(x, (*path, k), own)


def location(path: tuple, role: str | None) -> str:
    """field[i] (role) of a path's first steps, or (body) for a body that is itself a string."""
    if not path:
        return "(body)"
    label = str(path[0]) + (f"[{path[1]}]" if len(path) > 1 and isinstance(path[1], int) else "")
    return f"{label} ({role})" if role else label


def scan_pair(pair: dict, mode: str = "standard") -> list[tuple[str, str, str, str]]:
    """(type, token, location, direction) of every secret in a pair's bodies; requests are egress."""
    out = []
    request, response = pair.get("request") or {}, pair.get("response") or {}
    for value, direction, place in ((request.get("body"), "egress", None), (response.get("body"), "response", None), (response.get("body_raw"), "response", "response")):
        for text, path, role in walk(value):
            out += [(kind, token, place or location(path, role), direction) for kind, token in find_secrets(text, mode)]
    return out


#: Escapes in JSON text that may stand for a letter, digit or dash of a token.
ESCAPED = "\\u00"
#: How deep JSON text nests: escapes go, then strings, then all but brackets, which are counted.
NESTING = r"""aggregate(split(regexp_replace(regexp_replace(regexp_replace(raw, r'(?s)\\.', ''), r'"[^"]*"', ''), r'[^\[\]{}]+', ''), ''), named_struct('now', 0, 'most', 0),
  (a, c) -> CASE WHEN c IN ('[', '{') THEN named_struct('now', a.now + 1, 'most', greatest(a.most, a.now + 1)) WHEN c IN (']', '}') THEN named_struct('now', a.now - 1, 'most', a.most) ELSE a END, a -> a.most)"""
_KIND = "substring_index(schema_of_variant({}), '<', 1)"
_OWN_ROLE = "CASE WHEN schema_of_variant(try_variant_get(x.v, '$.role', 'variant')) = 'STRING' THEN try_variant_get(x.v, '$.role', 'string') ELSE x.role END"
#: A walk down a body, a level with each turn, within its row: objects give their keys, arrays their places, strings stay.
#: label is the first key and, if that holds an array, the place in it; a role is that of the nearest object that has one.
#: Depth 3 keeps a given label.
WALK = f"""aggregate(sequence(1, nesting), array(named_struct('label', label, 'depth', CASE WHEN label IS NULL THEN 0 ELSE 3 END, 'role', cast(NULL AS string), 'kind', {_KIND.format('v')}, 'v', v)), (walked, turn) -> flatten(transform(walked, x -> CASE x.kind
  WHEN 'STRING' THEN array(x)
  WHEN 'ARRAY' THEN transform(try_variant_get(x.v, '$', 'array<variant>'), (e, i) -> named_struct('label', CASE x.depth WHEN 0 THEN cast(i AS string) WHEN 1 THEN concat(x.label, '[', i, ']') ELSE x.label END,
    'depth', CASE x.depth WHEN 3 THEN 3 ELSE least(x.depth + 1, 2) END, 'role', x.role, 'kind', {_KIND.format('e')}, 'v', e))
  WHEN 'OBJECT' THEN transform(map_entries(try_variant_get(x.v, '$', 'map<string,variant>')), e -> named_struct('label', CASE x.depth WHEN 0 THEN e.key ELSE x.label END,
    'depth', CASE x.depth WHEN 3 THEN 3 ELSE least(x.depth + 1, 2) END, 'role', {_OWN_ROLE}, 'kind', {_KIND.format('e.value')}, 'v', e.value))
  ELSE slice(walked, 1, 0) END)))"""


def strings(pairs: DataFrame, mode: str = "off") -> DataFrame:
    """place (source_path, pair_index, ts, direction), location and text of every string value in the bodies of pairs
    (source_path, pair_index, ts, raw), walked in the JVM, each pair within its row, so that nothing is shuffled or kept
    between levels; with mode standard, of pairs that may hold a standard secret."""
    if mode == "standard":
        pairs = pairs.filter(_has_any(F.col("raw"), (*(s for starts in STARTS for s in starts), ESCAPED)))
    rows = pairs.select(F.col("source_path"), F.col("pair_index").cast("long").alias("pair_index"), F.col("ts").cast("double").alias("ts"), F.try_parse_json("raw").alias("pair"), F.greatest(F.expr(NESTING), F.lit(1)).alias("nesting"))
    body = lambda path, direction, label: F.struct(F.lit(direction).alias("direction"), F.lit(label).cast("string").alias("label"), F.expr(f"try_variant_get(pair, '$.{path}', 'variant')").alias("v"))
    rows = rows.select("source_path", "pair_index", "ts", "nesting", F.explode(F.array(body("request.body", "egress", None), body("response.body", "response", None), body("response.body_raw", "response", "response"))).alias("b")).filter("b.v is not null")
    bodies = rows.select(F.struct("source_path", "pair_index", "ts", "b.direction").alias("place"), "nesting", "b.label", "b.v")
    found = bodies.select("place", F.explode(F.expr(WALK)).alias("x")).filter("x.kind = 'STRING'").select("place", "x.label", F.expr("CASE WHEN x.depth < 3 THEN x.role END").alias("role"), F.col("x.v").cast("string").alias("text"))
    at = F.when(F.col("label").isNull(), "(body)").when(F.col("role").isNull(), F.col("label")).otherwise(F.concat("label", F.lit(" ("), "role", F.lit(")")))
    return found.select("place", at.alias("location"), "text")


def scanned(pairs: DataFrame, mode: str = "standard") -> DataFrame:
    """One row a secret of pairs (source_path, pair_index, ts, raw): with type, token, location and direction. JSON is walked
    in the JVM; strict detectors see batches of strings."""
    found = strings(pairs, mode)
    if mode == "strict":

        @F.pandas_udf("array<struct<type:string,token:string>>")
        def finds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: [{"type": kind, "token": token} for kind, token in find_secrets(t, "strict")])

        found = found.select("place", "location", F.explode(finds("text")).alias("secret")).select("place", "location", "secret.*")
    elif mode == "standard":
        found = detected(found)
    else:
        found = found.limit(0).select("place", "location", F.lit("").alias("type"), F.lit("").alias("token"))
    return found.select("place.source_path", "place.pair_index", "place.ts", "type", "token", "location", "place.direction")


def grouped(found: DataFrame) -> DataFrame:
    """Secrets by fingerprint and type: counts by direction, distinct places and files, first and last positive time."""
    times = F.when(F.col("ts") > 0, F.col("ts"))
    return found.groupBy(fingerprint(F.col("token")).alias("fingerprint"), "type").agg(
        F.first(last4(F.col("token"))).alias("last4"), F.count_if(F.col("direction") == "egress").alias("egress_count"), F.count_if(F.col("direction") == "response").alias("response_count"),
        F.array_sort(F.collect_set("location")).alias("locations"), F.array_sort(F.collect_set("source_path")).alias("files"), F.coalesce(F.min(times), F.lit(0.0)).alias("first_ts"), F.coalesce(F.max(times), F.lit(0.0)).alias("last_ts"),
    )


def audit_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("direction") == "egress").alias("total_egress"), F.count_if(F.col("direction") == "response").alias("total_response"))


def redact_check(pairs: DataFrame) -> DataFrame:
    """How many placeholders either mode leaves in pairs (raw): standard_masked, strict_masked, pairs_scanned.

    What stands in a pair already counts, and so does what each string of its bodies gains.
    """
    there = pairs.agg(F.coalesce(F.sum(redaction_count(F.col("raw"))), F.lit(0)).alias("there"), F.count("*").alias("pairs_scanned"))
    own = strings(pairs.select(F.lit("").alias("source_path"), F.lit(0).alias("pair_index"), F.lit(0.0).alias("ts"), "raw"))
    gained = lambda mode: F.coalesce(F.sum(redaction_count(redacted(F.col("text"), mode)) - redaction_count(F.col("text"))), F.lit(0))
    sums = own.agg(gained("standard").alias("standard"), gained("strict").alias("strict"))
    rows = there.crossJoin(F.broadcast(sums))  # a row each
    return rows.select((F.col("there") + F.col("standard")).alias("standard_masked"), (F.col("there") + F.col("strict")).alias("strict_masked"), "pairs_scanned")
