"""Scalar column functions: names, paths, globs, signatures, numbers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a failure signature forgets, in this order, and what stands for it.
SIGNATURE_STEPS = [
    (r"\x1b\[[0-9;]*[A-Za-z]", ""),  # terminal colours
    (r"0x[0-9a-fA-F]+", "<addr>"),  # addresses
    (r"[0-9]{3,}", "<n>"),  # long numbers
    (r"[ \t\n\f\r]+", " "),  # white space
]
# Fixed value: a decision in source text.
DECISION = r"\b(if|when|for|while|catch)\b|&&|\|\||\?:"
# Icon densities and their factors.
DENSITIES = {"ldpi": 0.75, "mdpi": 1.0, "hdpi": 1.5, "xhdpi": 2.0, "xxhdpi": 3.0, "xxxhdpi": 4.0}
# Path parts that hold deliberately broken sources.
TEST_DATA_DIRS = ["/test/data/", "/testData/", "/testdata/", "/test-data/", "/compiler-tests/", "/compilerTests/"]
# Cost, effort and precision labels from the least on; a label's rank counts from 1.
LABELS = {
    "cost": ["trivial", "line", "ast", "crossfile", "oracle", "fir"],
    "effort": ["trivial", "local", "refactor", "architectural"],
    "precision": ["heuristic/text-backed", "ast-backed", "project-structure-aware", "type-aware", "policy"],
}
# Presets that stand for a cost.
COST_PRESETS = {"fast": "ast", "balanced": "crossfile", "thorough": "fir", "all": "fir"}
# Parts of paths that hold tests.
TEST_PATHS = [
    "/test/", "/androidTest/", "/commonTest/", "/jvmTest/", "/jvmAndroidTest/", "/commonJvmTest/", "/browserCommonTest/", "/jvmCommonTest/",
    "/androidUnitTest/", "/androidInstrumentedTest/", "/jsTest/", "/iosTest/", "/nativeTest/", "/nonJvmCommonTest/", "/testShared/", "/sharedTest/",
    "/benchmark/", "/canary/", "/test-utils/", "/javatests/", "/kotlintests/", "/javatest/", "/kotlintest/", "/functionalTest/", "/functionaltests/",
    "/test/resources/", "/testResources/", "/testFixtures/", "/integration-tests/", "/integrationTest/", "/nonEmulatorCommonTest/", "/nonEmulatorJvmTest/",
    "/testData/", "/testdata/", "/test-data/", "/test/data/", "/compiler-tests/", "/compilertests/",
]
#: White space as a class for both regular expression engines.
SPACE = r"[\t-\r \x{85}\p{Z}]"


def normalize_signature(text: Column) -> Column:
    """A failure text without what changes from run to run; null stays null."""
    for pattern, stands in SIGNATURE_STEPS:
        text = F.regexp_replace(text, pattern, stands)
    return F.trim(F.lower(text))


def event_id(kind: Column, signature: Column, commit: Column, source: Column) -> Column:
    """16 hex digits of sha256 over the fields joined by NUL."""
    nul = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(kind, nul, signature, nul, commit, nul, source), 256), 1, 16)


def caller_chain_hash(frames: Column, depth: int = 4) -> Column:
    """Hash of up to ``depth`` frames below the top one, each ended by NUL; '' without any."""
    callers = F.slice(frames, 2, depth)
    joined = F.concat(F.array_join(callers, "\0"), F.lit("\0"))
    return F.when(F.size(frames) > 1, F.substring(F.sha2(joined, 256), 1, 16)).otherwise("")


def fingerprint(top: Column, chain: Column, role: Column) -> Column:
    """Identity of a runtime state: 24 hex digits over top frame, caller chain and role."""
    nul = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(F.trim(top), nul, chain, nul, F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown"))), 256), 1, 24)


def simple_name(name: Column) -> Column:
    """The last dotted part, without an argument list."""
    return F.element_at(F.split(F.split_part(name, F.lit("("), F.lit(1)), "\\."), -1)


def package_of(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def suffix_similarity(a: Column, b: Column) -> Column:
    """Shared trailing dotted parts over the longer's number of parts; 0 for an empty name."""
    x, y = F.reverse(F.split(a, "\\.")), F.reverse(F.split(b, "\\."))
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    run = F.array_position(same, False)
    shared = F.when(run == 0, F.least(F.size(x), F.size(y))).otherwise(run - 1)
    return F.when((a == "") | (b == ""), 0.0).otherwise(shared / F.greatest(F.size(x), F.size(y)))


def prefix_locality(package: Column, caller_package: Column) -> Column:
    """Leading dotted parts that both packages share, over the first one's number of parts."""
    x, y = F.split(package, "\\."), F.split(caller_package, "\\.")
    run = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    shared = F.when(run == 0, F.least(F.size(x), F.size(y))).otherwise(run - 1)
    return F.when((package == "") | (caller_package == ""), 0.0).otherwise(shared / F.size(x))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def finding_signature(line: Column) -> Column:
    """A source line up to ``{``, then up to ``=``, unless it starts with it; trimmed."""
    out = trimmed(line)
    for sign in ("{", "="):
        at = F.locate(sign, out)
        out = F.when(at > 1, trimmed(F.substring(out, F.lit(1), at - 1))).otherwise(out)
    return out


def expected_package(path: Column) -> Column:
    """The directory of a path below its source root, dotted."""
    below = F.regexp_replace(path, r"^(.*/)?src/[^/]+/(kotlin|java)/", "")
    return F.translate(F.regexp_extract(below, r"^(.*)/[^/]*$", 1), "/", ".")


def has_token(text: Column, token: str) -> Column:
    """Whether a token stands in a text with no letter, digit or underscore of ASCII beside it; an empty one never does."""
    return text.rlike(rf"(^|[^A-Za-z0-9_]){re.escape(token)}([^A-Za-z0-9_]|$)") if token else F.lit(False)


def accessor_to_path(accessor: Column) -> Column:
    """``someThing`` to ``:some-thing``: a part for each capital but the first sign."""
    return F.concat(F.lit(":"), F.lower(F.regexp_replace(accessor, r"(?<!^)(\p{Lu})", "-$1")))


def accessor_property(name: Column) -> Column:
    """getFoo and setFoo to foo, isFoo stays; null for anything else."""
    bare = F.concat(F.lower(F.substring(name, 4, 1)), F.substring(name, F.lit(5), F.length(name)))
    return F.when(name.rlike("^(get|set)[A-Z]"), bare).when(name.rlike("^is[A-Z]"), name)


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: ``*`` within a part, ``**`` across parts, ``?`` one sign.

    A leading ``/`` anchors at the root, a trailing one takes everything
    below, and a glob without ``/`` matches a name at any depth. Paths are
    matched with a leading ``/``.
    """
    anchored, below = glob.startswith("/"), glob.endswith("/")
    body = glob.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    head = "^/" if anchored or "/" in body else "^(?:.*/)?"
    if head == "^(?:.*/)?":
        head = "^/(?:.*/)?"
    return head + out + ("/.*$" if below else "(?:/.*)?$")


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path lies in a test-data directory or matches a glob; null never does."""
    rooted = F.concat(F.when(path.startswith("/"), "").otherwise("/"), path)
    out = F.lit(False)
    for part in TEST_DATA_DIRS:
        out = out | rooted.contains(part)
    for glob in globs:
        out = out | rooted.rlike(glob_regex(glob))
    return F.coalesce(out, F.lit(False))


def is_test_path(path: Column, also: Iterable[str] = (), instead: Iterable[str] = ()) -> Column:
    """Whether a path holds one of TEST_PATHS or of ``also``; of ``instead`` alone where it is given. Null never does."""
    clean = lambda marks: [m for x in marks if (m := x.strip().replace("\\", "/"))]
    marks = clean(instead) or [*TEST_PATHS, *clean(also)]
    plain = F.translate(path, "\\", "/")
    return F.coalesce(reduce(or_, (plain.contains(m) for m in marks)), F.lit(False))


def redact_path(path: Column) -> Column:
    """Each part of a path as 8 hex digits of its hash; an already redacted or empty part stays."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when((p == "") | p.rlike("^h:[0-9a-f]{8}$"), p).otherwise(F.concat(F.lit("h:"), F.substring(F.sha2(p, 256), 1, 8)))), "/")


def label_rank(kind: str, label: Column) -> Column:
    """Rank of a cost, effort or precision label from 1 on; null if unknown.

    Costs are read in any case and with hyphens, and presets stand for one.
    """
    ranks = {name: i for i, name in enumerate(LABELS[kind], 1)}
    if kind == "cost":
        ranks |= {preset: ranks[cost] for preset, cost in COST_PRESETS.items()}
        label = F.translate(F.lower(label), "-_ ", "")
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), label)


def parse_since(text: Column) -> Column:
    """A date or an RFC 3339 time, with or without a fraction of a second, as timestamp; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")))


def sarif_uri(path: Column) -> Column:
    """A path percent-encoded part by part."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(F.url_encode(p), r"\+", "%20")), "/")


def density_factor(density: Column) -> Column:
    """The factor of an icon density, 0 for an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DENSITIES.items() for x in pair]), density), F.lit(0.0))


def string_body(literal: Column) -> Column:
    """A string literal without its quotes, single or triple."""
    return F.regexp_replace(F.regexp_replace(literal, r'^"""([\s\S]*)"""$', "$1"), r'^"([^"]*)"$', "$1")


def placeholder_secret(value: Column) -> Column:
    """Whether a secret-like value is only a stand-in."""
    return F.lower(value).rlike(r"^(x+|\*+|\.+|<.*>|\$\{.*\}|.*(example|dummy|placeholder|changeme|your[-_]).*)$")


# Types of access keys, by their first four signs.
ACCESS_KEYS = ["AKIA", "ASIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA"]


def secret_kind(body: Column) -> Column:
    """What secret a string literal's body holds: ``aws``, ``jwt``, ``gcp`` or ``bearer``; null for none, a stand-in or a template."""
    body = F.trim(body)
    bearer = F.trim(F.regexp_extract(body, r"^Bearer (.*)$", 1))
    real = lambda c: ~placeholder_secret(c)
    aws = body.rlike(f"^(?:{'|'.join(ACCESS_KEYS)})[A-Z0-9]{{16}}$") & ~body.endswith("EXAMPLE") & real(body)
    jwt = body.rlike(r"^eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$") & real(body)
    gcp = body.contains('"type": "service_account"') | body.startswith("-----BEGIN PRIVATE KEY-----")
    token = bearer.rlike(r"^[^\s$]{16,}$") & real(bearer)
    return F.when(gcp, "gcp").when(aws, "aws").when(jwt, "jwt").when(token, "bearer")
