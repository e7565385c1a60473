"""Queries over runtime traces and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import traces as T
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        SQL[name] = with_facts(facts, sql)
        return fn

    return add


def _events(runtime):
    return runtime.withColumn("frames", F.array("frame", F.concat(F.lit("dev.caller.C"), F.col("source_id"))))


_CHAIN = "substr(sha256('dev.caller.C' || source_id || chr(0)), 1, 16)"
_FP = f"substr(sha256(trim(frame) || chr(0) || {_CHAIN} || chr(0) || role), 1, 24)"
_F = f"SELECT *, {_FP} AS fp FROM runtime"


@query("sc2_fingerprint", "runtime", f"SELECT fp, frame AS top, role, count(*) AS n FROM ({_F}) GROUP BY ALL")
def sc2(runtime):
    return T.fingerprinted(_events(runtime)).groupBy("fp", "top", "role").agg(F.count("*").alias("n"))


@query("ag20_reduce_states", "runtime", f"SELECT fp, frame AS top, role, count(*) AS n, coalesce(min(timestamp_ns) FILTER (WHERE timestamp_ns > 0), 0) AS first_ns, coalesce(max(timestamp_ns) FILTER (WHERE timestamp_ns > 0), 0) AS last_ns, count(DISTINCT source_id) AS sources FROM ({_F}) GROUP BY ALL")
def ag20(runtime):
    return T.reduce_states(_events(runtime))


_TRANS = f"SELECT source_id, lag(fp) OVER (PARTITION BY source_id ORDER BY pos) AS from_fp, fp AS to_fp FROM ({_F})"


@query("ag21_transitions", "runtime", f"SELECT from_fp, to_fp, count(*) AS n FROM ({_TRANS}) WHERE from_fp <> to_fp GROUP BY ALL")
def ag21(runtime):
    return T.transitions(_events(runtime))


@query("wi3_transition_rows", "runtime", f"SELECT source_id, from_fp, to_fp FROM ({_TRANS}) WHERE from_fp <> to_fp")
def wi3(runtime):
    return T.observed_transitions(_events(runtime))


@query("ag22_merge_states", "runtime", f"SELECT fp, count(*) AS n, coalesce(min(timestamp_ns) FILTER (WHERE timestamp_ns > 0), 0) AS first_ns, coalesce(max(timestamp_ns) FILTER (WHERE timestamp_ns > 0), 0) AS last_ns FROM ({_F}) GROUP BY fp")
def ag22(runtime):
    e = _events(runtime)
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    keep = ["fp", "n", "first_ns", "last_ns"]
    return T.merge_states(T.reduce_states(e.where(half)).select(keep), T.reduce_states(e.where(~half)).select(keep))


_SHORT = "SELECT source_id, lag(frame) OVER (PARTITION BY source_id ORDER BY pos) AS from_fp, frame AS to_fp FROM runtime"


@query("se8_divergence", "runtime", f"SELECT DISTINCT from_fp, to_fp FROM ({_TRANS}) t WHERE from_fp <> to_fp AND source_id IN ('u2', 'u4') AND NOT EXISTS (SELECT 1 FROM ({_TRANS}) o WHERE o.source_id IN ('u6', 'u8') AND o.from_fp = t.from_fp AND o.to_fp = t.to_fp)")
def se8(runtime):
    return T.divergence(T.observed_transitions(_events(runtime)), ["u2", "u4"], ["u6", "u8"])


_STATES = "SELECT DISTINCT name AS fp, CASE WHEN contains(name, '.') THEN name ELSE 'dev.p7.' || name END AS top, 'dev.p9.X' AS caller FROM refs"
_KNOWN = "SELECT DISTINCT fqn, name FROM symbols"
_SIM = """list_sum([CASE WHEN list_reverse(string_split(top, '.'))[1:i] = list_reverse(string_split(candidate, '.'))[1:i] THEN 1 ELSE 0 END FOR i IN range(1, least(len(string_split(top, '.')), len(string_split(candidate, '.'))) + 1)])
    / greatest(len(string_split(top, '.')), len(string_split(candidate, '.')))"""
_NEAR = "list_sum([CASE WHEN string_split(regexp_extract(candidate, '^(.*)[.][^.]*$', 1), '.')[1:i] = string_split('dev.p9', '.')[1:i] THEN 1 ELSE 0 END FOR i IN range(1, 3)]) / len(string_split(regexp_extract(candidate, '^(.*)[.][^.]*$', 1), '.'))"
_RECONCILED = f"""SELECT fp, 'exact' AS how, top AS fqn, 1.0::DOUBLE AS confidence FROM ({_STATES}) WHERE top IN (SELECT fqn FROM symbols)
    UNION ALL SELECT fp, CASE WHEN candidate IS NULL THEN 'unresolved' WHEN n = 1 THEN 'exact' ELSE 'fuzzy' END, candidate,
      CASE WHEN candidate IS NULL THEN NULL WHEN n = 1 THEN 1.0 WHEN {_NEAR} > 0 THEN least(1.0, {_SIM} * 0.5 + {_NEAR} * 0.5 + 0.1) ELSE {_SIM} END
    FROM (SELECT * FROM ({_STATES}) WHERE top NOT IN (SELECT fqn FROM symbols)) s
    LEFT JOIN (SELECT name AS leaf, fqn AS candidate, count(*) OVER (PARTITION BY name) AS n FROM ({_KNOWN})) k ON k.leaf = regexp_extract(s.top, '([^.]*)$', 1)"""


def _states(refs):
    top = F.when(F.col("name").contains("."), F.col("name")).otherwise(F.concat(F.lit("dev.p7."), F.col("name")))
    return refs.select(F.col("name").alias("fp"), top.alias("top"), F.lit("dev.p9.X").alias("caller")).distinct()


@query("jo25_reconcile", "refs symbols", f"SELECT fp, how, fqn, round(confidence, 6) AS confidence FROM ({_RECONCILED})")
def jo25(refs, symbols):
    return T.reconcile(_states(refs), symbols).withColumn("confidence", F.round("confidence", 6))


@query("wi9_best_candidate", "refs symbols", f"SELECT fp, how, fqn FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY confidence DESC NULLS LAST, fqn) AS r FROM ({_RECONCILED})) WHERE r = 1")
def wi9(refs, symbols):
    return T.best_candidates(T.reconcile(_states(refs), symbols)).select("fp", "how", "fqn")


@query("jo26_orphan_symbols", "refs symbols", f"SELECT DISTINCT fqn FROM symbols WHERE fqn NOT IN (SELECT fqn FROM ({_RECONCILED}) WHERE how = 'exact')")
def jo26(refs, symbols):
    return T.orphan_symbols(symbols, T.reconcile(_states(refs), symbols))


@query("jo27_phantom_states", "refs symbols", f"{{rec}}, seen AS (SELECT CASE WHEN in_comment THEN name || 'Gone' ELSE name END AS name FROM refs) SELECT name AS fp, count(*) AS n FROM seen WHERE name IN (SELECT fp FROM ({_RECONCILED.replace('FROM refs', 'FROM seen')}) WHERE how = 'unresolved') GROUP BY name")
def jo27(refs, symbols):
    """Names in comments stand for states whose code is gone."""
    seen = refs.select(F.when(F.col("in_comment"), F.concat("name", F.lit("Gone"))).otherwise(F.col("name")).alias("name"))
    counts = seen.groupBy(F.col("name").alias("fp")).agg(F.count("*").alias("n"))
    return T.phantom_states(counts, T.reconcile(_states(seen), symbols))


@query("gr20_match_frames", "refs symbols", f"""
    SELECT frame, CASE WHEN e IS NOT NULL THEN e WHEN b IS NOT NULL THEN b ELSE p END AS fqn, CASE WHEN e IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'simple' ELSE 'prefix' END AS how FROM (
      SELECT frame, (SELECT min(fqn) FROM symbols WHERE fqn = frame) AS e, (SELECT min(fqn) FROM symbols WHERE name = regexp_extract(frame, '([^.]*)$', 1)) AS b,
        (SELECT max_by(fqn, length(fqn)) FROM symbols WHERE starts_with(frame, fqn || '.')) AS p
      FROM (SELECT DISTINCT CASE WHEN contains(name, '.') THEN name || '.run' ELSE name END AS frame FROM refs)) WHERE e IS NOT NULL OR b IS NOT NULL OR p IS NOT NULL""")
def gr20(refs, symbols):
    frames = refs.select(F.when(F.col("name").contains("."), F.concat(F.col("name"), F.lit(".run"))).otherwise(F.col("name")).alias("frame"))
    return T.match_frames(frames, symbols)


_NORM = "trim(lower(regexp_replace(regexp_replace(regexp_replace(signature, '0x[0-9a-fA-F]+', '<addr>', 'g'), '[0-9]{3,}', '<n>', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')))"


@query("sc1_normalize_signature", "breakages", f"SELECT {_NORM} AS signature, count(*) AS n FROM breakages GROUP BY 1")
def sc1(breakages):
    return breakages.groupBy(S.normalize_signature(F.col("signature")).alias("signature")).agg(F.count("*").alias("n"))


@query("se10_event_ledger", "breakages", f"SELECT id, min(occurred_at) AS first_at, count(*) AS delivered FROM (SELECT *, substr(sha256(failure_kind || chr(0) || {_NORM} || chr(0) || commit_sha || chr(0) || source), 1, 16) AS id FROM breakages) GROUP BY id")
def se10(breakages):
    keyed = breakages.withColumn("id", S.event_id(F.col("failure_kind"), S.normalize_signature(F.col("signature")), F.col("commit_sha"), F.col("source")))
    return keyed.groupBy("id").agg(F.min("occurred_at").alias("first_at"), F.count("*").alias("delivered"))


@query("sc3_simple_name", "symbols", "SELECT DISTINCT fqn, regexp_extract(split_part(fqn, '(', 1), '([^.]*)$', 1) AS simple, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols")
def sc3(symbols):
    return symbols.select("fqn", S.simple_name(F.col("fqn")).alias("simple"), S.package_of(F.col("fqn")).alias("package")).distinct()


@query("sc4_suffix_similarity", "refs symbols", f"SELECT top, candidate, round({_SIM}, 6) AS sim FROM (SELECT DISTINCT r.name AS top, s.fqn AS candidate FROM refs r JOIN symbols s ON s.name = regexp_extract(r.name, '([^.]*)$', 1) WHERE contains(r.name, '.'))")
def sc4(refs, symbols):
    named = refs.where(F.col("name").contains(".")).select(F.col("name").alias("top")).distinct()
    pairs = named.join(symbols.select(F.col("fqn").alias("candidate"), F.col("name").alias("leaf")).distinct(), F.col("leaf") == S.simple_name(F.col("top")))
    return pairs.select("top", "candidate", F.round(S.suffix_similarity(F.col("top"), F.col("candidate")), 6).alias("sim"))
