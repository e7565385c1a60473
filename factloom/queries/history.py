"""Queries over snapshots, commits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import history as H
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        SQL[name] = with_facts(facts, sql)
        return fn

    return add


#: The third and fourth snapshots by time of capture.
_ORDER = "SELECT snapshot_id, row_number() OVER (ORDER BY min(captured_at), snapshot_id) AS seq FROM snaps GROUP BY snapshot_id"


def _at(snaps, seq):
    order = H.snapshot_pairs(snaps)
    nth = order.orderBy("captured_at", "snapshot_id").offset(seq - 1).limit(1)
    return snaps.join(F.broadcast(nth.select("snapshot_id")), "snapshot_id", "left_semi")


def _sql_at(seq, columns):
    return f"SELECT {columns} FROM snaps WHERE snapshot_id = (SELECT snapshot_id FROM ({_ORDER}) WHERE seq = {seq})"


_PER = "module, rule AS metric"
_DIFF = f"""SELECT coalesce(b.module, a.module) AS module, coalesce(b.metric, a.metric) AS metric, coalesce(b.n, 0) AS v_from, coalesce(a.n, 0) AS v_to, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
    FROM ({_sql_at(3, f"{_PER}, count(*) AS n")} GROUP BY module, rule) b FULL JOIN ({_sql_at(4, f"{_PER}, count(*) AS n")} GROUP BY module, rule) a ON b.module = a.module AND b.metric = a.metric"""


def _metrics(snaps):
    return snaps.groupBy("module", F.col("rule").alias("metric")).agg(F.count("*").alias("n"))


def _diff(snaps):
    return H.metric_diff(_metrics(_at(snaps, 3)), _metrics(_at(snaps, 4)), ["module", "metric"], "n")


@query("jo29_metric_diff", "snaps", _DIFF)
def jo29(snaps):
    return _diff(snaps)


@query("jo30_rule_diff", "snaps", f"SELECT coalesce(b.rule, a.rule) AS rule, coalesce(b.n, 0) AS v_from, coalesce(a.n, 0) AS v_to, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM ({_sql_at(1, 'rule, count(*) AS n')} GROUP BY rule) b FULL JOIN ({_sql_at(6, 'rule, count(*) AS n')} GROUP BY rule) a ON a.rule = b.rule")
def jo30(snaps):
    by_rule = lambda s: s.groupBy("rule").agg(F.count("*").alias("n"))
    return H.metric_diff(by_rule(_at(snaps, 1)), by_rule(_at(snaps, 6)), ["rule"], "n")


@query("gr21_gate", "snaps", f"""
    SELECT module, metric, c AS constraint, value, bound FROM (SELECT module, metric, unnest([
        {{'c': 'absolute', 'value': v_to::DOUBLE, 'bound': 20.0::DOUBLE}}, {{'c': 'increase', 'value': delta::DOUBLE, 'bound': 2.0::DOUBLE}},
        {{'c': 'increase_pct', 'value': CASE WHEN v_from <> 0 THEN delta / abs(v_from)::DOUBLE * 100 WHEN delta > 0 THEN 'inf'::DOUBLE ELSE 0 END, 'bound': 50.0::DOUBLE}}], recursive := true)
      FROM ({_DIFF})) WHERE value > bound""")
def gr21(snaps):
    bounds = snaps.select("rule").distinct().select(F.lit("*").alias("module"), F.col("rule").alias("metric"), F.lit(20.0).alias("max_absolute"), F.lit(2.0).alias("max_increase"), F.lit(50.0).alias("max_increase_pct"))
    return H.gate(_diff(snaps), bounds)


@query("sc21_percent_change", "snaps", f"SELECT module, metric, round(CASE WHEN v_from <> 0 THEN delta / abs(v_from)::DOUBLE * 100 WHEN delta > 0 THEN 1e18 ELSE 0 END, 6) AS pct FROM ({_DIFF})")
def sc21(snaps):
    return _diff(snaps).select("module", "metric", F.round(F.least(F.lit(1e18), H.percent_change(F.col("v_from"), F.col("v_to"))), 6).alias("pct"))


@query("ag19_churn", "commits", "SELECT file, count(DISTINCT commit_sha) AS churn FROM commits GROUP BY file")
def ag19(commits):
    return H.churn(commits)


_COMPLEXITY = "SELECT file, sum(arity)::BIGINT AS complexity FROM symbols GROUP BY file"


def _complexity(symbols):
    return symbols.groupBy("file").agg(F.sum("arity").cast("bigint").alias("complexity"))


@query("jo24_risk_map", "commits symbols", f"SELECT c.file, churn, complexity, churn * complexity AS risk FROM (SELECT file, count(DISTINCT commit_sha) AS churn FROM commits GROUP BY file) c JOIN ({_COMPLEXITY}) x ON x.file = c.file")
def jo24(commits, symbols):
    return H.risk_map(commits, _complexity(symbols))


@query("so6_risk_order", "commits symbols", f"SELECT c.file, churn, complexity, churn * complexity AS risk FROM (SELECT file, count(DISTINCT commit_sha) AS churn FROM commits GROUP BY file) c JOIN ({_COMPLEXITY}) x ON x.file = c.file ORDER BY risk DESC, churn DESC, c.file LIMIT 25")
def so6(commits, symbols):
    return H.risk_map(commits, _complexity(symbols)).limit(25)


@query("ag14_file_rollup", "found", "SELECT file, count(*) AS findings, count(DISTINCT rule) AS rules, max(line) AS last_line FROM found GROUP BY file")
def ag14(found):
    return found.groupBy("file").agg(F.count("*").alias("findings"), F.countDistinct("rule").alias("rules"), F.max("line").alias("last_line"))


@query("ag15_module_rollup", "files modules module_edges", """
    SELECT m.path AS module, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, coalesce(bytes, 0) AS bytes, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
    FROM modules m LEFT JOIN (SELECT module, count(*) AS files, sum(loc)::BIGINT AS loc, sum(bytes)::BIGINT AS bytes FROM files GROUP BY module) f ON f.module = m.path
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS fan_in FROM module_edges GROUP BY dst) i ON i.dst = m.path
    LEFT JOIN (SELECT src, count(DISTINCT dst) AS fan_out FROM module_edges GROUP BY src) o ON o.src = m.path""")
def ag15(files, modules, module_edges):
    return H.module_rollup(files, modules, module_edges)


@query("ag16_repo_rollup", "files", "SELECT count(DISTINCT module) AS modules, count(*) AS files, sum(loc)::BIGINT AS loc, sum(bytes)::BIGINT AS bytes FROM files")
def ag16(files):
    return H.repo_rollup(files)


@query("ag13_scorecard", "files modules refs", """
    SELECT m.path AS module, coalesce(main_loc, 0) AS main_loc, coalesce(round(test_loc::DOUBLE / nullif(main_loc, 0)::DOUBLE, 6), 0.0) AS test_ratio, coalesce(n, 0) AS findings,
           coalesce(round((coalesce(n, 0) * 1000)::DOUBLE / nullif(main_loc, 0)::DOUBLE, 6), 0.0) AS per_kloc
    FROM modules m LEFT JOIN (SELECT module, coalesce(sum(loc) FILTER (WHERE NOT is_test), 0)::BIGINT AS main_loc, coalesce(sum(loc) FILTER (WHERE is_test), 0)::BIGINT AS test_loc FROM files GROUP BY module) f ON f.module = m.path
    LEFT JOIN (SELECT module, count(*) AS n FROM refs WHERE in_comment GROUP BY module) r ON r.module = m.path""")
def ag13(files, modules, refs):
    return H.scorecard(files, modules, refs.where("in_comment").groupBy("module").agg(F.count("*").alias("findings")))


@query("wi1_history_delta", "snaps", "SELECT rule, snapshot_id, n, n - coalesce(lag(n) OVER (PARTITION BY rule ORDER BY captured_at, snapshot_id), n) AS delta FROM (SELECT rule, snapshot_id, captured_at, count(*) AS n FROM snaps GROUP BY ALL)")
def wi1(snaps):
    counts = snaps.groupBy("rule", "snapshot_id", "captured_at").agg(F.count("*").alias("n"))
    return H.history_delta(counts, "rule", ["captured_at", "snapshot_id"], "n").select("rule", "snapshot_id", "n", "delta")


@query("wi2_timeline", "snaps", "SELECT snapshot_id, captured_at, module, count(*) AS n FROM snaps GROUP BY ALL")
def wi2(snaps):
    return H.timeline(snaps, F.col("module"), "module")


@query("wi4_snapshot_pairs", "snaps", "SELECT snapshot_id, captured_at, lag(snapshot_id) OVER (ORDER BY captured_at, snapshot_id) AS parent FROM (SELECT snapshot_id, min(captured_at) AS captured_at FROM snaps GROUP BY 1)")
def wi4(snaps):
    return H.snapshot_pairs(snaps)


@query("wi5_parent_map", "snaps", "SELECT parent, snapshot_id FROM (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY captured_at, snapshot_id) AS parent FROM (SELECT snapshot_id, min(captured_at) AS captured_at FROM snaps GROUP BY 1)) WHERE parent IS NOT NULL")
def wi5(snaps):
    return H.snapshot_pairs(snaps).where("parent IS NOT NULL").select("parent", "snapshot_id")


@query("wi7_first_event", "breakages", "SELECT commit_sha, occurred_at, signature FROM (SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY occurred_at, signature) AS r FROM breakages) WHERE r = 1")
def wi7(breakages):
    return breakages.groupBy("commit_sha").agg(F.min(F.struct("occurred_at", "signature")).alias("e")).select("commit_sha", "e.*")


@query("wi10_dense_ranks", "found", "SELECT rule, dense_rank() OVER (ORDER BY rule)::INT AS rank FROM (SELECT DISTINCT rule FROM found)")
def wi10(found):
    from pyspark.sql.window import Window

    return found.select("rule").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("rule")))


@query("wi12_share_of_parent", "runtime", "SELECT source_id, frame, total, round(total / sum(total) OVER (PARTITION BY source_id), 6) AS share FROM (SELECT source_id, frame, round(sum(value), 2) AS total FROM runtime GROUP BY ALL)")
def wi12(runtime):
    sums = runtime.groupBy("source_id", "frame").agg(F.round(F.sum("value"), 2).alias("total"))
    return H.share_of_parent(sums, "source_id", "total").withColumn("share", F.round("share", 6))


@query("se3_file_bag_diff", "snaps", f"SELECT file, change FROM ({_sql_at(1, 'file')} AND file NOT IN ({_sql_at(2, 'file')})) t, (SELECT 'removed' AS change) UNION ALL SELECT file, 'added' FROM ({_sql_at(2, 'file')} AND file NOT IN ({_sql_at(1, 'file')}))")
def se3(snaps):
    return H.bag_diff(_at(snaps, 1), _at(snaps, 2), ["file"])


@query("se4_symbol_bag_diff", "snaps", f"SELECT rule, message, 'removed' AS change FROM ({_sql_at(1, 'rule, message')}) b WHERE NOT EXISTS (SELECT 1 FROM ({_sql_at(2, 'rule, message')}) a WHERE a.rule = b.rule AND a.message = b.message) UNION ALL SELECT rule, message, 'added' FROM ({_sql_at(2, 'rule, message')}) b WHERE NOT EXISTS (SELECT 1 FROM ({_sql_at(1, 'rule, message')}) a WHERE a.rule = b.rule AND a.message = b.message)")
def se4(snaps):
    return H.bag_diff(_at(snaps, 1), _at(snaps, 2), ["rule", "message"])


@query("se5_module_set_diff", "snaps", f"(SELECT module, rule, 'removed' AS change FROM ({_sql_at(1, 'module, rule')} EXCEPT {_sql_at(6, 'module, rule')})) UNION ALL (SELECT module, rule, 'added' FROM ({_sql_at(6, 'module, rule')} EXCEPT {_sql_at(1, 'module, rule')}))")
def se5(snaps):
    return H.set_diff(_at(snaps, 1), _at(snaps, 6), ["module", "rule"])


@query("se6_edge_set_diff", "module_edges", "SELECT src, dst, 'removed' AS change FROM (SELECT src, dst FROM module_edges WHERE configuration = 'api' EXCEPT SELECT src, dst FROM module_edges WHERE configuration <> 'api') UNION ALL SELECT src, dst, 'added' FROM (SELECT src, dst FROM module_edges WHERE configuration <> 'api' EXCEPT SELECT src, dst FROM module_edges WHERE configuration = 'api')")
def se6(module_edges):
    return H.set_diff(module_edges.where("configuration = 'api'"), module_edges.where("configuration <> 'api'"), ["src", "dst"])


@query("se7_surface_diff", "symbols", "SELECT kind, name, 'removed' AS change FROM (SELECT kind, name FROM symbols WHERE visibility = 'public' EXCEPT SELECT kind, name FROM symbols WHERE visibility = 'internal') UNION ALL SELECT kind, name, 'added' FROM (SELECT kind, name FROM symbols WHERE visibility = 'internal' EXCEPT SELECT kind, name FROM symbols WHERE visibility = 'public')")
def se7(symbols):
    return H.set_diff(symbols.where("visibility = 'public'"), symbols.where("visibility = 'internal'"), ["kind", "name"])


@query("se12_touched_modules", "snaps module_edges", f"SELECT DISTINCT module FROM (SELECT module FROM ({_sql_at(3, 'module, file')} EXCEPT {_sql_at(4, 'module, file')}) UNION ALL SELECT module FROM ({_sql_at(4, 'module, file')} EXCEPT {_sql_at(3, 'module, file')}) UNION ALL SELECT src FROM module_edges UNION ALL SELECT module FROM ({_DIFF}))")
def se12(snaps, module_edges):
    files = H.set_diff(_at(snaps, 3), _at(snaps, 4), ["module", "file"])
    return H.touched_modules(files, module_edges, _diff(snaps))


@query("gr18_delta_cosine", "commits symbols", """
    SELECT i AS author, round(max(dot / (n * m)), 6) AS score FROM (
      SELECT a.author AS i, b.author AS s, sum(a.v * b.v) AS dot FROM (SELECT author, file, (count(*) - 25)::DOUBLE AS v FROM commits GROUP BY ALL HAVING v <> 0) a
        JOIN (SELECT author, file, (count(*) - 25)::DOUBLE AS v FROM commits WHERE author IN ('dev1', 'dev2') GROUP BY ALL HAVING v <> 0) b ON a.file = b.file AND a.author <> b.author GROUP BY ALL)
      JOIN (SELECT author AS i, sqrt(sum(v * v)) AS n FROM (SELECT author, file, (count(*) - 25)::DOUBLE AS v FROM commits GROUP BY ALL) GROUP BY ALL) USING (i)
      JOIN (SELECT author AS s, sqrt(sum(v * v)) AS m FROM (SELECT author, file, (count(*) - 25)::DOUBLE AS v FROM commits GROUP BY ALL) GROUP BY ALL) USING (s)
    WHERE dot > 0 GROUP BY i""")
def gr18(commits, symbols):
    deltas = commits.groupBy("author", "file").agg((F.count("*") - 25).alias("v"))
    seeds = commits.where(F.col("author").isin("dev1", "dev2")).select("author")
    return H.delta_cosine(deltas, "author", "file", "v", seeds).withColumn("score", F.round("score", 6))


_SIGNALS = "SELECT commit_sha, nullif(module, ':m7') AS module, CASE failure_kind WHEN 'kind0' THEN 'stack' WHEN 'kind1' THEN 'diff' ELSE 'history' END AS tier, CASE failure_kind WHEN 'kind0' THEN 0.95 WHEN 'kind1' THEN 0.6 ELSE 0.5 END::DOUBLE AS prior FROM breakages"


@query("ag23_bisect_fusion", "breakages", f"SELECT commit_sha, module, max(prior) AS prior, count(DISTINCT tier) AS tiers, round(least(1.0, max(prior) + (1 - max(prior)) * (count(DISTINCT tier) - 1) / 3), 6) AS confidence FROM ({_SIGNALS}) WHERE module <> '' GROUP BY ALL")
def ag23(breakages):
    tier = F.element_at(F.create_map(*[F.lit(x) for x in ("kind0", "stack", "kind1", "diff", "kind2", "history")]), F.col("failure_kind"))
    return H.bisect_fusion(breakages.select("commit_sha", F.nullif("module", F.lit(":m7")).alias("module"), tier.alias("tier"))).withColumn("confidence", F.round("confidence", 6))


def gr19(spark, sf_dir):
    """Failures located by all four tiers, with snapshots, symbols and events from the driver's tables."""
    breakages, symbols, commits = (fact(spark, sf_dir, n) for n in ("failures", "symbols", "commits"))
    files = symbols.groupBy(F.col("file").alias("path")).agg(F.min("module").alias("module"))
    touched = commits.join(files, F.col("file") == F.col("path")).groupBy("module").agg(F.max_by("commit_sha", F.struct("committed_at", "commit_sha")).alias("commit_sha"))
    modules = fact(spark, sf_dir, "modules").select("path", "dir")
    return H.structural_bisect(breakages, symbols, files, modules, touched).select("event_id", "commit_sha", "module", "tiers", F.round("confidence", 6).alias("confidence"))


QUERIES["gr19_structural_bisect"] = gr19
SQL["gr19_structural_bisect"] = with_facts("failures symbols commits modules", """{rec},
    f AS (SELECT file AS path, min(module) AS module FROM symbols GROUP BY 1),
    y AS (SELECT fqn, max_by(file, struct_pack(a := file, b := start_byte)) AS file FROM symbols GROUP BY fqn),
    fr AS (SELECT event_id, commit_sha, unnest(frames) AS frame, generate_subscripts(frames, 1) AS pos FROM failures),
    cl AS (SELECT event_id, commit_sha, pos, string_split(trim(split_part(trim(frame), '(', 1)), '.') AS parts FROM fr),
    st AS (SELECT event_id, commit_sha, pos, k, array_to_string(parts[1:len(parts) - k], '.') AS fqn FROM cl, range(0, 6) t(k) WHERE k < len(parts)),
    hit AS (SELECT event_id, commit_sha, min_by(file, pos * 10 + k) AS path FROM st JOIN y USING (fqn) GROUP BY ALL),
    inferred AS (SELECT event_id, min(m.path) AS module FROM failures e JOIN modules m ON instr(e.file, '/src/test/') > 1 AND (m.dir = split_part(e.file, '/src/test/', 1)) GROUP BY 1),
    s AS (SELECT event_id, commit_sha, module, 'stack' AS tier FROM hit JOIN f USING (path)
      UNION ALL SELECT event_id, commit_sha, coalesce(f.module, i.module), 'owner' FROM failures e LEFT JOIN f ON f.path = e.file LEFT JOIN inferred i USING (event_id)
      UNION ALL SELECT event_id, t.commit_sha, t.module, 'diff' FROM failures e JOIN (SELECT f.module, max_by(commit_sha, struct_pack(a := committed_at, b := commit_sha)) AS commit_sha FROM commits c JOIN f ON f.path = c.file GROUP BY 1) t ON t.commit_sha = e.commit_sha
      UNION ALL SELECT e.event_id, e.commit_sha, h.module, 'history' FROM failures e JOIN (SELECT DISTINCT event_id, module, signature FROM failures WHERE module <> '') h ON h.signature = e.signature AND h.event_id <> e.event_id
      UNION ALL SELECT e.event_id, e.commit_sha, h.module, 'history' FROM failures e JOIN (SELECT failure_kind, module, min(event_id) AS a, max(event_id) AS b FROM failures WHERE module <> '' GROUP BY ALL) h ON h.failure_kind = e.failure_kind AND NOT (h.a = e.event_id AND h.b = e.event_id)),
    p AS (SELECT *, CASE tier WHEN 'stack' THEN 0.95 WHEN 'owner' THEN 0.85 WHEN 'diff' THEN 0.6 ELSE 0.5 END::DOUBLE AS prior FROM s WHERE module <> '')
    SELECT event_id, commit_sha, module, count(DISTINCT tier) AS tiers, round(least(1.0, max(prior) + (1 - max(prior)) * (count(DISTINCT tier) - 1) / 3), 6) AS confidence FROM p GROUP BY event_id, commit_sha, module""")


@query("ag24_majority", "files", "SELECT language, n FROM (SELECT language, count(*) AS n, count(*) OVER () AS d FROM files GROUP BY language) WHERE d >= 2 ORDER BY n DESC, language LIMIT 1")
def ag24(files):
    return H.majority(files, "language")


@query("ag25_below_maximum", "modules files", "SELECT module, loc, top FROM (SELECT module, max(loc) AS loc, max(max(loc)) OVER () AS top FROM files GROUP BY module) WHERE loc < top")
def ag25(modules, files):
    return H.below_maximum(files.groupBy("module").agg(F.max("loc").alias("loc")), "module", "loc")


@query("ag26_duplicate_aliases", "symbols", "SELECT signature, fqn, start_byte FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY line, start_byte) AS r FROM symbols) WHERE r > 1")
def ag26(symbols):
    return H.all_but_first(symbols, "signature", ["line", "start_byte"]).select("signature", "fqn", "start_byte")


@query("ag29_percentile", "runtime", "SELECT source_id, value FROM (SELECT source_id, value, row_number() OVER (PARTITION BY source_id ORDER BY value) AS r, count(*) OVER (PARTITION BY source_id) AS n FROM runtime) WHERE r = floor((n - 1) * 0.95) + 1")
def ag29(runtime):
    return H.lower_percentile(runtime, ["source_id"], "value", 0.95)


@query("ag30_rule_stats", "runtime", "SELECT frame, count(*) AS calls, round(sum(value), 2) AS total FROM runtime GROUP BY frame")
def ag30(runtime):
    return runtime.groupBy("frame").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"))


@query("ag31_perf_summary", "runtime", "SELECT frame || '/' || source_id AS name, round(sum(value), 2) AS ms FROM runtime GROUP BY 1 ORDER BY ms DESC, name LIMIT 10")
def ag31(runtime):
    return runtime.groupBy(F.concat_ws("/", "frame", "source_id").alias("name")).agg(F.round(F.sum("value"), 2).alias("ms")).orderBy(F.desc("ms"), "name").limit(10)


@query("ag33_surface_hash", "symbols", "SELECT module, sha256(string_agg(DISTINCT signature, chr(10) ORDER BY signature)) AS hash FROM symbols GROUP BY module")
def ag33(symbols):
    return H.surface_hash(symbols, ["module"], "signature")


@query("ag36_experiment_matrix", "runtime", "SELECT frame AS case, role AS target, count(*) AS runs, min(ms) AS min_ms, max(ms) AS max_ms, floor(sum(ms) / count(*))::BIGINT AS mean_ms FROM (SELECT *, (value * 100)::BIGINT AS ms FROM runtime) GROUP BY ALL")
def ag36(runtime):
    return H.experiment_matrix(runtime.select(F.col("frame").alias("case"), F.col("role").alias("target"), F.round(F.col("value") * 100).cast("bigint").alias("ms")))


@query("ag38_changelog", "symbols", "SELECT kind, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM symbols WHERE is_main GROUP BY kind")
def ag38(symbols):
    return symbols.where("is_main").groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("so10_lru_evict", "commits", """
    SELECT key, bytes, used_at FROM (SELECT *, sum(bytes) OVER (ORDER BY date_trunc('hour', used_at) DESC, used_at DESC, key DESC ROWS UNBOUNDED PRECEDING) AS s, sum(bytes) OVER () AS a
      FROM (SELECT commit_sha AS key, count(*) AS bytes, max(committed_at) AS used_at FROM commits GROUP BY commit_sha)) WHERE a > 30000 AND s > 30000 * 0.8""")
def so10(commits):
    return H.lru_evict(commits.groupBy(F.col("commit_sha").alias("key")).agg(F.count("*").alias("bytes"), F.max("committed_at").alias("used_at")), 30000)


@query("so11_retention", "snaps", "SELECT snapshot_id, CASE snapshot_id % 3 WHEN 0 THEN true WHEN 1 THEN captured_at + INTERVAL 30 DAY >= TIMESTAMP '2026-03-20 12:00:00' ELSE captured_at + INTERVAL 7 DAY >= TIMESTAMP '2026-03-20 12:00:00' END AS keep FROM (SELECT snapshot_id, min(captured_at) AS captured_at FROM snaps GROUP BY 1)")
def so11(snaps):
    reach = F.when(F.col("snapshot_id") % 3 == 0, "permanent").when(F.col("snapshot_id") % 3 == 1, "ref").otherwise("orphan")
    return H.retention(H.snapshot_pairs(snaps).withColumn("reach", reach), F.lit("2026-03-20 12:00:00"))


@query("gr22_rule_history", "snaps", "SELECT snapshot_id, rule, count(*) AS n FROM snaps GROUP BY ALL")
def gr22(snaps):
    return snaps.groupBy("snapshot_id", "rule").agg(F.count("*").alias("n"))
