"""Queries of the co-occurrence engine with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence as c
from ..operators.components import connected_components
from ..operators.pairs import summarise
from ..session import table
from .links import time_sql


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_records")


def _met(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder)
    return c.meetings(c.memberships(r), c.projects(r))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = c.metrics(c.memberships(_records(spark, folder)))
    return out.withColumns({x: F.round(x, 6) for x in ("jaccard", "lift", "pmi")})


def groups(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder)
    return c.groups(c.pair_features(r), c.memberships(r))


def relation_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components over recorded historical relations."""
    rows = _records(spark, folder).where("record_type = 'historical_relation'")
    return connected_components(rows, "bidder_id", "related_bidder_id")


def graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the global graph: bidder in project, and bidder pairs with a score of medium or more."""
    r = _records(spark, folder)
    part = c.memberships(r).select(F.lit("participates").alias("kind"), F.col("bidder_id").alias("source"), F.col("project_id").alias("target"), F.lit(1).cast("bigint").alias("weight"))
    pairs = c.pair_features(r).where("level in ('high', 'medium')").select(F.lit("cooccurrence_anomaly").alias("kind"), F.col("bidder_a").alias("source"), F.col("bidder_b").alias("target"), F.col("score").alias("weight"))
    return part.unionByName(pairs)


QUERIES = {
    "cooc_memberships": lambda s, d: c.memberships(_records(s, d)),
    "cooc_projects": lambda s, d: c.projects(_records(s, d)),
    "cooc_metrics": metrics,
    "cooc_longest_runs": lambda s, d: c.longest_runs(_met(s, d)),
    "cooc_outcomes": lambda s, d: c.outcomes(_met(s, d)),
    "cooc_same_agency": lambda s, d: c.same_agency(_met(s, d)),
    "cooc_shared_identifiers": lambda s, d: c.shared_identifiers(_records(s, d)),
    "cooc_status": lambda s, d: c.pair_status(_records(s, d)),
    "cooc_summary": lambda s, d: summarise(c.pair_status(_records(s, d))),
    "cooc_features": lambda s, d: c.pair_features(_records(s, d)),
    "cooc_groups": groups,
    "cooc_relation_components": relation_components,
    "cooc_graph": graph,
}

_BOTH = r"regexp_matches(project_id, '\S') AND regexp_matches(bidder_id, '\S')"
_TIME = "coalesce(" + ", ".join(time_sql(x) for x in ("event_time", "uploaded_at", "created_at", "modified_at")) + ")"
_EXTRA = "\n UNION ALL ".join(
    f"SELECT bidder_id, coalesce(project_id, ''), '{s}', extra['{k}'] FROM audit_records"
    for s, keys in (("shared_contact", c.CONTACT_KEYS), ("shared_address", c.ADDRESS_KEYS))
    for k in keys
)
BASE = f"""
WITH RECURSIVE m AS (SELECT project_id, bidder_id, bool_or(is_winner) AS winner, min(CASE WHEN bid_rank > 0 THEN bid_rank END) AS rank FROM audit_records WHERE {_BOTH} GROUP BY ALL),
p AS (SELECT project_id, min({_TIME}) AS time, min(CASE WHEN regexp_matches(agency_id, '\\S') THEN agency_id END) AS agency FROM audit_records WHERE regexp_matches(project_id, '\\S') GROUP BY ALL),
mt AS (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.winner AS winner_a, y.winner AS winner_b, time, agency
  FROM m x JOIN m y ON x.project_id = y.project_id AND x.bidder_id < y.bidder_id JOIN p ON p.project_id = x.project_id),
n AS (SELECT bidder_id, count(*) AS n FROM m GROUP BY ALL),
k AS (SELECT *, together / (n_a + n_b - together) AS jaccard, together * np / (n_a * n_b) AS lift, log2(together * np / (n_a * n_b)) AS pmi FROM (
  SELECT bidder_a, bidder_b, count(*) AS together, any_value(a.n) AS n_a, any_value(b.n) AS n_b, (SELECT count(DISTINCT project_id) FROM m) AS np
  FROM mt JOIN n a ON a.bidder_id = bidder_a JOIN n b ON b.bidder_id = bidder_b GROUP BY ALL)),
rs AS (SELECT *, CASE WHEN floor((epoch(time) - epoch(lag(time) OVER w)) / 86400) <= 180 THEN 0 ELSE 1 END AS fresh FROM mt WHERE time IS NOT NULL WINDOW w AS (PARTITION BY bidder_a, bidder_b ORDER BY time, project_id)),
lr AS (SELECT bidder_a, bidder_b, max(n) AS longest_run FROM (SELECT bidder_a, bidder_b, run, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY bidder_a, bidder_b ORDER BY time, project_id) AS run FROM rs) GROUP BY ALL) GROUP BY ALL),
dc AS (SELECT *, CASE WHEN winner_a THEN bidder_a ELSE bidder_b END AS winner FROM mt WHERE (winner_a AND NOT winner_b) OR (winner_b AND NOT winner_a)),
ow AS (SELECT bidder_a, bidder_b, count(*) AS both_known FROM mt WHERE winner_a IS NOT NULL AND winner_b IS NOT NULL GROUP BY ALL),
od AS (SELECT bidder_a, bidder_b, count(*) AS decided, count(*) FILTER (ch) AS switches FROM (
  SELECT *, lag(winner) OVER (PARTITION BY bidder_a, bidder_b ORDER BY time NULLS LAST, project_id) <> winner AS ch FROM dc) GROUP BY ALL),
oc AS (SELECT bidder_a, bidder_b, both_known, coalesce(decided, 0) AS decided, coalesce(switches, 0) AS switches FROM ow LEFT JOIN od USING (bidder_a, bidder_b)),
sa AS (SELECT bidder_a, bidder_b, max(n) AS one_agency, sum(n)::BIGINT AS any_agency FROM (SELECT bidder_a, bidder_b, agency, count(*) AS n FROM mt WHERE agency IS NOT NULL GROUP BY ALL) GROUP BY ALL),
iv(bidder_id, project_id, signal_type, value) AS (SELECT bidder_id, coalesce(project_id, ''), 'shared_ip', ip_address FROM audit_records WHERE NOT coalesce(is_public_exit, false)
 UNION ALL SELECT bidder_id, coalesce(project_id, ''), 'shared_device', device_id FROM audit_records UNION ALL SELECT bidder_id, coalesce(project_id, ''), 'shared_account', account_id FROM audit_records
 UNION ALL {_EXTRA}),
iu AS (SELECT signal_type, lower(trim(value)) AS value, bidder_id, count(DISTINCT project_id) AS n, min(project_id) AS p FROM iv
  WHERE regexp_matches(bidder_id, '\\S') AND regexp_matches(value, '\\S') AND NOT (signal_type = 'shared_address' AND length(trim(value)) < 5) GROUP BY ALL),
si AS (SELECT x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.signal_type, count(*) AS values FROM iu x JOIN iu y ON x.signal_type = y.signal_type AND x.value = y.value AND x.bidder_id < y.bidder_id
  WHERE NOT (x.n = 1 AND y.n = 1 AND x.p = y.p AND x.p <> '') GROUP BY ALL),
al AS (SELECT bidder_a, bidder_b FROM k UNION SELECT bidder_a, bidder_b FROM si),
fs AS (SELECT al.bidder_a, al.bidder_b, coalesce(together, 0) AS together, s FROM al LEFT JOIN k USING (bidder_a, bidder_b) LEFT JOIN lr USING (bidder_a, bidder_b)
  LEFT JOIN oc USING (bidder_a, bidder_b) LEFT JOIN sa USING (bidder_a, bidder_b), LATERAL (SELECT [
  CASE WHEN together >= 2 THEN 'stable_cooccurrence' END, CASE WHEN together >= 2 AND jaccard >= 0.45 THEN 'jaccard' END, CASE WHEN together >= 2 AND lift >= 1.8 THEN 'lift' END,
  CASE WHEN together >= 2 AND pmi >= 0.85 THEN 'pmi' END, CASE WHEN longest_run >= 2 THEN 'consecutive_cooccurrence' END, CASE WHEN decided >= 2 AND decided >= 0.75 * both_known THEN 'winner_loser_pattern' END,
  CASE WHEN switches >= 2 AND decided >= 3 THEN 'alternating_winner' END, CASE WHEN one_agency >= 2 THEN 'same_agency' END] AS s)),
sg AS (SELECT bidder_a, bidder_b, unnest(s) AS signal FROM fs UNION ALL SELECT bidder_a, bidder_b, signal_type FROM si),
wt(signal, weight) AS (VALUES ('stable_cooccurrence', 22), ('jaccard', 10), ('lift', 8), ('pmi', 8), ('consecutive_cooccurrence', 10), ('winner_loser_pattern', 12), ('alternating_winner', 15), ('same_agency', 8),
  ('shared_ip', 12), ('shared_device', 12), ('shared_contact', 8), ('shared_address', 8), ('shared_account', 12)),
sc AS (SELECT bidder_a, bidder_b, sum(weight) AS w, string_agg(signal, ',' ORDER BY signal) AS signals FROM sg JOIN wt USING (signal) GROUP BY ALL),
ft AS (SELECT fs.bidder_a, fs.bidder_b, together, least(coalesce(w, 0), 100)::BIGINT AS score, coalesce(signals, '') AS signals FROM fs LEFT JOIN sc USING (bidder_a, bidder_b)),
fl AS (SELECT *, CASE WHEN score >= 52 THEN 'high' WHEN score >= 28 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM ft)
"""
_COMPONENTS = """, ed AS (SELECT bidder_a AS u, bidder_b AS v FROM {edges} UNION SELECT bidder_b, bidder_a FROM {edges}),
re(id, node) AS (SELECT u, u FROM ed UNION SELECT re.id, ed.v FROM re JOIN ed ON re.node = ed.u),
cc AS (SELECT id, min(node) AS component FROM re GROUP BY id)
"""
_GROUPS = """, lk AS (SELECT * FROM ft WHERE score > 0)""" + _COMPONENTS.format(edges="lk") + """,
gs AS (SELECT component, count(*) AS members FROM cc GROUP BY ALL),
cm AS (SELECT component, count(*) AS common_projects FROM (SELECT component, project_id, count(*) AS there FROM m JOIN cc ON id = bidder_id GROUP BY ALL) JOIN gs USING (component) WHERE there = members GROUP BY ALL),
gm AS (SELECT component, sum(score) AS s, count(*) AS pairs FROM lk JOIN cc ON id = bidder_a GROUP BY ALL)
SELECT component, members, pairs, coalesce(common_projects, 0) AS common_projects, members >= 3 AND coalesce(common_projects, 0) >= 2 AS stable,
  CAST(least(floor(s / pairs) + CASE WHEN members >= 3 AND coalesce(common_projects, 0) >= 2 THEN 16 ELSE 0 END, 100) AS BIGINT) AS score
FROM gs JOIN gm USING (component) LEFT JOIN cm USING (component)"""
_STATUS = """, cs AS (SELECT e.bidder_a, e.bidder_b, e.signal_type, e.status, CASE WHEN e.status = 'triggered' THEN wt.weight ELSE 0 END::BIGINT AS points FROM (
  SELECT al.bidder_a, al.bidder_b, unnest(['stable_cooccurrence', 'jaccard', 'lift', 'pmi', 'consecutive_cooccurrence', 'winner_loser_pattern', 'alternating_winner', 'same_agency']) AS signal_type, unnest([
    CASE WHEN together >= 2 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN coalesce(together, 0) < 2 THEN 'excluded' WHEN jaccard >= 0.45 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN coalesce(together, 0) < 2 THEN 'excluded' WHEN lift >= 1.8 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN coalesce(together, 0) < 2 THEN 'excluded' WHEN pmi >= 0.85 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN together IS NULL THEN 'not_provided' WHEN longest_run >= 2 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN both_known IS NULL THEN 'not_provided' WHEN decided >= 2 AND decided >= 0.75 * both_known THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN coalesce(decided, 0) < 2 THEN 'not_provided' WHEN switches >= 2 AND decided >= 3 THEN 'triggered' ELSE 'no_signal' END,
    CASE WHEN any_agency IS NULL THEN 'not_provided' WHEN one_agency >= 2 THEN 'triggered' ELSE 'no_signal' END]) AS status
  FROM al LEFT JOIN k USING (bidder_a, bidder_b) LEFT JOIN lr USING (bidder_a, bidder_b) LEFT JOIN oc USING (bidder_a, bidder_b) LEFT JOIN sa USING (bidder_a, bidder_b)
  UNION ALL SELECT al.bidder_a, al.bidder_b, i.s, CASE WHEN si.bidder_a IS NULL THEN 'not_provided' ELSE 'triggered' END FROM al
   CROSS JOIN (VALUES ('shared_ip'), ('shared_device'), ('shared_contact'), ('shared_address'), ('shared_account')) i(s) LEFT JOIN si ON si.bidder_a = al.bidder_a AND si.bidder_b = al.bidder_b AND si.signal_type = i.s) e
  JOIN wt ON wt.signal = e.signal_type)
"""
ORACLE = {
    "cooc_memberships": BASE + "SELECT * FROM m",
    "cooc_projects": BASE + "SELECT * FROM p",
    "cooc_metrics": BASE + "SELECT bidder_a, bidder_b, together, n_a, n_b, round(jaccard, 6) AS jaccard, round(lift, 6) AS lift, round(pmi, 6) AS pmi FROM k",
    "cooc_longest_runs": BASE + "SELECT * FROM lr",
    "cooc_outcomes": BASE + "SELECT * FROM oc",
    "cooc_same_agency": BASE + "SELECT * FROM sa",
    "cooc_shared_identifiers": BASE + "SELECT * FROM si",
    "cooc_features": BASE + "SELECT * FROM fl",
    "cooc_status": BASE + _STATUS + "SELECT * FROM cs",
    "cooc_summary": BASE + _STATUS + "SELECT signal_type, status, count(*) AS pairs FROM cs GROUP BY ALL",
    "cooc_groups": BASE + _GROUPS,
    "cooc_relation_components": BASE
    + ", rl AS (SELECT DISTINCT bidder_id AS bidder_a, related_bidder_id AS bidder_b FROM audit_records WHERE record_type = 'historical_relation' AND bidder_id <> related_bidder_id)"
    + _COMPONENTS.format(edges="rl")
    + "SELECT * FROM cc",
    "cooc_graph": BASE
    + """SELECT 'participates' AS kind, bidder_id AS source, project_id AS target, 1::BIGINT AS weight FROM m
UNION ALL SELECT 'cooccurrence_anomaly', bidder_a, bidder_b, score FROM fl WHERE level IN ('high', 'medium')""",
}
