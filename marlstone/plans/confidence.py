"""Histories of tier totals in each session, and the confidence of each retrieval by the release of its time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import confidence as c
from marlstone.plans import model as m
from marlstone.registry import query

#: Coefficients of two releases: tiers, four pairs, the cosine and the intercept. Parameters of the queries.
FIRST = {"intercept": -0.407315926, "fts5": 0.004182737, "splade": -0.051739417, "sema_boost": 0.302917453, "tag_prefix": 0.113094871, "sr": 0.021573839, "fts5__splade": 0.613847291, "tag_prefix__sr": -0.702918377, "pki__sr": 1.509183747, "cos_q_c": -0.917362819}
SECOND = {**FIRST, "intercept": 0.203817463, "lex_anchor": -0.130917283, "harmonic": 0.001039187, "sema_boost__harmonic": 0.518273649, "unknown": 9.0}


def _sha(entries: dict[str, float]) -> str:
    return hashlib.sha256("\n".join(sorted(f"{k}:{round(v * 1_000_000_000)}" for k, v in entries.items())).encode()).hexdigest()


RELEASES = [("r1", 1704153600.0, 1, _sha(FIRST), "half"), ("r2", 1705276800.0, 1, "", "half"), ("r3", 1706745600.0, 1, _sha(FIRST), "full"), ("r4", 1707350400.0, 1, None, "full")]
COEFFICIENTS = {"r1": FIRST, "r2": SECOND, "r3": SECOND, "r4": SECOND}
TOTALS = {
    "fts5": "value", "splade": "(doc_id % 10)::DOUBLE", "sema_boost": "CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::DOUBLE", "lex_anchor": "(event_id % 7)::DOUBLE", "tag_exact": "value * (doc_id % 3)",
    "tag_prefix": "CASE WHEN event_id % 4 <> 0 THEN (doc_id % 5)::DOUBLE END", "pki": "0.5::DOUBLE", "harmonic": "CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END::DOUBLE", "sr": "((event_id * 31) % 17)::DOUBLE",
    "cos_q_c": "CASE WHEN event_id % 5 <> 0 THEN (doc_id % 21) / 20.0::DOUBLE - 0.5 END::DOUBLE",
}
HISTORY = f"""{m.LOG}, tt AS (SELECT event_id, session_id, ts, {", ".join(f"{v} AS {k}" for k, v in TOTALS.items())} FROM ev),
zz AS (SELECT event_id, session_id, ts, {", ".join(f"coalesce({t}, 0.0) AS {t}" for t in c.TIERS)} FROM tt),
hh AS (SELECT session_id, ts, event_id, count(*) OVER w AS n_rows, greatest({", ".join(f"max({t}) OVER w - min({t}) OVER w" for t in c.TIERS)}) > 0 AS moves, {", ".join(f"corr({p.replace('__', ', ')}) OVER w AS {p}" for p in c.PAIRS)}
  FROM zz WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
hi AS (SELECT session_id, ts, n_rows, n_rows < 2 OR NOT coalesce(moves, false) AS degenerate, {", ".join(f"CASE WHEN n_rows < 2 OR {p} IS NULL OR isnan({p}) THEN 0.0 ELSE round_even({p}, 6) END::DOUBLE AS {p}" for p in c.PAIRS)}
  FROM hh QUALIFY row_number() OVER (PARTITION BY session_id, ts ORDER BY event_id) = 1)"""


def retrievals(spark, sf) -> DataFrame:
    """The query log with the nine tier totals of each retrieval; some are missing, one never moves."""
    return m.query_log(spark, sf).selectExpr("event_id", "session_id", "ts", *(f"{_spark(v)} AS {k}" for k, v in TOTALS.items()))


def _spark(sql: str) -> str:
    return f"CAST({sql.replace('20.0::DOUBLE', '20D').replace('::DOUBLE', '')} AS DOUBLE)"


@query("tier_histories", f"WITH {HISTORY} SELECT * FROM hi")
def tier_histories(spark, sf) -> DataFrame:
    """How the nine totals moved together in the fifty retrievals before each time of each session: 36 pairs."""
    return c.histories(retrievals(spark, sf))


def _score_sql() -> str:
    whens = []
    for name, _, _, _, _ in RELEASES:
        terms = [f"{v}::DOUBLE * {'1.0' if k == c.INTERCEPT else f'coalesce({k}, 0.0)'}" for k, v in sorted(COEFFICIENTS[name].items()) if k != "unknown"]
        whens.append(f"WHEN '{name}' THEN {' + '.join(terms)}")
    releases = ", ".join(f"('{v}', {at}::DOUBLE, '{label}', {repr('sha256') if v == 'r3' else 'NULL'})" for v, at, _, _, label in RELEASES)
    return f"""WITH {HISTORY}, rel AS (SELECT * FROM (VALUES {releases}) r(version, valid_from, label_set, refused)),
x AS (SELECT tt.event_id, rel.version, label_set, refused, CASE WHEN rel.version IS NOT NULL AND refused IS NULL THEN 1 / (1 + exp(-(CASE rel.version {" ".join(whens)} END))) END AS p
  FROM tt LEFT JOIN hi USING (session_id, ts) ASOF LEFT JOIN rel ON tt.ts >= rel.valid_from)
SELECT event_id, version, round_even(p, 6) AS prob_b, CASE WHEN p IS NOT NULL THEN round_even(ln(greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE) / (1 - greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE))), 6) END AS logit, round_even(1 - p, 6) AS score_a, p > 0.5 AS high_risk, label_set, refused FROM x"""


@query("query_confidence", _score_sql())
def query_confidence(spark, sf) -> DataFrame:
    """Every retrieval by the release valid at its time; the third is refused for its digest, before the first there is none."""
    log = retrievals(spark, sf)
    coefficients = spark.createDataFrame([(v, k, float(x)) for v, entries in COEFFICIENTS.items() for k, x in entries.items()], "version string, feature string, coefficient double")
    releases = spark.createDataFrame(RELEASES, "version string, valid_from double, schema_version int, sha256 string, label_set string")
    return c.confidence(log, c.histories(log), c.models(coefficients, releases))
