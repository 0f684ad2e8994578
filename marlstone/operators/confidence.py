"""Confidence of a retrieval from its tiers' totals, how they moved together in its session, and versioned coefficients."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators.running import running

#: The tiers in their order (fixed values).
TIERS = ("fts5", "splade", "sema_boost", "lex_anchor", "tag_exact", "tag_prefix", "pki", "harmonic", "sr")
#: Names of the features of two tiers and of the likeness of query and best document (fixed format).
PAIRS = tuple(f"{a}__{b}" for a, b in combinations(TIERS, 2))
COSINE, INTERCEPT = "cos_q_c", "intercept"
#: Retrievals a block when a session's history is cut into blocks.
BLOCK = 4096
#: Versions that a lookup of the right one may hold.
VERSIONS = 1000


def histories(log: DataFrame, last: int = 50, block: int = BLOCK) -> DataFrame:
    """(session_id, ts, n_rows, degenerate, one column for each of ``PAIRS``) of (event_id, session_id, ts, TIERS).

    The correlations of the session's ``last`` retrievals before ``ts`` (earlier times only; of one time the largest
    ids), as moments of a sliding frame. A null total is 0, a tier that does not move correlates with none. With fewer
    than two retrievals, or if no tier moves, it is degenerate and all are 0. Rows without session or time give none.

    Retrievals are numbered in one order dealt by ranges and cut into blocks, each with the ``last`` before it, so
    a session with a third of all rows is no single task's.
    """
    rows = log.where("session_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "session_id", "ts", *(F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(t) for t in TIERS))
    placed = running(rows, [F.asc("session_id"), F.asc("ts"), F.asc("event_id")], {"_place": F.lit(1).cast("long")})
    own = F.floor(F.col("_place") / block)
    blocks = F.when(F.col("_place") % block >= block - last, F.array(own, own + 1)).otherwise(F.array(own))
    inside = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_block", "session_id").orderBy("_place").rowsBetween(-last, -1)
    moments = [F.var_pop(t).over(w).alias(f"v_{t}") for t in TIERS] + [F.covar_pop(*p.split("__")).over(w).alias(f"c_{p}") for p in PAIRS]

    def corr(name: str) -> Column:
        x, y = (F.col(f"v_{t}") for t in name.split("__"))
        return F.when((x > 0) & (y > 0), F.col(f"c_{name}") / F.sqrt(x * y)).otherwise(0.0)

    moves = F.greatest(*(F.max(t).over(w) - F.min(t).over(w) for t in TIERS)) > 0
    seen = inside.select("session_id", "ts", "_place", "_own", "_block", F.count("*").over(w).alias("n_rows"), moves.alias("_moves"), *moments).where("_own = _block")
    seen = seen.select("session_id", "ts", "_place", "n_rows", "_moves", *(fx.round6(corr(p)).alias(p) for p in PAIRS))
    first = F.min_by(F.struct("n_rows", "_moves", *PAIRS), "_place")  # of rows at one time the first has none of the others before it
    found = seen.groupBy("session_id", "ts").agg(first.alias("h"))
    flat = (F.col("h.n_rows") < 2) | ~F.coalesce("h._moves", F.lit(False))
    return found.select("session_id", "ts", "h.n_rows", flat.alias("degenerate"), *(F.when(flat, 0.0).otherwise(F.col(f"h.{p}")).alias(p) for p in PAIRS))


def digest(entries: Column) -> Column:
    """sha256 of a model's (feature, coefficient) entries: a line each, by name, coefficients in billionths."""
    line = lambda x: F.concat(x["feature"], F.lit(":"), F.round(x["coefficient"] * 1_000_000_000).cast("long").cast("string"))
    return F.sha2(F.array_join(F.array_sort(F.transform(entries, line)), "\n"), 256)


def models(coefficients: DataFrame, releases: DataFrame, schema_version: int = 1) -> DataFrame:
    """(version, valid_from, label_set, entries, refused): coefficients (version, feature, coefficient) of each release.

    ``releases`` hold (version, valid_from, schema_version, sha256, label_set). A release of another schema, without
    coefficients, or whose ``sha256`` (unless null or empty) is not that of its coefficients is refused, with the reason.
    """
    entries = coefficients.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("feature", "coefficient"))).alias("entries"))
    known = releases.where("version IS NOT NULL AND valid_from IS NOT NULL").join(entries, "version", "left")
    pinned = F.coalesce("sha256", F.lit("")) != ""
    why = F.when(~F.col("schema_version").eqNullSafe(schema_version), "schema").when(F.col("entries").isNull(), "no coefficients").when(pinned & (F.lower("sha256") != digest(F.col("entries"))), "sha256")
    return known.select("version", "valid_from", "label_set", "entries", why.alias("refused"))


def confidence(log: DataFrame, history: DataFrame | None, known: DataFrame, high_risk: float = 0.5) -> DataFrame:
    """(event_id, version, prob_b, logit, score_a, high_risk, label_set, refused) of each retrieval of the log.

    ``log`` holds (event_id, session_id, ts, TIERS, cos_q_c), ``history`` is ``histories`` and ``known`` ``models``. The
    release that was valid at the retrieval's time scores it (of one ``valid_from`` the largest version), so old ones
    are scored as they were. Features that are missing or null are 0, and so are those of a degenerate history.
    The logit's probability is held within .001 and .999. A refused release, or none yet, gives nulls and no risk flag.
    """
    one = known.select(F.struct("valid_from", "version", "label_set", "entries", "refused").alias("m")).limit(VERSIONS + 1).agg(F.array_sort(F.collect_list("m")).alias("_all"))
    checked = one.select(F.when(F.size("_all") <= VERSIONS, F.col("_all")).otherwise(F.raise_error(F.lit(f"more than {VERSIONS} versions"))).alias("_all"))
    rows = log.select("event_id", "session_id", "ts", *TIERS, COSINE)
    rows = rows.join(history.select("session_id", "ts", *PAIRS), ["session_id", "ts"], "left") if history is not None else rows.withColumns(dict.fromkeys(PAIRS, F.lit(0.0)))
    names = (*TIERS, *PAIRS, COSINE)
    x = F.map_from_arrays(F.array(*map(F.lit, (*names, INTERCEPT))), F.array(*(F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names), F.lit(1.0)))
    rows = rows.select("event_id", "ts", x.alias("x")).join(F.broadcast(checked))  # one row of all versions
    rows = rows.select("event_id", "x", F.try_element_at(F.filter("_all", lambda m: m["valid_from"] <= F.col("ts")), F.lit(-1)).alias("m"))
    z = F.aggregate(F.col("m.entries"), F.lit(0.0), lambda s, e: s + e["coefficient"] * F.coalesce(F.try_element_at(F.col("x"), e["feature"]), F.lit(0.0)))
    p = F.when(F.col("m.refused").isNull(), 1 / (1 + F.exp(-z)))
    held = F.greatest(F.least(F.col("p"), F.lit(0.999)), F.lit(0.001))
    scored = rows.select("event_id", "m", p.alias("p"))
    nulls = lambda c: F.when(F.col("p").isNotNull(), c)  # noqa: E731  greatest skips nulls
    return scored.select(
        "event_id", F.col("m.version").alias("version"), fx.round6("p").alias("prob_b"), fx.round6(nulls(F.log(held / (1 - held)))).alias("logit"), fx.round6(1 - F.col("p")).alias("score_a"),
        (F.col("p") > high_risk).alias("high_risk"), F.col("m.label_set").alias("label_set"), F.col("m.refused").alias("refused"),
    )
