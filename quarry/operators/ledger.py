"""Run ledger as tables (L1-L4) and configuration versions.

The reference keeps jobs, runs and steps as rows updated one call at a time.
Here a batch of requests/transitions is folded set-at-a-time:

* L1 ``create_runs``: first request per (tenant, key) creates the job; it
  creates the run too unless a run with its execution id exists: then it is
  quarantined as CONFLICT (deliberate: the reference would hand back another
  tenant's run) and leaves the job without a run, so the next request with
  that key creates it. Later requests replay the job's run.
* L2 ``create_steps``: a step is created unless an earlier *created* step of
  the run has the same key or the same sequence. This is greedy matching in
  arrival order, solved exactly in rounds: a step that is the earliest
  undecided one for both its key and its sequence is created, steps sharing a
  key or sequence with it are dropped, repeat. Each round is two aggregations
  and two anti-joins; lineage is cut with ``checkpoint()`` every round.
* L3/L4 ``run_state``/``step_state``: last-write-wins folds with ``max_by``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import jsvalues
from quarry.functions.grouping import materialize

# Run and step states.
RUN_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
STEP_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED", "CANCELLED"]
FINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED"]
NULL_KEY = "\u0000"


# ---------------------------------------------------------------- C1, C2
def config_snapshot(configuration: Mapping, profile_version_id: str | None = None,
                    rule_version_id: str | None = None) -> dict:
    """C1 for one configuration given as a job parameter."""
    text = jsvalues.dumps(dict(configuration))
    full = jsvalues.dumps({"profile_version_id": profile_version_id,
                           "rule_version_id": rule_version_id, "configuration": dict(configuration)})
    return {"configuration_version": "cfg-" + hashlib.sha256(text.encode()).hexdigest()[:16],
            "configuration_hash": hashlib.sha256(full.encode()).hexdigest()}


def _inner(text):
    """The text between the brackets of a one-element JSON array."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _json_text_or_null(c):
    return F.when(c.isNull(), F.lit("null")).otherwise(
        _inner(F.to_json(F.array(c))))


def config_versions(configs: DataFrame) -> DataFrame:
    """C1 over a table of stored configurations (compact JSON text)."""
    full = F.concat(F.lit('{"profile_version_id":'), _json_text_or_null(F.col("profile_version_id")),
                    F.lit(',"rule_version_id":'), _json_text_or_null(F.col("rule_version_id")),
                    F.lit(',"configuration":'), F.col("configuration"), F.lit("}"))
    return configs.select(
        "*", F.concat(F.lit("cfg-"), F.substring(F.sha2(F.col("configuration"), 256), 1, 16)).alias("configuration_version"),
        F.sha2(full, 256).alias("configuration_hash"))


def profiles_list(profile_versions: DataFrame) -> DataFrame:
    """C2 list: one row per profile with its latest version (global)."""
    return profile_versions.groupBy("profile_id").agg(
        F.max("version").alias("latest_version"), F.count(F.lit(1)).cast("long").alias("versions"))


def profile_get(profile_versions: DataFrame, profile_id: str) -> DataFrame:
    """C2 get: the versions of one profile (a pushed-down filter)."""
    return profile_versions.filter(F.col("profile_id") == profile_id)


# ---------------------------------------------------------------- L1
def create_runs(requests: DataFrame, existing_jobs: DataFrame | None = None,
                existing_runs: DataFrame | None = None) -> DataFrame:
    """L1. ``requests``: seq, tenant_id, execution_id, idempotency_key (nullable).

    ``existing_jobs``: (tenant_id, idempotency_key, run_id), run_id null for a
    job without a run; ``existing_runs``: (execution_id). Output per request:
    status in CREATED / REPLAY / CONFLICT, job_id, run_id.

    Same outcome as handling the requests one by one in ``seq`` order. Of each
    job's requests only the first two matter: the opener makes the job and,
    unless its execution id is taken, the run; after a conflict the second one
    makes the run (whatever its execution id, which is then taken too). Per
    execution id only the earliest opener can succeed, and it fails only if
    the id was taken before or an earlier second request made a run with it.
    That in turn happens when that request's own opener failed: failures
    spread along (opener's id -> second's id); ``_spread`` follows them.
    """
    key = F.coalesce(F.col("idempotency_key"), F.concat(F.col("tenant_id"), F.lit(":"), F.col("execution_id")))
    req = requests.select("seq", "tenant_id", "execution_id", key.alias("job_key"))
    job = ["tenant_id", "job_key"]
    if existing_jobs is not None:
        prior = (existing_jobs.groupBy("tenant_id", F.col("idempotency_key").alias("job_key"))
                 .agg(F.max("run_id").alias("p_run")).withColumn("p_job", F.lit(True)))
        req = req.join(prior, job, "left")
    else:
        req = req.select("*", F.lit(None).cast("string").alias("p_run"), F.lit(None).cast("boolean").alias("p_job"))
    req = req.withColumn("p_job", F.coalesce("p_job", F.lit(False)))

    # the first request of each job and the first after it, by map-side minima
    fresh = req.where("p_run IS NULL")
    openers = fresh.groupBy(*job).agg(F.min("seq").alias("a"), F.min_by("execution_id", "seq").alias("a_exec"),
                                      F.max("p_job").alias("p_job"))
    rest = fresh.select(*job, "seq", "execution_id").join(openers.select(*job, "a"), job).where("seq > a")
    seconds = rest.groupBy(*job).agg(F.min("seq").alias("b"), F.min_by("execution_id", "seq").alias("b_exec"))
    jobs = materialize(openers.join(seconds, job, "left"))
    # a stored job without a run: its first request makes the run like a second one
    opening = jobs.where("NOT p_job")
    late = (opening.where("b IS NOT NULL").select("a", "a_exec", "b", "b_exec")
            .unionByName(jobs.where("p_job").select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("string").alias("a_exec"),
                                                    F.col("a").alias("b"), F.col("a_exec").alias("b_exec"))))
    earliest = opening.groupBy(F.col("a_exec").alias("execution_id")).agg(F.min("a").alias("first"))
    late = (late.join(earliest.withColumnsRenamed({"execution_id": "a_exec", "first": "a_first"}), "a_exec", "left")
            .join(earliest.withColumnsRenamed({"execution_id": "b_exec", "first": "b_first"}), "b_exec"))
    # only runs made before the earliest opener of their id matter
    late = materialize(late.where("b < b_first").select("b_exec", "a_exec", (F.coalesce(F.col("a") > F.col("a_first"), F.lit(True))).alias("sure")))
    failed = late.where("sure").select(F.col("b_exec").alias("execution_id"))
    if existing_runs is not None:
        failed = failed.unionByName(existing_runs.select("execution_id").join(earliest, "execution_id", "left_semi"))
    failed = _spread(failed.distinct(), late.where("NOT sure").select("a_exec", "b_exec"))

    marks = earliest.join(failed.withColumn("failed", F.lit(True)), "execution_id", "left").withColumnRenamed("execution_id", "a_exec")
    won = (F.col("a") == F.col("first")) & F.col("failed").isNull() & ~F.col("p_job")
    jobs = jobs.join(marks, "a_exec", "left").select(*job, "a", "b", "p_job", F.coalesce(won, F.lit(False)).alias("won"))
    out = req.drop("p_job").join(jobs, job, "left")
    made = F.when(F.col("won") | F.col("p_job"), F.col("a")).otherwise(F.col("b"))  # seq of the request that made the run
    status = (F.when(F.col("p_run").isNotNull(), F.lit("REPLAY")).when(F.col("seq") == made, F.lit("CREATED"))
               .when(F.col("seq") == F.col("a"), F.lit("CONFLICT")).otherwise(F.lit("REPLAY")))
    run = F.sha2(F.concat_ws("|", F.lit("run"), F.col("tenant_id"), F.col("job_key")), 256)
    return out.select("seq", "tenant_id", F.col("job_key").alias("idempotency_key"), "execution_id", status.alias("status"),
                      F.sha2(F.concat_ws("|", F.lit("job"), F.col("tenant_id"), F.col("job_key")), 256).alias("job_id"),
                      F.coalesce("p_run", F.when(F.col("seq") >= made, run)).alias("run_id"))


def _spread(failed: DataFrame, links: DataFrame) -> DataFrame:
    """``failed`` and all execution ids that ``links`` (a_exec -> b_exec) lead to
    from them. An id has one link at most, as one request is its earliest opener.
    Links are doubled every round (pointer jumping), so a chain of n ids takes
    about log2(n) rounds, and it ends when no link is left."""
    failed, links = materialize(failed), materialize(links)
    while not links.isEmpty():
        reached = links.join(failed.withColumnRenamed("execution_id", "a_exec"), "a_exec").select(F.col("b_exec").alias("execution_id"))
        failed = materialize(failed.unionByName(reached).distinct())
        onward = links.select(F.col("a_exec").alias("b_exec"), F.col("b_exec").alias("c_exec"))
        links = materialize(links.join(onward, "b_exec").select("a_exec", F.col("c_exec").alias("b_exec")))
    return failed


# ---------------------------------------------------------------- L2
def steps_of_tenant(steps: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gate of L2: requests whose run exists in their tenant, and the rest
    with a reason. ``steps`` has run_id and tenant_id, ``runs`` the same."""
    r = runs.select("run_id", F.col("tenant_id").alias("__rt")).distinct()
    found = steps.join(r, (steps["run_id"] == r["run_id"]) & (steps["tenant_id"] == r["__rt"]), "left").drop(r["run_id"])
    ok = found.where(F.col("__rt").isNotNull()).drop("__rt")
    bad = found.where(F.col("__rt").isNull()).drop("__rt").withColumn("reason", F.lit("Run not found"))
    return ok, bad


def create_steps(steps: DataFrame, prior_steps: DataFrame | None = None) -> DataFrame:
    """L2. ``steps``: run_id, seq, sequence, idempotency_key (nullable; nulls
    are equal to each other, as in the reference's ``===`` test).

    Output per request: status CREATED or EXISTING and ``step_seq``: the seq
    of the step returned (own seq when created; -1 for a prior step).

    A request that no earlier undecided one shares a key or sequence with is
    created, those that share with a created one are settled, and so on: the
    first round settles all runs without crossed keys, later rounds only look
    at what is left. Every round is stored, so none is computed again.
    """
    base = materialize(steps.select("run_id", "seq", "sequence", F.coalesce(F.col("idempotency_key"), F.lit(NULL_KEY)).alias("k")))
    und, accepted = base, None
    if prior_steps is not None:
        accepted = prior_steps.select("run_id", F.lit(-1).cast("long").alias("seq"), "sequence",
                                      F.coalesce(F.col("idempotency_key"), F.lit(NULL_KEY)).alias("k"))
        und = materialize(base.join(accepted.select("run_id", "k"), ["run_id", "k"], "left_anti")
                          .join(accepted.select("run_id", "sequence"), ["run_id", "sequence"], "left_anti"))
    while not und.isEmpty():
        mk = und.groupBy("run_id", "k").agg(F.min("seq").alias("mk"))
        ms = und.groupBy("run_id", "sequence").agg(F.min("seq").alias("ms"))
        won = (und.join(mk, ["run_id", "k"]).join(ms, ["run_id", "sequence"])
               .where((F.col("seq") == F.col("mk")) & (F.col("seq") == F.col("ms")))
               .select("run_id", "seq", "sequence", "k"))
        won = materialize(won)
        accepted = won if accepted is None else accepted.unionByName(won)
        und = materialize(und.join(won.select("run_id", "k"), ["run_id", "k"], "left_anti")
                          .join(won.select("run_id", "sequence"), ["run_id", "sequence"], "left_anti"))
    if accepted is None:
        return base.select("run_id", "seq", "sequence", F.lit("CREATED").alias("status"),
                           F.col("seq").alias("step_seq")).where(F.lit(False))
    by_k = accepted.groupBy("run_id", "k").agg(F.min("seq").alias("sk"))
    by_s = accepted.groupBy("run_id", "sequence").agg(F.min("seq").alias("ss"))
    out = (base.join(by_k, ["run_id", "k"], "left").join(by_s, ["run_id", "sequence"], "left"))
    sk = F.when(F.col("sk") <= F.col("seq"), F.col("sk"))
    ss = F.when(F.col("ss") <= F.col("seq"), F.col("ss"))
    step_seq = F.least(sk, ss)
    return out.select("run_id", "seq", "sequence",
                      F.when(step_seq == F.col("seq"), F.lit("CREATED")).otherwise(F.lit("EXISTING")).alias("status"),
                      step_seq.alias("step_seq"))


# ---------------------------------------------------------------- L3, L4
#: The last transition that gives one of these wins; the rest is set by the state.
PATCH_FIELDS = ("progress", "worker", "statistics", "errors", "output")


def _fold(df: DataFrame, key: str) -> DataFrame:
    final = ", ".join(f"'{s}'" for s in FINAL_STATES)
    given = [c for c in PATCH_FIELDS if c in df.columns]
    # whether a transition patches a field: by default when it is not null;
    # ``patched`` (array of names) tells it apart from a patch to null
    told = lambda c: (f"array_contains(patched, '{c}')" if "patched" in df.columns else f"{c} IS NOT NULL")
    return df.groupBy(key).agg(
        F.max_by("status", "seq").alias("status"),
        F.expr("max_by(ts, seq) FILTER (WHERE status = 'RUNNING')").alias("started_at"),
        F.expr("max_by(ts, seq) FILTER (WHERE status = 'RUNNING')").alias("heartbeat_at"),
        F.expr(f"max_by(ts, seq) FILTER (WHERE status IN ({final}))").alias("finished_at"),
        *[F.expr(f"max_by({c}, seq) FILTER (WHERE {told(c)})").alias(c) for c in given],
        F.count(F.lit(1)).cast("long").alias("transitions"))


def _gated(transitions: DataFrame, runs: DataFrame | None, states: list[str], kind: str) -> DataFrame:
    """Transitions with the reason for refusing each, null if it applies."""
    reason = F.when(~F.coalesce(F.col("status").isin(*states), F.lit(False)), F.lit(f"Invalid {kind.upper()} state"))
    if runs is None:
        return transitions.withColumn("reason", reason)
    r = runs.groupBy("run_id").agg(F.min("tenant_id").alias("__rt"))
    found = F.coalesce(F.col("__rt") == F.col("tenant_id"), F.lit(False))
    t = transitions.join(r, "run_id", "left")
    return t.withColumn("reason", reason.when(~found, F.lit(f"{kind.capitalize()} not found"))).drop("__rt")


def run_state(transitions: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """L3: (run_id, seq, status, ts, and any of ``PATCH_FIELDS``) -> one state
    row per run, and the refused transitions with their reason. With ``runs``
    (run_id, tenant_id) a transition (with the caller's tenant_id) applies
    only to a run of that tenant."""
    t = _gated(transitions, runs, RUN_STATES, "run")
    return _fold(t.where("reason IS NULL"), "run_id"), t.where("reason IS NOT NULL")


def step_state(transitions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L4: (step_id, run_id, tenant_id, seq, status, ts, and any of
    ``PATCH_FIELDS``) -> one state row per step. A transition is applied only
    when its run belongs to the caller's tenant; others are not found."""
    t = _gated(transitions, runs, STEP_STATES, "step")
    return _fold(t.where("reason IS NULL"), "step_id"), t.where("reason IS NOT NULL")
