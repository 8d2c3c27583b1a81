"""Online training with a changing policy: every update samples two completions per prompt from the
policy as it is, labels them, and takes one gradient step (N2, R4, R5, L6, J*, G2, M1-M4, M8, M9).

Prompts are dealt to updates once and written partitioned by update, so an update reads its own share
only.  What an update leaves (theta, counters, metrics) is one small row in the shared folder; a run that
was ended goes on after the last row that was written whole, and gives what an undisturbed run gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.operators.fit import NEEDS_MEAN, pair_gradient
from prefengine.operators.metrics import cosine_lr, pair_metrics
from prefengine.operators.objectives import objective
from prefengine.operators.order import expand_epochs
from prefengine.operators.pairs import label_pairs, penalise_unterminated
from prefengine.operators.policy import candidate_logps, pair_logps, sample_sets
from prefengine.session import require_columns

STATE = ("update long, examples long, example_counter long, checkpoint boolean, lr double, loss double, margins double, kl double, "
         "accuracy double, score_margin double, theta array<double>")


@dataclass(frozen=True)
class Training:
    """Settings of a run.  ``batch_size`` prompts make a batch, ``accumulation`` batches an update;
    checkpoints fall where the example counter passes a multiple of ``eval_every``."""

    batch_size: int
    accumulation: int = 1
    epochs: int = 1
    kind: str = "dpo"
    beta: float = 0.05
    lr: float = 0.1
    warmup: int = 0
    temperature: float = 0.9
    seed: int = 0
    eval_every: int | None = None
    no_eos_score: float = -1.0


def deal_updates(cands: DataFrame, key: str, run: Training, path: str) -> int:
    """Write the candidate sets dealt to updates (partitioned by ``update``, with the batch in it) and return
    the number of updates: shuffled anew each epoch, ``batch_size`` x ``accumulation`` prompts each, the last of an
    epoch what is left."""
    prompts = expand_epochs(cands.select(key).distinct(), run.epochs, run.seed, key)
    per = run.batch_size * run.accumulation
    counts = prompts.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    each = -(-counts // per)
    prompts = prompts.select(key, (F.col("epoch") * each + F.floor(F.col("pos") / per)).cast("long").alias("update"),
                             (F.floor(F.col("pos") / run.batch_size) % run.accumulation).cast("long").alias("batch"))
    cands.join(prompts, key).write.partitionBy("update").parquet(path)
    return each * run.epochs


def one_update(sets: DataFrame, key: str, cand: str, theta: list[float], run: Training, update: int, total: int) -> DataFrame:
    """Samples, labels, gradient and metrics of one update: one row per batch of it (gradient and sums)."""
    carry = ["batch", "phi", "score", "has_eos", "ref_logp"]
    two = sample_sets(sets, [key], cand, theta, carry, 2, run.temperature, run.seed, update)
    two = two.withColumns({f"score_{k}": penalise_unterminated(f"score_{k}", f"has_eos_{k}", run.no_eos_score) for k in (0, 1)})
    two = two.select(key, F.col("batch_0").alias("batch"), *[f"{c}_{k}" for c in (cand, "phi", "score", "ref_logp") for k in (0, 1)])
    lab = label_pairs(two, tie="first", unscored="raise", first=f"{cand}_0", second=f"{cand}_1", first_score="score_0", second_score="score_1",
                      carry={"phi": ("phi_0", "phi_1"), "ref": ("ref_logp_0", "ref_logp_1")})
    lab = lab.withColumnRenamed("chosen_ref", "ref_chosen_logps").withColumnRenamed("rejected_ref", "ref_rejected_logps")
    lab = lab.withColumns({"data_chosen_logps": F.col("ref_chosen_logps"), "data_rejected_logps": F.col("ref_rejected_logps")})
    lab = pair_logps(lab, sets, [key], theta, mean=run.kind in NEEDS_MEAN)
    if run.kind == "sft":
        lab = lab.withColumn("logp", F.col("chosen_logps"))
    scored = pair_metrics(objective(lab, run.kind, beta=run.beta), run.beta)
    grad = pair_gradient(scored, theta, run.kind, run.beta, ref_chosen="ref_chosen_logps", ref_rejected="ref_rejected_logps",
                         data_chosen="data_chosen_logps", data_rejected="data_rejected_logps", logps=("chosen_logps", "rejected_logps"))
    sums = [F.sum(c).alias(c) for c in ("loss", "margins", "kl", "accuracy", "score_margin")]
    lr = cosine_lr(F.lit(update), run.lr, run.warmup, total)
    return (scored.groupBy("batch").agg(Summarizer.mean(array_to_vector(grad)).alias("g"), F.count(F.lit(1)).alias("examples"), *sums)
            .withColumn("grad", vector_to_array("g")).drop("g").withColumn("lr", lr))


def train_online(cands: DataFrame, key: str, cand: str, theta: list[float], run: Training, path: str,
                 ref_theta: list[float] | None = None, max_updates: int | None = None) -> DataFrame:
    """Train from ``theta`` over the candidate sets of ``cands`` (``key``, ``cand``, phi array, score, has_eos) and return the log:
    a row per update with its metrics, rate and the theta after it.

    ``path`` is the run's folder, shared by all machines: sets/ holds the dealt prompts, log/update=<n> a row per
    update.  A folder with rows is gone on with, so calling again with the same arguments resumes; the
    dealt prompts are kept too once they are whole.  ``max_updates`` ends this call early.  The reference
    policy is ``ref_theta`` (default: the first ``theta``); its log-probs are computed once.

    The step is the mean over batches of their mean gradients, as gradient accumulation makes it, with M8's rate:
    the scheduler steps once per update over (prompts // (batch_size * accumulation)) * epochs.  Prompts with
    a null score raise."""
    spark = cands.sparkSession
    require_columns(cands, key, cand, "phi", "score", "has_eos")
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    exists = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(hadoop).exists(jvm.org.apache.hadoop.fs.Path(p))
    sets_path, plan_path = f"{path}/sets", f"{path}/plan"
    if not exists(f"{plan_path}/_SUCCESS"):
        if exists(sets_path):  # an ended run left a part
            root = jvm.org.apache.hadoop.fs.Path(sets_path)
            root.getFileSystem(hadoop).delete(root, True)
        with_ref = candidate_logps(cands.select(key, cand, "phi", "score", "has_eos"), [key], ref_theta or theta, out="ref_logp")
        updates = deal_updates(with_ref, key, run, sets_path)
        n = cands.select(key).distinct().count()
        spark.createDataFrame([(updates, n)], "updates long, prompts long").coalesce(1).write.mode("overwrite").parquet(plan_path)
    updates, prompts = spark.read.parquet(plan_path).first()
    total = prompts // (run.batch_size * run.accumulation) * run.epochs
    sets = spark.read.parquet(sets_path) if updates else None
    done = 0
    while done < updates and exists(f"{path}/log/update={done}/_SUCCESS"):
        done += 1
    counter = 0
    if done:
        last = spark.read.schema(STATE).parquet(f"{path}/log/update={done - 1}").select("theta", "example_counter").first()
        theta, counter = list(last["theta"]), last["example_counter"]
    for update in range(done, min(updates, max_updates if max_updates is not None else updates)):
        own = sets.filter(F.col("update") == update)
        rows = one_update(own, key, cand, theta, run, update, total).collect()  # as many as batches in an update
        rows.sort(key=lambda r: r["batch"])
        n, lr = sum(r["examples"] for r in rows), rows[0]["lr"]
        theta = [t - lr * sum(r["grad"][i] for r in rows) / len(rows) for i, t in enumerate(theta)]
        passed = run.eval_every is not None and (counter + n) // run.eval_every > counter // run.eval_every
        counter += n
        mean = [sum(r[c] for r in rows) / n for c in ("loss", "margins", "kl", "accuracy", "score_margin")]
        state = spark.createDataFrame([(update, n, counter, passed, lr, *mean, theta)], STATE).coalesce(1)
        state.write.mode("overwrite").parquet(f"{path}/log/update={update}")
    if not exists(f"{path}/log/update=0/_SUCCESS"):
        return spark.createDataFrame([], STATE)
    fields = [f for f in spark.createDataFrame([], STATE).schema if f.name != "update"]
    log = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)).parquet(f"{path}/log")
    return log.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) if c.startswith("update ") else c.split()[0] for c in STATE.split(", ")])
