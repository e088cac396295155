"""Whole programs, each one lazy DataFrame plan between its sources and its written result."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import incremental, lexicon, metrics, pairs, remote, sampling
from ..storage import bounded_broadcast, written


def evaluation_set(directions: DataFrame, parallel: DataFrame, english_centric: DataFrame, per_pair: int | None, limit: int | None, seed: int) -> DataFrame:
    """Merged items: parallel items of every direction (as often as the direction stands there), then English-centric ones of directions from English, sampled per corpus and pair, then over all."""
    keys = ["src_lang", "tgt_lang"]
    first = directions.withColumnRenamed("_ord", "_d").join(parallel, keys).withColumn("eval_corpus", F.lit("flores"))
    targets = pairs.distinct_directions(directions).where("src_lang = 'eng_Latn' and tgt_lang <> 'eng_Latn'").withColumnRenamed("_ord", "_d")
    second = targets.join(english_centric, keys).withColumn("eval_corpus", F.lit("ntrex"))
    items = first.unionByName(second, allowMissingColumns=True).withColumn("eval_pair", names.pair_of(F.col("src_lang"), F.col("tgt_lang")))
    if per_pair:
        items = sampling.sample_per_key(items, per_pair, seed, ["eval_corpus", "eval_pair"], "sample_id")
    items = items.withColumn("_ord", F.struct("eval_corpus", "_d", "sample_id"))
    return sampling.sample_keep_order(items, limit, seed, "sample_id").drop("_d")


def generate_hypotheses(items: DataFrame, translator: remote.Translator, stored: DataFrame | None = None, instruction: Callable[[Column, Column], Column] = names.strict_instruction, workers: int = 4) -> DataFrame:
    """Hypotheses of the items that have none stored; errors stay in their column."""
    todo = incremental.pending(items, stored) if stored is not None else items
    asked = todo.withColumn("prompt", names.prompt(instruction(F.col("src_lang"), F.col("tgt_lang")), F.col("source_text")))
    return remote.translate(asked, translator, "prompt", workers=workers).drop("prompt")


def metrics_of(items: DataFrame, hypotheses: DataFrame, policy: str = "auto", score: str | None = None) -> DataFrame:
    """Metrics rows of the items and their stored hypotheses."""
    return metrics.evaluate(incremental.evaluated(items, pairs.validated(hypotheses)), policy, score)


def pivot_lexicons(lexicons: Mapping[tuple[str, str], DataFrame], languages: Sequence[str] = names.LOW_RESOURCE, max_candidates: int = 8) -> dict[tuple[str, str], DataFrame]:
    """Lexicons between each language and Chinese, by way of English, both ways."""
    out = {}
    en, zh = names.PIVOTS
    for lang in languages:
        if (lang, en) in lexicons and (en, zh) in lexicons:
            out[lang, zh] = lexicon.pivot_lexicon(lexicons[lang, en], lexicons[en, zh], lang, zh, max_candidates)
        if (zh, en) in lexicons and (en, lang) in lexicons:
            out[zh, lang] = lexicon.pivot_lexicon(lexicons[zh, en], lexicons[en, lang], zh, lang, max_candidates)
    return out


def synthetic_pairs(docs: DataFrame, src_lang: str, tgt_lang: str, translator: remote.Translator, quota: int, done: DataFrame | None = None, over: float = 1.2, min_chars: int = 20, max_chars: int = 600) -> DataFrame:
    """Alpaca rows from monolingual text: greedy candidates, not yet done, translated and checked by script, the first quota of them.

    Sources are chosen without their texts, which are fetched for those that are asked for. Each round asks for somewhat more
    than is lacking. A rejected answer gives its place back: rounds go on until the quota is full or the sources are at an end,
    and each writes its answers, so that none is asked for twice.
    """
    from ..functions.text import speaks

    pieces, found = sampling.greedy_choices(sampling.candidates(docs, F.lit(src_lang), min_chars, max_chars))
    if done is not None:
        found = written(found.join(done.withColumnRenamed("source_hash", "hash"), "hash", "left_anti"), "sources")
    inst = names.candidate_instruction(F.lit(src_lang), F.lit(tgt_lang))
    tally = (F.count(F.lit(1)).alias("asked"), F.count_if("good").alias("good"))
    every, good = None, 0
    while good < quota:
        rest = found if every is None else found.join(bounded_broadcast(every.select("hash")), "hash", "left_anti")
        most = int((quota - good) * over) + 1
        asked = sampling.with_texts(pieces, bounded_broadcast(pairs.first_rows(rest, most))).withColumn("prompt", names.prompt(inst, F.col("text")))
        answered = remote.translate(asked, translator, "prompt", "output").withColumn("good", F.coalesce(F.col("error").isNull() & speaks(F.col("output"), F.lit(tgt_lang)), F.lit(False)))
        answered = written(answered, "answers", *tally)
        every = answered if every is None else every.unionByName(answered)
        good += answered.measured["good"]
        if answered.measured["asked"] < most:
            break
    kept = pairs.first_rows((every if every is not None else pieces.limit(0).withColumns({"output": F.lit(""), "good": F.lit(False)})).where("good"), quota)
    meta = F.struct(F.lit(src_lang).alias("source"), F.col("hash").alias("source_hash"))
    return kept.select(inst.alias("instruction"), F.col("text").alias("input"), "output", meta.alias("meta"), "_ord")


def all_directions_mixture(rows: DataFrame, configs: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Every direction's mixture in one shuffled table."""
    return sampling.shuffle(sampling.direction_mixture(rows, configs, seed, id_col), seed, id_col)


@dataclass
class Outcome:
    """How one of several jobs ended: ok, failed or cancelled; its result or error, and seconds."""

    name: str
    status: str
    result: object = None
    error: str = ""
    seconds: float = 0.0


@dataclass
class Tally:
    """The outcomes of jobs by name, and the exit status of them all: 0 if each ended well, else 2."""

    outcomes: dict[str, Outcome]

    @property
    def exit_status(self) -> int:
        return 0 if all(o.status == "ok" for o in self.outcomes.values()) else 2

    def count(self, status: str) -> int:
        return sum(o.status == status for o in self.outcomes.values())

    def lines(self) -> list[str]:
        """A line for each job, and the counts."""
        marks = {"ok": "PASS", "failed": "FAIL", "cancelled": "CANCELLED"}
        return [f"[{marks[o.status]}] {o.name}: {o.seconds:.1f} s {o.error}".rstrip() for o in self.outcomes.values()] + [f"{m}: {self.count(s)}" for s, m in marks.items()]


class Directions:
    """Named jobs side by side on one cluster, workers at a time.

    Each job runs in a thread with a job group and, where the session schedules fairly (spark.scheduler.mode), a pool of its
    own, so that a long one doesn't hold the others up. A failure ends its job alone, unless stop_on_failure.
    """

    def __init__(self, spark: SparkSession, workers: int = 4, stop_on_failure: bool = False) -> None:
        self.spark, self.workers, self.stop_on_failure = spark, workers, stop_on_failure
        self._stopped: set[str] = set()
        self._all = False
        self._prefix = f"directions-{uuid.uuid4().hex[:8]}"
        self._lock = threading.Lock()

    def group(self, name: str) -> str:
        return f"{self._prefix}-{name}"

    def cancel(self, name: str | None = None) -> None:
        """Ends one job's Spark jobs and keeps it from starting; all of them without a name."""
        with self._lock:
            self._all |= name is None
            if name is not None:
                self._stopped.add(name)
        for one in self._names if name is None else (name,):
            self.spark.sparkContext.cancelJobGroup(self.group(one))

    def _cancelled(self, name: str) -> bool:
        with self._lock:
            return self._all or name in self._stopped

    def run(self, jobs: Mapping[str, Callable[[], object]]) -> Tally:
        self._names = tuple(jobs)
        context = self.spark.sparkContext

        def one(name: str) -> Outcome:
            began = time.monotonic()
            if self._cancelled(name):
                return Outcome(name, "cancelled")
            context.setJobGroup(self.group(name), name, interruptOnCancel=True)
            context.setLocalProperty("spark.scheduler.pool", self.group(name))
            try:
                out = Outcome(name, "ok", jobs[name]())
            except Exception as error:
                out = Outcome(name, "cancelled" if self._cancelled(name) else "failed", error=str(error).strip().split("\n")[0])
            finally:
                context.setLocalProperty("spark.scheduler.pool", None)
                context.setLocalProperty("spark.jobGroup.id", None)
            out.seconds = time.monotonic() - began
            if out.status == "failed" and self.stop_on_failure:
                self.cancel()
            return out

        with ThreadPoolExecutor(self.workers) as pool:
            # threads of their own in the JVM too, or they would share each other's properties
            tasks = [pool.submit(inheritable_thread_target(self.spark)(one), name) for name in jobs]
            return Tally({name: task.result() for name, task in zip(jobs, tasks, strict=True)})


def run_directions(jobs: Mapping[str, Callable[[], object]], workers: int = 4, spark: SparkSession | None = None, stop_on_failure: bool = False) -> Tally:
    """Runs named jobs side by side (see Directions) and tells how each ended."""
    return Directions(spark or SparkSession.active(), workers, stop_on_failure).run(jobs)


def evaluate_runs(runs: Mapping[str, DataFrame | None], items: DataFrame, policy: str = "auto", score: str | None = None) -> DataFrame:
    """Metrics rows of several runs' stored hypotheses, by run; runs without any (None) are passed over."""
    out = None
    for name, hypotheses in runs.items():
        if hypotheses is not None:
            one = metrics_of(items, hypotheses, policy, score).select(F.lit(name).alias("run"), "*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no run has hypotheses")
    return out


def expert_assets(directions: Sequence[tuple[str, str]], prefix: str, limit: int) -> list[dict]:
    """Router entries of the directions' experts."""
    return [{"src_lang": s, "tgt_lang": t, "dataset": f"{prefix}_{s}__{t}", "adapter_name": f"{prefix}_{s}_to_{t}", "adapter_path": f"adapters/{prefix}_{s}__{t}", "limit": limit} for s, t in directions]
