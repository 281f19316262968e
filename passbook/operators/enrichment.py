"""Calling an external model from tasks, with every attempt kept as a row.

A client is any ``load() -> call(text, system) -> text``, ``system`` being the instructions that go
with the text; ``load`` runs once per task. It raises
``Transient`` for what may pass on a later attempt and ``Refused`` for what will not.
"""

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passbook.operators.batching import request_payloads
from passbook.operators.responses import first_valid_attempt, validate_responses, with_fallback
from passbook.schemas import ANSWERS, CATEGORY_OPTIONS
from passbook.scratch import scratch_folder, written
from passbook.sources.tables import AppendTable


class Transient(Exception):
    """Rate limit or lost connection."""


class Refused(Exception):
    """The service answered with an error that repeating will not mend."""


@dataclass(frozen=True)
class RetryPolicy:
    """Waits grow as multiplier * 2^n between the two bounds."""

    attempts: int = 4
    multiplier: float = 2.0
    shortest: float = 2.0
    longest: float = 30.0

    def wait(self, attempt: int) -> float:
        """Seconds to wait after failed attempt number ``attempt`` (1-based)."""
        return max(self.shortest, min(self.longest, self.multiplier * 2.0 ** (attempt - 1)))


CATEGORIZE_RETRIES = RetryPolicy(attempts=4)
ANSWER_RETRIES = RetryPolicy(attempts=3)

# The instructions that go with every categorising request.
CATEGORIZE_SYSTEM = (
    "You sort bank transactions into categories. The message is a JSON list of transactions with id, description and "
    'amount. Reply with one JSON object {"results": [{"id": 0, "category": "..."}]} and nothing else: every id exactly '
    f"once, each category one of: {', '.join(CATEGORY_OPTIONS)}."
)
# Fixed value: what is shown when a call fails.
FAILED_ANSWER = "Sorry, I couldn't generate an answer right now ({}). Please try again."

# Answers that one write stores at least, and writes of a round at most, so that their number
# does not grow with the requests; a lost driver repeats the calls of one write.
CALLS_PER_SAVE = 1_000
SAVES_PER_ROUND = 20


def request_key(text: Column, system: Column) -> Column:
    """Names a request: equal text under equal instructions is asked once."""
    return F.sha2(F.concat_ws("\0", system, text), 256)


def call_requests(requests: DataFrame, load: Callable, attempt: int, run: str, tasks: int | None = None, forgiving: bool = False) -> DataFrame:
    """One call per row of ``requests`` (request, payload, system), as rows of the answer table.

    ``tasks`` caps how many calls run at the same time. ``forgiving``: an unknown error is an answer that
    failed for good, but for a ``RuntimeError`` (a client that is not configured), which stops the job.
    """

    def ask(pages):
        call = load()
        for page in pages:
            out = []
            for request, payload, system in zip(page["request"], page["payload"], page["system"]):
                try:
                    out.append((request, run, attempt, call(payload, system), None, False))
                except Transient as error:
                    out.append((request, run, attempt, None, str(error), False))
                except Refused as error:
                    out.append((request, run, attempt, None, str(error), True))
                except Exception as error:
                    if not forgiving or isinstance(error, RuntimeError):
                        raise
                    out.append((request, run, attempt, None, str(error), True))
            yield pd.DataFrame(out, columns=names)

    names = ANSWERS.names[:-1]
    source = requests.select("request", "payload", "system")
    source = source.repartition(tasks) if tasks else source
    return source.mapInPandas(ask, StructType(ANSWERS.fields[:-1])).withColumn("asked_at", F.current_timestamp())


def ask_rounds(
    requests: DataFrame,
    store: AppendTable,
    load: Callable,
    accepted: Callable[[DataFrame], DataFrame],
    policy: RetryPolicy,
    tasks: int | None,
    pause: Callable[[float], None],
    forgiving: bool = False,
) -> DataFrame:
    """What ``store`` holds for ``requests`` once each has an accepted answer or was asked ``policy.attempts`` times.

    ``accepted`` takes answers with text and returns the ``request`` of those that will do. The store is
    read before anything is asked and written after every ``CALLS_PER_SAVE`` calls, or a part in
    ``SAVES_PER_ROUND`` of a round's if that is more, so answers outlive a lost driver, and what comes back
    reads stored rows only.
    """
    spark, run = requests.sparkSession, uuid.uuid4().hex
    folder = scratch_folder(spark, "requests")
    requests = written(requests.select("request", "payload", "system").dropDuplicates(["request"]), folder, "all")
    known = lambda: store.read().join(requests.select("request"), "request", "left_semi")
    for attempt in range(1, policy.attempts + 1):
        answers = known()
        refused = answers.filter(F.col("final") & (F.col("run") == run)).select("request")
        done = accepted(answers.filter(F.col("raw").isNotNull())).select("request").unionByName(refused)
        pending = written(requests.join(done, "request", "left_anti"), folder, f"pending-{attempt}")
        count = pending.count()
        if not count:
            break
        if attempt > 1:
            pause(policy.wait(attempt - 1))
        saves = min(-(-count // CALLS_PER_SAVE), SAVES_PER_ROUND)
        turn = F.pmod(F.xxhash64("request"), F.lit(saves))
        for i in range(saves):
            store.append(call_requests(pending.filter(turn == i), load, attempt, run, tasks, forgiving))
    return known()


def categorize_with_model(
    batched: DataFrame,
    load: Callable,
    folder: str,
    policy: RetryPolicy = CATEGORIZE_RETRIES,
    tasks: int | None = None,
    pause: Callable[[float], None] = time.sleep,
    store: AppendTable | None = None,
) -> DataFrame:
    """txn_key_hash, category, origin for every batched row.

    Each round asks the batches without a valid answer; at most ``policy.attempts`` rounds run, whatever
    the number of batches. Answers are kept in ``store`` (a table in ``folder`` without one): a batch that
    was answered before is not asked again, whichever run asked.
    """
    spark = batched.sparkSession
    store = store or AppendTable(spark, f"{folder}/responses", ANSWERS)
    batched = written(batched, folder, "batched")
    system = F.lit(CATEGORIZE_SYSTEM)
    payloads = written(request_payloads(batched).withColumn("request", request_key(F.col("payload"), system)), folder, "payloads")

    def judged(answers: DataFrame) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("batch_id").orderBy("asked_at", "run", "attempt"))
        responses = answers.join(payloads.select("request", "batch_id"), "request").select("batch_id", turn.alias("attempt"), "raw")
        return validate_responses(payloads, responses)

    def accepted(answers: DataFrame) -> DataFrame:
        return payloads.join(judged(answers).filter("ok"), "batch_id", "left_semi").select("request")

    answers = ask_rounds(payloads.withColumn("system", system), store, load, accepted, policy, tasks, pause)
    return with_fallback(batched, first_valid_attempt(judged(answers.filter(F.col("raw").isNotNull()))))


def echo_client():
    """The offline default: repeats the evidence lines of the prompt."""

    def call(prompt: str, system: str) -> str:
        lines = [line for line in prompt.split("\n") if line.startswith("- ")]
        return "\n".join(lines)

    return call


def answer_prompts(
    prompts: DataFrame,
    load: Callable = echo_client,
    policy: RetryPolicy = ANSWER_RETRIES,
    tasks: int | None = None,
    pause: Callable[[float], None] = time.sleep,
    store: AppendTable | None = None,
) -> DataFrame:
    """query_id, answer. A failed call becomes a sentence in its row; a RuntimeError (a client
    that is not configured) stops the job.

    The model is asked here, once for each distinct prompt that ``store`` (a run-time table without one)
    has no answer to; actions on the result read stored rows.
    """
    spark = prompts.sparkSession
    folder = scratch_folder(spark, "answers")
    store = store or AppendTable(spark, f"{folder}/store", ANSWERS)
    asked = prompts.select("query_id", "prompt", "system", "message").withColumn("request", request_key(F.col("prompt"), F.col("system")))
    asked = written(asked, folder, "asked")
    requests = asked.filter(F.col("message").isNull()).withColumnRenamed("prompt", "payload")
    answers = ask_rounds(requests, store, load, lambda some: some, policy, tasks, pause, forgiving=True)
    first = F.min(F.when(F.col("raw").isNotNull(), F.struct("asked_at", "run", "raw")))
    last = F.max(F.when(F.col("raw").isNull(), F.struct("asked_at", "attempt", "error")))
    per_request = answers.groupBy("request").agg(first.alias("_first"), last.alias("_last"))
    before, after = FAILED_ANSWER.split("{}")
    failure = F.concat(F.lit(before), F.coalesce("_last.error", F.lit("")), F.lit(after))
    answer = F.coalesce("message", "_first.raw", failure)
    return asked.join(per_request, "request", "left").select("query_id", answer.alias("answer"))
