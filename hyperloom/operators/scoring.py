"""The seam for outside models: texts go out in Arrow batches, answers come back keyed by id.

A client is any picklable function (texts, budget) -> answers that may raise; the default answers from a hash of the text,
so plans run without a network and give the same result every time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import parse

Client = Callable[[list[str], int], list[str]]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def hashed_judge(texts: list[str], budget: int) -> list[str]:
    """A score of 1..10 for each text, from its hash."""
    return [f"Score: {_number(t) % 10 + 1}." for t in texts]


def hashed_verdict(texts: list[str], budget: int) -> list[str]:
    """A verdict for each faithfulness prompt, by hashes: which of the given quantities are met, and whether the target is."""
    out = []
    for t in texts:
        given = next((line.removeprefix(GIVEN) for line in t.splitlines() if line.startswith(GIVEN)), "")
        out.append("Verdict: " + json.dumps({"leaf_hits": {v: _number(v) % 2 == 0 for v in given.split(", ")}, "target_present": _number(t) % 2 == 0}))
    return out


#: What each judge is asked to do, in our own words, and its budget of tokens.
GIVEN = "Given: "
TASKS = {
    "difficulty": ("Rate how hard the question is, from 1 to 10. Answer with the number.", 64),
    "feasibility": ("Rate how well the question can be solved from what it gives, from 1 to 10. Answer with the number.", 64),
    "faithfulness": ("Say as JSON which given quantities the question states (leaf_hits) and whether it asks for the target (target_present).", 256),
}


def judge_prompt(task: str, trace: Column, leafs: Column, target: Column, question: Column) -> Column:
    """The prompt of one of the ``TASKS``; what is null counts as empty, no leafs as (none)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    given = F.coalesce(F.nullif(F.array_join(leafs, ", "), F.lit("")), F.lit("(none)"))
    return F.concat(F.lit(f"{TASKS[task][0]}\n"), text(trace), F.lit(f"\n{GIVEN}"), given, F.lit("\nTarget: "), text(target), F.lit("\nQuestion: "), text(question))


def ask(client: Client, texts: list[str], budget: int, tries: int = 3, most: int = 16_384, wait: float = 1.0) -> list[str | None]:
    """Answers of one batch; a failing call is repeated with four times the budget after 1, 2, 4 .. waits, then null."""
    for k in range(tries):
        try:
            return list(client(texts, min(most, budget * 4**k)))
        except Exception:  # whatever the client raises
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return [None] * len(texts)


def ask_batch(batch: Client, single: Client, texts: list[str], budget: int, **how) -> list[str | None]:
    """Answers of a client that takes many texts at once; one by one where it fails or does not answer each text."""
    try:
        got = list(batch(texts, budget))
        if len(got) == len(texts):
            return got
    except Exception:  # whatever the client raises
        pass
    return [ask(single, [t], budget, **how)[0] for t in texts]


def judged(rows: DataFrame, key: str, prompts: dict[str, str], clients: dict[str, Client], rows_at_once: int = 256, **how) -> DataFrame:
    """(key, one answer for each judge): the judges of a batch are asked side by side.

    ``prompts`` names the column of each judge's prompt, ``clients`` its client. A judge that fails gives null and leaves
    the others' answers as they are.
    """
    kind, names = dict(rows.dtypes)[key], list(prompts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(len(names)) as pool:
            for batch in batches:
                for part in (batch.slice(at, rows_at_once) for at in range(0, batch.num_rows, rows_at_once)):
                    asked = [pool.submit(ask, clients[n], part.column(1 + k).to_pylist(), TASKS.get(n, ("", 512))[1], **how) for k, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(a.result(), pa.string()) for a in asked)], names=[key, *names])

    return rows.select(key, *(prompts[n] for n in names)).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` string" for n in names)]))


def judge_questions(rows: DataFrame, key: str, clients: dict[str, Client] | None = None, **how) -> DataFrame:
    """(key, difficulty, feasibility, verdict) of every question; ``rows`` has trace_str, leafs, target and question.

    A failed judge of scores gives -1, a failed judge of faithfulness a verdict without hits.
    """
    clients = clients or {"difficulty": hashed_judge, "feasibility": hashed_judge, "faithfulness": hashed_verdict}
    asked = rows.select(key, *(judge_prompt(t, F.col("trace_str"), F.col("leafs"), F.col("target"), F.col("question")).alias(t) for t in TASKS))
    said = judged(asked, key, {t: t for t in TASKS}, clients, **how).join(rows.select(key, "leafs"), key)
    read = said.withColumn("v", parse.parse_verdict(F.col("faithfulness"), F.col("leafs")))
    return read.select(key, parse.parse_score(F.col("difficulty")).alias("difficulty"), parse.parse_score(F.col("feasibility")).alias("feasibility"), parse.verdict(F.col("v.leaf_hits"), F.col("v.target_present"), F.col("leafs")).alias("verdict"))


def answers(rows: DataFrame, key: str, text: str, client: Client = hashed_judge, budget: int = 512, per_minute: int | None = None) -> DataFrame:
    """(key, answer) for every row whose text is not null; ``per_minute`` bounds the texts sent by one partition."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, sent = time.monotonic(), 0
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                sent += len(texts)
                if per_minute:
                    time.sleep(max(0.0, began + 60.0 * (sent - per_minute) / per_minute - time.monotonic()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ask(client, texts, budget), pa.string())], names=[key, "answer"])

    return rows.where(f"`{text}` is not null").select(key, text).mapInArrow(run, f"`{key}` {kind}, answer string")
