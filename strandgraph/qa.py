"""Questions: decomposition, answers step by step, reflection and judging, for a batch of questions at a time.

All questions that are at the same step go through one retrieval and one model
job; only the number of steps is a loop on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.hooks import Model, ask, prompt
from strandgraph.operators.content import matches
from strandgraph.storage import Scratch

#: What a reply says when it is done, or when it asks on.
ANSWER_MARK, QUERY_MARK = "So the answer is:", "The new query is:"
#: ``(query_id, query)`` -> ``(query_id, context)``.
Retrieve = Callable[[DataFrame], DataFrame]


def decompose(questions: DataFrame, model: Model, template: str = "Decompose: {question}") -> DataFrame:
    """``questions(question_id, question)`` -> ``(question_id, step, sub_question)``; an unreadable reply leaves the question whole."""
    asked = questions.select(F.col("question_id").alias("id"), prompt(template, question=F.col("question")).alias("prompt"))
    rows = questions.join(Scratch(questions.sparkSession).write(ask(asked, model)).withColumnRenamed("id", "question_id"), "question_id")
    plain = F.from_json("reply", "array<string>")
    inner = F.from_json(F.get_json_object("reply", "$.sub_questions"), "array<string>")
    listed = [F.transform(a, lambda x: F.coalesce(F.get_json_object(x, "$['sub-question']"), x)) for a in (plain, inner)]
    some = [F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != "")) for a in listed]
    subs = F.coalesce(*[F.when(F.size(a) > 0, a) for a in some], F.array("question"))
    return rows.select("question_id", F.posexplode(subs).alias("step", "sub_question"))


def _answer(queries: DataFrame, retrieve: Retrieve, model: Model, template: str, scratch: Scratch) -> DataFrame:
    """``queries(query_id, query)`` -> the same with ``context`` and ``reply``."""
    seen = scratch.write(queries.join(retrieve(queries), "query_id", "left"))
    asked = seen.select(F.col("query_id").alias("id"), prompt(template, question=F.col("query"), context=F.col("context")).alias("prompt"))
    return scratch.write(seen.join(ask(asked, model).withColumnRenamed("id", "query_id"), "query_id"))


def answer_steps(subs: DataFrame, retrieve: Retrieve, model: Model, template: str = "{context}\n{question}") -> DataFrame:
    """``(question_id, step, sub_question)`` -> with ``context`` and ``reply``; each query begins with the reply before."""
    scratch = Scratch(subs.sparkSession)
    subs = scratch.write(subs)
    last = subs.agg(F.max("step")).first()[0]
    out, before = None, None
    for step in range((last if last is not None else -1) + 1):
        now = subs.filter(F.col("step") == step)
        if before is not None:
            now = now.join(before, "question_id", "left").withColumn("query", F.concat_ws(", ", "previous", "sub_question"))
        else:
            now = now.withColumn("query", F.col("sub_question"))
        done = _answer(now.select(F.col("question_id").alias("query_id"), "step", "sub_question", "query"), retrieve, model, template, scratch).withColumnRenamed("query_id", "question_id")
        before = done.select("question_id", F.col("reply").alias("previous"))
        out = done if out is None else out.unionByName(done)
    return out if out is not None else subs.withColumns({c: F.lit(None).cast("string") for c in ("query", "context", "reply")})


def answered(steps: DataFrame) -> DataFrame:
    """The last step of each question of ``answer_steps``: ``(question_id, reply, answer, steps)``."""
    last = steps.groupBy("question_id").agg(F.max_by("reply", "step").alias("reply"), (F.max("step") + 1).alias("steps"))
    answer = F.when(F.contains("reply", F.lit(ANSWER_MARK)), F.trim(F.substring_index("reply", ANSWER_MARK, -1))).otherwise(F.col("reply"))
    return last.select("question_id", "reply", answer.alias("answer"), "steps")


def reflect(questions: DataFrame, retrieve: Retrieve, model: Model, steps: int = 0, template: str = "{context}\n{question}") -> DataFrame:
    """``questions(question_id, question)`` -> ``(question_id, reply, answer, steps)``.

    A reply with the answer's mark ends a question; one with a new query sends it
    round again, at most ``steps`` times, unless the query stays the same.
    """
    scratch = Scratch(questions.sparkSession)
    open_ = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    closed = None
    for step in range(steps + 1):
        got = _answer(open_, retrieve, model, template, scratch)
        fresh = F.when(F.contains("reply", F.lit(QUERY_MARK)), F.trim(F.substring_index("reply", QUERY_MARK, -1)))
        got = got.withColumn("next", F.when(~F.contains("reply", F.lit(ANSWER_MARK)), fresh))
        again = F.col("next").isNotNull() & (F.col("next") != F.col("query")) & F.lit(step < steps)
        answer = F.when(F.contains("reply", F.lit(ANSWER_MARK)), F.trim(F.substring_index("reply", ANSWER_MARK, -1))).otherwise(F.col("reply"))
        done = got.filter(~F.coalesce(again, F.lit(False))).select(F.col("query_id").alias("question_id"), "reply", answer.alias("answer"), F.lit(step).alias("steps"))
        closed = done if closed is None else closed.unionByName(done)
        open_ = scratch.write(got.filter(again).select("query_id", F.col("next").alias("query")))
        if open_.isEmpty():
            break
    return closed


def judge(results: DataFrame, model: Model | None = None, template: str = "{question}\n{gold}\n{answer}") -> DataFrame:
    """``results(question_id, question, gold, answer)`` with ``matched`` and, given a model, ``correct`` (1 if it replies "1")."""
    out = results.withColumn("matched", F.coalesce(matches(F.col("answer"), F.col("gold")), F.lit(False)))
    if model is None:
        return out.withColumn("correct", F.col("matched").cast("int"))
    asked = results.select(F.col("question_id").alias("id"), prompt(template, question=F.col("question"), gold=F.col("gold"), answer=F.col("answer")).alias("prompt"))
    said = ask(asked, model).select(F.col("id").alias("question_id"), (F.trim("reply") == "1").cast("int").alias("correct"))
    return out.join(said, "question_id", "left").withColumn("correct", F.coalesce("correct", F.lit(0)))
