"""Classes by asking a model (N13): one decision a term, or rounds of lookups, over tables of prompts and replies.

A provider is a function of a table ``key, prompt`` that returns ``key, reply``; a tool is a table ``argument, answer``. Each
distinct term is asked about once (N12), all terms of a round together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..staging import stage

Provider = Callable[[DataFrame], DataFrame]
#: What a reply that calls a tool looks like: a fixed value.
ACTION_MARK = r"ACTION:\s*(\w+)\((.*)\)"


def judged(replies: DataFrame, classes: DataFrame, candidates: str) -> DataFrame:
    """``reply`` -> ``class_name``: the verdict if it is NONE or among the candidates, else the longest candidate that the
    reply names, else null."""
    v = text.parse_verdicts(replies, classes)
    admitted = F.col("ok") & ((F.col("class_name") == "NONE") | F.array_contains(candidates, F.col("class_name")))
    return v.withColumn("class_name", F.when(admitted, F.col("class_name")).otherwise(text.recover(F.col("reply"), F.col(candidates)))).drop("ok")


def decide(terms: DataFrame, classes: DataFrame, provider: Provider, template: str) -> DataFrame:
    """``term, sentence, candidates`` -> adds ``class_name``. Terms that differ in case only are one question, with the
    sentence and the candidates of the first; terms without candidates or refused by the sanitiser are not asked."""
    t = terms.withColumn("__s", text.sanitize(F.col("term"), F.col("sentence"))).withColumn("__key", F.lower("__s.term"))
    first = t.filter(F.col("__s.ok") & (F.size("candidates") > 0)).groupBy("__key").agg(F.min(F.struct("term", "sentence", "candidates", "__s")).alias("f"))
    ask = first.select(F.col("__key").alias("key"), "f.candidates", text.prompt(template, term=F.col("f.__s.term"), sentence=F.col("f.__s.sentence"), candidates=F.array_join("f.candidates", ", ")).alias("prompt"))
    ask = stage(ask, "prompts")
    got = judged(ask.join(provider(ask.select("key", "prompt")), "key", "left"), classes, "candidates").select(F.col("key").alias("__key"), "class_name")
    return t.join(got, "__key", "left").drop("__key", "__s")


def episodes(terms: DataFrame, classes: DataFrame, provider: Provider, tools: dict[str, DataFrame], template: str, most_steps: int = 4, closing: str = "Only the verdict now. ") -> DataFrame:
    """``term, sentence`` -> ``term, class_name, steps, hard``: rounds of lookups until a verdict.

    In a round every open term is asked with what it has seen; a call of a tool gets its answer, a verdict that is no class
    gets told so, anything else ends the rounds. What is open at the end gets one closing question. ``hard``: no
    verdict, one by the closing question, or one that took every step. Each round is staged; the driver loops over rounds."""
    t = terms.withColumn("__s", text.sanitize(F.col("term"), F.col("sentence"))).filter("__s.ok")
    t = t.groupBy(F.lower("__s.term").alias("key")).agg(F.min(F.struct("__s.term", "__s.sentence")).alias("f"))
    open_ = stage(t.select("key", text.prompt(template, term=F.col("f.term"), sentence=F.col("f.sentence")).alias("prompt"), F.lit(0).alias("steps"), F.lit(True).alias("going")), "episode")
    answers = None
    for name, table in tools.items():
        one = table.groupBy(F.col("argument").alias("t_argument")).agg(F.min("answer").alias("answer")).select(F.lit(name).alias("t_tool"), "t_argument", "answer")
        answers = one if answers is None else answers.unionByName(one)
    done = None

    def settle(rows: DataFrame, hard) -> None:
        nonlocal done
        now = rows.select("key", "class_name", "steps", hard.alias("hard"))
        done = now if done is None else done.unionByName(now)

    for step in range(1, most_steps + 1):
        asked = open_.filter("going")
        replies = text.parse_verdicts(asked.select("key", "prompt").join(provider(asked.select("key", "prompt")), "key", "left").withColumn("steps", F.lit(step)), classes)
        replies = stage(replies, "episode-replies")
        settle(replies.filter("ok"), F.lit(step == most_steps))
        call = replies.filter(~F.coalesce("ok", F.lit(False))).withColumn("tool", F.nullif(F.regexp_extract(F.coalesce("reply", F.lit("")), ACTION_MARK, 1), F.lit(""))).withColumn("argument", F.regexp_extract(F.coalesce("reply", F.lit("")), ACTION_MARK, 2))
        call = text.checked_arguments(call.withColumnRenamed("ok", "v_ok"), classes)
        if answers is not None:
            call = call.join(answers, (F.col("tool") == F.col("t_tool")) & (F.col("clean") == F.col("t_argument")), "left")
        else:
            call = call.withColumn("answer", F.lit(None).cast("string"))
        wrong = F.coalesce(F.col("reply"), F.lit("")).rlike("(?i)FINAL[_ ]VERDICT")
        seen = F.when(wrong, "That is no class. Answer with the exact name of one.").when(F.col("tool").isNotNull(), F.when(F.col("ok"), F.coalesce("answer", F.lit("nothing found"))).otherwise(F.concat(F.lit("Error: "), F.col("message"))))
        rest = call.select("key", F.concat_ws("\n", "prompt", "reply", F.concat(F.lit("OBSERVATION: "), seen)).alias("prompt"), "steps", seen.isNotNull().alias("going"))
        open_ = stage(rest.unionByName(open_.filter("NOT going")), "episode")
        if open_.filter("going").isEmpty():
            break
    last = open_.withColumn("prompt", F.concat("prompt", F.lit("\n"), F.lit(closing)))
    final = text.parse_verdicts(last.select("key", "prompt", "steps").join(provider(last.select("key", "prompt")), "key", "left"), classes)
    settle(final.withColumn("class_name", F.when(F.col("ok"), F.col("class_name"))), F.lit(True))
    return done.select(F.col("key").alias("term"), "class_name", "steps", "hard")
