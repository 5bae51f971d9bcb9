"""Judge prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.functions.exprs import strip
from tierwise.tiers import VERDICTS

CLIP = 2000
TEMPLATE = """Compare a candidate answer with a reference answer to the same question.
Say "equivalent" for the same substance, "acceptable" for a thinner answer that still serves the user, "worse" otherwise.
Reply with one JSON object only: {"verdict": "equivalent" | "acceptable" | "worse", "reason": "<one sentence>"}

<question>
%s
</question>

<reference>
%s
</reference>

<candidate>
%s
</candidate>"""
#: What can be wrong with a reply.
PROBLEMS = ("there is no JSON object in it", "the verdict is unknown or has no reason")
RETRY = """%s

Your reply was:
<previous>
%s
</previous>
It cannot be used: %s
Reply with the JSON object only."""


def judge_prompt(question: Column, reference: Column, candidate: Column) -> Column:
    parts = TEMPLATE.split("%s")
    return F.concat(F.lit(parts[0]), question, F.lit(parts[1]), reference, F.lit(parts[2]), candidate, F.lit(parts[3]))


def retry_prompt(prompt: Column, previous: Column, problem: Column) -> Column:
    parts = RETRY.split("%s")
    return F.concat(F.lit(parts[0]), prompt, F.lit(parts[1]), F.substring(previous, 1, CLIP), F.lit(parts[2]), problem, F.lit(parts[3]))


def parse_replies(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """rows with verdict and reason, both null unless the reply holds one JSON object with a known verdict and a reason that is text.

    The object reaches from the first to the last brace, so fences and prose around it do not matter; other keys are ignored.
    """
    body = F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)
    parsed = rows.withColumn("__json", F.try_parse_json(F.when(F.length(body) > 0, body)))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get("__json", f"$.{key}", "variant")) == "STRING", F.try_variant_get("__json", f"$.{key}", "string"))
    verdict = F.lower(strip(text("verdict")))
    reason = F.get(F.filter(F.transform(F.split(text("reason"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: F.length(x) > 0), F.lit(0))
    good = verdict.isin(*VERDICTS) & reason.isNotNull()
    return parsed.withColumn("__good", F.coalesce(good, F.lit(False))).select(*rows.columns, F.when(F.col("__good"), verdict).alias("verdict"), F.when(F.col("__good"), reason).alias("reason"))


def retries(rows: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """The rows whose reply gives no verdict, a null one included, with retry: the prompt to send again, which shows that reply and what is wrong with it."""
    body = F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)
    no_object = F.coalesce(F.try_parse_json(F.when(F.length(body) > 0, body)).isNull(), F.lit(True))
    problem = F.when(no_object, PROBLEMS[0]).otherwise(PROBLEMS[1])
    asked = retry_prompt(F.col(prompt), F.coalesce(F.col(reply), F.lit("")), problem)
    return parse_replies(rows.withColumn("retry", asked), reply).where("verdict is null").drop("verdict", "reason")


def judge_independence(judges: DataFrame, runs: DataFrame, frontier: str = "frontier") -> DataFrame:
    """Base names of judge models that are also frontier models; none may be."""
    from tierwise.functions.exprs import base_model

    own = runs.where(F.col("tier") == frontier).select(base_model(F.col("model")).alias("name")).distinct()
    return judges.select(base_model(F.col("judge_model")).alias("name")).distinct().join(own, "name", "left_semi")
