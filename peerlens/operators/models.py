"""Model calls: prompts, summaries in windows, scores of pairs. Clients are injected; the ones here need no network."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.config import MAX_CHARS, TARGET_WORDS, model_budget
from peerlens.functions import text as X
from peerlens.operators.chunks import word_windows
from peerlens.plans import stage

#: A prompt (and whether the answer must be JSON) to an answer.
Generator = Callable[[str, bool], str]


@dataclass
class HttpGenerator:
    """A local model server that takes POST /api/generate."""

    model: str
    url: str = "http://127.0.0.1:11434"
    timeout: float = 300.0

    def __call__(self, prompt: str, as_json: bool = False) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}} | ({"format": "json"} if as_json else {})
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            answer = str(json.load(reply).get("response") or "").strip()
        if not answer:
            raise RuntimeError("the model returned nothing")
        return answer


def lead_words(words: int = 120) -> Generator:
    """Stand-in for a summarizer: the first words of what follows the last TEXT: line."""
    return lambda prompt, as_json=False: " ".join(prompt.rpartition("TEXT:\n")[2].split()[:words]) or "-"


def overlap_scorer(prompt: str, as_json: bool = True) -> str:
    """Stand-in for a reranker: the share of common words of the two texts, as the JSON reply of a model."""
    _, _, rest = prompt.partition("FOCAL:\n")
    a, _, b = rest.partition("\nPEER:\n")
    x, y = set(a.lower().split()), set(b.lower().split())
    return json.dumps({"score": round(100 * len(x & y) / len(x | y), 4) if x | y else 0, "reason": "shared words"})


def map_prompt(text: Column, previous: Column, item: Column, words: Column) -> Column:
    """Prompt for the summary of one window; the previous year's text goes in only if it is there."""
    context = F.when(F.coalesce(previous, F.lit("")) != "", F.concat(F.lit("\nLAST YEAR:\n"), previous)).otherwise("")
    return F.concat(F.lit("Summarize item "), item, F.lit(" of a company's filing in about "), words.cast("string"), F.lit(" words, to compare companies: products, customers, regions, strategy, risks, regulation, capital, and what changed since last year. Leave out boilerplate and invent nothing."), context, F.lit("\nTEXT:\n"), text)


def reduce_prompt(parts: Column, item: Column, words: Column) -> Column:
    """Prompt that merges the summaries of windows."""
    return F.concat(F.lit("Merge these partial summaries of item "), item, F.lit(" into one of about "), words.cast("string"), F.lit(" words, without repeating points.\nTEXT:\n"), parts)


def rerank_prompt(focal: Column, peer: Column, item: Column, most: int = MAX_CHARS) -> Column:
    """Prompt for the similarity of two companies by one item; each text cut to its two ends."""
    return F.concat(F.lit("Judge from these texts of item "), item, F.lit(' alone how alike the two companies are in business, products, customers, regions, strategy, risks and finances; shared legal phrases do not count. Reply as JSON {"score": 0-100, "reason": "..."}.\nFOCAL:\n'), X.head_and_tail(focal, most), F.lit("\nPEER:\n"), X.head_and_tail(peer, most))


def parse_reply(reply: Column) -> Column:
    """score (0 to 1), reason and error of a reply: JSON, or with text around it what stands between its first and last
    brace. A score may be a number or a string of one; a missing one is 0, one out of range is clamped. A reply without
    such an object, or whose score is no number, has an error and no score; null has neither."""
    # a list of exactly one value: the parser alone would pass over what follows the first
    only = lambda text: F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    braced = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    single = lambda v: F.when(at(v, "$[1]", "variant").isNull(), at(v, "$[0]", "variant"))
    payload = F.coalesce(single(only(reply)), single(only(braced)))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")), F.lit(False))
    given = F.coalesce(F.schema_of_variant(at(payload, "$.score", "variant")), F.lit("none"))
    number = F.when(given == "none", F.lit(0.0)).otherwise(at(payload, "$.score", "double"))
    score = F.when(is_object & number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)) / 100)
    reason = F.when(score.isNotNull(), F.trim(F.coalesce(at(payload, "$.reason", "string"), F.lit(""))))
    error = F.when(reply.isNotNull() & score.isNull(), F.when(is_object, F.lit("the score is no number")).otherwise(F.lit("no JSON object in the reply")))
    return F.struct(score.alias("score"), reason.alias("reason"), error.alias("error"))


def call(df: DataFrame, prompt: str, generator: Generator, out: str, as_json: bool = False, error: str | None = None) -> DataFrame:
    """Adds the answers. A failed call fails the query, or with `error` leaves a null answer and the message there.

    Calls are not repeatable for free: stage the result before using it twice.
    """
    kind = f"struct<answer:string,error:string>"

    @F.pandas_udf(kind)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    rows.append((None if p is None else generator(p, as_json), None))
                except Exception as e:  # noqa: BLE001
                    if error is None:
                        raise
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    called = df.withColumn("_call", answers(F.col(prompt)))
    called = called.withColumn(out, F.col("_call.answer"))
    return (called.withColumn(error, F.col("_call.error")) if error else called).drop("_call")


def window_plan(tokens: Column, budget: int) -> Column:
    """overlap, windows and words of each partial summary for a text of so many words: one window within the budget,
    else windows of `budget` words that overlap by a tenth, at least 150."""
    overlap = max(150, budget // 10)
    step = max(1, budget - overlap)
    n = F.when(tokens <= budget, 1).otherwise(F.ceil(tokens / step)).cast("int")
    return F.struct(F.lit(overlap).alias("overlap"), n.alias("windows"))


def partial_target(target: int, windows: Column) -> Column:
    return F.least(F.lit(300), F.greatest(F.lit(120), F.ceil(F.lit(target) / windows))).cast("int")


def with_previous_year(items: DataFrame, keys: list[str], text: str, words: int = 700) -> DataFrame:
    """Adds previous_text (its first words) and previous_year_available: the text of the same keys exactly one year
    before. keys: without year."""
    before = items.select(*keys, (F.col("year") + 1).alias("year"), X.first_words(F.col(text), words).alias("previous_text")).dropDuplicates([*keys, "year"])
    return items.join(before, [*keys, "year"], "left").withColumn("previous_year_available", F.col("previous_text").isNotNull())


def summarize(items: DataFrame, keys: list[str], item: str, text: str, generator: Generator, model: str, target: int = TARGET_WORDS, map_reduce: bool = True) -> DataFrame:
    """keys, summary, target_words, llm, windows, of items with text; items may have previous_text. Texts within the
    model's budget are summarized in one call; others window by window, and the parts then merged by another call."""
    budget = model_budget(model)
    previous = F.col("previous_text") if "previous_text" in items.columns else F.lit(None).cast("string")
    rows = items.select(*keys, F.col(item).alias("_item"), X.collapse(F.col(text)).alias("_text"), previous.alias("_before")).where("_text <> ''")
    tokens = X.token_count(F.col("_text"))
    plan = window_plan(tokens, budget)
    long = (plan["windows"] > 1) if map_reduce else F.lit(False)
    windows = F.when(long, word_windows(F.col("_text"), F.lit(budget), F.lit(budget) - plan["overlap"])).otherwise(F.array("_text"))
    parts = rows.withColumn("_w", windows).withColumn("_n", F.size("_w")).select(*keys, "_item", "_before", "_n", F.posexplode("_w").alias("_i", "_part"))
    words = F.when(F.col("_n") > 1, partial_target(target, F.col("_n"))).otherwise(F.lit(target))
    parts = parts.withColumn("_prompt", map_prompt(F.col("_part"), F.col("_before"), F.col("_item"), words)).drop("_part", "_before")
    mapped = stage(call(parts, "_prompt", generator, "_answer").drop("_prompt"), "summaries")
    merged = mapped.groupBy(*keys, "_item").agg(F.max("_n").alias("windows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_answer"))), lambda x: x["_answer"]), "\n\n").alias("_parts"))
    prompts = merged.withColumn("_prompt", F.when(F.col("windows") > 1, reduce_prompt(F.col("_parts"), F.col("_item"), F.lit(target))))
    done = call(prompts, "_prompt", generator, "_final")
    return done.select(*keys, F.coalesce("_final", "_parts").alias("summary"), F.lit(target).alias("target_words"), F.lit(model).alias("llm"), "windows")


def rerank(candidates: DataFrame, texts: DataFrame, generator: Generator = overlap_scorer, most: int = MAX_CHARS) -> DataFrame:
    """Candidates (focal_firm, year, item_id, peer_firm, ...) with rerank_score, reason and error. texts: firm, year,
    item_id, text, one row each; pairs without both texts are dropped before any call. A reply that can't be read leaves
    its error and no score, and final_ranking leaves such a pair out. Staged, as calls are dear."""
    side = lambda who: texts.where(F.rlike("text", F.lit(X.NOT_WS))).select(F.col("firm").alias(f"{who}_firm"), "year", "item_id", F.col("text").alias(f"_{who}"))
    both = candidates.join(side("focal"), ["focal_firm", "year", "item_id"]).join(side("peer"), ["peer_firm", "year", "item_id"])
    asked = both.withColumn("_prompt", rerank_prompt(F.col("_focal"), F.col("_peer"), F.col("item_id"), most)).drop("_focal", "_peer")
    done = stage(call(asked, "_prompt", generator, "_reply", as_json=True).drop("_prompt"), "reranked")
    reply = parse_reply(F.col("_reply"))
    return done.withColumn("_r", reply).select("*", F.col("_r.score").alias("rerank_score"), F.col("_r.reason").alias("reason"), F.col("_r.error").alias("error")).drop("_reply", "_r")


def expected_calls(universe: int, items: int, q_share: float) -> int:
    """How many pairs a focal firm's query sends to the model."""
    return items * math.ceil(q_share * universe)
