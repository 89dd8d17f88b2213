"""A tagger that reads a word list, for use where no statistical tagger is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strings

STOP = ["the", "a", "an", "to", "for", "and", "or", "of", "on", "in", "by", "with", "it", "its", "that", "then", "before", "after", "please", "is", "are"]


class LexiconTagger:
    """verbs are always actions; ambiguous words are where they begin a sentence, or follow `after that` or `before that`.

    Entities are runs of other words; their root is the last word. `x before y` relates the actions next to it, `x after y` the other way round,
    and consecutive actions are in sequence."""

    def __init__(self, verbs: list[str], ambiguous: list[str] = (), stop: list[str] = STOP):
        self.verbs, self.ambiguous, self.stop = strings(*verbs), strings(*ambiguous), strings(*stop)

    def tokens(self, prompts: DataFrame) -> DataFrame:
        t = prompts.select("prompt_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+|[.;!?]"), F.lit(0))).alias("token_index", "text")).withColumn("low", F.lower("text"))
        w = Window.partitionBy("prompt_id").orderBy("token_index")
        one, two = F.lag("low", 1).over(w), F.lag("low", 2).over(w)
        starts = one.isNull() | one.isin(".", ";", "!", "?") | (one == "please")
        follows = (one == "that") & two.isin("after", "before")
        action = F.array_contains(self.verbs, F.col("low")) | (F.array_contains(self.ambiguous, F.col("low")) & (starts | F.coalesce(follows, F.lit(False))))
        word = F.col("low").rlike(r"^\p{L}")
        return t.withColumn("action", action).withColumn("noun", word & ~action & ~F.array_contains(self.stop, F.col("low")))

    def analyse(self, prompts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        t = self.tokens(prompts)
        w = Window.partitionBy("prompt_id").orderBy("token_index")
        number = lambda df: df.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))
        actions = number(t.where("action").select("prompt_id", "text", F.col("low").alias("lemma"), F.col("token_index").cast("long").alias("token_index")))
        island = t.where("noun").withColumn("g", F.col("token_index") - F.row_number().over(w))
        runs = island.groupBy("prompt_id", "g").agg(F.array_sort(F.collect_list(F.struct("token_index", "text", "low"))).alias("run"))
        last = F.element_at("run", -1)
        entities = number(runs.select("prompt_id", F.array_join(F.transform("run", lambda x: x["text"]), " ").alias("text"), last["low"].alias("root"), last["token_index"].cast("long").alias("token_index")))
        lemma = F.when(F.col("action"), F.col("low"))
        left = F.last(lemma, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        right = F.first(lemma, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        near = t.select("prompt_id", "token_index", "low", left.alias("l"), right.alias("r")).where("low IN ('before', 'after') AND l IS NOT NULL AND r IS NOT NULL AND l <> r")
        swap = F.col("low") == "after"
        said = near.select("prompt_id", F.col("token_index").cast("long").alias("at"), F.when(swap, F.col("r")).otherwise(F.col("l")).alias("source"), F.when(swap, F.col("l")).otherwise(F.col("r")).alias("target"), F.lit("before").alias("relation"))
        after = F.lead("lemma").over(w)
        line = actions.select("prompt_id", (F.col("token_index") + (1 << 32)).alias("at"), F.col("lemma").alias("source"), after.alias("target"), F.lit("sequence").alias("relation")).where("target IS NOT NULL")
        rel = said.unionByName(line).groupBy("prompt_id", "source", "target", "relation").agg(F.min("at").alias("at"))
        return actions, entities, rel.withColumn("seq", (F.row_number().over(Window.partitionBy("prompt_id").orderBy("at")) - 1).cast("int")).drop("at")
