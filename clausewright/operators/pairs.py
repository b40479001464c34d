"""Sentence pairs from feedback, and training samples from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.identifiers import decoration

KEPT = ["update_time", "id", "task_id", "index_id", "text_block_id", "page_id", "phrase_id", "ts_term", "ts_text"]


def in_dates(fb: DataFrame, start: Column, end: Column, *, time: str = "update_time") -> DataFrame:
    """Records from ``start`` up to and with ``end``; a plain filter, so that it reaches the scan."""
    return fb.where(F.col(time).between(start, end))


def sentence_pairs(fb: DataFrame, *, compat: bool = True) -> DataFrame:
    """A row per judged candidate and per text that a reviewer wrote.

    Unjudged records give their first candidate; true candidates and written texts entail, the others contradict.  The
    section comes from what decorates the identifier.  With compat a written text has the identifier of the candidate at
    its place, though its section is that of the manual identifier.
    """
    kept = [c for c in KEPT if c in fb.columns]
    default = F.array(F.struct(F.lit(0).alias("n"), F.lit(True).alias("judge")))
    judges = F.transform("result", lambda r, n: F.struct(n.alias("n"), r.alias("judge")))
    found = fb.where(F.size("match_term_list") > 0).select(*kept, "identifier_list", "match_term_list", F.explode(F.when(F.col("result").isNull(), default).otherwise(judges)).alias("j"))
    ident = F.get("identifier_list", F.col("j.n"))
    section, sub = decoration(ident)
    a = found.select(*kept, ident.alias("identifier"), section.alias("fa_section"), sub.alias("fa_sub_section"), F.get("match_term_list", F.col("j.n")).alias("fa_text"), F.lit(False).alias("is_manual_content"), F.when(F.col("j.judge"), "entailment").otherwise("contradiction").alias("label"))
    said = fb.where(F.size("manual_content") > 0).select(*kept, "identifier_list", "manual_identifier", F.posexplode("manual_content").alias("n", "fa_text"))
    manual = F.get("manual_identifier", F.col("n"))
    section, sub = decoration(manual)
    b = said.select(*kept, (F.get("identifier_list", F.col("n")) if compat else manual).alias("identifier"), section.alias("fa_section"), sub.alias("fa_sub_section"), "fa_text", F.lit(True).alias("is_manual_content"), F.lit("entailment").alias("label"))
    return a.unionByName(b)


def with_section(pairs: DataFrame) -> DataFrame:
    """Texts as a model reads them, with section and sub-section before."""
    head = lambda *c: F.nullif(F.concat_ws(" - ", *(F.nullif(x, F.lit("")) for x in c)), F.lit(""))
    return pairs.withColumns({"sentence1": F.concat_ws(": ", head(F.col("ts_term")), F.col("ts_text")), "sentence2": F.concat_ws(": ", head(F.col("fa_section"), F.col("fa_sub_section")), F.col("fa_text"))})


def label_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == "entailment").alias("entailment"), F.count_if(F.col("label") == "contradiction").alias("contradiction"))


def scores(label: Column, seed: int = 7) -> Column:
    """Between 0.999 and 1 for entailment, 0.3 otherwise."""
    return F.when(label == "entailment", F.rand(seed) * 0.001 + 0.999).otherwise(0.3)


def adjacency(pairs: DataFrame, a: str = "sentence1", b: str = "sentence2") -> DataFrame:
    """(sentence, entailment, contradiction): which sentences each is judged against, either way round."""
    both = pairs.select(F.col(a).alias("sentence"), F.col(b).alias("other"), "label").unionByName(pairs.select(F.col(b).alias("sentence"), F.col(a).alias("other"), "label"))
    pick = lambda x: F.array_sort(F.collect_set(F.when(F.col("label") == x, F.col("other"))))
    return both.distinct().groupBy("sentence").agg(pick("entailment").alias("entailment"), pick("contradiction").alias("contradiction"))


def training_samples(adjacent: DataFrame, *, copies: int = 100, seed: int = 7) -> DataFrame:
    """(anchor, positive, negative), both ways round, ``copies`` times, for sentences with both kinds of partner."""
    both = adjacent.where((F.size("entailment") > 0) & (F.size("contradiction") > 0))
    many = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    draw = lambda c, s: F.get(c, F.floor(F.rand(s) * F.size(c)).cast("int"))
    drawn = many.withColumns({"e": draw("entailment", seed), "c": draw("contradiction", seed + 1)})
    return drawn.select("copy", F.col("sentence").alias("anchor"), F.col("e").alias("positive"), F.col("c").alias("negative")).unionByName(drawn.select("copy", F.col("e").alias("anchor"), F.col("sentence").alias("positive"), F.col("c").alias("negative")))
