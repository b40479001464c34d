"""Finding a clause by a box on a page and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import geometry as G
from clausewright.operators.tokenise import ngrams


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def longest_shared_run(a: Column, b: Column) -> Column:
    """Words of the longest run (two words at least, and two fewer than the text has) of one text inside the other; 0 for none.

    Runs of ``a`` are tried first, from long to short, and those of ``b`` only if none of ``a`` is found.
    """

    def runs(x: Column, other: Column) -> Column:
        words, whole = _words(x), F.lower(other)
        sizes = F.when(F.size(words) >= 4, F.sequence(F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
        hit = F.filter(sizes, lambda n: F.exists(ngrams(words, n), lambda g: F.contains(whole, g)))
        return F.coalesce(F.array_max(hit), F.lit(0))

    enough = (F.size(_words(a)) > 1) & (F.size(_words(b)) > 1)
    own = runs(a, b)
    return F.when(enough, F.when(own > 0, own).otherwise(runs(b, a))).otherwise(0)


def shared_words(a: Column, b: Column) -> Column:
    """The greater of how many words of each text are words of the other."""
    words = lambda t: F.filter(F.split(F.lower(F.regexp_replace(t, r"[^\w\s]", "")), r"\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    return F.greatest(F.size(F.filter(x, lambda w: F.array_contains(y, w))), F.size(F.filter(y, lambda w: F.array_contains(x, w))))


def find_clause(requests: DataFrame, clauses: DataFrame, *, request: str = "id", doc: str = "file_id", page: str = "page_id", pos: str = "pos") -> DataFrame:
    """(request, identifier, text) for requests (id, file, page, box, text).

    Candidates are rows of the page whose box overlaps the request's.  The best is one with an equal text, then one
    that contains it, then one with the longest shared run of words, then the first; case is ignored.  Both are null
    if no candidate has an identifier.  Requests meet a page's rows in an equi join.
    """
    ask = requests.select(request, doc, page, F.col("box").alias("__box"), F.col("text").alias("__text"))
    near = ask.join(clauses.select(doc, page, pos, "box", "identifier", F.col("text").alias("found")), [doc, page]).where(G.boxes_overlap(F.col("box"), F.col("__box")))
    text, wanted = F.lower(F.coalesce("found", F.lit(""))), F.lower(F.coalesce("__text", F.lit("")))
    run = F.when(F.coalesce("found", F.lit("")) != "", longest_shared_run(F.col("found"), F.col("__text"))).otherwise(0)
    known = F.col("found").isNotNull() & (F.col("found") != "")
    scored = near.withColumns({"__equal": known & (text == wanted), "__within": known & F.contains(text, wanted), "__run": run})
    w = Window.partitionBy(request)
    ranked = scored.withColumn("__any", F.max(F.col("identifier").isNotNull()).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("__equal"), F.desc("__within"), F.desc("__run"), pos)))
    best = ranked.where("__n = 1 and __any").select(request, "identifier", F.col("found").alias("text"))
    return requests.select(request).join(best, request, "left")


def clauses_of_tasks(requests: DataFrame, tasks: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their task's agreement, and the clauses of just those agreements."""
    asked = requests.join(tasks.select("task_id", F.col("fa_file_id").alias("file_id")), "task_id")
    return asked, clauses.join(asked.select("file_id").distinct(), "file_id", "left_semi")
