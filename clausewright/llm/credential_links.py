"""Secret scanning with multipart credentials, in DataFrame operations alone.

Strong kinds are reported wherever they stand.  Weak kinds (a bare 40-character key, a user or client name, an
endpoint) are everywhere in clean text, so one is reported only when its complement is near: a key with an
identifier, a name or an endpoint with a secret.  Near means a gap of at most ``scope`` code points within one text.
Candidates and their possible complements are dealt to bins of that width and meet in a semi join, so no pairs
are made, and a text with very many candidates is met bin by bin.

Places count code points, ends are exclusive.  A weak candidate that overlaps a strong span is part of it and not
reported again.  Defined cases: a null text is the empty one; a text without spans has empty lists; rows that repeat are each
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import between, materialise, pieces_of, running, with_bound

# The strong kinds in report order, with the group that is measured and its least length.
STRONG = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
WEAK = (
    ("key40", r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])"),
    ("name", r"""(?i:(?:\b|(?<=_))(?:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    ("endpoint", r"""(?i:\b(?:https?|s3|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqps?))://[^\s"'<>]{4,}"""),
)
#: What a kind is in a credential, and what a weak kind needs near it.
ROLES = {"assign": "secret", "hex": "secret", "key40": "secret", "access": "identifier", "name": "identifier", "endpoint": "endpoint"}
NEEDS = {"key40": "identifier", "name": "secret", "endpoint": "secret"}
ORDER = [*(k[0] for k in STRONG), *(k[0] for k in WEAK)]

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _quick(kind: str, pattern: str, least: int) -> str:
    """A pattern with the same accepted matches that fails sooner: a run is matched whole or is too short anyway."""
    return {"access": rf"AKIA[A-Z0-9]{{{least - 4},}}", "hex": rf"[0-9a-f]{{{least},}}"}.get(kind, pattern)


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern as (start, rank, kind, end): the lengths of what is between them add up to their places."""
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), F.length) if group else F.transform(found, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.arrays_zip(F.transform(found, F.length).alias("n"), sizes.alias("v")), F.slice(gaps, 1, F.size(gaps) - 1), lambda m, g: F.struct(g.alias("gap"), m["n"].alias("n"), m["v"].alias("v")))

    def span(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        return F.when(x["v"] >= least, F.struct(begin.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (begin + x["n"]).alias("end")))

    return F.when(F.regexp_like(text, rx), running(steps, F.lit(0), lambda at, x: at + x["gap"] + x["n"], span, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidates(docs: DataFrame, key: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    """(row, key, strong, weak, carried columns): spans of every text; ``row`` names a row's key and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    found = {f"is_{k}": spans(F.col("text"), k, _quick(k, p, least), group, least) for k, p, group, least in STRONG}
    found |= {f"is_{k}": spans(F.col("text"), k, p) for k, p in WEAK}
    rows = rows.withColumns(found).select("*", F.concat(*(F.col(f"is_{k[0]}") for k in STRONG)).alias("strong"))
    weak = F.concat(*(F.col(f"is_{k[0]}") for k in WEAK))
    alone = F.filter(weak, lambda w: ~F.exists("strong", lambda s: overlaps(w, s)))
    row = F.concat_ws(":", F.hex(F.xxhash64("text")), F.length("text"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    return rows.select(row.alias("row"), "key", "strong", alone.alias("weak"), *(f"carry_{c}" for c in carry))


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(row, linked): the weak candidates of each row that have their complement within ``scope``."""
    some = found.where(F.size("weak") > 0)
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    need = F.create_map(*(F.lit(x) for kv in NEEDS.items() for x in kv))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = some.select("row", F.explode("weak").alias("w")).select("row", "w", need[F.col("w.kind")].alias("role"), bins(F.col("w.start"), F.col("w.end")).alias("bin"))
    parts = some.select("row", F.explode(F.concat("strong", "weak")).alias("p"))
    parts = parts.select(F.col("row").alias("row_"), "p", role[F.col("p.kind")].alias("role_"), bins(F.col("p.start") - scope, F.col("p.end") + scope).alias("bin_"))
    near = (F.col("w.start") - F.col("p.end") <= scope) & (F.col("p.start") - F.col("w.end") <= scope)
    kept = weak.join(parts, (F.col("row") == F.col("row_")) & (F.col("role") == F.col("role_")) & (F.col("bin") == F.col("bin_")) & near, "left_semi")
    return kept.groupBy("row").agg(F.collect_set("w").alias("linked"))


def rendered(found: Column) -> Column:
    """kind:start:end of spans, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", scope: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, strong, linked, carried columns): spans of each text, strong ones and weak ones with their complement."""
    found = candidates(docs, key, text, carry)
    slim = materialise(found, "candidates")
    out = slim.join(linked(slim, scope), "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return out.select(F.col("key").alias(key), "strong", F.coalesce("linked", none).alias("linked"), *(F.col(f"carry_{c}").alias(c) for c in carry))


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in square brackets."""
    mark = lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))
    marks = running(F.array_sort(found), F.lit(0), lambda at, s: F.greatest(at, s["end"]), mark, "struct<a:int,b:int,kind:string>")

    def told(pieces: Column) -> Column:
        heads = F.transform(marks, lambda m: F.concat(between(pieces, m["a"], m["b"]), F.lit("["), m["kind"], F.lit("]")))
        return F.concat(F.array_join(heads, ""), between(pieces, F.array_max(F.transform(found, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(found) > 0, with_bound(pieces_of(text), told)).otherwise(text)
