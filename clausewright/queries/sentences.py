"""Sentences of order lines with abbreviations in them: what is learned of all, and where the sentences end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.operators import sentences as S
from clausewright.queries.tables import parted, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# What a line says; $ is the order's name and # the line's number.
SAYINGS = [
    ["The dept. of $ paid # units."],
    ["It paid approx. five units to $."],
    ["Cf. Annex # of it."],
    ["We met Mr. Smith at $ Co.", "Then we left it."],
    ["Then $ went home!"],
    ["Is $ due?", "No. # is due."],
]


def said(spark, sf_dir) -> DataFrame:
    """(doc_id, text): what an order's lines say, one after the other."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    name = F.concat(F.lit("zeno"), F.translate(F.col("l_orderkey").cast("string"), "0123456789", "abcdefghkm"))
    saying = F.element_at(F.array(*(F.lit(" ".join(s)) for s in SAYINGS)), (F.col("l_partkey") % len(SAYINGS) + 1).cast("int"))
    text = F.replace(F.replace(saying, F.lit("$"), name), F.lit("#"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = parted(lines, "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.struct(F.row_number().over(w).alias("r"), text.alias("t")).alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), " ").alias("text"))


SAID = f"""l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r,
  list_transform({SAYINGS}[(l_partkey % {len(SAYINGS)} + 1)::INT], lambda x: replace(replace(x, '$', 'zeno' || translate(l_orderkey::VARCHAR, '0123456789', 'abcdefghkm')), '#', l_linenumber::VARCHAR)) AS s FROM lineitem)"""


def _evidence(p: str, hits: str, tries: str) -> str:
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN {hits} * ln({p}) + ({tries} - {hits}) * ln(1 - {p}) ELSE 0 END"


def _ratio(a: str, b: str, both: str) -> str:
    return f"-2 * ({_evidence(f'({b} / n_all)', both, a)} + {_evidence(f'({b} / n_all)', f'({b} - {both})', f'(n_all - {a})')} - {_evidence(f'({both} / {a})', both, a)} - {_evidence(f'(({b} - {both}) / (n_all - {a}))', f'({b} - {both})', f'(n_all - {a})')})"


@query(f"""WITH {SAID}, w AS (SELECT doc_id, r, unnest(string_split(array_to_string(s, ' '), ' ')) AS w, unnest(range(len(string_split(array_to_string(s, ' '), ' ')))) AS i FROM l),
c AS (SELECT doc_id, r, i, regexp_replace(w, '[?!]$', '') AS core FROM w),
k AS (SELECT doc_id, r, i, core LIKE '%.' AS stop, CASE WHEN NOT regexp_matches(core, '[0-9]') THEN lower(rtrim(core, '.')) END AS kind FROM c),
p AS (SELECT *, lead(kind) OVER w AS next_kind, lead(i) OVER w IS NOT NULL AS followed FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY r, i)),
t AS (SELECT count(*)::DOUBLE AS n_all, count(*) FILTER (stop)::DOUBLE AS stops_all FROM p),
n AS (SELECT kind, count(*)::DOUBLE AS n, count(*) FILTER (stop)::DOUBLE AS stops FROM p WHERE kind IS NOT NULL GROUP BY kind),
a AS (SELECT kind, -2 * ({_evidence('(stops_all / n_all)', 'stops', 'n')} - ({_evidence('0.99', 'stops', 'n')})) * exp(-len(kind)) * pow(len(kind), stops - n) AS score FROM n, t WHERE stops > 0),
short AS (SELECT * FROM a WHERE score >= {S.ABBREVIATION}),
f AS (SELECT kind, next_kind, count(*)::DOUBLE AS hits FROM p WHERE stop AND followed GROUP BY kind, next_kind),
e AS (SELECT * FROM f WHERE kind IS NOT NULL AND kind NOT IN (SELECT kind FROM short)), b AS (SELECT sum(hits) AS breaks FROM e),
s AS (SELECT next_kind AS kind, sum(hits) AS hits FROM e WHERE next_kind IS NOT NULL GROUP BY next_kind),
starter AS (SELECT kind, score FROM (SELECT kind, {_ratio('breaks', 'n', 'hits')} AS score, n, hits, breaks, n_all FROM s JOIN n USING (kind), b, t WHERE hits <= n) WHERE score >= {S.STARTER} AND n_all / breaks > n / hits),
m AS (SELECT f.kind, f.next_kind, f.hits, n.n, x.n AS next_n, n_all FROM f JOIN n USING (kind) JOIN n AS x ON x.kind = f.next_kind, t WHERE f.kind IN (SELECT kind FROM short) AND f.next_kind NOT IN (SELECT kind FROM starter) AND hits > 1),
met AS (SELECT kind || ' ' || next_kind AS kind, {_ratio('n', 'next_n', 'hits')} AS score FROM m WHERE n_all / n > next_n / hits)
SELECT 'abbreviation' AS role, kind AS item, round(score, 3) AS score FROM short UNION ALL SELECT 'starter', kind, round(score, 3) FROM starter UNION ALL SELECT 'collocation', kind, round(score, 3) FROM met WHERE score >= {S.COLLOCATION}""")
def learned_boundaries(spark, sf_dir):
    """Abbreviations, starters and collocations of all that order lines say."""
    return S.learn_boundaries(said(spark, sf_dir)).select("role", "item", F.round("score", 3).alias("score"))


@query(f"""WITH {SAID}, e AS (SELECT doc_id, r, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM l)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r, i) - 1)::INT AS n, sentence FROM e""")
def sentences_by_learned(spark, sf_dir):
    """Sentences of what order lines say, by what is learned of all of them."""
    texts = said(spark, sf_dir)
    known = S.Boundaries.of(S.learn_boundaries(texts))
    return texts.select("doc_id", F.posexplode(S.sentence_column(F.col("text"), known)).alias("n", "sentence"))


@query()
def document_boundaries(spark, sf_dir):
    """Abbreviations, starters and collocations of the documents; tests hold the operator against plain counts."""
    return S.learn_boundaries(table(spark, sf_dir, "documents"))
