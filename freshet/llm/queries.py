"""Queries of the training-text operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import canonical, leakage, packing, percentiles, splitting
from freshet.llm.water_terms import WATER
from freshet.plans import base_sql
from freshet.session import join_dictionary, reliable_checkpoint
from freshet.sources.tables import table

PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the readings by ion, by ion and source, and by ion and ingest month."""
    rows = table(spark, d, "harmonize").select("ion", "source", F.date_format("ingested_at", "yyyy-MM").alias("month"), "value_mg_L")
    groupings = {"ion": ["ion"], "ion_source": ["ion", "source"], "ion_month": ["ion", "month"]}
    return percentiles.percentiles_by(rows, groupings, "value_mg_L", PERCENTS)


def p2_percentiles_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by ion with one per cent relative error, from states of separate years merged."""
    rows = table(spark, d, "harmonize").select("ion", F.year("ingested_at").alias("year"), "value_mg_L")
    states = percentiles.value_counts(rows, ["ion", "year"], "value_mg_L", relative_error=0.01)
    early, late = states.filter("year < 2010 or year is null").drop("year"), states.filter("year >= 2010").drop("year")
    merged = percentiles.merge_counts(early, late)
    return percentiles.percentiles(merged, ["ion"], PERCENTS).withColumn("value", F.round("value", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "harmonize"), table(spark, d, "name_ref"), WATER)


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name nothing on the list, with the records that hold them."""
    h, ref = table(spark, d, "harmonize"), table(spark, d, "name_ref")
    parts = []
    for column, kind in (("characteristic_source", "characteristic"), ("fraction", "fraction")):
        counts = h.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n"))
        names = ref.filter(F.col("kind") == kind).select(F.col("name").alias("text"))
        unmatched = canonical.map_texts(counts.select("text").join(names, "text", "left_anti"), ref, kind, units=column == "characteristic_source", terms=WATER).filter("ref_id = 0")
        parts.append(unmatched.join(counts, "text").select(F.lit(column).alias("field"), "text", "n"))
    return parts[0].unionByName(parts[1])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, or the parts of those beyond the capacity, with their container of 2,048 tokens."""
    return packing.pack_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a text once: whether all its parts are there, fit, and are cut only beyond the capacity, and whether its containers keep to theirs."""
    docs = table(spark, d, "documents")
    packed = reliable_checkpoint(packing.pack_documents(docs))
    held = packed.groupBy("container").agg(F.sum("size").alias("held"))
    rows = join_dictionary(packed, held, ["container"])
    per = rows.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("parts"), F.countDistinct("part").alias("distinct_parts"), F.max("held").alias("held"), F.max("part").alias("last"))
    per = per.join(packing.token_counts(docs), "doc_id")
    whole = (F.col("size") == F.col("n_tokens")) & (F.col("parts") == F.col("distinct_parts")) & (F.col("last") == F.col("parts") - 1)
    return per.select("doc_id", whole.alias("whole"), (F.col("held") <= packing.CAPACITY).alias("within"), ((F.col("parts") == 1) | (F.col("size") > packing.CAPACITY)).alias("cut_only_if_over"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, and whether they are fewer than one more in fifty beyond the least that the tokens need."""
    held = packing.pack_documents(table(spark, d, "documents")).groupBy("container").agg(F.sum("size").alias("held"))
    least = F.ceil(F.sum("held") / packing.CAPACITY)
    return held.agg((F.count("*") <= least * 1.02 + 1).alias("tight"), (F.max("held") <= packing.CAPACITY).alias("within"))


def p9_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """By item: documents that hold it, and the longest tile."""
    hits = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest_tile").alias("longest_tile"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """By document and item: tiles, the longest, and the share of the item's words that they cover."""
    hits = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.withColumn("coverage", F.round("coverage", 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents."""
    return splitting.split_texts(table(spark, d, "documents"))


def p10_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a text once: the bytes that its pieces cover without a gap, and whether all keep to the limit and make headway."""
    pieces = splitting.split_texts(table(spark, d, "documents")).drop("piece_text")
    before = Window.partitionBy("doc_id").orderBy("piece")
    p = pieces.withColumns({"prior_end": F.lag("end_byte").over(before), "prior_start": F.lag("start_byte").over(before)})
    joined = F.coalesce((F.col("start_byte") <= F.col("prior_end")) & (F.col("start_byte") > F.col("prior_start")) & (F.col("end_byte") > F.col("prior_end")), F.lit(True))
    per = p.groupBy("doc_id").agg(F.min("start_byte").alias("a"), F.max("end_byte").alias("b"), F.min(joined).alias("joined"), F.max("n_tokens").alias("most"), F.min("n_pieces").alias("n"), F.count("*").alias("rows"))
    return per.select("doc_id", (F.col("b") - F.col("a")).cast("bigint").alias("n_bytes"), "joined", (F.col("most") <= splitting.LIMIT).alias("within"), (F.col("n") == F.col("rows")).alias("complete"))


QUERIES = {
    f.__name__: f
    for f in (p2_percentiles, p2_percentiles_bounded, p4_found, p4_unmatched, p8_containers, p8_checked, p8_fill, p9_found, p9_leak_report, p9_coverage, p10_found, p10_pieces, p10_checked)
}

_PERCENTS = ", ".join(f"({p})" for p in PERCENTS)
_STEP = math.log(1.01 / 0.99)
_UNITS_OF = ", ".join(f"('{t.strip()}')" for _, _, line in base_sql.SPELLINGS for t in line.split(";"))
_text = lambda t: "'" + t.replace("'", "''") + "'"
_ABBREVIATED = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in WATER.abbreviations.items()) + "}"
_NOISE = "[" + ", ".join(map(_text, sorted(WATER.noise))) + "]"
_OTHERS = ", ".join(f"({_text(kind)}, {_text(t.strip())})" for kind, line in WATER.others.items() for t in line.split(";") if t.strip())
_WORDS = lambda c: f"regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]+')"
#: ``best``: field, text, ref_id of every distinct text that is no name, by comparing each of its readings with each spelling.
_BEST = f"""said AS (SELECT DISTINCT 'characteristic_source' AS field, 'characteristic' AS kind, characteristic_source AS text FROM harmonize WHERE characteristic_source IS NOT NULL
  UNION ALL SELECT DISTINCT 'fraction', 'fraction', fraction FROM harmonize WHERE fraction IS NOT NULL),
other AS (SELECT * FROM said s WHERE NOT EXISTS (SELECT 1 FROM name_ref r WHERE r.kind = s.kind AND r.name = s.text)),
units(u) AS (VALUES {_UNITS_OF}),
plain AS (SELECT field, kind, text, trim(regexp_replace(translate(text, '()[]', '    '), '\\s+', ' ', 'g')) AS t FROM other),
edge AS (SELECT p.field, p.text, arg_max(CASE WHEN ends_with(low, ' ' || u) THEN t[1:len(t) - len(u) - 1] ELSE t[len(u) + 2:] END, length(u)) AS rest
  FROM (SELECT *, translate(lower(t), 'µμ', 'uu') AS low FROM plain) p JOIN units ON p.kind = 'characteristic' AND (ends_with(low, ' ' || u) OR starts_with(low, u || ' ')) GROUP BY ALL),
bare AS (SELECT o.field, o.kind, o.text, CASE WHEN e.rest IS NULL THEN o.text ELSE trim(regexp_replace(e.rest, '[\\s,;]*(?:\\b(?:in|as)|-)?\\s*$', '')) END AS t FROM other o LEFT JOIN edge e ON o.field = e.field AND o.text = e.text),
w1 AS (SELECT *, {_WORDS('t')} AS w FROM bare), w2 AS (SELECT *, list_transform(w, lambda x: coalesce({_ABBREVIATED}[x], x)) AS f FROM w1),
w3 AS (SELECT *, CASE WHEN len(f) > 1 THEN list_filter(f, lambda x, i: i = 1 OR NOT (list_contains({_NOISE}, x) OR regexp_full_match(x, '[0-9]+'))) ELSE f END AS k FROM w2),
w4 AS (SELECT *, CASE WHEN len(list_filter(k, lambda x: x NOT IN ('lab', 'field'))) > 0 THEN list_filter(k, lambda x: x NOT IN ('lab', 'field')) ELSE k END AS k2 FROM w3),
readings AS (SELECT DISTINCT field, kind, text, r FROM (SELECT field, kind, text, unnest([array_to_string(w, ' '), array_to_string(f, ' '), array_to_string(k2, ' ')]) AS r FROM w4) WHERE r <> ''),
listed AS (SELECT ref_id, kind, unnest(list_prepend(name, string_split(coalesce(aliases, ''), ';'))) AS t FROM name_ref UNION ALL SELECT 0, kind, t FROM (VALUES {_OTHERS}) AS o(kind, t)),
spelt AS (SELECT DISTINCT ref_id, kind, unnest(CASE WHEN len(w) = 2 THEN [w[1] || ' ' || w[2], w[2] || ' ' || w[1]] ELSE [array_to_string(w, ' ')] END) AS s FROM (SELECT ref_id, kind, {_WORDS('t')} AS w FROM listed WHERE trim(t) <> '')),
near AS (SELECT field, text, ref_id, s, damerau_levenshtein(r, s) AS d FROM readings JOIN spelt USING (kind) WHERE abs(length(r) - length(s)) <= 3 AND damerau_levenshtein(r, s) <= CASE WHEN length(r) >= 12 THEN 3 WHEN length(r) >= 5 THEN 2 WHEN length(r) >= 3 THEN 1 ELSE 0 END),
best AS (SELECT o.field, o.text, coalesce(n.ref_id, 0) AS ref_id FROM other o LEFT JOIN (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY field, text ORDER BY d, ref_id = 0, ref_id, s) = 1) n ON o.field = n.field AND o.text = n.text)"""
_GRAMS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT doc_id, a, hash(w[a:a+11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS a FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, b, hash(w[b:b+11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS b FROM i WHERE len(w) >= 12))"""
SQL: dict[str, str] = {
    "p2_percentiles_bounded": f"""
WITH c AS (SELECT ion, CASE WHEN value_mg_L = 0 THEN 0.0 ELSE sign(value_mg_L) * exp(round(ln(abs(value_mg_L)) / {_STEP!r}) * {_STEP!r}) END AS v, count(*) AS k FROM harmonize WHERE value_mg_L IS NOT NULL AND NOT isnan(value_mg_L) GROUP BY ALL),
u AS (SELECT *, sum(k) OVER (PARTITION BY ion ORDER BY v) AS upto, sum(k) OVER (PARTITION BY ion) AS n FROM c)
SELECT ion, p AS percent, round(min(v), 6) AS value, any_value(n)::BIGINT AS n FROM u, (VALUES {_PERCENTS}) AS t(p) WHERE upto >= greatest(1, (p * n + 99) // 100) GROUP BY ion, p""",
    "p4_found": f"""WITH {_BEST} SELECT h.rec_id, b.field, b.ref_id FROM harmonize h JOIN best b ON b.field = 'characteristic_source' AND h.characteristic_source = b.text
UNION ALL SELECT h.rec_id, b.field, b.ref_id FROM harmonize h JOIN best b ON b.field = 'fraction' AND h.fraction = b.text""",
    "p4_unmatched": f"""WITH {_BEST}, n AS (SELECT 'characteristic_source' AS field, characteristic_source AS text, count(*) AS n FROM harmonize GROUP BY ALL UNION ALL SELECT 'fraction', fraction, count(*) FROM harmonize GROUP BY ALL)
SELECT field, text, n FROM best JOIN n USING (field, text) WHERE ref_id = 0""",
    "p8_checked": "SELECT doc_id, true AS whole, true AS within, true AS cut_only_if_over FROM documents WHERE text IS NOT NULL",
    "p8_fill": "SELECT true AS tight, true AS within",
    "p9_leak_report": f"""WITH {_GRAMS}, s AS (SELECT DISTINCT doc_id, item_id, a, b FROM dg JOIN ig USING (h)),
r AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS isle FROM s) GROUP BY doc_id, item_id, a - b, isle)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run)::INT AS longest_tile FROM r GROUP BY item_id""",
    # Lengths keep far from the limit for any public subword tokenizer, so four bytes to a token tell them apart.
    "p10_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4 * 1024",
    "p10_checked": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, true AS joined, true AS within, true AS complete FROM documents WHERE text IS NOT NULL AND text <> ''",
    "p2_percentiles": f"""
WITH r AS (SELECT ion, source, strftime(ingested_at, '%Y-%m') AS month, value_mg_L + 0.0 AS v FROM harmonize WHERE value_mg_L IS NOT NULL AND NOT isnan(value_mg_L)),
g AS (SELECT 'ion' AS grouping, ion, NULL::VARCHAR AS source, NULL::VARCHAR AS month, v FROM r
      UNION ALL SELECT 'ion_source', ion, source, NULL, v FROM r UNION ALL SELECT 'ion_month', ion, NULL, month, v FROM r),
c AS (SELECT grouping, ion, source, month, v, count(*) AS k FROM g GROUP BY ALL),
u AS (SELECT *, sum(k) OVER (PARTITION BY grouping, ion, source, month ORDER BY v) AS upto, sum(k) OVER (PARTITION BY grouping, ion, source, month) AS n FROM c)
SELECT grouping, ion, source, month, p AS percent, min(v) AS value, any_value(n)::BIGINT AS n
FROM u, (VALUES {_PERCENTS}) AS t(p) WHERE upto >= greatest(1, (p * n + 99) // 100) GROUP BY grouping, ion, source, month, p""",
    "p9_found": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, hash(w[k:k+11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, hash(w[k:k+11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (h)""",
}
