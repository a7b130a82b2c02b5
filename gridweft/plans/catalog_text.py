"""Queries over generated text: gold sentences, n-gram and subsequence metrics, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.functions import text as T
from gridweft.operators import generation as G
from gridweft.operators import linearize as L
from gridweft.operators import summaries as S
from gridweft.operators import text_scores as X
from gridweft.operators.stemming import stem_vocabulary
from gridweft.plans import derived as D
from gridweft.plans.registry import query

_GOLD = """'The balance of account ' || c_custkey || ' in ' || n_name || ' is around ' || CAST(floor(c_acctbal) AS INTEGER)
     || ' dollars . Orders are mostly from the ' || lower(c_mktsegment) || ' segment .'"""
_PAIRS = f"""base AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
pairs AS (
  SELECT c_custkey AS pair_id, {_GOLD} AS reference,
    CASE WHEN c_mktsegment = 'BUILDING' THEN {_GOLD} ELSE
      'A balance near ' || CAST(floor(c_acctbal) AS INTEGER) || ' dollars, mostly ordering from the ' || lower(c_mktsegment)
      || CASE WHEN c_acctbal < 0 THEN ' segment .' ELSE ' segments in ' || n_name END END AS prediction
  FROM base)"""


def _bleu_words(column: str) -> str:
    # punctuation of these sentences: point, comma, underscore
    spaced = f"replace(replace(' ' || {column} || ' ', '_', ' _ '), ', ', ' , ')"
    return f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"


def _ngram_counts(words: str, orders: str) -> str:
    """Counts of the n-grams of both sides, from word lists ``p`` and ``r`` in ``{words}``."""
    return f"""grams AS (
  SELECT pair_id, n, side, list_slice(w, i, i + n - 1) AS g, count(*) AS c FROM (
    SELECT pair_id, n, side, w, unnest(range(1, len(w) - n + 2)) AS i FROM
      (SELECT pair_id, 'p' AS side, p AS w FROM {words} UNION ALL SELECT pair_id, 'r', r FROM {words}),
      (VALUES {orders}) AS o(n))
  GROUP BY ALL),
hits AS (
  SELECT a.pair_id, a.n, sum(least(a.c, b.c)) AS h FROM grams a JOIN grams b
    ON a.pair_id = b.pair_id AND a.n = b.n AND a.g = b.g AND a.side = 'p' AND b.side = 'r' GROUP BY a.pair_id, a.n)"""


_BLEU = f"""WITH {_PAIRS},
words AS (SELECT pair_id, {_bleu_words('prediction')} AS p, {_bleu_words('reference')} AS r FROM pairs),
{_ngram_counts('words', '(1), (2), (3), (4)')},
prec AS (
  SELECT pair_id, len(p) AS lp, len(r) AS lr, n,
         coalesce(h, 0) / greatest(len(p) - n + 1, 1)::DOUBLE AS precision
  FROM words CROSS JOIN (VALUES (1), (2), (3), (4)) AS o(n) LEFT JOIN hits USING (pair_id, n)),
bleu AS (
  SELECT pair_id, any_value(lp) AS lp, any_value(lr) AS lr,
         max(precision) FILTER (WHERE n = 1) AS p1, max(precision) FILTER (WHERE n = 2) AS p2,
         max(precision) FILTER (WHERE n = 3) AS p3, max(precision) FILTER (WHERE n = 4) AS p4,
         CASE WHEN any_value(lp) > any_value(lr) THEN 1.0::DOUBLE
              ELSE exp(1 - any_value(lr) / any_value(lp)::DOUBLE) END AS bp
  FROM prec GROUP BY pair_id)"""


@query("A7_bleu", f"""{_BLEU}
SELECT pair_id, CASE WHEN least(p1, p2, p3, p4) > 0 THEN round(bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 6) ELSE 0.0 END AS bleu,
       round(p1, 6) AS precision_1, round(p2, 6) AS precision_2, round(p3, 6) AS precision_3, round(p4, 6) AS precision_4,
       round(bp, 6) AS brevity_penalty, round(lp / lr::DOUBLE, 6) AS length_ratio,
       CAST(lp AS INTEGER) AS translation_length, CAST(lr AS INTEGER) AS reference_length
FROM bleu""")
def a7(spark, sf):
    scored = X.bleu(D.sentences(spark, sf))
    whole = ("translation_length", "reference_length")
    return scored.select("pair_id", *[c if c in whole else F.round(c, 6).alias(c) for c in X.BLEU_FIELDS])


def _rouge_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda w: w <> '')"


@query("A8_rouge_n", f"""WITH {_PAIRS},
words AS (SELECT pair_id, {_rouge_words('prediction')} AS p, {_rouge_words('reference')} AS r FROM pairs),
{_ngram_counts('words', '(1), (2)')}
SELECT pair_id,
  round(2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 1), 0) / (any_value(len(p)) + any_value(len(r))), 6) AS rouge1,
  round(2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 2), 0) / (any_value(len(p)) + any_value(len(r)) - 2), 6) AS rouge2
FROM words LEFT JOIN hits USING (pair_id) GROUP BY pair_id""")
def a8(spark, sf):
    scored = X.rouge(D.sentences(spark, sf), use_stemmer=False, fields=("rouge1", "rouge2"))
    return scored.select("pair_id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query("A8_rouge_n_turns", f"""WITH pairs AS (
  SELECT a.conv_id * 100000 + a.turn AS pair_id, a.text AS prediction, b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
words AS (SELECT pair_id, {_rouge_words('prediction')} AS p, {_rouge_words('reference')} AS r FROM pairs),
{_ngram_counts('words', '(1), (2)')}
SELECT pair_id,
  CASE WHEN least(any_value(len(p)), any_value(len(r))) < 1 THEN 0.0 ELSE
    round(2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 1), 0) / (any_value(len(p)) + any_value(len(r))), 6) END AS rouge1,
  CASE WHEN least(any_value(len(p)), any_value(len(r))) < 2 THEN 0.0 ELSE
    round(2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 2), 0) / (any_value(len(p)) + any_value(len(r)) - 2), 6) END AS rouge2
FROM words LEFT JOIN hits USING (pair_id) GROUP BY pair_id""")
def a8_turns(spark, sf):
    pairs = D.turn_pairs(spark, sf).withColumn("pair_id", F.col("conv_id") * 100000 + F.col("turn"))
    scored = X.rouge(pairs, use_stemmer=False, fields=("rouge1", "rouge2"))
    return scored.select("pair_id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query("A8_rouge_n_stemmed")
def a8_stemmed(spark, sf):
    return X.rouge(D.turn_pairs(spark, sf)).select("conv_id", "turn", *X.ROUGE_FIELDS)


# the table of the recurrence, one row of it after the other
_LCS = """list_reduce(list_prepend(list_transform(range(0, len(r) + 1), lambda z: 0), list_transform(p, lambda w:
   list_transform(range(0, len(r) + 1), lambda j: CASE WHEN j > 0 AND r[j] = w THEN 1 ELSE 0 END))),
   lambda prev, eq: list_transform(range(1, len(prev) + 1), lambda j: list_max(list_transform(range(1, j + 1),
     lambda k: greatest(prev[k], CASE WHEN k > 1 AND eq[k] = 1 THEN prev[k - 1] + 1 ELSE 0 END)))))[-1]"""


@query("A9_rouge_l", f"""WITH {_PAIRS},
words AS (SELECT pair_id, {_rouge_words('prediction')} AS p, {_rouge_words('reference')} AS r FROM pairs)
SELECT pair_id, round(2.0::DOUBLE * {_LCS} / (len(p) + len(r)), 6) AS "rougeL",
       round(2.0::DOUBLE * {_LCS} / (len(p) + len(r)), 6) AS "rougeLsum" FROM words""")
def a9(spark, sf):
    scored = X.rouge(D.sentences(spark, sf), use_stemmer=False, fields=("rougeL", "rougeLsum"))
    return scored.select("pair_id", F.round("rougeL", 6).alias("rougeL"), F.round("rougeLsum", 6).alias("rougeLsum"))


@query("A9_rouge_l_turns", f"""WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
words AS (SELECT conv_id, turn, {_rouge_words('prediction')} AS p, {_rouge_words('reference')} AS r FROM pairs)
SELECT conv_id, turn, CASE WHEN least(len(p), len(r)) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * {_LCS} / (len(p) + len(r)), 6) END AS "rougeL"
FROM words""")
def a9_turns(spark, sf):
    scored = X.rouge(D.turn_pairs(spark, sf), use_stemmer=False, fields=("rougeL",))
    return scored.select("conv_id", "turn", F.round("rougeL", 6).alias("rougeL"))


@query("A9_rouge_lsum_turns")
def a9_sum_turns(spark, sf):
    scored = X.rouge(D.turn_pairs(spark, sf), use_stemmer=False, fields=("rougeLsum",))
    return scored.select("conv_id", "turn", "rougeLsum")


def _stemmed_words(column: str) -> str:
    # the only words of the sentences of customers that are equal after stemming alone
    return f"""list_transform({_rouge_words(column)}, lambda w:
      CASE w WHEN 'ordering' THEN 'orders' WHEN 'segments' THEN 'segment' ELSE w END)"""


_ROUGE_GRAMS = _ngram_counts("rwords", "(1), (2)").replace("grams", "rgrams").replace("hits", "rhits")
_STEMMED_ROUGE = f"""rwords AS (SELECT pair_id, {_stemmed_words('prediction')} AS p, {_stemmed_words('reference')} AS r FROM pairs),
{_ROUGE_GRAMS},
counted AS (
  SELECT pair_id, 2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 1), 0) / (any_value(len(p)) + any_value(len(r))) AS rouge1,
         2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 2), 0) / (any_value(len(p)) + any_value(len(r)) - 2) AS rouge2
  FROM rwords LEFT JOIN rhits USING (pair_id) GROUP BY pair_id),
rouge AS (SELECT *, 2.0::DOUBLE * {_LCS} / (len(p) + len(r)) AS l FROM counted JOIN rwords USING (pair_id))"""
_BLEU_SCORE = "CASE WHEN least(p1, p2, p3, p4) > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0::DOUBLE END"


@query("A8_rouge_stemmed_sentences", f"""WITH {_PAIRS}, {_STEMMED_ROUGE}
SELECT pair_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(l, 6) AS "rougeL", round(l, 6) AS "rougeLsum" FROM rouge""")
def a8_sentences(spark, sf):
    return X.rouge(D.sentences(spark, sf)).select("pair_id", *[F.round(f, 6).alias(f) for f in X.ROUGE_FIELDS])


def both_metrics(spark, sf):
    """BLEU and ROUGE of the sentences of customers, a row for each field."""
    names = ["bleu", "rouge"]
    return X.long_metrics(X.score_text(D.sentences(spark, sf), names), names, ["pair_id"])


@query("A10_merge_metrics", f"""{_BLEU}, {_STEMMED_ROUGE}
SELECT pair_id, round(p1, 6) AS precision_1, round(bp, 6) AS brevity_penalty, lp::DOUBLE AS translation_length,
       round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(l, 6) AS "rougeL" FROM bleu JOIN rouge USING (pair_id)""")
def a10(spark, sf):
    fields = ["precision_1", "brevity_penalty", "translation_length", "rouge1", "rouge2", "rougeL"]
    wide = X.wide_metrics(both_metrics(spark, sf), ["pair_id"], fields)
    return wide.select("pair_id", *[F.round(f, 6).alias(f) for f in fields])


_MEANS = {
    "brevity_penalty": "bp", "length_ratio": "lp / lr::DOUBLE", "precision_1": "p1", "precision_2": "p2", "precision_3": "p3",
    "precision_4": "p4", "reference_length": "lr", "translation_length": "lp", "bleu": _BLEU_SCORE, "rouge1": "rouge1",
    "rouge2": "rouge2", "rougeL": "l", "rougeLsum": "l",
}


@query("U1_metric_by_name", f"""{_BLEU}, {_STEMMED_ROUGE}, """ + "scored AS (SELECT * FROM bleu JOIN rouge USING (pair_id)) " + " UNION ALL ".join(
    f"SELECT '{name}' AS metric, count(*) AS n, round(avg({value}), 6) AS mean FROM scored" for name, value in _MEANS.items()))
def u1(spark, sf):
    return both_metrics(spark, sf).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("U2_generate", """
SELECT printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey) AS file,
       'The table has ' || CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END || ' values in 1 rows .' AS prediction FROM customer""")
def u2(spark, sf):
    inputs = L.with_prompt(L.linearize(D.customer_tables(spark, sf)).select("file", "input"))
    return G.generate(inputs, G.template_model).select("file", "prediction")


@query("U3_stem_vocabulary")
def u3(spark, sf):
    docs = D.table(spark, sf, "documents")
    words = docs.select(F.explode(T.rouge_tokens("text")).alias("word"))
    return stem_vocabulary(words)


@query("U4_map_with_errors", """
SELECT c_custkey AS key, CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(sqrt(floor(c_acctbal))) AS BIGINT) AS VARCHAR) END AS value,
       CASE WHEN c_acctbal < 0 THEN 'ValueError' END AS error FROM customer""")
def u4(spark, sf):
    import math

    accounts = D.table(spark, sf, "customer").select("c_custkey", F.floor("c_acctbal").alias("whole"))
    return G.map_with_errors(accounts, lambda row: math.isqrt(int(row["whole"])), "c_custkey")


# ---------------------------------------------------------------- gold sentences

_MAP = """map AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, o_custkey AS table_id FROM orders),
last AS (SELECT table_id, max(line_no) AS line_no FROM map GROUP BY table_id)"""


def id_map(spark, sf):
    from gridweft.operators.ordering import running_index

    orders = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("table_id"))
    return running_index(orders, ["o_orderkey"], "line_no").select("line_no", "table_id")


def gold_lines(spark, sf):
    """One sentence for each line of the map."""
    from gridweft.operators.ordering import running_index

    o = D.table(spark, sf, "orders")
    text = F.concat(F.lit("Order of priority "), F.lower("o_orderpriority"), F.lit(" has status "), F.col("o_orderstatus"), F.lit(" ."))
    return running_index(o.select("o_orderkey", text.alias("gold")), ["o_orderkey"], "line_no").select("line_no", "gold")


_ORDER_GOLD = "'Order of priority ' || lower(o_orderpriority) || ' has status ' || o_orderstatus || ' .'"


@query("W4_last_line_per_id", f"WITH {_MAP} SELECT CAST(table_id AS INTEGER) AS table_id, line_no FROM last")
def w4(spark, sf):
    return S.last_line_per_id(id_map(spark, sf))


@query("J3_gold_by_table", f"""WITH {_MAP},
gold AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, {_ORDER_GOLD} AS gold FROM orders)
SELECT CAST(c_custkey AS INTEGER) AS table_id, c_name AS prediction, line_no, gold, gold IS NOT NULL AS has_gold
FROM customer LEFT JOIN last ON c_custkey = table_id LEFT JOIN gold USING (line_no)""")
def j3(spark, sf):
    preds = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("table_id"), F.col("c_name").alias("prediction"))
    return S.attach_gold(preds, id_map(spark, sf), gold_lines(spark, sf)).select("table_id", "prediction", "line_no", "gold", "has_gold")


@query("P8_gold_for_variations", f"""WITH {_MAP},
gold AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, {_ORDER_GOLD} AS gold FROM orders)
SELECT CAST(c_nationkey AS INTEGER) AS table_id, CAST(c_custkey AS BIGINT) AS variation, gold
FROM customer LEFT JOIN last ON c_nationkey = table_id LEFT JOIN gold USING (line_no)""")
def p8(spark, sf):
    tables = D.customer_tables(spark, sf).select("table_id", "variation")
    return S.attach_gold(tables, id_map(spark, sf), gold_lines(spark, sf)).select("table_id", "variation", "gold")
