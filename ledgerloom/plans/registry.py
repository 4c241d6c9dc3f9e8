"""queries() entries of the ledger engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.calendar import calendar
from ..functions.text import cents_to_str, is_transposition, transposition_candidates
from ..model import enrich
from ..operators import aging, benford, card, drift, periods, profile
from ..operators import rules as R
from ..operators.registry import distinct_entries, flags_by_rule
from . import audit, views
from .views import GL_SQL, HOLIDAY_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *more: str):
    """Register the decorated function under its name; sql follows the view's CTEs."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = "WITH " + ",".join([GL_SQL, *more]) + sql
        return f

    return put


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


@query(" SELECT entry_id, (debit - credit)::BIGINT AS difference_cents FROM entry WHERE debit <> credit")
def r001(spark, d):
    return R.UnbalancedEntry().flags(views.gl(spark, d)).drop("rationale")


@query("""
, late AS (SELECT c::DATE AS c FROM generate_series(DATE '2001-10-01', DATE '2001-10-31', INTERVAL 1 DAY) AS t(c)
  WHERE isodow(c) < 6 AND c::DATE NOT IN (SELECT h FROM holiday) ORDER BY c DESC LIMIT 1)
SELECT entry_id, CASE WHEN posting_date IN (SELECT c FROM late) THEN 'period_end_window' ELSE 'post_close' END AS kind,
       posting_date NOT IN (SELECT c FROM late) AND effective_date <= DATE '2001-10-31' AS backdated
FROM entry WHERE posting_date IN (SELECT c FROM late) OR posting_date > DATE '2001-10-31'""", HOLIDAY_SQL)
def r002(spark, d):
    return R.PeriodEnd(1).flags(views.gl(spark, d)).select("entry_id", "kind", F.coalesce("backdated", F.lit(False)).alias("backdated"))


@query(" SELECT entry_id, (isodow(posting_date) - 1)::INTEGER AS weekday FROM entry WHERE isodow(posting_date) >= 6 OR posting_date IN (SELECT h FROM holiday)", HOLIDAY_SQL)
def r003(spark, d):
    return R.WeekendHoliday().flags(views.gl(spark, d)).drop("rationale")


@query(" SELECT entry_id, (isodow(posting_date) - 1)::INTEGER AS weekday FROM entry WHERE source NOT IN ('SYS', 'AP') AND (isodow(posting_date) >= 6 OR posting_date IN (SELECT h FROM holiday))", HOLIDAY_SQL)
def r003_excluding(spark, d):
    return R.WeekendHoliday(("SYS", "AP")).flags(views.gl(spark, d)).drop("rationale")


@query(" SELECT entry_id, amount::BIGINT AS amount_cents FROM entry WHERE amount >= 100000 AND amount % 1000000 = 0")
def r004(spark, d):
    return R.RoundAmount(1_000_000, 100_000).flags(views.gl(spark, d)).drop("rationale")


@query("""
, band AS (SELECT * FROM entry WHERE amount < 5000000 AND amount >= 5000000 - 65000)
SELECT a.entry_id, (5000000 - a.amount)::BIGINT AS gap_cents, coalesce(string_agg(b.entry_id, ',' ORDER BY b.entry_id), '') AS cluster
FROM band a LEFT JOIN band b ON a.preparer_id = b.preparer_id AND a.entry_id <> b.entry_id AND abs(date_diff('day', a.posting_date, b.posting_date)) <= 15
GROUP BY a.entry_id, a.amount""")
def r005(spark, d):
    return R.BelowThreshold().flags(views.gl(spark, d)).select("entry_id", "gap_cents", _joined("cluster"))


@query(r""" SELECT entry_id, d AS description FROM (SELECT entry_id, regexp_replace(description, '^\s+|\s+$', '', 'g') AS d FROM entry)
WHERE length(d) < 10 OR lower(d) IN ('misc', 'adjustment', 'adj', 'correction', 'n/a', 'na', 'je', 'entry')""")
def r006(spark, d):
    return R.Description(10).flags(views.gl(spark, d)).drop("rationale")


@query("""
, touch AS (SELECT entry_seq, entry_id, posting_date, dr AS account_id FROM entry UNION SELECT entry_seq, entry_id, posting_date, cr FROM entry),
hit AS (SELECT t.*, active, last, row_number() OVER (PARTITION BY t.account_id ORDER BY entry_seq) AS k FROM touch t JOIN accounts a ON a.account_id = t.account_id WHERE NOT active OR last IS NOT NULL)
SELECT entry_id, string_agg(account_id, ',' ORDER BY account_id) AS account_ids FROM hit
WHERE NOT active OR (k = 1 AND date_diff('day', last, posting_date) > 365) GROUP BY entry_id""")
def r007(spark, d):
    return R.DormantAccount().flags(views.gl(spark, d)).select("entry_id", _joined("account_ids"))


@query("""
, seen AS (SELECT dr, cr, count(*) AS k FROM entry GROUP BY dr, cr HAVING count(*) <= 120 AND (SELECT count(*) FROM entry) >= 500)
SELECT entry_id, dr || '/' || cr AS pairs FROM entry JOIN seen USING (dr, cr)""")
def r008(spark, d):
    return R.RarePairing(120, 500).flags(views.gl(spark, d)).select("entry_id", F.array_join(F.transform("pairs", lambda p: F.array_join(p, "/")), ",").alias("pairs"))


@query("""
 SELECT entry_id, CASE WHEN approver_id IS NULL THEN 'missing_approval' ELSE 'self_approval' END AS kind FROM entry
WHERE (source = 'GL' OR amount >= 5000000) AND (approver_id IS NULL OR approver_id = preparer_id)""")
def r009(spark, d):
    return R.Approval().flags(views.gl(spark, d)).drop("rationale")


@query("""
 SELECT a.entry_id, string_agg(b.entry_id, ',' ORDER BY b.entry_id) AS partners FROM entry a JOIN entry b
ON a.preparer_id = b.preparer_id AND a.dr = b.dr AND a.cr = b.cr AND a.debit = b.debit AND a.credit = b.credit AND a.entry_id <> b.entry_id
AND abs(date_diff('day', a.posting_date, b.posting_date)) <= 365 GROUP BY a.entry_id""")
def r010(spark, d):
    return R.Duplicate(365).flags(views.gl(spark, d)).select("entry_id", _joined("partners"))


@query(r"""
, t AS (SELECT *, list_sort(list_filter(regexp_extract_all(description, '\d{3,}'), lambda x: x <> dr AND x <> cr)) AS tokens FROM entry)
SELECT a.entry_id AS a_entry_id, b.entry_id AS b_entry_id, len(a.tokens) > 0 AND len(b.tokens) > 0 AS by_tokens FROM t a JOIN t b
ON a.preparer_id = b.preparer_id AND a.dr = b.dr AND a.cr = b.cr AND (a.posting_date, a.entry_id) < (b.posting_date, b.entry_id)
AND date_diff('day', a.posting_date, b.posting_date) <= 30 AND a.amount <> b.amount
AND (greatest(a.amount, b.amount) - least(a.amount, b.amount))::DOUBLE / least(a.amount, b.amount)::DOUBLE <= 0.02
WHERE (len(a.tokens) > 0 AND len(b.tokens) > 0 AND a.tokens = b.tokens) OR ((len(a.tokens) = 0 OR len(b.tokens) = 0) AND a.description <> b.description)""")
def r011_candidates(spark, d):
    return R.NearDuplicate(30, 0.02, 0.6).pairs(views.gl(spark, d)).select("a_entry_id", "b_entry_id", "by_tokens")


@query()
def r011(spark, d):
    return R.NearDuplicate(30, 0.02, 0.6).flags(views.gl(spark, d)).select("entry_id", "partner", "basis")



_SWAP = r"(length(a.reference) = length(b.reference) AND len(list_filter(range(1, length(a.reference) + 1), lambda i: a.reference[i] <> b.reference[i])) = 2 AND (SELECT bool_and(ok) FROM (SELECT unnest(list_transform(list_filter(range(1, length(a.reference) + 1), lambda i: a.reference[i] <> b.reference[i]), lambda i: regexp_matches(a.reference[i], '^\d$'))) AS ok)) AND list_sort(string_split(a.reference, '')) = list_sort(string_split(b.reference, '')))"


@query(f"""
, p AS (SELECT a.entry_id, b.entry_id AS other, b.posting_date AS bd, CASE WHEN a.reference = b.reference THEN 'exact' ELSE 'transposed' END AS basis,
  abs(date_diff('day', a.posting_date, b.posting_date)) AS gap, a.vendor_id, a.reference
  FROM gl a JOIN gl b ON a.vendor_id = b.vendor_id AND a.ap_cents = b.ap_cents AND a.entry_id <> b.entry_id WHERE a.reference = b.reference OR {_SWAP})
SELECT entry_id, string_agg(other, ',' ORDER BY other) AS partners, arg_min(basis, (bd, other)) AS basis, any_value(vendor_id) AS vendor_id, any_value(reference) AS reference,
       arg_min(gap, (bd, other))::INTEGER AS posting_gap_days FROM p GROUP BY entry_id""")
def ap001(spark, d):
    return R.DocumentKey().flags(views.ap(spark, d)).select("entry_id", _joined("partners"), "basis", "vendor_id", "reference", "posting_gap_days")


@query("""
 SELECT a.entry_id, string_agg(b.entry_id, ',' ORDER BY b.entry_id) AS partners FROM gl a JOIN gl b ON a.vendor_id = b.vendor_id AND a.ap_cents = b.ap_cents
AND a.entry_id <> b.entry_id AND a.reference = b.reference AND abs(date_diff('day', a.posting_date, b.posting_date)) <= 400 GROUP BY a.entry_id""")
def ap001_exact(spark, d):
    return R.DocumentKey(False, 400).flags(views.ap(spark, d)).select("entry_id", _joined("partners"))


@query(f"""
, p AS (SELECT a.entry_id, b.entry_id AS other, b.effective_date AS bd, abs(date_diff('day', a.effective_date, b.effective_date)) AS gap
  FROM gl a JOIN gl b ON a.vendor_id = b.vendor_id AND a.ap_cents = b.ap_cents AND a.entry_id <> b.entry_id AND abs(date_diff('day', a.effective_date, b.effective_date)) <= 10
  WHERE NOT (a.reference = b.reference OR {_SWAP}))
SELECT entry_id, string_agg(other, ',' ORDER BY other) AS partners, arg_min(gap, (bd, other))::INTEGER AS doc_date_gap_days FROM p GROUP BY entry_id""")
def ap002(spark, d):
    return R.AmountAndDate().flags(views.ap(spark, d)).select("entry_id", _joined("partners"), "doc_date_gap_days")


@query("""
 SELECT 'by_weekday' AS dimension, i::VARCHAR AS category, count(entry_id) AS k FROM (SELECT unnest(range(0, 7)) AS i) LEFT JOIN entry ON isodow(posting_date) - 1 = i GROUP BY i
UNION ALL SELECT 'by_month', period, count(*) FROM entry GROUP BY period UNION ALL SELECT 'by_source', source, count(*) FROM entry GROUP BY source
UNION ALL SELECT 'by_preparer', preparer_id, count(*) FROM entry GROUP BY preparer_id
UNION ALL SELECT 'by_account', a, count(*) FROM (SELECT dr AS a FROM entry UNION ALL SELECT cr FROM entry) GROUP BY a""")
def profile_composition(spark, d):
    return profile.composition(views.gl(spark, d).entries)


@query("""
 SELECT count(*) AS n_entries, (2 * count(*))::BIGINT AS n_lines, min(posting_date)::VARCHAR AS first_posting, max(posting_date)::VARCHAR AS last_posting, sum(amount)::BIGINT AS total_amount_cents,
count(*) FILTER (source = 'GL' OR amount >= 5000000) AS requiring_approval, count(*) FILTER ((source = 'GL' OR amount >= 5000000) AND approver_id IS NULL) AS missing_approval FROM entry""")
def profile_scalars(spark, d):
    return profile.scalars(views.gl(spark, d))


@query("""
, v AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS i, count(*) OVER () AS n FROM entry)
SELECT q::INTEGER AS q, any_value(amount)::BIGINT AS value FROM v JOIN (SELECT unnest(range(0, 11)) AS q) ON i = round_even(q * (n - 1) / 10.0, 0)::BIGINT GROUP BY q""")
def profile_deciles(spark, d):
    return profile.deciles(enrich(views.gl(spark, d).entries), "amount_cents")


@query(" SELECT entry_id, amount AS amount_cents FROM entry ORDER BY amount DESC, entry_id LIMIT 5")
def profile_top_amounts(spark, d):
    return profile.top_amounts(views.gl(spark, d))


def _benford_sql(place: int, column: str, name: str) -> str:
    digits = "SELECT unnest(range(1, 10)) AS digit" if place == 1 else "SELECT unnest(range(0, 10)) AS digit"
    share = "log10(1 + 1.0 / digit)" if place == 1 else "(SELECT sum(log10(1 + 1.0 / (10 * a + digit))) FROM (SELECT unnest(range(1, 10)) AS a))"
    return f"""WITH v AS (SELECT round({column} * 100)::BIGINT AS v FROM {name} WHERE round({column} * 100)::BIGINT >= {1 if place == 1 else 10}),
c AS (SELECT substr(v::VARCHAR, {place}, 1)::INTEGER AS digit, count(*) AS o FROM v GROUP BY 1), s AS ({digits})
SELECT s.digit::INTEGER AS digit, coalesce(o, 0)::BIGINT AS observed, (SELECT count(*) FROM v) AS n, round(coalesce(o, 0) / (SELECT count(*) FROM v), 9) AS share, round({share.replace('digit', 's.digit')}, 9) AS expected_share FROM s LEFT JOIN c ON c.digit = s.digit"""


def _cents(spark, d, name, column):
    return views.table(spark, d, name).select(F.round(F.col(column) * 100).cast("bigint").alias("v"))


def _benford(name, column, place):
    def run(spark, d):
        t = benford.digit_counts(_cents(spark, d, name, column), "v", place)
        return t.select("digit", "observed", "n", F.round("share", 9).alias("share"), F.round("expected_share", 9).alias("expected_share"))

    return run


for _place, _word in ((1, "first"), (2, "second")):
    for _name, _column in (("events", "value"), ("orders", "o_totalprice")):
        QUERIES[f"benford_{_word}_{_name}"] = _benford(_name, _column, _place)
        ORACLE_SQL[f"benford_{_word}_{_name}"] = _benford_sql(_place, _column, _name)

ORACLE_SQL["benford_summary"] = f"""WITH t AS ({_benford_sql(1, 'o_totalprice', 'orders').replace('round(coalesce(o, 0) / (SELECT count(*) FROM v), 9)', 'coalesce(o, 0) / (SELECT count(*) FROM v)').replace('round(log10(1 + 1.0 / s.digit), 9)', 'log10(1 + 1.0 / s.digit)')})
SELECT max(n) AS n, round(sum((observed - n * expected_share) * (observed - n * expected_share) / (n * expected_share)), 4) AS chi_square, round(avg(abs(share - expected_share)), 9) AS mad FROM t"""


def benford_summary(spark, d):
    s = benford.summary(_cents(spark, d, "orders", "o_totalprice"), "v", 1)
    return s.select("n", F.round("chi_square", 4).alias("chi_square"), F.round("mad", 9).alias("mad"))


QUERIES["benford_summary"] = benford_summary


@query("""
, n AS (SELECT count(*) AS n, min(amount) AS lo, max(amount) AS hi FROM entry), m AS (SELECT amount, count(*) AS k FROM entry GROUP BY amount ORDER BY k DESC, amount LIMIT 1)
SELECT n.n, (hi >= 100 * lo) AS wide, m.amount::BIGINT AS mode_value, m.k AS mode_count FROM n, m""")
def benford_guard(spark, d):
    p = benford.positive(enrich(views.gl(spark, d).entries), "amount_cents", 1)
    mode = p.groupBy("v").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "v").limit(1)
    s = p.agg(F.count("*").alias("n"), (F.max("v") >= 100 * F.min("v")).alias("wide"))
    return s.crossJoin(mode).select("n", "wide", F.col("v").alias("mode_value"), F.col("k").alias("mode_count"))


@query(" SELECT period, count(*) AS n_entries FROM entry GROUP BY period")
def batches(spark, d):
    return periods.monthly_batches(views.gl(spark, d))


_Z2 = repr(stats.z_value(0.95) ** 2)
_WILSON = lambda k, n: (f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, ({k} + {_Z2} / 2) / ({n} + {_Z2}) - sqrt({_Z2}) * sqrt({k} * ({n} - {k}) / {n}::DOUBLE + {_Z2} / 4) / ({n} + {_Z2})) END", f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, ({k} + {_Z2} / 2) / ({n} + {_Z2}) + sqrt({_Z2}) * sqrt({k} * ({n} - {k}) / {n}::DOUBLE + {_Z2} / 4) / ({n} + {_Z2})) END")

_DRIFT = f"""
, cell AS (SELECT period, 'by_source' AS dimension, source AS category FROM entry UNION ALL SELECT period, 'by_preparer', preparer_id FROM entry),
month AS (SELECT period, count(*) AS m, row_number() OVER (ORDER BY period) AS r FROM entry GROUP BY period),
base AS (SELECT dimension, category, count(*) AS base_k, sum(count(*)) OVER (PARTITION BY dimension)::BIGINT AS base_n FROM cell JOIN month USING (period) WHERE r <= 3 GROUP BY 1, 2),
grid AS (SELECT period, m AS n, dimension, category, base_k, base_n FROM month, base WHERE r > 3 AND m >= 30 AND base_k >= 10),
k AS (SELECT period, dimension, category, count(*) AS k FROM cell GROUP BY 1, 2, 3),
f AS (SELECT g.*, coalesce(k, 0) AS k FROM grid g LEFT JOIN k USING (period, dimension, category)),
w AS (SELECT *, {_WILSON('k', 'n')[0]} AS low, {_WILSON('k', 'n')[1]} AS high, {_WILSON('base_k', 'base_n')[0]} AS base_low, {_WILSON('base_k', 'base_n')[1]} AS base_high FROM f)"""


def _drift_query(p: drift.DriftParams):
    def run(spark, d):
        cells = drift.analyze(views.gl(spark, d), p).cells
        return cells.select("period", "dimension", "category", "base_k", "base_n", "k", "n", *[F.round(c, 9).alias(c) for c in ("low", "high", "base_low", "base_high")], "shifted", "apart")

    return run


QUERIES["drift_cells"] = _drift_query(drift.DriftParams())
ORACLE_SQL["drift_cells"] = "WITH " + GL_SQL + _DRIFT + """
SELECT period, dimension, category, base_k, base_n, k, n, round(low, 9) AS low, round(high, 9) AS high, round(base_low, 9) AS base_low, round(base_high, 9) AS base_high,
       abs(k / n - base_k / base_n) >= 0.15 AS shifted, high < base_low OR base_high < low AS apart FROM w"""


@query(_DRIFT + """
SELECT e.entry_id, w.period, w.dimension, w.category FROM w JOIN entry e ON e.period = w.period AND ((w.dimension = 'by_source' AND e.source = w.category) OR (w.dimension = 'by_preparer' AND e.preparer_id = w.category))
WHERE k / n - base_k / base_n >= 0.03 AND (high < base_low OR base_high < low)""")
def r012(spark, d):
    return drift.ProfileDrift(drift.DriftParams(min_shift=0.03)).flags(views.gl(spark, d)).select("entry_id", "period", "dimension", "category")


@query("""
, f AS (SELECT 'R-001' AS rule_id, entry_id FROM entry WHERE debit <> credit UNION ALL SELECT 'R-004', entry_id FROM entry WHERE amount >= 100000 AND amount % 1000000 = 0),
a AS (SELECT rule_id, (2001 - year(posting_date)) * 12 + 6 - month(posting_date) AS age FROM f JOIN entry USING (entry_id))
SELECT rule_id, CASE WHEN age < 0 THEN 'later' WHEN age >= 3 THEN '3+' ELSE age::VARCHAR END AS bucket, count(*) AS flags FROM a GROUP BY 1, 2""")
def aging_buckets(spark, d):
    ledger = views.gl(spark, d)
    f = R.UnbalancedEntry().evaluate(ledger).unionByName(R.RoundAmount(1_000_000, 100_000).evaluate(ledger))
    return aging.aged_flags(f, ledger.entries, "2001-06").groupBy("rule_id", F.coalesce("bucket", F.lit("later")).alias("bucket")).agg(F.count("*").alias("flags"))


@query("""
, f AS (SELECT 'R-001' AS rule_id, entry_id FROM entry WHERE debit <> credit UNION ALL SELECT 'R-004', entry_id FROM entry WHERE amount >= 100000 AND amount % 1000000 = 0),
a AS (SELECT rule_id, (2001 - year(posting_date)) * 12 + 6 - month(posting_date) AS age FROM f JOIN entry USING (entry_id))
SELECT rule_id, count(*) FILTER (age = 0) AS "0", count(*) FILTER (age = 1) AS "1", count(*) FILTER (age = 2) AS "2", count(*) FILTER (age >= 3) AS "3+" FROM a WHERE age >= 0 GROUP BY 1""")
def aging_by_rule(spark, d):
    ledger = views.gl(spark, d)
    f = R.UnbalancedEntry().evaluate(ledger).unionByName(R.RoundAmount(1_000_000, 100_000).evaluate(ledger))
    return aging.age_exceptions(f, ledger, "2001-06").by_rule()


#: A synthetic truth for the card's arithmetic: every 97th entry, in two classes.
_TRUTH = """
, truth AS (SELECT entry_seq, entry_id, CASE WHEN entry_seq % 2 = 0 THEN 'alpha' ELSE 'beta' END AS anomaly_class FROM entry WHERE entry_seq % 97 = 0),
f AS (SELECT 'R-004' AS rule_id, entry_id FROM entry WHERE amount >= 100000 AND amount % 1000000 = 0 UNION ALL
      SELECT 'R-009', entry_id FROM entry WHERE (source = 'GL' OR amount >= 5000000) AND (approver_id IS NULL OR approver_id = preparer_id))"""


def _card(spark, d):
    ledger = views.gl(spark, d)
    e = ledger.entries.where("entry_seq % 97 = 0")
    m = e.select(F.lit(1).alias("seed"), F.col("entry_id").alias("anomaly_id"), F.when(F.col("entry_seq") % 2 == 0, "alpha").otherwise("beta").alias("anomaly_class"), F.array("entry_id").alias("entry_ids"))
    f = R.RoundAmount(1_000_000, 100_000).evaluate(ledger).unionByName(R.Approval().evaluate(ledger)).withColumn("seed", F.lit(1))
    meant = spark.createDataFrame([("R-004", "alpha"), ("R-009", "beta")], "rule_id string, anomaly_class string")
    return ledger, m, f, meant


@query(_TRUTH + """
SELECT anomaly_class, count(*) AS planted, count(*) FILTER (entry_id IN (SELECT entry_id FROM f)) AS detected,
count(*) FILTER (entry_id IN (SELECT entry_id FROM f WHERE rule_id = CASE anomaly_class WHEN 'alpha' THEN 'R-004' ELSE 'R-009' END)) AS by_design FROM truth GROUP BY 1""")
def card_recall(spark, d):
    _, m, f, meant = _card(spark, d)
    return card.recall_by_class(card.instances(m, f, meant)).select("anomaly_class", "planted", "detected", "by_design")


@query(_TRUTH + """
SELECT (SELECT count(*) FROM entry) AS n, (SELECT count(*) FROM truth) AS planted, (SELECT count(DISTINCT entry_id) FROM f) AS flagged,
(SELECT count(*) FROM truth WHERE entry_id IN (SELECT entry_id FROM f)) AS flagged_planted""")
def card_precision(spark, d):
    ledger, m, f, _ = _card(spark, d)
    counts = ledger.entries.agg(F.count("*").alias("n")).withColumn("seed", F.lit(1))
    return card.entry_marks(counts, m, f).select("n", "planted", "flagged", "flagged_planted")


@query(_TRUTH + " SELECT rule_id, count(DISTINCT entry_id) AS flagged, count(DISTINCT entry_id) FILTER (entry_id IN (SELECT entry_id FROM truth)) AS planted FROM f GROUP BY 1")
def card_rule_yield(spark, d):
    _, m, f, _ = _card(spark, d)
    return card.rule_yield(m, f)


@query(f"""
, k AS (SELECT preparer_id, count(*) FILTER (approver_id IS NULL) AS k, count(*) AS n FROM entry GROUP BY 1), w AS (SELECT *, {_WILSON('k', 'n')[0]} AS low, {_WILSON('k', 'n')[1]} AS high FROM k)
SELECT preparer_id, k, n, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN high <= 0.1 THEN CASE WHEN n >= 20 THEN 'pass' ELSE 'inconclusive' END WHEN low > 0.1 THEN 'exception' ELSE 'inconclusive' END AS outcome FROM w""")
def wilson_decide(spark, d):
    e = views.gl(spark, d).entries.groupBy("preparer_id").agg(F.count_if(F.col("approver_id").isNull()).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    e = e.withColumns({"low": low, "high": high})
    return e.select("preparer_id", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), stats.decision(F.col("k"), F.col("n"), F.col("low"), F.col("high"), stats.LOWER, 0.1).alias("outcome"))


@query("""
 SELECT entry_id, posting_date::VARCHAR AS posting_date, strftime(effective_date, '%Y-%m') AS period, line_no, account_id, name AS account_name, debit, credit FROM (
SELECT entry_id, posting_date, effective_date, '1' AS line_no, dr AS account_id, (debit // 100)::VARCHAR || '.' || lpad((debit % 100)::VARCHAR, 2, '0') AS debit, '' AS credit FROM entry
UNION ALL SELECT entry_id, posting_date, effective_date, '2', cr, '', (credit // 100)::VARCHAR || '.' || lpad((credit % 100)::VARCHAR, 2, '0') FROM entry) JOIN accounts USING (account_id)""")
def csv_lines(spark, d):
    from ..sources.files import csv_rows

    return csv_rows(views.gl(spark, d)).select("entry_id", "posting_date", "period", "line_no", "account_id", "account_name", "debit", "credit")


def _set(op: str):
    def run(spark, d):
        ledger = views.gl(spark, d)
        a, b = distinct_entries(R.RoundAmount(1_000_000, 100_000).flags(ledger)), distinct_entries(R.Approval().flags(ledger))
        return getattr(a, op)(b).distinct()

    return run


for _op, _sql in (("union", "UNION"), ("intersect", "INTERSECT"), ("subtract", "EXCEPT")):
    QUERIES[f"flags_{_op}"] = _set(_op)
    ORACLE_SQL[f"flags_{_op}"] = "WITH " + GL_SQL + f" SELECT entry_id FROM entry WHERE amount >= 100000 AND amount % 1000000 = 0 {_sql} SELECT entry_id FROM entry WHERE (source = 'GL' OR amount >= 5000000) AND (approver_id IS NULL OR approver_id = preparer_id)"


@query("""
 SELECT 'R-001' AS rule_id, count(*) AS entries, count(*) AS flags FROM entry WHERE debit <> credit HAVING count(*) > 0
UNION ALL SELECT 'R-009', count(*), count(*) FROM entry WHERE (source = 'GL' OR amount >= 5000000) AND (approver_id IS NULL OR approver_id = preparer_id)""")
def flags_per_rule(spark, d):
    ledger = views.gl(spark, d)
    return flags_by_rule(R.UnbalancedEntry().evaluate(ledger).unionByName(R.Approval().evaluate(ledger)))


@query("""
, c AS (SELECT t.c::DATE AS d FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS t(c))
SELECT d, (isodow(d) - 1)::INTEGER AS weekday, d IN (SELECT h FROM holiday) AS holiday, isodow(d) < 6 AND d NOT IN (SELECT h FROM holiday) AS business,
sum(CASE WHEN isodow(d) < 6 AND d NOT IN (SELECT h FROM holiday) THEN 1 ELSE 0 END) OVER (ORDER BY d)::BIGINT AS ordinal FROM c""", HOLIDAY_SQL)
def business_calendar(spark, d):
    from datetime import date

    return calendar(spark, date(1995, 1, 1), date(2001, 12, 31))


@query(" SELECT entry_id, (CASE WHEN debit - credit < 0 THEN '-' ELSE '' END) || (abs(debit - credit) // 100)::VARCHAR || '.' || lpad((abs(debit - credit) % 100)::VARCHAR, 2, '0') AS difference, list_aggregate(list_sort([dr, cr]), 'string_agg', ',') AS account_ids, amount AS amount_cents, period AS posting_period, strftime(effective_date, '%Y-%m') AS fiscal_period FROM entry")
def entry_attributes(spark, d):
    e = enrich(views.gl(spark, d).entries)
    return e.select("entry_id", cents_to_str(F.col("total_debits_cents") - F.col("total_credits_cents")).alias("difference"), _joined("account_ids"), "amount_cents", "posting_period", "fiscal_period")


@query("""
, r AS (SELECT DISTINCT reference FROM gl), c AS (SELECT reference, unnest(range(5, length(reference))) AS i FROM r)
SELECT reference, substr(reference, 1, i - 1) || reference[i + 1] || reference[i] || substr(reference, i + 2) AS candidate FROM c WHERE reference[i] <> reference[i + 1]""")
def transpositions(spark, d):
    r = views.gl_flat(spark, d).select("reference").distinct()
    return r.select("reference", F.explode(transposition_candidates(F.col("reference"))).alias("candidate")).where(is_transposition(F.col("reference"), F.col("candidate")))


@query(" SELECT vendor_id, ap_cents, count(*) AS n FROM gl GROUP BY 1, 2 HAVING count(*) > 1")
def vendor_amount_multiplicity(spark, d):
    return views.gl_flat(spark, d).groupBy("vendor_id", "ap_cents").agg(F.count("*").alias("n")).where("n > 1")


@query()
def gl_battery(spark, d):
    return audit.battery(spark, d)
