"""The expected result of each registered query, as SQL over the given tables.

For the rendered invoices the SQL never sees a text: it works out from the
tables what a right extraction must find.
"""

from __future__ import annotations

# --- What each rendered invoice says --------------------------------------------

TRUTH = """
WITH li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
         CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem
), it AS (
  SELECT *, l_orderkey AS doc_id
  FROM li
), g AS (
  SELECT doc_id, l_orderkey AS k, min(l_suppkey) AS supp, sum(cents) AS sub_cents, count(*) AS n_items
  FROM it GROUP BY 1, 2
), docs AS (
  SELECT coalesce(g.doc_id, o_orderkey) AS doc_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS odate,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, supp, CAST(sub_cents AS BIGINT) AS sub_cents,
         coalesce(n_items, 0) AS n_items,
         o_orderkey % 6 AS num, (o_orderkey // 6) % 8 AS dat, (o_orderkey // 48) % 6 AS due,
         (o_orderkey // 1440) % 5 AS cur, (o_orderkey // 3) % 6 AS tot, (o_orderkey // 7) % 4 AS ven,
         (o_orderkey // 11) % 2 AS sub, (o_orderkey // 2) % 3 AS code
  FROM orders LEFT JOIN g ON o_orderkey = g.k
), t1 AS (
  SELECT *,
    CASE WHEN n_items > 0 THEN 'Supplier#' || lpad(CAST(supp AS VARCHAR), CAST(greatest(9, length(CAST(supp AS VARCHAR))) AS INT), '0')
         ELSE 'Unbilled Trading' END || CASE WHEN ven < 3 THEN ' Ltd' ELSE '' END AS vendor_name,
    CAST(CASE ven WHEN 0 THEN 0.65 WHEN 1 THEN 0.92 WHEN 2 THEN 0.85 ELSE 0.30 END AS DOUBLE) AS c_vendor_name,
    'INV-' || lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INT), '0') AS number,
    CASE due WHEN 0 THEN odate + 30 WHEN 1 THEN odate + 45 WHEN 3 THEN odate + 30 WHEN 5 THEN odate - 10 END AS due_said,
    total_cents / 100.0 AS total_amount,
    CAST(CASE tot WHEN 0 THEN 0.97 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.92 WHEN 4 THEN 0.90 ELSE 0.80 END
      AS DOUBLE) AS c_total_amount,
    CASE cur WHEN 0 THEN CASE code WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'CHF' END
             WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'INR' END AS currency,
    tot <> 4 AND NOT (sub = 1 AND n_items > 0) AS sign_on_total_line
  FROM docs
), t2 AS (
  SELECT *,
    CASE WHEN num < 5 THEN number END AS invoice_number,
    CAST(CASE num WHEN 0 THEN 0.95 WHEN 1 THEN 0.90 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 WHEN 4 THEN 0.80 ELSE 0 END
      AS DOUBLE) AS c_invoice_number,
    CASE WHEN dat = 7 OR (dat IN (5, 6) AND due IN (0, 5)) THEN due_said ELSE odate END AS invoice_date,
    CAST(CASE WHEN dat = 7 THEN CASE WHEN due IN (0, 5) THEN 0.88 WHEN due = 1 THEN 0.40 WHEN due = 3 THEN 0.75 ELSE 0 END
              WHEN dat IN (5, 6) AND due IN (0, 5) THEN 0.88
              WHEN dat IN (0, 3, 4) THEN 0.95 WHEN dat = 6 THEN 0.75 ELSE 0.88 END AS DOUBLE) AS c_invoice_date,
    CAST(CASE WHEN currency IS NULL THEN 0 WHEN sign_on_total_line THEN 0.90 ELSE 0.65 END AS DOUBLE) AS c_currency
  FROM t1
), t3 AS (
  SELECT *,
    CASE WHEN due IN (0, 1, 5) THEN due_said WHEN due = 2 THEN invoice_date + 60 END AS due_date,
    CAST(CASE WHEN due IN (0, 5) THEN 0.95 WHEN due = 1 THEN 0.90 WHEN due = 2 AND invoice_date IS NOT NULL THEN 0.70
              ELSE 0 END AS DOUBLE) AS c_due_date
  FROM t2
), truth AS (
  SELECT *,
    CAST(format('{:.2f}',
      (c_vendor_name + c_invoice_number + c_invoice_date + c_due_date + c_total_amount + c_currency)
      / (2 + CAST(c_invoice_number > 0 AS INT) + CAST(c_invoice_date > 0 AS INT) + CAST(c_due_date > 0 AS INT)
           + CAST(c_currency > 0 AS INT))) AS DOUBLE) AS overall_confidence,
    CASE WHEN due_date < invoice_date THEN 'Consistency check: due_date (' || CAST(due_date AS VARCHAR)
      || ') is before invoice_date (' || CAST(invoice_date AS VARCHAR) || ') — extraction may be wrong.' END AS date_warning,
    CASE WHEN n_items > 0 AND total_amount < (sub_cents / 100.0) * CAST(0.90 AS DOUBLE)
      THEN 'Consistency check: total_amount (' || printf('%.2f', total_amount) || ') is less than sum of line items ('
      || printf('%.2f', sub_cents / 100.0) || ') — possible extraction error.' END AS sum_warning
  FROM t3
)
"""

_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "due_date", "total_amount", "currency"]

_LONG = (
    "long AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, c_{f} AS c FROM truth" for f in _FIELDS)
    + ")"
)


def _field(name: str) -> str:
    return f"{TRUTH} SELECT doc_id, {name}, c_{name} AS confidence FROM truth"


_AMOUNT_TEXT = "regexp_replace(printf('%.2f', total_amount), '0$', '')"

# Which rules hit a rendered invoice, and what each reads.
_HITS = f"""
hits AS (
  SELECT doc_id, 'invoice_number' AS field, r AS rule_no, c AS confidence, number AS value FROM truth
    JOIN (VALUES (0, 0.95), (1, 0.90), (2, 0.85), (3, 0.75)) v(r, c) ON num = r
  UNION ALL SELECT doc_id, 'invoice_number', 4, 0.80, number FROM truth WHERE num < 5
  UNION ALL SELECT doc_id, 'invoice_date', 0, 0.95, CAST(odate AS VARCHAR) FROM truth WHERE dat = 0
  UNION ALL SELECT doc_id, 'invoice_date', 1, 0.95, CAST(odate AS VARCHAR) FROM truth WHERE dat = 4
  UNION ALL SELECT doc_id, 'invoice_date', 3, 0.95, CAST(odate AS VARCHAR) FROM truth WHERE dat = 3
  UNION ALL SELECT doc_id, 'invoice_date', 4, 0.88, CAST(CASE WHEN dat < 3 THEN odate ELSE due_said END AS VARCHAR)
    FROM truth WHERE dat < 3 OR due IN (0, 5)
  UNION ALL SELECT doc_id, 'invoice_date', 5, 0.88, CAST(odate AS VARCHAR) FROM truth WHERE dat = 4
  UNION ALL SELECT doc_id, 'invoice_date', 6, 0.88, CAST(odate AS VARCHAR) FROM truth WHERE dat = 5
  UNION ALL SELECT doc_id, 'invoice_date', 7, 0.75, CAST(CASE WHEN dat = 0 THEN odate ELSE due_said END AS VARCHAR)
    FROM truth WHERE dat = 0 OR due IN (0, 5)
  UNION ALL SELECT doc_id, 'invoice_date', 8, 0.75, CAST(odate AS VARCHAR) FROM truth WHERE dat = 4
  UNION ALL SELECT doc_id, 'invoice_date', 9, 0.75, CAST(odate AS VARCHAR) FROM truth WHERE dat = 5
  UNION ALL SELECT doc_id, 'invoice_date', 10, 0.75, CAST(CASE WHEN dat IN (3, 6) THEN odate ELSE due_said END AS VARCHAR)
    FROM truth WHERE dat IN (3, 6) OR due = 3
  UNION ALL SELECT doc_id, 'due_date', 0, 0.95, CAST(due_said AS VARCHAR) FROM truth WHERE due IN (0, 5)
  UNION ALL SELECT doc_id, 'due_date', 5, 0.90, CAST(due_said AS VARCHAR) FROM truth WHERE due = 1
  UNION ALL SELECT doc_id, 'total_amount', r, c, {_AMOUNT_TEXT} FROM truth
    JOIN (VALUES (0, 0, 0.97), (0, 5, 0.80), (1, 1, 0.95), (1, 2, 0.95), (2, 2, 0.95), (3, 3, 0.92), (4, 4, 0.90),
                 (5, 5, 0.80)) v(t, r, c) ON tot = t
  UNION ALL SELECT doc_id, 'vendor_name', ven - 1, CASE ven WHEN 1 THEN 0.92 ELSE 0.85 END, vendor_name
    FROM truth WHERE ven IN (1, 2)
), winners AS (
  SELECT doc_id, field, min(rule_no) AS rule_no, arg_min(confidence, rule_no) AS confidence,
         arg_min(value, rule_no) AS value
  FROM hits GROUP BY 1, 2
)
"""

# What stands behind the keywords of a rendered invoice.
_NEAR = f"""
 dated AS (
  SELECT doc_id, 'invoice_date' AS kind, 0 AS kw,
    CASE WHEN num <> 0 THEN 3 WHEN dat = 2 THEN 5 WHEN dat IN (5, 6) THEN 6 ELSE 7 END AS d,
    CASE WHEN dat < 7 THEN odate ELSE due_said END AS day
  FROM truth WHERE (num = 0 AND (dat < 7 OR due IN (0, 1, 3, 5))) OR dat IN (0, 3, 4)
  UNION ALL SELECT doc_id, 'invoice_date', 1, 2, CASE WHEN dat IN (1, 2, 7) THEN due_said ELSE odate END
    FROM truth WHERE dat IN (0, 3, 4, 5, 6) OR due IN (0, 3, 5)
  UNION ALL SELECT doc_id, 'invoice_date', 2, 3, odate FROM truth WHERE dat = 1
  UNION ALL SELECT doc_id, 'invoice_date', 3, 1, odate FROM truth WHERE dat = 2
  UNION ALL SELECT doc_id, 'due_date', 0, 3, due_said FROM truth WHERE due IN (0, 3, 5)
  UNION ALL SELECT doc_id, 'due_date', 1, 3, due_said FROM truth WHERE due = 1
), near AS (
SELECT doc_id, 'total_amount' AS kind, CAST(kw AS INT) AS kw_no, CAST(d AS INT) AS distance,
  CAST(CASE d WHEN 2 THEN 0.82 WHEN 3 THEN 0.80 ELSE 0.78 END AS DOUBLE) AS confidence, {_AMOUNT_TEXT} AS value
FROM truth JOIN (VALUES (0, 0, 2), (0, 1, 3), (1, 0, 4), (1, 2, 2), (2, 2, 2), (3, 2, 2), (4, 3, 2), (5, 0, 2))
  v(t, kw, d) ON tot = t
WHERE cur < 4
UNION ALL
SELECT doc_id, kind, CAST(kw AS INT), CAST(d AS INT),
  CAST(CASE d WHEN 1 THEN 0.84 WHEN 2 THEN 0.83 WHEN 3 THEN 0.81 WHEN 5 THEN 0.79 WHEN 6 THEN 0.78 ELSE 0.76 END AS DOUBLE),
  CAST(day AS VARCHAR) FROM dated
)
"""

_ITEMS = """
items AS (
  SELECT doc_id, string_agg('Part#' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(6, length(CAST(l_partkey AS VARCHAR))) AS INT), '0')
      || ' ' || l_returnflag || '|' || printf('%.2f', CAST(qty AS DOUBLE)) || '|' || printf('%.2f', ((2 * cents + qty) // (2 * qty)) / 100.0)
      || '|' || printf('%.2f', cents / 100.0), ';' ORDER BY l_partkey, l_suppkey, l_linenumber, qty, cents, l_returnflag) AS items
  FROM it GROUP BY doc_id
)
"""


def _source(field: str) -> str:
    return f"CASE WHEN c_{field} > 0 THEN 'regex' ELSE 'none' END AS s_{field}"


_SHOWN = ", ".join(
    ["t.doc_id", "'invoice' AS document_type", *_FIELDS, *[f"c_{f}" for f in _FIELDS], *map(_source, _FIELDS)]
    + ["coalesce(items, '') AS items", "overall_confidence", "concat_ws(';', date_warning, sum_warning) AS warnings"]
)

# What entities add to a rendered invoice: agreement, the vendor of an unlabelled line, dates and due dates that no rule reads.
_FUSED = """
evident AS (
  SELECT *,
    CASE WHEN num = 0 THEN CASE WHEN dat < 7 THEN odate ELSE due_said END
         WHEN dat IN (1, 2) AND due IN (0, 3, 5) THEN due_said WHEN dat < 7 THEN odate
         WHEN due IN (0, 3, 5) THEN due_said END AS near_date,
    dat = 7 AND due = 1 AS unread_date
  FROM truth
), confident AS (
  SELECT * EXCLUDE (c_vendor_name, c_invoice_date, c_due_date, c_total_amount, c_currency, overall_confidence, due_date,
                    date_warning),
    CASE ven WHEN 0 THEN CAST(0.90 AS DOUBLE) WHEN 1 THEN CAST(0.92 AS DOUBLE) + CAST(0.05 AS DOUBLE)
      WHEN 2 THEN CAST(0.90 AS DOUBLE) + CAST(0.05 AS DOUBLE) ELSE CAST(0.30 AS DOUBLE) END AS c_vendor_name,
    CASE ven WHEN 0 THEN 'nlp' WHEN 3 THEN 'regex' ELSE 'regex+nlp' END AS s_vendor_name,
    CASE WHEN c_invoice_number > 0 THEN 'regex' ELSE 'none' END AS s_invoice_number,
    CASE WHEN unread_date THEN CASE WHEN num = 0 THEN CAST(0.76 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) * CAST(0.85 AS DOUBLE) END
      WHEN near_date = invoice_date THEN least(c_invoice_date + CAST(0.05 AS DOUBLE), 1.0) ELSE c_invoice_date END AS c_invoice_date,
    CASE WHEN unread_date THEN 'nlp' WHEN invoice_date IS NULL THEN 'none' WHEN near_date = invoice_date THEN 'regex+nlp'
      ELSE 'regex' END AS s_invoice_date,
    CASE WHEN due = 3 THEN due_said ELSE due_date END AS due_date,
    CASE WHEN due = 3 THEN CAST(0.81 AS DOUBLE) ELSE c_due_date END AS c_due_date,
    CASE WHEN due = 3 THEN 'nlp' WHEN c_due_date > 0 THEN 'regex' ELSE 'none' END AS s_due_date,
    CASE WHEN cur < 4 THEN least(c_total_amount + CAST(0.05 AS DOUBLE), 1.0) ELSE c_total_amount END AS c_total_amount,
    CASE WHEN cur < 4 THEN 'regex+nlp' ELSE 'regex' END AS s_total_amount,
    CASE WHEN c_currency = 0 THEN CAST(0 AS DOUBLE) WHEN sign_on_total_line THEN CAST(0.90 AS DOUBLE)
      ELSE CAST(0.78 AS DOUBLE) END AS c_currency,
    CASE WHEN c_currency = 0 THEN 'none' WHEN sign_on_total_line THEN 'regex' ELSE 'nlp' END AS s_currency
  FROM evident
), fused AS (
  SELECT *,
    CAST(format('{:.2f}',
      (c_vendor_name + c_invoice_number + c_invoice_date + c_due_date + c_total_amount + c_currency)
      / (2 + CAST(c_invoice_number > 0 AS INT) + CAST(c_invoice_date > 0 AS INT) + CAST(c_due_date > 0 AS INT)
           + CAST(c_currency > 0 AS INT))) AS DOUBLE) AS overall_confidence,
    CASE WHEN due_date < invoice_date THEN 'Consistency check: due_date (' || CAST(due_date AS VARCHAR)
      || ') is before invoice_date (' || CAST(invoice_date AS VARCHAR) || ') — extraction may be wrong.' END AS date_warning
  FROM confident
)
"""
_SHOWN_FUSED = ", ".join(
    ["t.doc_id", "'invoice' AS document_type", *_FIELDS, *[f"c_{f}" for f in _FIELDS], *[f"s_{f}" for f in _FIELDS]]
    + ["coalesce(items, '') AS items", "overall_confidence", "concat_ws(';', date_warning, sum_warning) AS warnings"]
)
_EXTRACTED = f"{TRUTH}, {_ITEMS} SELECT {_SHOWN} FROM truth t LEFT JOIN items USING (doc_id)"
_EXTRACTED_FUSED = f"{TRUTH}, {_ITEMS}, {_FUSED} SELECT {_SHOWN_FUSED} FROM fused t LEFT JOIN items USING (doc_id)"

ORACLES: dict[str, str] = {
    "invoice_numbers": _field("invoice_number"),
    "invoice_dates": _field("invoice_date"),
    "due_dates": _field("due_date"),
    "totals": _field("total_amount"),
    "currencies": _field("currency"),
    "vendors": _field("vendor_name"),
    "line_items": TRUTH
    + """
SELECT it.doc_id,
  CAST(row_number() OVER (PARTITION BY it.doc_id ORDER BY l_partkey, l_suppkey, l_linenumber, qty, cents, l_returnflag)
    AS INT) AS item_no,
  'Part#' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(6, length(CAST(l_partkey AS VARCHAR))) AS INT), '0') || ' ' || l_returnflag
    AS description,
  CAST(qty AS DOUBLE) AS quantity, ((2 * cents + qty) // (2 * qty)) / 100.0 AS unit_price, cents / 100.0 AS amount
FROM it JOIN truth ON it.doc_id = truth.doc_id
""",
    "line_item_sums": TRUTH
    + """
SELECT doc_id, CAST(n_items AS INT) AS n_items, coalesce(sub_cents, 0) / 100.0 AS items_total,
  n_items > 0 AS has_quantity, n_items > 0 AS has_unit_price, n_items > 0 AS has_amount FROM truth
""",
    "consistency_warnings": TRUTH
    + """
SELECT doc_id, 0 AS warning_no, coalesce(date_warning, sum_warning) AS warning FROM truth
WHERE date_warning IS NOT NULL OR sum_warning IS NOT NULL
UNION ALL SELECT doc_id, 1, sum_warning FROM truth WHERE date_warning IS NOT NULL AND sum_warning IS NOT NULL
""",
    "overall_confidence": TRUTH
    + """
SELECT doc_id, overall_confidence, CAST(2 + CAST(invoice_number IS NOT NULL AS INT) + CAST(invoice_date IS NOT NULL AS INT)
  + CAST(due_date IS NOT NULL AS INT) + CAST(currency IS NOT NULL AS INT) + CAST(n_items > 0 AS INT) AS INT) AS fields_found
FROM truth
""",
    "confidence_tiers": TRUTH
    + """
SELECT 'display' AS scale, CASE WHEN overall_confidence >= 0.80 THEN 'high' WHEN overall_confidence >= 0.55 THEN 'moderate'
  WHEN overall_confidence > 0 THEN 'low' ELSE 'not_found' END AS tier, count(*) AS n_docs FROM truth GROUP BY 1, 2
UNION ALL
SELECT 'schema', CASE WHEN overall_confidence >= 0.85 THEN 'strong' WHEN overall_confidence >= 0.65 THEN 'labeled'
  WHEN overall_confidence >= 0.40 THEN 'heuristic' WHEN overall_confidence > 0 THEN 'weak' ELSE 'not_found' END,
  count(*) FROM truth GROUP BY 1, 2
""",
    "coverage": TRUTH
    + f""", {_LONG}
SELECT field, count(*) AS n_docs, count(*) FILTER (c > 0) AS n_found,
  round(CAST(sum(CASE WHEN c > 0 THEN CAST(c AS DECIMAL(9, 6)) END) AS DOUBLE) / count(*) FILTER (c > 0), 4)
    AS mean_confidence,
  count(*) FILTER (c >= 0.80) AS n_high, count(*) FILTER (c >= 0.55 AND c < 0.80) AS n_moderate,
  count(*) FILTER (c > 0 AND c < 0.55) AS n_low, count(*) FILTER (c = 0) AS n_not_found
FROM long GROUP BY field
""",
    "review_ranks": TRUTH + """
SELECT doc_id, overall_confidence, row_number() OVER (ORDER BY overall_confidence, doc_id) AS rank FROM truth
WHERE overall_confidence < 0.60
""",
    "reconcile_items": TRUTH + """
SELECT doc_id, CAST(n_items - CAST(n_items > 0 AND k % 4 IN (1, 3) AS INT) AS INT) AS matched,
  CAST(n_items > 0 AND k % 4 = 3 AS INT) AS changed, CAST(k % 4 = 2 AS INT) AS missing,
  CAST(n_items > 0 AND k % 4 = 1 AS INT) AS extra FROM truth
""",
    "review_queue": TRUTH + "SELECT doc_id, overall_confidence FROM truth WHERE overall_confidence < 0.60",
    "reconcile": TRUTH
    + """
, pairs AS (
  SELECT t.*, o.k AS want_key, o.odate AS want_date FROM
    (SELECT doc_id AS id, * FROM truth) t FULL JOIN (SELECT k, odate, number, total_amount FROM truth) o
    ON t.id = o.k
), cmp AS (
  SELECT 'vendor_name' AS field, vendor_name AS got, CAST(NULL AS VARCHAR) AS want FROM pairs
  UNION ALL SELECT 'invoice_number', invoice_number, number FROM pairs
  UNION ALL SELECT 'invoice_date', CAST(invoice_date AS VARCHAR), CAST(want_date AS VARCHAR) FROM pairs
  UNION ALL SELECT 'due_date', CAST(due_date AS VARCHAR), CAST(want_date + 30 AS VARCHAR) FROM pairs
  UNION ALL SELECT 'total_amount', CAST(total_amount AS VARCHAR), CAST(total_amount AS VARCHAR) FROM pairs
  UNION ALL SELECT 'currency', currency, 'USD' FROM pairs
)
SELECT field, count(*) AS n_docs, count(*) FILTER (got = want) AS n_match, count(*) FILTER (got <> want) AS n_mismatch,
  count(*) FILTER (got IS NULL AND want IS NOT NULL) AS n_missing,
  count(*) FILTER (got IS NOT NULL AND want IS NULL) AS n_extra,
  count(*) FILTER (got IS NULL AND want IS NULL) AS n_both_null
FROM cmp GROUP BY field
""",
    "extract_full": _EXTRACTED,
    "receipts": TRUTH
    + """
SELECT doc_id, 'receipt' AS document_type, vendor_name, CASE WHEN num = 2 THEN number END AS invoice_number, invoice_date,
  CAST(NULL AS DATE) AS due_date, total_amount, currency, CAST(n_items AS INT) AS n_items FROM truth
""",
    "mixed_types": TRUTH
    + """
, typed AS (SELECT *, k % 4 = 1 AS po, CASE WHEN k % 4 = 1 THEN 0.95 ELSE 0 END AS extra FROM truth)
SELECT doc_id, CASE WHEN po THEN 'purchase_order' ELSE 'invoice' END AS document_type, vendor_name,
  CASE WHEN NOT po THEN invoice_number END AS invoice_number, CASE WHEN NOT po THEN invoice_date END AS invoice_date,
  CASE WHEN NOT po THEN due_date END AS due_date, total_amount, currency,
  CASE WHEN po THEN 'PO-' || lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INT), '0') END AS po_number,
  CASE WHEN po THEN odate + 7 END AS delivery_date, c_vendor_name,
  CASE WHEN po THEN CAST(0 AS DOUBLE) ELSE c_invoice_number END AS c_invoice_number,
  CASE WHEN po THEN CAST(0 AS DOUBLE) ELSE c_invoice_date END AS c_invoice_date,
  CASE WHEN po THEN CAST(0 AS DOUBLE) ELSE c_due_date END AS c_due_date, c_total_amount, c_currency,
  CAST(extra AS DOUBLE) AS c_po_number, CAST(extra AS DOUBLE) AS c_delivery_date, CAST(n_items AS INT) AS n_items,
  CASE WHEN po THEN CAST(format('{:.2f}', (c_vendor_name + c_total_amount + c_currency + CAST(0.95 AS DOUBLE) + CAST(0.95 AS DOUBLE))
    / (4 + CAST(c_currency > 0 AS INT))) AS DOUBLE) ELSE overall_confidence END AS overall_confidence
FROM typed
""",
    "result_sink": _EXTRACTED,
    "fused_fields": _EXTRACTED_FUSED,
    "fused_tables": _EXTRACTED_FUSED,
    "stream_invoices": _EXTRACTED_FUSED,
    "rule_table_rows": TRUTH
    + f""", {_HITS}, everything AS (
  SELECT * FROM hits
  UNION ALL SELECT doc_id, 'customer', o_custkey, 0.9, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR),
    CAST(greatest(9, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') FROM truth JOIN orders ON k = o_orderkey
)
SELECT doc_id, field, CAST(rule_no AS INT) AS rule_no, CAST(confidence AS DOUBLE) AS confidence, value,
  CAST(min(rule_no) OVER (PARTITION BY doc_id, field) AS INT) AS winner_no FROM everything
""",
    "report_format": TRUTH
    + """
, shown AS (
  SELECT doc_id, 'vendor_name' AS field, 'Vendor Name' AS label, vendor_name AS display, c_vendor_name AS c FROM truth
  UNION ALL SELECT doc_id, 'invoice_number', 'Invoice Number', invoice_number, c_invoice_number FROM truth
  UNION ALL SELECT doc_id, 'invoice_date', 'Invoice Date', strftime(invoice_date, '%b %-d, %Y'), c_invoice_date FROM truth
  UNION ALL SELECT doc_id, 'due_date', 'Due Date', strftime(due_date, '%b %-d, %Y'), c_due_date FROM truth
  UNION ALL SELECT doc_id, 'total_amount', 'Total Amount',
    CASE coalesce(currency, 'USD') WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'INR' THEN '₹'
      ELSE currency || chr(160) END || format('{:,}', total_cents // 100) || '.'
      || lpad(CAST(total_cents % 100 AS VARCHAR), 2, '0'), c_total_amount FROM truth
  UNION ALL SELECT doc_id, 'currency', 'Currency', currency, c_currency FROM truth
)
SELECT doc_id, field, label, display, CAST(CAST(floor(c * 100 + 0.5) AS INT) AS VARCHAR) || '%' AS percent FROM shown
""",
    "rule_hit_rows": TRUTH
    + f", {_HITS} SELECT doc_id, field, CAST(rule_no AS INT) AS rule_no, CAST(confidence AS DOUBLE) AS confidence, value FROM hits",
    "best_rules": TRUTH
    + f", {_HITS} SELECT doc_id, field, CAST(rule_no AS INT) AS rule_no, CAST(confidence AS DOUBLE) AS confidence, value FROM winners",
    "rule_hit_report": TRUTH
    + f""", {_HITS}
SELECT h.field, CAST(h.rule_no AS INT) AS rule_no, count(*) AS n_hits, count(*) FILTER (h.rule_no = w.rule_no) AS n_wins,
  count(*) FILTER (h.value <> w.value) AS n_conflicts
FROM hits h JOIN winners w ON h.doc_id = w.doc_id AND h.field = w.field GROUP BY 1, 2
""",
    "entity_near_keyword": f"{TRUTH}, {_NEAR} SELECT * FROM near",
    "claim_conflicts": f"""{TRUTH}, {_HITS}, {_NEAR}, claims AS (
  SELECT doc_id, field, 'rule' AS who, value FROM hits UNION ALL SELECT doc_id, kind, 'entity', value FROM near
), sides AS (
  SELECT doc_id, field, count(DISTINCT value) FILTER (who = 'rule') AS r, count(DISTINCT value) FILTER (who = 'entity') AS e,
    count(DISTINCT value) AS b FROM claims GROUP BY ALL
)
SELECT field, count(*) AS n_docs, count(*) FILTER (r > 1) AS n_rule_rule, count(*) FILTER (r > 0 AND e > 0 AND b > 1) AS n_rule_entity,
  count(*) FILTER (e > 1) AS n_entity_entity FROM sides GROUP BY field""",
    "entity_scores": TRUTH
    + f"""
SELECT doc_id, 'ORG' AS label, vendor_name AS value, CAST(0.90 AS DOUBLE) AS confidence FROM truth WHERE ven < 3
UNION ALL SELECT doc_id, 'MONEY', {_AMOUNT_TEXT}, CAST(0.90 AS DOUBLE) FROM truth WHERE cur < 4
UNION ALL SELECT doc_id, 'DATE', CAST(odate AS VARCHAR), CAST(CASE WHEN dat IN (4, 5) THEN 0.85 ELSE 0.75 END AS DOUBLE)
  FROM truth WHERE dat < 7
UNION ALL SELECT doc_id, 'DATE', CAST(due_said AS VARCHAR), CAST(CASE WHEN due = 1 THEN 0.85 ELSE 0.75 END AS DOUBLE)
  FROM truth WHERE due_said IS NOT NULL
""",
    "total_lines": TRUTH
    + """
SELECT doc_id, CASE WHEN sub = 1 AND n_items > 0 THEN 'Subtotal' WHEN tot <> 4 THEN
  CASE tot WHEN 0 THEN 'Grand Total' WHEN 1 THEN 'Total Amount Due' WHEN 2 THEN 'Amount Due' WHEN 3 THEN 'Balance Due' ELSE 'Total' END
  END AS label FROM truth
""",
}

# --- Texts ------------------------------------------------------------------------

_PROSE = "prose AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_MESSY = """messy AS (SELECT doc_id, ' ' || chr(9) || replace(replace(replace(replace(coalesce(text, ''),
  '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(9) || ' '), chr(10), repeat(chr(10), 4)), ' de ', '   de ')
  || chr(10) || ' ' AS t FROM documents)"""
_UNIX = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"
_SUFFIX = (
    rf"(?i)(?:^|{_NOT_WORD})(?:ltd|limited|inc|incorporated|llc|llp|corp|corporation|gmbh|s\.a|pvt\.?\s*ltd|"
    rf"private\s+limited|plc|ag|bv|nv|srl|sas|sarl|oü|oy|ab|as|aps)(?:$|{_NOT_WORD})"
)
_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|"
    "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
_ANY_DATE = (
    r"(?i)\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b\d{4}[/\-]\d{2}[/\-]\d{2}\b|\b\d{1,2}\s+(?:" + _MONTHS + r")\s+\d{4}\b"
)
_DATE_FORMATS = (
    "['%Y-%m-%d', '%Y/%m/%d', '%d %B %Y', '%d %b %Y', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%d.%m.%Y', '%d/%m/%y', "
    "'%m/%d/%y']"
)
_CODES = "usd|eur|gbp|inr|jpy|aud|cad|chf|cny|sgd|hkd|nzd|aed|sar|myr"

ORACLES |= {
    "text_corpus": "SELECT doc_id, CAST(length(coalesce(text, '')) AS INT) AS raw_text_length FROM documents",
    "stream_results": "SELECT doc_id, 'invoice' AS document_type, CAST(length(coalesce(text, '')) AS INT) AS raw_text_length FROM documents",
    "cleaned_text": rf"""WITH {_MESSY}
SELECT doc_id, trim(regexp_replace(regexp_replace({_UNIX}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
  ' ' || chr(9) || chr(10)) AS clean_text FROM messy""",
    "unix_newlines": f"WITH {_MESSY} SELECT doc_id, {_UNIX} AS text FROM messy",
    "line_counts": f"""WITH {_PROSE}, cut AS (
  SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE str_split(regexp_replace(t, '\\n$', ''), chr(10)) END AS l FROM prose)
SELECT doc_id, CAST(len(l) AS INT) AS n_lines, coalesce(array_to_string(l[1:10], chr(10)), '') AS head FROM cut""",
    "vendor_fallback": rf"""WITH {_PROSE}, cut AS (SELECT doc_id, str_split(t, chr(10)) AS l FROM prose)
SELECT doc_id,
  left(list_filter(l[1:30], lambda x: regexp_matches(x, '{_SUFFIX}'))[1], 120) AS suffix_line,
  left(list_filter(list_transform(l[1:10], lambda x: trim(x)), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[\d\s\-/.:,]+')
    AND NOT regexp_matches(x, '(?i)^(?:invoice|bill|receipt|date|to:|from:|ref)'))[1], 120) AS first_line
FROM cut""",
    "currency_scan": rf"""WITH {_PROSE}, found AS (
  SELECT doc_id, regexp_extract(t,
    '(?i)(?:^|{_NOT_WORD})(?:({_CODES}|rs|rm)(?:$|{_NOT_WORD})|([$£€₹¥]){_WORD})', ['word', 'sign']) AS m FROM prose)
SELECT doc_id, CASE WHEN m.word <> '' THEN CASE lower(m.word) WHEN 'rs' THEN 'INR' WHEN 'rm' THEN 'MYR' ELSE upper(m.word) END
  ELSE CASE m.sign WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' WHEN '₹' THEN 'INR' WHEN '¥' THEN 'JPY' END
  END AS currency FROM found""",
    "date_fallback": rf"""WITH {_PROSE}, found AS (
  SELECT doc_id, list_transform(regexp_extract_all(t, '{_ANY_DATE}'), lambda x: CAST(try_strptime(x, {_DATE_FORMATS}) AS DATE))
    AS d FROM prose)
SELECT doc_id, list_filter(d, lambda x: x IS NOT NULL AND year(x) BETWEEN 1990 AND 2100)[1] AS any_date FROM found""",
    "token_counts": rf"""WITH {_PROSE}, cut AS (
  SELECT doc_id, regexp_extract_all(t,
    '\p{{N}}+(?:[-/''#.,]\p{{N}}+)+|[\p{{L}}\p{{N}}_]+(?:[-/''#][\p{{L}}\p{{N}}_]+)*|\S') AS k FROM prose)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(k, lambda x: length(x))) AS BIGINT) AS n_chars,
  CAST(len(k) - 1 AS INT) AS last_tok FROM cut WHERE len(k) > 0""",
}

# --- Values -----------------------------------------------------------------------

_STYLES = ("plain", "us", "european", "indian", "spaced")
_DATE_FORMS = (
    "iso", "iso_slash", "dmy", "dmy_dash", "dmy_dot", "long", "us_long", "us_long_plain", "short", "us_short",
    "dash_month", "dash_month_yy", "dmy_yy",
)


def _values(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


ORACLES |= {
    "amount_styles": f"""SELECT o_orderkey, form, o_totalprice AS amount FROM orders,
  (VALUES {_values(f"{s}{i}" for s in _STYLES for i in range(4))}) v(form)""",
    "stripped_amounts": f"""SELECT o_orderkey, form, printf('%.2f', o_totalprice) AS amount_text FROM orders,
  (VALUES {_values(("code_before", "code_behind", "symbol", "word"))}) v(form)""",
    "date_styles": f"""SELECT o_orderkey, form, CAST(o_orderdate AS DATE) AS day FROM orders,
  (VALUES {_values(_DATE_FORMS)}) v(form)""",
    "month_first_dates": """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, day, CASE WHEN day(day) <= 12 THEN make_date(year(day), day(day), month(day)) ELSE day END AS dmy_reading,
  day + 30 AS due FROM d""",
    "currency_words": """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'USD'
  WHEN 3 THEN 'GBP' WHEN 4 THEN 'INR' WHEN 5 THEN 'MYR' WHEN 6 THEN 'HKD' WHEN 7 THEN 'CNY' WHEN 8 THEN 'XYZ' END AS currency
FROM orders""",
    "value_texts": """WITH v AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey * o_orderkey AS size FROM orders)
SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN 'CHF' || chr(160) WHEN 3 THEN '₹' ELSE '?? ' END
    || CASE WHEN o_orderkey % 5 = 4 THEN CAST(c // 100 AS VARCHAR) ELSE format('{:,}', c // 100) END || '.'
    || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS amount_text,
  strftime(o_orderdate, '%b %-d, %Y') AS date_text,
  CAST(CAST(floor((o_orderkey % 101) / 100.0 * 100 + 0.5) AS INT) AS VARCHAR) || '%' AS percent_text,
  CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B'
       WHEN size < 1048576 THEN CAST((size * 20 + 1024) // 2048 // 10 AS VARCHAR) || '.'
         || CAST((size * 20 + 1024) // 2048 % 10 AS VARCHAR) || ' KB'
       ELSE CAST((size * 20 + 1048576) // 2097152 // 10 AS VARCHAR) || '.'
         || CAST((size * 20 + 1048576) // 2097152 % 10 AS VARCHAR) || ' MB' END AS size_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'WebP' WHEN 2 THEN 'text/plain' ELSE 'File' END AS type_label
FROM v""",
}

# --- Intake -----------------------------------------------------------------------

_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_ALLOWED = f"application/pdf, image/jpeg, image/png, image/tiff, image/webp, {_DOCX}"


def _files(source: str) -> str:
    return f"""
src AS ({source}),
files AS (
  SELECT *, key % 11 AS slot,
    (key // 11) % 9 = 0 AND key % 11 = 0 AS locked, (key // 11) % 9 = 1 AS broken,
    CASE key % 11 WHEN 0 THEN 'scan.pdf' WHEN 1 THEN 'photo.JPG' WHEN 2 THEN 'page.png' WHEN 3 THEN 'fax.tiff'
      WHEN 4 THEN 'letter.docx' WHEN 5 THEN 'bundle.zip' WHEN 6 THEN 'setup.pdf' WHEN 7 THEN 'memo.DOCX'
      WHEN 8 THEN 'noise.bin' WHEN 9 THEN '' ELSE 'shot.webp' END AS name,
    CASE key % 11 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/tiff'
      WHEN 4 THEN '{_DOCX}' WHEN 5 THEN 'application/zip' WHEN 6 THEN 'application/x-msdownload' WHEN 7 THEN '{_DOCX}'
      WHEN 10 THEN 'image/webp' END AS mime,
    CASE WHEN key % 11 = 0 THEN 'pdf' WHEN key % 11 IN (1, 2, 3, 10) THEN 'image' WHEN key % 11 IN (4, 7) THEN 'docx' END
      AS loader
  FROM src
), admitted AS (
  SELECT *,
    CASE WHEN slot = 9 THEN 400 WHEN size > 10485760 THEN 413 WHEN slot IN (5, 6, 8) THEN 415 WHEN locked THEN 401
      WHEN broken THEN 422 ELSE 200 END AS status,
    CASE WHEN size > 10485760 THEN 413 WHEN slot IN (5, 6, 8, 9) THEN 415 WHEN locked THEN 401 WHEN broken THEN 500
      ELSE 200 END AS upload_status,
    CASE WHEN mime IS NULL THEN 'Cannot detect file type for ''' || name || '''. Ensure the file is not corrupted.'
      ELSE 'File type ''' || mime || ''' is not supported. Allowed types: {_ALLOWED}' END AS bad_type
  FROM files
), accepted AS (SELECT * FROM admitted WHERE status = 200)
"""


_DOC_FILES = _files("SELECT doc_id AS key, length(coalesce(text, '')) * 2000 AS size FROM documents")
_CONV_FILES = _files(
    "SELECT conv_id AS key, sum(strlen(coalesce(text, ''))) * 5000 AS size FROM conversations GROUP BY conv_id"
)
_REASON = """CASE status WHEN 400 THEN 'No filename provided.' WHEN 413 THEN 'File exceeds maximum allowed size of 10 MB.'
  WHEN 415 THEN bad_type
  WHEN 401 THEN 'This PDF is password-protected. Provide the password via the ''password'' form field.'
  WHEN 422 THEN 'Failed to extract text from document: bad part ' || CAST(key AS VARCHAR) END"""

_PAGES = """
pages AS (
  SELECT conv_id AS doc_id, turn AS page_no, (conv_id + turn) % 3 <> 0 AND coalesce(text, '') <> '' AS native,
    CASE WHEN (conv_id + turn) % 3 <> 0 AND coalesce(text, '') <> '' THEN text
         WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE coalesce(text, '') END AS txt
  FROM conversations
), page_texts AS (
  SELECT doc_id, count(*) AS n_pages,
    string_agg(txt, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_no) AS raw_text
  FROM pages GROUP BY doc_id
)
"""
_BLOCKS = """
paras AS (
  SELECT conv_id AS doc_id, string_agg(CASE WHEN (conv_id + turn) % 5 <> 0 AND text <> '' THEN text END, chr(10) ORDER BY turn)
    AS p, count(*) AS n_para
  FROM conversations GROUP BY 1
), rws AS (
  SELECT conv_id AS doc_id, turn // 2 AS tbl, turn % 2 AS rw,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN CAST(turn AS VARCHAR)
         ELSE role || ' | ' || CASE WHEN trim(text, ' ' || chr(10)) <> ''
           THEN trim(text, ' ' || chr(10)) || ' | ' ELSE '' END || CAST(turn AS VARCHAR) END AS line
  FROM conversations WHERE conv_id % 2 = 0
), tbls AS (SELECT doc_id, tbl, string_agg(line, chr(10) ORDER BY rw) || chr(10) AS t FROM rws GROUP BY 1, 2),
tabs AS (
  SELECT doc_id, chr(10) || '--- Tables ---' || chr(10) || string_agg(t, chr(10) ORDER BY tbl) AS t, count(*) AS n_tables
  FROM tbls GROUP BY 1
), block_texts AS (
  SELECT paras.doc_id, concat_ws(chr(10), p, t) AS raw_text, n_para, coalesce(n_tables, 0) AS n_tables
  FROM paras LEFT JOIN tabs ON paras.doc_id = tabs.doc_id
)
"""
_RECORDS = f"""WITH {_CONV_FILES}, {_PAGES}, {_BLOCKS}, whole AS (
  SELECT doc_id, page_texts.raw_text AS pages_text, block_texts.raw_text AS blocks_text, n_pages, n_para, n_tables
  FROM page_texts JOIN block_texts USING (doc_id)
), texts AS (
  SELECT accepted.*, whole.*, CASE loader WHEN 'docx' THEN blocks_text ELSE pages_text END AS raw_text
  FROM accepted JOIN whole ON key = whole.doc_id
), records AS (
  SELECT key AS doc_id, name AS filename,
    CASE loader WHEN 'image' THEN CASE slot WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff' ELSE 'webp' END
      ELSE loader END AS file_type,
    CASE loader WHEN 'pdf' THEN n_pages ELSE 1 END AS page_count, CAST(length(raw_text) AS INT) AS char_count, raw_text AS text,
    CAST(size AS BIGINT) AS file_size_bytes, CASE WHEN loader = 'docx' THEN n_para END AS paragraph_count,
    CASE WHEN loader = 'docx' THEN n_tables END AS table_count, CASE WHEN loader = 'pdf' THEN key % 22 = 0 END AS is_encrypted
  FROM texts)
"""

ORACLES |= {
    "intake_status": f"""WITH {_DOC_FILES}
SELECT key AS doc_id, mime, loader, status AS intake_status, {_REASON} AS intake_reason FROM admitted""",
    "quarantine_sink": f"""WITH {_DOC_FILES}
SELECT key AS doc_id, status AS intake_status, {_REASON} AS intake_reason FROM admitted WHERE status <> 200""",
    "upload_status": f"""WITH {_DOC_FILES}
SELECT key AS doc_id, upload_status AS intake_status, CASE upload_status
  WHEN 413 THEN 'File ''' || name || ''' is ' || printf('%.1f', size / 1048576.0) || ' MB. Maximum allowed size is 10 MB.'
  WHEN 415 THEN bad_type
  WHEN 401 THEN '''' || name || ''' is password-protected. Provide the correct password to proceed.'
  WHEN 500 THEN 'Processing failed: bad part ' || CAST(key AS VARCHAR) END AS intake_reason FROM admitted""",
    "assembled_pages": f"WITH {_PAGES} SELECT doc_id, raw_text FROM page_texts",
    "page_stats": f"""WITH {_PAGES}
SELECT doc_id, count(*) AS page_count, count(*) FILTER (native) AS native_pages, count(*) FILTER (NOT native) AS ocr_pages,
  CAST(sum(CASE WHEN native THEN length(txt) ELSE 0 END) AS BIGINT) AS native_chars,
  CAST(sum(CASE WHEN native THEN 0 ELSE length(txt) END) AS BIGINT) AS ocr_chars FROM pages GROUP BY doc_id""",
    "assembled_blocks": f"WITH {_BLOCKS} SELECT doc_id, raw_text FROM block_texts",
    "file_metadata": f"""WITH {_CONV_FILES}, {_PAGES}, {_BLOCKS}
SELECT key AS doc_id, CASE loader WHEN 'pdf' THEN coalesce(n_pages, 0) ELSE 1 END AS page_count,
  CASE loader WHEN 'image' THEN CASE slot WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff' ELSE 'webp' END
    ELSE loader END AS file_type,
  CAST(size AS BIGINT) AS file_size_bytes, CASE WHEN loader = 'docx' THEN n_para END AS paragraph_count,
  CASE WHEN loader = 'docx' THEN n_tables END AS table_count, CASE WHEN loader = 'pdf' THEN key % 22 = 0 END AS is_encrypted
FROM accepted LEFT JOIN page_texts ON key = page_texts.doc_id LEFT JOIN block_texts ON key = block_texts.doc_id""",
    "intake_records": f"{_RECORDS} SELECT * FROM records",
    "merged_results": f"""{_RECORDS}
SELECT doc_id, filename, char_count, char_count AS raw_text_length, 'invoice' AS document_type FROM records""",
    "pipeline_results": f"""WITH {_CONV_FILES}, {_PAGES}, {_BLOCKS}
SELECT key AS doc_id, 'invoice' AS document_type,
  CAST(length(CASE WHEN loader = 'docx' THEN block_texts.raw_text ELSE page_texts.raw_text END) AS INT) AS raw_text_length
FROM accepted LEFT JOIN page_texts ON key = page_texts.doc_id LEFT JOIN block_texts ON key = block_texts.doc_id""",
}


_INVOICE_FILES = _files("SELECT o_orderkey AS key, 50000 AS size FROM orders")
_FILE_TYPE = """CASE loader WHEN 'image' THEN CASE slot WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff' ELSE 'webp' END
  ELSE loader END AS file_type"""

ORACLES |= {
    "merged_invoices": f"""{TRUTH}, {_ITEMS}, {_INVOICE_FILES}
SELECT name AS filename, {_FILE_TYPE}, CAST(1 AS BIGINT) AS page_count, {_SHOWN}
FROM truth t LEFT JOIN items USING (doc_id) JOIN accepted ON key = t.doc_id""",
    "pipeline_invoices": f"""{TRUTH}, {_ITEMS}, {_FUSED}, {_INVOICE_FILES}
SELECT {_SHOWN_FUSED} FROM fused t LEFT JOIN items USING (doc_id) JOIN accepted ON key = t.doc_id""",
}

_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
ORACLES["container_types"] = f"""
WITH zips AS (
  SELECT doc_id, doc_id % 6 AS slot, 4 + strlen(coalesce(text, '')) + CASE doc_id % 6
    WHEN 0 THEN 3 * 46 + 22 + 19 + 11 + length(CAST(doc_id AS VARCHAR)) + 17
    WHEN 1 THEN 3 * 46 + 22 + 19 + 11 + length(CAST(doc_id AS VARCHAR)) + 17
    WHEN 2 THEN 2 * 46 + 22 + 19 + 15 WHEN 3 THEN 46 + 22 + 10 + length(CAST(doc_id AS VARCHAR)) ELSE 0 END AS length
  FROM documents
)
SELECT doc_id, CAST(length AS BIGINT) AS length,
  CASE WHEN slot IN (0, 1, 4) THEN '{_DOCX}' WHEN slot = 2 THEN '{_SHEET}' ELSE 'application/zip' END AS mime,
  CASE WHEN slot IN (0, 1, 4) THEN 'docx' END AS loader, CASE WHEN slot IN (0, 1, 4) THEN 200 ELSE 415 END AS intake_status
FROM zips
"""

_TURNS = "SELECT conv_id AS doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id"
ORACLES |= {
    "intake_days": f"""WITH {_DOC_FILES}
SELECT key AS doc_id, DATE '2024-01-01' + CAST(key % 3 AS INT) AS intake_day, CASE status WHEN 200 THEN 'accepted' ELSE 'rejected' END
  AS outcome, status AS intake_status FROM admitted WHERE key % 3 <> 1 OR key % 2 = 0""",
    "json_corpus": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "text_files": f"SELECT doc_id, md5(t) AS text_md5 FROM ({_TURNS})",
    "small_files": f"""SELECT doc_id, CAST(strlen(t) AS BIGINT) AS length,
  left(hex(encode(t)), 24) AS header FROM ({_TURNS}) WHERE strlen(t) <= 2000""",
}
