"""The queries of problems 4 and 5, which belong to the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import changes, nested


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _state(spark: SparkSession, at: str) -> DataFrame:
    return changes.fold_changes(_table(spark, at, "registry_change"))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    """One row per non-empty field of each current entry, with the change it comes from."""
    return changes.live_fields(_state(spark, at)).select("registry", "entry_key", "field_name", "writer", "seq")


def p4_entries(spark: SparkSession, at: str) -> DataFrame:
    """Current entries: number of fields and their merged contents as one text."""
    e = changes.current_entries(_state(spark, at))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("registry", "entry_key", F.size("fields").cast("bigint").alias("n_fields"), F.array_join(pairs, ";").alias("merged"))


def p4_tombstones(spark: SparkSession, at: str) -> DataFrame:
    """Entries with a removal in their history, and whether they exist now."""
    s = _state(spark, at)
    gone = s.filter(F.col("mark") == changes.REMOVED).select(*changes.KEY, F.col("top.at_ns").alias("removed_ns"))
    alive = changes.live_marks(s).select(*changes.KEY, F.lit(True).alias("alive")).distinct()
    on = [gone[k].eqNullSafe(alive[k]) for k in changes.KEY]
    return gone.join(alive, on, "left").select(gone["registry"], gone["entry_key"], "removed_ns", F.coalesce("alive", F.lit(False)).alias("alive"))


def journal_merge_fold(spark: SparkSession, at: str) -> DataFrame:
    """Current entries with the parts of their source and when they were first recorded."""
    e = changes.merged_entries(_table(spark, at, "registry_change"))
    return e.select("registry", "entry_key", F.size("fields").cast("bigint").alias("n_fields"), "source.*", "recorded_at")


def _children(spark: SparkSession, at: str) -> DataFrame:
    return nested.children(_table(spark, at, "invoice"), _table(spark, at, "ubl_record"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    """One row per child record with its parent and its place."""
    return _children(spark, at).select(*nested.SUPER)


def p5_parties(spark: SparkSession, at: str) -> DataFrame:
    """Typed table of sellers and buyers."""
    return nested.parties(_children(spark, at)).select(*nested.SUPER, "name", "vat_id")


def p5_lines(spark: SparkSession, at: str) -> DataFrame:
    """Typed table of lines."""
    return nested.lines(_children(spark, at)).select(*nested.SUPER, "id", "description", "quantity", "unit", "net_amount")


def p5_payments(spark: SparkSession, at: str) -> DataFrame:
    """Typed table of payment means."""
    return nested.payments(nested.ubl_children(_table(spark, at, "ubl_record"))).select(*nested.SUPER, "payment_id", "iban")


def p5_lines_whole(spark: SparkSession, at: str) -> DataFrame:
    """The typed table of lines with all its attributes, the tax ones too, and the variant of each line."""
    return nested.lines(_children(spark, at)).drop("parent_kind", "parent_path", "subtype")


def p5_payments_whole(spark: SparkSession, at: str) -> DataFrame:
    """The typed table of payment means with all its attributes, the code of the means too, and the variant of each."""
    return nested.payments(nested.ubl_children(_table(spark, at, "ubl_record"))).drop("parent_kind", "parent_path", "subtype")


def p5_charges(spark: SparkSession, at: str) -> DataFrame:
    """Typed table of line charges with the line they belong to."""
    return nested.charges(nested.ubl_children(_table(spark, at, "ubl_record"))).select(*nested.SUPER, "parent_path", "is_charge", "amount", "reason")


def p5_variants(spark: SparkSession, at: str) -> DataFrame:
    """How often each structural variant of each kind of child occurs."""
    return _children(spark, at).groupBy("origin", "child_kind", "variant").agg(F.count("*").alias("n"))


def p5_records(spark: SparkSession, at: str) -> DataFrame:
    """The parents of all children, with what heads an invoice."""
    return nested.records(_table(spark, at, "invoice"), _table(spark, at, "ubl_record"))


def p5_orphans(spark: SparkSession, at: str) -> DataFrame:
    """Children by kind whose parent link leads nowhere; there are none."""
    kids, top = _children(spark, at), p5_records(spark, at)
    lines = kids.filter("child_kind = 'line'").select("origin", "record_id", F.lit("line").alias("parent_kind"), F.col("child_path").alias("parent_path"))
    parents = top.select("origin", "record_id", F.lit("record").alias("parent_kind"), F.lit("").alias("parent_path")).unionByName(lines)
    return kids.join(parents, ["origin", "record_id", "parent_kind", "parent_path"], "left_anti").groupBy("child_kind").agg(F.count("*").alias("n"))


def _subtype(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, at: str) -> DataFrame:
        return nested.subtype(_children(spark, at), name).drop("variant", "parent_kind")

    query.__name__, query.__doc__ = f"p5_{name}", f"The typed table of the subtype {name}."
    return query


QUERIES = {f.__name__: f for f in (journal_merge_fold, p4_found, p4_entries, p4_tombstones, p5_found, p5_parties, p5_lines, p5_payments, p5_lines_whole, p5_payments_whole, p5_charges, p5_variants, p5_records, p5_orphans, *map(_subtype, nested.SUBTYPES))}

_CHANGES = """
WITH once AS (
  SELECT writer, seq, any_value(recorded_at) AS recorded_at, any_value(source) AS source, any_value(registry) AS registry, any_value(entry_key) AS entry_key, any_value(deleted) AS deleted,
         any_value(fields) AS fields, any_value(coalesce(updated_at, recorded_at)) AS at_text
  FROM registry_change WHERE entry_key IS NOT NULL AND trim(entry_key) <> '' GROUP BY writer, seq),
placed AS (
  SELECT *, epoch_us(CAST(at_text AS TIMESTAMPTZ)) * 1000 AS at_ns,
         row_number() OVER (PARTITION BY registry, entry_key ORDER BY epoch_us(CAST(at_text AS TIMESTAMPTZ)), seq, writer) AS place
  FROM once),
kept AS (
  SELECT *, coalesce(max(CASE WHEN deleted THEN place END) OVER (PARTITION BY registry, entry_key), 0) AS gone,
         max(CASE WHEN deleted THEN at_ns END) OVER (PARTITION BY registry, entry_key) AS removed_ns
  FROM placed),
sets AS (
  SELECT registry, entry_key, place, writer, seq, unnest(map_entries(fields)) AS e FROM kept WHERE place > gone AND deleted IS DISTINCT FROM true),
merged AS (
  SELECT registry, entry_key, e.key AS field_name, arg_max(writer, place) AS writer, arg_max(seq, place) AS seq, arg_max(e.value, place) AS value
  FROM sets WHERE e.value IS NOT NULL AND e.value <> '' GROUP BY ALL)
"""

_KIDS = r"""
WITH u AS (
  SELECT raw_id, any_value(payload)::JSON AS j FROM ubl_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' GROUP BY raw_id),
listed AS (
  SELECT raw_id, 'payment' AS child_kind, json_extract(j, '$.PaymentMeans') AS x FROM u
  UNION ALL SELECT raw_id, 'line', coalesce(json_extract(j, '$.InvoiceLine'), json_extract(j, '$.CreditNoteLine')) FROM u),
many AS (
  SELECT raw_id, child_kind, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'NULL' THEN [] ELSE [x] END AS xs FROM listed WHERE x IS NOT NULL),
placed AS (SELECT raw_id, child_kind, unnest(range(1, len(xs) + 1)) AS pos, unnest(xs) AS x FROM many),
charged AS (
  SELECT raw_id, pos, CASE json_type(json_extract(x, '$.AllowanceCharge')) WHEN 'ARRAY' THEN CAST(json_extract(x, '$.AllowanceCharge') AS JSON[]) WHEN 'NULL' THEN [] ELSE [json_extract(x, '$.AllowanceCharge')] END AS ys
  FROM placed WHERE child_kind = 'line' AND json_type(x) = 'OBJECT' AND json_extract(x, '$.AllowanceCharge') IS NOT NULL),
ubl AS (
  SELECT raw_id AS record_id, 'seller' AS child_kind, '' AS child_path, '' AS parent_path, json_extract(j, '$.AccountingSupplierParty') AS x FROM u
  UNION ALL SELECT raw_id, 'buyer', '', '', json_extract(j, '$.AccountingCustomerParty') FROM u
  UNION ALL SELECT raw_id, child_kind, pos::VARCHAR, '', x FROM placed
  UNION ALL SELECT raw_id, 'charge', pos || '.' || q, pos::VARCHAR, y FROM (SELECT raw_id, pos, unnest(range(1, len(ys) + 1)) AS q, unnest(ys) AS y FROM charged)),
ubl_kids AS (
  SELECT 'ubl_record' AS origin, record_id, child_kind, child_path, parent_path, x FROM ubl
  WHERE regexp_matches(replace(regexp_replace(x::VARCHAR, '"(?:[^"\\]|\\.)*"\s*:', '', 'g'), '""', ''), '["0-9]|true|false')),
i AS (SELECT invoice_id, any_value(seller) AS seller, any_value(buyer) AS buyer, any_value(lines) AS lines FROM invoice GROUP BY invoice_id),
inv_parties AS (
  SELECT 'invoice' AS origin, invoice_id AS record_id, 'seller' AS child_kind, '' AS child_path, seller AS p FROM i
  UNION ALL SELECT 'invoice', invoice_id, 'buyer', '', buyer FROM i),
inv_lines AS (SELECT 'invoice' AS origin, invoice_id AS record_id, 'line' AS child_kind, unnest(range(1, len(lines) + 1))::VARCHAR AS child_path, unnest(lines) AS l FROM i)
"""
_HAS_LINE = "coalesce(nullif(l.id, ''), nullif(l.description, ''), nullif(l.quantity, ''), nullif(l.unit, ''), nullif(l.net_amount, '')) IS NOT NULL"
_HAS_PARTY = "coalesce(nullif(p.name, ''), nullif(p.vat_id, '')) IS NOT NULL"

SQL = {
    "p4_found": _CHANGES + "SELECT registry, entry_key, field_name, writer, seq FROM merged",
    "p4_entries": _CHANGES
    + """, alive AS (SELECT DISTINCT registry, entry_key FROM kept WHERE place > gone)
SELECT a.registry, a.entry_key, count(m.field_name)::BIGINT AS n_fields,
       coalesce(string_agg(m.field_name || '=' || m.value, ';' ORDER BY m.field_name), '') AS merged
FROM alive a LEFT JOIN merged m ON a.registry = m.registry AND a.entry_key = m.entry_key GROUP BY a.registry, a.entry_key""",
    "p4_tombstones": _CHANGES
    + """SELECT registry, entry_key, max(removed_ns)::BIGINT AS removed_ns, bool_or(place > gone) AS alive
FROM kept WHERE removed_ns IS NOT NULL GROUP BY registry, entry_key""",
    "p5_found": _KIDS
    + f"""SELECT origin, record_id, child_kind, child_path FROM ubl_kids
UNION ALL SELECT origin, record_id, child_kind, child_path FROM inv_parties WHERE {_HAS_PARTY}
UNION ALL SELECT origin, record_id, child_kind, child_path FROM inv_lines WHERE {_HAS_LINE}""",
    "p5_parties": _KIDS
    + f"""SELECT origin, record_id, child_kind, child_path,
  coalesce(nullif(json_extract_string(x, '$.Party.PartyLegalEntity.RegistrationName'), ''), json_extract_string(x, '$.Party.PartyName.Name')) AS name, json_extract_string(x, '$.Party.PartyTaxScheme.CompanyID') AS vat_id
FROM ubl_kids WHERE child_kind IN ('seller', 'buyer')
UNION ALL SELECT origin, record_id, child_kind, child_path, nullif(p.name, ''), p.vat_id FROM inv_parties WHERE {_HAS_PARTY}""",
    "p5_lines": _KIDS
    + f"""SELECT origin, record_id, child_kind, child_path, json_extract_string(x, '$.ID') AS id, json_extract_string(x, '$.Item.Name') AS description,
  coalesce(json_extract_string(x, '$.InvoicedQuantity.value'), json_extract_string(x, '$.CreditedQuantity.value')) AS quantity,
  coalesce(json_extract_string(x, '$.InvoicedQuantity.unitCode'), json_extract_string(x, '$.CreditedQuantity.unitCode')) AS unit, json_extract_string(x, '$.LineExtensionAmount') AS net_amount
FROM ubl_kids WHERE child_kind = 'line'
UNION ALL SELECT origin, record_id, child_kind, child_path, l.id, l.description, l.quantity, l.unit, l.net_amount FROM inv_lines WHERE {_HAS_LINE}""",
    "p5_payments": _KIDS
    + "SELECT origin, record_id, child_kind, child_path, json_extract_string(x, '$.PaymentID') AS payment_id, json_extract_string(x, '$.PayeeFinancialAccount.ID') AS iban FROM ubl_kids WHERE child_kind = 'payment'",
    "p5_charges": _KIDS
    + """SELECT origin, record_id, child_kind, child_path, parent_path, json_extract_string(x, '$.ChargeIndicator') AS is_charge, json_extract_string(x, '$.Amount') AS amount,
  json_extract_string(x, '$.AllowanceChargeReason') AS reason FROM ubl_kids WHERE child_kind = 'charge'""",
}


def _json(path: str) -> str:
    return f"json_extract_string(x, '$.{path}')"


def _has(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ") IS NOT NULL"


_DEC = "DECIMAL(20,4)"
_U_NAME, _U_VAT = (_json("Party.PartyLegalEntity.RegistrationName"), _json("Party.PartyName.Name")), _json("Party.PartyTaxScheme.CompanyID")
_U_QTY, _U_UNIT = (_json("InvoicedQuantity.value"), _json("CreditedQuantity.value")), (_json("InvoicedQuantity.unitCode"), _json("CreditedQuantity.unitCode"))
_U_NET, _KEY = _json("LineExtensionAmount"), "SELECT origin, record_id, child_kind, child_path, parent_path"
_PARTY_U = f"coalesce(nullif({_U_NAME[0]}, ''), {_U_NAME[1]}) AS name"
_LINE_U = f"{_json('ID')} AS id, {_json('Item.Name')} AS description"
_TAX_U = f"{_json('Item.ClassifiedTaxCategory.ID')} AS tax_category, TRY_CAST({_json('Item.ClassifiedTaxCategory.Percent')} AS {_DEC}) AS tax_percent"
_QTY_U, _NET_U = f"TRY_CAST(coalesce({', '.join(_U_QTY)}) AS {_DEC}) AS quantity", f"TRY_CAST({_U_NET} AS {_DEC}) AS net_amount"
_QTY_I, _NET_I, _TAX_I = f"TRY_CAST(l.quantity AS {_DEC})", f"TRY_CAST(l.net_amount AS {_DEC})", f"CAST(NULL AS VARCHAR), CAST(NULL AS {_DEC})"
_INV = "SELECT origin, record_id, child_kind, child_path, ''"
_PARTIES, _LINES = "FROM ubl_kids WHERE child_kind IN ('seller', 'buyer') AND ", "FROM ubl_kids WHERE child_kind = 'line' AND "
_I_NAME, _I_VAT, _I_QTY, _I_UNIT, _I_NET = _has("p.name"), _has("p.vat_id"), _has("l.quantity"), _has("l.unit"), _has("l.net_amount")
_PAY = {"means_code": _json("PaymentMeansCode"), "payment_id": _json("PaymentID"), "iban": _json("PayeeFinancialAccount.ID")}
_CHARGE = f"TRY_CAST({_json('ChargeIndicator')} AS BOOLEAN) AS is_charge, TRY_CAST({_json('Amount')} AS {_DEC}) AS amount"

_PART = "arg_max({0}, place) FILTER (WHERE {0} IS NOT NULL AND CAST({0} AS VARCHAR) NOT IN ('', {1})) AS {2}"
SQL |= {
    "journal_merge_fold": _CHANGES
    + f""", live AS (SELECT *, source.mailbox AS s1, source.uid AS s2, source.attachment_index AS s3, source.sha256 AS s4, source.saved_path AS s5 FROM kept WHERE place > gone AND deleted IS DISTINCT FROM true),
n AS (SELECT registry, entry_key, count(*) AS n_fields FROM merged GROUP BY ALL),
e AS (SELECT registry, entry_key, arg_min(recorded_at, place) AS recorded_at, {_PART.format("s1", "''", "mailbox")}, {_PART.format("s2", "'0'", "uid")}, {_PART.format("s3", "''", "attachment_index")}, {_PART.format("s4", "''", "sha256")}, {_PART.format("s5", "''", "saved_path")} FROM live GROUP BY registry, entry_key)
SELECT e.registry, e.entry_key, coalesce(n.n_fields, 0) AS n_fields, e.mailbox, e.uid, e.attachment_index, e.sha256, e.saved_path, e.recorded_at FROM e LEFT JOIN n ON e.registry = n.registry AND e.entry_key = n.entry_key""",
    "p5_party_full": _KIDS + f"{_KEY}, {_PARTY_U}, {_U_VAT} AS vat_id {_PARTIES} {_has(*_U_NAME)} AND {_has(_U_VAT)} UNION ALL {_INV}, p.name, p.vat_id FROM inv_parties WHERE {_I_NAME} AND {_I_VAT}",
    "p5_party_name_only": _KIDS + f"{_KEY}, {_PARTY_U} {_PARTIES} {_has(*_U_NAME)} AND NOT ({_has(_U_VAT)}) UNION ALL {_INV}, p.name FROM inv_parties WHERE {_I_NAME} AND NOT ({_I_VAT})",
    "p5_party_vat_only": _KIDS + f"{_KEY}, {_U_VAT} AS vat_id {_PARTIES} NOT ({_has(*_U_NAME)}) AND {_has(_U_VAT)} UNION ALL {_INV}, p.vat_id FROM inv_parties WHERE NOT ({_I_NAME}) AND {_I_VAT}",
    "p5_line_measured": _KIDS
    + f"{_KEY}, {_LINE_U}, {_QTY_U}, coalesce({', '.join(_U_UNIT)}) AS unit, {_NET_U}, {_TAX_U} {_LINES} {_has(*_U_QTY)} AND {_has(*_U_UNIT)} UNION ALL {_INV}, l.id, l.description, {_QTY_I}, l.unit, {_NET_I}, {_TAX_I} FROM inv_lines WHERE {_I_QTY} AND {_I_UNIT}",
    "p5_line_counted": _KIDS + f"{_KEY}, {_LINE_U}, {_QTY_U}, {_NET_U}, {_TAX_U} {_LINES} {_has(*_U_QTY)} AND NOT ({_has(*_U_UNIT)}) UNION ALL {_INV}, l.id, l.description, {_QTY_I}, {_NET_I}, {_TAX_I} FROM inv_lines WHERE {_I_QTY} AND NOT ({_I_UNIT})",
    "p5_line_amount": _KIDS + f"{_KEY}, {_LINE_U}, {_NET_U}, {_TAX_U} {_LINES} NOT ({_has(*_U_QTY)}) AND {_has(_U_NET)} UNION ALL {_INV}, l.id, l.description, {_NET_I}, {_TAX_I} FROM inv_lines WHERE NOT ({_I_QTY}) AND {_I_NET}",
    "p5_payment_account": _KIDS + f"{_KEY}, {', '.join(f'{v} AS {k}' for k, v in _PAY.items())} FROM ubl_kids WHERE child_kind = 'payment' AND {_has(_PAY['iban'])}",
    "p5_payment_reference": _KIDS + f"{_KEY}, {_PAY['means_code']} AS means_code, {_PAY['payment_id']} AS payment_id FROM ubl_kids WHERE child_kind = 'payment' AND NOT ({_has(_PAY['iban'])}) AND {_has(_PAY['payment_id'])}",
    "p5_payment_code": _KIDS + f"{_KEY}, {_PAY['means_code']} AS means_code FROM ubl_kids WHERE child_kind = 'payment' AND NOT ({_has(_PAY['iban'], _PAY['payment_id'])}) AND {_has(_PAY['means_code'])}",
    "p5_charge_explained": _KIDS + f"{_KEY}, {_CHARGE}, {_json('AllowanceChargeReason')} AS reason FROM ubl_kids WHERE child_kind = 'charge' AND {_has(_json('AllowanceChargeReason'))}",
    "p5_charge_plain": _KIDS + f"{_KEY}, {_CHARGE} FROM ubl_kids WHERE child_kind = 'charge' AND NOT ({_has(_json('AllowanceChargeReason'))}) AND {_has(_json('Amount'))}",
    "p5_records": _KIDS
    + f"""SELECT 'ubl_record' AS origin, raw_id AS record_id, json_extract_string(j, '$.ID') AS invoice_number, coalesce(json_extract_string(j, '$.InvoiceTypeCode'), json_extract_string(j, '$.CreditNoteTypeCode')) AS type_code,
  TRY_CAST(json_extract_string(j, '$.IssueDate') AS DATE) AS issue_date, TRY_CAST(json_extract_string(j, '$.DueDate') AS DATE) AS due_date, json_extract_string(j, '$.DocumentCurrencyCode') AS currency,
  TRY_CAST(json_extract_string(j, '$.LegalMonetaryTotal.TaxExclusiveAmount') AS {_DEC}) AS total_net, TRY_CAST(json_extract_string(j, '$.TaxTotal.TaxAmount') AS {_DEC}) AS total_tax,
  TRY_CAST(json_extract_string(j, '$.LegalMonetaryTotal.TaxInclusiveAmount') AS {_DEC}) AS total_gross, TRY_CAST(json_extract_string(j, '$.LegalMonetaryTotal.PayableAmount') AS {_DEC}) AS payable_amount FROM u
UNION ALL SELECT DISTINCT 'invoice', invoice_id, invoice_number, type_code, TRY_CAST(issue_date AS DATE), TRY_CAST(due_date AS DATE), currency, TRY_CAST(total_net AS {_DEC}), TRY_CAST(total_tax AS {_DEC}), TRY_CAST(total_gross AS {_DEC}), TRY_CAST(payable_amount AS {_DEC}) FROM invoice""",
    "p5_orphans": "SELECT CAST(NULL AS VARCHAR) AS child_kind, CAST(NULL AS BIGINT) AS n WHERE false",
}
