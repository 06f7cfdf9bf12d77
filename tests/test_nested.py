import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from sievewright.operators import nested
from sievewright.plans import core_problems


def kids(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in payloads], "raw_id bigint, payload string, origin string")
    return sorted((r["record_id"], r["child_kind"], r["child_path"]) for r in nested.ubl_children(df).collect())


def test_shapes_of_payloads(spark):
    whole = {"AccountingSupplierParty": {"Party": {}}, "AccountingCustomerParty": {"Party": {"PartyName": {"Name": "B"}}}, "PaymentMeans": {"PaymentID": "p"}, "InvoiceLine": [None, {}, {"ID": "3", "AllowanceCharge": [None, {"Amount": "1"}, {"Amount": None}]}, {"ID": "4", "AllowanceCharge": {"Amount": 2}}], "Unknown": [[1]]}
    credit = {"CreditNoteLine": {"ID": 1, "CreditedQuantity": {"value": "2", "unitCode": "H87"}}, "PaymentMeans": []}
    rows = [(1, json.dumps(whole)), (1, json.dumps(whole)), (2, json.dumps(credit)), (3, json.dumps(whole)[:-9]), (4, None), (5, ""), (6, "[1]"), (7, "null"), (8, '{"InvoiceLine": "bare"}'), (9, '{"a":' * 5000)]
    assert kids(spark, rows) == [(1, "buyer", ""), (1, "charge", "3.2"), (1, "charge", "4.1"), (1, "line", "3"), (1, "line", "4"), (1, "payment", "1"), (2, "line", "1"), (8, "line", "1")]


def test_typed_tables_keep_keys(spark):
    doc = {"InvoiceLine": [{"ID": "1", "InvoicedQuantity": {"value": 1.50, "unitCode": "C62"}, "Item": {"Name": "n"}, "AllowanceCharge": {"ChargeIndicator": True, "Amount": "5"}}]}
    all_ = nested.ubl_children(spark.createDataFrame([(1, json.dumps(doc).replace("1.5", "1.50"))], "raw_id bigint, payload string"))
    line = nested.lines(all_).first()
    assert (line["quantity"], line["unit"], line["description"]) == ("1.50", "C62", "n")
    charge = nested.charges(all_).first()
    assert (charge["parent_kind"], charge["parent_path"], charge["is_charge"]) == ("line", "1", "true")


def test_automaton_shares_states():
    a = nested.ShapeAutomaton()
    q = a.run({"x": [{"y": "1"}, {"y": "2"}], "z": None})
    assert a.shape[q] == "{x:[{y:string}]}" and a.valued[q]
    assert a.run({"x": [{"y": "3"}]}) == q
    assert not a.valued[a.run({"x": [None, {}, {"y": ""}]})]


def test_invoices(spark):
    party = "struct<name:string,vat_id:string>"
    schema = f"invoice_id bigint, seller {party}, buyer {party}, lines array<struct<id:string,description:string,quantity:string,unit:string,net_amount:string>>, child_kind string, record_id string"
    line = lambda **k: Row(**({"id": None, "description": None, "quantity": None, "unit": None, "net_amount": None} | k))
    rows = [(1, Row(name="S", vat_id=None), Row(name=None, vat_id=None), [None, line(), line(id="3")], "c", "c")] * 2 + [(2, None, Row(name="", vat_id="V"), None, "c", "c"), (3, None, None, [], "c", "c"), (None, Row(name="S", vat_id=None), None, None, "c", "c")]
    out = nested.invoice_children(spark.createDataFrame(rows, schema))
    assert sorted((r["record_id"], r["child_kind"], r["child_path"]) for r in out.collect()) == [(1, "line", "3"), (1, "seller", ""), (2, "buyer", "")]
    assert nested.invoice_children(spark.createDataFrame([], schema)).count() == 0


def test_whole_typed_tables_keep_tax_and_means(spark, data):
    held = {"tax_category": 0, "tax_percent": 0, "means_code": 0}
    for r in {r["raw_id"]: r["payload"] for r in spark.read.parquet(f"{data}/ubl_record.parquet").collect()}.values():
        try:
            doc = json.loads(r)
        except (TypeError, ValueError):
            continue
        many = lambda x: x if isinstance(x, list) else [x]
        for x in many(doc.get("InvoiceLine") or doc.get("CreditNoteLine") or []):
            tax = ((x or {}).get("Item") or {}).get("ClassifiedTaxCategory") or {}
            held["tax_category"] += bool(tax.get("ID"))
            held["tax_percent"] += bool(tax.get("Percent"))
        for x in many(doc.get("PaymentMeans") or []):
            held["means_code"] += bool((x or {}).get("PaymentMeansCode"))
    lines, payments = core_problems.QUERIES["p5_lines_whole"](spark, data), core_problems.QUERIES["p5_payments_whole"](spark, data)
    got = {c: df.filter(f"{c} <> ''").count() for df, c in ((lines, "tax_category"), (lines, "tax_percent"), (payments, "means_code"))}
    assert got == held and any(held.values())
    assert lines.count() == core_problems.p5_lines(spark, data).count() and payments.count() == core_problems.p5_payments(spark, data).count()


def test_a_payload_of_any_depth_is_read_whole(spark):
    deep = '{"a":[' * 100_000 + "1" + "]}" * 100_000
    line = f'{{"ID": "1", "Note": {deep}}}'
    rows = [(1, f'{{"Extensions": {deep}, "InvoiceLine": [{line}, {{"ID": "2"}}], "AccountingSupplierParty": {{"Party": {{"PartyName": {{"Name": "S"}}}}}}}}'), (2, f'{{"Extensions": {deep}, "InvoiceLine": {{"ID": "1"}}'), (3, f'{{"Extensions": {deep}}} x')]
    assert kids(spark, rows) == [(1, "line", "1"), (1, "line", "2"), (1, "seller", "")]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=30), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_deep_parser_agrees_with_the_usual_one(tree, cut):
    text = json.dumps(tree, ensure_ascii=len(str(tree)) % 2 == 0, indent=2 if len(str(tree)) % 3 == 0 else None)
    for t in (text, text[:-1], text[:cut], text + ",", "[" + text + ",]", text.replace(":", ",", 1)):
        try:
            want = json.loads(t, parse_int=nested._Number, parse_float=nested._Number)
        except ValueError:
            with pytest.raises(ValueError):
                nested._parsed_deep(t)
        else:
            assert nested._parsed_deep(t) == want


def test_subtypes_of_both_origins_follow_one_rule(spark):
    party = "struct<name:string,vat_id:string>"
    schema = f"invoice_id bigint, seller {party}, buyer {party}, lines array<struct<id:string,description:string,quantity:string,unit:string,net_amount:string>>"
    line = lambda **k: Row(**({"id": None, "description": None, "quantity": None, "unit": None, "net_amount": None} | k))
    typed = nested.invoice_children(spark.createDataFrame([(1, Row(name="S", vat_id="V"), Row(name="", vat_id="V"), [line(quantity="2", unit="C62"), line(quantity="x"), line(net_amount="5"), line(id="4")])], schema))
    raw = {
        "AccountingSupplierParty": {"Party": {"PartyName": [{"Name": "S"}], "PartyTaxScheme": {"CompanyID": "V"}}}, "AccountingCustomerParty": {"Party": {"PartyName": {"Name": ""}, "PartyTaxScheme": {"CompanyID": "V"}}},
        "InvoiceLine": [{"InvoicedQuantity": {"value": 2, "unitCode": "C62"}}, {"InvoicedQuantity": "x"}, {"LineExtensionAmount": {"value": 5}}, {"ID": 4}], "PaymentMeans": [{"PaymentMeansCode": 58}, {"PaymentID": "p"}, {"PayeeFinancialAccount": {"ID": "i"}}, {"Odd": 1}],
    }
    ubl = nested.ubl_children(spark.createDataFrame([(1, json.dumps(raw))], "raw_id bigint, payload string"))
    of = lambda df: {(r["child_kind"], r["child_path"]): r["subtype"] for r in df.collect()}
    want = {("seller", ""): "party_full", ("buyer", ""): "party_vat_only", ("line", "1"): "line_measured", ("line", "2"): "line_counted", ("line", "3"): "line_amount", ("line", "4"): "line_other"}
    assert of(typed) == want
    assert of(ubl) == want | {("payment", "1"): "payment_code", ("payment", "2"): "payment_reference", ("payment", "3"): "payment_account", ("payment", "4"): "payment_other"}
    counted = nested.subtype(ubl.unionByName(typed), "line_counted")
    assert [r["quantity"] for r in counted.collect()] == [None, None] and dict(counted.dtypes)["quantity"] == "decimal(20,4)" and "unit" not in counted.columns


def test_records_are_the_parents_of_all(spark, data):
    assert core_problems.QUERIES["p5_orphans"](spark, data).count() == 0
    top = core_problems.p5_records(spark, data)
    assert top.count() == top.select("origin", "record_id").distinct().count()
