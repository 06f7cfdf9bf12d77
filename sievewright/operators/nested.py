"""Deeply nested records as related flat tables.

A deterministic bottom-up tree automaton reads each record once. Leaves go to the states null, string, number
or boolean; an object's state follows from its keys and their states, an array's from the set of its members'
states. States are created as trees are met and shared between equal subtrees. A state knows its *shape* (the
structural variant), whether any value lies below it, and to which subtype of a kind of child it belongs. :func:`records` is the
table of parents; the supertype table :func:`ubl_children` or :func:`invoice_children` keeps the common keys of all variants
and the link to the parent; :func:`subtype` gives the table of one subtype, with numbers and booleans typed and the
same keys, so that it joins back without loss. :func:`parties`, :func:`lines`, :func:`payments` and :func:`charges` unite the
subtypes of a kind, as printed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPER = ["origin", "record_id", "child_kind", "child_path"]
SCHEMA = "origin string, record_id bigint, child_kind string, child_path string, parent_kind string, parent_path string, variant string, subtype string, attrs map<string,string>"
#: Characters beyond which a shape is named by a hash.
LONGEST_SHAPE = 4_000

# The subtypes of each kind: name, attributes that a child of it has, of each group one; the first that holds is taken.
_ROUTES = {
    "party": (("full", (("legal_name", "trade_name"), ("vat_id",))), ("name_only", (("legal_name", "trade_name"),)), ("vat_only", (("vat_id",),))),
    "line": (("measured", (("quantity",), ("unit",))), ("counted", (("quantity",),)), ("amount", (("net_amount",),))),
    "payment": (("account", (("iban",),)), ("reference", (("payment_id",),)), ("code", (("means_code",),))),
    "charge": (("explained", (("reason",),)), ("plain", (("amount",),))),
    "record": (),
}
_KIND = {"seller": "party", "buyer": "party", "line": "line", "payment": "payment", "charge": "charge", "record": "record"}
# Where an attribute lies in a raw record; a measure may be an object with a value or a bare one.
_AT = {
    "legal_name": ("Party.PartyLegalEntity.RegistrationName",), "trade_name": ("Party.PartyName.Name",), "vat_id": ("Party.PartyTaxScheme.CompanyID",),
    "quantity": ("InvoicedQuantity", "InvoicedQuantity.value", "CreditedQuantity", "CreditedQuantity.value"), "unit": ("InvoicedQuantity.unitCode", "CreditedQuantity.unitCode"),
    "net_amount": ("LineExtensionAmount", "LineExtensionAmount.value"), "iban": ("PayeeFinancialAccount.ID",), "payment_id": ("PaymentID",), "means_code": ("PaymentMeansCode",),
    "reason": ("AllowanceChargeReason",), "amount": ("Amount", "Amount.value"),
}
_DEEPEST = max(p.count(".") for ps in _AT.values() for p in ps) + 1
# Columns of the subtype tables; what isn't text has its type beside it.
_MONEY = "decimal(20,4)"
_COLUMNS = {
    "party": {"name": "string", "vat_id": "string"},
    "line": {"id": "string", "description": "string", "quantity": _MONEY, "unit": "string", "net_amount": _MONEY, "tax_category": "string", "tax_percent": _MONEY},
    "payment": {"means_code": "string", "payment_id": "string", "iban": "string"},
    "charge": {"is_charge": "boolean", "amount": _MONEY, "reason": "string"},
}
_LEFT_OUT = {"party_vat_only": {"name"}, "party_name_only": {"vat_id"}, "line_counted": {"unit"}, "line_amount": {"quantity", "unit"}, "payment_reference": {"iban"}, "payment_code": {"iban", "payment_id"}, "charge_plain": {"reason"}}
HEAD = {"invoice_number": "string", "type_code": "string", "issue_date": "date", "due_date": "date", "currency": "string", "total_net": _MONEY, "total_tax": _MONEY, "total_gross": _MONEY, "payable_amount": _MONEY}
SUBTYPES = tuple(f"{kind}_{name}" for kind, routes in _ROUTES.items() for name, _ in routes)


_HERE = frozenset([""])
_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*+")|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)')


class _Number(str):
    """A JSON number as printed."""


class ShapeAutomaton:
    """States are numbers; ``shape[q]`` is the variant's text, ``valued[q]`` says if a value lies below, ``paths[q]`` where (near the top)."""

    def __init__(self) -> None:
        self.shape: list[str] = []
        self.valued: list[bool] = []
        self.paths: list[frozenset[str]] = []
        self._delta: dict[tuple, int] = {}
        self._subtypes: dict[tuple[str, int], str] = {}

    def _state(self, key: tuple, shape: str, valued: bool, paths: frozenset[str] = frozenset()) -> int:
        if (q := self._delta.get(key)) is None:
            q = self._delta[key] = len(self.shape)
            self.shape.append(shape if len(shape) <= LONGEST_SHAPE else shape[0] + "#" + hashlib.sha256(shape.encode("utf-8", "surrogatepass")).hexdigest())
            self.valued.append(valued)
            self.paths.append(paths)
        return q

    def _leaf(self, x: object) -> int:
        if x is None:
            return self._state(("null",), "null", False)
        if isinstance(x, bool):
            return self._state(("boolean",), "boolean", True, _HERE)
        if isinstance(x, _Number) or not isinstance(x, str):
            return self._state(("number",), "number", True, _HERE)
        return self._state(("string", bool(x)), "string", bool(x), _HERE if x else frozenset())

    def _object(self, kids: list[tuple[str, int]]) -> int:
        # a key without a value says nothing about the shape
        own = tuple(sorted((k, q) for k, q in kids if self.valued[q]))
        if (q := self._delta.get(("object", own))) is not None:
            return q
        paths = frozenset(k + "." + p if p else k for k, q in own for p in self.paths[q] if p.count(".") + 1 < _DEEPEST)
        return self._state(("object", own), "{" + ",".join(f"{k}:{self.shape[q]}" for k, q in own) + "}", bool(own), paths)

    def _array(self, members: list[int]) -> int:
        own = tuple(sorted({q for q in members if self.valued[q]}))
        if (q := self._delta.get(("array", own))) is not None:
            return q
        return self._state(("array", own), "[" + "|".join(self.shape[q] for q in own) + "]", bool(own), frozenset().union(*(self.paths[q] for q in own)))

    def run(self, x: object) -> int:
        """The state of a tree, however deep. Null, and objects and arrays that hold nothing but such, have no value; an empty string has none either."""
        done: list[int] = []
        todo: list[tuple[object, bool]] = [(x, False)]
        while todo:
            node, met = todo.pop()
            if isinstance(node, dict | list):
                n = len(node)
                if not met:
                    todo.append((node, True))
                    todo += [(v, False) for v in (reversed(node.values()) if isinstance(node, dict) else reversed(node))]
                    continue
                kids, done[len(done) - n :] = done[len(done) - n :], []
                done.append(self._object(list(zip(node, kids))) if isinstance(node, dict) else self._array(kids))
            else:
                done.append(self._leaf(node))
        return done[0]

    def subtype(self, kind: str, q: int) -> str:
        """The subtype to which a child of a kind in a state is routed."""
        kind = _KIND[kind]
        if (name := self._subtypes.get((kind, q))) is None:
            has = lambda group: any(p in self.paths[q] for a in group for p in _AT[a])
            name = next((f"{kind}_{r}" for r, groups in _ROUTES[kind] if all(map(has, groups))), f"{kind}_other")
            self._subtypes[kind, q] = name
        return name


def parsed(payload: str) -> object:
    """A JSON text with numbers as printed. Raises ValueError if it is cut off or no JSON."""
    try:
        return json.loads(payload, parse_int=_Number, parse_float=_Number)
    except RecursionError:
        return _parsed_deep(payload)


def _parsed_deep(text: str) -> object:
    """The same for texts nested deeper than the parser goes, with a list of what is open instead of calls."""
    top: list = []
    open_: list[list | dict] = [top]
    key: list[str | None] = [None]
    at, want = 0, "value"  # value, member (value or end), key, first key (or end), colon, more
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at, sign, string = m.end(), m.group(1), m.group(2)
        box = open_[-1]
        if want in ("key", "first key") and string is not None:
            key[-1], want = json.loads(string), "colon"
            continue
        if want == "colon" and sign == ":":
            want = "value"
            continue
        if want == "more" and sign == ",":
            want = "key" if isinstance(box, dict) else "value"
            continue
        if sign in ("}", "]") and len(open_) > 1 and (sign == "}") == isinstance(box, dict) and want in ("more", "first key" if sign == "}" else "member"):
            open_.pop()
            key.pop()
        elif want in ("value", "member") and (sign in ("{", "[") or sign is None):
            value = {} if sign == "{" else [] if sign == "[" else json.loads(m.group().strip(), parse_int=_Number, parse_float=_Number)
            if isinstance(box, dict):
                box[key[-1]] = value
            else:
                box.append(value)
            if sign:
                open_.append(value)
                key.append(None)
                want = "first key" if sign == "{" else "member"
                continue
        else:
            raise ValueError("no JSON")
        want = "more"
        if len(open_) == 1:
            if text[at:].strip(" \t\r\n"):
                raise ValueError("something follows")
            return top[0]


def _listed(x: object) -> list:
    """A list as it is; a bare value is a list of one; nothing is no list."""
    return x if isinstance(x, list) else [] if x is None else [x]


def _text(x: object, *path: str) -> str | None:
    """The scalar at a path as text, through lists of one; null if there is none. A ``{value: …}`` object counts as its value."""
    for k in path:
        if isinstance(x, list):
            x = next((v for v in x if v is not None), None)
        x = x.get(k) if isinstance(x, dict) else None
    if isinstance(x, list):
        x = next((v for v in x if v is not None), None)
    if isinstance(x, dict):
        x = x.get("value")
    if x is None or isinstance(x, dict | list):
        return None
    return ("true" if x else "false") if isinstance(x, bool) else str(x)


def _some(**attrs: str | None) -> list[tuple[str, str]]:
    return [(k, v) for k, v in attrs.items() if v is not None]


def _party(x: object) -> list[tuple[str, str]]:
    p = x.get("Party") if isinstance(x, dict) else None
    return _some(legal_name=_text(p, "PartyLegalEntity", "RegistrationName"), trade_name=_text(p, "PartyName", "Name"), vat_id=_text(p, "PartyTaxScheme", "CompanyID"))


def _line(x: object) -> list[tuple[str, str]]:
    unit = lambda k: _text(x, k, "unitCode")
    return _some(
        id=_text(x, "ID"),
        description=_text(x, "Item", "Name"),
        quantity=_text(x, "InvoicedQuantity") or _text(x, "CreditedQuantity"),
        unit=unit("InvoicedQuantity") or unit("CreditedQuantity"),
        net_amount=_text(x, "LineExtensionAmount"),
        tax_category=_text(x, "Item", "ClassifiedTaxCategory", "ID"),
        tax_percent=_text(x, "Item", "ClassifiedTaxCategory", "Percent"),
    )


def _payment(x: object) -> list[tuple[str, str]]:
    return _some(means_code=_text(x, "PaymentMeansCode"), payment_id=_text(x, "PaymentID"), iban=_text(x, "PayeeFinancialAccount", "ID"))


def _charge(x: object) -> list[tuple[str, str]]:
    return _some(is_charge=_text(x, "ChargeIndicator"), amount=_text(x, "Amount"), reason=_text(x, "AllowanceChargeReason"))


def _head(x: object) -> list[tuple[str, str]]:
    return _some(
        invoice_number=_text(x, "ID"),
        type_code=_text(x, "InvoiceTypeCode") or _text(x, "CreditNoteTypeCode"),
        issue_date=_text(x, "IssueDate"),
        due_date=_text(x, "DueDate"),
        currency=_text(x, "DocumentCurrencyCode"),
        total_net=_text(x, "LegalMonetaryTotal", "TaxExclusiveAmount"),
        total_tax=_text(x, "TaxTotal", "TaxAmount"),
        total_gross=_text(x, "LegalMonetaryTotal", "TaxInclusiveAmount"),
        payable_amount=_text(x, "LegalMonetaryTotal", "PayableAmount"),
    )


def payload_children(payload: str | None, automaton: ShapeAutomaton) -> list[tuple]:
    """(kind, path, parent kind, parent path, variant, subtype, attributes) of one payload: its record itself, then each child that holds a value."""
    try:
        doc = parsed(payload) if payload else None
    except ValueError:
        return []
    if not isinstance(doc, dict):
        return []
    head = automaton.run({k: v for k, v in doc.items() if not isinstance(v, dict | list)})
    out: list[tuple] = [("record", "", "", "", automaton.shape[head], "record", _head(doc))]

    def add(kind: str, path: str, above: tuple[str, str], x: object, attrs: object) -> None:
        if automaton.valued[q := automaton.run(x)]:
            out.append((kind, path, *above, automaton.shape[q], automaton.subtype(kind, q), attrs(x)))

    top = ("record", "")
    add("seller", "", top, doc.get("AccountingSupplierParty"), _party)
    add("buyer", "", top, doc.get("AccountingCustomerParty"), _party)
    for i, x in enumerate(_listed(doc.get("PaymentMeans")), 1):
        add("payment", str(i), top, x, _payment)
    for i, x in enumerate(_listed(doc.get("InvoiceLine")) + _listed(doc.get("CreditNoteLine")), 1):
        add("line", str(i), top, x, _line)
        for j, y in enumerate(_listed(x.get("AllowanceCharge")) if isinstance(x, dict) else [], 1):
            add("charge", f"{i}.{j}", ("line", str(i)), y, _charge)
    return out


def ubl_records(raw: DataFrame) -> DataFrame:
    """Records and children of raw UBL payloads (``raw_id``, ``payload``), parents (child_kind ``record``) among them.

    A payload that is null, cut off or no JSON object gives no row; one of any depth is read whole. Null
    children and children without a value keep their place in the list and give no row. Credit note lines
    follow invoice lines in one numbering. Repeated records count once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("record_id", pa.int64()), *((n, pa.string()) for n in ("child_kind", "child_path", "parent_kind", "parent_path", "variant", "subtype")), ("attrs", pa.map_(pa.string(), pa.string()))])
        automaton = ShapeAutomaton()
        for b in batches:
            rows = [(i, *c) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None for c in payload_children(p, automaton)]
            if len(automaton.shape) > 50_000:  # odd inputs only; states are rebuilt as they are met
                automaton = ShapeAutomaton()
            yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*rows) if rows else [[]] * len(types), types)], schema=types)

    once = raw.select("raw_id", "payload").dropDuplicates(["raw_id"])
    return once.mapInArrow(read, SCHEMA.split(", ", 1)[1]).select(F.lit("ubl_record").alias("origin"), "*")


def ubl_children(raw: DataFrame) -> DataFrame:
    """Supertype rows of raw UBL payloads; see :func:`ubl_records`."""
    return ubl_records(raw).filter(F.col("child_kind") != "record")


def holds_value(x: Column, kind: T.DataType) -> Column:
    """If a typed value holds anything at any depth; an empty string does not count."""
    if isinstance(kind, T.StructType):
        any_of = F.lit(False)
        for f in kind.fields:
            any_of = any_of | holds_value(x.getField(f.name), f.dataType)
        return F.coalesce(any_of, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(x, lambda v: holds_value(v, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(x), lambda v: holds_value(v, kind.valueType)), F.lit(False))
    if isinstance(kind, T.StringType):
        return x.isNotNull() & (x != "")
    return x.isNotNull()


def _variant(x: Column, kind: T.StructType) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.when(holds_value(x.getField(f.name), f.dataType), F.lit(f"{f.name}:{f.dataType.simpleString()}")) for f in kind.fields])), ","), F.lit("}"))


def _routed(kind: str, x: Column, t: T.StructType, names: dict[str, str]) -> Column:
    """The subtype of a typed child, by the same rule as :meth:`ShapeAutomaton.subtype`."""
    at = {name: n for n, name in names.items()}
    valued = lambda a: holds_value(x.getField(at[a]), t[at[a]].dataType) if a in at else F.lit(False)
    kind = _KIND[kind]
    out = F.lit(f"{kind}_other")
    for name, groups in reversed(_ROUTES[kind]):
        holds = F.lit(True)
        for group in groups:
            any_of = F.lit(False)
            for a in group:
                any_of = any_of | valued(a)
            holds = holds & any_of
        out = F.when(holds, F.lit(f"{kind}_{name}")).otherwise(out)
    return out


def _attrs(x: Column, kind: T.StructType, names: dict[str, str]) -> Column:
    of = F.map_from_arrays(F.array(*[F.lit(n) for n in names.values()]), F.array(*[x.getField(n).cast("string") for n in names]))
    return F.map_filter(of, lambda k, v: v.isNotNull())


def invoice_children(invoices: DataFrame) -> DataFrame:
    """Supertype rows of typed invoices (``invoice_id``, ``seller``, ``buyer``, ``lines``), in the JVM throughout.

    Null structs and structs without a value give no row; lines keep their place. Repeated invoices count once.
    """
    kinds = {f.name: f.dataType for f in invoices.schema.fields}
    party, line = kinds["seller"], kinds["lines"].elementType
    child = lambda kind, path, x, t, names: F.struct(F.lit(kind).alias("child_kind"), path.alias("child_path"), holds_value(x, t).alias("valued"), _variant(x, t).alias("variant"), _routed(kind, x, t, names).alias("subtype"), _attrs(x, t, names).alias("attrs"))
    who = {"name": "legal_name", "vat_id": "vat_id"}
    what = {n: n for n in ("id", "description", "quantity", "unit", "net_amount")}
    every = F.concat(
        F.array(child("seller", F.lit(""), F.col("seller"), party, who), child("buyer", F.lit(""), F.col("buyer"), kinds["buyer"], who)),
        F.coalesce(F.transform(F.col("lines"), lambda x, i: child("line", (i + 1).cast("string"), x, line, what)), F.array()),
    )
    return (
        invoices.filter(F.col("invoice_id").isNotNull())
        .dropDuplicates(["invoice_id"])
        .select(F.col("invoice_id").alias("record_id"), F.explode(F.filter(every, lambda c: c["valued"])).alias("c"))
        .select(F.lit("invoice").alias("origin"), "record_id", "c.child_kind", "c.child_path", F.lit("record").alias("parent_kind"), F.lit("").alias("parent_path"), "c.variant", "c.subtype", "c.attrs")
    )


def records(invoices: DataFrame, raw: DataFrame) -> DataFrame:
    """The table of parents: (origin, record_id) and what heads an invoice, dates and amounts typed (null if they are none)."""
    own = invoices.filter(F.col("invoice_id").isNotNull()).dropDuplicates(["invoice_id"]).select(F.lit("invoice").alias("origin"), F.col("invoice_id").alias("record_id"), *[F.col(c).try_cast(t).alias(c) for c, t in HEAD.items()])
    ubl = ubl_records(raw).filter(F.col("child_kind") == "record").select("origin", "record_id", *[F.col("attrs")[c].try_cast(t).alias(c) for c, t in HEAD.items()])
    return own.unionByName(ubl)


def children(invoices: DataFrame, records: DataFrame) -> DataFrame:
    """The supertype table over both origins."""
    return invoice_children(invoices).unionByName(ubl_children(records))


def _name() -> Column:
    return F.coalesce(F.nullif(F.col("attrs")["legal_name"], F.lit("")), F.col("attrs")["trade_name"])


def subtype(of: DataFrame, name: str) -> DataFrame:
    """The table of one subtype: keys, parent link and the attributes that its variants have, numbers and booleans typed (null if a text is none)."""
    kind = name.split("_", 1)[0]
    columns = {c: t for c, t in _COLUMNS[kind].items() if c not in _LEFT_OUT.get(name, ())}
    typed = [(_name() if c == "name" else F.col("attrs")[c]).try_cast(t).alias(c) for c, t in columns.items()]
    return of.filter(F.col("subtype") == name).select(*SUPER, "parent_kind", "parent_path", "variant", *typed)


def _typed(of: DataFrame, kinds: tuple[str, ...], *names: str) -> DataFrame:
    return of.filter(F.col("child_kind").isin(*kinds)).select(*SUPER, "parent_kind", "parent_path", "variant", "subtype", *[F.col("attrs")[n].alias(n) for n in names])


def parties(of: DataFrame) -> DataFrame:
    """Sellers and buyers: the legal name, else the trade name, and the VAT id."""
    t = _typed(of, ("seller", "buyer"), "legal_name", "trade_name", "vat_id")
    return t.withColumn("name", F.coalesce(F.nullif("legal_name", F.lit("")), F.col("trade_name")))


def lines(of: DataFrame) -> DataFrame:
    """Invoice and credit note lines, amounts as printed."""
    return _typed(of, ("line",), "id", "description", "quantity", "unit", "net_amount", "tax_category", "tax_percent")


def payments(of: DataFrame) -> DataFrame:
    """Payment means."""
    return _typed(of, ("payment",), "means_code", "payment_id", "iban")


def charges(of: DataFrame) -> DataFrame:
    """Allowances and charges of lines; parent_path is the line's child_path."""
    return _typed(of, ("charge",), "is_charge", "amount", "reason")
