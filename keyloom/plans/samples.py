"""Small catalogs that show one modelling pattern each; queries and tests run on them."""

from __future__ import annotations


def _columns(spec: str) -> list[dict]:
    """name:type, a question mark after the name for nullable, an exclamation mark for unique."""
    out = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        out.append({"name": name.rstrip("?!"), "data_type": kind or "text", "is_nullable": "?" in name, "is_unique": "!" in name})
    return out


def _table(spec: str, key: str = "", *fks: tuple[str, str, str], **more) -> dict:
    return {
        "columns": _columns(spec),
        "primary_key": key.split(),
        "foreign_keys": [{"columns": c.split(), "foreign_table": t, "foreign_columns": f.split()} for c, t, f in fks],
        **more,
    }


SALES = {
    "source": {"dialect": "duckdb", "namespace": "sales"},
    "tables": {
        "users": _table("id:integer email:varchar", "id", schema_name="sales"),
        "products": _table("id:integer sku!:varchar price?:decimal(10,2)", "id", schema_name="sales", unique_constraints=[["sku"]]),
        "orders": _table("id:integer user_id:integer", "id", ("user_id", "users", "id"), schema_name="sales"),
        "basket": _table("order_id:integer product_sku:varchar qty?:integer", "order_id product_sku", ("order_id", "orders", "id"), ("product_sku", "products", "sku"), schema_name="sales"),
    },
}
ACCOUNTS = {
    "tables": {
        "account": _table("account_id:integer name balance?:numeric account_type", "account_id", check_constraints=[{"name": "kinds", "expression": "account_type IN ('mortgage','checking','savings','insurance')", "columns": ["account_type"]}]),
        "mortgage_account": _table("account_id:integer routing_number? principal?:numeric monthly_payment?:numeric", "account_id", ("account_id", "account", "account_id")),
        "checking_account": _table("account_id:integer routing_number? overdraft_limit?:numeric", "account_id", ("account_id", "account", "account_id")),
        "savings_account": _table("account_id:integer routing_number? apy?:numeric", "account_id", ("account_id", "account", "account_id")),
        "insurance_account": _table("account_id:integer premium?:numeric policy_number?", "account_id", ("account_id", "account", "account_id")),
    }
}
CRM = {
    "tables": {
        "accounts": _table("id:bigint account_id!", "id"),
        "contracts": _table("id:bigint contract_id! account_id", "id"),
        "opportunities": _table("id:bigint account_id? contract_id?", "id"),
        "order_products": _table("order_id:int product_id:int", "order_id product_id"),
        "order_lines": _table("id:int order_id:int product_id:int", "id"),
    }
}
CYCLE = {
    "tables": {
        "d": _table("id:int c_id:int", "id", ("c_id", "c", "id")),
        "a": _table("id:int b_id:int a_id:int", "id", ("b_id", "b", "id"), ("a_id", "a", "id")),
        "b": _table("id:int c_id:int", "id", ("c_id", "c", "id")),
        "c": _table("id:int", "id"),
        "x": _table("id:int y_id:int", "id", ("y_id", "y", "id")),
        "y": _table("id:int x_id:int", "id", ("x_id", "x", "id")),
    }
}
SALES_LATER = {
    "tables": {
        "users": _table("id:bigint email?:varchar name?:varchar", "id", schema_name="sales"),
        "products": _table("id:integer sku!:varchar price?:decimal(10,2)", "sku", schema_name="sales"),
        "orders": _table("id:integer user_id:integer", "id", schema_name="sales"),
        "coupons": _table("id:integer product_sku:varchar", "id", ("product_sku", "products", "sku"), schema_name="sales"),
    },
}
