"""Stand-ins for the external model."""

import json

from passbook.operators.categories import CATEGORY_RULES


def _category(item):
    if item["amount"] > 0:
        return "Income"
    upper = item["description"].upper()
    return next((c for p, c in CATEGORY_RULES if p in upper), "Uncategorized")


def rule_client():
    def call(payload: str, system: str) -> str:
        return json.dumps({"results": [{"id": i["id"], "category": _category(i)} for i in json.loads(payload)]})

    return call


def half_trained_client():
    """Adds a remark after the JSON whenever the batch has an odd number of rows."""
    good = rule_client()

    def call(payload: str, system: str) -> str:
        odd = len(json.loads(payload)) % 2
        return good(payload, system) + (" Hope this helps!" if odd else "")

    return call
