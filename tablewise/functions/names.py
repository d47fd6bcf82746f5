"""Rules over column and table names. Patterns are valid in both Python and Java syntax."""

from __future__ import annotations

import re

# Name patterns whose matches decide roles, so they must not drift.
ID_SNAKE = r"(?i)(^|[_\s\-])(id|key|code|no|num|number)$"
ID_CAMEL = r"[a-z0-9](ID|Id|Key|Code|No|Num|Number)$"
INTEGER_LABEL = (
    r"(?i)(year|month|quarter|week|day|hour|zip|postal|postcode|phone|rank|level|rating|"
    r"line|seq|sequence|index|position|sort)"
)
NON_ADDITIVE = r"(?i)(price|rate|pct|percent|ratio|avg|average|margin|score|per_?unit)"
SEQUENCE = r"(?i)(line|seq|sequence|position|item_?no|row_?no)"
REVENUE = [r"^revenue$|net_?revenue", r"revenue", r"^sales$|sales_?amount|net_?sales", r"amount"]
COST = [r"cost|cogs|expense"]
PROFIT = [r"profit"]
QUANTITY = [r"qty|quantity|units"]
ORDER = [r"order|invoice|transaction|receipt"]
ORDER_DATE = [r"order", r"date"]
SUFFIX_SNAKE = r"(?i)[_\s\-]*(id|key|code|no|num|number)$"
SUFFIX_CAMEL = r"(?<=[a-z0-9])(ID|Id|Key|Code|No|Num|Number)$"


def is_id_like(name: str) -> bool:
    text = name.strip()
    return any(re.search(p, text) for p in (ID_SNAKE, ID_CAMEL))


def pick(names: list[str], patterns: list[str], taken: set[str] = frozenset()) -> str | None:
    """First name matching the earliest pattern; names compare lower-cased, blanks as ``_``."""
    free = [(n, re.sub(r"[\s\-]+", "_", n.strip().lower())) for n in names if n not in taken]
    hits = (n for p in patterns for n, key in free if re.search(p, key))
    return next(hits, None)


def pascal(text: str) -> str:
    joined = "".join(w[:1].upper() + w[1:] for w in re.findall("[A-Za-z0-9]+", text))
    if joined[:1].isdigit():
        return "T" + joined
    return joined or "Table"


def entity_name(key: str) -> str:
    """``CustomerID`` and ``customer_id`` both name the entity ``Customer``."""
    text = key.strip()
    for suffix in (SUFFIX_CAMEL, SUFFIX_SNAKE):
        stem = re.sub(suffix, "", text)
        if stem != text:
            return pascal(stem or key)
    return pascal(text or key)


def fact_name(dataset: str) -> str:
    return "Fact" + pascal(dataset)


def unique_name(name: str, taken: set[str]) -> str:
    """``name``, or ``name2``, ``name3`` ... ; ``taken`` holds lower-cased names and grows."""
    n, result = 1, name
    while result.lower() in taken:
        n += 1
        result = f"{name}{n}"
    taken.add(result.lower())
    return result
