"""The rule catalogue: families in the order that breaks ties."""

from __future__ import annotations

from dataclasses import dataclass, replace

from colsmith.plans.rules import core, domains, modelling

FAMILIES = (
    core.data_quality, core.type_detection, core.statistical, core.categorical, core.formats,
    domains.special_types, domains.business_metrics, domains.composites, domains.industry, domains.everyday,
    modelling.feature_engineering, modelling.leakage, modelling.category_choices, modelling.time_series, modelling.imbalance,
    modelling.missing_data, modelling.collinearity, modelling.anomalies, modelling.selection, modelling.dimensions,
)


@dataclass(frozen=True)
class Rule:
    """A condition and a confidence over the rule statistics, both as SQL text."""

    name: str
    action: str
    priority: int
    confidence: str
    condition: str
    family: str = "user"


def name_contains(*words: str) -> str:
    """The column name contains one of the words anywhere."""
    return "(" + " OR ".join(f"contains(name, '{w}')" for w in words) + ")"


def name_has_word(*words: str) -> str:
    """One of the words stands between underscores or at an end of the column name."""
    return "(" + " OR ".join(f"contains(concat('_', name, '_'), '_{w.strip('_')}_')" for w in words) + ")"


def _default(column: str, value: float) -> str:
    return f"CASE WHEN has_range THEN {column} ELSE {value} END"


# Conditions that do not depend on how many rows a table has. ``unique_ratio`` and ``duplicate_ratio`` are
# shares of the rows, so in a long table every bounded column would count as constant or as a duplicate; the share of
# the most frequent value says what those rules are after at any length.
SCALE_FREE = {
    "LEAKAGE_NEAR_CONSTANT": "unique_count > 1 AND top_share > 0.99",
    "LEAKAGE_DUPLICATE_COLUMN": "unique_count > 1 AND top_share > 0.95 AND row_count > 50",
    "MULTICOL_PERFECT": "unique_count = 1",
    "MULTICOL_VERY_HIGH": "is_numeric AND top_share > 0.95",
    "MULTICOL_CONSTANT_GROUPBY": "unique_count < 5 AND top_share > 0.8",
}


def catalogue(whole_words: bool = False, with_optional: bool = False, scale_free: bool = False) -> list[Rule]:
    """All rules, in order of priority and then of registration.

    ``scale_free`` replaces the conditions on shares of distinct rows by ones on the top value's share.
    """
    test = name_has_word if whole_words else name_contains
    families = (*FAMILIES, domains.optional_everyday) if with_optional else FAMILIES
    rules = [Rule(*row, family=family.__name__) for family in families for row in family(test, _default)]
    if scale_free:
        rules = [replace(r, condition=SCALE_FREE.get(r.name, r.condition)) for r in rules]
    return sorted(rules, key=lambda r: -r.priority)
