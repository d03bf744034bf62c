"""Preset row-variable lists of the standard cross-table reports."""
from __future__ import annotations

# Report presets and the party column each party type adds.
PARTY = {0: [], 1: ["supporting_partyr"], 2: ["supporting_partyrr"]}
DEMOGRAPHICS = ["gender", "agegp", "edugp"]


def crosstab_variables(customer: str, party_type: int) -> list[str]:
    party = PARTY[party_type]
    if customer == "general":
        return [*DEMOGRAPHICS, "supporting_party", *party, "area", "date"]
    if customer == "county_mode":
        return [*DEMOGRAPHICS, "edugpr", "area", "supporting_party", *party]
    if customer == "TPOF":
        return [*DEMOGRAPHICS, "area", "supporting_party"]
    if customer == "TPOF2":
        return [*DEMOGRAPHICS, "supporting_party"]
    raise ValueError(f"unknown report preset {customer!r}")


def rolling_variables(party_type: int) -> list[str]:
    return ["gender", "agegp2", "edugp", "edugpr", "area", "arear", "supporting_party",
            *PARTY[party_type]]
