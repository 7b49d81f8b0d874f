"""Policy and rule specifications that parameterise every job."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class TripRules:
    """Thresholds of the trip validity rules."""

    max_trip_hours: float = 8
    min_trip_miles: float = 0.01
    max_trip_miles: float = 200
    min_fare_amount: float = 0
    max_total_amount: float = 1000


@dataclass(frozen=True)
class PolicySpec:
    """When a policy starts, which zones it touches and how wide the event window is."""

    name: str
    start_date: date
    zone_groups: dict[str, tuple[str, ...]]
    airport_zone_names: tuple[str, ...]
    # (text contained in a zone name, airport label), first match wins
    airport_labels: tuple[tuple[str, str], ...] = ()
    weeks_before: int = 8
    weeks_after: int = 12
    rules: TripRules = field(default_factory=TripRules)

    @property
    def start_iso(self) -> str:
        return self.start_date.isoformat()


# The congestion-pricing study area of New York City.
NYC_CONGESTION_PRICING = PolicySpec(
    name="NYC Congestion Pricing",
    start_date=date(2025, 1, 5),
    zone_groups={
        "treated_zones": (
            "Midtown Center", "Times Sq/Theatre District", "Penn Station/Madison Sq West",
            "Union Sq", "Financial District North", "Financial District South",
            "West Chelsea/Hudson Yards", "Greenwich Village North", "Greenwich Village South",
            "East Chelsea", "Gramercy", "Flatiron", "Murray Hill", "Kips Bay", "SoHo",
            "TriBeCa/Civic Center", "Chinatown", "Lower East Side",
        ),
        "spillover_zones": (
            "Upper East Side South", "Upper West Side South", "East Harlem South",
            "Morningside Heights", "Williamsburg (North Side)", "Williamsburg (South Side)",
            "Long Island City/Queens Plaza", "Astoria",
        ),
        "control_zones": (
            "Forest Hills", "Bay Ridge", "Flushing", "Bensonhurst West", "Sunnyside",
            "Jackson Heights",
        ),
    },
    airport_zone_names=("Newark Airport", "JFK Airport", "LaGuardia Airport"),
    airport_labels=(
        ("JFK", "JFK Airport"), ("LaGuardia", "LaGuardia Airport"), ("Newark", "Newark Airport"),
    ),
)


def load_spec(path: str, base: PolicySpec = NYC_CONGESTION_PRICING) -> PolicySpec:
    """Read a policy file (YAML when PyYAML is present, else JSON) on the driver.

    The file holds a few dozen names; they become literals of the plan.
    """
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    policy = raw["policy"]
    start = policy["start_date"]
    return PolicySpec(
        name=policy.get("name", base.name),
        start_date=start if isinstance(start, date) else date.fromisoformat(str(start)),
        zone_groups={group: tuple(names) for group, names in raw["zone_groups"].items()},
        airport_zone_names=tuple(raw.get("airport_zone_names", ())),
        airport_labels=base.airport_labels,
        weeks_before=policy.get("event_window_weeks_before", base.weeks_before),
        weeks_after=policy.get("event_window_weeks_after", base.weeks_after),
        rules=TripRules(**raw.get("quality_rules", {})),
    )
