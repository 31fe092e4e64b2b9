"""Lexicons, rules, weights and baselines of the risk model, in their defined order."""

TOPICS = {
    "semiconductor": (1.0, ["semiconductor", "chip", "chips", "fab", "foundry", "wafer", "ic", "microcontroller", "microprocessor", "asic", "pcb", "passive component", "electronics manufacturing", "packaging", "osat", "substrate", "silicon", "fabless", "semiconductor equipment"]),
    "supply_chain": (0.9, ["supply chain", "bill of materials", "bom", "sourcing", "procurement", "lead time", "inventory", "shortage", "backorder", "single source", "sole source", "tier-1", "tier 1 supplier", "supplier", "vendor", "allocation"]),
    "disruption": (0.85, ["shutdown", "closure", "fire", "outage", "disruption", "halt production", "suspend operations", "force majeure", "contamination", "evacuation", "production delay"]),
    "geopolitical": (0.9, ["sanction", "export control", "embargo", "tariff", "trade restriction", "export ban", "geopolitical", "military escalation", "armed conflict", "conflict", "war", "missile strike", "military exercise", "invasion", "regional instability"]),
    "labor": (0.8, ["strike", "walkout", "labor dispute", "union", "protest", "labor shortage", "wage dispute"]),
    "logistics": (0.9, ["port closure", "port shutdown", "shipping delay", "cargo", "freight", "logistics", "canal", "route blockage", "customs delay", "maritime attack", "vessel attack", "shipping lane", "strait of hormuz", "suez canal", "red sea", "container shortage"]),
    "natural_disaster": (0.9, ["earthquake", "flood", "tropical cyclone", "cyclone", "hurricane", "typhoon", "tsunami", "wildfire", "natural disaster", "volcanic eruption", "drought", "extreme weather", "landslide"]),
    "financial": (0.8, ["bankruptcy", "insolvency", "credit downgrade", "liquidity crisis", "default", "financial distress", "restructuring", "debt crisis"]),
    "cyber": (0.9, ["ransomware", "cyberattack", "cyber attack", "malware", "data breach", "supply chain attack", "operational technology", "industrial control systems", "network intrusion"]),
    "energy": (0.85, ["power outage", "blackout", "rolling blackout", "grid failure", "electricity shortage", "gas shortage", "fuel shortage", "utility disruption"]),
    "regulatory": (0.75, ["regulation", "compliance", "export license", "import restriction", "environmental regulation", "customs regulation", "certification requirement"]),
    "health": (0.75, ["epidemic", "pandemic", "quarantine", "lockdown", "travel restriction", "health emergency"]),
    "market": (0.8, ["rare earth shortage", "commodity price", "semiconductor shortage", "raw material shortage", "demand surge", "demand collapse", "supply shortage"]),
}
CORE_TOPICS = ("semiconductor", "supply_chain", "disruption")
NEGATIVE = ["football", "soccer", "basketball", "baseball", "celebrity", "movie premiere", "album release", "reality tv", "fashion week", "recipe", "horoscope", "astrology", "gaming tournament", "esports"]
CONTEXT = ["supply chain", "supplier", "manufacturer", "factory", "production", "semiconductor", "chip", "component", "sourcing", "procurement", "disruption", "shortage", "backorder", "lead time"]
PROVIDERS = {"gdacs": (1, 1.0, 0.0), "gdelt": (1, 1.0, 0.40), "marketaux": (2, 0.85, 0.35), "gnews": (3, 0.65, 0.45), "newsdata": (3, 0.65, 0.45)}  # tier, weight, least relevance
AUTO_PASS = "gdacs"
SIGNAL_CODES = ["IN02", "IN03", "IN04", "EX01", "EX02"]

RULES = [
    ("natural_disaster", "earthquake", ["earthquake", "seismic", "magnitude"], 0.88),
    ("natural_disaster", "flood", ["flood", "flooding", "inundation"], 0.86),
    ("natural_disaster", "tropical_cyclone", ["cyclone", "hurricane", "typhoon"], 0.86),
    ("factory_shutdown", "plant_fire", ["factory fire", "plant fire", "fab fire"], 0.84),
    ("factory_shutdown", "power_outage", ["power outage", "blackout", "grid failure"], 0.82),
    ("factory_shutdown", "announced_closure", ["shutdown", "halt production", "suspend operations"], 0.8),
    ("export_sanction", "export_control", ["export control", "export ban", "trade restriction"], 0.85),
    ("export_sanction", "embargo", ["embargo", "sanction", "tariff"], 0.83),
    ("labor_action", "strike", ["strike", "walkout", "labor dispute"], 0.82),
    ("labor_action", "protest", ["protest", "demonstration"], 0.75),
    ("logistics_disruption", "port_closure", ["port closure", "port shutdown", "canal"], 0.84),
    ("logistics_disruption", "shipping_lane_disruption", ["strait of hormuz", "suez canal", "red sea", "shipping lane", "chokepoint"], 0.86),
    ("logistics_disruption", "route_blockage", ["route blockage", "shipping delay", "cargo"], 0.78),
    ("financial_distress", "bankruptcy", ["bankruptcy", "insolvency", "chapter 11"], 0.86),
    ("financial_distress", "credit_downgrade", ["credit downgrade", "liquidity crisis", "default"], 0.84),
    ("geopolitical_event", "armed_conflict", ["armed conflict", "military escalation", "invasion", "war"], 0.86),
    ("geopolitical_event", "regional_crisis", ["regional crisis", "political instability", "civil unrest"], 0.82),
    ("cyber_incident", "ransomware", ["ransomware", "cyberattack", "cyber attack", "data breach"], 0.84),
    ("energy_disruption", "grid_failure", ["grid failure", "rolling blackout", "fuel shortage"], 0.82),
    ("regulatory_change", "export_license", ["export license", "compliance requirement", "import restriction"], 0.78),
    ("public_health_event", "quarantine", ["quarantine", "pandemic", "epidemic", "lockdown"], 0.80),
    ("market_disruption", "semiconductor_shortage", ["semiconductor shortage", "raw material shortage", "commodity price shock"], 0.82),
]
GDACS = {"EQ": ("natural_disaster", "earthquake", 0.92), "FL": ("natural_disaster", "flood", 0.92), "TC": ("natural_disaster", "tropical_cyclone", 0.92), "VO": ("natural_disaster", "other_natural_disaster", 0.85), "DR": ("natural_disaster", "other_natural_disaster", 0.85), "WF": ("natural_disaster", "wildfire", 0.88)}
SIGNALS = ["shutdown", "closure", "strike", "disruption", "shortage", "sanction", "embargo", "fire", "outage", "bankruptcy", "delay", "blockade", "attack", "flood", "earthquake", "hurricane", "typhoon", "cyclone", "war", "conflict", "halt", "halted", "paused", "pause production", "production halt"]
QUIET_CATEGORIES = ["CORPORATE", "CO04", "TECHNOLOGY DEVELOPMENT MILESTONE"]
ALERT_LEVELS = {"green": 35.0, "orange": 65.0, "red": 85.0}
INTENSITY = {"critical": 0.90, "major": 0.85, "indefinite": 0.85, "nationwide": 0.80, "widespread": 0.80, "complete": 0.80, "partial": 0.50, "minor": 0.40}
URGENT = ["today", "now", "just", "breaking", "emergency", "alert", "reports", "confirmed", "announced", "revealed", "found", "happening", "ongoing", "in progress"]
LOCATIONS = {"strait of hormuz": 0.95, "suez canal": 0.95, "panama canal": 0.90, "south china sea": 0.85, "port of shanghai": 0.85, "port of singapore": 0.85, "red sea": 0.80, "taiwan": 0.90, "china": 0.85, "south korea": 0.80, "japan": 0.80, "vietnam": 0.75, "mexico": 0.75}
REGIONS = ["Europe", "Asia-Pacific", "Middle-East", "Africa", "Latin-America", "North-America"]
MARKET = {"export_sanction": 75.0, "logistics_disruption": 70.0, "factory_shutdown": 65.0, "natural_disaster": 60.0, "geopolitical_event": 70.0, "market_disruption": 80.0}
WEIGHTS = {"base_rule_score": 0.40, "supplier_criticality": 0.15, "source_reliability": 0.10, "entity_impact": 0.10, "geographic_importance": 0.10, "market_sensitivity": 0.10, "multi_source_confirmation": 0.05}
STOP_WORDS = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "is", "by"]
#: Priors of supply delay, manufacturing, logistics, inventory and price, and the recovery days.
BASELINES = {
    "natural_disaster": (0.55, 0.50, 0.65, 0.40, 0.30, 14, 120),
    "factory_shutdown": (0.70, 0.80, 0.35, 0.55, 0.45, 21, 90),
    "export_sanction": (0.65, 0.55, 0.50, 0.50, 0.60, 30, 180),
    "labor_action": (0.60, 0.45, 0.55, 0.35, 0.25, 14, 60),
    "logistics_disruption": (0.75, 0.30, 0.85, 0.40, 0.35, 7, 60),
    "financial_distress": (0.45, 0.40, 0.25, 0.35, 0.30, 30, 120),
    "geopolitical_event": (0.60, 0.45, 0.70, 0.45, 0.50, 21, 120),
    "cyber_incident": (0.50, 0.55, 0.40, 0.30, 0.20, 7, 45),
    "energy_disruption": (0.55, 0.60, 0.50, 0.40, 0.55, 14, 90),
    "regulatory_change": (0.40, 0.35, 0.30, 0.30, 0.35, 30, 180),
    "public_health_event": (0.50, 0.55, 0.45, 0.35, 0.25, 21, 120),
    "market_disruption": (0.45, 0.35, 0.35, 0.30, 0.50, 14, 90),
    "other": (0.30, 0.25, 0.25, 0.20, 0.15, 7, 30),
}
DEFAULT_BASELINE = (0.35, 0.30, 0.30, 0.25, 0.20, 7, 45)
DEFAULT_LEAD_TIME = 21
#: Alert rules: id, name, least severity, least source count, least verification, categories.
ALERTS = [
    ("high_severity_any", "High severity event", 70.0, None, None, None),
    ("natural_disaster_red", "GDACS red alert natural disaster", 80.0, None, None, "natural_disaster"),
    ("logistics_critical_location", "Logistics disruption at strategic location", 65.0, None, None, "logistics_disruption"),
    ("multi_source_confirmed", "Multi-source verified event", None, 2, 0.6, None),
    ("export_sanction_high", "Export sanction or trade restriction", 60.0, None, None, "export_sanction"),
]

# Fixed value: a token of an upper-case text that may be a part number.
PART_NUMBER = r"\b[A-Z0-9]{3,}[A-Z0-9\-/_]{2,}\b"
