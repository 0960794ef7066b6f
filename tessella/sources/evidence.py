"""Evidence of the single sources: landed payloads to (source, signal_id, ts, value, direction, confidence, category, tags, ttl).

A landing row has `source`, `fetched_at` (epoch seconds) and `data` (JSON text). A `Rule` says in SQL expressions how a
payload `p`, or each record `r` of one of its lists or objects, becomes one evidence row. All rules of a source are
compiled to one expression over a VARIANT, so a payload is parsed once and gives its rows by one `inline`: no shuffle,
no Python, and the filter on `source` reaches a landing table that is partitioned by it.

Defined results: a payload that isn't JSON gives no rows; a record that isn't an object, lacks the rule's value, or
holds it as JSON null gives none, and leaves the other records and rules alone; a value that is present but isn't a
number counts as 0; a table without rows, or sources without rules, give none. `ts` is fetched_at, the time of the
event, so nothing looks ahead of it. Extra columns of the landing table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "source string, signal_id string, ts double, value double, direction int, confidence double, category string, tags array<string>, ttl long"


@dataclass(frozen=True)
class Rule:
    """signal and tags may name `names`' expressions in braces. value: null gives no row. up and down: conditions on v, the
    value, for direction 1 and -1. each: the array that r runs over; without it the rule gives one row a payload."""

    signal: str
    value: str
    category: str
    confidence: str
    ttl: int
    tags: str
    up: str = "false"
    down: str = "false"
    where: str = "true"
    each: str = ""
    names: dict[str, str] = field(default_factory=dict)


def at(path: str, kind: str, of: str = "p") -> str:
    return f"try_variant_get({of}, '$.{path}', '{kind}')" if path else f"try_variant_get({of}, '$', '{kind}')"


def text(path: str, of: str = "p") -> str:
    return at(path, "string", of)


def has(path: str, of: str = "p") -> str:
    """Present and not null."""
    return f"({text(path, of)} is not null)"


def number(path: str, of: str = "p") -> str:
    """0 if absent or not a number."""
    return f"coalesce({at(path, 'double', of)}, 0D)"


def whole(path: str, of: str = "p") -> str:
    return f"coalesce({at(path, 'bigint', of)}, 0L)"


def given(path: str, of: str = "p") -> str:
    """Null if absent, 0 if not a number."""
    return f"if({has(path, of)}, {number(path, of)}, null)"


def either(first: str, second: str, of: str = "p") -> str:
    """The second where the first is absent or 0."""
    return f"coalesce(nullif({given(first, of)}, 0D), {given(second, of)})"


def true(path: str, of: str = "p") -> str:
    return f"(coalesce({text(path, of)}, '') not in ('', 'false', '0', '0.0', '[]', '{{}}'))"


def items(path: str, of: str = "p") -> str:
    return at(path, "array<variant>", of)


def members(path: str, of: str = "p") -> str:
    """An object's members as entries of key and value."""
    return f"map_entries({at(path, 'map<string,variant>', of)})"


def is_object(path: str, of: str = "p") -> str:
    return f"({at(path, 'map<string,variant>', of)} is not null)"


def size(path: str, of: str = "p") -> str:
    """Null if it isn't a list."""
    return f"array_size({items(path, of)})"


def count(path: str, condition: str) -> str:
    """Records y of a list under a condition; null if it isn't a list."""
    return f"array_size(filter({items(path)}, y -> {condition}))"


def total(path: str, expression: str) -> str:
    return f"aggregate({items(path)}, 0D, (a, y) -> a + {expression})"


def numbers(path: str, key: str) -> str:
    """The numbers under a key of a list's records that have it."""
    return f"filter(transform({items(path)}, y -> {given(key, 'y')}), z -> z is not null)"


def mean(array: str) -> str:
    return f"(aggregate({array}, 0D, (a, z) -> a + z) / nullif(array_size({array}), 0))"


def last(path: str, back: int = 1) -> str:
    return f"try_element_at({items(path)}, -{back})"


def slug(expression: str, length: int = 30) -> str:
    return f"left(replace(lower({expression}), ' ', '_'), {length})"


def named(path: str, otherwise: str = "unknown", of: str = "p") -> str:
    return f"coalesce({text(path, of)}, '{otherwise}')"


def mode(name: str) -> str:
    return f"{text('mode')} <=> '{name}'"


LIST = "{} is not null"
DAY, WEEK, MONTH = 86_400, 604_800, 2_592_000
PRESENT, SIGN_UP, SIGN_DOWN = "true", "v > 0", "v < 0"

# Fixed values below: the signals' names, thresholds, confidences, categories, tags and lifetimes in seconds.

JOBS = {  # series: suffix, whether a rise is relief, confidence, category
    "JTSJOL": ("openings", True, 0.75, "behavioral_intent"),
    "JTSQUL": ("quits", True, 0.7, "behavioral_intent"),
    "JTSHIL": ("hires", True, 0.7, "behavioral_intent"),
    "JTSLDR": ("layoffs", False, 0.75, "macro_momentum"),
    "UNRATE": ("unemployment_rate", False, 0.8, "macro_momentum"),
    "ICSA": ("initial_claims", False, 0.8, "macro_momentum"),
    "PAYEMS": ("payrolls", True, 0.75, "macro_momentum"),
}
HEALTH = {"water_or_barren": 0.0, "bare_soil": 1.0, "sparse": 2.0, "moderate": 3.0, "healthy": 4.0, "dense": 5.0}
FOOD = {  # part of the indicator's code: suffix
    "prd.food": "production.food",
    "prd.crop": "production.crop",
    "prd.lvsk": "production.livestock",
    "yld.crel": "cereal_yield",
    "lnd.crel": "cereal_area",
    "tm.val.food": "food_import_pct",
    "tx.val.food": "food_export_pct",
}
RENEWABLE = ("wind", "solar", "hydro", "other renewables")
DEFENCE = ("defense", "defence", "dod", "mod", "military", "army", "navy", "air force", "pentagon", "armed forces")
ACTIVE_TRIALS = ("Recruiting", "Active, not recruiting", "Not yet recruiting", "Enrolling by invitation")


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def cases(of: str, table: dict, otherwise: str, test: str = "{0} = {1}") -> str:
    arms = " ".join(f"when {test.format(of, repr(k))} then {v!r}" for k, v in table.items())
    return f"case {arms} else {otherwise} end"


def job(series: str) -> Rule:
    suffix, relief, confidence, category = JOBS[series]
    trend = text(f"summary.{series}.trend")
    up, down = ("falling", "rising") if relief else ("rising", "falling")
    return Rule(f"jobs.us.{suffix}", given(f"summary.{series}.latest_value"), category, str(confidence), MONTH, f"labor,us,{suffix}", f"{trend} = '{up}'", f"{trend} = '{down}'")


def grid_mode(name: str) -> str:
    inferred = {"total_peak_mw": "demand", "fuels": "fuel_mix", "stressed_zones": "pricing", "persistent_deviation_zones": "forecast"}
    return f"coalesce(nullif({text('mode')}, ''), case {' '.join(f'when {has(k)} then {m!r}' for k, m in inferred.items())} end) <=> '{name}'"


def defi_mode(name: str) -> str:
    keys = {"tvl": ("protocols", "total_tvl"), "stablecoins": ("stablecoins",), "dex_volume": ("dexes",), "chain": ("chains", "grand_total_tvl")}
    arms = " ".join(f"when {' and '.join(has(k) for k in ks)} then '{m}'" for m, ks in keys.items())
    return f"coalesce(nullif({text('mode')}, ''), case {arms} end) <=> '{name}'"


def top_share(records: str, key: str, whole_: str) -> str:
    first = f"try_element_at({items(records)}, 1)"
    return f"if({is_object('', first)} and {number(whole_)} > 0, round({number(key, first)} / {number(whole_)} * 100, 2), null)"


def strike(part: str) -> tuple[str, str, str]:
    """Value and directions of a strike series: flat under its label, or nested under its name."""
    at_ = lambda k: f"case when {text('label')} <=> '{part}' then {text('signals.' + k)} when not {has('label')} then {text(f'signals.{part}.{k}')} end"
    present, trend = at_("latest_value"), at_("trend")
    value = f"if({present} is not null, coalesce(try_cast({present} as double), 0D), null)"
    return value, f"{trend} in ('ESCALATING', 'RISING', 'NEW_ACTIVITY')", f"{trend} = 'DECLINING'"


V = "r.value"
ARTICLE = {"slug": slug(text("article", "r"), 40)}
SPREAD_MEAN, SPREAD_STD = number("stats.mean"), number("stats.std")
VIEWS_Z = f"if({SPREAD_MEAN} > 0 and {SPREAD_STD} > 1e-10, ({number('stats.max')} - {SPREAD_MEAN}) / {SPREAD_STD}, null)"
QUAKES = f"{size('quakes')} > 0"
MAGNITUDE = f"array_max(array_append(transform({items('quakes')}, y -> {number('magnitude', 'y')}), 0D))"
ZONE = {"zone": slug(named("zone.name")), "sector": named("zone.sector", "")}
YEARS = f"array_sort(map_keys({at('yearly_counts', 'map<string,variant>')}))"
PATENT = {"cpc": named("cpc_class")}
OUTPUT = [f"coalesce({number('', f'try_element_at({at("yearly_counts", "map<string,variant>")}, try_element_at({YEARS}, -{i}))')}, 0D)" for i in (1, 2)]
FLOW_SLUG = f"if({true('reporter')}, {slug(f"{named('reporter', '')} || '_' || {named('partner', '')}")}, 'global')"
MARKET = {"slug": f"left(lower(replace(replace(coalesce(nullif({text('slug', 'r')}, ''), {text('question', 'r')}), ' ', '_'), '-', '_')), 40)"}
TRADED = f"{MARKET['slug']} <> '' and {number('yes_price', 'r')} > 0 and {number('volume_24h', 'r')} >= 1000"
STRESSED = "v < 0"
FOOD_RECORDS = f"filter({items('records')}, y -> {has('value', 'y')})"
INDICATOR = f"lower({named('indicator', '')})"
FOOD_NAMES = {"country": f"lower({named('country')})", "suffix": cases(INDICATOR, FOOD, f"left(replace({INDICATOR}, '.', '_'), 30)", "contains({0}, {1})")}
RISK = f"{size('records')} > 0 and {text('result_type')} <=> "
CASH = f"({number('signals.support_total')} + {number('signals.oppose_total')})"
FUEL = "lower(coalesce(" + text("fuel_type", "y") + ", ''))"
SHARE = f"if({number('total_mw')} > 0, {{}} / {number('total_mw')} * 100, null)"
GAS = SHARE.format(total("fuels", f"if(contains({FUEL}, 'gas'), {number('mw', 'y')}, 0D)"))
RENEWED = SHARE.format(total("fuels", f"if({FUEL} in ({listed(RENEWABLE)}), {number('mw', 'y')}, 0D)"))
REGION = {"region": f"lower({named('region', 'us')})"}
AWARDED = f"{size('awards')} > 0"
AGENCY = f"lower(concat(coalesce({text('agency', 'y')}, ''), ' ', coalesce({text('description', 'y')}, '')))"
TRIAL = text("status", "y")
SPONSORED = count("trials", has("sponsor_class", "y"))
COUNTRIES = f"transform({{}}, y -> coalesce({text('country', 'y')}, '??'))"
CRITICAL = f"array_size(array_distinct({COUNTRIES.format(f"filter({items('alerts')}, y -> {text('level', 'y')} = 'critical')")}))"
EVENTS = f"filter({items('events')}, y -> {is_object('', 'y')})"
SEVERITY = text("severity")
DOMAIN = {"slug": f"left(replace({named('domain')}, '.', '_'), 30)"}
TICKER = {"slug": f"lower({named('ticker')})"}
LATEST_ROW = {"slug": "left(replace(replace(lower(r.key), '^', ''), '=', ''), 20)"}
CLOSE = [f"try_variant_get(try_element_at(try_variant_get(r.value, '$', 'array<variant>'), -{i}), '$.Close', 'double')" for i in (1, 2)]

RULES: dict[str, list[Rule]] = {
    "cftc": [
        Rule("cftc.{slug}.mm_net_pct_oi", given("_mm_net_pct_oi", "r"), "positioning", "0.85", WEEK, "commodity,{slug}", SIGN_UP, SIGN_DOWN, each=items("contracts"), names={"slug": f"if({true('Market_and_Exchange_Names', 'r')}, {slug(f"trim(split_part({text('Market_and_Exchange_Names', 'r')}, '-', 1))")}, 'unknown')"}),
    ],
    "weather_alerts": [
        Rule("weather.us.alert_count", given("alert_count"), "physical_disruption", "0.7", 43_200, "weather,us", SIGN_UP),
        Rule("weather.global.fire_count_infra", either("fire_count_infra", "count"), "physical_disruption", "0.6", 43_200, "fire,infrastructure", SIGN_UP, where=f"not {has('fires')}"),
        Rule("weather.us.severe_alert_count", count("alerts", f"{text('severity', 'y')} in ('Extreme', 'Severe')"), "physical_disruption", "0.75", 43_200, "weather,us,severe", SIGN_UP, where=f"{size('alerts')} > 0"),
        Rule("weather.us.market_relevant_alerts", count("alerts", true("market_relevant", "y")), "physical_disruption", "0.8", 43_200, "weather,us,market_relevant", PRESENT, where=f"{count('alerts', true('market_relevant', 'y'))} > 0"),
        Rule("weather.global.infra_fire_zones", f"coalesce({size('zones_affected')}, 0)", "physical_disruption", "0.65", 43_200, "fire,infrastructure", SIGN_UP, where=f"{size('fires')} > 0"),
    ],
    "sanctions_monitor": [
        Rule("sanctions.global.recent_additions", number("count"), "regulatory_action", "0.9", DAY, "sanctions,ofac,un", SIGN_UP, where=f"{has('days_back')} and {size('results')} is not null"),
        Rule("sanctions.global.program_count", size("programs"), "regulatory_action", "0.85", DAY, "sanctions,programs", where=f"{size('programs')} > 0 and not {has('days_back')}"),
        Rule("sanctions.global.total_entries", total("programs", whole("count", "y")), "regulatory_action", "0.85", DAY, "sanctions", where=f"{size('programs')} > 0 and not {has('days_back')}"),
    ],
    "ais_vessel_tracking": [
        Rule("ais.{slug}.vessel_count", given("total_vessels"), "physical_flow", "0.7", DAY, "shipping,{slug}", names={"slug": slug(named("area"))}),
        Rule("ais.{slug}.tanker_ratio", f"{number('type_counts.tanker')} / nullif({number('total_vessels')}, 0D)", "physical_flow", "0.65", DAY, "shipping,{slug},tanker", where=f"{is_object('type_counts')} and {number('total_vessels')} > 0", names={"slug": slug(named("area"))}),
        Rule("ais.destination.{place}", number("", V), "physical_flow", "0.6", DAY, "shipping,destination,{place}", each=members("strategic"), names={"place": "r.key"}),
    ],
    "finra_short_volume": [
        Rule("finra.{slug}.short_ratio", given("signals.latest_ratio"), "positioning", f"if({true('signals.is_anomaly')}, 0.8, 0.6)", DAY, "short_volume,{slug}", "v > 0.5", "true", f"{named('ticker')} <> 'unknown'", names=TICKER),
        Rule("finra.market.avg_short_ratio", f"{total('results', number('short_ratio', 'y'))} / greatest({size('results')}, 1)", "positioning", "0.7", DAY, "short_volume,market_wide", "v > 0.5", "true", f"not {has('ticker')} and {whole('total_tickers')} > 0"),
        Rule("finra.{slug}.days_to_cover", number("signals.days_to_cover"), "positioning", "0.75", 14 * DAY, "short_interest,{slug}", "v > 5", where=f"map_contains_key({at('signals', 'map<string,variant>')}, 'squeeze_risk')", names=TICKER),
    ],
    "disease_surveillance": [
        Rule("disease.{slug}.detection_rate", f"{total('summaries', whole('detections', 'y'))} / nullif({whole('total_samples')}, 0)", "biological", "0.8", WEEK, "wastewater,{slug}", "v > 0.3", where=f"{whole('total_samples')} > 0 and {named('pathogen')} <> ''", names={"slug": slug(f"replace({named('pathogen')}, '-', '_')")}),
        Rule("disease.{slug}.hot_states", whole("hot_states"), "biological", "0.75", WEEK, "wastewater,{slug},geographic_spread", "v > 5", where=f"{size('summaries')} is not null and {named('pathogen')} <> ''", names={"slug": slug(f"replace({named('pathogen')}, '-', '_')")}),
        Rule("disease.who.outbreak_count", size("entries"), "biological", "0.7", WEEK, "who,outbreaks", "v > 3"),
    ],
    "earthquake_proximity": [
        Rule("earthquake.{zone}.count", size("quakes"), "physical_disruption", "0.9", DAY, "earthquake,{zone},{sector}", f"{MAGNITUDE} >= 4", where=f"{QUAKES} and {is_object('zone')}", names=ZONE),
        Rule("earthquake.{zone}.max_magnitude", MAGNITUDE, "physical_disruption", "0.95", DAY, "earthquake,{zone}", "v >= 5", where=f"{QUAKES} and {is_object('zone')}", names=ZONE),
        Rule("earthquake.global.count", size("quakes"), "physical_disruption", "0.9", DAY, "earthquake,global", "v > 5", where=f"{QUAKES} and not {is_object('zone')}"),
        Rule("earthquake.global.max_magnitude", MAGNITUDE, "physical_disruption", "0.95", DAY, "earthquake", "v >= 6", where=f"{QUAKES} and not {is_object('zone')}"),
        Rule("earthquake.global.near_infrastructure", whole("near_infrastructure"), "physical_disruption", "0.9", DAY, "earthquake,infrastructure", PRESENT, where=f"{QUAKES} and not {is_object('zone')} and {whole('near_infrastructure')} > 0"),
    ],
    "global_pmi": [
        Rule("pmi.{slug}.{mode}", given("latest_value", V), "macro_momentum", "0.8", MONTH, "{mode},{slug},{regime}", "v > 100", "v < 100", "not startswith(r.key, '_')", members("signals"), {"slug": "lower(r.key)", "mode": named("mode", "cli"), "regime": named("regime", "", V)}),
        Rule("pmi.{slug}.{mode}.mom", f"nullif({number('mom_change', V)}, 0D)", "macro_momentum", "0.75", MONTH, "{mode},{slug},momentum", SIGN_UP, SIGN_DOWN, f"not startswith(r.key, '_') and {has('latest_value', V)}", members("signals"), {"slug": "lower(r.key)", "mode": named("mode", "cli")}),
    ],
    "treasury_receipts": [
        Rule("treasury.tga.daily_change_pct", given("signals.tga_daily_change_pct"), "macro_momentum", "0.85", DAY, "treasury,tga,liquidity", SIGN_DOWN, SIGN_UP),
        Rule("treasury.us.net_flow_today", given("signals.net_flow_today"), "macro_momentum", "0.8", DAY, "treasury,flow", SIGN_UP, SIGN_DOWN),
        Rule("treasury.us.deposits_today", given("signals.total_deposits_today"), "macro_momentum", "0.8", DAY, "treasury,deposits"),
    ],
    "job_postings": [job(s) for s in JOBS],
    "transport_throughput": [
        Rule("transport.us.border_total", total("records", number("total", "y")), "physical_flow", "0.7", WEEK, "transport,border,us", where=f"{size('records')} > 0"),
        Rule("transport.us.canada_mexico_ratio", number("ratio", last("comparison")), "physical_flow", "0.6", WEEK, "transport,border,ratio", where=f"{number('ratio', last('comparison'))} > 0"),
        Rule("transport.us.volume_change", f"({number('total', last('series'))} - {number('total', last('series', 2))}) / nullif({number('total', last('series', 2))}, 0D)", "physical_flow", "0.65", WEEK, "transport,momentum", "v > 0.05", "v < -0.05", f"{size('series')} >= 2 and {number('total', last('series', 2))} > 0"),
    ],
    "capital_flows": [
        Rule("capital_flows.ust.coordinated_selling", f"coalesce({size('coordination.sellers')}, 0)", "monetary_policy", "0.85", MONTH, "treasury,holdings,selling", PRESENT, where=true("coordination.coordinated_selling")),
        Rule("capital_flows.ust.coordinated_buying", f"coalesce({size('coordination.buyers')}, 0)", "monetary_policy", "0.85", MONTH, "treasury,holdings,buying", down=PRESENT, where=true("coordination.coordinated_buying")),
        Rule("capital_flows.{slug}.holdings_mom_pct", given("mom_change_pct", "r"), "monetary_policy", "0.7", MONTH, "treasury,holdings,{slug}", "v < -3", "v > 3", true("country", "r"), items("holdings"), {"slug": slug(text("country", "r"), 20)}),
        Rule("capital_flows.{key}.reversal", number("latest_value", "r"), "monetary_policy", "0.8", MONTH, "capital_flows,reversal", PRESENT, where=true("flow_reversal", "r"), each=items("flows"), names={"key": named("key", of="r")}),
        Rule("capital_flows.reserves.stress_count", size("stress_alerts"), "monetary_policy", "0.85", MONTH, "reserves,stress", PRESENT, where=f"{size('stress_alerts')} > 0"),
    ],
    "sovereign_debt": [
        *[Rule(f"sovereign.us.{c}", given(c, last("records")), "financial_stress", "0.9", DAY, "yields,us,curve", SIGN_DOWN, "true") for c in ("curve_2s10s", "curve_3m10y")],
        Rule("sovereign.{slug}.spread_vs_de", given("spread_vs_de", "r"), "financial_stress", "0.8", DAY, "spreads,{slug},eu", "v > 200", where=true("country", "r"), each=items("spreads"), names={"slug": slug(text("country", "r"), 20)}),
        *[Rule(f"sovereign.us.{c}", given(f"us_curve.{c}"), "financial_stress", "0.9", DAY, "yields,us,curve", SIGN_DOWN, "true") for c in ("curve_2s10s", "curve_3m10y")],
    ],
    "creditor_filings": [
        Rule("creditor.sec.filing_count", given("sec_count"), "financial_stress", "0.7", DAY, "creditor,sec", "v > 5"),
        Rule("creditor.uk.red_flags", either("red_flags", "ch_red_flags"), "financial_stress", "0.75", DAY, "creditor,uk,red_flag", SIGN_UP),
        Rule("creditor.sec.cluster_count", size("clusters"), "financial_stress", "0.8", DAY, "creditor,stress_scan", "v > 3", where=f"{size('clusters')} > 0"),
    ],
    "bankruptcy_court": [
        Rule("bankruptcy.{mode}.filing_count", given("count"), "financial_stress", "0.75", DAY, "bankruptcy,{mode}", "v > 10", names={"mode": f"coalesce(nullif({text('mode')}, ''), 'us')"}),
        Rule("bankruptcy.us.chapter_11", f"coalesce(nullif({whole('chapter_breakdown.11')}, 0L), {whole('chapter_breakdown.Chapter 11')})", "financial_stress", "0.8", DAY, "bankruptcy,chapter_11,corporate", PRESENT, where=f"coalesce(nullif({whole('chapter_breakdown.11')}, 0L), {whole('chapter_breakdown.Chapter 11')}) > 0"),
        Rule("bankruptcy.sec.enforcement_count", number("count"), "financial_stress", "0.8", DAY, "sec,enforcement", "v > 3", where=f"{is_object('type_breakdown')} and {mode('sec_enforcement')}"),
    ],
    "liquidity_regime": [
        Rule("liquidity.us.regime", whole("current_state"), "financial_stress", "0.85", WEEK, "liquidity,regime,{regime}", f"{text('current_regime')} = 'contraction'", f"{text('current_regime')} = 'expansion'", has("current_regime"), names={"regime": text("current_regime")}),
        Rule("liquidity.us.composite_zscore", given("composite_zscore"), "financial_stress", "0.85", WEEK, "liquidity,zscore", "v < -1.5", "v > 1.5"),
        Rule("liquidity.us.changepoint_count", given("n_changepoints"), "financial_stress", "0.7", WEEK, "liquidity,changepoint"),
    ],
    "central_bank_balance": [
        Rule("cb.{code}.balance_wow_pct", given("wow_pct", "r"), "monetary_policy", "0.8", WEEK, "central_bank,{code},balance_sheet", "v < -0.5", "v > 0.5", each=items("banks"), names={"code": f"lower({named('code', of='r')})"}),
        Rule("cb.us.net_liquidity_usd", given("net_usd"), "monetary_policy", "0.85", WEEK, "liquidity,net,usd"),
        Rule("cb.global.policy_synchronized", f"if({true('synchronized')}, 1D, 0D)", "monetary_policy", "0.75", MONTH, "policy,divergence", where=has("synchronized")),
        Rule("cb.global.divergence_count", size("divergences"), "monetary_policy", "0.7", MONTH, "policy,divergence", "v >= 3", where=f"{size('divergences')} > 0"),
    ],
    "drug_regulatory": [
        Rule("fda.approvals.count", given("total"), "regulatory_action", "0.7", DAY, "fda,approvals", where=mode("approvals")),
        Rule("fda.adverse_events.seriousness_ratio", given("signals.seriousness_ratio"), "regulatory_action", "0.75", DAY, "fda,adverse_events", "v > 0.5", where=mode("adverse_events")),
        Rule("fda.adverse_events.serious_count", given("signals.serious_count"), "regulatory_action", "0.7", DAY, "fda,adverse_events,serious", "v > 10", where=mode("adverse_events")),
        Rule("fda.labels.boxed_warning_count", count("results", true("has_boxed_warning", "y")), "regulatory_action", "0.8", WEEK, "fda,labels,boxed_warning", PRESENT, where=f"{mode('labels')} and {count('results', true('has_boxed_warning', 'y'))} > 0"),
    ],
    "regulatory_gazette": [
        Rule("regulatory.us.document_count", f"if({has('count')}, {number('count')}, {size('documents')})", "regulatory_action", "0.65", DAY, "federal_register,us", where=f"{size('documents')} is not null"),
        Rule("regulatory.us.significant_count", count("documents", true("significant", "y")), "regulatory_action", "0.8", DAY, "federal_register,us,significant", PRESENT, where=f"{count('documents', true('significant', 'y'))} > 0"),
    ],
    "building_permits": [
        Rule("permits.us.{slug}.mom_pct", given("mom_pct", V), "macro_momentum", "0.7", MONTH, "housing,permits,{slug}", "v < -5", "v > 5", each=members("summary"), names={"slug": slug("r.key")}),
        Rule("permits.us.{slug}.consecutive_declines", whole("consecutive_declines", V), "macro_momentum", "0.8", MONTH, "housing,permits,{slug},declining", PRESENT, where=f"{whole('consecutive_declines', V)} >= 3", each=members("summary"), names={"slug": slug("r.key")}),
    ],
    "patent_filings": [
        Rule("patent.{cpc}.total_count", number("total_count"), "behavioral_intent", "0.6", MONTH, "patent,{cpc}", where=f"array_size({YEARS}) > 0", names=PATENT),
        Rule("patent.{cpc}.yoy_growth", f"({OUTPUT[0]} - {OUTPUT[1]}) / nullif({OUTPUT[1]}, 0D)", "behavioral_intent", "0.6", MONTH, "patent,{cpc},growth", "v > 0.2", "v < -0.2", f"array_size({YEARS}) >= 2 and {OUTPUT[1]} > 0", names=PATENT),
        Rule("patent.signal_classes.count", f"cardinality({at('signal_classes', 'map<string,variant>')})", "behavioral_intent", "0.5", MONTH, "patent,signal_classes", where=is_object("signal_classes")),
        Rule("patent.search.total_count", given("total_count"), "behavioral_intent", "0.5", WEEK, "patent,search", where=mode("search")),
    ],
    "lobbying": [
        Rule("lobbying.{slug}.spend_anomaly", number("anomaly.ratio"), "behavioral_intent", f"if({true('anomaly.anomaly')}, 0.7, 0.4)", MONTH, "lobbying,{slug}", true("anomaly.anomaly"), where=is_object("anomaly"), names={"slug": slug(named("target"))}),
        Rule("lobbying.us.filing_count", given("total_count"), "behavioral_intent", "0.5", MONTH, "lobbying,volume", where=mode("search")),
    ],
    "wikipedia_pageviews": [
        Rule("wiki.{slug}.spike_zscore", number("z_score", "r"), "behavioral_intent", "least(0.3D + v * 0.1D, 0.9D)", DAY, "wikipedia,{slug},attention", PRESENT, where=f"{true('article', 'r')} and {number('z_score', 'r')} >= 2", each=items("spikes"), names=ARTICLE),
        Rule("wiki.{slug}.views_zscore", VIEWS_Z, "behavioral_intent", "0.5", DAY, "wikipedia,{slug}", SIGN_UP, SIGN_DOWN, f"abs({VIEWS_Z}) > 2", names={"slug": slug(named("article"), 40)}),
    ],
    "cert_transparency": [
        Rule("cert.{slug}.count", given("count"), "behavioral_intent", "0.5", DAY, "cert_transparency,{slug}", names=DOMAIN),
        Rule("cert.{slug}.active_ratio", f"{whole('active')} / nullif({whole('active')} + {whole('expired')}, 0)", "behavioral_intent", "0.4", DAY, "cert_transparency,{slug},active", where=f"{has('active')} and {has('expired')} and {whole('active')} + {whole('expired')} > 0", names=DOMAIN),
        Rule("cert.{slug}.subdomain_count", size("subdomains"), "behavioral_intent", "0.4", DAY, "cert_transparency,{slug},subdomains", names=DOMAIN),
    ],
    "dns_monitor": [
        Rule("dns.{slug}.change_count", size("changes"), "behavioral_intent", "0.6", DAY, "dns,{slug},changes", PRESENT, where=f"{size('changes')} > 0", names=DOMAIN),
        Rule("dns.bulk.total_records", given("total_records"), "behavioral_intent", "0.4", DAY, "dns,bulk", where=has("domain_count")),
    ],
    "polymarket": [
        Rule("polymarket.{slug}.probability", number("yes_price", "r"), "positioning", f"least(0.5D + {number('volume_24h', 'r')} / 100000D, 0.9D)", 43_200, "prediction_market,{slug}", "v > 0.85", "true", f"{TRADED} and ({number('yes_price', 'r')} > 0.85 or {number('yes_price', 'r')} < 0.15)", items("markets"), MARKET),
        Rule("polymarket.{slug}.price_change_24h", number("price_change_24h", "r"), "positioning", f"least(0.4D + {number('volume_24h', 'r')} / 100000D, 0.85D)", 43_200, "prediction_market,{slug},momentum", SIGN_UP, SIGN_DOWN, f"{TRADED} and abs({number('price_change_24h', 'r')}) > 0.10", items("markets"), MARKET),
    ],
    "polymarket_whales": [
        Rule("polymarket_whales.avg_composite", mean(f"filter({numbers('wallets', 'composite')}, z -> z > 0)"), "positioning", "0.6", DAY, "prediction_market,whales"),
        Rule("polymarket_whales.market_concentration", total("whales", number("total_usdc", "y")), "positioning", "0.55", DAY, "prediction_market,whales,concentration", where=f"{size('whales')} > 0"),
    ],
    "insider_filings": [
        Rule("insider.market.purchase_count", whole("total_purchases"), "positioning", "0.8", WEEK, "insider,purchases", down=PRESENT, where=f"{size('clusters')} is not null and {whole('total_purchases')} > 0"),
        Rule("insider.{slug}.cluster", number("total_value", "r"), "positioning", f"if({number('conviction', 'r')} > 0, least(0.5D + {number('conviction', 'r')} * 0.4D, 0.95D), 0.7D)", WEEK, "insider,{slug},cluster", down=PRESENT, where=f"{true('ticker', 'r')} and {whole('insider_count', 'r')} >= 2", each=items("clusters"), names={"slug": f"lower({text('ticker', 'r')})"}),
    ],
    "form144": [
        Rule("form144.market.filing_count", whole("total_filings"), "positioning", "0.7", WEEK, "form144,sell_intent", PRESENT, where=f"{size('clusters')} is not null and {whole('total_filings')} > 0"),
        Rule("form144.{slug}.sell_cluster", number("total_value", "r"), "positioning", f"if({number('urgency', 'r')} > 0, least(0.5D + {number('urgency', 'r')} * 0.3D, 0.9D), 0.6D)", WEEK, "form144,{slug},sell_intent", PRESENT, where=true("ticker", "r"), each=items("clusters"), names={"slug": f"lower({text('ticker', 'r')})"}),
        Rule("form144.{slug}.pct_outstanding", number("pct_of_outstanding", "r"), "positioning", "0.8", WEEK, "form144,{slug},significant", PRESENT, where=f"{true('ticker', 'r')} and {number('pct_of_outstanding', 'r')} > 1", each=items("clusters"), names={"slug": f"lower({text('ticker', 'r')})"}),
    ],
    "gdelt": [
        Rule("gdelt.global.avg_goldstein", mean(numbers("events", "goldstein")), "geopolitical", "0.6", DAY, "gdelt,goldstein", "v < -3", "v > 3"),
        Rule("gdelt.global.event_count", size("events"), "geopolitical", "0.5", DAY, "gdelt,volume", where=f"array_size({numbers('events', 'goldstein')}) > 0"),
        Rule("gdelt.global.material_conflict_ratio", f"{count('events', text('quad_label', 'y') + " = 'Material Conflict'")} / nullif({size('events')}, 0)", "geopolitical", "0.65", DAY, "gdelt,conflict", "v > 0.3"),
        Rule("gdelt.global.total_mentions", either("summary.total_mentions", "summary.num_mentions"), "geopolitical", "0.5", DAY, "gdelt,mentions", where=f"{size('events')} > 0 and {either('summary.total_mentions', 'summary.num_mentions')} > 0"),
    ],
    "whale_alert": [
        Rule("crypto.btc.large_tx_count", size("transactions"), "financial_stress", "0.6", 43_200, "crypto,btc,whale", where=f"{size('transactions')} > 0"),
        Rule("crypto.btc.whale_volume", either("summary.total_btc", "summary.total_value"), "financial_stress", "0.55", 43_200, "crypto,btc,volume", where=f"{size('transactions')} > 0 and {either('summary.total_btc', 'summary.total_value')} > 0"),
    ],
    "comtrade": [
        Rule("comtrade.{slug}.{flow}_value_usd", total("records", number("trade_value_usd", "y")), "supply_chain", "0.6", MONTH, "trade,{slug},{flow}", where=f"{size('records')} > 0", names={"slug": FLOW_SLUG, "flow": named("flow", "trade")}),
        Rule("comtrade.{code}.trade_volume", total("records", number("trade_value_usd", "y")), "supply_chain", "0.6", MONTH, "trade,commodity,{code}", where=f"{size('records')} > 0 and {true('commodity_code')}", names={"code": text("commodity_code")}),
    ],
    "energy_supply": [
        Rule("energy.{slug}.level", either("latest", "latest_value", V), "physical_flow", "0.75", WEEK, "energy,{slug},{label}", each=members("signals"), names={"slug": slug("r.key"), "label": f"coalesce(nullif({text('label')}, ''), 'stocks')"}),
        Rule("energy.{slug}.wow_change", either("wow_change", "change", V), "physical_flow", "0.75", WEEK, "energy,{slug},change", SIGN_DOWN, SIGN_UP, each=members("signals"), names={"slug": slug("r.key")}),
        Rule("energy.rig_count.total", given("count"), "physical_flow", "0.7", MONTH, "energy,rig_count", where=f"{size('records')} is not null"),
    ],
    "supply_chain_prices": [
        Rule("supply_chain.{slug}.mom_pct", either("mom_change", "mom_pct", V), "supply_chain", "0.7", MONTH, "{kind},{slug}", "v > 0.5", "v < -0.5", each=members("signals"), names={"slug": slug("r.key"), "kind": f"if(contains({named('mode', '')}, 'producer'), 'ppi', 'import_prices')"}),
        Rule("supply_chain.pressure_index", either("pressure.score", "pressure.pressure_score"), "supply_chain", "0.75", MONTH, "supply_chain,pressure", "v > 0.6", "v < 0.3"),
    ],
    "macro_data": [
        Rule("macro.{slug}.latest", given("value", "try_element_at(try_variant_get(r.value, '$', 'array<variant>'), -1)"), "macro_momentum", "0.6", MONTH, "macro,{slug}", each=members(""), names={"slug": "left(replace(replace(lower(r.key), ':', '_'), '/', '_'), 30)"}),
    ],
    "market_data": [
        Rule("market.{slug}.return", f"if({CLOSE[1]} > 0, ({CLOSE[0]} - {CLOSE[1]}) / {CLOSE[1]}, null)", "positioning", "0.7", DAY, "market,{slug}", "v < -0.02", "v > 0.02", each=members(""), names=LATEST_ROW),
        Rule("market.{slug}.volume", given("Volume", "try_element_at(try_variant_get(r.value, '$', 'array<variant>'), -1)"), "positioning", "0.5", DAY, "market,{slug},volume", each=members(""), names=LATEST_ROW),
    ],
    "foia_requests": [],
    "interconnection_queue": [],
    "electricity_monitor": [],
    "satellite_activity": [
        *[
            Rule(f"satellite.fire.{key}", number(key), "physical_disruption", confidence, 21_600, f"satellite,fire,{tags}", up, where=f"{mode('fire')} and {has('hotspot_count')}")
            for key, confidence, tags, up in (("hotspot_count", "0.8", "hotspot,count", "v > 100"), ("frp_total", "0.75", "frp,total", "v > 1000"), ("frp_max", "0.7", "frp,peak", "v > 100"), ("cluster_count", "0.75", "cluster,spatial", "v > 5"))
        ],
        *[
            Rule(f"satellite.vegetation.{key}", value, "supply_chain", confidence, WEEK, f"satellite,vegetation,ndvi,{tag}", up, down, f"{mode('vegetation')} and ({number('observation_count')} <> 0 or {has('latest_ndvi')} or {has('avg_ndvi')})")
            for key, value, confidence, tag, up, down in (
                ("ndvi_latest", number("latest_ndvi"), "0.85", "latest", "false", "false"),
                ("anomaly_pct", number("anomaly_pct"), "0.8", "anomaly", "v > 10", "v < -10"),
                ("health_class_ordinal", cases(f"lower({named('latest_health', '')})", HEALTH, "1.0"), "0.85", "health", "false", "false"),
            )
        ],
        *[
            Rule(f"satellite.events.{key}", number(path), "physical_disruption", "0.8", 43_200, f"satellite,events,{tags}", up, where=f"{mode('events')} and {has('event_count')}")
            for key, path, tags, up in (("active_count", "event_count", "eonet,count", "v > 20"), ("wildfire_count", "category_counts.wildfires", "wildfire,count", "v > 5"), ("severe_storm_count", "category_counts.severeStorms", "storm,count", "v > 3"))
        ],
    ],
    "internet_infrastructure": [
        Rule("internet.outage.critical_count", CRITICAL, "physical_disruption", "0.85", 3_600, "internet,outage,critical", SIGN_UP, where=mode("outages")),
        Rule("internet.outage.event_max_score", f"array_max(transform({EVENTS}, y -> {number('score', 'y')}))", "physical_disruption", "0.8", 3_600, "internet,outage,severity", "v > 50", where=mode("outages")),
        Rule("internet.outage.event_breadth", f"array_size(array_distinct({COUNTRIES.format(EVENTS)}))", "physical_disruption", "0.8", 3_600, "internet,outage,breadth", "v > 2", where=f"{mode('outages')} and array_size({EVENTS}) > 0"),
        Rule("internet.censorship.anomaly_rate", number("avg_rate"), "geopolitical", "0.75", DAY, "internet,censorship,anomaly_rate", "v > 0.1", where=mode("censorship")),
        Rule("internet.censorship.trend_rising", f"if({text('trend')} <=> 'rising', 1D, 0D)", "geopolitical", "0.7", DAY, "internet,censorship,trend", "v = 1", f"{text('trend')} = 'falling'", mode("censorship")),
        Rule("internet.censorship.confirmed_total", total("rows", number("confirmed", "y")), "geopolitical", "0.8", DAY, "internet,censorship,confirmed", SIGN_UP, where=mode("censorship")),
        Rule("internet.signals.connectivity_level", f"coalesce({at('current', 'double')}, 1D)", "physical_disruption", "0.85", 1_800, "internet,connectivity,{severity}", down=f"{SEVERITY} in ('critical', 'warning')", where=mode("signals"), names={"severity": named("severity", "normal")}),
        Rule("internet.signals.drop_count", size("drops"), "physical_disruption", "0.8", 1_800, "internet,connectivity,drops", "v > 3", where=mode("signals")),
        Rule("internet.incidents.active_count", size("incidents"), "geopolitical", "0.75", 3_600, "internet,censorship,incidents", "v > 3", where=mode("incidents")),
        Rule("internet.incidents.country_breadth", f"array_size(array_distinct(flatten(transform({items('incidents')}, y -> coalesce({at('countries', 'array<string>', 'y')}, cast(array() as array<string>))))))", "geopolitical", "0.75", 3_600, "internet,censorship,breadth", "v > 5", where=mode("incidents")),
    ],
    "consumer_sentiment": [
        Rule("consumer_sentiment.eu.{slug}", given("latest", V), "macro_momentum", "0.8", MONTH, "consumer_confidence,eu,{slug}", f"{number('mom_change', V)} > 0", f"{number('mom_change', V)} < 0", mode("eu_confidence"), members("signals.countries"), {"slug": "lower(r.key)"}),
        Rule("consumer_sentiment.eu.synchronized_decline", "1D", "macro_momentum", "0.9", MONTH, "consumer_confidence,eu,synchronized", down=PRESENT, where=f"{mode('eu_confidence')} and {true('signals.synchronized_decline')}"),
        Rule("consumer_sentiment.us.headline", given("signals.sentiment_latest"), "macro_momentum", "0.85", MONTH, "consumer_confidence,us,umichigan", f"if({has('signals.sentiment_mom_change')}, {number('signals.sentiment_mom_change')} > 0, v >= 70)", f"if({has('signals.sentiment_mom_change')}, {number('signals.sentiment_mom_change')} < 0, v <= 50)", mode("us_sentiment")),
        Rule("consumer_sentiment.us.inflation_expectations", given("signals.inflation_exp_latest"), "macro_momentum", "0.8", MONTH, "inflation,expectations,us", "v > 3", "true", mode("us_sentiment")),
        Rule("consumer_sentiment.cpi.mom", given("signals.cpi_mom_change"), "macro_momentum", "0.9", MONTH, "cpi,inflation,us", SIGN_UP, SIGN_DOWN, mode("inflation_reality")),
        Rule("consumer_sentiment.expectations_gap", given("signals.expectations_gap"), "macro_momentum", "0.75", MONTH, "inflation,expectations_gap,us", SIGN_UP, "true", mode("inflation_reality")),
    ],
    "food_security": [
        Rule("food_security.{country}.{suffix}", number("value", f"try_element_at({FOOD_RECORDS}, -1)"), "biological", f"if({true('signals.stress_alert')}, 0.9, 0.8)", MONTH, "food_security,{country},{suffix}", f"{text('signals.trend_direction')} = 'up'", f"{text('signals.trend_direction')} = 'down'", f"array_size({FOOD_RECORDS}) > 0", names=FOOD_NAMES),
        Rule("food_security.{country}.stress", "1D", "biological", "0.9", MONTH, "food_security,{country},stress_alert", down=PRESENT, where=f"array_size({FOOD_RECORDS}) > 0 and {true('signals.stress_alert')}", names=FOOD_NAMES),
    ],
    "political_risk": [
        Rule("political_risk.ie_total_spend", CASH, "geopolitical", "0.8", WEEK, "political_risk,expenditures,fec", PRESENT, where=f"{RISK}'expenditures' and {CASH} > 0"),
        Rule("political_risk.oppose_ratio", number("signals.oppose_ratio"), "geopolitical", "0.75", WEEK, "political_risk,oppose_ratio,fec", "v > 0.5", "true", f"{RISK}'expenditures' and {number('signals.oppose_ratio')} > 0"),
        Rule("political_risk.target.{slug}", number("total_spent", "r"), "geopolitical", "0.7", WEEK, "political_risk,target_spending,{slug}", PRESENT, where=f"{RISK}'expenditures' and {number('total_spent', 'r')} > 0", each=f"slice({items('signals.top_targets')}, 1, 3)", names={"slug": slug(f"replace({named('candidate', of='r')}, ',', '')")}),
        Rule("political_risk.avg_cash_on_hand", number("signals.avg_cash_on_hand"), "geopolitical", "0.7", WEEK, "political_risk,filings,cash", where=f"{RISK}'filings' and {number('signals.avg_cash_on_hand')} > 0"),
        Rule("political_risk.active_fundraisers", whole("signals.active_fundraisers"), "geopolitical", "0.65", WEEK, "political_risk,candidates,fundraising", "v > 5", where=f"{RISK}'candidates' and {whole('signals.active_fundraisers')} > 0"),
    ],
    "power_grid": [
        Rule("power_grid.demand.total_peak_mw", number("total_peak_mw"), "physical_flow", "0.8", DAY, "power_grid,demand,peak", where=grid_mode("demand")),
        Rule("power_grid.demand.zone_count", f"coalesce({size('zones')}, 0)", "physical_flow", "0.9", DAY, "power_grid,demand,zones", where=grid_mode("demand")),
        Rule("power_grid.fuel.gas_share_pct", f"round({GAS}, 1)", "physical_flow", "0.85", DAY, "power_grid,fuel_mix,gas", f"{GAS} > 50", where=grid_mode("fuel_mix")),
        Rule("power_grid.fuel.renewable_share_pct", f"round({RENEWED}, 1)", "physical_flow", "0.85", DAY, "power_grid,fuel_mix,renewable", where=grid_mode("fuel_mix")),
        Rule("power_grid.pricing.stressed_zone_count", f"coalesce({size('stressed_zones')}, 0)", "financial_stress", "0.8", DAY, "power_grid,pricing,stress", SIGN_UP, where=grid_mode("pricing")),
        Rule("power_grid.pricing.max_spread", f"array_max(transform({numbers('zones', 'spread')}, z -> abs(z)))", "financial_stress", "0.8", DAY, "power_grid,pricing,spread", "v > 5", where=grid_mode("pricing")),
        Rule("power_grid.pricing.avg_da_lbmp", f"round({mean(numbers('zones', 'da_lbmp'))}, 2)", "financial_stress", "0.8", DAY, "power_grid,pricing,day_ahead", f"{mean(numbers('zones', 'da_lbmp'))} > 100", where=grid_mode("pricing")),
        Rule("power_grid.forecast.persistent_deviation_count", f"coalesce({size('persistent_deviation_zones')}, 0)", "physical_disruption", "0.75", DAY, "power_grid,forecast,deviation", SIGN_UP, where=grid_mode("forecast")),
        Rule("power_grid.forecast.max_significant_deviations", f"array_max(transform(filter({items('zones')}, y -> {is_object('', 'y')}), y -> {number('significant_deviations', 'y')}))", "physical_disruption", "0.7", DAY, "power_grid,forecast,significant", "v > 5", where=grid_mode("forecast")),
    ],
    "defi_flows": [
        Rule("defi.tvl.total_usd", number("total_tvl"), "financial_stress", "0.8", 3_600, "defi,tvl,total", where=defi_mode("tvl")),
        Rule("defi.tvl.drawdown_breadth", count("protocols", f"{given('change_1d_pct', 'y')} < -5"), "financial_stress", "0.75", 3_600, "defi,tvl,drawdown", "v > 3", where=defi_mode("tvl")),
        Rule("defi.tvl.top_concentration_pct", top_share("protocols", "tvl_usd", "total_tvl"), "positioning", "0.7", 3_600, "defi,tvl,concentration", "v > 30", where=defi_mode("tvl")),
        Rule("defi.stablecoin.total_supply", number("total_supply"), "financial_stress", "0.85", 3_600, "defi,stablecoin,supply", where=defi_mode("stablecoins")),
        Rule("defi.stablecoin.top_share_pct", top_share("stablecoins", "circulating_usd", "total_supply"), "positioning", "0.8", 3_600, "defi,stablecoin,concentration", "v > 60", where=defi_mode("stablecoins")),
        Rule("defi.dex.total_volume_24h", number("total_volume_24h"), "positioning", "0.75", 3_600, "defi,dex,volume", where=defi_mode("dex_volume")),
        Rule("defi.dex.panic_breadth", count("dexes", f"{given('change_1d_pct', 'y')} > 50"), "financial_stress", "0.7", 3_600, "defi,dex,panic", "v > 2", where=defi_mode("dex_volume")),
        Rule("defi.chain.total_tvl", number("grand_total_tvl"), "financial_stress", "0.8", 3_600, "defi,chain,tvl", where=defi_mode("chain")),
        Rule("defi.chain.top_concentration_pct", top_share("chains", "tvl_usd", "grand_total_tvl"), "positioning", "0.75", 3_600, "defi,chain,concentration", "v > 50", where=defi_mode("chain")),
    ],
    "labor_disruptions": [
        Rule("strike.us.workers_involved", strike("workers")[0], "behavioral_intent", "0.75", MONTH, "labor,strike,workers", *strike("workers")[1:]),
        Rule("strike.us.idle_days", strike("idle_days")[0], "macro_momentum", "0.7", MONTH, "labor,strike,idle_days", *strike("idle_days")[1:]),
        Rule("strike.us.intensity", given("signals.intensity_ratio"), "macro_momentum", "0.65", MONTH, "labor,strike,intensity", "v > 1.5", "v < 0.5", f"not {has('label')}"),
        Rule("strike.us.consecutive_months", at("signals.consecutive_active_months", "double"), "behavioral_intent", "0.7", MONTH, "labor,strike,persistence", "v >= 3", where=f"not {has('label')} and {number('signals.consecutive_active_months')} > 0"),
    ],
    "gov_contracts": [
        Rule("gov_contract.{region}.award_count", f"if({has('count')}, {number('count')}, {size('awards')})", "regulatory_action", "0.65", 21_600, "gov,contracts,{region},count", PRESENT, where=f"{AWARDED} and if({has('count')}, {number('count')}, {size('awards')}) > 0", names=REGION),
        Rule("gov_contract.{region}.total_value", f"round({total('awards', f'coalesce({either("amount_usd", "amount", "y")}, 0D)')}, 2)", "regulatory_action", "0.7", 21_600, "gov,contracts,{region},value", PRESENT, where=f"{AWARDED} and {total('awards', f'coalesce({either("amount_usd", "amount", "y")}, 0D)')} > 0", names=REGION),
        Rule("gov_contract.{region}.defense_share", f"round({count('awards', ' or '.join(f"contains({AGENCY}, '{w}')" for w in DEFENCE))} / nullif({size('awards')}, 0), 4)", "geopolitical", "0.75", 21_600, "gov,contracts,{region},defense", "v > 0.3", where=AWARDED, names=REGION),
    ],
    "academic_preprints": [
        Rule("trials.active_count", f"nullif({count('trials', f'{TRIAL} in ({listed(ACTIVE_TRIALS)})')}, 0)", "biological", "0.6", DAY, "pharma,trials,active", PRESENT),
        Rule("trials.completed_count", f"nullif({count('trials', f"{TRIAL} = 'Completed'")}, 0)", "regulatory_action", "0.75", DAY, "pharma,trials,completed", PRESENT),
        Rule("trials.industry_ratio", f"round({count('trials', text('sponsor_class', 'y') + " = 'INDUSTRY'")} / nullif({SPONSORED}, 0), 4)", "behavioral_intent", "0.6", DAY, "pharma,trials,industry", "v > 0.5"),
        Rule("arxiv.volume", f"coalesce(nullif({number('count')}, 0D), nullif({number('total')}, 0D), {size('papers')})", "behavioral_intent", "0.5", DAY, "research,arxiv,volume", PRESENT, where=f"{size('trials')} is null and {size('papers')} is not null and coalesce(nullif({number('count')}, 0D), nullif({number('total')}, 0D), {size('papers')}) > 0"),
    ],
    "internet_outages": [],
    "migration_flows": [],
}


def filled(template: str, names: dict[str, str]) -> str:
    parts = [x for literal, name, _, _ in Formatter().parse(template) for x in ([f"'{literal}'"] if literal else []) + ([names[name]] if name else [])]
    return f"concat({', '.join(parts)})"


def compiled(rule: Rule) -> str:
    """An array of the rule's rows over a payload p."""
    tags = ", ".join(filled(t, rule.names) for t in rule.tags.split(","))
    row = (
        f"named_struct('signal_id', {filled(rule.signal, rule.names)}, 'value', v, 'direction', case when {rule.up} then 1 when {rule.down} then -1 else 0 end, "
        f"'confidence', cast({rule.confidence} as double), 'category', '{rule.category}', 'tags', filter(array({tags}), t -> t <> ''), 'ttl', {rule.ttl}L)"
    )
    rows = f"transform(array(cast(case when {rule.where} then {rule.value} end as double)), v -> {row})"
    return f"coalesce(flatten(transform({rule.each}, r -> {rows})), array())" if rule.each else rows


def of_source(landing: DataFrame, source: str, rules: list[Rule]) -> DataFrame:
    parsed = landing.where(F.col("source") == source).select("source", F.col("fetched_at").cast("double").alias("ts"), F.try_parse_json("data").alias("p"))
    rows = f"filter(concat({', '.join(compiled(r) for r in rules)}), x -> x.value is not null and x.signal_id is not null)"
    return parsed.where("p is not null").select("source", "ts", F.expr(f"inline({rows})")).select("source", "signal_id", "ts", "value", "direction", "confidence", "category", "tags", "ttl")


def evidence(landing: DataFrame, sources: list[str] | None = None, rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """The evidence of the sources named (all that have rules, if none are), in SCHEMA's columns. rules: a caller's own table."""
    table = RULES if rules is None else rules
    out = None
    for source in sorted(table) if sources is None else sources:
        if not table.get(source):
            continue
        one = of_source(landing, source, table[source])
        out = one if out is None else out.unionByName(one)
    return landing.sparkSession.createDataFrame([], SCHEMA) if out is None else out
