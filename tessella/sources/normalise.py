"""Source normalisers: landed payloads to observations, entities, aliases and links.

A landing row has `source`, `fetched_at` (epoch seconds) and `data` (JSON text). A `Spec` says how the records of one
source become rows, as SQL expressions over a record `r`, its payload `p` and `fetched_at`. Payloads that don't parse,
and records without a key, give no rows. All of it is from_json, explode and select.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_key
from ..operators.joins import all_pairs
from ..session import written

OBSERVATION = ["entity_id", "entity_type", "entity_key", "name", "source", "observation_type", "observed_at", "value_json"]


@dataclass(frozen=True)
class Link:
    kind: str
    to_type: str
    to_key: str
    confidence: float = 0.9
    lookup: str = ""  # to_key is a code, whose target the caller's table of this name gives


@dataclass(frozen=True)
class Spec:
    """payload: schema of `data`; records: expression for the array of records; the rest are expressions over r, p, fetched_at."""

    source: str
    payload: str
    records: str
    entity_type: str
    key: str
    observation_type: str
    value: dict[str, str]
    name: str = ""
    time: str = "fetched_at"
    where: str = "true"
    alias: str = ""
    links: tuple[Link, ...] = field(default_factory=tuple)


ISO = "unix_timestamp(try_to_timestamp(replace(substring({0}, 1, 19), 'T', ' '), 'yyyy-MM-dd HH:mm:ss'))"
DAY = "unix_timestamp(try_to_timestamp(substring({0}, 1, 10), 'yyyy-MM-dd'))"


def at(shape: str, col: str) -> str:
    return f"coalesce({shape.format(col)}, fetched_at)"


def same(*names: str) -> dict[str, str]:
    return {n: f"r.{n}" for n in names}


TRANSFER = "struct<transfers:array<struct<hash:string,time:double,confirmed:boolean,block_height:bigint,inputs:array<struct<addr:string,value_btc:double>>,outputs:array<struct<addr:string,value_btc:double>>>>>"


def transfers(side: str, other: str) -> str:
    one = f"transform(t.{side}, x -> named_struct('addr', x.addr, 'value_btc', x.value_btc, 'hash', t.hash, 'time', t.time, 'confirmed', t.confirmed, 'block_height', t.block_height, 'others', transform(t.{other}, y -> y.addr)))"
    return f"flatten(transform(p.transfers, t -> {one}))"


# The newest bars of an instrument's history: 20-day windows, 252 days a year.
HISTORY = "struct<histories:array<struct<ticker:string,name:string,bars:array<struct<date:string,close:double,high:double,low:double,volume:double>>>>>"
LOG_RETURNS = "zip_with(slice(h.bars, 2, size(h.bars)), slice(h.bars, 1, size(h.bars) - 1), (a, b) -> ln(a.close / b.close))"
HISTORIES = (
    "transform(filter(transform(p.histories, h -> named_struct('ticker', h.ticker, 'name', h.name, 'bars', filter(h.bars, b -> b.close > 0))), h -> size(h.bars) > 0), h -> named_struct("
    f"'ticker', h.ticker, 'name', h.name, 'latest', try_element_at(h.bars, -1), 'volumes', slice(transform(h.bars, b -> coalesce(b.volume, 0D)), greatest(size(h.bars) - 19, 1), 20), 'returns', slice({LOG_RETURNS}, greatest(size(h.bars) - 20, 1), 20)))"
)
MEAN = "aggregate({0}, 0D, (a, x) -> a + x) / size({0})"
DEVIATION = f"sqrt(aggregate(transform(r.returns, x -> pow(x - {MEAN.format('r.returns')}, 2)), 0D, (a, x) -> a + x) / size(r.returns))"
MASTER = "struct<instruments:array<struct<ticker:string,issuer:string,country:string,base_country:string,quote_country:string,protocol:string,exchange_country:string>>>"
OWNER = Link("domain_owned_by", "company", "lower(coalesce(try_element_at(split(p.domain, '[.]'), -2), p.domain))", 0.8, "domain_company")


def history(observed: str, value: dict[str, str], where: str = "true") -> Spec:
    return Spec("instrument_universe", HISTORY, HISTORIES, "instrument", "upper(r.ticker)", observed, value, "coalesce(r.name, key)", at(DAY, "r.latest.date"), where)


MOVED = {"tx_hash": "r.hash", "value_btc": "r.value_btc", "counterparty_count": "size(r.others)", "confirmed": "r.confirmed", "block_height": "r.block_height"}
COUNTRY = {"entity_type": "country"}
SPECS: list[Spec] = [
    Spec("ais_vessel", "struct<vessels:array<struct<mmsi:string,imo:string,name:string,lat:double,lon:double,sog:double,cog:double,heading:double,nav_status:string,timestamp:double>>>", "p.vessels", "vessel", "coalesce(r.mmsi, r.imo)", "vessel_position", same("lat", "lon", "sog", "cog", "heading", "nav_status"), "coalesce(r.name, r.mmsi)", "coalesce(r.timestamp, fetched_at)", "r.lat is not null and r.lon is not null", "mmsi"),
    Spec("ais_vessel", "struct<calls:array<struct<mmsi:string,imo:string,vesselName:string,eta:string,portToVisit:string,prevPort:string,nextPort:string,arrivalWithCargo:boolean>>>", "p.calls", "vessel", "coalesce(r.mmsi, r.imo)", "port_call", {"port": "r.portToVisit", "prev_port": "r.prevPort", "next_port": "r.nextPort", "arrival_with_cargo": "r.arrivalWithCargo"}, "coalesce(r.vesselName, r.mmsi)", at(ISO, "r.eta"), alias="mmsi"),
    Spec("capital_flows", "struct<holdings:array<struct<country_code:string,country:string,latest_value_billions:double,mom_change_pct:double>>>", "p.holdings", "country", "r.country_code", "capital_flow", {"flow_type": "'holdings'", "series": "r.country", "latest_value": "r.latest_value_billions", "mom_change_pct": "r.mom_change_pct"}),
    Spec("central_bank_balance", "struct<banks:array<struct<country_code:string,code:string,native_trillions:double,usd_trillions:double,wow_pct:double,mom_pct:double,yoy_pct:double>>>", "p.banks", "country", "r.country_code", "cb_balance_sheet", {"cb_code": "r.code", **same("native_trillions", "usd_trillions", "wow_pct", "mom_pct", "yoy_pct")}),
    Spec("central_bank_balance", "struct<rates:array<struct<country_code:string,code:string,current_rate:double,last_change_date:string,last_change_direction:string,last_change_bps:double,days_since_change:bigint>>>", "p.rates", "country", "r.country_code", "cb_policy_rate", {"cb_code": "r.code", **same("current_rate", "last_change_date", "last_change_direction", "last_change_bps", "days_since_change")}),
    Spec("cert_transparency", "struct<domain:string,certs:array<struct<entry_timestamp:string,is_expired:boolean,common_name:string,issuer_name:string>>>", "p.certs", "domain", "p.domain", "cert_issued", same("is_expired", "common_name", "issuer_name"), "p.domain", at(ISO, "r.entry_timestamp"), alias="domain_name", links=(OWNER,)),
    Spec("cftc", "struct<rows:array<struct<code:string,market:string,report_date:string,open_interest:double,mm_net:double,pm_net:double,swap_net:double,mm_net_pct_oi:double,mm_weekly_flow:double,oi_change:double,conc_top4_long:double,conc_top4_short:double,ticker:string>>>", "p.rows", "cftc_contract", "trim(r.code)", "futures_positioning", same("open_interest", "mm_net", "pm_net", "swap_net", "mm_net_pct_oi", "mm_weekly_flow", "oi_change", "conc_top4_long", "conc_top4_short"), "coalesce(nullif(trim(r.market), ''), r.code)", at(DAY, "r.report_date"), links=(Link("cftc_tracks", "instrument", "r.ticker", 1.0),)),
    Spec("comtrade", "struct<reporter:string,partner:string,flow:string,record_count:bigint,records:array<struct<commodity_code:string,trade_value_usd:double,period:string>>>", "slice(p.records, 1, 1)", "country", "upper(trim(p.reporter))", "trade_flow", {"partner": "p.partner", "flow": "p.flow", "commodity_code": "r.commodity_code", "trade_value_usd": "r.trade_value_usd", "record_count": "coalesce(p.record_count, size(p.records))", "period": "r.period"}),
    Spec("foia_requests", "struct<records:array<struct<entity:string,source:string,agency:string,jurisdiction:string,date_filed:string,status:string>>>", "p.records", "company", "trim(r.entity)", "investigation_signal", same("source", "agency", "jurisdiction", "date_filed", "status")),
    Spec("form144", "struct<filings:array<struct<reporter_cik:string,issuer_cik:string,insider:string,ticker:string,company:string,shares_to_sell:bigint,dollar_value:double,acquisition_type:string,urgency:string,relationship:string,filing_date:string>>>", "p.filings", "person", "r.reporter_cik", "sell_intent", same("ticker", "company", "shares_to_sell", "dollar_value", "acquisition_type", "urgency", "relationship"), "r.insider", at(DAY, "r.filing_date"), links=(Link("works_for", "company", "r.issuer_cik"),)),
    Spec("gdelt", "struct<events:array<struct<id:string,date:string,actor1:string,actor2:string,event_root:string,goldstein:double,quad_class:int,num_mentions:int,place:string>>>", "flatten(transform(p.events, e -> array(named_struct('country', e.actor1, 'other', e.actor2, 'role', 'initiator', 'e', e), named_struct('country', e.actor2, 'other', e.actor1, 'role', 'target', 'e', e))))", "country", "nullif(trim(r.country), '')", "geopolitical_event", {"event_id": "r.e.id", "counterpart_country": "r.other", "event_root": "r.e.event_root", "goldstein": "r.e.goldstein", "quad_class": "r.e.quad_class", "role": "r.role", "num_mentions": "r.e.num_mentions", "location": "r.e.place"}, "r.country", "coalesce(unix_timestamp(try_to_timestamp(r.e.date, 'yyyyMMdd')), fetched_at)", alias="fips", links=(Link("event_involves", "country", "if(r.role = 'initiator' and r.other <> r.country, nullif(trim(r.other), ''), null)"),)),
    Spec("global_pmi", "struct<mode:string,countries:array<struct<iso:string,value:double,period:string,regime:string,momentum_6m:double>>>", "p.countries", "country", "r.iso", "economic_activity", {"indicator": "p.mode", **same("value", "period", "regime", "momentum_6m")}),
    Spec("insider_filings", "struct<transactions:array<struct<reporter_cik:string,issuer_cik:string,name:string,ticker:string,company:string,shares:double,price:double,role:string,date:string>>>", "p.transactions", "person", "r.reporter_cik", "insider_trade", same("ticker", "company", "shares", "price", "role"), "r.name", at(DAY, "r.date"), links=(Link("works_for", "company", "r.issuer_cik"),)),
    Spec("internet_outages", "struct<country:string,mode:string,test_name:string,signals:struct<anomaly_rate_pct:double,disconnect_rate_pct:double,confirmed_count:bigint,failure_count:bigint,alert:string>>", "array(p.signals)", "country", "p.country", "internet_disruption", {"mode": "p.mode", "test_name": "p.test_name", **same("anomaly_rate_pct", "disconnect_rate_pct", "confirmed_count", "failure_count", "alert")}),
    Spec("lobbying", "struct<filings:array<struct<registrant_name:string,client_name:string,amount:double,filing_year:int,filing_period:string,issue_codes:array<string>,dt_posted:string>>>", "p.filings", "company", "trim(r.registrant_name)", "lobbying_spend", same("client_name", "amount", "filing_year", "filing_period", "issue_codes"), time=at(ISO, "r.dt_posted"), links=(Link("lobbies_for", "company", "if(lower(r.client_name) not in ('self', '') and r.client_name <> r.registrant_name, trim(r.client_name), null)"),)),
    Spec("migration_flows", "struct<country:string,mode:string,role:string,year:int,signals:struct<total_displaced:double,acceptance_rate:double,latest_value:double,yoy_change_pct:double,trend:string,alert:string>>", "array(p.signals)", "country", "p.country", "migration_pressure", {"mode": "p.mode", "role": "p.role", "year": "p.year", **same("total_displaced", "acceptance_rate", "latest_value", "yoy_change_pct", "trend", "alert")}),
    Spec("patent_filings", "struct<patents:array<struct<assignee:string,patent_number:string,patent_title:string,cpc_subgroup_id:array<string>,patent_date:string>>>", "p.patents", "company", "trim(r.assignee)", "patent_filing", {"patent_number": "r.patent_number", "patent_title": "r.patent_title", "cpc_subgroup_id": "try_element_at(r.cpc_subgroup_id, 1)"}, time=at(DAY, "r.patent_date"), links=(Link("patents_in", "country", "'US'"),)),
    Spec("political_risk", "struct<candidates:array<struct<candidate_id:string,name:string,party:string,office:string,state:string,has_raised_funds:boolean,candidate_status:string>>>", "p.candidates", "person", "r.candidate_id", "campaign_finance", {"mode": "'candidates'", **same("name", "party", "office", "state", "has_raised_funds", "candidate_status")}, "r.name"),
    Spec("polymarket", "struct<markets:array<struct<condition_id:string,question:string,yes_price:double,no_price:double,volume_24h:double,volume_total:double,liquidity:double,spread:double,price_change_24h:double,price_change_1wk:double,category:string>>>", "p.markets", "topic", "r.condition_id", "market_probability", same("yes_price", "no_price", "volume_24h", "volume_total", "liquidity", "spread", "price_change_24h", "price_change_1wk"), "r.question", links=(Link("topic_relates_to_instrument", "instrument", "r.category", 0.7, "topic_instrument"),)),
    Spec("polymarket_whales", "struct<wallets:array<struct<wallet:string,composite:double,accuracy:double,total_volume:double,total_resolved:bigint,markets:bigint,profit_factor:double>>>", "p.wallets", "wallet", "r.wallet", "whale_trade", {"composite_score": "r.composite", **same("accuracy", "total_volume", "total_resolved", "markets", "profit_factor")}),
    Spec("sanctions_monitor", "struct<records:array<struct<source:string,entity_id:string,name:string,type:string,programs:array<string>,nationality:string,aliases:array<string>,listed_date:string>>>", "p.records", "sanctioned", "concat(r.source, ':', r.entity_id)", "sanctions_listing", {"source": "r.source", "programs": "r.programs", "nationality": "r.nationality", "aliases": "slice(r.aliases, 1, 5)"}, "r.name", at(DAY, "r.listed_date"), links=(Link("sanctioned_under", "country", "explode_from:array_distinct(flatten(transform(r.programs, x -> array(x, upper(x)))))", 0.95, "program_country"),)),
    Spec("sovereign_debt", "struct<records:array<struct<country:string,date:string,yield_pct:double,curve_2s10s:double,maturity:string>>>", "p.records", "country", "r.country", "sovereign_yield", same("maturity", "yield_pct", "curve_2s10s", "date"), time=at(DAY, "r.date")),
    Spec("supply_chain_monitor", "struct<series:array<struct<series_id:string,sector:string,values:array<struct<period:string,value:double>>>>>", "p.series", "price_series", "r.series_id", "price_movement", {"series_id": "r.series_id", "sector": "r.sector", "latest_value": "try_element_at(r.values, -1).value", "num_periods": "size(r.values)"}, "r.sector"),
    Spec("transport_throughput", "struct<mode:string,period:string,records:array<struct<border_country:string>>>", "transform(array_distinct(transform(p.records, x -> x.border_country)), c -> named_struct('country', c, 'n', size(p.records)))", "country", "r.country", "border_throughput", {"mode": "p.mode", "record_count": "r.n", "period": "p.period"}),
    Spec("whale_alert", TRANSFER, transfers("inputs", "outputs"), "wallet", "nullif(r.addr, '')", "btc_transfer", {**MOVED, "direction": "'out'"}, time="coalesce(r.time, fetched_at)", alias="btc_address", links=(Link("transacts_with", "wallet", "explode_from:r.others"),)),
    Spec("whale_alert", TRANSFER, transfers("outputs", "inputs"), "wallet", "nullif(r.addr, '')", "btc_transfer", {**MOVED, "direction": "'in'"}, time="coalesce(r.time, fetched_at)", alias="btc_address"),
    Spec("wikipedia_pageviews", "struct<spikes:array<struct<article:string,date:string,z_score:double,latest_views:double,mean_views:double,spike_ratio:double,project:string>>>", "p.spikes", "topic", "r.article", "pageview_spike", same("z_score", "latest_views", "mean_views", "spike_ratio", "project"), time="coalesce(unix_timestamp(try_to_timestamp(r.date, 'yyyyMMdd')), fetched_at)"),
    Spec("earthquake_proximity", "struct<features:array<struct<id:string,properties:struct<mag:double,place:string,time:double>,geometry:struct<coordinates:array<double>>>>>", "p.features", "earthquake", "r.id", "earthquake", {"magnitude": "r.properties.mag", "place": "r.properties.place", "lon": "try_element_at(r.geometry.coordinates, 1)", "lat": "try_element_at(r.geometry.coordinates, 2)", "depth": "try_element_at(r.geometry.coordinates, 3)"}, "r.properties.place", "coalesce(r.properties.time / 1000, fetched_at)"),
    Spec("bankruptcy_court", "struct<entries:array<struct<debtor_name:string,chapter:string,court:string,case_number:string,pub_date:string>>>", "p.entries", "company", "nullif(trim(r.debtor_name), '')", "bankruptcy_status", {"source": "'pacer'", **same("chapter", "court", "case_number", "pub_date")}),
    Spec("energy_supply", "struct<series:array<struct<name:string,values:array<struct<period:string,value:double>>>>>", "p.series", "energy_series", "r.name", "petroleum_inventory", {"latest": "try_element_at(r.values, -1).value", "period": "try_element_at(r.values, -1).period", "periods": "size(r.values)"}),
    Spec("defi_flows", "struct<protocols:array<struct<name:string,chain:string,chains:array<string>,category:string,tvl_usd:double,change_1d_pct:double,change_7d_pct:double>>>", "p.protocols", "protocol", "lower(trim(r.name))", "tvl_change", same("tvl_usd", "chain", "chains", "category", "change_1d_pct", "change_7d_pct"), "r.name", alias="protocol_name"),
    Spec("academic_preprints", "struct<trials:array<struct<sponsor:string,nct_id:string,title:string,status:string,conditions:array<string>>>>", "p.trials", "company", "nullif(trim(r.sponsor), '')", "research_velocity", {"source": "'clinicaltrials'", **same("nct_id", "title", "status", "conditions")}),
    Spec("academic_preprints", "struct<papers:array<struct<id:string,title:string,categories:array<string>,published:string>>>", "p.papers", "research_field", "try_element_at(r.categories, 1)", "research_velocity", {"source": "'arxiv'", "paper_id": "r.id", "title": "r.title"}, time=at(DAY, "r.published")),
    Spec("consumer_sentiment", "struct<countries:array<struct<geo:string,value:double,period:string,mom_change:double,trend:string,consecutive_decline:bigint>>>", "p.countries", "country", "if(length(r.geo) = 2, r.geo, null)", "consumer_confidence", {"mode": "'eu_confidence'", "source": "'eurostat'", "latest": "r.value", **same("period", "mom_change", "trend", "consecutive_decline")}),
    Spec("consumer_sentiment", "struct<sentiment:struct<sentiment_latest:double,sentiment_date:string,sentiment_mom:double,sentiment_alert:string,inflation_exp_1yr:double,inflation_anchor:string>>", "array_compact(array(p.sentiment))", "country", "'US'", "consumer_confidence", {"mode": "'us_sentiment'", "source": "'fred'", "latest": "r.sentiment_latest", "period": "r.sentiment_date", "mom_change": "r.sentiment_mom", "trend": "r.sentiment_alert", **same("inflation_exp_1yr", "inflation_anchor")}),
    Spec("creditor_filings", "struct<filings:array<struct<company:string,cik:string,form:string,file_date:string,items:array<string>>>>", "p.filings", "company", "coalesce(r.cik, trim(r.company))", "creditor_filing", {"cik": "r.cik", "form": "coalesce(r.form, '8-K')", "file_date": "r.file_date", "items": "r.items"}, "r.company", at(DAY, "r.file_date")),
    Spec("creditor_filings", "struct<company_name:string,charges:array<struct<charge_code:string,status:string,created_on:string,holders:array<string>>>>", "p.charges", "company", "nullif(trim(p.company_name), '')", "creditor_filing", {"form": "'charge'", **same("charge_code", "status", "created_on")}, time=at(DAY, "r.created_on"), links=(Link("debtor_of", "company", "explode_from:r.holders"),)),
    Spec("disease_surveillance", "struct<wastewater:struct<pathogen:string,total_samples:bigint,states_count:bigint,hot_states:array<string>,surge_count:bigint>>", "array_compact(array(p.wastewater))", "country", "'US'", "pathogen_level", {"mode": "'wastewater'", **same("pathogen", "total_samples", "states_count", "hot_states", "surge_count")}),
    Spec("disease_surveillance", "struct<outbreaks:array<struct<country:string,disease:string,title:string,date:string>>>", "p.outbreaks", "country", "nullif(trim(r.country), '')", "pathogen_level", {"mode": "'outbreaks'", **same("disease", "title")}, time=at(DAY, "r.date")),
    Spec("dividend_data", "struct<ticker:string,dividends:array<struct<date:string,amount:double>>>", "p.dividends", "instrument", "upper(p.ticker)", "dividend", {"amount": "r.amount", "ex_date": "r.date"}, time=at(DAY, "r.date")),
    Spec("dns_monitor", "struct<domain:string,analysis:struct<cloud_providers:array<string>,mx_provider:string,ns_provider:string,min_ttl:bigint,low_ttl_warning:boolean,record_count:bigint>>", "array_compact(array(p.analysis))", "domain", "p.domain", "dns_change", same("cloud_providers", "mx_provider", "ns_provider", "min_ttl", "low_ttl_warning", "record_count"), alias="domain_name", links=(OWNER,)),
    Spec("drug_regulatory", "struct<records:array<struct<sponsor_name:string,application_number:string,brands:array<string>,latest_submission_type:string,latest_submission_date:string,review_priority:string>>>", "p.records", "company", "nullif(trim(r.sponsor_name), '')", "drug_approval", {"application_number": "r.application_number", "brand_names": "r.brands", "submission_type": "r.latest_submission_type", "submission_date": "r.latest_submission_date", "review_priority": "r.review_priority"}, time="coalesce(unix_timestamp(try_to_timestamp(r.latest_submission_date, 'yyyyMMdd')), fetched_at)", links=(Link("market_authorized_in", "country", "'US'"),)),
    Spec("electricity_monitor", "struct<region:string,region_name:string,mode:string>", "array(named_struct('x', 1))", "organization", "p.region", "grid_demand", {"mode": "p.mode", "region": "p.region", "region_name": "coalesce(p.region_name, p.region)"}),
    Spec("finra_short_volume", "struct<records:array<struct<symbol:string,settlement_date:string,short_volume:double,total_volume:double,short_ratio:double,days_to_cover:double>>>", "p.records", "instrument", "upper(r.symbol)", "short_interest", same("short_volume", "total_volume", "short_ratio", "days_to_cover"), time=at(DAY, "r.settlement_date")),
    Spec("food_security", "struct<country:string,mode:string,indicator:string,latest_value:double,latest_year:int,signals:struct<yoy_change_pct:double,trend_direction:string,consecutive_years:bigint,stress_alert:boolean,vulnerability:string>>", "array_compact(array(p.signals))", "country", "p.country", "food_security", {"mode": "p.mode", "indicator": "p.indicator", "latest_value": "p.latest_value", "latest_year": "p.latest_year", **same("yoy_change_pct", "trend_direction", "consecutive_years", "stress_alert", "vulnerability")}),
    Spec("gov_contracts", "struct<awards:array<struct<recipient:string,award_id:string,amount_usd:double,agency:string,award_type:string,country:string,date:string>>>", "p.awards", "company", "nullif(trim(r.recipient), '')", "contract_award", same("award_id", "amount_usd", "agency", "award_type", "country"), time=at(DAY, "r.date"), links=(Link("operates_in", "country", "r.country"), Link("awarded_by", "organization", "r.agency"))),
    history("instrument_return", {"log_return": "try_element_at(r.returns, -1)", "close": "r.latest.close"}, "size(r.returns) > 0"),
    history("instrument_volume", {"volume": "coalesce(r.latest.volume, 0D)", "avg_volume_20d": MEAN.format("r.volumes")}),
    history("instrument_volatility", {"realized_vol_20d": f"{DEVIATION} * sqrt(252)", "intraday_range": "coalesce(r.latest.high, r.latest.close) - coalesce(r.latest.low, r.latest.close)"}, "size(r.returns) > 1"),
    Spec("instrument_universe", MASTER, "p.instruments", "instrument", "upper(r.ticker)", "", {}, links=(
        Link("tracks_issuer", "company", "trim(r.issuer)", 1.0), Link("located_in", "country", "r.country", 1.0), Link("fx_base_country", "country", "r.base_country", 1.0), Link("fx_quote_country", "country", "r.quote_country", 1.0),
        Link("tracks_protocol", "protocol", "r.protocol", 1.0), Link("exchange_country", "country", "r.exchange_country", 1.0))),
    Spec("instrument_universe", MASTER, "p.instruments", "company", "nullif(trim(r.issuer), '')", "", {}, links=(Link("located_in", "country", "r.country", 1.0),)),
    Spec("energy_supply", "struct<rigs:array<struct<period:string,value:double,units:string>>>", "p.rigs", "energy_series", "if(trim(r.period) <> '', 'rig_count', null)", "rig_count", {"mode": "'rig_count'", "period": "trim(r.period)", **same("value", "units")}, time=at(DAY, "concat(trim(r.period), '-01')")),
    Spec("instrument_universe", "struct<bars:array<struct<ticker:string,date:string,close:double,log_return:double,volume:double>>>", "p.bars", "instrument", "upper(r.ticker)", "instrument_daily", same("close", "log_return", "volume"), time=at(DAY, "r.date")),
    Spec("interconnection_queue", "struct<projects:array<struct<entity_name:string,plant_name:string,nameplate_capacity_mw:double,energy_source_code:string,state:string,status:string,technology:string>>>", "p.projects", "company", "nullif(trim(r.entity_name), '')", "project_status", same("plant_name", "nameplate_capacity_mw", "energy_source_code", "state", "status", "technology"), links=(Link("located_in", "country", "'US'"),)),
    Spec("options_chain", "struct<ticker:string,summary:struct<spot:double,atm_iv:double,put_call_oi:double,total_oi:double>,observed_at:double>", "array_compact(array(p.summary))", "instrument", "upper(p.ticker)", "options_chain_eod", same("spot", "atm_iv", "put_call_oi", "total_oi"), time="coalesce(p.observed_at, fetched_at)"),
    Spec("regulatory_gazette", "struct<mode:string,agencies:array<struct<key:string,name:string,doc_count:bigint,significant_count:bigint,types:array<string>>>>", "p.agencies", "organization", "r.key", "regulatory_velocity", {"mode": "p.mode", "name": "r.name", "doc_count": "r.doc_count", "significant_count": "r.significant_count", "types": "array_sort(r.types)"}, "r.name"),
    Spec("nightlight_activity", "struct<zones:array<struct<zone:string,total_frp:double,hotspots:bigint,mean_brightness:double,high_share:double>>>", "p.zones", "zone", "r.zone", "zone_activity", same("total_frp", "hotspots", "mean_brightness", "high_share")),
]


def parsed(landing: DataFrame, spec: Spec) -> DataFrame:
    """One row per record with a key: r, p, fetched_at, key."""
    p = landing.where(F.col("source") == spec.source).select("fetched_at", F.from_json("data", spec.payload).alias("p")).where("p is not null")
    r = p.select("fetched_at", "p", F.explode(F.expr(spec.records)).alias("r"))
    return r.where(F.expr(spec.where)).withColumn("key", F.expr(f"cast({spec.key} as string)")).where("key is not null and key <> ''")


def observations(landing: DataFrame, specs: list[Spec]) -> DataFrame:
    """The observation rows of all specs that have a type of observation, in OBSERVATION's columns."""
    specs = [s for s in specs if s.observation_type]

    def one(spec: Spec) -> DataFrame:
        value = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in spec.value.items()]))
        return parsed(landing, spec).select(
            entity_key(F.lit(spec.entity_type), F.col("key")).alias("entity_id"), F.lit(spec.entity_type).alias("entity_type"), F.col("key").alias("entity_key"), F.expr(spec.name or "key").alias("name"),
            F.lit(spec.source).alias("source"), F.lit(spec.observation_type).alias("observation_type"), F.expr(f"cast({spec.time} as double)").alias("observed_at"), value.alias("value_json"),
        )

    out = one(specs[0])
    for spec in specs[1:]:
        out = out.unionByName(one(spec))
    return out


def entities(obs: DataFrame) -> DataFrame:
    """The first name of each entity, by time."""
    return obs.groupBy("entity_id", "entity_type").agg(F.min_by("name", F.struct("observed_at", "name")).alias("name"))


def aliases(landing: DataFrame, specs: list[Spec]) -> DataFrame:
    named = [s for s in specs if s.alias]
    parts = [parsed(landing, s).select(entity_key(F.lit(s.entity_type), F.col("key")).alias("entity_id"), F.lit(s.alias).alias("alias_source"), F.col("key").alias("external_id")) for s in named]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def links(landing: DataFrame, specs: list[Spec], lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Distinct links, never from an entity to itself. lookups: tables of (code, target) by name; links whose table isn't given are left out.

    An entity meets a target of one code only once, so such pairs, where they are all of their kind, are distinct as they are and not shuffled. They
    are made from packs of entities and targets of one code.
    """
    used = [(s, k) for s in specs for k in s.links if not k.lookup or k.lookup in (lookups or {})]
    kinds = [k.kind for _, k in used]
    loose, apart = [], []
    for s, k in used:
        many = k.to_key.startswith("explode_from:")
        to = F.explode(F.expr(k.to_key.removeprefix("explode_from:"))) if many else F.expr(k.to_key)
        part = parsed(landing, s).select(entity_key(F.lit(s.entity_type), F.col("key")).alias("entity_a"), to.alias("to")).where("to is not null and to <> ''")
        named = lambda rows, k=k: rows.select("entity_a", "entity_b", F.lit(k.kind).alias("link_type"), F.lit(k.confidence).alias("confidence")).where("entity_a <> entity_b")
        if not k.lookup:
            pairs = part.select("entity_a", entity_key(F.lit(k.to_type), F.col("to")).alias("entity_b"))
            apart.append(named(pairs.distinct())) if kinds.count(k.kind) == 1 else loose.append(named(pairs))
            continue
        part = written(part.distinct(), "link-sides")
        targets = lookups[k.lookup].select(F.col("code").alias("to"), entity_key(F.lit(k.to_type), F.col("target")).alias("entity_b")).where("to is not null").distinct()
        codes = targets.groupBy("entity_b").agg(F.min("to").alias("to"), F.count("*").alias("codes"))
        once, several = codes.where("codes = 1").drop("codes"), targets.join(codes.where("codes > 1").select("entity_b"), "entity_b", "left_semi")
        (apart if kinds.count(k.kind) == 1 else loose).append(named(all_pairs(part, once, "to", "entity_a", "entity_b")))
        loose.append(named(part.join(several, "to")))
    if not used:
        return landing.sparkSession.createDataFrame([], "entity_a string, entity_b string, link_type string, confidence double")
    return reduce(DataFrame.union, [*([reduce(DataFrame.union, loose).distinct()] if loose else []), *apart])
