"""The file readers on small files with malformed rows."""

import json

import pytest

from tessella.sources import files


@pytest.fixture
def put(tmp_path):
    def f(name: str, text: str) -> str:
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return f


def test_events(spark, put):
    row = [""] * 61
    for name, v in {"event_id": "9", "day": "20240102", "actor1_country": "USA", "event_root": "19", "quad_class": "4", "goldstein": "-10.0", "num_mentions": "x", "lat": "1.5"}.items():
        row[files.EVENT_FIELDS[name]] = v
    got = files.read_tsv_event_batches(spark, put("e.tsv", "\t".join(row) + "\nshort\tline\n\n")).collect()
    assert len(got) == 1
    assert (got[0].event_id, got[0].quad_class, got[0].goldstein, got[0].num_mentions, got[0].actor1_name, got[0].lat) == ("9", 4, -10.0, None, None, 1.5)


def test_positioning(spark, put):
    heads = ["Market_and_Exchange_Names", "Open_Interest_All", "Pct_of_OI_X", *[f"C{i}" for i in range(20)]]
    text = ",".join(heads) + "\n" + ",".join(['"WHEAT, CHI"', " 100 ", " 1.5", *["7"] * 20]) + "\nshort,1\n" + ",".join(["CORN", ".", ".", *["8"] * 20]) + "\n"
    got = files.read_positioning_csv(spark, put("p.csv", text)).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("WHEAT, CHI", 100, 1.5, 7), ("CORN", None, None, 8)]


def test_filings(spark, put):
    t = lambda code, n: f"<nonDerivativeTransaction><transactionDate><value>2024-01-0{n}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}00</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"
    doc = f"<ownershipDocument><issuer><issuerCik>1</issuerCik><issuerName>Acme</issuerName><issuerTradingSymbol>acm</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik><rptOwnerName>Doe J</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{t('P', 1)}{t('S', 2)}{t('P', 3)}</nonDerivativeTable></ownershipDocument>"
    got = files.read_filing_xml(spark, put("f.xml", doc)).orderBy("date").collect()
    assert [(r.ticker, r.name, r.role, r.shares, r.price, r.date) for r in got] == [("ACM", "Doe J", "CEO", 100.0, 2.5, "2024-01-01"), ("ACM", "Doe J", "CEO", 300.0, 2.5, "2024-01-03")]


def test_sale_notices(spark, put):
    doc = lambda who: f"<edgarSubmission><formData><issuerInfo><issuerName>Acme</issuerName>{who}</issuerInfo><securitiesInformation><noOfUnitsSold>50</noOfUnitsSold><aggregateMarketValue>1000.5</aggregateMarketValue><approxSaleDate>03/01/2024</approxSaleDate></securitiesInformation></formData></edgarSubmission>"
    person = "<nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold>Jo Roe</nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold>"
    put("a.xml", doc(person))
    path = put("b.xml", doc(""))
    got = files.read_sale_notice_xml(spark, path.replace("b.xml", "*.xml")).collect()
    assert [(r.insider, r.shares, r.value, str(r.sale_date), r.outstanding) for r in got] == [("Jo Roe", 50, 1000.5, "2024-03-01", 0)]


def test_sanctions_csv(spark, put):
    rows = '36,"AERO, SA",-0- ,"CUBA] [SDGT",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"a.k.a. \'AEROX\'; nationality Cuban;"\nEOF,,,,,,,,,,,\n37,DOE,individual,SDN,,,,,,,,\n'
    got = files.read_sanctions_csv(spark, put("s.csv", rows)).orderBy("entity_id").collect()
    assert [(r.name, r.type, r.programs, r.aliases, r.nationality) for r in got] == [("AERO, SA", "entity", ["CUBA", "SDGT"], ["AEROX"], "Cuban"), ("DOE", "individual", ["SDN"], [], None)]


def test_sanctions_xml(spark, put):
    doc = "<LIST><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>A</FIRST_NAME><THIRD_NAME>C</THIRD_NAME><UN_LIST_TYPE>X</UN_LIST_TYPE><NATIONALITY><VALUE>Y</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><ALIAS_NAME>Z</ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL><INDIVIDUAL><FIRST_NAME>no id</FIRST_NAME></INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Org</FIRST_NAME></ENTITY></ENTITIES></LIST>"
    got = files.read_sanctions_xml(spark, put("u.xml", doc)).orderBy("entity_id").collect()
    assert [(r.name, r.type, r.programs, r.nationality, r.aliases) for r in got] == [("A C", "individual", ["X"], "Y", ["Z"]), ("Org", "entity", [], None, [])]


def test_yields(spark, put):
    doc = "<feed><entry><content><properties><NEW_DATE>2024-03-01T00:00:00</NEW_DATE><BC_3MONTH>5.4</BC_3MONTH><BC_2YEAR>4.5</BC_2YEAR><BC_10YEAR>4.2</BC_10YEAR></properties></content></entry></feed>"
    r = files.read_yield_xml(spark, put("y.xml", doc)).first()
    assert (r.date, r.yields, r.curve_2s10s, r.curve_3m10y) == ("2024-03-01", {"3m": 5.4, "2y": 4.5, "10y": 4.2}, -0.3, -1.2)


def test_sdmx(spark, put):
    got = files.read_sdmx_csv(spark, put("x.csv", "KEY,TIME_PERIOD,OBS_VALUE\nA,2024-01,1.5\nA,2024-02,\nA,,2\n")).collect()
    assert [tuple(r) for r in got] == [("2024-01", 1.5)]


def test_jsonstat(spark, put):
    cube = {"id": ["freq", "geo", "time"], "size": [1, 2, 3], "value": {"0": 1.0, "2": 3.0, "4": 5.0}, "dimension": {"freq": {"category": {"index": {"M": 0}}}, "geo": {"category": {"index": {"DE": 0, "FR": 1}}}, "time": {"category": {"index": {"2024-01": 0, "2024-02": 1, "2024-03": 2}}}}}
    got = {(r.codes["geo"], r.codes["time"]): r.value for r in files.read_jsonstat(spark, put("c.json", json.dumps(cube))).collect()}
    assert got == {("DE", "2024-01"): 1.0, ("DE", "2024-03"): 3.0, ("FR", "2024-02"): 5.0}


def test_feed(spark, put):
    doc = "<rss><channel><item><title>24-10001 Acme Corp</title><link>http://x</link><description>Voluntary petition Chapter: 11</description><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item><item><title>Acme</title></item></channel></rss>"
    got = files.read_feed(spark, put("r.xml", doc)).collect()
    assert [(r.case_number, r.debtor, r.chapter, str(r.published)) for r in got] == [("24-10001", "Acme Corp", "11", "2024-03-01 10:00:00"), ("", "Acme", None, "None")]


def test_fires(spark, put):
    got = files.read_fire_csv(spark, put("h.csv", "latitude,longitude,brightness,confidence,frp,acq_date,acq_time\n1,2,300.5,80,12.5,2024-03-01,0100\nx,2,300,80,1,d,t\n1,2,300,n,1,d,t\n")).collect()
    assert [tuple(r)[:5] for r in got] == [(1.0, 2.0, 300.5, 80, 12.5)]


def test_feed_chapters_in_all_spellings(spark, put):
    texts = ["Ch. 11 Voluntary Petition", "chapter: 7", "Petition under CH 13", "Chap. 12", "ch.9 filing", "Church 11", "research 11 of it", "Chapter eleven", "ch 2024"]
    doc = "<rss><channel>" + "".join(f"<item><title>24-{i} Debtor {i}</title><description>{t}</description></item>" for i, t in enumerate(texts)) + "</channel></rss>"
    got = {r.case_number: r.chapter for r in files.read_feed(spark, put("feed.xml", doc)).collect()}
    assert got == {"24-0": "11", "24-1": "7", "24-2": "13", "24-3": "12", "24-4": "9", "24-5": None, "24-6": None, "24-7": None, "24-8": None}
