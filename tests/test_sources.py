import json

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from eventlab.schemas import RAW_PRICES
from eventlab.sources import csvfiles as CF
from eventlab.sources import html as H
from eventlab.sources import prices as PR
from eventlab.sources import tables as TB
from eventlab.streaming import ingest as I

HEADER = "date,open,high,low,close,adjusted_close,volume\n"


@pytest.fixture
def price_dir(tmp_path):
    folder = tmp_path / "prices"
    folder.mkdir()
    (folder / "ZEPH.csv").write_text(HEADER + "2031-05-05,32,48,24,40,10,700\n2031-05-06,12,13,11,12,12,\n")
    (folder / "QUOK.csv").write_text(HEADER + "2031-05-05,3,4,2,3,3,9\n")
    (folder / "EMPTY.csv").write_text("")
    (folder / "notes.txt").write_text("not prices")
    return str(folder)


def test_price_panel(spark, price_dir):
    got = rows(PR.price_panel(spark, price_dir).select("symbol", "date", "open", "high", "low", "close", "volume"), "symbol", "date")
    assert got[1] == ("ZEPH", day("2031-05-05"), 8.0, 12.0, 6.0, 10.0, 700.0)
    assert got[2][-2:] == (12.0, None)
    assert [r[0] for r in got] == ["QUOK", "ZEPH", "ZEPH"]


def test_columns_are_found_by_name(spark, tmp_path):
    """Another order, unknown columns, missing ones, quotes, capitals, blank first lines, odd file names."""
    folder = tmp_path / "mixed"
    (folder / "symbol=IN.F").mkdir(parents=True)
    (folder / "AAA.csv").write_text("date,close,open,high,low,volume,adjusted_close\n2031-05-05,40,32,48,24,700,10\n")
    (folder / "B B.csv").write_text('\n"Volume", open ,"date",note,adjusted_close,HIGH,low,close\n9,3,2031-05-06,"a, b",3,4,2,3\n')
    (folder / "C[1].csv").write_text("open,date\n5,2031-05-07\n")  # no close, adjusted or not
    (folder / "D.csv").write_text("adjusted_close,date,open\n7,2031-05-08,6\n")  # nothing to scale by
    (folder / "E.csv").write_text("open,close\n1,2\n")  # no date
    (folder / "F.csv").write_text("date,open,high,low,close,adjusted_close,volume\n")
    (folder / "G.csv").write_text("")
    (folder / "H.csv").write_text("\ufeffdate,date,adjusted_close,close\n2031-05-09,2031-01-01,8,16\n")
    (folder / "symbol=IN.F" / "part-1.csv").write_text("low,date\n,2031-05-10\n")
    got = rows(PR.price_panel(spark, str(folder)).select("symbol", "open", "high", "low", "close", "volume", "date"), "symbol")
    assert got == [
        ("AAA", 8.0, 12.0, 6.0, 10.0, 700.0, day("2031-05-05")),
        ("B B", 3.0, 4.0, 2.0, 3.0, 9.0, day("2031-05-06")),
        ("C[1]", 5.0, None, None, None, None, day("2031-05-07")),
        ("D", 6.0, None, None, 7.0, None, day("2031-05-08")),
        ("H", None, None, None, 8.0, None, day("2031-05-09")),
        ("IN.F", None, None, None, None, None, day("2031-05-10")),
    ]
    unread = PR.unread_price_files(spark, str(folder)).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["missing"], r["header"]) for r in unread] == [("E.csv", ["date"], "open,close")]
    raw = PR.raw_price_files(spark, str(folder))
    assert raw.columns == [*RAW_PRICES.names, "symbol"] and raw.count() == 6
    (tmp_path / "none").mkdir()
    assert PR.price_panel(spark, str(tmp_path / "none")).count() == 0


def test_one_scan_for_each_layout(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(12):
        columns = "date,open,adjusted_close,close" if i % 2 else "close,extra,open,date"
        values = "2031-05-05,1,2,2" if i % 2 else "2,x,1,2031-05-05"
        (folder / f"S{i}.csv").write_text(f"{columns}\n{values}\n")
    assert len(CF.scans(spark, str(folder), RAW_PRICES, ["date"])) == 2
    panel = PR.price_panel(spark, str(folder))
    assert panel.where("open = 1").count() == 12
    plan = panel.select("symbol", "open")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2


def test_tables_are_read_by_name(spark, tmp_path):
    path = tmp_path / "changes.csv"
    path.write_text("removed_ticker,date,seq,reason\nOLD,2031-02-03,4,size\n,2031-02-04,5,\n")
    assert rows(TB.read_changes(spark, str(path)), "seq") == [(4, day("2031-02-03"), None, "OLD"), (5, day("2031-02-04"), None, None)]
    earnings = tmp_path / "e.csv"
    earnings.write_text("surprise_pct,earnings_date,symbol\n5.5,2031-01-02 08:00:00+00:00,AA\n")
    assert rows(TB.earnings_clean(TB.read_raw_earnings(spark, str(earnings))), "date") == [("AA", day("2031-01-02"), None, None, 5.5)]


def test_duplicate_bars_are_found(spark, price_dir):
    panel = PR.price_panel(spark, price_dir)
    assert PR.require_unique_bars(panel) is panel
    with pytest.raises(ValueError, match="ZEPH|QUOK"):
        PR.require_unique_bars(panel.union(panel))


def test_json_prices(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    bars = [{"date": "2024-01-02", "open": 1.0, "close": 2.0, "extra": 1}, {"date": "2024-01-03", "warning": "limited"}]
    (folder / "A.json").write_text(json.dumps(bars))
    got = PR.landed_prices_json(spark, str(folder))
    assert "extra" not in got.columns
    assert [r["warning"] for r in got.orderBy("date").collect()] == [None, "limited"]


def test_missing_symbols(spark):
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    loaded = spark.createDataFrame([("A",), ("A",)], "symbol string")
    assert [r["symbol"] for r in PR.missing_symbols(wanted, loaded).collect()] == ["B"]
    assert tuple(PR.ingest_progress(wanted, loaded).first()) == (2, 1)


def test_sec_documents(spark):
    lookup = spark.createDataFrame(
        [('{"0": {"ticker": "A", "cik_str": 1, "title": "x"}, "1": {"ticker": "B", "cik_str": 2}}',)], "value string"
    )
    assert rows(TB.cik_lookup(lookup), "symbol") == [("A", 1), ("B", 2)]
    documents = spark.createDataFrame([(1, '{"name": "Aye", "sicDescription": "Steel"}'), (2, '{"name": "Bee", "sicDescription": ""}')], "cik bigint, value string")
    assert rows(TB.sec_submissions(documents), "cik") == [(1, "Steel", None, "Aye")]


def test_earnings_dates_are_utc_days(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("symbol,earnings_date,eps_estimate,reported_eps,surprise_pct\nA,2024-01-02 22:30:00-05:00,1.0,,\nA,2024-04-02 08:00:00+00:00,1.0,1.1,NaN\n")
    got = rows(TB.earnings_clean(TB.read_raw_earnings(spark, str(path))), "date")
    assert got == [("A", day("2024-01-03"), 1.0, None, None), ("A", day("2024-04-02"), 1.0, 1.1, None)]
    empty = TB.earnings_clean(TB.read_raw_earnings(spark, str(path)).limit(0))
    assert empty.columns == ["symbol", "date", "eps_estimate", "reported_eps", "surprise_pct"] and empty.count() == 0


CONSTITUENTS = """<html><table><tr><th>Menu</th></tr><tr><td>x</td></tr></table>
<TABLE class="w"><tbody><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>
<tr><td><a href="/z">ZE.P</a></td><td>Zephyr &amp; Sons</td><td>Shipping</td><td>Sails</td></tr>
<tr><td>QUOK
</td><td>Quokka<script>var t = "</td>";</script></td><td>Leisure</td><td>Zoos</td></tr><tr><td></td><td>blank</td><td>x</td><td>y</td></tr></tbody></TABLE></html>"""
CHANGES = """<table><tr><th>Date</th><th>Added Ticker</th><th>Added Security</th><th>Removed Ticker</th><th>Removed Security</th><th>Reason</th></tr>
<tr><td>May 6, 2031</td><td>NARW</td><td>N</td><td>TAPR</td><td>T</td><td>size</td></tr>
<tr><td>2030-01-31</td><td></td><td></td><td>OLD.K</td><td>O</td><td>merger</td></tr></table>"""
TWO_LEVELS = """<table>
<tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan="2">Reason</th></tr>
<tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>
<tr><td rowspan="2">June 3, 2030</td><td>NARW</td><td>Narwhal <table><tr><td>inner</td></tr></table> plc</td><td>TAPR</td><td>Tapir</td><td rowspan="3">size</td></tr>
<tr><td>IBIS</td><td>Ibis</td><td colspan="2"></td></tr>
<tr><td>soon</td><td>EMUU</td><td>Emu</td><td>KIWI</td><td>Kiwi</td></tr></table>"""


def pages(spark):
    return spark.createDataFrame([("c", CONSTITUENTS), ("h", CHANGES), ("bad", "<html><p>soon</p></html>")], "url string, html string")


def test_constituents_are_found_by_their_header(spark):
    got = rows(H.current_constituents(pages(spark)).select("url", "symbol", "sector", "name"), "symbol")
    assert got == [("c", "QUOK", "Leisure", "Quokka"), ("c", "ZE-P", "Shipping", "Zephyr & Sons")]


def test_changes_page(spark):
    got = rows(H.membership_changes(pages(spark)).select("seq", "date", "added_ticker", "removed_ticker"), "seq")
    assert got == [(1, day("2031-05-06"), "NARW", "TAPR"), (2, day("2030-01-31"), None, "OLD-K")]


def test_headers_of_two_rows_and_spans(spark):
    page = spark.createDataFrame([("t", TWO_LEVELS)], "url string, html string")
    got = rows(H.changes_with_errors(page).select("seq", "date", "added_ticker", "removed_ticker", "unreadable"), "seq")
    june = day("2030-06-03")
    assert got == [(1, june, "NARW", "TAPR", False), (2, june, "IBIS", None, False), (3, None, "EMUU", "KIWI", True)]
    assert H.membership_changes(page).count() == 2
    first = H.html_table_rows(page, ["Ticker"]).orderBy("row_number").first()
    assert first["header"] == ["Date", "Added Ticker", "Added Security", "Removed Ticker", "Removed Security", "Reason"]
    assert first["cells"] == ["June 3, 2030", "NARW", "Narwhal inner plc", "TAPR", "Tapir", "size"]
    assert [r["cells"][5] for r in H.html_table_rows(page, ["Ticker"]).collect()] == ["size"] * 3


def test_odd_pages(spark):
    cases = {"null": None, "empty": "", "open": "<table><tr><td>Symbol<td>x<tr><td>ABCD<td>y", "none": "<td>Symbol</td>", "span": "<table><tr><th>Symbol</th></tr><tr><td rowspan=0 colspan=x>EFGH</td></tr></table>"}
    page = spark.createDataFrame(list(cases.items()), "url string, html string")
    assert rows(H.current_constituents(page).select("url", "symbol"), "url") == [("open", "ABCD"), ("span", "EFGH")]


def test_pages_without_the_table(spark):
    assert [r["url"] for r in H.pages_without_table(pages(spark), ["Symbol"]).orderBy("url").collect()] == ["bad", "h"]
    assert tuple(H.quality_gate(pages(spark), ["Ticker", "Date"]).first()) == (3, 1, 2)
    with pytest.raises(ValueError, match="bad"):
        H.require_table(pages(spark).where("url <> 'h'"), ["Symbol"])


def test_every_page_of_a_repeated_url_counts(spark):
    twice = spark.createDataFrame([("u", CONSTITUENTS), ("u", "<p>later</p>"), (None, "")], "url string, html string")
    assert tuple(H.quality_gate(twice, ["Symbol"]).first()) == (3, 1, 2)
    assert sorted(str(r["url"]) for r in H.pages_without_table(twice, ["Symbol"]).collect()) == ["None", "u"]


def test_feature_files(spark, tmp_path, small_dir):
    from eventlab.sources import market as K

    features = K.features(spark, small_dir)
    TB.feature_sink(features, str(tmp_path / "f"))
    again = TB.read_features(spark, str(tmp_path / "f"))
    assert again.select(*features.columns).exceptAll(features).count() == 0
    TB.feature_csv(features, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == features.count()


def test_price_stream_ingests_each_file_once(spark, price_dir, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    I.ingest_price_files(spark, price_dir, target, checkpoint)
    assert I.ingested(spark, target).count() == 3
    I.ingest_price_files(spark, price_dir, target, checkpoint)
    assert I.ingested(spark, target).count() == 3
    (tmp_path / "prices" / "NEW.csv").write_text(HEADER + "2024-01-02,1,1,1,1,1,1\n")
    I.ingest_price_files(spark, price_dir, target, checkpoint)
    got = I.ingested(spark, target)
    assert got.count() == 4
    assert {r["symbol"] for r in got.select("symbol").distinct().collect()} == {"QUOK", "ZEPH", "NEW"}
    assert set(RAW_PRICES.names) < set(got.columns)


class FakeSession:
    """A session as far as storage looks at it; spark.checkpoint.dir is fixed at start-up."""

    def __init__(self, master, folder=None):
        from types import SimpleNamespace

        self.conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        self.sparkContext = SimpleNamespace(master=master)


def test_scratch_follows_the_session_setting():
    from eventlab import storage

    cluster = FakeSession("yarn", "hdfs://shared/scratch/")
    assert storage.scratch(cluster, "x").startswith("hdfs://shared/scratch/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch(FakeSession("yarn"), "x")
    local = FakeSession("local[2]")
    assert storage.scratch(local, "x") != storage.scratch(local, "x")


def test_nan_prices_become_null(spark, tmp_path):
    (tmp_path / "N.csv").write_text(HEADER + "2024-01-02,NaN,1,1,1,1,1\n")
    assert PR.raw_price_files(spark, str(tmp_path)).select(F.col("open").isNull().alias("n")).first()["n"]


def test_a_folder_of_one_arrangement_stands_for_its_files(spark, tmp_path):
    """Only different headers and folders pass through the driver; a file of another arrangement is named itself."""
    from eventlab.schemas import RAW_PRICES
    from eventlab.sources import csvfiles as CF

    for i in range(6):
        for folder, header, line in (("a", "date,close", f"2020-01-0{i + 1},{i}"), ("b", "close,date", f"{i},2020-02-0{i + 1}")):
            (tmp_path / folder / f"symbol={i}").mkdir(parents=True)
            (tmp_path / folder / f"symbol={i}" / "x.csv").write_text(f"{header}\n{line}\n")
    (tmp_path / "b" / "symbol=9").mkdir()
    (tmp_path / "b" / "symbol=9" / "x.csv").write_text("open,close\n1,2\n")
    groups = CF._arranged(spark, str(tmp_path), RAW_PRICES, {"date"}, "*.csv")
    named = sorted(len(paths) for paths in groups.values())
    assert named == [1, 6] and any(paths[0].endswith("/a") for paths in groups.values())
    found = CF.read_by_name(spark, str(tmp_path), RAW_PRICES, ["date"], "*.csv").collect()
    assert sorted((str(r["date"]), r["close"]) for r in found) == sorted([(f"2020-01-0{i + 1}", i) for i in range(6)] + [(f"2020-02-0{i + 1}", i) for i in range(6)])
