"""Queries that land files in shared scratch storage and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.sources import html as H
from eventlab.sources import market as K
from eventlab.sources import prices as PR
from eventlab.sources import tables as TB
from eventlab.storage import scratch, stored
from eventlab.streaming import ingest as I

from .ctes import with_ctes
from .panel import FEATURE_COLUMNS
from .shape import r6, r6_all, tidy

CIK_CHUNK = 50
ROWS_PER_PAGE = 20


#: Columns of landed price files, by the symbol's remainder: as declared, in another order, with unknown columns
#: between them, and without a volume.
LAYOUTS = [
    ["date", "open", "high", "low", "close", "adjusted_close", "volume"],
    ["volume", "low", "high", "date", "adjusted_close", "close", "open"],
    ["exchange", "close", "date", "open", "split", "adjusted_close", "high", "low", "volume"],
    ["open", "date", "high", "close", "low", "adjusted_close"],
]


#: Tasks put their files into place themselves; by default the driver moves them one by one. The folder is new, and a
#: repeated task writes the same names.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _landed_bars(spark, sf):
    """Raw bars as CSVs of four layouts, several files each, with symbols whose files lack the date."""
    path = scratch(spark, "prices")
    raw = stored(K.raw_prices(spark, sf).withColumns({"exchange": F.lit("X, Y"), "split": F.lit(1)}), "bars")
    for i, layout in enumerate(LAYOUTS):
        bars = raw.where(F.col("symbol") % len(LAYOUTS) == i).select(*layout, "symbol")
        bars.repartition("symbol").write.partitionBy("symbol").options(**BY_TASKS).option("header", True).csv(f"{path}/layout-{i}")
    undated = raw.where(F.col("symbol") % 5 == 0).select("open", "close", (-F.col("symbol")).alias("symbol"))
    undated.repartition("symbol").write.partitionBy("symbol").options(**BY_TASKS).option("header", True).csv(f"{path}/undated")
    return path


def price_panel(spark, sf):
    panel = PR.price_panel(spark, _landed_bars(spark, sf))
    return tidy(panel.withColumn("symbol", F.col("symbol").cast("bigint")))


def unread_price_files(spark, sf):
    """Landed files that lack a date column, by symbol and what they lack."""
    found = PR.unread_price_files(spark, _landed_bars(spark, sf))
    symbol = F.regexp_extract("file", "/symbol=([^/]+)/", 1).cast("bigint")
    return found.select(symbol.alias("symbol"), F.array_join("missing", ",").alias("missing"), "header").distinct()


def metadata_by_name(spark, sf):
    """Metadata landed with its columns in another order and one of them left out, read by name."""
    path = scratch(spark, "metadata")
    rows = K.metadata(spark, sf).select("name", "symbol", F.lit("x").alias("unknown"), "sector")
    rows.withColumnRenamed("name", "official_name").write.option("header", True).csv(path)
    read = TB.read_metadata(spark, path)
    return read.select(F.col("symbol").cast("bigint").alias("symbol"), "official_name", "sector", "industry", "date_added")


def landed_prices_json(spark, sf):
    """A JSON array of bars per symbol; some carry the provider's warning."""
    path = scratch(spark, "prices-json")
    warning = F.when(F.col("symbol") % 7 == 0, F.lit("data limited to the plan"))
    bars = K.raw_prices(spark, sf).withColumn("warning", warning)
    columns = ["date", "open", "high", "low", "close", "adjusted_close", "volume", "warning"]
    # A document holds one bar per day, so its size is bounded by the calendar.
    documents = bars.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    documents.repartition("symbol").write.partitionBy("symbol").text(path)
    landed = PR.landed_prices_json(spark, path)
    return tidy(
        landed.groupBy(F.col("symbol").cast("bigint").alias("symbol")).agg(
            F.count("date").alias("bars"),
            F.count("warning").alias("warnings"),
            F.max("adjusted_close").alias("highest_close"),
            F.sum("volume").alias("volume"),
        )
    )


def landed_sec_json(spark, sf):
    """Ticker lookup documents of fifty entries, and a submission document per company."""
    companies = K.metadata(spark, sf)
    ticker = F.concat(F.lit("S"), F.col("symbol").cast("string"))
    entry = F.struct(F.col("symbol").cast("string"), F.struct(ticker.alias("ticker"), (F.col("symbol") + 1000).alias("cik_str")))
    lookup = companies.groupBy(F.floor(F.col("symbol") / CIK_CHUNK).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    described = F.when(F.col("symbol") % 10 != 0, F.col("industry")).otherwise("")
    submissions = companies.select(
        (F.col("symbol") + 1000).alias("cik"),
        F.to_json(F.struct(F.col("name"), described.alias("sicDescription"))).alias("value"),
    )
    info = TB.sec_submissions(submissions)
    return TB.cik_lookup(lookup).join(info, "cik").select("symbol", "cik", "sector", "name")


def html_table_rows(spark, sf):
    pages = K.constituent_pages(spark, sf)
    return tidy(H.current_constituents(pages).select("url", "symbol", "sector", "industry", "name"))


def html_changes(spark, sf):
    """Changes pages with a header of two rows, whose rows share the cell of their date."""
    _, changes = K.membership(spark, sf)
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("S."), c.cast("string")))
    written = F.concat(cell(name(F.col("added_ticker"))), cell(F.lit("Added Inc.")), cell(name(F.col("removed_ticker"))), cell(F.lit("Removed Inc.")))
    part = F.floor(F.col("seq") / ROWS_PER_PAGE).alias("part")
    rows = changes.groupBy("date", part).agg(F.sort_array(F.collect_list(F.struct("seq", written.alias("cells")))).alias("rows"))
    head = "<tr><th rowspan='2'>Date</th><th colspan='2'>Added</th><th colspan='2'>Removed</th></tr><tr>" + "<th>Ticker</th><th>Security</th>" * 2 + "</tr>"
    day = F.concat(F.lit("<td rowspan='"), F.size("rows").cast("string"), F.lit("'>"), F.date_format("date", "MMMM d, yyyy"), F.lit("</td>"))
    lines = F.array_join(F.transform("rows", lambda r: r["cells"]), "</tr><tr>")
    pages = rows.select(
        F.concat_ws("/", F.lit("change"), F.col("date").cast("string"), F.col("part").cast("string")).alias("url"),
        F.concat(F.lit(f"<html><table>{head}<tr>"), day, lines, F.lit("</tr></table></html>")).alias("html"),
    )
    return tidy(H.membership_changes(pages).select("url", "seq", "date", "added_ticker", "removed_ticker"))


def quality_gate(spark, sf):
    """Constituent pages, each fetched again when it was gone, and the raw web pages against the constituents signature."""
    pages = K.constituent_pages(spark, sf)
    made = H.quality_gate(pages.unionByName(pages.withColumn("html", F.lit("<p>gone</p>"))), ["Symbol"])
    raw = H.quality_gate(K.table(spark, sf, "pages"), ["Symbol"])
    return made.withColumn("source", F.lit("constituents")).unionByName(raw.withColumn("source", F.lit("web")))


def pages_without_table(spark, sf):
    return H.pages_without_table(K.constituent_pages(spark, sf), ["Symbol"])


def feature_sink(spark, sf):
    path = scratch(spark, "features")
    TB.feature_sink(K.features(spark, sf), path)
    rows = TB.read_features(spark, path)
    return tidy(rows.select("date", "symbol", "sector", *FEATURE_COLUMNS, "target_spike_class"))


def panel_sink(spark, sf):
    path = scratch(spark, "panel")
    PR.write_panel(K.prices(spark, sf), path)
    return tidy(spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")))


def stream_ingest(spark, sf):
    """The events table through an incremental stream, run twice: the second finds nothing new."""
    target, checkpoint = scratch(spark, "ingested"), scratch(spark, "ingest-checkpoint")
    schema = K.table(spark, sf, "events").schema
    for _ in range(2):
        I.ingest_new_files(spark, sf, target, checkpoint, schema, options={"pathGlobFilter": "events.parquet"})
    return tidy(
        I.ingested(spark, target).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        price_panel, unread_price_files, metadata_by_name, landed_prices_json, landed_sec_json, html_table_rows, html_changes, quality_gate,
        pages_without_table, feature_sink, panel_sink, stream_ingest,
    )
}

SQL = {
    "price_panel": with_ctes(
        f"""SELECT symbol, date, {r6_all('open', 'high', 'low', 'close')}, CASE WHEN symbol % 4 <> 3 THEN {r6('volume').removesuffix(' AS volume')} END AS volume
        FROM px"""
    ),
    "unread_price_files": with_ctes(
        "SELECT -symbol AS symbol, 'date' AS missing, 'open,close' AS header FROM px WHERE symbol % 5 = 0 GROUP BY symbol"
    ),
    "metadata_by_name": with_ctes(
        "SELECT symbol, name AS official_name, sector, CAST(NULL AS VARCHAR) AS industry, CAST(NULL AS DATE) AS date_added FROM meta"
    ),
    "landed_prices_json": with_ctes(
        f"""SELECT symbol, count(*) AS bars, count(CASE WHEN symbol % 7 = 0 THEN 1 END) AS warnings,
        {r6('max(close)', 'highest_close')}, {r6('sum(volume)', 'volume')} FROM px GROUP BY symbol"""
    ),
    "landed_sec_json": with_ctes(
        """SELECT 'S' || symbol AS symbol, symbol + 1000 AS cik, industry AS sector, name FROM meta WHERE symbol % 10 <> 0"""
    ),
    "html_table_rows": with_ctes(
        """SELECT 'page/' || symbol AS url, 'S-' || symbol AS symbol, sector, industry, name || ' & Co' AS name
        FROM meta WHERE symbol % 11 <> 10"""
    ),
    "html_changes": with_ctes(
        f"""SELECT 'change/' || date || '/' || seq // {ROWS_PER_PAGE} AS url,
        row_number() OVER (PARTITION BY date, seq // {ROWS_PER_PAGE} ORDER BY seq) AS seq, date,
        CASE WHEN op = 'add' THEN 'S-' || symbol END AS added_ticker,
        CASE WHEN op = 'remove' THEN 'S-' || symbol END AS removed_ticker FROM changes"""
    ),
    "quality_gate": """SELECT 'constituents' AS source, 2 * count(*) AS pages, count(CASE WHEN s_suppkey % 11 <> 10 THEN 1 END) AS accepted,
        2 * count(*) - count(CASE WHEN s_suppkey % 11 <> 10 THEN 1 END) AS rejected FROM supplier
        UNION ALL SELECT 'web', count(*), count(CASE WHEN regexp_matches(html, '(?is)<table.*Symbol.*</table>') THEN 1 END),
        count(CASE WHEN NOT regexp_matches(html, '(?is)<table.*Symbol.*</table>') THEN 1 END) FROM pages""",
    "pages_without_table": "SELECT 'page/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 11 = 10",
    "feature_sink": with_ctes(
        f"SELECT date, symbol, sector, {r6_all(*FEATURE_COLUMNS)}, CAST(target_spike_class AS BIGINT) AS target_spike_class FROM feat"
    ),
    "panel_sink": with_ctes(f"SELECT year(date) AS year, count(*) AS bars, {r6('sum(volume)', 'volume')} FROM px GROUP BY 1"),
    "stream_ingest": f"SELECT event_type, count(*) AS n, {r6('sum(value)', 'value')} FROM events GROUP BY event_type",
}
