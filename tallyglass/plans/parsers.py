"""Disclosure text as transactions: metadata, delimited tables, line rows, confidence, and the fallback between them.

All of it is native, and one pass over a document: it is split into lines once, the lines are read by regular expressions
within its row, and only transactions are exploded, without a shuffle. Delimited fields may be quoted as in CSV, with
doubled quotes; a quoted field ends with its line. Where two columns of a table stand for one field the later one counts;
lines end with LF, CR or both. The rows come from `filing_texts`, disclosure texts made of the star schema's filings and trades in three layouts (delimited table, plain
lines, and a notice without transactions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bindings as B
from .bindings import sql
from .relational import C

QUERIES, ORACLES = {}, {}

# Patterns, words and field names of disclosure forms.
DATE = r"\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\b"
AMOUNT = r"(?i)(\$?\d[\d,]*\s*-\s*\$?\d[\d,]*|\$?\d[\d,]*\+?|Over\s+\$?\d[\d,]*)"
ACTION_WORDS = [("purchase", "BUY"), ("buy", "BUY"), ("sale", "SELL"), ("sold", "SELL"), ("sell", "SELL"), ("exchange", "EXCHANGE")]
FIELDS = {
    "owner": ["owner", "ownership", "who"],
    "asset": ["asset", "asset_name", "description", "security", "name_of_asset", "identification_of_assets"],
    "ticker": ["ticker", "symbol", "ticker_symbol"],
    "action": ["action", "transaction_type", "type", "type_of_transaction"],
    "date": ["date", "transaction_date", "date_of_transaction"],
    "amount": ["amount", "value", "range", "amount_of_transaction"],
    "comment": ["comment", "comments", "notes", "description_of_transaction"],
}
METADATA = {
    "filer_name": r"filer|name|name of reporting individual",
    "report_type": r"report type|filing type|form|type of report",
    "filing_date": r"filing date|filed|date filed|date of filing",
    "agency": r"agency|department|office",
    "position": r"position|title|position title",
    "court": r"court|judicial station",
    "reporting_period": r"reporting period|period covered",
    "report_year": r"report year|calendar year",
    "report_status": r"report status|status",
}
DELIMITERS = ["\t", ",", "|"]


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def filing_texts(spark, sf) -> DataFrame:
    """A disclosure text per filing: header lines, then its trades as a table, as lines, or a notice without any."""
    t = B.trades(spark, sf)
    date, cents = F.date_format("trade_date", "MM/dd/yyyy"), C("value_cents")
    table = F.concat_ws("|", F.concat(F.lit("Asset "), "line", F.lit(" Inc")), "ticker", F.lower("action"), date, F.concat(F.lit("$"), cents))
    line = F.concat(F.lit("Holding "), "line", F.lit(" Corp ("), F.regexp_replace("ticker", "\\d+", "X"), F.lit("), "), date, F.lit(" $"), cents, F.lit(" - $"), cents + 1000, F.when(C("action") == "SELL", " Sale").when(C("action") == "BUY", " Purchase").otherwise(" swapped"), F.lit(" note"))
    rows = t.groupBy("filing_id", "reported_date").agg(F.array_sort(F.collect_list(F.struct("line", table.alias("cells"), line.alias("words")))).alias("rows"))
    body = F.when(C("filing_id") % 3 == 0, F.concat(F.lit("Description|Symbol|Type|Date|Amount\n"), F.array_join(C("rows.cells"), "\n"))).when(C("filing_id") % 3 == 1, F.array_join(C("rows.words"), "\n")).otherwise("No reportable transactions, 3 pages")
    head = F.concat(F.lit("FILER: Person "), C("filing_id"), F.lit("  Lee\nReport type - Form 278-T"), F.when(C("filing_id") % 5 == 0, " (Amended)").otherwise(""), F.lit("\nDate filed: "), F.date_format("reported_date", "MM/dd/yyyy"), F.lit(" noon\n\n"))
    return rows.select("filing_id", F.concat(head, body).alias("text"))


_TEXTS = """t AS (SELECT filing_id, reported_date, line, ticker, action, strftime(trade_date, '%m/%d/%Y') AS d, value_cents AS v, 'Asset ' || line || ' Inc|' || ticker || '|' || lower(action) || '|' || strftime(trade_date, '%m/%d/%Y') || '|$' || value_cents AS cells FROM trades),
 texts AS (SELECT filing_id, 'FILER: Person ' || filing_id || '  Lee' || chr(10) || 'Report type - Form 278-T' || CASE WHEN filing_id % 5 = 0 THEN ' (Amended)' ELSE '' END || chr(10) || 'Date filed: ' || strftime(reported_date, '%m/%d/%Y') || ' noon' || chr(10) || chr(10) || CASE filing_id % 3
  WHEN 0 THEN 'Description|Symbol|Type|Date|Amount' || chr(10) || string_agg(cells, chr(10) ORDER BY line, cells)
  WHEN 1 THEN string_agg('Holding ' || line || ' Corp (' || regexp_replace(ticker, '[0-9]+', 'X') || '), ' || d || ' $' || v || ' - $' || (v + 1000) || CASE action WHEN 'SELL' THEN ' Sale' WHEN 'BUY' THEN ' Purchase' ELSE ' swapped' END || ' note', chr(10) ORDER BY line, cells)
  ELSE 'No reportable transactions, 3 pages' END AS text FROM t GROUP BY filing_id, reported_date)"""


def iso_date(x: Column) -> Column:
    """ISO text of a date in ISO, M/d/yyyy or M/d/yy form; other text as it is."""
    long = F.try_to_date(x, "M/d/yyyy")
    short = F.try_to_date(x, "M/d/yy")
    return F.when(F.contains(x, F.lit("-")), x).otherwise(F.coalesce(F.when(x.rlike(r"/\d{4}$"), long).otherwise(short).cast("string"), x))


def action_of(x: Column) -> Column:
    """The action of the first known word found, in the table's order; null if none."""
    out = F.lit(None).cast("string")
    for word, action in reversed(ACTION_WORDS):
        out = F.when(F.contains(F.lower(x), F.lit(word)), action).otherwise(out)
    return out


def confidence(asset: Column, date: Column, amount: Column, action: Column) -> Column:
    """Mean of the four required fields' scores, two decimals, in per cent."""
    has = lambda x, n: F.when(F.coalesce(F.length(x), F.lit(0)) > 0, n).otherwise(0)
    kind = F.when(action.isin("BUY", "SELL", "EXCHANGE", "OTHER"), 90).otherwise(45)
    return F.round((has(asset, 95) + has(date, 95) + has(amount, 90) + kind) / 4).cast("int")


def numbered(text: Column) -> Column:
    """array<(n from 1, raw, line with white space collapsed)> of the lines with text."""
    cut = F.transform(F.split(text, "\\r\\n|\\r|\\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("raw"), F.trim(F.regexp_replace(x, "\\s+", " ")).alias("line")))
    return F.filter(cut, lambda r: r.line != "")


def line_rows(found: Column) -> Column:
    """The transactions of numbered lines with a date, an amount and an action word; the asset stands before the date."""
    dated = F.filter(F.transform(found, lambda r: F.struct(r.n.alias("n"), r.line.alias("line"), F.regexp_extract(r.line, DATE, 1).alias("date"))), lambda r: r.date != "")
    read = F.transform(dated, lambda r: F.struct(r.n.alias("n"), r.line.alias("line"), r.date.alias("date"), F.regexp_extract(r.line, AMOUNT, 1).alias("amount"), action_of(r.line).alias("action")))
    edges = r"^[ ,\-;|]+|[ ,\-;|]+$"
    with_asset = F.transform(F.filter(read, lambda r: (r.amount != "") & r.action.isNotNull()), lambda r: F.struct(
        r.alias("r"), F.regexp_replace(F.split_part(r.line, r.date, F.lit(1)), edges, "").alias("before"), F.nullif(F.regexp_replace(F.substr(r.line, F.position(r.amount, r.line) + F.length(r.amount)), edges, ""), F.lit("")).alias("comment"),
    ))
    named = F.transform(with_asset, lambda x: F.struct(x.r.alias("r"), x.before.alias("before"), x.comment.alias("comment"), F.nullif(F.regexp_extract(x.before, r"\(([A-Z]{1,6})\)", 1), F.lit("")).alias("ticker")))
    bare = lambda x: F.nullif(F.trim(F.regexp_replace(F.replace(x.before, F.concat(F.lit("("), x.ticker, F.lit(")")), F.lit("")), "\\s+", " ")), F.lit(""))
    asset = lambda x: F.when(x.ticker.isNotNull(), F.coalesce(bare(x), x.before)).otherwise(x.before)
    whole = F.transform(named, lambda x: F.struct(x.r.alias("r"), asset(x).alias("asset"), x.ticker.alias("ticker"), x.comment.alias("comment")))
    return F.transform(whole, lambda x: _row(x.r.n, x.asset, x.ticker, x.r.action, x.r.date, x.r.amount, x.comment))


def _row(n: Column, asset: Column, ticker: Column, action: Column, date: Column, amount: Column, comment: Column) -> Column:
    return F.struct(
        n.alias("row_number"), asset.alias("asset"), ticker.alias("ticker"), action.alias("action"), iso_date(date).alias("date"), amount.alias("amount"), comment.alias("comment"), confidence(asset, date, amount, action).alias("confidence_pct")
    )


def _exploded(texts: DataFrame, rows: Column, *more: Column) -> DataFrame:
    return texts.select("filing_id", F.explode(rows).alias("r"), *more).select("filing_id", "r.*", *[c for c in ("parser",) if more])


def line_transactions(texts: DataFrame) -> DataFrame:
    """A transaction of every line with a date, an amount and an action word."""
    return _exploded(texts, line_rows(numbered(C("text"))))


_LINES = r"""raw_lines AS (SELECT filing_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS row_number FROM texts),
 lines AS (SELECT filing_id, row_number, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw_lines WHERE trim(raw) <> ''),
 found AS (SELECT *, regexp_extract(line, '\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\b', 1) AS d, regexp_extract(line, '(?i)(\$?\d[\d,]*\s*-\s*\$?\d[\d,]*|\$?\d[\d,]*\+?|Over\s+\$?\d[\d,]*)', 1) AS amount,
  CASE WHEN contains(lower(line), 'purchase') OR contains(lower(line), 'buy') THEN 'BUY' WHEN contains(lower(line), 'sale') OR contains(lower(line), 'sold') OR contains(lower(line), 'sell') THEN 'SELL' WHEN contains(lower(line), 'exchange') THEN 'EXCHANGE' END AS action FROM lines),
 parts AS (SELECT *, trim(split_part(line, d, 1), ' ,-;|') AS before FROM found WHERE d <> '' AND amount <> '' AND action IS NOT NULL),
 line_rows AS (SELECT filing_id, CAST(row_number AS INTEGER) AS row_number, CASE WHEN regexp_matches(before, '\([A-Z]{1,6}\)') THEN coalesce(nullif(trim(regexp_replace(replace(before, regexp_extract(before, '\([A-Z]{1,6}\)'), ''), '\s+', ' ', 'g')), ''), before) ELSE before END AS asset,
  nullif(regexp_extract(before, '\(([A-Z]{1,6})\)', 1), '') AS ticker, action, strftime(strptime(d, '%m/%d/%Y'), '%Y-%m-%d') AS date, amount,
  nullif(trim(substr(line, instr(line, amount) + length(amount)), ' ,-;|'), '') AS comment FROM parts)"""


@query("u4_transactions", sql(f", {_TEXTS}, {_LINES} SELECT *, CAST(round((CASE WHEN asset <> '' THEN 95 ELSE 0 END + 95 + 90 + 90) / 4.0) AS INTEGER) AS confidence_pct FROM line_rows", "trades"))
def u4(spark, sf):
    return line_transactions(filing_texts(spark, sf))


def field_of(name: Column) -> Column:
    """The canonical field of a header cell, or null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = {alias: field for field, aliases in FIELDS.items() for alias in aliases}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), plain)


def split_fields(line: Column, delimiter: str) -> Column:
    """The fields of a delimited line; one that begins with a quote reaches to the closing quote, doubled quotes are one."""
    d = {"\t": "\\t", "|": "\\|"}.get(delimiter, delimiter)
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'{d}({quoted}(?:"[^{d}]*+|$)|[^{d}]*+)'), F.lit(1))
    inside = lambda x: F.replace(F.regexp_extract(x, f"^({quoted})", 1), F.lit('""'), F.lit('"'))
    rest = lambda x: F.regexp_extract(x, f'^{quoted}"?(.*)$', 1)
    return F.transform(raw, lambda x: F.when(F.startswith(x, F.lit('"')), F.concat(F.substr(inside(x), F.lit(2)), rest(x))).otherwise(x))


def headers(found: Column) -> Column:
    """array<(n, delimiter, fields)> of the numbered lines with three known headers, an asset among them; of a line the first."""
    one = lambda r, d: F.struct(F.lit(d).alias("delimiter"), F.transform(split_fields(r.raw, d), field_of).alias("fields"))
    known = lambda c: (F.size(F.filter(c.fields, lambda f: f.isNotNull())) >= 3) & F.array_contains(c.fields, "asset")
    read = lambda r: F.filter(F.array(*[F.when(F.contains(r.raw, F.lit(d)), one(r, d)) for d in DELIMITERS]), lambda c: c.isNotNull() & known(c))
    # Only a line that holds a word of an asset's label can have one.
    words = "|".join(sorted({max(alias.split("_"), key=len) for alias in FIELDS["asset"]}))
    some = F.filter(found, lambda r: F.lower(r.raw).rlike(words))
    heads = F.filter(F.transform(some, lambda r: F.struct(r.n.alias("n"), F.get(read(r), F.lit(0)).alias("h"))), lambda x: x.h.isNotNull())
    return F.transform(heads, lambda x: F.struct(x.n.alias("n"), x.h.delimiter.alias("delimiter"), x.h.fields.alias("fields")))


def header(found: Column) -> Column:
    """The first of the headers, or null."""
    return F.get(headers(found), F.lit(0))


def tables(texts: DataFrame) -> DataFrame:
    """(filing_id, header_line, delimiter, fields) of each text's first line with three known headers, an asset among them."""
    # Exploded, as a filter on the header would read every line once more.
    return texts.select("filing_id", F.explode(F.slice(headers(numbered(C("text"))), 1, 1)).alias("h")).select("filing_id", C("h.n").alias("header_line"), "h.delimiter", "h.fields")


_TABLES = r"""heads AS (SELECT filing_id, min(row_number) AS header_line FROM lines WHERE regexp_matches(lower(raw), '^description\|symbol\|type\|date\|amount$') GROUP BY 1)"""


@query("u3_table_detection", sql(f", {_TEXTS}, {_LINES}, {_TABLES} SELECT filing_id, CAST(header_line AS INTEGER) AS header_line, '|' AS delimiter, 'asset,ticker,action,date,amount' AS fields FROM heads", "trades"))
def u3(spark, sf):
    return tables(filing_texts(spark, sf)).select("filing_id", "header_line", "delimiter", F.array_join(F.transform("fields", lambda f: F.coalesce(f, F.lit("?"))), ",").alias("fields"))


def table_rows(found: Column, head: Column) -> Column:
    """The transactions of the rows under a header that have an asset, date, amount and action."""
    body = F.transform(F.filter(found, lambda r: r.n > head.n), lambda r, i: F.struct((i + 1).alias("n"), r.raw.alias("raw")))
    cut = lambda r: F.when(head.delimiter == "\t", split_fields(r.raw, "\t")).when(head.delimiter == ",", split_fields(r.raw, ",")).otherwise(split_fields(r.raw, "|"))
    cells = F.transform(body, lambda r: F.struct(r.n.alias("n"), cut(r).alias("cells")))
    place = lambda name: F.array_max(F.transform(head.fields, lambda f, i: F.when(f == name, i)))
    get = lambda x, name: F.nullif(F.trim(F.regexp_replace(F.get(x.cells, place(name)), "\\s+", " ")), F.lit(""))
    named = F.transform(cells, lambda x: F.struct(x.n.alias("n"), *[get(x, f).alias(f) for f in ("asset", "ticker", "action", "date", "amount", "comment")]))
    whole = F.filter(named, lambda x: x.asset.isNotNull() & x.date.isNotNull() & x.amount.isNotNull() & x.action.isNotNull())
    short = lambda x: F.lower(x.action)
    action = lambda x: F.when(short(x) == "p", "BUY").when(short(x).isin("s", "s (partial)", "s (full)"), "SELL").when(short(x) == "e", "EXCHANGE").otherwise(F.coalesce(action_of(x.action), F.upper(x.action)))
    return F.transform(whole, lambda x: _row(x.n, x.asset, x.ticker, action(x), x.date, x.amount, x.comment))


def table_transactions(texts: DataFrame) -> DataFrame:
    """A transaction of every row under a detected header that has an asset, date, amount and action."""
    found = texts.select("filing_id", numbered(C("text")).alias("found"))
    headed = found.select("filing_id", "found", F.explode(F.slice(headers(C("found")), 1, 1)).alias("h"))
    return _exploded(headed, table_rows(C("found"), C("h")))


_TABLE_ROWS = r"""table_rows AS (SELECT filing_id, CAST(row_number - header_line AS INTEGER) AS row_number, split_part(raw, '|', 1) AS asset, split_part(raw, '|', 2) AS ticker, upper(split_part(raw, '|', 3)) AS action,
  strftime(strptime(split_part(raw, '|', 4), '%m/%d/%Y'), '%Y-%m-%d') AS date, split_part(raw, '|', 5) AS amount, CAST(NULL AS VARCHAR) AS comment FROM lines JOIN heads USING (filing_id) WHERE row_number > header_line)"""


@query("u1_disclosure_transactions", sql(f", {_TEXTS}, {_LINES}, {_TABLES}, {_TABLE_ROWS}, both_rows AS (SELECT *, 'table' AS parser FROM table_rows UNION ALL SELECT *, 'line' FROM line_rows WHERE filing_id NOT IN (SELECT filing_id FROM table_rows)) SELECT *, CAST(round((95 + 95 + 90 + 90) / 4.0) AS INTEGER) AS confidence_pct FROM both_rows", "trades"))
def u1(spark, sf):
    """The fallback chain: a text's table rows if it has any, else its line rows (U1, U8)."""
    found = filing_texts(spark, sf).select("filing_id", numbered(C("text")).alias("found"))
    headed = found.withColumn("h", header(C("found")))
    tabled = headed.withColumn("t", F.when(C("h").isNotNull(), table_rows(C("found"), C("h"))))
    any_row = F.coalesce(F.size("t"), F.lit(0)) > 0
    return _exploded(tabled, F.when(any_row, C("t")).otherwise(line_rows(C("found"))), F.when(any_row, "table").otherwise("line").alias("parser"))


@query("u7_field_confidence", sql(", c AS (SELECT filing_id, line, CASE WHEN line % 4 = 0 THEN '' ELSE ticker END AS asset, CASE WHEN line % 3 = 0 THEN NULL ELSE 'd' END AS date, CASE WHEN line % 5 = 0 THEN '' ELSE 'a' END AS amount, CASE WHEN line % 2 = 0 THEN 'GIFT' ELSE action END AS kind FROM trades) SELECT filing_id, line, CAST(floor(((CASE WHEN length(asset) > 0 THEN 95 ELSE 0 END + CASE WHEN length(date) > 0 THEN 95 ELSE 0 END + CASE WHEN length(amount) > 0 THEN 90 ELSE 0 END + CASE WHEN kind IN ('BUY', 'SELL', 'EXCHANGE', 'OTHER') THEN 90 ELSE 45 END) / 4.0) + 0.5) AS INTEGER) AS confidence_pct FROM c", "trades"))
def u7(spark, sf):
    t = B.trades(spark, sf)
    asset, date = F.when(C("line") % 4 == 0, "").otherwise(C("ticker")), F.when(C("line") % 3 != 0, "d")
    amount, kind = F.when(C("line") % 5 == 0, "").otherwise("a"), F.when(C("line") % 2 == 0, "GIFT").otherwise(C("action"))
    return t.select("filing_id", "line", confidence(asset, date, amount, kind).alias("confidence_pct"))


def metadata(texts: DataFrame) -> DataFrame:
    """The first `label: value` line of each kind, case-insensitive, and whether the report is an amendment."""
    first = {k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", rf"(?im)^(?:{p})\s*[:\-]\s*(.+)$", 1), "\\s+", " ")), F.lit("")) for k, p in METADATA.items()}
    date = F.regexp_extract(first["filing_date"], DATE, 1)
    first["filing_date"] = F.when(date != "", iso_date(date)).otherwise(first["filing_date"])
    amended = F.concat_ws(" ", first["report_type"], first["report_status"]).rlike(r"(?i)\b(?:amended|amendment)\b")
    return texts.select("filing_id", *[v.alias(k) for k, v in first.items()], amended.alias("is_amendment"))


@query("u2_metadata", sql(f", {_TEXTS} SELECT filing_id, 'Person ' || filing_id || ' Lee' AS filer_name, 'Form 278-T' || CASE WHEN filing_id % 5 = 0 THEN ' (Amended)' ELSE '' END AS report_type, CAST(filed_date AS VARCHAR) AS filing_date, CAST(NULL AS VARCHAR) AS agency, CAST(NULL AS VARCHAR) AS position, CAST(NULL AS VARCHAR) AS court, CAST(NULL AS VARCHAR) AS reporting_period, CAST(NULL AS VARCHAR) AS report_year, CAST(NULL AS VARCHAR) AS report_status, filing_id % 5 = 0 AS is_amendment FROM texts JOIN filings USING (filing_id)", "trades", "filings"))
def u2(spark, sf):
    return metadata(filing_texts(spark, sf))


# Transaction rows of the annual and periodic executive forms.
ROW_PREFIX = r"^\s*(\d{1,4})[.)]?\s+"
ACTION_MARK = r"(?i)\b(purchases?|purchased|bought|sales?|sold|exchange)\b"
MONEY = r"\$[\d,]+(?:\s*-\s*\$?[\d,]+)?"


def repaired(line: Column) -> Column:
    """Words and years that optical recognition has split, put together again (ST14)."""
    out = F.regexp_replace(line, r"(\d{1,2})/(\d)\.(\d)/(\d{4})", "$1/$2$3/$4")
    out = F.regexp_replace(out, r"(?i)pur\s*cha\s*se", "Purchase")
    out = F.regexp_replace(out, r"(?i)sa\s*le", "Sale")
    out = F.regexp_replace(out, r"(\d{1,2}/\d{1,2}/\d{3})\s+(\d)\b", "$1$2")
    out = F.regexp_replace(out, r"(\d{1,2})\s*-\s*([A-Za-z]{3})\s*-\s*(\d{4})", "$1-$2-$3")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def ocr_lines(spark, sf) -> DataFrame:
    """Trade rows as recognised from paper: split words and years, every seventh row printed twice."""
    t = B.trades(spark, sf).select("filing_id", "line", "ticker", "action", "trade_date", "reported_date", "value_cents")
    year = F.date_format("trade_date", "yyyy")
    date = F.concat(F.date_format("trade_date", "MM/dd/"), F.when(C("line") % 2 == 0, F.concat(F.substring(year, 1, 3), F.lit(" "), F.substring(year, 4, 1))).otherwise(year))
    word = F.when(C("action") == "BUY", "Pur cha se").when(C("action") == "SELL", "Sa le").otherwise("Exchange")
    text = F.concat("line", F.lit(". "), "ticker", F.lit(" Corp  Com "), word, F.lit(" "), date, F.lit(" $"), C("value_cents"))
    copies = F.explode(F.sequence(F.lit(1), F.when(C("line") == 7, 2).otherwise(1)))
    return t.select("filing_id", "line", "reported_date", text.alias("raw"), copies.alias("copy"))


_OCR = """o AS (SELECT filing_id, line, reported_date, action, trade_date, line || '. ' || ticker || ' Corp Com ' || CASE action WHEN 'BUY' THEN 'Purchase' WHEN 'SELL' THEN 'Sale' ELSE 'Exchange' END || ' ' || strftime(trade_date, '%m/%d/%Y') || ' $' || value_cents AS fixed, ticker || ' Corp Com' AS asset, '$' || value_cents AS amount FROM trades)"""


@query("st14_ocr_line_repair", sql(f", {_OCR}, k AS (SELECT unnest([1, 2]) AS copy) SELECT filing_id, line, fixed FROM o, k WHERE copy = 1 OR line = 7", "trades"))
def st14(spark, sf):
    return ocr_lines(spark, sf).select("filing_id", "line", repaired(C("raw")).alias("fixed"))


@query("u5_executive_form_rows", sql(f", {_OCR} SELECT filing_id || ':tx-' || lpad(CAST(row_number() OVER (PARTITION BY filing_id ORDER BY line, amount, asset, trade_date) AS VARCHAR), 4, '0') AS id, filing_id, CAST(line AS INTEGER) AS source_sequence, asset, CASE action WHEN 'BUY' THEN 'BUY' WHEN 'SELL' THEN 'SELL' ELSE 'EXCHANGE' END AS action, trade_date, amount, CAST(date_diff('day', trade_date, reported_date) AS INTEGER) AS lag_days FROM o", "trades"))
def u5(spark, sf):
    """Rows of the executive form: number, asset before the action word, last date before the amount; repeats dropped."""
    from pyspark.sql import Window

    # What is exploded is read once; a filter on a column that another makes would be moved below it and read it again.
    once = lambda x: F.explode(F.array(x))
    rows = ocr_lines(spark, sf).select("filing_id", "line", "copy", "reported_date", once(repaired(C("raw"))).alias("text"))
    sequence = F.nullif(F.regexp_extract("text", ROW_PREFIX, 1), F.lit("")).cast("int")
    amount, word = F.regexp_extract("text", MONEY, 0), F.lower(F.regexp_extract("text", ACTION_MARK, 1))
    dates = F.regexp_extract_all(F.substring_index("text", "$", 1), F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    asset = F.regexp_replace(F.regexp_replace(F.element_at(F.split("text", ACTION_MARK, 2), 1), ROW_PREFIX, ""), r"^[ \-|]+|[ \-|]+$", "")
    rows = rows.select("filing_id", "line", "copy", "reported_date", "text", once(F.struct(amount.alias("amount"), word.alias("word"), dates.alias("dates"))).alias("x")).filter("x.amount <> '' and x.word <> '' and size(x.dates) > 0")
    amount, word, dates = C("x.amount"), C("x.word"), C("x.dates")
    action = F.when(word.isin("sale", "sales", "sold"), "SELL").when(word == "exchange", "EXCHANGE").otherwise("BUY")
    rows = rows.select("filing_id", "line", "copy", "reported_date", sequence.alias("source_sequence"), asset.alias("asset"), action.alias("action"), once(F.try_to_date(F.element_at(dates, -1), "M/d/yyyy")).alias("trade_date"), amount.alias("amount"))
    key = ["filing_id", "source_sequence", "asset", "trade_date", "amount"]
    kept = rows.filter("trade_date is not null").groupBy(*key).agg(F.min_by(F.struct("line", "copy", "action", "reported_date"), F.struct("line", "copy")).alias("r")).select(*key, "r.*")
    number = F.row_number().over(Window.partitionBy("filing_id").orderBy("line", "amount", "asset", "trade_date"))
    return kept.select(F.concat("filing_id", F.lit(":tx-"), F.lpad(number.cast("string"), 4, "0")).alias("id"), "filing_id", "source_sequence", "asset", "action", "trade_date", "amount", F.datediff("reported_date", "trade_date").alias("lag_days"))


@query("u6_positional_table", sql(", w AS (SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY line, ticker, value_cents, action) AS line, ticker, action, value_cents FROM trades) SELECT filing_id, CAST(line AS INTEGER) AS row_number, ticker || ' Corp' AS asset, action, '$' || value_cents AS amount FROM w", "trades"))
def u6(spark, sf):
    """Words with positions to table cells: a row reaches from its number's top to the next one's, a column by x range."""
    # A filing has few rows, so its words meet its rows within it; nothing is sorted or joined by word.
    t = B.trades(spark, sf).groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("line", "ticker", "value_cents", "action"))).alias("t"))
    place = lambda text, x, top: F.struct(top.alias("top"), F.lit(x).alias("x0"), text.cast("string").alias("text"))
    printed = lambda r, n, top: F.array(place(n, 10, top), place(r.ticker, 60, top + 1), place(F.lit("Corp"), 61, top + 9), place(r.action, 300, top + 2), place(F.concat(F.lit("$"), r.value_cents), 400, top + 3))
    words = F.flatten(F.transform("t", lambda r, i: printed(r, i + 1, 120 + i * 20)))
    return positional_rows(t.select("filing_id", words.alias("words")))


def positional_rows(pages: DataFrame) -> DataFrame:
    """(filing_id, row_number, asset, action, amount) of pages (filing_id, words: array<(top, x0, text)>)."""
    once = lambda x: F.explode(F.array(x))
    pages = pages.select("filing_id", once(F.array_sort("words")).alias("words"))
    numbers = F.transform(F.filter("words", lambda w: w.x0 < 50), lambda w: F.struct(w.top.alias("a"), w.text.cast("int").alias("n")))
    pages = pages.select("filing_id", "words", once(numbers).alias("numbers"))
    rows = F.transform("numbers", lambda r, i: F.struct(r.n.alias("row_number"), r.a.alias("a"), F.coalesce(F.get("numbers", i + 1).a, F.lit(1 << 30)).alias("b")))
    rows = pages.select("filing_id", "words", F.explode(F.filter(rows, lambda r: r.a < r.b)).alias("r"))
    rows = rows.select("filing_id", "r.row_number", once(F.filter("words", lambda w: (C("r.a") <= w.top) & (w.top < C("r.b")))).alias("words"))
    text = lambda lo, hi: F.array_join(F.transform(F.filter("words", lambda w: (w.x0 >= lo) & (w.x0 < hi)), lambda w: w.text), " ")
    return rows.select("filing_id", "row_number", text(50, 300).alias("asset"), text(300, 400).alias("action"), text(400, 1 << 30).alias("amount"))
