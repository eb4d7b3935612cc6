"""A reference of organizations from sources of falling authority, without guessing.

`alias_evidence` asks which names disclosures give to a ticker's only registered issuer: exact agreement of the names' cores,
seen often enough; all else is a gap of one of four types. `build` resolves the records of each source, strongest first,
against the organizations that the sources before it left: a record whose ids and symbols (or else whose name, or else its
name's core) lead to exactly one organization joins it, one that leads to several is an issue and becomes a new one, as does
one that leads nowhere. Records of one source meet each other by an equal registry id or source id only.

Each source is one join of its records' keys with the keys known so far, of which there is one row per key, whatever number
of organizations share it: the smallest, the largest and whether they differ. A key with many organizations or many records
is thus no hot group. What is known is checkpointed from source to source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, uuid5_like
from .lineage import cut, staged

# Words that an issuer's name is compared without, where an annotation of a label begins, valid symbols, the namespace of ids.
CORPORATE = ["co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "lp", "ltd", "plc", "the"]
LABELS = ["a", "and", "class", "com", "common", "de", "depositary", "inc", "new", "ordinary", "ot", "registry", "share", "shares", "st", "stock"]
ANNOTATION = "(?i)\\b(filing\\s+status|subholding\\s+of|holding\\s+of|description|comments|location)\\b"
MARKS = "(?i)\\[\\s*(ST|OT)\\s*\\]"
SYMBOL = "^[A-Z0-9][A-Z0-9.-]{0,14}$"
NAMESPACE = "d9ca33253c7c55de9e6b7a0df5018f8b"

RECORD = "record_id string, name string, cik string, source_entity_id string, symbols array<string>"


def symbol(value: Column) -> Column:
    """An upper-case symbol, or null if it isn't one."""
    s = F.upper(F.trim(value))
    return F.when(s.rlike(SYMBOL), s)


def _without(text: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(F.split(fold(F.coalesce(text, F.lit(""))), " "), lambda t: ~t.isin(words)), " ")


def name_core(name: Column) -> Column:
    return _without(name, CORPORATE)


def issuer_core(name: Column, ticker: Column | None = None) -> Column:
    """The words of an issuer's name without the ticker in brackets, label marks, annotations and words that names vary in."""
    text = F.coalesce(name, F.lit(""))
    if ticker is not None:
        text = F.regexp_replace(text, F.concat(F.lit("(?i)\\(\\s*\\Q"), F.coalesce(ticker, F.lit("")), F.lit("\\E\\s*\\)")), F.lit(" "))
    text = F.regexp_replace(text, MARKS, " ")
    text = F.regexp_replace(text, "(?s)" + ANNOTATION + ".*$", "")
    return _without(text, [*CORPORATE, *LABELS])


def counted_labels(rows: DataFrame) -> DataFrame:
    """Disclosure rows with a ticker, counted (n) by ticker, label, source_dataset and asset_class as they are written; with an id, the least.

    Counted rows are returned as they are. Names are folded after this, once a spelling and not once a row.
    """
    if "n" in rows.columns:
        return rows
    least = [F.min("id").alias("id")] if "id" in rows.columns else []
    return rows.filter("ticker is not null").groupBy("ticker", "label", "source_dataset", "asset_class").agg(F.count(F.lit(1)).alias("n"), *least)


def observed_labels(rows: DataFrame) -> DataFrame:
    """(ticker, normalized_alias, alias, occurrence_count, source_datasets, asset_classes and, of rows with an id, first_transaction_id) of disclosure rows.

    rows has id (or not), ticker, label, source_dataset, asset_class; rows without a ticker or a label don't count.
    """
    counted = counted_labels(rows)
    ids = [c for c in ("id",) if c in counted.columns]
    named = counted.select(*ids, symbol(F.col("ticker")).alias("ticker"), F.trim("label").alias("label"), "source_dataset", "asset_class", "n")
    named = named.withColumn("normalized_alias", fold(F.coalesce("label", F.lit("")))).filter("ticker is not null and normalized_alias <> ''")
    first = F.min(F.struct(F.lower("label").alias("l"), F.col("label").alias("v")))
    return named.groupBy("ticker", "normalized_alias").agg(
        first.getField("v").alias("alias"), F.sum("n").alias("occurrence_count"), F.array_sort(F.collect_set("source_dataset")).alias("source_datasets"), F.array_sort(F.collect_set("asset_class")).alias("asset_classes"),
        *[F.min(c).alias("first_transaction_id") for c in ids],
    )


def alias_evidence(rows: DataFrame, registered: DataFrame, least: int = 3, already: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the tickers that disclosure rows name at least `least` times, but for those supported already.

    registered has ticker, cik, company_name, exchange. A record is one supported alias of an issuer whose supported aliases
    occur at least `least` times together. A ticker gives at most one gap of each type.
    """
    # Staged, as the tickers' sums and the records both read the labels.
    seen = staged(observed_labels(rows).drop("first_transaction_id"))
    if already:
        seen = seen.filter(~F.col("ticker").isin([t.upper() for t in already]))
    issuers = registered.groupBy("ticker").agg(F.array_sort(F.collect_set(F.struct("cik", "company_name"))).alias("issuers"), F.array_sort(F.collect_set("exchange")).alias("exchanges"))
    met = seen.join(issuers, "ticker", "left")
    only = F.when(F.size("issuers") == 1, F.get("issuers", F.lit(0)))
    core = issuer_core(only.company_name)
    met = met.withColumns({"cik": only.cik, "official_name": only.company_name, "agrees": F.coalesce((core != "") & (core == issuer_core(F.col("alias"), F.col("ticker"))), F.lit(False))})
    n = F.col("occurrence_count")
    agreed, other = F.col("agrees"), ~F.col("agrees")
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("alias"))))
    by_ticker = met.groupBy("ticker").agg(
        F.sum(n).alias("total"), F.coalesce(F.sum(F.when(agreed, n)), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.when(other, n)), F.lit(0)).alias("rejected"), F.count_if(agreed).alias("n_accepted"), F.count_if(other).alias("n_rejected"),
        names(F.lit(True)).alias("all_names"), names(agreed).alias("accepted_names"), names(other).alias("rejected_names"), F.max(F.coalesce(F.size("issuers"), F.lit(0))).alias("n_issuers"), F.max("cik").alias("cik"), F.max("official_name").alias("official_name"),
    ).filter(F.col("total") >= least)
    by_ticker = by_ticker.withColumn("n_issuers", F.greatest("n_issuers", F.lit(0)))
    known = F.col("n_issuers") == 1
    gap = lambda kind, when, count, aliases: F.when(when, F.struct(F.lit(kind).alias("gap_type"), count.alias("occurrence_count"), aliases.alias("observed_aliases")))
    found = F.array_compact(F.array(
        gap("ticker_not_in_sec_reference", F.col("n_issuers") == 0, F.col("total"), F.col("all_names")),
        gap("ambiguous_sec_ticker", F.col("n_issuers") > 1, F.col("total"), F.col("all_names")),
        gap("supported_alias_below_frequency_threshold", known & (F.col("n_accepted") > 0) & (F.col("accepted") < least), F.col("accepted"), F.col("accepted_names")),
        gap("issuer_name_mismatch", known & ((F.col("n_rejected") > 0) | (F.col("n_accepted") == 0)), F.col("rejected"), F.col("rejected_names")),
    ))
    gaps = by_ticker.select("ticker", "cik", "official_name", "n_issuers", F.explode(found).alias("g")).select("ticker", "g.gap_type", "cik", "official_name", F.col("n_issuers").cast("int").alias("n_issuers"), "g.occurrence_count", "g.observed_aliases")
    good = by_ticker.filter(known & (F.col("accepted") >= least)).select("ticker", F.col("accepted").alias("issuer_occurrences"))
    records = met.filter("agrees").join(good, "ticker").select(
        F.concat(F.lit("sec-issuer-alias:"), "cik", F.lit(":"), "ticker").alias("id"), "ticker", "cik", "official_name", "exchanges", "alias", "normalized_alias", "occurrence_count", "issuer_occurrences", "source_datasets", "asset_classes"
    )
    return records, gaps


@dataclass
class Source:
    """A source's records (RECORD) and their aliases (record_id, alias, alias_type, confidence, occurrence_count), or none."""

    name: str
    priority: int
    records: DataFrame
    aliases: DataFrame | None = None
    #: Its symbols help to find an organization but give none a symbol that nobody has so far.
    known_symbols: bool = False


@dataclass
class Reference:
    """keys (entity, scheme, value), names (entity, priority, name, source), aliases, and issues."""

    keys: DataFrame
    names: DataFrame
    aliases: DataFrame
    issues: DataFrame
    members: DataFrame

    def organizations(self) -> DataFrame:
        """One row each: the stable key by the strongest id, the name of the highest priority (then shortest), what it holds."""
        least = lambda scheme: F.min(F.when(F.col("scheme") == scheme, F.col("value")))
        count = lambda scheme: F.count_if(F.col("scheme") == scheme)
        held = self.keys.groupBy("entity").agg(least("cik").alias("cik"), least("source").alias("source_entity_id"), least("symbol").alias("symbol"), count("symbol").alias("n_symbols"), count("name").alias("n_names"))
        best = F.min(F.struct((-F.col("priority")).alias("p"), F.length("name").alias("n"), F.lower("name").alias("l"), F.col("name").alias("v")))
        names = self.names.groupBy("entity").agg(best.getField("v").alias("canonical_name"), F.array_sort(F.collect_set("source")).alias("sources"))
        rows = held.join(names, "entity")
        stable = F.coalesce(F.concat(F.lit("cik:"), "cik"), F.concat(F.lit("source:"), "source_entity_id"), F.concat(F.lit("symbol:"), "symbol"), F.concat(F.lit("name:"), fold(F.col("canonical_name"))))
        return rows.select("entity", uuid5_like(NAMESPACE, F.concat(F.lit("organization:"), stable)).alias("organization_id"), stable.alias("stable_key"), "canonical_name", "cik", "symbol", "n_symbols", "n_names", "sources")


def _keys(records: DataFrame) -> DataFrame:
    """(record_id, tier, scheme, value): ids and symbols first, the name where they lead nowhere, then its core."""
    name, core = fold(F.coalesce("name", F.lit(""))), name_core(F.col("name"))
    entry = lambda tier, scheme, value: F.struct(F.lit(tier).alias("tier"), F.lit(scheme).alias("scheme"), value.alias("value"))
    symbols = F.transform(F.array_distinct(F.array_compact(F.transform(F.coalesce("symbols", F.array().cast("array<string>")), symbol))), lambda s: entry(0, "symbol", s))
    fixed = F.array(entry(0, "cik", F.col("cik")), entry(0, "source", F.col("source_entity_id")), entry(1, "name", name), entry(2, "core", core))
    rows = records.select("record_id", F.explode(F.concat(fixed, symbols)).alias("k")).select("record_id", "k.*")
    return rows.filter("value is not null and value <> ''")


def resolve(records: DataFrame, keys: DataFrame, stage: str) -> DataFrame:
    """(record_id, entity, ambiguous, low, high): the organization that each record joins or starts, and what made it ambiguous."""
    known = keys.groupBy("scheme", "value").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    met = _keys(records).join(known, ["scheme", "value"])
    tiers = met.groupBy("record_id", "tier").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = tiers.groupBy("record_id").agg(F.min_by(F.struct("low", "high"), "tier").alias("b"))
    own = F.coalesce(F.concat(F.lit("cik:"), F.nullif("cik", F.lit(""))), F.concat(F.lit("source:"), F.nullif("source_entity_id", F.lit(""))), F.concat(F.lit("record:"), "record_id"))
    rows = records.join(best, "record_id", "left")
    one, several = F.col("b.low") == F.col("b.high"), F.coalesce(F.col("b.low") != F.col("b.high"), F.lit(False))
    return rows.select("record_id", F.when(one, F.col("b.low")).otherwise(F.concat(F.lit(f"{stage}|"), own)).alias("entity"), several.alias("ambiguous"), F.when(several, F.col("b.low")).alias("low"), F.when(several, F.col("b.high")).alias("high"))


def build(sources: list[Source]) -> Reference:
    """Resolve the sources in order; a record id is unique within its source."""
    spark = sources[0].records.sparkSession
    keys = spark.createDataFrame([], "entity string, scheme string, value string")
    names, aliases, issues, members = [], [], [], []
    for k, source in enumerate(sources):
        records = source.records
        found = cut(resolve(records, keys, str(k)))
        both = records.join(found, "record_id")
        names.append(both.filter("trim(name) <> ''").select("entity", F.lit(source.priority).alias("priority"), F.trim("name").alias("name"), F.lit(source.name).alias("source")))
        members.append(found.select("record_id", "entity", F.lit(source.name).alias("source")))
        issues.append(both.filter("ambiguous").select(F.lit("ambiguous_entity_match").alias("issue_type"), F.lit(source.name).alias("source"), "record_id", fold(F.col("name")).alias("label"), "low", "high", F.lit(None).cast("long").alias("occurrence_count")))
        named = both.select("entity", F.trim("name").alias("alias"), F.lit("legal_or_issuer_name").alias("alias_type"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("occurrence_count"), F.lit(source.name).alias("source"))
        aliases.append(named)
        if source.aliases is not None:
            aliases.append(source.aliases.join(found.select("record_id", "entity"), "record_id").select("entity", F.trim("alias").alias("alias"), "alias_type", "confidence", "occurrence_count", F.lit(source.name).alias("source")))
        fresh = _keys(records).join(found.select("record_id", "entity"), "record_id").select("entity", "scheme", "value")
        if source.known_symbols:
            held = keys.filter("scheme = 'symbol'").select("scheme", "value").distinct()
            fresh = fresh.filter("scheme <> 'symbol'").unionByName(fresh.join(held, ["scheme", "value"], "left_semi").select("entity", "scheme", "value"))
        keys = cut(keys.unionByName(fresh).distinct())
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Reference(keys, union(names), folded_aliases(union(aliases)), union(issues), union(members))


def folded_aliases(rows: DataFrame) -> DataFrame:
    """One row per (entity, normalized_alias, alias_type): the first spelling, the highest confidence, summed occurrences."""
    rows = rows.withColumn("normalized_alias", fold(F.coalesce("alias", F.lit("")))).filter("normalized_alias <> ''")
    first = F.min(F.struct(F.lower("alias").alias("l"), F.col("alias").alias("v")))
    return rows.groupBy("entity", "normalized_alias", "alias_type").agg(first.getField("v").alias("alias"), F.max("confidence").alias("confidence"), F.sum(F.coalesce("occurrence_count", F.lit(0))).alias("occurrence_count"), F.array_sort(F.collect_set("source")).alias("sources"))


def link_labels(rows: DataFrame, reference: Reference, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, issues) of disclosure labels: linked only through a ticker that leads to exactly one organization.

    evidence has the supported (ticker, normalized_alias). A label of a ticker with evidence that isn't among its supported
    ones is an issue, and so is a ticker that leads nowhere or to several.
    """
    rows = counted_labels(rows).withColumn("ticker", symbol(F.col("ticker"))).withColumn("label", F.trim("label")).filter("ticker is not null and label <> ''")
    first = F.min(F.struct(F.lower("label").alias("l"), F.col("label").alias("v")))
    groups = rows.groupBy(fold(F.col("label")).alias("normalized_alias"), "ticker", "source_dataset").agg(first.getField("v").alias("label"), F.sum("n").alias("occurrence_count"))
    known = reference.keys.filter("scheme = 'symbol'").groupBy(F.col("value").alias("ticker")).agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    supported = evidence.select("ticker", "normalized_alias").distinct().withColumn("supported", F.lit(True))
    tickers = evidence.select("ticker").distinct().withColumn("has_evidence", F.lit(True))
    met = groups.join(known, "ticker", "left").join(tickers, "ticker", "left").join(supported, ["ticker", "normalized_alias"], "left")
    kind = (
        F.when(F.col("has_evidence") & F.col("supported").isNull(), "unsupported_sec_alias_label")
        .when(F.col("has_evidence"), "supported")
        .when(F.col("low").isNull(), "unresolved_disclosed_ticker")
        .when(F.col("low") != F.col("high"), "ambiguous_disclosed_ticker")
        .otherwise("linked")
    )
    met = met.withColumn("kind", kind)
    linked = met.filter("kind = 'linked'").select(F.col("low").alias("entity"), F.col("label").alias("alias"), F.lit("disclosure_asset_label").alias("alias_type"), F.lit(1.0).alias("confidence"), "occurrence_count", F.lit("disclosure_labels").alias("source"))
    issues = met.filter(~F.col("kind").isin("linked", "supported")).select(F.col("kind").alias("issue_type"), F.lit("disclosure_labels").alias("source"), F.concat_ws(":", "ticker", "source_dataset").alias("record_id"), F.col("normalized_alias").alias("label"), "low", "high", "occurrence_count")
    return linked, issues
