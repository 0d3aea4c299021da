"""Taxa by name prefix, their names, and counts of what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.tables import small

LEAST_CHARACTERS = 3


def check_term(term: str) -> str:
    if len(term) < LEAST_CHARACTERS:
        raise ValueError(f"`term` needs at least {LEAST_CHARACTERS} characters")
    return term


def name_matches(term_col: Column, level_col: Column, term: str, level: str) -> Column:
    """Prefix match without case; % and _ in term are wildcards. Only the parameter's level is lower-cased."""
    return term_col.ilike(term + "%") & (level_col == F.lower(F.lit(level)))


def resolve_taxa(taxon_to_term: DataFrame, term: str, level: str, distinct: bool = True) -> DataFrame:
    """Taxa (one column, taxon) of the terms that begin with term. For semi joins leave distinct out: they don't need it."""
    found = taxon_to_term.where(name_matches(F.col("term"), F.col("level"), term, level)).select("taxon")
    return found.distinct() if distinct else found


def resolve_taxa_names(taxon_to_name: DataFrame, taxa: DataFrame) -> DataFrame:
    """Distinct lower-cased names (one column, name) of taxa, without empty ones."""
    return taxon_to_name.where("name != ''").join(small(taxa), "taxon", "left_semi").select(F.lower("name").alias("name")).distinct()


def count_occurrences(narrow: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row, count: occurrences of taxa with coordinates (x and y)."""
    return narrow.where("x is not null and y is not null").join(small(taxa), "taxon", "left_semi").agg(F.count("*").alias("count"))


def ranges_of(ranges: DataFrame, names: DataFrame) -> DataFrame:
    """The ranges (rows) of species whose names, in lower case, are named."""
    return ranges.join(small(names), F.lower(ranges["binomial"]) == names["name"], "left_semi")


def count_ranges(ranges: DataFrame, names: DataFrame) -> DataFrame:
    return ranges_of(ranges, names).agg(F.count("*").alias("count"))


def data_sources(occurrences: DataFrame, ranges: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """Two rows, name and count, from the one-row counts of occurrences and of ranges."""
    first, second = (df.select(F.lit(label).alias("name"), "count") for df, label in zip((occurrences, ranges), labels, strict=True))
    return first.unionByName(second)


def search_species(taxonomy: DataFrame, term: str, level: str) -> DataFrame:
    """Terms that begin with term, sorted, with repeats."""
    check_term(term)
    return taxonomy.where(name_matches(F.col("term"), F.col("level"), term, level)).select("term").orderBy("term")
