"""Lexicon of root words.

The lexicon is a one-column DataFrame ``root``: the built-in words, plus the
whitespace-separated words of an optional user file, de-duplicated.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_whitespace
from ..session import is_local, path_exists

# The built-in root words, in their original order (67 entries,
# 63 distinct; "Crisis" is listed four times).
BUILTIN_ROOTS = [
    "Presidente", "Presidencial", "Gobierno", "Crisis", "Elección", "Elecciones", "Ley", "Ministro", "Economía", "Defensa",
    "Inflación", "Desempleo", "Reforma", "Diplomático", "Crisis", "Ataque", "Seguridad", "Migración",
    "Infección", "Hospital", "Tecnología", "Tecnológico", "Innovación", "Ciberseguridad", "Clima", "Energía",
    "Guerra", "Conflicto", "Policía", "Crimen", "Corrupción", "Arresto", "Caos", "Protesta",
    "President", "Presidential", "Government", "Crisis", "Election", "Law", "Minister", "Economy", "Defense",
    "Inflation", "Unemployment", "Reform", "Diplomatic", "Crisis", "Attack", "Security", "Migration",
    "Infection", "Hospital", "Technology", "Technologic", "Innovation", "Cybersecurity", "Climate", "Energy",
    "War", "Conflict", "Police", "Crime", "Corruption", "Arrest", "Chaos", "Protest",
]

# Default location of the user's extra words (home folder, as a config file), for
# sessions on one machine: a cluster's executors do not see the driver's home.
DEFAULT_USER_FILE = "file://" + os.path.join(os.path.expanduser("~"), ".gacetilla", "root_words.txt")


def _literal_words(spark: SparkSession, words) -> DataFrame:
    # A JVM-side literal relation: no Python worker is started for it.
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("root"))


def builtin_lexicon(spark: SparkSession) -> DataFrame:
    return _literal_words(spark, BUILTIN_ROOTS).distinct()


def words_lexicon(spark: SparkSession, words) -> DataFrame:
    """Extra words given in code (split on white space like the file)."""
    return (_literal_words(spark, [" ".join(words)])
            .select(F.explode(split_whitespace("root")).alias("root")))


def file_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Words of a text file, split on any white space."""
    return (spark.read.text(path)
            .select(F.explode(split_whitespace("value")).alias("root")))


def combined_lexicon(spark: SparkSession, user_file: str | None = DEFAULT_USER_FILE,
                     extra_words=None, extra: DataFrame | None = None) -> DataFrame:
    """Built-ins UNION DISTINCT user words (U2).  The file may be on any file
    system Spark reads and is read anew by every query; a missing one adds
    nothing.  The default file counts in local sessions only; on a cluster name
    one that all executors see."""
    lex = builtin_lexicon(spark)
    if user_file == DEFAULT_USER_FILE and not is_local(spark):
        user_file = None
    if user_file and path_exists(spark, user_file):
        lex = lex.unionByName(file_lexicon(spark, user_file))
    if extra_words:
        lex = lex.unionByName(words_lexicon(spark, extra_words))
    if extra is not None:
        lex = lex.unionByName(extra.select(F.col(extra.columns[0]).alias("root")))
    return lex.distinct()
