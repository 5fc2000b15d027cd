"""Movie catalogue: from the two raw tables to facets and tag texts.

A movie row is known by (id, movie_id): the title join repeats both ids when several movies share a title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalens.functions import scalars as S
from catalens.functions.stem import stem_text

KEYS = ["id", "movie_id"]


def merged(movies: DataFrame, credits: DataFrame) -> DataFrame:
    """Inner join on title, pruned to the columns in use, incomplete rows dropped.

    Pruning before the join keeps the shuffled rows narrow, and the null filter reaches both scans.
    """
    left = movies.select("id", "title", "overview", "genres", "keywords").dropna("any")
    right = credits.select("movie_id", "title", "cast", "crew").dropna("any")
    return left.join(right, "title").select("id", "movie_id", "title", "overview", "genres", "keywords", "cast", "crew")


def facets(rows: DataFrame) -> DataFrame:
    """Parsed lists per movie row; an unreadable list is null and takes part in no answer (see ``profile.rejects``)."""
    return rows.select(
        *KEYS, "title",
        S.words(F.col("overview")).alias("overview"), S.spaced(F.col("overview")).alias("overview_text"),
        S.json_names(F.col("genres")).alias("genres"),
        S.json_names(F.col("keywords")).alias("keywords"),
        S.first_names(F.col("cast"), 3).alias("cast"),
        S.names_with_job(F.col("crew"), "Director", 1).alias("director"),
    )


def tags(facet_rows: DataFrame, stem: bool = False) -> DataFrame:
    """(id, movie_id, title, tags): overview words, then genre, keyword, cast and director names without inner spaces."""
    overview = F.when(F.col("overview_text").isNotNull(), F.array_remove(F.array("overview_text"), ""))
    text = S.tag_text(
        overview, *[S.close_up(F.col(c)) for c in ("genres", "keywords", "cast", "director")]
    )
    return facet_rows.select(*KEYS, "title", (stem_text(text) if stem else text).alias("tags"))


def genre_texts(facet_rows: DataFrame) -> DataFrame:
    """Genre names with their spaces kept, so "Science Fiction" is two words."""
    return facet_rows.select(*KEYS, "title", F.array_join("genres", " ").alias("tags"))


def first_by_title(rows: DataFrame) -> DataFrame:
    """The first row of every title: a minimum, so a title shared by many rows costs one row per task."""
    first = rows.groupBy("title").agg(F.min(F.struct(*KEYS)).alias("first"))
    return first.select("title", *[F.col(f"first.{k}").alias(k) for k in KEYS])
