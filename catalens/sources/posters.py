"""Poster and link columns for recommended movies, from a poster dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The image folder, the default image and the movie page.
IMAGE_BASE = "http://image.tmdb.org/t/p/w500"
DEFAULT_IMAGE = "https://via.placeholder.com/500x750?text=No+Image+Available"
MOVIE_PAGE = "https://www.themoviedb.org/movie/"


def with_posters(rows: DataFrame, posters: DataFrame, bounded: bool = False) -> DataFrame:
    """Add ``poster`` (the default image where the table has no path) and ``link``.

    Posters are made unique first, so that no row is repeated. When the caller knows ``rows`` to be ``bounded`` (the
    answer for a few seeds), their ids are broadcast and the poster table is cut down while it is scanned; otherwise the
    optimizer picks the join.
    """
    if bounded:
        posters = posters.join(F.broadcast(rows.select("movie_id").distinct()), "movie_id", "left_semi")
    one_each = posters.groupBy("movie_id").agg(F.min("poster_path").alias("poster_path"))
    path = F.nullif(F.col("poster_path"), F.lit(""))
    return (
        rows.join(one_each, "movie_id", "left")
        .withColumn("poster", F.coalesce(F.concat(F.lit(IMAGE_BASE), path), F.lit(DEFAULT_IMAGE)))
        .withColumn("link", F.concat(F.lit(MOVIE_PAGE), F.col("movie_id").cast("string"), F.lit("-"), F.col("title")))
        .drop("poster_path")
    )
