"""Every operator as a named query over the driver's tables: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalens.fixtures import SEED_TITLES, table, view
from catalens.functions import scalars as S
from catalens.functions.stem import stem_text
from catalens.functions.stopwords import load_stop_words
from catalens.operators import charts, profile, vectors
from catalens.plans import laptops, movies, price_models as models, recommend
from catalens.plans.kernel import KernelRegressor
from catalens.session import shared_dir
from catalens.sources import tables
from catalens.sources.posters import with_posters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = movies.KEYS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _laptops(spark, sf) -> DataFrame:
    return view(spark, sf, "laptop_raw")


def _parsed(spark, sf) -> DataFrame:
    return laptops.parsed(_laptops(spark, sf))


def _features(spark, sf) -> DataFrame:
    return laptops.feature_table(_laptops(spark, sf))


def _rows(spark, sf) -> DataFrame:
    return movies.merged(view(spark, sf, "movies_raw"), view(spark, sf, "credits_raw"))


def _facets(spark, sf) -> DataFrame:
    return movies.facets(_rows(spark, sf))


def _catalogue(spark, sf, *parts: str, **options) -> recommend.Catalogue:
    return recommend.build(
        view(spark, sf, "movies_raw"), view(spark, sf, "credits_raw"), load_stop_words(), parts, **options
    )


# --- sources and sinks ----------------------------------------------------------------------------------------------


def _new_path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _through_csv(spark, df: DataFrame, schema: str, line_breaks: bool = True) -> DataFrame:
    path = _new_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, schema, line_breaks)


@query
def q_csv_laptops(spark, sf):
    return _through_csv(spark, _laptops(spark, sf), tables.LAPTOPS, line_breaks=False)


@query
def q_csv_movies(spark, sf):
    """JSON columns with doubled quotes and texts with line breaks survive the CSV form."""
    return _through_csv(spark, view(spark, sf, "movies_raw"), tables.MOVIES)


@query
def q_csv_credits(spark, sf):
    return _through_csv(spark, view(spark, sf, "credits_raw"), tables.CREDITS)


@query
def q_table_store(spark, sf):
    path = _new_path(spark, "table")
    tables.write_table(_laptops(spark, sf), path)
    return tables.read_table(spark, path)


@query
def q_neighbour_store(spark, sf):
    """Genre neighbours stored as a table by facet, one facet read back."""
    path = _new_path(spark, "neighbours")
    tables.write_neighbours(recommend.nearest_all(_catalogue(spark, sf, "genre"), "genre"), path)
    return tables.read_table(spark, path).where(F.col("facet") == "genre")


@query
def q_neighbour_lookup(spark, sf):
    """Neighbours of the chosen titles, both facets, from a bucketed store that reads their buckets alone."""
    catalogue = _catalogue(spark, sf, "content", "genre")
    near = recommend.nearest_all(catalogue, "content").unionByName(recommend.nearest_all(catalogue, "genre"))
    name = f"neighbours_{uuid.uuid4().hex}"
    tables.write_neighbour_buckets(near, name, _new_path(spark, "neighbours"))
    return recommend.stored_neighbours(catalogue, tables.read_neighbour_buckets(spark, name), SEED_TITLES)


@query
def q_model_store(spark, sf):
    """A stored pipeline, loaded again, predicts the same for every hold-out row."""
    train, test = _sides(spark, sf)
    path = _new_path(spark, "model")
    model = models.fit(models.tree(), models.fit_encoder(train), train)
    tables.save_model(model, path)
    again = tables.load_model(path).transform(test).select(models.KEY, F.col("prediction").alias("again"))
    both = model.transform(test).join(again, models.KEY)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("again")).alias("n_same")).select(
        F.lit("tree").alias("model"), "n", "n_same")


@query
def q_poster_enrich(spark, sf):
    return with_posters(_rows(spark, sf).select("movie_id", "id", "title"), view(spark, sf, "posters"))


# --- profiling ------------------------------------------------------------------------------------------------------


@query
def q_shape(spark, sf):
    return profile.shape(_laptops(spark, sf))


@query
def q_info(spark, sf):
    return profile.info(_laptops(spark, sf))


@query
def q_null_counts(spark, sf):
    return profile.null_counts(_laptops(spark, sf))


@query
def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


@query
def q_head(spark, sf):
    return profile.head(_laptops(spark, sf), ["unnamed_0"])


@query
def q_sample_n(spark, sf):
    return profile.sample_rows(_laptops(spark, sf), "unnamed_0", 5, seed=7)


@query
def q_value_counts(spark, sf):
    return profile.value_counts(_laptops(spark, sf), "memory")


@query
def q_value_counts_gpu(spark, sf):
    return profile.value_counts(_parsed(spark, sf), "gpu_brand")


@query
def q_unique_first_seen(spark, sf):
    return profile.unique_in_order(_laptops(spark, sf), "company", "unnamed_0")


@query
def q_distinct_directors(spark, sf):
    people = recommend.members(_facets(spark, sf), "director").withColumnRenamed("person", "director")
    return profile.distinct_value_counts(people, "director")


@query
def q_distinct_sketch(spark, sf):
    """Exact distinct counts per line status, and whether those of united, stored sketches per return flag are within their error."""
    lines, columns = table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
    path = _new_path(spark, "sketches")
    tables.write_table(profile.distinct_sketches(lines, columns, ["l_linestatus", "l_returnflag"]), path)
    found = profile.distinct_estimates(tables.read_table(spark, path), columns, ["l_linestatus"])
    exact = lines.groupBy("l_linestatus").agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot(
        "l_linestatus", columns, "column_name", "n_distinct")
    off = F.abs(F.col("estimate") - F.col("n_distinct"))
    return found.join(exact, ["l_linestatus", "column_name"]).select(
        "l_linestatus", "column_name", "n_distinct", (off <= profile.sketch_error() * F.col("n_distinct") + 0.5).alias("within_error"))


@query
def q_corr_target(spark, sf):
    return profile.correlation_with(_parsed(spark, sf), "price")


# --- chart data -----------------------------------------------------------------------------------------------------


@query
def q_mean_by_category(spark, sf):
    return charts.mean_by_category(_laptops(spark, sf), "company", "price")


@query
def q_bootstrap_ci(spark, sf):
    return charts.bootstrap_interval(_laptops(spark, sf), "company", "price", "unnamed_0")


@query
def q_bootstrap_by_value(spark, sf):
    """Mean per type, and whether the interval by equal rows holds it and has a width above zero."""
    rows = _laptops(spark, sf)
    both = charts.mean_by_category(rows, "type_name", "price").join(charts.bootstrap_by_value(rows, "type_name", "price"), "type_name")
    inside = (F.col("low") < F.col("mean_value")) & (F.col("mean_value") < F.col("high"))
    return both.select("type_name", "mean_value", "n", inside.alias("inside"))


@query
def q_histogram(spark, sf):
    return charts.histogram(_laptops(spark, sf), "price")


@query
def q_histogram_lineitem(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query
def q_histogram_log(spark, sf):
    return charts.histogram(_laptops(spark, sf).select(F.log("price").alias("log_price")), "log_price")


@query
def q_kde(spark, sf):
    return charts.density(_laptops(spark, sf), "price")


@query
def q_kde_log(spark, sf):
    return charts.density(_laptops(spark, sf).select(F.log("price").alias("log_price")), "log_price")


@query
def q_scatter_grid(spark, sf):
    return charts.scatter_grid(_laptops(spark, sf), "inches", "price")


# --- projections, filters, predicates -------------------------------------------------------------------------------


@query
def q_laptop_features(spark, sf):
    return _features(spark, sf).withColumns(
        {"weight": F.col("weight").cast("double"), "ppi": F.round("ppi", 9), "label": F.round("label", 9)}
    )


@query
def q_movie_base(spark, sf):
    return _rows(spark, sf)


@query
def q_cast_clean(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "ram", F.col("weight").cast("double").alias("weight"))


@query
def q_cast_rejects(spark, sf):
    return profile.rejects(
        _laptops(spark, sf),
        {
            "ram_with_unit": (F.col("ram"), F.col("ram").try_cast("int")),
            "ram": (F.col("ram"), laptops.ram_gb(strict=False)),
            "weight": (F.col("weight"), laptops.weight_kg(strict=False)),
            "screen_resolution": (F.col("screen_resolution"), laptops.screen(strict=False)),
            "memory": (F.col("memory"), laptops.storage(strict=False)),
        },
    )


@query
def q_reject_counts(spark, sf):
    """Unreadable JSON lists of the catalogue, and feature values without which a row takes no part in the models."""
    lists = {"genres": S.NAME_LIST, "keywords": S.NAME_LIST, "cast": S.NAME_LIST, "crew": S.CREW_LIST}
    read = {c: (F.col(c), S.objects(F.col(c), kind)) for c, kind in lists.items()}
    return profile.rejects(_rows(spark, sf), read).unionByName(
        profile.null_counts(_features(spark, sf)).where(F.col("column_name").isin(laptops.FEATURES)).select(
            F.col("column_name").alias("check_name"), F.col("n_nulls").alias("n_rejects")))


def _checks() -> dict:
    return {
        "ram_with_unit": (F.col("ram"), F.col("ram").try_cast("int"), "not a whole number"),
        "weight": (F.col("weight"), laptops.weight_kg(strict=False), "not a number of kilograms"),
        "screen_resolution": (F.col("screen_resolution"), laptops.screen(strict=False), "no resolution"),
        "gpu_maker": (F.col("gpu"), F.nullif(S.first_word(F.col("gpu")), F.lit("ARM")), "maker not in use"),
    }


@query
def q_reject_rows(spark, sf):
    """Every listing value that a check refuses, with its text and the reason, written as a table and read back."""
    path = _new_path(spark, "rejects")
    profile.write_rejects(_laptops(spark, sf), "unnamed_0", _checks(), path)
    return tables.read_table(spark, path).select("unnamed_0", "check_name", "raw_text", "reason")


@query
def q_reject_observed(spark, sf):
    """The counts that were observed while that table was written."""
    counts = profile.write_rejects(_laptops(spark, sf), "unnamed_0", _checks(), _new_path(spark, "rejects"))
    return spark.createDataFrame(list(counts.items()), "check_name string, n bigint")


@query
def q_dropna(spark, sf):
    return _rows(spark, sf).select(*KEYS, "title")


@query
def q_filter_not_arm(spark, sf):
    return laptops.without_arm(_parsed(spark, sf)).select("unnamed_0", "gpu_brand")


@query
def q_filter_eq(spark, sf):
    return _facets(spark, sf).where(F.get("director", 0) == "Director 7").select(*KEYS, "title")


@query
def q_first_by_title(spark, sf):
    return movies.first_by_title(_rows(spark, sf))


@query
def q_validate_requests(spark, sf):
    return laptops.rejected_requests(view(spark, sf, "requests_raw"), _features(spark, sf))


@query
def q_request_features(spark, sf):
    return laptops.request_features(view(spark, sf, "requests_raw")).withColumns(
        {"weight": F.col("weight").cast("double"), "ppi": F.round("ppi", 9)}
    )


# --- joins and facets -----------------------------------------------------------------------------------------------


@query
def q_merge_title(spark, sf):
    left, right = view(spark, sf, "movies_raw"), view(spark, sf, "credits_raw")
    return left.join(right, "title").select("title", *KEYS)


@query
def q_same_director(spark, sf):
    return recommend.same_person(_catalogue(spark, sf), "director", SEED_TITLES, k=None)


@query
def q_same_actor(spark, sf):
    return recommend.same_person(_catalogue(spark, sf), "actor", SEED_TITLES, k=None)


@query
def q_director_top(spark, sf):
    return recommend.same_person(_catalogue(spark, sf), "director", SEED_TITLES)


@query
def q_actor_top(spark, sf):
    return recommend.same_person(_catalogue(spark, sf), "actor", SEED_TITLES)


@query
def q_sample_per_seed(spark, sf):
    return recommend.same_person_all(_catalogue(spark, sf), "director")


@query
def q_sample_per_seed_actor(spark, sf):
    return recommend.same_person_all(_catalogue(spark, sf), "actor")


@query
def q_content_topk(spark, sf):
    return recommend.nearest(_catalogue(spark, sf, "content"), "content", SEED_TITLES)


@query
def q_topk_many_seeds(spark, sf):
    """Every title of the catalogue is asked for at once."""
    catalogue = _catalogue(spark, sf, "content")
    wanted = movies.first_by_title(catalogue.titles).withColumnRenamed("title", "seed_title")
    return recommend.nearest_to(catalogue, "content", wanted)


@query
def q_sample_two_ways(spark, sf):
    """The random choice for a few titles against the one for all rows: how many rows differ."""
    catalogue = _catalogue(spark, sf)
    out = None
    for kind in ("director", "actor"):
        few = recommend.same_person(catalogue, kind, SEED_TITLES).select("seed_title", "rank", *KEYS)
        seeds = recommend.seed_rows(catalogue.titles, SEED_TITLES).select("seed_title", *[F.col(c).alias(f"seed_{c}") for c in KEYS])
        every = recommend.same_person_all(catalogue, kind).join(seeds, [f"seed_{c}" for c in KEYS])
        both = few.withColumn("few", F.lit(1)).join(
            every.select("seed_title", "rank", *KEYS, F.lit(1).alias("every")), ["seed_title", "rank", *KEYS], "full")
        part = both.agg(F.count("few").alias("n_rows"), F.count_if(F.expr("few IS NULL OR every IS NULL")).alias("n_different"))
        part = part.select(F.lit(kind).alias("facet"), "n_rows", "n_different")
        out = part if out is None else out.unionByName(part)
    return out


@query
def q_genre_topk(spark, sf):
    return recommend.nearest(_catalogue(spark, sf, "genre"), "genre", SEED_TITLES)


@query
def q_recommend_all(spark, sf):
    return recommend.recommend(_catalogue(spark, sf, "content", "genre"), SEED_TITLES)


@query
def q_recommend_links(spark, sf):
    """All four facets with poster and link."""
    answer = recommend.recommend(_catalogue(spark, sf, "content", "genre"), SEED_TITLES)
    return with_posters(answer, view(spark, sf, "posters"), bounded=True)


@query
def q_similar_all(spark, sf):
    return recommend.nearest_all(_catalogue(spark, sf, "content"), "content")


@query
def q_similar_lsh(spark, sf):
    """Most of the rows of q_similar_all, found by buckets; the share that is found is in the tests."""
    return recommend.nearest_some(_catalogue(spark, sf, "content"), "content")


@query
def q_genre_all(spark, sf):
    return recommend.nearest_all(_catalogue(spark, sf, "genre"), "genre")


@query
def q_tfidf_topk(spark, sf):
    return recommend.nearest(_catalogue(spark, sf, "content", tfidf=True), "content", SEED_TITLES, digits=9)


@query
def q_stemmed_topk(spark, sf):
    return recommend.nearest(_catalogue(spark, sf, "content", stem=True), "content", SEED_TITLES)


# --- scalar functions -----------------------------------------------------------------------------------------------


@query
def q_strip_units(spark, sf):
    return _laptops(spark, sf).select(
        "unnamed_0",
        S.strip_literal(F.col("ram"), "GB").alias("ram"),
        S.strip_literal(F.col("weight"), "kg").alias("weight"),
        F.replace(S.strip_literal(F.col("memory"), "GB"), F.lit("TB"), F.lit("000")).alias("memory"),
    )


@query
def q_flags(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "touchscreen", "ips")


@query
def q_split_once(spark, sf):
    plain = F.replace(S.strip_literal(F.col("memory"), "GB"), F.lit("TB"), F.lit("000"))
    first, second = S.split_once(plain, r"\+")
    return _laptops(spark, sf).select("unnamed_0", first.alias("first_part"), second.alias("second_part"))


@query
def q_resolution(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "x_res", "y_res")


@query
def q_ppi(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", F.round("ppi", 9).alias("ppi"))


@query
def q_storage_parse(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "hdd", "ssd", "hybrid", "flash_storage")


@query
def q_storage_fixed(spark, sf):
    """Storage with "1.0TB" read as 1000 instead of 10000."""
    first, second = S.storage_parts(F.col("memory"), fix_decimal_tb=True)
    hybrid = S.storage_of_kind(first, second, "Hybrid", S.digits(first), S.digits(second))
    return _laptops(spark, sf).select("unnamed_0", hybrid.alias("hybrid"))


@query
def q_cpu_name(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "cpu_name")


@query
def q_cpu_brand(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "cpu_brand")


@query
def q_gpu_brand(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "gpu_brand")


@query
def q_os_category(spark, sf):
    return _parsed(spark, sf).select("unnamed_0", "os")


@query
def q_log_price(spark, sf):
    label = F.log("price")
    return _laptops(spark, sf).select(
        "unnamed_0", F.round(label, 9).alias("label"), S.whole_price(label - 0.00001).alias("whole_price")
    )


@query
def q_json_names(spark, sf):
    lists = {c: S.json_names(F.col(c)) for c in ("genres", "keywords")}
    return view(spark, sf, "movies_raw").select("id", *[F.array_join(v, "|").alias(c) for c, v in lists.items()])


@query
def q_python_lists(spark, sf):
    """Lists in JSON and in Python notation: their names, those with a job, and whether they can be read."""
    names, directors = S.json_names(F.col("items")), S.names_with_job(F.col("items"), "Director", 1)
    return view(spark, sf, "lists_raw").select(
        "doc_id", names.isNotNull().alias("readable"), F.size(names).cast("long").alias("n_names"),
        F.array_join(names, "|", "?").alias("names"), F.array_join(directors, "|", "?").alias("director"))


@query
def q_top3_cast(spark, sf):
    return _facets(spark, sf).select(*KEYS, F.array_join("cast", "|").alias("actors"))


@query
def q_director(spark, sf):
    return _facets(spark, sf).select(*KEYS, F.get("director", 0).alias("director"))


@query
def q_overview_words(spark, sf):
    return _facets(spark, sf).select(
        *KEYS, F.size("overview").cast("long").alias("n_words"), F.array_join("overview", " ").alias("words")
    )


@query
def q_remove_space(spark, sf):
    return _facets(spark, sf).select(
        *KEYS,
        F.array_join(S.close_up(F.col("genres")), "|").alias("genres"),
        F.array_join(S.close_up(F.col("cast")), "|").alias("actors"),
    )


@query
def q_tags(spark, sf):
    return movies.tags(_facets(spark, sf))


# --- text vectors ---------------------------------------------------------------------------------------------------


@query
def q_stem_vocab(spark, sf):
    """Stem of every distinct whitespace word of the documents."""
    words = table(spark, sf, "documents").select(F.explode(S.words(F.lower("text"))).alias("term")).distinct()
    return words.select("term", stem_text("term").alias("stem"))


@query
def q_tokens(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", vectors.tokens(F.col("text")).alias("t"))
    return found.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_terms"),
        F.array_join("t", " ").alias("tokens"),
    )


@query
def q_stopwords(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(vectors.tokens(F.col("text"))).alias("term"))
    return terms.where(~F.col("term").isin(load_stop_words())).groupBy("term").agg(F.count("*").alias("n"))


@query
def q_vocab_topn(spark, sf):
    """The content vocabulary in two scans: a sketch names candidates, which alone are counted."""
    return vectors.frequent_terms(movies.tags(_facets(spark, sf)), "tags", load_stop_words(), recommend.CONTENT_TERMS)


@query
def q_vocab_documents(spark, sf):
    """The 100 most frequent terms of all documents."""
    return vectors.frequent_terms(table(spark, sf, "documents"), "text", load_stop_words(), 100)


@query
def q_vocab_genre(spark, sf):
    counts = vectors.term_counts(movies.genre_texts(_facets(spark, sf)), KEYS, "tags", load_stop_words())
    return vectors.vocabulary(counts, recommend.GENRE_TERMS)


@query
def q_term_counts(spark, sf):
    return vectors.vocabulary_counts(
        movies.tags(_facets(spark, sf)), KEYS, "tags", load_stop_words(), recommend.CONTENT_TERMS, numbered_terms=False
    )


@query
def q_term_counts_frequent(spark, sf):
    """The same counts with the vocabulary found first."""
    return vectors.frequent_counts(
        movies.tags(_facets(spark, sf)), KEYS, "tags", load_stop_words(), recommend.CONTENT_TERMS, numbered_terms=False
    )


# --- regression -----------------------------------------------------------------------------------------------------


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    return models.split(models.model_rows(_features(spark, sf)))


@query
def q_split(spark, sf):
    return models.model_rows(_features(spark, sf)).select(models.KEY, F.col("is_test").cast("int").alias("is_test"))


@query
def q_onehot(spark, sf):
    rows = models.model_rows(_features(spark, sf))
    return models.encoded_columns(models.fit_encoder(rows.where(~F.col("is_test"))), rows)


@query
def q_ols_simple(spark, sf):
    return models.simple_least_squares(_sides(spark, sf)[0], "ppi")


@query
def q_knn3(spark, sf):
    found = models.three_nearest(*_sides(spark, sf))
    return found.select(models.KEY, F.round("label", 6).alias("label"), F.round("prediction", 6).alias("prediction"))


@query
def q_metrics(spark, sf):
    train, test = _sides(spark, sf)
    nearest = models.metrics(models.three_nearest(train, test), "knn3")
    return nearest.unionByName(models.metrics(models.mean_prediction(train, test), "mean"))


def _judged(train: DataFrame, test: DataFrame, name: str, model) -> DataFrame:
    """(model, n, in_range, beats_mean): hold-out rows, whether all predictions lie between the smallest and largest training
    label, and whether R2 is above zero and the mean error below that of the training mean."""
    low, high, mean = train.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    gap, off = F.col("label") - F.col("prediction"), F.abs(F.col("label") - mean)
    return model.transform(test).agg(
        F.count("*").alias("n"), F.every(F.col("prediction").between(low - 1e-9, high + 1e-9)).alias("in_range"),
        ((F.sum(gap * gap) < F.var_pop("label") * F.count("label")) & (F.avg(F.abs(gap)) < F.avg(off))).alias("beats_mean"),
    ).select(F.lit(name).alias("model"), "n", "in_range", "beats_mean")


def _fitted(spark, sf, name: str, estimator) -> DataFrame:
    train, test = _sides(spark, sf)
    return _judged(train, test, name, models.fit(estimator, models.fit_encoder(train), train))


@query
def q_ols(spark, sf):
    """Residuals of least squares are orthogonal to every encoded feature."""
    train, _ = _sides(spark, sf)
    encoder = models.fit_encoder(train)
    names = [*models.encoded_names(encoder), *laptops.NUMERIC, "intercept"]
    found = models.moments(models.fit(models.least_squares(), encoder, train).transform(train))
    return found.select(F.get(F.array(*map(F.lit, names)), "slot").alias("feature"), "moment")


@query
def q_tree(spark, sf):
    """A leaf holds the mean label of its training rows: over these, predictions average like labels, and what they leave is
    orthogonal to them."""
    train, test = _sides(spark, sf)
    model = models.fit(models.tree(), models.fit_encoder(train), train)
    fitted, gap = F.col("prediction"), F.col("label") - F.col("prediction")
    mean, moment = model.transform(train).agg(F.round(F.avg(fitted), 9), F.round(F.avg(fitted * gap), 9) + 0.0).first()
    return _judged(train, test, "tree", model).withColumns({"train_mean": F.lit(mean), "train_moment": F.lit(moment)})


@query
def q_forest(spark, sf):
    return _fitted(spark, sf, "forest", models.forest())


@query
def q_rbf_svr(spark, sf):
    return _fitted(spark, sf, "kernel", KernelRegressor()).drop("in_range")


@query
def q_leaderboard(spark, sf):
    """All five models on the same hold-out rows; that each beats the mean is what SQL can tell, the values are in tests."""
    train, test = _sides(spark, sf)
    out = None
    for name, model in models.fit_all(train).items():
        part = _judged(train, test, name, model).drop("in_range")
        out = part if out is None else out.unionByName(part)
    return out


def _priced(spark, sf, train: DataFrame) -> DataFrame:
    """Requests that break no rule, priced by the forest, which is stored and loaded again before."""
    path = _new_path(spark, "model")
    tables.save_model(models.fit(models.forest(), models.fit_encoder(train), train), path)
    requests = view(spark, sf, "requests_raw")
    rejected = laptops.rejected_requests(requests, train).select("request_id").distinct()
    accepted = laptops.request_features(requests.join(rejected, "request_id", "left_anti"))
    return models.score_requests(tables.load_model(path), accepted)


@query
def q_score_requests(spark, sf):
    """The price of every accepted request lies inside the range of training prices."""
    train, _ = _sides(spark, sf)
    low, high = train.agg(F.min("price"), F.max("price")).first()
    return _priced(spark, sf, train).select("request_id", F.col("price").between(int(low) - 1, int(high)).alias("in_range"))


@query
def q_request_prices(spark, sf):
    """The prices themselves; a test walks the stored trees for them."""
    return _priced(spark, sf, _sides(spark, sf)[0])
