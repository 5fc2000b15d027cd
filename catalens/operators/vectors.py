"""Bag-of-words document vectors in sparse form. Terms are counted in slices of some documents, so documents are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from catalens.session import materialize

# A token is a run of two or more word characters.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
TOKEN = f"{WORD_CHARACTER}{{2,}}"
#: Terms that the sketch of a first scan follows; it may grow to the largest size the sketch has.
TRACKED = 1 << 16
MAX_TRACKED = 1_000_000
#: Bytes of text that make a slice; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Characters whose words are found at once; few, so that the arrays stay in the processor's cache.
PIECE_CHARS = 1 << 19
#: Documents that make a slice when their terms are counted already.
SLICE_ROWS = 1024
#: Groups of tasks whose sketches are merged before the last merge.
SKETCH_GROUPS = 256


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _words(docs: DataFrame, keys: list[str], text: str, stop_words: list[str]) -> DataFrame:
    words = docs.select(*keys, text).select(*keys, F.explode(tokens(F.col(text))).alias("term"))
    return words.where(~F.col("term").isin(stop_words))


@cache
def _word_characters() -> bytes:
    """One bit for every code point: whether it is a word character. Spark's own expression says so, as Python knows other letters."""
    texts = ["".join(map(chr, range(a, a + 4096))) for a in range(0, 0x110000, 4096) if not 0xD000 <= a <= 0xDFFF]
    texts.append("".join(map(chr, range(0xD000, 0xD800))))  # what follows are surrogates
    found = SparkSession.active().createDataFrame([(t,) for t in texts], "t string").select(
        F.array_join(F.regexp_extract_all("t", F.lit(f"{WORD_CHARACTER}+"), F.lit(0)), "").alias("t"))
    inside = np.zeros(0x110000, bool)
    inside[[ord(c) for r in found.collect() for c in r["t"]]] = True
    return np.packbits(inside).tobytes()


def _tokens_of(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, token number) of all ``tokens`` of lower-case texts, in order, and the tokens, each once."""
    number, at, parts = [], 0, []
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= PIECE_CHARS:
            size, stop = size + len(texts[stop]), stop + 1
        of, found = _piece(texts[at:stop], inside)
        number.append(of + at)
        parts.append(found)
        at = stop
    chunks = pa.chunked_array(parts).unify_dictionaries().chunks
    return np.concatenate(number), np.concatenate([c.indices.to_numpy() for c in chunks]), chunks[0].dictionary


def _piece(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    word = inside[points]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    single = stop - start == 1
    word[start[single]] = False
    start, size, kept = start[~single], (stop - start)[~single], points[word]
    ends, data = np.cumsum(size), kept.tobytes().decode("utf-32-le").encode()
    if len(data) > len(kept) > 0:
        ends = np.cumsum(1 + (kept > 0x7F) + (kept > 0x7FF) + (kept > 0xFFFF), dtype=np.int64)[ends - 1]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
    begin = np.cumsum([len(t) + 1 for t in texts])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begin), prepend=0)), found.dictionary_encode()


#: A slice holds some documents (an array of their keys) and their terms, each once with its total and its number of documents.
#: The pairs go by document: ``ends`` says where those of each end, ``places`` which term, ``times`` how often it comes, both in as few
#: bytes as the largest number needs.
SLICE = "ends binary, places binary, times binary, terms array<struct<term string, tf long, df long>>"


def _slice_schema(docs: DataFrame, keys: list[str]) -> StructType:
    held = StructType([docs.schema[k] for k in keys])
    return StructType([StructField("docs", ArrayType(held)), *StructType.fromDDL(SLICE)])


def _slice(held: pa.StructArray, doc: np.ndarray, place: np.ndarray, times: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """One slice, of pairs that are in order of document."""
    total = np.zeros(len(terms), np.int64)
    np.add.at(total, place, times)
    spread = np.bincount(place, minlength=len(terms)).astype(np.int64)
    each = pa.StructArray.from_arrays([terms.cast(pa.string()), pa.array(total), pa.array(spread)], ["term", "tf", "df"])
    ends = np.searchsorted(doc, np.arange(len(held)), "right").astype(np.int64)
    parts = [pa.array([x.tobytes()], pa.binary()) for x in (ends, _narrow(place), _narrow(times))]
    whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (held, each)]
    return pa.RecordBatch.from_arrays([whole[0], *parts, whole[1]], ["docs", "ends", "places", "times", "terms"])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _bare(slices: DataFrame) -> DataFrame:
    """Slices without totals: ``terms`` is an array of words."""
    return slices.withColumn("terms", F.col("terms.term"))


def _open(batch: pa.RecordBatch) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(documents, document, place, times, terms) of every bare slice."""
    for i in range(batch.num_rows):
        held = batch.column("docs")[i].values
        ends = np.frombuffer(batch.column("ends")[i].as_buffer(), np.int64)
        pairs = int(ends[-1]) if len(ends) else 0
        cells = (batch.column(c)[i].as_buffer() for c in ("places", "times"))
        place, times = (np.frombuffer(x, f"u{x.size // pairs}" if pairs else np.uint8).astype(np.int64) for x in cells)
        doc = np.repeat(np.arange(len(held)), np.diff(ends, prepend=0))
        yield held, doc, place, times, batch.column("terms")[i].values


def _held(batch: pa.RecordBatch, keys: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([batch.column(k) for k in keys], keys)


def _sliced(docs: DataFrame, keys: list[str], text: str, stop_words: list[str]) -> DataFrame:
    """The terms of all rows in slices of ``SLICE_BYTES`` of text, counted from the sorted (document, term) pairs of a slice."""
    bits, stops = _word_characters(), pa.array(stop_words, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            texts, held = pc.fill_null(batch.column(len(keys)), ""), _held(batch, keys)
            before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(held):
                limit = SLICE_BYTES + (before[at - 1] if at else 0)
                stop = max(at + 1, int(np.searchsorted(before, limit, "right")))
                doc, place, terms = _tokens_of(texts.slice(at, stop - at).to_pylist(), inside)
                plain = ~pc.is_in(terms, value_set=stops).to_numpy(zero_copy_only=False)
                number, wanted = np.cumsum(plain) - 1, plain[place]
                pairs = np.sort(doc[wanted] << 32 | number[place[wanted]])
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                pair, times = pairs[first], np.diff(first, append=len(pairs))
                yield _slice(held.slice(at, stop - at), pair >> 32, pair & 0xFFFFFFFF, times, terms.filter(pa.array(plain)))
                at = stop

    return docs.select(*keys, F.lower(text)).mapInArrow(run, _slice_schema(docs, keys))


def _by_document(slices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts ARRAY<STRUCT<term, tf>>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, doc, place, times, terms in _open(batch):
                ends = np.searchsorted(doc, np.arange(-1, len(held)), "right")
                each = pa.StructArray.from_arrays([terms.take(pa.array(place)), pa.array(times)], ["term", "tf"])
                counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*held.flatten(), counts], [*keys, "counts"])

    counts = StructField("counts", StructType.fromDDL("c array<struct<term string, tf long>>")["c"].dataType)
    return _bare(slices).mapInArrow(run, StructType([*slices.schema["docs"].dataType.elementType, counts]))


def _from_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Slices of rows (keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                doc, cells = pc.list_parent_indices(part.column("counts")).to_numpy(zero_copy_only=False), part.column("counts").flatten()
                found = cells.field("term").dictionary_encode()
                yield _slice(_held(part, keys), doc, found.indices.to_numpy(), cells.field("tf").to_numpy(), found.dictionary)

    return rows.mapInArrow(run, _slice_schema(rows, keys))


def counted(docs: DataFrame, keys: list[str], text: str, stop_words: list[str]) -> DataFrame:
    """Stored slices; only rows that share their keys are brought together."""
    slices = materialize(_sliced(docs, keys, text, stop_words), "counted", large_rows=True)
    held = slices.select(F.explode("docs").alias("d")).select("d.*")
    again = materialize(held.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").drop("n_rows"), "repeated-keys")
    if again.isEmpty():
        return slices
    rows = _by_document(slices, keys)
    again = again.select(*[F.col(k).alias(f"again_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in keys])
    merged = rows.join(again, same, "left_semi").select(*keys, F.explode("counts").alias("c")).select(*keys, "c.term", "c.tf")
    merged = merged.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    merged = merged.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("counts"))
    return materialize(_from_documents(rows.join(again, same, "left_anti").unionByName(merged), keys), "counted", large_rows=True)


def _totals(slices: DataFrame) -> DataFrame:
    """(term, tf, df) of every slice: far fewer rows than pairs, as a slice has each of its terms once."""
    return slices.select(F.explode("terms").alias("t")).select("t.*")


def _each(slices: DataFrame, keys: list[str], top: list[Row] | None = None, numbered: bool = False) -> DataFrame:
    """(keys, term, tf) of every pair. With a vocabulary of rows (term, n, term_no) only of its terms; ``numbered`` adds n and term_no."""
    names, numbers = pa.array([r["term"] for r in top or ()], pa.string()), np.array([(r["n"], r["term_no"]) for r in top or ()], np.int64).reshape(-1, 2)
    schema = [*slices.schema["docs"].dataType.elementType, *StructType.fromDDL("term string, tf long")]
    schema += StructType.fromDDL("n long, term_no int") if numbered else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, doc, place, times, terms in _open(batch):
                more = []
                if top is not None:
                    known = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy()[place]
                    found = known >= 0
                    doc, place, times, known = doc[found], place[found], times[found], known[found]
                    more = [pa.array(numbers[known, 0]), pa.array(numbers[known, 1].astype(np.int32))] if numbered else []
                columns = [*(x.take(pa.array(doc)) for x in held.flatten()), terms.take(pa.array(place)), pa.array(times), *more]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return _bare(slices).mapInArrow(run, StructType(schema))


def term_counts(docs: DataFrame, keys: list[str], text: str, stop_words: list[str]) -> DataFrame:
    """(keys, term, tf) without stop words."""
    return _each(counted(docs, keys, text, stop_words), keys)


def vocabulary(counts: DataFrame, n_terms: int) -> DataFrame:
    """(term, n) of the ``n_terms`` most frequent terms, ties alphabetical: a bounded top-n."""
    return counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(n_terms)


def _followed(words: DataFrame, tracked: int) -> DataFrame:
    """One row (n_words, bound, hashes): the most frequent hashes of terms, at most ``tracked``. No row without words.

    A hash that is not among them comes at most ``bound`` times: the least estimate of a named one, and estimates are
    never too low. Each task fills one sketch; they are merged in two levels, so no task merges those of all others.
    """
    hashed = words.select(F.xxhash64("term").alias("h"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
    merged = hashed.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.count("*").alias("n"))
    merged = merged.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n_words"))
    found = merged.select("n_words", F.expr(f"approx_top_k_estimate(s, {tracked})").alias("top"))
    return found.select("n_words", F.array_min("top.count").alias("bound"), F.col("top.item").alias("hashes"))


def frequent_terms(docs: DataFrame, text: str, stop_words: list[str], n_terms: int, tracked: int = TRACKED) -> DataFrame:
    """(term, n) of the ``n_terms`` most frequent terms, as ``vocabulary`` gives them, without a shuffle of rare terms.

    A first scan sketches the frequent hashes of terms, a second counts only terms with such a hash. The counts are the
    answer if the last term wanted is more frequent than anything the sketch may have missed, or if they add up to all
    words. Else the sketch is made four times as large, and beyond its largest size all terms are counted.
    The hashes are broadcast: at most ``tracked`` numbers of 64 bits, whatever the terms are. Null texts have no terms.
    """
    return _frequent(_words(docs, [], text, stop_words).withColumn("tf", F.lit(1).cast("long")), n_terms, tracked)


def _frequent(counts: DataFrame, n_terms: int, tracked: int) -> DataFrame:
    """``frequent_terms`` of words that come as (term, tf), a term any number of times."""
    tracked = max(tracked, n_terms)
    while tracked <= MAX_TRACKED:
        words = counts.select(F.explode(F.array_repeat("term", F.col("tf").cast("int"))).alias("term"))
        followed = materialize(_followed(words, tracked), "frequent-hashes")
        known = F.broadcast(followed.select(F.explode("hashes").alias("h")))
        found = counts.join(known, F.xxhash64("term") == F.col("h"), "left_semi").groupBy("term").agg(F.sum("tf").alias("n"))
        found = materialize(found, "frequent-terms")
        top = found.orderBy(F.desc("n"), "term").limit(n_terms)
        n_words, bound = followed.select("n_words", "bound").first() or (0, 0)
        size, least = top.agg(F.count("*"), F.min("n")).first()
        if size == n_terms and least > bound or (found.agg(F.sum("n")).first()[0] or 0) == n_words:
            return top
        tracked *= 4
    return vocabulary(counts, n_terms)


def numbered_vocabulary(counts: DataFrame, n_terms: int) -> DataFrame:
    return numbered(vocabulary(counts, n_terms))


def numbered(top: DataFrame) -> DataFrame:
    """(term, n, term_no), numbered in rank order.

    A vocabulary, a bounded number of rows, is numbered as one sorted array.
    """
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))).alias("a"))
    return top.select(F.posexplode("a").alias("term_no", "e")).select(
        F.col("e.term").alias("term"), (-F.col("e.m")).alias("n"), "term_no"
    )


def vocabulary_counts(
    docs: DataFrame, keys: list[str], text: str, stop_words: list[str], n_terms: int, numbered_terms: bool = True
) -> DataFrame:
    """(keys, term, tf, n, term_no): the term counts that are in the vocabulary; n and term_no if asked for.

    The counts are stored once, as the vocabulary and the result both read them. The vocabulary comes from the totals of the
    slices. It goes to the tasks: at most ``n_terms`` rows.
    """
    slices = counted(docs, keys, text, stop_words)
    top = numbered_vocabulary(_totals(slices).select("term", "tf"), n_terms).collect()
    return _each(slices, keys, top, numbered_terms)


def frequent_counts(
    docs: DataFrame, keys: list[str], text: str, stop_words: list[str], n_terms: int, tracked: int = TRACKED,
    numbered_terms: bool = True,
) -> DataFrame:
    """``vocabulary_counts`` for texts with far more terms than the vocabulary takes.

    The vocabulary comes first, by the sketch of ``frequent_terms``, so other terms are not shuffled. The words are counted once,
    and all scans read the stored slices.
    """
    slices = counted(docs, keys, text, stop_words)
    top = numbered(_frequent(_totals(slices).select("term", "tf"), n_terms, tracked)).collect()
    return _each(slices, keys, top, numbered_terms)


def document_vectors(
    docs: DataFrame, keys: list[str], text: str, stop_words: list[str], n_terms: int, tfidf: bool = False
) -> DataFrame:
    """One row per document: (keys, terms ARRAY<INT>, weights ARRAY, norm2), written once as a table.

    ``terms`` is ascending. Weights are counts (whole numbers, so dot products and ``norm2`` are exact), or
    ``tf * (ln((1 + n) / (1 + df)) + 1)`` with ``tfidf``. A document without any vocabulary term has no row, as its
    cosine with everything is zero.
    """
    slices = counted(docs, keys, text, stop_words)
    top = _totals(slices).groupBy("term").agg(F.sum("tf").alias("n"), F.sum("df").alias("df")).orderBy(F.desc("n"), "term").limit(n_terms)
    idf = F.log(F.lit(1.0 + docs.count()) / (1 + F.col("df"))) + 1.0 if tfidf else F.lit(1).cast("long")
    known = top.select("term", idf.alias("idf")).collect()  # the vocabulary, in the order of its numbers
    names, factors = pa.array([r["term"] for r in known], pa.string()), np.array([r["idf"] for r in known], np.float64 if tfidf else np.int64)
    number = DoubleType() if tfidf else LongType()
    schema = StructType([*slices.schema["docs"].dataType.elementType, StructField("terms", ArrayType(IntegerType())),
                         StructField("weights", ArrayType(number)), StructField("norm2", number)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, doc, place, times, terms in _open(batch):
                yield _vectors(held, keys, doc, pc.index_in(terms, value_set=names), place, times, factors)

    return materialize(_bare(slices).mapInArrow(build, schema), "vectors")


def _vectors(held: pa.StructArray, keys: list[str], row: np.ndarray, numbers: pa.Array, place: np.ndarray, times: np.ndarray,
             factors: np.ndarray) -> pa.RecordBatch:
    """Vectors of the documents of a slice, without those that have no term of the vocabulary."""
    term = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False)[place]
    row, term, weight = row[term >= 0], term[term >= 0], times[term >= 0]
    order = np.lexsort((term, row))
    row, term, weight = row[order], term[order], weight[order]
    weight = weight * factors[term]
    kept, first = np.unique(row, return_index=True)
    norm2 = np.add.reduceat(weight * weight, first) if len(first) else weight
    ends = pa.array(np.append(first, len(row)), pa.int32())
    columns = [x.take(pa.array(kept)) for x in held.flatten()]
    made = [pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight)), pa.array(norm2)]
    return pa.RecordBatch.from_arrays([*columns, *made], names=[*keys, "terms", "weights", "norm2"])
