"""The queries pN_ over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import bpe, distinctive, fuse, mix, neighbours, reading, split, topn
from sieveline.operators import dense
from sieveline.storage import attach, materialise, once_per_key

WINDOW, OVERLAP, DIM = 512, 48, 32


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 1: splitting


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(_table(spark, folder, "documents"), ["doc_id"], "text", WINDOW, OVERLAP)


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text above the window: its pieces are within it, share 48 positions each with the one before, and hold the whole text in order."""
    rows = p1_pieces(spark, folder)
    later = F.coalesce(F.col("piece_start") > F.lag("piece_start").over(Window.partitionBy("doc_id").orderBy("piece_no")), F.lit(True))
    each = rows.distinct().withColumn("later", later).groupBy("doc_id").agg(
        F.max("text_size").alias("size"), (F.max("piece_size") <= WINDOW).alias("within"), (F.sum(F.col("piece_size") - 2) - OVERLAP * (F.count("*") - 1) == F.max("text_size") - 2).alias("shared"),
        (F.bool_and("later") & (F.max("piece_no") + 1 == F.max("n_pieces")) & (F.count("*") == F.max("n_pieces")) & (F.max_by("ends_at", "piece_no") == "end")).alias("whole"),
    )
    return each.select("doc_id", F.col("size").cast("long").alias("size"), "within", "shared", "whole")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split.split_oversized(_table(spark, folder, "documents"), ["doc_id", "build_id"], "text", WINDOW, OVERLAP)
    over = materialise(pieces.where("piece_no = 0").select("doc_id", "build_id", "text_size", "longest_sentence").distinct(), "over")
    counts = over.groupBy("build_id").agg(F.countDistinct("doc_id").alias("n"))
    builds = _table(spark, folder, "builds").where("passages_over_window is not null and build_id is not null").select("build_id", "passages_over_window").distinct()
    wrong = builds.join(counts, "build_id", "left").where(F.col("passages_over_window") != F.coalesce("n", F.lit(0)))
    return (
        over.select(F.lit("over_window").alias("case_kind"), F.col("doc_id").alias("case_id")).distinct()
        .unionByName(over.where(F.col("longest_sentence") > WINDOW).select(F.lit("no_boundary").alias("case_kind"), F.col("doc_id").alias("case_id")).distinct())
        .unionByName(wrong.select(F.lit("build_count").alias("case_kind"), F.col("build_id").alias("case_id")).distinct())
    )


# 2: distinctive terms


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.distinctive_terms(_table(spark, folder, "documents"), "doc_id", "text")
    return scores.withColumns({c: F.round(c, 6) for c in ("expected", "residual", "adjusted")})


def p2_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.most_distinctive(p2_scores(spark, folder), "doc_id", 5)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = p2_scores(spark, folder).where((F.col("tf") >= 3) & F.col("df").between(2, 8) & (F.length("term") >= 4) & F.col("term").rlike("^[a-z\\u00DF-\\u024F]+$"))
    return marked.select("doc_id", "term")


# 3: similar vectors


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(neighbours.live_vectors(_table(spark, folder, "mutations"), DIM), DIM, 10)


def p3_recall(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """Of every live vector whose id is divisible by 100 the true k nearest by a scan of all vectors: how many ids, and whether at least
    0.95 of the true neighbours are found."""
    live = materialise(neighbours.live_vectors(_table(spark, folder, "mutations"), DIM), "live")
    asked = live.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    true = dense.knn(live.withColumnRenamed("id", "doc_id"), asked, k + 1, "cosine", digits=12, dim=DIM).where("query_id != doc_id")
    # without the vector itself there are k or k + 1 left: the first k count
    true = true.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k).select(F.col("query_id").alias("id"), F.col("doc_id").alias("neighbour"))
    found = neighbours.nearest(live, DIM, k).where(F.col("id") % 100 == 0).select("id", "neighbour", F.lit(1).alias("hit"))
    counted = true.join(found, ["id", "neighbour"], "left").agg(F.count("*").alias("all"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return counted.join(F.broadcast(asked.agg(F.count("*").alias("ids")))).select("ids", (F.col("hits") >= F.col("all") * 0.95).alias("enough"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.mutual(p3_neighbours(spark, folder), 0.98)


# 4: top N within groups


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each passage of a query the row scored last, with the query's k; equal times: the higher score."""
    wanted = _table(spark, folder, "fusion").where("query_id is not null and k >= 1").groupBy("query_id").agg(F.max("k").alias("k"))
    rows = _table(spark, folder, "results").where("query_id is not null and id is not null").select("query_id", "id", "score", "scored_at")
    last = rows.groupBy("query_id", "id").agg(F.max(F.struct("scored_at", "score")).alias("last")).select("query_id", "id", "last.score")
    return materialise(attach(last, materialise(wanted, "wanted"), ["query_id"]), "latest")


def p4_results(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(_latest(spark, folder), ["query_id"], "score", ["id"], "k").select("query_id", "id", "score", "rank")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    best = p4_results(spark, folder).select(F.lit("results").alias("origin"), F.col("query_id").alias("group_id"), F.col("id").alias("item_id"))
    cases = _table(spark, folder, "fusion").where("id is not null and k >= 1 and expected is not null").select("id", "k", "expected").distinct()
    items = cases.select(F.col("id").alias("group_id"), "k", F.explode("expected").alias("x")).select("group_id", "k", F.col("x.id").alias("item_id"), F.col("x.score").alias("score"))
    # a passage that a list repeats takes one place, by its highest finite score
    items = items.where("item_id is not null and not isnan(score) and abs(score) < double('infinity')")
    items = materialise(items.groupBy("group_id", "item_id").agg(F.max("score").alias("score"), F.max("k").alias("k")), "expected")
    fused = topn.top_n(items, ["group_id"], "score", ["item_id"], "k").select(F.lit("fusion").alias("origin"), "group_id", "item_id")
    return best.unionByName(fused)


# 5: one ranking from several scores


def _best_of(items: str, values: str) -> object:
    return F.explode(F.arrays_zip(F.col(items).alias("item"), F.col(values).alias("value")))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, case_id, item_id, first, second): every scored item of the cases without a recorded answer.

    Of an item that a list holds twice the higher score counts.
    """
    fusion = _table(spark, folder, "fusion").where("id is not null and expected is null").select(F.lit("fusion").alias("origin"), F.col("id").alias("case_id"), F.col("lexical").alias("a"), F.col("lexical_scores").alias("x"), F.col("dense").alias("b"), F.col("dense_scores").alias("y"))
    order = _table(spark, folder, "pipeline_order").where("name is not null and expected is null").select(F.lit("pipeline_order").alias("origin"), F.col("name").alias("case_id"), F.col("fused").alias("a"), F.col("fused_scores").alias("x"), F.slice("fused", 1, F.size("scores")).alias("b"), F.col("scores").alias("y"))
    cases = fusion.unionByName(order.where("scores is not null")).distinct()

    def scored(items: str, values: str, name: str):
        return F.transform(F.arrays_zip(F.col(items).alias("item"), F.col(values).alias("value")), lambda z: F.struct(z["item"].alias("item_id"), F.when(F.lit(name == "first"), z["value"]).alias("first"), F.when(F.lit(name == "second"), z["value"]).alias("second")))

    none = F.array().cast("array<struct<item_id:long,first:double,second:double>>")
    both = F.concat(F.coalesce(scored("a", "x", "first"), none), F.coalesce(scored("b", "y", "second"), none))
    items = cases.select("origin", "case_id", F.explode(both).alias("z")).select("origin", "case_id", "z.*").where("item_id is not null")

    def real(c: str):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))

    return items.groupBy("origin", "case_id", "item_id").agg(F.max(real("first")).alias("first"), F.max(real("second")).alias("second"))


def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    items = _cases(spark, folder).where("origin = 'fusion' or (first is not null and second is not null)")
    return fuse.combine_scores(materialise(items, "cases"), ["origin", "case_id"], ["first", "second"], missing="last")


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder).select("origin", "case_id", "item_id", (F.col("first") + 0.0).alias("first"), (F.col("second") + 0.0).alias("second"), F.round("combined", 6).alias("combined"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    ranking = materialise(_ranking(spark, folder), "ranking")
    return topn.top_n(ranking, ["origin", "case_id"], "combined", ["item_id"], 1).select("origin", "case_id", "item_id")


# 6: encoding


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, folder, "documents"), ["doc_id"], "text")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that do not come back from their ids: none."""
    docs = _table(spark, folder, "documents")
    back = bpe.decode_ids(bpe.encode_texts(docs.withColumn("was", F.coalesce("text", F.lit(""))), ["doc_id", "was"], "text"), ["doc_id", "was"], "ids")
    return back.select((F.col("text") == F.col("was")).alias("same")).groupBy("same").agg(F.count("*").alias("texts"))


# 7: mixing


def _mix_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = once_per_key(_table(spark, folder, "documents").select("doc_id", "source", "lang", "title", "text"), "doc_id")
    docs = docs.select("doc_id", "source", "lang", mix.subject("title").alias("subject"), "text")
    counted = materialise(bpe.count_tokens(docs, ["doc_id", "source", "lang", "subject"], "text"), "counted")
    return materialise(mix.clean_docs(counted, "subject"), "tokens")


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    docs = _mix_docs(spark, folder)
    return mix.select_documents(docs, mix.calibrate(docs, _table(spark, folder, "mix_targets")))


def _mixed(spark: SparkSession, folder: str, report) -> DataFrame:
    docs = _mix_docs(spark, folder)
    cells = mix.calibrate(docs, _table(spark, folder, "mix_targets"))
    return report(cells, mix.select_documents(docs, cells))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder, mix.shares)


def p7_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of languages and topics, wished, raked and reached."""
    return _mixed(spark, folder, mix.margins)


def p7_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source reaches its wish, or what its cap leaves of it, within half of its longest document, in few enough copies."""
    most = F.least(F.col("wished_tokens"), F.col("source_tokens") * F.coalesce("max_repeats", F.lit(float("inf"))))
    near = F.abs(F.col("actual_tokens") - F.when(F.col("source_tokens") > 0, most).otherwise(0.0)) <= F.col("longest_doc") / 2 + 1
    few = F.col("most_copies") <= F.coalesce("max_repeats", F.lit(float("inf")))
    return p7_shares(spark, folder).select("mix_id", "source", near.alias("near"), few.alias("few"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_shares(spark, folder).where("misses").select("mix_id", "source")


# 8: reading level


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return reading.reading_levels(docs, reading.train(docs, _table(spark, folder, "reading_labels")))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("level is not null")


def p8_measures(spark: SparkSession, folder: str) -> DataFrame:
    """What the levels are told from: words, sentences and their means."""
    return _levels(spark, folder).select("doc_id", "words", "sentences", F.round("words_per_sentence", 6).alias("words_per_sentence"), F.round("letters_per_word", 6).alias("letters_per_word"))


def p8_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The bands of p8_found against the levels of the model, which has not seen the bounds: how many documents, and whether 0.98 of them
    have a level above (hard) or below (easy) the middle of the scale."""
    rows = _banded(spark, folder)
    right = F.when(F.col("band") == "hard", F.col("level") > 3.0).otherwise(F.col("level") < 3.0)
    return rows.groupBy("band").agg(F.count("*").alias("documents"), (F.avg(right.cast("double")) >= 0.98).alias("right"))


def p8_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Rated documents, and whether models that have not seen a document's source explain half of the variance of the ratings."""
    model = reading.train(_table(spark, folder, "documents"), _table(spark, folder, "reading_labels"))
    return spark.createDataFrame([(sum(r[1] for r in model.validation), model.explained >= 0.5)] if model else [], "rated long, close boolean")


def p8_validation(spark: SparkSession, folder: str) -> DataFrame:
    model = reading.train(_table(spark, folder, "documents"), _table(spark, folder, "reading_labels"))
    return spark.createDataFrame(model.validation if model else [], reading.VALIDATION)


def _banded(spark: SparkSession, folder: str) -> DataFrame:
    rows = _levels(spark, folder).where("lang = 'en' and words >= 30")
    hard = (F.col("words_per_sentence") >= 18) & (F.col("letters_per_word") >= 6.0)
    easy = (F.col("words_per_sentence") <= 10) & (F.col("letters_per_word") <= 4.2)
    return rows.select("doc_id", F.when(hard, "hard").when(easy, "easy").alias("band"), "level").where("band is not null").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose sentences and words lie beyond the bounds, whatever level the model gives them: the problem states the bands as
    a rule. p8_bands compares them with the levels."""
    return _banded(spark, folder).select("doc_id", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p2_found, p2_scores, p2_top_terms, p3_found, p3_neighbours, p3_recall, p4_found, p4_results, p5_found, p5_ranking, p6_ids, p6_decoded, p7_found, p7_shares, p7_selection, p7_margins, p7_reached, p8_found, p8_levels, p8_measures, p8_bands, p8_agreement, p8_validation)}
