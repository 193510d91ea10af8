"""Mixing sources to target shares of the tokens, by raking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.text import BLANK
from sieveline.storage import attach, materialise

#: Rounds of raking at most, and the relative change at which it ends; whether it did is reported.
ROUNDS, SETTLED = 300, 1e-6
#: Language and topic of a document that has none, and topic of one beyond the classes.
NONE, OTHER = "none", "other"
#: Classes of topics: the subjects with the most tokens; all others are one more class.
TOPICS = 24
#: Places on the scale on which documents are drawn, as powers of two: in all, and told apart in one pass.
PLACE_BITS, PASS_BITS = 48, 12
#: Documents of a source of a mix that are ordered one by one at the edge of the draw.
EDGE_ROWS = 20_000


def trimmed(column: str | Column) -> Column:
    """Without white space around it, lower-cased."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column, F.lit(BLANK)))


def clean_source(column: str | Column) -> Column:
    """Trimmed and lower-cased; empty is null."""
    c = trimmed(column)
    return F.when(c != "", c)


def clean_lang(column: str | Column) -> Column:
    """Trimmed, lower-cased, without the region."""
    c = F.substring_index(trimmed(column), "-", 1)
    return F.when(c != "", c)


def subject(title: str | Column) -> Column:
    """The topic a title names: its last word, lower-cased; null without one."""
    c = F.regexp_extract(trimmed(title), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    return F.when(c != "", c)


def rake(tokens: np.ndarray, source: np.ndarray, margins: Sequence[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Times each cell is used, so that each source reaches its goal of tokens, or as near as its cap lets it; and the
    rounds it took with the relative change of the last one.

    tokens: of each cell; source: its source; margins: for language and topic, the class of each cell and the
    wished share of each class; goal and cap: of each source. Each round scales the cells to the shares of one
    margin after the other, then every source to its goal within its cap, spreading what a full cell can not
    take over the others. The source comes last, so its shares hold exactly where they can.
    """
    times, whole = np.zeros(len(tokens)), goal.sum()
    some = tokens > 0
    held = np.bincount(source, tokens, len(goal))
    times[some] = np.minimum(cap[source], np.where(held > 0, goal / np.maximum(held, 1e-300), 0)[source])[some]
    change, done = 0.0, 0
    for done in range(1, ROUNDS + 1):
        before = times.copy()
        for label, share in margins:
            now = np.bincount(label, times * tokens, len(share))
            fit = now.sum() if now.sum() else whole
            times = times * np.where(now > 0, share * fit / np.maximum(now, 1e-300), 1.0)[label]
        for s in range(len(goal)):
            own = np.flatnonzero((source == s) & some)
            if len(own):
                times[own] = _fill(np.maximum(times[own], 1e-12), tokens[own], goal[s], cap[s])
        change = float(np.abs(times - before).max(initial=0.0) / max(1.0, np.abs(times).max(initial=0.0)))
        if change <= SETTLED:
            break
    return times, done, change


def _fill(times: np.ndarray, tokens: np.ndarray, goal: float, cap: float) -> np.ndarray:
    """times in proportion, scaled so that they use `goal` tokens, none above cap."""
    if np.isfinite(cap) and cap * tokens.sum() <= goal:
        return np.full(len(tokens), cap)
    full = np.zeros(len(tokens), bool)
    while True:
        rest = goal - cap * tokens[full].sum() if full.any() else goal
        scaled = times * (rest / (times[~full] * tokens[~full]).sum())
        over = ~full & (scaled > cap)
        if not over.any():
            return np.where(full, cap, scaled)
        full |= over


def _rake_mix(cells: pd.DataFrame) -> pd.DataFrame:
    wished = cells.drop_duplicates("source").sort_values("source")
    code = {s: i for i, s in enumerate(wished["source"])}
    source = cells["source"].map(code).to_numpy()
    tokens = cells["tokens"].fillna(0).to_numpy(float)
    margins = []
    for name in ("lang", "topic"):
        labels, names = pd.factorize(cells[name].fillna(NONE))
        share = cells.assign(label=labels).groupby("label")[f"{name}_share"].first().reindex(range(len(names))).fillna(0).to_numpy(float)
        if share.sum() > 0:
            margins.append((labels, share / share.sum()))
    goal, cap = wished["goal"].to_numpy(float), wished["max_repeats"].fillna(np.inf).to_numpy(float)
    times, rounds, change = rake(tokens, source, margins, goal, np.maximum(cap, 0))
    made = cells.assign(times=times, rounds=rounds, settled=change <= SETTLED)
    return made[["mix_id", "source", "lang", "topic", "tokens", "docs", "longest", "share", "goal", "max_repeats", "lang_share", "topic_share", "times", "rounds", "settled"]]


CELLS = "mix_id string, source string, lang string, topic string, tokens long, docs long, longest long, share double, goal double, max_repeats double, lang_share double, topic_share double, times double, rounds int, settled boolean"


def clean_targets(targets: DataFrame) -> DataFrame:
    """(mix_id, source, share, max_repeats) of wishes: repeated rows once, weights in proportion within a mix.

    Rows without mix or source, or with a weight that is null, not finite or not above 0, are left out; of several
    rows for a source of a mix the weights add up and the smallest cap holds; null or negative caps are no cap.
    """
    weight = F.col("weight").cast("double")
    rows = targets.select("mix_id", clean_source("source").alias("source"), weight.alias("weight"), F.when(F.col("max_repeats") >= 0, F.col("max_repeats").cast("double")).alias("max_repeats")).distinct()
    rows = rows.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull() & (F.col("weight") > 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight"))
    rows = rows.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    whole = rows.groupBy("mix_id").agg(F.sum("weight").alias("whole"))
    return rows.join(whole, "mix_id").select("mix_id", "source", (F.col("weight") / F.col("whole")).alias("share"), "max_repeats")


def calibrate(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells (mix, source, language, topic) with `times`, how often a document of the cell is used on average.

    docs: doc_id, source, lang, topic, tokens, as clean_docs gives them. A mix is as large as the corpus: the tokens of
    all documents with a source. Language and topic keep the shares they have in the documents of the mix's
    sources. The table of cells has a row for each class, whatever the number of documents; each mix is raked in a task.
    A source without documents has one cell without tokens.

    - documents without source do not take part; language and topic are `none` where null. Documents of no tokens
      are used like the others of their cell. Repeated rows of docs count as documents: see once_per_key.
    - no documents: every source misses its share. No targets: an empty result. Other columns are ignored.
    """
    cells = materialise(docs.where(F.col("source").isNotNull()).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"), F.max("tokens").alias("longest")), "cells")
    corpus = cells.agg(F.sum("tokens")).first()[0] or 0
    wished = clean_targets(targets)
    rows = wished.join(cells, "source", "left").select("mix_id", "source", "lang", "topic", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("longest", F.lit(0)).alias("longest"), "share", (F.col("share") * F.lit(float(corpus))).alias("goal"), "max_repeats")
    for name in ("lang", "topic"):
        own = rows.groupBy("mix_id", name).agg(F.sum("tokens").cast("double").alias(f"{name}_tokens"))
        own = own.join(own.groupBy("mix_id").agg(F.sum(f"{name}_tokens").alias("all")), "mix_id").select("mix_id", name, F.try_divide(f"{name}_tokens", "all").alias(f"{name}_share"))
        own = own.withColumnRenamed(name, "__l").withColumnRenamed("mix_id", "__m")
        rows = rows.join(own, (F.col("mix_id") == F.col("__m")) & F.col(name).eqNullSafe(F.col("__l"))).drop("__l", "__m")
    return materialise(rows.groupBy("mix_id").applyInPandas(_rake_mix, CELLS), "raked")


def clean_docs(docs: DataFrame, topic: str | None = None, topics: int = TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) ready for calibrate.

    topic: a column of subjects, or none. The `topics` subjects with the most tokens (then by name) are classes of their own;
    the others are `other`, no subject is `none`, so that the number of cells does not grow with the documents.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", clean_source("source").alias("source"), F.coalesce(clean_lang("lang"), F.lit(NONE)).alias("lang"), (F.col(topic).cast("string") if topic else F.lit(None).cast("string")).alias("topic"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    if not topic:
        return rows.withColumn("topic", F.lit(NONE))
    large = rows.where("topic is not null").groupBy("topic").agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), "topic").limit(topics)
    kinds = F.broadcast(large.select("topic", F.col("topic").alias("kind")))
    kind = F.coalesce("kind", F.when(F.col("topic").isNull(), F.lit(NONE)).otherwise(F.lit(OTHER)))
    return rows.join(kinds, "topic", "left").select("doc_id", "source", "lang", kind.alias("topic"), "tokens")


def select_documents(docs: DataFrame, cells: DataFrame, seed: str = "mix") -> DataFrame:
    """(mix_id, doc_id, source, lang, topic, tokens, copies): the documents of each mix, with how often each is used, at least once.

    The whole part of a cell's times is certain; the rest is drawn with that probability, so that the drawn tokens of
    a source are off by half a document at most: documents stand on a scale at a hash of mix and document over their
    probability, and each source takes them from the start until its tokens are reached (sequential Poisson
    sampling). Where that is on the scale is found by sums over parts of the scale, each pass within the part of the
    pass before; only the documents of the last part are ordered one by one. The same documents come out every time.
    No document is used more than max_repeats times. Repeated rows of docs count as documents.
    """
    spark = docs.sparkSession
    used = cells.where("times > 0").select("mix_id", "source", "lang", "topic", "times", "max_repeats")
    whole = F.floor(F.col("times") + 1e-9)
    part = F.when(F.col("times") - whole > 1e-9, F.col("times") - whole).otherwise(0.0)
    goals = cells.where("times > 0").groupBy("mix_id", "source").agg(F.sum(part * F.col("tokens")).alias("goal"))
    drawn = attach(docs.select("doc_id", "source", "lang", "topic", "tokens"), used, ["source", "lang", "topic"])
    chance = (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    at = chance / F.when(part > 0, part)
    drawn = drawn.select("mix_id", "doc_id", "source", "lang", "topic", "tokens", whole.alias("whole"), part.alias("part"), F.col("max_repeats"), F.floor(at / (at + 1.0) * float(1 << PLACE_BITS)).alias("place"))

    # (mix, source): places below `low` are drawn, those of [low, high) are in question, `rest` tokens are still wanted
    open_ = [(r["mix_id"], r["source"], 0, 1 << PLACE_BITS, r["goal"]) for r in goals.collect()]  # a row for each wish
    shift, fields = PLACE_BITS, "mix_id string, source string, low long, high long, rest double"
    while True:
        edges = F.broadcast(spark.createDataFrame(open_, fields))
        asked = drawn.where("part > 0").join(edges, ["mix_id", "source"]).where("place >= low and place < high")
        shift -= PASS_BITS
        step = F.shiftright(F.col("place"), shift)
        sums = asked.groupBy("mix_id", "source", step.alias("step")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        order = Window.partitionBy("mix_id", "source").orderBy("step")
        upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
        # the first part in which the goal is reached
        reached = sums.withColumn("upto", upto).where("upto >= rest").groupBy("mix_id", "source").agg(F.min(F.struct("step", "upto", "tokens", "n", "rest")).alias("s")).select("mix_id", "source", "s.*").collect()
        ends = {(r["mix_id"], r["source"]): r for r in reached}
        narrowed = []
        for mix_id, source, low, high, rest in open_:
            r = ends.get((mix_id, source))
            # beyond the last document where rounding keeps the goal out of reach
            narrowed.append((mix_id, source, high, high, 0.0) if r is None else (mix_id, source, r["step"] << shift, (r["step"] + 1) << shift, rest - (r["upto"] - r["tokens"])))
        open_ = narrowed
        if shift <= 0 or max((r["n"] for r in reached), default=0) <= EDGE_ROWS:
            break
    if not open_:
        return drawn.select("mix_id", "doc_id", "source", "lang", "topic", "tokens", F.lit(0).cast("long").alias("copies")).limit(0)
    placed = drawn.join(F.broadcast(spark.createDataFrame(open_, fields)), ["mix_id", "source"])
    edge = placed.where("part > 0 and place >= low and place < high")
    before = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    edge = edge.withColumn("more", (before <= F.col("rest")).cast("long"))
    sure = placed.where("not (part > 0 and place >= low and place < high)").withColumn("more", F.when((F.col("part") > 0) & (F.col("place") < F.col("low")), 1).otherwise(0).cast("long"))
    copies = F.least((F.col("whole") + F.col("more")).cast("double"), F.coalesce("max_repeats", F.lit(float("inf")))).cast("long")
    return sure.unionByName(edge).withColumn("copies", copies).where("copies > 0").select("mix_id", "doc_id", "source", "lang", "topic", "tokens", "copies")


def shares(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each source of each mix: wished share and tokens, what the chosen documents have of both, their number and the most
    copies of one, whether raking settled, and whether the source misses its share: it has no tokens, or all its
    documents at the cap fall short of the wish.
    """
    own = cells.groupBy("mix_id", "source").agg(
        F.first("share").alias("wished_share"), F.first("goal").alias("wished_tokens"), F.first("max_repeats").alias("max_repeats"), F.sum("tokens").alias("source_tokens"), F.sum("docs").alias("source_docs"), F.max("longest").alias("longest_doc"), F.first("rounds").alias("rounds"), F.first("settled").alias("settled")
    )
    real = materialise(chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("actual_docs"), F.max("copies").alias("most_copies")), "chosen")
    whole = F.broadcast(real.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mix_tokens")))
    real = real.join(whole, "mix_id").select("mix_id", "source", "actual_tokens", "actual_docs", "most_copies", F.try_divide("actual_tokens", "mix_tokens").alias("actual_share"))
    made = own.join(real, ["mix_id", "source"], "left").na.fill(0, ["actual_tokens", "actual_docs", "most_copies", "actual_share"])
    short = F.col("actual_tokens") < F.col("wished_tokens") * (1 - 1e-9)
    return made.withColumn("misses", (F.col("source_tokens") == 0) | (short & (F.col("actual_tokens") >= F.col("source_tokens") * F.coalesce("max_repeats", F.lit(float("inf"))))))


def margins(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """(mix_id, margin, class, wished_share, raked_share, actual_share): what language and topic were to have of a mix, what the
    raked cells give them, and what the chosen documents have."""
    out = []
    for name in ("lang", "topic"):
        raked = cells.where("lang is not null").groupBy("mix_id", name).agg(F.max(f"{name}_share").alias("wished_share"), F.sum(F.col("times") * F.col("tokens")).alias("raked"))
        real = chosen.groupBy("mix_id", name).agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual"))
        both = raked.join(real, ["mix_id", name], "left").na.fill(0, ["actual"])
        of_mix = Window.partitionBy("mix_id")
        out.append(both.select("mix_id", F.lit(name).alias("margin"), F.col(name).alias("class"), "wished_share", F.try_divide(F.col("raked"), F.sum("raked").over(of_mix)).alias("raked_share"), F.try_divide(F.col("actual"), F.sum("actual").over(of_mix)).alias("actual_share")))
    return out[0].unionByName(out[1])
